"""Cleaning with repairs: private signs become their phrases, misread words their right ones, presentation forms plain letters."""

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import text as tx

# fixed values: what the signs of one symbol font stand for
PRIVATE_PHRASES = {
    "": "صلى الله عليه وسلم",
    "": "عليه السلام",
    "": "عليه السلام",
    "": "عليه السلام",
    "": "صلى الله تعالى عليه وسلم",
    "": "تبارك وتعالى",
    "": "رضي الله عنه",
    "": "رضي الله عنه",
    "": "رضي الله عنه",
    "": "رضي الله عنهم",
    "": "رضي الله عنهن",
    "": "رحمه الله",
    "": "رحمه الله",
}
# fixed values: misread words and the right ones, in the order in which they are put right
_LETTER = "[\\u0621-\\u063A\\u0641-\\u064A]"
_WHOLE = f"(?<!{_LETTER}){{0}}(?!{_LETTER})"
MISREAD = (
    ("اﷲ", "الله"),
    ("ﷲ", "الله"),
    (_WHOLE.format("الكرمي"), "الكريم"),
    (_WHOLE.format("الرحمي"), "الرحيم"),
    (_WHOLE.format("االسالمية"), "الاسلامية"),
    (_WHOLE.format("اإلسالمية"), "الإسلامية"),
    ("اهلل", "الله"),
    (f"هللا(?!{_LETTER})", "الله"),
    (f"وهلل(?!{_LETTER})", "والله"),
    ("(^|[ \\t\\r\\n(«\"“،.:؛؟!ـ-])اال", "$1ال"),
    ("(?<![\\u0621-\\u064A])امل(?=[\\u0621-\\u063A\\u0641-\\u064A]{2})", "الم"),
)
PRESENTATION = "[\\uFB50-\\uFDFF\\uFE70-\\uFEFF]"
_FORMS = re.compile("[ﭐ-﷿ﹰ-﻿]+")


@F.pandas_udf(T.StringType())
def plain_forms(s: pd.Series) -> pd.Series:
    """NFKC of presentation forms alone; other signs that NFKC would change stay."""
    return s.map(lambda x: x if x is None or x.isascii() else _FORMS.sub(lambda m: unicodedata.normalize("NFKC", m[0]), x))


def repaired(c: Column) -> Column:
    """Private signs and misread words put right, then presentation forms made plain. Each step is computed once: Python sees all values, for what it is spared would be worked out again beside it.

    Direction marks and controls are to be gone before, as they may stand inside a word.
    """
    signs = "".join(PRIVATE_PHRASES)
    spelt = lambda t: reduce(lambda out, p: F.replace(out, F.lit(p[0]), F.lit(p[1])), PRIVATE_PHRASES.items(), t)
    out = tx.once(c, lambda t: F.when(t.rlike(f"[{signs}]"), spelt(t)).otherwise(t))
    return plain_forms(tx.once(out, lambda t: F.when(t.rlike("[اهﷲو]"), tx.replaced(t, *MISREAD)).otherwise(t)))


def clean(c: Column) -> Column:
    """``text.clean`` with repairs; null is empty."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), f"{tx.BIDI_MARKS}|{tx.CONTROLS}", "")
    return tx.clean(repaired(bare))
