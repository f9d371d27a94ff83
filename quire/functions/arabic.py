"""Arabic search forms. Spark has no NFKC, so that one step is a pandas UDF; everything after it is built-in."""

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import repairs
from quire.functions import text as tx

#: Default stop words; pass another tuple to the functions that take one.
STOP_WORDS = ("من", "الي", "علي", "عن", "في", "ما", "هو", "هي", "هذا", "هذه", "ثم", "او", "مع", "كل", "ان", "لا", "قد")
# fixed values: suffixes that a search form may lose, longest kinds first
_SUFFIXES = ("كم", "كن", "هم", "هن", "ها", "نا", "ه", "ك", "ي")


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


#: Whatever lies outside these ranges may change under NFKC; plain ASCII, Latin-1 and Arabic letters and digits don't.
_MAY_CHANGE = "[^\\x00-\\x9F\\u00A1-\\u00A7\\u00A9\\u00AB-\\u00AE\\u00B0\\u00B1\\u00B6\\u00B7\\u00BB\\u00BF-\\u00FF\\u0621-\\u0652\\u0660-\\u0669]"


def fold_nfkc(c: Column) -> Column:
    """``fold`` of the NFKC form; only values that NFKC may change are handed to Python."""
    return tx.fold(F.coalesce(nfkc(F.when(tx.beyond_ascii(c).rlike(_MAY_CHANGE), c)), c))


def normalise(c: Column) -> Column:
    """Basic Arabic and Latin letters and digits, variants of one letter united, blanks between words."""
    bare = tx.replaced(F.lower(nfkc(tx.normalise_digits(repairs.clean(c)))), (tx.VOWEL_MARKS, ""), ("ـ", ""))
    united = F.translate(bare, "إأآٱىئؤةگچپ", "اااايي" + "وهكجب")
    return tx.flat(F.regexp_replace(united, "[^\\u0621-\\u063A\\u0641-\\u064Aa-z0-9]+", " "))


# fixed values: endings that may take another's place, and the length that a word must exceed for it
_ENDINGS = (("ات", "", 4), ("ه", "ت", 4), ("ت", "ه", 4), ("ه", "", 4), ("ت", "", 4))


def search_forms(term: Column) -> Column:
    """The forms under which a term is indexed.

    A term stands beside the form with or without the article; each of these may lose one suffix after the other, in their
    order; and every form has its variants by ``_ENDINGS``. A suffix goes only if more than three letters stay.
    """
    swap = lambda f, old, new, over: F.when((F.length(f) > over) & f.endswith(old), F.concat(F.left(f, F.length(f) - len(old)), F.lit(new)))
    other = F.when(~term.startswith("ال"), F.when(F.length(term) > 3, F.concat(F.lit("ال"), term))).otherwise(F.when(F.length(term) > 4, F.right(term, F.length(term) - 2)))
    forms = F.array_compact(F.array(term, other))
    least = forms
    grown = lambda rules: lambda held: F.array_union(held, F.array_compact(F.flatten(F.transform(held, lambda f: F.array(*(swap(f, *rule) for rule in rules))))))
    for rules in (*([(suffix, "", len(suffix) + 3)] for suffix in _SUFFIXES), _ENDINGS):
        forms = tx.once(forms, grown(rules))
    # both forms end as the term does: where no rule's ending is, none applies, and most words are done
    return F.when(term.rlike(f"[{''.join(sorted({e[-1] for e in (*_SUFFIXES, *(old for old, _, _ in _ENDINGS))}))}]$"), forms).otherwise(least)


def search_tokens(c: Column, stop: tuple = STOP_WORDS) -> Column:
    words = F.filter(F.split(normalise(c), " "), lambda w: (F.length(w) >= 2) & ~w.isin(list(stop)))
    return F.array_distinct(F.flatten(F.transform(F.array_distinct(words), search_forms)))
