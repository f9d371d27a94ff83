"""Model answers as VARIANT values: the object an answer holds, what is wrong if it holds none, and JSON in canonical form."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as tx

# fixed values: why an answer is refused
EMPTY, MISSING, SERIALISED, NOT_JSON = "OCR_RESPONSE_EMPTY", "OCR_RESPONSE_MISSING_TEXT_FIELD", "OCR_RESPONSE_IS_SERIALIZED_TEXT", "OCR_RESPONSE_NOT_JSON"
TEXT_FIELDS = ("text", "fullText")
_HELD = '"(text|fullText|title|summary)"[ \\t\\r\\n]*:[ \\t\\r\\n]*"'


def bare(c: Column) -> Column:
    """Without the byte order mark and white space around it; null is empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), "^\\x{FEFF}?[ \\t\\r\\n]*|[ \\t\\r\\n]*$", "")


def candidates(c: Column) -> Column:
    """Where an answer may hold its JSON, in order: inside the first fence, the whole, from the first brace to the last."""
    whole = bare(c)
    fence = F.regexp_extract(whole, "(?s)```(?:json)?[ \\t\\r\\n]*(.*?)```", 1)
    braces = F.regexp_extract(whole, "(?s)\\{.*\\}", 0)
    return F.transform(F.array(fence, whole, braces), bare)


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def objects(c: Column) -> Column:
    """The candidates that are JSON objects, as VARIANT; broken ones, arrays and scalars are left out."""
    parsed = F.transform(F.filter(candidates(c), lambda x: x.startswith("{")), F.try_parse_json)
    return F.filter(parsed, lambda v: v.isNotNull())


def object_of(c: Column) -> Column:
    """The first object that an answer holds; null if there is none."""
    return F.get(objects(c), F.lit(0))


def text_field(v: Column) -> Column:
    """The first of ``TEXT_FIELDS`` that is a string; numbers and nested values are none."""
    return F.coalesce(*(F.when(_kind(v, f"$.{f}") == "STRING", F.try_variant_get(v, f"$.{f}", "string")) for f in TEXT_FIELDS))


def reading(c: Column) -> Column:
    """struct(text, reason): an answer's text, or else why it is refused; one of both is null."""

    def told(v: Column) -> Column:
        text = text_field(v)
        reason = F.when(bare(c) == "", EMPTY).when(v.isNotNull() & text.isNull(), MISSING).when(v.isNull() & bare(c).rlike(_HELD), SERIALISED).when(v.isNull(), NOT_JSON)
        return F.struct(text.alias("text"), reason.alias("reason"))

    return tx.once(object_of(c), told)


def field(v: Column, path: str, kind: str) -> Column:
    """A value inside an object, or null where it isn't there or isn't of the kind."""
    return F.try_variant_get(v, path, kind)


def canonical(c: Column) -> Column:
    """JSON with the keys of all nested objects in order and without blanks: equal values give equal text. Null for what is no JSON, or repeats a key.

    VARIANT keeps an object's fields in order of their names, so writing it back is enough.
    """
    return F.to_json(F.try_parse_json(c))
