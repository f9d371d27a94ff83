"""Queries over JSON in model answers and stored fields, broken and nested; they join those of ``library``."""

from pyspark.sql import functions as F

from quire.functions import answers
from quire.operators import semistructured
from quire.plans.corpus import table
from quire.plans.library import R

def _answers(spark, sf):
    """An answer of each kind for every document: fenced, in words, without text, empty, cut off, plain, nested, an array, with a number as text."""
    text, d = F.col("text"), F.col("doc_id")
    body = F.to_json(F.struct("text"))
    kinds = (
        F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\n{}")), F.concat(F.lit("﻿ Sure: "), F.to_json(F.struct(text.alias("fullText"))), F.lit(" that is all")), F.lit('{"note": 1, "title": "x"}'), F.lit(" \n"),
        F.concat(F.lit('{"text": "'), F.translate(text, '{}"\\', "")), F.translate(text, '{}"', ""), F.concat(F.lit('{"a": {"text": "no", "z": [1]}, '), F.substring(body, F.lit(2), F.length(body))),
        F.concat(F.lit("["), body, F.lit("]")), F.lit('{"text": 5}'),
    )
    return table(spark, sf, "documents").select("doc_id", "text", F.get(F.array(*kinds), (d % 9).cast("int")).alias("answer"))


@R.add(
    "SELECT doc_id, CASE WHEN doc_id % 9 IN (0, 1, 6, 7) THEN text END AS text, CASE doc_id % 9 WHEN 2 THEN 'OCR_RESPONSE_MISSING_TEXT_FIELD' WHEN 3 THEN 'OCR_RESPONSE_EMPTY' WHEN 4 THEN 'OCR_RESPONSE_IS_SERIALIZED_TEXT' WHEN 5 THEN CASE WHEN translate(text, '{}\" \t\r\n', '') = '' THEN 'OCR_RESPONSE_EMPTY' ELSE 'OCR_RESPONSE_NOT_JSON' END WHEN 8 THEN 'OCR_RESPONSE_MISSING_TEXT_FIELD' END AS reason FROM documents",
    base=False,
)
def js_answer_readings(spark, sf):
    return _answers(spark, sf).select("doc_id", answers.reading(F.col("answer")).alias("r")).select("doc_id", "r.*")


@R.add(
    """SELECT doc_id, '{"a":"' || source || '","b":{"x":[1,{"c":"' || lang || '","d":null},[]],"y":' || doc_id || '},"c":' || CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE '-7' END || '}' AS value FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id % 5 = 0""",
    base=False,
)
def js_nested_canonical(spark, sf):
    """Nested values with their keys out of order; every fifth one is cut off."""
    value = F.concat(F.lit('{ "c": '), F.when(F.col("doc_id") % 2 == 0, "true").otherwise("-7"), F.lit(', "b": {"y": '), F.col("doc_id").cast("string"), F.lit(', "x": [1, {"d": null, "c": "'), "lang", F.lit('"}, [] ]}, "a": "'), "source", F.lit('"'), F.when(F.col("doc_id") % 5 == 0, "").otherwise("}"))
    return table(spark, sf, "documents").select("doc_id", answers.canonical(value).alias("value"))


@R.add("SELECT doc_id, CASE WHEN body = '' THEN raw ELSE body END AS value FROM (SELECT doc_id, translate(text, '\"\\', '') AS body, '{\"text\": \"' || translate(text, '\"\\', '') || CASE WHEN doc_id % 2 = 0 THEN '\"}' ELSE '' END AS raw FROM documents)", base=False)
def json_salvage_broken(spark, sf):
    """Stored JSON with raw line ends inside its text, every other one without an end."""
    body = F.translate("text", '"\\', "")
    raw = F.concat(F.lit('{"text": "'), body, F.when(F.col("doc_id") % 2 == 0, '"}').otherwise(""))
    return table(spark, sf, "documents").select("doc_id", semistructured.unwrapped(raw).alias("value"))


@R.add("SELECT event_id, CAST(regexp_extract(props, ': *([0-9]+)', 1) AS BIGINT) AS k, event_id % 3 = 0 AS odd FROM events", base=False)
def js_variant_fields(spark, sf):
    """A number inside each event's JSON; every third one says it in another place."""
    props = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"deep": {"k": '), F.regexp_extract("props", ": *([0-9]+)", 1), F.lit("}}"))).otherwise(F.col("props"))
    read = table(spark, sf, "events").select("event_id", F.try_parse_json(props).alias("v"))
    flat, deep = answers.field(F.col("v"), "$.k", "bigint"), answers.field(F.col("v"), "$.deep.k", "bigint")
    return read.select("event_id", F.coalesce(flat, deep).alias("k"), flat.isNull().alias("odd"))
