"""Many patterns at once: one automaton of a block of patterns runs over each text, whatever the number of patterns.

Patterns are dealt to blocks of bounded size; a block is sent to the tasks, which build its Aho-Corasick automaton, and costs
one pass over the texts. Nothing of a text is shuffled, and no text is compared with one pattern after the other.
"""

from functools import lru_cache, reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a block's patterns; its automaton takes some 60 bytes a character in each task.
BLOCK = 1 << 20


@lru_cache(maxsize=1)
def _automaton(patterns: tuple) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for p in patterns:
        out.add_word(p, p)
    out.make_automaton()
    return out


def held(text: str, patterns: tuple) -> set:
    """The patterns that a text contains."""
    return set(map(_second, _automaton(patterns).iter(text))) if patterns else set()


def _second(pair: tuple) -> str:
    return pair[1]


def blocks(patterns: DataFrame, pattern: str, most: int) -> list[DataFrame]:
    """The distinct patterns that aren't null or empty, dealt by hash to blocks of about ``most`` characters."""
    distinct = patterns.select(F.col(pattern).alias("p")).where("p is not null and p <> ''").distinct()
    total = distinct.agg(F.coalesce(F.sum(F.length("p")), F.lit(0))).first()[0]
    parts = -(-2 * total // most) if total > most else 1
    return [distinct.where(F.pmod(F.xxhash64("p"), F.lit(parts)) == k) for k in range(parts)] if total else []


def contained(rows: DataFrame, patterns: DataFrame, text: str, pattern: str, most: int = BLOCK) -> DataFrame:
    """``rows`` without ``text`` and with ``pattern``: a row for each distinct pattern that the text contains.

    Null texts and null patterns match nothing, the empty pattern matches every other text. A pattern longer than a block makes
    a block of its own size.
    """
    spark = rows.sparkSession
    kept = [f for f in rows.schema.fields if f.name != text]
    out = T.StructType([*kept, T.StructField(pattern, T.StringType())])
    source = rows.select(*(f.name for f in kept), text)

    def scan(block: tuple):
        sent = spark.sparkContext.broadcast(block)

        def run(batches):
            for batch in batches:
                at, met = [], []
                for i, value in enumerate(batch.column(len(kept)).to_pylist()):
                    if value:
                        found = held(value, sent.value)
                        at += [i] * len(found)
                        met += found
                if at:
                    taken = batch.select(range(len(kept))).take(pa.array(at, pa.int32()))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(met, pa.string())], out.names)

        return source.mapInArrow(run, out)

    # a block is bounded, so it may go to the driver and the tasks
    found = [scan(tuple(sorted(r["p"] for r in b.collect()))) for b in blocks(patterns, pattern, most)]
    empty = patterns.where(F.col(pattern) == "").select(pattern).limit(1)
    every = rows.where(F.col(text).isNotNull()).drop(text).join(F.broadcast(empty))  # one row at most
    return reduce(DataFrame.unionAll, found, every.select(*out.names))
