"""Tool calls assembled from streamed fragments, with state per stream and call."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "stream string, call int, name string, arguments string"


def assemble(fragments: DataFrame, idle: str = "1 minute") -> DataFrame:
    """(stream, call, name, arguments) of each call, once its last fragment (done = true) has come.

    fragments: a streaming DataFrame of stream, call, at, name, arguments, done. Fragments may come in any order and in any
    batches; they are joined by ``at``. A call that gets no fragment for ``idle`` is dropped and its state freed.
    """
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        at, names, parts, end = state.get if state.exists else ([], [], [], -1)
        at, names, parts = list(at), list(names), list(parts)
        for rows in batches:
            at += rows["at"].tolist()
            names += rows["name"].fillna("").tolist()
            parts += rows["arguments"].fillna("").tolist()
            if rows["done"].any():
                end = int(rows.loc[rows["done"], "at"].max())
        if end >= 0 and len(set(at)) == end + 1:  # all fragments from 0 to the last one are there
            whole = sorted(dict(zip(at, zip(names, parts, strict=True), strict=True)).items())
            state.remove()
            yield pd.DataFrame({"stream": [key[0]], "call": [key[1]], "name": [next((n for _, (n, _) in whole if n), "")], "arguments": ["".join(p for _, (_, p) in whole)]})
            return
        state.update((at, names, parts, end))
        state.setTimeoutDuration(wait)

    return fragments.groupBy("stream", "call").applyInPandasWithState(step, _OUT, "at array<int>, names array<string>, parts array<string>, end int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def activity(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """(start, event_type, n) of an event stream (ts, event_type); rows later than ``late`` are left out. Works on a batch as well."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n")
