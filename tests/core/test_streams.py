"""Event streams cut at any place, with restarts, against the streams read whole."""

import json
import random
import time

import pytest

from quire.streaming import events

CHUNKS = "stream string, at int, chunk string, last boolean"


def stream_of(pick, n):
    """A stream's text, and its calls."""
    said, want = [], []
    for turn in range(2):
        names = [f"tool{turn}{i}" for i in range(pick.randint(1, 3))]
        parts = [(i, [json.dumps({"q": f"é {n} {i}", "k": [1, 2]})[j : j + 3] for j in range(0, 30, 3)]) for i in range(len(names))]
        line = lambda calls, end=None: "data: " + json.dumps({"choices": [{"delta": {"tool_calls": calls}, "finish_reason": end}]})
        said += [line([{"index": i, "id": f"id{turn}{i}", "function": {"name": names[i], "arguments": ""}}]) for i in range(len(names))]
        queue = [(i, p) for i, ps in parts for p in ps]
        queue.sort(key=lambda x: (parts[x[0]][1].index(x[1]), x[0]))
        said += [line([{"index": str(i) if n % 2 else i, "function": {"arguments": p}}]) for i, p in queue]
        said += [": a comment", "data: not json", line([], "tool_calls") if turn == 0 else "event: end\ndata: [DONE]"]
        want += [(f"s{n}", i, f"id{turn}{i}", names[i], "".join(ps)) for i, ps in parts]
    mark = pick.choice(["\n\n", "\r\n\r\n"])
    return mark.join(said) + (mark if n % 3 else ""), want


def cut(pick, name, text):
    at, out = 0, []
    while at < len(text):
        size = pick.randint(1, 200)
        out.append((name, len(out), text[at : at + size], at + size >= len(text)))
        at += size
    return out


def test_blocks_and_fragments():
    assert events.blocks_of("data: a\r", "\n\r\ndata: b") == (["data: a"], "data: b")
    assert events.blocks_of("x", "", True) == (["x"], "") and events.blocks_of("", "\n\n\n\n") == ([], "")
    for odd in ("", "data: [1]", 'data: {"choices": 3}', 'data: {"choices": [null, {"delta": 5}, {"delta": {"tool_calls": [null, 4]}}]}', "data: null"):
        assert events.fragments_of(odd) == ([], False)
    assert events.fragments_of('data: {"choices":\ndata: [{"delta": {"tool_calls": [{"name": "n", "arguments": {"a": 1}}]}}]}') == ([(0, "", "n", '{"a":1}')], False)


def _until(query, done, seconds=120):
    end = time.time() + seconds
    while time.time() < end and not done():
        assert query.exception() is None, query.exception()
        time.sleep(0.3)
    assert done()


def test_a_restarted_query_tells_each_call_once(spark, tmp_path):
    spark.conf.set(*events.STORE)
    pick = random.Random(11)
    rows, want = [], []
    for n in range(6):
        text, calls = stream_of(pick, n)
        rows += cut(pick, f"s{n}", text)
        want += calls
    rows += [r for r in rows if pick.random() < 0.1]  # some come twice
    pick.shuffle(rows)
    for k in range(6):
        spark.createDataFrame(rows[k::6], CHUNKS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def start():
        read = spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        return events.calls(read).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()

    try:
        query = start()
        _until(query, lambda: query.lastProgress is not None and query.lastProgress["batchId"] >= 2)
        query.stop()  # in the midst of a batch or between two
        query = start()
        _until(query, lambda: query.lastProgress is not None and json.loads(query.lastProgress.json)["sources"][0]["endOffset"] == {"logOffset": 5} and query.lastProgress["numInputRows"] == 0)
        query.stop()
        got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
        assert len(got) == len(set(got)) and sorted(got) == sorted(want)
    finally:
        spark.conf.unset(events.STORE[0])


def test_silent_streams_are_dropped(spark, tmp_path):
    spark.conf.set(*events.STORE)
    call = 'data: {"choices":[{"delta":{"tool_calls":[{"index":0,"function":{"name":"%s","arguments":"x"}}]}}]}\n\n'
    put = lambda *rows: spark.createDataFrame(list(rows), CHUNKS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put(("quiet", 0, call % "old", False))
    query = events.calls(spark.readStream.schema(CHUNKS).parquet(f"{tmp_path}/in"), "1 second").writeStream.format("memory").queryName("told").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(processingTime="500 milliseconds").start()
    try:
        _until(query, lambda: any(p["numInputRows"] for p in query.recentProgress))
        time.sleep(6)
        put(("quiet", 0, call % "new", True))
        _until(query, lambda: spark.table("told").count() > 0)
        assert [(r["name"], r["arguments"]) for r in spark.table("told").collect()] == [("new", "x")]
    finally:
        query.stop()
        spark.conf.unset(events.STORE[0])


@pytest.mark.parametrize("n", range(4))
def test_chunks_read_whole_and_cut_agree(n):
    pick = random.Random(n)
    text, want = stream_of(pick, n)
    rest, open_, told = "", {}, []
    for _, _, chunk, last in cut(pick, f"s{n}", text):
        whole, rest = events.blocks_of(rest, chunk, last)
        for parts, ended in map(events.fragments_of, whole):
            for call, *said in parts:
                a, b, c = open_.get(call, ("", "", ""))
                open_[call] = (a or said[0], b or said[1], c + said[2])
            if ended:
                told += [(f"s{n}", k, *v) for k, v in sorted(open_.items())]
                open_ = {}
    assert told == want
