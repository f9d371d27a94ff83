"""Server-sent events cut across chunks, put together with state and timers, and the tool calls they bear.

A stream's chunks may come in any order and in any batches. Its processor keeps the chunks that are ahead, the end of the last
block that isn't whole yet, and the calls that are open. A call is told once, when its turn ends; a stream that says nothing
for ``idle`` is dropped by a timer. State and told calls go into the query's checkpoint together, so a restart repeats nothing.
"""

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "stream string, call int, id string, name string, arguments string"
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_END = re.compile(r"\r?\n\r?\n")
_DATA = re.compile(r"^data:[ ]?(.*?)\r?$", re.M)


def blocks_of(rest: str, chunk: str, last: bool = False) -> tuple[list[str], str]:
    """The whole blocks of what was left and a new chunk, and what is left now; the ``last`` chunk ends its block."""
    *whole, left = _END.split(rest + chunk)
    if last and left.strip():
        whole, left = [*whole, left], ""
    return [b for b in whole if b.strip()], left


def fragments_of(block: str) -> tuple[list[tuple[int, str, str, str]], bool]:
    """(call, id, name, arguments) of a block's tool calls, and whether it ends the turn. What isn't JSON of this kind says nothing."""
    data = "\n".join(_DATA.findall(block))
    if data.strip() == "[DONE]":
        return [], True
    try:
        choices = json.loads(data)["choices"]
    except (ValueError, KeyError, TypeError):
        return [], False
    out, ended = [], False
    for choice in choices if isinstance(choices, list) else []:
        choice = choice if isinstance(choice, dict) else {}
        calls = (choice.get("delta") or {}).get("tool_calls") if isinstance(choice.get("delta"), dict) else None
        for place, call in enumerate(calls if isinstance(calls, list) else []):
            if isinstance(call, dict):
                said = call["function"] if isinstance(call.get("function"), dict) else call
                given = said.get("arguments")
                text = lambda v: v if isinstance(v, str) else ""
                out.append((_index(call.get("index"), place), text(call.get("id")), text(said.get("name")), json.dumps(given, ensure_ascii=False, separators=(",", ":")) if isinstance(given, (dict, list)) else text(given)))
        ended = ended or bool(choice.get("finish_reason"))
    return out, ended


def _index(value, place: int) -> int:
    try:
        return int(float(value))
    except (TypeError, ValueError, OverflowError):
        return place


class Calls(StatefulProcessor):
    """Chunks (at, chunk, last) of one stream in, its finished calls out."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next int, rest string, due long")
        self.ahead = handle.getMapState("ahead", "at int", "chunk string, last boolean")
        self.open = handle.getMapState("open", "call int", "id string, name string, arguments string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, rest, due = self.place.get() if self.place.exists() else (0, "", 0)
        for frame in rows:
            for place, chunk, last in zip(frame["at"].tolist(), frame["chunk"].fillna("").tolist(), frame["last"].fillna(False).tolist(), strict=True):
                if place >= at:  # what comes again is known
                    self.ahead.updateValue((int(place),), (chunk, bool(last)))
        told = []
        while self.ahead.containsKey((at,)):
            chunk, last = self.ahead.getValue((at,))
            self.ahead.removeKey((at,))
            whole, rest = blocks_of(rest, chunk, last)
            for block in whole:
                parts, ended = fragments_of(block)
                for call, *said in parts:
                    held = self.open.getValue((call,)) if self.open.containsKey((call,)) else ("", "", "")
                    self.open.updateValue((call,), (held[0] or said[0], held[1] or said[1], held[2] + said[2]))
                told += self._close(key) if ended else []
            told += self._close(key) if last else []
            at += 1
        if due:
            self.handle.deleteTimer(due)
        due = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
        self.handle.registerTimer(due)
        self.place.update((at, rest, due))
        if told:
            yield pd.DataFrame(told, columns=["stream", "call", "id", "name", "arguments"])

    def _close(self, key) -> list[tuple]:
        out = sorted((key[0], call, *said) for (call,), said in ((tuple(k), tuple(v)) for k, v in self.open.iterator()))
        self.open.clear()
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.place, self.ahead, self.open):
            state.clear()
        return iter([])

    def close(self) -> None:
        pass


def calls(chunks: DataFrame, idle: str = "10 minutes") -> DataFrame:
    """(stream, call, id, name, arguments) of each tool call, once its turn has ended. chunks: a streaming DataFrame of stream, at, chunk, last.

    at: a chunk's number in its stream, from 0 on; a chunk that comes twice counts once. last: it is the stream's end. A stream that
    was dropped for silence begins anew. The session's state store must be RocksDB (``STORE``).
    """
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)
    return chunks.groupBy("stream").transformWithStateInPandas(statefulProcessor=Calls(wait), outputStructType=OUT, outputMode="Append", timeMode="ProcessingTime")
