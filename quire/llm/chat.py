"""Chat formatting over prefix trees.

Conversations that begin with the same turns share the nodes of these turns. Sorted by the hashes of all their turns, one after
the other, those that share most lie next to each other, and a task that reads them in this order builds one tree after the other depth-first: each shared
turn is written once per pack. A pack holds the tokens of a forest, position ids that count along each root-to-leaf path,
the loss mask, and for each node the intervals of its ancestors, to which attention is limited. Packs are bounded in tokens
and in members; a path that goes on in the next pack is written there again, so a first turn that a third of all
conversations share is spread over many packs and tasks.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"

PACKS = (
    "tokens array<int>, positions array<int>, loss array<struct<start:int,end:int>>,"
    " nodes array<struct<start:int,end:int,parent:int,attends:array<struct<start:int,end:int>>>>, members array<struct<conv_id:bigint,node:int>>"
)

#: How packs are written. A reader of nested columns holds up to 4096 rows of a row group at once, and a pack is a very long row.
GROUPS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1}


def escape(text: str) -> str:
    """Put one more backslash into everything that could be taken for a control string."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def turn_parts(role: str, text: str) -> tuple[str, str, str]:
    """Before the text, the escaped text, after it."""
    return f"{START}{escape_role(role)}\n", escape(text), f"{END}\n"


class Codec:
    """Text to token ids and back: a public tokenizer's vocabulary file, or UTF-8 bytes where none is named."""

    def __init__(self, path: str | None = None):
        self.tokenizer = None
        if path:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.encode_special_tokens = True

    def encode(self, text: str) -> np.ndarray:
        if self.tokenizer:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
        return np.frombuffer(text.encode(), np.uint8).astype(np.int32)

    def decode(self, ids: np.ndarray) -> str:
        if self.tokenizer:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        return ids.astype(np.uint8).tobytes().decode()


class _Pack:
    def __init__(self, codec: Codec):
        self.codec, self.tokens, self.positions, self.loss, self.nodes, self.members, self.size, self.path = codec, [], [], [], [], [], 0, []

    def add(self, turns: list) -> None:
        """A conversation: turns already on the current path are shared, the others become nodes below it."""
        shared = 0
        while shared < min(len(turns), len(self.path)) and self.path[shared][0] == turns[shared]:
            shared += 1
        del self.path[shared:]
        for turn in turns[shared:]:
            _, parent, position = self.path[-1] if self.path else (None, -1, 0)
            begin = self.size
            for i, part in enumerate(turn_parts(*turn)):
                ids = self.codec.encode(part)
                if i == 1 and turn[0] == "assistant" and len(ids):
                    self.loss.append((self.size, self.size + len(ids)))
                self.tokens.append(ids)
                self.positions.append(np.arange(position, position + len(ids), dtype=np.int32))
                self.size, position = self.size + len(ids), position + len(ids)
            above = self.nodes[parent][3] if parent >= 0 else []
            joined = [*above[:-1], (above[-1][0], self.size)] if above and above[-1][1] == begin else [*above, (begin, self.size)]
            self.nodes.append((begin, self.size, parent, joined))
            self.path.append((turn, len(self.nodes) - 1, position))

    def row(self) -> dict:
        span = lambda xs: [{"start": a, "end": b} for a, b in xs]
        return {
            "tokens": np.concatenate(self.tokens or [np.zeros(0, np.int32)]), "positions": np.concatenate(self.positions or [np.zeros(0, np.int32)]), "loss": span(self.loss),
            "nodes": [{"start": a, "end": b, "parent": p, "attends": span(x)} for a, b, p, x in self.nodes], "members": [{"conv_id": c, "node": n} for c, n in self.members],
        }


def conversations(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns, path): each conversation's turns in order of turn, role and text, and the hash of each turn.

    Null role and text are empty, a null turn comes first, and a null key is a conversation of its own. Keys are cast to long: a
    string that is no whole number raises an error.
    """
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    grouped = rows.select(F.col(key).cast("long").alias("conv_id"), one.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    turns = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return grouped.select("conv_id", turns.alias("turns"), F.transform(turns, lambda t: F.xxhash64(t["role"], t["text"])).alias("path"))


def pack(convs: DataFrame, tokenizer: str | None = None, pack_tokens: int = 1 << 16, pack_members: int = 1024) -> DataFrame:
    """One row per pack: tokens, positions, loss, nodes with their ancestors' intervals, and members (conversation, last node).

    A pack is closed once it holds ``pack_tokens`` tokens or ``pack_members`` conversations; a longer conversation has a pack of its own.
    """

    def run(batches):
        codec = Codec(tokenizer)
        held = _Pack(codec)
        schema = _PACK_SCHEMA
        for batch in batches:
            for conv, turns in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist(), strict=True):
                held.add([(t["role"], t["text"]) for t in turns])
                held.members.append((conv, held.path[-1][1]))
                if held.size >= pack_tokens or len(held.members) >= pack_members:
                    yield pa.RecordBatch.from_pylist([held.row()], schema)
                    held = _Pack(codec)
        if held.members:
            yield pa.RecordBatch.from_pylist([held.row()], schema)

    ordered = convs.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    return ordered.select("conv_id", "turns").mapInArrow(run, PACKS)


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_PACK_SCHEMA = pa.schema([
    ("tokens", pa.list_(pa.int32())), ("positions", pa.list_(pa.int32())), ("loss", _SPANS),
    ("nodes", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("parent", pa.int32()), ("attends", _SPANS)]))), ("members", pa.list_(pa.struct([("conv_id", pa.int64()), ("node", pa.int32())]))),
])


def _digest(row: dict, codec: Codec):
    """Per member of a pack, what its path says: only tokens, loss mask and parents are used."""
    tokens = np.asarray(row["tokens"], np.int32)
    loss = sorted((x["start"], x["end"]) for x in row["loss"])
    starts = np.array([a for a, _ in loss], np.int64)
    state = []
    for node in row["nodes"]:
        turns, taught, count, chars, formatted = (hashlib.sha256(), hashlib.sha256(), 0, 0, 0) if node["parent"] < 0 else state[node["parent"]]
        text = codec.decode(tokens[node["start"] : node["end"]])
        head, _, body = text.removeprefix(START).partition("\n")
        turns = turns.copy()
        turns.update(f"{unescape_role(head)}\n{unescape(body.removesuffix(f'{END}\n'))}\n".encode())
        here = loss[np.searchsorted(starts, node["start"]) : np.searchsorted(starts, node["end"])]
        said = "".join(unescape(codec.decode(tokens[a:b])) for a, b in here)
        if said:
            taught = taught.copy()
            taught.update(said.encode())
        state.append((turns, taught, count + 1, chars + len(said), formatted + len(text)))
    for member in row["members"]:
        turns, taught, count, chars, formatted = state[member["node"]]
        yield member["conv_id"], count, turns.hexdigest(), chars, taught.hexdigest(), formatted


def read_back(packs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of every member, from the packs alone."""
    kinds = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]

    def run(batches):
        codec = Codec(tokenizer)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() if c in ("loss", "nodes", "members") else batch.column(c)[i].values.to_numpy() for c in batch.schema.names}
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(zip(*_digest(row, codec), strict=True), kinds, strict=True)], [n for n, _ in kinds])

    return packs.select("tokens", "loss", "nodes", "members").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
