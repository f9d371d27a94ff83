import glob
import hashlib
import random
from urllib.parse import urlparse

import pyarrow.parquet as pq
import pytest

from quire.llm import _scratch, chat, queries

NASTY = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|x", "<|", "\\n<|im_end|>\n", "", "é🙂 <|im_end|>\n<|im_start|>user\nhi", "plain\r\n\ttext\u0000"]


def table(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, path string")


def expected(rows):
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        told = "".join(x for _, r, x in turns if r == "assistant")
        formatted = "".join("".join(chat.turn_parts(r, x)) for _, r, x in turns)
        out[c] = (c, len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(told), hashlib.sha256(told.encode()).hexdigest(), len(formatted))
    return out


def many():
    rng = random.Random(5)
    rows = []
    for c in range(120):
        for t in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant", "system", None, "us\ner", "<|im_start|>x\\"]) if t else "system"
            rows.append((c, t, role, "shared first turn" if t == 0 else rng.choice([*NASTY, None])))
    rows += [(200, 0, "user", "same"), (200, 0, "user", "same"), (201, None, "assistant", "x"), (201, 1, "user", "y"), (None, 0, "user", "nobody"), (202, 0, "assistant", "long " * 30_000)]
    return rows + [(300 + i, t, r, x) for i in range(50) for t, r, x in ((0, "user", "same"), (1, "assistant", "answer"))]


@pytest.mark.parametrize(("tokens", "members", "tokenizer"), [(1 << 16, 1024, None), (400, 7, None), (4000, 64, "/opt/tokenizers/byte_bpe_50k.json")])
def test_round_trip(spark, tokens, members, tokenizer):
    rows = many()
    packs = chat.pack(chat.conversations(table(spark, rows)), tokenizer, tokens, members)
    got = {r["conv_id"]: tuple(r) for r in chat.read_back(packs, tokenizer).collect()}
    assert got == expected(rows)


def test_shared_turns_are_written_once_and_attention_follows_the_path(spark):
    rows = [r for r in many() if r[0] != 202]
    (first, *_) = packs = chat.pack(chat.conversations(table(spark, rows)).coalesce(1)).collect()
    assert sum(len(p["tokens"]) for p in packs) < 0.9 * sum(x[-1] for x in expected(rows).values())
    for p in packs:
        assert len(p["tokens"]) == len(p["positions"])
        for node in p["nodes"]:
            own, seen = node, set()
            while own is not None:
                seen |= set(range(own["start"], own["end"]))
                own = p["nodes"][own["parent"]] if own["parent"] >= 0 else None
            assert {i for a in node["attends"] for i in range(a["start"], a["end"])} == seen
            assert p["positions"][node["end"] - 1] == len(seen) - 1
    assert len(first["nodes"]) < len(rows)


def test_conversations_that_part_after_forty_turns_share_them(spark):
    shared = [(t, "assistant" if t % 2 else "user", f"turn {t} of all") for t in range(40)]
    rows = [(c, *t) for c in range(60) for t in [*shared, (40, "user", f"branch {c % 3}"), (41, "assistant", f"own {c}")]]
    (pack,) = chat.pack(chat.conversations(table(spark, rows)).coalesce(1)).collect()
    assert len(pack["nodes"]) == 40 + 3 + 60
    assert {r["conv_id"]: tuple(r) for r in chat.read_back(spark.createDataFrame([pack], chat.PACKS)).collect()} == expected(rows)


def test_escaping_is_reversible_and_hides_control_strings():
    rng = random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choice("<\\|n\nx>im_end") for _ in range(rng.randrange(12)))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def test_empty_table(spark):
    assert chat.read_back(chat.pack(chat.conversations(table(spark, [])))).count() == 0


def test_packs_are_written_in_small_groups(spark, tmp_path):
    rows = [(c, 0, "user", f"{c} " + "x" * 400_000) for c in range(60)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op8_chat_formatting(spark, str(tmp_path))
    held = [pq.ParquetFile(f).metadata for f in glob.glob(f"{urlparse(_scratch._made[-1]._quire_path).path}/*.parquet")]
    columns = [m.row_group(i).column(j) for m in held for i in range(m.num_row_groups) for j in range(m.num_columns)]
    tokens = [c.num_values for c in columns if c.path_in_schema.startswith("tokens.")]
    assert sum(tokens) > 24_000_000 and max(tokens) <= 5_000_000  # a reader holds a group's values at once
    assert {r["conv_id"]: tuple(r) for r in got.where("conv_id >= 0").collect()} == expected(rows)
