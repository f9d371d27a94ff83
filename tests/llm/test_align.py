import random
import sys
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from quire.llm import align

NAMES = (align.FOLDER, "byte_bpe_50k.json", "piece_bpe_32k.model")
LETTERS = ["a", "B", "é", "ß", "日", "本", "\U0001f600", " ", " ", " ", "  ", "\n", "\t", "\r", " ", "　", " ", "1", "23", ".", "'s", "<s>", "<|endoftext|>", "<0x0A>", "▁", "word", "tion", ");\r", "\x00", "​", "\x1f"]


def texts():
    pick = random.Random(3)
    out = [None, "", " ", "   ", "a", " a", "a ", "a  b", "\n a", "\n  a", "a \n b  ", "<s> </s>", "x▁y", "<|endoftext|> end", "\x00", "Ünïcödé wörds, and 日本語 text."]
    out += ["".join(pick.choice(LETTERS) for _ in range(pick.randint(1, 40))) for _ in range(400)]
    return [*out, "word " * 3000, "日本" * 2000, "a b\n" * 10, "a b\n" * 10]


def plain(rows):
    """By definition: whole texts, byte ranges of all tokens, all overlapping pairs."""
    first, second, a_bytes, b_bytes, _ = align.tokenizers(*NAMES)
    met, count = [], Counter()
    for text in rows:
        a = first.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        own = f" {text}".encode()
        if not text or b"".join(a_bytes[i] for i in a) != own or b"".join(b_bytes[i] for i in b) != own:
            met.append(([], [], [], []))
            continue
        ranges = []
        for ids, known in ((a, a_bytes), (b, b_bytes)):
            at, spans = 0, []
            for i in ids:
                spans.append((at, at + len(known[i]), i))
                at = spans[-1][1]
            ranges.append(spans)
        links, low = [], 0
        for s, e, i in ranges[0]:
            while ranges[1][low][1] <= s:
                low += 1
            for s2, e2, j in ranges[1][low:]:
                if s2 >= e:
                    break
                if max(s, s2) < min(e, e2):
                    links.append((i, j))
        cuts = sorted({e for _, e, _ in ranges[0]} & {e for _, e, _ in ranges[1]})
        groups, start = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in spans if s >= start and e <= cut) for spans in ranges) if len(cuts) < 300 else None)
            start = cut
        met.append((a, b, groups, links))
        count.update(links)
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    return [(len(a), len(b), len(g), len(k), sum(count[x] == best[x[1]] for x in k), sum(count[x] for x in k), None if None in g else sha256(";".join(g).encode()).hexdigest() if g else "") for a, b, g, k in met]


@pytest.mark.parametrize("block", [1 << 22, 200])
def test_equals_the_definition(spark, block):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(rows)], "doc_id long, text string, groups_sha256 string, n long").repartition(5)
    found = {r["doc_id"]: r for r in align.align(docs, block=block).collect()}
    assert len(found) == len(rows)
    wanted = plain(rows)
    assert sum(w[0] > 0 for w in wanted) > 200 and sum(w[0] == 0 for w in wanted) > 5
    for i, want in enumerate(wanted):
        got = tuple(found[i][c] for c in (*align.COUNTS, "groups_sha256"))
        assert got[:6] == want[:6], (rows[i][:80], got, want)
        assert want[6] is None or got[6] == want[6]


@pytest.mark.parametrize("block", [1 << 22, 3])
def test_repeats_nulls_and_no_rows(spark, block):
    rows = [(1, "one two"), (1, "one two"), (1, "three"), (None, "one"), (None, None), (2, ""), (3, "x▁y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = align.align(docs, block=block)
    assert got.columns == ["doc_id", *align.COUNTS, "groups_sha256"]
    found = sorted(tuple(r) for r in got.select(F.coalesce("doc_id", F.lit(-1)), *align.COUNTS, "groups_sha256").collect())
    wanted = sorted((-1 if k is None else k, *w) for (k, _), w in zip(rows, plain([t for _, t in rows]), strict=True))
    assert found == wanted
    assert align.align(docs.limit(0)).count() == 0


def test_pieces_join_to_the_text():
    for text in texts():
        if text:
            assert "".join(f" {p}" for p in align.pieces_of(text)) == f" {text}"


def test_bounded_memory_of_pieces(spark, monkeypatch):
    known = align.Aligned(*NAMES)
    monkeypatch.setattr(sys.modules["quire.llm.align"], "_HELD", 3)
    import pyarrow as pa

    for t in ("a b c d", "e f g h", "a b c d"):
        assert len(known.texts(pa.array([t]))[0]) == 4
        assert len(known.place) <= 4
