import gzip
import hashlib

import pytest

from quire.llm import _scratch, warc


def test_round_trip_and_edge_cases(spark):
    big = "a page that is longer than a hundred bytes " * 5
    rows = [(5, "http://a/1", big), (3, "http://a/2\r\nX: y", big), (9, None, big), (None, "http://n/", big), (1, "http://b/", "short"), (2, "http://b/", "short"), (4, "u", None), (6, "u", ""), (7, "ü", "é\r\n\r\nWARC/1.1\r\n" * 20), (8, "z", "x" * 300_000), (3, "again", big)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, archive string").repartition(3)
    got = warc.archive(df, archive_bytes=1 << 10)[1].collect()
    assert len(got) == len(rows)
    for key, _, html in rows:
        payload = (html or "").encode()
        assert any((r["page_id"], r["payload_bytes"], r["payload_digest"]) == (key, len(payload), hashlib.sha256(payload).hexdigest()) for r in got)
    copies = [r for r in got if r["payload_bytes"] == len(big)]
    assert sorted((r["record_type"], str(r["page_id"]), r["refers_to"]) for r in copies) == [("response", "3", None), ("revisit", "3", 3), ("revisit", "5", 3), ("revisit", "9", 3), ("revisit", "None", 3)]
    assert all(r["record_type"] == "response" and r["refers_to"] is None for r in got if r["payload_bytes"] != len(big))


def test_every_record_is_a_member_of_its_own(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    out, read = warc.archive(pages)
    index = warc.read_index(spark, out).collect()
    assert len(index) == read.count() == pages.count()
    fs, path = warc._place(out)
    for row in index:
        with fs.open_input_file(f"{path}/{row['archive']}.warc.gz") as f:
            data = f.read_at(row["length"], row["offset"])
        text = gzip.decompress(data)
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n") and text.count(b"WARC/1.1\r\nWARC-Type") == 1


def test_empty_table(spark):
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string"))[1].count() == 0


def test_a_used_folder_and_a_scheme_that_tasks_cannot_open_are_refused(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string")
    out, got = warc.archive(pages, f"{tmp_path}/new")
    assert out.startswith("file:/") and got.count() == 1
    with pytest.raises(ValueError, match="holds files already"):
        warc.archive(pages, f"{tmp_path}/new")
    with pytest.raises(ValueError, match="tasks can't"):
        warc.opened("odd://none/x")


def test_scratch_tables_go_after_an_error(spark):
    before = list(_scratch._made)
    with pytest.raises(RuntimeError), _scratch.passing() as keep:
        path = keep(spark.range(3))._quire_path
        raise RuntimeError
    assert _scratch._made == before and not _scratch.is_used(spark, path)
    assert _scratch.qualified(spark, "/x/y") == "file:/x/y"
