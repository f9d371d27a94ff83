"""WARC archives: writing, normalising monolithic gzip files to one member per record, and reading by offset.

Records are written as whole-file gzip streams, one stream for many records. The normaliser inflates each stream once,
rewrites every record as a gzip member of its own and writes a sidecar index with the members' offsets. Archives and
indexes lie in a folder that all executors share, under names that a repeated task writes again with the same bytes.
"""

import gzip
import hashlib
import io
import json
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm._scratch import folder, is_used, qualified, stored

SMALLEST = 100  # bytes of a payload from which equal payloads are revisits
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _place(uri: str):
    return pyarrow.fs.FileSystem.from_uri(uri)


def opened(uri: str) -> None:
    """Refuse a folder that tasks can't reach by its own scheme."""
    try:
        _place(uri)
    except (pa.ArrowInvalid, NotImplementedError) as e:
        raise ValueError(f"tasks can't write archives to {uri}: {e}") from e


def _put(uri: str, write) -> None:
    """Write a file under a name of this attempt and rename it, so that a half-written file is never seen."""
    fs, path = _place(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    task = TaskContext.get()
    own = f"{path}.{task.taskAttemptId() if task else 0}"
    with fs.open_output_stream(own, compression=None) as out:
        write(out)
    fs.move(own, path)


def record(kind: str, name: str, url: str | None, payload: bytes | None, digest: str, size: int, refers: str | None = None) -> bytes:
    """One WARC record. A revisit has the HTTP header with the payload's length, but no payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + (payload or b"")
    target = (url or "").translate({10: "%0A", 13: "%0D"})
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Target-URI: {target}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers:
        lines += [f"WARC-Refers-To: <{refers}>", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_records(stream):
    """(header, block) of each record of an inflated stream; one record is held at a time."""
    while first := stream.readline():
        if not first.strip():
            continue
        header = {}
        while line := stream.readline().rstrip(b"\r\n"):
            name, _, value = line.decode().partition(":")
            header[name.strip().lower()] = value.strip()
        yield header, stream.read(int(header["content-length"]))


def payload_of(block: bytes) -> tuple[dict, bytes]:
    head, _, payload = block.partition(b"\r\n\r\n")
    fields = (line.decode().partition(":") for line in head.split(b"\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in fields}, payload


def _name(archive: str, seq: int, page: object) -> str:
    return f"urn:warc:{archive}:{seq}:{'' if page is None else page}"


def write_archives(pages: DataFrame, out: str, key: str, url: str, html: str, archive_bytes: int) -> DataFrame:
    """Write one response per row into whole-file gzip streams; (archive, seq, key, payload_bytes, payload_digest) per row.

    A task begins a new archive after ``archive_bytes`` of records, so it holds one archive's compressed bytes at most.
    """

    def run(batches):
        part, number, held, packer, size, rows = TaskContext.get().partitionId(), 0, io.BytesIO(), None, 0, []

        def close():
            nonlocal number, held, packer, size, rows
            held.write(packer.flush())
            data = held.getvalue()
            _put(f"{out}/{part:06d}-{number:06d}.warc.gz", lambda f: f.write(data))
            done = pa.RecordBatch.from_pylist(rows, schema)
            number, held, packer, size, rows = number + 1, io.BytesIO(), None, 0, []
            return done

        for batch in batches:
            for page, link, text in zip(*(batch.column(c).to_pylist() for c in ("page", "url", "html")), strict=True):
                payload = (text or "").encode()
                packer = packer or zlib.compressobj(1, zlib.DEFLATED, 31)
                archive, digest = f"{part:06d}-{number:06d}", hashlib.sha256(payload).hexdigest()
                data = record("response", _name(archive, len(rows), page), link, payload, digest, len(payload))
                held.write(packer.compress(data))
                rows.append({"archive": archive, "seq": len(rows), "page": page, "payload_bytes": len(payload), "payload_digest": digest})
                size += len(data)
                if size >= archive_bytes:
                    yield close()
        if rows:
            yield close()

    asked = pages.select(F.col(key).cast("long").alias("page"), F.col(url).alias("url"), F.col(html).alias("html"))
    schema = pa.schema([("archive", pa.string()), ("seq", pa.int64()), ("page", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
    return asked.mapInArrow(run, "archive string, seq long, page long, payload_bytes long, payload_digest string")


def normalise(decided: DataFrame, source: str, out: str, parts: int) -> DataFrame:
    """Rewrite the archives of ``decided`` (archive, seq, refers); one row per archive with its number of records.

    Each archive is inflated once, as a stream. Record seq becomes a revisit of ``refers`` where that isn't null, and is kept as it is
    otherwise, also where ``decided`` has no row for it. Next to each archive lies its index of JSON lines: record, type, offset and length.
    ``parts`` tasks share the archives; the number is given, as Spark would judge by the few rows here and not by the archives' bytes.
    """

    def run(table: pa.Table) -> pa.Table:
        archive = table.column("archive")[0].as_py()
        refers = dict(zip(table.column("seq").to_pylist(), table.column("refers").to_pylist(), strict=True))
        index, at = [], 0

        def write(f):
            nonlocal at
            fs, path = _place(f"{source}/{archive}.warc.gz")
            with fs.open_input_stream(path, compression=None) as packed, gzip.GzipFile(fileobj=packed) as stream:
                for seq, (header, block) in enumerate(read_records(io.BufferedReader(stream))):
                    name, to = header["warc-record-id"].strip("<>"), refers.get(seq)
                    fields, payload = payload_of(block)
                    kind = "revisit" if to else header["warc-type"]
                    data = record(kind, name, header["warc-target-uri"], None if to else payload, header["warc-payload-digest"].removeprefix("sha256:"), int(fields["content-length"]), to)
                    member = gzip.compress(data, 1, mtime=0)
                    f.write(member)
                    index.append(json.dumps({"archive": archive, "record": name, "type": kind, "offset": at, "length": len(member)}))
                    at += len(member)

        _put(f"{out}/{archive}.warc.gz", write)
        _put(f"{out}/index/{archive}.json", lambda f: f.write("\n".join(index).encode()))
        return pa.table({"archive": [archive], "records": [len(index)]})

    return decided.repartition(parts, "archive").groupBy("archive").applyInArrow(run, "archive string, records long")


def read_index(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("archive string, record string, type string, offset long, length long").json(f"{out}/index")


def read_members(index: DataFrame, out: str) -> DataFrame:
    """Read each indexed record by its offset alone: (record, target, record_type, payload_bytes, payload_digest, refers_to).

    A response's digest and length are taken from its payload, and a response that doesn't match its own header raises an error.
    """

    def run(batches):
        opened, held = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if archive != opened:
                    fs, path = _place(f"{out}/{archive}.warc.gz")
                    opened, held = archive, fs.open_input_file(path)
                ((header, block),) = read_records(io.BytesIO(gzip.decompress(held.read_at(length, offset))))
                fields, payload = payload_of(block)
                digest, size = header["warc-payload-digest"].removeprefix("sha256:"), int(fields["content-length"])
                if header["warc-type"] == "response" and (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, size):
                    raise ValueError(f"{archive} at {offset}: the payload doesn't match its digest")
                rows.append((header["warc-record-id"].strip("<>"), header["warc-target-uri"], header["warc-type"], size, digest, header.get("warc-refers-to", "").strip("<>") or None))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names)

    names = ["record", "target", "record_type", "payload_bytes", "payload_digest", "refers_to"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    return index.select("archive", "offset", "length").mapInArrow(run, T.StructType([T.StructField(n, T.LongType() if k == pa.int64() else T.StringType()) for n, k in zip(names, kinds, strict=True)]))


def archive(pages: DataFrame, out: str | None = None, key: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = 64 << 20) -> tuple[str, DataFrame]:
    """Archive ``pages`` and read the archives back: their folder, and a row per record that was read.

    The rows: key, payload_bytes, payload_digest, record_type, refers_to, archive record. Of records with equal payloads of at
    least 100 bytes, the one with the smallest key is a response and the others are revisits of it; a null key comes last, and rows
    with equal keys follow in archive order, so that exactly one is the response. A null payload is empty, a null URL is written as
    an empty one. ``out`` must be new or empty, and of a scheme that pyarrow opens (file, hdfs, s3, gs, abfss). An empty table gives no archives and no rows. Other columns are not read. Keys are cast to long: a string that
    is no whole number raises an error.
    """
    spark = pages.sparkSession
    top = qualified(spark, out) if out else folder(spark)
    if is_used(spark, top):
        raise ValueError(f"{top} holds files already; each run needs a folder of its own")
    opened(top)
    raw = f"{top}/raw"
    written = stored(write_archives(pages, raw, key, url, html, archive_bytes), "written")
    rank = F.struct(F.col("page").isNull(), "page", "archive", "seq")
    first = written.where(F.col("payload_bytes") >= SMALLEST).groupBy("payload_digest").agg(F.min(rank).alias("first"))
    same = written.join(first, "payload_digest", "left")
    target = F.concat(F.lit("urn:warc:"), F.col("first.archive"), F.lit(":"), F.col("first.seq"), F.lit(":"), F.coalesce(F.col("first.page").cast("string"), F.lit("")))
    moved = F.when((F.col("payload_bytes") >= SMALLEST) & (F.struct("archive", "seq") != F.struct("first.archive", "first.seq")), target)
    archives = written.where("seq = 0").count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), archives // 16)
    done = stored(normalise(same.select("archive", "seq", moved.alias("refers")), raw, top, parts), "normalised")
    place = spark._jvm.org.apache.hadoop.fs.Path(raw)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    if done.isEmpty():
        return top, spark.createDataFrame([], f"{key} long, payload_bytes long, payload_digest string, record_type string, refers_to long, record string")
    read = read_members(read_index(spark, top), top)
    page = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, ':([^:]*)$', 1), '') as bigint)")
    return top, read.select(page("record").alias(key), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "record")
