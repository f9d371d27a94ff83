"""Derived tables that many queries read: written once to the folder that all executors share, and read from there.

A table is derived again when a file of its sources changes, or when what was written is gone. Sessions have tables of their own.
"""

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_made: dict[tuple, tuple[str, str]] = {}  # by application, name and sources: the sources' files, and where the table is


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; with a local master, where that may be unset, a folder of the machine's own."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='quire-')}")
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        top = held.get()
    return f"{top.rstrip('/')}/quire-{uuid.uuid4().hex}"


def stamp(spark: SparkSession, path: str) -> tuple:
    """Names, lengths and times of the files of a path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files = system.listFiles(place, True)
    out = []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def is_there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def derived(spark: SparkSession, name: str, sources: list[str], make: Callable[[], DataFrame], partitions: tuple = ()) -> DataFrame:
    """What ``make`` gives, written as Parquet at the first call; ``partitions``: columns that the files are laid out by."""
    key = (spark.sparkContext.applicationId, name, tuple(sources))
    now = str([stamp(spark, p) for p in sources])
    if key not in _made or _made[key][0] != now or not is_there(spark, f"{_made[key][1]}/_SUCCESS"):
        path, df = f"{shared_folder(spark)}/{name}", make()
        writer = df.write.partitionBy(*partitions) if partitions else df.write
        writer.parquet(path)
        _made[key] = (now, path)
    return spark.read.parquet(_made[key][1])
