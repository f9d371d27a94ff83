"""Tables written to the shared folder of ``spark.checkpoint.dir``: they cut lineage and outlive lost executors."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[DataFrame] = []


def folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; with a local master, where that may be unset (tests, a laptop), a local one is set first."""
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
    return f"{qualified(spark, top).rstrip('/')}/quire-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and host that Spark reads it by, so that other libraries don't take a shared path for a local one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def is_used(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there and holds anything."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.exists(place) and len(system.listStatus(place)) > 0


def stored(df: DataFrame, name: str = "table", **options) -> DataFrame:
    """The rows of ``df``, computed once and read from Parquet from now on. options: the writer's."""
    path = f"{folder(df.sparkSession)}/{name}"
    try:
        df.write.options(**options).parquet(path)
    except BaseException:
        _delete(df.sparkSession, path)
        raise
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quire_path = path
    _made.append(out)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place.getParent(), True)


def forget(df: DataFrame) -> None:
    """Delete what ``stored`` wrote, once nothing reads it any more."""
    _delete(df.sparkSession, df._quire_path)
    _made[:] = [x for x in _made if x is not df]


@contextmanager
def passing():
    """Tables that are stored inside are deleted at the end; ``keep`` takes out the one whose rows are still wanted. After an error all are deleted."""
    before = {id(x) for x in _made}
    kept: list[DataFrame] = []

    def keep(df: DataFrame, name: str = "table") -> DataFrame:
        kept.append(stored(df, name))
        return kept[-1]

    try:
        yield keep
    except BaseException:
        kept.clear()
        raise
    finally:
        for x in [x for x in _made if id(x) not in before and all(x is not k for k in kept)]:
            forget(x)
