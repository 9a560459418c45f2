"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; where it is unset and all runs on this machine (tests), a
    temporary one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shelfmark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Makes Spark remove a query's shuffle files when the query ends, and not when the driver's next collection finds them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_LOCK, _WRITES = threading.Lock(), {"now": 0, "before": None}


@contextlib.contextmanager
def cleaned_up(spark: SparkSession) -> Iterator[None]:
    """Holds CLEANUP while any thread writes; the last to end gives back what the session had."""
    with _LOCK:
        if not _WRITES["now"]:
            _WRITES["before"] = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _WRITES["now"] += 1
    try:
        yield
    finally:
        with _LOCK:
            _WRITES["now"] -= 1
            if not _WRITES["now"]:
                spark.conf.unset(CLEANUP) if _WRITES["before"] is None else spark.conf.set(CLEANUP, _WRITES["before"])


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it survives lost executors and cuts the lineage. The shuffle files of
    the write go at its end, as the table stands for them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with cleaned_up(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def claimed(df: DataFrame, path: str, staged: str) -> bool:
    """Write ``df`` and rename it to ``path``, which only one of several writers can do; whether this one did. A rename to a
    folder that is there fails, on HDFS as on a local disk."""
    spark = df.sparkSession
    df.coalesce(1).write.json(staged)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (staged, path))
    fs = target.getFileSystem(conf)
    fs.mkdirs(target.getParent())
    if fs.exists(target) or not fs.rename(source, target):
        return False
    # A writer that was passed after it looked may have landed inside the winner's folder: then it isn't the winner.
    return not fs.exists(jvm.org.apache.hadoop.fs.Path(target, source.getName()))


#: Bytes of an Arrow batch: it is held by the JVM and by a Python worker, on either way, for each task at once.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> None:
    """Lower the session's bytes for each Arrow batch to BATCH_BYTES, where they are still at Spark's default or above."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(key).rstrip("b") or 0) > BATCH_BYTES:
        conf.set(key, f"{BATCH_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
