"""Shared folder tables and small helpers for the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no checkpoint folder, as in tests.
LOCAL_FALLBACK = "/tmp/checkpoints/textloom"
ARROW_BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a local one only where that is unset and the driver is the only executor."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = f"file://{LOCAL_FALLBACK}"
        atexit.register(shutil.rmtree, LOCAL_FALLBACK, ignore_errors=True)
    return base.rstrip("/")


#: Folders of this process's tables.
RUN = f"textloom-{uuid.uuid4().hex}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{RUN}/{uuid.uuid4().hex}/{name}"


def release_tables(spark: SparkSession) -> None:
    """Delete all tables and files that operators of this process have left in the shared folder. Results are read from them, so call it once results are written elsewhere."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{RUN}")
    path.getFileSystem(conf).delete(path, True)


def stage_table(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and a lost executor costs nothing before it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    for key, value in options.items():
        writer = writer.option(key.replace("__", "."), value)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete what stage_table wrote; call it once nothing reads the table any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Have Spark's cleaner drop the shuffle files of finished jobs now; it acts when the JVM collects dead references."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded_batches(spark: SparkSession) -> None:
    """Batches between the JVM and Python of at most ARROW_BATCH_BYTES from now on in this session: else a batch is all text of a task, held on both sides and again in what a worker makes of it. A smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = re.fullmatch(r"(\d+)b?", spark.conf.get(key) or "")
    if old is None or not 0 < int(old[1]) <= ARROW_BATCH_BYTES:
        spark.conf.set(key, str(ARROW_BATCH_BYTES))


def give_back() -> None:
    """Return what a Python worker has freed to the system at the end of a task: workers stay for later tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def hex_number(text_hash: Column, digits: int) -> Column:
    """The first hex digits of a hash as a long."""
    return F.conv(F.substring(text_hash, 1, digits), 16, 10).cast("long")
