"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: While a table is written: shuffle files go with their query, and batches and row groups are small, as rows may be large.
_WRITING = {_CLEANUP: "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def scratch_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only for an unset value on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tesserae-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def tidy_shuffles(spark: SparkSession):
    """Shuffle files of the queries run inside are removed as soon as each query ends, and Arrow batches are bounded in bytes."""
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), replaces: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to a new shared table and read it back: lineage ends at files that outlive any executor.

    ``replaces`` is a table of this kind that nothing reads any more once the new one is written; it is deleted then.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with tidy_shuffles(spark):
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.option("parquet.block.size", 16 << 20).parquet(path)
    if replaces is not None:
        discard(replaces)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(table: DataFrame) -> None:
    """Delete a table that ``materialize`` made and that nothing reads any more; others are left alone."""
    path = getattr(table, "scratch_path", None)
    if isinstance(path, str):
        spark = table.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
