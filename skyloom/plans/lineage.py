"""Tables in the folder that driver and executors share: where a long lineage ends."""

from __future__ import annotations

import atexit
import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables that are still there.
_kept: set[str] = set()


def shared_table(df: DataFrame, label: str, by: str | None = None, small: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: the lineage ends there, and lost executors take nothing along.

    The folder is ``spark.checkpoint.dir``; where that is unset (tests on one machine) a folder in
    the warehouse is used. A table is deleted by release(), or when the driver's Python ends. ``by``: a column of few
    values that readers filter on; each has a folder of its own. ``small``: not worth a collection of the shuffles behind.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    _kept.add(path)
    if len(_kept) == 1:
        atexit.register(_drop_all, spark)
    if small:
        return spark.read.schema(df.schema).parquet(path)
    # the shuffles behind the table serve nothing any more: let the cleaner find them now
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete a shared table before the driver's Python ends; no plan may read it any more."""
    for path in {p for f in df.inputFiles() for p in _kept if p.rsplit("/", 1)[1] in f.split("/")}:
        _drop(df.sparkSession, path)


def settle(spark: SparkSession) -> None:
    """Let the cleaner find the shuffles of finished queries before a large one starts."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def _drop_all(spark: SparkSession) -> None:
    for path in list(_kept):
        _drop(spark, path)


def _drop(spark: SparkSession, path: str) -> None:
    _kept.discard(path)
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already; the folder is scratch space
        pass
