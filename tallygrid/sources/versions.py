"""Whole-table rewrites that readers see all at once or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _complete(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the versions whose write was committed, in ascending order."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(path):
        return []
    names = [s.getPath().getName() for s in store.listStatus(path) if s.isDirectory()]
    done = [n for n in names if n.startswith("v") and n[1:].isdigit() and store.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))]
    return sorted(int(n[1:]) for n in done)


def current_version(spark: SparkSession, root: str) -> DataFrame:
    """The table as its last finished rewrite left it."""
    done = _complete(spark, root)
    if not done:
        raise ValueError(f"{root} has no finished version")
    return spark.read.parquet(f"{root}/v{done[-1]:08d}")


def publish_version(df: DataFrame, root: str) -> DataFrame:
    """Writes ``df`` as the next version of the table at ``root`` and reads it back.

    Spark commits a write by its ``_SUCCESS`` file, and only versions that have one are read. So a rewrite that fails or is
    still running changes nothing, and its remains are overwritten by the next one. ``df`` may read the current version.
    """
    spark = df.sparkSession
    number = max(_complete(spark, root), default=0) + 1
    df.write.mode("overwrite").parquet(f"{root}/v{number:08d}")
    return current_version(spark, root)
