"""Group totals, running totals and picks that do not put a hot group into one task.

A window partitioned by a key holds the whole group in one task. These helpers keep the
same results while splitting a group by a *bucket*: a column that the ordering starts with, so
that all rows of one bucket come before all rows of the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrid.session import staged


def attach_totals(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Every row with its group's totals: partial aggregation, then a join that AQE can split."""
    return df.join(df.groupBy(*keys).agg(*aggregates), list(keys), "left")


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: Sequence[Column],
    totals: dict[str, Column],
) -> DataFrame:
    """Inclusive running sums of ``totals`` (name → value) inside ``keys`` by ``order``.

    ``bucket`` must be the leading part of ``order``; null keys and buckets are groups of their own, a null bucket the first. Bucket sums are small and get
    the only window over a whole group; rows are windowed per (keys, bucket).
    """
    keys = list(keys)
    per_bucket = df.groupBy(*keys, bucket).agg(
        *[F.sum(value).alias(f"_{name}_sum") for name, value in totals.items()]
    )
    before = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *keys,
        bucket,
        *[F.coalesce(F.sum(f"_{n}_sum").over(before), F.lit(0)).alias(f"_{n}_before") for n in totals],
    )
    inside = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = df.select("*", *[F.sum(value).over(inside).alias(f"_{n}_local") for n, value in totals.items()])
    offsets = offsets.select(*[F.col(c).alias(f"_of_{c}") for c in (*keys, bucket)], *[f"_{n}_before" for n in totals])
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*keys, bucket)]
    joined = local.join(offsets, same)
    return joined.select(
        *df.columns,
        *[(F.coalesce(F.col(f"_{n}_local"), F.lit(0)) + F.col(f"_{n}_before")).alias(n) for n in totals],
    )


def prefix_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column], totals: dict[str, Column]) -> DataFrame:
    """Inclusive running sums of ``totals`` inside ``keys`` by ``order``, for groups of any size and any order columns.

    The rows are cut into sorted runs by ranges of (keys, order), so a large group is spread over many runs, and are
    written once. Each run sums its own part of a group; what the runs before it hold of the group is added as an offset.
    A window never holds more than one run's part of a group, or one sum for each run of a group. ``order`` must be
    unique inside a group for repeatable results; null keys are a group of their own.
    """
    keys = list(keys)
    along = [*[F.col(k).asc_nulls_first() for k in keys], *order]
    runs = df.repartitionByRange(*along).sortWithinPartitions(*along)
    runs = staged(runs.withColumn("_at", F.monotonically_increasing_id()), "runs")
    runs = runs.withColumn("_run", F.shiftright("_at", 33))
    per_run = runs.groupBy("_run", *keys).agg(*[F.sum(value).alias(f"_{name}_sum") for name, value in totals.items()])
    before = W.partitionBy(*keys).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_run.select(
        F.col("_run").alias("_of_run"),
        *[F.col(k).alias(f"_of_{k}") for k in keys],
        *[F.coalesce(F.sum(f"_{n}_sum").over(before), F.lit(0)).alias(f"_{n}_before") for n in totals],
    )
    # a run's first group only can have begun in an earlier one
    offsets = offsets.filter(" OR ".join(f"_{n}_before <> 0" for n in totals))
    inside = W.partitionBy("_run", *keys).orderBy("_at").rowsBetween(W.unboundedPreceding, W.currentRow)
    local = runs.select(*df.columns, "_run", *[F.coalesce(F.sum(value).over(inside), F.lit(0)).alias(f"_{n}_local") for n, value in totals.items()])
    same = [F.col("_run") == F.col("_of_run"), *[F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]]
    return local.join(offsets, same, "left").select(
        *df.columns, *[(F.col(f"_{n}_local") + F.coalesce(f"_{n}_before", F.lit(0))).alias(n) for n in totals]
    )


def numbered(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column], name: str) -> DataFrame:
    """1..n inside ``keys``: ``row_number`` for groups of any size."""
    return running_totals(df, keys, bucket, order, {name: F.lit(1).cast("bigint")})


def pick_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """The first row per group by ``order`` (ascending), combined on the map side."""
    ranked = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)])
    packed = F.min_by(F.struct(*columns), ranked).alias("_first")
    return df.groupBy(*keys).agg(packed).select(*keys, "_first.*")


def pick_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """The last row per group by ``order`` (ascending), combined on the map side."""
    ranked = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)])
    packed = F.max_by(F.struct(*columns), ranked).alias("_last")
    return df.groupBy(*keys).agg(packed).select(*keys, "_last.*")
