"""Global top-N with a remainder row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOP_LIMIT = 10


def top_n_with_others(
    groups: DataFrame,
    measures: Sequence[str] = ("value",),
    limit: int = TOP_LIMIT,
    label: str = "Others",
) -> DataFrame:
    """Largest groups by the first measure; beyond ``limit`` groups the tail is one summed row.

    ``groups`` has (record_id, label, *measures). Exactly ``limit`` groups are shown unchanged. The
    head is a distributed top-k and the tail is total minus head, so no task sees all groups.
    """
    lead = measures[0]
    sort = [F.desc(lead), F.asc("record_id")]
    head = groups.orderBy(*sort).limit(limit + 1)
    row = F.struct(
        (-F.col(lead)).alias("_rank"),
        F.col("record_id").alias("record_id"),
        F.col("label").alias("label"),
        *[F.col(m).alias(m) for m in measures],
    )
    shown = head.agg(F.array_sort(F.collect_list(row)).alias("rows"))
    totals = groups.agg(*[F.sum(m).alias(f"_{m}") for m in measures])
    # Two one-row frames meet in a union and one tiny aggregation.
    both = shown.select("rows", *[F.lit(None).cast(totals.schema[f"_{m}"].dataType).alias(f"_{m}") for m in measures]).unionByName(
        totals.select(F.lit(None).cast(shown.schema["rows"].dataType).alias("rows"), *[f"_{m}" for m in measures])
    ).agg(
        F.first("rows", ignorenulls=True).alias("rows"),
        *[F.first(f"_{m}", ignorenulls=True).alias(f"_{m}") for m in measures],
    )
    types = {f.name: f.dataType for f in groups.schema.fields}
    top = F.slice("rows", 1, limit - 1)

    def tail(m: str):
        wide = both.schema[f"_{m}"].dataType
        part = F.aggregate(top, F.lit(0).cast(wide), lambda acc, r: (acc + r[m]).cast(wide))
        return (F.col(f"_{m}") - part).cast(wide).alias(m)

    def line(r):
        return F.struct(r["record_id"].alias("record_id"), r["label"].alias("label"), *[r[m].cast(both.schema[f"_{m}"].dataType).alias(m) for m in measures])

    others = F.struct(
        F.lit(0).cast(types["record_id"]).alias("record_id"),
        F.lit(label).alias("label"),
        *[tail(m) for m in measures],
    )
    chosen = F.when(F.size("rows") > limit, F.concat(F.transform(top, line), F.array(others))).otherwise(
        F.transform("rows", line)
    )
    return both.select(F.inline(chosen))
