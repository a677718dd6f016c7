"""Bulk column updates, as projections that a job writes to a new table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.functions.money import QTY, zero_if_null


def scan_domain(table: DataFrame, condition: Column | str, order: Sequence[Column] = (), limit: int | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """Filtered, ordered, limited scan of the named columns."""
    out = table.filter(condition)
    if order:
        out = out.orderBy(*order)
    if limit is not None:
        out = out.limit(limit)
    return out.select(*columns) if columns else out


def backfill_discount_free(lines: DataFrame) -> DataFrame:
    """Lines without discount take their amounts as the amounts before discount."""
    free = zero_if_null("discount") == 0
    return lines.withColumn("price_subtotal_no_discount", F.when(free, F.col("price_subtotal"))).withColumn(
        "price_total_no_discount", F.when(free, F.col("price_total"))
    )


def distinct_orders(lines: DataFrame) -> DataFrame:
    """Orders with at least one discounted line."""
    return lines.filter(F.col("discount") != 0).select("order_id").distinct()


def backfill_remaining(lines: DataFrame) -> DataFrame:
    return lines.withColumn("remains", (F.col("qty") - F.col("qty_delivered")).cast(QTY))


def backfill_parent_to_child(table: DataFrame, column: str, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """Empty values take the parent's."""
    above = table.select(F.col(key).alias(parent), F.col(column).alias("_parent_value"))
    return table.join(above, parent, "left").withColumn(column, F.coalesce(column, "_parent_value")).drop("_parent_value")


def backfill_empty(table: DataFrame, column: str, source: str) -> DataFrame:
    """Empty values take another column's."""
    return table.withColumn(column, F.coalesce(column, source))


def column_rename_copy(table: DataFrame, old: str, new: str) -> DataFrame:
    """The new column takes the old one's values; where it is there already, only its gaps."""
    if new in table.columns:
        return table.withColumn(new, F.coalesce(new, old)).drop(old)
    return table.withColumnRenamed(old, new)


def prefix_flag_backfill(orders: DataFrame, prefix: str, flag: str = "is_quotation_number") -> DataFrame:
    """Mark open quotations whose name still starts with the quotation prefix."""
    return orders.withColumn(flag, F.col("state").isin("draft", "sent") & F.startswith("name", F.lit(prefix)))
