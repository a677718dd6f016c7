"""Blanket orders: consumption, state, assignment, conversion to orders."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.functions.money import MONEY, QTY, convert_uom, money, total, zero_if_null

MAX_DISTANCE_DAYS = 365  # fixed value: schedule dates this far away or farther are not taken


def blanket_quantities(blanket_lines: DataFrame, sale_lines: DataFrame, uoms: DataFrame) -> DataFrame:
    """Ordered, invoiced, delivered and remaining quantity of each blanket line, in its own unit.

    ``sale_lines`` need (blanket_line_id, product_id, uom_id, state, qty, qty_invoiced, qty_delivered).
    """
    live = sale_lines.filter(F.col("state") != "cancel").groupBy("blanket_line_id", "product_id", F.col("uom_id").alias("sale_uom")).agg(
        *[F.sum(c).cast(QTY).alias(f"_{c}") for c in ("qty", "qty_invoiced", "qty_delivered")]
    )
    own = uoms.select(F.col("id").alias("uom_id"), F.col("factor").alias("_to"))
    theirs = uoms.select(F.col("id").alias("sale_uom"), F.col("factor").alias("_from"))
    used = (
        live.join(theirs, "sale_uom")
        .join(blanket_lines.select(F.col("id").alias("blanket_line_id"), "product_id", "uom_id"), ["blanket_line_id", "product_id"])
        .join(own, "uom_id")
        .groupBy("blanket_line_id")
        .agg(
            *[
                F.sum(convert_uom(f"_{c}", "_from", "_to")).alias(name)
                for c, name in (("qty", "ordered"), ("qty_invoiced", "invoiced"), ("qty_delivered", "delivered"))
            ]
        )
    )
    joined = blanket_lines.join(used, blanket_lines.id == used.blanket_line_id, "left").drop("blanket_line_id")
    for c in ("ordered", "invoiced", "delivered"):
        joined = joined.withColumn(c, zero_if_null(c).cast(QTY))
    return joined.withColumn("remaining", (F.col("original_qty") - F.col("ordered")).cast(QTY))


def blanket_state(blankets: DataFrame, line_quantities: DataFrame, today: date) -> DataFrame:
    """Header sums and state: draft, expired, done, open — tested in that order."""
    plain = F.col("display_type").isNull()
    sums = line_quantities.groupBy("blanket_id").agg(
        *[F.sum(c).alias(c) for c in ("original_qty", "ordered", "invoiced", "delivered", "remaining")],
        F.coalesce(F.sum(F.when(plain, F.col("remaining"))), F.lit(0)).alias("_left"),
    )
    state = (
        F.when(~F.col("confirmed"), F.lit("draft"))
        .when(F.col("validity_date") <= F.lit(today), F.lit("expired"))
        .when(F.round(zero_if_null("_left"), 4) == 0, F.lit("done"))
        .otherwise(F.lit("open"))
    )
    return blankets.join(sums, blankets.id == sums.blanket_id, "left").withColumn("state", state).drop("blanket_id", "_left")


def blanket_amounts(lines: DataFrame) -> DataFrame:
    """Untaxed, tax and total per blanket order; lines need (blanket_id, price_unit, original_qty, tax_rate)."""
    untaxed = money(F.col("price_unit") * F.col("original_qty").cast("decimal(12,4)"))
    priced = lines.withColumn("_untaxed", untaxed).withColumn("_tax", money(F.col("_untaxed") * F.col("tax_rate") / 100))
    return priced.groupBy("blanket_id").agg(
        total("_untaxed").alias("amount_untaxed"), total("_tax").alias("amount_tax")
    ).withColumn("amount_total", F.col("amount_untaxed") + F.col("amount_tax"))


def blanket_expired(blankets: DataFrame, today: date) -> DataFrame:
    return blankets.filter((F.col("state") == "open") & (F.col("validity_date") <= F.lit(today)))


def nearest_blanket_line(
    sale_lines: DataFrame, blanket_lines: DataFrame, uoms: DataFrame, keys: Sequence[str], today: date, max_days: int = MAX_DISTANCE_DAYS
) -> DataFrame:
    """(keys, blanket_line_id): for each sale line a blanket line of its customer, product and currency with enough left.

    Enough is measured in the product's unit. A line that is already assigned stays while it is open and has enough,
    however far its date; else the one whose schedule date is nearest to ``today``, if nearer than ``max_days``, else the
    first undated one. Sale lines need (partner_id, product_id, currency_id, qty, uom_id, product_uom_id, blanket_line_id).

    The candidates of a (partner, product, currency) are packed into one array sorted by preference, so a sale
    line meets one row instead of every candidate and takes the first with enough quantity.
    """
    gap = F.abs(F.date_diff("date_schedule", F.lit(today)))
    usable = blanket_lines.filter(F.col("state") == "open").withColumn("_gap", gap)
    match = ["partner_id", "product_id", "currency_id"]
    far = F.coalesce(F.col("_gap") >= max_days, F.lit(False))
    entry = F.struct(
        F.col("_gap").isNull().alias("undated"), F.coalesce("_gap", F.lit(0)).alias("gap"), F.col("id").alias("id"),
        F.col("remaining").alias("remaining"), far.alias("far"),
    )
    packed = usable.groupBy(*match).agg(F.array_sort(F.collect_list(entry)).alias("_candidates"))
    asked = sale_lines.select(*keys, *match, "qty", "uom_id", "product_uom_id", F.col("blanket_line_id").alias("_assigned"))
    in_units = asked.join(uoms.select(F.col("id").alias("uom_id"), F.col("factor").alias("_from")), "uom_id", "left").join(
        uoms.select(F.col("id").alias("product_uom_id"), F.col("factor").alias("_to")), "product_uom_id", "left"
    )
    based = in_units.withColumn("_asked", convert_uom(F.col("qty"), F.col("_from"), F.col("_to"))).join(packed, match, "left")
    enough = F.filter("_candidates", lambda b: b["remaining"] >= F.col("_asked"))
    kept = F.exists("_enough", lambda b: b["id"] == F.col("_assigned"))
    nearest = F.get(F.filter("_enough", lambda b: ~b["far"]), F.lit(0))["id"]
    chosen = F.when(kept, F.col("_assigned")).otherwise(nearest)
    return based.withColumn("_enough", enough).select(*keys, chosen.alias("blanket_line_id"))


def agreed(value: str) -> Column:
    """The common value of a group, NULL when its rows differ."""
    same = F.min(value).eqNullSafe(F.max(value)) & ((F.count(value) == F.count("*")) | (F.count(value) == 0))
    return F.when(same, F.min(value)).alias(value)


def blanket_to_orders(wanted: DataFrame, shared: Sequence[str]) -> DataFrame:
    """One order per customer from chosen blanket lines; header values are kept only if all lines agree.

    ``wanted`` is (partner_id, blanket_line_id, qty, remaining, price_unit, *shared).
    """
    kept = wanted.filter(F.col("qty") != 0)
    return kept.groupBy("partner_id").agg(
        F.count("*").alias("line_count"),
        F.sum(money(F.col("price_unit") * F.col("qty").cast("decimal(12,4)"))).cast(MONEY).alias("amount"),
        F.count_if(F.col("qty") > F.col("remaining")).alias("over_quantity_lines"),
        *[agreed(c) for c in shared],
    )


def header_search_by_line(headers: DataFrame, lines: DataFrame, condition: Column, key: str) -> DataFrame:
    """Headers with at least one line that meets ``condition``."""
    hits = lines.filter(condition).select(F.col(key).alias("_header"))
    return headers.join(hits, headers.id == hits._header, "left_semi")
