"""Delivery and procurement status of order lines and orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.functions.money import QTY, convert_uom, floored, zero_if_null
from tallygrid.operators.hooks import DATE_PLANNED, GROUP_NAME, hooked

KEY = ("order_id", "line_no")


def delivery_state(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """full / partial / pending per order; NULL for drafts and cancelled orders.

    Delivery-cost lines and skipped lines (``skip``) do not count; an order without relevant lines is full.
    """
    relevant = lines.filter(~F.col("is_delivery") & ~F.col("skip"))
    flags = relevant.groupBy("order_id").agg(
        F.bool_and(F.round("qty_delivered", 4) >= F.round("qty", 4)).alias("all_delivered"),
        F.bool_or(F.round("qty_delivered", 4) != 0).alias("any_delivered"),
    )
    state = (
        F.when(F.col("state").isin("draft", "cancel"), F.lit(None).cast("string"))
        .when(F.col("force_delivered") | F.coalesce("all_delivered", F.lit(True)), F.lit("full"))
        .when(F.col("any_delivered"), F.lit("partial"))
        .otherwise(F.lit("pending"))
    )
    return orders.join(flags, orders.id == flags.order_id, "left").select("id", "state", state.alias("delivery_state"))


def delivery_state_v2(orders: DataFrame, lines: DataFrame, pickings: DataFrame) -> DataFrame:
    """nothing / to_deliver / partial / delivered / processing, in that order of tests.

    ``lines`` need the product ``type``; ``pickings`` is (order_id, state).
    """
    goods = F.col("type") != "service"
    flags = lines.groupBy("order_id").agg(
        F.coalesce(F.bool_or(goods), F.lit(False)).alias("has_goods"),
        F.coalesce(F.bool_or(~goods), F.lit(False)).alias("has_services"),
        F.coalesce(F.bool_and(F.when(goods, F.col("qty_delivered") == 0)), F.lit(True)).alias("none_delivered"),
        F.coalesce(F.bool_or(F.when(goods, F.col("qty_delivered") < F.col("qty"))), F.lit(False)).alias("some_short"),
    )
    moves = pickings.groupBy("order_id").agg(F.bool_or(F.col("state").isin("waiting", "confirmed")).alias("waiting"))
    heads = orders.select(F.col("id").alias("order_id"), "state")
    joined = heads.join(flags, "order_id", "left").join(moves, "order_id", "left")

    def is_true(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(False))

    none_delivered = F.coalesce("none_delivered", F.lit(True))
    status = (
        F.when(~is_true("has_goods") & is_true("has_services") & (F.col("state") == "sale"), F.lit("delivered"))
        .when(is_true("waiting"), F.lit("processing"))
        .when(F.col("waiting").isNull() & ~is_true("has_services"), F.lit("nothing"))
        .when(none_delivered, F.lit("to_deliver"))
        .when(is_true("some_short"), F.lit("partial"))
        .otherwise(F.lit("delivered"))
    )
    return joined.select("order_id", "state", status.alias("delivery_status"))


def all_qty_delivered(lines: DataFrame) -> DataFrame:
    """Whether every line that is no service is delivered exactly."""
    exact = (F.col("type") == "service") | (F.round("qty_delivered", 4) == F.round("qty", 4))
    return lines.groupBy("order_id").agg(F.bool_and(exact).alias("all_qty_delivered"))


def remaining_to_deliver(lines: DataFrame) -> DataFrame:
    """Open quantity per line and whether the rest may be cancelled."""
    open_ = floored(F.col("qty") - F.col("qty_delivered") - zero_if_null("qty_canceled")).cast(QTY)
    return lines.withColumn("remaining", open_).withColumn(
        "can_cancel", (F.round("remaining", 4) > 0) & F.col("state").isin("sale", "done")
    )


def cancel_remaining(lines: DataFrame, decrease_ordered: bool = False) -> DataFrame:
    """Lines after cancelling what is left: cancelled quantity, and ordered quantity if it is to follow."""
    checked = remaining_to_deliver(lines)
    cancelled = F.when(F.col("can_cancel"), F.col("qty") - F.col("qty_delivered")).otherwise(zero_if_null("qty_canceled"))
    ordered = F.when(F.col("can_cancel") & (F.col("state") == "sale") & F.lit(decrease_ordered), F.col("qty_delivered")).otherwise(F.col("qty"))
    return checked.withColumn("qty_canceled_after", cancelled.cast(QTY)).withColumn("qty_after", ordered.cast(QTY))


def procured_join(lines: DataFrame, moves: DataFrame, uoms: DataFrame) -> DataFrame:
    """Lines with the signed, unit-converted quantity of each of their live moves."""
    live = moves.filter((F.col("state") != "cancel") & ~F.col("scrapped"))
    to_customer = F.col("dest_usage") == "customer"
    sign = (
        F.when(to_customer & (~F.col("is_return") | F.col("to_refund")), F.lit(1))
        .when(~to_customer & F.col("to_refund"), F.lit(-1))
        .otherwise(F.lit(0))
    )
    # One row per line and move unit before the join.
    summed = live.groupBy(*KEY, "product_id", F.col("uom_id").alias("move_uom")).agg(
        F.sum(F.col("quantity") * sign).cast(QTY).alias("moved")
    )
    line_unit = uoms.select(F.col("id").alias("uom_id"), F.col("factor").alias("_line_factor"))
    move_unit = uoms.select(F.col("id").alias("move_uom"), F.col("factor").alias("_move_factor"))
    converted = convert_uom("moved", "_move_factor", "_line_factor")
    return (
        lines.join(line_unit, "uom_id", "left")
        .join(summed.join(move_unit, "move_uom"), [*KEY, "product_id"], "left")
        .withColumn("procured", F.coalesce(converted, F.lit(0).cast(QTY)))
        .drop("_line_factor", "_move_factor")
    )


def qty_procured(lines: DataFrame, moves: DataFrame, uoms: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Procured quantity and what is still to procure, per line."""
    joined = procured_join(lines, moves, uoms)
    return joined.groupBy(*KEY, "product_id", "qty", *keep).agg(F.sum("procured").cast(QTY).alias("qty_procured")).withColumn(
        "qty_to_procure", (F.col("qty") - F.col("qty_procured")).cast(QTY)
    )


def has_pending_delivery(procured: DataFrame, orders: DataFrame) -> DataFrame:
    """Every order, whatever its state; without lines nothing is pending. Pass ``procured`` without services."""
    pending = procured.groupBy("order_id").agg(F.bool_or(F.col("qty_to_procure") > 0).alias("pending"))
    return orders.select(F.col("id").alias("order_id"), "state").join(pending, "order_id", "left").withColumn(
        "pending", F.coalesce("pending", F.lit(False))
    )


# Priorities of the keys by which lines are grouped for procurement.
GROUP_PRIORITY = {"order": 8, "warehouse": 10, "date": 24}


def procurement_groups(lines: DataFrame, security_lead: int) -> DataFrame:
    """Group key and name of each line by the strongest criterion: planned date, warehouse, order.

    Lines need (order_id, order_name, commitment_date, warehouse_id, blocked). Hooks may move the planned date and
    refine the name, as a split by lot or elaboration does.
    """
    planned = hooked(DATE_PLANNED, F.date_sub("commitment_date", security_lead))
    dated, stored = F.col("commitment_date").isNotNull(), F.col("line_warehouse_id").isNotNull()
    return (
        lines.filter(~F.col("blocked"))
        .withColumn(
            "priority",
            F.when(dated, F.lit(GROUP_PRIORITY["date"])).when(stored, F.lit(GROUP_PRIORITY["warehouse"])).otherwise(F.lit(GROUP_PRIORITY["order"])),
        )
        .withColumn(
            "group_name",
            hooked(
                GROUP_NAME,
                F.when(dated, F.concat_ws("/", "order_name", planned.cast("string")))
                .when(stored, F.concat_ws("/", "order_name", F.concat(F.lit("W"), F.col("line_warehouse_id").cast("string"))))
                .otherwise(F.col("order_name")),
            ),
        )
        .withColumn("date_planned", planned)
    )


def procurement_group_totals(grouped: DataFrame) -> DataFrame:
    return grouped.groupBy("order_id", "priority", "group_name").agg(
        F.count("*").alias("line_count"), F.sum("qty_to_procure").alias("qty_to_procure")
    )


def manual_deliveries(lines: DataFrame) -> DataFrame:
    """Open manual deliveries by partner, carrier-free: one group per (partner, planned date)."""
    open_ = lines.filter(F.col("qty_to_procure") > 0)
    return open_.groupBy("partner_id", "date_planned").agg(
        F.count("*").alias("line_count"), F.sum("qty_to_procure").alias("quantity")
    )


def manual_delivery_prep(lines: DataFrame, asked: str = "asked") -> DataFrame:
    """Lines to procure of the chosen orders with the reason when the asked quantity is too large or partners mix."""
    open_ = lines.filter(F.col("qty_to_procure") > 0)
    partners = open_.groupBy("batch").agg((F.min("partner_id") != F.max("partner_id")).alias("mixed"))
    reason = F.when(F.col(asked) > F.col("qty_to_procure"), F.lit("over quantity")).when(F.col("mixed"), F.lit("several partners"))
    return open_.join(partners, "batch").withColumn("reason", reason)


def picking_fill(moves: DataFrame) -> DataFrame:
    """Picked, unfinished moves short of demand take their line quantity."""
    short = F.col("picked") & ~F.col("state").isin("done", "cancel") & (F.col("quantity_done") < F.col("demand"))
    return moves.withColumn("quantity_done", F.when(short, F.col("demand")).otherwise(F.col("quantity_done")))


def free_stock_by_location(quants: DataFrame, locations: DataFrame) -> DataFrame:
    """Free quantity of each product per internal location."""
    internal = locations.filter(F.col("usage") == "internal").select(F.col("id").alias("location_id"))
    return quants.join(internal, "location_id", "left_semi").groupBy("product_id", "location_id").agg(
        F.sum(F.col("quantity") - F.col("reserved")).alias("free_qty")
    )


def move_sequence_copy(moves: DataFrame, lines: DataFrame) -> DataFrame:
    return moves.join(lines.select(*KEY, F.col("sequence").alias("move_sequence")), list(KEY), "left")


def purchase_orders_of_sale(lines: DataFrame, direct: DataFrame, through_moves: DataFrame) -> DataFrame:
    """Purchase orders reached from an order by its lines' groups directly, or through stock moves.

    ``lines`` is (order_id, group_id); ``direct`` (group_id, purchase_id); ``through_moves`` (group_id, purchase_id).
    """
    groups = lines.select("order_id", "group_id").distinct()
    paths = direct.select("group_id", "purchase_id").unionByName(through_moves.select("group_id", "purchase_id"))
    return groups.join(paths, "group_id").select("order_id", "purchase_id").distinct()


