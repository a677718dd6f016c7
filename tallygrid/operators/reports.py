"""Reports over orders, lines and invoices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.functions.labels import CONFIRMED
from tallygrid.functions.money import percentage, ratio, sum_when, total, zero_if_null


def sale_report_by_type(lines: DataFrame, orders: DataFrame, by: Sequence[str] = ("type_id", "state")) -> DataFrame:
    """Lines summed by order type; orders are cut to the grouping columns before the join."""
    heads = orders.select(F.col("id").alias("order_id"), *by)
    return lines.join(heads, "order_id").groupBy(*by).agg(
        F.count("*").alias("line_count"), F.sum("qty").alias("quantity"), F.sum("price_subtotal").alias("price_subtotal"), F.sum("price_total").alias("price_total")
    )


def stacked_documents(orders: DataFrame, invoices: DataFrame) -> DataFrame:
    """Orders and customer invoices one below the other, one row each; invoice ids are negative to stay apart."""
    keys = ["user_id", "currency_id", "discount_amount"]
    none = F.lit(0).cast("bigint")
    sold = orders.select("id", *keys, F.col("state").isin(*CONFIRMED).cast("bigint").alias("order_count"), none.alias("invoice_count"))
    billed = invoices.filter(F.col("move_type").isin("out_invoice", "out_refund")).select(
        (-F.col("id")).alias("id"), *keys, none.alias("order_count"), (F.col("state") == "posted").cast("bigint").alias("invoice_count")
    )
    return sold.unionByName(billed)


def union_all_analytics(orders: DataFrame, invoices: DataFrame) -> DataFrame:
    """Discounts by user and currency: orders and customer invoices summed each on their own, one result below the other.

    A group carries the smallest id of its documents, negative for invoices.
    """
    none = F.lit(0).cast("bigint")
    sold = orders.groupBy("user_id", "currency_id").agg(
        F.min("id").alias("id"), F.sum("discount_amount").alias("total_discount"),
        F.count_if(F.col("state").isin(*CONFIRMED)).alias("order_count"), none.alias("invoice_count"),
    )
    billed = invoices.filter(F.col("move_type").isin("out_invoice", "out_refund")).groupBy("user_id", "currency_id").agg(
        (-F.min("id")).alias("id"), F.sum("discount_amount").alias("total_discount"),
        none.alias("order_count"), F.count_if(F.col("state") == "posted").alias("invoice_count"),
    )
    return sold.unionByName(billed)


def discount_analytics(orders: DataFrame, invoices: DataFrame) -> DataFrame:
    """Discounts by user and currency, one row for the orders and one for the invoices, with the id of the first of them."""
    stacked = stacked_documents(orders, invoices).withColumn("_billed", F.col("id") < 0)
    return stacked.groupBy("user_id", "currency_id", "_billed").agg(
        F.when(F.col("_billed"), F.max("id")).otherwise(F.min("id")).alias("id"),
        F.sum("discount_amount").alias("total_discount"), F.sum("order_count").alias("order_count"), F.sum("invoice_count").alias("invoice_count"),
    ).drop("_billed")


def salesperson_report(orders: DataFrame, returns: DataFrame, users: DataFrame, team_of: Column, within: Column | None = None) -> DataFrame:
    """Figures of each salesperson in the own team, and the share of all orders inside and outside that team.

    ``team_of`` maps users (user_id) to their team; ``returns`` is (order_id) of incoming pickings.
    """
    people = users.select(F.col("id").alias("user_id")).withColumn("_team", team_of)
    back = returns.groupBy("order_id").agg(F.count("*").alias("_returns"))
    mine = orders.join(people, "user_id").join(back, orders.id == back.order_id, "left")
    inside = F.col("team_id").eqNullSafe(F.col("_team"))
    counted = inside if within is None else inside & within
    done = counted & (F.col("state") == "sale")
    sums = mine.groupBy("user_id").agg(
        F.count_if(counted).alias("total_orders"),
        F.count_if(done).alias("orders_done"),
        sum_when(done, "amount_total").alias("net_revenue"),
        sum_when(counted, "amount_total").alias("estimated_revenue"),
        sum_when(counted, zero_if_null("_returns")).alias("returned_orders"),
        F.count_if(~inside).alias("_elsewhere"),
    )
    everything = orders.agg(F.count("*")).scalar()
    return sums.select(
        "user_id", "total_orders", "orders_done", "net_revenue", "estimated_revenue", "returned_orders",
        ratio("estimated_revenue", "total_orders").alias("avg_price"),
        percentage("total_orders", everything).alias("overall_performance"),
        percentage("_elsewhere", everything).alias("overall_elsewhere"),
    )


def product_report(lines: DataFrame, returns: DataFrame, products: DataFrame) -> DataFrame:
    """Per template: ordered, delivered and returned quantity, revenue and means; returns are summed."""
    goods = products.select(F.col("id").alias("product_id"), "template_id")
    per_product = lines.groupBy("product_id").agg(
        F.count("*").alias("n"), F.sum("qty").alias("q"), F.sum("qty_delivered").alias("d"), F.sum("price_unit").alias("p"), F.sum("price_subtotal").alias("r")
    )
    back = returns.groupBy("product_id").agg(F.sum("quantity").alias("b"))
    sums = per_product.join(back, "product_id", "left").join(goods, "product_id").groupBy("template_id").agg(
        F.sum("n").alias("total_lines"), F.sum("q").alias("ordered_qty"), F.sum("d").alias("delivered_qty"), total("b").alias("returned_qty"),
        F.sum("r").alias("revenue"), F.sum("p").alias("_p"),
    )
    return sums.select(
        "template_id", "total_lines", "ordered_qty", "delivered_qty", "returned_qty", "revenue",
        ratio("_p", "total_lines", 8).alias("avg_price"), ratio("ordered_qty", "total_lines", 8).alias("avg_ordered"), ratio("delivered_qty", "total_lines", 8).alias("avg_delivered"),
    )


def product_sale_count(lines: DataFrame, orders: DataFrame, products: DataFrame, by: str = "product_id") -> DataFrame:
    """Confirmed lines per product or template; products without sales show 0."""
    sold = orders.filter(F.col("state").isin(*CONFIRMED)).select(F.col("id").alias("order_id"))
    counts = lines.join(sold, "order_id", "left_semi").groupBy("product_id").agg(F.count("*").alias("n"))
    goods = products.select(F.col("id").alias("product_id"), "template_id")
    return goods.join(counts, "product_id", "left").groupBy(by).agg(total("n").alias("sale_count"))


def has_orders(rows: DataFrame, orders: DataFrame, key: str) -> DataFrame:
    """Rows with a live order (existence test)."""
    return rows.join(orders.filter(F.col("state") != "cancel").select(F.col(key).alias("id")), "id", "left_semi")


def without_orders(rows: DataFrame, orders: DataFrame, key: str) -> DataFrame:
    return rows.join(orders.filter(F.col("state") != "cancel").select(F.col(key).alias("id")), "id", "left_anti")
