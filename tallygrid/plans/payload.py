"""The whole dashboard for two adjacent windows from one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.functions.dates import Window, iso_weekday, month_start
from tallygrid.functions.labels import CONFIRMED, QUOTATION
from tallygrid.functions.money import sum_when, zero_if_null
from tallygrid.operators import dashboard as d
from tallygrid.operators.dashboard import SalesFilter, sales
from tallygrid.session import staged


def dashboard_payload(orders: DataFrame, lines: DataFrame, flt: SalesFilter) -> DataFrame:
    """(period, section, key) → counts and revenue.

    Both windows touch, so they are one date range in the scan. Orders are first combined to
    (day, team, user, state), which bounds the rows by calendar × teams × users × states; only that
    much is expanded into the sections.
    """
    before = flt.previous().window
    span = SalesFilter(
        Window(before.date_from, flt.window.date_to),
        flt.company_ids, flt.team_ids, flt.partner_ids, flt.user_ids, flt.product_ids, flt.viewer,
    )
    cells = (
        sales(orders, lines, span)
        .groupBy(F.col("date_order").cast("date").alias("day"), "team_id", "user_id", "state")
        .agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))
    )
    keys = {
        "daily_revenue": F.col("day").cast("string"),
        "monthly_revenue": month_start("day").cast("string"),
        "weekday_heatmap": iso_weekday("day").cast("string"),
        "team_performance": zero_if_null("team_id").cast("string"),
        "salesperson_performance": zero_if_null("user_id").cast("string"),
        "state_distribution": F.col("state"),
        "totals": F.lit("all"),
    }
    period = F.when(F.col("day") >= F.lit(flt.window.date_from), F.lit("current")).otherwise(F.lit("previous"))
    sections = F.array(*[F.struct(F.lit(s).alias("section"), k.alias("key")) for s, k in keys.items()])
    confirmed, quoted = F.col("state").isin(*CONFIRMED), F.col("state").isin(*QUOTATION)
    return (
        cells.select(period.alias("period"), "state", "n", "amount", F.inline(sections))
        .groupBy("period", "section", "key")
        .agg(
            F.sum("n").alias("orders_count"),
            sum_when(confirmed, "n").alias("confirmed_orders"),
            sum_when(quoted, "n").alias("quotation_orders"),
            sum_when(confirmed, "amount").alias("confirmed_revenue"),
            sum_when(quoted, "amount").alias("quotation_revenue"),
        )
    )


#: Columns of the order rows that the sections read.
HEAD = ("id", "name", "date_order", "state", "team_id", "user_id", "partner_id", "amount", "amount_total", "amount_untaxed")
#: What the order groups and the line groups are keyed by, besides the period.
ORDER_SETS = (("day", "state"), ("team_id", "state"), ("user_id", "state"), ("partner_id", "state"))
LINE_SETS = (("product_id",), ("partner_id",), ("order_id", "name"))
#: Orders shown in the list.
LISTED = 10


def _grouped(df: DataFrame, sets: tuple[tuple[str, ...], ...], *aggregates: Column) -> DataFrame:
    """One aggregation for all key sets; ``grouped_by`` names the set of a row, other sets' keys are null."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    made = df.groupingSets([["period", *(F.col(k) for k in s)] for s in sets], "period", *keys).agg(F.grouping_id().alias("_g"), *aggregates)
    number = {",".join(s): sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s) for s in sets}
    names = F.create_map(*[x for name, g in number.items() for x in (F.lit(g).cast("bigint"), F.lit(name))])
    return made.withColumn("grouped_by", F.element_at(names, F.col("_g"))).drop("_g")


def dashboard_bundle(
    orders: DataFrame, lines: DataFrame, targets: DataFrame, partners: DataFrame, products: DataFrame, teams: DataFrame, users: DataFrame,
    flt: SalesFilter, lang: str = "en_US", listed: int = LISTED,
) -> DataFrame:
    """(section, key, label, value, second, third): every section of the dashboard for the filter's window.

    The orders of both windows are read once and written as narrow rows, their lines once. One aggregation with grouping
    sets over the orders and one over the lines give all groups; the sections are the single operators applied to these
    groups, so each equals its own query. Rankings and the list take their heads partition by partition.
    """
    before = flt.previous().window
    span = SalesFilter(
        Window(before.date_from, flt.window.date_to),
        flt.company_ids, flt.team_ids, flt.partner_ids, flt.user_ids, flt.product_ids, flt.viewer,
    )
    period = F.when(F.col("date_order").cast("date") >= F.lit(flt.window.date_from), F.lit("current")).otherwise(F.lit("previous"))
    base = staged(sales(orders, lines, span).select(*HEAD).withColumn("period", period), "dashboard-orders")
    cells = _grouped(
        base.withColumn("day", F.col("date_order").cast("date")),
        ORDER_SETS,
        F.count("*").alias("n"), F.sum("amount").alias("amount"), F.sum("amount_total").alias("amount_total"),
    )
    cells = staged(cells, "dashboard-order-groups")
    confirmed = base.filter(F.col("state").isin(*CONFIRMED)).select(F.col("id").alias("order_id"), "name", "partner_id", "period")
    sold = d.with_margin(confirmed.join(d.product_lines(lines, flt).drop("name", "partner_id"), "order_id"))
    sums = [F.sum(c).alias(c) for c in ("price_total", "qty", "price_subtotal", "margin")]
    line_cells = staged(_grouped(sold, LINE_SETS, *sums), "dashboard-line-groups")

    def of(groups: DataFrame, by: str, when: str = "current") -> DataFrame:
        return groups.filter((F.col("period") == when) & (F.col("grouped_by") == by)).drop("period", "grouped_by")

    def done(groups: DataFrame) -> DataFrame:
        return groups.filter(F.col("state").isin(*CONFIRMED))

    def headline(when: str, span_of: SalesFilter) -> DataFrame:
        metrics = d.core_metrics(of(cells, "day,state", when))
        owners = of(cells, "team_id,state", when).unionByName(of(cells, "user_id,state", when))
        planned = d.target_overall(d.target_lines(targets, owners, span_of))
        return d.headline(metrics, planned, d.profitability(of(line_cells, "product_id", when)))

    daily = of(cells, "day,state").withColumn("date_order", F.col("day"))
    owners = of(cells, "team_id,state").unionByName(of(cells, "user_id,state"))
    now, then = headline("current", flt), headline("previous", flt.previous())
    by_product, by_partner = of(line_cells, "product_id"), of(line_cells, "partner_id")
    latest = d.recent_orders(base.filter("period = 'current'"), partners, teams, users, lang, listed)
    ranked = {
        "team_performance": (d.team_performance(done(of(cells, "team_id,state")), teams, lang), "orders_count"),
        "salesperson_performance": (d.salesperson_performance(done(of(cells, "user_id,state")), users), "orders_count"),
        "top_customers": (d.top_customers(done(of(cells, "partner_id,state")), partners), "orders_count"),
        "top_products": (d.top_products(by_product, products), "quantity"),
        "top_categories": (d.top_categories(by_product, products), None),
        "margin_top_products": (d.margin_by_product(by_product, products), None),
        "margin_top_customers": (d.margin_by_customer(by_partner, partners), None),
    }
    parts = [_section(df, name, "record_id", "label", "value", second) for name, (df, second) in ranked.items()]
    parts += [
        _section(d.kpi_cards(now), "kpis", "key", "label", "value"),
        _section(d.comparison_cards(now, then), "comparison", "key", "label", "current_value", "previous_value", "difference_pct"),
        _section(d.dashboard_alerts(now), "alerts", "level", "title"),
        _section(d.quotation_funnel(d.core_metrics(daily)), "quotation_funnel", "key", "label", "value", "pct"),
        _section(d.state_distribution(daily), "state_distribution", "key", "label", "value"),
        _section(d.daily_revenue(done(daily), flt.window), "daily_revenue", "date", "label", "value"),
        _section(d.daily_orders(done(daily), flt.window), "daily_orders", "date", "label", "value"),
        _section(d.average_order_trend(done(daily), flt.window), "average_order_trend", "date", "label", "value"),
        _section(d.monthly_revenue(done(daily)), "monthly_revenue", "date", "label", "value"),
        _section(d.weekday_heatmap(done(daily)), "weekday_heatmap", "key", "label", "value"),
        _section(d.pivot_summary(of(cells, "team_id,state"), teams, lang), "pivot_summary", "record_id", "label", "revenue", "average_order_value", "conversion"),
        _section(d.profitability(by_product).withColumn("key", F.lit("all")), "profitability", "key", "key", "revenue", "margin_amount", "margin_rate"),
        _section(d.low_margin_orders(of(line_cells, "order_id,name")), "low_margin_orders", "record_id", "label", "revenue", "margin_amount", "margin_rate"),
        _section(d.target_progress(d.target_lines(targets, owners, flt)), "target_progress", "key", "owner_type", "actual_amount", "target_amount", "achievement"),
        _section(latest, "recent_orders", "id", "partner_name", "amount_total", "amount_untaxed"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _section(df: DataFrame, name: str, key: str, label: str, *values: str | None) -> DataFrame:
    """One section's rows in the common columns."""
    numbers = [*values, None, None, None][:3]
    return df.select(
        F.lit(name).alias("section"),
        F.col(key).cast("string").alias("key"),
        F.col(label).cast("string").alias("label"),
        *[(F.col(v) if v else F.lit(None)).cast("double").alias(c) for v, c in zip(numbers, ("value", "second", "third"), strict=True)],
    )
