"""Sales dashboard: filters, KPIs, series, rankings, targets, margin, alerts.

``sales`` below is one row per order with its ``amount``. With a product filter the lines are
summed per order first, so orders can be counted without a distinct count.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.functions.dates import Window, calendar, iso_weekday, month_start
from tallygrid.functions.labels import CONFIRMED, QUOTATION, named, state_label, translated
from tallygrid.functions.money import percentage, ratio, sum_when, total, zero_if_null
from tallygrid.plans.ranking import TOP_LIMIT, top_n_with_others

# Refresh choices (milliseconds).
REFRESH_CHOICES = (0, 15000, 30000, 60000, 300000)
# Alert thresholds.
STACKING_FACTOR, MIN_ORDERS, LOW_WIN_RATE, LOW_ACHIEVEMENT, LOW_MARGIN_RATE = 1.5, 3, 35, 60, 15
# Weekday labels in ISO order.
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


@dataclass(frozen=True)
class SalesFilter:
    """What the dashboard shows. ``viewer`` is a salesperson who only sees own or created orders."""

    window: Window
    company_ids: tuple[int, ...]
    team_ids: tuple[int, ...] = ()
    partner_ids: tuple[int, ...] = ()
    user_ids: tuple[int, ...] = ()
    product_ids: tuple[int, ...] = ()
    viewer: int | None = None
    refresh_ms: int = field(default=0, compare=False)

    @classmethod
    def clean(cls, raw: dict, today: date, company_ids: Sequence[int], viewer: int | None = None) -> "SalesFilter":
        """Arguments as typed by a user: last 30 days by default, swapped dates put right, bad ids dropped."""

        def day(value, default: date) -> date:
            return date.fromisoformat(str(value)[:10]) if value else default

        def ids(key: str) -> tuple[int, ...]:
            kept = []
            for value in raw.get(key) or ():
                try:
                    kept.append(int(value))
                except (TypeError, ValueError):
                    pass
            return tuple(kept)

        first, last = sorted((day(raw.get("date_from"), today - timedelta(days=29)), day(raw.get("date_to"), today)))
        try:
            refresh = int(raw.get("refresh_interval_ms") or 0)
        except (TypeError, ValueError):
            refresh = 0
        return cls(
            Window(first, last),
            tuple(company_ids),
            ids("team_ids"),
            ids("partner_ids"),
            ids("user_ids"),
            ids("product_ids"),
            viewer,
            refresh if refresh in REFRESH_CHOICES else 0,
        )

    def previous(self) -> "SalesFilter":
        return replace(self, window=self.window.previous())


def order_filter(orders: DataFrame, flt: SalesFilter, states: Sequence[str] = ()) -> DataFrame:
    keep = F.col("company_id").isin(*flt.company_ids) & flt.window.covers("date_order")
    if flt.viewer is not None:
        keep &= (F.col("user_id") == flt.viewer) | (F.col("create_uid") == flt.viewer)
    for column, allowed in (
        ("team_id", flt.team_ids),
        ("partner_id", flt.partner_ids),
        ("user_id", flt.user_ids),
        ("state", tuple(states)),
    ):
        if allowed:
            keep &= F.col(column).isin(*allowed)
    return orders.filter(keep)


def product_lines(lines: DataFrame, flt: SalesFilter) -> DataFrame:
    kept = lines.filter(F.col("display_type").isNull())
    return kept.filter(F.col("product_id").isin(*flt.product_ids)) if flt.product_ids else kept


def line_filter(orders: DataFrame, lines: DataFrame, flt: SalesFilter, states: Sequence[str] = ()) -> DataFrame:
    """Product lines of the filtered orders, with the order's columns."""
    head = order_filter(orders, flt, states).withColumnRenamed("id", "order_id")
    shared = [c for c in product_lines(lines, flt).columns if c in head.columns and c != "order_id"]
    return head.drop(*shared).join(product_lines(lines, flt), "order_id")


def sales(orders: DataFrame, lines: DataFrame, flt: SalesFilter, states: Sequence[str] = ()) -> DataFrame:
    """One row per filtered order with ``amount`` at the grain the filter asks for."""
    head = order_filter(orders, flt, states)
    if not flt.product_ids:
        return head.withColumn("amount", F.col("amount_total"))
    per_order = product_lines(lines, flt).groupBy("order_id").agg(F.sum("price_total").alias("amount"))
    return head.join(per_order, head.id == per_order.order_id).drop("order_id")


# -- metrics ------------------------------------------------------------------------------


def rows_of(base: DataFrame) -> Column:
    """How many orders a group has: ``base`` may be orders, or groups of them with their number ``n``."""
    return F.sum("n") if "n" in base.columns else F.count("*")


def core_metrics(base: DataFrame, all_orders: DataFrame | None = None) -> DataFrame:
    """One row of headline figures. ``all_orders`` counts orders without the product filter."""
    confirmed, quoted = F.col("state").isin(*CONFIRMED), F.col("state").isin(*QUOTATION)
    orders_in = F.col("n") if "n" in base.columns else F.lit(1).cast("bigint")
    figures = base.agg(
        sum_when(confirmed, "amount").alias("confirmed_revenue"),
        sum_when(quoted, "amount").alias("quotation_revenue"),
        sum_when(confirmed, orders_in).alias("confirmed_orders"),
        sum_when(quoted, orders_in).alias("quotation_orders"),
        zero_if_null(rows_of(base)).alias("all_orders"),
    )
    if all_orders is not None:
        figures = figures.withColumn("all_orders", all_orders.agg(F.count("*")).scalar())
    return figures.withColumn("average_order_value", ratio("confirmed_revenue", "confirmed_orders")).withColumn(
        "win_rate", percentage("confirmed_orders", F.col("confirmed_orders") + F.col("quotation_orders"))
    )


def quotation_funnel(metrics: DataFrame) -> DataFrame:
    whole = F.col("quotation_orders") + F.col("confirmed_orders")
    rows = [
        F.struct(F.lit(k).alias("key"), F.lit(lab).alias("label"), F.col(c).alias("value"), percentage(c, whole).alias("pct"))
        for k, lab, c in (
            ("quotations", "Open Quotations", "quotation_orders"),
            ("confirmed", "Confirmed Orders", "confirmed_orders"),
        )
    ]
    return metrics.select(F.inline(F.array(*rows)))


def state_distribution(orders: DataFrame) -> DataFrame:
    return orders.groupBy("state").agg(rows_of(orders).alias("value")).select(
        F.col("state").alias("key"), state_label("state").alias("label"), "value"
    )


# -- series -------------------------------------------------------------------------------


def _daily(base: DataFrame, window: Window, value: Column) -> DataFrame:
    per_day = base.groupBy(F.col("date_order").cast("date").alias("day")).agg(value.alias("value"))
    return calendar(base.sparkSession, window).join(per_day, "day", "left").select(
        F.col("day").alias("date"), F.date_format("day", "dd MMM").alias("label"), zero_if_null("value").alias("value")
    )


def daily_revenue(base: DataFrame, window: Window) -> DataFrame:
    return _daily(base, window, F.sum("amount"))


def daily_orders(base: DataFrame, window: Window) -> DataFrame:
    return _daily(base, window, rows_of(base))


def average_order_trend(orders: DataFrame, window: Window) -> DataFrame:
    """Mean order total per day; by design not narrowed by products."""
    return _daily(orders, window, ratio(F.sum("amount_total"), rows_of(orders)))


def monthly_revenue(base: DataFrame) -> DataFrame:
    per_month = base.groupBy(month_start("date_order").alias("date")).agg(total("amount").alias("value"))
    return per_month.select("date", F.date_format("date", "MMM yyyy").alias("label"), "value")


def weekday_heatmap(base: DataFrame) -> DataFrame:
    per_day = base.groupBy(iso_weekday("date_order").alias("key")).agg(F.sum("amount").alias("value"))
    names = F.array(*[F.lit(n) for n in WEEKDAYS])
    week = base.sparkSession.range(1, 8).select(F.col("id").cast("int").alias("key"))
    return week.join(per_day, "key", "left").select(
        "key", F.element_at(names, F.col("key")).alias("label"), zero_if_null("value").alias("value")
    )


# -- rankings -----------------------------------------------------------------------------


def _labelled(groups: DataFrame, key: str, names: DataFrame, label: Column, measures: Sequence[str]) -> DataFrame:
    """Attach names after aggregation, when one row per group is left; groups without a name become one."""
    shown = groups.join(names, groups[key] == names["id"], "left").select(
        F.coalesce(names["id"], F.lit(0)).alias("record_id"), label.alias("label"), *measures
    )
    return shown.groupBy("record_id", "label").agg(*[F.sum(m).alias(m) for m in measures])


def _first(rows: DataFrame, limit: int | None, *order: Column | str) -> DataFrame:
    """All rows without a limit, else the first ones in this order."""
    return rows if limit is None else rows.orderBy(*order).limit(limit)


def by_team(base: DataFrame, teams: DataFrame, lang: str = "en_US") -> DataFrame:
    groups = base.groupBy("team_id").agg(total("amount").alias("value"), rows_of(base).alias("orders_count"))
    return _labelled(groups, "team_id", teams.select("id", "names"), translated("names", lang, "No Team"), ["value", "orders_count"])


def by_salesperson(base: DataFrame, users: DataFrame) -> DataFrame:
    groups = base.groupBy("user_id").agg(total("amount").alias("value"), rows_of(base).alias("orders_count"))
    return _labelled(groups, "user_id", users.select("id", "name"), named("name", "No Salesperson"), ["value", "orders_count"])


def by_customer(base: DataFrame, partners: DataFrame) -> DataFrame:
    groups = base.groupBy("partner_id").agg(total("amount").alias("value"), rows_of(base).alias("orders_count"))
    return _labelled(groups, "partner_id", partners.select("id", "name"), named("name", "No Customer"), ["value", "orders_count"])


def by_product(sold: DataFrame, products: DataFrame) -> DataFrame:
    groups = sold.groupBy("product_id").agg(total("price_total").alias("value"), total("qty").alias("quantity"))
    return _labelled(groups, "product_id", products.select("id", "name"), named("name", "No Product"), ["value", "quantity"])


def by_category(sold: DataFrame, products: DataFrame) -> DataFrame:
    """Sums per product first: one row per product meets the product table."""
    per_product = sold.groupBy("product_id").agg(total("price_total").alias("value"))
    keyed = per_product.join(products.select(F.col("id").alias("product_id"), "categ_id"), "product_id", "left")
    return keyed.groupBy("categ_id").agg(total("value").alias("value")).select(
        zero_if_null("categ_id").alias("record_id"),
        F.coalesce(F.concat(F.lit("Category "), F.col("categ_id").cast("string")), F.lit("No Category")).alias("label"),
        "value",
    )


def team_performance(base: DataFrame, teams: DataFrame, lang: str = "en_US") -> DataFrame:
    return top_n_with_others(by_team(base, teams, lang), ["value", "orders_count"])


def salesperson_performance(base: DataFrame, users: DataFrame) -> DataFrame:
    return top_n_with_others(by_salesperson(base, users), ["value", "orders_count"])


def top_customers(base: DataFrame, partners: DataFrame) -> DataFrame:
    return top_n_with_others(by_customer(base, partners), ["value", "orders_count"])


def top_products(sold: DataFrame, products: DataFrame) -> DataFrame:
    return top_n_with_others(by_product(sold, products), ["value", "quantity"])


def top_categories(sold: DataFrame, products: DataFrame) -> DataFrame:
    return top_n_with_others(by_category(sold, products), ["value"])


def pivot_summary(base: DataFrame, teams: DataFrame, lang: str = "en_US", limit: int | None = None) -> DataFrame:
    confirmed, quoted = F.col("state").isin(*CONFIRMED), F.col("state").isin(*QUOTATION)
    orders_in = F.col("n") if "n" in base.columns else F.lit(1).cast("bigint")
    groups = base.groupBy("team_id").agg(
        sum_when(quoted, orders_in).alias("quotations"),
        sum_when(confirmed, orders_in).alias("confirmed_orders"),
        sum_when(confirmed, "amount").alias("revenue"),
    )
    named_groups = _labelled(
        groups, "team_id", teams.select("id", "names"), translated("names", lang, "No Team"), ["quotations", "confirmed_orders", "revenue"]
    )
    rated = named_groups.withColumn("average_order_value", ratio("revenue", "confirmed_orders")).withColumn(
        "conversion", percentage("confirmed_orders", F.col("confirmed_orders") + F.col("quotations"))
    )
    return _first(rated, limit, F.desc("revenue"), "record_id")


# -- margin -------------------------------------------------------------------------------


def line_cost(lines: DataFrame) -> Column:
    """Cost of a line; 0 where the table has no purchase price."""
    if "purchase_price" not in lines.columns:
        return F.lit(0).cast("decimal(18,2)")
    return zero_if_null("purchase_price") * zero_if_null("qty")


def with_margin(sold: DataFrame) -> DataFrame:
    """Lines with their margin; groups of lines bring its sum already."""
    if "margin" in sold.columns:
        return sold
    return sold.withColumn("margin", F.round(F.col("price_subtotal") - line_cost(sold), 2).cast("decimal(18,2)"))


def profitability(sold: DataFrame) -> DataFrame:
    summary = with_margin(sold).agg(total("price_subtotal").alias("revenue"), total("margin").alias("margin_amount"))
    return summary.withColumn("margin_rate", percentage("margin_amount", "revenue"))


def margin_by_product(sold: DataFrame, products: DataFrame, limit: int = TOP_LIMIT) -> DataFrame:
    groups = with_margin(sold).groupBy("product_id").agg(total("margin").alias("value"))
    head = groups.orderBy(F.desc("value"), "product_id").limit(limit)
    return _labelled(head, "product_id", products.select("id", "name"), named("name", "No Product"), ["value"])


def margin_by_customer(sold: DataFrame, partners: DataFrame, limit: int = TOP_LIMIT) -> DataFrame:
    groups = with_margin(sold).groupBy("partner_id").agg(total("margin").alias("value"))
    head = groups.orderBy(F.desc("value"), "partner_id").limit(limit)
    return _labelled(head, "partner_id", partners.select("id", "name"), named("name", "No Customer"), ["value"])


def low_margin_orders(sold: DataFrame, limit: int | None = None) -> DataFrame:
    """Orders with revenue; with a limit those of the smallest margin."""
    groups = (
        with_margin(sold)
        .groupBy("order_id", "name")
        .agg(total("price_subtotal").alias("revenue"), total("margin").alias("margin_amount"))
        .filter(F.col("revenue") > 0)
    )
    return _first(groups, limit, "margin_amount", "order_id").select(
        F.col("order_id").alias("record_id"),
        F.col("name").alias("label"),
        "revenue",
        "margin_amount",
        percentage("margin_amount", "revenue").alias("margin_rate"),
    )


# -- targets ------------------------------------------------------------------------------


def target_lines(targets: DataFrame, base: DataFrame, flt: SalesFilter) -> DataFrame:
    """Target, actual and achieved % per owner, from uncapped actuals.

    ``targets`` is (company_id, scope, owner_id, month_start, target_amount, active).
    """
    months = (month_start(F.lit(flt.window.date_from)), month_start(F.lit(flt.window.date_to)))
    wanted = targets.filter(
        F.col("company_id").isin(*flt.company_ids) & F.col("active") & F.col("month_start").between(*months)
    )
    for scope, allowed in (("team", flt.team_ids), ("user", flt.user_ids)):
        if allowed:
            wanted = wanted.filter((F.col("scope") != scope) | F.col("owner_id").isin(*allowed))
    planned = wanted.groupBy("scope", "owner_id").agg(F.sum("target_amount").alias("target_amount"))
    # One pass over the sales for both kinds of owner.
    owners = F.array(
        F.struct(F.lit("team").alias("scope"), F.col("team_id").alias("owner_id")),
        F.struct(F.lit("user").alias("scope"), F.col("user_id").alias("owner_id")),
    )
    actual = (
        base.filter(F.col("state").isin(*CONFIRMED))
        .select("amount", F.inline(owners))
        .groupBy("scope", "owner_id")
        .agg(F.sum("amount").alias("actual_amount"))
    )
    return planned.join(actual, ["scope", "owner_id"], "left").select(
        F.concat_ws("_", "scope", "owner_id").alias("key"),
        F.col("scope").alias("owner_type"),
        F.col("owner_id").alias("record_id"),
        "target_amount",
        zero_if_null("actual_amount").alias("actual_amount"),
        percentage(zero_if_null("actual_amount"), "target_amount").alias("achievement"),
    )


def target_progress(lines: DataFrame, limit: int | None = None) -> DataFrame:
    return _first(lines, limit, F.desc("achievement"), "key")


def target_overall(lines: DataFrame) -> DataFrame:
    return lines.agg(total("target_amount").alias("overall_target_amount"))


# -- cards --------------------------------------------------------------------------------

# KPI keys, labels and kinds; and the keys compared between periods.
KPIS = (
    ("confirmed_revenue", "Confirmed Revenue", "currency"),
    ("quotation_revenue", "Quotation Pipeline", "currency"),
    ("confirmed_orders", "Confirmed Orders", "number"),
    ("average_order_value", "Average Order Value", "currency"),
    ("win_rate", "Win Rate", "percentage"),
    ("target_achievement", "Target Achievement", "percentage"),
    ("approx_margin", "Approx. Margin", "currency"),
    ("approx_margin_rate", "Approx. Margin Rate", "percentage"),
)
COMPARED = ("confirmed_revenue", "confirmed_orders", "average_order_value", "win_rate", "approx_margin_rate", "target_achievement")


def headline(metrics: DataFrame, targets: DataFrame, profit: DataFrame) -> DataFrame:
    """One row with all figures the cards and alerts need, folded from three one-row frames."""
    margin = profit.select(
        F.col("revenue").alias("margin_revenue"), F.col("margin_amount").alias("approx_margin"), F.col("margin_rate").alias("approx_margin_rate")
    )
    stacked = metrics.unionByName(targets, allowMissingColumns=True).unionByName(margin, allowMissingColumns=True)
    row = stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])
    return row.withColumn("target_achievement", percentage("confirmed_revenue", "overall_target_amount"))


def kpi_cards(row: DataFrame) -> DataFrame:
    cards = [
        F.struct(
            F.lit(key).alias("key"),
            F.lit(label).alias("label"),
            F.col(key).cast("double").alias("value"),
            F.lit(kind).alias("type"),
        )
        for key, label, kind in KPIS
    ]
    return row.select(F.inline(F.array(*cards)))


def comparison_cards(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Difference and % change of KPI rows; 100 % when there was nothing before."""
    cur = kpi_cards(current).filter(F.col("key").isin(*COMPARED))
    prev = kpi_cards(previous).select("key", F.col("value").alias("previous_value"))
    now, before = F.round("value", 4), F.round("previous_value", 4)
    change = F.when(before == 0, F.when(now == 0, F.lit(0.0)).otherwise(F.lit(100.0))).otherwise(percentage(now - before, before))
    return cur.join(prev, "key").select(
        "key", "label", "type", now.alias("current_value"), before.alias("previous_value"),
        F.round(now - before, 4).alias("difference"), change.alias("difference_pct"),
    )


def dashboard_alerts(row: DataFrame) -> DataFrame:
    confirmed, quoted = F.col("confirmed_orders"), F.col("quotation_orders")
    checks = (
        ("warning", "No confirmed orders", confirmed == 0),
        ("info", "Quotations are stacking up", (quoted > confirmed * STACKING_FACTOR) & (quoted > MIN_ORDERS)),
        ("warning", "Low win rate", (F.col("win_rate") < LOW_WIN_RATE) & (quoted + confirmed > MIN_ORDERS)),
        (
            "danger",
            "Target is behind plan",
            (F.col("overall_target_amount") != 0) & (F.col("target_achievement") < LOW_ACHIEVEMENT),
        ),
        ("warning", "Low margin", (F.col("approx_margin_rate") < LOW_MARGIN_RATE) & (F.col("margin_revenue") != 0)),
    )
    hits = F.array_compact(
        F.array(*[F.when(hit, F.struct(F.lit(level).alias("level"), F.lit(title).alias("title"))) for level, title, hit in checks])
    )
    return row.select(F.inline(hits))


# -- lists --------------------------------------------------------------------------------


def recent_orders(orders: DataFrame, partners: DataFrame, teams: DataFrame, users: DataFrame, lang: str = "en_US", limit: int | None = None) -> DataFrame:
    """Orders with names; with a limit the newest, picked before the name joins."""
    head = _first(orders, limit, F.desc("date_order"), F.desc("id"))
    p = partners.select(F.col("id").alias("partner_id"), F.col("name").alias("_partner"))
    t = teams.select(F.col("id").alias("team_id"), "names")
    u = users.select(F.col("id").alias("user_id"), F.col("name").alias("_user"))
    return head.join(p, "partner_id", "left").join(t, "team_id", "left").join(u, "user_id", "left").select(
        "id",
        "name",
        F.date_format("date_order", "yyyy-MM-dd HH:mm").alias("date_order"),
        "state",
        translated("names", lang, "No Team").alias("team_name"),
        named("_partner", "No Customer").alias("partner_name"),
        named("_user", "No Salesperson").alias("salesperson_name"),
        zero_if_null("amount_total").alias("amount_total"),
        zero_if_null("amount_untaxed").alias("amount_untaxed"),
    )


def orders_grouped(listed: DataFrame, by: str = "none") -> DataFrame:
    """Totals of listed orders by team, salesperson, customer, state or month."""
    keys = {
        "none": F.lit("All Orders"),
        "team": named("team_name", "No Team"),
        "salesperson": named("salesperson_name", "No Salesperson"),
        "customer": named("partner_name", "No Customer"),
        "state": named("state", "No State"),
        "month": named(F.substring("date_order", 1, 7), "Unknown Month"),
    }
    return listed.groupBy(keys[by].alias("group_label")).agg(
        F.count("*").alias("orders_count"), total("amount_total").alias("amount_total")
    )


def filter_options(teams: DataFrame, users: DataFrame, products: DataFrame, partners: DataFrame, lang: str = "en_US", limits: dict[str, int] | None = None) -> DataFrame:
    """The choices offered in the filter bar; ``limits`` names the lists (kind) of which only the first by name are wanted."""
    lists = {
        "teams": teams.select("id", translated("names", lang, "").alias("name")),
        "salespeople": users.select("id", "name"),
        "products": products.filter(F.col("sale_ok") & F.col("active")).select("id", "name"),
        "partners": partners.select("id", "name"),
    }
    parts = [
        _first(df, (limits or {}).get(kind), "name", "id").select(F.lit(kind).alias("kind"), "id", "name")
        for kind, df in lists.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def order_enrich(orders: DataFrame, lines: DataFrame, products: DataFrame, teams: DataFrame, users: DataFrame, partners: DataFrame, lang: str = "en_US") -> DataFrame:
    """Lines with order, product, team, salesperson and customer names (star join)."""
    o = orders.select(F.col("id").alias("order_id"), F.col("name").alias("order_name"), "team_id", "user_id", "partner_id")
    p = products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"), "categ_id")
    t = teams.select(F.col("id").alias("team_id"), translated("names", lang, "No Team").alias("team_name"))
    u = users.select(F.col("id").alias("user_id"), F.col("name").alias("user_name"))
    c = partners.select(F.col("id").alias("partner_id"), F.col("name").alias("partner_name"))
    # Header names are attached to orders before the much larger line table is joined.
    head = o.join(t, "team_id", "left").join(u, "user_id", "left").join(c, "partner_id", "left")
    return lines.select("order_id", "product_id", "sequence", "price_total").join(head, "order_id").join(p, "product_id", "left").select(
        "order_id", "product_id", "sequence", "order_name", "product_name", "categ_id",
        F.coalesce("team_name", F.lit("No Team")).alias("team_name"), "user_name", "partner_name", "price_total",
    )
