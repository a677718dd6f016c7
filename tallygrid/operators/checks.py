"""Policy and data checks: each returns the violating rows with a reason."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.functions.money import QTY, zero_if_null
from tallygrid.operators.pricing import path_ids


def reasons(*tests: tuple[str, Column]) -> Column:
    """Names of the failing tests of a row."""
    return F.array_compact(F.array(*[F.when(failed, F.lit(name)) for name, failed in tests]))


def failing(rows: DataFrame, *tests: tuple[str, Column]) -> DataFrame:
    """One output row per row and failing test."""
    return rows.withColumn("reason", F.explode(reasons(*tests)))


def duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with the count."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


@dataclass(frozen=True)
class KeySet:
    """Columns that must be unique in ``rows``.

    As in SQL a key with a null counts for nothing, unless ``nulls_equal`` holds: then nulls are a value like any other.
    """

    rule: str
    rows: DataFrame
    keys: tuple[str, ...]
    nulls_equal: bool = False


def uniqueness_checks(sets: Sequence[KeySet]) -> DataFrame:
    """(rule, key, n) of every key that occurs more than once, all sets in one shuffle.

    Each set is reduced to its keys and counted before the shuffle. Keys meet as JSON, so no two different keys look alike;
    ``key`` shows the values joined by a slash, nulls as nothing.
    """
    parts = []
    for s in sets:
        rows = s.rows if s.nulls_equal else s.rows.dropna(subset=list(s.keys))
        values = [F.col(k) for k in s.keys]
        shown = F.concat_ws("/", *[F.coalesce(v.cast("string"), F.lit("")) for v in values])
        exact = F.to_json(F.struct(*[v.cast("string").alias(f"k{i}") for i, v in enumerate(values)]), {"ignoreNullFields": "false"})
        parts.append(rows.select(F.lit(s.rule).alias("rule"), shown.alias("key"), exact.alias("_exact")))
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked.groupBy("rule", "key", "_exact").agg(F.count("*").alias("n")).filter("n > 1").drop("_exact")


def out_of_range(probability: Column | None = None, cancel_days: Column | None = None, rate: Column | None = None, owner: tuple[Column, Column, Column] | None = None) -> list[tuple[str, Column]]:
    """Range tests for :func:`failing`: a probability in 0..100, cancel days from 0, a rate above 0, the owner its scope asks for.

    ``owner`` is (scope, team, user). A null value fails no range test, a missing owner fails its own.
    """
    tests = []
    if probability is not None:
        tests.append(("probability out of range", ~probability.between(0, 100)))
    if cancel_days is not None:
        tests.append(("negative cancel days", cancel_days < 0))
    if rate is not None:
        tests.append(("rate not positive", rate <= 0))
    if owner is not None:
        scope, team, user = owner
        tests += [("team missing", (scope == "team") & team.isNull()), ("salesperson missing", (scope == "user") & user.isNull())]
    return tests


# -- exception rules ----------------------------------------------------------------------


@dataclass(frozen=True)
class ExceptionRule:
    """A named SQL condition that is true for a violating order or line."""

    name: str
    level: str  # 'order' or 'line'
    condition: str
    sequence: int = 10


def exception_catalog(holidays: bool = False) -> list[ExceptionRule]:
    """The standard rules over the columns of :func:`exception_facts`."""
    rules = [
        ExceptionRule("no zip", "order", "ship_zip IS NULL"),
        ExceptionRule("partner warning", "order", "partner_warning IS NOT NULL"),
        ExceptionRule("no lines", "order", "line_count IS NULL"),
        ExceptionRule("total is 0", "order", "amount_total = 0"),
        ExceptionRule("not enough stock", "line", "type = 'product' AND virtual_available < qty"),
        ExceptionRule("product warning", "line", "product_warning IS NOT NULL"),
        ExceptionRule("price below cost", "line", "standard_price <> 0 AND price_unit < standard_price"),
    ]
    return rules + ([ExceptionRule("delivery on holiday", "order", "on_holiday")] if holidays else [])


def exception_rules(orders: DataFrame, lines: DataFrame, rules: Sequence[ExceptionRule]) -> DataFrame:
    """(order, rule) for every failing rule; a line's failure counts for its order; ignored orders pass.

    Orders need (id, ignore_exceptions), lines (order_id).
    """
    kept = orders.filter(~F.col("ignore_exceptions"))

    def hits(df: DataFrame, level: str, key: str) -> DataFrame:
        chosen = [(r.name, F.expr(r.condition)) for r in rules if r.level == level]
        return failing(df, *chosen).select(F.col(key).alias("order_id"), F.col("reason").alias("rule"))

    on_lines = hits(lines, "line", "order_id").distinct().join(kept.select(F.col("id").alias("order_id")), "order_id", "left_semi")
    return hits(kept, "order", "id").unionByName(on_lines)


def exception_sort(orders: DataFrame, found: DataFrame, rules: Sequence[ExceptionRule]) -> DataFrame:
    """Orders with their main exception (lowest sequence, then name), sorted by it, newest first; clean orders last."""
    rank = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.sequence)])
    main = found.groupBy("order_id").agg(F.min_by("rule", F.struct(rank[F.col("rule")], F.col("rule"))).alias("main_exception"))
    joined = orders.join(main, orders.id == main.order_id, "left").drop("order_id")
    return joined.orderBy(F.asc_nulls_last("main_exception"), F.desc("date_order"), F.desc("name"))


def holiday_check(orders: DataFrame, partners: DataFrame, holidays: DataFrame, timezone: str) -> DataFrame:
    """Orders whose local commitment day is a holiday for the delivery country.

    ``holidays`` is (date, country_id or NULL, state_ids array); orders need (commitment_at, partner_shipping_id).
    """
    where = partners.select(F.col("id").alias("partner_shipping_id"), F.col("country_id").alias("_country"), F.col("state_id").alias("_state"))
    local = orders.join(where, "partner_shipping_id", "left").withColumn(
        "_day", F.from_utc_timestamp("commitment_at", timezone).cast("date")
    )
    days = holidays.withColumnRenamed("country_id", "_h_country")
    hit = (
        (F.col("_day") == F.col("date"))
        & (F.col("_h_country").isNull() | (F.col("_h_country") == F.col("_country")))
        & ((F.size("state_ids") == 0) | F.array_contains("state_ids", F.col("_state")))
    )
    return local.join(days, hit, "left_semi").drop("_country", "_state", "_day")


# -- prices, stock, quantities ------------------------------------------------------------


def below_cost_lines(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Product lines sold under a known cost and not approved yet."""
    goods = products.select(F.col("id").alias("product_id"), F.col("standard_price").alias("cost"))
    return lines.filter(F.col("display_type").isNull() & ~F.col("approved")).join(goods, "product_id").filter(
        (F.col("cost") > 0) & (F.col("price_unit") < F.col("cost"))
    )


def stock_block_lines(lines: DataFrame, stock: str = "free_qty") -> DataFrame:
    """Storable lines that ask for more than the chosen stock column holds."""
    return lines.filter((F.col("type") == "product") & (F.col("qty") > F.col(stock)))


def stock_block_adjust(lines: DataFrame, stock: str = "free_qty") -> DataFrame:
    """Allowed quantity and packages of blocked lines, and the quantity they would be set to."""
    allowed = F.col(stock)
    packs = F.when(F.col("pack_qty").isNotNull(), F.floor(allowed / F.col("pack_qty")).cast(QTY))
    return (
        stock_block_lines(lines, stock)
        .withColumn("allowed_qty", allowed)
        .withColumn("allowed_packs", packs)
        .withColumn("adjusted_qty", F.when((allowed > 0) & (F.col("qty") > allowed), allowed).otherwise(F.col("qty")))
    )


def restricted_qty_resolve(products: DataFrame, templates: DataFrame, categories: DataFrame) -> DataFrame:
    """Minimum, maximum, multiple and force flags of a product from itself, its template, or its category line.

    A quantity of 0 and a flag 'use_parent' mean "ask the parent". Levels carry (min_qty, max_qty,
    multiple_qty, force_min, force_max); ``categories`` also a path. Ancestors are an equi join on path ids.
    """
    numbers, flags = ("min_qty", "max_qty", "multiple_qty"), ("force_min", "force_max")

    def given(df: DataFrame, *keys: Column) -> DataFrame:
        return df.select(
            *keys, *[F.when(F.col(n) != 0, F.col(n)).alias(n) for n in numbers], *[F.when(F.col(f) != "use_parent", F.col(f)).alias(f) for f in flags]
        )

    path = categories.select(F.col("id").alias("categ_id"), F.posexplode(F.reverse(path_ids("parent_path"))).alias("depth", "ancestor"))
    levels = path.join(given(categories, F.col("id").alias("ancestor")), "ancestor")
    inherited = levels.groupBy("categ_id").agg(
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("depth"))).alias(f"_c_{c}") for c in numbers + flags]
    )
    template = given(templates, F.col("id").alias("template_id"))
    template = template.select("template_id", *[F.col(c).alias(f"_t_{c}") for c in numbers + flags])
    own = given(products, F.col("id"), F.col("template_id"), F.col("categ_id"))
    joined = own.join(template, "template_id", "left").join(inherited, "categ_id", "left")
    return joined.select(
        F.col("id").alias("product_id"),
        *[F.coalesce(n, f"_t_{n}", f"_c_{n}", F.lit(0)).cast(QTY).alias(n) for n in numbers],
        *[(F.coalesce(f, f"_t_{f}", f"_c_{f}", F.lit("not_force")) == "force").alias(f) for f in flags],
    )


def restricted_qty_check(lines: DataFrame, limits: DataFrame) -> DataFrame:
    """Lines below the minimum, above the maximum, or no multiple; forcing lifts the first two."""
    joined = lines.join(limits, "product_id")
    return failing(
        joined,
        ("below minimum", (F.col("min_qty") > 0) & (F.col("qty") < F.col("min_qty")) & ~F.col("force_min")),
        ("above maximum", (F.col("max_qty") > 0) & (F.col("qty") > F.col("max_qty")) & ~F.col("force_max")),
        ("not a multiple", (F.col("multiple_qty") > 0) & (F.pmod("qty", "multiple_qty") != 0)),
    )


def start_end_date_check(lines: DataFrame) -> DataFrame:
    """Lines of dated products without a start or end, or with the start after the end."""
    reason = (
        F.when(F.col("end_date").isNull(), F.lit("missing end date"))
        .when(F.col("start_date").isNull(), F.lit("missing start date"))
        .when(F.col("start_date") > F.col("end_date"), F.lit("start after end"))
    )
    return lines.filter("must_have_dates").withColumn("reason", reason).filter(F.col("reason").isNotNull())


# -- orders and partners ------------------------------------------------------------------


def quotation_expired(orders: DataFrame, companies: DataFrame, partners: DataFrame, today: date) -> DataFrame:
    """Open quotations past their validity by more than their own company's days; customers may opt out."""
    days = companies.select(F.col("id").alias("company_id"), "auto_cancel_days")
    asked_out = partners.filter("no_auto_cancel").select(F.col("id").alias("partner_id"))
    open_ = orders.filter(F.col("state").isin("draft", "sent")).join(days, "company_id")
    late = open_.filter(F.col("validity_date") < F.date_sub(F.lit(today), F.col("auto_cancel_days")))
    return late.join(asked_out, "partner_id", "left_anti")


def address_check(orders: DataFrame, partners: DataFrame) -> DataFrame:
    """Orders whose invoice or delivery address lies outside the customer's commercial entity."""
    entity = partners.select(F.col("id").alias("_id"), F.col("commercial_partner_id").alias("_entity"))
    bill = entity.select(F.col("_id").alias("partner_invoice_id"), F.col("_entity").alias("_bill"))
    ship = entity.select(F.col("_id").alias("partner_shipping_id"), F.col("_entity").alias("_ship"))
    joined = orders.join(bill, "partner_invoice_id", "left").join(ship, "partner_shipping_id", "left").join(
        entity.select(F.col("_id").alias("partner_id"), F.col("_entity").alias("_own")), "partner_id", "left"
    )
    return failing(
        joined,
        ("invoice address", ~F.col("_bill").eqNullSafe(F.col("_own"))),
        ("delivery address", ~F.col("_ship").eqNullSafe(F.col("_own"))),
    ).drop("_bill", "_ship", "_own")


def archivable_orders(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("state").isin("done", "cancel"))


def cancel_restriction(orders: DataFrame, pickings: DataFrame) -> DataFrame:
    """Orders that may not be cancelled because goods already left."""
    done = pickings.filter(F.col("state") == "done").select(F.col("order_id").alias("id"))
    return orders.join(done, "id", "left_semi")


def task_link_check(tasks: DataFrame, lines: DataFrame) -> DataFrame:
    """Tasks linked to an invoiced line, or to one of a locked or cancelled order."""
    joined = tasks.join(lines.select("order_id", "line_no", "qty_invoiced", "state"), ["order_id", "line_no"])
    return failing(
        joined,
        ("line is invoiced", F.col("qty_invoiced") > 0),
        ("order is locked", F.col("state") == "done"),
        ("order is cancelled", F.col("state") == "cancel"),
    )


def line_kind_check(lines: DataFrame) -> DataFrame:
    """Sections must not carry product, price or unit; product lines must have product and unit."""
    note = F.col("display_type").isNotNull()
    filled = F.col("product_id").isNotNull() | (zero_if_null("price_unit") != 0) | F.col("uom_id").isNotNull()
    return failing(
        lines,
        ("section with product data", note & filled),
        ("product line incomplete", ~note & (F.col("product_id").isNull() | F.col("uom_id").isNull())),
    )


def order_line_list(lines: DataFrame, states: Sequence[str], invoice_statuses: Sequence[str]) -> DataFrame:
    """Product lines by order state and invoice status."""
    return lines.filter(F.col("display_type").isNull() & F.col("state").isin(*states) & F.col("invoice_status").isin(*invoice_statuses))


# -- blanket orders, plans, payments ------------------------------------------------------


def blanket_consistency_check(lines: DataFrame, blanket_lines: DataFrame) -> DataFrame:
    """Order lines that disagree with their blanket line.

    Both sides carry (product_id, currency_id, partner_id, company_id); blanket lines also (id, state, remaining).
    """
    names = ("product_id", "currency_id", "partner_id", "company_id")
    other = blanket_lines.select(F.col("id").alias("blanket_line_id"), F.col("state").alias("_state"), F.col("remaining").alias("_remaining"), *[F.col(n).alias(f"_{n}") for n in names])
    joined = lines.join(other, "blanket_line_id")
    return failing(
        joined,
        *[(f"{n.removesuffix('_id')} differs", ~F.col(n).eqNullSafe(F.col(f"_{n}"))) for n in names],
        ("blanket order not open", F.col("_state") != "open"),
        ("negative remaining", F.col("_remaining") < 0),
        ("quantity not positive", F.col("qty") <= 0),
    ).drop("_state", "_remaining", *[f"_{n}" for n in names])


def plan_percent_check(plans: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders whose installments exceed 100 %, or that left draft with a zero installment."""
    instalment = F.col("invoice_type") == "installment"
    sums = plans.groupBy("order_id").agg(
        F.round(F.sum(F.when(instalment, F.col("percent"))), 0).alias("percent"), F.bool_or(instalment & (F.col("percent") == 0)).alias("has_zero")
    )
    joined = sums.join(orders.select(F.col("id").alias("order_id"), "state"), "order_id")
    return failing(joined, ("over 100 percent", F.col("percent") > 100), ("zero percent", F.col("has_zero") & (F.col("state") != "draft")))


def payment_overpay_check(sheet_lines: DataFrame) -> DataFrame:
    """Invoices paid beyond their residual by open sheets together, and payments of nothing.

    ``sheet_lines`` is (sheet_id, sheet_state, invoice_id, amount, residual).
    """
    paid = sheet_lines.filter(F.col("sheet_state") == "open").groupBy("invoice_id").agg(
        F.sum("amount").alias("paid"), F.max("residual").alias("residual"), F.bool_or(F.col("amount") == 0).alias("zero")
    )
    return failing(paid, ("over residual", F.col("paid") > F.col("residual")), ("zero amount", F.col("zero")))


def advance_payment_check(requests: DataFrame) -> DataFrame:
    """Advance requests over what may be paid in or out; amounts already in order currency.

    ``requests`` need (payment_type, currency_amount, amount_residual, amount_total).
    """
    return failing(
        requests,
        ("amount not positive", F.col("currency_amount") <= 0),
        ("inbound over residual", (F.col("payment_type") == "inbound") & (F.col("currency_amount") > F.col("amount_residual"))),
        ("outbound over advanced", (F.col("payment_type") == "outbound") & (F.col("currency_amount") > F.col("amount_total") - F.col("amount_residual"))),
    )


# -- commission, masters ------------------------------------------------------------------


def commission_band_check(bands: DataFrame) -> DataFrame:
    return bands.filter(F.col("amount_to") < F.col("amount_from"))


def agent_integrity_check(agents: DataFrame) -> DataFrame:
    """Salesman agents need exactly one linked employee; a salesperson who is an agent needs a commission."""
    sharing = agents.filter("employee_id IS NOT NULL").groupBy("employee_id").agg(F.count_if(F.col("agent_type") == "salesman").alias("_sharing"))
    joined = agents.join(sharing, "employee_id", "left")
    salesman = F.col("agent_type") == "salesman"
    return failing(
        joined,
        ("no employee", salesman & F.col("employee_id").isNull()),
        ("employee shared", salesman & (zero_if_null("_sharing") > 1)),
        ("no commission", F.col("salesman_as_agent") & F.col("commission_id").isNull()),
    ).drop("_sharing")
