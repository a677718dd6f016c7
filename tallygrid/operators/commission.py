"""Agent commissions: assignment, amounts, settlement periods, settlement invoices, analysis."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.functions.dates import month_start, period_end, period_start
from tallygrid.functions.money import MONEY, PERCENT, floored, money, percent_of, total, zero_if_null
from tallygrid.operators.hooks import COMMISSION_AMOUNT, hooked

# Payment states that release a commission which waits for payment.
PAID_STATES = ("in_payment", "paid", "reversed")


def commission_status(agent_count: Column, free: Column) -> Column:
    return (
        F.when(free, F.lit("Comm. free"))
        .when(agent_count == 0, F.lit("No commission agents"))
        .when(agent_count == 1, F.lit("1 commission agent"))
        .otherwise(F.concat(agent_count.cast("string"), F.lit(" commission agents")))
    )


def assign_agents(
    lines: DataFrame,
    headers: DataFrame,
    partner_agents: DataFrame,
    agents: DataFrame,
    products: DataFrame,
    commissions: DataFrame,
    settlement_type: str,
    rule_commissions: DataFrame | None = None,
    salesperson_fallback: bool = True,
) -> DataFrame:
    """One row per line and agent with the commission that applies.

    Agents are attached to headers first, which are far fewer than lines. ``headers`` is (order_id,
    partner_id, user_id, pricelist_id); ``rule_commissions`` is (pricelist_id, product_id, commission_id).
    """
    kinds = commissions.select(F.col("id").alias("commission_id"), "settlement_type")
    able = agents.join(kinds, "commission_id").filter(
        F.col("settlement_type").isNull() | (F.col("settlement_type") == settlement_type)
    )
    serving = partner_agents.join(able.select(F.col("id").alias("agent_id"), "commission_id"), "agent_id")
    by_partner = headers.join(serving, "partner_id").select(
        "order_id", "pricelist_id", "agent_id", F.col("commission_id").alias("agent_commission"), F.lit("partner").alias("kind")
    )
    assigned = by_partner
    kept = lines.join(products.select(F.col("id").alias("product_id"), "commission_free"), "product_id")
    if salesperson_fallback:
        sellers = agents.filter("salesman_as_agent").select(
            F.col("id").alias("user_id"), F.col("commission_id").alias("agent_commission")
        )
        # Served customers still leave their commission-free lines to the salesperson.
        served = serving.select("partner_id", F.lit(True).alias("served")).distinct()
        by_seller = headers.join(sellers, "user_id").join(served, "partner_id", "left").select(
            "order_id", "pricelist_id", F.col("user_id").alias("agent_id"), "agent_commission",
            F.coalesce("served", F.lit(False)).alias("only_free"),
        )
        assigned = by_partner.unionByName(
            by_seller.select(
                "order_id", "pricelist_id", "agent_id", "agent_commission",
                F.when(F.col("only_free"), F.lit("free lines")).otherwise(F.lit("all lines")).alias("kind"),
            )
        )
    fits = (
        ((F.col("kind") == "partner") & ~F.col("commission_free"))
        | ((F.col("kind") == "free lines") & F.col("commission_free"))
        | (F.col("kind") == "all lines")
    )
    out = kept.join(assigned, "order_id").filter(fits).drop("kind")
    if rule_commissions is None:
        return out.withColumn("commission_id", F.col("agent_commission")).drop("agent_commission", "pricelist_id")
    rules = rule_commissions.select("pricelist_id", "product_id", F.col("commission_id").alias("_rule_commission"))
    return (
        out.join(rules, ["pricelist_id", "product_id"], "left")
        .withColumn("commission_id", F.coalesce("_rule_commission", "agent_commission"))
        .drop("_rule_commission", "agent_commission", "pricelist_id")
    )


def pack_bands(bands: DataFrame) -> DataFrame:
    """Bands of a commission as one ordered array: (commission_id, bands)."""
    band = F.struct("position", "amount_from", "amount_to", "percent")
    return bands.groupBy("commission_id").agg(F.array_sort(F.collect_list(band)).alias("bands"))


def band_percent(base: Column, bands: Column) -> Column:
    """Percent of the first band that holds ``base``; 0 when none does."""
    hit = F.filter(bands, lambda b: (b["amount_from"] <= base) & (base <= b["amount_to"]))
    return F.coalesce(F.get(hit, F.lit(0))["percent"], F.lit(0).cast(PERCENT))


def band_join(facts: DataFrame, bands: DataFrame, base: str) -> DataFrame:
    """Range join to bands without multiplying rows: an equi join on the commission, then an array search."""
    joined = facts.join(pack_bands(bands), "commission_id", "left")
    return joined.withColumn("percent", band_percent(F.col(base), F.col("bands"))).drop("bands")


def commission_amount(
    agent_lines: DataFrame,
    commissions: DataFrame,
    bands: DataFrame,
    formulas: Mapping[int, str] | None = None,
    refund: Column | None = None,
) -> DataFrame:
    """Amount per line and agent.

    Lines need (commission_id, commission_free, price_subtotal, standard_price, qty). A formula is
    a SQL expression over the line, by commission id. Hooks of the commission amount see it before a refund's sign.
    """
    rules = commissions.select(
        F.col("id").alias("commission_id"), "commission_type", "fix_qty", "amount_base_type"
    ).join(pack_bands(bands), "commission_id", "left")
    joined = agent_lines.join(rules, "commission_id", "left")
    subtotal = F.col("price_subtotal")
    net = floored(subtotal - money(F.col("standard_price") * F.col("qty")))
    base = F.when(F.col("amount_base_type") == "net_amount", net).otherwise(subtotal).cast(MONEY)
    amount = F.when(F.col("commission_free") | F.col("commission_type").isNull(), F.lit(0).cast(MONEY))
    for key, text in (formulas or {}).items():
        amount = amount.when((F.col("commission_type") == "formula") & (F.col("commission_id") == key), money(F.expr(text)))
    amount = (
        amount.when(F.col("commission_type") == "fixed", percent_of(base, "fix_qty"))
        .when(F.col("commission_type") == "section", percent_of(base, band_percent(base, F.col("bands"))))
        .otherwise(F.lit(0).cast(MONEY))
    )
    amount = hooked(COMMISSION_AMOUNT, amount)
    if refund is not None:
        amount = F.when(refund, -amount).otherwise(amount)
    return joined.withColumn("amount", amount.cast(MONEY)).drop("commission_type", "fix_qty", "amount_base_type", "bands")


def commission_totals(agent_lines: DataFrame, key: str = "order_id") -> DataFrame:
    """Total commission and the agents of each order or invoice."""
    return agent_lines.groupBy(key).agg(
        total("amount").alias("commission_total"),
        F.array_sort(F.collect_set("agent_id")).alias("agents"),
    )


# -- settlement ---------------------------------------------------------------------------


def settleable_lines(agent_lines: DataFrame, agents: DataFrame, commissions: DataFrame, date_to: date) -> DataFrame:
    """Lines due before the period that holds ``date_to``, with the period they belong to.

    Lines need (agent_id, commission_id, invoice_date, move_state, payment_state, settled, product_id).
    """
    who = agents.select(F.col("id").alias("agent_id"), "settlement")
    terms = commissions.select(F.col("id").alias("commission_id"), "invoice_state")
    cut_off = period_start(F.lit(date_to), "settlement")
    ready = (F.col("move_state") == "posted") & ~(
        (F.col("invoice_state") == "paid") & ~F.col("payment_state").isin(*PAID_STATES)
    )
    start = period_start("invoice_date", "settlement")
    return (
        # The latest cut-off any agent can have; this part reaches the scan.
        agent_lines.filter((F.col("invoice_date") < F.lit(date_to)) & ~F.col("settled") & F.col("product_id").isNotNull())
        .join(who, "agent_id")
        .join(terms, "commission_id")
        .filter(ready & (F.col("invoice_date") < cut_off))
        .withColumn("date_from", start)
        .withColumn("date_to", period_end(start, "settlement"))
    )


SETTLEMENT_KEYS = ("agent_id", "company_id", "currency_id", "date_from", "date_to")


def settle_commissions(due: DataFrame, existing: DataFrame) -> DataFrame:
    """One settlement per agent, company, currency and period; an open one is extended.

    ``existing`` is (id, *SETTLEMENT_KEYS, state). New settlements have a NULL id.
    """
    groups = due.groupBy(*SETTLEMENT_KEYS).agg(F.count("*").alias("line_count"), F.sum("amount").alias("amount"))
    known = existing.filter(F.col("state") == "settled").select(F.col("id").alias("settlement_id"), *SETTLEMENT_KEYS)
    return groups.join(known, list(SETTLEMENT_KEYS), "left")


def settlement_run(
    agent_lines: DataFrame, agents: DataFrame, commissions: DataFrame, settlements: DataFrame, settlement_lines: DataFrame, date_to: date, keys: Sequence[str]
) -> DataFrame:
    """The settlement lines that one more run adds: (settlement_id, *SETTLEMENT_KEYS, *keys, amount).

    ``settlements`` is (id string, *SETTLEMENT_KEYS, state) and ``settlement_lines`` (settlement_id, *keys) of all earlier
    runs. A line with a settlement that is not cancelled is settled and left out, so a repeated run adds nothing, and lines
    of cancelled settlements are due again. The open settlement of the same agent, company, currency and period takes
    the lines; else a new one does, whose id is the keys and the number of earlier settlements with these keys.
    """
    left = settled_flags(agent_lines.drop("settled"), settlement_lines, settlements, keys)
    due = settleable_lines(left, agents, commissions, date_to).select(*SETTLEMENT_KEYS, *keys, "amount")
    known = settlements.groupBy(*SETTLEMENT_KEYS).agg(
        F.min(F.when(F.col("state") == "settled", F.col("id"))).alias("_open"), F.count("*").alias("_earlier")
    )
    fresh = F.concat_ws("/", *[F.col(k).cast("string") for k in SETTLEMENT_KEYS], zero_if_null("_earlier").cast("string"))
    return due.join(known, list(SETTLEMENT_KEYS), "left").select(
        F.coalesce("_open", fresh).alias("settlement_id"), *SETTLEMENT_KEYS, *keys, "amount"
    )


def settlements_of(lines: DataFrame) -> DataFrame:
    """The open settlements that a run's lines make up, as further runs read them."""
    return lines.select(F.col("settlement_id").alias("id"), *SETTLEMENT_KEYS).distinct().withColumn("state", F.lit("settled"))


def settlement_totals(lines: DataFrame, key: str = "settlement_id") -> DataFrame:
    return lines.groupBy(key).agg(total("settled_amount").alias("total"))


def settled_flags(agent_lines: DataFrame, settlement_lines: DataFrame, settlements: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A line is settled when one of its settlements is not cancelled."""
    live = settlement_lines.join(
        settlements.filter(F.col("state") != "cancel").select(F.col("id").alias("settlement_id")), "settlement_id", "left_semi"
    )
    marks = live.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return agent_lines.join(marks, list(keys), "left").withColumn("settled", F.coalesce("_hit", F.lit(False))).drop("_hit")


def settlement_invoices(settlements: DataFrame, agents: DataFrame, grouped: bool = False) -> DataFrame:
    """Vendor bills for external agents, one per settlement or per (company, currency, agent).

    Each settlement is one line of quantity 1 or −1 with a positive price; a negative document becomes a refund.
    """
    external = agents.filter(F.col("agent_type") == "agent").select(F.col("id").alias("agent_id"))
    lines = settlements.join(external, "agent_id", "left_semi").select(
        "agent_id", "company_id", "currency_id", "date_from", "date_to",
        F.when(F.col("amount") < 0, F.lit(-1)).otherwise(F.lit(1)).alias("quantity"),
        F.abs("amount").alias("price_unit"),
    )
    keys = ["company_id", "currency_id", "agent_id"] + ([] if grouped else ["date_from", "date_to"])
    documents = lines.groupBy(*keys).agg(
        F.count("*").alias("line_count"), F.sum(F.col("quantity") * F.col("price_unit")).alias("signed_total")
    )
    return documents.select(
        *keys,
        "line_count",
        F.when(F.col("signed_total") < 0, F.lit("in_refund")).otherwise(F.lit("in_invoice")).alias("move_type"),
        F.abs("signed_total").alias("amount_total"),
    )


def settlement_state(settlements: DataFrame, bills: DataFrame) -> DataFrame:
    """Settlements with a live bill are invoiced, with a cancelled one fall back to settled.

    ``bills`` is (settlement_id, bill_state).
    """
    live = bills.groupBy("settlement_id").agg(F.bool_or(F.col("bill_state") != "cancel").alias("billed"))
    return settlements.join(live, settlements.id == live.settlement_id, "left").withColumn(
        "state",
        F.when(F.col("state") == "cancel", F.lit("cancel"))
        .when(F.coalesce("billed", F.lit(False)), F.lit("invoiced"))
        .otherwise(F.lit("settled")),
    ).drop("billed", "settlement_id")


# -- analysis -----------------------------------------------------------------------------


def commission_fact_join(agent_lines: DataFrame, invoice_lines: DataFrame, commissions: DataFrame, products: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Agent lines with invoice line, commission and product; lines without a product fall out."""
    rules = commissions.select(F.col("id").alias("commission_id"), F.col("fix_qty").alias("percentage"))
    goods = products.select(F.col("id").alias("product_id"), "categ_id", F.col("uom_id").alias("product_uom_id"))
    return agent_lines.join(invoice_lines, list(keys)).join(rules, "commission_id", "left").join(goods, "product_id")


def commission_analysis(facts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sums of quantity, amounts and commission, means of price and percent, by ``by``."""
    return facts.groupBy(*by).agg(
        F.min("order_id").alias("id"),
        F.sum("qty").alias("quantity"),
        F.round(F.sum("price_unit").cast("double") / F.count("price_unit"), 4).alias("price_unit"),
        F.sum("price_subtotal").alias("price_subtotal"),
        F.sum("balance").alias("balance"),
        F.round(F.sum("percentage").cast("double") / F.count("percentage"), 4).alias("percentage"),
        F.sum("amount").alias("amount"),
    )


def month_pivot(facts: DataFrame, row: str, day: str, value: str, months: Sequence[str]) -> DataFrame:
    """``row`` × month with a grand-total row (NULL key shown as 'Total').

    Month names are given, so no extra pass finds them.
    """
    month = F.date_format(month_start(day), "yyyy-MM")
    cells = facts.groupBy(row, month.alias("month")).agg(F.sum(value).alias("v"))
    return (
        cells.rollup(row)
        .agg(
            *[F.coalesce(F.sum(F.when(F.col("month") == m, F.col("v"))), F.lit(0)).alias(f"m_{m.replace('-', '_')}") for m in months],
            F.sum("v").alias("total"),
            F.grouping_id().alias("_level"),
        )
        .withColumn(row, F.when(F.col("_level") == 1, F.lit("Total")).otherwise(F.col(row).cast("string")))
        .drop("_level")
    )
