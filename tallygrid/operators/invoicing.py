"""What is to invoice, invoiced and paid; invoice plans; payment sheets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrid.functions.labels import CONFIRMED
from tallygrid.functions.money import MONEY, PERCENT, QTY, floored, money, percent_of, quantity, total, zero_if_null
from tallygrid.plans.asof import convert_currency
from tallygrid.plans.skew import prefix_sums


def amount_to_invoice(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Value of what is ordered but not invoiced, per order, at least 0.

    Lines with no ordered quantity are skipped; a single line may count negative.
    """
    open_ = lines.filter(F.col("qty") > 0).withColumn(
        "_open", ((F.col("qty") - F.col("qty_invoiced")).cast("decimal(12,4)") * F.col("price_total") / F.col("qty").cast("decimal(12,4)")).cast("decimal(20,8)")
    )
    sums = open_.groupBy("order_id").agg(F.sum("_open").alias("_open"))
    confirmed = F.col("state").isin(*CONFIRMED)
    return orders.join(sums, orders.id == sums.order_id, "left").select(
        "id", "state", F.when(confirmed, money(floored(zero_if_null("_open")))).otherwise(F.lit(0).cast(MONEY)).alias("amount_to_invoice")
    )


def amount_invoiced(orders: DataFrame, invoices: DataFrame, company_currency: int) -> DataFrame:
    """Signed totals of live invoices per order.

    When order and invoice currency differ and the order is not in company currency, posted invoices
    count with their line totals (``line_total``); each invoice counts once.
    """
    links = orders.select(F.col("id").alias("order_id"), "state", F.col("currency_id").alias("_order_currency"))
    live = invoices.filter(F.col("state") != "cancel").drop("order_currency_id").withColumnRenamed("state", "invoice_state")
    third = (F.col("currency_id") != F.col("_order_currency")) & (F.col("_order_currency") != company_currency)
    sign = F.when(F.col("move_type") == "out_refund", F.lit(-1)).otherwise(F.lit(1))
    value = F.when(third, F.when(F.col("invoice_state") == "posted", F.col("line_total")).otherwise(F.lit(0))).otherwise(F.col("amount_total"))
    sums = live.join(links.filter("state <> 'cancel'"), "order_id").groupBy("order_id").agg(F.sum(sign * value).alias("amount_invoiced"))
    return links.join(sums, "order_id", "left").select("order_id", zero_if_null("amount_invoiced").cast(MONEY).alias("amount_invoiced"))


def qty_to_invoice(lines: DataFrame) -> DataFrame:
    """Quantity still to invoice by the order's or the product's policy.

    Lines need (state, product_policy, type, order_policy, order_policy_required, force_invoiced_qty, open_tasks).
    """
    by_order = (F.col("type") != "service") & F.col("order_policy").isNotNull() & F.col("order_policy_required")
    policy = F.when(by_order, F.col("order_policy")).otherwise(F.col("product_policy"))
    basis = F.when(policy == "order", F.col("qty")).otherwise(F.col("qty_delivered"))
    forced = F.when(by_order, F.lit(0)).otherwise(zero_if_null("force_invoiced_qty"))
    due = F.col("state").isin(*CONFIRMED) & F.col("display_type").isNull() & ~(F.col("open_tasks") & (F.col("type") == "service"))
    return lines.withColumn(
        "qty_to_invoice", F.when(due, basis - F.col("qty_invoiced") - forced).otherwise(F.lit(0)).cast(QTY)
    )


def untaxed_to_invoice(lines: DataFrame, invoice_lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Untaxed value still to invoice per line.

    Where an invoice line has another discount, its gross value is taken off and the rest is at least
    0; otherwise the untaxed amount already invoiced is taken off. ``lines`` need (state, product_policy,
    force_invoiced_qty); ``invoice_lines`` (*keys, inv_price, inv_qty, inv_discount, inv_subtotal, move_state).
    """
    live = invoice_lines.filter(F.col("move_state") != "cancel")
    # a line meets its invoice lines once: their least and greatest discount tell whether one differs from the line's own
    summed = live.groupBy(*keys).agg(
        F.min("inv_discount").alias("_least"),
        F.max("inv_discount").alias("_most"),
        F.sum(money(F.col("inv_price") * F.col("inv_qty").cast("decimal(12,4)"))).alias("_gross_once"),
        F.coalesce(F.sum(F.when(F.col("move_state") == "posted", F.col("inv_subtotal"))), F.lit(0)).alias("_invoiced_once"),
    )
    # lines that share their keys share what was invoiced, once for each of them
    alike = W.partitionBy(*keys)
    differs = (F.col("_least") != F.col("discount")) | (F.col("_most") != F.col("discount"))
    copies = F.count("*").over(alike)
    met = lines.join(summed, list(keys), "left").select(
        "*",
        F.bool_or(differs).over(alike).alias("_differs"),
        (F.col("_gross_once") * copies).alias("_gross"),
        (F.col("_invoiced_once") * copies).alias("_invoiced"),
    )
    basis = F.when(F.col("product_policy") == "delivery", F.col("qty_delivered")).otherwise(F.col("qty"))
    units = (basis - zero_if_null("force_invoiced_qty")).cast("decimal(12,4)")
    worth = money(less_percent_exact("price_unit", "discount") * units)
    left = F.when(F.coalesce("_differs", F.lit(False)), floored(worth - zero_if_null("_gross"))).otherwise(worth - zero_if_null("_invoiced"))
    return met.withColumn(
        "untaxed_to_invoice", F.when(F.col("state").isin(*CONFIRMED), left).otherwise(F.lit(0)).cast(MONEY)
    ).drop("_differs", "_gross", "_invoiced", *[c for c in summed.columns if c not in keys])


def less_percent_exact(price: str, discount: str) -> Column:
    """Unit price after discount, kept to four decimals."""
    return (F.col(price) * (F.lit(100).cast(PERCENT) - F.col(discount)) / F.lit(100)).cast("decimal(16,4)")


def invoice_status_override(orders: DataFrame, open_tasks: DataFrame) -> DataFrame:
    """Invoice status after open tasks, a blocking reason and forcing, the later rule winning."""
    waiting = open_tasks.groupBy("order_id").agg(F.lit(True).alias("_waiting"))
    status = (
        F.when(F.col("force_invoiced") & (F.col("state") == "sale"), F.lit("invoiced"))
        .when(F.col("blocking_reason").isNotNull() & F.col("state").isin(*CONFIRMED), F.lit("no"))
        .when(F.coalesce("_waiting", F.lit(False)), F.lit("no"))
        .otherwise(F.col("invoice_status"))
    )
    return orders.join(waiting, orders.id == waiting.order_id, "left").select("id", "state", status.alias("invoice_status"))


def advance_payment_status(orders: DataFrame, payments: DataFrame, invoices: DataFrame, rates: DataFrame) -> DataFrame:
    """Residual of an order after advances and paid invoices, and its status.

    ``payments`` is (order_id, currency_id, amount, date) of posted, unreconciled receivable lines.
    """
    heads = orders.select(F.col("id").alias("order_id"), F.col("currency_id").alias("order_currency_id"), "amount_total")
    currency = heads.select("order_id", "order_currency_id")
    advances = convert_currency(payments.join(currency, "order_id"), rates, "amount", "currency_id", "order_currency_id", "date", "_advance")
    advance = advances.groupBy("order_id").agg(F.sum("_advance").alias("advance_amount"))
    sign = F.when(F.col("move_type") == "out_refund", F.lit(-1)).otherwise(F.lit(1))
    paid = (
        invoices.filter(F.col("state") != "cancel")
        .select("order_id", "currency_id", "invoice_date", (sign * F.col("amount_total") - F.col("amount_residual")).cast(MONEY).alias("_paid"))
        .join(currency, "order_id")
    )
    paid = convert_currency(paid, rates, "_paid", "currency_id", "order_currency_id", "invoice_date", "_paid_here")
    paid_sum = paid.groupBy("order_id").agg(F.sum("_paid_here").alias("paid_amount"))
    residual = F.col("amount_total") - zero_if_null("advance_amount") - zero_if_null("paid_amount")
    status = (
        F.when(F.col("advance_amount").isNull(), F.lit("not_paid"))
        .when(F.col("amount_residual") <= 0, F.lit("paid"))
        .otherwise(F.lit("partial"))
    )
    return (
        heads.join(advance, "order_id", "left")
        .join(paid_sum, "order_id", "left")
        .withColumn("amount_residual", residual.cast(MONEY))
        .select("order_id", "amount_residual", status.alias("advance_status"))
    )


# -- invoice plans ------------------------------------------------------------------------


def invoice_plan_generate(orders: DataFrame, installments: int, start: str, interval: int, unit: str, advance: bool) -> DataFrame:
    """``installments`` rows per order, the last one taking the remainder of 100 %.

    Dates are chained: each is stepped from the one before, so Jan 31 → Feb 28 → Mar 28.
    """

    def step(d: Column) -> Column:
        if unit == "month":
            return F.add_months(d, interval)
        if unit == "year":
            return F.add_months(d, 12 * interval)
        return F.date_add(d, interval)

    percent = round(100 / installments, 2)
    first = 0 if advance else 1
    rows = orders.select(
        F.col("id").alias("order_id"), F.col(start).cast("date").alias("_start"), F.explode(F.sequence(F.lit(first), F.lit(installments))).alias("installment")
    )
    steps = F.array_repeat(F.lit(0), F.col("installment") - first)
    is_advance = F.col("installment") == 0
    share = (
        F.when(is_advance, F.lit(0.0))
        .when(F.col("installment") == installments, F.lit(round(100 - percent * (installments - 1), 2)))
        .otherwise(F.lit(percent))
    )
    return rows.select(
        "order_id",
        "installment",
        F.aggregate(steps, F.col("_start"), lambda d, _: step(d)).alias("plan_date"),
        F.when(is_advance, F.lit("advance")).otherwise(F.lit("installment")).alias("invoice_type"),
        share.cast(PERCENT).alias("percent"),
    )


def plan_progress(plans: DataFrame, orders: DataFrame) -> DataFrame:
    """Amount of each plan row, which row is last, and which is next to invoice.

    ``plans`` need (order_id, installment, invoice_type, percent, invoiced, amount_invoiced).
    """
    heads = orders.select(F.col("id").alias("order_id"), "state", "amount_untaxed")
    known = F.when(F.col("invoiced"), F.col("amount_invoiced")).otherwise(percent_of("amount_untaxed", "percent"))
    joined = plans.join(heads, "order_id").withColumn("_known", known.cast(MONEY))
    # a plan has few rows: windows over it need no further shuffle after the join
    plan = W.partitionBy("order_id")
    joined = joined.withColumn("last", F.col("installment") == F.max("installment").over(plan))
    instalment = F.col("invoice_type") == "installment"
    full = joined.select(
        "*",
        F.coalesce(F.sum(F.when(instalment & ~F.col("last"), F.col("_known"))).over(plan), F.lit(0)).alias("_before"),
        F.min(F.when(~F.col("invoiced"), F.col("installment"))).over(plan).alias("_next"),
        F.bool_or(~F.col("invoiced")).over(plan).alias("processable"),
    )
    amount = F.when(~F.col("invoiced") & F.col("last"), F.col("amount_untaxed") - F.col("_before")).otherwise(F.col("_known")).cast(MONEY)
    return full.withColumn("amount", amount).withColumn(
        "to_invoice", (F.col("state") == "sale") & F.coalesce(F.col("installment") == F.col("_next"), F.lit(False))
    ).drop("_known", "_before", "_next")


def plan_totals(progress: DataFrame) -> DataFrame:
    """Planned percent and amount of the installments per order."""
    instalment = F.col("invoice_type") == "installment"
    return progress.groupBy("order_id").agg(
        total(F.when(instalment, F.col("percent"))).alias("plan_percent"),
        total(F.when(instalment, F.col("amount"))).alias("plan_amount"),
        F.bool_or("processable").alias("processable"),
    )


def next_to_invoice(progress: DataFrame) -> DataFrame:
    return progress.filter("to_invoice")


def plan_invoice_qty(planned: DataFrame, lines: DataFrame, digits: int = 2) -> DataFrame:
    """Quantity to invoice per line for a planned installment; rows over the invoiceable quantity are flagged.

    Down payments are invoiced as −percent of one unit. ``lines`` need (qty, invoiceable, is_downpayment).
    """
    joined = planned.select("order_id", "installment", "percent", "last").join(lines, "order_id")
    share = quantity(F.col("qty").cast("decimal(14,4)") * F.col("percent") / 100, digits)
    plan = F.when(F.col("is_downpayment"), (-F.col("percent") / 100).cast(QTY)).when(F.col("last"), F.col("invoiceable")).otherwise(share)
    return joined.withColumn("plan_qty", plan.cast(QTY)).withColumn(
        "exceeds", ~F.col("last") & ~F.col("is_downpayment") & (F.abs("plan_qty") > F.abs("invoiceable"))
    )


def planned_invoices(progress: DataFrame, all_remaining: bool = False) -> DataFrame:
    """Invoices to make: the next installment, or all remaining, an advance by percent and others by quantity."""
    due = progress.filter((F.col("state") == "sale") & ~F.col("invoiced")) if all_remaining else progress.filter("to_invoice")
    method = F.when(F.col("invoice_type") == "advance", F.lit("percentage")).otherwise(F.lit("delivered"))
    return due.select("order_id", "installment", "percent", "amount", method.alias("method"))


# -- payments -----------------------------------------------------------------------------


def payment_sheet_total(sheet_lines: DataFrame) -> DataFrame:
    return sheet_lines.groupBy("sheet_id").agg(total("amount").alias("amount_total"))


def statement_lines(sheet_lines: DataFrame, merge: bool) -> DataFrame:
    """Bank statement lines of sheets: merged by (partner, ref) or one per sheet line; refunds are negative."""
    sign = F.when(F.col("move_type") == "out_refund", F.lit(-1)).otherwise(F.lit(1))
    signed = sheet_lines.withColumn("_amount", (F.abs("amount") * sign).cast(MONEY))
    keys = ["sheet_id", "partner_id", "ref"] + ([] if merge else ["invoice_id"])
    return signed.groupBy(*keys).agg(
        F.count("*").alias("line_count"),
        F.sum("_amount").alias("amount"),
        F.bool_and(F.abs("amount") >= F.col("residual")).alias("full_payment"),
    )


def greedy_payment_allocation(invoices: DataFrame, budgets: DataFrame, group: str) -> DataFrame:
    """Spread one amount per group over its open invoices: refunds first, then by (date, id).

    A refund enlarges the budget for the invoices that follow. ``budgets`` is (group, budget).
    """
    open_ = invoices.filter((F.col("state") == "posted") & (F.col("payment_state") != "paid"))
    refund = F.col("move_type") == "out_refund"
    given_back = open_.filter(refund).groupBy(group).agg(F.sum("amount_residual").alias("_back"))
    bills = prefix_sums(open_.filter(~refund), [group], [F.col("invoice_date"), F.col("id")], {"_until": F.col("amount_residual")})
    enlarged = budgets.join(given_back, group, "left").withColumn("_budget", F.col("budget") + zero_if_null("_back"))
    spread = bills.join(enlarged, group).withColumn(
        "payment", floored(F.least("amount_residual", F.col("_budget") - (F.col("_until") - F.col("amount_residual")))).cast(MONEY)
    )
    refunds = open_.filter(refund).join(budgets, group).withColumn("payment", (-F.col("amount_residual")).cast(MONEY))
    columns = [group, "id", "move_type", "payment"]
    return spread.select(*columns).unionByName(refunds.select(*columns)).filter("payment <> 0")


def payment_register_prep(invoices: DataFrame) -> DataFrame:
    """Payment rows for selected invoices."""
    outbound = F.col("move_type").isin("out_refund", "in_invoice")
    return invoices.select(
        F.col("id").alias("invoice_id"),
        "partner_id",
        F.col("amount_residual").alias("amount"),
        F.when(F.col("move_type").isin("out_invoice", "out_refund"), F.lit("customer")).otherwise(F.lit("supplier")).alias("partner_type"),
        F.when(outbound, F.lit("outbound")).otherwise(F.lit("inbound")).alias("payment_type"),
    )


def order_to_invoice_lines(lines: DataFrame, workflows: DataFrame) -> DataFrame:
    """Lines carried from orders to invoices with what the workflow and the line add.

    Lines need (workflow_id, qty_to_invoice, type, discount_fixed, must_have_dates, start_date, end_date, …);
    ``workflows`` is (id, journal_id, invoice_date_is_order_date, fill_services).
    """
    flow = workflows.select(F.col("id").alias("workflow_id"), "journal_id", "invoice_date_is_order_date", "fill_services")
    joined = lines.join(flow, "workflow_id", "left")
    manual = F.coalesce("fill_services", F.lit(False)) & (F.col("type") == "service")
    qty = F.when(manual, F.col("qty") - F.col("qty_invoiced")).otherwise(F.col("qty_to_invoice")).cast(QTY)
    return (
        joined.withColumn("quantity", qty)
        .filter(F.col("quantity") != 0)
        .withColumn("invoice_date", F.when(F.coalesce("invoice_date_is_order_date", F.lit(False)), F.col("date_order").cast("date")))
        .withColumn("line_start", F.when(F.col("must_have_dates"), F.col("start_date")))
        .withColumn("line_end", F.when(F.col("must_have_dates"), F.col("end_date")))
    )


def forcible_invoicing_orders(orders: DataFrame, invoices: DataFrame) -> DataFrame:
    """Confirmed orders that were never invoiced."""
    confirmed = orders.filter(F.col("state").isin(*CONFIRMED))
    return confirmed.join(invoices.select("order_id"), confirmed.id == F.col("order_id"), "left_anti")


def team_invoiced_mtd(invoices: DataFrame, month: Column, until: Column, extra: Column | None = None) -> DataFrame:
    """Signed untaxed amount of posted invoices per team from the start of the month on."""
    kept = invoices.filter((F.col("state") == "posted") & F.col("invoice_date").between(month, until) & F.col("payment_state").isin("paid", "in_payment", "reversed"))
    if extra is not None:
        kept = kept.filter(extra)
    sign = F.when(F.col("move_type") == "out_refund", F.lit(-1)).otherwise(F.lit(1))
    return kept.groupBy("team_id").agg(F.sum(sign * F.col("amount_untaxed")).alias("invoiced"))


