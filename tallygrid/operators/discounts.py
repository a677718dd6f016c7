"""Discounts on lines, orders and invoices."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.functions.money import CENT, MONEY, PERCENT, money, percent_of, total, zero_if_null
from tallygrid.operators.pricing import gross_amount, tax_amounts, tax_sum
from tallygrid.plans.skew import attach_totals

# Fixed value: tax factor by which a fixed after-tax discount on an order is taken back.
ORDER_TAX_FACTOR = 1.15
FACTOR = "decimal(16,8)"


def fixed_discount(lines: DataFrame) -> DataFrame:
    """Fixed amount per unit as percent (0 at price 0); the subtotal uses the unrounded percent."""
    has = zero_if_null("discount_fixed") != 0
    exact = F.when(
        has, F.coalesce(F.try_divide(F.col("discount_fixed").cast("double") * 100, F.col("price_unit").cast("double")), F.lit(0.0))
    )
    net = F.when(has & (F.col("price_unit") != 0), F.col("price_unit") - F.col("discount_fixed"))
    return lines.withColumn("discount_percent", F.round(F.coalesce(exact, F.col("discount").cast("double")), 2)).withColumn(
        "subtotal",
        F.when(net.isNotNull(), money(gross_amount(net, "qty"))).otherwise(
            money(gross_amount("price_unit", "qty", F.when(has, F.lit(0).cast(PERCENT)).otherwise(F.col("discount"))))
        ),
    )


def fixed_discount_mismatch(lines: DataFrame) -> DataFrame:
    """Lines whose fixed and percent discount are both set and disagree at the currency step."""
    both = (F.col("discount_fixed") != 0) & (F.col("discount") != 0)
    calculated = F.round(F.coalesce(F.try_divide(F.col("discount_fixed") * 100, F.col("price_unit")), F.lit(0)), 2)
    return lines.withColumn("calculated", calculated.cast(PERCENT)).filter(both & (F.col("calculated") != F.col("discount")))


def stacked_factor(discounts: Column | str) -> Column:
    """Π (1 − d/100) over an array of percents; 1 for none."""
    values = F.col(discounts) if isinstance(discounts, str) else discounts
    keep = F.aggregate(
        F.coalesce(values, F.array().cast("array<decimal(9,2)>")),
        F.lit(1).cast(FACTOR),
        lambda acc, d: (acc * (F.lit(100).cast(PERCENT) - d) * F.lit(CENT)).cast(FACTOR),
    )
    return keep


def globally_discounted(lines: DataFrame) -> DataFrame:
    """Lines (with taxes, discounts, bypass_discount) after the order's stacked discounts; tax on the new base."""
    factor = F.when(F.col("bypass_discount"), F.lit(1).cast(FACTOR)).otherwise(stacked_factor("discounts"))
    net = lines.withColumn("discounted", money(F.col("price_subtotal").cast("decimal(14,2)") * factor))
    return net.withColumn("_taxes", tax_amounts(F.col("discounted"), F.col("qty"), F.col("taxes"))).withColumn(
        "discounted_tax", tax_sum(F.col("_taxes"))
    )


def stacked_global_discount(lines: DataFrame) -> DataFrame:
    """Order amounts before and after stacked discounts."""
    return (
        globally_discounted(lines)
        .groupBy("order_id")
        .agg(
            F.sum("price_subtotal").alias("untaxed_before"),
            F.sum("price_total").alias("total_before"),
            F.sum("discounted").alias("amount_untaxed"),
            F.sum("discounted_tax").alias("amount_tax"),
        )
        .withColumn("amount_global_discount", F.col("untaxed_before") - F.col("amount_untaxed"))
        .withColumn("amount_total", F.col("amount_untaxed") + F.col("amount_tax"))
    )


def global_discount_tax_groups(lines: DataFrame) -> DataFrame:
    """Tax after stacked discounts by order and tax group."""
    taxed = globally_discounted(lines).select("order_id", F.inline("_taxes"))
    return taxed.groupBy("order_id", "tax_group").agg(F.sum("amount").alias("tax_amount"))


def global_discount_sanity(lines: DataFrame) -> DataFrame:
    """Orders with discounts where a line has no tax, or where two tax sets overlap without being equal.

    Two distinct sets overlap exactly when some tax sits in more than one distinct set of its order,
    so counting replaces comparing pairs.
    """
    checked = lines.filter((F.size(F.coalesce("discounts", F.array())) > 0) & F.col("display_type").isNull())
    ids = F.array_sort(F.array_distinct(F.transform("taxes", lambda t: t["id"])))
    sets = checked.select("order_id", ids.alias("tax_set")).distinct()
    untaxed = sets.filter(F.size("tax_set") == 0).select("order_id", F.lit("line without tax").alias("reason"))
    shared = (
        sets.select("order_id", "tax_set", F.explode("tax_set").alias("tax"))
        .groupBy("order_id", "tax")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .select("order_id", F.lit("incompatible taxes").alias("reason"))
        .distinct()
    )
    return untaxed.unionByName(shared)


def global_discount_pick(orders: DataFrame, partners: DataFrame, partner_discounts: DataFrame) -> DataFrame:
    """Discounts of the customer, else of its commercial entity, for the order's company.

    ``partner_discounts`` is (partner_id, company_id, sequence, discount).
    """
    packed = partner_discounts.groupBy("partner_id", "company_id").agg(
        F.array_sort(F.collect_list(F.struct("sequence", "discount"))).alias("_d")
    ).select("partner_id", "company_id", F.transform("_d", lambda x: x["discount"]).alias("_discounts"))
    own = packed.withColumnRenamed("_discounts", "_own")
    entity = packed.withColumnRenamed("partner_id", "commercial_partner_id").withColumnRenamed("_discounts", "_entity")
    links = partners.select(F.col("id").alias("partner_id"), "commercial_partner_id")
    joined = orders.join(links, "partner_id", "left").join(own, ["partner_id", "company_id"], "left")
    return joined.join(entity, ["commercial_partner_id", "company_id"], "left").withColumn(
        "discounts", F.coalesce("_own", "_entity")
    ).drop("_own", "_entity")


def general_discount(lines: DataFrame, orders: DataFrame, partners: DataFrame, products: DataFrame) -> DataFrame:
    """The customer's discount on every line whose product does not bypass it."""
    given = orders.select(F.col("id").alias("order_id"), "partner_id").join(
        partners.select(F.col("id").alias("partner_id"), F.col("discount").alias("general")), "partner_id", "left"
    )
    goods = products.select(F.col("id").alias("product_id"), "bypass_discount")
    return lines.join(given, "order_id").join(goods, "product_id", "left").withColumn(
        "general_discount", F.when(F.col("bypass_discount"), F.lit(0).cast(PERCENT)).otherwise(zero_if_null("general").cast(PERCENT))
    )


def total_discount_prorata(lines: DataFrame, application: str = "after_tax", tax_factor: float = ORDER_TAX_FACTOR) -> DataFrame:
    """Spread an order discount over its lines.

    Lines need (order_id, price_unit, qty, discount, add_discount, add_discount_type). A fixed
    discount is shared by base amount, a percent applies to each line alike.
    """
    base = money(gross_amount("price_unit", "qty"))
    shared = attach_totals(lines.withColumn("base", base), ["order_id"], F.sum("base").alias("order_base"))
    fixed = F.col("add_discount_type") == "fixed"
    divisor = tax_factor if application == "after_tax" else 1.0
    share = F.coalesce(F.try_divide(F.col("base").cast("double"), F.col("order_base").cast("double")), F.lit(0.0))
    second = F.when(fixed, F.col("add_discount").cast("double") / divisor * share).otherwise(F.col("add_discount").cast("double"))
    first_amount = F.col("base").cast("double") * F.col("discount").cast("double") / 100.0
    second_amount = F.when(fixed, F.col("discount2")).otherwise(F.col("base").cast("double") * F.col("discount2") / 100.0)
    spread = shared.withColumn("discount2", second).withColumn("discount_amount", first_amount + second_amount)
    return spread.withColumn(
        "discount_percent", F.coalesce(F.try_divide(F.col("discount_amount") * 100.0, F.col("base").cast("double")), F.lit(0.0))
    ).withColumn("net_subtotal", F.col("base").cast("double") - F.col("discount_amount"))


def invoice_tax_factor(lines: DataFrame) -> DataFrame:
    """Mean tax factor per document, used where invoices take back a fixed after-tax discount."""
    return lines.groupBy("order_id").agg((1 + F.avg(F.col("tax_rate").cast("double")) / 100.0).alias("tax_factor"))


def total_discount_totals(spread: DataFrame, orders: DataFrame, application: str = "after_tax") -> DataFrame:
    """Discount sum, amount after discount, amount due and total before discount per order."""
    sums = spread.groupBy("order_id").agg(
        F.round(F.sum(F.col("discount_amount").cast("decimal(24,10)")), 4).alias("total_discount"),
        F.round(F.sum(F.col("net_subtotal").cast("decimal(24,10)")), 4).alias("amount_untaxed"),
    )
    heads = orders.select(F.col("id").alias("order_id"), "amount_total", "amount_tax", "add_discount", "add_discount_type")
    due = (
        F.col("amount_total")
        if application == "before_tax"
        else F.when(F.col("add_discount_type") == "fixed", F.col("amount_total") - F.col("add_discount")).otherwise(
            F.col("amount_total") - percent_of("amount_total", "add_discount")
        )
    )
    return sums.join(heads, "order_id").select(
        "order_id",
        "total_discount",
        due.cast(MONEY).alias("amount_after_discount"),
        due.cast(MONEY).alias("amount_due"),
        (F.col("amount_untaxed") + F.col("amount_tax")).alias("total_before_discount"),
    )


def order_discount(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Percent or fixed discount on the untaxed order sum, with the reason why an input is invalid."""
    sums = lines.groupBy("order_id").agg(total("price_subtotal").alias("untaxed"), total("price_tax").alias("tax"))
    heads = orders.select(F.col("id").alias("order_id"), "discount_type", "discount_rate")
    joined = heads.join(sums, "order_id", "left").withColumn("untaxed", zero_if_null("untaxed").cast(MONEY)).withColumn(
        "tax", zero_if_null("tax").cast(MONEY)
    )
    rate, kind = F.col("discount_rate"), F.col("discount_type")
    discount = (
        F.when(kind == "percent", percent_of("untaxed", "discount_rate")).when(kind == "fixed", money(rate)).otherwise(F.lit(0).cast(MONEY))
    )
    reason = (
        F.when((F.col("untaxed") == 0) & (rate != 0), F.lit("no product"))
        .when(kind.isNull() & (rate != 0), F.lit("no discount type"))
        .when(rate < 0, F.lit("negative rate"))
        .when((kind == "percent") & (rate > 100), F.lit("over 100 percent"))
        .when((kind == "fixed") & (rate > F.col("untaxed")), F.lit("over untaxed amount"))
    )
    return joined.select(
        "order_id",
        F.col("untaxed").alias("amount_untaxed"),
        F.col("tax").alias("amount_tax"),
        discount.alias("discount_amount"),
        (F.col("untaxed") + F.col("tax") - discount).cast(MONEY).alias("amount_total"),
        reason.alias("invalid"),
    )


def invoice_amounts_with_discount(items: DataFrame, invoices: DataFrame) -> DataFrame:
    """Invoice amounts from journal items, in document currency when there is only one.

    ``items`` is (move_id, kind ∈ product/rounding/tax/payment_term, currency_id, balance,
    amount_currency, residual, residual_currency); ``invoices`` need (id, move_type, state,
    discount_amount, matched, fully_reversed).
    """
    kind = F.col("kind")

    def of(kinds, c):
        return F.coalesce(F.sum(F.when(kind.isin(*kinds), F.col(c))), F.lit(0))

    sums = items.groupBy("move_id").agg(
        (F.min("currency_id").eqNullSafe(F.max("currency_id"))).alias("single"),
        *[
            of(kinds, c).alias(name + suffix)
            for c, suffix in (("balance", ""), ("amount_currency", "_cur"))
            for name, kinds in (("untaxed", ("product", "rounding")), ("tax", ("tax",)))
        ],
        of(("payment_term",), "residual").alias("residual"),
        of(("payment_term",), "residual_currency").alias("residual_cur"),
    )
    joined = invoices.join(sums, invoices.id == sums.move_id)
    sign = F.when(F.col("move_type").isin("out_invoice", "in_refund"), F.lit(-1)).otherwise(F.lit(1))

    def pick(name):
        return F.when(F.col("single"), F.col(f"{name}_cur")).otherwise(F.col(name))

    amounts = joined.select(
        "id",
        "move_type",
        "state",
        "matched",
        "fully_reversed",
        (sign * pick("untaxed")).alias("amount_untaxed"),
        (sign * pick("tax")).alias("amount_tax"),
        (sign * (pick("untaxed") + pick("tax") + F.col("discount_amount"))).alias("amount_total"),
        (-sign * (F.col("residual_cur") - F.col("discount_amount"))).alias("amount_residual"),
    )
    settled = F.when(F.col("fully_reversed"), F.lit("reversed")).when(F.col("matched"), F.lit("paid")).otherwise(F.lit("in_payment"))
    state = (
        F.when(F.col("state") != "posted", F.lit("not_paid"))
        .when(money("amount_residual") == 0, settled)
        .when(money("amount_total") != F.abs(money("amount_residual")), F.lit("partial"))
        .otherwise(F.lit("not_paid"))
    )
    return amounts.withColumn("payment_state", state).drop("matched", "fully_reversed")


