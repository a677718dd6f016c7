"""Cumulative price rules and promotion rules.

Rule tables are small; they are packed into arrays, so facts meet them by equi join or as one
constant and rows are never multiplied by rules.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrid.functions.money import CENT, MONEY, PERCENT, QTY, money
from tallygrid.operators.hooks import PROMOTION_OFFERED, hooked
from tallygrid.operators.pricing import gross_amount, path_ids, tax_total, untaxed_base
from tallygrid.plans.skew import pick_last
from tallygrid.session import staged

# Codes of the two cumulative rule kinds; the template kind takes precedence.
BY_TEMPLATE, BY_CATEGORY = "3_1_global_product_template", "3_2_global_product_category"


def cumulative_qty(lines: DataFrame) -> DataFrame:
    """Each product line with the order's quantity of its template and of its category.

    Lines need (order_id, template_id, categ_id, unit_qty, display_type); one without one of the three ids falls out. The
    sums are windows inside an order: lines that an earlier join dealt by order stay where they are, and a large group
    is sorted on disk.
    """
    ids = F.col("order_id").isNotNull() & F.col("template_id").isNotNull() & F.col("categ_id").isNotNull()
    plain = lines.filter(F.col("display_type").isNull() & ids)
    for key, name in (("template_id", "template_qty"), ("categ_id", "category_qty")):
        plain = plain.withColumn(name, F.sum("unit_qty").over(W.partitionBy("order_id", key)).cast(QTY))
    return plain


def rule_prefix_join(categories: DataFrame, rules: DataFrame) -> DataFrame:
    """Category rules that apply to each category: those set on it or on an ancestor (prefix of the path)."""
    nodes = categories.select(F.col("id").alias("categ_id"), F.explode(path_ids("parent_path")).alias("global_categ_id"))
    return nodes.join(rules.filter(F.col("applied_on") == BY_CATEGORY), "global_categ_id")


def _packed(rules: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Rules per key, best first: larger minimum, then newer."""
    entry = F.struct(
        (-F.col("min_quantity")).alias("rank"), (-F.col("id")).alias("newest"), "id", "min_quantity", "compute_price",
        "fixed_price", "percent_price", "date_start", "date_end",
    )
    return rules.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias(name))


def cumulative_price_rules(lines: DataFrame, rules: DataFrame, categories: DataFrame) -> DataFrame:
    """Rule, price and discount of each line from cumulated quantities.

    Lines need (order_id, pricelist_id, template_id, categ_id, unit_qty, list_price, day, display_type). Precedence: template
    rules before category rules, then larger minimum quantity, then higher id.
    """
    summed = cumulative_qty(lines)
    templates = _packed(
        rules.filter(F.col("applied_on") == BY_TEMPLATE).withColumnRenamed("global_product_tmpl_id", "template_id"),
        ["pricelist_id", "template_id"],
        "_by_template",
    )
    branches = _packed(rule_prefix_join(categories, rules), ["pricelist_id", "categ_id"], "_by_category")
    joined = summed.join(templates, ["pricelist_id", "template_id"], "left").join(branches, ["pricelist_id", "categ_id"], "left")

    def first_fit(rules_: str, qty: str) -> Column:
        def fits(r):
            in_time = (r["date_start"].isNull() | (r["date_start"] <= F.col("day"))) & (
                r["date_end"].isNull() | (F.col("day") <= r["date_end"])
            )
            return ((r["min_quantity"] == 0) | (F.col(qty) >= r["min_quantity"])) & in_time

        return F.get(F.filter(rules_, fits), F.lit(0))

    picked = joined.withColumn("_rule", F.coalesce(first_fit("_by_template", "template_qty"), first_fit("_by_category", "category_qty")))
    rule = F.col("_rule")
    price = (
        F.when(rule["compute_price"] == "fixed", rule["fixed_price"])
        .when(rule["compute_price"] == "percentage", money(F.col("list_price") * (F.lit(100).cast(PERCENT) - rule["percent_price"]) * F.lit(CENT)))
        .otherwise(F.col("list_price"))
    )
    return picked.withColumn("rule_id", rule["id"]).withColumn("rule_price", price.cast(MONEY)).drop("_rule", "_by_template", "_by_category")


# -- promotions ---------------------------------------------------------------------------

AMOUNT = "decimal(28,2)"
#: Steps of one cent that a fixed discount's price may be moved to meet its amount after tax rounding.
CENT_STEPS = 20
_LINE = "struct<price:decimal(18,2),untaxed:decimal(18,2),taxed:decimal(18,2)>"
_STATE = (
    f"struct<u:{AMOUNT},t:{AMOUNT},groups:array<struct<start:decimal(9,2),now:decimal(9,2),taken:array<bigint>>>,"
    "applied:array<bigint>,coupon:boolean,lines:array<struct<rule_id:bigint,price:decimal(18,2)>>>"
)


def promotion_usage(rules_of_orders: DataFrame) -> DataFrame:
    """How many non-cancelled orders of each partner took each rule, and the first and last of them."""
    used = rules_of_orders.filter(F.col("state") != "cancel")
    return used.groupBy("rule_id", "partner_id").agg(
        F.count_distinct("order_id").alias("n_orders"), F.min("order_id").alias("first_order"), F.max("order_id").alias("last_order")
    )


def order_bases(lines: DataFrame) -> DataFrame:
    """Per order the sums before any discount, without and with tax, and the discounts its lines start with.

    Promotion lines do not count. All lines of one discount fare alike, so the fold needs each discount once; there are
    at most 10,001 of them.
    """
    gross = gross_amount("price_unit", "qty")
    plain = lines.filter(~F.col("is_promotion_line")).withColumn("_base", untaxed_base(gross, F.col("qty"), F.col("taxes")))
    sums = plain.withColumn("_tax", tax_total(F.col("_base"), F.col("qty"), F.col("taxes")))
    return sums.groupBy("order_id").agg(
        F.sum("_base").alias("base_untaxed"),
        F.sum(F.col("_base") + F.col("_tax")).alias("base_taxed"),
        F.collect_set(F.col("discount").cast(PERCENT)).alias("discounts"),
    )


def rates_of_day(rates: DataFrame, today: date) -> DataFrame:
    """(currency_id, rate) valid on ``today`` from (id, currency_id, date, rate)."""
    return pick_last(rates.filter(F.col("date") <= F.lit(today)), ["currency_id"], [F.col("date"), F.col("id")], ["rate"])


def fixed_discounts(rules: DataFrame, rates: DataFrame) -> DataFrame:
    """Rules with ``lines``: for each currency the price of a fixed amount's discount line and what it takes off.

    The amount is converted from the rule's currency and worked back through ``taxes`` of the discount product to the
    amount without or with tax; then the price moves by cents until the rounded result meets the amount or passes it.
    Percentages have no lines. ``rates`` has one row for each currency.
    """
    one = F.lit(1).cast(QTY)

    def with_result(df: DataFrame, price: str) -> DataFrame:
        """Adds ``_base``, ``_taxed`` and ``_sign``, how the result that counts compares with the amount."""
        based = df.withColumn("_base", untaxed_base(F.col(price).cast("decimal(24,6)"), one, F.col("taxes")))
        based = based.withColumn("_taxed", (F.col("_base") + tax_total(F.col("_base"), one, F.col("taxes"))).cast(MONEY))
        result = F.when(F.col("discount_type") == "amount_tax_included", F.col("_taxed")).otherwise(F.col("_base"))
        return based.withColumn("_result", result).withColumn("_sign", F.signum(result - F.col("_amount")).cast("int"))

    all_rates = rates.agg(F.collect_list(F.struct("currency_id", "rate"))).scalar()
    own = rates.select("currency_id", F.col("rate").alias("_own"))
    fixed = rules.filter(F.col("discount_type") != "percentage").select("id", "currency_id", "discount_type", "discount_amount", "taxes")
    each = fixed.join(own, "currency_id").withColumn("_c", F.explode(all_rates))
    each = each.withColumn("_amount", money(F.col("discount_amount") * F.col("_c.rate") / F.col("_own")))
    met = with_result(each, "_amount")
    ratio = F.col("_amount").cast("decimal(20,2)") / F.col("_result").cast("decimal(18,2)")
    start = F.when(F.col("_sign") == 0, F.col("_amount")).otherwise(money(F.col("_amount") * ratio))
    first = with_result(met.withColumn("_start", start), "_start").withColumnRenamed("_sign", "_first")
    tried = first.withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(CENT_STEPS))))
    tried = with_result(tried.withColumn("_price", (F.col("_start") - (F.lit(CENT) * F.col("_first") * F.col("_step")).cast(MONEY)).cast(MONEY)), "_price")
    done = tried.filter((F.col("_sign") != F.col("_first")) | (F.col("_first") == 0) | (F.col("_step") == CENT_STEPS))
    line = F.struct(F.col("_price").alias("price"), F.col("_base").alias("untaxed"), F.col("_taxed").alias("taxed"))
    picked = done.groupBy("id", F.col("_c.currency_id").alias("_currency")).agg(F.min_by(line, "_step").alias("_line"))
    lines = picked.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("_currency", "_line"))).alias("lines"))
    empty = F.create_map().cast(f"map<bigint,{_LINE}>")
    return rules.join(lines, "id", "left").withColumn("lines", F.coalesce("lines", empty))


def candidate_rules(orders: DataFrame, rules: DataFrame, today: date) -> DataFrame:
    """Orders with ``_rules``, those that can hold for them, coupon first, then by (sequence, id).

    Rules are met by what they are restricted to: partner, else pricelist, else coupon code, each packed for one key; only
    automatic rules without a restriction go to every order, since every order has to test them. Hooks of the offer
    get the answer so far and the rule (a field each for id, type, amounts and strategy).
    """
    day = F.lit(today)
    live = rules.filter((F.col("date_from").isNull() | (F.col("date_from") <= day)) & (F.col("date_to").isNull() | (day <= F.col("date_to"))))
    fields = (
        "id", "rule_type", "code", "discount_type", "discount_amount", "minimal_amount", "minimal_tax_incl",
        "once_per_partner", "strategy", "pricelist_ids", "only_newsletter", "lines",
    )
    entry = F.struct((F.col("rule_type") != "coupon").alias("auto"), F.col("sequence"), *fields)
    by_partner, by_list = F.size("partner_ids") > 0, F.size("pricelist_ids") > 0
    coupon = F.col("rule_type") == "coupon"

    def packed(chosen: DataFrame, key: str, value: Column, name: str) -> DataFrame:
        return chosen.withColumn("_entry", entry).select(value.alias(key), "_entry").groupBy(key).agg(F.collect_list("_entry").alias(name))

    partner = packed(live.filter(by_partner), "partner_id", F.explode(F.array_distinct("partner_ids")), "_p")
    pricelist = packed(live.filter(~by_partner & by_list & ~coupon), "pricelist_id", F.explode(F.array_distinct("pricelist_ids")), "_l")
    code = packed(live.filter(~by_partner & coupon), "_code", F.lower("code"), "_c")
    everywhere = live.filter(~by_partner & ~by_list & ~coupon).withColumn("_entry", entry).agg(F.collect_list("_entry")).scalar()
    met = orders.withColumn("_code", F.lower("coupon_code")).join(partner, "partner_id", "left").join(pricelist, "pricelist_id", "left")
    met = met.join(code, "_code", "left").withColumn("_all", everywhere)
    none = F.array()

    def holds(r: Column) -> Column:
        listed = (F.size(r["pricelist_ids"]) == 0) | F.coalesce(F.array_contains(r["pricelist_ids"], F.col("pricelist_id")), F.lit(False))
        named = (r["rule_type"] == "auto") | F.coalesce(F.lower(r["code"]) == F.col("_code"), F.lit(False))
        return hooked(PROMOTION_OFFERED, listed & named & (~r["only_newsletter"] | F.coalesce(F.col("newsletter"), F.lit(False))), r)

    together = F.concat(*[F.coalesce(c, none) for c in ("_p", "_l", "_c", "_all")])

    def own_line(r: Column) -> Column:
        names = [c for c in ("auto", "sequence", *fields) if c not in ("lines", "code", "pricelist_ids")]
        return F.struct(*[r[c].alias(c) for c in names], F.try_element_at(r["lines"], F.col("currency_id")).alias("line"))

    possible = F.sort_array(F.transform(F.filter(together, holds), own_line))
    return met.withColumn("_rules", possible).drop("_p", "_l", "_c", "_all", "_code")


def applied_rules(
    orders: DataFrame, lines: DataFrame, rules: DataFrame, rates: DataFrame, today: date, used: DataFrame | None = None
) -> DataFrame:
    """(order_id, applied, groups, lines): the fold of each order over its rules, coupon first, then by sequence.

    The state carries the order's untaxed and taxed sums, its lines' discounts and the rules taken. A fixed amount that at
    least one line takes becomes a negative line, which lowers the sums that the next rule's minimum is compared with; a
    percentage changes only discounts, which the sums leave out. ``groups`` has (start, now, taken) for each discount the
    lines start with; ``lines`` the discount lines.

    ``orders`` has (id, partner_id, pricelist_id, currency_id, newsletter, coupon_code), ``rules`` may restrict by
    ``partner_ids`` and ``pricelist_ids``, ``rates`` is (id, currency_id, date, rate), ``used`` is (partner_id, rule_id,
    order_id, state) of earlier use. A fixed amount without a rate for the order's currency is not taken.
    """
    # four joins read the rules: the prices are worked out once
    priced = staged(fixed_discounts(rules, rates_of_day(rates, today)), "promotion-rules")
    heads = candidate_rules(orders, priced, today).withColumnRenamed("id", "order_id").join(order_bases(lines), "order_id", "left")
    if used is not None:
        once = used.join(rules.filter("once_per_partner").select(F.col("id").alias("rule_id")), "rule_id")
        counts = promotion_usage(once).groupBy("partner_id").agg(F.map_from_entries(F.collect_list(F.struct("rule_id", "n_orders"))).alias("_used"))
        own = once.filter("state <> 'cancel'").groupBy("order_id").agg(F.collect_set("rule_id").alias("_own"))
        heads = heads.join(counts, "partner_id", "left").join(own, "order_id", "left")
    else:
        heads = heads.withColumn("_used", F.lit(None).cast("map<bigint,bigint>")).withColumn("_own", F.lit(None).cast("array<bigint>"))

    def unused(r: Column) -> Column:
        own = F.when(F.coalesce(F.array_contains("_own", r["id"]), F.lit(False)), F.lit(1)).otherwise(F.lit(0))
        return ~r["once_per_partner"] | (F.coalesce(F.try_element_at(F.col("_used"), r["id"]), F.lit(0)) - own <= 0)

    def fold(acc: Column, r: Column) -> Column:
        percent = r["discount_type"] == "percentage"
        line = r["line"]
        holds = (
            (r["minimal_amount"] < F.when(r["minimal_tax_incl"], acc["t"]).otherwise(acc["u"]))
            & ~((r["strategy"] == "exclusive") & (F.size(acc["applied"]) > 0))
            & ~((r["rule_type"] == "coupon") & acc["coupon"])
            & (percent | line.isNotNull())
        )

        def takes(g: Column) -> Column:
            now = g["now"]
            return (
                r["strategy"].isin("cumulate", "exclusive")
                | ((r["strategy"] == "use_best") & ((now == 0) | (r["discount_amount"] > now)))
                | ((r["strategy"] == "keep_existing") & (now == 0))
            )

        def changed(g: Column) -> Column:
            kept = F.when(r["strategy"] == "cumulate", g["now"]).otherwise(F.lit(0).cast(PERCENT))
            now = (kept + F.when(percent, r["discount_amount"]).otherwise(F.lit(0).cast(PERCENT))).cast(PERCENT)
            after = F.struct(g["start"].alias("start"), now.alias("now"), F.concat(g["taken"], F.array(r["id"])).alias("taken"))
            return F.when(takes(g), after).otherwise(g)

        off = ~percent & F.exists(acc["groups"], takes)
        after = F.struct(
            (acc["u"] - F.when(off, line["untaxed"]).otherwise(F.lit(0))).cast(AMOUNT).alias("u"),
            (acc["t"] - F.when(off, line["taxed"]).otherwise(F.lit(0))).cast(AMOUNT).alias("t"),
            F.transform(acc["groups"], changed).alias("groups"),
            F.concat(acc["applied"], F.array(r["id"])).alias("applied"),
            (acc["coupon"] | (r["rule_type"] == "coupon")).alias("coupon"),
            F.when(off, F.concat(acc["lines"], F.array(F.struct(r["id"].alias("rule_id"), (-line["price"]).cast(MONEY).alias("price")))))
            .otherwise(acc["lines"])
            .alias("lines"),
        ).cast(_STATE)
        return F.when(holds, after).otherwise(acc)

    start = F.struct(
        F.coalesce("base_untaxed", F.lit(0)).cast(AMOUNT).alias("u"),
        F.coalesce("base_taxed", F.lit(0)).cast(AMOUNT).alias("t"),
        F.transform(F.coalesce("discounts", F.array()), lambda d: F.struct(d.alias("start"), d.alias("now"), F.array().cast("array<bigint>").alias("taken"))).alias("groups"),
        F.array().cast("array<bigint>").alias("applied"),
        F.lit(False).alias("coupon"),
        F.array().alias("lines"),
    ).cast(_STATE)
    state = F.aggregate(F.filter("_rules", unused), start, fold)
    return heads.select("order_id", state.alias("_s")).select("order_id", "_s.applied", "_s.groups", "_s.lines")


def promoted_lines(lines: DataFrame, applied: DataFrame) -> DataFrame:
    """Every line with its discount after the order's rules and the rules it took, by (order, discount it started with)."""
    fates = applied.select("order_id", F.explode("groups").alias("_g")).select("order_id", F.col("_g.start").alias("_start"), "_g.now", "_g.taken")
    keyed = lines.withColumn("_start", F.when(~F.col("is_promotion_line"), F.col("discount").cast(PERCENT)))
    return keyed.join(fates, ["order_id", "_start"], "left").select(
        *lines.columns,
        F.coalesce("now", F.col("discount").cast(PERCENT)).alias("promo_discount"),
        F.coalesce("taken", F.array().cast("array<bigint>")).alias("taken_rules"),
    )


def discount_lines(applied: DataFrame) -> DataFrame:
    """One negative line per order and fixed-amount rule that at least one line took."""
    return applied.select("order_id", F.explode("lines").alias("_l")).select(
        "order_id", "_l.rule_id", F.col("_l.price").alias("price_unit"), F.lit(1).alias("qty")
    )
