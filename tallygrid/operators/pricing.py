"""Line projections: taxes, units, areas, packages, dates, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrid.functions.labels import filled
from tallygrid.functions.money import CENT, MONEY, QTY, col, convert_uom, money, quantity, ratio, total, zero_if_null
from tallygrid.plans.skew import pick_first

WIDE = "decimal(24,6)"


def gross_amount(price: Column | str, qty: Column | str, discount: Column | str | None = None) -> Column:
    """price × quantity less a percent discount, unrounded."""
    amount = (col(price).cast("decimal(14,2)") * col(qty).cast("decimal(12,4)")).cast(WIDE)
    if discount is None:
        return amount
    return amount * (F.lit(100).cast("decimal(9,2)") - col(discount)) * F.lit(CENT)


# -- taxes --------------------------------------------------------------------------------
# ``taxes`` is array<struct<id, kind ('percent' | 'fixed'), rate, included, tax_group>> on each line.


#: So many taxes of a line are read by position, in generated code; longer lists are folded.
DIRECT_TAXES = 4


def _over(taxes: Column, value, kind: str, fold) -> Column:
    """Sum of ``value(tax)`` over a list of taxes as ``kind``."""
    none = F.lit(0).cast(kind)
    direct = none
    for i in range(DIRECT_TAXES):
        t = F.get(taxes, F.lit(i))
        direct = (direct + F.when(t.isNotNull(), value(t)).otherwise(none)).cast(kind)
    return F.when(F.size(taxes) <= DIRECT_TAXES, direct).otherwise(fold)


def _summed(taxes: Column, kind: str, included: bool) -> Column:
    def rate(t):
        return F.when((t["kind"] == kind) & (t["included"] == included), t["rate"]).otherwise(F.lit(0).cast("decimal(9,2)"))

    fold = F.aggregate(taxes, F.lit(0).cast("decimal(9,2)"), lambda acc, t: (acc + rate(t)).cast("decimal(9,2)"))
    return _over(taxes, rate, "decimal(9,2)", fold)


def untaxed_base(gross: Column, qty: Column, taxes: Column) -> Column:
    """Amount without the taxes that the price already includes; one rounding."""
    fixed = _summed(taxes, "fixed", True) * col(qty).cast("decimal(12,4)")
    percent = F.lit(100).cast("decimal(9,2)") + _summed(taxes, "percent", True)
    some = F.exists(taxes, lambda t: t["included"])
    return F.when(some, money((gross - fixed).cast("decimal(22,6)") * 100 / percent)).otherwise(money(gross))


def tax_amounts(base: Column, qty: Column, taxes: Column) -> Column:
    """(tax id, group, amount) of every tax on an untaxed base."""

    def one(t):
        return F.struct(t["id"].alias("id"), t["tax_group"].alias("tax_group"), _tax_amount(base, qty, t).alias("amount"))

    return F.transform(taxes, one)


def _tax_amount(base: Column, qty: Column, tax: Column) -> Column:
    return F.when(tax["kind"] == "percent", money(base * tax["rate"] * F.lit(CENT))).otherwise(
        money(tax["rate"] * col(qty).cast("decimal(12,4)"))
    )


def tax_total(base: Column, qty: Column, taxes: Column) -> Column:
    """Sum of all taxes on an untaxed base, each rounded by itself."""
    return _over(taxes, lambda t: _tax_amount(base, qty, t), MONEY, tax_sum(tax_amounts(base, qty, taxes)))


def tax_sum(amounts: Column) -> Column:
    return F.aggregate(amounts, F.lit(0).cast(MONEY), lambda acc, t: (acc + t["amount"]).cast(MONEY))


def tax_compute(lines: DataFrame, price: str = "price_unit", qty: str = "qty", discount: str | None = "discount") -> DataFrame:
    """Subtotal, tax and total of a line from its price and included / excluded taxes."""
    gross = gross_amount(price, qty, discount)
    based = lines.withColumn("subtotal", untaxed_base(gross, F.col(qty), F.col("taxes")))
    taxed = based.withColumn("tax", tax_total(F.col("subtotal"), F.col(qty), F.col("taxes")))
    return taxed.withColumn("total", (F.col("subtotal") + F.col("tax")).cast(MONEY))


def discount_display(lines: DataFrame) -> DataFrame:
    """Amounts as they would be without the discount, and what the discount is worth; 0 where there is none."""
    full = tax_compute(lines, discount=None).select(
        *lines.columns, F.col("subtotal").alias("_full_subtotal"), F.col("total").alias("_full_total")
    )
    cut = tax_compute(full)
    none = zero_if_null("discount") == 0
    zero = F.lit(0).cast(MONEY)
    return cut.select(
        *lines.columns,
        F.when(none, F.col("subtotal")).otherwise(F.col("_full_subtotal")).alias("price_subtotal_no_discount"),
        F.when(none, F.col("total")).otherwise(F.col("_full_total")).alias("price_total_no_discount"),
        F.when(none, zero).otherwise(F.col("_full_total") - F.col("total")).cast(MONEY).alias("discount_total"),
        F.when(none, zero).otherwise(F.col("_full_subtotal") - F.col("subtotal")).cast(MONEY).alias("discount_subtotal"),
    )


DISPLAY_MEASURES = ("price_subtotal_no_discount", "price_total_no_discount", "discount_total", "discount_subtotal")


def discount_display_totals(displayed: DataFrame) -> DataFrame:
    return displayed.groupBy("order_id").agg(*[total(m).alias(m) for m in DISPLAY_MEASURES])


def shipping_split(lines: DataFrame) -> DataFrame:
    """Delivery and item amounts of each order."""
    parts = []
    for name in ("price_subtotal", "price_tax", "price_total"):
        short = name.removeprefix("price_")
        ship = F.when(F.col("is_delivery"), F.col(name)).otherwise(F.lit(0))
        item = F.when(F.col("is_delivery"), F.lit(0)).otherwise(F.col(name))
        parts += [F.sum(ship).alias(f"shipping_{short}"), F.sum(item).alias(f"item_{short}")]
    return lines.groupBy("order_id").agg(*parts)


# -- areas --------------------------------------------------------------------------------


def _rated(products: DataFrame, rates: DataFrame) -> DataFrame:
    """Products of positive size with every rate of their category or of one above it, and with the rates for all.

    The subtree test is an equi join on path ids. Rates without a category are listed as one constant, since each product
    meets all of them; as a join key they would put all products into one task.
    """
    sized = products.filter((F.col("width") > 0) & (F.col("height") > 0))
    names = [c for c in rates.columns if c != "categ_id"]
    general = rates.filter(F.col("categ_id").isNull()).agg(F.collect_list(F.struct(*names))).scalar()
    by_branch = sized.withColumn("_branch", F.explode(F.array_distinct(path_ids("parent_path"))))
    special = by_branch.join(rates.withColumnRenamed("categ_id", "_branch"), "_branch").drop("_branch")
    return special.unionByName(sized.withColumn("_rate", F.explode(general)).select(*products.columns, "_rate.*"))


def area_price(products: DataFrame, rates: DataFrame) -> DataFrame:
    """Price before and after applying a rate per area unit to all products below the rate's category.

    ``rates`` is (rate_id, categ_id, rate); a NULL category means all. Products need (id, parent_path,
    width, height, list_price, standard_price).
    """
    area = (F.col("width") * F.col("height")).cast("decimal(18,4)")
    after = money(area * F.col("rate"))
    return _rated(products, rates).select(
        "rate_id",
        F.col("id").alias("product_id"),
        area.alias("area"),
        F.col("list_price").alias("price_before"),
        F.col("standard_price").alias("cost_before"),
        after.alias("price_after"),
        (after - F.col("list_price")).cast(MONEY).alias("difference"),
    )


def rate_apply(products: DataFrame, rates: DataFrame) -> DataFrame:
    """What applying the rates one after another does: (rate_id, position, product_id, price_before, cost_before, cost_after).

    Only products with ``use_area_pricing`` and a size take a rate; it sets their cost to area × rate and leaves the list
    price. ``rates`` is (rate_id, categ_id, rate, date), applied by (date, rate_id); a later rate finds the cost that the
    earlier one left. The window holds the rates of one product.
    """
    cost = money((F.col("width") * F.col("height")).cast("decimal(18,4)") * F.col("rate"))
    taken = _rated(products.filter(F.col("use_area_pricing")), rates).withColumn("cost_after", cost)
    along = W.partitionBy("id").orderBy("date", "rate_id")
    return taken.select(
        "rate_id",
        F.row_number().over(along).alias("position"),
        F.col("id").alias("product_id"),
        F.col("list_price").alias("price_before"),
        F.coalesce(F.lag("cost_after").over(along), F.col("standard_price")).cast(MONEY).alias("cost_before"),
        "cost_after",
    )


def products_after(products: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The product table after :func:`rate_apply`: the cost of the last rate, all other products as they were."""
    last = snapshot.groupBy(F.col("product_id").alias("id")).agg(F.max_by("cost_after", "position").alias("_cost"))
    return products.join(last, "id", "left").withColumn("standard_price", F.coalesce("_cost", "standard_price")).drop("_cost")


def path_ids(path: Column | str) -> Column:
    """Ids along a materialised path such as '1/12/140/'."""
    return F.transform(F.filter(F.split(col(path), "/"), lambda x: x != ""), lambda x: x.cast("bigint"))


# -- units and packages -------------------------------------------------------------------


def uom_convert(lines: DataFrame, uoms: DataFrame, target: str, out: str = "converted") -> DataFrame:
    """Quantity of each line in the unit named by column ``target``."""
    source = uoms.select(F.col("id").alias("uom_id"), F.col("factor").alias("_from"))
    wanted = uoms.select(F.col("id").alias(target), F.col("factor").alias("_to"))
    joined = lines.join(source, "uom_id").join(wanted, target)
    return joined.withColumn(out, convert_uom(F.col("qty"), F.col("_from"), F.col("_to"))).drop("_from", "_to")


def secondary_unit_price(lines: DataFrame) -> DataFrame:
    """Price per secondary unit; 0 without a secondary unit or quantity."""
    per_unit = ratio("price_subtotal", F.when(F.col("secondary_uom_id").isNotNull(), F.col("secondary_qty")), digits=8)
    return lines.withColumn("secondary_price", per_unit)


def template_unique_value(products: DataFrame, value: str, strict: bool = False) -> DataFrame:
    """A template shows its variants' value when all agree; ``strict`` also asks for a single variant."""
    same = F.min(value).eqNullSafe(F.max(value)) & (F.count(value) == F.count("*"))
    if strict:
        same = same & (F.count("*") == 1)
    return products.groupBy("template_id").agg(F.when(same, F.min(value)).alias(value))


def packaging_default(lines: DataFrame, packagings: DataFrame) -> DataFrame:
    """First sales package per product; dropped when the quantity is no whole number of packages."""
    first = pick_first(packagings.filter("sales"), ["product_id"], [F.col("sequence"), F.col("id")], ["id", "qty"])
    packs = first.select("product_id", F.col("id").alias("packaging_id"), F.col("qty").alias("pack_qty"))
    joined = lines.join(packs, "product_id", "left")
    fits = F.col("packaging_id").isNotNull() & (F.pmod(F.col("qty"), F.col("pack_qty")) == 0)
    return joined.withColumn("packaging_qty", F.when(fits, quantity(F.col("qty") / F.col("pack_qty")))).withColumn(
        "packaging_id", F.when(fits, F.col("packaging_id"))
    )


# -- dates --------------------------------------------------------------------------------


def line_days(lines: DataFrame) -> DataFrame:
    """Start, end and number of days of a line, each filled from the others.

    Lines need (must_have_dates, start_date, end_date, days, default_start, default_end).
    """
    needs = F.col("must_have_dates")
    span = F.greatest(F.col("days"), F.lit(1)).cast("int") - 1
    start = F.when(needs, F.coalesce("start_date", F.date_sub("end_date", span), "default_start"))
    end = F.when(needs, F.coalesce("end_date", F.date_add("start_date", span), "default_end"))
    dated = lines.withColumn("line_start", start).withColumn("line_end", end)
    dated = dated.withColumn("line_start", F.when(F.col("line_start") > F.col("line_end"), F.col("line_end")).otherwise(F.col("line_start")))
    return dated.withColumn("number_of_days", F.date_diff("line_end", "line_start") + 1)


def commitment_shift(lines: DataFrame, security_lead: int) -> DataFrame:
    """Planned date a lead time before the commitment; deadline of the line, else of its order."""
    return lines.withColumn("date_planned", F.date_sub("commitment_date", security_lead)).withColumn(
        "date_deadline", F.coalesce("commitment_date", "order_commitment_date")
    )


# -- elaborations, expansion --------------------------------------------------------------


def elaboration_price(lines: DataFrame, line_elaborations: DataFrame, elaborations: DataFrame, prices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of list prices of a line's elaborations, its first route, and its profile.

    ``lines`` need (pricelist_id, product_profile_id, category_profile_id); ``prices`` is
    (pricelist_id, product_id, price).
    """
    chosen = line_elaborations.join(
        elaborations.select(F.col("id").alias("elaboration_id"), F.col("product_id").alias("_elab_product"), "route_id"),
        "elaboration_id",
    )
    heads = lines.select(*keys, "pricelist_id")
    price = prices.select("pricelist_id", F.col("product_id").alias("_elab_product"), "price")
    summed = (
        chosen.join(heads, list(keys))
        .join(price, ["pricelist_id", "_elab_product"], "left")
        .groupBy(*keys)
        .agg(total("price").alias("elaboration_price_unit"), F.min_by("route_id", "elaboration_id").alias("route_id"))
    )
    return lines.join(summed, list(keys), "left").withColumn(
        "elaboration_price_unit", F.coalesce("elaboration_price_unit", F.lit(0).cast(MONEY)).cast(MONEY)
    ).withColumn("elaboration_profile_id", F.coalesce("product_profile_id", "category_profile_id"))


def multi_line_expand(wanted: DataFrame, products: DataFrame) -> DataFrame:
    """(order, product, qty) wishes as order lines at list price."""
    goods = products.select(F.col("id").alias("product_id"), F.col("list_price").alias("price_unit"), F.col("uom_id").alias("product_uom"), F.col("name").alias("product_name"))
    return wanted.join(goods, "product_id").withColumn("price_subtotal", money(gross_amount("price_unit", "qty")))


# -- labels -------------------------------------------------------------------------------


def line_label(lines: DataFrame) -> DataFrame:
    """Line text from customer code, description override, stock and elaboration.

    Lines need (product_name, customer_code, sale_description, free_qty, show_stock, is_elaboration, order_name).
    """
    base = F.coalesce(filled("sale_description"), F.col("product_name"))
    coded = F.when(filled("customer_code").isNotNull(), F.concat(F.lit("["), F.col("customer_code"), F.lit("] "), base)).otherwise(base)
    stocked = F.when(
        F.col("show_stock"), F.concat(coded, F.lit(" ("), F.format_string("%.2f", F.col("free_qty").cast("double")), F.lit(")"))
    ).otherwise(coded)
    invoiced = F.when(F.col("is_elaboration"), F.concat(F.col("order_name"), F.lit(" - "), coded)).otherwise(coded)
    return lines.withColumn("line_name", stocked).withColumn("invoice_name", invoiced)


def warning_message(orders: DataFrame, partners: DataFrame) -> DataFrame:
    """Warnings of the commercial entity and of the contact on open quotations."""
    contact = partners.select(F.col("id").alias("partner_id"), "commercial_partner_id", filled("sale_warn").alias("_own"))
    entity = partners.select(F.col("id").alias("commercial_partner_id"), filled("sale_warn").alias("_entity"))
    joined = orders.join(contact, "partner_id", "left").join(entity, "commercial_partner_id", "left")
    own = F.when(F.col("commercial_partner_id") != F.col("partner_id"), F.col("_own"))
    text = F.nullif(F.concat_ws("\n", F.col("_entity"), own), F.lit(""))
    open_ = F.col("state").isin("draft", "sent")
    return joined.withColumn("warning", F.when(open_, text)).drop("_own", "_entity")


def partner_balance(orders: DataFrame, entries: DataFrame) -> DataFrame:
    """Receivable balance (credit − debit) of the order's customer; 0 without one."""
    sums = entries.groupBy("partner_id").agg(F.sum("credit").alias("credit"), F.sum("debit").alias("debit"))
    return orders.join(sums, "partner_id", "left").withColumn(
        "customer_balance", (zero_if_null("credit") - zero_if_null("debit")).cast(MONEY)
    )


