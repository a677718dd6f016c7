"""Price, tax, unit and discount queries."""

from __future__ import annotations

import uuid
from datetime import date
from decimal import Decimal as D

from pyspark.sql import functions as F

from tallygrid.functions.money import MONEY, PERCENT, QTY
from tallygrid.operators import discounts as g
from tallygrid.operators import pricing as p
from tallygrid.session import shared_dir
from tallygrid.sources.rules import rows
from tallygrid.sources.star import Star
from tallygrid.sources.versions import publish_version
from workload.registry import query

# Units typed in by people: how many of the unit make one reference unit.
UOMS = [(1, "Unit", D("1")), (2, "Pack of four", D("0.25")), (3, "Half", D("2"))]
SQL_UOM = ", uom AS (SELECT CAST(id AS BIGINT) AS id, CAST(f AS DECIMAL(9,4)) AS factor FROM (VALUES (1,1),(2,0.25),(3,2)) v(id,f))"


def uoms(s: Star):
    return rows(s.spark, "id bigint, name string, factor decimal(9,4)", UOMS)


def tax(id_, kind, rate, included, group):
    return F.struct(
        F.lit(id_).cast("bigint").alias("id"),
        F.lit(kind).alias("kind"),
        (rate if not isinstance(rate, D) else F.lit(rate)).cast(PERCENT).alias("rate"),
        (included if not isinstance(included, bool) else F.lit(included)).alias("included"),
        F.lit(group).cast("bigint").alias("tax_group"),
    )


def taxed_lines(s: Star, keyed=False):
    """Lines with a percent tax (included on every fourth order) and, for some products, a fixed eco tax."""
    lines = s.keyed_lines() if keyed else s.lines()
    vat = tax(1, "percent", F.col("tax_rate"), F.col("order_id") % 4 == 0, 1)
    eco = tax(2, "fixed", D("0.50"), False, 2)
    return lines.withColumn("taxes", F.when(F.col("product_id") % 10 == 3, F.array(vat, eco)).otherwise(F.array(vat)))


# An untaxed base in whole cents, rounded half up by integer division.
def base_sql(gross: str) -> str:
    return f"CAST(CASE WHEN order_id % 4 = 0 THEN (2 * CAST({gross} * 10000 AS HUGEINT) + CAST(100 + tax_rate AS HUGEINT)) // (2 * CAST(100 + tax_rate AS HUGEINT)) * 0.01 ELSE {gross} END AS DECIMAL(18,2))"


def taxes_sql(base: str) -> str:
    return f"CAST(round({base} * tax_rate * 0.01, 2) + CASE WHEN product_id % 10 = 3 THEN qty * 0.5 ELSE 0 END AS DECIMAL(18,2))"


GROSS = "round(CAST(price_unit * qty AS DECIMAL(24,6)) * (100 - discount) * 0.01, 4)"
FULL = "round(CAST(price_unit * qty AS DECIMAL(24,6)), 4)"
# Gross has up to four decimals: keep them through the division.


def base4_sql(gross: str) -> str:
    return f"CAST(CASE WHEN order_id % 4 = 0 THEN CAST((2 * CAST({gross} * 1000000 AS HUGEINT) + 100 * CAST(100 + tax_rate AS HUGEINT)) // (200 * CAST(100 + tax_rate AS HUGEINT)) AS DECIMAL(18,0)) * 0.01 ELSE round({gross}, 2) END AS DECIMAL(18,2))"


SQL_TAXED = f""", b AS (SELECT *, {base4_sql(GROSS)} AS sub, {base4_sql(FULL)} AS full_sub FROM sale_order_line),
taxed AS (SELECT *, {taxes_sql('sub')} AS tax, {taxes_sql('full_sub')} AS full_tax FROM b)
"""


@query("tax_compute", SQL_TAXED + "SELECT order_id, sequence, product_id, sub::DOUBLE AS subtotal, tax::DOUBLE AS tax, (sub + tax)::DOUBLE AS total FROM taxed")
def _(s):
    return p.tax_compute(taxed_lines(s)).select("order_id", "sequence", "product_id", "subtotal", "tax", "total")


DISPLAY = """SELECT order_id, sequence, product_id, CASE WHEN discount = 0 THEN sub ELSE full_sub END AS a, CASE WHEN discount = 0 THEN sub + tax ELSE full_sub + full_tax END AS b,
 CASE WHEN discount = 0 THEN 0 ELSE full_sub + full_tax - sub - tax END AS c, CASE WHEN discount = 0 THEN 0 ELSE full_sub - sub END AS d FROM taxed"""


@query("discount_display", SQL_TAXED + f"SELECT order_id, sequence, product_id, a::DOUBLE AS price_subtotal_no_discount, b::DOUBLE AS price_total_no_discount, c::DOUBLE AS discount_total, d::DOUBLE AS discount_subtotal FROM ({DISPLAY})")
def _(s):
    return p.discount_display(taxed_lines(s)).select("order_id", "sequence", "product_id", *p.DISPLAY_MEASURES)


@query("discount_display_totals", SQL_TAXED + f"SELECT order_id, sum(a)::DOUBLE AS price_subtotal_no_discount, sum(b)::DOUBLE AS price_total_no_discount, sum(c)::DOUBLE AS discount_total, sum(d)::DOUBLE AS discount_subtotal FROM ({DISPLAY}) GROUP BY order_id")
def _(s):
    return p.discount_display_totals(p.discount_display(taxed_lines(s)))


def fixed_lines(s: Star):
    return s.lines().withColumn("discount_fixed", F.when(F.col("product_id") % 4 == 0, F.col("sequence") * 3).otherwise(F.lit(0)).cast(MONEY))


FIXED = "CASE WHEN product_id % 4 = 0 THEN CAST(sequence * 3 AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END"


@query("fixed_discount", f"SELECT order_id, sequence, product_id, round(CASE WHEN f <> 0 THEN f::DOUBLE * 100 / price_unit::DOUBLE ELSE discount::DOUBLE END, 2) AS discount_percent, CASE WHEN f <> 0 THEN round((price_unit - f) * qty, 2) ELSE round(CAST(price_unit * qty AS DECIMAL(24,6)) * (100 - discount) * 0.01, 2) END::DOUBLE AS subtotal FROM (SELECT *, {FIXED} AS f FROM sale_order_line)")
def _(s):
    return g.fixed_discount(fixed_lines(s)).select("order_id", "sequence", "product_id", "discount_percent", "subtotal")


@query("fixed_discount_mismatch", f"SELECT order_id, sequence, product_id, discount::DOUBLE AS discount, round(f * 100.0::DOUBLE / price_unit::DOUBLE, 2) AS calculated FROM (SELECT *, {FIXED} AS f FROM sale_order_line) WHERE f <> 0 AND discount <> 0 AND round(f * 100.0::DOUBLE / price_unit::DOUBLE, 2) <> discount::DOUBLE")
def _(s):
    return g.fixed_discount_mismatch(fixed_lines(s)).select("order_id", "sequence", "product_id", "discount", "calculated")


def discounted_lines(s: Star):
    """Taxed lines of orders with up to two stacked discounts."""
    a, b = F.lit(20).cast(PERCENT), (F.col("order_id") % 9).cast(PERCENT)
    pick = F.when(F.col("order_id") % 3 == 0, F.array(a, b)).when(F.col("order_id") % 3 == 1, F.array(b))
    goods = s.products().select(F.col("id").alias("product_id"), "bypass_discount")
    return taxed_lines(s).withColumn("discounts", pick).join(goods, "product_id")


SQL_STACK = """
, d AS (SELECT l.*, CAST(round(price_subtotal * CAST(CASE WHEN p.bypass_discount THEN 1 WHEN order_id % 3 = 0 THEN 0.8 * (100 - order_id % 9) * 0.01 WHEN order_id % 3 = 1 THEN (100 - order_id % 9) * 0.01 ELSE 1 END AS DECIMAL(9,6)), 2) AS DECIMAL(18,2)) AS net FROM sale_order_line l JOIN product p ON p.id = l.product_id),
dt AS (SELECT *, CAST(round(net * tax_rate * 0.01, 2) AS DECIMAL(18,2)) AS vat, CASE WHEN product_id % 10 = 3 THEN CAST(qty * 0.5 AS DECIMAL(18,2)) END AS eco FROM d)
"""


@query("stacked_global_discount", SQL_STACK + "SELECT order_id, sum(price_subtotal)::DOUBLE AS untaxed_before, sum(price_total)::DOUBLE AS total_before, sum(net)::DOUBLE AS amount_untaxed, sum(vat + coalesce(eco, 0))::DOUBLE AS amount_tax, (sum(price_subtotal) - sum(net))::DOUBLE AS amount_global_discount, (sum(net) + sum(vat + coalesce(eco, 0)))::DOUBLE AS amount_total FROM dt GROUP BY order_id")
def _(s):
    return g.stacked_global_discount(discounted_lines(s))


@query("global_discount_tax_groups", SQL_STACK + "SELECT order_id, CAST(1 AS BIGINT) AS tax_group, sum(vat)::DOUBLE AS tax_amount FROM dt GROUP BY order_id UNION ALL SELECT order_id, 2, sum(eco)::DOUBLE FROM dt WHERE eco IS NOT NULL GROUP BY order_id")
def _(s):
    return g.global_discount_tax_groups(discounted_lines(s))


@query(
    "global_discount_sanity",
    """, x AS (SELECT DISTINCT order_id, CASE WHEN product_id % 50 = 7 THEN [] WHEN product_id % 10 = 3 THEN [1, 2] ELSE [1] END AS ts FROM sale_order_line WHERE display_type IS NULL AND order_id % 3 <> 2)
SELECT DISTINCT order_id, 'line without tax' AS reason FROM x WHERE len(ts) = 0 UNION ALL SELECT DISTINCT a.order_id, 'incompatible taxes' FROM x a JOIN x b ON a.order_id = b.order_id AND a.ts <> b.ts AND list_has_any(a.ts, b.ts)""",
)
def _(s):
    lines = discounted_lines(s)
    bare = F.slice("taxes", 1, 0)
    return g.global_discount_sanity(lines.withColumn("taxes", F.when(F.col("product_id") % 50 == 7, bare).otherwise(F.col("taxes"))))


@query(
    "global_discount_pick",
    """, pd AS (SELECT id AS partner_id, CAST(c AS BIGINT) AS company_id, CASE WHEN id % 2 = 0 THEN '5.00,10.00' ELSE '5.00' END AS ds FROM partner, (VALUES (1),(2)) v(c) WHERE id % 5 = 0 OR id % 7 = 0)
SELECT o.id, coalesce(a.ds, b.ds, '') AS discounts FROM sale_order o JOIN partner p ON p.id = o.partner_id LEFT JOIN pd a ON a.partner_id = o.partner_id AND a.company_id = o.company_id LEFT JOIN pd b ON b.partner_id = p.commercial_partner_id AND b.company_id = o.company_id""",
)
def _(s):
    d = lambda n: F.struct(F.lit(n).alias("sequence"), F.lit(n * 5).cast(PERCENT).alias("discount"))
    given = s.partners().filter("id % 5 = 0 OR id % 7 = 0").select(
        F.col("id").alias("partner_id"),
        F.explode(F.array(F.lit(1), F.lit(2)).cast("array<bigint>")).alias("company_id"),
        F.when(F.col("id") % 2 == 0, F.array(d(1), d(2))).otherwise(F.array(d(1))).alias("ds"),
    ).select("partner_id", "company_id", F.inline("ds"))
    return g.global_discount_pick(s.orders(), s.partners(), given).select("id", "discounts")


@query("general_discount", "SELECT l.order_id, l.sequence, l.product_id, CASE WHEN g.bypass_discount THEN 0 ELSE p.discount END::DOUBLE AS general_discount FROM sale_order_line l JOIN sale_order o ON o.id = l.order_id JOIN partner p ON p.id = o.partner_id JOIN product g ON g.id = l.product_id")
def _(s):
    return g.general_discount(s.lines(), s.orders(), s.partners(), s.products()).select("order_id", "sequence", "product_id", "general_discount")


def spread_lines(s: Star, application="after_tax"):
    heads = s.orders().select(F.col("id").alias("order_id"), F.col("discount_rate").alias("add_discount"), F.col("discount_type").alias("add_discount_type"))
    return g.total_discount_prorata(s.lines().join(heads, "order_id"), application)


def spread_sql(divisor: str) -> str:
    return f"""
, b AS (SELECT l.*, CAST(round(price_unit * qty, 2) AS DECIMAL(18,2)) AS base, o.discount_rate::DOUBLE AS ad, o.discount_type AS kind FROM sale_order_line l JOIN sale_order o ON o.id = l.order_id),
c AS (SELECT *, CASE WHEN kind = 'fixed' THEN ad / {divisor} * (base::DOUBLE / sum(base) OVER (PARTITION BY order_id)::DOUBLE) ELSE ad END AS d2 FROM b),
sp AS (SELECT *, base::DOUBLE * discount::DOUBLE / 100.0 + CASE WHEN kind = 'fixed' THEN d2 ELSE base::DOUBLE * d2 / 100.0 END AS da FROM c)
"""


for _app, _div, _suffix in (("after_tax", "1.15", ""), ("before_tax", "1.0", "_before_tax")):

    @query(f"total_discount_prorata{_suffix}", spread_sql(_div) + "SELECT order_id, sequence, product_id, round(d2, 4) AS discount2, round(da * 100.0 / base::DOUBLE, 4) AS discount_percent, round(base::DOUBLE - da, 4) AS net_subtotal FROM sp")
    def _(s, app=_app):
        return spread_lines(s, app).select(
            "order_id", "sequence", "product_id",
            *[F.round(c, 4).alias(c) for c in ("discount2", "discount_percent", "net_subtotal")],
        )


@query("total_discount_totals", spread_sql("1.15") + """, t AS (SELECT order_id, round(sum(CAST(da AS DECIMAL(24,10))), 4) AS total_discount, round(sum(CAST(base::DOUBLE - da AS DECIMAL(24,10))), 4) AS untaxed FROM sp GROUP BY order_id)
SELECT order_id, total_discount::DOUBLE AS total_discount, due::DOUBLE AS amount_after_discount, due::DOUBLE AS amount_due, (untaxed + amount_tax)::DOUBLE AS total_before_discount
FROM (SELECT t.*, o.amount_tax, CASE WHEN discount_type = 'fixed' THEN amount_total - discount_rate ELSE amount_total - round(amount_total * discount_rate * 0.01, 2) END AS due FROM t JOIN sale_order o ON o.id = t.order_id)""")
def _(s):
    heads = s.orders().withColumnRenamed("discount_rate", "add_discount").withColumnRenamed("discount_type", "add_discount_type")
    return g.total_discount_totals(spread_lines(s), heads)


@query("order_discount", """, t AS (SELECT o.id AS order_id, discount_type, discount_rate, coalesce(sum(price_subtotal), 0) AS u, coalesce(sum(price_tax), 0) AS x FROM sale_order o LEFT JOIN sale_order_line l ON l.order_id = o.id GROUP BY ALL),
e AS (SELECT *, CASE WHEN discount_type = 'percent' THEN round(u * discount_rate * 0.01, 2) ELSE discount_rate END AS da FROM t)
SELECT order_id, u::DOUBLE AS amount_untaxed, x::DOUBLE AS amount_tax, da::DOUBLE AS discount_amount, (u + x - da)::DOUBLE AS amount_total,
 CASE WHEN u = 0 AND discount_rate <> 0 THEN 'no product' WHEN discount_type = 'percent' AND discount_rate > 100 THEN 'over 100 percent' WHEN discount_type = 'fixed' AND discount_rate > u THEN 'over untaxed amount' END AS invalid FROM e""")
def _(s):
    return g.order_discount(s.lines(), s.orders())


@query("invoice_amounts_with_discount", """, i AS (SELECT *, CASE WHEN id % 2 = 0 THEN CAST(25 AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END AS da, CASE WHEN move_type = 'out_refund' THEN 1 ELSE -1 END AS sg FROM invoice),
s AS (SELECT l.order_id, sum(price_subtotal) AS u, sum(price_tax) AS t, bool_or(l.sequence = 3 AND l.order_id % 6 = 0) AND NOT bool_and(l.sequence = 3 AND l.order_id % 6 = 0) AS multi FROM invoice_line l GROUP BY 1),
r AS (SELECT i.id, move_type, state, sg * sg * coalesce(s.u, 0) * CASE WHEN multi THEN 1 ELSE 2 END AS au, sg * sg * coalesce(s.t, 0) * CASE WHEN multi THEN 1 ELSE 2 END AS atx, sg * da AS sda, -sg * (-sg * amount_residual - da) AS ar FROM i LEFT JOIN s ON s.order_id = i.id)
SELECT id, move_type, state, au::DOUBLE AS amount_untaxed, atx::DOUBLE AS amount_tax, (au + atx + sda)::DOUBLE AS amount_total, ar::DOUBLE AS amount_residual,
 CASE WHEN state <> 'posted' THEN 'not_paid' WHEN ar = 0 THEN CASE WHEN id % 7 = 0 THEN 'reversed' WHEN id % 3 = 0 THEN 'paid' ELSE 'in_payment' END WHEN au + atx + sda <> abs(ar) THEN 'partial' ELSE 'not_paid' END AS payment_state FROM r""")
def _(s):
    sign = F.when(F.col("move_type") == "out_refund", F.lit(1)).otherwise(F.lit(-1))
    inv = s.invoices().select(
        "id", "move_type", "state", "amount_residual",
        F.when(F.col("id") % 2 == 0, F.lit(25)).otherwise(F.lit(0)).cast(MONEY).alias("discount_amount"),
        (F.col("id") % 3 == 0).alias("matched"),
        (F.col("id") % 7 == 0).alias("fully_reversed"),
    )
    # Amounts in the document currency are twice those in company currency; some documents mix two currencies.
    cur = F.when((F.col("sequence") == 3) & (F.col("order_id") % 6 == 0), F.lit(2)).otherwise(F.lit(1)).alias("currency_id")
    zero = F.lit(0).cast(MONEY)
    lines = s.invoice_lines()
    kinds = F.array(
        F.struct(F.lit("product").alias("kind"), (sign * F.col("price_subtotal")).cast(MONEY).alias("balance")),
        F.struct(F.lit("tax").alias("kind"), (sign * F.col("price_tax")).cast(MONEY).alias("balance")),
    )
    items = lines.select("move_id", cur, F.inline(kinds)).select(
        "move_id", "currency_id", "kind", "balance", (F.col("balance") * 2).cast(MONEY).alias("amount_currency"),
        zero.alias("residual"), zero.alias("residual_currency"),
    )
    due = (-sign * F.col("amount_residual")).cast(MONEY)
    terms = inv.select(
        F.col("id").alias("move_id"), F.lit(None).cast("int").alias("currency_id"), F.lit("payment_term").alias("kind"), zero.alias("balance"),
        zero.alias("amount_currency"), due.alias("residual"), due.alias("residual_currency"),
    )
    return g.invoice_amounts_with_discount(items.unionByName(terms), inv)


@query("shipping_split", """SELECT order_id, coalesce(sum(price_subtotal) FILTER (is_delivery), 0)::DOUBLE AS shipping_subtotal, coalesce(sum(price_subtotal) FILTER (NOT is_delivery), 0)::DOUBLE AS item_subtotal,
 coalesce(sum(price_tax) FILTER (is_delivery), 0)::DOUBLE AS shipping_tax, coalesce(sum(price_tax) FILTER (NOT is_delivery), 0)::DOUBLE AS item_tax, coalesce(sum(price_total) FILTER (is_delivery), 0)::DOUBLE AS shipping_total, coalesce(sum(price_total) FILTER (NOT is_delivery), 0)::DOUBLE AS item_total FROM sale_order_line GROUP BY order_id""")
def _(s):
    return p.shipping_split(s.lines())


def sized_products(s: Star):
    return s.products().withColumn("width", (F.col("id") % 30).cast("decimal(9,2)")).withColumn("height", (F.col("id") % 20).cast("decimal(9,2)"))


RATES = [(1, 11, D("3.50")), (2, 12, D("4.25")), (3, 110, D("7.10"))]
SQL_AREA = ", rate AS (SELECT * FROM (VALUES (1,'/11/',CAST(3.5 AS DECIMAL(9,2))),(2,'/12/',CAST(4.25 AS DECIMAL(9,2))),(3,'/110/',CAST(7.1 AS DECIMAL(9,2)))) v(rate_id,node,rate)), area AS (SELECT CAST(rate_id AS BIGINT) AS rate_id, id AS product_id, (id % 30) * (id % 20) AS area, list_price, standard_price, CAST((id % 30) * (id % 20) * rate AS DECIMAL(18,2)) AS pa FROM product, rate WHERE contains('/' || parent_path, node) AND id % 30 > 0 AND id % 20 > 0)"


def area_rates(s: Star):
    return rows(s.spark, "rate_id bigint, categ_id bigint, rate decimal(9,2)", RATES)


@query("area_price", SQL_AREA + "SELECT rate_id, product_id, area::DOUBLE AS area, list_price::DOUBLE AS price_before, standard_price::DOUBLE AS cost_before, pa::DOUBLE AS price_after, (pa - list_price)::DOUBLE AS difference FROM area")
def _(s):
    return p.area_price(sized_products(s), area_rates(s))


APPLIED_RATES = [(1, 11, D("3.50"), date(2024, 3, 1)), (2, 12, D("4.25"), date(2024, 1, 1)), (3, 110, D("7.10"), date(2024, 2, 1)), (4, None, D("2.00"), date(2024, 2, 1))]
SQL_APPLY = """
, rate AS (SELECT * FROM (VALUES (1, '/11/', 3.5, DATE '2024-03-01'), (2, '/12/', 4.25, DATE '2024-01-01'), (3, '/110/', 7.1, DATE '2024-02-01'), (4, '/', 2.0, DATE '2024-02-01')) v(rate_id, node, rate, date)),
took AS (SELECT CAST(rate_id AS BIGINT) AS rate_id, id AS product_id, list_price, standard_price, round((id % 30) * (id % 20) * rate, 2)::DECIMAL(18,2) AS cost, row_number() OVER (PARTITION BY id ORDER BY date, rate_id) AS position
  FROM product, rate WHERE id % 3 <> 1 AND contains('/' || parent_path, node) AND id % 30 > 0 AND id % 20 > 0)
"""


def area_products(s: Star):
    return sized_products(s).withColumn("use_area_pricing", F.col("id") % 3 != 1)


def applied_rates(s: Star):
    return rows(s.spark, "rate_id bigint, categ_id bigint, rate decimal(9,2), date date", APPLIED_RATES)


@query("rate_apply", SQL_APPLY + "SELECT rate_id, position, product_id, list_price::DOUBLE AS price_before, coalesce(lag(cost) OVER (PARTITION BY product_id ORDER BY position), standard_price)::DOUBLE AS cost_before, cost::DOUBLE AS cost_after FROM took")
def _(s):
    return p.rate_apply(area_products(s), applied_rates(s))


@query("rate_apply_products", SQL_APPLY + "SELECT id, list_price::DOUBLE AS list_price, coalesce(c.cost, p.standard_price)::DOUBLE AS standard_price FROM product p LEFT JOIN (SELECT product_id, arg_max(cost, position) AS cost FROM took GROUP BY 1) c ON c.product_id = p.id")
def _(s):
    """The product table written once, rewritten with the applied rates, and read back."""
    root = f"{shared_dir(s.spark).rstrip('/')}/products-{uuid.uuid4().hex}"
    before = publish_version(area_products(s), root)
    after = publish_version(p.products_after(before, p.rate_apply(before, applied_rates(s))), root)
    return after.select("id", "list_price", "standard_price")


@query("affected_product_count", SQL_AREA + "SELECT rate_id, count(*) AS products FROM area GROUP BY rate_id")
def _(s):
    return p.area_price(sized_products(s), area_rates(s)).groupBy("rate_id").agg(F.count("*").alias("products"))


@query("uom_convert", SQL_UOM + "SELECT order_id, sequence, product_id, CAST(qty AS DOUBLE) AS qty, (CASE WHEN l.uom_id = 2 THEN qty * 4 ELSE qty END)::DOUBLE AS converted FROM sale_order_line l")
def _(s):
    lines = s.lines().withColumn("product_uom_id", F.lit(1).cast("bigint"))
    return p.uom_convert(lines, uoms(s), "product_uom_id").select("order_id", "sequence", "product_id", "qty", "converted")


@query("secondary_unit_price", "SELECT order_id, sequence, product_id, round(CASE WHEN product_id % 3 = 0 AND floor(qty / 6) > 0 THEN price_subtotal::DOUBLE / floor(qty / 6)::DOUBLE ELSE 0 END, 8) AS secondary_price FROM sale_order_line")
def _(s):
    lines = s.lines().withColumn("secondary_uom_id", F.when(F.col("product_id") % 3 == 0, F.lit(9))).withColumn("secondary_qty", F.floor(F.col("qty") / 6).cast(QTY))
    return p.secondary_unit_price(lines).select("order_id", "sequence", "product_id", "secondary_price")


@query("template_unique_value", "SELECT template_id, CASE WHEN count(DISTINCT brand) = 1 THEN min(brand) END AS brand FROM product GROUP BY template_id")
def _(s):
    return p.template_unique_value(s.products(), "brand")


def packagings(s: Star):
    base = s.products().filter("id % 2 = 0").select(F.col("id").alias("product_id"))
    boxes = F.array(
        F.struct(F.lit(1).alias("n"), F.lit(6).alias("qty"), (F.col("product_id") % 4 == 0).alias("sales")),
        F.struct(F.lit(2).alias("n"), F.lit(4).alias("qty"), F.lit(True).alias("sales")),
    )
    return base.select("product_id", F.inline(boxes)).select(
        (F.col("product_id") * 10 + F.col("n")).alias("id"), "product_id", F.col("n").alias("sequence"), F.col("qty").cast(QTY).alias("qty"), "sales"
    )


@query("packaging_default", """, k AS (SELECT *, CASE WHEN product_id % 4 = 0 THEN 6 WHEN product_id % 2 = 0 THEN 4 END AS q, product_id * 10 + CASE WHEN product_id % 4 = 0 THEN 1 ELSE 2 END AS pid FROM sale_order_line)
SELECT order_id, sequence, product_id, qty::DOUBLE AS qty, CASE WHEN q IS NOT NULL AND qty % q = 0 THEN pid END AS packaging_id, CASE WHEN q IS NOT NULL AND qty % q = 0 THEN qty::DOUBLE / q END AS packaging_qty FROM k""")
def _(s):
    return p.packaging_default(s.lines(), packagings(s)).select("order_id", "sequence", "product_id", "qty", "packaging_id", "packaging_qty")


def dated_lines(s: Star):
    heads = s.orders().select(
        F.col("id").alias("order_id"),
        F.when(F.col("id") % 2 == 0, F.col("date_order").cast("date")).alias("default_start"),
        F.when(F.col("id") % 3 == 0, F.date_add(F.col("date_order").cast("date"), 9)).alias("default_end"),
    )
    goods = s.products().select(F.col("id").alias("product_id"), "must_have_dates")
    return (
        s.lines()
        .join(heads, "order_id")
        .join(goods, "product_id")
        .withColumn("start_date", F.when(F.col("sequence") % 2 == 0, F.col("ship_date")))
        .withColumn("end_date", F.when(F.col("sequence") % 3 == 0, F.date_add("ship_date", 4)))
        .withColumn("days", F.when(F.col("agent_id") % 2 == 0, F.col("qty").cast("int") - 5))
    )


SQL_DATED = """
, dl AS (SELECT l.*, p.must_have_dates, CASE WHEN o.id % 2 = 0 THEN CAST(date_order AS DATE) END AS ds, CASE WHEN o.id % 3 = 0 THEN CAST(date_order AS DATE) + 9 END AS de,
 CASE WHEN sequence % 2 = 0 THEN ship_date END AS start_date, CASE WHEN sequence % 3 = 0 THEN ship_date + 4 END AS end_date, CASE WHEN agent_id % 2 = 0 THEN CAST(qty AS INT) - 5 END AS days
 FROM sale_order_line l JOIN sale_order o ON o.id = l.order_id JOIN product p ON p.id = l.product_id)
"""


@query("line_days", SQL_DATED + """, z AS (SELECT *, CASE WHEN must_have_dates THEN coalesce(start_date, end_date - (greatest(days, 1) - 1), ds) END AS st, CASE WHEN must_have_dates THEN coalesce(end_date, start_date + (greatest(days, 1) - 1), de) END AS en FROM dl)
SELECT order_id, sequence, product_id, CAST(CASE WHEN en IS NOT NULL AND st > en THEN en ELSE st END AS VARCHAR) AS line_start, CAST(en AS VARCHAR) AS line_end, CASE WHEN st > en THEN 1 ELSE en - st + 1 END AS number_of_days FROM z""")
def _(s):
    return p.line_days(dated_lines(s)).select("order_id", "sequence", "product_id", "line_start", "line_end", "number_of_days")


@query("start_end_date_check", SQL_DATED + """SELECT order_id, sequence, product_id, CASE WHEN end_date IS NULL THEN 'missing end date' WHEN start_date IS NULL THEN 'missing start date' ELSE 'start after end' END AS reason FROM dl WHERE must_have_dates AND (end_date IS NULL OR start_date IS NULL OR start_date > end_date)""")
def _(s):
    from tallygrid.operators.checks import start_end_date_check

    return start_end_date_check(dated_lines(s)).select("order_id", "sequence", "product_id", "reason")


@query("commitment_shift", "SELECT l.order_id, l.sequence, l.product_id, CAST(l.commitment_date - 2 AS VARCHAR) AS date_planned, CAST(coalesce(l.commitment_date, o.commitment_date) AS VARCHAR) AS date_deadline FROM sale_order_line l JOIN sale_order o ON o.id = l.order_id")
def _(s):
    heads = s.orders().select(F.col("id").alias("order_id"), F.col("commitment_date").alias("order_commitment_date"))
    return p.commitment_shift(s.lines().join(heads, "order_id"), 2).select("order_id", "sequence", "product_id", "date_planned", "date_deadline")


ELABORATIONS = [(1, 3, 10), (2, 5, None), (3, 8, 30)]


@query("elaboration_price", """, el AS (SELECT order_id, line_no, unnest(CASE WHEN product_id % 3 = 0 THEN [1, 2] ELSE [2, 3] END) AS e FROM sale_order_line WHERE product_id % 4 < 2),
pr AS (SELECT CAST(k AS BIGINT) AS pricelist_id, id AS product_id, CAST(round(list_price * k * 0.1, 2) AS DECIMAL(18,2)) AS price FROM product, (VALUES (1),(2)) v(k)),
su AS (SELECT el.order_id, el.line_no, sum(pr.price) AS v, coalesce(arg_min(r, e) FILTER (r IS NOT NULL), NULL) AS route FROM el JOIN (VALUES (1,3,10),(2,5,NULL),(3,8,30)) x(id,pid,r) ON x.id = e JOIN sale_order o ON o.id = el.order_id LEFT JOIN pr ON pr.pricelist_id = o.pricelist_id AND pr.product_id = x.pid GROUP BY 1, 2)
SELECT l.order_id, l.line_no, coalesce(v, 0)::DOUBLE AS elaboration_price_unit, CASE WHEN product_id % 4 < 2 AND product_id % 3 = 0 THEN CAST(10 AS BIGINT) END AS route_id, CASE WHEN product_id % 6 = 0 THEN product_id ELSE CAST(7 AS BIGINT) END AS elaboration_profile_id FROM sale_order_line l LEFT JOIN su USING (order_id, line_no)""")
def _(s):
    heads = s.orders().select(F.col("id").alias("order_id"), "pricelist_id")
    lines = s.keyed_lines().select("order_id", "line_no", "product_id").join(heads, "order_id").withColumn(
        "product_profile_id", F.when(F.col("product_id") % 6 == 0, F.col("product_id"))
    ).withColumn("category_profile_id", F.lit(7).cast("bigint"))
    chosen = F.when(F.col("product_id") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2), F.lit(3))).cast("array<bigint>")
    links = lines.filter("product_id % 4 < 2").select("order_id", "line_no", F.explode(chosen).alias("elaboration_id"))
    prices = s.products().select(
        F.col("id").alias("product_id"), "list_price", F.explode(F.array(F.lit(1), F.lit(2)).cast("array<bigint>")).alias("pricelist_id")
    ).select("product_id", "pricelist_id", F.round(F.col("list_price") * F.col("pricelist_id") * F.lit(D("0.1")), 2).cast(MONEY).alias("price"))
    return p.elaboration_price(lines, links, rows(s.spark, "id bigint, product_id bigint, route_id bigint", ELABORATIONS), prices, ["order_id", "line_no"]).select(
        "order_id", "line_no", "elaboration_price_unit", "route_id", "elaboration_profile_id"
    )


@query("multi_line_expand", "SELECT o.id AS order_id, p.id AS product_id, CAST(o.id % 5 + 1 AS DOUBLE) AS qty, p.list_price::DOUBLE AS price_unit, p.uom_id AS product_uom, p.name AS product_name, (p.list_price * (o.id % 5 + 1))::DOUBLE AS price_subtotal FROM sale_order o JOIN product p ON p.id = o.id % 20 OR p.id = o.id % 20 + 3 WHERE o.state = 'draft'")
def _(s):
    wish = F.array(F.col("id") % 20, F.col("id") % 20 + 3)
    wanted = s.orders().filter("state = 'draft'").select(F.col("id").alias("order_id"), (F.col("id") % 5 + 1).cast(QTY).alias("qty"), F.explode(wish).alias("product_id"))
    return p.multi_line_expand(wanted, s.products()).select("order_id", "product_id", "qty", "price_unit", "product_uom", "product_name", "price_subtotal")


@query("line_label", """, z AS (SELECT l.order_id, l.line_no, CASE WHEN l.product_id % 9 = 0 THEN 'Special ' || p.name ELSE p.name END AS b, CASE WHEN l.product_id % 7 = 0 THEN 'C' || l.product_id END AS code, l.product_id % 2 = 0 AS st, l.product_id % 11 = 0 AS el, p.free_qty, 'SO' || l.order_id AS o FROM sale_order_line l JOIN product p ON p.id = l.product_id),
y AS (SELECT *, CASE WHEN code IS NOT NULL THEN '[' || code || '] ' || b ELSE b END AS c FROM z)
SELECT order_id, line_no, CASE WHEN st THEN c || ' (' || printf('%.2f', free_qty::DOUBLE) || ')' ELSE c END AS line_name, CASE WHEN el THEN o || ' - ' || c ELSE c END AS invoice_name FROM y""")
def _(s):
    pid = F.col("product_id")
    goods = s.products().select(F.col("id").alias("product_id"), F.col("name").alias("product_name"), "free_qty")
    lines = s.keyed_lines().select("order_id", "line_no", "product_id").join(goods, "product_id").select(
        "*",
        F.when(pid % 7 == 0, F.concat(F.lit("C"), pid.cast("string"))).otherwise(F.lit("")).alias("customer_code"),
        F.when(pid % 9 == 0, F.concat(F.lit("Special "), F.col("product_name"))).alias("sale_description"),
        (pid % 2 == 0).alias("show_stock"),
        (pid % 11 == 0).alias("is_elaboration"),
        F.concat(F.lit("SO"), F.col("order_id").cast("string")).alias("order_name"),
    )
    return p.line_label(lines).select("order_id", "line_no", "line_name", "invoice_name")


@query("warning_message", """SELECT o.id, o.state, CASE WHEN o.state IN ('draft','sent') THEN nullif(concat_ws(chr(10), nullif(c.sale_warn, ''), CASE WHEN p.id <> p.commercial_partner_id THEN nullif(p.sale_warn, '') END), '') END AS warning
FROM sale_order o LEFT JOIN partner p ON p.id = o.partner_id LEFT JOIN partner c ON c.id = p.commercial_partner_id""")
def _(s):
    return p.warning_message(s.orders(), s.partners()).select("id", "state", "warning")


@query("partner_balance", """, e AS (SELECT partner_id, sum(amount_total) FILTER (move_type = 'out_refund') AS credit, sum(amount_total) FILTER (move_type = 'out_invoice') AS debit FROM invoice WHERE state = 'posted' GROUP BY 1)
SELECT o.id, (coalesce(credit, 0) - coalesce(debit, 0))::DOUBLE AS customer_balance FROM sale_order o LEFT JOIN e USING (partner_id)""")
def _(s):
    refund = F.col("move_type") == "out_refund"
    zero = F.lit(0).cast(MONEY)
    entries = s.invoices().filter("state = 'posted'").select(
        "partner_id",
        F.when(refund, F.col("amount_total")).otherwise(zero).alias("credit"),
        F.when(refund, zero).otherwise(F.col("amount_total")).alias("debit"),
    )
    return p.partner_balance(s.orders(), entries).select("id", "customer_balance")
