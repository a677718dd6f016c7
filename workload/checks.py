"""Checks, visibility, automation, backfill, report and set-operation queries."""

from __future__ import annotations

import os
import uuid
from datetime import date
from decimal import Decimal as D

from pyspark.sql import functions as F

from tallygrid.functions.money import MONEY, PERCENT, QTY
from tallygrid.operators import automation as au
from tallygrid.operators import checks as ck
from tallygrid.operators import reports as rp
from tallygrid.operators import visibility as vi
from tallygrid.session import shared_dir
from tallygrid.sources import backfill as bf
from tallygrid.sources import sinks
from tallygrid.sources.rules import rows
from tallygrid.sources.star import Star
from workload.fulfilment import SQL_PLAN, SQL_SHEET, plans, sheet_lines, stated
from workload.prelude import ratio_sql
from workload.registry import query

# -- sources, sinks, backfills ------------------------------------------------------------


@query("scan_domain", "SELECT id, partner_id, amount_total::DOUBLE AS amount_total FROM sale_order WHERE state = 'sale' AND date_order >= '1999-01-01' ORDER BY amount_total DESC, id LIMIT 25")
def _(s):
    return bf.scan_domain(s.orders(), "state = 'sale' AND date_order >= timestamp '1999-01-01'", [F.desc("amount_total"), F.asc("id")], 25, ["id", "partner_id", "amount_total"])


@query("view_publish", "SELECT state, count(*) AS n, sum(amount_total)::DOUBLE AS amount FROM sale_order GROUP BY 1")
def _(s):
    df = s.orders().groupBy("state").agg(F.count("*").alias("n"), F.sum("amount_total").alias("amount"))
    return sinks.view_publish(df, "order_state_totals")


@query("sink_csv_export", "SELECT id, name || ' \"' || state || '\", x' AS label, amount_total::DOUBLE AS amount_total FROM sale_order WHERE state IN ('sale','done')")
def _(s):
    # Written to the shared folder and read back, so the check sees the file's content.
    path = os.path.join(shared_dir(s.spark), "exports", uuid.uuid4().hex)
    df = s.orders().filter("state IN ('sale','done')").select("id", F.concat("name", F.lit(' "'), "state", F.lit('", x')).alias("label"), "amount_total", "team_id")
    sinks.sink_csv_export(df, path, ["id", "label", "amount_total"])
    return s.spark.read.csv(path, header=True, quote='"', escape='"', schema="id bigint, label string, amount_total decimal(18,2)")


@query("backfill_discount_free", "SELECT order_id, sequence, product_id, CASE WHEN discount = 0 THEN price_subtotal END::DOUBLE AS price_subtotal_no_discount, CASE WHEN discount = 0 THEN price_total END::DOUBLE AS price_total_no_discount FROM sale_order_line")
def _(s):
    return bf.backfill_discount_free(s.lines()).select("order_id", "sequence", "product_id", "price_subtotal_no_discount", "price_total_no_discount")


@query("distinct_orders", "SELECT DISTINCT order_id FROM sale_order_line WHERE discount <> 0")
def _(s):
    return bf.distinct_orders(s.lines())


@query("backfill_remaining", "SELECT order_id, sequence, product_id, (qty - qty_delivered)::DOUBLE AS remains FROM sale_order_line")
def _(s):
    return bf.backfill_remaining(s.lines()).select("order_id", "sequence", "product_id", "remains")


@query("backfill_parent_to_child", "SELECT c.id, coalesce(c.user_id, p.user_id) AS user_id FROM partner c LEFT JOIN partner p ON p.id = c.parent_id")
def _(s):
    return bf.backfill_parent_to_child(s.partners(), "user_id").select("id", "user_id")


@query("backfill_unrevisioned_name", "SELECT id, CASE WHEN id % 3 = 0 THEN 'OLD' || id ELSE name END AS unrevisioned_name FROM sale_order")
def _(s):
    old = s.orders().withColumn("unrevisioned_name", F.when(F.col("id") % 3 == 0, F.concat(F.lit("OLD"), F.col("id").cast("string"))))
    return bf.backfill_empty(old, "unrevisioned_name", "name").select("id", "unrevisioned_name")


@query("column_rename_copy", "SELECT id, amount_untaxed::DOUBLE AS invoiced_amount, coalesce(coupon_code, blocking_reason) AS note FROM sale_order")
def _(s):
    base = s.orders().select("id", F.col("amount_untaxed").alias("old_amount"), F.col("coupon_code").alias("note"), F.col("blocking_reason").alias("old_note"))
    return bf.column_rename_copy(bf.column_rename_copy(base, "old_amount", "invoiced_amount"), "old_note", "note")


@query("prefix_flag_backfill", "SELECT id, state IN ('draft','sent') AND starts_with(name, 'SO1') AS is_quotation_number FROM sale_order")
def _(s):
    return bf.prefix_flag_backfill(s.orders(), "SO1").select("id", "is_quotation_number")


# -- visibility ---------------------------------------------------------------------------


@query("domain_predicate", "SELECT id FROM sale_order WHERE (state = 'sale' OR (team_id = 3 AND NOT (amount_total > 1000))) AND company_id IN (1, 2)")
def _(s):
    keep = vi.all_of(vi.any_of("state = 'sale'", vi.all_of("team_id = 3", ~F.expr("amount_total > 1000"))), F.col("company_id").isin(1, 2))
    return s.orders().filter(keep).select("id")


@query("rule_predicates", "SELECT order_id, sequence, product_id FROM sale_order_line WHERE price_unit > 3000 AND discount >= 5 AND display_type IS NULL")
def _(s):
    texts = ["price_unit > 3000", "discount >= 5", "display_type IS NULL"]
    return s.lines().filter(vi.all_of(*texts)).select("order_id", "sequence", "product_id")


@query("override_hooks", "SELECT order_id, sequence, product_id, round(price_subtotal * CASE WHEN qty > 30 THEN 0.1 ELSE 0.05 END, 2)::DOUBLE AS amount FROM sale_order_line")
def _(s):
    rate = F.when(F.col("qty") > 30, F.lit(D("0.10"))).otherwise(F.lit(D("0.05")))
    return vi.with_hook(s.lines(), "amount", lambda base: F.round(base * rate, 2), F.col("price_subtotal")).select("order_id", "sequence", "product_id", "amount")


@query("visible_team_rows", "SELECT id FROM sale_order WHERE user_id = 3 OR user_id IS NULL OR team_id IN (2, 5) OR team_id IS NULL")
def _(s):
    return vi.visible_team_rows(s.orders(), 3, [2, 5]).select("id")


@query("visible_team_lines", "SELECT order_id, sequence, product_id FROM sale_order_line l JOIN sale_order o ON o.id = l.order_id WHERE user_id = 3 OR user_id IS NULL OR team_id IN (2, 5) OR team_id IS NULL")
def _(s):
    heads = vi.visible_team_rows(s.orders(), 3, [2, 5]).select(F.col("id").alias("order_id"))
    return s.lines().join(heads, "order_id", "left_semi").select("order_id", "sequence", "product_id")


for _name, _manager, _scope in (
    ("visible_partner_rows", False, "user_id = 3 OR (user_id IS NULL AND (team_id IS NULL OR team_id = 4))"),
    ("visible_partner_rows_manager", True, "team_id = 4 OR team_id IS NULL"),
):

    @query(_name, f"SELECT id FROM partner WHERE id % 50 = 11 OR id = 7 OR {_scope}")
    def _(s, manager=_manager):
        followed = s.partners().withColumn("followers", F.when(F.col("id") % 50 == 11, F.array(F.lit(7).cast("bigint"))).otherwise(F.array().cast("array<bigint>")))
        return vi.visible_partner_rows(followed, 3, 7, 4, manager).select("id")


@query("visible_portal_rows", "SELECT o.id FROM sale_order o WHERE EXISTS (SELECT 1 FROM partner p WHERE (p.id = o.partner_id OR p.id = o.partner_id + 3) AND o.id % 3 <> 1 AND contains('/' || p.parent_path, '/25/'))")
def _(s):
    who = F.explode(F.array(F.col("partner_id"), F.col("partner_id") + 3))
    followers = s.orders().filter("id % 3 <> 1").select(F.col("id").alias("order_id"), who.alias("partner_id"))
    return vi.visible_portal_rows(s.orders(), "id", followers, s.partners(), 25).select("id")


@query("visible_portal_invoices", "SELECT i.id FROM invoice i JOIN partner p ON p.id = i.partner_id WHERE contains('/' || p.parent_path, '/25/')")
def _(s):
    followers = s.orders().select(F.col("id").alias("order_id"), "partner_id")
    return vi.visible_portal_rows(s.invoices(), "order_id", followers, s.partners(), 25).select("id")


@query("visible_company_rows", "SELECT id FROM (SELECT id, CASE WHEN id % 8 <> 0 THEN company_id END AS c FROM sale_order) WHERE c IS NULL OR c IN (1, 3)")
def _(s):
    return vi.visible_company_rows(s.orders().withColumn("company_id", F.when(F.col("id") % 8 != 0, F.col("company_id"))), [1, 3]).select("id")


@query("selectable_partners", "SELECT id FROM partner WHERE selectable")
def _(s):
    return vi.selectable_partners(s.partners()).select("id")


@query("allowed_pricelists", "SELECT id FROM sale_order WHERE partner_id % 4 <> 0 OR pricelist_id = partner_id % 3 + 1 AND partner_id % 8 = 0 OR pricelist_id = 2")
def _(s):
    lists = s.partners().filter("id % 4 = 0").select(
        F.col("id").alias("partner_id"), F.explode(F.when(F.col("id") % 8 == 0, F.array(F.col("id") % 3 + 1, F.lit(2))).otherwise(F.array(F.lit(2).cast("bigint")))).alias("pricelist_id")
    )
    return vi.allowed_pricelists(s.orders(), lists).select("id")


ASSORTMENTS = {1: "list_price > 950", 2: "brand IN ('Brand#1', 'Brand#2', 'Brand#3')", 3: "type = 'product'"}


@query("assortment_products", """, t AS (SELECT c.id AS partner_id, p.id AS product_id, p.list_price > 950 AS a1, p.brand IN ('Brand#1', 'Brand#2', 'Brand#3') AS a2, p.type = 'product' AS a3 FROM partner c, product p WHERE c.id % 40 = 3 OR c.id % 40 = 7)
SELECT partner_id, product_id FROM t WHERE (partner_id % 40 = 3 AND a1 AND a2) OR (partner_id % 40 = 7 AND a2 AND a3)""")
def _(s):
    picks = F.when(F.col("id") % 40 == 3, F.array(F.lit(1), F.lit(2))).when(F.col("id") % 40 == 7, F.array(F.lit(2), F.lit(3))).cast("array<bigint>")
    given = s.partners().select(F.col("id").alias("partner_id"), F.explode(picks).alias("assortment_id"))
    return vi.assortment_products(s.products(), given, ASSORTMENTS)


def given_assortments(s: Star):
    """Three of four partners have assortments: one, or two of the three."""
    picks = F.when(F.col("id") % 4 == 1, F.array(F.lit(2), F.lit(1))).when(F.col("id") % 4 == 2, F.array(F.lit(2), F.lit(3))).when(F.col("id") % 4 == 3, F.array(F.lit(3)))
    return s.partners().select(F.col("id").alias("partner_id"), F.explode(picks.cast("array<bigint>")).alias("assortment_id"))


@query("assortment_combinations", "SELECT id AS partner_id, CASE id % 4 WHEN 1 THEN '1,2' WHEN 2 THEN '2,3' ELSE '3' END AS combination FROM partner WHERE id % 4 > 0")
def _(s):
    return vi.partner_combinations(given_assortments(s))


@query("assortment_combination_products", """, t AS (SELECT id AS product_id, list_price > 950 AS a1, brand IN ('Brand#1', 'Brand#2', 'Brand#3') AS a2, type = 'product' AS a3 FROM product)
SELECT '1,2' AS combination, product_id FROM t WHERE a1 AND a2 UNION ALL SELECT '2,3', product_id FROM t WHERE a2 AND a3 UNION ALL SELECT '3', product_id FROM t WHERE a3""")
def _(s):
    return vi.combination_products(vi.partner_combinations(given_assortments(s)), vi.fitting_assortments(s.products(), ASSORTMENTS))


@query("assortment_lines", """SELECT l.order_id, line_no, product_id, CASE o.partner_id % 4 WHEN 1 THEN list_price > 950 AND brand IN ('Brand#1', 'Brand#2', 'Brand#3') WHEN 2 THEN brand IN ('Brand#1', 'Brand#2', 'Brand#3') AND p.type = 'product' WHEN 3 THEN p.type = 'product' ELSE TRUE END AS in_assortment
FROM sale_order_line l JOIN sale_order o ON o.id = l.order_id JOIN product p ON p.id = l.product_id""")
def _(s):
    heads = s.orders().select(F.col("id").alias("order_id"), "partner_id")
    lines = s.keyed_lines().select("order_id", "line_no", "product_id").join(heads, "order_id")
    return vi.assortment_lines(lines, s.products(), given_assortments(s), ASSORTMENTS).drop("partner_id")


# -- exceptions ---------------------------------------------------------------------------

HOLIDAYS = [(date(1997, m, 1), m if m % 2 else None, [1] if m == 5 else []) for m in range(1, 13)] + [(date(1998, 12, 25), None, [])]
SQL_HOLIDAY = """
, hol AS (SELECT make_date(1997, m, 1) AS d, CASE WHEN m % 2 = 1 THEN m END AS c, m = 5 AS only1 FROM range(1, 13) r(m) UNION ALL SELECT DATE '1998-12-25', NULL, FALSE),
oh AS (SELECT o.id, CAST((CAST(commitment_date AS TIMESTAMP) + INTERVAL 23 HOUR) + INTERVAL 5 HOUR AS DATE) AS d, p.country_id AS c, p.id % 2 AS st FROM sale_order o LEFT JOIN partner p ON p.id = o.partner_shipping_id WHERE commitment_date IS NOT NULL),
hh AS (SELECT DISTINCT oh.id FROM oh JOIN hol ON hol.d = oh.d AND (hol.c IS NULL OR hol.c = oh.c) AND (NOT only1 OR st = 1))
"""


def on_holiday(s: Star):
    places = s.partners().withColumn("state_id", F.col("id") % 2)
    days = rows(s.spark, "date date, country_id bigint, state_ids array<bigint>", HOLIDAYS)
    orders = s.orders().withColumn("commitment_at", F.col("commitment_date").cast("timestamp") + F.expr("interval 23 hours"))
    return ck.holiday_check(orders, places, days, "Asia/Karachi")


@query("holiday_check", SQL_HOLIDAY + "SELECT id FROM hh")
def _(s):
    return on_holiday(s).select("id")


SQL_EXCEPTIONS = SQL_HOLIDAY + """
, lc AS (SELECT order_id, count(*) AS n FROM sale_order_line GROUP BY 1),
oe AS (SELECT o.id AS order_id, o.date_order, o.name, sp.zip, nullif(p.sale_warn, '') AS pw, n, amount_total, hh.id AS h FROM sale_order o LEFT JOIN partner p ON p.id = o.partner_id LEFT JOIN partner sp ON sp.id = o.partner_shipping_id LEFT JOIN lc ON lc.order_id = o.id LEFT JOIN hh ON hh.id = o.id WHERE o.id % 6 <> 0),
le AS (SELECT l.*, p.type, p.virtual_available, nullif(p.sale_warn, '') AS sw, p.standard_price FROM sale_order_line l JOIN product p ON p.id = l.product_id WHERE order_id % 6 <> 0),
ex AS (SELECT order_id, 'no zip' AS rule FROM oe WHERE zip IS NULL UNION ALL SELECT order_id, 'partner warning' FROM oe WHERE pw IS NOT NULL UNION ALL SELECT order_id, 'no lines' FROM oe WHERE n IS NULL UNION ALL SELECT order_id, 'total is 0' FROM oe WHERE amount_total = 0
 UNION ALL SELECT order_id, 'delivery on holiday' FROM oe WHERE h IS NOT NULL UNION ALL SELECT DISTINCT order_id, 'not enough stock' FROM le WHERE type = 'product' AND virtual_available < qty UNION ALL SELECT DISTINCT order_id, 'product warning' FROM le WHERE sw IS NOT NULL
 UNION ALL SELECT DISTINCT order_id, 'price below cost' FROM le WHERE standard_price <> 0 AND price_unit < standard_price)
"""


def exception_facts(s: Star):
    own = s.partners().select(F.col("id").alias("partner_id"), F.nullif("sale_warn", F.lit("")).alias("partner_warning"))
    ship = s.partners().select(F.col("id").alias("partner_shipping_id"), F.col("zip").alias("ship_zip"))
    counts = s.lines().groupBy(F.col("order_id").alias("id")).agg(F.count("*").alias("line_count"))
    closed = on_holiday(s).select("id", F.lit(True).alias("on_holiday"))
    orders = s.orders().withColumn("ignore_exceptions", F.col("id") % 6 == 0).join(own, "partner_id", "left").join(ship, "partner_shipping_id", "left")
    orders = orders.join(counts, "id", "left").join(closed, "id", "left").withColumn("on_holiday", F.coalesce("on_holiday", F.lit(False)))
    goods = s.products().select(F.col("id").alias("product_id"), "type", "virtual_available", F.nullif("sale_warn", F.lit("")).alias("product_warning"), "standard_price")
    return orders, s.lines().join(goods, "product_id")


@query("exception_rules", SQL_EXCEPTIONS + "SELECT order_id, rule FROM ex")
def _(s):
    orders, lines = exception_facts(s)
    return ck.exception_rules(orders, lines, ck.exception_catalog(holidays=True))


@query("exception_rule_catalog", SQL_EXCEPTIONS + "SELECT rule, count(*) AS orders FROM ex GROUP BY 1")
def _(s):
    orders, lines = exception_facts(s)
    return ck.exception_rules(orders, lines, ck.exception_catalog(holidays=True)).groupBy("rule").agg(F.count("*").alias("orders"))


@query("exception_sort", SQL_EXCEPTIONS + "SELECT o.id, o.name, min(rule) AS main_exception FROM sale_order o LEFT JOIN ex ON ex.order_id = o.id GROUP BY o.id, o.name")
def _(s):
    orders, lines = exception_facts(s)
    rules = ck.exception_catalog(holidays=True)
    return ck.exception_sort(orders, ck.exception_rules(orders, lines, rules), rules).select("id", "name", "main_exception")


# -- price, stock and quantity checks -----------------------------------------------------


@query("below_cost_lines", "SELECT order_id, sequence, product_id, price_unit::DOUBLE AS price_unit, standard_price::DOUBLE AS cost FROM sale_order_line l JOIN product p ON p.id = l.product_id WHERE display_type IS NULL AND order_id % 5 <> 0 AND standard_price > 0 AND price_unit < standard_price")
def _(s):
    return ck.below_cost_lines(s.lines().withColumn("approved", F.col("order_id") % 5 == 0), s.products()).select("order_id", "sequence", "product_id", "price_unit", "cost")


def stocked_lines(s: Star):
    goods = s.products().select(F.col("id").alias("product_id"), "type", "free_qty")
    return s.lines().join(goods, "product_id").withColumn("pack_qty", F.when(F.col("product_id") % 2 == 0, F.lit(6)))


@query("stock_block_lines", "SELECT order_id, sequence, product_id, qty::DOUBLE AS qty, free_qty::DOUBLE AS free_qty FROM sale_order_line l JOIN product p ON p.id = l.product_id WHERE type = 'product' AND qty > free_qty")
def _(s):
    return ck.stock_block_lines(stocked_lines(s)).select("order_id", "sequence", "product_id", "qty", "free_qty")


@query("stock_block_adjust", "SELECT order_id, sequence, product_id, free_qty::DOUBLE AS allowed_qty, CASE WHEN product_id % 2 = 0 THEN floor(free_qty / 6) END::DOUBLE AS allowed_packs, CASE WHEN free_qty > 0 THEN free_qty ELSE qty END::DOUBLE AS adjusted_qty FROM sale_order_line l JOIN product p ON p.id = l.product_id WHERE type = 'product' AND qty > free_qty")
def _(s):
    return ck.stock_block_adjust(stocked_lines(s)).select("order_id", "sequence", "product_id", "allowed_qty", "allowed_packs", "adjusted_qty")


LEVELS = ("min_qty", "max_qty", "multiple_qty", "force_min", "force_max")


def limited(df, key, low, high, mult):
    """Restriction columns by key arithmetic: 0 and 'use_parent' where not set."""
    k = F.col(key)
    flag = lambda m: F.when(k % m == 0, F.lit("force")).when(k % m == 1, F.lit("not_force")).otherwise(F.lit("use_parent"))
    return df.select(
        "*",
        F.when(k % 4 == 0, F.lit(low)).otherwise(F.lit(0)).cast(QTY).alias("min_qty"),
        F.when(k % 3 == 0, F.lit(high)).otherwise(F.lit(0)).cast(QTY).alias("max_qty"),
        F.when(k % 5 == 0, F.lit(mult)).otherwise(F.lit(0)).cast(QTY).alias("multiple_qty"),
        flag(7).alias("force_min"),
        flag(6).alias("force_max"),
    )


def limits(s: Star):
    templates = s.products().select(F.col("template_id").alias("id")).distinct()
    return ck.restricted_qty_resolve(limited(s.products(), "id", 8, 40, 4), limited(templates, "id", 10, 45, 5), limited(s.categories(), "id", 5, 48, 2))


def level_sql(k: str, low: int, high: int, mult: int) -> str:
    flag = lambda m: f"CASE {k} % {m} WHEN 0 THEN 'force' WHEN 1 THEN 'not_force' END"
    return f"CASE WHEN {k} % 4 = 0 THEN {low} END, CASE WHEN {k} % 3 = 0 THEN {high} END, CASE WHEN {k} % 5 = 0 THEN {mult} END, {flag(7)}, {flag(6)}"


SQL_LIMITS = f"""
, lv AS (SELECT p.id AS product_id, 0 AS dist, {level_sql('p.id', 8, 40, 4)} FROM product p UNION ALL SELECT p.id, 1, {level_sql('p.template_id', 10, 45, 5)} FROM product p
 UNION ALL SELECT p.id, 2, {level_sql('p.categ_id', 5, 48, 2)} FROM product p UNION ALL SELECT p.id, 3, {level_sql('c.parent_id', 5, 48, 2)} FROM product p JOIN category c ON c.id = p.categ_id UNION ALL SELECT p.id, 4, {level_sql('1', 5, 48, 2)} FROM product p),
lm AS (SELECT product_id, coalesce(arg_min(mn, dist) FILTER (mn IS NOT NULL), 0) AS min_qty, coalesce(arg_min(mx, dist) FILTER (mx IS NOT NULL), 0) AS max_qty, coalesce(arg_min(mu, dist) FILTER (mu IS NOT NULL), 0) AS multiple_qty,
 coalesce(arg_min(f1, dist) FILTER (f1 IS NOT NULL), 'x') = 'force' AS force_min, coalesce(arg_min(f2, dist) FILTER (f2 IS NOT NULL), 'x') = 'force' AS force_max FROM lv t(product_id, dist, mn, mx, mu, f1, f2) GROUP BY 1)
"""


@query("restricted_qty_resolve", SQL_LIMITS + "SELECT product_id, min_qty::DOUBLE AS min_qty, max_qty::DOUBLE AS max_qty, multiple_qty::DOUBLE AS multiple_qty, force_min, force_max FROM lm")
def _(s):
    return limits(s)


@query("restricted_qty_check", SQL_LIMITS + """, z AS (SELECT order_id, line_no, qty, lm.* FROM sale_order_line l JOIN lm ON lm.product_id = l.product_id)
SELECT order_id, line_no, 'below minimum' AS reason FROM z WHERE min_qty > 0 AND qty < min_qty AND NOT force_min UNION ALL SELECT order_id, line_no, 'above maximum' FROM z WHERE max_qty > 0 AND qty > max_qty AND NOT force_max UNION ALL SELECT order_id, line_no, 'not a multiple' FROM z WHERE multiple_qty > 0 AND qty % multiple_qty <> 0""")
def _(s):
    return ck.restricted_qty_check(s.keyed_lines().select("order_id", "line_no", "product_id", "qty"), limits(s)).select("order_id", "line_no", "reason")


# -- order, partner, plan and payment checks ----------------------------------------------


@query("quotation_expired", "SELECT o.id FROM sale_order o JOIN partner p ON p.id = o.partner_id WHERE state IN ('draft','sent') AND NOT no_auto_cancel AND validity_date < DATE '1999-06-01' - CAST(company_id * 10 AS INT)")
def _(s):
    companies = rows(s.spark, "id bigint, auto_cancel_days int", [(c, c * 10) for c in range(5)])
    return ck.quotation_expired(s.orders(), companies, s.partners(), date(1999, 6, 1)).select("id")


@query("address_check", """, z AS (SELECT o.id, b.commercial_partner_id AS b, s.commercial_partner_id AS s, p.commercial_partner_id AS p FROM sale_order o LEFT JOIN partner b ON b.id = o.partner_invoice_id LEFT JOIN partner s ON s.id = o.partner_shipping_id LEFT JOIN partner p ON p.id = o.partner_id)
SELECT id, 'invoice address' AS reason FROM z WHERE b IS DISTINCT FROM p UNION ALL SELECT id, 'delivery address' FROM z WHERE s IS DISTINCT FROM p""")
def _(s):
    return ck.address_check(s.orders(), s.partners()).select("id", "reason")


@query("archivable_orders", "SELECT id, state FROM sale_order WHERE state IN ('done','cancel')")
def _(s):
    return ck.archivable_orders(s.orders()).select("id", "state")


def pickings(s: Star):
    moves = s.lines().filter("qty_delivered > 0").select("order_id", F.when(F.col("product_id") % 3 == 0, F.lit("done")).otherwise(F.lit("assigned")).alias("state"))
    return moves.distinct()


@query("cancel_restriction", "SELECT id FROM sale_order WHERE state = 'sale' AND id IN (SELECT order_id FROM sale_order_line WHERE qty_delivered > 0 AND product_id % 3 = 0)")
def _(s):
    return ck.cancel_restriction(s.orders().filter("state = 'sale'"), pickings(s)).select("id")


@query("task_link_check", """, t AS (SELECT order_id, line_no, qty_invoiced, state FROM sale_order_line l JOIN sale_order o ON o.id = l.order_id)
SELECT order_id, line_no, 'line is invoiced' AS reason FROM t WHERE qty_invoiced > 0 UNION ALL SELECT order_id, line_no, 'order is locked' FROM t WHERE state = 'done' UNION ALL SELECT order_id, line_no, 'order is cancelled' FROM t WHERE state = 'cancel'""")
def _(s):
    lines = stated(s, s.keyed_lines())
    tasks = s.keyed_lines().select("order_id", "line_no")
    return ck.task_link_check(tasks, lines).select("order_id", "line_no", "reason")


@query("line_kind_check", """, z AS (SELECT order_id, sequence, product_id AS pid, display_type, CASE WHEN product_id % 30 <> 7 THEN product_id END AS p, uom_id FROM sale_order_line)
SELECT order_id, sequence, pid, 'section with product data' AS reason FROM z WHERE display_type IS NOT NULL UNION ALL SELECT order_id, sequence, pid, 'product line incomplete' FROM z WHERE display_type IS NULL AND p IS NULL""")
def _(s):
    lines = s.lines().withColumn("pid", F.col("product_id")).withColumn("product_id", F.when(F.col("pid") % 30 != 7, F.col("pid")))
    return ck.line_kind_check(lines).select("order_id", "sequence", "pid", "reason")


@query("order_line_list", "SELECT order_id, sequence, product_id, state, invoice_status FROM sale_order_line l JOIN sale_order o ON o.id = l.order_id WHERE display_type IS NULL AND state IN ('sale','done') AND invoice_status IN ('to invoice','upselling')")
def _(s):
    heads = s.orders().select(F.col("id").alias("order_id"), "state", "invoice_status")
    return ck.order_line_list(s.lines().join(heads, "order_id"), ["sale", "done"], ["to invoice", "upselling"]).select("order_id", "sequence", "product_id", "state", "invoice_status")


@query("blanket_consistency_check", """, z AS (SELECT l.order_id, l.line_no, l.product_id AS lp, l.product_id + CASE WHEN l.product_id % 10 = 0 THEN 1 ELSE 0 END AS bp, o.currency_id AS lc, o.partner_id % 3 + 1 AS bc, o.company_id % 3 AS bco, o.company_id AS lco, CASE WHEN l.product_id % 8 = 1 THEN 'done' ELSE 'open' END AS st, 20 - qty AS rem, qty FROM sale_order_line l JOIN sale_order o ON o.id = l.order_id)
SELECT order_id, line_no, 'product differs' AS reason FROM z WHERE lp <> bp UNION ALL SELECT order_id, line_no, 'currency differs' FROM z WHERE lc <> bc UNION ALL SELECT order_id, line_no, 'company differs' FROM z WHERE lco <> bco UNION ALL SELECT order_id, line_no, 'blanket order not open' FROM z WHERE st <> 'open' UNION ALL SELECT order_id, line_no, 'negative remaining' FROM z WHERE rem < 0""")
def _(s):
    heads = s.orders().select(F.col("id").alias("order_id"), "currency_id", "partner_id", "company_id")
    lines = s.keyed_lines().select("order_id", "line_no", "product_id", "qty").join(heads, "order_id")
    lines = lines.withColumn("blanket_line_id", F.concat_ws("/", "order_id", "line_no"))
    other = lines.select(
        F.col("blanket_line_id").alias("id"), (F.col("product_id") + F.when(F.col("product_id") % 10 == 0, 1).otherwise(0)).alias("product_id"), (F.col("partner_id") % 3 + 1).alias("currency_id"),
        "partner_id", (F.col("company_id") % 3).alias("company_id"), F.when(F.col("product_id") % 8 == 1, F.lit("done")).otherwise(F.lit("open")).alias("state"), (F.lit(20) - F.col("qty")).alias("remaining"),
    )
    return ck.blanket_consistency_check(lines, other).select("order_id", "line_no", "reason")


@query("plan_percent_check", SQL_PLAN + """, z AS (SELECT order_id, round(sum(CASE WHEN invoice_type = 'installment' THEN CASE WHEN order_id % 4 = 0 THEN percent + 1 WHEN order_id % 4 = 1 AND installment = 2 THEN 0 ELSE percent END END), 0) AS pc, order_id % 4 = 1 AS zero, any_value(o.state) AS state FROM plan JOIN sale_order o ON o.id = order_id GROUP BY order_id)
SELECT order_id, pc::DOUBLE AS percent, 'over 100 percent' AS reason FROM z WHERE pc > 100 UNION ALL SELECT order_id, pc::DOUBLE, 'zero percent' FROM z WHERE zero AND state <> 'draft'""")
def _(s):
    k = F.col("order_id") % 4
    bad = plans(s).withColumn("percent", F.when(F.col("invoice_type") == "advance", F.col("percent")).when(k == 0, F.col("percent") + 1).when((k == 1) & (F.col("installment") == 2), F.lit(0)).otherwise(F.col("percent")).cast(PERCENT))
    return ck.plan_percent_check(bad, s.orders()).select("order_id", "percent", "reason")


@query("payment_overpay_check", SQL_SHEET + """, z AS (SELECT invoice_id, sum(amount * k) AS paid, residual, bool_or(amount * k = 0) AS zero FROM sl, (VALUES (1),(2)) v(k) WHERE (k = 1 OR invoice_id % 3 = 0) GROUP BY invoice_id, residual)
SELECT invoice_id, paid::DOUBLE AS paid, 'over residual' AS reason FROM z WHERE paid > residual UNION ALL SELECT invoice_id, paid::DOUBLE, 'zero amount' FROM z WHERE zero""")
def _(s):
    base = sheet_lines(s).withColumn("k", F.explode(F.when(F.col("invoice_id") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    doubled = base.withColumn("amount", (F.col("amount") * F.col("k")).cast(MONEY)).withColumn("sheet_state", F.lit("open"))
    return ck.payment_overpay_check(doubled).select("invoice_id", "paid", "reason")


@query("advance_payment_check", """, z AS (SELECT id AS order_id, CASE WHEN id % 2 = 0 THEN 'inbound' ELSE 'outbound' END AS pt, CAST(id % 7 * 20000 AS DECIMAL(18,2)) AS a, CAST(round(amount_total * 0.5, 2) AS DECIMAL(18,2)) AS res, amount_total AS t FROM sale_order)
SELECT order_id, 'amount not positive' AS reason FROM z WHERE a <= 0 UNION ALL SELECT order_id, 'inbound over residual' FROM z WHERE pt = 'inbound' AND a > res UNION ALL SELECT order_id, 'outbound over advanced' FROM z WHERE pt = 'outbound' AND a > t - res""")
def _(s):
    asks = s.orders().select(
        F.col("id").alias("order_id"), F.when(F.col("id") % 2 == 0, F.lit("inbound")).otherwise(F.lit("outbound")).alias("payment_type"), (F.col("id") % 7 * 20000).cast(MONEY).alias("currency_amount"),
        F.round(F.col("amount_total") * F.lit(D("0.5")), 2).cast(MONEY).alias("amount_residual"), "amount_total",
    )
    return ck.advance_payment_check(asks).select("order_id", "reason")


@query("commission_band_check", "SELECT product_id, low::DOUBLE AS amount_from, high::DOUBLE AS amount_to FROM (SELECT id AS product_id, list_price AS low, list_price + 10 - id % 20 AS high FROM product) WHERE high < low")
def _(s):
    bands = s.products().select(F.col("id").alias("product_id"), F.col("list_price").alias("amount_from"), (F.col("list_price") + 10 - F.col("id") % 20).alias("amount_to"))
    return ck.commission_band_check(bands)


@query("agent_integrity_check", """, u AS (SELECT id, agent_type, employee_id, salesman_as_agent, CASE WHEN id % 10 <> 1 THEN commission_id END AS cm FROM users), sh AS (SELECT employee_id, count(*) FILTER (agent_type = 'salesman') AS n FROM u WHERE employee_id IS NOT NULL GROUP BY 1)
SELECT id, 'no employee' AS reason FROM u WHERE agent_type = 'salesman' AND employee_id IS NULL UNION ALL SELECT id, 'employee shared' FROM u JOIN sh USING (employee_id) WHERE agent_type = 'salesman' AND n > 1 UNION ALL SELECT id, 'no commission' FROM u WHERE salesman_as_agent AND cm IS NULL""")
def _(s):
    agents = s.users().withColumn("commission_id", F.when(F.col("id") % 10 != 1, F.col("commission_id")))
    return ck.agent_integrity_check(agents).select("id", "reason")


def unique_sql(rule: str, keys: list[str], source: str, nulls_equal: bool = False) -> str:
    shown = " || '/' || ".join(f"coalesce(({k})::VARCHAR, '')" for k in keys)
    some = "" if nulls_equal else " WHERE " + " AND ".join(f"({k}) IS NOT NULL" for k in keys)
    return f"SELECT '{rule}' AS rule, {shown} AS key, count(*) AS n FROM {source}{some} GROUP BY {', '.join(keys)} HAVING count(*) > 1"


UNIQUE_SQL = " UNION ALL ".join([
    unique_sql("line agent", ["order_id", "product_id", "agent_id"], "sale_order_line"),
    unique_sql("target", ["company_id", "id % 2", "team_id", "user_id", "CAST(date_trunc('month', date_order) AS DATE)"], "sale_order"),
    unique_sql("area rate", ["CAST(date_order AS DATE)", "nullif(type_id, 5)", "company_id"], "sale_order"),
    unique_sql("applied area rate", ["CAST(date_order AS DATE)", "nullif(type_id, 5)", "company_id"], "(SELECT * FROM sale_order WHERE state = 'sale')", True),
    unique_sql("revision", ["revision_group", "revision_number // 2", "company_id"], "sale_order"),
    unique_sql("coupon code", ["zip"], "partner"),
    unique_sql("instalment", ["order_id", "sequence"], "sale_order_line"),
])


@query("uniqueness_checks", UNIQUE_SQL)
def _(s):
    """Orders stand for targets, area rates and revisions, customers' codes for coupons, line positions for instalments."""
    orders = s.orders().select(
        "id", "company_id", "team_id", "user_id", "state", "revision_group",
        (F.col("id") % 2).alias("scope"), F.trunc("date_order", "month").alias("month"), F.col("date_order").cast("date").alias("day"),
        F.expr("nullif(type_id, 5)").alias("categ_id"), F.expr("revision_number div 2").alias("half"),
    )
    rate = ("day", "categ_id", "company_id")
    return ck.uniqueness_checks([
        ck.KeySet("line agent", s.lines(), ("order_id", "product_id", "agent_id")),
        ck.KeySet("target", orders, ("company_id", "scope", "team_id", "user_id", "month")),
        ck.KeySet("area rate", orders, rate),
        ck.KeySet("applied area rate", orders.filter("state = 'sale'"), rate, nulls_equal=True),
        ck.KeySet("revision", orders, ("revision_group", "half", "company_id")),
        ck.KeySet("coupon code", s.partners(), ("zip",)),
        ck.KeySet("instalment", s.lines(), ("order_id", "sequence")),
    ])


@query("range_checks", """SELECT id, 'validity before order' AS reason FROM sale_order WHERE validity_date < CAST(date_order AS DATE) + CAST(id % 40 AS INT)
UNION ALL SELECT id, 'probability out of range' FROM sale_order WHERE id % 120 > 100 UNION ALL SELECT id, 'negative cancel days' FROM sale_order WHERE id % 50 < 3
UNION ALL SELECT id, 'rate not positive' FROM sale_order WHERE discount_rate <= 0 UNION ALL SELECT id, 'team missing' FROM sale_order WHERE id % 2 = 0 AND team_id IS NULL
UNION ALL SELECT id, 'salesperson missing' FROM sale_order WHERE id % 2 = 1 AND user_id IS NULL""")
def _(s):
    late = F.col("validity_date") < F.date_add(F.col("date_order").cast("date"), (F.col("id") % 40).cast("int"))
    scope = F.when(F.col("id") % 2 == 0, F.lit("team")).otherwise(F.lit("user"))
    tests = ck.out_of_range(F.col("id") % 120, F.col("id") % 50 - 3, F.col("discount_rate"), (scope, F.col("team_id"), F.col("user_id")))
    return ck.failing(s.orders(), ("validity before order", late), *tests).select("id", "reason")


# -- automation ---------------------------------------------------------------------------

FLOWS = [(1, True, True, False, True, True), (2, True, False, True, True, False)]
FLOW_SCHEMA = "id bigint, validate_order boolean, create_invoice boolean, sale_done boolean, validate_invoice boolean, register_payment boolean"


@query("workflow_stage_select", """SELECT 'order' AS kind, id, 'validate_order' AS action FROM sale_order WHERE workflow_id IN (1, 2) AND state = 'draft' UNION ALL SELECT 'order', id, 'create_invoice' FROM sale_order WHERE workflow_id = 1 AND state IN ('sale','done') AND invoice_status = 'to invoice'
UNION ALL SELECT 'order', id, 'sale_done' FROM sale_order WHERE workflow_id = 2 AND state = 'sale' AND invoice_status = 'invoiced' UNION ALL SELECT 'invoice', id, 'validate_invoice' FROM invoice WHERE id % 3 <> 0 AND state = 'draft' UNION ALL SELECT 'invoice', id, 'register_payment' FROM invoice WHERE id % 3 = 1 AND state = 'posted' AND payment_state = 'not_paid'
UNION ALL SELECT 'picking', p.id, 'validate_picking' FROM (SELECT DISTINCT order_id, order_id * 2 + CAST(is_return AS INT) AS id FROM stock_move) p JOIN sale_order o ON o.id = order_id WHERE workflow_id = 1 AND p.id % 5 < 3""")
def _(s):
    """Orders, invoices and their transfers; a transfer's state follows from its number."""
    flows = rows(s.spark, FLOW_SCHEMA, FLOWS)
    states = F.array(*[F.lit(x) for x in ("draft", "confirmed", "assigned", "done", "cancel")])
    transfers = s.stock_moves().select("order_id", (F.col("order_id") * 2 + F.col("is_return").cast("int")).alias("id")).distinct()
    transfers = transfers.withColumn("state", F.element_at(states, (F.col("id") % 5 + 1).cast("int"))).join(s.orders().select(F.col("id").alias("order_id"), "workflow_id"), "order_id")
    moved = au.workflow_stage_select(transfers, flows.withColumn("validate_picking", F.col("id") == 1), au.PICKING_STAGES)
    orders = au.workflow_stage_select(s.orders(), flows, au.ORDER_STAGES).select(F.lit("order").alias("kind"), "id", "action")
    bills = s.invoices().withColumn("workflow_id", F.when(F.col("id") % 3 != 0, F.col("id") % 3))
    billed = au.workflow_stage_select(bills, flows, au.INVOICE_STAGES).select(F.lit("invoice").alias("kind"), "id", "action")
    return orders.unionByName(billed).unionByName(moved.select(F.lit("picking").alias("kind"), "id", "action"))


@query("warehouse_automation_select", """, o AS (SELECT *, warehouse_id % 2 = 0 AS dd, warehouse_id < 3 AS mi, warehouse_id > 0 AS po FROM sale_order WHERE state IN ('sale','done')), op AS (SELECT DISTINCT order_id FROM sale_order_line WHERE qty_delivered > 0 AND product_id % 3 <> 0), iv AS (SELECT order_id, bool_or(state = 'draft') AS d FROM invoice GROUP BY 1)
SELECT id, 'deliver' AS step FROM o WHERE dd AND id IN (SELECT order_id FROM op) UNION ALL SELECT id, 'invoice' FROM o WHERE mi AND id NOT IN (SELECT order_id FROM iv) UNION ALL SELECT id, 'post' FROM o JOIN iv ON iv.order_id = o.id WHERE po AND d""")
def _(s):
    stores = rows(s.spark, "id bigint, delivery_done boolean, make_invoice boolean, post_invoice boolean", [(w, w % 2 == 0, w < 3, w > 0) for w in range(4)])
    return au.warehouse_automation_select(s.orders(), stores, s.invoices(), pickings(s))


@query("amount_approval", "SELECT id, CASE WHEN state IN ('draft','sent') THEN CASE WHEN amount_total > 300000 THEN 'to_approve' ELSE 'sale' END ELSE state END AS state_after FROM sale_order")
def _(s):
    return au.amount_approval(s.orders(), 300000, approver=False).select("id", "state_after")


@query("discount_approval", "SELECT id, CASE WHEN state IN ('draft','sent') AND discount_type = 'percent' AND discount_rate > 9 THEN 'waiting_approval' ELSE state END AS approval_state FROM sale_order")
def _(s):
    return au.discount_approval(s.orders(), 9).select("id", "approval_state")


@query("bulk_discount_update", "SELECT id, CASE WHEN state NOT IN ('draft','sent') THEN 'not open' END AS rejected, CASE WHEN state IN ('draft','sent') THEN 12.5 ELSE discount_rate END::DOUBLE AS discount_rate, CASE WHEN state IN ('draft','sent') THEN 'waiting_approval' ELSE state END AS approval_state FROM sale_order")
def _(s):
    return au.bulk_discount_update(s.orders(), "percent", 12.5, 9)


@query("bulk_discount_decision", "SELECT id, CASE WHEN state IN ('draft','sent') AND discount_type = 'percent' AND discount_rate > 9 THEN 'approved' ELSE state END AS approval_state, CASE WHEN NOT (state IN ('draft','sent') AND discount_type = 'percent' AND discount_rate > 9) THEN 'not waiting' END AS rejected FROM sale_order")
def _(s):
    return au.bulk_discount_decision(au.discount_approval(s.orders(), 9), approve=True)


@query("approver_queue", """, o AS (SELECT id, team_id FROM sale_order WHERE state IN ('draft','sent')), ta AS (SELECT CAST(t AS BIGINT) AS team_id, t % 5 + k AS user_id, k AS sq FROM range(0, 20) r(t), (VALUES (1),(2),(3)) v(k)), oa AS (SELECT id AS order_id, team_id % 5 + k AS user_id, k AS sq, k <= id % 4 AS ap FROM o, (VALUES (1),(2)) v(k) WHERE team_id IS NOT NULL AND id % 3 <> 0),
al AS (SELECT * FROM oa UNION ALL SELECT o.id, ta.user_id, ta.sq, FALSE FROM o JOIN ta USING (team_id) WHERE NOT EXISTS (SELECT 1 FROM oa WHERE oa.order_id = o.id AND oa.user_id = ta.user_id)), nx AS (SELECT order_id, arg_min(user_id, sq * 1000 + user_id) AS n FROM al WHERE NOT ap GROUP BY 1)
SELECT o.id AS order_id, n AS next_approver, CASE WHEN n IS NULL THEN 'Fully Approved' ELSE 'Pending Approval' END AS approval_status FROM o LEFT JOIN nx ON nx.order_id = o.id""")
def _(s):
    team = rows(s.spark, "team_id bigint, user_id bigint, sequence int", [(t, t % 5 + k, k) for t in range(20) for k in (1, 2, 3)])
    open_ = s.orders().filter("state IN ('draft','sent') AND team_id IS NOT NULL AND id % 3 <> 0")
    own = open_.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("sequence")).select(F.col("id").alias("order_id"), (F.col("team_id") % 5 + F.col("sequence")).alias("user_id"), "sequence", (F.col("sequence") <= F.col("id") % 4).alias("approved"))
    return au.approver_queue(s.orders(), team, own)


@query("partner_default_fill", "SELECT o.id, coalesce(s.sale_warn, p.sale_warn) AS note, coalesce(p.team_id, u.country_id) AS default_team FROM sale_order o LEFT JOIN (SELECT id, nullif(sale_warn, '') AS sale_warn FROM partner) s ON s.id = o.partner_shipping_id LEFT JOIN partner p ON p.id = o.partner_id LEFT JOIN users u ON u.id = o.user_id")
def _(s):
    warn = s.partners().withColumn("warn", F.nullif("sale_warn", F.lit("")))
    noted = au.partner_default_fill(s.orders(), [(warn, "partner_shipping_id", "warn"), (s.partners(), "partner_id", "sale_warn")], "note")
    return au.partner_default_fill(noted, [(s.partners(), "partner_id", "team_id"), (s.users(), "user_id", "country_id")], "default_team").select("id", "note", "default_team")


@query("parent_propagation", "SELECT c.id, CASE WHEN c.parent_id IS NOT NULL AND c.parent_id % 10 = 0 AND (c.user_id IS NULL OR c.user_id = c.parent_id % 11) THEN 99 ELSE c.user_id END AS user_id FROM partner c")
def _(s):
    changed = s.partners().filter("id % 10 = 0").select("id", (F.col("id") % 11).alias("old_value"), F.lit(99).cast("bigint").alias("new_value"))
    return au.parent_propagation(s.partners(), changed, "user_id").select("id", "user_id")


STAGES = [(1, D("10"), True), (2, D("30"), True), (3, D("60"), False), (4, D("100"), True)]


def leads(s: Star):
    return s.orders().select(F.col("id").alias("lead_id"), F.when(F.col("id") % 9 != 0, F.col("id") % 4 + 1).alias("stage_id"), (F.col("id") % 11 * 10).cast(PERCENT).alias("probability"))


@query("stage_probability_apply", """, st AS (SELECT * FROM (VALUES (1,10,TRUE),(2,30,TRUE),(3,60,FALSE),(4,100,TRUE)) v(id,p,oc)), z AS (SELECT o.id AS lead_id, CASE WHEN coalesce(oc, FALSE) THEN st.p ELSE o.id % 11 * 10 END AS pr, st.p FROM sale_order o LEFT JOIN st ON st.id = CASE WHEN o.id % 9 <> 0 THEN o.id % 4 + 1 END)
SELECT lead_id, pr::DOUBLE AS probability, pr IS NOT DISTINCT FROM p AS matches_stage FROM z""")
def _(s):
    return au.stage_probability_apply(leads(s), rows(s.spark, "id bigint, probability decimal(9,2), on_change boolean", STAGES)).select("lead_id", "probability", "matches_stage")


@query("stage_lead_count", "SELECT CASE WHEN id % 9 <> 0 THEN id % 4 + 1 END AS stage_id, count(*) AS lead_count FROM sale_order GROUP BY 1")
def _(s):
    return au.stage_lead_count(leads(s))


# -- reports and set operations -----------------------------------------------------------


@query("sale_report_by_type", "SELECT type_id, state, count(*) AS line_count, sum(qty)::DOUBLE AS quantity, sum(price_subtotal)::DOUBLE AS price_subtotal, sum(price_total)::DOUBLE AS price_total FROM sale_order_line l JOIN sale_order o ON o.id = l.order_id GROUP BY 1, 2")
def _(s):
    return rp.sale_report_by_type(s.lines(), s.orders())


SQL_ANALYTICS = """SELECT user_id, currency_id, min(id) AS id, sum(discount_rate)::DOUBLE AS total_discount, count(*) FILTER (state IN ('sale','done')) AS order_count, CAST(0 AS BIGINT) AS invoice_count FROM sale_order GROUP BY 1, 2
UNION ALL SELECT user_id, currency_id, -min(id), sum(discount_rate)::DOUBLE, 0, count(*) FILTER (state = 'posted') FROM invoice GROUP BY 1, 2"""


def discounted(df):
    return df.withColumn("discount_amount", F.col("discount_rate").cast(MONEY))


@query("discount_analytics", SQL_ANALYTICS)
def _(s):
    return rp.discount_analytics(discounted(s.orders()), discounted(s.invoices()))


@query("union_all_analytics", SQL_ANALYTICS)
def _(s):
    return rp.union_all_analytics(discounted(s.orders()), discounted(s.invoices()))


@query("salesperson_report", f""", z AS (SELECT o.*, u.id AS uid, coalesce(o.team_id = u.id % 3, FALSE) AS ins, r.n AS rn FROM sale_order o JOIN users u ON u.id = o.user_id LEFT JOIN (SELECT order_id, count(*) AS n FROM stock_move WHERE is_return GROUP BY 1) r ON r.order_id = o.id), tot AS (SELECT count(*) AS n FROM sale_order)
SELECT uid AS user_id, count(*) FILTER (ins) AS total_orders, count(*) FILTER (ins AND state = 'sale') AS orders_done, coalesce(sum(amount_total) FILTER (ins AND state = 'sale'), 0)::DOUBLE AS net_revenue, coalesce(sum(amount_total) FILTER (ins), 0)::DOUBLE AS estimated_revenue, coalesce(sum(coalesce(rn, 0)) FILTER (ins), 0)::BIGINT AS returned_orders,
 {ratio_sql("sum(amount_total) FILTER (ins)", "count(*) FILTER (ins)")} AS avg_price, {ratio_sql("count(*) FILTER (ins) * 100", "any_value(tot.n)")} AS overall_performance, {ratio_sql("count(*) FILTER (NOT ins) * 100", "any_value(tot.n)")} AS overall_elsewhere FROM z, tot GROUP BY uid""")
def _(s):
    back = s.stock_moves().filter("is_return").select("order_id")
    return rp.salesperson_report(s.orders(), back, s.users(), F.col("user_id") % 3)


@query("product_report", f""", z AS (SELECT p.template_id, count(*) AS n, sum(qty) AS q, sum(qty_delivered) AS d, sum(price_unit) AS pu, sum(price_subtotal) AS r FROM sale_order_line l JOIN product p ON p.id = l.product_id GROUP BY 1), b AS (SELECT p.template_id, sum(quantity) AS b FROM stock_move m JOIN product p ON p.id = m.product_id WHERE is_return AND m.product_id IN (SELECT product_id FROM sale_order_line) GROUP BY 1)
SELECT template_id, n AS total_lines, q::DOUBLE AS ordered_qty, d::DOUBLE AS delivered_qty, coalesce(b, 0)::DOUBLE AS returned_qty, r::DOUBLE AS revenue, {ratio_sql("pu", "n", 8)} AS avg_price, {ratio_sql("q", "n", 8)} AS avg_ordered, {ratio_sql("d", "n", 8)} AS avg_delivered FROM z LEFT JOIN b USING (template_id)""")
def _(s):
    return rp.product_report(s.lines(), s.stock_moves().filter("is_return"), s.products()).withColumn("total_lines", F.col("total_lines").cast("bigint"))


for _name, _by in (("product_sale_count", "product_id"), ("product_sale_count_template", "template_id")):

    @query(_name, f"SELECT {'p.id' if _by == 'product_id' else 'p.template_id'} AS {_by}, count(l.order_id) AS sale_count FROM product p LEFT JOIN (SELECT l.* FROM sale_order_line l JOIN sale_order o ON o.id = l.order_id WHERE state IN ('sale','done')) l ON l.product_id = p.id GROUP BY 1")
    def _(s, by=_by):
        return rp.product_sale_count(s.lines(), s.orders(), s.products(), by)


@query("semi_has_orders", "SELECT id, name FROM partner WHERE id IN (SELECT partner_id FROM sale_order WHERE state <> 'cancel' AND date_order >= '2000-01-01')")
def _(s):
    return rp.has_orders(s.partners(), s.orders().filter(F.col("date_order") >= F.lit(date(2000, 1, 1))), "partner_id").select("id", "name")


@query("anti_no_orders", "SELECT id, name FROM partner WHERE id NOT IN (SELECT partner_id FROM sale_order WHERE state <> 'cancel' AND date_order >= '2000-01-01')")
def _(s):
    return rp.without_orders(s.partners(), s.orders().filter(F.col("date_order") >= F.lit(date(2000, 1, 1))), "partner_id").select("id", "name")


@query("union_distinct", "SELECT order_id, product_id FROM sale_order_line WHERE qty > 40 UNION SELECT order_id, product_id FROM sale_order_line WHERE discount > 8")
def _(s):
    keys = s.lines().select("order_id", "product_id", "qty", "discount")
    return keys.filter("qty > 40").select("order_id", "product_id").union(keys.filter("discount > 8").select("order_id", "product_id")).distinct()


@query("difference", "SELECT DISTINCT order_id FROM sale_order_line WHERE qty > 40 EXCEPT SELECT order_id FROM sale_order_line WHERE discount > 8")
def _(s):
    return s.lines().filter("qty > 40").select("order_id").subtract(s.lines().filter("discount > 8").select("order_id"))


@query("intersection", "SELECT order_id FROM sale_order_line WHERE qty > 40 INTERSECT SELECT order_id FROM sale_order_line WHERE discount > 8")
def _(s):
    return s.lines().filter("qty > 40").select("order_id").intersect(s.lines().filter("discount > 8").select("order_id"))


@query("scalar_text", "SELECT order_id, line_no, printf('%s-%03d', 'SO' || order_id, line_no) AS lot, regexp_replace('SO' || order_id, '^SO', '') AS digits, 'SO' || order_id ILIKE 'so1%' AS like_so1, trim('  ' || product_id || ' ') AS trimmed FROM sale_order_line")
def _(s):
    name = F.concat(F.lit("SO"), F.col("order_id").cast("string"))
    return s.keyed_lines().select(
        "order_id", "line_no", F.format_string("%s-%03d", name, "line_no").alias("lot"), F.regexp_replace(name, "^SO", "").alias("digits"), name.ilike("so1%").alias("like_so1"),
        F.trim(F.concat(F.lit("  "), F.col("product_id").cast("string"), F.lit(" "))).alias("trimmed"),
    )


@query("scalar_date", "SELECT id, strftime(date_order, '%Y-%m-%d') AS day, CAST(CAST(date_trunc('month', date_order) AS DATE) AS VARCHAR) AS month, CAST(CAST(date_trunc('quarter', date_order) AS DATE) AS VARCHAR) AS quarter, isodow(date_order) AS weekday, CAST(CAST(CAST(date_order AS DATE) + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS next_month, CAST(CAST(date_order AS DATE) - 15 AS VARCHAR) AS before, CAST(CAST(date_order + INTERVAL 5 HOUR AS DATE) AS VARCHAR) AS local_day FROM sale_order")
def _(s):
    day = F.col("date_order").cast("date")
    return s.orders().select(
        "id", F.date_format("date_order", "yyyy-MM-dd").alias("day"), F.trunc(day, "month").alias("month"), F.trunc(day, "quarter").alias("quarter"), (F.weekday(day) + 1).cast("bigint").alias("weekday"),
        F.add_months(day, 1).alias("next_month"), F.date_sub(day, 15).alias("before"), F.from_utc_timestamp("date_order", "Asia/Karachi").cast("date").alias("local_day"),
    )


@query("scalar_math", "SELECT order_id, line_no, round(price_subtotal, 0)::DOUBLE AS rounded, abs(price_unit - purchase_price)::DOUBLE AS distance, CAST(order_id % 7 AS BIGINT) AS rest, floor(qty / 6)::DOUBLE AS packs, greatest(qty, 10)::DOUBLE AS at_least, least(qty, 10)::DOUBLE AS at_most, coalesce(round(price_total::DOUBLE / nullif(qty_delivered, 0)::DOUBLE, 8), 0) AS per_delivered FROM sale_order_line")
def _(s):
    return s.keyed_lines().select(
        "order_id", "line_no", F.round("price_subtotal", 0).alias("rounded"), F.abs(F.col("price_unit") - F.col("purchase_price")).alias("distance"), F.pmod("order_id", F.lit(7).cast("bigint")).alias("rest"),
        F.floor(F.col("qty") / 6).cast("double").alias("packs"), F.greatest("qty", F.lit(10)).cast(QTY).alias("at_least"), F.least("qty", F.lit(10)).cast(QTY).alias("at_most"),
        F.round(F.coalesce(F.try_divide(F.col("price_total").cast("double"), F.col("qty_delivered").cast("double")), F.lit(0.0)), 8).alias("per_delivered"),
    )


@query("scalar_json", "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(s):
    return s.events().select("event_id", "event_type", F.from_json("props", "k bigint")["k"].alias("k"))




@query("scalar_array", "SELECT order_id, string_agg(DISTINCT lpad(CAST(product_id % 7 AS VARCHAR), 2, '0'), ',' ORDER BY lpad(CAST(product_id % 7 AS VARCHAR), 2, '0')) AS kinds, count(DISTINCT product_id % 7) AS n_kinds, CASE max(product_id % 7) WHEN 6 THEN 'six' WHEN 5 THEN 'five' ELSE 'less' END AS top_name FROM sale_order_line GROUP BY 1")
def _(s):
    kinds = F.array_sort(F.collect_set(F.col("product_id") % 7))
    names = F.map_from_entries(F.array(F.struct(F.lit(6), F.lit("six")), F.struct(F.lit(5), F.lit("five"))))
    grouped = s.lines().groupBy("order_id").agg(kinds.alias("k"))
    top = F.aggregate("k", F.lit(0).cast("bigint"), lambda acc, x: F.greatest(acc, x))
    return grouped.select(
        "order_id", F.array_join(F.transform("k", lambda x: F.lpad(x.cast("string"), 2, "0")), ",").alias("kinds"), F.size("k").alias("n_kinds"),
        F.coalesce(F.try_element_at(names, top.cast("int")), F.lit("less")).alias("top_name"),
    )


@query("scalar_conditional", "SELECT order_id, count(*) FILTER (qty > 25) AS big_lines, coalesce(sum(price_total) FILTER (discount > 5), 0)::DOUBLE AS discounted, CASE WHEN bool_or(display_type IS NOT NULL) THEN 'with notes' ELSE 'plain' END AS kind FROM sale_order_line GROUP BY 1")
def _(s):
    note = F.col("display_type").isNotNull()
    return s.lines().groupBy("order_id").agg(
        F.count_if(F.col("qty") > 25).alias("big_lines"), F.coalesce(F.sum(F.when(F.col("discount") > 5, F.col("price_total"))), F.lit(0)).alias("discounted"),
        F.when(F.bool_or(note), F.lit("with notes")).otherwise(F.lit("plain")).alias("kind"),
    )
