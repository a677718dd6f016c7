"""Price rules, promotions, recommendation, history and line upkeep queries."""

from __future__ import annotations

from datetime import date
from decimal import Decimal as D

from pyspark.sql import functions as F

from tallygrid.functions.money import QTY
from tallygrid.operators import hooks
from tallygrid.operators import lines as ln
from tallygrid.operators import promotion as pr
from tallygrid.operators import recommend as rc
from tallygrid.sources.rules import rows
from tallygrid.sources.star import Star
from workload.pricing import SQL_TAXED, tax, taxed_lines
from workload.registry import query

# -- cumulative price rules ---------------------------------------------------------------

T, C = pr.BY_TEMPLATE, pr.BY_CATEGORY
# id, pricelist, applied on, template, category, minimum, kind, fixed price, percent, start, end.
PRICE_RULES = (
    [(k, 1, T, 10 * k, None, D(20), "fixed", D(500 + k), D(0), None, None) for k in range(1, 30)]
    + [(100 + k, 1, T, 10 * k, None, D(40), "percentage", D(0), D(15), None, date(1998, 12, 31)) for k in range(1, 30)]
    + [
        (201, 1, C, None, 11, D(30), "percentage", D(0), D(5), None, None),
        (202, 1, C, None, 1, D(0), "percentage", D(0), D(1), date(1996, 1, 1), None),
        (203, 2, C, None, 12, D(45), "fixed", D("99.50"), D(0), None, None),
        (204, 2, C, None, 112, D(45), "percentage", D(0), D(12), None, None),
    ]
)
SQL_PRICE_RULES = """
, pl_rule AS (SELECT CAST(k AS BIGINT) AS id, 1 AS pricelist_id, 't' AS kind, 10 * k AS node, 20 AS mn, 'fixed' AS cp, 500 + k AS fx, 0 AS pc, CAST(NULL AS DATE) AS ds, CAST(NULL AS DATE) AS de FROM range(1, 30) r(k)
 UNION ALL SELECT 100 + k, 1, 't', 10 * k, 40, 'percentage', 0, 15, NULL, DATE '1998-12-31' FROM range(1, 30) r(k)
 UNION ALL SELECT * FROM (VALUES (201,1,'c',11,30,'percentage',0,5,NULL,NULL),(202,1,'c',1,0,'percentage',0,1,DATE '1996-01-01',NULL),(203,2,'c',12,45,'fixed',99.5,0,NULL,NULL),(204,2,'c',112,45,'percentage',0,12,NULL,NULL)) v),
cl AS (SELECT l.order_id, l.line_no, o.pricelist_id, p.template_id, p.categ_id, p.parent_path, p.list_price, CAST(o.date_order AS DATE) AS day, CASE WHEN l.uom_id = 2 THEN qty * 4 ELSE qty END AS uq FROM sale_order_line l JOIN sale_order o ON o.id = l.order_id JOIN product p ON p.id = l.product_id WHERE display_type IS NULL),
cq AS (SELECT *, sum(uq) OVER (PARTITION BY order_id, template_id) AS tq, sum(uq) OVER (PARTITION BY order_id, categ_id) AS gq FROM cl),
cm AS (SELECT cq.*, r.id AS rid, r.cp, r.fx, r.pc, row_number() OVER (PARTITION BY order_id, line_no ORDER BY r.kind IS NULL, r.kind DESC, r.mn DESC, r.id DESC) AS rk FROM cq LEFT JOIN pl_rule r ON r.pricelist_id = cq.pricelist_id AND (r.ds IS NULL OR r.ds <= day) AND (r.de IS NULL OR day <= r.de)
  AND ((r.kind = 't' AND r.node = template_id AND (r.mn = 0 OR tq >= r.mn)) OR (r.kind = 'c' AND contains('/' || parent_path, '/' || r.node || '/') AND (r.mn = 0 OR gq >= r.mn))))
"""


def price_rules(s: Star):
    return rows(
        s.spark,
        "id bigint, pricelist_id bigint, applied_on string, global_product_tmpl_id bigint, global_categ_id bigint, min_quantity decimal(18,4), compute_price string, fixed_price decimal(18,2), percent_price decimal(9,2), date_start date, date_end date",
        PRICE_RULES,
    )


def rule_lines(s: Star):
    heads = s.orders().select(F.col("id").alias("order_id"), "pricelist_id", F.col("date_order").cast("date").alias("day"))
    goods = s.products().select(F.col("id").alias("product_id"), "template_id", "categ_id", "list_price")
    units = F.when(F.col("uom_id") == 2, F.col("qty") * 4).otherwise(F.col("qty")).cast(QTY)
    return s.keyed_lines().select("order_id", "line_no", "product_id", "display_type", units.alias("unit_qty")).join(goods, "product_id").join(heads, "order_id")


@query("cumulative_qty", SQL_PRICE_RULES + "SELECT order_id, line_no, tq::DOUBLE AS template_qty, gq::DOUBLE AS category_qty FROM cq")
def _(s):
    return pr.cumulative_qty(rule_lines(s)).select("order_id", "line_no", "template_qty", "category_qty")


@query("cumulative_price_rules", SQL_PRICE_RULES + "SELECT order_id, line_no, rid AS rule_id, CASE WHEN cp = 'fixed' THEN CAST(fx AS DECIMAL(18,2)) WHEN cp = 'percentage' THEN CAST(round(list_price * (100 - pc) * 0.01, 2) AS DECIMAL(18,2)) ELSE list_price END::DOUBLE AS rule_price FROM cm WHERE rk = 1")
def _(s):
    return pr.cumulative_price_rules(rule_lines(s), price_rules(s), s.categories()).select("order_id", "line_no", "rule_id", "rule_price")


@query("rule_prefix_join", SQL_PRICE_RULES + "SELECT c.id AS categ_id, r.id AS rule_id FROM category c JOIN pl_rule r ON r.kind = 'c' AND contains('/' || c.parent_path, '/' || r.node || '/')")
def _(s):
    return pr.rule_prefix_join(s.categories(), price_rules(s)).select("categ_id", F.col("id").alias("rule_id"))


@query("pricelist_lines", SQL_PRICE_RULES + "SELECT id, mn::DOUBLE AS min_quantity, cp AS compute_price FROM pl_rule WHERE pricelist_id = 1")
def _(s):
    return price_rules(s).filter("pricelist_id = 1").select("id", "min_quantity", "compute_price")


# -- promotions ---------------------------------------------------------------------------

# id, sequence, type, code, discount type, amount, minimum, tax incl., from, to, once, strategy, partners, pricelists, newsletter, currency
PROMOTIONS = [
    (1, 10, "coupon", "welcome20", "percentage", D(20), D(50000), False, None, None, False, "use_best", [], [], False, 1),
    (2, 1, "auto", None, "percentage", D(4), D(50000), True, None, None, False, "use_best", [], [1, 2], False, 1),
    (3, 2, "auto", None, "percentage", D(3), D(150000), False, date(1998, 1, 1), date(1998, 12, 31), False, "cumulate", [], [], False, 1),
    (4, 3, "auto", None, "amount_tax_included", D(20000), D(200000), False, None, None, False, "keep_existing", [], [], True, 1),
    (5, 4, "auto", None, "percentage", D(9), D(1000), False, None, None, False, "exclusive", [], [], False, 1),
    (6, 5, "auto", None, "amount_tax_excluded", D(30000), D(250000), True, None, None, True, "cumulate", [], [], False, 2),
    (7, 6, "auto", None, "percentage", D(50), D(10), False, None, date(1997, 1, 1), False, "use_best", [], [], False, 1),
    (8, 7, "auto", None, "percentage", D(6), D(10), False, None, None, False, "keep_existing", list(range(0, 400)), [], False, 1),
    (9, 8, "auto", None, "amount_tax_excluded", D(5), D(240000), False, None, None, False, "use_best", [], [], False, 3),
    (10, 9, "auto", None, "percentage", D(2), D(260000), True, None, None, False, "cumulate", [], [3], False, 1),
]
PROMO_SCHEMA = "id bigint, sequence int, rule_type string, code string, discount_type string, discount_amount decimal(9,2), minimal_amount decimal(18,2), minimal_tax_incl boolean, date_from date, date_to date, once_per_partner boolean, strategy string, partner_ids array<bigint>, pricelist_ids array<bigint>, only_newsletter boolean, currency_id bigint"
PROMO_RATES = [(1, 1, date(1998, 1, 1), D("1")), (2, 2, date(1998, 1, 1), D("2")), (3, 2, date(1998, 6, 1), D("1.25")), (4, 2, date(1998, 7, 1), D("3")), (5, 3, date(1998, 1, 1), D("0.8"))]
TODAY = date(1998, 6, 15)


def promotions(s: Star):
    """The rules; the product that stands for a fixed discount bears 21 % on top of its price."""
    return rows(s.spark, PROMO_SCHEMA, PROMOTIONS).withColumn("taxes", F.array(tax(1, "percent", D(21), False, 1)))


def promo_rates(s: Star):
    return rows(s.spark, "id bigint, currency_id bigint, date date, rate decimal(12,6)", PROMO_RATES)


def promo_orders(s: Star):
    news = s.partners().select(F.col("id").alias("partner_id"), "newsletter")
    return s.orders().select("id", "partner_id", "pricelist_id", "currency_id", "coupon_code").join(news, "partner_id")


def promo_lines(s: Star, keyed=False):
    return taxed_lines(s, keyed=keyed).withColumn("is_promotion_line", F.col("product_id") % 40 == 21)


def used_rules(s: Star):
    """Orders with a coupon code took rule 6 as well."""
    return s.orders().filter("coupon_code IS NOT NULL").select("partner_id", F.lit(6).cast("bigint").alias("rule_id"), F.col("id").alias("order_id"), "state")


def _promo_sql(also: dict[int, str] | None = None) -> str:
    """The fold written out, rule after rule on the lines: order sums ``u`` and ``t`` fall with each discount line.

    ``also`` adds conditions to rules.
    A rule is tested against the sums left by the rules before it. The discount lines' prices are worked out by hand
    for the three currencies: 21 % tax on the discount product, 1 : 1.25 : 0.8.
    """
    static = {
        1: "lower(coupon_code) = 'welcome20' AND u > 50000",
        2: "t > 50000 AND pricelist_id IN (1, 2)",
        3: "u > 150000",
        4: "u > 200000 AND newsletter",
        5: "u > 1000",
        6: "t > 250000 AND coalesce(n_used, 0) - CASE WHEN coupon_code IS NOT NULL AND state <> 'cancel' THEN 1 ELSE 0 END <= 0",
        7: "FALSE",
        8: "u > 10 AND partner_id < 400",
        9: "u > 240000",
        10: "t > 260000 AND pricelist_id = 3",
    }
    rules = {1: ("ub", 20), 2: ("ub", 4), 3: ("cu", 3), 4: ("ke", 20000), 5: ("ex", 9), 6: ("cu", 30000), 7: ("ub", 50), 8: ("ke", 6), 9: ("ub", 5), 10: ("cu", 2)}
    sql = SQL_TAXED + """
, ns AS (SELECT partner_id, count(*) AS n_used FROM sale_order WHERE coupon_code IS NOT NULL AND state <> 'cancel' GROUP BY 1),
fixed_line(rule, cur, price, off_u, off_t) AS (VALUES
  (4, 1, 16528.92, 16528.92, 19999.99), (4, 2, 20661.16, 20661.16, 25000.00), (4, 3, 13223.14, 13223.14, 16000.00),
  (6, 1, 24000.00, 24000.00, 29040.00), (6, 2, 30000.00, 30000.00, 36300.00), (6, 3, 19200.00, 19200.00, 23232.00),
  (9, 1, 6.25, 6.25, 7.56), (9, 2, 7.81, 7.81, 9.45), (9, 3, 5.00, 5.00, 6.05)),
pb0 AS (SELECT order_id, sum(full_sub) AS u, sum(full_sub + full_tax) AS t FROM taxed WHERE product_id % 40 <> 21 GROUP BY 1),
d0 AS (SELECT o.id AS order_id, o.state, o.partner_id, o.pricelist_id, o.currency_id, o.coupon_code, p.newsletter, n_used, l.line_no,
    coalesce(l.product_id % 40 = 21, TRUE) AS pl, l.discount AS c0, coalesce(u, 0)::DECIMAL(28,2) AS u, coalesce(t, 0)::DECIMAL(28,2) AS t
  FROM sale_order o JOIN partner p ON p.id = o.partner_id LEFT JOIN pb0 ON pb0.order_id = o.id LEFT JOIN ns ON ns.partner_id = o.partner_id
  LEFT JOIN sale_order_line l ON l.order_id = o.id)
"""
    for k, (kind, amount) in rules.items():
        c = f"c{k - 1}"
        count = "+".join(f"CAST(v{j} AS INT)" for j in range(1, k)) or "0"
        test = f"coalesce({static[k]}{' AND ' + also[k] if also and k in also else ''}, FALSE)" + (f" AND {count} = 0" if kind == "ex" else "")
        takes = {"ub": f"({c} = 0 OR {amount} > {c})", "cu": "TRUE", "ke": f"{c} = 0", "ex": "TRUE"}[kind]
        fixed = k in (4, 6, 9)
        percent = 0 if fixed else amount
        new = f"{c} + {percent}" if kind == "cu" else str(percent)
        sql += f", t{k} AS (SELECT *, {test} AS v{k} FROM d{k - 1}), e{k} AS (SELECT *, v{k} AND NOT pl AND {takes} AS e{k} FROM t{k})"
        body = f"SELECT * REPLACE (u, t), CASE WHEN e{k} THEN {new} ELSE {c} END AS c{k} FROM e{k}"
        if fixed:
            body = f"""SELECT e{k}.* REPLACE (u - coalesce(off_u, 0) AS u, t - coalesce(off_t, 0) AS t), CASE WHEN e{k} THEN {new} ELSE {c} END AS c{k}, f.price AS p{k}
  FROM (SELECT *, bool_or(e{k}) OVER (PARTITION BY order_id) AS any{k} FROM e{k}) e{k} LEFT JOIN fixed_line f ON f.rule = {k} AND f.cur = currency_id AND any{k}"""
        sql += f", d{k} AS ({body.replace('SELECT * REPLACE (u, t)', 'SELECT *')})"
    return sql


SQL_PROMO = _promo_sql()
_RULES = range(1, 11)
_APPLIED = "concat_ws(',', " + ", ".join(f"CASE WHEN v{k} THEN '{k}' END" for k in _RULES) + ")"
_TAKEN = "concat_ws(',', " + ", ".join(f"CASE WHEN e{k} THEN '{k}' END" for k in _RULES) + ")"


def applied(s: Star):
    return pr.applied_rules(promo_orders(s), promo_lines(s), promotions(s), promo_rates(s), TODAY, used_rules(s))


def listed(column: str):
    return F.concat_ws(",", F.transform(column, lambda x: x.cast("string"))).alias(column)


@query("promotion_rules_applied", SQL_PROMO + f"SELECT DISTINCT order_id, {_APPLIED} AS applied FROM d10")
def _(s):
    return applied(s).select("order_id", listed("applied"))


@query("hook_promotions", _promo_sql({2: "partner_id % 2 = 0", 3: "currency_id <> 1"}) + f"SELECT DISTINCT order_id, {_APPLIED} AS applied FROM d10")
def _(s):
    """An extension offers rule 2 to every second customer and rule 3 to foreign currencies only."""
    def offered(so_far, rule):
        return so_far & ((rule["id"] != 2) | (F.col("partner_id") % 2 == 0)) & ((rule["id"] != 3) | (F.col("currency_id") != 1))

    with hooks.extended(hooks.PROMOTION_OFFERED, offered):
        return applied(s).select("order_id", listed("applied"))


@query("promotions", SQL_PROMO + f"SELECT order_id, line_no, c10::DOUBLE AS promo_discount, {_TAKEN} AS taken_rules FROM d10 WHERE line_no IS NOT NULL")
def _(s):
    found = pr.promoted_lines(promo_lines(s, keyed=True), applied(s))
    return found.select("order_id", "line_no", F.col("promo_discount").cast("double").alias("promo_discount"), listed("taken_rules"))


@query("promotion_discount_lines", SQL_PROMO + " UNION ALL ".join(f"SELECT DISTINCT order_id, CAST({k} AS BIGINT) AS rule_id, (-p{k})::DOUBLE AS price_unit, CAST(1 AS BIGINT) AS qty FROM d10 WHERE p{k} IS NOT NULL" for k in (4, 6, 9)))
def _(s):
    return pr.discount_lines(applied(s))


@query("promotion_usage", SQL_PROMO + ", taken AS (SELECT DISTINCT order_id, partner_id, state, unnest([" + ", ".join(f"CASE WHEN v{k} THEN CAST({k} AS BIGINT) END" for k in _RULES) + "]) AS rule_id FROM d10) SELECT rule_id, partner_id, count(*) AS n_orders, min(order_id) AS first_order, max(order_id) AS last_order FROM taken WHERE rule_id IS NOT NULL AND state <> 'cancel' GROUP BY ALL")
def _(s):
    """Use of every rule by the orders that took it."""
    heads = s.orders().select(F.col("id").alias("order_id"), "partner_id", "state")
    # a plain explode would first test the list for rows, which works out the fold a second time
    taken = applied(s).select("order_id", F.explode_outer("applied").alias("rule_id")).filter("rule_id IS NOT NULL")
    return pr.promotion_usage(taken.join(heads, "order_id"))


# -- recommendation and history -----------------------------------------------------------

SQL_RECOMMEND = """
, me AS (SELECT o.company_id, p.commercial_partner_id AS root FROM sale_order o JOIN partner p ON p.id = o.partner_id WHERE o.id = 42),
fam AS (SELECT p.id FROM partner p, me WHERE contains('/' || p.parent_path, '/' || me.root || '/')),
oth AS (SELECT o.id FROM sale_order o, me WHERE o.company_id = me.company_id AND o.id <> 42 AND o.partner_id IN (SELECT id FROM fam) AND date_order >= DATE '2001-08-01' - 2160),
fnd AS (SELECT product_id, count(*) AS times, sum(qty_delivered) AS units FROM sale_order_line l JOIN product p ON p.id = l.product_id WHERE order_id IN (SELECT id FROM oth) AND qty_delivered <> 0 AND NOT is_delivery AND active AND sale_ok GROUP BY 1),
bk AS (SELECT product_id, qty FROM sale_order_line WHERE order_id = 42 AND NOT is_delivery AND display_type IS NULL),
top AS (SELECT * FROM fnd WHERE product_id NOT IN (SELECT product_id FROM bk) ORDER BY times DESC, units DESC, product_id LIMIT 15),
rec AS (SELECT product_id, times, units, 0 AS inc, FALSE AS inb FROM top UNION ALL SELECT bk.product_id, coalesce(times, 0), coalesce(units, 0), bk.qty, TRUE FROM bk LEFT JOIN fnd ON fnd.product_id = bk.product_id)
"""


def recommended(s: Star):
    products = s.products().withColumn("priority", (F.col("id") % 2).cast("string"))
    return rc.recommend_products(42, s.orders(), s.lines(), s.partners(), products, date(2001, 8, 1), months=72)


@query("recommend_products", SQL_RECOMMEND + "SELECT product_id, times AS times_delivered, units::DOUBLE AS units_delivered, inc::DOUBLE AS units_included, inb AS in_basket, CAST(product_id % 2 AS VARCHAR) AS priority FROM rec")
def _(s):
    return recommended(s)


@query("recommendation_actions", SQL_RECOMMEND + ", ch AS (SELECT *, product_id % 4 AS ch FROM rec) SELECT product_id, ch::DOUBLE AS units_chosen, CASE WHEN NOT inb AND ch > 0 THEN 'add' WHEN inb AND ch = 0 THEN 'remove' ELSE 'update' END AS action FROM ch WHERE (NOT inb AND ch > 0) OR (inb AND ch = 0) OR (inb AND ch <> inc)")
def _(s):
    chosen = recommended(s).withColumn("units_chosen", (F.col("product_id") % 4).cast(QTY))
    return rc.recommendation_actions(chosen).select("product_id", "units_chosen", "action")


#: Per open order: products of its customer group's other deliveries, best fifteen not in the basket, plus the basket.
SQL_RECOMMEND_ALL = """
, me AS (SELECT o.id AS order_id, o.company_id, o.partner_id, o.pricelist_id, p.commercial_partner_id AS root FROM sale_order o JOIN partner p ON p.id = o.partner_id WHERE o.state IN ('draft', 'sent')),
up AS (SELECT id, CAST(unnest(string_split(rtrim(parent_path, '/'), '/')) AS BIGINT) AS root FROM partner),
del AS (SELECT o.id AS oid, o.company_id, up.root, l.product_id, l.qty_delivered FROM sale_order o JOIN up ON up.id = o.partner_id JOIN sale_order_line l ON l.order_id = o.id JOIN product p ON p.id = l.product_id WHERE date_order >= DATE '2001-08-01' - 2160 AND qty_delivered <> 0 AND NOT is_delivery AND active AND sale_ok),
fnd AS (SELECT me.order_id, del.product_id, count(*) AS times, sum(qty_delivered) AS units FROM me JOIN del ON del.company_id = me.company_id AND del.root = me.root AND del.oid <> me.order_id GROUP BY ALL),
bk AS (SELECT l.order_id, product_id, qty FROM sale_order_line l JOIN me ON me.order_id = l.order_id WHERE NOT is_delivery AND display_type IS NULL),
top AS (SELECT * FROM fnd WHERE (order_id, product_id) NOT IN (SELECT (order_id, product_id) FROM bk) QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY times DESC, units DESC, product_id) <= 15),
rec AS (SELECT order_id, product_id, times, units, 0 AS inc, FALSE AS inb FROM top UNION ALL SELECT bk.order_id, bk.product_id, coalesce(times, 0), coalesce(units, 0), bk.qty, TRUE FROM bk LEFT JOIN fnd ON fnd.order_id = bk.order_id AND fnd.product_id = bk.product_id)
"""
SQL_RECOMMEND_COLUMNS = "rec.order_id, rec.product_id, times AS times_delivered, units::DOUBLE AS units_delivered, inc::DOUBLE AS units_included, inb AS in_basket, CAST(rec.product_id % 2 AS VARCHAR) AS priority"


def recommended_all(s: Star, **options):
    products = s.products().withColumn("priority", (F.col("id") % 2).cast("string"))
    orders = s.orders()
    return rc.recommend_for_orders(orders.filter("state IN ('draft', 'sent')"), orders, s.lines() if "prices" in options else s.keyed_lines(), s.partners(), products, date(2001, 8, 1), months=72, **options)


@query("recommend_for_orders", SQL_RECOMMEND_ALL + f"SELECT {SQL_RECOMMEND_COLUMNS}, CASE WHEN me.pricelist_id = 2 AND rec.product_id % 3 = 0 THEN round(list_price * 0.8, 2) ELSE list_price END::DOUBLE AS price_unit FROM rec JOIN me ON me.order_id = rec.order_id JOIN product p ON p.id = rec.product_id")
def _(s):
    """All open orders at the prices of their list; list 2 sells a third of the products at 80 %."""
    special = s.products().filter("id % 3 = 0").select(F.lit(2).cast("bigint").alias("pricelist_id"), F.col("id").alias("product_id"), F.round(F.col("list_price") * D("0.8"), 2).alias("price"))
    return recommended_all(s, prices=special)


@query("recommend_at_last_price", SQL_RECOMMEND_ALL + f""", lp AS (SELECT company_id, partner_id, product_id, arg_max(price_unit, (date_order, l.order_id, line_no)) AS price FROM sale_order_line l JOIN sale_order o ON o.id = l.order_id WHERE state NOT IN ('draft','sent','cancel') GROUP BY ALL)
SELECT {SQL_RECOMMEND_COLUMNS}, coalesce(price, 0)::DOUBLE AS price_unit FROM rec JOIN me ON me.order_id = rec.order_id LEFT JOIN lp ON lp.company_id = me.company_id AND lp.partner_id = me.partner_id AND lp.product_id = rec.product_id""")
def _(s):
    """All open orders at what their customer paid last."""
    return recommended_all(s, price_origin="last_sale_price")


@query("price_history", """, fam AS (SELECT p.id FROM partner p WHERE contains('/' || p.parent_path, '/' || (SELECT commercial_partner_id FROM partner WHERE id = 25) || '/'))
SELECT order_id, line_no, o.partner_id, o.state, CAST(CAST(o.date_order AS DATE) AS VARCHAR) AS day, price_unit::DOUBLE AS price_unit FROM sale_order_line l JOIN sale_order o ON o.id = l.order_id WHERE l.product_id = 56 AND NOT (order_id = 1 AND line_no = 1) AND o.state IN ('sale','done','draft','sent') AND (o.partner_id IN (SELECT id FROM fam)) ORDER BY o.date_order DESC, order_id DESC, line_no DESC LIMIT 20""")
def _(s):
    out = rc.price_history(56, 25, (1, 1), s.orders(), s.keyed_lines(), s.partners(), include_quotations=True)
    return out.select("order_id", "line_no", "partner_id", "state", F.col("date_order").cast("date").alias("day"), "price_unit")


@query("price_histories", """, up AS (SELECT id, CAST(unnest(string_split(rtrim(parent_path, '/'), '/')) AS BIGINT) AS root FROM partner),
past AS (SELECT up.root, l.product_id, l.order_id, l.line_no, o.partner_id, o.state, o.date_order, price_unit FROM sale_order_line l JOIN sale_order o ON o.id = l.order_id JOIN up ON up.id = o.partner_id WHERE o.state IN ('sale','done','draft','sent')),
x AS (SELECT l.order_id, l.line_no, l.product_id, past.order_id AS past_order, past.line_no AS past_line, past.partner_id AS past_partner, past.state, past.price_unit,
    row_number() OVER (PARTITION BY l.order_id, l.line_no ORDER BY past.date_order DESC, past.order_id DESC, past.line_no DESC) AS place
  FROM sale_order_line l JOIN sale_order o ON o.id = l.order_id JOIN partner p ON p.id = o.partner_id JOIN past ON past.root = p.commercial_partner_id AND past.product_id = l.product_id AND (past.order_id <> l.order_id OR past.line_no <> l.line_no)
  WHERE o.state IN ('draft', 'sent'))
SELECT order_id, line_no, product_id, past_order, past_line, past_partner, state, price_unit::DOUBLE AS price_unit, place FROM x WHERE place <= 3""")
def _(s):
    """The three newest other sales of every line of the open orders, to the customer's group."""
    lines, orders = s.keyed_lines(), s.orders()
    heads = orders.filter("state IN ('draft', 'sent')").select(F.col("id").alias("order_id"), "partner_id")
    asked = lines.select("order_id", "line_no", "product_id").join(heads, "order_id")
    return rc.price_histories(asked, orders, lines, s.partners(), limit=3, include_quotations=True).drop("date_order")


@query("last_sale_price", "SELECT company_id, partner_id, product_id, arg_max(l.order_id, (date_order, l.order_id, line_no)) AS order_id, arg_max(price_unit, (date_order, l.order_id, line_no))::DOUBLE AS price_unit FROM sale_order_line l JOIN sale_order o ON o.id = l.order_id WHERE state NOT IN ('draft','sent','cancel') GROUP BY ALL")
def _(s):
    return rc.last_sale_price(s.orders(), s.keyed_lines())


@query("subtree_child_of", "SELECT o.id, o.partner_id FROM sale_order o JOIN partner p ON p.id = o.partner_id WHERE contains('/' || p.parent_path, '/25/') OR contains('/' || p.parent_path, '/60/')")
def _(s):
    roots = rows(s.spark, "id bigint", [(25,), (60,)])
    return rc.subtree_child_of(s.orders().select("id", "partner_id"), "partner_id", s.partners(), roots)


@query("subtree_child_of_categories", "SELECT order_id, line_no, product_id FROM sale_order_line l JOIN product p ON p.id = l.product_id WHERE contains('/' || p.parent_path, '/12/')")
def _(s):
    goods = s.products().select(F.col("id").alias("product_id"), "categ_id")
    facts = s.keyed_lines().select("order_id", "line_no", "product_id").join(goods, "product_id")
    return rc.subtree_child_of(facts, "categ_id", s.categories(), rows(s.spark, "id bigint", [(12,)])).select("order_id", "line_no", "product_id")


@query("commercial_partner", "SELECT o.id, p.commercial_partner_id FROM sale_order o LEFT JOIN partner p ON p.id = o.partner_id")
def _(s):
    return s.orders().select("id", "partner_id").join(s.partners().select(F.col("id").alias("partner_id"), "commercial_partner_id"), "partner_id", "left").drop("partner_id")


@query("customer_code", """, cc AS (SELECT p.id AS product_id, c.id AS partner_id, arg_min('C' || c.id || '-' || k, k) AS code, arg_min(k * 5, k) AS mq FROM product p JOIN partner c ON c.id = p.id % 50 * 5 OR c.id = p.id % 40, (VALUES (1),(2)) v(k) GROUP BY 1, 2)
SELECT l.order_id, l.line_no, coalesce(a.code, b.code, '') AS customer_code, coalesce(a.mq, b.mq)::DOUBLE AS min_qty FROM sale_order_line l JOIN sale_order o ON o.id = l.order_id JOIN partner p ON p.id = o.partner_id LEFT JOIN cc a ON a.product_id = l.product_id AND a.partner_id = o.partner_id LEFT JOIN cc b ON b.product_id = l.product_id AND b.partner_id = p.commercial_partner_id""")
def _(s):
    who = F.explode(F.array_distinct(F.array(F.col("id") % 50 * 5, F.col("id") % 40)))
    base = s.products().select(F.col("id").alias("product_id"), who.alias("partner_id"))
    k = F.explode(F.array(F.lit(1), F.lit(2)))
    codes = base.select("*", k.alias("sequence")).select(
        "product_id", "partner_id", "sequence", F.concat(F.lit("C"), F.col("partner_id").cast("string"), F.lit("-"), F.col("sequence").cast("string")).alias("code"),
        (F.col("sequence") * 5).cast(QTY).alias("min_qty"),
    )
    heads = s.orders().select(F.col("id").alias("order_id"), "partner_id").join(s.partners().select(F.col("id").alias("partner_id"), "commercial_partner_id"), "partner_id")
    return ln.customer_code(s.keyed_lines().select("order_id", "line_no", "product_id").join(heads, "order_id"), codes).select("order_id", "line_no", "customer_code", "min_qty")


# -- lines --------------------------------------------------------------------------------


@query("line_number", "SELECT order_id, line_no, row_number() OVER (PARTITION BY order_id ORDER BY sequence, line_no) AS line_number FROM sale_order_line WHERE display_type IS NULL")
def _(s):
    return ln.line_number(s.keyed_lines()).select("order_id", "line_no", "line_number")


@query("serial_no", "SELECT order_id, line_no, CASE WHEN display_type IS NULL THEN sum(CASE WHEN display_type IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY order_id ORDER BY sequence, line_no ROWS UNBOUNDED PRECEDING)::BIGINT ELSE 0 END AS serial_no FROM sale_order_line")
def _(s):
    return ln.serial_no(s.keyed_lines()).select("order_id", "line_no", "serial_no")


@query("related_so_sequence", """, k AS (SELECT order_id // 3 AS move_id, (order_id // 3) * 10 + line_no % 4 AS il, order_id, 'SO' || order_id AS on_, line_no FROM sale_order_line),
m AS (SELECT move_id, min(order_id) <> max(order_id) AS many FROM k GROUP BY 1), g AS (SELECT move_id, il, count(*) AS n, string_agg(on_ || '/' || line_no, ', ' ORDER BY line_no, on_) AS t, min(line_no) AS f FROM k GROUP BY 1, 2)
SELECT move_id, il AS invoice_line_id, CASE WHEN many OR n > 1 THEN t ELSE CAST(f AS VARCHAR) END AS related_so_sequence FROM g JOIN m USING (move_id)""")
def _(s):
    move = F.floor(F.col("order_id") / 3).cast("bigint")
    links = s.keyed_lines().select(
        move.alias("move_id"), (move * 10 + F.col("line_no") % 4).alias("invoice_line_id"), "order_id", F.concat(F.lit("SO"), F.col("order_id").cast("string")).alias("order_name"), F.col("line_no").alias("number")
    )
    return ln.related_so_sequence(links)


@query("next_sequence", "SELECT order_id, max(sequence) + 1 AS next_sequence FROM sale_order_line GROUP BY 1")
def _(s):
    return ln.next_sequence(s.lines())


@query("shift_template_lines", ", t AS (SELECT o.id AS order_id, o.id % 3 + k AS sequence, p.id AS product_id FROM sale_order o, (VALUES (1),(2),(4)) v(k), product p WHERE p.id = k AND o.state = 'draft'), e AS (SELECT order_id, max(sequence) AS top FROM sale_order_line GROUP BY 1) SELECT t.order_id, product_id, sequence - min(sequence) OVER (PARTITION BY t.order_id) + coalesce(top, 0) + 1 AS sequence FROM t LEFT JOIN e ON e.order_id = t.order_id")
def _(s):
    k = F.explode(F.array(*[F.lit(x).cast("bigint") for x in (1, 2, 4)]))
    template = s.orders().filter("state = 'draft'").select(F.col("id").alias("order_id"), k.alias("product_id")).withColumn("sequence", F.col("order_id") % 3 + F.col("product_id"))
    return ln.shift_template_lines(template, s.lines().select("order_id", "sequence")).select("order_id", "product_id", "sequence")


@query("lot_numbers", """, z AS (SELECT order_id, line_no, 'SO' || order_id AS on_, CASE WHEN product_id % 4 = 0 THEN 'SO' || order_id || '-' || printf('%03d', product_id % 20) WHEN product_id % 4 = 1 THEN 'X' || product_id END AS lot, product_id % 3 <> 0 AS au, sequence FROM sale_order_line),
tp AS (SELECT order_id, max(CASE WHEN regexp_matches(replace(lot, on_ || '-', ''), '^[0-9]+$') THEN CAST(replace(lot, on_ || '-', '') AS BIGINT) ELSE 0 END) AS top FROM z WHERE lot IS NOT NULL GROUP BY 1)
SELECT z.order_id, line_no, on_ || '-' || printf('%03d', coalesce(top, 0) + row_number() OVER (PARTITION BY z.order_id ORDER BY sequence, line_no)) AS lot_name FROM z LEFT JOIN tp USING (order_id) WHERE au AND lot IS NULL""")
def _(s):
    name = F.concat(F.lit("SO"), F.col("order_id").cast("string"))
    pid = F.col("product_id")
    lines = s.keyed_lines().select(
        "order_id", "line_no", "sequence", name.alias("order_name"), (pid % 3 != 0).alias("auto_lot"),
        F.when(pid % 4 == 0, F.format_string("%s-%03d", name, pid % 20)).when(pid % 4 == 1, F.concat(F.lit("X"), pid.cast("string"))).alias("lot_name"),
    )
    return ln.lot_numbers(lines).select("order_id", "line_no", "lot_name")


@query("revision_chain", "SELECT id, max(id) OVER (PARTITION BY revision_group, company_id) AS current_revision_id, count(*) OVER (PARTITION BY revision_group, company_id) AS revisions, CASE WHEN id <> max(id) OVER (PARTITION BY revision_group, company_id) THEN 'cancel' ELSE state END AS state_after FROM sale_order")
def _(s):
    return ln.revision_chain(s.orders()).select("id", "current_revision_id", "revisions", "state_after")


@query("attached_products", """, l AS (SELECT order_id, line_no, product_id, CASE WHEN line_no % 6 = 5 THEN 0 ELSE qty END AS qty FROM sale_order_line WHERE display_type IS NULL),
w AS (SELECT order_id, line_no AS parent_line_no, a AS product_id, qty AS wq FROM l JOIN (SELECT id AS pid, unnest([id + 1, id + 2]) AS a FROM product WHERE id % 10 = 0) t ON t.pid = l.product_id),
h AS (SELECT order_id, line_no AS parent_line_no, product_id + 1 + line_no % 3 AS product_id, qty * (1 + order_id % 2) AS cq FROM l WHERE product_id % 10 = 0 AND line_no % 4 <> 0)
SELECT order_id, parent_line_no, product_id, CASE WHEN wq IS NULL OR (wq = 0 AND cq IS NOT NULL) THEN 'remove' WHEN cq IS NULL THEN 'add' WHEN cq <> wq THEN 'update' ELSE 'keep' END AS action FROM w FULL JOIN h USING (order_id, parent_line_no, product_id) WHERE NOT (coalesce(wq = 0, FALSE) AND cq IS NULL)
UNION ALL SELECT order_id, NULL, product_id, 'remove' FROM l WHERE product_id % 100 = 7""")
def _(s):
    qty = F.when(F.col("line_no") % 6 == 5, F.lit(0)).otherwise(F.col("qty")).cast(QTY)
    lines = s.keyed_lines().filter("display_type IS NULL").select("order_id", "line_no", "product_id", qty.alias("qty"))
    links = s.products().filter("id % 10 = 0").select(F.col("id").alias("product_id"), F.explode(F.array(F.col("id") + 1, F.col("id") + 2)).alias("attached_product_id"))
    held = lines.filter("product_id % 10 = 0 AND line_no % 4 <> 0").select(
        "order_id", F.col("line_no").alias("parent_line_no"), (F.col("product_id") + 1 + F.col("line_no") % 3).alias("product_id"), (F.col("qty") * (1 + F.col("order_id") % 2)).cast(QTY).alias("qty")
    )
    lost = lines.filter("product_id % 100 = 7").select("order_id", F.lit(None).cast("bigint").alias("parent_line_no"), "product_id", "qty")
    return ln.attached_products(lines, links, held.unionByName(lost)).select("order_id", "parent_line_no", "product_id", "action")


SET_LINES = [(k, n, (k * 7 + n * 3) % 200, D(n), D(10 * n)) for k in range(3) for n in range(1, 6)]


@query("product_set_expand", """, sl AS (SELECT k, n, (k * 7 + n * 3) % 200 AS pid FROM range(0, 3) a(k), range(1, 6) b(n)), rq AS (SELECT id AS order_id, id % 3 AS k, id % 4 + 1 AS q FROM sale_order WHERE state = 'draft'),
w AS (SELECT order_id, rq.k AS set_id, n, pid, q FROM rq JOIN sl ON sl.k = rq.k WHERE NOT EXISTS (SELECT 1 FROM sale_order_line l WHERE l.order_id = rq.order_id AND l.product_id = pid)), e AS (SELECT order_id, max(sequence) AS top FROM sale_order_line GROUP BY 1)
SELECT w.order_id, set_id, pid AS product_id, (n * q)::DOUBLE AS qty, (10 * n)::DOUBLE AS price_unit, coalesce(top, 0) + row_number() OVER (PARTITION BY w.order_id, set_id ORDER BY n) AS sequence FROM w LEFT JOIN e ON e.order_id = w.order_id""")
def _(s):
    asks = s.orders().filter("state = 'draft'").select(F.col("id").alias("order_id"), (F.col("id") % 3).alias("set_id"), (F.col("id") % 4 + 1).cast("decimal(9,2)").alias("set_qty"))
    sets = rows(s.spark, "set_id bigint, position bigint, product_id bigint, qty decimal(9,2), price_unit decimal(18,2)", SET_LINES)
    return ln.product_set_expand(asks, sets, s.lines().select("order_id", "product_id", "sequence"))


@query("elaboration_merge", """, x AS (SELECT order_id, product_id % 200 AS product_id, sum(quantity) AS eq FROM stock_move WHERE dest_usage = 'customer' AND state = 'done' GROUP BY 1, 2),
f AS (SELECT order_id, product_id, arg_min(qty, line_no) AS q, arg_min(sequence, line_no) AS sq FROM sale_order_line GROUP BY 1, 2), la AS (SELECT order_id, max(sequence) AS top FROM sale_order_line GROUP BY 1)
SELECT x.order_id, x.product_id, (coalesce(q, 0) + eq)::DOUBLE AS qty, CASE WHEN q IS NULL THEN coalesce(top, 0) + 1 ELSE sq END AS sequence, CASE WHEN q IS NULL THEN 'create' ELSE 'update' END AS action FROM x LEFT JOIN f USING (order_id, product_id) LEFT JOIN la ON la.order_id = x.order_id""")
def _(s):
    extra = s.stock_moves().filter("dest_usage = 'customer' AND state = 'done'").select("order_id", (F.col("product_id") % 200).alias("product_id"), F.col("quantity").alias("qty"))
    return ln.elaboration_merge(s.keyed_lines().select("order_id", "line_no", "product_id", "sequence", "qty"), extra)


def bookings(s: Star):
    states = F.array(*[F.lit(x) for x in ("pending", "canceled", "confirmed", "scheduled")])
    base = s.keyed_lines().select("order_id", "line_no", F.explode(F.sequence(F.lit(1), (F.col("product_id") % 6 + 1).cast("int"))).alias("n"))
    return base.select(
        ((F.col("order_id") * 100 + F.col("line_no")) * 10 + F.col("n")).alias("id"), "order_id", "line_no",
        F.element_at(states, ((F.col("order_id") + F.col("n")) % 4 + 1).cast("int")).alias("state"),
    )


SQL_BOOKINGS = ", bk AS (SELECT (order_id * 100 + line_no) * 10 + n AS id, order_id, line_no, CASE (order_id + n) % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'canceled' WHEN 2 THEN 'confirmed' ELSE 'scheduled' END AS state FROM sale_order_line, range(1, 7) r(n) WHERE n <= product_id % 6 + 1)"


@query("booking_sync", SQL_BOOKINGS + """, t AS (SELECT order_id, line_no, CASE WHEN product_id % 8 = 4 OR o.state = 'cancel' THEN 0 ELSE CAST(floor(qty / 10) AS BIGINT) END AS want FROM sale_order_line l JOIN sale_order o ON o.id = l.order_id WHERE product_id % 8 = 4 OR o.state IN ('cancel','sale')),
rk AS (SELECT bk.*, want, row_number() OVER (PARTITION BY bk.order_id, bk.line_no ORDER BY CASE bk.state WHEN 'confirmed' THEN 100 WHEN 'scheduled' THEN 200 WHEN 'pending' THEN 300 ELSE 400 END, id) AS pl FROM bk JOIN t USING (order_id, line_no)),
hv AS (SELECT order_id, line_no, count(*) AS have FROM bk GROUP BY 1, 2)
SELECT order_id, line_no, id AS booking_id, CASE WHEN pl <= want THEN 'keep' ELSE 'cancel' END AS action FROM rk UNION ALL SELECT order_id, line_no, NULL, 'create' FROM (SELECT t.order_id, t.line_no, want - coalesce(have, 0) AS miss FROM t LEFT JOIN hv USING (order_id, line_no)) q, range(1, 10) r(n) WHERE n <= miss""")
def _(s):
    heads = s.orders().select(F.col("id").alias("order_id"), "state")
    lines = s.keyed_lines().join(heads, "order_id").select(
        "order_id", "line_no", "state", (F.col("product_id") % 8 != 4).alias("bookable"), F.floor(F.col("qty") / 10).alias("qty")
    )
    return ln.booking_sync(lines, bookings(s))


@query("booking_count", SQL_BOOKINGS + "SELECT order_id, count(*) AS bookings FROM bk GROUP BY 1")
def _(s):
    return ln.booking_count(bookings(s))


@query("booking_state", SQL_BOOKINGS + "SELECT bk.id, CASE WHEN bk.state = 'confirmed' AND o.state <> 'sale' THEN 'scheduled' ELSE bk.state END AS state FROM bk JOIN sale_order o ON o.id = order_id")
def _(s):
    heads = s.orders().select(F.col("id").alias("order_id"), F.col("state").alias("order_state"))
    return bookings(s).join(heads, "order_id").select("id", ln.booking_state(F.col("state"), F.col("order_state")).alias("state"))


@query("order_priority", "SELECT order_id, max(CAST(product_id % 3 AS VARCHAR)) AS priority FROM sale_order_line GROUP BY 1")
def _(s):
    return ln.order_priority(s.lines().withColumn("priority", (F.col("product_id") % 3).cast("string")))


