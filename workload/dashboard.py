"""Dashboard queries."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from tallygrid.functions.dates import Window
from tallygrid.functions.labels import CONFIRMED, state_label, translated
from tallygrid.operators import dashboard as d
from tallygrid.plans import payload
from tallygrid.plans.ranking import top_n_with_others
from tallygrid.sources.rules import rows
from tallygrid.sources.star import Star
from workload.prelude import ratio_sql
from workload.registry import ORACLES, query

YEAR = d.SalesFilter(Window(date(1997, 1, 1), date(1997, 12, 31)), (0, 1, 2, 3))
BY_PRODUCT = d.SalesFilter(YEAR.window, YEAR.company_ids, product_ids=tuple(range(0, 60)))

SQL_BASE = """
, f AS (SELECT *, amount_total AS amount FROM sale_order WHERE company_id IN (0,1,2,3) AND date_order >= '1997-01-01' AND date_order <= '1997-12-31 23:59:59'),
c AS (SELECT * FROM f WHERE state IN ('sale','done')),
prev AS (SELECT *, amount_total AS amount FROM sale_order WHERE company_id IN (0,1,2,3) AND date_order >= '1996-01-02' AND date_order <= '1996-12-31 23:59:59'),
fl AS (SELECT f.id, f.name AS order_name, f.partner_id, f.date_order, f.state, f.team_id, f.user_id, l.* FROM f JOIN sale_order_line l ON l.order_id = f.id WHERE l.display_type IS NULL),
cl AS (SELECT * FROM fl WHERE state IN ('sale','done')),
fp AS (SELECT * FROM fl WHERE product_id BETWEEN 0 AND 59)
"""

# Targets typed in for the year: (company, scope, owner, month, amount, active).
TARGETS = [
    (c, scope, owner, date(1997, m, 1), Decimal(20000 * (owner + 1)), owner % 4 != 3)
    for c in (0, 1)
    for scope in ("team", "user")
    for owner in range(0, 9)
    for m in (1, 6, 12)
]
SQL_TARGETS = SQL_BASE + f"""
, target AS (SELECT c AS company_id, s AS scope, CAST(o AS BIGINT) AS owner_id, m AS month, CAST(20000 * (o + 1) AS DECIMAL(18,2)) AS amount
  FROM (VALUES (0),(1)) a(c), (VALUES ('team'),('user')) b(s), range(0, 9) r(o), (VALUES (1),(6),(12)) e(m) WHERE o % 4 <> 3),
plan AS (SELECT scope, owner_id, sum(amount) AS target_amount FROM target GROUP BY ALL),
actual AS (SELECT 'team' AS scope, team_id AS owner_id, sum(amount) AS v FROM c GROUP BY ALL UNION ALL SELECT 'user', user_id, sum(amount) FROM c GROUP BY ALL),
tl AS (SELECT scope || '_' || p.owner_id AS key, scope AS owner_type, owner_id AS record_id, target_amount::DOUBLE AS target_amount, coalesce(v, 0)::DOUBLE AS actual_amount,
  {ratio_sql("coalesce(v, 0) * 100", "target_amount")} AS achievement FROM plan p LEFT JOIN actual a USING (scope, owner_id))
"""


def _targets(s: Star):
    return rows(
        s.spark,
        "company_id bigint, scope string, owner_id bigint, month_start date, target_amount decimal(18,2), active boolean",
        TARGETS,
    )


def _base(s: Star, flt=YEAR, states=()):
    return d.sales(s.orders(), s.lines(), flt, states)


def _sold(s: Star, flt=YEAR):
    return d.line_filter(s.orders(), s.lines(), flt, CONFIRMED)


def _headline(s: Star, flt=YEAR):
    metrics = d.core_metrics(_base(s, flt))
    lines = d.target_lines(_targets(s), _base(s, flt), flt)
    return d.headline(metrics, d.target_overall(lines), d.profitability(_sold(s, flt)))


@query("order_filter", SQL_BASE + "SELECT id, state, amount_total::DOUBLE AS amount_total FROM c WHERE (user_id = 3 OR create_uid = 3)")
def _(s):
    flt = d.SalesFilter(YEAR.window, YEAR.company_ids, viewer=3)
    return d.order_filter(s.orders(), flt, CONFIRMED).select("id", "state", "amount_total")


@query("line_filter", SQL_BASE + "SELECT order_id, product_id, sequence, qty::DOUBLE AS qty, price_total::DOUBLE AS price_total FROM fp WHERE team_id IN (1,2,3)")
def _(s):
    flt = d.SalesFilter(YEAR.window, YEAR.company_ids, team_ids=(1, 2, 3), product_ids=BY_PRODUCT.product_ids)
    return d.line_filter(s.orders(), s.lines(), flt).select("order_id", "product_id", "sequence", "qty", "price_total")


@query("filter_normalize", SQL_BASE + "SELECT count(*) AS orders_count, min(id) AS first_id, max(id) AS last_id FROM f WHERE team_id IN (1, 7)")
def _(s):
    raw = {"date_from": "1997-12-31", "date_to": "1997-01-01", "team_ids": ["1", "x", None, 7], "refresh_interval_ms": "17"}
    flt = d.SalesFilter.clean(raw, date(1998, 1, 1), YEAR.company_ids)
    return d.order_filter(s.orders(), flt).agg(
        F.count("*").alias("orders_count"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )


METRICS = """coalesce(sum(amount) FILTER (state IN ('sale','done')), 0)::DOUBLE AS confirmed_revenue,
 coalesce(sum(amount) FILTER (state IN ('draft','sent')), 0)::DOUBLE AS quotation_revenue,
 count(*) FILTER (state IN ('sale','done')) AS confirmed_orders, count(*) FILTER (state IN ('draft','sent')) AS quotation_orders"""
DERIVED = """round(coalesce(confirmed_revenue / nullif(confirmed_orders, 0), 0), 4) AS average_order_value,
 round(coalesce(confirmed_orders * 100.0::DOUBLE / nullif(confirmed_orders + quotation_orders, 0), 0), 4) AS win_rate"""


@query("core_metrics", SQL_BASE + f", m AS (SELECT {METRICS}, count(*) AS all_orders FROM f) SELECT *, {DERIVED} FROM m")
def _(s):
    return d.core_metrics(_base(s))


@query(
    "core_metrics_by_product",
    SQL_BASE + f", o AS (SELECT id, state, sum(price_total) AS amount FROM fp GROUP BY ALL), m AS (SELECT {METRICS}, (SELECT count(*) FROM f) AS all_orders FROM o) SELECT *, {DERIVED} FROM m",
)
def _(s):
    return d.core_metrics(_base(s, BY_PRODUCT), d.order_filter(s.orders(), BY_PRODUCT))


HEAD = f"""
, m AS (SELECT {METRICS} FROM f), m2 AS (SELECT *, {DERIVED} FROM m),
pl AS (SELECT price_subtotal, round(price_subtotal - purchase_price * qty, 2) AS margin FROM cl),
p AS (SELECT sum(price_subtotal)::DOUBLE AS revenue, sum(margin)::DOUBLE AS margin_amount FROM pl),
tt AS (SELECT sum(target_amount) AS overall FROM tl),
h AS (SELECT m2.*, overall, round(confirmed_revenue * 100.0 / overall, 4) AS target_achievement, margin_amount AS approx_margin, round(margin_amount * 100.0 / revenue, 4) AS approx_margin_rate, revenue FROM m2, tt, p),
k AS (SELECT unnest([
 {{'key':'confirmed_revenue','label':'Confirmed Revenue','value':confirmed_revenue,'type':'currency'}},
 {{'key':'quotation_revenue','label':'Quotation Pipeline','value':quotation_revenue,'type':'currency'}},
 {{'key':'confirmed_orders','label':'Confirmed Orders','value':confirmed_orders::DOUBLE,'type':'number'}},
 {{'key':'average_order_value','label':'Average Order Value','value':average_order_value,'type':'currency'}},
 {{'key':'win_rate','label':'Win Rate','value':win_rate,'type':'percentage'}},
 {{'key':'target_achievement','label':'Target Achievement','value':target_achievement,'type':'percentage'}},
 {{'key':'approx_margin','label':'Approx. Margin','value':approx_margin,'type':'currency'}},
 {{'key':'approx_margin_rate','label':'Approx. Margin Rate','value':approx_margin_rate,'type':'percentage'}}], recursive := true) FROM h)
"""


@query("kpi_cards", SQL_TARGETS + HEAD + "SELECT key, label, value, type FROM k")
def _(s):
    return d.kpi_cards(_headline(s))


@query(
    "comparison_cards",
    SQL_TARGETS
    + HEAD
    + f""", pm AS (SELECT {METRICS} FROM prev), pm2 AS (SELECT *, {DERIVED} FROM pm),
pp AS (SELECT sum(price_subtotal)::DOUBLE AS revenue, sum(round(price_subtotal - purchase_price * qty, 2))::DOUBLE AS margin_amount FROM sale_order_line l JOIN prev ON l.order_id = prev.id WHERE display_type IS NULL AND state IN ('sale','done')),
pv AS (SELECT unnest([{{'key':'confirmed_revenue','v':confirmed_revenue}},{{'key':'confirmed_orders','v':confirmed_orders::DOUBLE}},{{'key':'average_order_value','v':average_order_value}},{{'key':'win_rate','v':win_rate}},
 {{'key':'approx_margin_rate','v':round(margin_amount * 100.0 / revenue, 4)}},{{'key':'target_achievement','v':0.0::DOUBLE}}], recursive := true) FROM pm2, pp)
SELECT key, label, type, value AS current_value, v AS previous_value, round(value - v, 4) AS difference,
 CASE WHEN v = 0 THEN CASE WHEN value = 0 THEN 0.0 ELSE 100.0 END ELSE round((value - v) * 100.0 / v, 4) END::DOUBLE AS difference_pct FROM k JOIN pv USING (key)""",
)
def _(s):
    return d.comparison_cards(_headline(s), _headline(s, YEAR.previous()))


@query(
    "dashboard_alerts",
    SQL_TARGETS
    + HEAD
    + """SELECT level, title FROM (
 SELECT 'warning' AS level, 'No confirmed orders' AS title, confirmed_orders = 0 AS hit FROM h UNION ALL
 SELECT 'info', 'Quotations are stacking up', quotation_orders > confirmed_orders * 1.5 AND quotation_orders > 3 FROM h UNION ALL
 SELECT 'warning', 'Low win rate', win_rate < 35 AND quotation_orders + confirmed_orders > 3 FROM h UNION ALL
 SELECT 'danger', 'Target is behind plan', overall <> 0 AND target_achievement < 60 FROM h UNION ALL
 SELECT 'warning', 'Low margin', approx_margin_rate < 15 AND revenue <> 0 FROM h) WHERE hit""",
)
def _(s):
    return d.dashboard_alerts(_headline(s))


DAYS = ", cal AS (SELECT CAST(unnest(generate_series(DATE '1997-01-01', DATE '1997-12-31', INTERVAL 1 DAY)) AS DATE) AS day)"


@query("daily_revenue", SQL_BASE + DAYS + "SELECT CAST(day AS VARCHAR) AS date, strftime(day, '%d %b') AS label, coalesce(sum(amount), 0)::DOUBLE AS value FROM cal LEFT JOIN c ON CAST(date_order AS DATE) = day GROUP BY day")
def _(s):
    return d.daily_revenue(_base(s, states=CONFIRMED), YEAR.window)


@query("daily_orders", SQL_BASE + DAYS + "SELECT CAST(day AS VARCHAR) AS date, strftime(day, '%d %b') AS label, count(c.id) AS value FROM cal LEFT JOIN c ON CAST(date_order AS DATE) = day GROUP BY day")
def _(s):
    return d.daily_orders(_base(s, states=CONFIRMED), YEAR.window)


@query(
    "average_order_trend",
    SQL_BASE + DAYS + "SELECT CAST(day AS VARCHAR) AS date, strftime(day, '%d %b') AS label, round(coalesce(sum(amount)::DOUBLE / nullif(count(c.id), 0), 0), 4) AS value FROM cal LEFT JOIN c ON CAST(date_order AS DATE) = day GROUP BY day",
)
def _(s):
    return d.average_order_trend(d.order_filter(s.orders(), YEAR, CONFIRMED), YEAR.window)


@query("monthly_revenue", SQL_BASE + "SELECT CAST(CAST(date_trunc('month', date_order) AS DATE) AS VARCHAR) AS date, strftime(date_trunc('month', date_order), '%b %Y') AS label, sum(amount)::DOUBLE AS value FROM c GROUP BY date_trunc('month', date_order)")
def _(s):
    return d.monthly_revenue(_base(s, states=CONFIRMED))


@query(
    "weekday_heatmap",
    SQL_BASE + "SELECT key, label, coalesce(sum(amount), 0)::DOUBLE AS value FROM (VALUES (1::BIGINT,'Mon'),(2,'Tue'),(3,'Wed'),(4,'Thu'),(5,'Fri'),(6,'Sat'),(7,'Sun')) w(key, label) LEFT JOIN c ON isodow(date_order) = key GROUP BY key, label",
)
def _(s):
    return d.weekday_heatmap(_base(s, states=CONFIRMED))


@query(
    "quotation_funnel",
    SQL_BASE + f""", m AS (SELECT {METRICS} FROM f)
SELECT 'quotations' AS key, 'Open Quotations' AS label, quotation_orders AS value, round(quotation_orders * 100.0::DOUBLE / (quotation_orders + confirmed_orders), 4) AS pct FROM m
UNION ALL SELECT 'confirmed', 'Confirmed Orders', confirmed_orders, round(confirmed_orders * 100.0::DOUBLE / (quotation_orders + confirmed_orders), 4) FROM m""",
)
def _(s):
    return d.quotation_funnel(d.core_metrics(_base(s)))


LABELS = "CASE state WHEN 'draft' THEN 'Draft Quotation' WHEN 'sent' THEN 'Sent Quotation' WHEN 'sale' THEN 'Sales Order' WHEN 'done' THEN 'Locked Order' WHEN 'cancel' THEN 'Cancelled' ELSE state END"


@query("state_distribution", SQL_BASE + f"SELECT state AS key, {LABELS} AS label, count(*) AS value FROM f GROUP BY state")
def _(s):
    return d.state_distribution(d.order_filter(s.orders(), YEAR))


@query("state_label", f"SELECT id, {LABELS} AS label FROM sale_order")
def _(s):
    return s.orders().select("id", state_label("state").alias("label"))


@query("label_translate", "SELECT id, coalesce(nullif(name_fr, ''), nullif(name_en, ''), 'No Team') AS label FROM team")
def _(s):
    return s.teams().select("id", translated("names", "fr_FR", "No Team").alias("label"))


def others(groups: str, measures: tuple[str, ...]) -> str:
    lead = measures[0]
    shown = ", ".join(f"{m}::DOUBLE AS {m}" if m != "orders_count" else m for m in measures)
    rest = ", ".join(f"sum({m})::DOUBLE AS {m}" if m != "orders_count" else f"sum({m})::BIGINT AS {m}" for m in measures)
    return f""", g AS ({groups}), r AS (SELECT *, row_number() OVER (ORDER BY {lead} DESC, record_id) AS rk, count(*) OVER () AS n FROM g)
SELECT record_id, label, {shown} FROM r WHERE rk <= 9 OR n <= 10
UNION ALL SELECT 0, 'Others', {rest} FROM r WHERE rk > 9 AND n > 10 HAVING count(*) > 0"""


@query("team_performance", SQL_BASE + others("SELECT coalesce(t.id, 0) AS record_id, coalesce(nullif(name_en, ''), 'No Team') AS label, sum(amount) AS value, count(*) AS orders_count FROM c LEFT JOIN team t ON t.id = team_id GROUP BY t.id, name_en", ("value", "orders_count")))
def _(s):
    return d.team_performance(_base(s, states=CONFIRMED), s.teams())


@query("team_performance_by_product", SQL_BASE + others("SELECT coalesce(t.id, 0) AS record_id, coalesce(nullif(name_en, ''), 'No Team') AS label, sum(price_total) AS value, count(DISTINCT fp.id) AS orders_count FROM fp LEFT JOIN team t ON t.id = team_id WHERE state IN ('sale','done') GROUP BY t.id, name_en", ("value", "orders_count")))
def _(s):
    return d.team_performance(_base(s, BY_PRODUCT, CONFIRMED), s.teams())


@query("salesperson_performance", SQL_BASE + others("SELECT coalesce(u.id, 0) AS record_id, coalesce(u.name, 'No Salesperson') AS label, sum(amount) AS value, count(*) AS orders_count FROM c LEFT JOIN users u ON u.id = c.user_id GROUP BY u.id, u.name", ("value", "orders_count")))
def _(s):
    return d.salesperson_performance(_base(s, states=CONFIRMED), s.users())


@query("top_customers", SQL_BASE + others("SELECT coalesce(p.id, 0) AS record_id, coalesce(p.name, 'No Customer') AS label, sum(amount) AS value, count(*) AS orders_count FROM c LEFT JOIN partner p ON p.id = c.partner_id GROUP BY p.id, p.name", ("value", "orders_count")))
def _(s):
    return d.top_customers(_base(s, states=CONFIRMED), s.partners())


@query("top_products", SQL_BASE + others("SELECT coalesce(p.id, 0) AS record_id, coalesce(p.name, 'No Product') AS label, sum(price_total) AS value, sum(qty) AS quantity FROM cl LEFT JOIN product p ON p.id = product_id GROUP BY p.id, p.name", ("value", "quantity")))
def _(s):
    return d.top_products(_sold(s), s.products())


@query("top_categories", SQL_BASE + others("SELECT coalesce(categ_id, 0) AS record_id, coalesce('Category ' || categ_id, 'No Category') AS label, sum(price_total) AS value FROM cl LEFT JOIN product p ON p.id = product_id GROUP BY categ_id", ("value",)))
def _(s):
    return d.top_categories(_sold(s), s.products())


@query("top_n_with_others", others("SELECT product_id AS record_id, CAST(product_id AS VARCHAR) AS label, sum(qty) AS value FROM sale_order_line GROUP BY product_id", ("value",)))
def _(s):
    groups = s.lines().groupBy("product_id").agg(F.sum("qty").alias("value"))
    return top_n_with_others(groups.select(F.col("product_id").alias("record_id"), F.col("product_id").cast("string").alias("label"), "value"))


@query(
    "pivot_summary",
    SQL_BASE + f""", g AS (SELECT coalesce(t.id, 0) AS record_id, coalesce(nullif(name_en, ''), 'No Team') AS label, count(*) FILTER (state IN ('draft','sent')) AS quotations,
 count(*) FILTER (state IN ('sale','done')) AS confirmed_orders, coalesce(sum(amount) FILTER (state IN ('sale','done')), 0) AS rev FROM f LEFT JOIN team t ON t.id = team_id GROUP BY t.id, name_en)
SELECT * EXCLUDE (rev), rev::DOUBLE AS revenue, {ratio_sql("rev", "confirmed_orders")} AS average_order_value, {ratio_sql("confirmed_orders * 100", "confirmed_orders + quotations")} AS conversion FROM g""",
)
def _(s):
    return d.pivot_summary(_base(s), s.teams())


@query("profitability", SQL_BASE + "SELECT sum(price_subtotal)::DOUBLE AS revenue, sum(round(price_subtotal - purchase_price * qty, 2))::DOUBLE AS margin_amount, " + ratio_sql("sum(round(price_subtotal - purchase_price * qty, 2)) * 100", "sum(price_subtotal)") + " AS margin_rate FROM cl")
def _(s):
    return d.profitability(_sold(s))


@query("scan_optional_column", SQL_BASE + "SELECT sum(price_subtotal)::DOUBLE AS revenue, sum(price_subtotal)::DOUBLE AS margin_amount, 100.0::DOUBLE AS margin_rate FROM cl")
def _(s):
    return d.profitability(_sold(s).drop("purchase_price"))


@query("margin_top_products", SQL_BASE + "SELECT p.id AS record_id, p.name AS label, sum(round(price_subtotal - purchase_price * qty, 2))::DOUBLE AS value FROM cl JOIN product p ON p.id = product_id GROUP BY ALL ORDER BY sum(round(price_subtotal - purchase_price * qty, 2)) DESC, 1 LIMIT 10")
def _(s):
    return d.margin_by_product(_sold(s), s.products())


@query("margin_top_customers", SQL_BASE + "SELECT p.id AS record_id, p.name AS label, sum(round(price_subtotal - purchase_price * qty, 2))::DOUBLE AS value FROM cl JOIN partner p ON p.id = partner_id GROUP BY ALL ORDER BY sum(round(price_subtotal - purchase_price * qty, 2)) DESC, 1 LIMIT 10")
def _(s):
    return d.margin_by_customer(_sold(s), s.partners())


@query("low_margin_orders", SQL_BASE + ", g AS (SELECT order_id AS record_id, order_name AS label, sum(price_subtotal) AS rev, sum(round(price_subtotal - purchase_price * qty, 2)) AS m FROM cl GROUP BY ALL HAVING sum(price_subtotal) > 0) SELECT record_id, label, rev::DOUBLE AS revenue, m::DOUBLE AS margin_amount, " + ratio_sql("m * 100", "rev") + " AS margin_rate FROM g")
def _(s):
    return d.low_margin_orders(_sold(s))


@query("target_progress", SQL_TARGETS + "SELECT * FROM tl")
def _(s):
    return d.target_progress(d.target_lines(_targets(s), _base(s), YEAR))


@query("recent_orders", SQL_BASE + "SELECT f.id, f.name, strftime(date_order, '%Y-%m-%d %H:%M') AS date_order, state, coalesce(nullif(name_en, ''), 'No Team') AS team_name, p.name AS partner_name, coalesce(u.name, 'No Salesperson') AS salesperson_name, amount_total::DOUBLE AS amount_total, amount_untaxed::DOUBLE AS amount_untaxed FROM f LEFT JOIN team t ON t.id = f.team_id LEFT JOIN partner p ON p.id = f.partner_id LEFT JOIN users u ON u.id = f.user_id")
def _(s):
    return d.recent_orders(d.order_filter(s.orders(), YEAR), s.partners(), s.teams(), s.users())


@query("orders_grouped", SQL_BASE + "SELECT strftime(date_order, '%Y-%m') AS group_label, count(*) AS orders_count, sum(amount_total)::DOUBLE AS amount_total FROM f GROUP BY 1")
def _(s):
    return d.orders_grouped(d.recent_orders(d.order_filter(s.orders(), YEAR), s.partners(), s.teams(), s.users()), "month")


@query(
    "filter_options",
    """, o AS (SELECT 'teams' AS kind, id, coalesce(name_en, '') AS name FROM team UNION ALL SELECT 'salespeople', id, name FROM users
 UNION ALL SELECT 'products', id, name FROM product WHERE sale_ok AND active UNION ALL SELECT 'partners', id, name FROM partner)
SELECT kind, id, name FROM o""",
)
def _(s):
    return d.filter_options(s.teams(), s.users(), s.products(), s.partners())


@query(
    "order_enrich",
    "SELECT l.order_id, l.product_id, l.sequence, o.name AS order_name, p.name AS product_name, p.categ_id, coalesce(nullif(t.name_en, ''), 'No Team') AS team_name, u.name AS user_name, c.name AS partner_name, l.price_total::DOUBLE AS price_total FROM sale_order_line l JOIN sale_order o ON l.order_id = o.id LEFT JOIN product p ON p.id = l.product_id LEFT JOIN team t ON t.id = o.team_id LEFT JOIN users u ON u.id = o.user_id LEFT JOIN partner c ON c.id = o.partner_id",
)
def _(s):
    return d.order_enrich(s.orders(), s.lines(), s.products(), s.teams(), s.users(), s.partners())


PAYLOAD_KEYS = {
    "daily_revenue": "CAST(CAST(date_order AS DATE) AS VARCHAR)",
    "monthly_revenue": "CAST(CAST(date_trunc('month', date_order) AS DATE) AS VARCHAR)",
    "weekday_heatmap": "CAST(isodow(date_order) AS VARCHAR)",
    "team_performance": "CAST(coalesce(team_id, 0) AS VARCHAR)",
    "salesperson_performance": "CAST(coalesce(user_id, 0) AS VARCHAR)",
    "state_distribution": "state",
    "totals": "'all'",
}


@query(
    "dashboard_payload",
    SQL_BASE
    + ", w AS (SELECT 'current' AS period, * FROM f UNION ALL SELECT 'previous', * FROM prev), u AS ("
    + " UNION ALL ".join(f"SELECT period, '{k}' AS section, {v} AS key, state, amount FROM w" for k, v in PAYLOAD_KEYS.items())
    + """) SELECT period, section, key, count(*) AS orders_count, count(*) FILTER (state IN ('sale','done')) AS confirmed_orders, count(*) FILTER (state IN ('draft','sent')) AS quotation_orders,
 coalesce(sum(amount) FILTER (state IN ('sale','done')), 0)::DOUBLE AS confirmed_revenue, coalesce(sum(amount) FILTER (state IN ('draft','sent')), 0)::DOUBLE AS quotation_revenue FROM u GROUP BY period, section, key""",
)
def _(s):
    return payload.dashboard_payload(s.orders(), s.lines(), YEAR)


# section: key, label and up to three numbers of the query of that name, or of the one named first
BUNDLE = {
    "team_performance": ("record_id", "label", "value", "orders_count"),
    "salesperson_performance": ("record_id", "label", "value", "orders_count"),
    "top_customers": ("record_id", "label", "value", "orders_count"),
    "top_products": ("record_id", "label", "value", "quantity"),
    "top_categories": ("record_id", "label", "value"),
    "margin_top_products": ("record_id", "label", "value"),
    "margin_top_customers": ("record_id", "label", "value"),
    "kpis": ("key", "label", "value"),
    "comparison": ("key", "label", "current_value", "previous_value", "difference_pct"),
    "alerts": ("level", "title"),
    "quotation_funnel": ("key", "label", "value", "pct"),
    "state_distribution": ("key", "label", "value"),
    "daily_revenue": ("date", "label", "value"),
    "daily_orders": ("date", "label", "value"),
    "average_order_trend": ("date", "label", "value"),
    "monthly_revenue": ("date", "label", "value"),
    "weekday_heatmap": ("key", "label", "value"),
    "pivot_summary": ("record_id", "label", "revenue", "average_order_value", "conversion"),
    "profitability": ("'all'", "'all'", "revenue", "margin_amount", "margin_rate"),
    "low_margin_orders": ("record_id", "label", "revenue", "margin_amount", "margin_rate"),
    "target_progress": ("key", "owner_type", "actual_amount", "target_amount", "achievement"),
    "recent_orders": ("id", "partner_name", "amount_total", "amount_untaxed"),
}
_QUERY_OF = {"kpis": "kpi_cards", "comparison": "comparison_cards", "alerts": "dashboard_alerts"}


def _bundle_sql() -> str:
    """Every section from the SQL of its own query."""
    parts = []
    for section, columns in BUNDLE.items():
        key, label, *numbers = columns
        values = ", ".join(f"{n}::DOUBLE AS {c}" for n, c in zip([*numbers, "NULL", "NULL", "NULL"][:3], ("value", "second", "third"), strict=True))
        end = " ORDER BY date_order DESC, id DESC LIMIT 10" if section == "recent_orders" else ""
        parts.append(f"(SELECT '{section}' AS section, ({key})::VARCHAR AS key, ({label})::VARCHAR AS label, {values} FROM ({ORACLES[_QUERY_OF.get(section, section)]}){end})")
    return " UNION ALL ".join(parts)


@query("dashboard_bundle")
def _(s):
    return payload.dashboard_bundle(s.orders(), s.lines(), _targets(s), s.partners(), s.products(), s.teams(), s.users(), YEAR)


ORACLES["dashboard_bundle"] = _bundle_sql()
