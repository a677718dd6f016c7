"""Commission queries."""

from __future__ import annotations

from datetime import date
from decimal import Decimal as D

from pyspark.sql import functions as F

from tallygrid.functions.labels import CONFIRMED
from tallygrid.operators import commission as c
from tallygrid.operators import hooks
from tallygrid.session import staged
from tallygrid.sources.rules import rows
from tallygrid.sources.star import Star
from workload.registry import query

# Commissions typed in by people: id, name, type, percent, base, invoice state, settlement type.
COMMISSIONS = [
    (1, "fixed 20 net", "fixed", D(20), "net_amount", "paid", None),
    (2, "fixed 10 gross", "fixed", D(10), "gross_amount", "open", "sale_invoice"),
    (3, "section net", "section", D(0), "net_amount", "paid", None),
    (4, "formula", "formula", D(0), "gross_amount", "open", None),
]
BANDS = [(3, 1, D(1), D(5000), D(10)), (3, 2, D(5000), D(20000), D(15)), (3, 3, D(25000), D(60000), D(20))]
FORMULAS = {4: "price_subtotal * 0.05 + CASE WHEN qty > 25 THEN 100 ELSE 0 END"}
# (pricelist, product, commission): price rules that carry their own commission.
RULE_COMMISSIONS = [(1, p, 2) for p in range(0, 40)] + [(2, p, 1) for p in range(20, 60)]

SQL_RULES = """
, commission AS (SELECT CAST(id AS BIGINT) AS id, kind, CAST(pct AS DECIMAL(9,2)) AS fix_qty, base, invoice_state, settlement_type FROM (VALUES
  (1,'fixed',20,'net_amount','paid',NULL),(2,'fixed',10,'gross_amount','open','sale_invoice'),(3,'section',0,'net_amount','paid',NULL),(4,'formula',0,'gross_amount','open',NULL)) v(id,kind,pct,base,invoice_state,settlement_type)),
band AS (SELECT * FROM (VALUES (3,1,1,5000,10),(3,2,5000,20000,15),(3,3,25000,60000,20)) v(commission_id,pos,lo,hi,pct)),
rule AS (SELECT CAST(1 AS BIGINT) AS pricelist_id, p AS product_id, CAST(2 AS BIGINT) AS commission_id FROM range(0,40) r(p) UNION ALL SELECT 2, p, 1 FROM range(20,60) r(p))
"""


def amount_sql(source: str, refund: str = "FALSE") -> str:
    """Commission amount over a table with commission_id, commission_free, price_subtotal, standard_price, qty."""
    return f"""SELECT x.*, CASE WHEN {refund} THEN -a ELSE a END AS amount FROM (
  SELECT b.*, CAST(CASE WHEN commission_free OR kind IS NULL THEN 0
    WHEN kind = 'formula' THEN round(price_subtotal * 0.05 + CASE WHEN qty > 25 THEN 100 ELSE 0 END, 2)
    WHEN kind = 'fixed' THEN round(basis * fix_qty * 0.01, 2)
    ELSE round(basis * coalesce((SELECT CAST(arg_min(pct, pos) AS DECIMAL(9,2)) FROM band WHERE band.commission_id = b.commission_id AND lo <= basis AND basis <= hi), 0) * 0.01, 2) END AS DECIMAL(18,2)) AS a
  FROM (SELECT s.*, k.kind, k.fix_qty, CASE WHEN k.base = 'net_amount' THEN greatest(price_subtotal - CAST(round(standard_price * qty, 2) AS DECIMAL(18,2)), 0) ELSE price_subtotal END AS basis
        FROM ({source}) s LEFT JOIN commission k ON k.id = s.commission_id) b) x"""


ASSIGN_SQL = """
, able AS (SELECT u.id, u.commission_id FROM users u JOIN commission k ON k.id = u.commission_id WHERE settlement_type IS NULL OR settlement_type = 'sale_invoice'),
serving AS (SELECT pa.partner_id, pa.agent_id, a.commission_id FROM partner_agent pa JOIN able a ON a.id = pa.agent_id),
direct AS (SELECT l.*, o.pricelist_id, s.agent_id AS who, s.commission_id AS own, p.commission_free, p.standard_price FROM sale_order_line l JOIN sale_order o ON o.id = l.order_id JOIN product p ON p.id = l.product_id
  JOIN serving s ON s.partner_id = o.partner_id WHERE NOT p.commission_free),
fallback AS (SELECT l.*, o.pricelist_id, u.id AS who, u.commission_id AS own, p.commission_free, p.standard_price FROM sale_order_line l JOIN sale_order o ON o.id = l.order_id JOIN product p ON p.id = l.product_id JOIN users u ON u.id = o.user_id AND u.salesman_as_agent
  WHERE p.commission_free OR o.partner_id NOT IN (SELECT partner_id FROM serving)),
assigned AS (SELECT a.* EXCLUDE (agent_id), a.who AS agent_id, coalesce(r.commission_id, own) AS commission_id FROM (SELECT * FROM direct UNION ALL SELECT * FROM fallback) a LEFT JOIN rule r ON r.pricelist_id = a.pricelist_id AND r.product_id = a.product_id)
"""
INVOICE_AGENT_SQL = """
, agent_line AS (""" + amount_sql(
    "SELECT l.*, u.commission_id, p.commission_free, p.standard_price, p.categ_id, p.uom_id AS product_uom_id, l.order_id % 10 = 0 AS settled FROM invoice_line l JOIN users u ON u.id = l.agent_id JOIN product p ON p.id = l.product_id WHERE l.display_type IS NULL",
    "move_type = 'out_refund'",
) + ")"


def start_sql(day: str, freq: str = "settlement") -> str:
    return f"""CAST(CASE {freq} WHEN 'monthly' THEN date_trunc('month', {day}) WHEN 'quaterly' THEN date_trunc('quarter', {day}) WHEN 'annual' THEN date_trunc('year', {day})
 WHEN 'biweekly' THEN CASE WHEN day({day}) >= 16 THEN date_trunc('month', {day}) + INTERVAL 15 DAY ELSE date_trunc('month', {day}) END
 ELSE CASE WHEN month({day}) > 6 THEN date_trunc('year', {day}) + INTERVAL 6 MONTH ELSE date_trunc('year', {day}) END END AS DATE)"""


def end_sql(start: str, freq: str = "settlement") -> str:
    return f"""CAST(CASE {freq} WHEN 'monthly' THEN {start} + INTERVAL 1 MONTH - INTERVAL 1 DAY WHEN 'quaterly' THEN {start} + INTERVAL 3 MONTH - INTERVAL 1 DAY WHEN 'annual' THEN {start} + INTERVAL 12 MONTH - INTERVAL 1 DAY
 WHEN 'biweekly' THEN CASE WHEN day({start}) = 1 THEN {start} + INTERVAL 14 DAY ELSE last_day({start}) - INTERVAL 1 DAY END
 ELSE {start} + INTERVAL 6 MONTH - INTERVAL 1 DAY END AS DATE)"""


CUT = "DATE '1998-05-20'"
DUE_SQL = SQL_RULES + INVOICE_AGENT_SQL + f"""
, due AS (SELECT *, {end_sql('date_from')} AS date_to FROM (SELECT a.*, u.settlement, {start_sql('a.invoice_date')} AS date_from FROM agent_line a JOIN users u ON u.id = a.agent_id JOIN commission k2 ON k2.id = a.commission_id
  WHERE NOT settled AND move_state = 'posted' AND NOT (k2.invoice_state = 'paid' AND payment_state NOT IN ('in_payment','paid','reversed')) AND a.invoice_date < {start_sql(CUT)})),
old AS (SELECT CAST(id AS BIGINT) AS sid, CAST(agent AS BIGINT) AS agent, CAST(comp AS BIGINT) AS comp, CAST(cur AS BIGINT) AS cur, CAST(f AS DATE) AS f FROM (VALUES (71,1,1,2,'1997-01-16'),(72,2,0,1,'1997-04-01'),(73,5,3,3,'1996-02-01')) v(id,agent,comp,cur,f)),
settlement AS (SELECT agent_id, company_id, currency_id, date_from, date_to, count(*) AS line_count, sum(amount) AS amount FROM due GROUP BY ALL)
"""
OPEN_SETTLEMENTS = [
    (71, 1, 1, 2, date(1997, 1, 16), date(1997, 1, 30), "settled"),
    (72, 2, 0, 1, date(1997, 4, 1), date(1997, 6, 30), "settled"),
    (73, 5, 3, 3, date(1996, 2, 1), date(1996, 2, 29), "settled"),
    (74, 0, 3, 3, date(1996, 2, 1), date(1996, 2, 29), "cancel"),
]


def commissions(s: Star):
    return rows(
        s.spark,
        "id bigint, name string, commission_type string, fix_qty decimal(9,2), amount_base_type string, invoice_state string, settlement_type string",
        COMMISSIONS,
    )


def bands(s: Star):
    return rows(
        s.spark,
        "commission_id bigint, position int, amount_from decimal(18,2), amount_to decimal(18,2), percent decimal(9,2)",
        BANDS,
    )


def assigned(s: Star):
    headers = s.orders().select(F.col("id").alias("order_id"), "partner_id", "user_id", "pricelist_id")
    rules = rows(s.spark, "pricelist_id bigint, product_id bigint, commission_id bigint", RULE_COMMISSIONS)
    return c.assign_agents(
        s.lines().drop("agent_id"), headers, s.partner_agents(), s.users(), s.products(), commissions(s), "sale_invoice", rules
    )


def invoice_agent_lines(s: Star, keyed=False):
    goods = s.products().select(F.col("id").alias("product_id"), "commission_free", "standard_price", "categ_id", F.col("uom_id").alias("product_uom_id"))
    agents = s.users().select(F.col("id").alias("agent_id"), "commission_id")
    lines = (s.keyed_invoice_lines() if keyed else s.invoice_lines()).filter("display_type IS NULL").join(goods, "product_id").join(agents, "agent_id")
    lines = lines.withColumn("settled", F.col("order_id") % 10 == 0)
    return c.commission_amount(lines, commissions(s), bands(s), FORMULAS, F.col("move_type") == "out_refund")


def settlements(s: Star):
    due = c.settleable_lines(invoice_agent_lines(s), s.users(), commissions(s), date(1998, 5, 20))
    known = rows(
        s.spark,
        "id bigint, agent_id bigint, company_id bigint, currency_id bigint, date_from date, date_to date, state string",
        OPEN_SETTLEMENTS,
    )
    return c.settle_commissions(due, known)


@query("commission_status", """SELECT l.order_id, l.sequence, l.product_id, CASE WHEN p.commission_free THEN 'Comm. free' WHEN n = 0 THEN 'No commission agents' WHEN n = 1 THEN '1 commission agent' ELSE n || ' commission agents' END AS status
FROM sale_order_line l JOIN product p ON p.id = l.product_id JOIN sale_order o ON o.id = l.order_id LEFT JOIN (SELECT c.id, count(pa.agent_id) AS n FROM partner c LEFT JOIN partner_agent pa ON pa.partner_id = c.id GROUP BY c.id) a ON a.id = o.partner_id""")
def _(s):
    counts = s.partner_agents().groupBy("partner_id").agg(F.count("*").alias("n"))
    heads = s.orders().select(F.col("id").alias("order_id"), "partner_id").join(counts, "partner_id", "left")
    goods = s.products().select(F.col("id").alias("product_id"), "commission_free")
    lines = s.lines().select("order_id", "sequence", "product_id").join(goods, "product_id").join(heads, "order_id")
    return lines.select("order_id", "sequence", "product_id", c.commission_status(F.coalesce("n", F.lit(0)), F.col("commission_free")).alias("status"))


@query("assign_agents", SQL_RULES + ASSIGN_SQL + "SELECT order_id, sequence, product_id, agent_id, commission_id, commission_free, qty::DOUBLE AS qty FROM assigned")
def _(s):
    return assigned(s).select("order_id", "sequence", "product_id", "agent_id", "commission_id", "commission_free", "qty")


@query("commission_amount", SQL_RULES + ASSIGN_SQL + ", r AS (" + amount_sql("SELECT * FROM assigned") + ") SELECT order_id, sequence, product_id, agent_id, commission_id, amount::DOUBLE AS amount FROM r")
def _(s):
    goods = s.products().select(F.col("id").alias("product_id"), "standard_price")
    lines = assigned(s).join(goods, "product_id")
    return c.commission_amount(lines, commissions(s), bands(s), FORMULAS).select(
        "order_id", "sequence", "product_id", "agent_id", "commission_id", "amount"
    )


@query("hook_commission_amount", SQL_RULES + ASSIGN_SQL + ", r AS (" + amount_sql("SELECT * FROM assigned") + ") SELECT order_id, sequence, product_id, agent_id, commission_id, CASE WHEN qty > 30 THEN least(amount, 500) ELSE amount END::DOUBLE AS amount FROM r")
def _(s):
    """An extension limits the commission of large lines to 500."""
    goods = s.products().select(F.col("id").alias("product_id"), "standard_price")
    with hooks.extended(hooks.COMMISSION_AMOUNT, lambda amount: F.when(F.col("qty") > 30, F.least(amount, F.lit(500))).otherwise(amount)):
        paid = c.commission_amount(assigned(s).join(goods, "product_id"), commissions(s), bands(s), FORMULAS)
    return paid.select("order_id", "sequence", "product_id", "agent_id", "commission_id", "amount")


@query("commission_formula", SQL_RULES + INVOICE_AGENT_SQL + "SELECT order_id, sequence, product_id, qty::DOUBLE AS qty, amount::DOUBLE AS amount FROM agent_line WHERE commission_id = 4")
def _(s):
    return invoice_agent_lines(s).filter("commission_id = 4").select("order_id", "sequence", "product_id", "qty", "amount")


@query("band_join", SQL_RULES + "SELECT l.order_id, l.sequence, l.product_id, coalesce((SELECT arg_min(pct, pos) FROM band WHERE lo <= price_subtotal AND price_subtotal <= hi), 0)::DOUBLE AS percent FROM sale_order_line l")
def _(s):
    facts = s.lines().withColumn("commission_id", F.lit(3).cast("bigint"))
    return c.band_join(facts, bands(s), "price_subtotal").select("order_id", "sequence", "product_id", "percent")


@query("commission_totals", SQL_RULES + ASSIGN_SQL + ", r AS (" + amount_sql("SELECT * FROM assigned") + ") SELECT order_id, sum(amount)::DOUBLE AS commission_total, string_agg(DISTINCT CAST(agent_id AS VARCHAR), ',' ORDER BY CAST(agent_id AS VARCHAR)) AS agents FROM r GROUP BY order_id")
def _(s):
    goods = s.products().select(F.col("id").alias("product_id"), "standard_price")
    lines = c.commission_amount(assigned(s).join(goods, "product_id"), commissions(s), bands(s), FORMULAS)
    return c.commission_totals(lines)


@query("settle_commissions", DUE_SQL + "SELECT agent_id, company_id, currency_id, CAST(date_from AS VARCHAR) AS date_from, CAST(date_to AS VARCHAR) AS date_to, line_count, amount::DOUBLE AS amount, sid AS settlement_id FROM settlement LEFT JOIN old ON agent = agent_id AND comp = company_id AND cur = currency_id AND f = date_from")
def _(s):
    return settlements(s)


def _run_sql(name: str, cut: str, earlier: str) -> str:
    """Lines due before ``cut`` and not in ``earlier``, a table of settled (order_id, line_no)."""
    return f""", {name} AS (SELECT *, {end_sql('date_from')} AS date_to FROM (
  SELECT a.order_id, a.line_no, a.agent_id, a.company_id, a.currency_id, a.amount, u.settlement, {start_sql('a.invoice_date')} AS date_from
  FROM agent_line a JOIN users u ON u.id = a.agent_id JOIN commission k2 ON k2.id = a.commission_id
  WHERE NOT EXISTS (FROM {earlier} e WHERE e.order_id = a.order_id AND e.line_no = a.line_no) AND move_state = 'posted'
    AND NOT (k2.invoice_state = 'paid' AND payment_state NOT IN ('in_payment','paid','reversed')) AND a.invoice_date < {start_sql(cut)}))"""


_KEY = "agent_id || '/' || company_id || '/' || currency_id || '/' || date_from || '/' || date_to || '/'"
# the first run's settlements of every fifth agent are cancelled before the second; the third repeats the second
RUNS_SQL = (
    SQL_RULES + INVOICE_AGENT_SQL + ", nothing AS (SELECT order_id, line_no FROM agent_line WHERE FALSE)"
    + _run_sql("run1", "DATE '1997-05-20'", "nothing")
    + ", live1 AS (SELECT order_id, line_no FROM run1 WHERE agent_id % 5 <> 2)"
    + _run_sql("run2", "DATE '1998-05-20'", "live1")
    + ", seen AS (SELECT agent_id, company_id, currency_id, date_from, count(*) AS n FROM run1 GROUP BY ALL)"
    + f""" SELECT 2::BIGINT AS run, {_KEY} || CASE WHEN s.n IS NOT NULL AND agent_id % 5 = 2 THEN 1 ELSE 0 END AS settlement_id, count(*) AS line_count, sum(amount)::DOUBLE AS amount
FROM run2 LEFT JOIN seen s USING (agent_id, company_id, currency_id, date_from) GROUP BY ALL
UNION ALL SELECT 1, {_KEY} || 0, count(*), sum(amount)::DOUBLE FROM run1 GROUP BY ALL"""
)


@query("settlement_runs", RUNS_SQL)
def _(s):
    """Three runs one after another: the second also takes the lines of cancelled settlements, the third adds nothing."""
    keys = ["order_id", "line_no"]
    needed = ["agent_id", "commission_id", "company_id", "currency_id", "product_id", "invoice_date", "move_state", "payment_state", "amount"]
    facts = staged(invoice_agent_lines(s, keyed=True).select(*keys, *needed), "agent-lines")
    none = rows(s.spark, "id string, agent_id bigint, company_id bigint, currency_id bigint, date_from date, date_to date, state string", [])
    no_lines = rows(s.spark, "settlement_id string, order_id bigint, line_no bigint", [])
    names = ["settlement_id", *keys]
    first = staged(c.settlement_run(facts, s.users(), commissions(s), none, no_lines, date(1997, 5, 20), keys), "run")
    cancelled = F.when(F.col("agent_id") % 5 == 2, F.lit("cancel")).otherwise(F.lit("settled"))
    made = staged(c.settlements_of(first).withColumn("state", cancelled), "settlements")
    second = staged(c.settlement_run(facts, s.users(), commissions(s), made, first.select(names), date(1998, 5, 20), keys), "run")
    both = staged(made.unionByName(c.settlements_of(second)).distinct(), "settlements")
    lines = first.select(names).unionByName(second.select(names))
    third = c.settlement_run(facts, s.users(), commissions(s), both, lines, date(1998, 5, 20), keys)
    runs = [r.groupBy(F.lit(n).cast("bigint").alias("run"), "settlement_id").agg(F.count("*").alias("line_count"), F.sum("amount").alias("amount")) for n, r in ((1, first), (2, second), (3, third))]
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


@query("settlement_period_runs", DUE_SQL + "SELECT agent_id, settlement, CAST(date_from AS VARCHAR) AS date_from, CAST(date_to AS VARCHAR) AS date_to, CAST(min(invoice_date) AS VARCHAR) AS first_invoice, CAST(max(invoice_date) AS VARCHAR) AS last_invoice, count(*) AS line_count FROM due GROUP BY ALL")
def _(s):
    due = c.settleable_lines(invoice_agent_lines(s), s.users(), commissions(s), date(1998, 5, 20))
    return due.groupBy("agent_id", "settlement", "date_from", "date_to").agg(
        F.min("invoice_date").alias("first_invoice"), F.max("invoice_date").alias("last_invoice"), F.count("*").alias("line_count")
    )


@query("settlement_totals", DUE_SQL + "SELECT agent_id, sum(amount)::DOUBLE AS total FROM due GROUP BY agent_id")
def _(s):
    due = c.settleable_lines(invoice_agent_lines(s), s.users(), commissions(s), date(1998, 5, 20))
    return c.settlement_totals(due.withColumnRenamed("amount", "settled_amount"), "agent_id")


@query("settlement_invoices", DUE_SQL + "SELECT company_id, currency_id, agent_id, CAST(date_from AS VARCHAR) AS date_from, CAST(date_to AS VARCHAR) AS date_to, CAST(1 AS BIGINT) AS line_count, CASE WHEN amount < 0 THEN 'in_refund' ELSE 'in_invoice' END AS move_type, abs(amount)::DOUBLE AS amount_total FROM settlement JOIN users u ON u.id = agent_id WHERE agent_type = 'agent'")
def _(s):
    return c.settlement_invoices(settlements(s), s.users())


@query("settlement_invoices_grouped", DUE_SQL + "SELECT company_id, currency_id, agent_id, count(*) AS line_count, CASE WHEN sum(amount) < 0 THEN 'in_refund' ELSE 'in_invoice' END AS move_type, abs(sum(amount))::DOUBLE AS amount_total FROM settlement JOIN users u ON u.id = agent_id WHERE agent_type = 'agent' GROUP BY ALL")
def _(s):
    return c.settlement_invoices(settlements(s), s.users(), grouped=True)


@query("settlement_state", DUE_SQL + "SELECT agent_id, company_id, currency_id, CAST(date_from AS VARCHAR) AS date_from, CASE WHEN agent_id % 4 = 0 THEN 'cancel' WHEN agent_id % 4 = 1 THEN 'settled' WHEN agent_id % 4 = 2 THEN 'settled' ELSE 'invoiced' END AS state FROM settlement")
def _(s):
    key = F.concat_ws("/", "agent_id", "company_id", "currency_id", "date_from")
    base = settlements(s).select(key.alias("id"), "agent_id", "company_id", "currency_id", "date_from",
        F.when(F.col("agent_id") % 4 == 0, F.lit("cancel")).otherwise(F.lit("settled")).alias("state"))
    bills = base.filter("agent_id % 4 <> 1").select(F.col("id").alias("settlement_id"),
        F.when(F.col("agent_id") % 4 == 2, F.lit("cancel")).otherwise(F.lit("posted")).alias("bill_state"))
    return c.settlement_state(base, bills).drop("id")


ANALYSIS_KEYS = ("partner_id", "move_state", "invoice_date", "company_id", "agent_id", "categ_id", "product_id", "product_uom_id", "settled", "commission_id")


@query(
    "commission_analysis",
    SQL_RULES + INVOICE_AGENT_SQL + """SELECT partner_id, move_state, CAST(invoice_date AS VARCHAR) AS invoice_date, company_id, agent_id, categ_id, product_id, product_uom_id, settled, commission_id,
 min(order_id) AS id, sum(qty)::DOUBLE AS quantity, round(sum(price_unit)::DOUBLE / count(price_unit), 4) AS price_unit, sum(price_subtotal)::DOUBLE AS price_subtotal,
 sum(CASE WHEN move_type = 'out_refund' THEN price_subtotal ELSE -price_subtotal END)::DOUBLE AS balance, round(sum(fix_qty)::DOUBLE / count(fix_qty), 4) AS percentage, sum(amount)::DOUBLE AS amount FROM agent_line GROUP BY ALL""",
)
def _(s):
    sign = F.when(F.col("move_type") == "out_refund", F.col("price_subtotal")).otherwise(-F.col("price_subtotal"))
    facts = invoice_agent_lines(s).withColumn("balance", sign)
    rates = commissions(s).select(F.col("id").alias("commission_id"), F.col("fix_qty").alias("percentage"))
    return c.commission_analysis(facts.join(rates, "commission_id", "left"), ANALYSIS_KEYS)


@query("commission_fact_join", SQL_RULES + INVOICE_AGENT_SQL + "SELECT order_id, line_no, agent_id, commission_id, categ_id, product_id, product_uom_id, fix_qty::DOUBLE AS percentage, price_subtotal::DOUBLE AS price_subtotal FROM agent_line")
def _(s):
    lines = s.keyed_invoice_lines().filter("display_type IS NULL")
    agents = s.users().select(F.col("id").alias("agent_id"), "commission_id")
    agent_lines = lines.select("order_id", "line_no", "agent_id").join(agents, "agent_id")
    facts = c.commission_fact_join(agent_lines, lines.drop("agent_id"), commissions(s), s.products(), ["order_id", "line_no"])
    return facts.select("order_id", "line_no", "agent_id", "commission_id", "categ_id", "product_id", "product_uom_id", "percentage", "price_subtotal")


MONTHS = [f"1997-{m:02d}" for m in range(1, 13)]


def pivot_sql(row: str, source: str, value: str, day: str) -> str:
    cells = ", ".join(f"coalesce(sum({value}) FILTER (strftime({day}, '%Y-%m') = '{m}'), 0)::DOUBLE AS m_{m.replace('-', '_')}" for m in MONTHS)
    return f"SELECT CASE WHEN grouping({row}) = 1 THEN 'Total' ELSE CAST({row} AS VARCHAR) END AS {row}, {cells}, sum({value})::DOUBLE AS total FROM ({source}) GROUP BY ROLLUP ({row})"


@query("commission_pivot", SQL_RULES + INVOICE_AGENT_SQL + pivot_sql("agent_id", "SELECT * FROM agent_line WHERE year(invoice_date) = 1997", "amount", "invoice_date"))
def _(s):
    facts = invoice_agent_lines(s).filter(F.col("invoice_date").between(date(1997, 1, 1), date(1997, 12, 31)))
    return c.month_pivot(facts, "agent_id", "invoice_date", "amount", MONTHS)


@query("sale_pivot", pivot_sql("product_id", "SELECT l.product_id, l.price_subtotal, o.date_order FROM sale_order_line l JOIN sale_order o ON o.id = l.order_id WHERE state IN ('sale','done') AND year(date_order) = 1997 AND display_type IS NULL", "price_subtotal", "date_order"))
def _(s):
    year = (F.col("date_order") >= F.lit(date(1997, 1, 1))) & (F.col("date_order") < F.lit(date(1998, 1, 1)))
    heads = s.orders().filter(F.col("state").isin(*CONFIRMED) & year).select(F.col("id").alias("order_id"), "date_order")
    sold = s.lines().filter("display_type IS NULL").select("order_id", "product_id", "price_subtotal").join(heads, "order_id")
    return c.month_pivot(sold, "product_id", "date_order", "price_subtotal", MONTHS)


@query("line_pivot", "SELECT product_id, CAST(CAST(date_order AS DATE) AS VARCHAR) AS day, sum(price_subtotal)::DOUBLE AS price_subtotal, sum(qty)::DOUBLE AS qty FROM sale_order_line l JOIN sale_order o ON o.id = l.order_id WHERE display_type IS NULL GROUP BY 1, 2")
def _(s):
    heads = s.orders().select(F.col("id").alias("order_id"), F.col("date_order").cast("date").alias("day"))
    sold = s.lines().filter("display_type IS NULL").select("order_id", "product_id", "price_subtotal", "qty").join(heads, "order_id")
    return sold.groupBy("product_id", "day").agg(F.sum("price_subtotal").alias("price_subtotal"), F.sum("qty").alias("qty"))
