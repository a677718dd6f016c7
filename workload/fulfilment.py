"""Delivery, procurement, invoicing, payment and blanket-order queries."""

from __future__ import annotations

from datetime import date
from decimal import Decimal as D

from pyspark.sql import functions as F

from tallygrid.functions.money import MONEY, QTY
from tallygrid.operators import blanket as b
from tallygrid.operators import fulfilment as f
from tallygrid.operators import hooks
from tallygrid.operators import invoicing as i
from tallygrid.plans.asof import asof_join, asof_rate, convert_currency, merge_asof
from tallygrid.sources.rules import rows
from tallygrid.sources.star import Star
from workload.pricing import SQL_UOM, uoms
from workload.prelude import ratio_sql
from workload.registry import query


def typed_lines(s: Star):
    return s.lines().join(s.products().select(F.col("id").alias("product_id"), "type"), "product_id")


def stated(s: Star, lines):
    heads = s.orders().select(F.col("id").alias("order_id"), "state", "partner_id", "currency_id", "warehouse_id", F.col("name").alias("order_name"), "workflow_id", "date_order")
    return lines.join(heads, "order_id")


@query("delivery_state", """, x AS (SELECT order_id, bool_and(qty_delivered >= qty) AS al, bool_or(qty_delivered <> 0) AS an FROM sale_order_line WHERE NOT is_delivery AND NOT (product_id % 13 = 0) GROUP BY 1)
SELECT id, state, CASE WHEN state IN ('draft','cancel') THEN NULL WHEN force_delivered OR coalesce(al, TRUE) THEN 'full' WHEN an THEN 'partial' ELSE 'pending' END AS delivery_state FROM sale_order LEFT JOIN x ON order_id = id""")
def _(s):
    return f.delivery_state(s.orders(), s.lines().withColumn("skip", F.col("product_id") % 13 == 0))


@query("delivery_state_v2", """, x AS (SELECT order_id, bool_or(type <> 'service') AS g, bool_or(type = 'service') AS sv, coalesce(bool_and(qty_delivered = 0) FILTER (type <> 'service'), TRUE) AS nd, coalesce(bool_or(qty_delivered < qty) FILTER (type <> 'service'), FALSE) AS sh FROM sale_order_line l JOIN product p ON p.id = product_id GROUP BY 1),
pk AS (SELECT id AS order_id, CASE id % 5 WHEN 1 THEN 'waiting' WHEN 2 THEN 'done' ELSE 'assigned' END AS st FROM sale_order WHERE id % 5 < 4),
y AS (SELECT o.id AS order_id, o.state, coalesce(g, FALSE) AS g, coalesce(sv, FALSE) AS sv, coalesce(nd, TRUE) AS nd, coalesce(sh, FALSE) AS sh, pk.st FROM sale_order o LEFT JOIN x ON x.order_id = o.id LEFT JOIN pk ON pk.order_id = o.id)
SELECT order_id, state, CASE WHEN NOT g AND sv AND state = 'sale' THEN 'delivered' WHEN st = 'waiting' THEN 'processing' WHEN st IS NULL AND NOT sv THEN 'nothing' WHEN nd THEN 'to_deliver' WHEN sh THEN 'partial' ELSE 'delivered' END AS delivery_status FROM y""")
def _(s):
    k = F.col("id") % 5
    picks = s.orders().filter("id % 5 < 4").select(
        F.col("id").alias("order_id"), F.when(k == 1, F.lit("waiting")).when(k == 2, F.lit("done")).otherwise(F.lit("assigned")).alias("state")
    )
    return f.delivery_state_v2(s.orders(), typed_lines(s), picks)


@query("all_qty_delivered", "SELECT order_id, bool_and(type = 'service' OR qty_delivered = qty) AS all_qty_delivered FROM sale_order_line JOIN product p ON p.id = product_id GROUP BY 1")
def _(s):
    return f.all_qty_delivered(typed_lines(s))


CANCELED = "CASE WHEN product_id % 4 = 1 THEN CAST(2 AS DECIMAL(18,4)) ELSE CAST(0 AS DECIMAL(18,4)) END"
SQL_REMAIN = f", z AS (SELECT l.*, o.state, {CANCELED} AS qc, greatest(qty - qty_delivered - {CANCELED}, 0) AS rem FROM sale_order_line l JOIN sale_order o ON o.id = l.order_id)"


def cancelling(s: Star):
    return stated(s, s.lines()).withColumn("qty_canceled", F.when(F.col("product_id") % 4 == 1, F.lit(2)).otherwise(F.lit(0)).cast(QTY))


@query("remaining_to_deliver", SQL_REMAIN + "SELECT order_id, sequence, product_id, rem::DOUBLE AS remaining, rem > 0 AND state IN ('sale','done') AS can_cancel FROM z")
def _(s):
    return f.remaining_to_deliver(cancelling(s)).select("order_id", "sequence", "product_id", "remaining", "can_cancel")


@query("cancel_remaining", SQL_REMAIN + ", w AS (SELECT *, rem > 0 AND state IN ('sale','done') AS c FROM z) SELECT order_id, sequence, product_id, CASE WHEN c THEN qty - qty_delivered ELSE qc END::DOUBLE AS qty_canceled_after, CASE WHEN c AND state = 'sale' THEN qty_delivered ELSE qty END::DOUBLE AS qty_after FROM w")
def _(s):
    return f.cancel_remaining(cancelling(s), decrease_ordered=True).select("order_id", "sequence", "product_id", "qty_canceled_after", "qty_after")


SQL_PROCURED = SQL_UOM + """
, mv AS (SELECT m.order_id, m.line_no, m.product_id, m.uom_id AS mu, sum(quantity * CASE WHEN dest_usage = 'customer' AND (NOT is_return OR to_refund) THEN 1 WHEN dest_usage <> 'customer' AND to_refund THEN -1 ELSE 0 END) AS q FROM stock_move m WHERE state <> 'cancel' AND NOT scrapped GROUP BY ALL),
pj AS (SELECT l.*, coalesce(CAST(mv.q / mf.factor * lf.factor AS DECIMAL(18,4)), 0) AS procured FROM sale_order_line l JOIN uom lf ON lf.id = l.uom_id LEFT JOIN mv ON mv.order_id = l.order_id AND mv.line_no = l.line_no AND mv.product_id = l.product_id LEFT JOIN uom mf ON mf.id = mv.mu),
pq AS (SELECT order_id, line_no, product_id, qty, commitment_date, ship_date, sum(procured) AS qp, qty - sum(procured) AS tp FROM pj GROUP BY order_id, line_no, product_id, qty, commitment_date, ship_date)
"""


@query("procured_join", SQL_PROCURED + "SELECT order_id, line_no, product_id, procured::DOUBLE AS procured FROM pj")
def _(s):
    return f.procured_join(s.keyed_lines(), s.stock_moves(), uoms(s)).select("order_id", "line_no", "product_id", "procured")


@query("qty_procured", SQL_PROCURED + "SELECT order_id, line_no, product_id, qty::DOUBLE AS qty, qp::DOUBLE AS qty_procured, tp::DOUBLE AS qty_to_procure FROM pq")
def _(s):
    return f.qty_procured(s.keyed_lines(), s.stock_moves(), uoms(s))


@query("has_pending_delivery", SQL_PROCURED + "SELECT o.id AS order_id, o.state, coalesce(bool_or(tp > 0), FALSE) AS pending FROM sale_order o LEFT JOIN (SELECT pq.* FROM pq JOIN product p ON p.id = pq.product_id WHERE p.type <> 'service') pq ON o.id = pq.order_id GROUP BY o.id, o.state")
def _(s):
    goods = s.products().filter("type <> 'service'").select(F.col("id").alias("product_id"))
    procured = f.qty_procured(s.keyed_lines(), s.stock_moves(), uoms(s)).join(goods, "product_id", "left_semi")
    return f.has_pending_delivery(procured, s.orders())


SQL_GROUPS = SQL_PROCURED + """
, gl AS (SELECT pq.*, o.name AS on_, o.partner_id, o.id % 10 AS batch, CASE WHEN product_id % 4 = 0 THEN o.warehouse_id END AS wh FROM pq JOIN sale_order o ON o.id = pq.order_id WHERE o.state IN ('sale','done') AND o.id % 12 <> 5),
gg AS (SELECT *, CASE WHEN commitment_date IS NOT NULL THEN 24 WHEN wh IS NOT NULL THEN 10 ELSE 8 END AS priority, CASE WHEN commitment_date IS NOT NULL THEN on_ || '/' || CAST(commitment_date - 2 AS VARCHAR) WHEN wh IS NOT NULL THEN on_ || '/W' || wh ELSE on_ END AS group_name, commitment_date - 2 AS dp FROM gl)
"""


def to_procure(s: Star):
    procured = f.qty_procured(s.keyed_lines(), s.stock_moves(), uoms(s), ["commitment_date", "ship_date"])
    lines = stated(s, procured).filter(F.col("state").isin("sale", "done"))
    return lines.select(
        "*",
        F.when(F.col("product_id") % 4 == 0, F.col("warehouse_id")).alias("line_warehouse_id"),
        (F.col("order_id") % 12 == 5).alias("blocked"),
        (F.col("order_id") % 10).alias("batch"),
    )


@query("procurement_groups", SQL_GROUPS + "SELECT order_id, CAST(priority AS BIGINT) AS priority, group_name, count(*) AS line_count, sum(tp)::DOUBLE AS qty_to_procure FROM gg GROUP BY ALL")
def _(s):
    return f.procurement_group_totals(f.procurement_groups(to_procure(s), 2))


@query("hook_procurement_groups", SQL_GROUPS + """, hg AS (SELECT *, CASE WHEN commitment_date IS NOT NULL THEN on_ || '/' || CAST(commitment_date - CASE WHEN qty > 40 THEN 5 ELSE 2 END AS VARCHAR) WHEN wh IS NOT NULL THEN on_ || '/W' || wh ELSE on_ END || CASE WHEN product_id % 3 = 0 THEN '/lot ' || product_id ELSE '' END AS hooked_name FROM gg)
SELECT order_id, CAST(priority AS BIGINT) AS priority, hooked_name AS group_name, count(*) AS line_count, sum(tp)::DOUBLE AS qty_to_procure FROM hg GROUP BY ALL""")
def _(s):
    """Extensions: large lines leave three days earlier, products kept by lot get a group of their own."""
    lot = F.when(F.col("product_id") % 3 == 0, F.concat(F.lit("/lot "), F.col("product_id").cast("string"))).otherwise(F.lit(""))
    earlier = hooks.extended(hooks.DATE_PLANNED, lambda day: F.date_sub(day, F.when(F.col("qty") > 40, 3).otherwise(0)))
    with earlier, hooks.extended(hooks.GROUP_NAME, lambda name: F.concat(name, lot)):
        grouped = f.procurement_groups(to_procure(s), 2)
    return f.procurement_group_totals(grouped)


@query("manual_deliveries", SQL_GROUPS + "SELECT partner_id, CAST(dp AS VARCHAR) AS date_planned, count(*) AS line_count, sum(tp)::DOUBLE AS quantity FROM gg WHERE tp > 0 GROUP BY partner_id, dp")
def _(s):
    return f.manual_deliveries(f.procurement_groups(to_procure(s), 2))


@query("manual_delivery_prep", SQL_GROUPS + ", mm AS (SELECT batch, min(partner_id) <> max(partner_id) AS mixed FROM gg WHERE tp > 0 GROUP BY 1) SELECT order_id, line_no, tp::DOUBLE AS qty_to_procure, CASE WHEN order_id % 9 + 1 > tp THEN 'over quantity' WHEN mixed THEN 'several partners' END AS reason FROM gg JOIN mm USING (batch) WHERE tp > 0")
def _(s):
    lines = f.procurement_groups(to_procure(s), 2).withColumn("asked", (F.col("order_id") % 9 + 1).cast(QTY))
    return f.manual_delivery_prep(lines).select("order_id", "line_no", "qty_to_procure", "reason")


@query("picking_fill", "SELECT order_id, line_no, is_return, CASE WHEN product_id % 2 = 0 AND state NOT IN ('done','cancel') AND floor(quantity / 3) < quantity THEN quantity ELSE floor(quantity / 3) END::DOUBLE AS quantity_done FROM (SELECT * REPLACE (CASE WHEN product_id % 3 = 0 THEN 'assigned' ELSE state END AS state) FROM stock_move)")
def _(s):
    moves = s.stock_moves().select(
        "order_id", "line_no", "is_return", (F.col("product_id") % 2 == 0).alias("picked"),
        F.when(F.col("product_id") % 3 == 0, F.lit("assigned")).otherwise(F.col("state")).alias("state"),
        F.col("quantity").alias("demand"), F.floor(F.col("quantity") / 3).cast(QTY).alias("quantity_done"),
    )
    return f.picking_fill(moves).select("order_id", "line_no", "is_return", "quantity_done")


@query("free_stock_by_location", "SELECT product_id, order_id % 6 AS location_id, sum(quantity - floor(quantity / 4))::DOUBLE AS free_qty FROM stock_move WHERE dest_usage = 'internal' AND order_id % 6 < 4 GROUP BY ALL")
def _(s):
    quants = s.stock_moves().filter("dest_usage = 'internal'").select(
        "product_id", (F.col("order_id") % 6).alias("location_id"), "quantity", F.floor(F.col("quantity") / 4).cast(QTY).alias("reserved")
    )
    places = rows(s.spark, "id bigint, usage string", [(k, "internal" if k < 4 else "transit") for k in range(6)])
    return f.free_stock_by_location(quants, places)


@query("move_sequence_copy", "SELECT m.order_id, m.line_no, m.is_return, l.sequence AS move_sequence FROM stock_move m LEFT JOIN sale_order_line l USING (order_id, line_no)")
def _(s):
    return f.move_sequence_copy(s.stock_moves(), s.keyed_lines()).select("order_id", "line_no", "is_return", "move_sequence")


@query("purchase_orders_of_sale", """, l AS (SELECT DISTINCT order_id, order_id * 10 + sequence % 2 AS g FROM sale_order_line), p AS (SELECT DISTINCT order_id * 10 + sequence % 2 AS g, agent_id AS po FROM sale_order_line UNION SELECT order_id * 10 + line_no % 2, product_id % 50 FROM stock_move)
SELECT DISTINCT order_id, po AS purchase_id FROM l JOIN p USING (g)""")
def _(s):
    group = (F.col("order_id") * 10 + F.col("sequence") % 2).alias("group_id")
    direct = s.lines().select(group, F.col("agent_id").alias("purchase_id"))
    moved = s.stock_moves().select((F.col("order_id") * 10 + F.col("line_no") % 2).alias("group_id"), (F.col("product_id") % 50).alias("purchase_id"))
    return f.purchase_orders_of_sale(s.lines().select("order_id", group), direct, moved)


# -- invoicing ----------------------------------------------------------------------------


@query("amount_to_invoice", """, t AS (SELECT order_id, sum(CAST((qty - qty_invoiced) * price_total / qty AS DECIMAL(20,8))) AS v FROM sale_order_line WHERE qty > 0 GROUP BY 1)
SELECT id, state, CASE WHEN state IN ('sale','done') THEN round(greatest(coalesce(v, 0), 0), 2) ELSE 0 END::DOUBLE AS amount_to_invoice FROM sale_order LEFT JOIN t ON order_id = id""")
def _(s):
    return i.amount_to_invoice(s.orders(), s.lines())


@query("amount_invoiced", """, lt AS (SELECT order_id, sum(price_total) AS line_total FROM sale_order_line GROUP BY 1),
v AS (SELECT i.order_id, sum(CASE WHEN move_type = 'out_refund' THEN -1 ELSE 1 END * CASE WHEN i.currency_id <> o.currency_id AND o.currency_id <> 1 THEN CASE WHEN i.state = 'posted' THEN coalesce(line_total, 0) ELSE 0 END ELSE i.amount_total END) AS a FROM invoice i JOIN sale_order o ON o.id = i.order_id LEFT JOIN lt ON lt.order_id = i.order_id WHERE i.state <> 'cancel' AND o.state <> 'cancel' GROUP BY 1)
SELECT o.id AS order_id, coalesce(a, 0)::DOUBLE AS amount_invoiced FROM sale_order o LEFT JOIN v ON v.order_id = o.id""")
def _(s):
    totals = s.lines().groupBy("order_id").agg(F.sum("price_total").alias("line_total"))
    inv = s.invoices().join(totals, "order_id", "left").withColumn("line_total", F.coalesce("line_total", F.lit(0)))
    return i.amount_invoiced(s.orders(), inv, 1)


def policy_lines(s: Star, lines):
    goods = s.products().select(F.col("id").alias("product_id"), "type", F.when(F.col("id") % 2 == 0, F.lit("order")).otherwise(F.lit("delivery")).alias("product_policy"))
    k = F.col("order_id")
    return stated(s, lines).join(goods, "product_id").select(
        "*",
        F.when(k % 3 == 0, F.lit("order")).when(k % 3 == 1, F.lit("delivery")).alias("order_policy"),
        (k % 2 == 0).alias("order_policy_required"),
        F.when(F.col("product_id") % 5 == 0, F.lit(1)).otherwise(F.lit(0)).cast(QTY).alias("force_invoiced_qty"),
        (k % 7 == 0).alias("open_tasks"),
    )


SQL_POLICY = """
, pl AS (SELECT l.*, o.state, o.workflow_id, o.date_order, o.currency_id AS oc, p.type, p.must_have_dates, CASE WHEN product_id % 2 = 0 THEN 'order' ELSE 'delivery' END AS pp, CASE order_id % 3 WHEN 0 THEN 'order' WHEN 1 THEN 'delivery' END AS op, order_id % 2 = 0 AS req, CASE WHEN product_id % 5 = 0 THEN 1 ELSE 0 END AS fq, order_id % 7 = 0 AS tasks FROM sale_order_line l JOIN sale_order o ON o.id = l.order_id JOIN product p ON p.id = l.product_id),
q1 AS (SELECT *, type <> 'service' AND op IS NOT NULL AND req AS bo FROM pl),
q2 AS (SELECT *, CASE WHEN state IN ('sale','done') AND display_type IS NULL AND NOT (tasks AND type = 'service') THEN CASE WHEN CASE WHEN bo THEN op ELSE pp END = 'order' THEN qty ELSE qty_delivered END - qty_invoiced - CASE WHEN bo THEN 0 ELSE fq END ELSE 0 END AS qti FROM q1)
"""


@query("qty_to_invoice", SQL_POLICY + "SELECT order_id, sequence, product_id, qti::DOUBLE AS qty_to_invoice FROM q2")
def _(s):
    return i.qty_to_invoice(policy_lines(s, s.lines())).select("order_id", "sequence", "product_id", "qty_to_invoice")


@query("untaxed_to_invoice", SQL_POLICY + """, il AS (SELECT order_id, line_no, price_unit AS ip, qty_invoiced AS iq, CASE WHEN product_id % 6 = 0 THEN discount + 1 ELSE discount END AS idisc, CAST(round(price_subtotal * 0.5, 2) AS DECIMAL(18,2)) AS isub, move_state FROM invoice_line WHERE qty_invoiced <> 0),
sm AS (SELECT il.order_id, il.line_no, bool_or(idisc <> l.discount) AS df, sum(round(ip * iq, 2)) AS g, coalesce(sum(isub) FILTER (move_state = 'posted'), 0) AS iv FROM il JOIN sale_order_line l USING (order_id, line_no) WHERE move_state <> 'cancel' GROUP BY ALL),
w AS (SELECT pl.*, round(CAST(price_unit * (100 - discount) * 0.01 AS DECIMAL(16,4)) * (CASE WHEN pp = 'delivery' THEN qty_delivered ELSE qty END - fq), 2) AS worth FROM pl)
SELECT order_id, line_no, CASE WHEN state IN ('sale','done') THEN CASE WHEN coalesce(df, FALSE) THEN greatest(worth - coalesce(g, 0), 0) ELSE worth - coalesce(iv, 0) END ELSE 0 END::DOUBLE AS untaxed_to_invoice FROM w LEFT JOIN sm USING (order_id, line_no)""")
def _(s):
    inv = s.keyed_invoice_lines().filter("qty_invoiced <> 0").select(
        "order_id", "line_no", "move_state", F.col("price_unit").alias("inv_price"), F.col("qty_invoiced").alias("inv_qty"),
        F.when(F.col("product_id") % 6 == 0, F.col("discount") + 1).otherwise(F.col("discount")).alias("inv_discount"),
        F.round(F.col("price_subtotal") / 2, 2).cast(MONEY).alias("inv_subtotal"),
    )
    return i.untaxed_to_invoice(policy_lines(s, s.keyed_lines()), inv, ["order_id", "line_no"]).select("order_id", "line_no", "untaxed_to_invoice")


@query("invoice_status_override", "SELECT id, state, CASE WHEN force_invoiced AND state = 'sale' THEN 'invoiced' WHEN blocking_reason IS NOT NULL AND state IN ('sale','done') THEN 'no' WHEN o IS NOT NULL THEN 'no' ELSE invoice_status END AS invoice_status FROM sale_order LEFT JOIN (SELECT DISTINCT order_id AS o FROM sale_order_line WHERE product_id % 90 = 4) ON o = id")
def _(s):
    return i.invoice_status_override(s.orders(), s.lines().filter("product_id % 90 = 4").select("order_id"))


RATES = [
    (1, 1, date(1990, 1, 1), D("1")), (2, 2, date(1990, 1, 1), D("1.25")), (3, 2, date(1996, 3, 15), D("2")), (4, 2, date(1996, 3, 15), D("1.6")),
    (5, 2, date(1999, 7, 1), D("0.8")), (6, 3, date(1990, 1, 1), D("0.5")), (7, 3, date(1998, 1, 20), D("0.4")), (8, 4, date(1990, 1, 1), D("4")),
]
SQL_RATES = """, rate AS (SELECT * FROM (VALUES (1,1,DATE '1990-01-01',CAST(1 AS DECIMAL(12,6))),(2,2,DATE '1990-01-01',1.25),(3,2,DATE '1996-03-15',2),(4,2,DATE '1996-03-15',1.6),(5,2,DATE '1999-07-01',0.8),(6,3,DATE '1990-01-01',0.5),(7,3,DATE '1998-01-20',0.4),(8,4,DATE '1990-01-01',4)) v(rid,cur,d,r))
"""


def rates(s: Star):
    return rows(s.spark, "id bigint, currency_id bigint, date date, rate decimal(12,6)", RATES)


def rate_sql(cur: str, day: str) -> str:
    return f"(SELECT arg_max(r, d * 100 + rid) FROM (SELECT r, CAST(epoch(d) AS BIGINT) AS d, rid FROM rate WHERE cur = {cur} AND rate.d <= {day}))"


SQL_PAID = SQL_RATES + f"""
, pay AS (SELECT o.id, o.currency_id AS oc, o.id % 2 + 1 AS pc, CAST(round(o.amount_total * CASE WHEN o.id % 4 = 1 THEN 0.3 ELSE 1.1 END, 2) AS DECIMAL(18,2)) AS amt, CAST(date_order AS DATE) + 2 AS d FROM sale_order o WHERE o.id % 4 IN (1, 2)),
adv AS (SELECT id, sum({ratio_sql('amt * t', 'f', 2)}::DECIMAL(18,2)) AS a FROM (SELECT *, {rate_sql('oc', 'pay.d')} AS t, {rate_sql('pc', 'pay.d')} AS f FROM pay) GROUP BY 1),
ip AS (SELECT order_id, sum({ratio_sql('(amt * t)', 'f', 2)}::DECIMAL(18,2)) AS p FROM (SELECT order_id, (CASE WHEN move_type = 'out_refund' THEN -1 ELSE 1 END * amount_total - amount_residual)::DECIMAL(18,2) AS amt, {rate_sql('order_currency_id', 'invoice.invoice_date')} AS t, {rate_sql('invoice.currency_id', 'invoice.invoice_date')} AS f FROM invoice WHERE state <> 'cancel') GROUP BY 1)
"""


@query("advance_payment_status", SQL_PAID + """SELECT o.id AS order_id, (amount_total - coalesce(a, 0) - coalesce(p, 0))::DOUBLE AS amount_residual, CASE WHEN a IS NULL THEN 'not_paid' WHEN amount_total - coalesce(a, 0) - coalesce(p, 0) <= 0 THEN 'paid' ELSE 'partial' END AS advance_status
FROM sale_order o LEFT JOIN adv ON adv.id = o.id LEFT JOIN ip ON ip.order_id = o.id""")
def _(s):
    share = F.when(F.col("id") % 4 == 1, F.lit(D("0.3"))).otherwise(F.lit(D("1.1")))
    payments = s.orders().filter("id % 4 IN (1, 2)").select(
        F.col("id").alias("order_id"), (F.col("id") % 2 + 1).alias("currency_id"), F.round(F.col("amount_total") * share, 2).cast(MONEY).alias("amount"),
        F.date_add(F.col("date_order").cast("date"), 2).alias("date"),
    )
    return i.advance_payment_status(s.orders(), payments, s.invoices(), rates(s))


@query("currency_convert", SQL_RATES + f"SELECT id, {ratio_sql('(amount_total * t)', 'f', 2)} AS converted FROM (SELECT *, {rate_sql('order_currency_id', 'invoice.invoice_date')} AS t, {rate_sql('invoice.currency_id', 'invoice.invoice_date')} AS f FROM invoice)")
def _(s):
    return convert_currency(s.invoices(), rates(s), "amount_total", "currency_id", "order_currency_id", "invoice_date", "converted").select("id", "converted")


@query("asof_join", SQL_RATES + f"SELECT id, {rate_sql('invoice.currency_id', 'invoice.invoice_date')}::DOUBLE AS rate FROM invoice")
def _(s):
    return asof_join(s.invoices(), rates(s), ["currency_id"], "invoice_date", ["rate"]).select("id", "rate")


def price_marks(s: Star):
    """List of prices that grows with the table: each order date of a product starts its lowest price of that day."""
    days = s.orders().select(F.col("id").alias("order_id"), F.col("date_order").cast("date").alias("date"))
    sold = s.lines().select("order_id", "product_id", "price_unit").join(days, "order_id")
    return sold.groupBy("product_id", "date").agg(F.min("price_unit").alias("price"), F.min("order_id").alias("id"))


@query("asof_merge", """, mark AS (SELECT l.product_id, CAST(o.date_order AS DATE) AS d, min(price_unit) AS price FROM sale_order_line l JOIN sale_order o ON o.id = l.order_id GROUP BY ALL)
SELECT l.order_id, l.line_no, m.price::DOUBLE AS price FROM sale_order_line l ASOF LEFT JOIN mark m ON m.product_id = l.product_id AND m.d <= l.ship_date - 60""")
def _(s):
    """Price in force sixty days before a line was shipped, from a price list as long as the sales themselves."""
    facts = s.keyed_lines().select("order_id", "line_no", "product_id", F.date_sub("ship_date", 60).alias("day"))
    return merge_asof(facts, price_marks(s), ["product_id"], "day", ["price"]).select("order_id", "line_no", "price")


AREA_RATES = [
    (1, 0, None, date(1994, 1, 1), D("2")), (2, 0, 105, date(1996, 5, 5), D("3")), (3, 0, None, date(1998, 2, 1), D("2.5")),
    (4, 1, 110, date(1997, 1, 1), D("4")), (5, 1, 110, date(1997, 9, 9), D("4.5")), (6, 2, None, date(1995, 6, 1), D("1.75")),
]


@query("asof_rate", """, r AS (SELECT * FROM (VALUES (1,0,NULL,DATE '1994-01-01',2.0),(2,0,105,DATE '1996-05-05',3.0),(3,0,NULL,DATE '1998-02-01',2.5),(4,1,110,DATE '1997-01-01',4.0),(5,1,110,DATE '1997-09-09',4.5),(6,2,NULL,DATE '1995-06-01',1.75)) v(id,co,cat,d,rate))
, x AS (SELECT l.order_id, l.line_no, r.rate, row_number() OVER (PARTITION BY l.order_id, l.line_no ORDER BY r.cat IS NOT NULL AND r.id IS NOT NULL DESC, r.d DESC NULLS LAST, r.id DESC) AS rk FROM sale_order_line l JOIN sale_order o ON o.id = l.order_id JOIN product p ON p.id = l.product_id LEFT JOIN r ON r.co = o.company_id AND (r.cat IS NULL OR r.cat = p.categ_id) AND r.d <= CAST(o.date_order AS DATE))
SELECT order_id, line_no, rate::DOUBLE AS rate FROM x WHERE rk = 1""")
def _(s):
    heads = s.orders().select(F.col("id").alias("order_id"), "company_id", F.col("date_order").cast("date").alias("day"))
    goods = s.products().select(F.col("id").alias("product_id"), "categ_id")
    facts = s.keyed_lines().select("order_id", "line_no", "product_id").join(heads, "order_id").join(goods, "product_id")
    table = rows(s.spark, "id bigint, company_id bigint, categ_id bigint, date date, rate decimal(9,4)", AREA_RATES)
    return asof_rate(facts, table, "day").select("order_id", "line_no", "rate")


def chained(steps: int) -> str:
    out = "CAST(date_order AS DATE)"
    for _k in range(steps):
        out = f"CAST({out} + INTERVAL 1 MONTH AS DATE)"
    return out


SQL_PLAN = f"""
, plan AS (SELECT id AS order_id, CAST(n AS BIGINT) AS installment, CASE n {' '.join(f'WHEN {k} THEN {chained(k)}' for k in range(4))} END AS plan_date, CASE WHEN n = 0 THEN 'advance' ELSE 'installment' END AS invoice_type, CAST(CASE n WHEN 0 THEN 0 WHEN 3 THEN 33.34 ELSE 33.33 END AS DECIMAL(9,2)) AS percent FROM sale_order, range(0, 4) r(n)),
pf AS (SELECT p.*, o.state, o.amount_untaxed, installment < order_id % 5 AS invoiced, CAST(CASE WHEN installment < order_id % 5 THEN round(o.amount_untaxed * percent * 0.01, 2) + 1 ELSE 0 END AS DECIMAL(18,2)) AS ai FROM plan p JOIN sale_order o ON o.id = p.order_id),
pk AS (SELECT *, CASE WHEN invoiced THEN ai ELSE CAST(round(amount_untaxed * percent * 0.01, 2) AS DECIMAL(18,2)) END AS known FROM pf),
pg AS (SELECT *, installment = 3 AS last, CASE WHEN NOT invoiced AND installment = 3 THEN amount_untaxed - sum(CASE WHEN invoice_type = 'installment' AND installment < 3 THEN known ELSE 0 END) OVER (PARTITION BY order_id) ELSE known END AS amount, state = 'sale' AND coalesce(installment = min(installment) FILTER (NOT invoiced) OVER (PARTITION BY order_id), FALSE) AS to_invoice FROM pk)
"""


def plans(s: Star):
    return i.invoice_plan_generate(s.orders(), 3, "date_order", 1, "month", advance=True)


def progress(s: Star):
    heads = s.orders().select(F.col("id").alias("order_id"), F.col("amount_untaxed").alias("_u"))
    done = F.col("installment") < F.col("order_id") % 5
    rows_ = plans(s).join(heads, "order_id").select(
        "order_id", "installment", "invoice_type", "percent", done.alias("invoiced"),
        F.when(done, F.round(F.col("_u") * F.col("percent") * F.lit(D("0.01")), 2) + 1).otherwise(F.lit(0)).cast(MONEY).alias("amount_invoiced"),
    )
    return i.plan_progress(rows_, s.orders())


@query("invoice_plan_generate", SQL_PLAN + "SELECT order_id, installment, CAST(plan_date AS VARCHAR) AS plan_date, invoice_type, percent::DOUBLE AS percent FROM plan")
def _(s):
    return plans(s)


@query("plan_progress", SQL_PLAN + "SELECT order_id, installment, invoice_type, percent::DOUBLE AS percent, invoiced, amount::DOUBLE AS amount, last, to_invoice FROM pg")
def _(s):
    return progress(s).select("order_id", "installment", "invoice_type", "percent", "invoiced", "amount", "last", "to_invoice")


@query("plan_totals", SQL_PLAN + "SELECT order_id, sum(percent)::DOUBLE AS plan_percent, sum(amount) FILTER (invoice_type = 'installment')::DOUBLE AS plan_amount, bool_or(NOT invoiced) AS processable FROM pg GROUP BY 1")
def _(s):
    return i.plan_totals(progress(s))


@query("next_to_invoice", SQL_PLAN + "SELECT order_id, installment, amount::DOUBLE AS amount FROM pg WHERE to_invoice")
def _(s):
    return i.next_to_invoice(progress(s)).select("order_id", "installment", "amount")


@query("plan_invoice_qty", SQL_PLAN + """, z AS (SELECT p.order_id, installment, line_no, last, l.product_id % 20 = 0 AS dp, qty_delivered AS inv, CASE WHEN l.product_id % 20 = 0 THEN -percent * 0.01 WHEN last THEN qty_delivered ELSE round(qty * percent * 0.01, 2) END AS pq FROM pg p JOIN sale_order_line l USING (order_id) WHERE to_invoice AND invoice_type = 'installment')
SELECT order_id, installment, line_no, pq::DOUBLE AS plan_qty, NOT last AND NOT dp AND abs(pq) > abs(inv) AS exceeds FROM z""")
def _(s):
    due = i.next_to_invoice(progress(s)).filter("invoice_type = 'installment'")
    lines = s.keyed_lines().select("order_id", "line_no", "qty", F.col("qty_delivered").alias("invoiceable"), (F.col("product_id") % 20 == 0).alias("is_downpayment"))
    return i.plan_invoice_qty(due, lines).select("order_id", "installment", "line_no", "plan_qty", "exceeds")


@query("planned_invoices", SQL_PLAN + "SELECT order_id, installment, percent::DOUBLE AS percent, amount::DOUBLE AS amount, CASE WHEN invoice_type = 'advance' THEN 'percentage' ELSE 'delivered' END AS method FROM pg WHERE state = 'sale' AND NOT invoiced")
def _(s):
    return i.planned_invoices(progress(s), all_remaining=True)


def sheet_lines(s: Star):
    inv = s.invoices().filter("state = 'posted' AND amount_residual > 0")
    return inv.select(
        (F.col("id") % 40).alias("sheet_id"), "partner_id", F.concat(F.lit("R"), (F.col("id") % 3).cast("string")).alias("ref"), F.col("id").alias("invoice_id"), "move_type",
        F.round(F.col("amount_residual") * F.when(F.col("id") % 4 == 0, F.lit(D("0.5"))).otherwise(F.lit(D("1"))), 2).cast(MONEY).alias("amount"),
        F.col("amount_residual").alias("residual"),
    )


SQL_SHEET = ", sl AS (SELECT id % 40 AS sheet_id, partner_id, 'R' || id % 3 AS ref, id AS invoice_id, move_type, CAST(round(amount_residual * CASE WHEN id % 4 = 0 THEN 0.5 ELSE 1 END, 2) AS DECIMAL(18,2)) AS amount, amount_residual AS residual FROM invoice WHERE state = 'posted' AND amount_residual > 0)"


@query("payment_sheet_total", SQL_SHEET + "SELECT sheet_id, sum(amount)::DOUBLE AS amount_total FROM sl GROUP BY 1")
def _(s):
    return i.payment_sheet_total(sheet_lines(s))


for _merge, _name in ((True, "statement_lines"), (False, "statement_lines_single")):

    @query(_name, SQL_SHEET + f"SELECT sheet_id, partner_id, ref, {'' if _merge else 'invoice_id, '}count(*) AS line_count, sum(CASE WHEN move_type = 'out_refund' THEN -amount ELSE amount END)::DOUBLE AS amount, bool_and(amount >= residual) AS full_payment FROM sl GROUP BY ALL")
    def _(s, merge=_merge):
        return i.statement_lines(sheet_lines(s), merge)


@query("greedy_payment_allocation", """, bud AS (SELECT CAST(c AS BIGINT) AS company_id, CAST(5000000 * (c + 1) AS DECIMAL(18,2)) AS budget FROM range(0, 5) r(c)), op AS (SELECT i.*, budget FROM invoice i JOIN bud USING (company_id) WHERE state = 'posted' AND payment_state <> 'paid'),
en AS (SELECT company_id, budget + coalesce(sum(amount_residual) FILTER (move_type = 'out_refund'), 0) AS big FROM op GROUP BY company_id, budget),
sp AS (SELECT op.company_id, id, move_type, greatest(least(amount_residual, big - (sum(amount_residual) OVER (PARTITION BY op.company_id ORDER BY invoice_date, id ROWS UNBOUNDED PRECEDING) - amount_residual)), 0) AS payment FROM op JOIN en USING (company_id) WHERE move_type = 'out_invoice')
SELECT company_id, id, move_type, payment::DOUBLE AS payment FROM sp WHERE payment <> 0 UNION ALL SELECT company_id, id, move_type, (-amount_residual)::DOUBLE FROM op WHERE move_type = 'out_refund' AND amount_residual <> 0""")
def _(s):
    budgets = rows(s.spark, "company_id bigint, budget decimal(18,2)", [(c, D(5000000 * (c + 1))) for c in range(5)])
    return i.greedy_payment_allocation(s.invoices(), budgets, "company_id")


@query("payment_register_prep", "SELECT id AS invoice_id, partner_id, amount_residual::DOUBLE AS amount, 'customer' AS partner_type, CASE WHEN move_type = 'out_refund' THEN 'outbound' ELSE 'inbound' END AS payment_type FROM invoice WHERE state = 'posted' AND payment_state = 'not_paid'")
def _(s):
    return i.payment_register_prep(s.invoices().filter("state = 'posted' AND payment_state = 'not_paid'"))


@query("order_to_invoice_lines", SQL_POLICY + """, wf AS (SELECT * FROM (VALUES (1, 501, TRUE, TRUE), (2, 502, FALSE, FALSE)) v(id, journal_id, dd, fs)),
r AS (SELECT q2.*, wf.journal_id, CASE WHEN coalesce(fs, FALSE) AND type = 'service' THEN qty - qty_invoiced ELSE qti END AS quantity, coalesce(dd, FALSE) AS dd FROM q2 LEFT JOIN wf ON wf.id = workflow_id WHERE state IN ('sale','done') AND display_type IS NULL)
SELECT order_id, line_no, quantity::DOUBLE AS quantity, CAST(journal_id AS BIGINT) AS journal_id, CAST(CASE WHEN dd THEN CAST(date_order AS DATE) END AS VARCHAR) AS invoice_date, CAST(CASE WHEN must_have_dates THEN ship_date END AS VARCHAR) AS line_start, discount::DOUBLE AS discount FROM r WHERE quantity <> 0""")
def _(s):
    flows = rows(s.spark, "id bigint, journal_id bigint, invoice_date_is_order_date boolean, fill_services boolean", [(1, 501, True, True), (2, 502, False, False)])
    dates = s.products().select(F.col("id").alias("product_id"), "must_have_dates")
    lines = i.qty_to_invoice(policy_lines(s, s.keyed_lines())).filter("state IN ('sale','done') AND display_type IS NULL").join(dates, "product_id")
    lines = lines.withColumn("start_date", F.col("ship_date")).withColumn("end_date", F.date_add("ship_date", 5))
    return i.order_to_invoice_lines(lines, flows).select("order_id", "line_no", "quantity", "journal_id", "invoice_date", "line_start", "discount")


@query("forcible_invoicing_orders", "SELECT id FROM sale_order WHERE state IN ('sale','done') AND id NOT IN (SELECT id FROM invoice WHERE state = 'posted')")
def _(s):
    return i.forcible_invoicing_orders(s.orders(), s.invoices().filter("state = 'posted'")).select("id")


@query("team_invoiced_mtd", "SELECT team_id, sum(CASE WHEN move_type = 'out_refund' THEN -amount_untaxed ELSE amount_untaxed END)::DOUBLE AS invoiced FROM invoice WHERE state = 'posted' AND payment_state IN ('paid','in_payment','reversed') AND invoice_date BETWEEN '1998-03-01' AND '1998-03-25' AND amount_total > 20000 GROUP BY 1")
def _(s):
    return i.team_invoiced_mtd(s.invoices(), F.lit(date(1998, 3, 1)), F.lit(date(1998, 3, 25)), F.expr("amount_total > 20000"))


# -- blanket orders -----------------------------------------------------------------------


def blanket_id(partner="partner_id"):
    return F.col(partner)


def blanket_lines(s: Star):
    """One blanket line per (customer, product) that was ever ordered together, for every third product."""
    heads = s.orders().select(F.col("id").alias("order_id"), "partner_id", (F.col("partner_id") % 3 + 1).alias("currency_id"))
    wanted = s.lines().filter("display_type IS NULL").select("order_id", "product_id", "qty", "price_unit", "tax_rate", "ship_date").join(heads, "order_id")
    return wanted.groupBy("partner_id", "product_id", "currency_id").agg(
        (F.sum("qty") + F.col("product_id") % 4 * 5 - 5).cast(QTY).alias("original_qty"), F.max("price_unit").alias("price_unit"), F.max("tax_rate").alias("tax_rate"),
        F.when(F.col("product_id") % 2 == 0, F.max("ship_date")).alias("date_schedule"),
    ).select(
        "*", (F.col("partner_id") * 1000000 + F.col("product_id")).alias("id"), F.col("partner_id").alias("blanket_id"),
        F.when(F.col("product_id") % 4 == 0, F.lit(2)).otherwise(F.lit(1)).cast("bigint").alias("uom_id"), F.lit(None).cast("string").alias("display_type"),
    )


def blankets(s: Star):
    return s.partners().select("id", (F.col("id") % 6 != 0).alias("confirmed"), F.date_add(F.lit(date(1998, 1, 1)), (F.col("id") % 400).cast("int")).alias("validity_date"))


def linked_lines(s: Star):
    return stated(s, s.lines()).withColumn("blanket_line_id", F.col("partner_id") * 1000000 + F.col("product_id"))


SQL_BLANKET = SQL_UOM + """
, bl AS (SELECT partner_id, product_id, partner_id % 3 + 1 AS currency_id, sum(qty) + product_id % 4 * 5 - 5 AS original_qty, max(price_unit) AS price_unit, max(tax_rate) AS tax_rate, CASE WHEN product_id % 2 = 0 THEN max(ship_date) END AS date_schedule, partner_id * 1000000 + product_id AS id, CASE WHEN product_id % 4 = 0 THEN 2 ELSE 1 END AS uom_id
 FROM sale_order_line l JOIN sale_order o ON o.id = l.order_id WHERE display_type IS NULL GROUP BY partner_id, product_id),
us AS (SELECT o.partner_id * 1000000 + l.product_id AS id, l.uom_id AS su, sum(qty) AS a, sum(qty_invoiced) AS b, sum(qty_delivered) AS c FROM sale_order_line l JOIN sale_order o ON o.id = l.order_id WHERE o.state <> 'cancel' GROUP BY 1, 2),
bq AS (SELECT bl.*, coalesce(CAST(a / uf.factor * ut.factor AS DECIMAL(18,4)), 0) AS ordered, coalesce(CAST(b / uf.factor * ut.factor AS DECIMAL(18,4)), 0) AS invoiced, coalesce(CAST(c / uf.factor * ut.factor AS DECIMAL(18,4)), 0) AS delivered FROM bl JOIN uom ut ON ut.id = bl.uom_id LEFT JOIN us ON us.id = bl.id LEFT JOIN uom uf ON uf.id = us.su),
bs AS (SELECT p.id, p.id % 6 <> 0 AS confirmed, DATE '1998-01-01' + CAST(p.id % 400 AS INT) AS vd, sum(original_qty) AS original_qty, sum(ordered) AS ordered, sum(original_qty - ordered) AS remaining FROM partner p LEFT JOIN bq ON bq.partner_id = p.id GROUP BY p.id),
bt AS (SELECT *, CASE WHEN NOT confirmed THEN 'draft' WHEN vd <= DATE '1998-06-15' THEN 'expired' WHEN coalesce(remaining, 0) = 0 THEN 'done' ELSE 'open' END AS state FROM bs)
"""


@query("blanket_quantities", SQL_BLANKET + "SELECT id, product_id, original_qty::DOUBLE AS original_qty, ordered::DOUBLE AS ordered, invoiced::DOUBLE AS invoiced, delivered::DOUBLE AS delivered, (original_qty - ordered)::DOUBLE AS remaining FROM bq")
def _(s):
    return b.blanket_quantities(blanket_lines(s), linked_lines(s), uoms(s)).select("id", "product_id", "original_qty", "ordered", "invoiced", "delivered", "remaining")


def blanket_headers(s: Star):
    return b.blanket_state(blankets(s), b.blanket_quantities(blanket_lines(s), linked_lines(s), uoms(s)), date(1998, 6, 15))


@query("blanket_state", SQL_BLANKET + "SELECT id, state, original_qty::DOUBLE AS original_qty, ordered::DOUBLE AS ordered, remaining::DOUBLE AS remaining FROM bt")
def _(s):
    return blanket_headers(s).select("id", "state", "original_qty", "ordered", "remaining")


@query("blanket_expired", SQL_BLANKET + "SELECT id, CAST(vd AS VARCHAR) AS validity_date FROM bt WHERE state = 'open' AND vd <= DATE '1998-12-01'")
def _(s):
    return b.blanket_expired(blanket_headers(s), date(1998, 12, 1)).select("id", "validity_date")


@query("blanket_amounts", SQL_BLANKET + ", z AS (SELECT partner_id, round(price_unit * original_qty, 2) AS u, round(round(price_unit * original_qty, 2) * tax_rate * 0.01, 2) AS t FROM bl) SELECT partner_id AS blanket_id, sum(u)::DOUBLE AS amount_untaxed, sum(t)::DOUBLE AS amount_tax, (sum(u) + sum(t))::DOUBLE AS amount_total FROM z GROUP BY 1")
def _(s):
    return b.blanket_amounts(blanket_lines(s))


@query("nearest_blanket_line", SQL_BLANKET + """, cand AS (SELECT partner_id, product_id, currency_id, partner_id * 10000000 + product_id * 10 + k AS id, original_qty + k * 3 AS remaining, CASE WHEN k < 2 THEN date_schedule + k * 50 END AS ds FROM bl, (VALUES (0),(1),(2)) v(k)),
ask AS (SELECT l.order_id, l.line_no, o.partner_id, l.product_id, o.currency_id, CASE WHEN l.uom_id = 2 THEN l.qty * 4 ELSE l.qty END AS base, CASE WHEN l.order_id % 2 = 0 THEN o.partner_id * 10000000 + l.product_id * 10 + l.order_id // 2 % 4 END AS had FROM sale_order_line l JOIN sale_order o ON o.id = l.order_id),
el AS (SELECT a.order_id, a.line_no, a.had, c.id, c.ds FROM ask a JOIN cand c USING (partner_id, product_id, currency_id) WHERE c.remaining >= a.base),
near AS (SELECT order_id, line_no, id, row_number() OVER (PARTITION BY order_id, line_no ORDER BY ds IS NULL, abs(ds - DATE '1998-06-15'), id) AS rk FROM el WHERE ds IS NULL OR abs(ds - DATE '1998-06-15') < 365)
SELECT a.order_id, a.line_no, coalesce(k.id, n.id) AS blanket_line_id FROM ask a LEFT JOIN el k ON k.order_id = a.order_id AND k.line_no = a.line_no AND k.id = k.had LEFT JOIN near n ON n.order_id = a.order_id AND n.line_no = a.line_no AND n.rk = 1""")
def _(s):
    """Every second order has lines assigned, some of them to a blanket line that is not theirs or has too little left."""
    k = F.col("k")
    number = F.col("partner_id") * 10000000 + F.col("product_id") * 10
    cand = blanket_lines(s).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(
        "partner_id", "product_id", "currency_id", (number + k).alias("id"), F.lit("open").alias("state"),
        (F.col("original_qty") + k * 3).cast(QTY).alias("remaining"), F.when(k < 2, F.date_add("date_schedule", k * 50)).alias("date_schedule"),
    )
    assigned = F.when(F.col("order_id") % 2 == 0, number + F.expr("order_id div 2 % 4"))
    lines = stated(s, s.keyed_lines()).withColumn("blanket_line_id", assigned).withColumn("product_uom_id", F.lit(1).cast("bigint"))
    return b.nearest_blanket_line(lines, cand, uoms(s), ["order_id", "line_no"], date(1998, 6, 15))


@query("blanket_to_orders", SQL_BLANKET + "SELECT partner_id, count(*) AS line_count, sum(round(price_unit * (product_id % 5), 2))::DOUBLE AS amount, count(*) FILTER (product_id % 5 > original_qty) AS over_quantity_lines, CASE WHEN count(DISTINCT product_id % 4) = 1 THEN min(product_id % 4) END AS payment_term_id, min(currency_id) AS currency_id FROM bl WHERE product_id % 5 <> 0 GROUP BY 1")
def _(s):
    wanted = blanket_lines(s).select(
        "partner_id", F.col("id").alias("blanket_line_id"), (F.col("product_id") % 5).cast(QTY).alias("qty"), F.col("original_qty").alias("remaining"), "price_unit",
        (F.col("product_id") % 4).alias("payment_term_id"), "currency_id",
    )
    return b.blanket_to_orders(wanted, ["payment_term_id", "currency_id"])


@query("header_search_by_line", "SELECT id, name FROM sale_order WHERE id IN (SELECT order_id FROM sale_order_line WHERE qty_invoiced >= 45)")
def _(s):
    return b.header_search_by_line(s.orders(), s.lines(), F.col("qty_invoiced") >= 45, "order_id").select("id", "name")
