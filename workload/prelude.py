"""The star schema once more in plain SQL, for the independent check of results."""

PRELUDE = """
WITH sale_order AS (
  SELECT o_orderkey AS id, 'SO' || o_orderkey AS name, o_custkey AS partner_id,
    CASE WHEN o_orderkey % 3 = 0 THEN o_custkey - o_custkey % 5 ELSE o_custkey END AS partner_shipping_id,
    CASE WHEN o_orderkey % 50 = 1 THEN abs(o_custkey - 7) ELSE o_custkey END AS partner_invoice_id,
    o_orderdate AS date_order,
    CASE WHEN o_orderkey % 20 = 0 THEN 'cancel' WHEN o_orderstatus = 'F' AND o_orderkey % 6 = 1 THEN 'done'
         WHEN o_orderstatus = 'F' THEN 'sale' WHEN o_orderstatus = 'P' THEN 'sent' ELSE 'draft' END AS state,
    CASE WHEN o_orderkey % 11 < 10 THEN o_orderkey % 11 END AS user_id, o_orderkey % 7 AS create_uid,
    CASE WHEN o_custkey % 26 < 25 THEN o_custkey % 26 END AS team_id, o_custkey % 5 AS company_id,
    o_orderkey % 3 + 1 AS currency_id, o_custkey % 3 + 1 AS pricelist_id, o_orderkey % 4 AS warehouse_id,
    CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS type_id,
    CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 3 END AS workflow_id,
    CAST(o_totalprice AS DECIMAL(18,2)) AS amount_total,
    CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * 0.9, 2) AS DECIMAL(18,2)) AS amount_untaxed,
    CAST(o_totalprice AS DECIMAL(18,2)) - CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * 0.9, 2) AS DECIMAL(18,2)) AS amount_tax,
    CAST(o_orderdate AS DATE) + 30 AS validity_date,
    CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) + 10 END AS commitment_date,
    CASE WHEN o_orderkey % 13 = 0 THEN 'WELCOME20' END AS coupon_code,
    CASE o_orderkey % 4 WHEN 0 THEN 'no' WHEN 1 THEN 'to invoice' WHEN 2 THEN 'invoiced' ELSE 'upselling' END AS invoice_status,
    o_orderkey % 30 = 3 AS force_invoiced, o_orderkey % 30 = 4 AS force_delivered,
    CASE WHEN o_orderkey % 25 = 2 THEN 'credit' END AS blocking_reason,
    CASE WHEN o_orderkey % 2 = 0 THEN 'percent' ELSE 'fixed' END AS discount_type,
    CAST(o_orderkey % 15 AS DECIMAL(9,2)) AS discount_rate,
    o_orderkey // 4 AS revision_group, o_orderkey % 4 AS revision_number
  FROM orders),
raw_line AS (
  SELECT l_orderkey AS order_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
      l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS line_no,
    l_partkey AS product_id, l_suppkey AS agent_id, CAST(l_linenumber AS BIGINT) AS sequence,
    CASE WHEN l_partkey % 40 = 39 THEN 'line_note' END AS display_type,
    CAST(l_quantity AS DECIMAL(18,4)) AS qty,
    CAST(CAST((CAST(round(l_extendedprice * 100) AS BIGINT) * 2 + CAST(l_quantity AS BIGINT)) // (CAST(l_quantity AS BIGINT) * 2) AS DECIMAL(16,0)) * 0.01 AS DECIMAL(18,2)) AS price_unit,
    CAST(round(l_discount * 100) AS DECIMAL(9,2)) AS discount, CAST(round(l_tax * 100) AS DECIMAL(9,2)) AS tax_rate,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS gross, l_returnflag AS return_flag, l_linestatus AS line_status,
    CAST(l_shipdate AS DATE) AS ship_date, CASE WHEN l_partkey % 5 = 0 THEN 2 ELSE 1 END AS uom_id,
    l_partkey % 17 = 0 AS is_delivery
  FROM lineitem),
net_line AS (
  SELECT *, CAST(round(gross * (100 - discount) * 0.01, 2) AS DECIMAL(18,2)) AS price_subtotal FROM raw_line),
sale_order_line AS (
  SELECT *, CAST(round(price_subtotal * tax_rate * 0.01, 2) AS DECIMAL(18,2)) AS price_tax,
    CAST(price_subtotal + round(price_subtotal * tax_rate * 0.01, 2) AS DECIMAL(18,2)) AS price_total,
    CASE WHEN line_status = 'F' THEN qty WHEN return_flag = 'A' THEN CAST(floor(qty / 2) AS DECIMAL(18,4)) ELSE CAST(0 AS DECIMAL(18,4)) END AS qty_delivered,
    CASE WHEN line_status = 'F' AND return_flag = 'N' THEN qty WHEN return_flag = 'A' THEN CAST(floor(qty / 2) AS DECIMAL(18,4)) ELSE CAST(0 AS DECIMAL(18,4)) END AS qty_invoiced,
    CAST(round(price_unit * CAST(agent_id % 60 + 60 AS DECIMAL(9,2)) * 0.01, 2) AS DECIMAL(18,2)) AS purchase_price,
    CASE WHEN product_id % 3 = 0 THEN ship_date - 3 END AS commitment_date
  FROM net_line),
product AS (
  SELECT p_partkey AS id, p_name AS name, p_partkey - p_partkey % 2 AS template_id, CAST(p_size + 100 AS BIGINT) AS categ_id,
    '1/' || (p_size % 5 + 10) || '/' || (p_size + 100) || '/' AS parent_path, p_brand AS brand,
    CASE p_type WHEN 'PROMO' THEN 'service' WHEN 'SMALL' THEN 'consu' ELSE 'product' END AS type,
    CAST(p_retailprice AS DECIMAL(18,2)) AS list_price,
    CAST(round(CAST(p_retailprice AS DECIMAL(18,2)) * 0.7, 2) AS DECIMAL(18,2)) AS standard_price,
    CAST(p_partkey % 37 AS DECIMAL(18,4)) AS free_qty, CAST(p_partkey % 23 + p_size AS DECIMAL(18,4)) AS virtual_available,
    p_partkey % 9 <> 8 AS sale_ok, p_partkey % 19 <> 18 AS active, p_partkey % 7 = 6 AS commission_free,
    p_partkey % 8 = 7 AS bypass_discount, CAST(1 AS BIGINT) AS uom_id,
    CASE WHEN p_partkey % 10 = 1 THEN 'Handle with care' ELSE '' END AS sale_warn, p_partkey % 6 = 5 AS must_have_dates
  FROM part),
category AS (
  SELECT DISTINCT CAST(p_size + 100 AS BIGINT) AS id, CAST(p_size % 5 + 10 AS BIGINT) AS parent_id, '1/' || (p_size % 5 + 10) || '/' || (p_size + 100) || '/' AS parent_path FROM part
  UNION ALL SELECT DISTINCT CAST(p_size % 5 + 10 AS BIGINT), CAST(1 AS BIGINT), '1/' || (p_size % 5 + 10) || '/' FROM part
  UNION ALL SELECT CAST(1 AS BIGINT), CAST(NULL AS BIGINT), '1/'),
partner AS (
  SELECT c_custkey AS id, c_name AS name,
    CASE WHEN c_custkey % 5 <> 0 THEN c_custkey - c_custkey % 5 WHEN c_custkey % 25 <> 0 THEN c_custkey - c_custkey % 25 END AS parent_id,
    CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey - c_custkey % 25) || '/' || CASE WHEN c_custkey % 25 >= 5 THEN (c_custkey - c_custkey % 5) || '/' ELSE '' END || c_custkey || '/'
         WHEN c_custkey % 25 <> 0 THEN (c_custkey - c_custkey % 25) || '/' || c_custkey || '/' ELSE c_custkey || '/' END AS parent_path,
    c_custkey - c_custkey % 5 AS commercial_partner_id,
    CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 11 END AS user_id, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 26 END AS team_id,
    CASE WHEN c_custkey % 6 <> 0 THEN CAST(c_nationkey AS BIGINT) END AS country_id,
    CASE WHEN c_custkey % 12 <> 0 THEN lpad(CAST(c_custkey AS VARCHAR), 5, '0') END AS zip, c_mktsegment AS segment,
    CAST(c_acctbal AS DECIMAL(18,2)) AS balance, CASE WHEN c_custkey % 15 = 2 THEN 'Check the credit' ELSE '' END AS sale_warn,
    CAST(c_custkey % 10 AS DECIMAL(9,2)) AS discount, c_custkey % 4 = 1 AS newsletter, c_custkey % 9 <> 4 AS selectable,
    c_custkey % 14 = 3 AS no_auto_cancel
  FROM customer),
team AS (
  SELECT CAST(n_nationkey AS BIGINT) AS id, n_nationkey % 10 AS leader_id, CAST(n_regionkey AS BIGINT) AS region_id,
    CASE WHEN n_nationkey % 7 = 6 THEN '' ELSE n_name END AS name_en,
    CASE WHEN n_nationkey % 7 <> 6 AND n_nationkey % 2 = 0 THEN lower(n_name) END AS name_fr
  FROM nation),
users AS (
  SELECT s_suppkey AS id, s_name AS name, CAST(s_nationkey AS BIGINT) AS country_id, s_suppkey % 4 + 1 AS commission_id,
    CASE s_suppkey % 5 WHEN 0 THEN 'monthly' WHEN 1 THEN 'biweekly' WHEN 2 THEN 'quaterly' WHEN 3 THEN 'semi' ELSE 'annual' END AS settlement,
    CASE WHEN s_suppkey % 6 = 5 THEN 'salesman' ELSE 'agent' END AS agent_type, s_suppkey % 3 <> 2 AS salesman_as_agent,
    CASE WHEN s_suppkey % 8 <> 7 THEN s_suppkey % 3 END AS employee_id
  FROM supplier),
partner_agent AS (
  SELECT c_custkey AS partner_id, c_custkey % 10 AS agent_id FROM customer WHERE c_custkey % 3 > 0
  UNION ALL SELECT c_custkey, (c_custkey + 3) % 10 FROM customer WHERE c_custkey % 3 = 2),
invoice AS (
  SELECT id, id AS order_id, 'INV' || id AS name, CASE WHEN id % 9 = 0 THEN 'out_refund' ELSE 'out_invoice' END AS move_type,
    CASE id % 8 WHEN 0 THEN 'draft' WHEN 5 THEN 'cancel' ELSE 'posted' END AS state,
    CASE id % 5 WHEN 0 THEN 'not_paid' WHEN 1 THEN 'partial' WHEN 2 THEN 'in_payment' ELSE 'paid' END AS payment_state,
    CAST(date_order AS DATE) + 5 AS invoice_date, partner_id, team_id, user_id, company_id, id % 4 + 1 AS currency_id,
    currency_id AS order_currency_id, amount_total, amount_untaxed,
    CASE id % 5 WHEN 0 THEN amount_total WHEN 1 THEN CAST(round(amount_total * 0.4, 2) AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END AS amount_residual,
    type_id, discount_type, discount_rate
  FROM sale_order WHERE state IN ('sale', 'done')),
invoice_line AS (
  SELECT l.*, i.id AS move_id, i.move_type, i.state AS move_state, i.payment_state, i.invoice_date, i.partner_id, i.company_id, i.currency_id
  FROM sale_order_line l JOIN invoice i ON l.order_id = i.id),
stock_move AS (
  SELECT order_id, line_no, product_id, CASE WHEN product_id % 29 = 0 THEN 'cancel' ELSE 'done' END AS state, product_id % 31 = 0 AS scrapped,
    CASE WHEN product_id % 4 = 0 THEN 3 ELSE 1 END AS uom_id, qty AS quantity, 'customer' AS dest_usage, FALSE AS is_return, FALSE AS to_refund
  FROM sale_order_line WHERE line_status = 'F'
  UNION ALL
  SELECT order_id, line_no, product_id, CASE WHEN product_id % 29 = 0 THEN 'cancel' ELSE 'done' END, product_id % 31 = 0,
    CASE WHEN product_id % 4 = 0 THEN 3 ELSE 1 END, CAST(floor(qty / 2) AS DECIMAL(18,4)), 'internal', TRUE, product_id % 2 = 0
  FROM sale_order_line WHERE return_flag = 'R')
"""


def ratio_sql(numerator: str, denominator: str, digits: int = 4) -> str:
    """Quotient of exact numbers (up to eight decimals) in whole numbers, one half-up rounding; 0 without a denominator."""
    n, d = f"CAST(abs({numerator})::DECIMAL(38,8) * 100000000 AS HUGEINT)", f"CAST(nullif({denominator}, 0)::DECIMAL(38,8) * 100000000 AS HUGEINT)"
    return f"coalesce(sign({numerator}) * ((2 * {n} * {10**digits} + {d}) // (2 * {d}))::DOUBLE / {10**digits}, 0)"
