"""Streaming queries, run over the available input and compared with the batch result."""

from __future__ import annotations

import uuid

from tallygrid.operators.automation import ORDER_STAGES
from tallygrid.operators.checks import exception_catalog
from tallygrid.session import shared_dir
from tallygrid.sources.rules import rows
from tallygrid.sources.star import Star
from tallygrid.streaming import jobs
from workload.checks import FLOW_SCHEMA, FLOWS
from workload.registry import query


def folder(s: Star) -> str:
    return f"{shared_dir(s.spark)}/streams/{uuid.uuid4().hex}"


def arriving_orders(s: Star):
    """The orders as files in a shared folder, in about six batches: four by date, then all of 1995 and the first year again."""
    raw, out = s.table("orders"), folder(s)
    years = ["o_orderdate < '1994-01-01'", "year(o_orderdate) = 1994", "year(o_orderdate) = 1996", "o_orderdate >= '1997-01-01'", "year(o_orderdate) = 1995", "year(o_orderdate) = 1992"]
    for part in years:
        raw.where(part).write.mode("append").parquet(out)
    files = len(s.spark.read.schema(raw.schema).parquet(out).inputFiles())
    return s.orders(s.spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", -(-files // len(years))).parquet(out))


@query("stream_daily_revenue", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, sum(CAST(value AS DECIMAL(18,2)))::DOUBLE AS revenue, count(*) AS orders FROM events WHERE event_type = 'purchase' GROUP BY 1")
def _(s):
    out = jobs.run_available(jobs.stream_daily_revenue(s.stream("events")), "update", folder(s))
    return jobs.latest_per_key(s.spark, out, ["day"])


@query("stream_core_metrics", "SELECT event_type, count(*) AS n, sum(CAST(value AS DECIMAL(18,2)))::DOUBLE AS value FROM events GROUP BY 1")
def _(s):
    out = jobs.run_available(jobs.stream_core_metrics(s.stream("events")), "complete", folder(s))
    return jobs.latest_per_key(s.spark, out, ["event_type"])


@query("stream_exception_alerts", "SELECT o.id, 'no zip' AS rule FROM sale_order o LEFT JOIN partner p ON p.id = o.partner_id WHERE zip IS NULL UNION ALL SELECT o.id, 'partner warning' FROM sale_order o JOIN partner p ON p.id = o.partner_id WHERE sale_warn <> '' UNION ALL SELECT id, 'total is 0' FROM sale_order WHERE amount_total = 0")
def _(s):
    rules = [r for r in exception_catalog() if r.name != "no lines"]
    alerts = jobs.stream_exception_alerts(arriving_orders(s), s.partners(), rules)
    return jobs.all_batches(s.spark, jobs.run_available(alerts, "append", folder(s)))


@query("stream_workflow_actions", """SELECT id, 'validate_order' AS action FROM sale_order WHERE workflow_id IN (1, 2) AND state = 'draft' UNION ALL SELECT id, 'create_invoice' FROM sale_order WHERE workflow_id = 1 AND state IN ('sale','done') AND invoice_status = 'to invoice'
UNION ALL SELECT id, 'sale_done' FROM sale_order WHERE workflow_id = 2 AND state = 'sale' AND invoice_status = 'invoiced'""")
def _(s):
    flows = rows(s.spark, FLOW_SCHEMA, FLOWS)
    actions = jobs.stream_workflow_actions(arriving_orders(s), flows, ORDER_STAGES)
    return jobs.all_batches(s.spark, jobs.run_available(actions, "append", folder(s))).select("id", "action")
