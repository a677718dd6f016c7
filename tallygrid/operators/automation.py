"""What scheduled jobs would pick up: workflow stages, warehouse automation, approvals, defaults."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def workflow_stage_select(documents: DataFrame, workflows: DataFrame, stages: Mapping[str, str]) -> DataFrame:
    """(document, action) for every due stage, in one pass.

    ``stages`` maps an action to a SQL condition over the document and its workflow's flags.
    """
    joined = documents.join(workflows.withColumnRenamed("id", "workflow_id"), "workflow_id")
    actions = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(a)) for a, c in stages.items()]))
    return joined.withColumn("action", F.explode(actions))


# The standard stages by kind of document.
ORDER_STAGES = {
    "validate_order": "validate_order AND state = 'draft'",
    "create_invoice": "create_invoice AND state IN ('sale', 'done') AND invoice_status = 'to invoice'",
    "sale_done": "sale_done AND state = 'sale' AND invoice_status = 'invoiced'",
}
INVOICE_STAGES = {
    "validate_invoice": "validate_invoice AND state = 'draft'",
    "register_payment": "register_payment AND state = 'posted' AND payment_state = 'not_paid'",
}
PICKING_STAGES = {"validate_picking": "validate_picking AND state IN ('draft', 'confirmed', 'assigned')"}


def warehouse_automation_select(orders: DataFrame, warehouses: DataFrame, invoices: DataFrame, pickings: DataFrame) -> DataFrame:
    """Confirmed orders with the steps their warehouse asks for and that are still missing."""
    billed = invoices.groupBy("order_id").agg(F.bool_or(F.col("state") == "draft").alias("_draft"), F.count("*").alias("_invoices"))
    open_moves = pickings.filter(~F.col("state").isin("done", "cancel")).select("order_id").distinct().withColumn("_open", F.lit(True))
    flags = warehouses.withColumnRenamed("id", "warehouse_id")
    joined = (
        orders.filter(F.col("state").isin("sale", "done"))
        .join(flags, "warehouse_id")
        .join(billed, F.col("id") == billed.order_id, "left")
        .drop("order_id")
        .join(open_moves, F.col("id") == open_moves.order_id, "left")
        .drop("order_id")
    )
    steps = (
        ("deliver", F.col("delivery_done") & F.coalesce("_open", F.lit(False))),
        ("invoice", F.col("make_invoice") & F.col("_invoices").isNull()),
        ("post", F.col("post_invoice") & F.coalesce("_draft", F.lit(False))),
    )
    missing = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in steps]))
    return joined.select("id", F.explode(missing).alias("step"))


def amount_approval(orders: DataFrame, threshold: float, approver: bool) -> DataFrame:
    """Orders over the threshold wait for approval unless the caller may approve."""
    wait = F.col("state").isin("draft", "sent") & (F.col("amount_total") > F.lit(threshold)) & F.lit(not approver)
    return orders.withColumn("state_after", F.when(wait, F.lit("to_approve")).when(F.col("state").isin("draft", "sent"), F.lit("sale")).otherwise(F.col("state")))


def discount_approval(documents: DataFrame, limit: float) -> DataFrame:
    """Open documents with a percent discount over the limit wait for approval."""
    over = (F.col("discount_type") == "percent") & (F.col("discount_rate") > F.lit(limit))
    return documents.withColumn("approval_state", F.when(F.col("state").isin("draft", "sent") & over, F.lit("waiting_approval")).otherwise(F.col("state")))


def bulk_discount_update(documents: DataFrame, kind: str | None, rate: float, limit: float) -> DataFrame:
    """Set (or, without a kind, reset) the discount of chosen documents, or say why not."""
    closed = ~F.col("state").isin("draft", "sent")
    too_much = F.lit(kind == "percent") & (F.lit(rate) > 100)
    reject = F.when(closed, F.lit("not open")).when(too_much, F.lit("over 100 percent"))
    new_rate = F.when(reject.isNull(), F.lit(rate if kind else 0.0)).otherwise(F.col("discount_rate").cast("double"))
    waits = reject.isNull() & F.lit(kind == "percent") & (F.lit(rate) > limit)
    return documents.select(
        "id", reject.alias("rejected"), new_rate.alias("discount_rate"), F.when(waits, F.lit("waiting_approval")).otherwise(F.col("state")).alias("approval_state")
    )


def bulk_discount_decision(documents: DataFrame, approve: bool) -> DataFrame:
    """Approve or reject waiting documents; others are reported."""
    waiting = F.col("approval_state") == "waiting_approval"
    after = F.when(waiting, F.lit("approved" if approve else "rejected")).otherwise(F.col("approval_state"))
    return documents.select("id", after.alias("approval_state"), F.when(~waiting, F.lit("not waiting")).alias("rejected"))


def approver_queue(orders: DataFrame, team_approvers: DataFrame, order_approvers: DataFrame) -> DataFrame:
    """Approval status and next approver of open orders, after copying missing team approvers.

    ``team_approvers`` is (team_id, user_id, sequence); ``order_approvers`` (order_id, user_id, sequence, approved).
    """
    open_ = orders.filter(F.col("state").isin("draft", "sent")).select(F.col("id").alias("order_id"), "team_id")
    missing = open_.join(team_approvers, "team_id").join(order_approvers.select("order_id", "user_id"), ["order_id", "user_id"], "left_anti")
    known = order_approvers.join(open_.select("order_id"), "order_id", "left_semi").select("order_id", "user_id", "sequence", "approved")
    everyone = known.unionByName(missing.select("order_id", "user_id", "sequence", F.lit(False).alias("approved")))
    pending = everyone.filter(~F.col("approved")).groupBy("order_id").agg(F.min_by("user_id", F.struct("sequence", "user_id")).alias("next_approver"))
    return open_.join(pending, "order_id", "left").select(
        "order_id", "next_approver", F.when(F.col("next_approver").isNull(), F.lit("Fully Approved")).otherwise(F.lit("Pending Approval")).alias("approval_status")
    )


def partner_default_fill(orders: DataFrame, sources: Sequence[tuple[DataFrame, str, str]], column: str) -> DataFrame:
    """Fill an order column from the first source that has a value.

    A source is (table, order column that points to it, value column); its key is ``id``.
    """
    out, found = orders, []
    for n, (table, key, value) in enumerate(sources):
        found.append(f"_s{n}")
        out = out.join(table.select(F.col("id").alias(key), F.col(value).alias(f"_s{n}")), key, "left")
    return out.withColumn(column, F.coalesce(F.col(column), *found) if column in orders.columns else F.coalesce(*found)).drop(*found)


def parent_propagation(partners: DataFrame, changes: DataFrame, column: str) -> DataFrame:
    """Children that are empty or still hold the old value take the parent's new one.

    ``changes`` is (id, old_value, new_value) of parents.
    """
    moved = changes.select(F.col("id").alias("parent_id"), F.col("old_value").alias("_old"), F.col("new_value").alias("_new"), F.lit(True).alias("_changed"))
    joined = partners.join(moved, "parent_id", "left")
    take = F.coalesce("_changed", F.lit(False)) & (F.col(column).isNull() | F.col(column).eqNullSafe(F.col("_old")))
    return joined.withColumn(column, F.when(take, F.col("_new")).otherwise(F.col(column))).drop("_old", "_new", "_changed")


# -- leads --------------------------------------------------------------------------------


def stage_probability_apply(leads: DataFrame, stages: DataFrame) -> DataFrame:
    """Leads take their stage's probability where the stage asks for it; a flag says whether they match."""
    rules = stages.select(F.col("id").alias("stage_id"), F.col("probability").alias("_p"), "on_change")
    joined = leads.join(rules, "stage_id", "left")
    new: Column = F.when(F.coalesce("on_change", F.lit(False)), F.col("_p")).otherwise(F.col("probability"))
    return joined.withColumn("probability", new).withColumn("matches_stage", F.col("probability").eqNullSafe(F.col("_p"))).drop("_p", "on_change")


def stage_lead_count(leads: DataFrame) -> DataFrame:
    return leads.groupBy("stage_id").agg(F.count("*").alias("lead_count"))


