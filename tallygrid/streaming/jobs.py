"""Streaming jobs: live revenue, live counts, exception alerts, due workflow actions.

Each job is a streaming DataFrame; :func:`run_available` drives one to the end of the available input. A micro-batch
writes its own folder by overwriting, so a batch that is run again after a failure leaves no
duplicates. Checkpoints and output live in the shared folder.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.functions.money import MONEY
from tallygrid.operators.automation import workflow_stage_select
from tallygrid.operators.checks import ExceptionRule, failing


def stream_daily_revenue(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Revenue and count of purchases per day (tumbling window)."""
    sold = events.filter(F.col("event_type") == "purchase").select(F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast(MONEY).alias("value"))
    return (
        sold.withWatermark("ts", late)
        .groupBy(F.window("ts", "1 day").alias("w"))
        .agg(F.sum("value").alias("revenue"), F.count("*").alias("orders"))
        .select(F.col("w.start").cast("date").alias("day"), "revenue", "orders")
    )


def stream_core_metrics(events: DataFrame) -> DataFrame:
    """Running count and value per kind of event; the state is one row per kind."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast(MONEY)).alias("value"))


def stream_exception_alerts(orders: DataFrame, partners: DataFrame, rules: Sequence[ExceptionRule]) -> DataFrame:
    """Arriving orders that break a rule, each (order, rule) once; customers are joined as a static table.

    What was told is kept as state without a time limit, so a file that is delivered again, however late, tells nothing twice.
    """
    own = partners.select(F.col("id").alias("partner_id"), F.nullif("sale_warn", F.lit("")).alias("partner_warning"), F.col("zip").alias("ship_zip"))
    tests = [(r.name, F.expr(r.condition)) for r in rules if r.level == "order"]
    return failing(orders.join(own, "partner_id", "left"), *tests).select("id", F.col("reason").alias("rule")).dropDuplicates(["id", "rule"])


def stream_workflow_actions(orders: DataFrame, workflows: DataFrame, stages: Mapping[str, str]) -> DataFrame:
    """Due actions of arriving orders, each (order, action) once.

    No watermark drops late orders, and the state has no time limit: one row for each action ever taken, which is what
    "once" needs when files come late or again. It lies in the checkpoint folder, by hash of (order, action).
    """
    return workflow_stage_select(orders, workflows, stages).select("id", "action").dropDuplicates(["id", "action"])


def run_available(stream: DataFrame, mode: str, folder: str) -> str:
    """Run a streaming query over all available input; returns the folder with one sub-folder per batch."""
    out = f"{folder}/out"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    return out


def latest_per_key(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """State of an updating stream: the row of the last batch per key."""
    rows = spark.read.option("basePath", out).parquet(out)
    values = [c for c in rows.columns if c not in keys and c != "batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(*keys, "_v.*")


def all_batches(spark: SparkSession, out: str) -> DataFrame:
    """Everything an appending stream wrote."""
    return spark.read.option("basePath", out).parquet(out).drop("batch")
