"""Connected components of a link table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id in a link: the smallest id it can reach.

    Each round a node takes the smallest label among its neighbours and then its label's label, which halves the
    distances; labels are counted, never collected. No links give no rows. Null ids are left out.
    """
    one = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    both = stored(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label"))
    while True:
        seen = labels.select(F.col("u").alias("v"), F.col("label").alias("seen"))
        near = both.join(seen, "v").groupBy("u").agg(F.min("seen").alias("near"))
        nearer = labels.join(near, "u").select("u", "label", F.least("label", "near").alias("better"))
        ahead = nearer.select(F.col("u").alias("better"), F.col("better").alias("ahead"))
        labels = stored(
            nearer.join(ahead, "better").select("u", F.least("better", "ahead").alias("label"), F.col("label").alias("old")),
            "labels",
        )
        moved = not labels.where("label < old").isEmpty()
        labels = labels.drop("old")
        if not moved:
            return labels.select(F.col("u").alias("id"), F.col("label").alias("component"))
