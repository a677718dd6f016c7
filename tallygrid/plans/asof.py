"""As-of lookup of rates by day: equi joins for a short rate table, a sorted merge for any other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrid.plans.skew import pick_last
from tallygrid.session import staged

#: Rate rows up to which the lookup is an equi join on intervals that Spark can send to all tasks.
SHORT_TABLE = 20_000
#: Facts of a key up to which the merge is one window over each key; with a longer key the rows are cut into runs.
SHORT_KEY = 100_000


def asof_join(
    facts: DataFrame, rates: DataFrame, keys: Sequence[str], day: str, values: Sequence[str], short: int = SHORT_TABLE
) -> DataFrame:
    """Attach the rate row with the latest ``date`` not after ``day`` (highest id on one date).

    The rates are counted, as far as ``short``: a table within it is met by interval, a longer one is merged with the
    facts in order. Both give the same rows.
    """
    if rates.limit(short + 1).count() > short:
        return merge_asof(facts, rates, keys, day, values)
    return interval_asof(facts, rates, keys, day, values)


def merge_asof(
    facts: DataFrame, rates: DataFrame, keys: Sequence[str], day: str, values: Sequence[str], short: int = SHORT_KEY
) -> DataFrame:
    """The same lookup for rate tables and keys of any size: facts and rates are stacked and the last rate is carried forward.

    The facts of each key are counted. Where no key has more than ``short``, nor more than one rate a day, rows are dealt by
    key and one window over each key carries the rate; with a longer key all rows are cut into sorted runs. Both give the
    same rows. Facts with a null key or day, or before the first rate, get nulls.
    """
    keys = list(keys)
    names = [f"_k{i}" for i in range(len(keys))]
    daily = pick_last(rates.dropna(subset=[*keys, "date"]), [*keys, "date"], [F.col("id")], values)
    found = F.struct(*[F.col(v).alias(v) for v in values])
    marks = daily.select(
        *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("date").cast("date").alias("_day"), F.lit(0).alias("_kind"),
        found.alias("_rate"), F.lit(None).cast(facts.schema).alias("_fact"),
    )
    row = F.struct(*[F.col(f"`{c}`") for c in facts.columns])
    asked = facts.select(
        *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(day).cast("date").alias("_day"), F.lit(1).alias("_kind"),
        F.lit(None).cast(marks.schema["_rate"].dataType).alias("_rate"), row.alias("_fact"),
    )
    each = facts.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).count()
    longest = each.agg(F.max("count")).first()[0] or 0
    best = _carried_by_key(marks, asked, names) if longest <= short else _carried_by_run(marks, asked, names, facts)
    return best.select(*[F.col("_fact")[c].alias(c) for c in facts.columns], *[F.col("_best")[v].alias(v) for v in values])


def _carried_by_key(marks: DataFrame, asked: DataFrame, names: Sequence[str]) -> DataFrame:
    """(_fact, _best) by one window over each key."""
    inside = W.partitionBy(*names).orderBy("_day", "_kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    carried = marks.unionByName(asked).withColumn("_last", F.last("_rate", ignorenulls=True).over(inside)).filter("_kind = 1")
    return carried.select("_fact", F.when(F.col("_day").isNotNull(), F.col("_last")).alias("_best"))


def _carried_by_run(marks: DataFrame, asked: DataFrame, names: Sequence[str], facts: DataFrame) -> DataFrame:
    """(_fact, _best) by one sorted merge, without meeting facts by key.

    Facts and rates are cut into sorted runs by ranges of (keys, date, kind, row hash), so the facts of one
    key, even of one day, are spread over many runs (only rows alike in all columns stay together); the runs are written once. Inside a run the last rate is carried
    forward; a key that began in an earlier run starts with the last rate the runs before hold of it.
    """
    plain = [F.col("_fact")[c] for c, t in facts.dtypes if "map<" not in t]  # maps have no hash
    marks = marks.withColumn("_spread", F.lit(0).cast("bigint"))
    asked = asked.withColumn("_spread", F.xxhash64(*plain))
    along = [F.col(c).asc_nulls_first() for c in (*names, "_day", "_kind", "_spread")]
    runs = marks.unionByName(asked).repartitionByRange(*along).sortWithinPartitions(*along)
    runs = staged(runs.drop("_spread").withColumn("_at", F.monotonically_increasing_id()), "asof").withColumn("_run", F.shiftright("_at", 33))
    # a run's last rate of each key; a fact-only part of a key has none and takes over what came before
    ends = runs.groupBy("_run", *names).agg(F.max_by("_rate", F.when(F.col("_kind") == 0, F.col("_at"))).alias("_end"))
    before = W.partitionBy(*names).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    heads = ends.select(
        F.col("_run").alias("_h_run"), *[F.col(n).alias(f"_h{n}") for n in names], F.last("_end", ignorenulls=True).over(before).alias("_head")
    ).filter("_head IS NOT NULL")  # only a run's first key can have begun in an earlier run
    inside = W.partitionBy("_run", *names).orderBy("_at").rowsBetween(W.unboundedPreceding, W.currentRow)
    carried = runs.withColumn("_last", F.last("_rate", ignorenulls=True).over(inside)).filter("_kind = 1")
    same = [F.col("_run") == F.col("_h_run"), *[F.col(n) == F.col(f"_h{n}") for n in names]]
    best = F.when(F.col("_day").isNotNull(), F.coalesce("_last", "_head"))
    return carried.join(heads, same, "left").select("_fact", best.alias("_best"))


def interval_asof(facts: DataFrame, rates: DataFrame, keys: Sequence[str], day: str, values: Sequence[str]) -> DataFrame:
    """The lookup by intervals. Rates become validity intervals. Closed ones are listed under each month they touch, so facts
    meet them by (keys, month) and at most one interval fits; the open last interval of a key joins by key.
    """
    keys = list(keys)
    daily = pick_last(rates, [*keys, "date"], [F.col("id")], values)
    ends = F.lead("date").over(W.partitionBy(*keys).orderBy("date"))
    spans = daily.withColumn("_to", ends)
    months = F.sequence(F.trunc("date", "month"), F.trunc(F.date_sub("_to", 1), "month"), F.expr("interval 1 month"))
    closed = spans.filter("_to IS NOT NULL").select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("date").alias("_from"),
        "_to",
        *[F.col(v).alias(f"_c_{v}") for v in values],
        F.explode(months).alias("_month"),
    )
    last = spans.filter("_to IS NULL").select(
        *[F.col(k).alias(f"_l_{k}") for k in keys], F.col("date").alias("_since"), *[F.col(v).alias(f"_o_{v}") for v in values]
    )
    d = F.col(day).cast("date")
    on_closed = (F.trunc(d, "month") == F.col("_month")) & (d >= F.col("_from")) & (d < F.col("_to"))
    on_last = d >= F.col("_since")
    for k in keys:
        on_closed &= F.col(k) == F.col(f"_k_{k}")
        on_last &= F.col(k) == F.col(f"_l_{k}")
    return facts.join(closed, on_closed, "left").join(last, on_last, "left").select(
        *[facts[c] for c in facts.columns], *[F.coalesce(f"_o_{v}", f"_c_{v}").alias(v) for v in values]
    )


def asof_rate(facts: DataFrame, rates: DataFrame, day: str) -> DataFrame:
    """Latest rate of the fact's category and company, else the latest rate without category.

    ``rates`` is (id, company_id, categ_id, date, rate).
    """
    own = rates.filter(F.col("categ_id").isNotNull()).withColumnRenamed("rate", "_own")
    general = rates.filter(F.col("categ_id").isNull()).withColumnRenamed("rate", "_general")
    step = asof_join(facts, own, ["company_id", "categ_id"], day, ["_own"])
    return asof_join(step, general, ["company_id"], day, ["_general"]).withColumn(
        "rate", F.coalesce("_own", "_general")
    ).drop("_own", "_general")


def convert_currency(facts: DataFrame, rates: DataFrame, amount: str, source: str, target: str, day: str, out: str) -> DataFrame:
    """Amount from currency column ``source`` to ``target`` at the rates of ``day``, rounded to the cent.

    ``rates`` is (id, currency_id, date, rate): units of the currency per unit of company currency.
    """
    from_rates = rates.withColumnRenamed("currency_id", source).withColumnRenamed("rate", "_rate_from")
    to_rates = rates.withColumnRenamed("currency_id", target).withColumnRenamed("rate", "_rate_to")
    step = asof_join(facts, from_rates, [source], day, ["_rate_from"])
    step = asof_join(step, to_rates, [target], day, ["_rate_to"])
    exact = F.col(amount) * F.col("_rate_to") / F.col("_rate_from")
    return step.withColumn(out, F.round(exact, 2).cast("decimal(18,2)")).drop("_rate_from", "_rate_to")
