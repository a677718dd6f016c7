"""Shards along a Hilbert curve through quantised metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits per dimension; 2 ** (bits * dimensions) cells, which bounds what is broadcast.
BITS = 4
MAX_CELLS = 1 << 16
#: Groups into which the rows of one cell are split for ranking.
SUBGROUPS = 256


def _number(df: DataFrame, column: str) -> Column:
    """A number in the column's order; of texts the first seven bytes."""
    if isinstance(df.schema[column].dataType, T.NumericType):
        return F.col(column).cast("double")
    prefix = F.substring(F.col(column).cast("string").cast("binary"), 1, 7)
    return F.conv(F.rpad(F.hex(prefix), 14, "0"), 16, 10).cast("double")


def _quantised(df: DataFrame, columns: list[str], bits: int) -> DataFrame:
    """Adds q0, q1, ... with values below 2 ** bits: as many cuts as there are, at the quantiles of each dimension."""
    numbers = df.select("*", *[_number(df, c).alias(f"__v{i}") for i, c in enumerate(columns)])
    shares = [k / 2**bits for k in range(1, 2**bits)]
    cuts = numbers.agg(*[F.percentile_approx(f"__v{i}", shares).alias(f"__c{i}") for i in range(len(columns))]).first()
    for i in range(len(columns)):
        bounds = sorted({float(x) for x in cuts[i] or []})
        value = F.col(f"__v{i}")
        level = sum((F.when(value > b, 1).otherwise(0) for b in bounds), F.lit(0))
        numbers = numbers.withColumn(f"q{i}", level.cast("int"))
    return numbers.drop(*[f"__v{i}" for i in range(len(columns))])


def _trailing_ones(w: int) -> int:
    return (~w & (w + 1)).bit_length() - 1


def hilbert_cells(spark, dimensions: int, bits: int) -> DataFrame:
    """(q0, q1, ..., hilbert) for every cell of the cube with 2 ** bits values on each side.

    From the highest bit down, the bits of all axes select one sub-cube. Its number is the inverse Gray code of these
    bits, seen from the corner ``e`` where the curve enters and the axis ``d`` along which it leaves.
    """
    n, side = dimensions, 1 << bits
    if side**n > MAX_CELLS:
        raise ValueError(f"{n} dimensions of {bits} bits give more than {MAX_CELLS} cells")
    gray = {w ^ (w >> 1): w for w in range(1 << n)}
    number = [gray[g] for g in range(1 << n)]
    enters = [0 if w == 0 else (v := 2 * ((w - 1) // 2)) ^ (v >> 1) for w in range(1 << n)]
    leaves = [0 if w == 0 else _trailing_ones(w if w % 2 else w - 1) % n for w in range(1 << n)]

    def listed(values: list[int]) -> str:
        return f"array({', '.join(map(str, values))})"

    mask = (1 << n) - 1
    turned = f"(shiftright(l ^ s.e, (s.d + 1) % {n}) | shiftleft(l ^ s.e, {n} - (s.d + 1) % {n})) & {mask}"
    corner = f"{listed(enters)}[w]"
    back = f"(shiftleft({corner}, (s.d + 1) % {n}) | shiftright({corner}, {n} - (s.d + 1) % {n})) & {mask}"
    levels = listed([" + ".join(f"{1 << j} * (shiftright(q{j}, {b}) & 1)" for j in range(n)) for b in range(bits - 1, -1, -1)])
    index = f"""aggregate({levels}, named_struct('h', 0, 'e', 0, 'd', 0), (s, l) -> transform(
        array({listed(number)}[{turned}]),
        w -> named_struct('h', s.h * {1 << n} + w, 'e', s.e ^ ({back}), 'd', (s.d + {listed(leaves)}[w] + 1) % {n}))[0]).h"""
    cells = spark.range(0, side**n, 1, 1).select(*[F.expr(f"int((id div {side**i}) % {side})").alias(f"q{i}") for i in range(n)])
    return cells.select("*", F.expr(index).alias("hilbert"))


def hilbert_ranked(docs: DataFrame, dimensions: list[str], order: list[str], bits: int = BITS) -> DataFrame:
    """``docs`` with ``hilbert``, ``rank`` (0, 1, ... along the curve) and ``total``.

    No row is ranked against all others: rows are counted by cell and by a hash of their order columns, offsets come from
    these counts (at most MAX_CELLS cells), and only the rows of one such group are numbered together.
    Null metadata count as the lowest value. Repeated rows get neighbouring ranks; an empty table stays empty.
    """
    qs = [f"q{i}" for i in range(len(dimensions))]
    cells = hilbert_cells(docs.sparkSession, len(dimensions), bits)
    placed = _quantised(docs, dimensions, bits).join(F.broadcast(cells), qs).drop(*qs)
    placed = placed.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(SUBGROUPS)).cast("int"))
    counts = placed.groupBy("hilbert", "part").agg(F.count("*").alias("n"))
    by_cell = counts.groupBy("hilbert").agg(F.sum("n").alias("cell_n"))
    along = Window.partitionBy(F.lit(0)).orderBy("hilbert")  # at most MAX_CELLS rows
    by_cell = by_cell.select(
        "hilbert",
        (F.sum("cell_n").over(along) - F.col("cell_n")).alias("cell_first"),
        F.sum("cell_n").over(Window.partitionBy(F.lit(0))).alias("total"),
    )
    within = Window.partitionBy("hilbert").orderBy("part")  # at most SUBGROUPS rows
    starts = counts.withColumn("before", F.sum("n").over(within) - F.col("n")).join(by_cell, "hilbert")
    starts = starts.select("hilbert", "part", (F.col("cell_first") + F.col("before")).alias("first"), "total")
    inside = F.row_number().over(Window.partitionBy("hilbert", "part").orderBy(*order))
    return (
        placed.withColumn("inside", inside)
        .join(starts, ["hilbert", "part"])
        .withColumn("rank", F.col("first") + F.col("inside") - 1)
        .drop("part", "inside", "first")
    )


def shard_rows(ranked: DataFrame, shards: int) -> DataFrame:
    """Cuts the curve into ``shards`` runs whose row counts differ by at most one: adds ``shard`` and ``slot``."""
    shard = F.expr(f"int((rank * {shards}) div total)")
    return ranked.withColumn("shard", shard).withColumn(
        "slot", F.expr(f"rank - (shard * total + {shards - 1}) div {shards}")
    )


def write_shards(sharded: DataFrame, path: str, files_per_shard: int = 8) -> None:
    """One folder for each shard, its files being consecutive runs of the curve, so min/max statistics prune them."""
    share = F.expr(f"int((slot * {files_per_shard}) div greatest(1, max_slot + 1))")
    most = sharded.groupBy("shard").agg(F.max("slot").alias("max_slot"))
    runs = sharded.join(F.broadcast(most), "shard").withColumn("run", share).drop("max_slot")
    runs.repartition("shard", "run").sortWithinPartitions("shard", "slot").drop("run").write.partitionBy("shard").parquet(path)
