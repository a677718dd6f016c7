"""Exact inner-product search with a table of distances to pivots."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.llm.common import by_batch, stored

#: Components are multiplied by this and floored.
SCALE = 256
#: Pivots, and the rows (by a hash of the id and vector, about so many) from which they are chosen.
PIVOTS = 24
SAMPLE = 1024
#: Rows of a block of candidates, all of which one task holds.
BLOCK_ROWS = 1 << 15
#: Queries bounded together, and the candidates scored first; each further round scores twice as many.
QUERY_ROWS = 32
FIRST_ROUND = 128
#: Distances are kept in single precision; bounds are widened by more than its error, as a share of the squared distance.
SLACK = 2.0**-20
LONG = (1 - 2**63, 2**63 - 1)


class PivotIndex(NamedTuple):
    """``rows``: (id, vector, row, distances) of every row; the other fields describe them and hold the sample."""

    rows: DataFrame
    pivots: np.ndarray
    sample: np.ndarray
    sample_ids: list
    dimensions: int
    count: int
    scale: int


def integers(vectors: pa.ListArray, dimensions: int, scale: int) -> np.ndarray:
    """floor(scale * x) as doubles, which hold them exactly; shorter vectors are filled with zeros."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(float) * scale)
    out = np.zeros((len(sizes), dimensions))
    out[np.arange(dimensions) < sizes[:, None]] = flat
    return out


def products(vectors: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as longs. Doubles are exact if every sum stays below 2^53; else whole numbers of any size are used.

    A product beyond the range of a long counts as the end of that range.
    """
    if exact:
        return (vectors @ query).astype(np.int64)
    q = [int(x) for x in query]
    whole = (sum(int(x) * y for x, y in zip(v, q, strict=True)) for v in vectors.tolist())
    return np.array([min(max(x, LONG[0]), LONG[1]) for x in whole], np.int64)


def largest(vectors: np.ndarray) -> float:
    return float(np.abs(vectors).max(initial=0))


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances, pivot by pivot, so that no third dimension is needed."""
    return np.column_stack([np.sqrt(((vectors - p) ** 2).sum(axis=1)) for p in pivots])


def spread_out(sample: np.ndarray, count: int) -> np.ndarray:
    """The zero vector, then again and again the sample's vector farthest from all chosen ones."""
    chosen = [np.zeros(sample.shape[1])]
    nearest = ((sample - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < count and nearest.max(initial=0) > 0:
        chosen.append(sample[int(nearest.argmax())])
        nearest = np.minimum(nearest, ((sample - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def build(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, pivots: int = PIVOTS, sample: int = SAMPLE
) -> PivotIndex | None:
    """The index of all rows whose vector is not null and has only finite components; None without such rows.

    The pivots are fitted on about ``sample`` rows. Every row's distances to them are computed once and kept.
    Vectors of several lengths count as filled up with zeros.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    rows = rows.where(F.col("vector").isNotNull() & finite).withColumn("row", F.monotonically_increasing_id())
    count, dimensions = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not count:
        return None
    # a share of the hashes' range, so that no task gets more than its part and repeated rows do not come together
    low = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(min(1.0, sample / count) * (1 << 30))
    picked = rows.where(low).select("id", "vector").toArrow().combine_chunks()
    known = integers(picked.column(1).combine_chunks(), dimensions, scale) if picked.num_rows else np.zeros((0, dimensions))
    chosen = spread_out(known, pivots)
    kind = rows.schema["id"].dataType.simpleString()

    def measured(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            d = distances(integers(batch.column(1), dimensions, scale), chosen).astype(np.float32)
            yield {"id": batch.column(0), "vector": batch.column(1), "row": batch.column(2), "distances": list(d)}

    table = by_batch(rows, f"id {kind}, vector array<double>, row long, distances array<float>", measured)
    return PivotIndex(stored(table, "pivot-table"), chosen, known, picked.column(0).to_pylist(), dimensions, count, scale)


class Block:
    """The candidates of one task in the order of their ids, null ids last."""

    def __init__(self, ids: list, vectors: np.ndarray, table: np.ndarray):
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))
        self.ids = [ids[i] for i in order]
        self.vectors, self.table = vectors[order], np.ascontiguousarray(table[order].T)
        self.norms = (self.vectors**2).sum(axis=1)
        self.largest = largest(self.vectors)
        self.places: dict = {}
        for place, i in enumerate(self.ids):
            self.places.setdefault(i, []).append(place)

    @classmethod
    def of(cls, batches: list[pa.RecordBatch], dimensions: int, scale: int) -> Block:
        rows = pa.Table.from_batches(batches).combine_chunks()
        vectors = integers(rows.column("vector").combine_chunks(), dimensions, scale)
        table = rows.column("distances").combine_chunks().flatten().to_numpy().astype(float)
        return cls(rows.column("id").to_pylist(), vectors, table.reshape(rows.num_rows, -1 if rows.num_rows else 0))

    def bounds(self, queries: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """No inner product of a query with a candidate is larger: the greatest difference of their distances to one pivot
        is the best lower bound on their own distance, and their norms turn it into an upper bound on the product.
        """
        lower = np.zeros((len(queries), len(self.ids)))
        for p, of in enumerate(self.table):
            np.maximum(lower, np.abs(tables[:, p, None] - of), out=lower)
        norms = (queries**2).sum(axis=1)[:, None] + self.norms
        slack = SLACK * (tables.max(axis=1)[:, None] ** 2 + norms) + 1
        return np.floor((norms - lower**2 + slack) / 2)

    def best(self, query: np.ndarray, own: object, bounds: np.ndarray, floor: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, places) of the k highest scores that are not below ``floor``, ties to the first place.

        Candidates are scored in the order of their bounds. The search stops when the next bound cannot beat the k-th
        score found: it is lower, or equal with a later place.
        """
        bounds[self.places.get(own, [])] = -np.inf
        able = np.flatnonzero(bounds >= max(floor, np.finfo(float).min))
        able = able[np.argsort(-bounds[able], kind="stable")]
        exact = self.largest * largest(query) * len(query) < 2.0**53
        scores, places, at, width = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, FIRST_ROUND
        while at < len(able):
            if len(scores) == k and (bounds[able[at]] < scores[-1] or bounds[able[at]] == scores[-1] and able[at] > places[-1]):
                break
            part = able[at : at + width]
            found = products(self.vectors[part], query, exact)
            good = found >= floor
            scores, places = np.concatenate([scores, found[good]]), np.concatenate([places, part[good]])
            first = np.lexsort((places, -scores))[:k]
            scores, places, at, width = scores[first], places[first], at + width, width * 2
        return scores, places


def _asked(index: PivotIndex, queries: Column, k: int) -> DataFrame:
    """(query, id, vector, distances, floor) of the rows to search for, each (id, vector) once.

    ``floor`` is the k-th score among the sample's rows, which the k-th score among all rows cannot fall below.
    """
    pivots, sample, sample_ids, dimensions, _, scale = index[1:]
    most = largest(sample)

    def floors(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            vectors = integers(batch.column(1), dimensions, scale)
            lows = []
            for own, v in zip(batch.column(0).to_pylist(), vectors, strict=True):
                scores = products(sample, v, most * largest(v) * dimensions < 2.0**53)
                scores = np.sort(scores[[i != own for i in sample_ids]])
                lows.append(int(scores[-k]) if len(scores) >= k else None)
            yield {"id": batch.column(0), "vector": batch.column(1), "distances": batch.column(2), "floor": lows}

    kind = index.rows.schema["id"].dataType.simpleString()
    asked = index.rows.where(queries).dropDuplicates(["id", "vector"]).select("id", "vector", "distances")
    low = by_batch(asked, f"id {kind}, vector array<double>, distances array<float>, floor long", floors)
    return stored(low.withColumn("query", F.monotonically_increasing_id()), "queries")


def search(index: PivotIndex, queries: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, id, score) of the ``k`` highest scores of each row that meets ``queries``, against all others.

    ``queries`` is a condition on ``id``. Rows with the query's own id are not its candidates; a query that is repeated is
    asked once, repeated candidates count one by one. Ties go to the smaller id, null ids last.
    Candidates are dealt into blocks of bounded size. A task holds one block and reads the queries one batch after
    another, so all queries meet all blocks without a table of pairs; each block returns at most ``k`` rows of a query.
    """
    blocks = max(-(-index.count // BLOCK_ROWS), index.rows.sparkSession.sparkContext.defaultParallelism)
    dimensions, scale = index.dimensions, index.scale
    missing = F.lit(None).cast("long")
    candidates = index.rows.select(
        F.pmod("row", F.lit(blocks)).cast("int").alias("block"), missing.alias("query"), "id", "vector", "distances", missing.alias("floor")
    )
    asked = _asked(index, queries, k)
    to_all = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = candidates.unionByName(to_all).repartition(blocks, "block").sortWithinPartitions("block", F.col("query").asc_nulls_first())
    kind = index.rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        current, held, block = None, [], None
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for number in np.unique(numbers):
                if number != current:
                    current, held, block = number, [], None
                rows = batch.filter(pa.array(numbers == number))
                is_query = rows.column(1).is_valid()
                held.append(rows.filter(pc.invert(is_query)))
                asked_rows = rows.filter(is_query)
                if asked_rows.num_rows:
                    block = block or Block.of(held, dimensions, scale)
                    yield from _answers(block, asked_rows, dimensions, scale, k)

    found = by_batch(met, f"query long, query_id {kind}, id {kind}, score long", run)
    place = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _answers(block: Block, asked: pa.RecordBatch, dimensions: int, scale: int, k: int) -> Iterator[dict[str, list]]:
    for at in range(0, asked.num_rows, QUERY_ROWS):
        part = asked.slice(at, QUERY_ROWS)
        vectors = integers(part.column(3), dimensions, scale)
        bounds = block.bounds(vectors, np.stack(part.column(4).to_numpy(zero_copy_only=False)).astype(float))
        numbers, ids, lows = (part.column(i).to_pylist() for i in (1, 2, 5))
        out: dict[str, list] = {"query": [], "query_id": [], "id": [], "score": []}
        for i, (number, own, low) in enumerate(zip(numbers, ids, lows, strict=True)):
            scores, places = block.best(vectors[i], own, bounds[i], -np.inf if low is None else low, k)
            out["query"] += [number] * len(scores)
            out["query_id"] += [own] * len(scores)
            out["id"] += [block.ids[p] for p in places]
            out["score"] += scores.tolist()
        yield out
