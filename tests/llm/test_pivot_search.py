"""Pivot search against all inner products."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallygrid.llm import pivot_search, queries

SCHEMA = "vec_id long, embedding array<float>, score long, rank string, row int"


def brute(rows, asked, k):
    """Scores of every query's id against all rows with another id, by whole numbers."""
    valid = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, x in valid:
        if q is None or not asked(q):
            continue
        scores = [(-sum(a * b for a, b in zip(x, y)), i is None, i or 0) for i, y in valid if i != q]
        for rank, (score, missing, i) in enumerate(sorted(scores)[:k], 1):
            out.add((q, rank, None if missing else i, -score))
    return out


def found(spark, rows, asked, k=5, **options):
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA).repartition(3)
    index = pivot_search.build(df, **options)
    return [tuple(r) for r in pivot_search.search(index, asked, k).collect()]


@pytest.fixture(scope="module")
def rows():
    random.seed(5)
    centres = [[random.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [c + random.gauss(0, 0.05) for c in random.choice(centres)]) for i in range(600)]
    rows = [(i, [struct_float(x) for x in v]) for i, v in rows]
    rows += [(1000 + i, rows[50][1]) for i in range(120)]  # copies of one vector: ties
    return rows + [(700, None), (750, [1.0, None]), (800, [float("nan")]), (850, [float("inf"), 1.0]), (900, []), (950, [0.5, -2.0]), (None, rows[3][1])]


def struct_float(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def test_top_k_is_that_of_all_products(spark, rows, monkeypatch):
    monkeypatch.setattr(pivot_search, "FIRST_ROUND", 4)  # many rounds, so the stopping rule decides
    got = found(spark, rows, F.col("id") % 50 == 0)
    assert len(got) == len(set(got)) and set(got) == brute(rows, lambda q: q % 50 == 0, 5)


def test_fewer_rows_than_asked_and_repeated_rows(spark):
    few = [(0, [1.0, 2.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (None, [3.0, 0.0])]
    got = sorted(found(spark, few, F.col("id") == 0), key=lambda r: r[1])
    assert got == [(0, 1, 7, 327680), (0, 2, 7, 327680), (0, 3, None, 196608)]
    assert found(spark, few[:1], F.col("id") == 0) == []


def test_sums_beyond_double_precision_are_whole_numbers(spark):
    big = [(0, [2.0**20, 3.0]), (1, [2.0**24, 1.0]), (2, [2.0**24, 2.0]), (3, [1e30, 0.0])]
    got = {(r[2], r[3]) for r in found(spark, big, F.col("id") == 0, 3)}
    assert got == {(3, 2**63 - 1), (2, 2**60 + 3 * 2 * 65536), (1, 2**60 + 3 * 65536)}


def test_bounds_hold_and_spare_most_candidates_of_clustered_data(rows):
    import numpy as np

    vectors = np.array([[math.floor(256 * x) for x in v] for i, v in rows[:600]], float)
    pivots = pivot_search.spread_out(vectors, 12)
    block = pivot_search.Block(list(range(600)), vectors, pivot_search.distances(vectors, pivots).astype("f4").astype(float))
    bounds = block.bounds(vectors[:40], pivot_search.distances(vectors[:40], pivots).astype("f4").astype(float))
    products = vectors[:40] @ vectors.T
    assert (bounds >= products).all()
    tenth = np.sort(products, axis=1)[:, -10]
    assert (bounds >= tenth[:, None]).mean() < 0.5


def test_empty_table_and_registered_query(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert pivot_search.build(empty) is None
    assert pivot_search.build(spark.createDataFrame([(1, None, 1, "", 1)], SCHEMA)) is None
    empty.select("vec_id", "embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = queries.QUERIES["op11_pivot_top_k"](spark, str(tmp_path))
    assert out.columns == ["query_id", "rank", "vec_id", "score"] and out.count() == 0
