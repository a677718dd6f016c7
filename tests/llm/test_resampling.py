"""Importance resampling against plain counting of every word and word pair."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import pytest

from tallygrid.llm import queries, resampling

SCHEMA = "doc_id long, text string, weight int, score string, rank int, bucket int, n string"


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain(rows, target, buckets=10000, percent=25, least=20, seed=7):
    of = lambda f: crc32(f.encode()) % buckets
    s, t = (Counter(of(f) for text in texts for f in plain_features(text)[1]) for texts in ([x for _, x in rows], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        words, found = plain_features(text)
        weight = sum(gain[of(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least))
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    ranks = [(r[:4], n if n <= percent * len(able) // 100 else None) for n, r in enumerate(able, 1)]
    return sorted(((*r, n) for r, n in ranks + [(r[:4], None) for r in out if not r[4]]), key=str)


COLUMNS = ["doc_id", "n_features", "weight", "score", "rank"]


def texts():
    base = "The quick brown Fox-jumps over 23 lazy dögs, and so on it goes until there are enough words in here"
    rows = [(i, f"{base} {i} " + " ".join(f"w{j % (i + 1)}" for j in range(i))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "-- ."), (103, "one"), (104, "a\x00b A\x00B"), (105, " ".join(f"long{i}" for i in range(30000)))]
    return rows + [(7, rows[7][1]), (7, rows[7][1]), (None, rows[3][1]), (None, rows[3][1])]


@pytest.mark.parametrize("target", [["quick w1 w2 w3", None, "dögs 23"], []])
def test_ranks_and_weights_are_those_of_plain_counting(spark, target):
    rows = texts()
    docs = spark.createDataFrame([(i, t, 1, "x", 2, 3, "y") for i, t in rows], SCHEMA).repartition(4)
    wanted = spark.createDataFrame([(1, t, 1, "x", 2, 3, "y") for t in target], SCHEMA)
    for options in ({}, {"percent": 100, "least_words": 1}, {"percent": 0}):
        got = resampling.resample(docs, wanted, **options).select(COLUMNS).collect()
        known = {"least_words": "least"}
        assert sorted(map(tuple, got), key=str) == plain(rows, target, **{known.get(k, k): v for k, v in options.items()})


def test_pairs_do_not_cross_texts():
    n_words, n_features, bucket = resampling.batch_features([b"a b", b"", b"c", b"d e f"], 1 << 32)
    assert n_words.tolist() == [2, 0, 1, 3] and n_features.tolist() == [3, 0, 1, 5]
    assert bucket.tolist() == [crc32(x) for x in (b"a", b"b", b"a b", b"c", b"d", b"e", b"f", b"d e", b"e f")]


def test_registered_query_and_empty_tables(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = queries.QUERIES["op13_importance_resampling"](spark, sf).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, target)
    empty = spark.createDataFrame([], SCHEMA)
    assert resampling.resample(empty, empty).count() == 0
