"""Importance resampling of documents towards a target collection, by hashed words and word pairs."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.llm.common import by_batch, sized_batches, stored, utf8

BUCKETS = 10_000
#: Of the documents with at least LEAST_WORDS words, so many in a hundred are drawn.
PERCENT = 25
LEAST_WORDS = 20
SEED = 7
#: Runs of letters and digits; every byte beyond ASCII counts as a letter. Texts are lower-cased before.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Stands between the texts of a batch; it is no part of a word.
SENTINEL = b"\x00"
#: Width of the bins in which the cut-off score is first looked for.
BIN = 1000


def batch_features(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of words of each text, its number of features, buckets of all features text by text).

    The texts are joined and searched once. Where a word's text is not its predecessor's, the pair of the two is masked.
    The checksum of a pair goes on from that of its first word, so no pair is ever written out.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts_of = np.concatenate([[0], np.cumsum(lengths + len(SENTINEL))[:-1]])
    words, starts = [], []
    for found in WORD.finditer(SENTINEL.join(texts).lower()):
        words.append(found.group())
        starts.append(found.start())
    text_of = np.searchsorted(starts_of, np.array(starts, np.int64), "right") - 1
    n_words = np.bincount(text_of, minlength=len(texts))
    singles = list(map(crc32, words))
    spaced = map(crc32, repeat(b" "), singles)
    pairs = np.fromiter(map(crc32, words[1:], spaced), np.int64, max(0, len(words) - 1))
    inside = text_of[1:] == text_of[:-1]
    bucket = np.concatenate([np.array(singles, np.int64), pairs[inside]]) % buckets
    owner = np.concatenate([text_of, text_of[1:][inside]])
    return n_words, np.bincount(owner, minlength=len(texts)), bucket[np.argsort(owner, kind="stable")]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(id, n_words, n_features, buckets) of whole texts; ``buckets`` holds each feature's bucket as 32 bits.

    Null and wordless texts have no features. Repeated rows stay, other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in sized_batches(batch, 1):
                n_words, n_features, bucket = batch_features(utf8(part.column(1)), buckets)
                packed = np.split(bucket.astype("<u4"), np.cumsum(n_features)[:-1])
                yield {id_col: part.column(0), "n_words": n_words, "n_features": n_features, "buckets": [x.tobytes() for x in packed]}

    return by_batch(docs.select(id_col, text_col), f"`{id_col}` {kind}, n_words long, n_features long, buckets binary", run)


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows fall into each bucket; every task sends at most one row for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]):
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                counts += np.bincount(np.frombuffer(packed.as_py(), "<u4"), minlength=buckets)
        used = np.flatnonzero(counts)
        yield {"bucket": used, "n": counts[used]}

    counts = np.zeros(buckets, np.int64)
    for bucket, n in by_batch(found.select("buckets"), "bucket int, n long", run).groupBy("bucket").agg(F.sum("n")).collect():
        counts[bucket] = n
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket floor(1000 * ln of its smoothed share in the target over that in the source)."""
    s, t = map(int, (source.sum(), target.sum()))
    n = len(source)
    shares = (((b + 1) * (s + n)) / ((a + 1) * (t + n)) for a, b in zip(source.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(x)) for x in shares], np.int64)


def noise(key: object, seed: int) -> int:
    """A Gumbel number that the key fixes, in thousandths; a null key counts as the empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(found: DataFrame, gain: np.ndarray, id_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """``found`` with ``weight``, the floored mean gain of its features (0 without any), and the noisy ``score``."""
    kind = found.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            keys, n_words, n_features, packed = batch.columns
            weights = []
            for n, value in zip(n_features.to_pylist(), packed, strict=True):
                weights.append(int(gain[np.frombuffer(value.as_py(), "<u4")].sum()) // n if n else 0)
            scores = [w + noise(key, seed) for w, key in zip(weights, keys.to_pylist(), strict=True)]
            yield {id_col: keys, "n_words": n_words, "n_features": n_features, "weight": weights, "score": scores}

    schema = f"`{id_col}` {kind}, n_words long, n_features long, weight long, score long"
    return by_batch(found.select(id_col, "n_words", "n_features", "buckets"), schema, run)


def cut_off(scores: DataFrame, share: int) -> tuple[int, int]:
    """(rows to draw, score of the last one drawn), from counts by bin and then by score inside one bin."""
    bins = dict(scores.groupBy(F.floor(F.col("score") / BIN).alias("bin")).count().collect())
    wanted = share * sum(bins.values()) // 100
    left = wanted
    for b in sorted(bins, reverse=True):
        if left <= bins[b]:
            break
        left -= bins[b]
    if not wanted:
        return 0, 0
    inside = scores.where((F.col("score") >= b * BIN) & (F.col("score") < (b + 1) * BIN))
    for score, n in sorted(inside.groupBy("score").count().collect(), reverse=True):
        left -= n
        if left <= 0:
            return wanted, score
    raise AssertionError("counts by bin and by score differ")


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, ... over all of them: sorted runs, and the number of rows in the runs before.

    No task holds more than one run. The driver and the offsets hold one number for each run.
    """
    runs = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "runs")
    run, inside = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    counts = runs.groupBy(run.alias("__run")).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(F.lit(0)).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__run", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    placed = runs.withColumn("__run", run).join(starts, "__run")
    return placed.withColumn("rank", F.col("__first") + inside + 1).drop("__run", "__at", "__first")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text: str = "text",
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank): ``rank`` numbers the documents drawn, all others have null.

    Each document has the mean log ratio of its features' shares in the target and in all documents, plus Gumbel noise of
    its id; the highest scores are a draw without replacement by these weights. Null ids hash as the empty text and come
    last among ties; repeated rows are drawn one by one. Without target texts all shares count as equal. An empty table
    gives no rows. Clashing columns are not read.
    """
    found = stored(features(docs, id_col, text_col, buckets), "features")
    wanted = features(target.select(F.lit(0).alias("__id"), F.col(target_text).alias("__text")), "__id", "__text", buckets)
    gain = gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets))
    scored = stored(weighted(found, gain, id_col, seed), "scored")
    eligible = F.col("n_words") >= least_words
    wanted_rows, lowest = cut_off(scored.where(eligible).select("score"), percent)
    if not wanted_rows:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    high = eligible & (F.col("score") >= lowest)
    order = [F.col("score").desc(), F.col(id_col).asc_nulls_last(), F.col("n_features"), F.col("__row")]
    numbered = scored.where(high).withColumn("__row", F.monotonically_increasing_id())
    drawn = ranked(numbered, order).drop("__row")
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= wanted_rows, F.col("rank")))
    return drawn.unionByName(scored.where(~high).withColumn("rank", F.lit(None).cast("long")))
