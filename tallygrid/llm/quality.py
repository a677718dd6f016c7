"""Text quality from trusted positives and unlabelled text, by the non-negative unbiased risk."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.common import by_batch, fold, shingle_hashes, small_batches, utf8, word_hashes

#: Of trusted positives and of unlabelled texts, at most so many are used to fit.
FIT_ROWS = 20_000
FOLDS, HELD_OUT = 3, 1
STEPS = 600
RATE = 0.05
DECAY = 1e-4

_KIND = np.zeros(256, np.uint8)  # 0 other symbol
_KIND[97:123] = 1
_KIND[65:91] = 2
_KIND[128:] = 3
_KIND[48:58] = 4
_KIND[[9, 10, 11, 12, 13, 32]] = 5
_KIND[[ord(c) for c in ".,;:'\"-()"]] = 6
_KIND[[ord(c) for c in "!?"]] = 7
_KIND[ord("|")] = 8
_KIND[[ord(c) for c in "*#%&$@^~=+<>_\\/{}[]"]] = 9


def features(text: bytes) -> np.ndarray:
    """Numbers about the form of a whole text: kinds of characters, lengths, repetition. An empty text has a row too."""
    raw = np.frombuffer(text, np.uint8)
    kinds = np.bincount(_KIND[raw], minlength=10) / max(1, len(raw))
    letters = kinds[1] + kinds[2] + kinds[3]
    words = word_hashes(text)
    n = max(1, len(words))
    _, times = np.unique(words, return_counts=True)
    counts = np.bincount(raw, minlength=256)
    share = counts[counts > 0] / max(1, len(raw))
    lines = [line for line in text.split(b"\n") if line.strip()]
    pairs = len(shingle_hashes(words, 2)) / max(1, len(words) - 1)
    triples = len(shingle_hashes(words, 3)) / max(1, len(words) - 2)
    ends = sum(text.count(e) for e in (b". ", b".\n", b"? ", b"! ")) + text.endswith((b".", b"!", b"?"))
    return np.array(
        [
            *kinds,
            kinds[2] / max(letters, 1e-9),
            np.log1p(len(raw)),
            np.log1p(len(words)),
            len(raw) / n,
            len(times) / n,
            np.log1p(len(times)) / np.log1p(n) if len(words) else 0.0,
            times.max(initial=0) / n,
            float((words[1:] == words[:-1]).sum()) / n,
            min(pairs, 1.0),
            min(triples, 1.0),
            float(-(share * np.log2(share)).sum()),
            np.log1p(len(lines)),
            len(set(lines)) / max(1, len(lines)),
            ends / n,
            np.log1p(len(raw) / max(1, len(lines))),
            float(not len(words)),
        ]
    )


N_FEATURES = len(features(b""))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def spread(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([z, z * z, np.maximum(0, z - 1), np.maximum(0, -z - 1), np.ones((len(z), 1))])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.spread(x) @ self.weights, -30, 30)))


def fit(positives: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """Minimises prior * R(+, positives) + max(0, R(-, unlabelled) - prior * R(-, positives)) with the logistic loss.

    While the second part is below zero, which no true risk can be, the step goes the other way on that part. Without
    positives or unlabelled texts every score is the prior.
    """
    both = np.vstack([positives, unlabelled])
    if not len(positives) or not len(unlabelled):
        size = 4 * N_FEATURES + 1
        bias = np.zeros(size)
        bias[-1] = np.log(prior / (1 - prior))
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), bias, prior)
    model = Model(both.mean(0), both.std(0) + 1e-6, np.zeros(4 * N_FEATURES + 1), prior)
    p, u = model.spread(positives), model.spread(unlabelled)
    w, m, v = model.weights.copy(), 0.0, 0.0

    def sigmoid(x):
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    for step in range(1, STEPS + 1):
        gp, gu = p @ w, u @ w
        positive = -prior * (p.T @ sigmoid(-gp)) / len(p)
        negative = u.T @ sigmoid(gu) / len(u) - prior * (p.T @ sigmoid(gp)) / len(p)
        risk = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        slope = (positive + negative if risk >= 0 else -negative) + DECAY * w
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        w -= RATE * (1 - step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(model.mean, model.scale, w, prior)


def _features_of(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in small_batches(batch):
                found = [features(t).tolist() for t in utf8(part.column(len(keep)))]
                yield {c: part.column(i) for i, c in enumerate(keep)} | {"features": found}

    return by_batch(docs.select(*keep, text_col), f"{types}, features array<double>", run)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    prior: float | None = None,
    fit_rows: int = FIT_ROWS,
) -> Model:
    """Fits on rows whose key is not held out.

    Trusted positives are documents all of whose labels are 1. Unlabelled texts are documents of the table, whatever
    their label, which is not looked at. Both are samples by a hash of the id of at most ``fit_rows`` rows. The prior,
    if not given, is estimated over all labelled rows that are not held out, with one more row on either side.
    """
    used = labels.where((fold(id_col, FOLDS) != HELD_OUT) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    per_doc = used.groupBy(id_col).agg(F.min(label_col).alias("label"))
    if prior is None:
        good, rows = per_doc.agg(F.count_if(F.col("label") == 1), F.count("*")).first()
        prior = (good + 1) / (rows + 2)
    order = F.xxhash64(F.col(id_col))
    trusted = docs.join(per_doc.where("label = 1"), id_col, "left_semi").select(id_col).distinct()
    trusted = trusted.orderBy(order, id_col).limit(fit_rows)
    web = docs.where((fold(id_col, FOLDS) != HELD_OUT) & F.col(id_col).isNotNull()).select(id_col).distinct()
    web = web.orderBy(F.hash(F.col(id_col)), id_col).limit(fit_rows)
    chosen = trusted.withColumn("kind", F.lit(1)).unionByName(web.withColumn("kind", F.lit(0)))
    chosen = chosen.groupBy(id_col).agg(F.max("kind").alias("trusted"), F.min("kind").alias("only_trusted"))
    sample = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)  # at most 2 * fit_rows ids
    rows = _features_of(sample, ["trusted", "only_trusted"], text_col).toPandas()
    x = np.array(rows["features"].tolist(), float).reshape(-1, N_FEATURES)
    return fit(x[rows["trusted"].to_numpy() == 1], x[rows["only_trusted"].to_numpy() == 0], prior)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for each row; null text counts as empty, repeated rows stay."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in small_batches(batch):
                score = model.scores(np.array([features(t) for t in utf8(part.column(2))]))
                yield {
                    id_col: part.column(0),
                    "held_out": part.column(1),
                    "score": score,
                    "predicted": (score >= 0.5).astype(np.int32),
                }

    return by_batch(docs.select(id_col, (fold(id_col, FOLDS) == HELD_OUT).alias("held_out"), text_col), schema, run)


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least 0.5."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in small_batches(batch):
                score = model.scores(np.array([features(t) for t in utf8(part.column(1))]))
                rows = part.column(0).filter(pa.array(score >= 0.5))
                yield {"row": rows}

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    return by_batch(rows, f"row {docs.schema.simpleString()}", run).select("row.*")
