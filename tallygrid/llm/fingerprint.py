"""Threshold-scaled sketches of word shingles: every hash below a fixed fraction is kept."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.common import by_batch, content, shingle_hashes, word_hashes

WIDTH = 5
#: Share of all shingle hashes that a sketch keeps.
FRACTION = 1 / 8


def sketch(text: bytes, width: int = WIDTH, fraction: float = FRACTION) -> np.ndarray:
    """Sorted distinct hashes below ``fraction`` of the hash range.

    If a text has shingles but none below it, the sketch is its smallest hash alone. That keeps sketches mergeable: see
    :func:`merged`. A text without words has an empty sketch.
    """
    hashes = shingle_hashes(word_hashes(text), width)
    below = hashes[: np.searchsorted(hashes, np.uint64(int(fraction * 2**64)))]
    return below if len(below) else hashes[:1]


def merged(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch of the two texts' shingles together."""
    both = np.union1d(a, b)
    below = both[: np.searchsorted(both, np.uint64(int(fraction * 2**64)))]
    return below if len(below) else both[:1]


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the smaller text's shingles that the other has; of two empty sketches 1, of one 0."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def text_of(hashes: np.ndarray) -> str:
    return hashes.astype(">u8").tobytes().hex()


def sketch_of(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (all columns) with ``fingerprint``; null text counts as empty and gives an empty one."""
    sketches = by_batch(
        docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text")),
        f"row {docs.schema.simpleString()}, fingerprint string",
        lambda batches: (
            {"row": b.column(0), "fingerprint": [text_of(sketch((t or "").encode())) for t in b.column(1).to_pylist()]}
            for b in batches
        ),
    )
    return sketches.select("row.*", "fingerprint")


def _with_guards(docs: DataFrame, parts: int) -> DataFrame:
    """(part, guard, id, text): rows by ranges of the id; the first row of a range is also sent to the range before it.

    The first range follows the last one.
    """
    bounds = docs.agg(F.percentile_approx("id", [k / parts for k in range(1, parts)] or [0.5])).first()[0] or []
    bounds = sorted({int(b) for b in bounds})
    cuts = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    part = F.size(F.filter(cuts, lambda b: b < F.col("id")))
    rows = docs.withColumn("part", part)
    first = sorted((r[0], r[1]) for r in rows.groupBy("part").agg(F.min("id")).collect())  # one for each range
    guarded = [(first[i - 1][0], i_first) for i, (_, i_first) in enumerate(first)]
    if not guarded:
        return rows.select("part", F.lit(False).alias("guard"), "id", "text")
    before = F.create_map(*[F.lit(x) for p, i in guarded for x in (i, p)])
    goes = F.when(
        F.array_contains(F.array(*[F.lit(i).cast("long") for _, i in guarded]), F.col("id")),
        F.array(
            F.struct(F.col("part").alias("part"), F.lit(False).alias("guard")),
            F.struct(F.element_at(before, F.col("id")).alias("part"), F.lit(True).alias("guard")),
        ),
    ).otherwise(F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("guard"))))
    return rows.select(F.inline(goes), "id", "text")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each text and of its edited text, with the likeness to the edited text and to the next document.

    Edited: the last half (rounded down) of the code points is replaced by as many of the first code points of the next
    document by id, or all it has; the first document follows the last. A single document follows itself. Documents of
    one id follow each other in the order of their texts; null ids are taken as -1; null text counts as empty. Rows are
    dealt by ranges of the id, so no task sees all rows and a text moves once.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("id"), content(text_col).alias("text"))
    parts = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = _with_guards(rows, parts).repartition(parts, "part").sortWithinPartitions("part", "guard", "id", "text")
    schema = (
        f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )

    def run(batches: Iterator[pa.RecordBatch]):
        last, last_part, guards = None, None, 0
        for batch in batches:
            out = []
            for part, guard, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != last_part:
                    last, last_part = None, part
                if last is None and guard:
                    continue  # a repeated first row was sent more than once
                own = sketch(text.encode())
                if last is not None:
                    out.append(_compared(*last, text, own))
                last = None if guard else (key, text, own)
            if out:
                yield dict(zip(_COLUMNS, map(list, zip(*out, strict=True)), strict=True)) | {id_col: [r[0] for r in out]}

    return by_batch(dealt, schema, run)


_COLUMNS = ("key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _compared(key: int, text: str, own: np.ndarray, following: str, next_own: np.ndarray) -> tuple:
    half = len(text) // 2
    edited = (text[: len(text) - half] + following[:half]).encode()
    other = sketch(edited)
    return (
        key,
        len(text),
        hashlib.sha256(edited).hexdigest(),
        text_of(own),
        text_of(other),
        containment(own, other),
        containment(own, next_own),
    )
