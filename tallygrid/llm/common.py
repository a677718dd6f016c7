"""Tables, row keys and hashed word shingles that several corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.session import shared_dir

#: ASCII white space, the only white space that splits words here.
SPACES = b" \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def content(text: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def squeezed(text: str | Column) -> Column:
    """Every run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(content(text), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts


def by_batch(
    df: DataFrame, schema: str | T.StructType, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[dict[str, list]]]
) -> DataFrame:
    """``mapInArrow`` with columns as plain lists or numpy arrays; empty batches are not sent."""
    target = df.sparkSession.createDataFrame([], schema).schema if isinstance(schema, str) else schema

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        for columns in fn(b for b in batches if b.num_rows):
            values = [(columns[f.name], f.type) for f in arrow]
            arrays = [v.cast(t) if isinstance(v, pa.Array) else pa.array(v, t) for v, t in values]
            if len(arrays[0]):
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, target)


def small_batches(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, so that Python never holds many long texts at once."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def sized_batches(batch: pa.RecordBatch, column: int, most: int = 1 << 22, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and about ``most`` bytes of text in ``column``; one longer text is a slice of its own."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = total = 0
    for i, size in enumerate(sizes.tolist()):
        if i > at and (total + size > most or i - at >= rows):
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += size
    if at < batch.num_rows:
        yield batch.slice(at)


# --- hashed words: one pass over the bytes, no Python object per word

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers after which every bit depends on every other."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[_LOWER]


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def series(base: int) -> np.ndarray:
        out = np.ones(size, np.uint64)
        filled = 1
        while filled < size:
            step = np.uint64(pow(base, filled, 1 << 64))
            more = min(filled, size - filled)
            out[filled : filled + more] = out[:more] * step
            filled += more
        return out

    with np.errstate(over="ignore"):
        return series(_BASE), series(_INVERSE)


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash for each word of the text, A-Z lower-cased, in order.

    The hash of a word is a difference of prefix sums of a polynomial, scaled back to the word's start.
    """
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_IS_SPACE[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    size = 1 << max(12, int(len(raw)).bit_length())
    power, inverse = _powers(size)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * power[: len(raw)], out=sums[1:])
        return mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The distinct hashes of all runs of ``width`` words, sorted; with fewer words, of the whole sequence."""
    if not len(words):
        return words
    k = min(width, len(words))
    n = len(words) - k + 1
    with np.errstate(over="ignore"):
        sums = words[:n].copy()
        for j in range(1, k):
            sums = mixed(sums * np.uint64(_BASE) + words[j : j + n])
    return np.unique(mixed(sums + np.uint64(k)))


def utf8(values: pa.Array) -> list[bytes]:
    """Text column as UTF-8, null as empty."""
    return [v or b"" for v in values.cast(pa.binary()).to_pylist()]
