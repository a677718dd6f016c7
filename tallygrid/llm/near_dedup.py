"""Near-duplicates by SetSketch registers: banded, estimated by likelihood, confirmed on the full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.common import by_batch, content, mixed, shingle_hashes, small_batches, stored, utf8, word_hashes
from tallygrid.llm.components import components

#: Registers of a sketch, the base of their exponential spacing, the rate of the hash values, the highest register.
REGISTERS, BASE, RATE, TOP = 252, 1.001, 20.0, 2**16 - 1
#: A pair of just the threshold's similarity shares no band with at most this probability.
MISS = 1e-5
#: Estimates are believed up to so many standard deviations.
DEVIATIONS = 5
#: Rows of a bucket that meet each other in one task.
BLOCK = 256
#: Bits of the filter on ids, in words of 64: what is sent to the tasks is at most this many bits, whatever the input.
FILTER_BITS = 2**26
WIDTH, PERCENT = 5, 80

_FACTORS = mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64)) | np.uint64(1)


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch: register i is 1 - log_BASE of the smallest of the set's i-th exponential hash values, cut to 0..TOP."""
    if not len(shingles):
        return np.zeros(REGISTERS, np.uint16)
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 256):
            np.minimum(least, (shingles[at : at + 256, None] * _FACTORS).min(0), out=least)
    exponential = -np.log1p(-np.minimum((least.astype(np.float64) + 1) / 2.0**64, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / log(BASE)), 0, TOP).astype(np.uint16)


def merged_registers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def rows_per_band(similarity: float) -> int:
    """The most registers in a band for which a pair at the threshold is missed no more often than MISS."""
    fit = [r for r in range(1, 17) if (1 - similarity**r) ** (REGISTERS // r) <= MISS]
    return max(fit, default=1)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Most likely similarity of each pair of sketches (rows), given the sets' sizes.

    With u and v the shares of the two sizes, a register of the first is above the second's with probability
    p(u - v J), below it with p(v - u J), where p(x) = -log_BASE(1 - x (BASE - 1) / BASE).
    """
    above, below = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 201)[None, :]

    def p(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / log(BASE), 1e-12, 1)

    up, down = p(u - v * grid), p(v - u * grid)
    fit = above * np.log(up) + below * np.log(down)
    fit += (REGISTERS - above - below) * np.log(np.clip(1 - up - down, 1e-12, 1))
    possible = grid <= np.minimum(u / v, v / u) + 1e-9
    return grid[0, np.where(possible, fit, -np.inf).argmax(1)]


def sketched(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, key, n, bits, sketch): key stands for the word sequence, n is the set's size, bits one bit of each register."""

    def row(text: bytes) -> tuple:
        words = text.lower().split()
        shingles = shingle_hashes(word_hashes(text), width)
        found = registers(shingles)
        bits = np.packbits((found & 1).astype(np.uint8), bitorder="little")
        bits = np.frombuffer(bits.tobytes().ljust(32, b"\0"), np.int64).tolist()
        return hashlib.sha256(b" ".join(words)).digest(), len(shingles), bits, found.astype("<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in small_batches(batch):
                rows = zip(*map(row, utf8(part.column(1))), strict=True)
                yield {"id": part.column(0)} | dict(zip(("key", "n", "bits", "sketch"), map(list, rows), strict=True))

    schema = "id long, key binary, n long, bits array<long>, sketch binary"
    return by_batch(docs.select(F.col(id_col).cast("long").alias("id"), text_col), schema, run)


def band_hashes(found: np.ndarray, count: int) -> np.ndarray:
    """A hash for each of ``count`` bands of each sketch (row); the band's number is part of it."""
    rows = REGISTERS // count
    cut = found[:, : count * rows].reshape(-1, count, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        band = np.broadcast_to(mixed(np.arange(1, count + 1, dtype=np.uint64)), cut.shape[:2]).copy()
        for i in range(rows):
            band = mixed(band * np.uint64(31) + cut[:, :, i])
    return band.view(np.int64)


def _bands(reps: DataFrame, rows: int) -> DataFrame:
    """(band, id) for each band of each sketch."""
    count = REGISTERS // rows

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(-1, REGISTERS)
            yield {"band": band_hashes(found, count).reshape(-1), "id": np.repeat(batch.column(0).to_numpy(), count)}

    return by_batch(reps.select("id", "sketch"), "band long, id long", run)


def _most_different(similarity: float) -> int:
    """Of one bit of each register, as many differ at most at this similarity."""
    p = (1 - similarity) / 2
    return int(REGISTERS * p + DEVIATIONS * sqrt(REGISTERS * p * (1 - p))) + 1


def _alike(similarity: float) -> Column:
    """Whether sizes and one bit of each register allow the similarity, for rows (n, bits) and (n2, bits2)."""
    differ = sum((F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("bits2")[i])) for i in range(4)), F.lit(0))
    sizes = F.least("n", "n2") >= F.greatest("n", "n2") * similarity - 1e-6
    return sizes & (differ <= _most_different(similarity))


def _perhaps_in(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is in ``ids`` and a few others, found without a shuffle of the rows; a join then decides.

    The ids set bits of a bitmap of FILTER_BITS, which is broadcast: at most FILTER_BITS / 64 pairs of numbers. With many
    more ids than bits it lets every row pass, so it only ever saves shuffled bytes.
    """
    slot = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    word, bit = F.shiftright(slot, 6).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
    words = ids.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_set"))
    met = rows.withColumn("_word", word).join(F.broadcast(words), "_word")
    return met.where(F.col("_set").bitwiseAND(bit) != 0).select(rows.columns)


def _ends(pairs: DataFrame) -> DataFrame:
    """The ids of both ends of each pair."""
    return pairs.select(F.col("a").alias("id")).union(pairs.select("b"))


def _likely(pairs: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose joint likelihood does not rule the similarity out."""
    least = similarity - DEVIATIONS * sqrt(similarity * (1 - similarity) / REGISTERS)
    reps = _perhaps_in(reps.select("id", "n", "sketch"), _ends(pairs))
    one = reps.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    two = reps.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    rows = pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in small_batches(batch, 2048):
                a, b, n_a, n_b = (part.column(i).to_numpy() for i in range(4))
                s_a, s_b = (np.frombuffer(b"".join(part.column(i).to_pylist()), "<u2").reshape(-1, REGISTERS) for i in (4, 5))
                keep = estimate(s_a, s_b, n_a, n_b) >= least
                yield {"a": a[keep], "b": b[keep]}

    return by_batch(rows, "a long, b long", run)


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets meet the threshold."""
    texts = _perhaps_in(texts, _ends(pairs))
    rows = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("t_a")), "a")
    rows = rows.join(texts.select(F.col("id").alias("b"), F.col("text").alias("t_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]):
        known: dict[int, np.ndarray] = {}

        def shingles(key: int, text: str) -> np.ndarray:
            if key not in known:
                if len(known) >= 64:
                    known.clear()
                known[key] = shingle_hashes(word_hashes(text.encode()), width)
            return known[key]

        for batch in batches:
            for part in small_batches(batch):
                out = []
                for a, b, t_a, t_b in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    one, two = shingles(a, t_a), shingles(b, t_b)
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    if both and 100 * both >= percent * (len(one) + len(two) - both):
                        out.append((a, b))
                yield {"a": [x for x, _ in out], "b": [x for _, x in out]}

    return by_batch(rows.select("a", "b", "t_a", "t_b"), "a long, b long", run)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of one (band, low, high), which follow each other."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:3] != row[:3]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _met_in_blocks(open_rows: DataFrame, reps: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between members of a bucket that are not yet in one component.

    A text travels once for each such bucket and not once for each pair. The members of a bucket are dealt into chunks of
    about BLOCK rows, and each two chunks meet in a block of their own. A pair that shares several buckets is met in the
    first of them only.
    """
    similarity = percent / 100
    count = REGISTERS // rows_per_band(similarity)
    most = _most_different(similarity)
    least = similarity - DEVIATIONS * sqrt(similarity * (1 - similarity) / REGISTERS)
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    rows = open_rows.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).withColumn("other", other)
    low, high = F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high")
    rows = rows.select("band", low, high, "chunk", "id", "component", "n", "bits")
    parts = int(open_rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def in_blocks(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "band", "low", "high").sortWithinPartitions("band", "low", "high", "id")

    def partners(i: int, chunk, key, component, n, inside: bool) -> np.ndarray:
        """Rows after row i that are to meet it, as far as sizes, chunks and components tell."""
        j = np.arange(i + 1, len(key))
        j = j[(component[j] != component[i]) & (key[j] != key[i]) & ((chunk[j] != chunk[i]) | inside)]
        return j[np.minimum(n[j], n[i]) >= np.maximum(n[j], n[i]) * similarity - 1e-6]

    def possible(rows: list[tuple]) -> dict[str, list]:
        """The rows that have a partner by one bit of each register; only these need their texts."""
        chunk, key, component, n = (np.array([r[i] for r in rows]) for i in (3, 4, 5, 6))
        bits = np.array([r[7] for r in rows], np.int64).view(np.uint64)
        wanted = np.zeros(len(rows), bool)
        for i in range(len(rows) - 1):
            j = partners(i, chunk, key, component, n, rows[0][1] == rows[0][2])
            j = j[np.bitwise_count(bits[j] ^ bits[i]).sum(1, dtype=np.int64) <= most]
            wanted[j] = True
            wanted[i] |= bool(len(j))
        kept = [r[:7] for r, w in zip(rows, wanted, strict=True) if w]
        return dict(zip(names, map(list, zip(*kept, strict=True)), strict=True)) if kept else {c: [] for c in names}

    names = ["band", "low", "high", "chunk", "id", "component", "n"]
    schema = "band long, low int, high int, chunk int, id long, component long, n long"
    wanted = stored(by_batch(in_blocks(rows), schema, lambda batches: map(possible, _blocks(batches))), "wanted")
    ids = wanted.select("id")
    payload = _perhaps_in(reps.select("id", "sketch"), ids).join(_perhaps_in(texts, ids), "id")
    rows = in_blocks(wanted.join(payload, "id").select(*names, "sketch", "text"))

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        band, low, high = rows[0][:3]
        chunk, key, component, n = (np.array([r[i] for r in rows]) for i in (3, 4, 5, 6))
        found = np.frombuffer(b"".join(r[7] for r in rows), "<u2").reshape(-1, REGISTERS)
        bands = band_hashes(found, count)
        known: dict[int, np.ndarray] = {}
        out = []
        for i in range(len(rows) - 1):
            j = partners(i, chunk, key, component, n, low == high)
            if len(j):
                j = j[bands[i][(bands[j] == bands[i]).argmax(1)] == band]
            if len(j):
                one = np.broadcast_to(found[i], (len(j), REGISTERS))
                j = j[estimate(one, found[j], np.full(len(j), n[i]), n[j]) >= least]
            for k in (i, *j) if len(j) else ():
                if k not in known:
                    known[k] = shingle_hashes(word_hashes(rows[k][8].encode()), width)
            for k in j:
                both = len(np.intersect1d(known[i], known[k], assume_unique=True))
                if both and 100 * both >= percent * (len(known[i]) + len(known[k]) - both):
                    out.append((int(key[i]), int(key[k])))
        return out

    def run(batches: Iterator[pa.RecordBatch]):
        for found in map(links, _blocks(batches)):
            yield {"a": [x for x, _ in found], "b": [x for _, x in found]}

    return by_batch(rows, "a long, b long", run)


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row.

    Documents are linked if their sets of ``width``-word shingles (A-Z lower-cased; a shorter text is one shingle) are
    ``percent`` % alike; a component is all that links reach, named by its smallest id, whose row stays. Equal word
    sequences are one class with one sketch. In each bucket of a band all members first meet one of them; the links found
    give components, and then every pair of a bucket that is not yet in one component is met as well, so no bucket is
    cut, and members of one component are not paired again. Sizes, one bit of each register and the likelihood estimate
    rule pairs out only beyond DEVIATIONS standard deviations.

    Null and empty texts have an empty set and no links. A null id links with nothing and has a null component. Rows of
    one id are one document: each of its texts links it. Other columns are not read; an empty table gives no rows.
    """
    similarity = percent / 100
    seen = stored(sketched(docs, id_col, text_col, width), "sketches")
    reps = seen.where("n > 0 AND id IS NOT NULL").groupBy("key").agg(F.min(F.struct("id", "n", "bits", "sketch")).alias("r"))
    reps = stored(reps.select("key", "r.*"), "classes")
    bands = _bands(reps, rows_per_band(similarity))
    pivot = F.min(F.struct(F.xxhash64("id").alias("order"), F.col("id")))
    shared = bands.groupBy("band").agg(F.count("*").alias("members"), pivot.alias("first")).where("members > 1")
    members = bands.join(shared.select("band", F.col("first.id").alias("pivot")), "band")
    form = reps.select("id", "n", "bits")
    members = stored(members.join(form, "id").select("band", "id", "pivot", "n", "bits"), "buckets")
    other = form.select(F.col("id").alias("pivot"), F.col("n").alias("n2"), F.col("bits").alias("bits2"))
    star = members.where("id != pivot").select("id", "pivot", "n", "bits").join(other, "pivot").where(_alike(similarity))

    texts = docs.select(F.col(id_col).cast("long").alias("id"), content(text_col).alias("text"))

    def links(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        likely = stored(_likely(stored(pairs, "pairs"), reps, similarity), "likely")
        return stored(_confirmed(likely, texts, width, percent), "links")

    first = links(star.select(F.col("id").alias("a"), F.col("pivot").alias("b")))
    labelled = members.join(components(first), "id", "left").select(
        "band", "id", "n", "bits", F.coalesce("component", "id").alias("component")
    )
    mixed_bands = labelled.groupBy("band").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks")
    )
    open_rows = stored(labelled.join(mixed_bands.where("lo < hi").select("band", "chunks"), "band"), "open")
    second = stored(_met_in_blocks(open_rows, reps, texts, width, percent), "links")
    found = components(first.unionByName(second)).withColumnRenamed("id", "rep")
    classes = seen.where("n > 0 AND id IS NOT NULL").groupBy("key").agg(F.min("id").alias("rep"))
    placed = seen.select("id", "key", "n").join(classes, "key", "left").join(found, "rep", "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("component", "rep")).otherwise(F.col("id"))
    return placed.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
