"""Packing of tokenised documents into sequences of fixed length."""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.llm.common import by_batch, small_batches, stored, utf8

CAPACITY = 2048
#: Put after each document.
END_ID = 0
#: Words remembered by one Python worker, about 250 bytes each; the memory is emptied when it is full.
CACHED_WORDS = 250_000
#: Groups into which the rows of one length are split for ranking.
BUCKETS = 256


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write visible Latin-1 characters as themselves and the other bytes as U+0100 and on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()


class WordIds(dict):
    """Ids of each white-space separated word as little-endian unsigned 32-bit bytes.

    The tokenizer normalises and splits text without looking across white space, so a text's ids are those of its words.
    Words of letters with one full stop or comma are split here, as the tokenizer's pattern does.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def of_word(self, word: bytes) -> bytes:
        text = word.decode("utf-8")
        if text.isalpha() and text == text.lower() and is_normalized("NFC", text):
            # nothing to normalise or to split: the merges alone, on the letters that stand for the bytes
            found = self.tokenizer.model.tokenize(word.decode("latin-1").translate(BYTE_LETTERS))
            return array("I", [t.id for t in found]).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        if word[-1:] in b".," and len(word) > 1 and word[:-1].decode("utf-8").isalpha():
            ids = self[word[:-1]] + self[word[-1:]]
        else:
            ids = self.of_word(word)
        if len(word) <= 64:
            self[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        # lower case is the tokenizer's own first step, except for its special tokens
        words = text.split() if b"<|" in text else text.lower().split()
        return b"".join(map(self.__getitem__, words))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One for each Python worker, kept from task to task."""
    return WordIds(path)


def pieces(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of each document's tokens with the end id, cut only at ``capacity``.

    Null text counts as empty and gives the end id alone. ``ids`` are the token ids themselves, which writing
    sequences needs and planning does not.
    """
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    schema += ", ids binary" if with_ids else ""
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]):
        words = word_ids(tokenizer_path)
        for batch in batches:
            for part in small_batches(batch):
                rows = []
                for key, text in zip(part.column(0).to_pylist(), utf8(part.column(1)), strict=True):
                    ids = words.encode(text) + end
                    for piece, at in enumerate(range(0, len(ids), capacity * 4)):
                        cut = ids[at : at + capacity * 4]
                        rows.append((key, piece, at // 4, len(cut) // 4, zlib.crc32(cut), cut))
                names = [id_col, "piece", "start", "length", "ids_crc32", "ids"]
                yield dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

    return by_batch(docs.select(id_col, text_col), schema, run)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, end rank, first sequence, offset) for pieces that are known by length and rank alone.

    Lengths above a third of the capacity are matched first: from the longest down, each takes the longest partner that
    still fits, which gives most pairs, and no sequence can hold three. Shorter lengths then go, from the longest down,
    into the smallest gap that holds them. Equal sequences are handled together, so the work depends on the capacity and
    not on the number of pieces.
    """
    left = {s: n for s, n in sorted(histogram.items()) if n > 0}
    if any(not 0 < s <= capacity for s in left):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    groups: list[tuple[tuple[int, ...], int]] = []  # lengths in a sequence, number of such sequences
    third = capacity // 3
    large = sorted((s for s in left if s > third), reverse=True)
    for s in large:
        for t in (t for t in large if t <= min(s, capacity - s)):
            n = left[s] // 2 if t == s else min(left[s], left[t])
            if n:
                groups.append(((s, t), n))
                left[s] -= n
                left[t] -= n
            if not left[s]:
                break
        if left[s]:
            groups.append(((s,), left[s]))
            left[s] = 0
    by_gap: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for lengths, n in groups:
        by_gap[capacity - sum(lengths)].append((lengths, n))
    for s in sorted((s for s in left if s <= third), reverse=True):
        gap = s
        while left[s] and gap <= capacity:
            if not by_gap[gap]:
                gap += 1
                continue
            lengths, n = by_gap[gap].pop()
            fit = gap // s  # one after the other, the same sequence stays the smallest gap until it is full
            whole = min(n, left[s] // fit)
            if whole:
                by_gap[gap - fit * s].append((lengths + (s,) * fit, whole))
                left[s] -= whole * fit
            if whole < n:
                rest = left[s]
                used = 1 if rest else 0
                if used:
                    by_gap[gap - rest * s].append((lengths + (s,) * rest, 1))
                    left[s] = 0
                if n - whole - used:
                    by_gap[gap].append((lengths, n - whole - used))
        if left[s]:
            fit = capacity // s
            whole, rest = divmod(left[s], fit)
            if whole:
                by_gap[capacity - fit * s].append(((s,) * fit, whole))
            if rest:
                by_gap[capacity - rest * s].append(((s,) * rest, 1))
            left[s] = 0
    slots, ranks, sequence = [], defaultdict(int), 0
    for gap in sorted(by_gap):
        for lengths, n in by_gap[gap]:
            offset = 0
            for s in lengths:
                slots.append((s, ranks[s], ranks[s] + n, sequence, offset))
                ranks[s] += n
                offset += s
            sequence += n
    return sorted(slots)


def pack(cut: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (from :func:`pieces`) with ``sequence_id`` and ``offset``.

    The driver sees only how many pieces there are of each length, at most ``capacity`` numbers. Pieces get a rank within
    their length, and (length, rank) fixes the place. Ranks are counted in groups of a hash of the id, so a common
    length is split; ties and repeated rows take places of their own in any order. An empty table gives no rows.
    """
    cut = stored(cut, "pieces")
    bucket = F.pmod(F.xxhash64(F.col(id_col), F.col("piece")), F.lit(BUCKETS)).cast("int")
    cut = cut.withColumn("bucket", bucket)
    counts = stored(cut.groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    slots = np.array(plan(histogram, capacity), np.int64).reshape(-1, 5)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "bucket").orderBy(id_col, "piece", "ids_crc32")
    ranked = (
        cut.withColumn("inside", F.row_number().over(inside))
        .join(starts, ["length", "bucket"])
        .withColumn("rank", F.col("first") + F.col("inside") - 1)
        .drop("bucket", "first", "inside")
    )
    kept = [c for c in cut.columns if c != "bucket"]
    types = {f.name: f.dataType.simpleString() for f in cut.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + ", sequence_id long, offset long"
    # one sorted number for (length, rank): a slot is found by bisection
    span = int(slots[:, 2].max(initial=0)) + 1
    keys = slots[:, 0] * span + slots[:, 1]

    def place(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length * span + rank, "right") - 1
            out = {c: batch.column(batch.schema.get_field_index(c)) for c in kept}
            yield out | {"sequence_id": slots[at, 3] + rank - slots[at, 1], "offset": slots[at, 4]}

    return by_batch(ranked, schema, place)
