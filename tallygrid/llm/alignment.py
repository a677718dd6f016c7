"""Alignment of the tokens of two tokenizers over the same bytes."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.common import by_batch, sized_batches, stored, utf8

#: Stretches of text that one Python worker remembers, and the longest one remembered.
CACHED = 600_000
LONGEST = 48
#: A single space between a visible ASCII character and anything: neither tokenizer looks across it.
BREAK = re.compile(rb"(?<=[\x21-\x7E])(?=\x20.)", re.DOTALL)
SPACE = "▁"


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write visible Latin-1 characters as themselves and the other bytes as U+0100 and on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """The bytes of each id of a vocabulary, and the ids of stretches of text."""

    def __init__(self, token_bytes: list[bytes]):
        self.token_bytes = token_bytes
        self.sizes = np.array([len(t) for t in token_bytes], np.int64)

    def of_stretches(self, stretches: list[bytes]) -> list[list[int]]:
        raise NotImplementedError

    def joined(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


class ByteLevel(Encoder):
    """A byte-level BPE file of the tokenizers library; strings of special tokens are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = _byte_letters()
        entries = sorted((i, t) for t, i in self.tokenizer.get_vocab().items())
        token_bytes = [b""] * (entries[-1][0] + 1)
        for i, t in entries:
            token_bytes[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        super().__init__(token_bytes)

    def of_stretches(self, stretches: list[bytes]) -> list[list[int]]:
        texts = [s.decode("utf-8") for s in stretches]
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces(Encoder):
    """A sentencepiece model, which puts a space before each text by itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(SPACE in n.lstrip(SPACE) for n in names):
            raise ValueError(f"{path} has pieces with a space inside, so texts cannot be encoded in stretches")
        super().__init__([bytes([int(n[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", n) else n.replace(SPACE, " ").encode() for n in names])

    def of_stretches(self, stretches: list[bytes]) -> list[list[int]]:
        return self.model.encode([s[1:].decode("utf-8") for s in stretches], num_threads=1)


class Encoders:
    """Both tokenizers, with a memory of the ids on either side of each stretch between breaks, as 32-bit integers."""

    def __init__(self, byte_level: str, pieces: str):
        self.sides = ByteLevel(byte_level), Pieces(pieces)
        self.known: dict[bytes, tuple[bytes, bytes]] = {}
        #: Stretches that one of the tokenizers does not give back unchanged.
        self.changed: set[bytes] = set()

    def learn(self, stretches: list[bytes]) -> None:
        left, right = self.sides
        for s, a, b in zip(stretches, left.of_stretches(stretches), right.of_stretches(stretches), strict=True):
            self.known[s] = array("I", a).tobytes(), array("I", b).tobytes()
            if left.joined(a) != s or right.joined(b) != s:
                self.changed.add(s)

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of each text on both sides, none where either side's bytes are not those of the text."""
        if len(self.known) > CACHED:
            self.known.clear()
            self.changed.clear()
        split = [BREAK.split(t) if t else [] for t in texts]
        known = self.known
        new = list({s for stretches in split for s in stretches if s not in known})
        self.learn(new)
        out = []
        for text, stretches in zip(texts, split, strict=True):
            found = [known[s] for s in stretches]
            sides = np.frombuffer(b"".join([a for a, _ in found]), "<u4"), np.frombuffer(b"".join([b for _, b in found]), "<u4")
            if self.changed and not self.changed.isdisjoint(stretches):
                if any(e.joined(x.tolist()) != text for e, x in zip(self.sides, sides, strict=True)):
                    sides = sides[0][:0], sides[1][:0]
            out.append(sides)
        for s in new:
            if len(s) > LONGEST:
                del known[s]
                self.changed.discard(s)
        return out


@lru_cache(maxsize=2)
def encoders(byte_level: str, pieces: str) -> Encoders:
    """One for each Python worker, kept from task to task."""
    return Encoders(byte_level, pieces)


def common_cuts(a: np.ndarray, b: np.ndarray, firsts_a: np.ndarray, firsts_b: np.ndarray) -> np.ndarray:
    """Positions in ``a`` of all ends that ``b`` has too, by divide and conquer on many texts at once.

    ``a`` and ``b`` are ascending token ends, text after text; text i has those from firsts[i] to firsts[i + 1], and its
    last ends are equal. In each open interval the end nearest to the middle is looked up in the other list by
    bisection, then the next ones outwards until one is shared. The interval is cut there and both halves go on; an
    interval without a shared inner end is a leaf. All intervals of one depth move together.
    """
    lo, hi = firsts_a[:-1], firsts_a[1:] - 1  # inner ends are lo .. hi - 1, the end at hi is shared
    many = (hi > lo) & (firsts_b[1:] - firsts_b[:-1] > 1)
    found = [firsts_a[1:][firsts_a[1:] > firsts_a[:-1]] - 1]
    lo, hi = lo[many], hi[many]
    while len(lo):
        cut = np.full(len(lo), -1)
        open_, step, middle = np.arange(len(lo)), 0, (lo + hi - 1) // 2
        while len(open_):
            for probe in {step, -step}:
                at = middle[open_] + probe
                inside = (at >= lo[open_]) & (at < hi[open_]) & (cut[open_] < 0)
                rows, at = open_[inside], at[inside]
                place = np.minimum(np.searchsorted(b, a[at]), len(b) - 1)
                hit = b[place] == a[at]
                cut[rows[hit]] = at[hit]
            step += 1
            open_ = open_[cut[open_] < 0]
            open_ = open_[(middle[open_] + step < hi[open_]) | (middle[open_] - step >= lo[open_])]
        split = cut >= 0
        cut, lo, hi = cut[split], lo[split], hi[split]
        found.append(cut)
        lo, hi = np.column_stack([lo, cut + 1]).ravel(), np.column_stack([cut, hi]).ravel()
        many = hi > lo
        lo, hi = lo[many], hi[many]
    return np.sort(np.concatenate(found))


class Aligned(NamedTuple):
    """Tokens of a batch of texts one after another, and the positions of the last token of each group on both sides."""

    a: np.ndarray
    b: np.ndarray
    firsts_a: np.ndarray
    firsts_b: np.ndarray
    cuts_a: np.ndarray
    cuts_b: np.ndarray


def align(texts: list[bytes], both: Encoders) -> Aligned:
    """Tokens and groups of space + text; a text of which either side's bytes differ from that has no tokens."""
    found = both.encode([b" " + t if t else b"" for t in texts])
    ids = [np.concatenate([*side, np.zeros(0, "<u4")]).astype(np.int64) for side in zip(*found, strict=True)]
    firsts = [np.cumsum([0, *map(len, side)]) for side in zip(*found, strict=True)]
    ends = [np.cumsum(e.sizes[x]) for e, x in zip(both.sides, ids, strict=True)]
    cuts_a = common_cuts(*ends, *firsts)
    return Aligned(*ids, *firsts, cuts_a, np.searchsorted(ends[1], ends[0][cuts_a]))


def _groups(tokens: int, cuts: np.ndarray) -> np.ndarray:
    """The number of each token's group, which its last token ends."""
    ends = np.zeros(tokens + 1, np.int64)
    ends[cuts + 1] = 1
    return np.cumsum(ends)[:-1]


def written(x: Aligned) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` for each text: the ids of both sides, group by group."""
    group_a, group_b = _groups(len(x.a), x.cuts_a), _groups(len(x.b), x.cuts_b)
    order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
    ids = np.concatenate([x.a, x.b])
    after = np.full(len(ids), ord(","), np.uint8)
    after[x.cuts_a] = ord("|")
    after[len(x.a) + x.cuts_b] = ord(";")
    ids, after = ids[order], after[order]
    digits = [[]] if not len(ids) else [ids // 10**k for k in range(len(str(ids.max())) - 1, -1, -1)]
    cells = np.column_stack([*[d % 10 + ord("0") for d in digits], after]).astype(np.uint8) if len(ids) else np.zeros((0, 1), np.uint8)
    shown = np.column_stack([*[d > 0 for d in digits[:-1]], np.ones((len(ids), 2), bool)]) if len(ids) else np.zeros((0, 1), bool)
    sizes = np.concatenate([[0], np.cumsum(shown.sum(axis=1))])
    text = cells[shown].tobytes()
    firsts = sizes[x.firsts_a + x.firsts_b]
    return [text[i : max(i, j - 1)] for i, j in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)]


def alignments(
    docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False
) -> DataFrame:
    """(id, n_a, n_b, n_groups, groups_sha256, pairs, times[, groups]) of whole texts.

    ``pairs`` are the distinct linked id pairs as one number (a * 2^32 + b) and ``times`` how often each is linked: in
    each group the two tokens that end it. Null and empty texts, and texts that either tokenizer changes, have no tokens
    and an empty digest. ``with_groups`` adds the groups as text. Repeated rows stay; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>"
    schema += ", groups string" if with_groups else ""

    def run(batches: Iterator[pa.RecordBatch]):
        both = encoders(byte_level, pieces)
        for batch in batches:
            for part in sized_batches(batch, 1):
                x = align(utf8(part.column(1)), both)
                linked = (x.a[x.cuts_a] << 32) | x.b[x.cuts_b]
                edges = np.searchsorted(x.cuts_a, x.firsts_a)
                texts = written(x)
                each = [np.unique(linked[i:j], return_counts=True) for i, j in zip(edges[:-1], edges[1:], strict=True)]
                out = {id_col: part.column(0), "n_a": np.diff(x.firsts_a), "n_b": np.diff(x.firsts_b), "n_groups": np.diff(edges)}
                out["groups_sha256"] = [hashlib.sha256(t).hexdigest() if t else "" for t in texts]
                out |= {"pairs": [p for p, _ in each], "times": [n.astype(np.int32) for _, n in each]}
                yield out | ({"groups": [t.decode() for t in texts]} if with_groups else {})

    return by_batch(docs.select(id_col, text_col), schema, run)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): links of each id pair in the whole corpus, and whether no other pair of its right id has more.

    Of two tokens that end together the shorter one's bytes end the longer one. So the number of pairs is at most that of
    such suffixes: the sum of all token lengths, which the vocabularies fix whatever the corpus.
    """
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("x.pairs", "x.times")
    counts = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n"))
    right = F.col("pair").bitwiseAND((1 << 32) - 1)
    most = counts.groupBy(right.alias("right")).agg(F.max("n").alias("most"))
    return counts.withColumn("right", right).join(most, "right").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_statistics(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``aligned`` with ``n_links``, ``n_best`` and ``count_sum`` instead of its pairs.

    ``counts`` (from :func:`pair_counts`) goes to every task: its size has a bound that the vocabularies fix.
    """
    spark = aligned.sparkSession
    found = counts.orderBy("pair").toArrow()
    table = spark.sparkContext.broadcast([found.column(c).to_numpy() for c in ("pair", "n", "best")])
    kept = [c for c in aligned.columns if c not in ("pairs", "times")]
    fields = {f.name: f.dataType.simpleString() for f in aligned.schema}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in kept) + ", n_links long, n_best long, count_sum long"

    def run(batches: Iterator[pa.RecordBatch]):
        pair, n, best = table.value
        for batch in batches:
            of = {c: batch.column(batch.schema.get_field_index(c)) for c in aligned_columns}
            pairs, times = of.pop("pairs"), of.pop("times").flatten().to_numpy().astype(np.int64)
            at = np.searchsorted(pair, pairs.flatten().to_numpy())
            edges = np.concatenate([[0], np.cumsum(pairs.value_lengths().to_numpy())])
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (times, times * best[at], times * n[at])]
            yield of | dict(zip(("n_links", "n_best", "count_sum"), (s[edges[1:]] - s[edges[:-1]] for s in sums), strict=True))

    aligned_columns = aligned.columns
    return by_batch(aligned, schema, run)


def token_alignment(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, groups_sha256, n_links, n_best, count_sum) for every row.

    Texts are encoded once; the links of each text are kept in a table from which the corpus counts are taken and the
    sums of each document. Null, empty and changed texts have zeros. An empty table gives no rows.
    """
    aligned = stored(alignments(docs, byte_level, pieces, id_col, text_col), "aligned")
    return link_statistics(aligned, stored(pair_counts(aligned), "pair-counts"))
