"""Byte-level BPE: encoding by prefix dynamic programming, and decoding."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tallygrid.llm.common import by_batch, small_batches

#: Pieces and token pairs remembered by one Python worker; a memory is emptied when it is full.
CACHED_PIECES = 1_000_000
CACHED_PAIRS = 2_000_000
#: What the pattern's \s means to the encoder: Unicode's White_Space, without the ASCII separators that Python adds.
WHITE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _spelled_out(pattern: str, letters: str, numbers: str) -> str:
    """The pattern with its classes written out, so that every engine reads them alike."""
    out = pattern.replace(r"\p{L}+", f"[{letters}]+").replace(r"\p{N}+", f"[{numbers}]+")
    out = out.replace(r"\p{L}", letters).replace(r"\p{N}", numbers)
    out = out.replace(r"[^\s", f"[^{WHITE_SPACE}")
    return out.replace(r"\s", f"[{WHITE_SPACE}]").replace(r"\S", f"[^{WHITE_SPACE}]")


class Vocabulary(dict):
    """Encodes pieces of text; as a dict it remembers each piece's ids as little-endian unsigned 32-bit bytes.

    A sequence of tokens is the encoding of its bytes exactly if every two neighbours are compatible, that is if no merge
    across their border comes before the merges that made them. So each prefix of a piece has one valid last token, and
    the table of last tokens is the encoding of every prefix at once.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = (line.split() for line in lines if line.strip())
            self.ids = {base64.b64decode(token): int(rank) for token, rank in ranks}
        self.tokens = [b""] * (max(self.ids.values(), default=-1) + 1)
        for token, rank in self.ids.items():
            self.tokens[rank] = token
        self.of_text = regex.compile(_spelled_out(pattern, r"\p{L}", r"\p{N}"))
        self.of_ascii = re.compile(_spelled_out(pattern, "A-Za-z", "0-9"))
        self.parts: dict[int, tuple[int, int]] = {}
        self.pairs: dict[int, bool] = {}
        self.usable: dict[bytes, int] = {}
        for rank, token in enumerate(self.tokens):
            if len(token) == 1:
                self.usable[token] = rank
            elif token and (made := self._made_from(token, rank)):
                self.parts[rank] = made
                self.usable[token] = rank
        self.longest = max(map(len, self.usable), default=1)
        self.tails = {t[i:] for t in self.usable for i in range(len(t))}

    def _made_from(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None if the merges before it never leave just these two."""
        for at in range(1, len(token)):
            left, right = self.usable.get(token[:at]), self.usable.get(token[at:])
            if left is not None and right is not None and self._compatible(left, right, rank):
                return left, right
        return None

    def _compatible(self, left: int, right: int, before: int) -> bool:
        """Whether no merge across the border of the two tokens has a rank below the time it had its chance.

        The two are taken apart again, the later made first. Of two merges of one rank the left one is done first.
        """
        ids, tokens, parts = self.ids, self.tokens, self.parts
        while True:
            across = ids.get(tokens[left] + tokens[right])
            if across is not None and across < before:
                return False
            made_left, made_right = parts.get(left), parts.get(right)
            if made_left and (not made_right or left > right):
                before, left = left, made_left[1]
            elif made_right:
                before, right = right + 1, made_right[0]
            else:
                return True

    def compatible(self, left: int, right: int) -> bool:
        key = left << 24 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._compatible(left, right, len(self.tokens))
        return known

    def extend(self, data: bytes, last: list[int], end: int) -> None:
        """Appends to ``last`` the one valid last token of each prefix of ``data`` up to ``end``."""
        usable, tails, pairs = self.usable, self.tails, self.pairs
        for stop in range(len(last) + 1, end + 1):
            start = stop - 1
            while start >= 0:
                token = data[start:stop]
                rank = usable.get(token)
                if rank is not None:
                    if not start:
                        break
                    known = pairs.get(last[start - 1] << 24 | rank)
                    if known or (known is None and self.compatible(last[start - 1], rank)):
                        break
                elif token not in tails:
                    start = 0
                start -= 1
            if start < 0:
                raise ValueError("a byte has no token")
            last.append(rank)

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.ids.get(data)
        ids = [whole] if whole is not None else PrefixTable(self, data).tokens()
        packed = np.array(ids, "<u4").tobytes()
        if len(self) >= CACHED_PIECES:
            self.clear()
        if len(data) <= 64:
            self[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        pattern = self.of_ascii if text.isascii() else self.of_text
        return b"".join(map(self.__getitem__, pattern.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class PrefixTable:
    """The last token of each prefix of one piece; appends are exact, and an edit re-encodes only its surroundings."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.vocabulary.extend(self.data, self.last, len(self.data))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Replaces ``data[start:stop]``; returns how many prefixes were encoded again.

        Prefixes before the edit keep their token. After it, a prefix depends on no more than the ``longest`` prefixes
        before it, so once that many in a row agree with the old table, the rest of the old table holds.
        """
        old, data = self.last, self.data[:start] + new + self.data[stop:]
        last, shift, agree = old[:start], len(new) - (stop - start), 0
        for end in range(start + 1, len(data) + 1):
            self.vocabulary.extend(data, last, end)
            same = end > start + len(new) and last[-1] == old[end - shift - 1]
            agree = agree + 1 if same else 0
            if agree >= self.vocabulary.longest and end - start - len(new) >= self.vocabulary.longest:
                last += old[end - shift :]
                break
        again = end - start if start < len(data) else 0
        self.data, self.last = data, last
        return again

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.tokens[out[-1]])
        return out[::-1]


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One for each Python worker, kept from task to task."""
    return Vocabulary(path, pattern)


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of each text as little-endian unsigned 32-bit bytes; a null text counts as empty.

    Special tokens' strings are ordinary text. Repeated rows stay, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        known = vocabulary(path, pattern)
        for batch in batches:
            for part in small_batches(batch):
                yield {id_col: part.column(0), "ids": [known.encode(t or "") for t in part.column(1).to_pylist()]}

    return by_batch(docs.select(id_col, text_col), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids binary", run)


def decoded(ids: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes): what the ids stand for; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]):
        known = vocabulary(path, pattern)
        for batch in batches:
            for part in small_batches(batch):
                yield {id_col: part.column(0), "bytes": [known.decode(i or b"") for i in part.column(1).to_pylist()]}

    return by_batch(ids.select(id_col, ids_col), f"`{id_col}` {ids.schema[id_col].dataType.simpleString()}, bytes binary", run)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of encoding and of decoding its ids, in one pass."""

    def digests(text: str, known: Vocabulary) -> tuple[int, str, str]:
        ids = known.encode(text)
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(known.decode(ids)).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]):
        known = vocabulary(path, pattern)
        for batch in batches:
            for part in small_batches(batch):
                rows = zip(*(digests(t or "", known) for t in part.column(1).to_pylist()), strict=True)
                yield {id_col: part.column(0)} | dict(zip(("n_tokens", "ids_sha256", "decoded_sha256"), map(list, rows), strict=True))

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return by_batch(docs.select(id_col, text_col), schema, run)
