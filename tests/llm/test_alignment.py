"""Token groups, links and corpus counts against a plain walk over both token lists."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tallygrid.llm import alignment, queries

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, pairs int, times string, n string"
PARTS = ["a", "The", "ing", " ", "  ", "\n", "\t", ".", "'s", "é", "日", "😀", "<|endoftext|>", "<s>", "23", "\x00", "ﬁ", "İ", "don't", "\r\n", "́", "<0x0A>", "\u0085"]


@pytest.fixture(scope="module")
def walk():
    a, b = Tokenizer.from_file(FILES[0]), SentencePieceProcessor(model_file=FILES[1])
    a.encode_special_tokens = True
    names = {i: t for t, i in a.get_vocab().items()}
    letters = alignment._byte_letters()

    def piece(i):
        name = b.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if b.is_byte(i) else name.replace("▁", " ").encode()

    def aligned(text):
        """Groups of the ids of both sides; none for texts that either side changes."""
        if not text:
            return []
        sides = [(i, bytes(letters[c] for c in names[i])) for i in a.encode(" " + text, add_special_tokens=False).ids], [(i, piece(i)) for i in b.encode(text)]
        if any(b"".join(t for _, t in side) != (" " + text).encode() for side in sides):
            return []
        ends = []
        for side in sides:
            at, out = 0, {}
            for place, (_, t) in enumerate(side, 1):
                at += len(t)
                out[at] = place
            ends.append(out)
        groups, before = [], (0, 0)
        for cut in sorted(ends[0].keys() & ends[1].keys()):
            now = ends[0][cut], ends[1][cut]
            groups.append(tuple([i for i, _ in side[x:y]] for side, x, y in zip(sides, before, now)))
            before = now
        return groups

    return aligned


def text_of(groups):
    return ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)


def expected(rows, walk):
    found = [(i, walk(t)) for i, t in rows]
    counts = Counter((g[0][-1], g[1][-1]) for _, groups in found for g in groups)
    most = Counter()
    for (_, right), n in counts.items():
        most[right] = max(most[right], n)
    for i, groups in found:
        links = [counts[g[0][-1], g[1][-1]] for g in groups]
        best = sum(n == most[g[1][-1]] for n, g in zip(links, groups))
        digest = hashlib.sha256(text_of(groups).encode()).hexdigest() if groups else ""
        yield (i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), best, sum(links), digest)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_groups_of_odd_texts_are_those_of_a_walk(walk):
    random.seed(3)
    texts = ["".join(random.choices(PARTS, k=random.randint(0, 25))) for _ in range(3000)]
    both = alignment.encoders(*FILES)
    for at in range(0, len(texts), 300):
        part = texts[at : at + 300]
        for text, got in zip(part, alignment.written(alignment.align([t.encode() for t in part], both))):
            assert got.decode() == text_of(walk(text)), repr(text)


def test_memory_of_stretches_may_be_full(walk, monkeypatch):
    monkeypatch.setattr(alignment, "CACHED", 3)
    both = alignment.encoders(*FILES)
    for text in ("one two three four five", "one two six", "x" * 300 + " one"):
        assert alignment.written(alignment.align([text.encode()], both))[0].decode() == text_of(walk(text))


def test_operator_counts_links_over_all_rows(spark, walk):
    long_text = " ".join(f"word{i} and  {i}" for i in range(5000)) + "x" * 20000
    texts = [None, "", " ", "plain text here", "plain text here", "the plain ▁ sign", "é" * 50, long_text, "a\nb\tc", "日本 語 text here"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "plain text here"), (None, "no id")]
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA).repartition(3)
    got = alignment.token_alignment(df, *FILES).select(COLUMNS).collect()
    key = lambda r: (r[0] is None, *r[1:], r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(expected(rows, walk), key=key)
    groups = {r["doc_id"]: r["groups"] for r in alignment.alignments(df, *FILES, with_groups=True).collect()}
    assert groups[8] == text_of(walk(texts[8])) and groups[0] == ""


def test_registered_query_is_the_walk_over_all_documents(spark, walk):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.QUERIES["op12_token_alignment"](spark, sf).select(COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted(expected(rows, walk))


def test_empty_table(spark):
    assert alignment.token_alignment(spark.createDataFrame([], SCHEMA), *FILES).count() == 0
