"""Each corpus operator on a small table with nulls, empty and long texts, ties, repeated rows and odd columns."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallygrid.llm import byte_bpe, exact_dedup, fingerprint, html_text, license_scan, lm_scoring, near_dedup, packing, quality, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, id long"
LONG = " ".join(f"w{i}" for i in range(4000))
TEXTS = [
    "one two  three four\tfive six seven", "one two three four five six seven", None, "", "   ", LONG, LONG + " end",
    "Ünï cödé don't WE'LL  x", "a", "a", "Licensed under CC BY-NC 4.0.\nbody text", "body of the text\nall about it",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "src0", None, "x", 7) for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, "no id here at all", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def squeeze(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_dedup_matches_groups_and_bears_colliding_hashes(docs, empty):
    for options in ({}, {"block_bytes": 64}, {"block_bytes": 64, "digest": lambda b: F.pmod(F.xxhash64(b), F.lit(3))}):
        found = {(r["doc_id"], r["text_sha256"]): r for r in exact_dedup.exact_dedup(docs, **options).collect()}
        groups = {}
        for r in docs.collect():
            groups.setdefault(squeeze(r["text"]), []).append(r["doc_id"])
        for text, ids in groups.items():
            for i in ids:
                r = found[i, hashlib.sha256(text.encode()).hexdigest()]
                smallest = min((x for x in ids if x is not None), default=None)
                assert (r["keep_id"], r["group_size"], r["kept"]) == (smallest, len(ids), i == smallest)
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.without_copies(docs).count() == len(groups)


def test_prefix_bpe_is_the_librarys_encoding():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    known = byte_bpe.Vocabulary(path, public_tokenizers.PATTERN)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in [t or "" for t in TEXTS] + ["\x1c a\x85b　c", "x" * 500, "<|endoftext|>", "aaaa" * 40]:
        ids = known.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(text)
        assert known.decode(ids) == text.encode()
    table = byte_bpe.PrefixTable(known, b"international")
    table.append(b"isation")
    table.replace(3, 5, b"rrr")
    assert table.tokens() == byte_bpe.PrefixTable(known, table.data).tokens()


def test_bpe_and_packing_keep_every_token(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    encode = Tokenizer.from_file(path).encode
    rows = packing.pack(packing.pieces(docs, path)).collect()
    whole = Counter((r["doc_id"], len(encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in docs.collect())
    assert sum(n * k for (_, n), k in whole.items()) == sum(r["length"] for r in rows)
    ids = encode(LONG, add_special_tokens=False).ids + [0]
    for r in (r for r in rows if r["doc_id"] == 5):
        cut = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert r["ids_crc32"] == zlib.crc32(cut)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(packing.pieces(empty, path)).count() == 0
    digests = byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert len(digests) == docs.count()


def test_packing_plan_pairs_large_items():
    slots = packing.plan({1400: 2, 1024: 3, 700: 2, 600: 1, 40: 5, 2048: 1})
    assert len({s for *_, s, _ in slots}) <= 7
    used = Counter()
    for length, first, end, sequence, _ in slots:
        for k in range(end - first):
            used[sequence + k] += length
    assert max(used.values()) <= 2048 and sum(used.values()) == 1400 * 2 + 1024 * 3 + 1400 + 600 + 200 + 2048
    assert len(used) == 6  # 2048; each 1400 alone, as 700 does not fit; of the other five large ones no three fit


def brute_components(rows, width, percent):
    sets, parent = {}, {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        grams = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
        sets.setdefault(i, []).append(grams)
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and any(a & b and 100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def test_near_dedup_matches_brute_force(spark, docs, empty):
    base = [f"t{i}" for i in range(150)]
    rows = [(100 + k, " ".join(base[:n] + ["y"] * 3 + base[n + k % 9 :])) for k, n in enumerate(range(10, 90, 2))]
    rows += [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for width, percent in ((3, 85), (5, 80)):
        want = brute_components(rows, width, percent)
        found = near_dedup.near_dedup(frame, width=width, percent=percent).collect()
        assert {r["doc_id"]: r["component_id"] for r in found} == want
        assert len(found) == len(rows) and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)
    assert near_dedup.near_dedup(empty).count() == 0
    assert near_dedup.near_dedup(docs).where("doc_id IS NULL AND component_id IS NULL").count() == 1


def test_hilbert_curve_visits_neighbours_and_shards_are_even(spark, docs, empty):
    cells = sorted((r["hilbert"], r["q0"], r["q1"], r["q2"]) for r in sharding.hilbert_cells(spark, 3, 3).collect())
    assert [c[0] for c in cells] == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(x[1:], y[1:], strict=True)) == 1 for x, y in zip(cells, cells[1:], strict=False))
    rows = docs.withColumn("size", F.length(F.coalesce("text", F.lit(""))))
    ranked = sharding.hilbert_ranked(rows, ["lang", "source", "size"], ["size", "doc_id"])
    found = sharding.shard_rows(ranked, 4).collect()
    slots = {}
    for r in found:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(found) == docs.count() and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    none = sharding.hilbert_ranked(empty, ["lang", "source", "n_chars"], ["doc_id"])
    assert sharding.shard_rows(none, 4).count() == 0


def test_edited_likeness_and_merging(docs, empty):
    known = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    texts = [(r["doc_id"], r["text"] or "") for r in known.orderBy("doc_id").collect()]
    found = {r["doc_id"]: r for r in fingerprint.edited_likeness(known).collect()}
    for k, (i, text) in enumerate(texts):
        half = len(text) // 2
        edited = text[: len(text) - half] + texts[(k + 1) % len(texts)][1][:half]
        assert found[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert found[i]["n_chars"] == len(text)
    assert fingerprint.edited_likeness(empty).count() == 0
    assert fingerprint.fingerprints(docs).count() == docs.count()
    a, b = (fingerprint.sketch(t.encode()) for t in (LONG, LONG + " end"))
    assert fingerprint.containment(a, b) > 0.99 and len(fingerprint.merged(a, b)) >= len(a)


def test_quality_ranks_junk_below_prose(spark, docs, empty):
    good = [(i, f"The {i} quiet words of page {i} go on, and they end. Here is more text for {i}.") for i in range(200)]
    junk = [(200 + i, "buy ### $$$ " * 20) for i in range(60)]
    frame = spark.createDataFrame(good + junk, "doc_id long, text string")
    labels = frame.select("doc_id", F.when(F.col("doc_id") < 200, 1).otherwise(0).alias("quality"))
    rows = quality.scored(frame, quality.train(frame, labels)).collect()
    assert all(r["predicted"] == (r["doc_id"] < 200) for r in rows if r["held_out"])
    model = quality.train(frame, labels)
    assert quality.scored(docs, model).count() == docs.count() and quality.scored(empty, model).count() == 0
    assert quality.accepted(docs, model).columns == docs.columns
    assert 0 < quality.train(empty, labels.limit(0)).prior < 1


def test_main_text_drops_chrome_and_template(spark):
    page = (
        "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a href=/>Menu {i}</a></nav>"
        "<div class=main><div class='notice'>Old page</div><p>Same line everywhere</p><p>Body &amp; soul {i}<br>goes&nbsp;on"
        "<p>Second <b>part</b> {i}</div><div id=comments><p>first!</p></div><footer>(c)</footer></body></html>"
    )
    rows = [(i, f"http://h/{i}", page.replace("{i}", str(i))) for i in range(8)]
    rows += [(8, "http://other/", "<p>Alone<script>"), (9, None, None), (10, "x", ""), (11, "http://h/1", "<article>In<footer>no")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in html_text.main_text(frame).collect()}
    assert found[3] == "Body & soul 3 goes on\nSecond part 3"
    assert (found[8], found[9], found[10], found[11]) == ("Alone", "", "", "In")
    assert html_text.main_text(frame.limit(0)).count() == 0


def test_main_text_keeps_sibling_blocks_and_all_articles(spark):
    rows = [
        (1, "http://a/", "<div id=content><div><p>A</p></div><div><p>B b</p></div></div><nav>menu</nav>"),
        (2, "http://b/", "<article>One one</article><p>outside</p><article>Two</article>"),
        (3, "http://c/", "<article><h1>Title</h1><p>Lead</p><div itemprop=articleBody><p>Body text of it</p></div></article>"),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in html_text.main_text(frame).collect()}
    assert found == {1: "A\nB b", 2: "One one\nTwo", 3: "Title\nLead\nBody text of it"}


def test_deep_pages_formulas_and_template_articles(spark):
    """20,000 unclosed elements on one host, in shapes that differ; MathML is text; a text from outside never replaces an article."""
    deep = "<div>" * 20_000
    rows = [(1, "http://a/", f"{deep}deep text"), (2, "http://a/", f"{deep}<p>other</p></div><section>more"), (3, "http://a/", "<article>x <math><mi>y</mi></math> z</article>")]
    rows += [(10 + i, "http://b/", f"<article>same</article><p>{i} outside</p>") for i in range(9)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in html_text.main_text(frame).collect()}
    assert found == {1: "deep text", 2: "other\nmore", 3: "x y z"} | {10 + i: "same" for i in range(9)}


def test_matching_without_recursion_is_the_largest():
    import random

    def largest(a, b):
        if a.label != b.label:
            return 0
        best = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
        for i, c in enumerate(a.children):
            for j, d in enumerate(b.children):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + largest(c, d))
        return best[-1][-1] + 1

    rnd = random.Random(3)

    def tree(depth):
        node = html_text.Node(rnd.choice("pq"))
        node.children = [tree(depth - 1) for _ in range(rnd.randint(0, 3))] if depth else []
        return node

    for _ in range(100):
        a, b = tree(4), tree(4)
        size, pairs = html_text.matching(a, b)
        assert size == largest(a, b) == len(pairs)
        assert all(x.label == y.label for x, y in pairs) and len({id(y) for _, y in pairs}) == size


def test_licences_are_inherited_from_the_nearest_directory(spark, docs, empty):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.py", "code"), (3, "a/c/LICENSE", "Licensed under the Apache License, Version 2.0"),
        (4, "a/c/d/y.py", None), (5, "z.py", "code of the work"), (6, "a/c/w.py", "text\nLicensed under CC BY-NC 4.0."),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, path string, text string")
    found = {r["doc_id"]: (r["license"], r["license_dir"]) for r in license_scan.license_scan(frame, "doc_id", "path", "text", F.col("path").endswith("LICENSE")).collect()}
    assert found == {1: ("mit", None), 2: ("mit", "a"), 3: ("apache-2.0", None), 4: ("apache-2.0", "a/c"), 5: (None, None), 6: ("cc-by-nc-4.0", None)}
    odd = docs.withColumn("path", F.col("source"))
    assert license_scan.license_scan(odd, "doc_id", "path", "text", F.lit(True)).count() >= docs.count()
    assert license_scan.license_scan(empty.withColumn("path", F.col("source")), "doc_id", "path", "text", F.lit(True)).count() == 0


def test_every_line_that_meets_the_condition_speaks_for_its_directory(spark):
    rows = [(1, "a/x.py", "Released under the MIT License, ok\ncode\nLicensed under CC BY-NC 4.0"), (2, "a/b/y.py", "code")]
    frame = spark.createDataFrame(rows, "doc_id long, path string, text string")
    found = {r["doc_id"]: r for r in license_scan.license_scan(frame, "doc_id", "path", "text", F.col("line") == 0).collect()}
    assert found[1]["license"] == "cc-by-nc-4.0"  # its nearest line is the last one
    assert (found[2]["license"], found[2]["license_dir"]) == ("mit", "a")


def test_registered_files_inherit(spark):
    """On the given table some files own a licence, others have that of a folder at or above theirs."""
    from tallygrid.llm import queries

    found = queries.op9_license_scan(spark, "/root/testdata/sf0.01").collect()
    heirs = [r for r in found if r["license_dir"] is not None]
    assert heirs and all(r["own_license"] is None and r["license"] and r["path"].startswith(r["license_dir"]) for r in heirs)
    assert any(r["own_license"] for r in found) and all(r["license"] == r["own_license"] for r in found if r["license_dir"] is None)


def test_whole_licences_headers_and_broken_notices_are_found(spark):
    whole = {n: t for n, t in license_scan.BODIES if n in ("mit", "bsd-3-clause")}
    code = "\n".join(f"x{i} = call{i}(y{i})" for i in range(40))
    header = "\n".join("# " + line for line in dict(x for x in license_scan.BODIES if len(x[1]) < 700)["apache-2.0"].split("\n"))
    texts = [*(f"Copyright (c) 2020 Some Body\nAll rights reserved.\n\n{t}" for t in whole.values()), f"#!/usr/bin/python\n{header}\n{code}"]
    texts += [whole["mit"].replace("\n", " "), f"{code}\n{whole['mit']}\n{code}", code]
    texts += [code + "\n# Redistribution and use in source and binary forms, with or without\n# modification, are permitted\n" + code]
    texts += [" ".join(["word"] * 90) + " Released under the MIT License " + " ".join(["more"] * 90)]
    want = [*whole, "apache-2.0", "mit", "mit", None, "bsd-3-clause", "mit"]
    frame = spark.createDataFrame([(i, f"{i}/f", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    found = {r["doc_id"]: r["own_license"] for r in license_scan.license_scan(frame, "doc_id", "path", "text", F.lit(True)).collect()}
    assert [found[i] for i in range(len(texts))] == want


def test_language_model_base_scores_and_empty_table(docs, empty):
    rows = docs.collect()
    counts = Counter()
    for r in rows:
        if zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 5 != 1:
            counts.update((r["text"] or "").encode().lower().split() + [b""])
    n, v = sum(counts.values()), len(counts)
    found = {r["doc_id"]: r for r in lm_scoring.log_probabilities(docs).collect()}
    for r in rows:
        words = (r["text"] or "").encode().lower().split() + [b""]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        got = found[r["doc_id"]]
        assert math.isclose(got["base_score"], base, rel_tol=1e-9) and got["score"] < 0
        assert (got["n_tokens"], got["n_known"], got["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), n)
    assert lm_scoring.log_probabilities(empty).count() == 0


def test_every_training_word_teaches_the_mixing_weights(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "LEARNER_WORDS", 150)
    monkeypatch.setattr(lm_scoring, "STEP_WORDS", 16)
    words = spark.range(400).select(F.concat(F.lit("w"), F.hex(F.xxhash64("id"))).cast("binary").alias("word"))
    tables = lm_scoring.bit_tables(lm_scoring.context_counts(words))
    shared = spark.sparkContext.broadcast(tables)
    weights, refine = lm_scoring.mixing(words, 400, shared)
    # the same by hand: learners by hash, in the order of another hash, averaged by their words
    rows = words.select("word", F.pmod(F.hash("word"), F.lit(3)).alias("k"), F.xxhash64("word").alias("h")).collect()
    total = 0
    for k in range(3):
        mine = [bytes(r["word"]) for r in sorted((r for r in rows if r["k"] == k), key=lambda r: (r["h"], r["word"]))]
        model = lm_scoring.untrained(*tables)
        model.learn(mine)
        total = total + len(mine) / 400 * np.concatenate([model.weights.ravel(), model.refine.ravel()])
    assert np.allclose(np.concatenate([weights.ravel(), refine.ravel()]), total)
    more = lm_scoring.mixing(words.repartition(7), 400, shared)
    assert np.allclose(weights, more[0]) and np.allclose(refine, more[1])
    # leaving out any half of the words changes them
    half = lm_scoring.mixing(words.where("hash(word) % 2 = 0"), 400, shared)
    assert not np.allclose(weights, half[0])


def test_contexts_are_counted_by_occurrence_and_a_word_is_learned_without_its_own(spark):
    """A word that stands n times in the training text counts n times, as the text repeated word by word does."""
    texts = [(1, 0, "ab ab ab ac"), (2, 0, "ab"), (3, 1, "held")]
    docs = spark.createDataFrame([(bool(h), 0, t) for _, h, t in texts], "held_out boolean, grp int, text string")
    seen = lm_scoring.word_counts(docs).where("total > 0")
    got = {r["slot"]: (r["zeros"], r["ones"]) for r in lm_scoring.context_counts(seen).collect()}
    want = {}
    for word in b"ab ab ab ac ab".split() + [b""] * 2:
        for place, byte in enumerate(word + b" "):
            for bit in range(8):
                for order in lm_scoring.ORDERS:
                    pair = want.setdefault(_slot_by_hand(word[:place], order, (byte | 256) >> (8 - bit)), [0, 0])
                    pair[byte >> (7 - bit) & 1] += 1
    assert got == {slot: tuple(pair) for slot, pair in want.items()}
    # a word that all counts come from leaves only contexts that were not seen, exactly also when the counts are large
    many = spark.createDataFrame([(b"often", (1 << 25) + 1)], "word binary, total long")
    tables = lm_scoring.bit_tables(lm_scoring.context_counts(many))
    assert tables[1].max() == (1 << 25) + 1
    fresh, model = lm_scoring.untrained(*tables), lm_scoring.untrained(*tables)
    model.learn([b"often"], [(1 << 25) + 1])
    assert (model.weights == fresh.weights).all() and (model.refine[0] != fresh.refine[0]).any() and (model.refine[1:] == fresh.refine[1:]).all()
    weights, refine = lm_scoring.mixing(many, 1, spark.sparkContext.broadcast(tables))
    assert (weights == fresh.weights).all() and (refine == model.refine).all()


def _slot_by_hand(before: bytes, order: int, node: int) -> int:
    """Slot of a predictor for one bit: a hash of the ``order`` bytes before (1 in front of the word) and the bits so far."""
    mask = (1 << 64) - 1
    k = lm_scoring.ORDERS.index(order)
    context = k + 1
    for back in range(1, order + 1):
        context = (context * 0x9E3779B1 + (before[-back] + 2 if back <= len(before) else 1)) & mask
        context = int(lm_scoring.mixed(np.array([context], np.uint64))[0])
    return (((context ^ node) * 0xD6E8FEB86659FD93 & mask) >> (64 - lm_scoring.SLOT_BITS)) + k * lm_scoring.SLOTS


def test_bits_of_words_are_looked_up_in_blocks_not_byte_by_byte(monkeypatch):
    words = [b"", b"a", b"ab", "ünd".encode(), b"x" * 9, bytes(range(33, 60)), b"\x00\xff"]
    want = []
    for row, word in enumerate(words):
        for place, byte in enumerate(word + b" "):
            for bit in range(8):
                slots = [_slot_by_hand(word[:place], order, (byte | 256) >> (8 - bit)) for order in lm_scoring.ORDERS]
                want.append((row, bit, slots, byte >> (7 - bit) & 1))
    for by_place in (False, True):
        got, sizes = [], []
        for rows, slots, bits, bounds in lm_scoring._bits(words, by_place):
            got += [(int(rows[i]), k, slots[k, :, i].tolist(), int(bits[k, i])) for i in range(len(rows)) for k in range(8)]
            sizes += np.diff(bounds).tolist() if by_place else []
        assert sorted(got) == sorted(want)
        if by_place:
            assert sizes == [sum(len(w) >= place for w in words) for place in range(28)]
    # words of 200 bytes: the bytes are hashed some thousands at once
    calls = []
    monkeypatch.setattr(lm_scoring, "mixed", lambda x, plain=lm_scoring.mixed: calls.append(1) or plain(x))
    long = [bytes([97 + i % 26]) * 200 for i in range(40)]
    zeros, ones = (np.zeros(len(lm_scoring.ORDERS) * lm_scoring.SLOTS, np.float32) for _ in range(2))
    model = lm_scoring.untrained(zeros, ones)
    assert model.log10_of(long).shape == (40,) and model.log10_of([]).shape == (0,)
    model.learn(long)
    assert len(calls) <= 2 * max(lm_scoring.ORDERS)
