"""Licences of files: sparse TF-IDF cosine of their texts, headers and lines to templates, then inheritance from the nearest directory."""

from __future__ import annotations

import re
from collections.abc import Iterable
from math import log, sqrt
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.session import staged
from tallygrid.sources.rules import rows

# Usual short forms of public licences.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc0-1.0": "Released into the public domain under CC0 1.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "mit": "Released under the MIT License",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "all-rights-reserved": "All rights reserved",
}
#: (licence, text) of whole licences and of the headers that files bear.
BODIES = [(p.name.split(".txt")[0].removesuffix(".header"), p.read_text()) for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))]
THRESHOLD = 0.75
#: Scores are compared after rounding to six places; bounds leave room for it.
ROUNDING = 1e-6
SPLIT = r"[^a-z0-9]+"


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SPLIT), lambda t: t != "")


def _constant(words: Iterable[str]) -> Column:
    """Tokens as one literal: thousands of literals make plans slow."""
    return F.split(F.lit(" ".join(words)), " ")


def _template_counts(templates: dict[str, str]) -> dict[str, dict[str, int]]:
    found: dict[str, dict[str, int]] = {}
    for name, text in templates.items():
        counts = found.setdefault(name, {})
        for t in re.split(SPLIT, text.lower()):
            if t:
                counts[t] = counts.get(t, 0) + 1
    return found


def template_words(docs: DataFrame, id_col: str, text_col: str, templates: Iterable[str]) -> DataFrame:
    """(id, shared): the tokens of any template that each whole text holds; the only pass that splits all texts."""
    words = sorted({t for text in templates for t in re.split(SPLIT, text.lower()) if t})
    split = F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), SPLIT)
    return docs.select(id_col, F.array_intersect(split, _constant(words)).alias("shared"))


def idf(words: DataFrame, templates: Iterable[str]) -> dict[str, float]:
    """ln((N + 1) / (documents with the token + 1)) + 1 over all documents, for each token of a template; '' for others.

    ``words`` is the result of ``template_words``.
    """
    vocabulary = sorted({t for text in templates for t in re.split(SPLIT, text.lower()) if t})
    found = words.select(F.explode(F.concat(F.array(F.lit("")), "shared")).alias("token")).groupBy("token").count()
    counts = {r[0]: r[1] for r in found.collect()}  # at most one row for each word of the templates
    n = counts.get("", 0)
    return {t: log((n + 1) / (counts.get(t, 0) + 1)) + 1 for t in vocabulary} | {"": log(n + 1) + 1}


def _anchors(weights: dict[str, dict[str, float]], threshold: float) -> list[str]:
    """Tokens of which a line must have one to come near any template: what is left of a template is too light."""
    anchors: set[str] = set()
    for own in weights.values():
        total, rest = sum(w * w for w in own.values()), sum(w * w for w in own.values())
        for token, w in sorted(own.items(), key=lambda x: (-x[1], x[0])):
            if rest < (threshold - ROUNDING) ** 2 * total:
                break
            anchors.add(token)
            rest -= w * w
    return sorted(anchors)


def candidates(
    words: DataFrame, id_col: str, templates: dict[str, str], bodies: list[tuple[str, str]], threshold: float, weight: dict[str, float]
) -> DataFrame:
    """(id, anchored, possible): texts in which some line or run of tokens can come near a template, and near which.

    ``anchored`` texts hold a token that a line needs to come near a notice. ``possible`` numbers the ``bodies``, then the
    notices, of whose squared weight the text's tokens hold the share that the threshold asks for: a run's cosine is at
    most the root of that share, so no run is lost. All shares are summed in one join with the templates' words, whose
    number is that of the templates alone.
    """
    vectors = [{t: n * weight[t] for t, n in own.items()} for own in _vectors(templates, bodies)]
    totals = [sum(w * w for w in v.values()) for v in vectors]
    squares = [(t, [v.get(t, 0.0) ** 2 for v in vectors]) for t in sorted({t for v in vectors for t in v})]
    # proven small: one row for each word of the templates
    squares = F.broadcast(rows(words.sparkSession, "word string, squares array<double>", squares))
    anchors = _constant(_anchors(_line_weights(templates, weight), threshold))
    held = words.select(id_col, F.arrays_overlap("shared", anchors).alias("anchored"), F.explode("shared").alias("word")).join(squares, "word")
    sums = held.groupBy(id_col).agg(F.bool_or("anchored").alias("anchored"), *[F.sum(F.col("squares")[i]).alias(f"_s{i}") for i in range(len(vectors))])
    possible = F.array(*[F.when(F.col(f"_s{i}") >= (threshold - ROUNDING) ** 2 * total, F.lit(i)) for i, total in enumerate(totals)])
    return sums.select(id_col, "anchored", F.array_compact(possible).alias("possible")).where(F.col("anchored") | (F.size("possible") > 0))


def _vectors(templates: dict[str, str], bodies: list[tuple[str, str]]) -> list[dict[str, int]]:
    return [_counted([t for t in re.split(SPLIT, text.lower()) if t]) for _, text in [*bodies, *templates.items()]]


def _line_weights(templates: dict[str, str], weight: dict[str, float]) -> dict[str, dict[str, float]]:
    return {name: {t: n * weight[t] for t, n in own.items()} for name, own in _template_counts(templates).items()}


def line_licenses(
    docs: DataFrame, id_col: str, text_col: str, templates: dict[str, str], threshold: float, weight: dict[str, float]
) -> DataFrame:
    """(id, line, license, score): the best template of each line that comes near one; lines count from 0.

    Whole texts are read. Only lines with a token that is needed to reach the threshold are compared, which loses none.
    """
    weights = _line_weights(templates, weight)
    needed = rf"(^|[^a-z0-9])({'|'.join(map(re.escape, _anchors(weights, threshold)))})([^a-z0-9]|$)"
    lines = F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"))
    near = docs.select(id_col, lines.alias("line", "text")).where(F.lower("text").rlike(needed))
    known = F.create_map(*[F.lit(x) for t, w in weight.items() if t for x in (t, w)])
    near = near.select(id_col, "line", tokens(F.col("text")).alias("tokens")).select(
        id_col,
        "line",
        F.transform(
            F.array_distinct("tokens"),
            lambda t: F.struct(
                t.alias("t"),
                (F.size(F.filter("tokens", lambda x: x == t)) * F.coalesce(F.try_element_at(known, t), F.lit(weight[""]))).alias("w"),
            ),
        ).alias("line_weights"),
    )
    length = F.sqrt(F.aggregate("line_weights", F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))

    def cosine(own: dict[str, float]) -> Column:
        norm = sqrt(sum(w * w for w in own.values()))
        has = F.create_map(*[F.lit(x) for t, w in own.items() for x in (t, w)])
        dot = F.aggregate(
            "line_weights", F.lit(0.0), lambda a, x: a + x["w"] * F.coalesce(F.try_element_at(has, x["t"]), F.lit(0.0))
        )
        return F.round(dot / (F.col("length") * norm), 6)

    choices = F.array(*[F.struct(cosine(own).alias("score"), F.lit(name).alias("license")) for name, own in weights.items()])
    near = near.withColumn("length", length).withColumn("all", choices)
    near = near.withColumn("score", F.array_max(F.col("all.score"))).where(F.col("score") >= threshold)
    best = F.array_min(F.transform(F.filter("all", lambda x: x["score"] == F.col("score")), lambda x: x["license"]))
    return near.select(id_col, "line", best.alias("license"), "score")


def _counted(words: list[str]) -> dict[str, int]:
    counts: dict[str, int] = {}
    for t in words:
        counts[t] = counts.get(t, 0) + 1
    return counts


def block_licenses(
    docs: DataFrame, id_col: str, text_col: str, bodies: list[tuple[str, str]], templates: dict[str, str], threshold: float,
    weight: dict[str, float], told: DataFrame,
) -> DataFrame:
    """(id, line, license, score, kind): runs of neighbouring tokens, across lines, that come near a licence; ``line`` is the first.

    ``docs`` has ``possible`` from ``candidates``. Compared are the whole text and windows of as many tokens as the
    licence has, one every sixteenth of it (every token if it is shorter). ``kind`` is 0 for ``bodies`` and 2 for the
    notices in ``templates``, which are looked for in texts whose ids are not in ``told``.
    """
    whole = len(bodies)
    bodies = [*bodies, *templates.items()]
    sized = [[t for t in re.split(SPLIT, text.lower()) if t] for _, text in bodies]
    vectors = [{t: n * weight[t] for t, n in _counted(own).items()} for own in sized]
    squares = [sum(w * w for w in v.values()) for v in vectors]
    some = docs.select(id_col, F.col(text_col).alias("text"), F.explode("possible").alias("template"))
    told = told.select(id_col).distinct().withColumn("told", F.lit(True))
    some = some.join(told, id_col, "left").where((F.col("template") < whole) | F.col("told").isNull())
    lines = F.transform(F.split("text", "\n"), lambda t, i: F.transform(tokens(t), lambda w: F.struct(w.alias("t"), i.alias("line"))))
    some = some.select(id_col, F.flatten(lines).alias("words"), "template")

    known = [(i, name, len(own), max(1, len(own) // 16), sqrt(s)) for i, ((name, _), own, s) in enumerate(zip(bodies, sized, squares, strict=True))]
    known = rows(docs.sparkSession, "template int, license string, size int, step int, norm double", known)
    sparse = rows(docs.sparkSession, "template int, t string, own double", [(i, t, float(w)) for i, v in enumerate(vectors) for t, w in sorted(v.items())])
    all_words = rows(docs.sparkSession, "t string, idf double", [(t, w) for t, w in sorted(weight.items()) if t])
    at = some.join(known, "template").select(id_col, "template", "license", "size", "step", "norm", F.posexplode("words").alias("i", "word"))
    # window k starts at token k * step; window -1 is the whole text
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - F.col("size") + 1) / F.col("step")).cast("int"))
    last = F.floor(F.col("i") / F.col("step")).cast("int")
    windows = F.concat(F.array(F.lit(-1)), F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>")))
    at = at.select(id_col, "template", "license", "norm", "word.t", "word.line", F.explode(windows).alias("k"))
    keys = [id_col, "template", "license", "norm", "k"]
    at = at.groupBy(*keys, "t").agg(F.count("*").alias("n"), F.min("line").alias("line"))
    at = at.join(all_words, "t", "left").join(sparse, ["template", "t"], "left")
    w = F.col("n") * F.coalesce("idf", F.lit(weight[""]))
    sums = at.groupBy(*keys).agg(F.min("line").alias("line"), F.sum(w * F.col("own")).alias("dot"), F.sum(w * w).alias("square"))
    sums = sums.withColumn("score", F.round(F.col("dot") / (F.sqrt("square") * F.col("norm")), 6)).where(F.col("score") >= threshold)
    kind = F.when(F.col("template") < whole, 0).otherwise(2).alias("kind")
    return sums.select(id_col, "line", "license", "score", kind)


def license_scan(
    files: DataFrame,
    id_col: str,
    path_col: str,
    text_col: str,
    is_license_file: Column,
    templates: dict[str, str] = TEMPLATES,
    threshold: float = THRESHOLD,
    bodies: list[tuple[str, str]] = BODIES,
) -> DataFrame:
    """(id, path, own_license, own_score, license, license_dir): the licence of each file and where it comes from.

    A file's own licence is that of a whole licence or header of ``bodies`` in it; else that of its nearest line; else that
    of a notice that is broken over lines or stands within a longer one (each by highest score, then first line).
    ``is_license_file`` is a condition on (id, path, line): each licence that starts in a line for which it holds speaks for
    the file's directory, whether or not it is the file's own (in the same order, then highest score, then smallest path,
    then first line). A file without its own takes that of the nearest directory at or above it that has one; the result
    then names the directory in ``license_dir``. Null texts and paths count as empty; ids should be unique, and rows that
    share one share what their lines show; an empty table gives no rows.
    """
    texts = files.select(F.col(id_col), F.coalesce(F.col(path_col), F.lit("")).alias("path"), F.coalesce(text_col, F.lit("")).alias(text_col))
    wording = [*templates.values(), *(text for _, text in bodies)]
    # written once each: the texts' words, the texts to compare and what was found in them have several readers
    words = staged(template_words(texts, id_col, text_col, wording), "license-words")
    weight = idf(words, wording)
    of_lines = {t: weight[t] for text in templates.values() for t in re.split(SPLIT, text.lower()) if t} | {"": weight[""]}
    chosen = staged(candidates(words, id_col, templates, bodies, threshold, weight), "license-candidates")
    near = texts.join(chosen, id_col)
    found = line_licenses(near.where("anchored"), id_col, text_col, templates, threshold, of_lines).withColumn("kind", F.lit(1))
    found = staged(found, "license-lines")
    blocks = block_licenses(near.where(F.size("possible") > 0), id_col, text_col, bodies, templates, threshold, weight, found)
    lines = staged(found.unionByName(blocks), "license-found")
    rank = F.struct("kind", (-F.col("score")).alias("s"), "line", "license")
    own = lines.groupBy(id_col).agg(F.min(rank).alias("own"))
    named = texts.select(id_col, "path").join(own, id_col, "left")
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    named = named.withColumn("dir", folder)
    holders = named.select(id_col, "path", "dir").join(lines, id_col).where(is_license_file)
    first = F.min(F.struct("kind", (-F.col("score")).alias("s"), "path", "line", "license"))
    by_dir = holders.groupBy("dir").agg(first.alias("first")).select(F.col("dir").alias("up"), F.col("first.license").alias("from_dir"))
    parts = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    dirs = named.where("own IS NULL").select("dir").distinct()
    inherited = dirs.select("dir", F.explode(F.array_distinct(ups)).alias("up")).join(by_dir, "up")
    nearest = F.max_by(F.struct("up", "from_dir"), F.length("up"))
    inherited = inherited.groupBy("dir").agg(nearest.alias("near"))
    return named.join(inherited, "dir", "left").select(
        id_col,
        "path",
        F.col("own.license").alias("own_license"),
        (-F.col("own.s")).alias("own_score"),
        F.coalesce("own.license", "near.from_dir").alias("license"),
        F.when(F.col("own").isNull(), F.col("near.up")).alias("license_dir"),
    )
