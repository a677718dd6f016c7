"""Exact deduplication by deterministic naming of fixed-size blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.common import squeezed, stored

#: Bytes of a block. A document of n bytes takes log2(n / BLOCK_BYTES) rounds of pairing.
BLOCK_BYTES = 8192
#: Names of blocks whose hash is shared with another block are counted downwards from here.
ODD_START = -1
#: Stands where a document has no second name for the last pair.
NOTHING = -(2**63)


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, digest) -> DataFrame:
    """(id, sha, n, pos, h, block) for each block of each normalised text; an empty text has one empty block."""
    named = docs.select(F.col(id_col).alias("id"), squeezed(text_col).cast("binary").alias("bytes"))
    cut = F.transform(
        F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0))),
        lambda i: F.substring(F.col("bytes"), i * block_bytes + 1, F.lit(block_bytes)),
    )
    return (
        named.withColumn("sha", F.unhex(F.sha2("bytes", 256)))
        .withColumn("n", F.greatest(F.lit(1), F.ceil(F.octet_length("bytes") / block_bytes)).cast("int"))
        .select("id", "sha", "n", F.posexplode(cut).alias("pos", "block"))
        .withColumn("h", digest(F.col("block")))
    )


def _sorted_names(distinct: DataFrame, *by: str) -> Column:
    """Rows are dealt by their key and sorted, so a lost task gives the same integers again."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def _first_names(blocks: DataFrame) -> DataFrame:
    """(id, sha, n, pos, name): equal blocks share an integer, different ones never do.

    The whole blocks meet once, in the distinct step that sorts and names them. The way back to the documents
    goes by the 8-byte hash, which is allowed only where exactly one block has it; blocks of a shared hash are
    named and met by their bytes.
    """
    names = stored(
        _sorted_names(blocks.select("h", "block").distinct(), "h", "block").select("h", "name"), "names"
    )
    shared = names.groupBy("h").agg(F.count("*").alias("blocks")).where("blocks > 1").select("h")
    if shared.isEmpty():
        return blocks.select("id", "sha", "n", "pos", "h").join(names, "h").drop("h")
    plain = blocks.select("id", "sha", "n", "pos", "h").join(shared, "h", "left_anti").join(names, "h").drop("h")
    odd = blocks.join(shared, "h", "left_semi").drop("h")
    odd_names = _sorted_names(odd.select("block").distinct(), "block").withColumn("name", ODD_START - F.col("name"))
    return plain.unionByName(odd.join(odd_names, "block").drop("block"))


def identities(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, digest=F.xxhash64
) -> DataFrame:
    """One row (id, sha, copies, level, name) for each different (id, normalised text).

    (level, name) is equal exactly for equal normalised texts: at each level a name stands for one pair of names of
    the level below, down to the bytes. ``sha`` is the SHA-256 of the normalised text, ``copies`` the number of
    input rows. Null text counts as empty; a null id is a value like any other; an empty table gives no rows; other
    columns are not read. ``digest`` only speeds up the first level and may collide.
    """
    rows = _first_names(_blocks(docs, id_col, text_col, block_bytes, digest))
    rows = stored(rows.groupBy("id", "sha", "n", "pos").agg(F.max("name").alias("name"), F.count("*").alias("copies")), "blocks")
    rounds = (rows.agg(F.max("n")).first()[0] or 1) - 1
    done = [rows.where("n = 1").select("id", "sha", "copies", F.lit(0).alias("level"), "name")]
    for level in range(1, rounds.bit_length() + 1):
        pairs = rows.where("n > 1").groupBy("id", "sha", "n", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(NOTHING)).alias("right"),
            F.max("copies").alias("copies"),
        )
        names = _sorted_names(pairs.select("left", "right").distinct(), "left", "right")
        rows = stored(
            pairs.join(names, ["left", "right"]).select(
                "id", "sha", F.expr("int((n + 1) div 2)").alias("n"), "pos", "name", "copies"
            ),
            "pairs",
        )
        done.append(rows.where("n = 1").select("id", "sha", "copies", F.lit(level).alias("level"), "name"))
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for each document.

    Texts are equal when they are identical after each run of ASCII white space has become one space. The smallest id
    of a group stays; null ids are never the smallest unless the whole group has none. Identical rows (same id, equal
    text) give one result row and count in ``group_size``.
    """
    found = identities(docs, id_col, text_col, **options)
    groups = found.groupBy("level", "name").agg(F.min("id").alias("keep_id"), F.sum("copies").alias("group_size"))
    return found.join(groups, ["level", "name"]).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that exact deduplication keeps; of identical documents one row stays."""
    found = identities(docs, id_col, text_col, **options)
    groups = found.groupBy("level", "name").agg(F.min("id").alias("keep_id"))
    kept = stored(
        found.join(groups, ["level", "name"])
        .where(F.col("id").eqNullSafe(F.col("keep_id")))
        .select(F.col("id").alias("__id"), F.col("sha").alias("__sha"), F.col("copies").alias("__copies")),
        "kept",
    )
    marked = docs.withColumn("__sha2", F.unhex(F.sha2(squeezed(text_col).cast("binary"), 256)))

    def rows(some: DataFrame) -> DataFrame:
        met = (F.col("__sha2") == some["__sha"]) & F.col(id_col).eqNullSafe(some["__id"])
        return marked.join(some, met, "left_semi")

    if kept.where("__copies > 1").isEmpty():
        return rows(kept).drop("__sha2")
    repeated = rows(kept.where("__copies > 1")).dropDuplicates([id_col, "__sha2"])
    return rows(kept.where("__copies = 1")).unionByName(repeated).drop("__sha2")
