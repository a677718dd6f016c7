"""Row-level visibility as filters and semi joins."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrid.operators.recommend import ancestor_closure

#: Parts into which the products of a combination are dealt when they meet its partners.
PRODUCT_PARTS = 64
#: Partners, or products, of one combination that meet as one row.
BLOCK = 128


def all_of(*conditions: Column | str) -> Column:
    """AND of predicates given as columns or SQL text; true for none."""
    parts = [F.expr(c) if isinstance(c, str) else c for c in conditions]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def any_of(*conditions: Column | str) -> Column:
    """OR of predicates; false for none."""
    parts = [F.expr(c) if isinstance(c, str) else c for c in conditions]
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def with_hook(df: DataFrame, name: str, hook: Callable[[Column], Column], value: Column) -> DataFrame:
    """Extension point: a caller's function from column to column replaces a computed value."""
    return df.withColumn(name, hook(value))


def _none_or_in(column: str, allowed: Sequence[int]) -> Column:
    return F.col(column).isNull() | F.col(column).isin(*allowed)


def visible_team_rows(rows: DataFrame, user: int, teams: Sequence[int], owner: str = "user_id", team: str = "team_id") -> DataFrame:
    """Own, unassigned, own teams' and teamless rows."""
    return rows.filter(_none_or_in(owner, [user]) | _none_or_in(team, teams))


def visible_partner_rows(partners: DataFrame, user: int, own_partner: int, team: int, manager: bool) -> DataFrame:
    """Partners a salesperson or team manager may see: followed, oneself, and by team or salesperson.

    ``partners`` need (id, user_id, team_id, followers array).
    """
    in_team = _none_or_in("team_id", [team])
    scope = in_team if manager else ((F.col("user_id") == user) | (F.col("user_id").isNull() & in_team))
    follows = F.array_contains("followers", own_partner)
    return partners.filter(F.coalesce(follows | (F.col("id") == own_partner) | scope, F.lit(False)))


def visible_portal_rows(rows: DataFrame, key: str, followers: DataFrame, partners: DataFrame, own_partner: int) -> DataFrame:
    """Rows whose order is followed by someone in the partner's subtree.

    ``followers`` is (order_id, partner_id); ``key`` names the order in ``rows``.
    """
    below = ancestor_closure(partners).filter(F.col("ancestor_id") == own_partner).select(F.col("id").alias("partner_id"))
    seen = followers.join(below, "partner_id", "left_semi").select(F.col("order_id").alias(key))
    return rows.join(seen, key, "left_semi")


def visible_company_rows(rows: DataFrame, companies: Sequence[int]) -> DataFrame:
    return rows.filter(_none_or_in("company_id", companies))


def selectable_partners(partners: DataFrame) -> DataFrame:
    return partners.filter("selectable")


def allowed_pricelists(orders: DataFrame, allowed: DataFrame) -> DataFrame:
    """Orders whose price list is on their customer's allow list; customers without a list may use any."""
    limited = allowed.select("partner_id").distinct().withColumn("_limited", F.lit(True))
    listed = allowed.select("partner_id", "pricelist_id").distinct().withColumn("_listed", F.lit(True))
    joined = orders.join(limited, "partner_id", "left").join(listed, ["partner_id", "pricelist_id"], "left")
    return joined.filter(F.col("_limited").isNull() | F.col("_listed").isNotNull()).drop("_limited", "_listed")


def partner_combinations(partner_assortments: DataFrame) -> DataFrame:
    """(partner_id, combination): the sorted assortments of each partner that has any."""
    return partner_assortments.groupBy("partner_id").agg(F.array_sort(F.collect_set("assortment_id")).alias("combination"))


def fitting_assortments(products: DataFrame, predicates: dict[int, str]) -> DataFrame:
    """(product_id, fits): the assortments whose predicate holds for each product. A predicate is SQL over product columns."""
    flags = F.array_compact(F.array(*[F.when(F.expr(p), F.lit(k).cast("bigint")) for k, p in predicates.items()]))
    return products.select(F.col("id").alias("product_id"), flags.alias("fits"))


def combination_products(combinations: DataFrame, fitting: DataFrame) -> DataFrame:
    """(combination, product_id): products that all assortments of a combination let through.

    Partners share few different combinations; each is met by its first assortment only.
    """
    by_first = fitting.select("product_id", "fits", F.explode("fits").alias("first"))
    kinds = combinations.select("combination").distinct().withColumn("first", F.get("combination", F.lit(0)))
    return kinds.join(by_first, "first").filter(F.size(F.array_except("combination", "fits")) == 0).select("combination", "product_id")


def assortment_products(products: DataFrame, partner_assortments: DataFrame, predicates: dict[int, str]) -> DataFrame:
    """(partner, product) pairs allowed by all of the partner's assortments.

    ``partner_assortments`` is (partner_id, assortment_id). The pairs are as many as the result has; who needs less reads
    ``partner_combinations`` and ``combination_products``, or tests lines with ``assortment_lines``.

    Partners and products of a combination meet in blocks, so that few rows are shuffled and joined, and the pairs of two
    blocks come one after the other: runs of a partner, over the same few products again and again, which files hold small.
    """
    combos = partner_combinations(partner_assortments)
    allowed = combination_products(combos, fitting_assortments(products, predicates))
    # many partners share a combination: its products are dealt into parts, and each part meets all of its partners
    parts = F.explode(F.sequence(F.lit(0), F.lit(PRODUCT_PARTS - 1))).alias("part")
    partners = _blocks(combos, "partner_id").select("combination", F.col("block").alias("partners"), parts).repartition(PRODUCT_PARTS, "combination", "part")
    dealt = _blocks(allowed, "product_id").repartition(PRODUCT_PARTS, "combination", "part")
    met = partners.join(dealt, ["combination", "part"])
    return met.select(F.inline("partners"), "block").select("partner_id", F.inline("block"))


def _blocks(rows: DataFrame, column: str) -> DataFrame:
    """(combination, part, block): the values of ``column``, repeated and null ones too, in arrays of at most BLOCK structs."""
    keys = ["combination", "part"]
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(column), F.lit(PRODUCT_PARTS)).cast("int"))
    number = F.row_number().over(W.partitionBy(*keys).orderBy(column))
    numbered = dealt.select(*keys, column, F.floor((number - 1) / BLOCK).alias("_run"))
    return numbered.groupBy(*keys, "_run").agg(F.collect_list(F.struct(column)).alias("block")).drop("_run")


def assortment_lines(lines: DataFrame, products: DataFrame, partner_assortments: DataFrame, predicates: dict[int, str]) -> DataFrame:
    """Lines (with partner_id, product_id) and ``in_assortment``; a partner without assortments may buy anything.

    A line meets its partner's combination and its product's assortments by key, so no partner meets any product but
    those it has lines of. An unknown product fits no assortment.
    """
    fitting = fitting_assortments(products, predicates)
    met = lines.join(partner_combinations(partner_assortments), "partner_id", "left").join(fitting, "product_id", "left")
    missing = F.array_except("combination", F.coalesce("fits", F.array().cast("array<bigint>")))
    flag = F.col("combination").isNull() | (F.size(missing) == 0)
    return met.select(*[lines[c] for c in lines.columns], flag.alias("in_assortment"))
