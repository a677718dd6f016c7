"""Line numbering, lots, revisions and the upkeep of dependent order lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrid.functions.money import QTY, zero_if_null
from tallygrid.plans.skew import prefix_sums

ORDER = ("sequence", "line_no")


def line_number(lines: DataFrame) -> DataFrame:
    """1..n over the product lines of an order, by sequence."""
    plain = lines.filter(F.col("display_type").isNull())
    return prefix_sums(plain, ["order_id"], [F.col(c) for c in ORDER], {"line_number": F.lit(1).cast("bigint")})


def serial_no(lines: DataFrame) -> DataFrame:
    """Product lines numbered in sequence, sections and notes 0."""
    plain = F.col("display_type").isNull()
    counted = prefix_sums(lines, ["order_id"], [F.col(c) for c in ORDER], {"_n": F.when(plain, F.lit(1)).otherwise(F.lit(0)).cast("bigint")})
    return counted.withColumn("serial_no", F.when(plain, F.col("_n")).otherwise(F.lit(0))).drop("_n")


def related_so_sequence(links: DataFrame) -> DataFrame:
    """Numbers of the order lines behind an invoice line: 'order/number, …' when several orders or lines, else the number.

    ``links`` is (move_id, invoice_line_id, order_id, order_name, number).
    """
    many = links.groupBy("move_id").agg((F.min("order_id") != F.max("order_id")).alias("_many"))
    packed = links.groupBy("move_id", "invoice_line_id").agg(
        F.array_sort(F.collect_set(F.struct(F.col("number"), F.col("order_name")))).alias("_items"), F.count("*").alias("_n")
    )
    listed = F.array_join(F.transform("_items", lambda x: F.concat(x["order_name"], F.lit("/"), x["number"].cast("string"))), ", ")
    single = F.get("_items", F.lit(0))["number"].cast("string")
    return packed.join(many, "move_id").select(
        "move_id", "invoice_line_id", F.when(F.col("_many") | (F.col("_n") > 1), listed).otherwise(single).alias("related_so_sequence")
    )


def next_sequence(lines: DataFrame) -> DataFrame:
    return lines.groupBy("order_id").agg((F.max("sequence") + 1).alias("next_sequence"))


def shift_template_lines(template_lines: DataFrame, existing: DataFrame) -> DataFrame:
    """Template lines moved behind the existing lines of their order, in their own order."""
    top = existing.groupBy("order_id").agg(F.max("sequence").alias("_top"))
    low = template_lines.groupBy("order_id").agg(F.min("sequence").alias("_low"))
    return template_lines.join(low, "order_id").join(top, "order_id", "left").withColumn(
        "sequence", F.col("sequence") - F.col("_low") + zero_if_null("_top") + 1
    ).drop("_low", "_top")


def lot_numbers(lines: DataFrame) -> DataFrame:
    """Names for missing lots, continuing the order's highest index: ``order-001``.

    Lines need (order_id, order_name, line_no, sequence, lot_name, auto_lot).
    """
    index = F.regexp_replace("lot_name", F.concat(F.col("order_name"), F.lit("-")), F.lit(""))
    number = F.when(index.rlike("^[0-9]+$"), index.cast("bigint")).otherwise(F.lit(0))
    top = lines.filter("lot_name IS NOT NULL").groupBy("order_id").agg(F.max(number).alias("_top"))
    missing = lines.filter(F.col("auto_lot") & F.col("lot_name").isNull())
    counted = prefix_sums(missing, ["order_id"], [F.col(c) for c in ORDER], {"_n": F.lit(1).cast("bigint")})
    position = zero_if_null("_top") + F.col("_n")
    return counted.join(top, "order_id", "left").withColumn("lot_name", F.format_string("%s-%03d", "order_name", position)).drop("_n", "_top")


def revision_chain(orders: DataFrame) -> DataFrame:
    """Each order with its current revision; older revisions are cancelled.

    Orders need (id, revision_group, revision_number, company_id, state).
    """
    current = orders.groupBy("revision_group", "company_id").agg(
        F.max_by("id", F.struct("revision_number", "id")).alias("current_revision_id"), F.count("*").alias("revisions")
    )
    joined = orders.join(current, ["revision_group", "company_id"])
    older = F.col("id") != F.col("current_revision_id")
    return joined.withColumn("state_after", F.when(older, F.lit("cancel")).otherwise(F.col("state")))


def attached_products(lines: DataFrame, attachments: DataFrame, attached: DataFrame) -> DataFrame:
    """What to do with attached lines: add, remove, update or keep.

    ``attachments`` is (product_id, attached_product_id); ``attached`` is (order_id, parent_line_no, product_id, qty)
    with NULL parent when the main line is gone.
    """
    wanted = lines.join(attachments, "product_id").select(
        "order_id", F.col("line_no").alias("parent_line_no"), F.col("attached_product_id").alias("product_id"), F.col("qty").alias("wanted_qty")
    )
    keys = ["order_id", "parent_line_no", "product_id"]
    orphans = attached.filter("parent_line_no IS NULL").select(*keys, F.lit(None).cast(QTY).alias("wanted_qty"), F.col("qty").alias("current_qty"))
    held = attached.filter("parent_line_no IS NOT NULL").select(*keys, F.col("qty").alias("current_qty"))
    both = wanted.join(held, keys, "full_outer").select(*keys, "wanted_qty", "current_qty").unionByName(orphans)
    action = (
        F.when(F.col("wanted_qty").isNull() | ((F.col("wanted_qty") == 0) & F.col("current_qty").isNotNull()), F.lit("remove"))
        .when(F.col("current_qty").isNull(), F.when(F.col("wanted_qty") != 0, F.lit("add")))
        .when(F.col("current_qty") != F.col("wanted_qty"), F.lit("update"))
        .otherwise(F.lit("keep"))
    )
    return both.withColumn("action", action).filter(F.col("action").isNotNull())


def product_set_expand(requests: DataFrame, set_lines: DataFrame, existing: DataFrame, skip_existing: bool = True) -> DataFrame:
    """Lines of product sets added behind an order's lines.

    ``requests`` is (order_id, set_id, set_qty); ``set_lines`` (set_id, position, product_id, qty, price_unit);
    ``existing`` (order_id, product_id, sequence). A set is short, so its positions are counted per request.
    """
    wide = requests.join(set_lines, "set_id")
    if skip_existing:
        wide = wide.join(existing.select("order_id", "product_id").distinct(), ["order_id", "product_id"], "left_anti")
    top = existing.groupBy("order_id").agg(F.max("sequence").alias("_top"))
    rank = F.row_number().over(W.partitionBy("order_id", "set_id").orderBy("position"))
    return wide.withColumn("_rank", rank).join(top, "order_id", "left").select(
        "order_id", "set_id", "product_id", (F.col("qty") * F.col("set_qty")).cast(QTY).alias("qty"), "price_unit",
        (zero_if_null("_top") + F.col("_rank")).alias("sequence"),
    )


def elaboration_merge(lines: DataFrame, extra: DataFrame) -> DataFrame:
    """Add elaboration quantities to the first line of the product, else as a new line.

    ``extra`` is (order_id, product_id, qty); lines need (order_id, line_no, product_id, sequence, qty).
    """
    sums = extra.groupBy("order_id", "product_id").agg(F.sum("qty").cast(QTY).alias("extra_qty"))
    first = lines.groupBy("order_id", "product_id").agg(F.min("line_no").alias("_first"))
    last = lines.groupBy("order_id").agg(F.max("sequence").alias("_last"))
    target = sums.join(first, ["order_id", "product_id"], "left").join(last, "order_id", "left")
    merged = target.filter("_first IS NOT NULL").join(
        lines.select("order_id", F.col("line_no").alias("_first"), "qty", "sequence"), ["order_id", "_first"]
    ).select("order_id", "product_id", (F.col("qty") + F.col("extra_qty")).cast(QTY).alias("qty"), "sequence", F.lit("update").alias("action"))
    added = target.filter("_first IS NULL").select(
        "order_id", "product_id", F.col("extra_qty").alias("qty"), (zero_if_null("_last") + 1).alias("sequence"), F.lit("create").alias("action")
    )
    return merged.unionByName(added)


# How useful a booking is to keep, by state (smaller is better).
BOOKING_RANK = {"confirmed": 100, "scheduled": 200, "pending": 300, "canceled": 400}


def booking_sync(lines: DataFrame, bookings: DataFrame) -> DataFrame:
    """Bookings to keep, cancel or create so that a line has as many as its quantity.

    Lines need (order_id, line_no, state, bookable, qty); bookings (id, order_id, line_no, state).
    """
    key = ["order_id", "line_no"]
    drop = ~F.col("bookable") | (F.col("state") == "cancel")
    touched = lines.filter(drop | (F.col("state") == "sale"))
    wanted = touched.select(*key, F.when(drop, F.lit(0)).otherwise(F.greatest(F.floor("qty"), F.lit(0))).cast("bigint").alias("_wanted"))
    rank = F.coalesce(*[F.when(F.col("state") == s, F.lit(v)) for s, v in BOOKING_RANK.items()])
    place = F.row_number().over(W.partitionBy(*key).orderBy(rank, "id"))
    ranked = bookings.join(wanted, key).withColumn("_place", place)
    kept = ranked.select(
        *key, F.col("id").alias("booking_id"), F.when(F.col("_place") <= F.col("_wanted"), F.lit("keep")).otherwise(F.lit("cancel")).alias("action")
    )
    have = bookings.groupBy(*key).agg(F.count("*").alias("_have"))
    short = wanted.join(have, key, "left").withColumn("_missing", F.col("_wanted") - zero_if_null("_have")).filter("_missing > 0")
    created = short.select(*key, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_missing")))).select(
        *key, F.lit(None).cast("bigint").alias("booking_id"), F.lit("create").alias("action")
    )
    return kept.unionByName(created)


def booking_count(bookings: DataFrame) -> DataFrame:
    return bookings.groupBy("order_id").agg(F.count("*").alias("bookings"))


def booking_state(state: Column, order_state: Column) -> Column:
    """A booking is only confirmed once its order is."""
    return F.when((state == "confirmed") & order_state.isNotNull() & (order_state != "sale"), F.lit("scheduled")).otherwise(state)


def order_priority(lines: DataFrame) -> DataFrame:
    return lines.groupBy("order_id").agg(F.coalesce(F.max("priority"), F.lit("0")).alias("priority"))


def customer_code(lines: DataFrame, codes: DataFrame) -> DataFrame:
    """Customer's own product code, that of the exact customer before one of its commercial entity.

    Lines need (product_id, partner_id, commercial_partner_id); ``codes`` (product_id, partner_id, sequence, code, min_qty).
    """
    # dealt first: the pick sorts its rows, which must not be all that one task reads from a small file; merged, since Spark
    # takes codes made from a small file for a small table and would send them all through the driver to every task
    dealt = codes.repartition("product_id", "partner_id")
    first = dealt.groupBy("product_id", "partner_id").agg(F.min_by(F.struct("code", "min_qty"), "sequence").alias("_hit"))
    entity = first.withColumnRenamed("partner_id", "commercial_partner_id").withColumnRenamed("_hit", "_entity")
    joined = lines.join(first.hint("merge"), ["product_id", "partner_id"], "left").join(entity.hint("merge"), ["product_id", "commercial_partner_id"], "left")
    hit = F.coalesce("_hit", "_entity")
    return joined.withColumn("customer_code", F.coalesce(hit["code"], F.lit(""))).withColumn("min_qty", hit["min_qty"]).drop("_hit", "_entity")


