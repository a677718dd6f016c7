"""Product recommendation, price history, last sale price."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrid.functions.labels import CONFIRMED, QUOTATION
from tallygrid.functions.money import MONEY, QTY
from tallygrid.operators.pricing import path_ids
from tallygrid.plans.skew import pick_last, prefix_sums
from tallygrid.session import staged

# Defaults of the recommendation and history dialogs.
DEFAULT_PRODUCTS, DEFAULT_MONTHS, DAYS_PER_MONTH, HISTORY_LIMIT = 15, 6, 30, 20
#: Products that a group's list holds beyond the wanted number, for orders that have some of them.
SPARE = 32
#: Orders of one customer group that meet its list in one task; those of a larger group are dealt into parts.
GROUP_ORDERS = 100_000


def ancestor_closure(tree: DataFrame) -> DataFrame:
    """(ancestor_id, id) pairs of a tree with materialised paths, each node its own ancestor too."""
    return tree.select(F.explode(path_ids("parent_path")).alias("ancestor_id"), "id")


def subtree_child_of(rows: DataFrame, column: str, tree: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows whose ``column`` lies in the subtree of any root (``roots`` has ``id``)."""
    members = ancestor_closure(tree).join(roots.select(F.col("id").alias("ancestor_id")), "ancestor_id", "left_semi")
    return rows.join(members.select(F.col("id").alias(column)), column, "left_semi")


def recommend_products(
    target_order: int,
    orders: DataFrame,
    lines: DataFrame,
    partners: DataFrame,
    products: DataFrame,
    today: date,
    months: int = DEFAULT_MONTHS,
    amount: int = DEFAULT_PRODUCTS,
    use_delivery_address: bool = False,
    order_by: str = "times_delivered",
    descending: bool = True,
) -> DataFrame:
    """Products recently delivered to the customer's group, best first, plus the whole current basket.

    The ``amount`` best by (times, units) are chosen first and then shown by ``order_by``, product
    priority always high first. History does not depend on the order's state, only on deliveries.
    """
    head = orders.filter(F.col("id") == target_order).join(
        partners.select(F.col("id").alias("partner_id"), "commercial_partner_id"), "partner_id"
    )
    company = head.select("company_id").scalar()
    who = head.select("partner_shipping_id" if use_delivery_address else "commercial_partner_id").scalar()
    address = "partner_shipping_id" if use_delivery_address else "partner_id"
    family = partners.filter(F.array_contains(path_ids("parent_path"), who)).select(F.col("id").alias(address))
    start = today - timedelta(days=months * DAYS_PER_MONTH)
    others = (
        orders.filter((F.col("date_order") >= F.lit(start)) & (F.col("id") != target_order) & (F.col("company_id") == company))
        .join(family, address, "left_semi")
        .select(F.col("id").alias("order_id"))
    )
    saleable = products.filter(F.col("active") & F.col("sale_ok")).select(F.col("id").alias("product_id"))
    found = (
        lines.filter((F.col("qty_delivered") != 0) & ~F.col("is_delivery"))
        .join(others, "order_id", "left_semi")
        .groupBy("product_id")
        .agg(F.count("*").alias("times_delivered"), F.sum("qty_delivered").cast(QTY).alias("units_delivered"))
        .join(saleable, "product_id", "left_semi")
    )
    basket = lines.filter((F.col("order_id") == target_order) & ~F.col("is_delivery") & F.col("display_type").isNull()).select(
        "product_id", F.col("qty").alias("units_included"), F.lit(True).alias("in_basket")
    )
    fresh = (
        found.join(basket.select("product_id").distinct(), "product_id", "left_anti")
        .orderBy(F.desc("times_delivered"), F.desc("units_delivered"), "product_id")
        .limit(amount)
        .withColumn("units_included", F.lit(0).cast(QTY))
        .withColumn("in_basket", F.lit(False))
    )
    held = basket.join(found, "product_id", "left").select(
        "product_id", F.coalesce("times_delivered", F.lit(0)).alias("times_delivered"),
        F.coalesce("units_delivered", F.lit(0)).cast(QTY).alias("units_delivered"), "units_included", "in_basket",
    )
    priority = products.select(F.col("id").alias("product_id"), "priority")
    shown = held.unionByName(fresh).join(priority, "product_id", "left")
    lead = F.desc(order_by) if descending else F.asc(order_by)
    return shown.orderBy(lead, F.desc("priority"), "product_id")


def _candidate(times: str, units: str) -> Column:
    """A product that can be recommended, as a struct that sorts best first: most times, most units, lowest id."""
    most = [(-F.col(times)).alias("_by_times"), F.col(units).isNull().alias("_no_units"), (-F.col(units).cast(QTY)).alias("_by_units")]
    return F.struct(*most, "product_id", F.col(times).alias("times"), F.col(units).cast(QTY).alias("units"), "shown")


def recommend_for_orders(
    targets: DataFrame,
    orders: DataFrame,
    lines: DataFrame,
    partners: DataFrame,
    products: DataFrame,
    today: date,
    months: int = DEFAULT_MONTHS,
    amount: int = DEFAULT_PRODUCTS,
    use_delivery_address: bool = False,
    price_origin: str = "pricelist",
    prices: DataFrame | None = None,
) -> DataFrame:
    """``recommend_products`` for a whole table of orders, with a price: (order_id, product_id, ..., price_unit).

    ``targets`` holds rows of ``orders``. Deliveries are summed once per (company, customer group, product). A group's best
    products form one list of ``amount`` + SPARE; an order meets it once, takes its own products out and reads the first
    ``amount`` left, in place; own products that are not in its basket compete with these by what others had of them. That is
    always enough, because only an order's own products can leave the list or change their place once its own deliveries are
    taken off. Orders with over SPARE products, or ids that stand for several orders, read rank by rank, by equi join.

    ``price_origin`` is "pricelist", the product's price in ``prices`` (pricelist_id, product_id, price) or else its
    list price, or "last_sale_price", what the customer last paid in a confirmed order of the company, 0 if nothing.
    """
    if price_origin not in ("pricelist", "last_sale_price"):
        raise ValueError(f"unknown price origin {price_origin}")
    start = F.lit(today - timedelta(days=months * DAYS_PER_MONTH))
    address = "partner_shipping_id" if use_delivery_address else "partner_id"
    who = F.col("id") if use_delivery_address else F.col("commercial_partner_id")
    people = partners.select(F.col("id").alias(address), who.alias("who"), F.array_contains(path_ids("parent_path"), who).alias("_inside"))
    heads = targets.select(
        F.col("id").alias("order_id"), "company_id", "pricelist_id", F.col("partner_id").alias("customer_id"), address, (F.col("date_order") >= start).alias("_recent")
    ).join(people, address)
    facts = lines.select("order_id", "product_id", "qty", "qty_delivered", "is_delivery", "display_type")
    delivered = (F.col("qty_delivered") != 0) & ~F.col("is_delivery")
    order_keys = ["order_id", "company_id", "who", "pricelist_id", "customer_id"]
    group = ["company_id", "who"]

    # the lines of an order stand together after their join: what an order or one of its products needs is worked out there
    mine = F.when(delivered & F.col("_recent") & F.col("_inside"), F.lit(1)).otherwise(F.lit(0))
    order, alike = W.partitionBy(*order_keys), W.partitionBy(*order_keys, "product_id")
    own = heads.drop(address).join(facts, "order_id", "left").select(
        *order_keys, "product_id", F.col("qty").alias("units_included"), (~F.col("is_delivery") & F.col("display_type").isNull()).alias("_listed"),
        mine.alias("_mine"), (mine * F.col("qty_delivered")).cast(QTY).alias("_sent"),
        (F.row_number().over(order.orderBy("product_id")) == 1).alias("_lead"),
    ).select(
        *order_keys, "product_id", "units_included", "_listed", "_lead",
        ((F.row_number().over(alike.orderBy("product_id")) == 1) & F.col("product_id").isNotNull()).alias("_first"),
        F.sum("_mine").over(alike).alias("_times"), F.sum("_sent").over(alike).cast(QTY).alias("_units"), F.max("_listed").over(alike).alias("in_basket"),
        F.sum(F.col("_lead").cast("int")).over(W.partitionBy("order_id")).alias("_alias"),
    ).withColumn("_held", F.sum(F.col("_first").cast("bigint")).over(order))
    own = own.withColumn("_long", (F.col("_held") > SPARE) | (F.col("_alias") > 1))
    products_of = F.collect_set(F.when(F.col("_first") & ~F.col("_long"), F.col("product_id"))).over(order)  # at most SPARE
    own = staged(own.withColumn("_products", F.when(F.col("_lead"), products_of)), "recommend")

    groups = own.filter("_lead").groupBy(*group).count()
    members = ancestor_closure(partners).withColumnRenamed("ancestor_id", "who").join(groups.drop("count"), "who")
    past = orders.filter(F.col("date_order") >= start).select(F.col("id").alias("order_id"), "company_id", F.col(address).alias("id"))
    sums = (
        lines.filter(delivered).select("order_id", "product_id", "qty_delivered")
        .join(past.join(members, ["company_id", "id"]).drop("id"), "order_id")
        .groupBy(*group, "product_id")
        .agg(F.count("*").alias("times"), F.sum("qty_delivered").cast(QTY).alias("units"))  # as results hold it; 8 bytes
    )
    look = F.collect_list(F.struct("priority", *["list_price"] * (price_origin == "pricelist")))
    # a row for each product: (product_id, shown: its rows, saleable)
    kinds = products.groupBy(F.col("id").alias("product_id")).agg(look.alias("shown"), F.coalesce(F.bool_or(F.col("active") & F.col("sale_ok")), F.lit(False)).alias("saleable"))
    kinds = staged(kinds, "recommend-products")
    saleable = kinds.filter("saleable").drop("saleable")
    best = [F.desc("times"), F.desc("units"), F.asc("product_id")]
    # the numbers are cut before the shuffle too, so a hot group sends few rows
    rank = F.row_number().over(W.partitionBy(*group).orderBy(*best))
    first = sums.join(saleable, "product_id").withColumn("rank", rank).filter(F.col("rank") <= amount + SPARE)
    lists = first.groupBy(*group).agg(F.array_sort(F.collect_list(_candidate("times", "units"))).alias("_best"))

    held = (
        own.filter("product_id IS NOT NULL AND (_listed OR _first)")
        .join(sums, [*group, "product_id"], "left")
        .join(kinds, "product_id", "left")
        .withColumn("times", F.when(F.col("saleable"), F.col("times")))
        .withColumn("times_delivered", F.coalesce(F.col("times") - F.col("_times"), F.lit(0)))
        .withColumn("units_delivered", F.when(F.col("times") > F.col("_times"), F.col("units") - F.col("_units")).otherwise(F.lit(0)).cast(QTY))
    )
    columns = [*order_keys, "product_id", "in_basket", "times_delivered", "units_delivered", "shown"]
    fresh_columns = [*order_keys, "product_id", F.lit(False).alias("in_basket"), F.col("times").alias("times_delivered"), F.col("units").cast(QTY).alias("units_delivered"), "shown"]
    # own products that compete with the list, at most SPARE of an order
    rivals = held.filter("_first AND NOT _long AND NOT in_basket").filter("times_delivered > 0").groupBy("order_id")
    rivals = rivals.agg(F.collect_list(_candidate("times_delivered", "units_delivered")).alias("_rivals"))
    short = own.filter("_lead AND NOT _long").select(*order_keys, "_products").join(rivals, "order_id", "left")
    meeting = group
    hot = groups.filter(F.col("count") > GROUP_ORDERS).collect()  # at most one for each GROUP_ORDERS orders
    if hot:
        many = own.sparkSession.createDataFrame([(r["company_id"], r["who"], -(-r["count"] // GROUP_ORDERS)) for r in hot], groups.drop("count").schema.add("_parts", "long"))
        meeting, parts = [*group, "_part"], F.coalesce("_parts", F.lit(1))
        short = short.join(many, group, "left").withColumn("_part", F.pmod(F.xxhash64("order_id"), parts)).drop("_parts")
        lists = lists.join(many, group, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop("_parts")
    left = F.slice(F.filter("_best", lambda x: ~F.array_contains("_products", x["product_id"])), 1, amount)
    left = F.when(F.col("_rivals").isNull(), left).otherwise(F.slice(F.array_sort(F.concat(left, "_rivals")), 1, amount))
    fresh = short.join(lists, meeting).select(*order_keys, F.inline(left)).select(*fresh_columns)
    if not own.filter("_long").isEmpty():
        these = own.filter("_long AND _lead")
        some = sums.join(saleable, "product_id", "left_semi").join(these.select(*group).distinct(), group, "left_semi")
        ranked = staged(prefix_sums(some, group, best, {"rank": F.lit(1).cast("bigint")}), "recommend-ranks")
        wanted = these.select(*order_keys, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_held") + amount)).alias("rank"))
        new = wanted.join(ranked, [*group, "rank"]).join(saleable, "product_id").select(*fresh_columns, F.lit(False).alias("_own"))
        # ranks and own products of an order are dealt by order once: there its own products leave the ranks, and places are given
        dealt = new.unionByName(held.filter("_first AND _long").select(*columns, F.lit(True).alias("_own"))).repartition("order_id")
        met = dealt.withColumn("_held", F.bool_or("_own").over(W.partitionBy("order_id", "product_id")))
        place = F.row_number().over(W.partitionBy("order_id").orderBy(F.desc("times_delivered"), F.desc("units_delivered"), "product_id"))
        offered = F.when(F.col("_own"), ~F.col("in_basket") & (F.col("times_delivered") > 0)).otherwise(~F.col("_held"))
        fresh = fresh.unionByName(met.filter(offered).withColumn("_place", place).filter(F.col("_place") <= amount).select(*columns))
    fresh = fresh.withColumn("units_included", F.lit(0).cast(QTY))
    basket = held.filter("_listed AND _alias = 1").select(*columns, "units_included")
    # lines of an id that stands for several orders show with each of them
    shared = held.filter("_first AND in_basket AND _alias > 1").select(*columns).join(own.filter("_listed AND _alias > 1").select("order_id", "product_id", "units_included"), ["order_id", "product_id"])
    shown = basket.unionByName(shared).unionByName(fresh)
    shown = shown.withColumn("shown", F.explode_outer("shown")).select("*", "shown.*").drop("shown")
    if price_origin == "pricelist":
        if prices is None:
            priced = shown.withColumn("price_unit", F.col("list_price"))
        else:
            listed = prices.select("pricelist_id", "product_id", F.col("price").alias("_price"))
            priced = shown.join(listed, ["pricelist_id", "product_id"], "left").withColumn("price_unit", F.coalesce("_price", "list_price"))
    else:
        last = last_sale_price(orders, lines).select("company_id", F.col("partner_id").alias("customer_id"), "product_id", F.col("price_unit").alias("_price"))
        priced = shown.join(last, ["company_id", "customer_id", "product_id"], "left").withColumn("price_unit", F.coalesce("_price", F.lit(0)))
    return priced.select(
        "order_id", "product_id", "times_delivered", "units_delivered", "units_included", "in_basket", "priority", F.col("price_unit").cast(MONEY).alias("price_unit")
    )


def recommendation_actions(recommended: DataFrame) -> DataFrame:
    """What accepting does to the order: add, update or remove lines. Needs (units_chosen, units_included, in_basket)."""
    action = (
        F.when(~F.col("in_basket") & (F.col("units_chosen") > 0), F.lit("add"))
        .when(F.col("in_basket") & (F.col("units_chosen") == 0), F.lit("remove"))
        .when(F.col("in_basket") & (F.col("units_chosen") != F.col("units_included")), F.lit("update"))
    )
    return recommended.withColumn("action", action).filter(F.col("action").isNotNull())


def price_history(
    product_id: int,
    partner_id: int,
    exclude: tuple[int, int] | None,
    orders: DataFrame,
    lines: DataFrame,
    partners: DataFrame,
    limit: int = HISTORY_LIMIT,
    include_quotations: bool = False,
    include_commercial: bool = True,
) -> DataFrame:
    """Newest earlier lines of a product for a customer and its contacts; the current line is left out before the limit."""
    states = CONFIRMED + QUOTATION if include_quotations else CONFIRMED
    me = partners.filter(F.col("id") == partner_id)
    root = me.select("commercial_partner_id" if include_commercial else "id").scalar()
    family = partners.filter(F.array_contains(path_ids("parent_path"), root)).select(F.col("id").alias("partner_id"))
    heads = (
        orders.filter(F.col("state").isin(*states))
        .join(family, "partner_id", "left_semi")
        .select(F.col("id").alias("order_id"), "partner_id", "state", "date_order")
    )
    history = lines.filter(F.col("product_id") == product_id).join(heads, "order_id")
    if exclude is not None:
        history = history.filter(~((F.col("order_id") == exclude[0]) & (F.col("line_no") == exclude[1])))
    return history.orderBy(F.desc("date_order"), F.desc("order_id"), F.desc("line_no")).limit(limit)


def price_histories(
    asked: DataFrame,
    orders: DataFrame,
    lines: DataFrame,
    partners: DataFrame,
    limit: int = HISTORY_LIMIT,
    include_quotations: bool = False,
    include_commercial: bool = True,
) -> DataFrame:
    """``price_history`` for a table of lines: (order_id, line_no, place, and the earlier line's past_order, past_line, ...).

    ``asked`` is (order_id, line_no, product_id, partner_id), one row a line. Sold lines are numbered once per (customer
    group, product), newest first, and kept up to number ``limit`` and one more, since only the line itself can drop out
    of them; a line meets these few by an equi join on (group, product).
    """
    states = CONFIRMED + QUOTATION if include_quotations else CONFIRMED
    root = F.col("commercial_partner_id") if include_commercial else F.col("id")
    wanted = asked.select("order_id", "line_no", "product_id", "partner_id").join(partners.select(F.col("id").alias("partner_id"), root.alias("root")), "partner_id")
    heads = orders.filter(F.col("state").isin(*states)).select(F.col("id").alias("past_order"), F.col("partner_id").alias("id"), "state", "date_order")
    sold = (
        lines.select(F.col("order_id").alias("past_order"), F.col("line_no").alias("past_line"), "product_id", "price_unit")
        .join(heads, "past_order")
        .join(ancestor_closure(partners).withColumnRenamed("ancestor_id", "root"), "id")
        .join(wanted.select("root", "product_id").distinct(), ["root", "product_id"], "left_semi")
        .withColumnRenamed("id", "past_partner")
    )
    newest = [F.desc("date_order"), F.desc("past_order"), F.desc("past_line")]
    # only the first numbers are kept, cut before the shuffle too, so a hot group sends few rows
    number = F.row_number().over(W.partitionBy("root", "product_id").orderBy(*newest))
    numbered = sold.withColumn("number", number).filter(F.col("number") <= limit + 1)
    found = wanted.drop("partner_id").join(numbered, ["root", "product_id"]).filter((F.col("past_order") != F.col("order_id")) | (F.col("past_line") != F.col("line_no")))
    place = F.row_number().over(W.partitionBy("order_id", "line_no").orderBy("number"))  # at most limit + 1 rows each
    return found.withColumn("place", place).filter(F.col("place") <= limit).drop("root", "number")


def last_sale_price(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Price of the latest confirmed line per company, customer and product; by maximum, so hot pairs combine early."""
    heads = orders.filter(~F.col("state").isin("draft", "sent", "cancel") & F.col("date_order").isNotNull()).select(
        F.col("id").alias("order_id"), "company_id", "partner_id", "date_order"
    )
    sold = lines.select("order_id", "line_no", "product_id", "price_unit").join(heads, "order_id")
    return pick_last(
        sold, ["company_id", "partner_id", "product_id"], [F.col("date_order"), F.col("order_id"), F.col("line_no")], ["order_id", "price_unit"]
    )
