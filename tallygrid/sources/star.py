"""The order / invoice star schema as views over the given Parquet tables.

Every view is a projection of one table, so filters and pruned columns reach the Parquet scan.
Columns the tables lack (teams, currencies, price lists …) are derived from keys by arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrid.functions.money import CENT, MONEY, PERCENT, QTY, less_percent, money, percent_of, whole, whole_or


#: Lines that a task numbers at once, about 100 MB to sort.
LINES_PER_TASK = 250_000


def _keyed(number: Column, *cases: tuple[int, int, Column], otherwise: Column | None = None) -> Column:
    """First case whose ``number % modulus == remainder``."""
    chosen = None
    for modulus, remainder, value in cases:
        hit = number % modulus == remainder
        chosen = F.when(hit, value) if chosen is None else chosen.when(hit, value)
    return chosen if otherwise is None else chosen.otherwise(otherwise)


class Star:
    """Lazy access to the views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def stream(self, name: str, files_per_batch: int | None = None) -> DataFrame:
        """The same table as a file stream; timestamps become instants, so they can carry a watermark."""
        schema = self.table(name).schema
        reader = self.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        return reader.parquet(self.sf_dir)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -- orders ---------------------------------------------------------------------------

    def orders(self, raw: DataFrame | None = None) -> DataFrame:
        """Orders; ``raw`` may be a stream of the same table."""
        key, cust, status = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
        total = F.col("o_totalprice").cast(MONEY)
        untaxed = money(total * F.lit(9) / F.lit(10))
        day = F.col("o_orderdate").cast("date")
        return (self.table("orders") if raw is None else raw).select(
            key.alias("id"),
            F.concat(F.lit("SO"), key.cast("string")).alias("name"),
            cust.alias("partner_id"),
            F.when(key % 3 == 0, cust - cust % 5).otherwise(cust).alias("partner_shipping_id"),
            F.when(key % 50 == 1, F.abs(cust - 7)).otherwise(cust).alias("partner_invoice_id"),
            F.col("o_orderdate").alias("date_order"),
            F.when(key % 20 == 0, F.lit("cancel"))
            .when((status == "F") & (key % 6 == 1), F.lit("done"))
            .when(status == "F", F.lit("sale"))
            .when(status == "P", F.lit("sent"))
            .otherwise(F.lit("draft"))
            .alias("state"),
            F.when(key % 11 < 10, key % 11).alias("user_id"),
            (key % 7).alias("create_uid"),
            F.when(cust % 26 < 25, cust % 26).alias("team_id"),
            (cust % 5).alias("company_id"),
            (key % 3 + 1).alias("currency_id"),
            (cust % 3 + 1).alias("pricelist_id"),
            (key % 4).alias("warehouse_id"),
            F.substring("o_orderpriority", 1, 1).cast("bigint").alias("type_id"),
            F.when(key % 3 != 0, key % 3).alias("workflow_id"),
            total.alias("amount_total"),
            untaxed.alias("amount_untaxed"),
            (total - untaxed).cast(MONEY).alias("amount_tax"),
            F.date_add(day, 30).alias("validity_date"),
            F.when(key % 4 != 0, F.date_add(day, 10)).alias("commitment_date"),
            F.when(key % 13 == 0, F.lit("WELCOME20")).alias("coupon_code"),
            _keyed(
                key,
                (4, 0, F.lit("no")),
                (4, 1, F.lit("to invoice")),
                (4, 2, F.lit("invoiced")),
                otherwise=F.lit("upselling"),
            ).alias("invoice_status"),
            (key % 30 == 3).alias("force_invoiced"),
            (key % 30 == 4).alias("force_delivered"),
            F.when(key % 25 == 2, F.lit("credit")).alias("blocking_reason"),
            F.when(key % 2 == 0, F.lit("percent")).otherwise(F.lit("fixed")).alias("discount_type"),
            (key % 15).cast(PERCENT).alias("discount_rate"),
            F.floor(key / 4).cast("bigint").alias("revision_group"),
            (key % 4).alias("revision_number"),
        )

    # -- order lines ----------------------------------------------------------------------

    def _lines(self, raw: DataFrame, *extra: str) -> DataFrame:
        part = F.col("l_partkey")
        cents = whole(F.col("l_extendedprice") * 100)
        units = F.col("l_quantity").cast("bigint")
        ext = F.col("l_extendedprice").cast(MONEY)
        priced = raw.select(
            *extra,
            F.col("l_orderkey").alias("order_id"),
            part.alias("product_id"),
            F.col("l_suppkey").alias("agent_id"),
            F.col("l_linenumber").cast("bigint").alias("sequence"),
            F.when(part % 40 == 39, F.lit("line_note")).alias("display_type"),
            whole_or("l_quantity", QTY).alias("qty"),
            # whole cents, rounded half up by integer arithmetic
            (F.floor((cents * 2 + units) / (units * 2)).cast("decimal(16,0)") * F.lit(CENT)).cast(MONEY).alias("price_unit"),
            whole(F.col("l_discount") * 100).cast(PERCENT).alias("discount"),
            whole(F.col("l_tax") * 100).cast(PERCENT).alias("tax_rate"),
            ext.alias("gross"),
            F.col("l_returnflag").alias("return_flag"),
            F.col("l_linestatus").alias("line_status"),
            F.col("l_shipdate").cast("date").alias("ship_date"),
            F.when(part % 5 == 0, F.lit(2)).otherwise(F.lit(1)).cast("bigint").alias("uom_id"),
            (part % 17 == 0).alias("is_delivery"),
        )
        done, flag = F.col("line_status") == "F", F.col("return_flag")
        half = F.floor(F.col("qty") / 2).cast(QTY)
        none = F.lit(0).cast(QTY)
        net = less_percent("gross", "discount")
        cost_share = (F.col("agent_id") % 60 + 60).cast(PERCENT)
        return priced.select(
            *priced.columns,
            net.alias("price_subtotal"),
            percent_of(net, "tax_rate").alias("price_tax"),
            (net + percent_of(net, "tax_rate")).cast(MONEY).alias("price_total"),
            F.when(done, F.col("qty")).when(flag == "A", half).otherwise(none).alias("qty_delivered"),
            F.when(done & (flag == "N"), F.col("qty")).when(flag == "A", half).otherwise(none).alias("qty_invoiced"),
            percent_of("price_unit", cost_share).alias("purchase_price"),
            F.when(F.col("product_id") % 3 == 0, F.date_sub("ship_date", 3)).alias("commitment_date"),
        )

    def lines(self) -> DataFrame:
        """All order lines; cheapest form, without a line key."""
        return self._lines(self.table("lineitem"))

    def keyed_lines(self, of: DataFrame | None = None) -> DataFrame:
        """Order lines with ``line_no``, 1..n per order: (order_id, line_no) is unique.

        ``of`` (order_id) leaves only lines of these orders, before they are numbered; it takes whole orders, so numbers stay.
        """
        raw = self.table("lineitem")
        if of is not None:
            raw = raw.join(of, raw.l_orderkey == of.order_id, "left_semi")
        elif (parts := raw.count() // LINES_PER_TASK) > self.spark.sparkContext.defaultParallelism:
            # a task's sort stays as small on a longer table; the count reads file footers only
            raw = raw.repartition(parts, "l_orderkey")
        order = [
            "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
        ]
        # numbered where the lines are dealt by order, so that joins with orders find them in place; a row number needs
        # a sort of the order's lines, which spills, and no group in memory
        place = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order)).cast("bigint")
        return self._lines(raw.withColumn("line_no", place), "line_no")

    # -- products -------------------------------------------------------------------------

    def products(self) -> DataFrame:
        key, size = F.col("p_partkey"), F.col("p_size").cast("bigint")
        retail = F.col("p_retailprice").cast(MONEY)
        return self.table("part").select(
            key.alias("id"),
            F.col("p_name").alias("name"),
            (key - key % 2).alias("template_id"),
            (size + 100).alias("categ_id"),
            F.concat(F.lit("1/"), (size % 5 + 10).cast("string"), F.lit("/"), (size + 100).cast("string"), F.lit("/")).alias(
                "parent_path"
            ),
            F.col("p_brand").alias("brand"),
            F.when(F.col("p_type") == "PROMO", F.lit("service"))
            .when(F.col("p_type") == "SMALL", F.lit("consu"))
            .otherwise(F.lit("product"))
            .alias("type"),
            retail.alias("list_price"),
            percent_of(retail, F.lit(70).cast(PERCENT)).alias("standard_price"),
            (key % 37).cast(QTY).alias("free_qty"),
            (key % 23 + size).cast(QTY).alias("virtual_available"),
            (key % 9 != 8).alias("sale_ok"),
            (key % 19 != 18).alias("active"),
            (key % 7 == 6).alias("commission_free"),
            (key % 8 == 7).alias("bypass_discount"),
            F.lit(1).cast("bigint").alias("uom_id"),
            F.when(key % 10 == 1, F.lit("Handle with care")).otherwise(F.lit("")).alias("sale_warn"),
            (key % 6 == 5).alias("must_have_dates"),
        )

    def categories(self) -> DataFrame:
        """Three-level category tree of the products: (id, parent_id, parent_path, depth)."""
        sizes = self.table("part").select(F.col("p_size").cast("bigint").alias("size")).distinct()
        leaf = sizes.select(
            (F.col("size") + 100).alias("id"),
            (F.col("size") % 5 + 10).alias("parent_id"),
            F.concat(F.lit("1/"), (F.col("size") % 5 + 10).cast("string"), F.lit("/"), (F.col("size") + 100).cast("string"), F.lit("/")).alias("parent_path"),
        )
        middle = sizes.select((F.col("size") % 5 + 10).alias("id")).distinct().select(
            "id", F.lit(1).cast("bigint").alias("parent_id"), F.concat(F.lit("1/"), F.col("id").cast("string"), F.lit("/")).alias("parent_path")
        )
        root = sizes.limit(1).select(
            F.lit(1).cast("bigint").alias("id"), F.lit(None).cast("bigint").alias("parent_id"), F.lit("1/").alias("parent_path")
        )
        return leaf.unionByName(middle).unionByName(root)

    # -- partners, teams, users -----------------------------------------------------------

    def partners(self) -> DataFrame:
        """Three-level partner tree with its materialised path."""
        key = F.col("c_custkey")
        five, top = key - key % 5, key - key % 25
        slash = F.lit("/")
        return self.table("customer").select(
            key.alias("id"),
            F.col("c_name").alias("name"),
            F.when(key % 5 != 0, five).when(key % 25 != 0, top).alias("parent_id"),
            F.when(key % 5 != 0, F.concat(top.cast("string"), slash, F.when(key % 25 >= 5, F.concat(five.cast("string"), slash)).otherwise(F.lit("")), key.cast("string"), slash))
            .when(key % 25 != 0, F.concat(top.cast("string"), slash, key.cast("string"), slash))
            .otherwise(F.concat(key.cast("string"), slash))
            .alias("parent_path"),
            five.alias("commercial_partner_id"),
            F.when(key % 4 != 0, key % 11).alias("user_id"),
            F.when(key % 3 != 0, key % 26).alias("team_id"),
            F.when(key % 6 != 0, F.col("c_nationkey").cast("bigint")).alias("country_id"),
            F.when(key % 12 != 0, F.lpad(key.cast("string"), 5, "0")).alias("zip"),
            F.col("c_mktsegment").alias("segment"),
            F.col("c_acctbal").cast(MONEY).alias("balance"),
            F.when(key % 15 == 2, F.lit("Check the credit")).otherwise(F.lit("")).alias("sale_warn"),
            (key % 10).cast(PERCENT).alias("discount"),
            (key % 4 == 1).alias("newsletter"),
            (key % 9 != 4).alias("selectable"),
            (key % 14 == 3).alias("no_auto_cancel"),
        )

    def teams(self) -> DataFrame:
        """Sales teams; names are JSON by language, some without a translation."""
        key = F.col("n_nationkey").cast("bigint")
        return self.table("nation").select(
            key.alias("id"),
            F.when(key % 7 == 6, F.lit('{"en_US": ""}'))
            .when(key % 2 == 0, F.concat(F.lit('{"en_US": "'), F.col("n_name"), F.lit('", "fr_FR": "'), F.lower("n_name"), F.lit('"}')))
            .otherwise(F.concat(F.lit('{"en_US": "'), F.col("n_name"), F.lit('"}')))
            .alias("names"),
            (key % 10).alias("leader_id"),
            F.col("n_regionkey").cast("bigint").alias("region_id"),
        )

    def users(self) -> DataFrame:
        """Salespeople and commission agents."""
        key = F.col("s_suppkey")
        return self.table("supplier").select(
            key.alias("id"),
            F.col("s_name").alias("name"),
            F.col("s_nationkey").cast("bigint").alias("country_id"),
            (key % 4 + 1).alias("commission_id"),
            F.element_at(
                F.array(*[F.lit(x) for x in ("monthly", "biweekly", "quaterly", "semi", "annual")]),
                (key % 5 + 1).cast("int"),
            ).alias("settlement"),
            F.when(key % 6 == 5, F.lit("salesman")).otherwise(F.lit("agent")).alias("agent_type"),
            (key % 3 != 2).alias("salesman_as_agent"),
            F.when(key % 8 != 7, key % 3).alias("employee_id"),
        )

    def partner_agents(self) -> DataFrame:
        """Which agents serve a customer: none, one or two."""
        key = F.col("c_custkey")
        first, second = key % 10, (key + 3) % 10
        both = F.when(key % 3 == 1, F.array(first)).when(key % 3 == 2, F.array(first, second))
        return self.table("customer").select(key.alias("partner_id"), F.explode(both).alias("agent_id"))

    # -- invoices, stock ------------------------------------------------------------------

    def invoices(self) -> DataFrame:
        """One customer invoice or refund per confirmed order."""
        key = F.col("id")
        total = F.col("amount_total")
        paid = _keyed(key, (5, 0, F.lit("not_paid")), (5, 1, F.lit("partial")), (5, 2, F.lit("in_payment")), otherwise=F.lit("paid"))
        return self.orders().filter(F.col("state").isin("sale", "done")).select(
            key.alias("id"),
            key.alias("order_id"),
            F.concat(F.lit("INV"), key.cast("string")).alias("name"),
            F.when(key % 9 == 0, F.lit("out_refund")).otherwise(F.lit("out_invoice")).alias("move_type"),
            _keyed(key, (8, 0, F.lit("draft")), (8, 5, F.lit("cancel")), otherwise=F.lit("posted")).alias("state"),
            paid.alias("payment_state"),
            F.date_add(F.col("date_order").cast("date"), 5).alias("invoice_date"),
            "partner_id",
            "team_id",
            "user_id",
            "company_id",
            (key % 4 + 1).alias("currency_id"),
            F.col("currency_id").alias("order_currency_id"),
            total.alias("amount_total"),
            "amount_untaxed",
            _keyed(
                key,
                (5, 0, total),
                (5, 1, percent_of(total, F.lit(40).cast(PERCENT))),
                otherwise=F.lit(0).cast(MONEY),
            ).alias("amount_residual"),
            "type_id",
            "discount_type",
            "discount_rate",
        )

    def invoice_lines(self, lines: DataFrame | None = None) -> DataFrame:
        """Lines as invoiced: one per order line, joined to its header on the order key."""
        source = self.lines() if lines is None else lines
        head = self.invoices().select(
            F.col("id").alias("move_id"),
            "move_type",
            F.col("state").alias("move_state"),
            "payment_state",
            "invoice_date",
            "partner_id",
            "company_id",
            "currency_id",
        )
        return source.join(head, source.order_id == head.move_id)

    def keyed_invoice_lines(self) -> DataFrame:
        """Invoice lines with the ``line_no`` of their order line; lines of orders without an invoice are not numbered."""
        return self.invoice_lines(self.keyed_lines(self.invoices().select("order_id")))

    def stock_moves(self) -> DataFrame:
        """One delivery per delivered line, one return per returned line; some cancelled or scrapped."""
        out, back = F.col("line_status") == "F", F.col("return_flag") == "R"
        both = F.when(out & back, F.array(F.lit(False), F.lit(True))).when(out, F.array(F.lit(False))).when(back, F.array(F.lit(True)))
        # the lines are numbered once for both directions
        moves = self.keyed_lines().select("order_id", "line_no", "product_id", "qty", F.explode(both).alias("is_return"))
        product, returned = F.col("product_id"), F.col("is_return")
        return moves.select(
            "order_id",
            "line_no",
            "product_id",
            F.when(product % 29 == 0, F.lit("cancel")).otherwise(F.lit("done")).alias("state"),
            (product % 31 == 0).alias("scrapped"),
            F.when(product % 4 == 0, F.lit(3)).otherwise(F.lit(1)).cast("bigint").alias("uom_id"),
            F.when(returned, F.floor(F.col("qty") / 2).cast(QTY)).otherwise(F.col("qty")).alias("quantity"),
            F.when(returned, F.lit("internal")).otherwise(F.lit("customer")).alias("dest_usage"),
            "is_return",
            F.when(returned, product % 2 == 0).otherwise(F.lit(False)).alias("to_refund"),
        )

    def events(self) -> DataFrame:
        return self.table("events")
