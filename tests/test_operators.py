"""Operators on tiny hand-made rows, and invariants."""

import os
from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from conftest import pairs
from tallygrid.functions import money
from tallygrid.functions.dates import Window, period_end, period_start
from tallygrid.operators import blanket, checks, commission, dashboard, discounts, fulfilment, invoicing, lines, promotion
from tallygrid.plans.asof import asof_join, convert_currency, merge_asof
from tallygrid.plans.ranking import top_n_with_others
from tallygrid.plans.skew import numbered, running_totals
from tallygrid.sources import sinks


def test_previous_window_is_adjacent_and_equally_long():
    w = Window(date(2024, 3, 1), date(2024, 3, 31))
    assert w.previous() == Window(date(2024, 1, 30), date(2024, 2, 29))
    assert w.previous().days == w.days


def test_filter_swaps_dates_and_drops_bad_ids():
    f = dashboard.SalesFilter.clean({"date_from": "2024-02-01", "date_to": "2024-01-01", "team_ids": ["3", "x", None]}, date(2024, 5, 1), [1])
    assert f.window == Window(date(2024, 1, 1), date(2024, 2, 1)) and f.team_ids == (3,)
    assert dashboard.SalesFilter.clean({}, date(2024, 5, 1), [1]).window.days == 30


@pytest.mark.parametrize(
    "frequency,day,start,end",
    [
        ("monthly", date(2024, 2, 20), date(2024, 2, 1), date(2024, 2, 29)),
        ("biweekly", date(2024, 2, 10), date(2024, 2, 1), date(2024, 2, 15)),
        ("biweekly", date(2024, 2, 29), date(2024, 2, 16), date(2024, 2, 28)),
        ("quaterly", date(2024, 8, 3), date(2024, 7, 1), date(2024, 9, 30)),
        ("semi", date(2024, 6, 30), date(2024, 1, 1), date(2024, 6, 30)),
        ("annual", date(2024, 6, 30), date(2024, 1, 1), date(2024, 12, 31)),
    ],
)
def test_settlement_periods(spark, frequency, day, start, end):
    s = period_start(F.lit(day), F.lit(frequency))
    got = spark.range(1).select(s.alias("s"), period_end(s, F.lit(frequency)).alias("e")).first()
    assert (got.s, got.e) == (start, end)


@pytest.mark.parametrize("groups", [3, 10, 11, 40])
def test_top_n_with_others_keeps_the_total(rows, groups):
    df = rows("record_id bigint, label string, value decimal(18,2)", [(k, str(k), D(k)) for k in range(1, groups + 1)])
    got = top_n_with_others(df).collect()
    assert len(got) == min(groups, 10)
    assert sum(r.value for r in got) == D(groups * (groups + 1) // 2)
    assert any(r.label == "Others" for r in got) == (groups > 10)


def test_running_totals_equal_a_window_for_a_hot_group(spark):
    df = spark.range(400).select((F.col("id") % 3 == 0).cast("int").alias("k"), (F.col("id") % 7).alias("b"), F.col("id").alias("v"))
    got = running_totals(df, ["k"], "b", [F.col("b"), F.col("v")], {"t": F.col("v")})
    sums = {}
    want = {}
    for r in sorted(df.collect(), key=lambda r: (r.k, r.b, r.v)):
        sums[r.k] = sums.get(r.k, 0) + r.v
        want[(r.k, r.v)] = sums[r.k]
    assert {(r.k, r.v): r.t for r in got.collect()} == want
    n = numbered(df, ["k"], "b", [F.col("b"), F.col("v")], "n")
    assert [r.n for r in n.filter("k = 1").orderBy("b", "v").collect()] == list(range(1, 135))


def test_band_join_takes_the_first_band_and_zero_outside(rows):
    bands = rows("commission_id bigint, position int, amount_from decimal(18,2), amount_to decimal(18,2), percent decimal(9,2)",
                 [(1, 1, D(1), D(100), D(10)), (1, 2, D(100), D(200), D(20)), (1, 3, D(15000), D(16000), D(30))])
    facts = rows("id int, commission_id bigint, base decimal(18,2)", [(1, 1, D(50)), (2, 1, D(100)), (3, 1, D(150)), (4, 1, D(300)), (5, 2, D(50))])
    assert pairs(commission.band_join(facts, bands, "base"), "id", "percent") == [(1, D(10)), (2, D(10)), (3, D(20)), (4, D(0)), (5, D(0))]


def test_commission_amounts(rows):
    kinds = rows("id bigint, commission_type string, fix_qty decimal(9,2), amount_base_type string",
                 [(1, "fixed", D(20), "net_amount"), (2, "formula", D(0), "gross_amount")])
    bands = rows("commission_id bigint, position int, amount_from decimal(18,2), amount_to decimal(18,2), percent decimal(9,2)", [(9, 1, D(0), D(1), D(1))])
    facts = rows("id int, commission_id bigint, commission_free boolean, price_subtotal decimal(18,2), standard_price decimal(18,2), qty decimal(18,4), move_type string",
                 [(1, 1, False, D(100), D(30), D(2), "out_invoice"), (2, 1, False, D(50), D(30), D(2), "out_invoice"), (3, 1, True, D(100), D(0), D(1), "out_invoice"),
                  (4, 2, False, D(80), D(0), D(3), "out_refund"), (5, None, False, D(80), D(0), D(3), "out_invoice")])
    got = commission.commission_amount(facts, kinds, bands, {2: "price_subtotal / 10 + qty"}, F.col("move_type") == "out_refund")
    assert pairs(got, "id", "amount") == [(1, D("8.00")), (2, D(0)), (3, D(0)), (4, D("-11.00")), (5, D(0))]


def test_settlement_invoices_turn_negative_totals_into_refunds(rows):
    settlements = rows("agent_id bigint, company_id bigint, currency_id bigint, date_from date, date_to date, amount decimal(18,2)",
                       [(1, 1, 1, date(2024, 1, 1), date(2024, 1, 31), D(100)), (1, 1, 1, date(2024, 2, 1), date(2024, 2, 29), D(-130)), (2, 1, 1, date(2024, 1, 1), date(2024, 1, 31), D(10))])
    agents = rows("id bigint, agent_type string", [(1, "agent"), (2, "salesman")])
    assert pairs(commission.settlement_invoices(settlements, agents, grouped=True), "agent_id", "move_type", "amount_total") == [(1, "in_refund", D("30.00"))]
    assert len(commission.settlement_invoices(settlements, agents).collect()) == 2


def test_stacked_discount(spark):
    df = spark.range(1).select(F.array(F.lit(20), F.lit(30)).cast("array<decimal(9,2)>").alias("d"))
    assert df.select(discounts.stacked_factor("d").alias("f"), discounts.stacked_factor(F.lit(None).cast("array<decimal(9,2)>")).alias("n")).first()[:] == (D("0.56"), D(1))


def test_prorata_shares_add_up(rows):
    df = rows("order_id bigint, price_unit decimal(18,2), qty decimal(18,4), discount decimal(9,2), add_discount decimal(9,2), add_discount_type string",
              [(1, D("10"), D(1), D(0), D(23), "fixed"), (1, D("30"), D(3), D(0), D(23), "fixed"), (1, D("0.01"), D(1), D(0), D(23), "fixed")])
    got = discounts.total_discount_prorata(df).agg(F.sum("discount2")).first()[0]
    assert got == pytest.approx(20.0)
    before = discounts.total_discount_prorata(df, "before_tax").agg(F.sum("discount2")).first()[0]
    assert before == pytest.approx(23.0)


def test_fixed_discount_at_price_zero(rows):
    df = rows("id int, price_unit decimal(18,2), qty decimal(18,4), discount decimal(9,2), discount_fixed decimal(18,2)",
              [(1, D(750), D(1), D(0), D(100)), (2, D(0), D(1), D(0), D(100)), (3, D(100), D(2), D(10), D(0))])
    got = discounts.fixed_discount(df)
    assert pairs(got, "id", "discount_percent", "subtotal") == [(1, 13.33, D(650)), (2, 0.0, D(0)), (3, 10.0, D(180))]


def test_delivery_states(rows):
    orders = rows("id bigint, state string, force_delivered boolean", [(1, "sale", False), (2, "sale", False), (3, "sale", False), (4, "sale", True), (5, "draft", False), (6, "sale", False)])
    ls = rows("order_id bigint, is_delivery boolean, skip boolean, qty decimal(18,4), qty_delivered decimal(18,4)",
              [(1, False, False, D(5), D(5)), (1, True, False, D(1), D(0)), (2, False, False, D(5), D(2)), (3, False, False, D(5), D(0)), (4, False, False, D(5), D(0)), (5, False, False, D(1), D(1)), (6, False, True, D(1), D(0))])
    assert [r.delivery_state for r in fulfilment.delivery_state(orders, ls).orderBy("id").collect()] == ["full", "partial", "pending", "full", None, "full"]


def test_installment_dates_are_chained(rows):
    orders = rows("id bigint, start date", [(1, date(2023, 1, 31))])
    got = invoicing.invoice_plan_generate(orders, 3, "start", 1, "month", advance=False).orderBy("installment").collect()
    assert [r.plan_date for r in got] == [date(2023, 1, 31), date(2023, 2, 28), date(2023, 3, 28)]
    assert sum(r.percent for r in got) == D(100)


def test_allocation_spends_refunds_first_and_never_more_than_the_budget(rows):
    inv = rows("id bigint, c bigint, state string, payment_state string, move_type string, invoice_date date, amount_residual decimal(18,2)",
               [(1, 1, "posted", "not_paid", "out_invoice", date(2024, 1, 2), D(60)), (2, 1, "posted", "not_paid", "out_invoice", date(2024, 1, 1), D(50)),
                (3, 1, "posted", "not_paid", "out_refund", date(2024, 1, 9), D(20)), (4, 1, "posted", "not_paid", "out_invoice", date(2024, 1, 3), D(60)), (5, 1, "draft", "not_paid", "out_invoice", date(2024, 1, 1), D(60))])
    got = invoicing.greedy_payment_allocation(inv, rows("c bigint, budget decimal(18,2)", [(1, D(70))]), "c")
    assert pairs(got, "id", "payment") == [(1, D(40)), (2, D(50)), (3, D(-20))]


def test_nearest_blanket_line(rows):
    cand = rows("id bigint, partner_id bigint, product_id bigint, currency_id bigint, state string, remaining decimal(18,4), date_schedule date",
                [(1, 1, 1, 1, "open", D(5), None), (2, 1, 1, 1, "open", D(5), date(2024, 1, 20)), (3, 1, 1, 1, "open", D(50), date(2024, 3, 1)), (4, 1, 1, 1, "done", D(99), date(2024, 1, 1)), (5, 1, 1, 1, "open", D(900), date(2026, 1, 1))])
    sale = rows("order_id bigint, partner_id bigint, product_id bigint, currency_id bigint, qty decimal(18,4)", [(1, 1, 1, 1, D(2)), (2, 1, 1, 1, D(20)), (3, 1, 1, 1, D(100)), (4, 1, 2, 1, D(1))])
    sale = sale.selectExpr("*", "1L AS uom_id", "1L AS product_uom_id", "CAST(NULL AS BIGINT) AS blanket_line_id")
    got = blanket.nearest_blanket_line(sale, cand, rows("id bigint, factor decimal(9,4)", [(1, D(1))]), ["order_id"], date(2024, 1, 1))
    assert pairs(got.na.fill(0), "order_id", "blanket_line_id") == [(1, 2), (2, 3), (3, 0), (4, 0)]


def test_asof_join_picks_the_latest_rate(rows):
    rates = rows("id bigint, c bigint, date date, rate decimal(9,2)", [(1, 1, date(2023, 1, 1), D(25)), (2, 1, date(2023, 3, 15), D(30)), (3, 1, date(2023, 3, 15), D(31)), (4, 2, date(2024, 1, 1), D(2))])
    facts = rows("id bigint, c bigint, day date", [(1, 1, date(2022, 12, 31)), (2, 1, date(2023, 3, 14)), (3, 1, date(2023, 3, 15)), (4, 1, date(2030, 1, 1)), (5, 2, date(2024, 1, 1)), (6, 3, date(2024, 1, 1))])
    for short in (0, 4):
        got = {r.id: r.rate for r in asof_join(facts, rates, ["c"], "day", ["rate"], short=short).collect()}
        assert got == {1: None, 2: D(25), 3: D(31), 4: D(31), 5: D(2), 6: None}


def test_merge_asof_takes_nulls_repeats_and_no_rates(rows):
    rates = rows("id bigint, c bigint, date date, rate decimal(9,2)", [(1, 1, date(2023, 1, 1), D(25)), (2, None, date(2020, 1, 1), D(9)), (3, 1, None, D(8)), (4, 1, date(2023, 2, 1), None)])
    facts = rows("id bigint, c bigint, day date, _rate string", [(1, 1, date(2023, 1, 5), "x"), (1, 1, date(2023, 1, 5), "x"), (2, None, date(2023, 1, 5), None), (3, 1, None, ""), (4, 1, date(2023, 3, 1), "y")])
    got = sorted((r.id, r.rate, r._rate) for r in merge_asof(facts, rates, ["c"], "day", ["rate"]).na.fill("-", ["_rate"]).na.fill({"rate": 0}).collect())
    assert got == [(1, D(25), "x"), (1, D(25), "x"), (2, D(0), "-"), (3, D(0), ""), (4, D(0), "y")]
    assert merge_asof(facts, rates.filter("id < 0"), ["c"], "day", ["rate"]).filter("rate IS NULL").count() == 5
    assert merge_asof(facts.filter("id < 0"), rates, ["c"], "day", ["rate"]).count() == 0


def test_merge_asof_spreads_one_key(spark):
    """300,000 facts of one currency: the rate of every day, and no run holds more than a fraction of them."""
    days = spark.range(1000).select(F.col("id"), F.lit(1).cast("bigint").alias("c"), F.date_add(F.lit(date(2020, 1, 1)), F.col("id").cast("int")).alias("date"), (F.col("id") * 2).alias("rate"))
    rates = days.filter("id % 3 = 0")
    facts = spark.range(300_000).select("id", F.lit(1).cast("bigint").alias("c"), F.date_add(F.lit(date(2020, 1, 1)), F.when(F.col("id") % 2 == 0, 500).otherwise(F.col("id") % 1000).cast("int")).alias("day"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = merge_asof(facts, rates, ["c"], "day", ["rate"])
        assert "BroadcastNestedLoop" not in out._jdf.queryExecution().toString()
        off = out.withColumn("n", F.date_diff("day", F.lit(date(2020, 1, 1)))).filter(~F.col("rate").eqNullSafe((F.col("n") - F.col("n") % 3) * 2))
        assert (out.count(), off.count()) == (300_000, 0)
        sizes = [r["count"] for r in spark.read.parquet(os.path.dirname(out.inputFiles()[0])).groupBy(F.shiftright("_at", 33)).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) >= 4 and max(sizes) < 150_000


def _python_fold(discount, rules):
    taken = []
    for rid, strategy, kind, amount in rules:
        ok = strategy in ("cumulate", "exclusive") or (strategy == "use_best" and (not discount or amount > discount)) or (strategy == "keep_existing" and not discount)
        if ok:
            discount = (discount if strategy == "cumulate" else 0) + (amount if kind == "percentage" else 0)
            taken.append(rid)
    return discount, taken


PROMO_RULES = (
    "id bigint, sequence int, rule_type string, code string, discount_type string, discount_amount decimal(9,2), minimal_amount decimal(18,2), minimal_tax_incl boolean, "
    "date_from date, date_to date, once_per_partner boolean, strategy string, partner_ids array<bigint>, pricelist_ids array<bigint>, only_newsletter boolean, currency_id bigint, "
    "taxes array<struct<id:int,kind:string,rate:decimal(9,2),included:boolean,tax_group:int>>"
)
VAT_EXCLUDED, VAT_INCLUDED = (1, "percent", D(21), False, 1), (2, "percent", D(21), True, 1)


def _rule(rid, strategy, kind="percentage", amount=10, minimum=0, **other):
    values = dict(id=rid, sequence=rid, rule_type="auto", code=None, discount_type=kind, discount_amount=D(amount), minimal_amount=D(minimum),
                  minimal_tax_incl=False, date_from=None, date_to=None, once_per_partner=False, strategy=strategy, partner_ids=[], pricelist_ids=[],
                  only_newsletter=False, currency_id=1, taxes=[VAT_EXCLUDED])
    return tuple((values | other).values())


def _promote(rows, rules, order_lines, orders=None, used=None, rates=((1, 1, date(2020, 1, 1), D(1)), (2, 2, date(2020, 1, 1), D(2)))):
    """order_lines: (order, line, price, quantity, discount, taxes, is promotion line)."""
    orders = orders or sorted({(o, 1, 1, 1, True, None) for o, *_ in order_lines})
    heads = rows("id bigint, partner_id bigint, pricelist_id bigint, currency_id bigint, newsletter boolean, coupon_code string", orders)
    tax = "taxes array<struct<id:int,kind:string,rate:decimal(9,2),included:boolean,tax_group:int>>"
    found = rows(f"order_id bigint, line_no bigint, price_unit decimal(18,2), qty decimal(18,4), discount decimal(9,2), {tax}, is_promotion_line boolean", order_lines)
    at = rows("id bigint, currency_id bigint, date date, rate decimal(12,6)", list(rates))
    earlier = used and rows("partner_id bigint, rule_id bigint, order_id bigint, state string", used)
    return found, promotion.applied_rules(heads, found, rows(PROMO_RULES, rules), at, date(2024, 1, 1), earlier)


def test_promotion_fold_equals_plain_python(spark, rows):
    import itertools

    strategies = ("use_best", "cumulate", "keep_existing", "exclusive")
    pairs_, rules, order_lines, want = list(itertools.product(strategies, strategies)), [], [], {}
    for n, (a, b) in enumerate(pairs_):
        chosen = [(2 * n + 1, a, "percentage", 10), (2 * n + 2, b, "percentage" if n % 2 else "amount_tax_included", 12)]
        rules += [_rule(i, strategy, kind, amount, partner_ids=[n]) for i, strategy, kind, amount in chosen]
        kept = chosen if b != "exclusive" else chosen[:1]  # exclusive: only as the first
        for k, start in enumerate((0, 5, 15, 12)):
            order_lines.append((n, k, D(100), D(1), D(start), [VAT_EXCLUDED], False))
            want[n, k] = _python_fold(start, kept)
    found, applied = _promote(rows, rules, order_lines, [(n, n, 1, 1, True, None) for n in range(len(pairs_))])
    got = {(r.order_id, r.line_no): (int(r.promo_discount), list(r.taken_rules)) for r in promotion.promoted_lines(found, applied).collect()}
    assert got == want


def test_fixed_amounts_lower_the_sums_of_later_rules(rows):
    # 1,000 untaxed: the first rule takes 300 off, so 750 is no longer reached; taxed it still is (1,210 - 363 = 847)
    rules = [_rule(1, "cumulate", "amount_tax_excluded", 300), _rule(2, "cumulate", minimum=750), _rule(3, "cumulate", minimum=750, minimal_tax_incl=True)]
    order_lines = [(1, 1, D(500), D(2), D(0), [VAT_EXCLUDED], False), (2, 1, D(1000), D(1), D(50), [VAT_EXCLUDED], True)]
    found, applied = _promote(rows, rules, order_lines)
    assert {r.order_id: list(r.applied) for r in applied.collect()} == {1: [1, 3], 2: []}
    # no line takes a fixed amount that must keep existing discounts: the sums stay, the order still has the rule
    rules[0] = _rule(1, "keep_existing", "amount_tax_excluded", 300)
    _, applied = _promote(rows, rules, [(1, 1, D(500), D(2), D(5), [VAT_EXCLUDED], False)])
    row = applied.first()
    assert list(row.applied) == [1, 2, 3] and row.lines == []


def test_fixed_amounts_meet_the_discount_with_either_tax(rows):
    import itertools

    cases = list(itertools.product(("amount_tax_excluded", "amount_tax_included"), (VAT_EXCLUDED, VAT_INCLUDED), ("20", "3", "719.77", "0.01")))
    rules = [_rule(n, "use_best", kind, D(amount), taxes=[tax], partner_ids=[n]) for n, (kind, tax, amount) in enumerate(cases)]
    order_lines = [(n, 1, D(5000), D(1), D(0), [tax], False) for n, (_, tax, _) in enumerate(cases)]
    _, applied = _promote(rows, rules, order_lines, [(n, n, 1, 1, True, None) for n in range(len(cases))])
    prices = {r.order_id: -r.price_unit for r in promotion.discount_lines(applied).collect()}
    for n, (kind, tax, amount) in enumerate(cases):
        base = prices[n] if tax is VAT_EXCLUDED else (prices[n] * 100 / 121).quantize(D("0.01"), "ROUND_HALF_UP")
        taxed = base + (base * D("0.21")).quantize(D("0.01"), "ROUND_HALF_UP")
        assert abs((taxed if kind.endswith("included") else base) - D(amount)) <= D("0.01")
        if tax is VAT_EXCLUDED and kind.endswith("excluded"):
            assert prices[n] == D(amount)


def test_fixed_amounts_are_converted_and_need_a_rate(rows):
    rules = [_rule(1, "use_best", "amount_tax_excluded", 20, currency_id=2, taxes=[])]
    orders = [(1, 1, 1, 1, True, None), (2, 1, 1, 2, True, None), (3, 1, 1, 9, True, None)]
    order_lines = [(o, 1, D(100), D(1), D(0), [], False) for o in (1, 2, 3)]
    _, applied = _promote(rows, rules, order_lines, orders)
    assert {(r.order_id, r.price_unit) for r in promotion.discount_lines(applied).collect()} == {(1, D(-10)), (2, D(-20))}


def test_coupon_goes_first_and_once_per_partner_counts_other_orders(rows):
    rules = [_rule(1, "exclusive"), _rule(2, "exclusive", rule_type="coupon", code="Elgekot", sequence=99), _rule(3, "cumulate", once_per_partner=True),
             _rule(4, "cumulate", partner_ids=[7], pricelist_ids=[5]), _rule(5, "cumulate", only_newsletter=True, pricelist_ids=[1])]
    orders = [(1, 1, 1, 1, True, "ELGEKOT"), (2, 1, 1, 1, False, "other"), (3, 7, 5, 1, None, None), (4, 8, 5, 1, True, None)]
    order_lines = [(o, 1, D(100), D(1), D(0), [], False) for o in (1, 2, 3, 4)]
    used = [(1, 3, 1, "sale"), (7, 3, 99, "cancel"), (8, 3, 98, "draft")]
    _, applied = _promote(rows, rules, order_lines, orders, used)
    # partner 1 used rule 3 on order 1 only: order 1 may keep it, order 2 may not; partner 7's use was cancelled
    assert {r.order_id: list(r.applied) for r in applied.collect()} == {1: [2, 3, 5], 2: [1], 3: [1, 3, 4], 4: [1]}


def test_exceptions_respect_the_ignore_flag(rows):
    orders = rows("id bigint, ignore_exceptions boolean, amount_total decimal(18,2)", [(1, False, D(0)), (2, True, D(0)), (3, False, D(5))])
    ls = rows("order_id bigint, qty int", [(1, 1), (2, 99), (3, 99), (3, 98)])
    rules = [checks.ExceptionRule("zero", "order", "amount_total = 0"), checks.ExceptionRule("many", "line", "qty > 50")]
    assert pairs(checks.exception_rules(orders, ls, rules), "order_id", "rule") == [(1, "zero"), (3, "many")]


def test_restricted_quantities_inherit(rows):
    level = "min_qty decimal(18,4), max_qty decimal(18,4), multiple_qty decimal(18,4), force_min string, force_max string"
    none = (D(0), D(0), D(0), "use_parent", "use_parent")
    products = rows(f"id bigint, template_id bigint, categ_id bigint, {level}", [(1, 1, 2, *none), (2, 2, 2, D(3), D(0), D(0), "not_force", "use_parent")])
    templates = rows(f"id bigint, {level}", [(1, *none), (2, D(7), D(70), D(0), "force", "use_parent")])
    cats = rows(f"id bigint, parent_path string, {level}", [(1, "1/", D(10), D(100), D(5), "force", "use_parent"), (2, "1/2/", D(0), D(90), D(0), "use_parent", "use_parent")])
    got = {r.product_id: r for r in checks.restricted_qty_resolve(products, templates, cats).collect()}
    assert (got[1].min_qty, got[1].max_qty, got[1].multiple_qty, got[1].force_min) == (10, 90, 5, True)
    assert (got[2].min_qty, got[2].max_qty, got[2].multiple_qty, got[2].force_min) == (3, 70, 5, False)


def test_lots_continue_from_the_highest_number(rows):
    df = rows("order_id bigint, order_name string, line_no bigint, sequence bigint, lot_name string, auto_lot boolean",
              [(1, "S1", 1, 1, "S1-007", True), (1, "S1", 2, 2, None, True), (1, "S1", 3, 3, None, False), (1, "S1", 4, 4, None, True)])
    assert pairs(lines.lot_numbers(df), "line_no", "lot_name") == [(2, "S1-008"), (4, "S1-009")]


def test_csv_doubles_quotes(spark, rows, tmp_path):
    sinks.sink_csv_export(rows("id int, t string, hidden int", [(1, 'say "hi", x', 9)]).coalesce(1), str(tmp_path / "o"), ["id", "t"])
    text = next((tmp_path / "o").glob("*.csv")).read_text()
    assert text == '"id","t"\n"1","say ""hi"", x"\n'


def test_stream_over_many_batches_equals_batch(spark, tmp_path):
    from tallygrid.streaming import jobs

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for n in range(4):  # slices in time order, one file each
        lo, hi = f"2024-01-{1 + n * 8:02d}", f"2024-01-{9 + n * 8:02d}" if n < 3 else "2024-03-01"
        events.filter(f"ts >= '{lo}' AND ts < '{hi}'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = jobs.run_available(jobs.stream_daily_revenue(source), "update", str(tmp_path / "job"))
    got = {r.day: (r.revenue, r.orders) for r in jobs.latest_per_key(spark, out, ["day"]).collect()}
    want = events.filter("event_type = 'purchase'").groupBy(F.to_date("ts").alias("day")).agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("r"), F.count("*").alias("n"))
    assert got == {r.day: (r.r, r.n) for r in want.collect()}


def test_null_buckets_and_keys_keep_their_rows(spark):
    rows = [(1, None, 5), (1, 2, 7), (None, 1, 3)]
    frame = spark.createDataFrame(rows, "k int, seq int, v int")
    found = running_totals(frame, ["k"], "seq", [F.col("seq")], {"run": F.col("v")}).collect()
    assert sorted((r["v"], r["run"]) for r in found) == [(3, 3), (5, 5), (7, 12)]


def test_currency_is_converted_before_rounding(spark):
    day = date(2024, 1, 2)
    rates = spark.createDataFrame([(1, 1, day, D("3")), (2, 2, day, D("1")), (3, 3, day, D("100000")), (4, 4, day, D("0.7"))], "id long, currency_id long, date date, rate decimal(12,6)")
    facts = spark.createDataFrame([(D("1000000.00"), 1, 2, day), (D("90000000000.00"), 3, 4, day)], "a decimal(18,2), src long, dst long, day date")
    found = {r["a"]: r["out"] for r in convert_currency(facts, rates, "a", "src", "dst", "day", "out").collect()}
    assert found == {D("1000000.00"): D("333333.33"), D("90000000000.00"): D("630000.00")}


def test_prefix_sums_spread_one_large_group(spark):
    """200,000 rows of one key with unique order values: same sums as a window, and no run holds the group."""
    from tallygrid.plans.skew import prefix_sums
    from tallygrid.session import staged

    hot = spark.range(200_000).select(F.lit(1).cast("bigint").alias("k"), F.col("id").alias("seq"), (F.col("id") % 7 - 3).alias("v"))
    small = spark.range(3000).select((F.col("id") % 1000 + 2).alias("k"), F.col("id").alias("seq"), F.lit(1).cast("bigint").alias("v"))
    none = spark.range(10).select(F.lit(None).cast("bigint").alias("k"), F.col("id").alias("seq"), F.lit(2).cast("bigint").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = staged(prefix_sums(hot.unionByName(small).unionByName(none), ["k"], [F.col("seq")], {"run": F.col("v"), "n": F.lit(1).cast("bigint")}), "sums")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    first = got.filter("k = 1").agg(F.count("*"), F.sum(F.when(F.col("n") == F.col("seq") + 1, 0).otherwise(1)), F.max("n")).first()
    assert tuple(first) == (200_000, 0, 200_000)
    at = {r.seq: r.run for r in got.filter("k = 1 AND seq IN (0, 99999, 199999)").collect()}
    assert at == {s: sum(i % 7 - 3 for i in range(s + 1)) for s in (0, 99999, 199999)}
    assert got.filter("k > 1").agg(F.max("n"), F.count("*")).first()[:] == (3, 3000)
    assert sorted(r.run for r in got.filter("k IS NULL").collect()) == list(range(2, 21, 2))


def test_prefix_sums_of_nothing(spark):
    from tallygrid.plans.skew import prefix_sums

    empty = spark.createDataFrame([], "k bigint, seq bigint, v bigint")
    assert prefix_sums(empty, ["k"], [F.col("seq")], {"run": F.col("v")}).count() == 0


def test_key_sets_count_nulls_only_where_they_are_equal(rows):
    df = rows("a string, b bigint", [("x", 1), ("x", 1), ("x", None), ("x", None), ("x/1", 2), ("x", 12), (None, None), (None, None)])
    slash = rows("a string, b string", [("p/q", "r"), ("p", "q/r")])
    sets = [checks.KeySet("plain", df, ("a", "b")), checks.KeySet("null", df, ("a", "b"), nulls_equal=True), checks.KeySet("slash", slash, ("a", "b"))]
    assert pairs(checks.uniqueness_checks(sets), "rule", "key", "n") == [("null", "/", 2), ("null", "x/", 2), ("null", "x/1", 2), ("plain", "x/1", 2)]


def test_ranges_pass_nulls_and_ask_for_owners(rows):
    df = rows("id bigint, p bigint, d bigint, r double, scope string, team bigint, usr bigint",
              [(1, 101, -1, 0.0, "team", None, 1), (2, None, None, None, "user", 1, None), (3, 0, 0, 0.1, "user", None, 4)])
    tests = checks.out_of_range(F.col("p"), F.col("d"), F.col("r"), (F.col("scope"), F.col("team"), F.col("usr")))
    assert pairs(checks.failing(df, *tests), "id", "reason") == [
        (1, "negative cancel days"), (1, "probability out of range"), (1, "rate not positive"), (1, "team missing"), (2, "salesperson missing"),
    ]


def test_a_second_settlement_run_adds_nothing_until_one_is_cancelled(rows):
    line = "order_id bigint, agent_id bigint, commission_id bigint, company_id bigint, currency_id bigint, invoice_date date, move_state string, payment_state string, product_id bigint, amount decimal(18,2)"
    facts = rows(line, [(n, 1, 1, 1, 1, d, "posted", "paid", 5, D(10)) for n, d in enumerate((date(2024, 1, 3), date(2024, 1, 30), date(2024, 2, 5)))])
    agents = rows("id bigint, settlement string", [(1, "monthly")])
    terms = rows("id bigint, invoice_state string", [(1, "paid")])
    keys, top = "agent_id bigint, company_id bigint, currency_id bigint, date_from date, date_to date", date(2024, 2, 20)

    def run(settlements, settled, date_to=top):
        found = commission.settlement_run(facts, agents, terms, rows(f"id string, {keys}, state string", settlements), rows("settlement_id string, order_id bigint", settled), date_to, ["order_id"])
        return sorted((r.settlement_id, r.order_id) for r in found.collect())

    january = "1/1/1/2024-01-01/2024-01-31/"
    made = [(january + "0", 1, 1, 1, date(2024, 1, 1), date(2024, 1, 31), "settled")]
    assert run([], []) == [(january + "0", 0), (january + "0", 1)]
    assert run(made, [(january + "0", 0), (january + "0", 1)]) == []
    assert run(made, [(january + "0", 0)]) == [(january + "0", 1)]  # the open settlement is extended
    assert run([(*made[0][:-1], "cancel")], [(january + "0", 0), (january + "0", 1)]) == [(january + "1", 0), (january + "1", 1)]
    assert run(made, [(january + "0", 0), (january + "0", 1)], date(2024, 3, 1)) == [("1/1/1/2024-02-01/2024-02-29/0", 2)]


def test_assigned_blanket_lines_stay_while_they_have_enough(rows):
    line = "line_id bigint, partner_id bigint, product_id bigint, currency_id bigint, qty decimal(18,4), uom_id bigint, product_uom_id bigint, blanket_line_id bigint"
    held = "id bigint, partner_id bigint, product_id bigint, currency_id bigint, state string, remaining decimal(18,4), date_schedule date"
    blankets = rows(held, [
        (10, 1, 1, 1, "open", D(100), date(2024, 6, 1)), (11, 1, 1, 1, "open", D(20), date(2024, 1, 10)), (12, 1, 1, 1, "open", D(1000), None),
        (13, 1, 1, 1, "open", D(100), date(2030, 1, 1)), (14, 1, 1, 1, "done", D(1000), date(2024, 1, 1)),
    ])
    units = rows("id bigint, factor decimal(9,4)", [(1, D(1)), (2, D("0.25"))])
    asked = rows(line, [
        (1, 1, 1, 1, D(10), 1, 1, None), (2, 1, 1, 1, D(10), 2, 1, None),  # ten packs of four are 40
        (3, 1, 1, 1, D(10), 1, 1, 10), (4, 1, 1, 1, D(10), 1, 1, 13), (5, 1, 1, 1, D(50), 1, 1, 11), (6, 1, 1, 1, D(5), 1, 1, 14),
        (7, 1, 1, 1, D(500), 1, 1, None), (8, 1, 1, 1, D(5000), 1, 1, 10), (9, 2, 1, 1, D(1), 1, 1, 10),
    ])
    got = blanket.nearest_blanket_line(asked, blankets, units, ["line_id"], date(2024, 1, 1))
    assert dict(pairs(got.fillna(-1), "line_id", "blanket_line_id")) == {1: 11, 2: 10, 3: 10, 4: 13, 5: 10, 6: 11, 7: 12, 8: -1, 9: -1}
    assert dict(pairs(blanket.nearest_blanket_line(asked, blankets, units, ["line_id"], date(2024, 1, 1), 5).fillna(-1), "line_id", "blanket_line_id"))[1] == 12


@pytest.mark.parametrize("delivery", [False, True])
def test_recommendations_of_many_orders_equal_those_of_each(rows, delivery):
    """Random orders of three customer groups, limit 2, own deliveries and repeated products: batch form against the single one."""
    import random

    from tallygrid.operators import recommend

    rnd = random.Random(5)
    paths = {1: "1/", 2: "1/2/", 3: "1/2/3/", 4: "4/", 5: "4/5/", 6: "6/"}
    partners = rows("id bigint, parent_path string, commercial_partner_id bigint", [(k, p, {1: 1, 2: 1, 3: 2, 4: 4, 5: 4, 6: 6}[k]) for k, p in paths.items()])
    products = rows("id bigint, active boolean, sale_ok boolean, priority string, list_price decimal(18,2)", [(k, k != 7, k != 8, "0", D(k)) for k in range(1, 10)])
    heads = [(n, rnd.randint(1, 2), rnd.randint(1, 6), rnd.randint(1, 6), 1, date(2024, rnd.randint(1, 12), 1), "sale") for n in range(24)]
    orders = rows("id bigint, company_id bigint, partner_id bigint, partner_shipping_id bigint, pricelist_id bigint, date_order date, state string", heads)
    sold = [(n, k, rnd.randint(1, 9), D(rnd.randint(1, 3)), D(rnd.choice([0, 1, 2])), rnd.random() < 0.1, "line_note" if rnd.random() < 0.1 else None) for n in range(23) for k in range(rnd.randint(0, 5))]
    items = rows("order_id bigint, line_no bigint, product_id bigint, qty decimal(18,4), qty_delivered decimal(18,4), is_delivery boolean, display_type string", sold).withColumn("price_unit", F.lit(D("3.00")))
    args = (orders, items, partners, products, date(2024, 12, 31))
    chosen = [0, 3, 8, 11, 23]
    got = recommend.recommend_for_orders(orders.filter(F.col("id").isin(chosen)), *args, months=8, amount=2, use_delivery_address=delivery).collect()
    columns = ["product_id", "times_delivered", "units_delivered", "units_included", "in_basket"]
    for n in chosen:
        one = recommend.recommend_products(n, *args, months=8, amount=2, use_delivery_address=delivery).collect()
        assert sorted(tuple(r[c] for c in columns) for r in got if r.order_id == n) == sorted(tuple(r[c] for c in columns) for r in one)
    assert all(r.price_unit == r.product_id for r in got)
    with pytest.raises(ValueError):
        recommend.recommend_for_orders(orders, *args, price_origin="other")


@pytest.mark.parametrize("spare, group_orders, ranked", [(32, 100_000, 0), (1, 100_000, 1), (32, 2, 0)])
def test_orders_read_one_list_of_their_group_and_ranks_only_when_long(rows, monkeypatch, spare, group_orders, ranked):
    """Lists, ranks (orders with more products than a list has to spare) and dealt groups give what the single form gives."""
    import random

    from tallygrid.operators import recommend

    calls = []
    monkeypatch.setattr(recommend, "prefix_sums", lambda *a, plain=recommend.prefix_sums: calls.append(a) or plain(*a))
    monkeypatch.setattr(recommend, "SPARE", spare, raising=False)
    monkeypatch.setattr(recommend, "GROUP_ORDERS", group_orders, raising=False)
    rnd = random.Random(11)
    partners = rows("id bigint, parent_path string, commercial_partner_id bigint", [(1, "1/", 1), (2, "1/2/", 1), (3, "3/", 3)])
    products = rows("id bigint, active boolean, sale_ok boolean, priority string, list_price decimal(18,2)", [(k, k != 7, True, "0", D(k)) for k in range(1, 15)])
    heads = [(n, 1, rnd.randint(1, 3), 1, date(2024, rnd.randint(1, 12), 1), "sale") for n in range(20)]
    orders = rows("id bigint, company_id bigint, partner_id bigint, pricelist_id bigint, date_order date, state string", heads)
    sold = [(n, k, rnd.randint(1, 14), D(rnd.randint(1, 3)), D(rnd.choice([0, 1, 2])), False, "line_note" if rnd.random() < 0.2 else None, D(n + k)) for n in range(20) for k in range(rnd.randint(0, 6))]
    items = rows("order_id bigint, line_no bigint, product_id bigint, qty decimal(18,4), qty_delivered decimal(18,4), is_delivery boolean, display_type string, price_unit decimal(18,2)", sold)
    args = (orders, items, partners, products, date(2024, 12, 31))
    got = recommend.recommend_for_orders(orders, *args, months=8, amount=3, price_origin="last_sale_price").collect()
    columns = ["product_id", "times_delivered", "units_delivered", "units_included", "in_basket"]
    for n in (0, 3, 7, 12, 19):
        one = recommend.recommend_products(n, *args, months=8, amount=3).collect()
        assert sorted(tuple(r[c] for c in columns) for r in got if r.order_id == n) == sorted(tuple(r[c] for c in columns) for r in one)
    last = {(r.partner_id, r.product_id): r.price_unit for r in recommend.last_sale_price(orders, items).collect()}
    assert all(r.price_unit == last.get((heads[r.order_id][2], r.product_id), 0) for r in got)
    assert len(calls) == ranked


def test_hooks_apply_in_order_and_end_with_their_block(rows):
    from tallygrid.operators import hooks

    lines = rows("order_id bigint, order_name string, commitment_date date, line_warehouse_id bigint, blocked boolean, qty decimal(18,4)", [(1, "S1", date(2024, 1, 10), None, False, D(1)), (2, "S2", None, 4, False, D(2))])
    plain = [(1, "S1/2024-01-09"), (2, "S2/W4")]
    with hooks.extended(hooks.GROUP_NAME, lambda name: F.concat(name, F.lit("-a"))), hooks.extended(hooks.GROUP_NAME, lambda name: F.concat(name, F.lit("-b"))):
        changed = fulfilment.procurement_groups(lines, 1)
    assert pairs(changed, "order_id", "group_name") == [(k, f"{n}-a-b") for k, n in plain]
    assert pairs(fulfilment.procurement_groups(lines, 1), "order_id", "group_name") == plain
    with pytest.raises(ValueError), hooks.extended("no such point", lambda c: c):
        pass


def test_assortment_lines_take_partners_without_and_unknown_products(rows):
    from tallygrid.operators import visibility

    products = rows("id bigint, price bigint", [(1, 5), (2, 50), (3, None)])
    given = rows("partner_id bigint, assortment_id bigint", [(1, 1), (1, 2), (2, 1), (2, 1)])
    sold = rows("partner_id bigint, product_id bigint", [(1, 1), (1, 2), (1, 3), (2, 1), (3, 3), (2, 9), (3, 9), (None, 1)])
    got = visibility.assortment_lines(sold, products, given, {1: "price > 1", 2: "price > 10"}).na.fill(0, ["partner_id"])
    assert pairs(got, "partner_id", "product_id", "in_assortment") == [(0, 1, True), (1, 1, False), (1, 2, True), (1, 3, False), (2, 1, True), (2, 9, False), (3, 3, True), (3, 9, True)]


def test_union_all_analytics_sums_orders_and_invoices_by_user_and_currency(rows):
    from tallygrid.operators import reports
    from workload.checks import SQL_ANALYTICS
    from workload.registry import ORACLES

    columns = "id bigint, user_id bigint, currency_id bigint, discount_amount decimal(18,2), state string"
    orders = rows(columns, [(4, 1, 1, D(2), "sale"), (3, 1, 1, D(3), "draft"), (5, None, 1, D(1), "done"), (6, None, 1, None, "done")])
    billed = [(7, 1, 1, D(4), "posted", "out_invoice"), (8, 1, 1, D(1), "draft", "out_refund"), (9, 1, 1, D(9), "posted", "entry")]
    got = reports.union_all_analytics(orders, rows(columns + ", move_type string", billed)).na.fill(0, ["user_id"])
    assert pairs(got, "id", "user_id", "currency_id", "total_discount", "order_count", "invoice_count") == [(-7, 1, 1, D(5), 0, 1), (3, 1, 1, D(5), 1, 0), (5, 0, 1, D(1), 2, 0)]
    assert ORACLES["union_all_analytics"].endswith(SQL_ANALYTICS)


def test_assortment_products_spread_a_hot_combination(rows, spark):
    from tallygrid.operators import visibility

    products = spark.range(300).select("id", (F.col("id") % 2).alias("odd"))
    given = spark.range(40).select(F.col("id").alias("partner_id"), F.explode(F.array(F.lit(1), F.lit(2)).cast("array<bigint>")).alias("assortment_id"))
    given = given.unionByName(given).unionByName(rows("partner_id bigint, assortment_id bigint", [(None, 2), (50, 9), (51, None)]))
    predicates = {1: "odd = 1", 2: "id > 99"}
    got = visibility.assortment_products(products.unionByName(products.filter("id = 201")), given, predicates)
    expected = [(p, q) for p in range(40) for q in [*range(101, 300, 2), 201]] + [(-1, q) for q in [*range(100, 300), 201]]
    assert pairs(got.na.fill(-1, ["partner_id"]), "partner_id", "product_id") == sorted(expected)
    # partners and products of one combination meet in many parts, not in one task
    parts = got.groupBy(F.spark_partition_id()).count()
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = [r["count"] for r in parts.collect()]
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert max(sizes) < 0.6 * sum(sizes)


def test_assortment_pairs_come_in_runs_that_files_hold_small(spark, tmp_path, monkeypatch):
    """All pairs of a combination, with more products than a block; written, a pair takes a small part of a byte."""
    from tallygrid.operators import visibility

    monkeypatch.setattr(visibility, "PRODUCT_PARTS", 1)  # 20,003 products of a part, as many partners have in large tables
    products = spark.range(20_003).select("id", F.lit(1).alias("one"))
    given = spark.range(300).select((F.col("id") * 7919 + (1 << 40)).alias("partner_id"), F.lit(1).cast("bigint").alias("assortment_id"))
    out, keep = str(tmp_path / "pairs"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        visibility.assortment_products(products, given, {1: "one = 1"}).write.parquet(out)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    found = spark.read.parquet(out).agg(F.count("*"), F.count_distinct("partner_id"), F.count_distinct("product_id"), F.sum("product_id"))
    assert tuple(found.first()) == (300 * 20_003, 300, 20_003, 300 * sum(range(20_003)))
    assert sum(os.path.getsize(os.path.join(out, f)) for f in os.listdir(out) if f.endswith(".parquet")) < 0.4 * 300 * 20_003


def shuffles(spark, make) -> int:
    """Exchanges of the planned query when nothing is small enough to be sent to all tasks."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return make()._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_plan_progress_shuffles_plans_and_orders_once(spark, rows):
    plans = rows(
        "order_id bigint, installment int, invoice_type string, percent decimal(9,2), invoiced boolean, amount_invoiced decimal(18,2)",
        [(1, 0, "advance", D(0), False, None), (1, 1, "installment", D(30), True, D(31)), (1, 2, "installment", D(70), False, None),
         (2, 1, "installment", D(100), True, D(9)), (3, 1, "installment", D(100), False, None), (None, 1, "installment", D(100), False, None)],
    )
    orders = rows("id bigint, state string, amount_untaxed decimal(18,2)", [(1, "sale", D(100)), (2, "sale", D(10)), (None, "sale", D(1))])
    got = invoicing.plan_progress(plans, orders)
    assert pairs(got, "order_id", "installment", "amount", "last", "to_invoice", "processable") == [
        (1, 0, D(0), False, True, True), (1, 1, D(31), False, False, True), (1, 2, D(69), True, False, True), (2, 1, D(9), True, False, False)
    ]
    assert shuffles(spark, lambda: invoicing.plan_progress(plans.repartition(2), orders.repartition(2))) == 2


def test_lines_are_numbered_in_one_shuffle_also_without_an_order(spark, tmp_path):
    from tallygrid.sources.star import Star

    kinds = {"l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
             "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp"}
    schema = "l_orderkey long, l_partkey long, l_suppkey long, " + ", ".join(f"{n} {t}" for n, t in kinds.items())
    made = [(o, p, 1, n, 1.0, 9.0, 0.0, 0.0, "N", "F", None) for o in (1, 2, None) for n in (None, 1, 1, 2) for p in (8, 9)]
    spark.createDataFrame(made * 2, schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    lines = Star(spark, str(tmp_path)).keyed_lines()
    got = pairs(lines.na.fill(-1, ["order_id", "sequence"]), "order_id", "line_no", "sequence", "product_id")
    for order in (-1, 1, 2):
        mine = [g[1:] for g in got if g[0] == order]
        assert [g[0] for g in mine] == list(range(1, 17)) and [g[1:] for g in mine] == sorted(g[1:] for g in mine)
    assert shuffles(spark, lambda: lines.filter("order_id > 0").groupBy("order_id").count()) == 1


def test_price_histories_write_no_runs_and_recommendations_meet_orders_once(spark, rows, monkeypatch):
    from tallygrid.operators import recommend

    calls = []
    monkeypatch.setattr(recommend, "prefix_sums", lambda *a, **k: calls.append(a))
    partners = rows("id bigint, commercial_partner_id bigint, parent_path string", [(1, 1, "1/"), (2, 1, "1/2/")])
    orders = rows("id bigint, partner_id bigint, state string, date_order date", [(k, 1 + k % 2, "sale", date(2024, 1, 1 + k % 9)) for k in range(30)])
    lines = rows("order_id bigint, line_no bigint, product_id bigint, price_unit decimal(18,2)", [(k, n, 7, D(k)) for k in range(30) for n in (1, 2)])
    asked = rows("order_id bigint, line_no bigint, product_id bigint, partner_id bigint", [(3, 1, 7, 1), (8, 2, 7, 2)])
    got = recommend.price_histories(asked, orders, lines, partners, limit=3)
    newest = sorted(((k % 9, k, n) for k in range(30) for n in (1, 2)), reverse=True)
    for order, line in ((3, 1), (8, 2)):
        expected = [(order, line, i + 1, k, n) for i, (_, k, n) in enumerate([x for x in newest if x[1:] != (order, line)][:3])]
        assert pairs(got.filter(F.col("order_id") == order), "order_id", "line_no", "place", "past_order", "past_line") == expected
    assert not calls


def test_streamed_actions_and_alerts_come_once(spark, rows, tmp_path):
    """Five files, one a batch, then a restart with an old order and a file delivered again: no action or alert twice."""
    from tallygrid.operators.automation import ORDER_STAGES
    from tallygrid.operators.checks import exception_catalog
    from tallygrid.streaming import jobs
    from workload.checks import FLOW_SCHEMA, FLOWS

    columns = "id bigint, partner_id bigint, workflow_id bigint, state string, invoice_status string, amount_total decimal(18,2), date_order date, force_invoiced boolean"
    folder, flows = str(tmp_path / "in"), rows(FLOW_SCHEMA, FLOWS)
    partners = rows("id bigint, sale_warn string, zip string", [(1, "", "1"), (2, "careful", None)])

    def deliver(*values):
        rows(columns, list(values)).coalesce(1).write.mode("append").parquet(folder)

    def order(k, day, state="draft"):
        return (k, k % 2 + 1, 1, state, "no", D(5), day, False)

    for k in range(5):
        deliver(order(k, date(2024, 1 + k, 1)))
    stream = spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).parquet(folder)
    rules = [r for r in exception_catalog() if r.name != "no lines"]
    made = {
        "actions": lambda: jobs.stream_workflow_actions(stream, flows, ORDER_STAGES),
        "alerts": lambda: jobs.stream_exception_alerts(stream, partners, rules),
    }
    outs = {n: jobs.run_available(make(), "append", str(tmp_path / n)) for n, make in made.items()}
    assert all(len(os.listdir(out)) >= 5 for out in outs.values())
    deliver(order(2, date(2024, 3, 1)), order(1, date(2024, 2, 1)))
    deliver(order(9, date(2020, 1, 1)))
    for n, make in made.items():
        jobs.run_available(make(), "append", str(tmp_path / n))
    assert pairs(jobs.all_batches(spark, outs["actions"]), "id", "action") == [(k, "validate_order") for k in (0, 1, 2, 3, 4, 9)]
    assert pairs(jobs.all_batches(spark, outs["alerts"]), "id", "rule") == [(k, r) for k in (1, 3, 9) for r in ("no zip", "partner warning")]


def test_price_histories_equal_those_of_each_line(rows):
    """Every line of random orders against the single form, with a limit that cuts."""
    import random

    from tallygrid.operators import recommend

    rnd = random.Random(9)
    partners = rows("id bigint, parent_path string, commercial_partner_id bigint", [(1, "1/", 1), (2, "1/2/", 1), (3, "3/", 3)])
    heads = [(n, rnd.randint(1, 3), date(2024, rnd.randint(1, 6), 1), rnd.choice(["sale", "done", "draft", "cancel"])) for n in range(20)]
    orders = rows("id bigint, partner_id bigint, date_order date, state string", heads)
    sold = [(n, k, rnd.choice([1, 1, 1, 2]), D(rnd.randint(1, 99))) for n in range(20) for k in range(1, 4)]
    lines = rows("order_id bigint, line_no bigint, product_id bigint, price_unit decimal(18,2)", sold)
    asked = lines.join(orders.selectExpr("id AS order_id", "partner_id"), "order_id").drop("price_unit")
    got = recommend.price_histories(asked, orders, lines, partners, limit=4).orderBy("place").collect()
    for n, k, product, _ in sold[:15:2]:
        one = recommend.price_history(product, heads[n][1], (n, k), orders, lines, partners, limit=4).collect()
        assert [(r.past_order, r.past_line, r.price_unit) for r in got if (r.order_id, r.line_no) == (n, k)] == [(r.order_id, r.line_no, r.price_unit) for r in one]
    assert {r.place for r in got} == {1, 2, 3, 4}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def joins_by_shuffle(spark):
    """Plans as on tables too large to be sent to all tasks."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def small_star(spark, rows, folder, orders=12):
    """Orders 0 to 11 with three lines each, the first order's first line twice; a third of them has an invoice."""
    from tallygrid.sources.star import Star

    heads = [(k, k % 4, "FOP"[k % 3], D(10 * k), date(1997, 1, 1), "1-URGENT") for k in range(orders)]
    made = rows("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice decimal(18,2), o_orderdate date, o_orderpriority string", heads)
    made.write.parquet(f"{folder}/orders.parquet")
    sold = [(k, k + n, 1, n, 2.0, 10.0 * n, 0.05, 0.02, "RNA"[(k + n) % 3], "FO"[n % 2], date(1997, 2, n)) for k in range(orders) for n in (1, 2, 3)]
    columns = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date"
    rows(columns, sold + sold[:1]).write.parquet(f"{folder}/lineitem.parquet")
    return Star(spark, str(folder))


def test_long_tables_are_numbered_in_more_parts(spark, rows, tmp_path, monkeypatch):
    from tallygrid.sources import star

    s = small_star(spark, rows, tmp_path)
    plain = pairs(s.keyed_lines(), "order_id", "line_no", "product_id")
    assert s.keyed_lines().rdd.getNumPartitions() <= 4
    monkeypatch.setattr(star, "LINES_PER_TASK", 4)
    assert s.keyed_lines().rdd.getNumPartitions() == 37 // 4
    assert pairs(s.keyed_lines(), "order_id", "line_no", "product_id") == plain
    assert pairs(s.keyed_lines().filter("order_id = 0"), "line_no", "product_id") == [(1, 1), (2, 1), (3, 2), (4, 3)]


def test_invoice_lines_are_numbered_after_their_orders_are_picked(spark, rows, tmp_path):
    s = small_star(spark, rows, tmp_path)
    whole = s.invoice_lines(s.keyed_lines())
    some = s.keyed_invoice_lines()
    columns = ("order_id", "line_no", "product_id", "move_state")
    assert pairs(some, *columns) == pairs(whole, *columns) and 0 < some.count() < s.lines().count()
    text = _plan(some)
    assert "LeftSemi" in text[text.index("Window") :]


def test_stock_moves_number_the_lines_once(spark, rows, tmp_path):
    s = small_star(spark, rows, tmp_path)
    moves = s.stock_moves()
    lines = s.keyed_lines().collect()
    expected = [(r.order_id, r.line_no, False, r.qty, "customer") for r in lines if r.line_status == "F"]
    expected += [(r.order_id, r.line_no, True, r.qty // 2, "internal") for r in lines if r.return_flag == "R"]
    assert pairs(moves, "order_id", "line_no", "is_return", "quantity", "dest_usage") == sorted(expected)
    assert _plan(moves).count("Window [") == 1


def test_cumulated_quantities_leave_lines_dealt_by_order(rows, joins_by_shuffle):
    schema = "order_id bigint, template_id bigint, categ_id bigint, unit_qty decimal(18,4), display_type string"
    made = [(1, 10, 5, D(2), None), (1, 10, 6, D(3), None), (1, 20, 5, D(4), None), (1, 10, 5, D(9), "note"), (2, 10, 5, D(7), None), (None, 10, 5, D(1), None), (2, None, 5, D(1), None)]
    heads = rows("order_id bigint, pricelist_id bigint", [(1, 1), (2, 1)])
    got = promotion.cumulative_qty(rows(schema, made))
    assert pairs(got, "order_id", "template_id", "categ_id", "template_qty", "category_qty") == [
        (1, 10, 5, D(5), D(6)), (1, 10, 6, D(5), D(3)), (1, 20, 5, D(4), D(6)), (2, 10, 5, D(7), D(7))
    ]
    assert _plan(promotion.cumulative_qty(rows(schema, made).join(heads, "order_id"))).count("Exchange hashpartitioning") == 2


def test_untaxed_to_invoice_meets_invoice_lines_once(rows, joins_by_shuffle):
    """A line that is there twice shares what was invoiced as before; any other discount counts."""
    schema = "order_id bigint, line_no bigint, state string, product_policy string, qty decimal(18,4), qty_delivered decimal(18,4), force_invoiced_qty int, price_unit decimal(18,2), discount decimal(9,2)"
    lines = rows(schema, [(1, 1, "sale", "order", D(10), D(0), 0, D(5), D(0)), (1, 2, "sale", "order", D(10), D(0), 0, D(5), D(10)), (2, 1, "sale", "order", D(10), D(0), 0, D(5), D(0)), (2, 1, "sale", "order", D(10), D(0), 0, D(5), D(0)), (None, 1, "sale", "order", D(1), D(0), 0, D(5), D(0))])
    inv = rows(
        "order_id bigint, line_no bigint, inv_price decimal(18,2), inv_qty decimal(18,4), inv_discount decimal(9,2), inv_subtotal decimal(18,2), move_state string",
        [(1, 1, D(5), D(2), D(0), D(10), "posted"), (1, 1, D(5), D(1), D(0), D(5), "draft"), (1, 2, D(5), D(2), D(10), D(9), "posted"), (1, 2, D(5), D(1), D(0), D(5), "posted"), (2, 1, D(5), D(2), None, D(10), "posted"), (None, 1, D(5), D(1), D(0), D(5), "posted")],
    )
    got = invoicing.untaxed_to_invoice(lines, inv, ["order_id", "line_no"])
    assert _plan(got).count("LocalTableScan") == 2
    found = sorted(((r.order_id or 0, r.line_no, r.untaxed_to_invoice) for r in got.collect()))
    assert found == [(0, 1, D(5)), (1, 1, D(40)), (1, 2, D(30)), (2, 1, D(30)), (2, 1, D(30))]


def test_promotion_usage_folds_once(spark):
    """Reading the rules taken must not work out the fold a second time to see whether there are any."""
    import __spark_entry__ as entry

    used = entry.queries()["promotion_usage"](spark, "/root/testdata/sf0.001")
    assert _plan(used).count("aggregate(filter(") == 1


def test_customer_codes_are_dealt_before_they_are_picked(rows):
    """The pick sorts its rows, so no task may sort all the codes that it reads; nor are they sent to all tasks."""
    codes = rows("product_id bigint, partner_id bigint, sequence int, code string, min_qty decimal(18,4)", [(1, 7, 2, "b", D(2)), (1, 7, 1, "a", D(1)), (1, 5, 1, "e", D(3)), (None, 7, 1, "n", D(1))])
    asked = rows("line_no bigint, product_id bigint, partner_id bigint, commercial_partner_id bigint", [(1, 1, 7, 5), (2, 1, 6, 5), (3, 2, 7, 5), (4, None, 7, 5)])
    got = lines.customer_code(asked, codes)
    plan = _plan(got)
    assert "Broadcast" not in plan
    assert not any("Scan" in part[part.index("Aggregate(") :] for part in plan.split("Exchange hashpartitioning(") if "Aggregate(" in part)
    assert pairs(got, "line_no", "customer_code") == [(1, "a"), (2, "e"), (3, ""), (4, "")]


def test_merge_asof_merges_short_keys_without_runs(rows):
    rates = rows("id bigint, c bigint, date date, rate decimal(9,2)", [(1, 1, date(2023, 1, 1), D(25)), (2, 1, date(2023, 2, 1), None), (3, 2, date(2023, 1, 1), D(4)), (4, 2, date(2023, 1, 1), D(5)), (5, None, date(2020, 1, 1), D(9))])
    days = [date(2022, 12, 31), date(2023, 1, 1), date(2023, 1, 31), date(2023, 2, 1), None]
    facts = rows("id bigint, c bigint, day date", [(10 * c + i, c or None, d) for c in (0, 1, 2, 3) for i, d in enumerate(days)] + [(30, 3, days[1])] * 2)
    want = {11: D(25), 12: D(25), 21: D(5), 22: D(5), 23: D(5)}
    plans = {}
    for short in (6, 7):  # key 3 has seven facts
        out = merge_asof(facts, rates, ["c"], "day", ["rate"], short=short)
        assert out.columns == ["id", "c", "day", "rate"] and out.count() == 22
        assert {r.id: r.rate for r in out.collect() if r.rate is not None} == want
        plans[short] = out._jdf.queryExecution().toString()
    # one window where rows are dealt by key: no ranges, no written runs
    assert "/asof-" in plans[6] and "/asof-" not in plans[7]


def test_doubles_become_whole_numbers_and_decimals_as_round_and_cast_do(spark):
    odd = [0.0, -0.0, 0.5, 0.49999999999999994, 1.5, 2.5, 2.4999999999999996, -0.5, -1.5, -2.4, 7.000000000000001, 57.99999999999999, 1005 * 100.0, 4503599627370497.5, 9e14 + 0.5, 2e15 + 1, 123.45, 0.00005, 999999999999.0, 12345678901234.0]
    df = spark.createDataFrame([(float(x),) for x in odd] + [(None,)], "y double")
    got = df.select("y", money.whole("y").alias("a"), F.round("y").cast("bigint").alias("b"), money.whole_or("y", "decimal(24,4)").alias("c"), F.col("y").cast("decimal(24,4)").alias("d")).collect()
    assert all((r.a, r.c) == (r.b, r.d) for r in got), [r for r in got if (r.a, r.c) != (r.b, r.d)]
