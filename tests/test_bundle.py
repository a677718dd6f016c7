"""The dashboard in one go: how often it reads the facts, and odd inputs."""

from datetime import date
from decimal import Decimal as D

from tallygrid.functions.dates import Window
from tallygrid.operators import dashboard as d
from tallygrid.plans.payload import dashboard_bundle
from tallygrid.sources.star import Star

FLT = d.SalesFilter(Window(date(2024, 3, 1), date(2024, 3, 3)), (1,))
ORDER = "id bigint, name string, date_order timestamp, state string, team_id bigint, user_id bigint, partner_id bigint, company_id bigint, create_uid bigint, amount_total decimal(18,2), amount_untaxed decimal(18,2)"
LINE = "order_id bigint, product_id bigint, display_type string, qty decimal(18,4), price_total decimal(18,2), price_subtotal decimal(18,2), purchase_price decimal(18,2)"
TARGET = "company_id bigint, scope string, owner_id bigint, month_start date, target_amount decimal(18,2), active boolean"


def bundle(rows, orders, lines):
    named = lambda n: rows("id bigint, name string", n)
    products = rows("id bigint, name string, categ_id bigint", [(1, "P1", 7), (2, "P2", None)])
    teams = rows("id bigint, names string", [(1, '{"en_US": "North"}')])
    targets = rows(TARGET, [(1, "team", 1, date(2024, 3, 1), D(400), True)])
    found = dashboard_bundle(rows(ORDER, orders), rows(LINE, lines), targets, named([(5, "Ann")]), products, teams, named([(3, "Bo")]), FLT)
    out = {}
    for r in found.collect():
        out.setdefault(r.section, {})[r.key] = (r.label, r.value, r.second, r.third)
    return out


def test_sections_of_two_windows(spark, rows):
    from datetime import datetime as t

    orders = [
        (1, "S1", t(2024, 3, 1, 23, 59, 59), "sale", 1, 3, 5, 1, 1, D(100), D(90)),
        (2, "S2", t(2024, 3, 3, 8), "done", None, None, None, 1, 1, D(50), D(45)),
        (3, "S3", t(2024, 3, 2), "draft", 1, 3, 5, 1, 1, D(30), D(27)),
        (4, "S4", t(2024, 2, 28), "sale", 1, 3, 5, 1, 1, D(60), D(54)),  # the window before
        (5, "S5", t(2024, 3, 2), "sale", 1, 3, 5, 2, 1, D(999), D(999)),  # another company
        (6, "S6", t(2024, 2, 26), "sale", 1, 3, 5, 1, 1, D(999), D(999)),  # before both windows
    ]
    lines = [(1, 1, None, D(2), D(100), D(90), D(30)), (2, 2, None, D(1), D(50), D(45), None), (1, 1, "line_note", D(9), D(9), D(9), D(9)), (4, 1, None, D(1), D(60), D(54), D(4))]
    got = bundle(rows, orders, lines)
    assert got["daily_revenue"] == {"2024-03-01": ("01 Mar", 100, None, None), "2024-03-02": ("02 Mar", 0, None, None), "2024-03-03": ("03 Mar", 50, None, None)}
    assert got["team_performance"] == {"1": ("North", 100, 1, None), "0": ("No Team", 50, 1, None)}
    assert got["top_customers"] == {"5": ("Ann", 100, 1, None), "0": ("No Customer", 50, 1, None)}
    assert got["top_products"] == {"1": ("P1", 100, 2, None), "2": ("P2", 50, 1, None)}
    assert got["profitability"]["all"][1:] == (135, 75, 55.5556)
    assert got["pivot_summary"]["1"][1:] == (100, 100, 50)
    assert got["target_progress"]["team_1"][1:] == (100, 400, 25)
    assert got["comparison"]["confirmed_revenue"][1:] == (150, 60, 150)
    assert [*got["recent_orders"]] == ["2", "3", "1"] and "S5" not in str(got)


def test_no_rows_at_all(spark, rows):
    got = bundle(rows, [], [])
    assert len(got["daily_orders"]) == 3 and got["kpis"]["confirmed_revenue"][1] == 0 and "top_products" not in got


def test_facts_are_read_once(spark):
    s = Star(spark, "/root/testdata/sf0.001")
    flt = d.SalesFilter(Window(date(1997, 1, 1), date(1997, 12, 31)), (0, 1, 2, 3))
    targets = spark.createDataFrame([], TARGET)
    found = dashboard_bundle(s.orders(), s.lines(), targets, s.partners(), s.products(), s.teams(), s.users(), flt)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # the sections read the written groups only
    assert "lineitem.parquet" not in plan and "orders.parquet" not in plan
