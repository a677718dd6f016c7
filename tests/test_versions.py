"""Rewrites of a whole table, and rates applied one after another."""

import os
from datetime import date
from decimal import Decimal as D

import pytest

from conftest import pairs
from tallygrid.operators import pricing
from tallygrid.sources.versions import current_version, publish_version


def test_a_rewrite_shows_when_it_is_finished(spark, tmp_path):
    root = str(tmp_path / "t")
    with pytest.raises(ValueError):
        current_version(spark, root)
    first = publish_version(spark.range(3), root)
    second = publish_version(first.selectExpr("id + 10 AS id"), root)
    assert pairs(second, "id") == [(10,), (11,), (12,)] and pairs(first, "id") == [(0,), (1,), (2,)]
    os.remove(f"{root}/v00000002/_SUCCESS")  # as a write that was lost would leave it
    assert pairs(current_version(spark, root), "id") == [(0,), (1,), (2,)]
    assert pairs(publish_version(current_version(spark, root).selectExpr("id + 20 AS id"), root), "id") == [(20,), (21,), (22,)]


def test_a_rate_sets_the_cost_of_area_priced_products_only(spark, rows):
    product = "id bigint, parent_path string, width decimal(9,2), height decimal(9,2), list_price decimal(18,2), standard_price decimal(18,2), use_area_pricing boolean"
    products = rows(product, [
        (1, "1/2/", D(2), D(3), D(50), D(5), True), (2, "1/2/", D(2), D(3), D(50), D(5), False),
        (3, "1/2/", D(0), D(3), D(50), D(5), True), (4, "1/9/", D(1), D(1), D(50), None, True), (5, "1/9/", D(1), D(1), D(50), D(5), None),
    ])
    rates = rows("rate_id bigint, categ_id bigint, rate decimal(9,2), date date", [(7, 2, D(4), date(2024, 2, 1)), (8, None, D(3), date(2024, 1, 1)), (9, 4, D(9), date(2024, 1, 1))])
    done = pricing.rate_apply(products, rates)
    assert pairs(done, "rate_id", "product_id", "price_before", "cost_after") == [(7, 1, 50, 24), (8, 1, 50, 18), (8, 4, 50, 3)]
    assert {(r.rate_id, r.product_id, r.position): r.cost_before for r in done.collect()} == {(8, 1, 1): 5, (7, 1, 2): 18, (8, 4, 1): None}
    after = {r.id: (r.list_price, r.standard_price) for r in pricing.products_after(products, done).collect()}
    assert after == {1: (50, 24), 2: (50, 5), 3: (50, 5), 4: (50, 3), 5: (50, 5)}
