"""Every query against its SQL."""

from __future__ import annotations

import pytest
from comparing import differences, duck_rows, rows_of

from ledgerloom.oracles import ORACLES
from ledgerloom.queries import QUERIES
from ledgerloom.sources.demo import order_ledger


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    ours = rows_of(QUERIES[name](spark, sf_dir))
    assert ours[1], "no rows"
    assert not differences(ours, duck_rows(duck, ORACLES[name]))


def test_whole_tables(spark, sf_dir, duck):
    """Reports, checks and questions have every account, month and untaught row."""
    month, account = duck.execute("SELECT count(DISTINCT strftime(o_orderdate, '%Y-%m')), count(DISTINCT o_custkey) FROM orders").fetchone()
    run = lambda name: QUERIES[name](spark, sf_dir)
    assert run("monthly_total_rollup").where("account is not null").select("month").where("month is not null").distinct().count() == month
    moved = order_ledger(spark, sf_dir).where("type in ('income', 'expense')")
    assert run("month_vat_sheet").count() == moved.count()
    for name in ("assess_rows", "assess_statements"):
        assert run(name).select("account").distinct().count() == account
    assert {r.id % 5 for r in run("learned_category").collect()} == {1, 2, 3, 4}
