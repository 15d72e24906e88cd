"""Joins whose tasks don't grow with a hot key or with copies."""

import pytest

from carrylens.operators import ledger, positions


@pytest.mark.parametrize("members", [["a", "b"], ["a", "b", "hub"], [None, "a"], []])
def test_transfers_of_hubs_that_are_no_members_dont_move(spark, members):
    ends = ["a", "b", "c", "hub", "zero", None]
    t = spark.createDataFrame([("t", x, y, k) for x in ends for y in ends for k in range(2)], "contract_address string, `from` string, `to` string, value int")
    m = spark.createDataFrame([(x,) for x in members * 2], "address string")
    got = ledger.intra_set_transfers(t, m, hubs=("hub", "zero"))
    assert sorted((r["from"], r["to"], r.value) for r in got.collect()) == sorted((x, y, k) for x in set(members) - {None} for y in set(members) - {None} for k in range(2))


def test_traces_are_distinct_before_they_are_joined(spark):
    p = spark.createDataFrame([("a",), ("b",), (None,)], "user_addr string")
    x = positions.contract_flag(p, spark.createDataFrame([("a",), ("a",), ("z",), (None,)], "address string"))
    assert sorted(map(tuple, x.collect()), key=str) == [("a", "contract"), ("b", "EOA"), (None, "EOA")]
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftSemi") < plan.index("Aggregate [address")
