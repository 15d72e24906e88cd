"""Connected components against union-find, and what a round asks of the driver."""

import random
import re

import pytest

from carrylens.llm import common, op3_minhash


def plain(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if None not in (a, b) and a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {x: find(x) for x in up}


def graphs():
    pick = random.Random(7)
    mixed = pick.sample(range(200), 200)
    return {
        "random": [(pick.randrange(1500), pick.randrange(1500)) for _ in range(800)],
        "path": list(zip(mixed, mixed[1:])),
        "two hubs of the same nodes": [(hub, i) for hub in (0, 1) for i in range(2, 400)],
        "hubs with the largest ids": [(5000 + i % 3, i) for i in range(400)] + [(9000, i) for i in range(0, 400, 7)],
        "odd": [(None, 1), (1, None), (1, 1), (2, 1), (2, 1), (1, 2), (-5, 2), (7, 7)],
        "empty": [],
    }


@pytest.mark.parametrize("name", graphs())
def test_components_are_those_of_union_find(spark, name):
    edges = graphs()[name]
    got = common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert sorted((r.id, r.component_id) for r in got) == sorted(plain(edges).items())


def test_a_round_shuffles_three_times(spark):
    """What the driver keeps of a round goes with its tasks: an exchange's partitions each."""
    now = spark.createDataFrame([(3, 1), (3, 2)], "u bigint, v bigint")
    plan = common._stars(now)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= 3
    # repeats stay one row each, whatever the round
    many = spark.createDataFrame([(i, hub) for hub in (0, 1) for i in range(2, 300)] * 3, "u bigint, v bigint")
    first = common._stars(many)
    second = common._stars(first)
    assert many.count() >= first.count() >= second.count()
    assert {tuple(r) for r in second.collect()} == {(i, 0) for i in range(1, 300)}


def test_found_components_stand_for_their_links(spark, monkeypatch):
    """The second search starts from stars: a chain of near copies isn't followed again."""
    words = [f"w{i}" for i in range(400)]
    rows = [(k * 7 % 41, " ".join(words[4 * k : 4 * k + 120])) for k in range(41)] + [(90, " ".join(words[:120]))]
    given = []

    def seen(edges):
        given.append({tuple(sorted(r)) for r in edges.collect()})
        return common.components(edges)

    monkeypatch.setattr(op3_minhash, "components", seen)
    got = op3_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    stars = {(root, x) for x, root in plain(given[0]).items() if x != root}
    assert len(given) == 2 and stars <= given[1]
    assert {(r.doc_id, r.component_id) for r in got} == {(i, 0) for i, _ in rows}
