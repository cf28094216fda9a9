import random

import pytest

from siltmark.llm import components
from siltmark.llm.components import random_mate_components


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    sets = {}
    for x in parent:
        sets.setdefault(find(x), set()).add(x)
    return {frozenset(s) for s in sets.values() if len(s) > 1}


@pytest.mark.parametrize("edges", [
    [(random.Random(1).randrange(9), 0) for _ in range(5)],
    [(0, i) for i in range(1, 400)],
    [(i, i + 1) for i in range(60)],
    [(a, b) for r in (random.Random(7),) for a, b in ((r.randrange(200), r.randrange(200)) for _ in range(170))],
    [(3, 3), (1, 2), (2, 1), (1, 2)],
], ids=["small", "star", "chain", "random", "loops"])
def test_against_union_find(spark, edges):
    found = random_mate_components(spark.createDataFrame(edges, "u long, v long")).collect()
    sets = {}
    for row in found:
        sets.setdefault(row.root, set()).add(row.node)
    assert len(found) == len({r.node for r in found})
    assert {frozenset(s) for s in sets.values() if len(s) > 1} == union_find([e for e in edges if e[0] != e[1]])


def test_empty(spark):
    assert random_mate_components(spark.createDataFrame([], "u string, v string")).count() == 0
    assert random_mate_components(spark.createDataFrame([(None, "a"), ("b", None)], "u string, v string")).count() == 0


def test_hot_keys_join_without_a_shuffle_of_their_rows(spark):
    rows = spark.range(3000).selectExpr("id", "if(id < 1500, 'hot', concat('k', id)) AS k")
    table = rows.select("k").distinct().selectExpr("k", "length(k) AS n").where("k <> 'k2000'")
    for how in ("inner", "left"):
        got = sorted(tuple(r) for r in components.join_hot(rows, table, "k", how).select("id", "n").collect())
        assert got == sorted(tuple(r) for r in rows.join(table, "k", how).select("id", "n").collect())
    empty = rows.where("false")
    assert components.join_hot(empty, table, "k").count() == 0
