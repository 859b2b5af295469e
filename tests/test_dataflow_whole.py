"""Closed sets over more edges than one mask holds, and chains longer than the old bounds."""

import itertools
import random

import pytest

from tracelens.operators import dataflow


def closed_by_force(episodes, least):
    found = {e for e in set().union(*episodes) if sum(e in x for x in episodes) >= least}
    rows = [x & found for x in episodes if x & found]
    sets, todo = set(rows), set(rows)
    while todo:
        todo = {a & b for a, b in itertools.product(todo, rows)} - sets - {frozenset()}
        sets |= todo
    return {s: n for s in sets if (n := sum(s <= r for r in rows)) >= least}


@pytest.mark.parametrize("shared", [0, 1])
def test_closed_sets_of_all_edges(spark, shared):
    rng = random.Random(5)
    names = [(f"a{i}", "t", f"b{i}") for i in range(150)]
    episodes = [frozenset([*names[:shared], *rng.sample(names[2:], 9), *names[k % 140 : k % 140 + 5]]) for k in range(280)]
    edges = spark.createDataFrame([(k, *e) for k, x in enumerate(episodes) for e in x], "ep long, source string, value_type string, target string")
    found = dataflow.numbered(dataflow.frequent_edges(edges, ["ep"], 3))
    assert found.count() > 2 * dataflow.WORD_BITS
    got = dataflow.closed_edge_lists(edges, found, ["ep"], 3).collect()
    want = closed_by_force([frozenset(f"{a} --{t}--> {b}" for a, t, b in x) for x in episodes], 3)
    assert len(got) == len(want) and {frozenset(r["edges"]): r["support"] for r in got} == want
    with pytest.raises(ValueError, match="62 edges"):
        dataflow.closed_sets(edges, found, ["ep"], 3)


def test_long_chains(spark):
    n = 103
    chain = spark.createDataFrame([(1, i, i + 1) for i in range(n)], "ep long, call long, source long")
    seeds = chain.where("call = 40").select("ep", "call")
    assert {r["call"] for r in dataflow.participating_calls(seeds, chain, ["ep"]).collect()} == set(range(40, n + 1))
    got = dataflow.layers(chain, "call", "source").collect()
    assert {r["node"]: r["layer"] for r in got} == {i: i for i in range(n + 1)}


@pytest.mark.parametrize("edges", [[(1, 2), (2, 1)], [(0, 1), (1, 2), (2, 1)]])
def test_layers_of_a_cycle(spark, edges):
    with pytest.raises(ValueError, match="cycle"):
        dataflow.layers(spark.createDataFrame(edges, "source long, target long"))


def test_layers_read_the_edges_once(spark):
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    edges = spark.createDataFrame([(i, i + 1) for i in range(4)], "source long, target long").withColumn("source", counted("source"))
    assert sorted((r["node"], r["layer"]) for r in dataflow.layers(edges).collect()) == [(i, i) for i in range(5)]
    assert seen.value == 4
