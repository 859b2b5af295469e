"""Connected closed graphs against brute force, and numbers in one order."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tracelens.operators import dataflow
from tracelens.operators.ranking import number_rows


def parts(edges):
    return dataflow.components_of(sorted(edges))


def by_force(episodes, least):
    """Every set of frequent edges of some episodes, split, closed again, and ranked."""
    has = {e: {i for i, x in enumerate(episodes) if e in x} for e in set().union(*episodes) if e[0] != "constant"}
    has = {e: s for e, s in has.items() if len(s) >= least}
    rows = [frozenset(e for e in x if e in has) for x in episodes]
    sets, todo = set(rows), set(rows)
    while todo:
        todo = {a & b for a, b in itertools.product(todo, rows)} - sets
        sets |= todo
    out = {}
    for s in sets:
        for part in parts(s) if s else []:
            inside = set.intersection(*(has[e] for e in part))
            if len(inside) < least:
                continue
            closure = {e for e in has if inside <= has[e]}
            whole = next(p for p in parts(closure) if part <= p)
            out[whole] = max(out.get(whole, 0), len(inside))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_graphs(spark, seed):
    rng = random.Random(seed)
    sources, tools = ["prompt", "catalog", "constant", "a", "b", "c"], ["a", "b", "c", "d"]
    episodes = [frozenset((rng.choice(sources), rng.choice("xy"), rng.choice(tools)) for _ in range(rng.randint(1, 7))) for _ in range(14)]
    rows = [(i, *e, 10 * k + 1, 10 * k if e[0] in tools else None) for i, x in enumerate(episodes) for k, e in enumerate(sorted(x))]
    got = dataflow.graph_candidates(spark.createDataFrame(rows, "ep long, source string, value_type string, target string, call long, src long"), ["ep"], 2).collect()
    want = by_force(episodes, 2)
    assert {frozenset(r["edges"]): r["support"] for r in got} == {frozenset(f"{a} --{t}--> {b}" for a, t, b in s): n for s, n in want.items()}
    assert [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] == list(range(1, len(got) + 1))
    order = [(not r["rooted"], -r["n"] * r["support"], -r["support"], -r["saving"], r["edges"]) for r in sorted(got, key=lambda r: r["rank"])]
    assert order == sorted(order) and all(r["rooted"] == any(e.startswith("prompt --") for e in r["edges"]) and not r["truncated"] for r in got)


def test_truncated_is_told(spark):
    rows = [(i, "a", f"t{k}", "b", 1, 0) for i in range(3) for k in range(5)]
    got = dataflow.graph_candidates(spark.createDataFrame(rows, "ep long, source string, value_type string, target string, call long, src long"), ["ep"], 2, most=3).collect()
    assert [(r["n"], r["support"], r["truncated"]) for r in got] == [(3, 3, True)]


@pytest.mark.parametrize("most", [1, 5, 17, 500])
def test_best_closed_sets(spark, most):
    """The best sets are those of the whole list, for any bound, also with more edges than a word holds."""
    rng = random.Random(most)
    names = [(f"n{k:02}", "x", f"m{k:02}") for k in range(70)]
    episodes = [frozenset(rng.sample(names[:9], rng.randint(2, 6)) + rng.sample(names[9:], 3)) | {names[69]} for _ in range(26)]
    rows = [(i, *e) for i, x in enumerate(episodes) for e in sorted(x)]
    df = spark.createDataFrame(rows, "ep long, source string, value_type string, target string")
    found = dataflow.numbered(dataflow.frequent_edges(df, ["ep"], 2)).cache()
    number = {(r["source"], r["value_type"], r["target"]): r["bit"] for r in found.collect()}
    masks = [frozenset(number[e] for e in x if e in number) for x in episodes]
    sets, todo = set(masks), set(masks)
    while todo:
        todo = {a & b for a, b in itertools.product(todo, masks)} - sets
        sets |= todo
    support = {s: n for s in sets if s and (n := sum(s <= m for m in masks)) >= 2}
    word = lambda s, k: sum(1 << b % 62 for b in s if b // 62 == k)
    want = sorted(support, key=lambda s: (-support[s], len(s), word(s, 0), word(s, 1)))[:most]
    text = {b: f"{a} --{t}--> {c}" for (a, t, c), b in number.items()}
    got, left_out = dataflow.top_closed_edge_lists(df, found, ["ep"], most, 2)
    assert {tuple(r["edges"]): r["support"] for r in got.collect()} == {tuple(text[b] for b in sorted(s)): support[s] for s in want}
    assert left_out == (len(support) > most)


def test_numbers(spark):
    rows = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5003).alias("x"))
    got = [r["n"] for r in number_rows(rows, ["x"], "n").orderBy("x").collect()]
    assert got == list(range(1, 5001))
    assert number_rows(rows.where("x < 0"), ["x"], "n").collect() == []
