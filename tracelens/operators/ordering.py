"""A stable order of many small dependency graphs at once, cycles included."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranking import cut

#: Edges of a graph that is settled as one group; larger graphs are settled by rounds over all of them.
SMALL_EDGES = 2000


def _cycle_edges(edges: DataFrame, graph: list[str]) -> DataFrame:
    """Of each graph without a ready node, the forward edges of one node of its cycles: one that loses soft edges only if there is one, else the first by rank."""
    kept = edges
    while True:  # nodes that nothing waits for are on no cycle
        fewer = cut(kept.join(kept.select(*graph, F.col("dep").alias("node")).distinct(), [*graph, "node"], "left_semi"))
        if fewer.count() == kept.count():
            break
        kept = fewer
    ahead = kept.where(F.struct("dep_rank", "dep") > F.struct(F.col("rank").alias("dep_rank"), F.col("node").alias("dep")))
    nodes = ahead.groupBy(*graph, "node", "rank").agg(F.bool_and("soft").alias("soft"))
    first = nodes.groupBy(*graph).agg(F.min_by("node", F.struct((~F.col("soft")).alias("hard"), "rank", "node")).alias("node"))
    return ahead.join(first, [*graph, "node"], "left_semi").select(*graph, "node", "dep", "soft")


def _settle(rank: dict, waits: dict) -> tuple[dict, list]:
    """Paths of one small graph's nodes, and its cut edges; waits: {node: {dep: soft}}."""
    path, cuts, open_ = {}, [], set(rank)
    while open_:
        ready = [n for n in open_ if waits[n].keys().isdisjoint(open_)]
        for n in ready:
            floor = max((path[d] for d in waits[n]), default=())
            path[n] = (*floor, rank[n]) if floor > (rank[n],) else (rank[n],)
        open_.difference_update(ready)
        if not ready:
            ring = {n: waits[n].keys() & open_ for n in open_}
            while idle := ring.keys() - set().union(*ring.values()):
                for n in idle:
                    del ring[n]
            ahead = {n: found for n, deps in ring.items() if (found := [d for d in deps if (rank[d], d) > (rank[n], n)])}
            first = min(ahead, key=lambda n: (not all(waits[n][d] for d in ahead[n]), rank[n], n))
            cuts += [(first, d, waits[first].pop(d)) for d in ahead[first]]
    return path, cuts


def _small_graphs(ranks: DataFrame, edges: DataFrame, graph: list[str]) -> DataFrame:
    """(graph, node, place, dep, soft): a row with ``place`` for each node and one with ``dep`` for each edge that was cut."""
    none = lambda kind: F.lit(None).cast(kind)
    kinds = dict(ranks.dtypes)
    rows = ranks.select(*graph, "node", "rank", none(kinds["node"]).alias("dep"), none("boolean").alias("soft")).unionByName(edges.select(*graph, "node", none("long").alias("rank"), "dep", "soft"))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*graph, "node"]) + f", place long, dep {kinds['node']}, soft boolean"

    names, width = [*graph, "node", "place", "dep", "soft"], len(graph)

    def settled(key: tuple, rows: list) -> Iterator[tuple]:
        rank = {n: r for n, r, d, _ in rows if d is None}
        waits = {n: {} for n in rank}
        for n, _, d, soft in rows:
            if d is not None:
                waits[n][d] = soft
        path, cuts = _settle(rank, waits)
        for i, n in enumerate(sorted(path, key=lambda n: (path[n], n))):
            yield (*key, n, i, None, None)
        for n, d, soft in cuts:
            yield (*key, n, None, d, soft)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *keys, lists = batch.columns
            node = lists.type.value_type.field("node").type
            kind = [*[k.type for k in keys], node, pa.int64(), node, pa.bool_()]
            flat, sizes = lists.flatten(), lists.value_lengths().to_pylist()
            cells, out = zip(*[flat.field(c).to_pylist() for c in ("node", "rank", "dep", "soft")], strict=True), []
            for key, n in zip(zip(*[k.to_pylist() for k in keys], strict=True), sizes, strict=True):
                out.extend(settled(key, list(islice(cells, n))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kind, strict=True)], names=names)

    lists = rows.groupBy(*graph).agg(F.collect_list(F.struct("node", "rank", "dep", "soft")).alias("rows"))
    return lists.mapInArrow(run, schema)


def stable_order(nodes: DataFrame, edges: DataFrame, graph: list[str], small: int = SMALL_EDGES) -> tuple[DataFrame, DataFrame]:
    """(graph, node, place) of nodes (graph, node, rank), each after all that it depends on, and the edges that were cut.

    edges: (graph, node, dep, soft): ``node`` waits for ``dep``.  A node whose dependencies all rank before it keeps its
    rank; another goes right behind the last of them.  So the key of a node is the list of the ranks that it follows, and
    lists order the graph.  Where no node is ready any more there is a cycle, and one node on it loses its forward
    edges: rather one whose edges are all soft.  Loops and edges to unknown nodes count for nothing; nodes are no nulls.

    Graphs of at most ``small`` edges, such as those of flows, are settled one by one in groups; larger ones by rounds,
    each of which settles all ready nodes of all of them.  Both give the same order.
    """
    key = [*graph, "node"]
    ranks = nodes.groupBy(*key).agg(F.min("rank").cast("long").alias("rank"))
    e = edges.where("node != dep").groupBy(*key, "dep").agg(F.bool_and("soft").alias("soft"))
    e = cut(e.join(ranks, key).join(ranks.select(*graph, F.col("node").alias("dep"), F.col("rank").alias("dep_rank")), [*graph, "dep"]))
    large = cut(e.groupBy(*graph).agg(F.count("*").alias("n")).where(F.col("n") > small).select(*graph))
    one = cut(_small_graphs(ranks.join(large, graph, "left_anti"), e.join(large, graph, "left_anti"), graph))
    placed, gone = one.where("dep is null").select(*key, "place"), one.where("dep is not null").select(*key, "dep", "soft")
    if large.isEmpty():
        return placed, gone
    more, lost = _by_rounds(ranks.join(large, graph, "left_semi"), cut(e.join(large, graph, "left_semi")), graph)
    return placed.unionByName(more), gone.unionByName(lost)


def _by_rounds(ranks: DataFrame, e: DataFrame, graph: list[str]) -> tuple[DataFrame, DataFrame]:
    key = [*graph, "node"]
    todo = cut(ranks.withColumn("floor", F.lit(None).cast("array<long>")))
    done, cuts = None, e.select(*key, "dep", "soft").where("false")
    own = F.array("rank")
    while True:
        ready = todo.join(e.select(*key).distinct(), key, "left_anti")
        new = cut(ready.select(*key, "rank", F.when(F.col("floor") > own, F.concat("floor", own)).otherwise(own).alias("path")))
        if new.isEmpty():
            if todo.isEmpty():
                break
            gone = cut(_cycle_edges(e, graph))
            cuts = cuts.unionByName(gone)
            e = cut(e.join(gone, [*key, "dep"], "left_anti"))
            continue
        done = new if done is None else done.unionByName(new)
        settled = new.select(*graph, F.col("node").alias("dep"), "path")
        raised = e.join(settled, [*graph, "dep"]).groupBy(*key).agg(F.max("path").alias("up"))
        todo = cut(todo.join(new, key, "left_anti").join(raised, key, "left").select(*key, "rank", F.greatest("floor", "up").alias("floor")))
        e = cut(e.join(settled, [*graph, "dep"], "left_anti"))
    place = F.row_number().over(W.partitionBy(*graph).orderBy("path", "node")) - 1
    return done.select(*key, place.cast("long").alias("place")), cuts
