"""Dataflow graphs of episodes: edges, their support, closed connected edge sets, and the calls that carry them."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import cut, number_rows

# Origins that connect nothing, and the sizes at which mining stops growing.
PSEUDO_SOURCES = ("prompt", "workspace", "catalog", "constant")
MAX_FREQUENT_EDGES = 400
MAX_CONCEPTS = 20_000
MAX_CANDIDATE_EDGES = 60
WORD_BITS = 62


def frequent_edges(edges: DataFrame, episode: list[str], min_support: int = 2) -> DataFrame:
    """(source, value_type, target, support): the edges of enough episodes; constants never count."""
    own = edges.where(F.col("source") != "constant").select(*episode, "source", "value_type", "target").distinct()
    return own.groupBy("source", "value_type", "target").agg(F.count("*").alias("support")).where(F.col("support") >= min_support)


def top_edges(found: DataFrame, most: int = MAX_FREQUENT_EDGES) -> tuple[DataFrame, bool]:
    """The most frequent edges, which get the bits of the closed-set search, and whether any was left out."""
    top = found.orderBy(F.desc("support"), "source", "value_type", "target").limit(most)
    return top, found.limit(most + 1).count() > most


def numbered(found: DataFrame) -> DataFrame:
    """All of ``found``, most frequent first, with their numbers from 0 in ``bit``."""
    return number_rows(found, [F.desc("support"), "source", "value_type", "target"], "bit").withColumn("bit", (F.col("bit") - 1).cast("int"))


def _closed(edges: DataFrame, found: DataFrame, episode: list[str], min_support: int, most: int | None = None) -> tuple[DataFrame, int, bool]:
    """(w0, w1, .., support) of every closed set of numbered edges, the number of words, and whether any set was left out; a word holds ``WORD_BITS`` edges.

    Each episode becomes one mask, and equal masks are counted first.  A set is closed if it is the intersection of all masks
    that hold it.  It grows by one edge of a higher number than its last and is closed by a bitwise and over its masks;
    what gets an edge of a lower number by that is found from another set, so each closed set is found once.
    Sets meet their masks by an equi-join on the last edge that was added, and only those with enough support go on.

    With ``most``, only the best so many go on and stay: by support, then the smaller, then by edges.  A set's supersets
    are all worse than itself, so what falls below the worst of the best, a bound that rises from level to level, can lead
    to no better one: these are the best of all closed sets, and no level holds more than ``most``.
    """
    number = found.agg(F.max("bit")).first()[0]
    words = range((number or 0) // WORD_BITS + 1)
    one = lambda bit, k: F.when(F.floor(bit / WORD_BITS) == k, F.call_function("shiftleft", F.lit(1).cast("long"), bit % WORD_BITS)).otherwise(F.lit(0).cast("long"))
    below = lambda bit, k: F.when(F.floor(bit / WORD_BITS) > k, F.lit((1 << WORD_BITS) - 1)).otherwise(F.greatest(one(bit, k) - 1, F.lit(0)))
    every = lambda conditions: reduce(Column.__and__, conditions)
    closure = [*[F.bit_and(f"m{k}").alias(f"w{k}") for k in words], F.sum("n").alias("support")]
    bit = F.col("bit")

    def kept(grown: DataFrame) -> DataFrame:
        right = every([F.col(f"w{k}").bitwiseAND(below(bit, k)) == F.col(f"p{k}").bitwiseAND(below(bit, k)) for k in words])
        return cut(grown.where((F.col("support") >= min_support) & right).select(*[f"w{k}" for k in words], "support", "bit"))

    size = reduce(Column.__add__, [F.bit_count(f"w{k}") for k in words])
    rank = F.struct((-F.col("support")).alias("s"), size.alias("n"), *[F.col(f"w{k}") for k in words])
    left_out = False

    def best(levels: list[DataFrame], fresh: DataFrame) -> tuple[list[DataFrame], DataFrame]:
        """The levels and the fresh sets without what is worse than the ``most``-th of them."""
        nonlocal left_out
        known = reduce(DataFrame.unionByName, [*levels, fresh.drop("bit")])
        worst = known.select(rank.alias("r")).orderBy("r").offset(most - 1).limit(2).collect() if most else []
        if len(worst) < 2:
            return levels, fresh
        left_out = True
        r = worst[0]["r"]
        bound = F.struct(*[F.lit(v).cast(t.dataType).alias(t.name) for v, t in zip(r, known.select(rank.alias("r")).schema["r"].dataType, strict=True)])
        return [cut(reduce(DataFrame.unionByName, levels).where(rank <= bound))], cut(fresh.where(rank <= bound))

    own = edges.select(*episode, "source", "value_type", "target").distinct().join(found.select("source", "value_type", "target", "bit"), ["source", "value_type", "target"])
    masks = own.groupBy(*episode).agg(*[F.bit_or(one(bit, k)).alias(f"m{k}") for k in words], F.array_sort(F.collect_list("bit")).alias("bits"))
    masks = cut(masks.groupBy(*[f"m{k}" for k in words]).agg(F.first("bits").alias("bits"), F.count("*").alias("n")))
    root = masks.agg(*closure).where(F.col("support") >= min_support)
    common = F.broadcast(root.select(*[F.col(f"w{k}").alias(f"p{k}") for k in words]))
    by_bit = masks.withColumn("low", F.explode("bits"))
    first = by_bit.groupBy(F.col("low").alias("bit")).agg(*closure).crossJoin(common)
    fresh = kept(first.where(every([F.col(f"p{k}").bitwiseAND(one(bit, k)) == 0 for k in words])))
    levels = [root.where(~every([F.col(f"w{k}") == 0 for k in words]))]
    levels, fresh = best(levels, fresh)
    while not fresh.isEmpty():
        levels.append(fresh.drop("bit"))
        sets = fresh.select(*[F.col(f"w{k}").alias(f"p{k}") for k in words], F.col("bit").alias("low"))
        held = sets.join(by_bit, "low").where(every([F.col(f"p{k}").bitwiseAND(F.col(f"m{k}")) == F.col(f"p{k}") for k in words]))
        more = held.withColumn("bit", F.explode(F.filter("bits", lambda b: b > F.col("low")))).where(every([F.col(f"p{k}").bitwiseAND(one(bit, k)) == 0 for k in words]))
        levels, fresh = best(levels, kept(more.groupBy(*[f"p{k}" for k in words], "bit").agg(*closure)))
    return reduce(DataFrame.unionByName, levels), len(words), left_out


def closed_sets(edges: DataFrame, found: DataFrame, episode: list[str], min_support: int = 2) -> DataFrame:
    """(mask, support): every closed set of up to 62 edges, numbered in a column ``bit`` of ``found``, as a bit mask."""
    out, words, _ = _closed(edges, found, episode, min_support)
    if words > 1:
        raise ValueError(f"a mask holds {WORD_BITS} edges: use closed_edge_lists")
    return out.select(F.col("w0").alias("mask"), "support")


def closed_edge_bits(edges: DataFrame, found: DataFrame, episode: list[str], min_support: int = 2, most: int | None = None) -> tuple[DataFrame, bool]:
    """(bits, support) of every closed set of any number of numbered edges, as a sorted list of their numbers, or of the ``most`` best; and whether any was left out."""
    out, words, left_out = _closed(edges, found, episode, min_support, most)

    def bits(k: int) -> Column:
        held = F.filter(F.sequence(F.lit(0), F.lit(WORD_BITS - 1)), lambda i: F.col(f"w{k}").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0)
        return F.transform(held, lambda i: i + k * WORD_BITS)

    return out.select(F.concat(*[bits(k) for k in range(words)]).alias("bits"), "support"), left_out


def _texts(sets: DataFrame, found: DataFrame) -> DataFrame:
    """(edges, support) of sets (bits, support): the texts of their edges in the order of ``bit``, joined by number."""
    text = edge_text(F.col("source"), F.col("value_type"), F.col("target"))
    rows = sets.select("bits", "support", F.explode("bits").alias("bit")).join(found.select("bit", text.alias("text")), "bit")
    lists = rows.groupBy("bits").agg(F.first("support").alias("support"), F.array_sort(F.collect_list(F.struct("bit", "text"))).alias("x"))
    return lists.select(F.transform("x", lambda x: x["text"]).alias("edges"), "support")


def closed_edge_lists(edges: DataFrame, found: DataFrame, episode: list[str], min_support: int = 2) -> DataFrame:
    """(edges, support): every closed set of any number of numbered edges, as a list of their texts in the order of ``bit``."""
    return _texts(closed_edge_bits(edges, found, episode, min_support)[0], found)


def top_closed_edge_lists(edges: DataFrame, found: DataFrame, episode: list[str], most: int, min_support: int = 2) -> tuple[DataFrame, bool]:
    """(edges, support) of the ``most`` best closed sets, by support, then fewer edges, then the numbers of these; and whether any was left out."""
    sets, left_out = closed_edge_bits(edges, found, episode, min_support, most)
    return _texts(sets, found), left_out


def components_of(edges: list[tuple[str, str, str]]) -> list[frozenset]:
    """One candidate's edges (some tens) split where only pseudo sources hold them together."""
    label = {e: i for i, e in enumerate(edges)}
    changed = True
    while changed:
        changed = False
        low: dict[str, int] = {}
        for e, i in label.items():
            for node in {e[0], e[2]} - set(PSEUDO_SOURCES):
                low[node] = min(low.get(node, i), i)
        for e, i in label.items():
            m = min([low[n] for n in {e[0], e[2]} - set(PSEUDO_SOURCES)], default=i)
            if m < i:
                label[e], changed = m, True
    return [frozenset(e for e, i in label.items() if i == k) for k in sorted(set(label.values()))]


def graph_candidates(edges: DataFrame, episode: list[str], min_support: int = 2, most: int = MAX_FREQUENT_EDGES, max_edges: int = MAX_CANDIDATE_EDGES, most_sets: int = MAX_CONCEPTS) -> DataFrame:
    """The frequent connected closed graphs of episodes: (rank, edges, n, support, saving, rooted, truncated).

    ``edges`` has rows (episode, source, value_type, target, call, src).  The closed edge sets are split where only pseudo
    sources hold them together.  A part may be in more episodes than its set; so it gets every frequent edge of all its
    episodes that its tool nodes reach, which is the part of that closure that holds it.  Graphs of more than
    ``max_edges`` edges are left out.  ``saving`` counts the calls at both ends of a graph's edges in its episodes;
    graphs with an edge from the prompt come first, then support times size decides.  ``truncated`` tells whether more
    than ``most`` edges were frequent, or more than ``most_sets`` sets closed: then the best of them by support count.
    """
    top, truncated = top_edges(frequent_edges(edges, episode, min_support), most)
    found = cut(numbered(top))
    ends = {r["bit"]: (r["source"], r["value_type"], r["target"]) for r in found.collect()}  # ``most`` rows at most
    number = {e: b for b, e in ends.items()}

    @F.pandas_udf("array<array<int>>")
    def split(sets: pd.Series) -> pd.Series:
        return pd.Series([[sorted(number[e] for e in part) for part in components_of([ends[b] for b in bits])] for bits in sets], dtype=object)

    name = ["source", "value_type", "target"]
    held = cut(edges.where(F.col("source") != "constant").join(F.broadcast(found.select(*name, "bit")), name).select(*episode, "bit", "call", "src"))
    has = held.select(*episode, "bit").distinct()
    sets, left_out = closed_edge_bits(edges, found, episode, min_support, most_sets)
    parts = sets.select(F.explode(split("bits")).alias("part")).distinct()
    parts = cut(parts.where(F.size("part") <= max_edges))
    inside = parts.select("part", F.explode("part").alias("bit")).join(has, "bit").groupBy("part", *episode).agg(F.count("*").alias("k"))
    inside = cut(inside.where(F.col("k") == F.size("part")).select("part", *episode))
    n = inside.groupBy("part").agg(F.count("*").alias("support"))
    common = inside.join(has, episode).groupBy("part", "bit").agg(F.count("*").alias("k")).join(n, "part").where("k = support")
    closure = common.groupBy("part", "support").agg(F.array_sort(F.collect_list("bit")).alias("all"))
    graphs = closure.select("support", "part", F.explode(split("all")).alias("graph")).where(F.size(F.array_except("part", "graph")) == 0)
    graphs = cut(graphs.where((F.size("graph") <= max_edges) & (F.col("support") >= min_support)).groupBy("graph").agg(F.max("support").alias("support"), F.min("part").alias("part")))
    where = graphs.select("graph", "part").join(inside, "part").select("graph", *episode, F.explode("graph").alias("bit"))
    calls = where.join(held, [*episode, "bit"]).select("graph", *episode, F.explode(F.array("call", "src")).alias("call")).where("call is not null").distinct()
    saving = calls.groupBy("graph").agg(F.count("*").alias("saving"))
    text = F.transform("graph", lambda b: F.get(F.array(*[F.lit(f"{x} --{t}--> {y}") for x, t, y in (ends[k] for k in sorted(ends))]), b)) if ends else F.array().cast("array<string>")
    roots = F.array(*[F.lit(b) for b, e in ends.items() if e[0] == "prompt"]).cast("array<int>")
    out = graphs.join(saving, "graph", "left").select(F.array_sort(text).alias("edges"), F.size("graph").cast("long").alias("n"), "support", F.coalesce("saving", F.lit(0)).alias("saving"), F.arrays_overlap("graph", roots).alias("rooted"))
    order = [F.desc("rooted"), -F.col("n") * F.col("support"), F.desc("support"), F.desc("saving"), "edges"]
    return number_rows(out, order, "rank").withColumn("truncated", F.lit(truncated or left_out))


def participating_calls(seeds: DataFrame, deps: DataFrame, episode: list[str]) -> DataFrame:
    """(episode, call): the seed calls and all calls whose results they bind to, directly or through any number of others.

    ``deps`` has one row (episode, call, source) for each binding.
    """
    seen = fresh = cut(seeds.select(*episode, "call").distinct())
    while not fresh.isEmpty():
        step = fresh.join(deps, [*episode, "call"]).select(*episode, F.col("source").alias("call")).distinct()
        fresh = cut(step.join(seen, [*episode, "call"], "left_anti"))
        seen = seen.unionByName(fresh)
    return seen


def edge_text(source: Column, value_type: Column, target: Column) -> Column:
    return F.concat(source, F.lit(" --"), value_type, F.lit("--> "), target)


def layers(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """(node, layer): the longest path from a node without incoming edges; edges with a cycle raise."""
    edges = cut(edges.select(source, target))  # every layer reads them
    ends = edges.select(F.explode(F.array(F.struct(F.col(source).alias("node"), F.lit(False).alias("behind")), F.struct(F.col(target).alias("node"), F.lit(True).alias("behind")))).alias("x"))
    nodes = cut(ends.groupBy("x.node").agg(F.bool_or("x.behind").alias("behind")))
    done = level = cut(nodes.where("not behind and node is not null").select("node", F.lit(0).cast("long").alias("layer")))
    depth, most = 0, nodes.count()
    while not level.isEmpty():
        depth += 1
        if depth > most:
            raise ValueError("the edges have a cycle")
        level = cut(level.join(edges, F.col("node") == F.col(source)).select(F.col(target).alias("node")).distinct().withColumn("layer", F.lit(depth).cast("long")))
        done = done.unionByName(level)
    if done.select("node").distinct().count() < most:
        raise ValueError("the edges have a cycle")
    return done.groupBy("node").agg(F.max("layer").alias("layer"))
