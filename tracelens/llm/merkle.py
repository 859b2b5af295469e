"""Merkle manifest of a dataset, with the upper tree on the driver and broadcast.

Each row is a leaf, a digest of its named fields.  Within a group (null first, then by
UTF-8 bytes) leaves ascend by id; every 16 consecutive nodes become one until one is
left, the group's subroot; the subroots in order become the root in the same way.

1. Leaves are hashed where the rows lie: texts are read once and never shuffled.
2. Digests are range-partitioned by (group, id), and counts of each partition give
   every leaf its place in its group; a hot group spreads over many ranges.
3. Large blocks of ``16 ** LEVELS`` consecutive leaves are reduced to one node each;
   that is repeated until at most ``TOP`` nodes are left.  Groups of one node each, if
   more than ``TOP``, are reduced as a group of their own.
4. The driver builds the tree above these nodes, and broadcasts their suffix paths
   (bounded by ``TOP``); where blocks were reduced more than once, suffix paths of
   lower blocks are made block by block and meet their rows in a cogroup.
5. Executors finish each row's proof and fold its leaf, tampered or not, to a root.

Nodes are lowercase hex sha256 of their children's hex digests.

Defined results: null fields are ``-``; null groups and null ids come first; rows of one
group and id ascend by leaf, so repeated rows have equal leaves in any order; an empty
table has no rows; texts of any length are hashed whole; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, narrow, table

FAN = 16
#: Levels that one block reduction folds: blocks of 16 ** LEVELS nodes.
LEVELS = 3
#: Nodes that the driver builds the upper tree of.
TOP = 1024
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PATH = "array<struct<l:string,r:string>>"
Path = list[tuple[str, str]]


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf(fields: Iterable[str | Column]) -> Column:
    """Digest of the fields: ``-`` for null, else byte count, colon and value."""
    parts = []
    for f in fields:
        v = (F.col(f) if isinstance(f, str) else f).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def place(rows: DataFrame, key: str, order: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` with their place ``pos`` among the ``n`` rows of their ``key`` in ascending order: a range partitioning and counts of its parts."""
    rows = scratch.save(rows.withColumn("tie", F.monotonically_increasing_id()), "unsorted")
    by = [key, *order, "tie"]
    at = scratch.save(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()).drop("tie"), "sorted")
    at = at.withColumn("part", F.shiftright("at", 33))
    count = at.groupBy(key, "part").agg(F.count("*").alias("m"), F.min("at").alias("low"))
    same = Window.partitionBy(key)
    before = F.coalesce(F.sum("m").over(same.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    count = count.select(key, "part", (before - F.col("low")).alias("shift"), F.sum("m").over(same).alias("n"))
    out = at.join(narrow(count, scratch), [key, "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")
    out = scratch.save(out, "placed")
    scratch.drop(rows)
    scratch.drop(at)
    return out


def up(nodes: list[str]) -> list[str]:
    return [digest("".join(nodes[i : i + FAN])) for i in range(0, len(nodes), FAN)]


def block_levels(nodes: list[str], whole: bool, levels: int) -> list[list[str]]:
    """The nodes of a block and of each level above, to its one node: all levels of a whole group, else as many as a full block has."""
    out = [nodes]
    while (len(out[-1]) > 1) if whole else (len(out) <= levels):
        out.append(up(out[-1]))
    return out


def paths(levels: list[list[str]], tail: Path) -> list[Path]:
    """The path of each node of the lowest level: what stands left and right of it in its run, level by level, then ``tail``."""
    out = [tail]
    for nodes in reversed(levels[:-1]):
        below = []
        for j in range(len(nodes)):
            run, i = nodes[j - j % FAN : j - j % FAN + FAN], j % FAN
            below.append([("".join(run[:i]), "".join(run[i + 1 :])), *out[j // FAN]])
        out = below
    return out


def fold(node: str, path: Path) -> str:
    for left, right in path:
        node = digest(left + node + right)
    return node


def _blocks(rows: DataFrame, levels: int) -> DataFrame:
    return rows.withColumn("block", F.call_function("div", F.col("pos"), F.lit(FAN**levels)))


def _ordered(rows: pa.Table) -> tuple[pa.Table, list[str], bool]:
    rows = rows.sort_by("pos")
    return rows, rows["h"].to_pylist(), rows["n"][0].as_py() <= rows["span"][0].as_py()


def reduce_blocks(nodes: DataFrame, levels: int, scratch: Scratch) -> DataFrame:
    """(key, pos, h, n) of the nodes that full blocks of (key, pos, h, n) become."""

    def run(rows: pa.Table) -> pa.Table:
        rows, h, whole = _ordered(rows)
        top = block_levels(h, whole, levels)[-1]
        n = -(-rows["n"][0].as_py() // FAN**levels)
        return pa.table({"key": rows["key"][:1].combine_chunks(), "pos": rows["block"][:1].combine_chunks(), "h": top, "n": pa.array([n], pa.int64())})

    grouped = _blocks(nodes.select("key", "pos", "h", "n", F.lit(FAN**levels).alias("span")), levels).groupBy("key", "block")
    return scratch.save(grouped.applyInArrow(run, "key string, pos long, h string, n long"), "nodes")


def upper_tree(nodes: list[tuple[str, int, str]], apart: bool) -> list[tuple[str, int, Path, str, str]]:
    """(key, pos, path, subroot, root) of the nodes (key, pos, h) that are left.

    ``apart``: nodes of one key make its subroot, and the subroots the root; else all are subroots' nodes in order, of one key.
    """
    groups: dict[str, list[tuple[int, str]]] = {}
    for key, pos, h in nodes:
        groups.setdefault(key, []).append((pos, h))
    keys = sorted(groups, key=lambda k: k.encode())
    trees = {k: block_levels([h for _, h in sorted(groups[k])], True, 0) for k in keys}
    roots = block_levels([trees[k][-1][0] for k in keys], True, 0) if keys else []
    tails = paths(roots, []) if apart and keys else [[] for _ in keys]
    out = []
    for k, tail in zip(keys, tails, strict=True):
        for (pos, _), path in zip(sorted(groups[k]), paths(trees[k], tail), strict=True):
            out.append((k, pos, path, trees[k][-1][0] if apart else None, roots[-1][0]))
    return out


def lower_suffixes(nodes: DataFrame, suffixes: DataFrame, levels: int, scratch: Scratch) -> DataFrame:
    """The suffix path of each of the nodes, whose blocks have ``suffixes``."""
    kind = suffixes.select("path", "subroot", "root").schema
    types = {f.name: t for f, t in zip(kind, [pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())])), pa.string(), pa.string()], strict=True)}

    def run(rows: pa.Table, suffix: pa.Table) -> pa.Table:
        rows, h, whole = _ordered(rows)
        tail = [(x["l"], x["r"]) for x in suffix["path"][0].as_py()]
        found = paths(block_levels(h, whole, levels), tail)
        cols = {"key": rows["key"], "pos": rows["pos"], "path": pa.array([[{"l": a, "r": b} for a, b in p] for p in found], types["path"])}
        return pa.table(cols | {c: pa.array([suffix[c][0].as_py()] * len(h), pa.string()) for c in ("subroot", "root")})

    mine = _blocks(nodes.select("key", "pos", "h", "n", F.lit(FAN**levels).alias("span")), levels).groupBy("key", "block")
    return scratch.save(mine.cogroup(suffixes.groupBy("key", "pos")).applyInArrow(run, f"key string, pos long, path {_PATH}, subroot string, root string"), "suffixes")


def _finisher(levels: int, given: Callable[[pa.Table, pa.Table | None], tuple[Path, str, str]]):
    """Proofs and folds of a block's rows (pos, h, n, id, other)."""

    def run(rows: pa.Table, suffix: pa.Table | None = None) -> pa.Table:
        tail, subroot, root = given(rows, suffix)
        rows, h, whole = _ordered(rows)
        found = paths(block_levels(h, whole, levels), tail)
        shared: dict[int, str] = {}  # what 16 neighbours' proofs have in common
        proofs, folded = [], []
        for j, (path, own, other) in enumerate(zip(found, h, rows["other"].to_pylist(), strict=True)):
            own_level = 1 if len(h) > 1 or not whole else 0
            if j // FAN not in shared:
                shared[j // FAN] = "".join(a + b for a, b in path[own_level:])
            proofs.append(digest("".join(a + b for a, b in path[:own_level]) + shared[j // FAN]))
            folded.append(fold(own if other is None else other, path))
        many = lambda x: pa.array([x] * len(h), pa.string())
        return pa.table({"id": rows["id"], "leaf": rows["h"], "subroot": many(subroot), "root": many(root), "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded]})

    return run


def manifest(leaves: DataFrame, scratch: Scratch, levels: int = LEVELS, top: int = TOP) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root and verified of leaves (key, id, h, other): ``other`` is folded in the place of h where it is not null."""
    rows = place(leaves.select("key", "id", "h", "other"), "key", ["id", "h"], scratch)
    frames, apart, kin = [rows], True, {}
    nodes = reduce_blocks(rows, levels, scratch)
    while nodes.count() > top:
        if apart and nodes.where("n > 1").isEmpty():  # one node for each of many groups
            listed = place(nodes.select(F.lit("").alias("all"), "key", "h"), "all", ["key"], scratch)
            kin[len(frames)] = listed
            nodes, apart = listed.select(F.col("all").alias("key"), "pos", "h", "n"), False
        frames.append(nodes)
        nodes = reduce_blocks(nodes, levels, scratch)
    tree = upper_tree([(r["key"], r["pos"], r["h"]) for r in nodes.collect()], apart)
    schema = f"key string, pos long, path {_PATH}, subroot string, root string"
    result = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    blocks = _blocks(rows.withColumn("span", F.lit(FAN**levels)), levels).groupBy("key", "block")
    if len(frames) == 1:
        sent = scratch.spark.sparkContext.broadcast({(k, pos): (path, sub, root) for k, pos, path, sub, root in tree})
        finish = _finisher(levels, lambda r, _: sent.value[r["key"][0].as_py(), r["block"][0].as_py()])

        def alone(rows: pa.Table) -> pa.Table:  # what Spark hands over depends on the number of arguments
            return finish(rows)

        return blocks.applyInArrow(alone, result)
    suffixes = scratch.spark.createDataFrame(tree, schema)
    for k in range(len(frames) - 1, 0, -1):
        suffixes = lower_suffixes(frames[k], suffixes, levels, scratch)
        if k in kin:  # back from places among all groups to the groups themselves
            suffixes = suffixes.join(kin[k].select("pos", F.col("key").alias("group"), F.col("h").alias("sub")), "pos").select(F.col("group").alias("key"), F.lit(0).cast("long").alias("pos"), "path", F.col("sub").alias("subroot"), "root")

    def carried(_: pa.Table, suffix: pa.Table) -> tuple[Path, str, str]:
        return [(x["l"], x["r"]) for x in suffix["path"][0].as_py()], suffix["subroot"][0].as_py(), suffix["root"][0].as_py()

    run = _finisher(levels, carried)

    def both(rows: pa.Table, suffix: pa.Table) -> pa.Table:
        return run(rows, suffix)

    return blocks.cogroup(suffixes.groupBy("key", "pos")).applyInArrow(both, result)


def document_leaves(docs: DataFrame, salt_mod: int = 5) -> DataFrame:
    """Leaves of documents by source; where ``salt_mod`` divides crc32 of the id, ``other`` is the leaf of the text with A-Z lower-cased."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % salt_mod == 0
    lowered = F.translate("text", UPPER, UPPER.lower())
    other = F.when(hit, leaf([lowered if f == "text" else f for f in FIELDS]))
    key = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source")))
    return docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("id"), leaf(FIELDS).alias("h"), other.alias("other"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "merkle")
    return manifest(document_leaves(table(spark, sf_dir, "documents")), scratch).withColumnRenamed("id", "doc_id")
