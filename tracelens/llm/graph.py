"""Distributed connected components with DataFrame operations only.

Alternating large-star and small-star rounds: in a large-star round each node
tells its larger neighbours the smallest id it sees, in a small-star round its
smaller ones.  The edge list shrinks to stars around the smallest id of each
component.  Each round is two map-side combined aggregations and two joins; a node
with very many neighbours is one key of a join, whose large side adaptive execution
splits over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def shared_ids(rows: DataFrame, id_: str, class_: str, heads: DataFrame) -> DataFrame:
    """Edges (a, b) between an id that stands in several classes and the head of each of them; ``heads`` has (class, id).

    Rows with one id are one node of the graph, so their classes belong together.
    """
    many = rows.groupBy(id_).agg(F.min(class_).alias("lo"), F.max(class_).alias("hi")).where("lo != hi").select(id_)
    return rows.select(id_, class_).join(many, id_, "left_semi").join(heads.select(F.col("id").alias("b"), F.col("class").alias(class_)), class_).select(F.col(id_).alias("a"), "b").where("a != b").distinct()


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``edges`` has columns a and b of one orderable type; returns (id, component) of every node on an edge.

    Nulls and loops are left out: they connect nothing.
    """
    e = edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = scratch.save(e, "edges")
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = e.select(F.col("v").alias("hub"), F.col("u").alias("leaf")).join(low, F.col("hub") == F.col("u")).select(F.col("leaf").alias("u"), F.col("m").alias("v"))
        large = scratch.save(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        after = scratch.save(small.where("u != v").distinct(), "edges")
        scratch.drop(large)
        scratch.drop(e)
        e = after
        # done when each node points to one other, and none of those points on
        loose = e.select("u").groupBy("u").count().where("count > 1").select("u").union(e.select("v").distinct().join(e.select(F.col("u").alias("v")), "v", "left_semi").select(F.col("v").alias("u")))
        if loose.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    star = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return star.union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
