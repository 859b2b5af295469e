"""The steps of an investigation, over all its inputs at once.

A ladder is one table of attempts in which the first rung with hits counts; a
fan-out is one exploded list; a condition is a filter.  Each is a plain
DataFrame, so that Catalyst plans a thousand investigations like one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_ITEMS = 10


def ladder(rungs: list[DataFrame], key: list[str]) -> DataFrame:
    """(key, rung, hits, value) of the rung that counts for each key: the first with hits, else the last that was tried.

    Each rung has key, value and hits.  A blank value is not tried, nor is one that an earlier rung has tried.
    """
    all_ = reduce(DataFrame.unionByName, [r.select(*key, "value", "hits", F.lit(i).cast("long").alias("rung")) for i, r in enumerate(rungs)])
    tried = all_.where(F.trim("value") != "")
    first = tried.withColumn("_again", F.row_number().over(W.partitionBy(*key, "value").orderBy("rung"))).where("_again = 1").drop("_again")
    best = F.min(F.when(F.col("hits") > 0, F.struct("rung", "hits", "value")))
    return first.groupBy(*key).agg(F.coalesce(best, F.max(F.struct("rung", "hits", "value"))).alias("r")).select(*key, "r.rung", "r.hits", "r.value")


def fan_out(rows: DataFrame, items: str, most: int = MAX_ITEMS) -> DataFrame:
    """One row an item: blanks go first, then the list is cut to its bound."""
    kept = F.slice(F.filter(items, lambda x: x.isNotNull() & (x.cast("string") != "")), 1, most)
    return rows.select(*[c for c in rows.columns if c != items], F.posexplode(kept).alias("n", "item"))


def fan_in(items: DataFrame, key: list[str], hits: str, error: str) -> DataFrame:
    """hits and status of a fanned-out step: an error if all items failed, partial if some did."""
    bad = F.col(error).isNotNull()
    return items.groupBy(*key).agg(
        F.sum(F.when(bad, F.lit(0)).otherwise(F.col(hits))).cast("long").alias("hits"),
        F.when(F.bool_and(bad), F.lit("error")).when(F.bool_or(bad), F.lit("partial_errors")).otherwise(F.lit("ok")).alias("status"))


def merge_extracts(rows: DataFrame, key: list[str], order: list[str], name: str, value: str) -> DataFrame:
    """The distinct values of each extract in order of first place, as an array."""
    first = rows.where(F.col(value).isNotNull()).groupBy(*key, name, value).agg(F.min(F.struct(*order)).alias("_o"))
    return first.groupBy(*key, name).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", value))), lambda s: s[value]).alias("values"))


def first_value(rows: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """The first value of each key that is neither null nor blank."""
    good = F.when(F.coalesce(F.col(value).cast("string"), F.lit("")) != "", F.struct(*order))
    return rows.groupBy(*key).agg(F.min_by(value, good).alias(value))


def replay(requests: DataFrame, recorded: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Requests answered from recorded calls, and those without an answer.  The last recording of a key counts."""
    last = recorded.groupBy(key).agg(F.max_by(F.struct(*[c for c in recorded.columns if c != key]), "seq").alias("r")).select(key, "r.*")
    return requests.join(last, key), requests.join(last, key, "left_anti")
