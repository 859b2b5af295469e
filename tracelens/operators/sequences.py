"""Closed frequent contiguous tool sequences.

Support is anti-monotone, so a sequence has a longer one of equal support that
contains it only if some extension by one token has.  Closedness is thus two
equi-joins with the sequences of one more token, and no comparison of all pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranking import number_rows

MIN_SUPPORT, MIN_LEN, MAX_LEN = 2, 2, 40


def ngrams(runs: DataFrame, episode: list[str], least: int = MIN_LEN, most: int = MAX_LEN) -> DataFrame:
    """One row for each place and length: the tokens, the calls they span, and the fan-out flag of each token.

    ``runs`` has one row an episode (see ``episodes.token_lists``).
    """
    r = F.col("runs")
    starts = runs.select(*episode, "runs", F.explode(F.sequence(F.lit(0), F.size(r) - least)).alias("at")).where(F.size(r) >= least)
    both = starts.select(*episode, "runs", "at", F.explode(F.sequence(F.lit(least), F.least(F.lit(most), F.size(r) - F.col("at")))).alias("n"))
    part = F.slice("runs", F.col("at") + 1, F.col("n"))
    both = both.select(*episode, "at", "n", part.alias("part"))
    return both.select(
        *episode, "at", "n", F.col("part.token").alias("seq"), F.col("part.fanout").alias("fan"),
        (F.element_at("part", -1)["end_idx"] - F.element_at("part", 1)["start_idx"]).alias("span"))


def support(grams: DataFrame, episode: list[str]) -> DataFrame:
    """seq, n, support, saving, and the fan-out flags over all places: sums and greatest flags, combined before each shuffle."""
    first = grams.groupBy(*episode, "seq", "n").agg(F.min_by("span", "at").alias("span"))
    got = first.groupBy("seq", "n").agg(F.count("*").alias("support"), F.sum("span").alias("saving"))
    flags = grams.select("seq", F.posexplode("fan").alias("place", "flag")).groupBy("seq", "place").agg(F.max(F.col("flag").cast("int")).alias("flag"))
    fans = flags.groupBy("seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "flag"))), lambda x: x["flag"].cast("string")), "").alias("fanout"))
    return got.join(fans, "seq").select("seq", "n", "support", "saving", "fanout")


def closed(found: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Frequent sequences that no longer one of the same support contains."""
    freq = found.where(F.col("support") >= min_support)
    longer = freq.where(F.col("n") > 1)
    cover = longer.select(F.expr("slice(seq, 1, n - 1)").alias("seq"), "support").union(longer.select(F.expr("slice(seq, 2, n - 1)").alias("seq"), "support")).distinct()
    return freq.join(cover, ["seq", "support"], "left_anti")


def ranked(found: DataFrame) -> DataFrame:
    """By support times length, then support, saving, and the tokens themselves."""
    return number_rows(found, [(-F.col("support") * F.col("n")), -F.col("support"), -F.col("saving"), F.col("seq")], "rank")


def ordered_distinct(rows: DataFrame, key: list[str], value: str, order: list[str], most: int) -> DataFrame:
    """The first ``most`` distinct values of each key by first place, as an array."""
    first = rows.where(F.trim(value) != "").groupBy(*key, value).agg(F.min(F.struct(*order)).alias("_o"))
    top = first.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy("_o"))).where(F.col("_n") <= most)
    return top.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", value))), lambda s: s[value]).alias("values"))
