"""Reports over runs: coverage, evidence without repeats, log summaries, provenance, majority votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranking import cut

# Fixed value: characters from which on a value counts inside a text.
LEAST = 5
#: Beginnings of values that are sent to every executor, at some 40 bytes each; more of them are joined by a shuffle.
MOST_HEADS = 500_000


def coverage(expected: DataFrame, steps: DataFrame, run: list[str]) -> DataFrame:
    """(run, found, total, missing, required_missing).  ``expected`` has (name, required, step), ``steps`` (run, step, hits).

    An output is found if one of its steps has hits; every run is held against every output.
    """
    runs = steps.select(*run).distinct()
    outputs = expected.groupBy("name", "required").agg(F.collect_set("step").alias("wanted"))
    have = steps.where(F.col("hits") > 0).groupBy(*run).agg(F.collect_set("step").alias("have"))
    all_ = F.array_sort(F.array_agg(F.struct("name", "required", "wanted")))
    card = outputs.agg(all_.alias("o"))
    # the card of a flow has a few outputs: it travels as one list with each run
    per = runs.join(have, run, "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>"))).withColumn("o", card.scalar())
    lost = F.filter("o", lambda x: ~F.arrays_overlap(x["wanted"], F.col("have")))
    return per.select(
        *run, (F.size("o") - F.size(lost)).cast("long").alias("found"), F.size("o").cast("long").alias("total"), F.array_join(F.transform(lost, lambda x: x["name"]), ",").alias("missing"),
        F.array_join(F.transform(F.filter(lost, lambda x: x["required"]), lambda x: x["name"]), ",").alias("required_missing"))


def without_repeats(cards: DataFrame, run: list[str], key: list[str], order: list[str], better: Column | None = None) -> DataFrame:
    """One card for each key: the first, or the first of the better ones (such as a page with its body)."""
    prefer = [(~better).cast("int")] if better is not None else []
    n = F.row_number().over(W.partitionBy(*run, *key).orderBy(*prefer, *order))
    return cards.withColumn("_n", n).where("_n = 1").drop("_n")


def log_summary(logs: DataFrame, source: list[str], at: str, names: dict[str, str]) -> DataFrame:
    """n, first and last time of each source, and each of ``names``' values by frequency as ``value:count`` texts; sources that are null are the total."""
    out = logs.groupingSets([source, []], *source).agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"), F.grouping(source[0]).alias("total"))
    for name, value in names.items():
        n = logs.where(F.col(value).isNotNull()).groupingSets([[*source, value], [value]], *source, value).agg(F.count("*").alias("k"), F.grouping(source[0]).alias("total"))
        best = n.groupBy(*source, "total").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), value))), lambda s: F.concat_ws(":", s[value], (-s["k"]).cast("string"))), ",").alias(name))
        on = [out[c].eqNullSafe(best[c]) for c in source] + [out["total"] == best["total"]]
        out = out.join(best, on, "left").select(out["*"], name)
    return out


def majority(rows: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each key, the first seen at ties."""
    n = rows.groupBy(*key, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return n.groupBy(*key).agg(F.max_by(F.struct(value, "n"), F.struct("n", -F.col("_first"))).alias("m")).select(*key, f"m.{value}", "m.n")


def repeats(rows: DataFrame, key: list[str], count: str) -> DataFrame:
    """The most and the upper median of a count."""
    per = rows.groupBy(*key, count).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(W.partitionBy(*key).orderBy(count))
    total = F.sum("_n").over(W.partitionBy(*key))
    placed = per.withColumn("_upto", upto).withColumn("_total", total).where(F.col(count).isNotNull())
    return placed.groupBy(*key).agg(F.max(count).alias("most"), F.min(F.when(F.col("_upto") > F.call_function("div", F.col("_total"), F.lit(2)), F.col(count))).alias("median"))


def bindability(args: DataFrame, key: list[str]) -> DataFrame:
    """The share of derived arguments among those that vary; 1 if none varies.  ``args`` has a column kind: derived, unresolved, authored or constant."""
    varies = F.count_if(F.col("kind").isin("derived", "unresolved", "authored"))
    return args.groupBy(*key).agg(F.coalesce(F.try_divide(F.count_if(F.col("kind") == "derived"), varies), F.lit(1.0)).alias("bound"))


def provenance(origins: DataFrame, uses: DataFrame, run: list[str], bucket: Column | None = None) -> DataFrame:
    """(run, use, value, origin): where each used text got a value from, the latest origin before the use.

    origins: (run, at, value); uses: (run, use, at, text).  A text and a value meet if they are equal, or by the first
    ``LEAST`` characters of a value that may stand inside a text: equi-joins within a run, not all pairs of it.  Places
    of a text travel without it; only values that meet one are held against the whole text.
    """
    may = lambda v: (F.length(v) >= LEAST) & ~F.col(v).rlike(r"^\d+$")
    inside = may("value")
    given = origins.select(*run, F.col("at").alias("_at"), "value").where("value is not null")
    # equal values that may stand inside are found there
    same = uses.where(~may("text")).select(*run, "use", "at", F.col("text").alias("value")).join(given.where(~inside), [*run, "value"]).where(F.col("_at") < F.col("at")).select(*run, "use", "value", "_at")
    begins = given.where(inside).withColumn("_head", F.substring("value", 1, LEAST))
    n = F.length("text") - LEAST + 1
    heads = F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(F.col("text"), i, F.lit(LEAST))))
    places = uses.where(n >= 1).select(*run, "use", "at", F.explode(heads).alias("_head"))
    known = cut(begins.select("_head").distinct())
    if known.count() <= MOST_HEADS:
        places = places.join(F.broadcast(known), "_head", "left_semi")
    met = places.join(begins, [*run, "_head"]).where(F.col("_at") < F.col("at")).groupBy(*run, F.col("use").alias("_use"), "at", "value").agg(F.max("_at").alias("_from"))
    met = met.withColumnsRenamed({c: f"_{c}" for c in (*run, "at")})
    own = F.col("_use").eqNullSafe(F.col("use"))
    for c in (*run, "at"):
        own = own & (F.col(f"_{c}") == F.col(c))
    held = uses.select(*run, "use", "at", "text").join(met, own).where(F.contains("text", F.col("value"))).select(*run, "use", "value", F.col("_from").alias("_at"))
    return same.unionByName(held).groupBy(*run, "use", "value").agg(F.max("_at").alias("origin"))


def folded_prompts(prompts: DataFrame, key: list[str], fold: Column, order: str, text: str, most: int = 12) -> DataFrame:
    """Near-identical prompts as one row: the first text, and how many there are."""
    n = prompts.withColumn("_fold", fold).groupBy(*key, "_fold").agg(F.min(order).alias("first"), F.count("*").alias("n"), F.min_by(text, order).alias("text"))
    return n.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy("first"))).where(F.col("_n") <= most).drop("_n", "_fold")


def observed(values: DataFrame, key: list[str], value: str, episode: str) -> DataFrame:
    """How many values and episodes each argument has, and whether it is constant."""
    return values.groupBy(*key).agg(F.countDistinct(value).alias("n_values"), F.countDistinct(episode).alias("n_episodes"), (F.countDistinct(value) == 1).alias("constant"))
