"""Sessions cut into prompts and episodes; calls collapsed to tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def run_collapse(calls: DataFrame, episode: list[str], order: list[str], token: str) -> DataFrame:
    """One row for each run of equal tokens: pos, token, first and past-the-end call index, and whether the run has several."""
    w = W.partitionBy(*episode).orderBy(*order)
    new = F.coalesce(F.lag(token).over(w) != F.col(token), F.lit(True)).cast("int")
    marked = calls.select(*episode, *order, token, (F.row_number().over(w) - 1).alias("_i"), new.alias("_new"))
    runs = marked.withColumn("pos", F.sum("_new").over(W.partitionBy(*episode).orderBy("_i")) - 1)
    return runs.groupBy(*episode, "pos").agg(
        F.first(token).alias("token"), F.min("_i").cast("long").alias("start_idx"), (F.max("_i") + 1).cast("long").alias("end_idx"), (F.count("*") > 1).alias("fanout"))


def token_lists(runs: DataFrame, episode: list[str]) -> DataFrame:
    """One row an episode: its runs in order as an array."""
    return runs.groupBy(*episode).agg(F.array_sort(F.collect_list(F.struct("pos", "token", "start_idx", "end_idx", "fanout"))).alias("runs"))


def prompt_index(lines: DataFrame, session: list[str], order: list[str], is_prompt: Column) -> DataFrame:
    """``lines`` with the number of the prompt that each belongs to: 0 for the first, -1 before it."""
    w = W.partitionBy(*session).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return lines.withColumn("prompt_index", F.sum(F.coalesce(is_prompt, F.lit(False)).cast("long")).over(w) - 1)


def result_per_prompt(lines: DataFrame, session: list[str], order: list[str], text: str, is_answer: Column) -> DataFrame:
    """The last answer under each prompt; needs ``prompt_index``."""
    key = F.struct(*order)
    answers = lines.where(is_answer & (F.col("prompt_index") >= 0))
    return answers.groupBy(*session, "prompt_index").agg(F.max_by(text, key).alias("result"))


def episode_numbers(calls: DataFrame, session: list[str], prompt: str) -> DataFrame:
    """The prompts that have calls, numbered without gaps from 1."""
    own = calls.select(*session, prompt).distinct()
    return own.withColumn("episode", F.dense_rank().over(W.partitionBy(*session).orderBy(prompt)).cast("long"))


def drop_split_parents(sessions: DataFrame, session: str, parent: str) -> DataFrame:
    """Sessions that were split are stood for by their parts."""
    parents = sessions.where(F.col(parent).isNotNull()).select(F.col(parent).alias(session)).distinct()
    return sessions.join(parents, session, "left_anti")


def while_active(calls: DataFrame, session: list[str], order: list[str], starts: Column, always: Column) -> DataFrame:
    """Calls that count: those that start activity or always count, and others once the session is active."""
    w = W.partitionBy(*session).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    active = F.max(starts.cast("int")).over(w)
    return calls.withColumn("_active", active).where(always | (F.col("_active") == 1)).drop("_active")


def resequence(calls: DataFrame, session: list[str], ts: str, agent: str, main: str = "main", tie: list[str] | None = None) -> DataFrame:
    """Calls of all agents in one order: time, the main agent first at ties."""
    w = W.partitionBy(*session).orderBy(F.col(ts).asc_nulls_first(), F.col(agent) != main, *(tie or []))
    return calls.withColumn("seq", F.row_number().over(w).cast("long"))


def pair_results(uses: DataFrame, results: DataFrame, key: list[str], order: str) -> DataFrame:
    """Each use with its first result; later results of the same use do not count."""
    first = results.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(order))).where("_n = 1").drop("_n")
    return uses.join(first, key)


def as_of(events: DataFrame, facts: DataFrame, key: list[str], at: str, since: str, value: str, tie: str) -> DataFrame:
    """``events`` with the value of the latest fact of the same key that is not later.

    Both sides are merged into one ordered stream per key and the last fact is carried on: one shuffle, no range join.
    """
    left = events.select(*key, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*events.columns).alias("_row"), F.lit(None).cast(dict(facts.dtypes)[value]).alias("_v"), F.lit(None).cast(dict(facts.dtypes)[tie]).alias("_tie"))
    right = facts.select(*key, F.col(since).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"), F.col(tie).alias("_tie"))
    w = W.partitionBy(*key).orderBy("_t", "_side", "_tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    carried = F.last(F.when(F.col("_side") == 0, F.struct("_v")), ignorenulls=True).over(w)
    return left.unionByName(right).withColumn("_last", carried).where("_side = 1").select("_row.*", F.col("_last._v").alias(f"as_of_{value}"))


def slice_calls(calls: DataFrame, keep: DataFrame, episode: list[str], order: str) -> DataFrame:
    """An episode restricted to some of its calls, numbered again from 1."""
    kept = calls.join(keep, [*episode, order], "left_semi")
    return kept.withColumn("seq", F.row_number().over(W.partitionBy(*episode).orderBy(order)).cast("long"))


def step_names(steps: DataFrame, session: list[str], base: str, order: str) -> DataFrame:
    """Unique names: the base, then base_2, base_3 and so on."""
    n = F.row_number().over(W.partitionBy(*session, base).orderBy(order))
    return steps.withColumn("step", F.when(n == 1, F.col(base)).otherwise(F.concat_ws("_", F.col(base), n.cast("string"))))
