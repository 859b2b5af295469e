"""From bound calls of many sessions to parameterised flows: one DataFrame chain, all triggers at once.

Calls are collapsed to steps, steps aligned across sessions, references to calls renamed to the common steps, arguments
merged, fan-outs and optional steps settled, steps put in an order in which each follows what it refers to, and inputs
and regression cases taken from the sessions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelens.functions import ids

from . import induce, ordering, templates
from .ranking import cut, dealt, kept

STEP = ["trigger", "step"]


@dataclass(frozen=True)
class Flows:
    """steps: one row a flow's step, in ``place`` order; arguments: what each step passes; inputs; cases: the inputs of
    a traced session and the steps that have to find something; cuts: references that an order had to give up."""

    steps: DataFrame
    arguments: DataFrame
    inputs: DataFrame
    cases: DataFrame
    cuts: DataFrame


def named_steps(aligned: DataFrame) -> DataFrame:
    """(trigger, step, id, tool, mean, seen_in, silent, hits_everywhere, repeated_max, repeated_median) of each common step.

    Ids are the tool's last part; of several such steps those of more sessions, then earlier ones, are numbered first.
    """
    place = F.row_number().over(W.partitionBy("trigger", "session").orderBy("idx"))
    rows = aligned if "place" in aligned.columns else aligned.withColumn("place", place)
    per = rows.groupBy(*STEP).agg(
        F.min("tool").alias("tool"), F.avg("place").alias("mean"), induce.sessions_of(aligned).alias("seen_in"), (F.max("hits") <= 0).alias("silent"), (F.min("hits") > 0).alias("hits_everywhere"),
        F.max("repeated").alias("repeated_max"), F.count("*").alias("members"))
    # the median of the repeats from their counts, not from a sorted list
    counts = rows.groupBy(*STEP, "repeated").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy(*STEP).orderBy("repeated"))
    median = counts.withColumn("upto", upto).join(per.select(*STEP, "members"), STEP).where(F.col("upto") > F.call_function("div", F.col("members"), F.lit(2))).groupBy(*STEP).agg(F.min("repeated").alias("repeated_median"))
    base = F.regexp_replace(F.substring_index("tool", ".", -1), r"\W", "_")
    n = F.row_number().over(W.partitionBy("trigger", "base").orderBy(F.col("seen_in").desc(), "mean", "step"))
    per = per.join(median, STEP).withColumn("base", base).withColumn("n", n)
    return per.select(*STEP, F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", "n")).alias("id"), "tool", "mean", "seen_in", "silent", "hits_everywhere", "repeated_max", "repeated_median")


def _call_names(calls: DataFrame, aligned: DataFrame, named: DataFrame) -> DataFrame:
    """(trigger, session, head, name): ``c<idx>`` of each call, and the id of the common step that it belongs to."""
    owner = F.last("step", ignorenulls=True).over(W.partitionBy("trigger", "session").orderBy("idx", "side").rowsBetween(W.unboundedPreceding, W.currentRow))
    begins = aligned.select("trigger", "session", "idx", "step", F.lit(0).alias("side"))
    both = begins.unionByName(calls.select("trigger", "session", "idx", F.lit(None).cast("long").alias("step"), F.lit(1).alias("side")))
    both = dealt(both, ["trigger", "session"]).withColumn("step", owner).where("side = 1")
    return both.join(named.select(*STEP, "id"), STEP).select("trigger", "session", F.concat(F.lit("c"), F.col("idx").cast("string")).alias("head"), F.col("id").alias("name"))


def _first_fanouts(aligned: DataFrame) -> DataFrame:
    """(trigger, step, f) of the steps with fan-outs: the argument and shape of the first session's."""
    some = aligned.where("each is not null").select(*STEP, "session", "idx", "each", F.col("args")[F.col("each")].alias("shape"))
    return induce.small(dealt(some, ["trigger", "session"]).groupBy(*STEP).agg(F.min_by(F.struct("each", "shape"), F.struct("session", "idx")).alias("f")))


def _fanouts(aligned: DataFrame, items: DataFrame, first: DataFrame) -> DataFrame:
    """(trigger, step, each, shape, refs, max_items) of the steps that run once for each item of a list.

    items: (trigger, step, ref) of the references of their items.  Two more items than ever seen may come.
    """
    most = aligned.where("each is not null").join(first, STEP).where(F.col("each") == F.col("f.each")).groupBy(*STEP).agg((F.max("items") + 2).alias("max_items"))
    refs = items.distinct().groupBy(*STEP).agg(F.array_sort(F.collect_list("ref")).alias("refs"))
    return first.join(most, STEP).join(refs, STEP, "left").select(*STEP, "f.each", "f.shape", F.coalesce("refs", F.array().cast("array<string>")).alias("refs"), "max_items")


def _items(aligned: DataFrame, first: DataFrame) -> DataFrame:
    """(trigger, session, step, ref): references of the items of a fan-out, and of single calls of the same shape in other sessions."""
    rows = aligned.join(first, STEP)
    own = rows.where(F.col("each") == F.col("f.each")).select("trigger", "session", "step", F.explode("item_refs").alias("ref"))
    value = F.col("args")[F.col("f.each")]
    single = rows.where(F.col("each").isNull() & (F.regexp_replace(value, induce.REFERENCE, "{{ item }}") == F.col("f.shape"))).select("trigger", "session", "step", F.regexp_extract(value, induce.REFERENCE, 0).alias("ref"))
    return own.unionByName(single).where("ref != ''")


def _without(list_: str, cut_ids: str):
    """The templates that refer to none of the cut steps."""
    return F.filter(list_, lambda t: F.size(F.array_intersect(F.transform(templates.references(t), lambda r: F.regexp_extract(r, r"^\w+", 0)), F.col(cut_ids))) == 0)


def induce_flows(calls: DataFrame, inputs: DataFrame) -> Flows:
    """Flows of all triggers from their sessions' bound calls.

    calls: rows as ``induce`` takes them, whose templates refer to ``inputs.<name>`` or to ``c<idx>.<name>``, an earlier
    call of the session; inputs: (trigger, session, name, value).  A step is optional if a session lacks it or it never
    found anything; its arguments are as ``merge_arguments`` has them.  Where sessions did things in opposite orders,
    references may form a cycle: rungs of a ladder and lists of a fan-out give way first, a scalar template stays and
    renders blank.  Null and missing maps count as empty; sessions without calls give nothing.
    """
    session = ["trigger", "session"]
    calls, inputs = kept(calls), dealt(inputs, session)
    aligned = induce.place(induce.collapse(calls))
    named = induce.small(named_steps(aligned))
    total = cut(aligned.groupBy("trigger").agg(F.count_if(F.col("place") == 1).alias("sessions")))
    heads = kept(_call_names(calls, aligned, named))

    rows = templates.rename(induce.argument_rows(aligned), heads, session, "template", "renamed").drop("template").withColumnRenamed("renamed", "template")
    first = _first_fanouts(aligned)
    items = templates.rename(_items(aligned, first), heads, session, "ref", "renamed").select(*STEP, F.col("renamed").alias("ref"))
    fan = induce.small(_fanouts(aligned, items, first))
    merged = induce.merge_arguments(aligned, rows)
    # the argument of a fan-out takes the items
    merged = merged.join(fan.select(*STEP, F.col("each").alias("arg"), "shape"), [*STEP, "arg"], "left")
    merged = cut(merged.select(*STEP, "arg", F.when(F.col("shape").isNotNull(), "item").otherwise(F.col("kind")).alias("kind"), F.when(F.col("shape").isNotNull(), F.array("shape")).otherwise(F.col("templates")).alias("templates"), "dropped", F.when(F.col("shape").isNull(), F.col("open_values")).alias("open_values")))

    # what each step refers to; an edge is soft if only some rungs, or terms of a list, are lost with it
    head = lambda t: F.regexp_extract(t, r"^\w+", 0)
    used = merged.select(*STEP, "arg", F.size("templates").alias("n"), F.explode(F.transform("templates", lambda t: F.array_distinct(F.transform(templates.references(t), head)))).alias("deps")).select(*STEP, "arg", "n", F.explode("deps").alias("dep"))
    used = used.groupBy(*STEP, "arg", "n", "dep").agg(F.count("*").alias("k")).select(*STEP, "dep", (F.col("k") < F.col("n")).alias("soft"))
    listed = fan.select(*STEP, F.explode("refs").alias("ref")).select(*STEP, head(F.get(templates.references(F.col("ref")), F.lit(0))).alias("dep"), F.lit(True).alias("soft"))
    by_id = named.select("trigger", F.col("step").alias("from"), F.col("id").alias("dep"))
    edges = used.unionByName(listed).join(by_id, ["trigger", "dep"]).select("trigger", F.col("step").alias("node"), F.col("from").alias("dep"), "soft")
    rank = F.row_number().over(W.partitionBy("trigger").orderBy("mean", "step"))
    order, cuts = ordering.stable_order(named.select("trigger", F.col("step").alias("node"), rank.alias("rank")), edges, ["trigger"])

    ids_of = named.select("trigger", F.col("step").alias("dep"), F.col("id").alias("lost"))
    lost = cut(cuts.join(ids_of, ["trigger", "dep"]).groupBy("trigger", F.col("node").alias("step")).agg(F.array_sort(F.collect_set("lost")).alias("lost")))
    merged = merged.join(lost, STEP, "left").withColumn("lost", F.coalesce("lost", F.array().cast("array<string>")))
    left = _without("templates", "lost")
    arguments = merged.select(*STEP, "arg", "kind", F.when((F.size("templates") > 1) & (F.size(left) > 0), left).otherwise(F.col("templates")).alias("templates"), "dropped", "open_values")
    arguments = arguments.join(named.select(*STEP, "id"), STEP)

    refs = F.transform(_without("refs", "lost"), lambda r: F.get(templates.references(r), F.lit(0)))
    fan = fan.join(lost, STEP, "left").withColumn("lost", F.coalesce("lost", F.array().cast("array<string>"))).withColumn("refs", refs)
    terms = F.when(F.size("refs") == 1, F.get("refs", F.lit(0))).otherwise(F.concat(F.lit("("), F.array_join("refs", " + "), F.lit(")")))
    fan = fan.select(*STEP, "each", "max_items", F.when(F.size("refs") == 0, F.lit("[]")).otherwise(F.concat(terms, F.lit(" | unique | list"))).alias("for_each"))

    shown = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("arg", "templates")))))
    passed = arguments.groupBy(*STEP).agg(shown.alias("args"), F.array_sort(F.collect_list(F.when(F.col("kind") == "unresolved", F.col("arg")))).alias("unresolved"))
    steps = named.join(total, "trigger").join(order.withColumnRenamed("node", "step"), STEP).join(passed, STEP, "left").join(fan, STEP, "left")
    steps = steps.select(
        "trigger", "place", *STEP[1:], "id", "tool", F.coalesce("args", F.lit("{}")).alias("args"), F.coalesce("unresolved", F.array().cast("array<string>")).alias("unresolved"), "each", "for_each", "max_items",
        (F.col("silent") | (F.col("seen_in") < F.col("sessions"))).alias("optional"), "silent", "seen_in", "sessions", "repeated_max", "repeated_median", (F.col("hits_everywhere") & (F.col("seen_in") == F.col("sessions"))).alias("expected"))

    example = F.min_by("value", F.struct("session", "value"))
    given = inputs.groupBy("trigger", "name").agg(example.alias("example"))
    given = given.select("trigger", "name", F.coalesce(ids.type_of(F.col("example")), F.lit("string")).alias("type"), F.lit(True).alias("required"), "example")
    # one case for each set of inputs, whatever the number of sessions that had it
    asked = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))))
    case = inputs.groupBy("trigger", "session", "name").agg(F.min("value").alias("value")).groupBy("trigger", "session").agg(asked.alias("inputs")).groupBy("trigger", "inputs").agg(F.count("*").alias("sessions"))
    expect = steps.where("expected").groupBy("trigger").agg(F.array_sort(F.collect_list("id")).alias("min_hits"))
    cases = case.join(expect, "trigger", "left").select("trigger", "inputs", "sessions", F.coalesce("min_hits", F.array().cast("array<string>")).alias("min_hits"))
    cut_ids = cuts.join(ids_of, ["trigger", "dep"]).join(named.select("trigger", F.col("step").alias("node"), "id"), ["trigger", "node"]).select("trigger", "id", "lost", "soft")
    return Flows(steps, arguments, given, cases, cut_ids)
