"""Calls of flows replaced by the calls that the flows made, so that a session that ran a flow is mined like any other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ATTEMPTS = "array<struct<value:string,values:map<string,string>,skipped:boolean,error:string>>"
ITEMS = f"array<struct<args:map<string,string>,result:string,error:string,attempts:{ATTEMPTS}>>"
STEPS = f"array<struct<tool:string,skipped:boolean,args:map<string,string>,result:string,error:string,attempts:{ATTEMPTS},items:{ITEMS}>>"


def flow_calls(runs: DataFrame) -> DataFrame:
    """(run_id, flow, at, tool, args, result, is_error) of the calls behind runs (run_id, flow, steps as ``STEPS``), in the order of ``at``.

    A skipped step, or one without a tool, made none.  A fan-out made one for each item with arguments.  The rungs of a
    ladder that missed come before the one that counts, with an empty result: a rung has the values that it tried, or its
    value in the place of the argument that holds the last one's.
    """
    steps = runs.select("run_id", "flow", F.posexplode("steps").alias("i", "s")).where(~F.coalesce("s.skipped", F.lit(False)) & F.col("s.tool").isNotNull())
    own = F.array(F.struct("s.args", "s.result", "s.error", "s.attempts"))
    subs = steps.select("run_id", "flow", "i", F.col("s.tool").alias("tool"), F.posexplode(F.coalesce("s.items", own)).alias("j", "x")).where(F.coalesce(F.size("x.args"), F.lit(0)) > 0)
    tried = F.filter(F.coalesce("x.attempts", F.array().cast(ATTEMPTS)), lambda a: ~F.coalesce(a["skipped"], F.lit(False)))
    subs = subs.withColumn("tried", tried)
    last = F.element_at("tried", -1)["value"]
    holder = F.get(F.transform(F.filter(F.map_entries("x.args"), lambda e: e["value"] == F.when(F.size("tried") > 0, last)), lambda e: e["key"]), F.lit(0))
    subs = subs.withColumn("holder", F.when(F.size("tried") > 1, holder))

    def rung(a):
        with_values = F.map_concat(F.map_filter("x.args", lambda k, v: ~F.map_contains_key(a["values"], k)), a["values"])
        with_value = F.transform_values("x.args", lambda k, v: F.when(k == F.col("holder"), a["value"]).otherwise(v))
        args = F.when(F.coalesce(F.size(a["values"]), F.lit(0)) > 0, with_values).when(F.col("holder").isNotNull(), with_value)
        return F.struct(args.alias("args"), F.lit("{}").alias("result"), a["error"].isNotNull().alias("is_error"))

    missed = F.when(F.size("tried") > 1, F.filter(F.transform(F.slice("tried", F.lit(1), F.size("tried") - 1), rung), lambda c: c["args"].isNotNull())).otherwise(F.array().cast("array<struct<args:map<string,string>,result:string,is_error:boolean>>"))
    final = F.array(F.struct(F.col("x.args").alias("args"), F.coalesce("x.result", F.lit("{}")).alias("result"), F.col("x.error").isNotNull().alias("is_error")))
    out = subs.select("run_id", "flow", "i", "j", "tool", F.posexplode(F.concat(missed, final)).alias("k", "c"))
    return out.select("run_id", "flow", F.struct("i", "j", "k").alias("at"), "tool", "c.args", "c.result", "c.is_error")


def expand_flow_calls(calls: DataFrame, runs: DataFrame, session: list[str]) -> tuple[DataFrame, DataFrame]:
    """Sessions' calls (session, seq, tool, args, result, is_error) with each ``flows.run_flow`` replaced by its run's calls, numbered anew; and (session, seq, run_id) of those whose run is not there.

    A flow call names its run by ``run_id`` in its result.  Other calls of flows, and a session's own tools
    (``claude-code``), are left out, as flows cannot make them.
    """
    server = F.substring_index("tool", ".", 1)
    plain = calls.where(~server.isin("flows", "claude-code")).select(*session, "seq", F.lit(None).cast("struct<i:int,j:int,k:int>").alias("at"), "tool", "args", "result", "is_error", F.lit(None).cast("string").alias("from_flow"))
    ran = calls.where(F.col("tool") == "flows.run_flow").select(*session, "seq", F.get_json_object("result", "$.run_id").alias("run_id"))
    made = ran.join(flow_calls(runs), "run_id").select(*session, "seq", "at", "tool", "args", "result", "is_error", F.col("flow").alias("from_flow"))
    lost = ran.join(runs.select("run_id").distinct(), "run_id", "left_anti").select(*session, "seq", "run_id")
    order = W.partitionBy(*session).orderBy(F.col("seq").alias("_s"), "at")
    both = plain.unionByName(made).withColumn("_n", F.row_number().over(order).cast("long"))
    return both.select(*session, F.col("_n").alias("seq"), "tool", "args", "result", "is_error", "from_flow"), lost
