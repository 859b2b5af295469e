"""Flows induced from the events of users' weeks, their bindings replayed, and dependency orders, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelens.operators import binding, flows, induce, ordering, positions, templates
from tracelens.operators.ranking import kept

from .tables import CALLS, calls, read

SESSION = ["trigger", "session"]


def week_calls(spark, sf_dir) -> DataFrame:
    """Events as the calls of a user's week: the first tool is the trigger, the calls are numbered from 0."""
    c = calls(spark, sf_dir).withColumn("session", F.concat_ws("-", "user_id", F.date_format(F.date_trunc("week", "day"), "yyyyMMdd")))
    order = W.partitionBy("session").orderBy("ts", "event_id")
    c = c.withColumn("idx", (F.row_number().over(order) - 1).cast("long")).withColumn("trigger", F.first("tool").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return c.select(*SESSION, "idx", "tool", (F.col("k").cast("int") % 8).cast("string").alias("key"), F.when(F.col("value") > 100, "large").otherwise("small").alias("size"), F.when(F.col("tool") == "error", 0).otherwise(F.col("event_id") % 4).cast("long").alias("hits"))


def week_inputs(c: DataFrame) -> DataFrame:
    """The first call's key is what a session was asked."""
    return c.where("idx = 0").select(*SESSION, F.lit("key").alias("name"), F.col("key").alias("value"))


def bound_steps(c: DataFrame) -> DataFrame:
    """The calls with their key bound to the inputs or to an earlier call that had it, as rows of ``induce``."""
    cand = lambda df, at, kind, source, name: df.select(*SESSION, at.alias("at"), F.col("key").alias("value"), kind.alias("kind"), F.lit(False).alias("in_list"), F.lit(True).alias("first"), source.alias("source"), F.lit(name).alias("name"))
    given = cand(c.where("idx = 0"), F.lit(-1).cast("long"), F.lit("input"), F.lit("inputs"), "key")
    shown = cand(c.where("tool != 'error'"), F.col("idx"), F.when(F.col("tool") == "view", "ids:key").otherwise("copy"), F.col("tool"), "key")
    args = c.select(*SESSION, F.col("idx").alias("at"), F.lit("key").alias("arg"), F.col("key").alias("value"), "tool", "size", "hits")
    rows = binding.bind(args, given.unionByName(shown), SESSION, ("tool", "size", "hits")).withColumnsRenamed({"at": "idx", "value": "key"})
    template = F.when(F.col("kind") == "input", "{{ inputs.key }}").when(F.col("kind") == "unresolved", F.col("key")).otherwise(F.format_string("{{ c%d.key }}", "src"))
    what = F.when(F.col("kind") == "input", "text").when(F.col("kind") == "unresolved", "").otherwise("id")
    both = lambda k, s: F.create_map(F.lit("key"), k, F.lit("size"), s)
    return rows.select(*SESSION, "idx", "tool", both(template, F.col("size")).alias("args"), both(F.col("key"), F.col("size")).alias("raw"), both(F.col("kind"), F.lit("literal")).alias("kinds"), both(what, F.lit("")).alias("classes"), "hits")


def _steps(spark, sf_dir):
    return bound_steps(kept(week_calls(spark, sf_dir)))


def collapsed_steps(spark, sf_dir):
    s = induce.collapse(_steps(spark, sf_dir))
    return s.select(*SESSION, "idx", "tool", F.col("args")["key"].alias("key"), F.col("args")["size"].alias("size"), "hits", F.col("repeated").cast("long").alias("repeated"), "each", F.col("items").cast("long").alias("items"), F.array_join("item_refs", ",").alias("item_refs"), "rung", F.array_join("ladder", ",").alias("ladder"))


def aligned_steps(spark, sf_dir):
    return induce.align(induce.collapse(_steps(spark, sf_dir))).select(*SESSION, "idx", "step")


def _flows(spark, sf_dir) -> flows.Flows:
    c = kept(week_calls(spark, sf_dir))
    return flows.induce_flows(bound_steps(c), week_inputs(c))


def induced_flows(spark, sf_dir):
    """Every step of the flow of every trigger, from bindings to order, fan-outs and optional steps."""
    return _flows(spark, sf_dir).steps.withColumn("unresolved", F.array_join("unresolved", ","))


def induced_arguments(spark, sf_dir):
    return _flows(spark, sf_dir).arguments.select("trigger", "id", "arg", "kind", F.array_join("templates", ",").alias("templates"), "dropped", F.array_join("open_values", ",").alias("open_values"))


def induced_cases(spark, sf_dir):
    """The regression cases of each flow: every distinct input, and the steps that have to find something."""
    return _flows(spark, sf_dir).cases.withColumn("min_hits", F.array_join("min_hits", ","))


def replayed_bindings(spark, sf_dir):
    """Templates proposed for each tool's key and size, rendered in every week and held against what its calls passed."""
    c = week_calls(spark, sf_dir)
    first = c.groupBy(*SESSION, "tool").agg(F.min_by(F.struct("key", "size"), "idx").alias("f")).select(*SESSION, "tool", "f.*")
    inputs = week_inputs(c).select(*SESSION, F.lit("inputs.key").alias("ref"), "value")
    context = inputs.unionByName(first.select(*SESSION, F.concat("tool", F.lit(".key")).alias("ref"), F.col("key").alias("value")))
    recorded = first.select(*SESSION, F.col("tool").alias("step"), F.explode(F.create_map(F.lit("key"), F.col("key"), F.lit("size"), F.col("size"))).alias("arg", "value"))
    steps = c.select("trigger", F.col("tool").alias("step")).distinct()
    pair = lambda arg, template: F.struct(F.lit(arg).alias("arg"), template.alias("template"))
    tried = F.explode(F.array(pair("key", F.lit("{{ inputs.key }}")), pair("key", F.concat(F.lit("{{ "), F.col("step"), F.lit(".key | short }}"))), pair("size", F.lit("small")), pair("other", F.lit("x")))).alias("x")
    proposals = steps.select("trigger", "step", tried).select("trigger", "step", "x.arg", "x.template")
    return templates.replay(proposals, recorded, context, ["trigger"], "session")


def rendered_sentences(spark, sf_dir):
    """A sentence for each customer with references to nation, balance and something unknown."""
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    texts = c.select("c_custkey", F.concat(F.lit("{{ name }} of {{ nation | space }}, {{ nothing }}-{{name|short}}/"), "c_name").alias("text"))
    context = c.select("c_custkey", F.explode(F.create_map(F.lit("name"), F.col("c_name"), F.lit("nation"), F.concat("n_name", F.lit("_x")))).alias("ref", "value"))
    return templates.fill(texts, context, ["c_custkey"]).select("c_custkey", "value")


def _order_graphs(spark, sf_dir):
    """Of each customer, the suppliers in the order in which they first come up: a small graph."""
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    o = o.select(F.col("o_custkey").alias("graph"), F.concat(F.lit("s"), (F.col("l_suppkey") % 7).cast("string")).alias("node"), F.struct("o_orderkey", "l_linenumber", "l_suppkey", "l_quantity").alias("at"), F.col("l_quantity"))
    rank = F.row_number().over(W.partitionBy("graph").orderBy("at"))
    nodes = o.groupBy("graph", "node").agg(F.min("at").alias("at")).withColumn("rank", rank.cast("long")).select("graph", "node", "rank")
    before = F.lag("node").over(W.partitionBy("graph").orderBy("at"))
    edges = o.withColumn("dep", before).where("dep is not null").select("graph", "node", "dep", (F.col("l_quantity") > 25).alias("soft"))
    return nodes, edges


def dependency_order(spark, sf_dir):
    """Suppliers of each customer, each behind those of a larger number that come right before it."""
    nodes, edges = _order_graphs(spark, sf_dir)
    return ordering.stable_order(nodes, edges.where("dep > node"), ["graph"])[0]


def cyclic_order(spark, sf_dir):
    """The same with all neighbours, which makes cycles; with the number of edges that each node lost."""
    nodes, edges = _order_graphs(spark, sf_dir)
    order, cuts = ordering.stable_order(nodes, edges, ["graph"])
    return order.join(cuts.groupBy("graph", "node").agg(F.count("*").alias("lost")), ["graph", "node"], "left").withColumn("lost", F.coalesce("lost", F.lit(0)))


def _position_examples(spark, sf_dir) -> DataFrame:
    """Sentences about suppliers, a key for each nation, and what was taken from them: the nation, the balance, or a word at a place that nothing explains."""
    s = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    balance = F.format_string("%.2f", "s_acctbal")
    text = F.concat(F.lit("ref "), F.repeat(F.lit("x1 "), (F.col("s_suppkey") % 3).cast("int")), F.lit("Supplier "), "s_name", F.lit(" from nation="), F.replace("n_name", F.lit(" "), F.lit("_")), F.lit("\nbalance: "), balance, F.lit(" USD\nnote a b c d"))
    odd = F.substring("s_name", -1, 1)
    some = lambda arg, value: F.struct(F.lit(arg).alias("arg"), value.alias("value"))
    picked = F.explode(F.array(some("nation", F.replace("n_name", F.lit(" "), F.lit("_"))), some("balance", balance), some("name", F.col("s_name")), some("odd", F.element_at(F.array(F.lit("a b"), F.lit("b"), F.lit("USD"), F.lit("balance")), (odd.cast("int") % 4 + 1))))).alias("x")
    rows = s.select((F.col("s_nationkey") % 5).cast("string").alias("step"), text.alias("text"), picked).select("step", "x.arg", "text", "x.value")
    start = F.expr("locate(value, text) - 1")
    return rows.select("step", "arg", "text", start.cast("long").alias("start"), (start + F.length("value")).cast("long").alias("end"))


def learned_positions(spark, sf_dir):
    """Where each argument stands in its text, learnt from all suppliers, with the held-out gate."""
    p = positions.learn_programs(_position_examples(spark, sf_dir), ["step", "arg"], gate=True)
    return p.select("step", "arg", "program", "examples", "holds")


def positioned_values(spark, sf_dir):
    """The values that programs which hold find in all texts again."""
    examples = _position_examples(spark, sf_dir)
    programs = positions.learn_programs(examples, ["step", "arg"], gate=True).where("holds and arg != 'odd'")
    texts = examples.join(programs.select("step", "arg"), ["step", "arg"], "left_semi")
    return positions.extract(texts, programs, ["step", "arg"], "text").groupBy("step", "arg", "value").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (collapsed_steps, aligned_steps, induced_flows, induced_arguments, induced_cases, replayed_bindings, rendered_sentences, dependency_order, cyclic_order, learned_positions, positioned_values)}
WEEKS = (
    CALLS
    + """, wk AS (SELECT *, user_id || '-' || strftime(date_trunc('week', day), '%Y%m%d') AS session FROM calls),
 w AS (SELECT session, first_value(tool) OVER s AS trigger, row_number() OVER s - 1 AS idx, tool, CAST(CAST(k AS INT) % 8 AS VARCHAR) AS key, CASE WHEN value > 100 THEN 'large' ELSE 'small' END AS size
   FROM wk WINDOW s AS (PARTITION BY session ORDER BY ts, event_id))"""
)


def _dependency_sql() -> str:
    """Level by level: seven suppliers a graph, each waiting for larger ones only, so at most seven levels."""
    parts = [
        "o AS (SELECT o_custkey AS graph, 's' || (l_suppkey % 7) AS node, (o_orderkey, l_linenumber, l_suppkey, l_quantity) AS pl FROM orders JOIN lineitem ON o_orderkey = l_orderkey)",
        "n AS (SELECT graph, node, row_number() OVER (PARTITION BY graph ORDER BY min(pl)) AS rank FROM o GROUP BY 1, 2)",
        "e AS (SELECT DISTINCT graph, node, dep FROM (SELECT *, lag(node) OVER (PARTITION BY graph ORDER BY pl) AS dep FROM o) WHERE dep > node)",
        "d AS (SELECT graph, node, 0 AS lv FROM n UNION SELECT e.graph, e.node, d.lv + 1 FROM d JOIN e ON e.graph = d.graph AND e.dep = d.node)",
        "v AS (SELECT n.graph, n.node, n.rank, max(lv) AS lv FROM n JOIN d USING (graph, node) GROUP BY ALL)",
        "k0 AS (SELECT graph, node, [rank] AS path FROM v WHERE lv = 0)",
    ]
    for i in range(1, 7):
        parts.append(f"m{i} AS (SELECT v.graph, v.node, v.rank, max(path) AS floor FROM v JOIN e ON e.graph = v.graph AND e.node = v.node JOIN k{i - 1} k ON k.graph = e.graph AND k.node = e.dep WHERE lv = {i} GROUP BY ALL)")
        parts.append(f"k{i} AS (SELECT * FROM k{i - 1} UNION ALL SELECT graph, node, CASE WHEN floor > [rank] THEN list_append(floor, rank) ELSE [rank] END FROM m{i})")
    return "WITH RECURSIVE " + ",\n ".join(parts) + "\n SELECT graph, node, row_number() OVER (PARTITION BY graph ORDER BY path, node) - 1 AS place FROM k6"


ORACLE_SQL = {
    "replayed_bindings": f"""WITH {WEEKS}, f AS (SELECT trigger, session, tool AS step, arg_min(key, idx) AS key, arg_min(size, idx) AS size FROM w GROUP BY ALL), i AS (SELECT session, key AS asked FROM w WHERE idx = 0),
 r AS (SELECT f.trigger, f.step, asked, unnest([{{'a': 'key', 't': '{{{{ inputs.key }}}}', 'v': f.key, 'g': asked}}, {{'a': 'key', 't': '{{{{ ' || f.step || '.key | short }}}}', 'v': f.key, 'g': left(f.key, 10)}}, {{'a': 'size', 't': 'small', 'v': f.size, 'g': 'small'}}]) AS x FROM f JOIN i USING (session)),
 d AS (SELECT trigger, step, x.a AS arg, x.t AS template, count(*) AS checked, count(*) FILTER (x.v = x.g) AS passed, min(x.g) != max(x.g) AS varies FROM r GROUP BY ALL),
 w2 AS (SELECT *, CASE WHEN passed < checked THEN 'differs' WHEN contains(template, '{{{{') AND NOT varies AND checked > 1 THEN 'constant' ELSE 'reproduced' END AS why FROM d)
 SELECT trigger, step, arg, template, checked, passed, why = 'reproduced' AS accepted, why FROM w2 UNION ALL SELECT DISTINCT trigger, tool, 'other', 'x', 0, 0, false, 'never passed' FROM w""",
    "rendered_sentences": "SELECT c_custkey, c_name || ' of ' || regexp_replace(n_name || '_x', '[_-]+', ' ', 'g') || ', -' || left(c_name, 10) || '/' || c_name AS value FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "dependency_order": _dependency_sql(),
    "positioned_values": """WITH s AS (SELECT CAST(s_nationkey % 5 AS VARCHAR) AS step, unnest([{'arg': 'nation', 'value': replace(n_name, ' ', '_')}, {'arg': 'balance', 'value': printf('%.2f', s_acctbal)}, {'arg': 'name', 'value': s_name}]) AS x FROM supplier JOIN nation ON s_nationkey = n_nationkey)
 SELECT step, x.arg AS arg, x.value AS value, count(*) AS n FROM s WHERE step IN (SELECT step FROM s GROUP BY 1 HAVING count(*) > 3) GROUP BY ALL""",
}
