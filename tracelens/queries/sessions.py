"""Sessions, composite bindings and the graphs mined from them, and names for people, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelens.functions import display
from tracelens.operators import binding, composites, dataflow, sessions

from .mining import BIND_ALL, bound_calls
from .tables import CALLS, EPISODE, calls, read

EDGES = f"WITH {BIND_ALL}, edges AS (SELECT a.user_id, a.day, b.source, CASE WHEN b.kind = 'copy' THEN 'copy:k' ELSE b.kind END AS value_type, a.tool AS target, a.at AS call, b.src FROM args a JOIN (SELECT * FROM best WHERE r = 1) b ON a.at = b.at)"


def call_edges(spark, sf_dir):
    """Each call's argument bound to an earlier call of its episode, as an edge between tools."""
    return _edges(spark, sf_dir).select("user_id", "day", "source", "value_type", "target", "call", "src")


def _edges(spark, sf_dir):
    tools = calls(spark, sf_dir).select(F.col("event_id").alias("at"), "tool")
    bound = bound_calls(spark, sf_dir).join(tools, "at")
    return binding.edges(bound, EPISODE, "tool").withColumnRenamed("at", "call")


def bound_edges(spark, sf_dir):
    """Frequent edges of the bindings, not of neighbours."""
    return dataflow.frequent_edges(_edges(spark, sf_dir), EPISODE, 3)


def flow_graphs(spark, sf_dir):
    """Calls, their bindings, edges, connected closed graphs and their ranks, in one go."""
    g = dataflow.graph_candidates(_edges(spark, sf_dir), EPISODE, 3)
    return g.select("rank", F.array_join("edges", "; ").alias("edges"), "n", "support", "saving", "rooted", "truncated")


def composite_bindings(spark, sf_dir):
    """Sentences about a key, bound to the earlier call that had it."""
    c = calls(spark, sf_dir)
    key = F.concat(F.lit("key-"), "k")
    cand = c.select(*EPISODE, F.col("event_id").alias("at"), key.alias("value"), F.lit("copy").alias("kind"), F.lit(False).alias("in_list"), F.lit(True).alias("first"), F.col("tool").alias("source"), F.lit("k").alias("name"))
    args = c.select(*EPISODE, F.col("event_id").alias("at"), F.lit("q").alias("arg"), F.concat(F.lit("find "), key, F.lit(" of x"), key).alias("value"))
    return composites.bind_composite(args, cand, EPISODE).select("at", "template", F.size("kinds").cast("long").alias("n"))


def quoted_values(spark, sf_dir):
    """Words of an assistant's turn that later turns of the user hold as whole tokens."""
    c = read(spark, sf_dir, "conversations")
    words = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{7,}"), F.lit(0))))
    cand = c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("at"), words.alias("value"), F.lit("copy").alias("kind"), F.lit(False).alias("in_list"), F.lit(True).alias("first"), F.lit("a").alias("source"), F.lit("w").alias("name"))
    args = c.where("role = 'user'").select("conv_id", F.col("turn").alias("at"), F.lit("text").alias("arg"), F.col("text").alias("value"))
    return composites.contained(args, cand, ["conv_id"]).select("conv_id", "at", "part", "src")


def carried_values(spark, sf_dir):
    """Long words of each turn, and the latest earlier turn that has them; the first turn stands for the inputs."""
    c = read(spark, sf_dir, "conversations").where("text is not null")
    words = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z]{8,}"), F.lit(0))))
    parts = c.where("turn > 0").select("conv_id", F.col("turn").alias("at"), words.alias("value"))
    return sessions.carried_values(parts, c.where("turn > 0").select("conv_id", F.col("turn").alias("at"), "text"), c.where("turn = 0").select("conv_id", "text"), ["conv_id"])


def hook_join(spark, sf_dir):
    """Calls of the hook against those that the transcript has (all but the errors), and the counts by user."""
    c = calls(spark, sf_dir)
    tx = c.where("tool != 'error'").select("user_id", F.col("event_id").alias("use"), F.col("event_id").alias("seq"), F.col("tool").alias("agent"), F.col("event_id").alias("prompt_index"))
    _, counts = sessions.join_hook_calls(c.select("user_id", F.col("event_id").alias("use")), tx, ["user_id"], "use")
    return counts


def failed_runs(spark, sf_dir):
    """The lines of each order up to the first one that was returned."""
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    return sessions.until_failure(l, ["l_orderkey"], "l_linenumber", F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber", "status")


def window_choice(spark, sf_dir):
    c = calls(spark, sf_dir).select("k", F.col("user_id").alias("session"), F.col("tool").alias("template"), F.length("tool").alias("width"))
    return sessions.window_choice(c, ["k"])


def template_references(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    text = F.concat(F.lit("{{ inputs.key }} x {{ step"), (F.col("o_custkey") % 7).cast("string"), F.lit(".ids | first }} {{ item }} {{step_"), F.lower("o_orderstatus"), F.lit(".k }}"))
    return sessions.template_references(o.select("o_orderkey", F.lit("s").alias("step"), text.alias("text")), ["o_orderkey"])


def step_calls(spark, sf_dir):
    """Every event with the latest step (a view) of its user that does not begin after it."""
    c = calls(spark, sf_dir)
    steps = c.where("tool = 'view'").select("user_id", F.col("event_id").alias("idx"), F.concat(F.lit("view-"), "k").alias("step"))
    return sessions.step_calls(steps, c.select("user_id", F.col("event_id").alias("idx")), ["user_id"]).select("idx", "step")


def display_types(spark, sf_dir):
    e = calls(spark, sf_dir)
    kind = F.element_at(F.array(*[F.lit(x) for x in ("window", "ids:trace_id", "copy:thread_ids", "catalog-attr:service.team", "regex:status", "input", "copy:boxes_2")]), (F.col("event_id") % 7 + 1).cast("int"))
    name = F.element_at(F.array(*[F.lit(x) for x in ("entries", "keys", "status", "x_3", "")]), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select("event_id", display.display_type(kind, name).alias("shown"), display.plural(display.singular(name)).alias("many"))


def time_spans(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    l = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_shipdate", "l_quantity")  # noqa: E741
    end = F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + F.col("l_quantity").cast("long") * 137 - 300)
    return o.join(l, "o_orderkey").select("o_orderkey", "l_linenumber", display.minutes_text(F.col("o_orderdate").cast("timestamp"), end).alias("span"))


def repeat_phrases(spark, sf_dir):
    o = read(spark, sf_dir, "orders").where("o_custkey is not null")
    key = lambda c: F.concat(F.lit("PAY-"), c.cast("string"))
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("It looks like "), key(F.col("o_custkey")), F.lit(" to me"))).when(F.col("o_orderkey") % 3 == 1, F.concat(key(F.col("o_orderkey")), F.lit(" again, sigh"))).otherwise(F.lit("nothing"))
    return o.select("o_orderkey", display.repeat_of(text, key(F.col("o_orderkey") - 3)).alias("repeat_of"))


def parsed_times(spark, sf_dir):
    """Each event's time written in one of five ways, read again."""
    e = read(spark, sf_dir, "events")
    t = F.col("ts").cast("timestamp")
    way = F.col("event_id") % 5
    text = F.when(way == 0, F.date_format(t, "yyyy-MM-dd")).when(way == 1, F.unix_timestamp(t).cast("string")).when(way == 2, F.concat(F.lit("now-"), F.col("event_id").cast("string"), F.lit("m"))).when(way == 3, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.lit("soon"))
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return e.select("event_id", F.unix_timestamp(display.parse_time(text, now)).alias("at"))


def markable_values(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    v = F.when(F.col("page_id") % 4 == 0, F.lit("2024-01-31T10:00:00Z")).when(F.col("page_id") % 4 == 1, F.lit(" None ")).when(F.col("page_id") % 4 == 2, F.concat(F.lit("  "), "url")).otherwise(F.lit("ab"))
    return p.select("page_id", display.markable(v).alias("shown"))


def trusted_flows(spark, sf_dir):
    """The three most trusted flows: a status by market segment, versions by account."""
    c = read(spark, sf_dir, "customer")
    status = F.when(F.col("c_mktsegment") == "BUILDING", "promoted").when(F.col("c_mktsegment") == "MACHINERY", "candidate").otherwise("draft")
    return c.orderBy(*display.trust_order(status, F.col("c_nationkey").cast("string"), F.col("c_custkey"))).limit(3).select("c_custkey")


QUERIES = {
    f.__name__: f
    for f in (
        call_edges, bound_edges, flow_graphs, composite_bindings, quoted_values, carried_values, hook_join, failed_runs, window_choice, template_references, step_calls, display_types, time_spans, repeat_phrases,
        parsed_times, markable_values, trusted_flows,
    )
}
_SINGULAR = "CASE WHEN len(n) > 4 AND n LIKE '%ies' THEN left(n, len(n) - 3) || 'y' WHEN len(n) > 4 AND regexp_matches(n, '(s|x|z|ch|sh)es$') THEN left(n, len(n) - 2) WHEN len(n) > 3 AND n LIKE '%s' AND NOT regexp_matches(n, '(ss|us|is|ts)$') THEN left(n, len(n) - 1) ELSE n END"
ORACLE_SQL = {
    "call_edges": f"{EDGES} SELECT * FROM edges",
    "bound_edges": f"{EDGES} SELECT source, value_type, target, count(*) AS support FROM (SELECT DISTINCT user_id, day, source, value_type, target FROM edges) GROUP BY ALL HAVING count(*) >= 3",
    "composite_bindings": f"""WITH {CALLS}, f AS (SELECT a.event_id, min_by(b.tool, b.event_id) AS tool FROM calls a JOIN calls b ON a.user_id = b.user_id AND a.day = b.day AND a.k = b.k AND b.event_id < a.event_id GROUP BY 1)
 SELECT c.event_id AS "at", CASE WHEN f.tool IS NOT NULL THEN 'find {{{{ ' || f.tool || '.k }}}} of xkey-' || c.k END AS template, CAST(CASE WHEN f.tool IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n FROM calls c LEFT JOIN f USING (event_id)""",
    "quoted_values": r"""WITH w AS (SELECT DISTINCT conv_id, turn AS src, unnest(regexp_extract_all(text, '[A-Za-z]{7,}')) AS part FROM conversations WHERE role = 'assistant')
 SELECT u.conv_id, u.turn AS "at", part, src FROM conversations u JOIN w ON w.conv_id = u.conv_id AND src < u.turn AND contains(u.text, part) AND u.text != part WHERE role = 'user' AND regexp_matches(u.text, '(^|[^\p{L}\p{N}_-])' || part || '($|[^\p{L}\p{N}_-])')""",
    "carried_values": """WITH c AS (SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL), v AS (SELECT DISTINCT conv_id, turn AS t, unnest(regexp_extract_all(text, '[a-z]{8,}')) AS value FROM c WHERE turn > 0),
 s AS (SELECT v.*, EXISTS (SELECT 1 FROM c WHERE c.conv_id = v.conv_id AND turn = 0 AND list_contains(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), value)) AS given,
   (SELECT max(turn) FROM c WHERE c.conv_id = v.conv_id AND turn > 0 AND turn < v.t AND list_contains(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), value)) AS src FROM v)
 SELECT conv_id, t AS "at", value, CASE WHEN given THEN 'inputs' ELSE 'c' || src END AS source FROM s WHERE given OR src IS NOT NULL""".replace("\\\\", "\\"),
    "hook_join": f"WITH {CALLS} SELECT user_id, count(*) FILTER (tool != 'error') AS joined, count(*) FILTER (tool = 'error') AS unjoined FROM calls GROUP BY 1",
    "failed_runs": """WITH f AS (SELECT l_orderkey, min(l_linenumber) FILTER (l_returnflag = 'R') AS f FROM lineitem GROUP BY 1)
 SELECT l_orderkey, l_linenumber, CASE WHEN f IS NULL THEN 'ok' ELSE 'failed' END AS status FROM lineitem JOIN f USING (l_orderkey) WHERE f IS NULL OR l_linenumber <= f""",
    "window_choice": f"""WITH {CALLS}, n AS (SELECT k, tool, count(DISTINCT user_id) AS s FROM calls GROUP BY 1, 2)
 SELECT k, arg_min(tool, (-s, -len(tool), tool)) AS template, arg_min(s, (-s, -len(tool), tool)) AS sessions, count(*) AS variants FROM n GROUP BY 1""",
    "template_references": """SELECT o_orderkey, 'inputs' AS source, 'inputs.key' AS ref, 's' AS target FROM orders UNION ALL SELECT o_orderkey, 'step' || (o_custkey % 7), 'step' || (o_custkey % 7) || '.ids', 's' FROM orders WHERE o_custkey IS NOT NULL
 UNION ALL SELECT o_orderkey, 'step_' || lower(o_orderstatus), 'step_' || lower(o_orderstatus) || '.k', 's' FROM orders""",
    "step_calls": f"""WITH {CALLS} SELECT event_id AS idx, last_value(CASE WHEN tool = 'view' THEN 'view-' || k END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS step FROM calls""",
    "display_types": f"""WITH e AS (SELECT event_id, ['window', 'ids:trace_id', 'copy:thread_ids', 'catalog-attr:service.team', 'regex:status', 'input', 'copy:boxes_2'][event_id % 7 + 1] AS vt, regexp_replace(['entries', 'keys', 'status', 'x_3', ''][event_id % 5 + 1], '_\\d+$', '') AS n FROM events),
 s AS (SELECT event_id, vt, {_SINGULAR} AS one FROM e)
 SELECT event_id, CASE vt WHEN 'window' THEN 'window' WHEN 'ids:trace_id' THEN 'trace_id' WHEN 'copy:thread_ids' THEN 'thread_id' WHEN 'catalog-attr:service.team' THEN 'team' WHEN 'regex:status' THEN 'status' WHEN 'copy:boxes_2' THEN 'box' ELSE CASE WHEN one != '' THEN one ELSE 'input' END END AS shown,
 one || CASE WHEN one LIKE '%s' THEN '_list' ELSE 's' END AS many FROM s""",
    "time_spans": """WITH m AS (SELECT o_orderkey, l_linenumber, CAST(floor((CAST(trunc(l_quantity) AS BIGINT) * 137 - 300) / 60) AS BIGINT) AS m FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
 SELECT o_orderkey, l_linenumber, CASE WHEN m >= 60 THEN (m // 60) || 'h ' || lpad(CAST(m % 60 AS VARCHAR), 2, '0') || 'm' WHEN m >= 0 THEN m || 'm' END AS span FROM m""",
    "repeat_phrases": """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CASE WHEN o_custkey != o_orderkey - 3 THEN 'PAY-' || o_custkey END WHEN 1 THEN 'PAY-' || o_orderkey END AS repeat_of FROM orders WHERE o_custkey IS NOT NULL""",
    "parsed_times": """SELECT event_id, CAST(CASE event_id % 5 WHEN 0 THEN epoch(date_trunc('day', ts)) WHEN 1 THEN floor(epoch(ts)) WHEN 2 THEN epoch(TIMESTAMP '2024-02-01') - event_id * 60 WHEN 3 THEN floor(epoch(ts)) END AS BIGINT) AS "at" FROM events""",
    "markable_values": "SELECT page_id, CASE WHEN page_id % 4 = 2 AND len(url) BETWEEN 3 AND 80 THEN trim(url) END AS shown FROM pages",
    "trusted_flows": "SELECT c_custkey FROM customer ORDER BY CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE 2 END, CAST(c_nationkey AS VARCHAR), -c_custkey LIMIT 3",
}
