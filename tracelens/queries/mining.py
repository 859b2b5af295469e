"""Episodes, sequences, bindings and dataflow over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.operators import binding, dataflow, episodes, sequences

from .tables import CALLS, EPISODE, RUNS, calls, read

ORDER = ["ts", "event_id"]


def _runs(spark, sf_dir):
    return episodes.run_collapse(calls(spark, sf_dir), EPISODE, ORDER, "tool")


def run_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir)


def calls_per_token(spark, sf_dir):
    return calls(spark, sf_dir).groupBy("tool").agg(F.count("*").alias("n"))


def _grams(spark, sf_dir):
    lists = episodes.token_lists(_runs(spark, sf_dir), EPISODE)
    return sequences.ngrams(lists, EPISODE)


def ngram_support(spark, sf_dir):
    s = sequences.support(_grams(spark, sf_dir), EPISODE)
    return s.select(F.array_join("seq", ">").alias("seq"), F.col("n").cast("long").alias("n"), "support", "saving", "fanout")


def seq_closed_patterns(spark, sf_dir):
    s = sequences.ranked(sequences.closed(sequences.support(_grams(spark, sf_dir), EPISODE)))
    return s.select(F.array_join("seq", ">").alias("seq"), F.col("n").cast("long").alias("n"), "support", "saving", "fanout", "rank")


GRAMS = (
    RUNS
    + """, lists AS (SELECT user_id, day, list(token ORDER BY pos) AS t, list(start_idx ORDER BY pos) AS s, list(end_idx ORDER BY pos) AS e, list(CAST(fanout AS INT) ORDER BY pos) AS f FROM runs GROUP BY user_id, day),
 starts AS (SELECT *, unnest(range(1, CAST(len(t) AS BIGINT))) AS i FROM lists WHERE len(t) >= 2),
 grams AS (SELECT user_id, day, i, unnest(range(2, CAST(least(40, len(t) - i + 1) AS BIGINT) + 1)) AS n, t, s, e, f FROM starts),
 g AS (SELECT user_id, day, i, n, array_to_string(t[i:i+n-1], '>') AS seq, e[i+n-1] - s[i] AS span, f[i:i+n-1] AS fan FROM grams),
 firsts AS (SELECT user_id, day, seq, n, min_by(span, i) AS span FROM g GROUP BY user_id, day, seq, n),
 fans AS (SELECT seq, string_agg(CAST(b AS VARCHAR), '' ORDER BY p) AS fanout FROM (SELECT seq, p, max(b) AS b FROM (SELECT seq, unnest(fan) AS b, unnest(range(1, n + 1)) AS p FROM g) GROUP BY seq, p) GROUP BY seq),
 sup AS (SELECT seq, n, count(*) AS support, sum(span) AS saving FROM firsts GROUP BY seq, n),
 full_sup AS (SELECT sup.*, fanout FROM sup JOIN fans USING (seq))"""
)
SQL_NGRAM = f"WITH {GRAMS} SELECT seq, n, support, CAST(saving AS BIGINT) AS saving, fanout FROM full_sup"
SQL_CLOSED = f"""WITH {GRAMS}, freq AS (SELECT * FROM full_sup WHERE support >= 2),
 closed AS (SELECT * FROM freq a WHERE NOT EXISTS (SELECT 1 FROM freq b WHERE b.support = a.support AND b.n = a.n + 1 AND (b.seq LIKE a.seq || '>%' OR b.seq LIKE '%>' || a.seq)))
 SELECT seq, n, support, CAST(saving AS BIGINT) AS saving, fanout, row_number() OVER (ORDER BY -support * n, -support, -saving, string_split(seq, '>')) AS rank FROM closed"""


def _turns(spark, sf_dir):
    return episodes.prompt_index(read(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.col("role") == "user")


def prompt_index(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", "prompt_index")


def result_per_prompt(spark, sf_dir):
    r = episodes.result_per_prompt(_turns(spark, sf_dir), ["conv_id"], ["turn"], "text", F.col("role") == "assistant")
    return r.select("conv_id", "prompt_index", F.md5("result").alias("result"))


TURNS = "t AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pi FROM conversations)"


def ordered_prompts(spark, sf_dir):
    users = read(spark, sf_dir, "conversations").where("role = 'user'")
    p = sequences.ordered_distinct(users, ["conv_id"], "text", ["turn"], 6)
    return p.select("conv_id", F.size("values").cast("long").alias("n"), F.md5(F.array_join("values", "|")).alias("prompts"))


def episode_numbers(spark, sf_dir):
    return episodes.episode_numbers(calls(spark, sf_dir), ["user_id"], "day")


def parent_anti_join(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("session"), F.lit(None).cast("long").alias("parent"))
    parts = read(spark, sf_dir, "labels").select((F.col("doc_id") + 1_000_000_000).alias("session"), F.col("doc_id").alias("parent"))
    return episodes.drop_split_parents(docs.unionByName(parts), "session", "parent").select("session")


def active_session(spark, sf_dir):
    tool = F.col("tool")
    return episodes.while_active(calls(spark, sf_dir), ["user_id"], ORDER, tool == "purchase", tool != "click").select("event_id")


def resequence(spark, sf_dir):
    c = calls(spark, sf_dir).withColumn("agent", F.when(F.col("tool") == "view", "main").otherwise("sub"))
    return episodes.resequence(c, ["user_id", "day"], "ts", "agent", tie=["event_id"]).select("event_id", "seq")


def as_of_prompt(spark, sf_dir):
    c = calls(spark, sf_dir)
    left = c.where("tool = 'error'").select("user_id", "ts", "event_id")
    right = c.where("tool = 'view'").select("user_id", "ts", "event_id", F.col("event_id").alias("view_id"))
    return episodes.as_of(left, right, ["user_id"], "ts", "ts", "view_id", "event_id").select("event_id", "as_of_view_id")


def pair_results(spark, sf_dir):
    c = calls(spark, sf_dir)
    uses = c.where("tool = 'click'").groupBy("user_id", "day", "k").agg(F.min("event_id").alias("use_id"))
    results = c.where("tool = 'view'").select("user_id", "day", "k", F.col("event_id").alias("result_id"))
    return episodes.pair_results(uses, results, ["user_id", "day", "k"], "result_id")


def step_names(spark, sf_dir):
    c = calls(spark, sf_dir)
    return episodes.step_names(c, EPISODE, "tool", "event_id").select("event_id", "step")


def slice_calls(spark, sf_dir):
    c = calls(spark, sf_dir)
    return episodes.slice_calls(c, c.where("value > 50").select(*EPISODE, "event_id"), EPISODE, "event_id").select("event_id", "seq")


def _candidates(spark, sf_dir):
    c = calls(spark, sf_dir)
    return c.select(
        *EPISODE, F.col("event_id").alias("at"), F.col("k").alias("value"), F.when(F.col("tool") == "signup", "input").when(F.col("tool") == "view", "ids:k").otherwise("copy").alias("kind"),
        (F.col("tool") == "click").alias("in_list"), (F.col("event_id") % 2 == 0).alias("first"), F.col("tool").alias("source"), F.lit("k").alias("name"))


def bound_calls(spark, sf_dir):
    args = calls(spark, sf_dir).select(*EPISODE, F.col("event_id").alias("at"), F.lit("k").alias("arg"), F.col("k").alias("value"))
    return binding.bind(args, _candidates(spark, sf_dir), EPISODE)


def bind_values(spark, sf_dir):
    return bound_calls(spark, sf_dir).select("at", "kind", "src", "source")


BIND_ALL = (
    CALLS
    + """, cand AS (SELECT user_id, day, event_id AS src, k AS v, tool AS source, CASE tool WHEN 'signup' THEN 'input' WHEN 'view' THEN 'ids:k' ELSE 'copy' END AS kind,
   tool = 'click' AS in_list, CASE WHEN tool = 'click' AND event_id % 2 != 0 THEN 4 WHEN tool = 'signup' THEN 0 WHEN tool = 'view' THEN 2 ELSE 1 END AS o FROM calls),
 args AS (SELECT user_id, day, event_id AS at, k AS v, tool FROM calls),
 best AS (SELECT a.at, c.src, c.kind, c.source, row_number() OVER (PARTITION BY a.at ORDER BY c.o, c.in_list, c.src) AS r FROM args a JOIN cand c ON a.user_id = c.user_id AND a.day = c.day AND a.v = c.v AND c.src < a.at)"""
)


def bind_windows(spark, sf_dir):
    c = calls(spark, sf_dir).select(*EPISODE, F.col("event_id").alias("at"), F.date_trunc("minute", "ts").cast("timestamp").alias("t"), "tool")
    return binding.bind_windows(c.where("tool = 'error'"), c.where("tool != 'error'"), EPISODE).select("at", "src", F.col("round"), "delta")


def session_windows(spark, sf_dir):
    """The times of a day's errors held against one field of the day: the minutes, or the quarters of an hour, of its other calls."""
    c = calls(spark, sf_dir).select(*EPISODE, F.col("event_id").alias("at"), F.date_trunc("minute", "ts").cast("timestamp").alias("t"), "tool", "ts")
    quarter = F.timestamp_seconds(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 900) * 900)
    other = c.where("tool != 'error'")
    anchors = other.select(*EPISODE, "at", F.lit("minute").alias("path"), F.lit(False).alias("in_list"), "t").unionByName(other.select(*EPISODE, "at", F.lit("quarters[*]").alias("path"), F.lit(True).alias("in_list"), quarter.alias("t")))
    return binding.session_windows(c.where("tool = 'error'").select(*EPISODE, "at", F.lit("from").alias("arg"), "t"), anchors, EPISODE).drop("day", "user_id", "arg")


def _edges(spark, sf_dir):
    """A call binds to the call before it of the same episode: source tool, its argument as type, target tool."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*EPISODE).orderBy(*ORDER)
    c = calls(spark, sf_dir).withColumn("source", F.lag("tool").over(w)).withColumn("src", F.lag("event_id").over(w))
    v = F.when(F.col("k").cast("int") % 2 == 0, "even").otherwise("odd")
    return c.where("source is not null").select(*EPISODE, "source", v.alias("value_type"), F.col("tool").alias("target"), F.col("event_id").alias("call"), F.col("src"))


def frequent_edges(spark, sf_dir):
    return dataflow.frequent_edges(_edges(spark, sf_dir), EPISODE, 3)


EDGES = (
    CALLS
    + """, edges AS (SELECT * FROM (SELECT user_id, day, lag(tool) OVER w AS source, lag(event_id) OVER w AS src, CASE WHEN CAST(k AS INT) % 2 = 0 THEN 'even' ELSE 'odd' END AS value_type, tool AS target, event_id AS call
   FROM calls WINDOW w AS (PARTITION BY user_id, day ORDER BY ts, event_id)) WHERE source IS NOT NULL)"""
)


def closed_edge_sets(spark, sf_dir):
    """The closed sets of all frequent edges."""
    e = _edges(spark, sf_dir)
    s = dataflow.closed_edge_lists(e, dataflow.numbered(dataflow.frequent_edges(e, EPISODE, 3)), EPISODE, 3)
    return s.select(F.array_join("edges", "; ").alias("edges"), F.size("edges").cast("long").alias("n"), "support")


def top_closed_edge_sets(spark, sf_dir):
    """The twelve best of the closed sets, and whether there are more."""
    e = _edges(spark, sf_dir)
    s, left_out = dataflow.top_closed_edge_lists(e, dataflow.numbered(dataflow.frequent_edges(e, EPISODE, 3)), EPISODE, 12, 3)
    return s.select(F.array_join("edges", "; ").alias("edges"), F.size("edges").cast("long").alias("n"), "support").withColumn("left_out", F.lit(left_out))


SQL_CLOSED_SETS = f"""WITH RECURSIVE {EDGES}, f AS (SELECT source, value_type, target, count(*) AS s FROM (SELECT DISTINCT user_id, day, source, value_type, target FROM edges) GROUP BY ALL HAVING count(*) >= 3),
 num AS (SELECT *, row_number() OVER (ORDER BY s DESC, source, value_type, target) - 1 AS bit FROM f),
 m AS (SELECT user_id, day, CAST(sum(CAST(1 AS HUGEINT) << bit) AS HUGEINT) AS mask FROM (SELECT DISTINCT user_id, day, bit FROM edges JOIN num USING (source, value_type, target)) GROUP BY user_id, day),
 b AS (SELECT mask, count(*) AS n FROM m GROUP BY mask),
 c AS (SELECT mask FROM b UNION SELECT c.mask & b.mask FROM c, b WHERE c.mask & b.mask != 0),
 k AS (SELECT c.mask, CAST(sum(b.n) AS BIGINT) AS support FROM c JOIN b ON b.mask & c.mask = c.mask GROUP BY c.mask HAVING sum(b.n) >= 3)
 SELECT string_agg(source || ' --' || value_type || '--> ' || target, '; ' ORDER BY bit) AS edges, count(*) AS n, any_value(support) AS support
 FROM k JOIN num ON k.mask & (CAST(1 AS HUGEINT) << bit) != 0 GROUP BY k.mask"""


SQL_TOP_SETS = SQL_CLOSED_SETS.rsplit("\n SELECT string_agg", 1)[0] + """,
 t AS (SELECT mask, support, row_number() OVER (ORDER BY support DESC, bit_count(mask), mask) AS r, count(*) OVER () > 12 AS left_out FROM k)
 SELECT string_agg(source || ' --' || value_type || '--> ' || target, '; ' ORDER BY bit) AS edges, count(*) AS n, any_value(support) AS support, any_value(left_out) AS left_out
 FROM t JOIN num ON t.mask & (CAST(1 AS HUGEINT) << bit) != 0 WHERE r <= 12 GROUP BY t.mask"""


def participating_calls(spark, sf_dir):
    e = _edges(spark, sf_dir)
    seeds = e.where("target = 'error'").select(*EPISODE, "call")
    deps = e.where("value_type = 'even'").select(*EPISODE, "call", F.col("src").alias("source"))
    return dataflow.participating_calls(seeds, deps, EPISODE).select("call")


def graph_layers(spark, sf_dir):
    """Customers, their orders and the suppliers of these, as a graph of three layers."""
    o = read(spark, sf_dir, "orders").select(F.concat(F.lit("customer "), F.col("o_custkey").cast("string")).alias("source"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("target"))
    l = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("source"), F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string")).alias("target"))  # noqa: E741
    return dataflow.layers(o.unionByName(l).distinct())


QUERIES = {
    f.__name__: f
    for f in (
        run_collapse, calls_per_token, ngram_support, seq_closed_patterns, prompt_index, result_per_prompt, ordered_prompts, episode_numbers, parent_anti_join, active_session, resequence,
        as_of_prompt, pair_results, step_names, slice_calls, bind_values, bind_windows, session_windows, frequent_edges, closed_edge_sets, top_closed_edge_sets, participating_calls, graph_layers,
    )
}
ORACLE_SQL = {
    "run_collapse": f"WITH {RUNS} SELECT * FROM runs",
    "calls_per_token": "SELECT event_type AS tool, count(*) AS n FROM events GROUP BY 1",
    "ngram_support": SQL_NGRAM,
    "seq_closed_patterns": SQL_CLOSED,
    "prompt_index": f"WITH {TURNS} SELECT conv_id, turn, CAST(pi AS BIGINT) AS prompt_index FROM t",
    "result_per_prompt": f"WITH {TURNS} SELECT conv_id, CAST(pi AS BIGINT) AS prompt_index, md5(max_by(text, turn)) AS result FROM t WHERE role = 'assistant' AND pi >= 0 GROUP BY 1, 2",
    "ordered_prompts": """WITH f AS (SELECT conv_id, text, min(turn) AS o FROM conversations WHERE role = 'user' AND trim(text) != '' GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY o) AS n FROM f) SELECT conv_id, count(*) AS n, md5(string_agg(text, '|' ORDER BY n)) AS prompts FROM r WHERE n <= 6 GROUP BY 1""",
    "episode_numbers": "SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, dense_rank() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE)) AS episode FROM events",
    "parent_anti_join": "SELECT doc_id AS session FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id + 1000000000 FROM labels",
    "active_session": "SELECT event_id FROM (SELECT event_id, event_type, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a FROM events) WHERE event_type != 'click' OR a = 1",
    "resequence": "SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_type != 'view', event_id) AS seq FROM events",
    "as_of_prompt": """SELECT e.event_id, (SELECT v.event_id FROM events v WHERE v.event_type = 'view' AND v.user_id = e.user_id AND v.ts <= e.ts ORDER BY v.ts DESC, v.event_id DESC LIMIT 1) AS as_of_view_id
 FROM events e WHERE e.event_type = 'error'""",
    "pair_results": f"""WITH {CALLS}, u AS (SELECT user_id, day, k, min(event_id) AS use_id FROM calls WHERE tool = 'click' GROUP BY 1, 2, 3), r AS (SELECT user_id, day, k, min(event_id) AS result_id FROM calls WHERE tool = 'view' GROUP BY 1, 2, 3)
 SELECT * FROM u JOIN r USING (user_id, day, k)""",
    "step_names": f"WITH {CALLS} SELECT event_id, tool || CASE WHEN n = 1 THEN '' ELSE '_' || n END AS step FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day, tool ORDER BY event_id) AS n FROM calls)",
    "slice_calls": f"WITH {CALLS} SELECT event_id, row_number() OVER (PARTITION BY user_id, day ORDER BY event_id) AS seq FROM calls WHERE value > 50",
    "bind_values": f"WITH {BIND_ALL} SELECT a.at, coalesce(b.kind, 'unresolved') AS kind, b.src, b.source FROM args a LEFT JOIN (SELECT * FROM best WHERE r = 1) b ON a.at = b.at",
    "bind_windows": f"""WITH {CALLS}, c AS (SELECT user_id, day, event_id, tool, date_trunc('minute', ts) AS t FROM calls),
 p AS (SELECT e.event_id AS "at", a.event_id AS src, epoch(e.t) - epoch(a.t) AS d0, epoch(e.t) - epoch(date_trunc('day', a.t)) AS d1, epoch(e.t) - epoch(date_trunc('hour', a.t)) AS d2,
   date_trunc('day', a.t) != a.t AS m1, date_trunc('hour', a.t) != a.t AS m2 FROM c e JOIN c a ON e.user_id = a.user_id AND e.day = a.day AND a.event_id < e.event_id WHERE e.tool = 'error' AND a.tool != 'error'),
 o AS (SELECT "at", src, CASE WHEN d0 % 900 = 0 THEN 0 WHEN m1 AND d1 % 86400 = 0 THEN 1 WHEN m2 AND d2 % 1800 = 0 THEN 2 END AS n, d0, d1, d2 FROM p)
 SELECT "at", src, ['exact', '1d', '1h'][n + 1] AS round, CAST([d0, d1, d2][n + 1] AS BIGINT) AS delta FROM o WHERE n IS NOT NULL QUALIFY row_number() OVER (PARTITION BY "at" ORDER BY src, n) = 1""",
    "session_windows": f"""WITH {CALLS}, c AS (SELECT user_id, day, event_id, tool, date_trunc('minute', ts) AS t, make_timestamp((epoch_us(ts) // 900000000) * 900000000) AS q FROM calls),
 a AS (SELECT user_id, day, event_id AS src, 'minute' AS path, false AS in_list, t AS a FROM c WHERE tool != 'error' UNION ALL SELECT user_id, day, event_id, 'quarters[*]', true, q FROM c WHERE tool != 'error'),
 p AS (SELECT e.user_id, e.day, e.event_id AS "at", src, path, in_list, a, epoch(e.t) - epoch(a) AS d0, epoch(e.t) - epoch(date_trunc('day', a)) AS d1, epoch(e.t) - epoch(date_trunc('hour', a)) AS d2, date_trunc('day', a) != a AS m1, date_trunc('hour', a) != a AS m2
   FROM c e JOIN a ON e.user_id = a.user_id AND e.day = a.day AND src < e.event_id WHERE e.tool = 'error'),
 o AS (SELECT * FROM (SELECT *, CASE WHEN d0 % 900 = 0 THEN 0 WHEN m1 AND d1 % 86400 = 0 THEN 1 WHEN m2 AND d2 % 1800 = 0 THEN 2 END AS n FROM p) WHERE n IS NOT NULL),
 f AS (SELECT user_id, day, src, path FROM o QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY src, in_list, a, path) = 1)
 SELECT "at", src, path, ['exact', '1d', '1h'][n + 1] AS round, CAST([d0, d1, d2][n + 1] AS BIGINT) AS delta, CASE WHEN [d0, d1, d2][n + 1] <= 0 THEN 'start' ELSE 'end' END AS side FROM o JOIN f USING (user_id, day, src, path)
 QUALIFY row_number() OVER (PARTITION BY "at" ORDER BY n, abs([d0, d1, d2][n + 1])) = 1""",
    "frequent_edges": f"WITH {EDGES} SELECT source, value_type, target, count(*) AS support FROM (SELECT DISTINCT user_id, day, source, value_type, target FROM edges) GROUP BY ALL HAVING count(*) >= 3",
    "closed_edge_sets": SQL_CLOSED_SETS,
    "top_closed_edge_sets": SQL_TOP_SETS,
    "participating_calls": f"""WITH RECURSIVE {EDGES}, r AS (SELECT user_id, day, call FROM edges WHERE target = 'error' UNION SELECT r.user_id, r.day, e.src FROM r JOIN edges e ON e.call = r.call AND e.user_id = r.user_id AND e.day = r.day WHERE e.value_type = 'even')
 SELECT call FROM r""",
    "graph_layers": """WITH RECURSIVE e AS (SELECT 'customer ' || o_custkey AS a, 'order ' || o_orderkey AS b FROM orders UNION SELECT 'order ' || l_orderkey, 'supplier ' || l_suppkey FROM lineitem),
 n AS (SELECT a AS node FROM e UNION SELECT b FROM e), l AS (SELECT node, 0 AS layer FROM n WHERE node NOT IN (SELECT b FROM e) UNION SELECT e.b, l.layer + 1 FROM l JOIN e ON l.node = e.a)
 SELECT node, CAST(max(layer) AS BIGINT) AS layer FROM l GROUP BY 1""",
}
