"""Steps of investigations, reports on them, and promotion state, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.functions import text
from tracelens.operators import cards, expansion, lifecycle, reports
from tracelens.plans import steps

from .tables import CALLS, EPISODE, calls, read


def ladder_first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of an order by rungs that ask for less each time: large returned ones, large ones, all."""
    o, l = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")  # noqa: E741
    big, back = F.col("l_quantity") > 40, F.col("l_returnflag") == "R"
    found = l.groupBy("l_orderkey").agg(F.count_if(big & back).alias("h0"), F.count_if(big).alias("h1"), F.count("*").alias("h2"))
    base = o.join(found, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", *[F.coalesce(f"h{i}", F.lit(0)).alias(f"h{i}") for i in range(3)])
    values = ["returned", "large", "all"]
    rungs = [base.select("o_orderkey", F.when(F.lit(i == 1) & (F.col("o_orderkey") % 5 == 0), F.lit(" ")).otherwise(F.lit(values[i])).alias("value"), F.col(f"h{i}").alias("hits")) for i in range(3)]
    return steps.ladder(rungs, ["o_orderkey"])


def foreach_fanout(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("p"))  # noqa: E741
    items = l.select("l_orderkey", F.transform("p", lambda x: F.when(x["l_partkey"] % 7 != 0, x["l_partkey"].cast("string"))).alias("items"))
    return steps.fan_out(items, "items", 3).select("l_orderkey", F.col("n").cast("long").alias("n"), "item")


def fan_in_status(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("hits"), F.when(F.col("l_returnflag") == "R", F.lit("gone")).alias("error"))  # noqa: E741
    return steps.fan_in(l, ["l_orderkey"], "hits", "error")


def when_filter(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    v = F.when(F.col("event_id") % 5 == 0, F.lit(" None ")).when(F.col("event_id") % 5 == 1, F.lit("0")).when(F.col("event_id") % 5 == 2, F.lit("[]")).when(F.col("event_id") % 5 == 3, F.lit(None).cast("string")).otherwise(F.col("event_type"))
    return e.where(text.truthy(v)).select("event_id")


def merge_extracts(spark, sf_dir):
    m = steps.merge_extracts(calls(spark, sf_dir), EPISODE, ["ts", "event_id"], "tool", "k")
    return m.select(*EPISODE, "tool", F.array_join("values", ",").alias("vals"))


def headline_first(spark, sf_dir):
    c = calls(spark, sf_dir).withColumn("v", F.when(F.col("tool") == "view", F.lit("")).when(F.col("tool") == "error", F.lit(None).cast("string")).otherwise(F.concat_ws(":", "tool", "k")))
    return steps.first_value(c, ["user_id"], ["ts", "event_id"], "v")


def cassette(spark, sf_dir):
    """Every call is either recorded or replayed."""
    c = calls(spark, sf_dir).withColumn("key", text.call_key(F.lit("srv"), F.col("tool"), F.create_map(F.lit("k"), F.col("k")))).withColumn("seq", F.col("event_id"))
    recorded = c.where("event_id % 2 = 0").select("key", "seq", F.col("event_id").alias("answer"))
    hits, misses = steps.replay(c.where("event_id % 2 != 0").select("event_id", "key"), recorded)
    return hits.select("event_id", "answer").unionByName(misses.select("event_id", F.lit(None).cast("long").alias("answer")))


def coverage(spark, sf_dir):
    c = calls(spark, sf_dir)
    s = c.groupBy("user_id", F.col("tool").alias("step")).agg(F.count_if(F.col("value") > 80).alias("hits"))
    expected = spark.createDataFrame([("opened", True, "view"), ("opened", True, "click"), ("bought", True, "purchase"), ("failed", False, "error")], "name string, required boolean, step string")
    return reports.coverage(expected, s, ["user_id"])


def evidence_dedup(spark, sf_dir):
    c = calls(spark, sf_dir)
    d = reports.without_repeats(c, ["user_id"], ["tool", "k"], ["ts", "event_id"], F.col("value") > 90)
    return d.select("user_id", "tool", "k", "event_id")


def log_summary(spark, sf_dir):
    return reports.log_summary(calls(spark, sf_dir).withColumn("at", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), ["user_id"], "at", {"tools": "tool"}).select("user_id", "n", "first", "last", "tools")


def majority_vote(spark, sf_dir):
    return reports.majority(calls(spark, sf_dir), ["user_id"], "tool", "event_id").select("user_id", "tool", "n")


def repeat_counts(spark, sf_dir):
    n = calls(spark, sf_dir).groupBy("user_id", "tool").agg(F.count("*").alias("n"))
    return reports.repeats(n, ["user_id"], "n")


def bindability(spark, sf_dir):
    kind = F.when(F.col("tool") == "view", "constant").when(F.col("tool") == "error", "unresolved").when(F.col("value") > 99, "authored").otherwise("derived")
    return reports.bindability(calls(spark, sf_dir).select(*EPISODE, kind.alias("kind")), EPISODE)


def value_provenance(spark, sf_dir):
    """Prompts that quote words of earlier answers."""
    c = read(spark, sf_dir, "conversations")
    words = c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("at"), F.explode(F.array_distinct(F.split("text", " "))).alias("value")).where(F.length("value") >= 6)
    uses = c.where("role = 'user'").select("conv_id", F.col("turn").alias("use"), F.col("turn").alias("at"), "text")
    return reports.provenance(words, uses, ["conv_id"])


def prompt_folding(spark, sf_dir):
    c = read(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("flow"), "event_id", F.concat(F.lit("Look at  PAY-"), F.col("event_id").cast("string"), F.lit(" "), "event_type").alias("t"))
    return reports.folded_prompts(c, ["flow"], text.folded(F.col("t")), "event_id", "t", 4)


def observed_values(spark, sf_dir):
    c = calls(spark, sf_dir).withColumn("ep", F.concat_ws("/", F.col("user_id").cast("string"), F.col("day").cast("string")))
    return reports.observed(c, ["tool"], "k", "ep")


def pending_feedback(spark, sf_dir):
    c = calls(spark, sf_dir)
    return c.where("tool = 'error'").join(c.where("tool = 'purchase'").select("user_id", "k").distinct(), ["user_id", "k"], "left_anti").select("event_id")


def ordered_union(spark, sf_dir):
    c = calls(spark, sf_dir)
    lists = c.groupBy("user_id").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("tool") == t, F.struct("event_id", "k")))), lambda s: s["k"]).alias(t) for t in ("view", "click")])
    return lists.select("user_id", F.array_join(F.array_distinct(F.concat("view", "click")), ",").alias("both"), F.array_join(F.array_except("view", "click"), ",").alias("only_view"))


def _outcomes(spark, sf_dir):
    c = calls(spark, sf_dir)
    return c.select("user_id", "ts", "event_id", F.when(F.col("tool") == "view", "test").otherwise("run").alias("kind"), (F.col("tool") != "error").alias("ok"))


def lifecycle_fold(spark, sf_dir):
    return lifecycle.fold(_outcomes(spark, sf_dir), ["user_id"], ["ts", "event_id"])


def declarations(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("author", F.floor(F.col("event_id") / 1000) % 3)
    return lifecycle.by_declaration(e, ["user_id"], ["event_id"], "author").select("event_id", "declaration")


def classify_run(spark, sf_dir):
    c = calls(spark, sf_dir)
    s = c.select(
        *EPISODE, "event_id", F.col("tool").alias("step"), F.when((F.col("tool") == "error") & (F.col("value") > 50), F.lit("timeout")).alias("error"), F.col("value").cast("long").alias("hits"),
        (F.col("tool") == "purchase").alias("required"), (F.col("k") == "3").alias("skipped"), F.when(F.col("event_id") % 97 == 0, F.lit("failed")).otherwise(F.lit("ok")).alias("status"))
    return lifecycle.classify_runs(s, EPISODE, "event_id")


def expectations(spark, sf_dir):
    s = calls(spark, sf_dir).groupBy("user_id", F.col("tool").alias("step")).agg(F.count("*").alias("hits")).withColumn("skipped", F.col("hits") == 12)
    bounds = [F.struct(F.lit(a).alias("step"), F.lit(b).cast("long").alias("min_hits"), F.lit(c).cast("long").alias("max_hits")) for a, b, c in (("view", 10, 20), ("other", 1, 9))]
    want = read(spark, sf_dir, "events").select("user_id").distinct().select("user_id", F.explode(F.array(*bounds)).alias("w")).select("user_id", "w.*")
    return lifecycle.check_expectations(s, want, ["user_id"])


def _evidence(spark, sf_dir) -> DataFrame:
    """Cards of the tools' results about each customer: orders as tickets, events as log lines found by two searches, its nation's page found and read."""
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.sort_array(F.collect_list(F.struct(F.concat(F.lit("O-"), "o_orderkey").alias("key"), F.struct(F.lit("order").alias("summary")).alias("fields")))).alias("issues"))
    e = calls(spark, sf_dir).select(F.col("user_id").alias("run"), "tool", F.struct(F.map_from_arrays(F.array(*[F.lit(x) for x in ("@timestamp", "level", "kubernetes.pod_name", "message")]), F.array(F.col("day").cast("string"), F.col("tool"), F.concat(F.lit("p-"), F.col("k").cast("int") % 3), F.lit("called"))).alias("_source")).alias("h"))
    logs = lambda some: some.groupBy("run").agg(F.collect_list("h").alias("hits"))
    n = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumnRenamed("c_custkey", "run")
    page = F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"), F.lit("about it").alias("excerpt"))
    home = F.struct(F.lit(-1).cast("long").alias("id"), F.lit("home").alias("title"), F.lit("all").alias("excerpt"))
    step = lambda df, k, name, tool, value: df.select("run", F.lit(k).alias("n"), F.lit(name).alias("step"), F.lit(None).cast("string").alias("item"), F.lit(tool).alias("tool"), F.to_json(value).alias("result"), F.lit(None).cast("string").alias("error"))
    rows = step(o, 0, "tickets", "jira.jira_search", F.struct("issues")).unionByName(step(logs(e.where("tool = 'error'")), 1, "errors", "logz.search_logs", F.struct("hits"))).unionByName(step(logs(e), 2, "lines", "logz.search_logs_simple", F.struct("hits")))
    rows = rows.unionByName(step(n, 3, "pages", "confluence.confluence_search", F.struct(F.array(page, home).alias("results")))).unionByName(step(n.where("run % 2 = 0"), 4, "page", "confluence.confluence_get_page", F.struct(F.col("n_nationkey").alias("id"), F.lit("whole").alias("body"))))
    rows = rows.unionByName(step(n.where("run % 5 = 0"), 5, "code", "code.grep", F.struct(F.array().cast("array<int>").alias("matches")))).unionByName(step(n.where("run % 7 = 0"), 6, "flow", "flows.other", F.struct(F.col("n_name").alias("x"))))
    return cards.evidence(cards.cards(rows, ["run", "n"]), ["run"], ["n"])


def evidence_cards(spark, sf_dir):
    a = F.col("attrs")
    return _evidence(spark, sf_dir).select("run", "step", "kind", "type", F.coalesce(a["key"], a["id"], a["pod"], a["text"]).alias("what"), F.coalesce(a["body"], a["excerpt"], a["ts"]).alias("more"))


def evidence_groups(spark, sf_dir):
    return cards.groups(_evidence(spark, sf_dir), ["run"], "step").withColumn("steps", F.array_join("steps", ","))


def expanded_calls(spark, sf_dir):
    """Customers' orders as calls, every third of them a flow whose items are its lines; the runs of the odd ones are lost."""
    o, l = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")  # noqa: E741
    flow = F.col("o_orderkey") % 3 == 0
    args = lambda v: F.create_map(F.lit("part"), v.cast("string"))
    made = o.select(
        "o_custkey", F.col("o_orderkey").alias("seq"), F.when(flow, "flows.run_flow").when(F.col("o_orderkey") % 11 == 0, "claude-code.Read").otherwise("shop.order").alias("tool"), args(F.lit("all")).alias("args"),
        F.when(flow, F.concat(F.lit('{"run_id": "r'), F.col("o_orderkey").cast("string"), F.lit('"}'))).otherwise("{}").alias("result"), F.lit(False).alias("is_error"))
    lines = l.where("l_orderkey % 3 = 0 and l_orderkey % 2 = 0").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.col("l_partkey").cast("string").alias("k")))), lambda x: x["k"]).alias("parts"))
    items = F.transform("parts", lambda k: F.struct(F.create_map(F.lit("part"), k).alias("args"), F.lit(None).cast("string").alias("result"), F.lit(None).cast("string").alias("error"), F.lit(None).cast(expansion.ATTEMPTS).alias("attempts")))
    step = F.struct(F.lit("shop.line").alias("tool"), F.lit(None).cast("boolean").alias("skipped"), F.lit(None).cast("map<string,string>").alias("args"), F.lit(None).cast("string").alias("result"), F.lit(None).cast("string").alias("error"), F.lit(None).cast(expansion.ATTEMPTS).alias("attempts"), items.alias("items"))
    runs = lines.select(F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("run_id"), F.lit("lines").alias("flow"), F.array(step).alias("steps"))
    out, _ = expansion.expand_flow_calls(made, runs, ["o_custkey"])
    return out.select("o_custkey", "seq", "tool", F.col("args")["part"].alias("part"), "from_flow")


def read_only_commands(spark, sf_dir):
    shapes = ("ls -la %s", "git log -n %s", "git push %s", "cat %s | wc", "python %s.py", "python -c 'print(%s)'", "rm %s", "/bin/grep 'a b' %s")
    e = calls(spark, sf_dir).select("event_id", F.element_at(F.array(*[F.lit(s) for s in shapes]), (F.col("event_id") % 8 + 1).cast("int")).alias("shape"), "k")
    return e.select("event_id", text.is_read_only(F.replace("shape", F.lit("%s"), F.col("k"))).alias("ok"))


def ledes(spark, sf_dir):
    """Opening sentences about customers: those of odd number have no owner, every third one no commits, every fifth is resolved."""
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey")
    facts = c.select(
        "c_custkey", F.col("c_name").alias("what"), F.when(key % 4 > 0, F.col("n_name")).alias("service"), F.lit("Monday").alias("started"), F.when(key % 5 == 0, "Tuesday").alias("resolved"), F.when(key % 10 == 0, "1h").alias("duration"),
        F.lit("open").alias("status"), F.when(key % 2 == 0, F.array(F.lit("@a"), F.lit("@b"))).alias("owners"), F.when(key % 7 == 0, "ann").alias("person"), (key % 3).alias("commits"), F.lit("abc").alias("sha"), F.lit("fix").alias("subject"))
    return facts.select("c_custkey", cards.lede(facts).alias("lede"))


def extract_expectations(spark, sf_dir):
    """Users' tools held against expected keys: views have to know 3, errors 5 and then 500, which none does."""
    keys = F.array_agg("k")
    s = calls(spark, sf_dir).groupBy("user_id", F.col("tool").alias("step")).agg(F.count("*").alias("hits"), F.create_map(F.lit("k"), keys, F.lit("none"), F.array().cast("array<string>")).alias("extracts")).withColumn("skipped", F.lit(False))
    want = s.where("step in ('view', 'error', 'click')").select(
        "user_id", "step", F.lit(1).cast("long").alias("min_hits"), F.lit(1000).cast("long").alias("max_hits"),
        F.when(F.col("step") == "view", F.create_map(F.lit("k"), F.lit("3"))).when(F.col("step") == "error", F.create_map(F.lit("k"), F.lit("5"), F.lit("none"), F.lit("500"))).alias("extracts"))
    return lifecycle.check_expectations(s, want, ["user_id"])


def hub_join(spark, sf_dir):
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    hub = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    return c.join(F.broadcast(hub), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name", "n_name").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        ladder_first_hit, foreach_fanout, fan_in_status, when_filter, merge_extracts, headline_first, cassette, coverage, evidence_dedup, log_summary, majority_vote, repeat_counts, bindability,
        value_provenance, prompt_folding, observed_values, pending_feedback, ordered_union, lifecycle_fold, declarations, classify_run, expectations, hub_join,
        evidence_cards, evidence_groups, expanded_calls, read_only_commands, ledes, extract_expectations,
    )
}

EVIDENCE = f"""{CALLS}, ev AS (SELECT o_custkey AS run, 'tickets' AS step, 'issue' AS kind, 'issue' AS type, 'O-' || o_orderkey AS what, NULL AS more FROM orders
 UNION ALL SELECT user_id, CASE WHEN bool_or(tool = 'error') THEN 'errors' ELSE 'lines' END, 'log', 'log', 'p-' || (CAST(k AS INT) % 3), CAST(day AS VARCHAR) FROM calls GROUP BY user_id, day, CAST(k AS INT) % 3
 UNION ALL SELECT c_custkey, 'pages', 'page', 'page', '-1', 'all' FROM customer
 UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'page' ELSE 'pages' END, 'page', 'page', CAST(c_nationkey AS VARCHAR), CASE WHEN c_custkey % 2 = 0 THEN 'whole' ELSE 'about it' END FROM customer
 UNION ALL SELECT c_custkey, 'flow', 'json', 'flow', '{{"x":"' || n_name || '"}}', NULL FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 7 = 0)"""
ORACLE_SQL = {
    "expanded_calls": """WITH c AS (SELECT o_custkey, o_orderkey AS s, 0 AS j, 'shop.order' AS tool, 'all' AS part, NULL AS from_flow FROM orders WHERE o_orderkey % 3 != 0 AND o_orderkey % 11 != 0
 UNION ALL SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey), 'shop.line', CAST(l_partkey AS VARCHAR), 'lines' FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0)
 SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY s, j) AS seq, tool, part, from_flow FROM c""",
    "extract_expectations": f"""WITH {CALLS}, s AS (SELECT user_id, tool AS step, bool_or(k = '3') AS three, bool_or(k = '5') AS five FROM calls GROUP BY 1, 2)
 SELECT user_id, step, CASE WHEN step = 'view' THEN 'extract k is not 3' WHEN five THEN 'extract none is not 500' ELSE 'extract k is not 5' END AS why FROM s WHERE step = 'error' OR step = 'view' AND NOT three""",
    "read_only_commands": "SELECT event_id, event_id % 8 IN (0, 1, 5, 7) AS ok FROM events",
    "ledes": """SELECT c_custkey, c_name || CASE WHEN c_custkey % 4 > 0 THEN ' on ' || n_name ELSE '' END || '. Fired Monday' || CASE WHEN c_custkey % 10 = 0 THEN ', resolved after 1h.' WHEN c_custkey % 5 = 0 THEN ', resolved Tuesday.' ELSE '. The incident is open.' END
 || CASE WHEN c_custkey % 2 = 0 THEN ' Owned by @a, @b' || CASE WHEN c_custkey % 7 = 0 THEN ' (ann on it)' ELSE '' END || '.' ELSE '' END
 || CASE c_custkey % 3 WHEN 1 THEN ' One commit touched the service just before, latest abc “fix”.' WHEN 2 THEN ' 2 commits touched the service just before, latest abc “fix”.' ELSE '' END AS lede FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "evidence_cards": f"WITH {EVIDENCE} SELECT * FROM ev",
    "evidence_groups": f"""WITH {EVIDENCE} SELECT run, list_position(['issue', 'incident', 'message', 'metric', 'log', 'commit', 'code', 'owners', 'page', 'flow', 'other'], type) AS place, type, count(*) AS cards, count(DISTINCT step) AS sources, string_agg(DISTINCT step, ',' ORDER BY step) AS steps
 FROM ev GROUP BY run, type""",
    "ladder_first_hit": """WITH f AS (SELECT o_orderkey, count(*) FILTER (WHERE l_quantity > 40 AND l_returnflag = 'R') AS h0, count(*) FILTER (WHERE l_quantity > 40) AS h1, count(l_orderkey) AS h2
 FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
 SELECT o_orderkey, CAST(CASE WHEN h0 > 0 THEN 0 WHEN h1 > 0 AND o_orderkey % 5 != 0 THEN 1 ELSE 2 END AS BIGINT) AS rung, CASE WHEN h0 > 0 THEN h0 WHEN h1 > 0 AND o_orderkey % 5 != 0 THEN h1 ELSE h2 END AS hits,
 CASE WHEN h0 > 0 THEN 'returned' WHEN h1 > 0 AND o_orderkey % 5 != 0 THEN 'large' ELSE 'all' END AS value FROM f""",
    "foreach_fanout": "SELECT l_orderkey, n, item FROM (SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS item, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS n FROM lineitem WHERE l_partkey % 7 != 0) WHERE n < 3",
    "fan_in_status": """SELECT l_orderkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE trunc(l_quantity) END) AS BIGINT) AS hits,
 CASE WHEN bool_and(l_returnflag = 'R') THEN 'error' WHEN bool_or(l_returnflag = 'R') THEN 'partial_errors' ELSE 'ok' END AS status FROM lineitem GROUP BY 1""",
    "when_filter": "SELECT event_id FROM events WHERE event_id % 5 = 4",
    "merge_extracts": f"WITH {CALLS}, f AS (SELECT user_id, day, tool, k, min((ts, event_id)) AS o FROM calls GROUP BY 1, 2, 3, 4) SELECT user_id, day, tool, string_agg(k, ',' ORDER BY o) AS vals FROM f GROUP BY 1, 2, 3",
    "headline_first": f"""WITH {CALLS}, u AS (SELECT DISTINCT user_id FROM calls), f AS (SELECT user_id, tool || ':' || k AS v FROM calls WHERE tool NOT IN ('view', 'error') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1)
 SELECT u.user_id, f.v FROM u LEFT JOIN f USING (user_id)""",
    "cassette": f"WITH {CALLS}, r AS (SELECT tool, k, max(event_id) AS answer FROM calls WHERE event_id % 2 = 0 GROUP BY tool, k) SELECT a.event_id, r.answer FROM calls a LEFT JOIN r ON r.tool = a.tool AND r.k = a.k WHERE a.event_id % 2 != 0",
    "coverage": f"""WITH {CALLS}, s AS (SELECT user_id, bool_or(tool IN ('view', 'click') AND value > 80) AS o, bool_or(tool = 'purchase' AND value > 80) AS b, bool_or(tool = 'error' AND value > 80) AS e FROM calls GROUP BY 1)
 SELECT user_id, CAST(o AS BIGINT) + CAST(b AS BIGINT) + CAST(e AS BIGINT) AS found, CAST(3 AS BIGINT) AS total,
 concat_ws(',', CASE WHEN NOT b THEN 'bought' END, CASE WHEN NOT e THEN 'failed' END, CASE WHEN NOT o THEN 'opened' END) AS missing, concat_ws(',', CASE WHEN NOT b THEN 'bought' END, CASE WHEN NOT o THEN 'opened' END) AS required_missing FROM s""",
    "evidence_dedup": f"WITH {CALLS} SELECT user_id, tool, k, event_id FROM calls QUALIFY row_number() OVER (PARTITION BY user_id, tool, k ORDER BY CASE WHEN value > 90 THEN 0 ELSE 1 END, ts, event_id) = 1",
    "log_summary": f"""WITH {CALLS}, n AS (SELECT user_id, tool, count(*) AS k FROM calls GROUP BY 1, 2), t AS (SELECT user_id, string_agg(tool || ':' || k, ',' ORDER BY k DESC, tool) AS tools FROM n GROUP BY 1),
 m AS (SELECT string_agg(tool || ':' || k, ',' ORDER BY k DESC, tool) AS tools FROM (SELECT tool, sum(k) AS k FROM n GROUP BY 1))
 SELECT user_id, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, any_value(t.tools) AS tools FROM calls JOIN t USING (user_id) GROUP BY 1
 UNION ALL SELECT NULL, count(*), strftime(min(ts), '%Y-%m-%d %H:%M:%S'), strftime(max(ts), '%Y-%m-%d %H:%M:%S'), (SELECT tools FROM m) FROM calls""",
    "majority_vote": f"WITH {CALLS} SELECT user_id, tool, n FROM (SELECT user_id, tool, count(*) AS n, min(event_id) AS f FROM calls GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1",
    "repeat_counts": f"WITH {CALLS}, n AS (SELECT user_id, tool, count(*) AS n FROM calls GROUP BY 1, 2) SELECT user_id, max(n) AS most, list_sort(list(n))[count(*) // 2 + 1] AS median FROM n GROUP BY 1",
    "bindability": f"""WITH {CALLS}, k AS (SELECT user_id, day, CASE WHEN tool = 'view' THEN 'constant' WHEN tool = 'error' THEN 'unresolved' WHEN value > 99 THEN 'authored' ELSE 'derived' END AS kind FROM calls)
 SELECT user_id, day, CASE WHEN count(*) FILTER (WHERE kind != 'constant') = 0 THEN 1.0 ELSE count(*) FILTER (WHERE kind = 'derived') / count(*) FILTER (WHERE kind != 'constant') END AS bound FROM k GROUP BY 1, 2""",
    "value_provenance": r"""WITH w AS (SELECT DISTINCT conv_id, turn AS at_, unnest(string_split(text, ' ')) AS value FROM conversations WHERE role = 'assistant'), u AS (SELECT conv_id, turn AS use, text FROM conversations WHERE role = 'user')
 SELECT u.conv_id, u.use, w.value, max(w.at_) AS origin FROM u JOIN w ON u.conv_id = w.conv_id AND w.at_ < u.use AND length(w.value) >= 6 AND (w.value = u.text OR (NOT regexp_full_match(w.value, '\d+') AND contains(u.text, w.value))) GROUP BY 1, 2, 3""",
    "prompt_folding": """WITH f AS (SELECT user_id % 10 AS flow, event_type, min(event_id) AS first, count(*) AS n FROM events GROUP BY 1, 2)
 SELECT flow, first, n, 'Look at  PAY-' || first || ' ' || event_type AS text FROM f QUALIFY row_number() OVER (PARTITION BY flow ORDER BY first) <= 4""",
    "observed_values": f"WITH {CALLS} SELECT tool, count(DISTINCT k) AS n_values, count(DISTINCT (user_id, day)) AS n_episodes, count(DISTINCT k) = 1 AS constant FROM calls GROUP BY 1",
    "pending_feedback": f"WITH {CALLS} SELECT event_id FROM calls a WHERE tool = 'error' AND NOT EXISTS (SELECT 1 FROM calls b WHERE b.tool = 'purchase' AND b.user_id = a.user_id AND b.k = a.k)",
    "ordered_union": f"""WITH {CALLS}, v AS (SELECT user_id, k, min(CASE tool WHEN 'view' THEN 0 ELSE 1000000000 END + event_id) AS o, bool_or(tool = 'click') AS c FROM calls WHERE tool IN ('view', 'click') GROUP BY 1, 2), u AS (SELECT DISTINCT user_id FROM calls)
 SELECT u.user_id, coalesce(string_agg(k, ',' ORDER BY o), '') AS both, coalesce(string_agg(k, ',' ORDER BY o) FILTER (WHERE NOT c), '') AS only_view FROM u LEFT JOIN v USING (user_id) GROUP BY 1""",
    "lifecycle_fold": f"""WITH RECURSIVE {CALLS}, e AS (SELECT user_id, tool, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM calls),
 s AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, 0 AS lvl, CAST(0 AS BIGINT) AS streak, CAST(0 AS BIGINT) AS runs, CAST(0 AS BIGINT) AS clean, CAST(0 AS BIGINT) AS failed FROM e
  UNION ALL SELECT s.user_id, e.i, CASE WHEN tool = 'error' THEN greatest(0, lvl - 1) WHEN tool = 'view' THEN lvl WHEN lvl < 2 AND streak + 1 >= CASE lvl WHEN 0 THEN 2 ELSE 5 END THEN lvl + 1 ELSE lvl END,
   CASE WHEN tool = 'error' THEN 0 WHEN tool = 'view' THEN streak WHEN lvl < 2 AND streak + 1 >= CASE lvl WHEN 0 THEN 2 ELSE 5 END THEN 0 ELSE streak + 1 END,
   runs + CASE WHEN tool = 'view' THEN 0 ELSE 1 END, clean + CASE WHEN tool IN ('view', 'error') THEN 0 ELSE 1 END, failed + CASE WHEN tool = 'error' THEN 1 ELSE 0 END FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
 SELECT user_id, ['draft', 'candidate', 'promoted'][lvl + 1] AS status, streak, runs, clean, failed FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""",
    "declarations": """WITH a AS (SELECT event_id, user_id, (event_id // 1000) % 3 AS author FROM events), n AS (SELECT *, CASE WHEN lag(author) OVER (PARTITION BY user_id ORDER BY event_id) = author THEN 0 ELSE 1 END AS new FROM a)
 SELECT event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS declaration FROM n""",
    "classify_run": f"""WITH {CALLS}, s AS (SELECT *, CASE WHEN k = '3' THEN NULL WHEN tool = 'error' AND value > 50 THEN 'step error: timeout' WHEN tool = 'purchase' AND trunc(value) = 0 THEN 'required step purchase returned zero hits' END AS bad,
  CASE WHEN event_id % 97 = 0 THEN 'run status failed' END AS st FROM calls) SELECT user_id, day, coalesce(max(st), arg_min(bad, event_id) FILTER (WHERE bad IS NOT NULL)) AS reason FROM s GROUP BY 1, 2""",
    "expectations": f"""WITH {CALLS}, s AS (SELECT user_id, tool AS step, count(*) AS hits FROM calls GROUP BY 1, 2), w AS (SELECT user_id, step, lo, hi FROM (SELECT DISTINCT user_id FROM calls), (VALUES ('view', 10, 20), ('other', 1, 9)) v(step, lo, hi))
 SELECT user_id, step, why FROM (SELECT w.user_id, w.step, CASE WHEN hits IS NULL THEN 'missing' WHEN hits = 12 THEN 'skipped' WHEN hits < lo THEN 'too few hits' WHEN hits > hi THEN 'too many hits' END AS why FROM w LEFT JOIN s USING (user_id, step)) WHERE why IS NOT NULL""",
    "hub_join": "SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
}
