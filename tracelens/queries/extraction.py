"""Typed ids, labelled lines, windows, entities and searches over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.functions import extract, ids, text
from tracelens.operators import binding, search

from .tables import read


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text")


def _ids(kind):
    def query(spark, sf_dir):
        found = F.array_distinct(ids.matches(F.col("text"), kind, ascii_words=True))
        return docs(spark, sf_dir).select("doc_id", found.alias("f")).where(F.size("f") > 0).select("doc_id", F.size("f").cast("long").alias("n"), F.array_join("f", "|").alias("ids"))

    query.__name__ = f"ids_{kind}"
    return query


def _sql_ids(shape: str) -> str:
    return f"""WITH f AS (SELECT doc_id, unnest(regexp_extract_all(text, '{shape}')) AS v, generate_subscripts(regexp_extract_all(text, '{shape}'), 1) AS p FROM documents),
 d AS (SELECT doc_id, v, min(p) AS p FROM f GROUP BY 1, 2) SELECT doc_id, count(*) AS n, string_agg(v, '|' ORDER BY p) AS ids FROM d GROUP BY 1"""


def find_all_ids(spark, sf_dir):
    """Distinct hashes that no longer id of an earlier kind covers; lookarounds put the cover check beyond the SQL engine's patterns."""
    return ids.find_all(docs(spark, sf_dir), "doc_id", "text", "sha_short").select("doc_id", "n", "value")


def typed_mentions(spark, sf_dir):
    return ids.typed_mentions(docs(spark, sf_dir), "doc_id", "text").groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


def type_of_values(spark, sf_dir):
    urls = read(spark, sf_dir, "pages").select(F.explode(F.array("url", F.regexp_extract("url", "//([^/]+)", 1), F.sha1(F.col("url").cast("binary")), F.lit("PAY-101"), F.lit("plain"))).alias("v"))
    return urls.groupBy(ids.type_of(F.col("v")).alias("kind")).agg(F.count("*").alias("n"))


def redact_secrets(spark, sf_dir):
    out = ids.redact(F.col("text"), ascii_words=True)
    return docs(spark, sf_dir).select("doc_id", F.md5(out).alias("redacted"), (out != F.col("text")).alias("changed"))


def _sql_redact() -> str:
    out = "text"
    for shape in ids.CREDENTIALS.values():
        out = f"regexp_replace({out}, '{shape}', '[redacted]', 'g')"
    return f"SELECT doc_id, md5({out}) AS redacted, {out} != text AS changed FROM documents"


def outermost_spans(spark, sf_dir):
    s = F.col("l_shipdate").cast("timestamp").cast("double")
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", s.alias("s"), (s + F.col("l_quantity").cast("long") * 86400).alias("e"), "l_linenumber")  # noqa: E741
    return ids.outermost(l, ["l_orderkey"], "s", "e", ["l_linenumber"]).select("l_orderkey", "l_linenumber")


def gazetteer_hits(spark, sf_dir):
    nations = read(spark, sf_dir, "nation")
    names = nations.select(F.col("n_name").alias("alias"), F.lower("n_name").alias("name")).unionByName(spark.sql("SELECT 'UNITED_KINGDOM' AS alias, 'united kingdom' AS name"))
    texts = read(spark, sf_dir, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat_ws(" ", F.lit("From:"), F.initcap("n_name"), F.lit("to"), "n_name", F.lit("xCHINA-1")).alias("t"))
    return extract.gazetteer(texts, "c_custkey", "t", names).select("c_custkey", F.col("n").cast("long").alias("n"), "name")


def label_lines(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("Title page: "), "url", F.lit("\nsize = "), F.length("html").cast("string"), F.lit("\n: none\nplain")).alias("t"))
    return extract.label_lines(pages, "page_id", "t").select("page_id", F.col("line").cast("long").alias("line"), "label", "value")


def window_extract(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", extract.window(F.col("ts").cast("timestamp"), "1h", "4h", "1h").alias("w"))
    return e.select("event_id", "w.*")


def json_leaves(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.from_json("props", "k int").alias("p"), F.array(F.col("event_type"), F.lit("x")).alias("list"))).alias("j"))
    return binding.leaves(e, ["event_id"], "j")


def count_hits(spark, sf_dir):
    o = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list("l_linenumber").alias("items"))).alias("j"))
    return o.select("l_orderkey", extract.count_hits(F.col("j"), "items").cast("long").alias("hits"), extract.count_hits(F.col("j"), "none").cast("long").alias("none"))


def search_tokens(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark")
    return b.select("item_id", F.array_join(text.tokens(F.col("text"), 4), " ").alias("tokens"))


SQL_TOKENS = """WITH w AS (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_.-]+')) AS r, generate_subscripts(regexp_extract_all(text, '[A-Za-z0-9_.-]+'), 1) AS p FROM benchmark),
 c AS (SELECT item_id, trim(r, '._-') AS t, p FROM w WHERE len(trim(r, '._-')) >= 4 AND lower(trim(r, '._-')) NOT IN ('the','a','an','of','for','in','on','at','to','and','or','is','was','not','with','within','did','after','before')),
 d AS (SELECT item_id, lower(t) AS l, min(p) AS p, min_by(t, p) AS t FROM c GROUP BY 1, 2), g AS (SELECT item_id, string_agg(t, ' ' ORDER BY p) AS tokens FROM d GROUP BY 1)
 SELECT b.item_id, coalesce(g.tokens, '') AS tokens FROM benchmark b LEFT JOIN g USING (item_id)"""


def term_search(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.where(text.all_terms(F.col("text"), "the", "work*") | text.all_terms(F.col("text"), '"licensed under"')).select("doc_id")


def issue_search(spark, sf_dir):
    """Orders as issues: project by equality, status by list, text by terms, and a date back from the last one."""
    o = read(spark, sf_dir, "orders")
    last = o.agg(F.max("o_orderdate").alias("m")).scalar()
    hit = text.field_is(F.col("o_orderstatus"), "o", "F") & text.any_term(F.col("o_orderpriority"), '"urgent"', '"high"') & (F.col("o_orderdate") >= last - F.expr("interval 900 days"))
    found = o.where(hit & ~text.field_is(F.col("o_custkey"), "7"))
    return search.page(found, [F.desc("o_orderdate"), "o_orderkey"], 20, 5).select("o_orderkey", "total")


def message_search(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return c.where(text.field_is(F.col("role"), "user") & text.all_terms(F.col("text"), "the")).select("conv_id", "turn")


def record_search(spark, sf_dir):
    """Terms without a field are sought in all of a record's leaves."""
    p = read(spark, sf_dir, "part")
    flat = text.flattened(*[F.col(c) for c in ("p_partkey", "p_brand", "p_name")])
    return p.where(text.term(flat, "Brand*") & ~text.term(F.col("p_brand"), "Brand#11") & text.term(flat, "12*")).select("p_partkey")


def page_search(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return p.where(text.any_term(title, "the", "die", "les") & text.field_has(F.array(F.regexp_extract("url", "example[.]([a-z]+)", 1)), "COM", "net")).select("page_id")


def grep_context(spark, sf_dir):
    g = search.grep(docs(spark, sf_dir), "doc_id", "text", "Licen[sc]e", 1)
    return g.select("doc_id", F.col("line").cast("long").alias("line"), F.md5(F.concat_ws("\n", "before", "content", "after")).alias("lines"))


def grep_counts(spark, sf_dir):
    return search.grep_counts(docs(spark, sf_dir), "doc_id", "text", "stupid|idiot")


def folded_excerpt(spark, sf_dir):
    c = read(spark, sf_dir, "events").select(F.col("user_id"), F.col("event_id"), F.col("event_type"))
    return search.excerpt(c, ["user_id"], "event_id", F.col("event_type") == "signup", 1).select("user_id", "first", "last", "folded")


def metric_bands(spark, sf_dir):
    """Each event with the number of errors of its service in the five hours before it."""
    e = read(spark, sf_dir, "events").select("event_id", "event_type", (F.col("user_id") % 5).alias("service"), F.col("ts").cast("timestamp").alias("t"))
    spikes = e.where("event_type = 'error'").select("service", F.col("t").alias("s"), (F.col("t") + F.expr("interval 5 hours")).alias("e"))
    return search.bands(e.select("event_id", "service", "t"), spikes, "service", "t", "s", "e").select("event_id", "spikes")


def metric_peaks(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"), F.min_by("event_id", F.struct(-F.col("value"), "event_id")).alias("peak"))


def on_call(spark, sf_dir):
    shifts = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.to_date("l_shipdate").alias("s"), F.date_add("l_shipdate", 30).alias("e"), "l_linenumber")
    asks = read(spark, sf_dir, "orders").select("o_orderkey", F.date_add("o_orderdate", 40).alias("at"))
    return search.on_call(asks, shifts, ["o_orderkey"], "at", "s", "e", "l_linenumber").select("o_orderkey", F.col("on_call").cast("long").alias("on_call"))


def commit_prefix(spark, sf_dir):
    full = read(spark, sf_dir, "pages").select("page_id", F.sha1(F.col("url").cast("binary")).alias("sha"))
    return search.by_prefix(full.select(F.substring("sha", 1, 9).alias("short")), full, "short", "sha", "page_id")


def code_owners(spark, sf_dir):
    paths = read(spark, sf_dir, "pages").select(F.regexp_replace("url", r"^https?://", "").alias("path")).distinct()
    hosts = read(spark, sf_dir, "pages").select(F.regexp_extract("url", r"//([^/]+)", 1).alias("host"), "page_id").distinct()
    rules = hosts.groupBy("host").agg(F.min("page_id").alias("p")).select(F.col("host").alias("prefix"), F.col("p").alias("rule_no"), F.concat(F.lit("team"), (F.col("p") % 3).cast("string")).alias("owner"))
    more = hosts.groupBy("host").agg(F.max("page_id").alias("p")).select(F.concat("host", F.lit("/en")).alias("prefix"), (F.col("p") + 10_000).alias("rule_no"), F.lit("english").alias("owner"))
    return search.owners(paths, rules.unionByName(more), "path")


def registry_layers(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    specs = c.select((F.col("c_custkey") % 100).alias("name"), F.col("c_custkey").alias("layer"), F.when(F.col("c_acctbal") > 2000, F.col("c_custkey")).alias("spec"))
    return search.layered(specs, "name", "layer", "spec")


def newest_versions(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.concat(F.lit("flow-"), (F.col("p_partkey") % 17).cast("string"), F.when(F.col("p_partkey") < 20, F.lit("")).otherwise(F.concat(F.lit(".v"), (F.floor(F.col("p_partkey") / 17) + 1).cast("string")))).alias("name"))
    return search.newest_version(p, "name")


def previews(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(text.preview(F.col("text"))).alias("preview"), text.is_authored(F.col("text")).alias("authored"))


def tool_names(spark, sf_dir):
    t = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("mcp__srv"), (F.col("event_id") % 4).cast("string"), F.lit("__"), F.col("event_type"), F.lit("__x"))).otherwise(F.col("event_type"))
    e = read(spark, sf_dir, "events").select(t.alias("t"))
    return e.groupBy(text.server_of(F.col("t")).alias("server"), text.tool_of(F.col("t")).alias("tool")).agg(F.count("*").alias("n"))


def templates(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    q = text.template("summary ~ {q} AND project = {p}", q=text.quote(F.col("c_name")), p=F.when(F.col("c_custkey") % 2 == 0, text.snake(text.kebab(F.col("c_mktsegment")))))
    return c.select("c_custkey", q.alias("query"), text.escape_query(F.concat(F.col("c_name"), F.lit(":(x)"))).alias("escaped"), text.short(F.col("c_name"), 4).alias("short"))


_KINDS = ("sha40", "trace_id16", "ipv4", "email", "gdrive_id", "fqdn", "aws_key_id", "pd_service_id", "log_level")
QUERIES = {f"ids_{k}": _ids(k) for k in _KINDS} | {
    f.__name__: f
    for f in (
        find_all_ids, typed_mentions, type_of_values, redact_secrets, outermost_spans, gazetteer_hits, label_lines, window_extract, json_leaves, count_hits, search_tokens, term_search, issue_search,
        message_search, record_search, page_search, grep_context, grep_counts, folded_excerpt, metric_bands, metric_peaks, on_call, commit_prefix, code_owners, registry_layers, newest_versions,
        previews, tool_names, templates,
    )
}

LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS c, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents)"
ORACLE_SQL = {f"ids_{k}": _sql_ids(ids.SHAPES[k].replace("(?:[a-z0-9]([a-z0-9-]", "(?:[a-z0-9](?:[a-z0-9-]")) for k in _KINDS} | {
    "redact_secrets": _sql_redact(),
    "outermost_spans": """WITH l AS (SELECT l_orderkey, l_linenumber, epoch(l_shipdate) AS s, epoch(l_shipdate) + CAST(trunc(l_quantity) AS BIGINT) * 86400 AS e FROM lineitem)
 SELECT l_orderkey, l_linenumber FROM l a WHERE NOT EXISTS (SELECT 1 FROM l b WHERE b.l_orderkey = a.l_orderkey AND b.s <= a.s AND b.e >= a.e AND (b.s < a.s OR b.e > a.e OR b.l_linenumber < a.l_linenumber))""",
    "gazetteer_hits": "SELECT c_custkey, CAST(1 AS BIGINT) AS n, lower(n_name) AS name FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "label_lines": "SELECT page_id, CAST(0 AS BIGINT) AS line, 'Title page' AS label, trim(url) AS value FROM pages UNION ALL SELECT page_id, 1, 'size', CAST(length(html) AS VARCHAR) FROM pages WHERE length(CAST(length(html) AS VARCHAR)) >= 3",
    "window_extract": """WITH w AS (SELECT event_id, date_trunc('hour', ts) AS t FROM events)
 SELECT event_id, strftime(t - INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS start, strftime(t + INTERVAL 4 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS "end", strftime(t, '%Y-%m-%dT%H:%M:%SZ') AS anchor,
 strftime(t - INTERVAL 1 HOUR, '%Y-%m-%d') AS start_date, strftime(t + INTERVAL 4 HOUR, '%Y-%m-%d') AS end_date FROM w""",
    "json_leaves": """SELECT event_id, 'p.k' AS path, json_extract_string(props, '$.k') AS value FROM events UNION ALL SELECT event_id, 'list[*]', event_type FROM events
 UNION ALL SELECT event_id, 'list[*]', 'x' FROM events""",
    "count_hits": "SELECT l_orderkey, count(*) AS hits, CAST(0 AS BIGINT) AS none FROM lineitem GROUP BY 1",
    "search_tokens": SQL_TOKENS,
    "term_search": r"SELECT doc_id FROM documents WHERE (regexp_matches(lower(text), '(^|[^\w\-])the($|[^\w\-])') AND regexp_matches(lower(text), '(^|[^\w\-])work')) OR contains(lower(text), 'licensed under')",
    "issue_search": """WITH f AS (SELECT * FROM orders WHERE lower(o_orderstatus) IN ('o', 'f') AND (contains(lower(o_orderpriority), 'urgent') OR contains(lower(o_orderpriority), 'high'))
 AND o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 900 DAY AND o_custkey != 7) SELECT o_orderkey, (SELECT count(*) FROM f) AS total FROM f ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 5""",
    "message_search": r"SELECT conv_id, turn FROM conversations WHERE role = 'user' AND regexp_matches(lower(text), '(^|[^\w\-])the($|[^\w\-])')",
    "record_search": "SELECT p_partkey FROM part WHERE lower(p_brand) != 'brand#11' AND p_brand LIKE 'Brand%' AND regexp_matches(lower(p_partkey || ' ' || p_brand || ' ' || p_name), '(^|[^a-z0-9_\\-])12')".replace("\\\\", "\\"),
    "page_search": r"""SELECT page_id FROM pages WHERE regexp_matches(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '(^|[^\p{L}\p{N}_\-])(the|die|les)($|[^\p{L}\p{N}_\-])') AND regexp_extract(url, 'example[.]([a-z]+)', 1) IN ('com', 'net')""",
    "grep_context": f"""WITH {LINES}, w AS (SELECT *, lag(c) OVER (PARTITION BY doc_id ORDER BY line) AS b, lead(c) OVER (PARTITION BY doc_id ORDER BY line) AS a FROM l)
 SELECT doc_id, CAST(line AS BIGINT) AS line, md5(coalesce(b, '') || chr(10) || c || chr(10) || coalesce(a, '')) AS lines FROM w WHERE regexp_matches(c, 'Licen[sc]e')""",
    "grep_counts": f"WITH {LINES} SELECT doc_id, count(*) AS n FROM l WHERE regexp_matches(c, 'stupid|idiot') GROUP BY 1",
    "folded_excerpt": """WITH n AS (SELECT user_id, event_id, max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM events),
 b AS (SELECT *, CASE WHEN lag(near) OVER (PARTITION BY user_id ORDER BY event_id) = near THEN 0 ELSE 1 END AS new FROM n), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM b)
 SELECT user_id, min(event_id) AS first, max(event_id) AS last, max(near) = 0 AS folded FROM g GROUP BY user_id, k""",
    "metric_bands": """WITH e AS (SELECT event_id, event_type, user_id % 5 AS service, ts FROM events)
 SELECT a.event_id, count(b.event_id) AS spikes FROM e a LEFT JOIN e b ON b.event_type = 'error' AND a.service = b.service AND a.ts BETWEEN b.ts AND b.ts + INTERVAL 5 HOUR GROUP BY 1""",
    "metric_peaks": "SELECT event_type, min(value) AS low, max(value) AS high, count(*) AS n, (SELECT event_id FROM events b WHERE b.event_type = a.event_type ORDER BY value DESC, event_id LIMIT 1) AS peak FROM events a GROUP BY event_type",
    "on_call": """WITH s AS (SELECT l_orderkey AS k, CAST(l_shipdate AS DATE) AS s, CAST(l_shipdate AS DATE) + 30 AS e, l_linenumber AS p FROM lineitem), o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) + 40 AS at_ FROM orders)
 SELECT o_orderkey, CAST(coalesce((SELECT min_by(p, struct_pack(s := s, p := p)) FROM s WHERE k = o_orderkey AND s <= at_ AND at_ < e), (SELECT max_by(p, struct_pack(s := s, p := p)) FROM s WHERE k = o_orderkey)) AS BIGINT) AS on_call FROM o""",
    "commit_prefix": "SELECT left(sha1(url), 9) AS short, min_by(sha1(url), page_id) AS sha FROM pages GROUP BY 1",
    "code_owners": """WITH h AS (SELECT regexp_extract(url, '//([^/]+)', 1) AS host, min(page_id) AS lo FROM pages GROUP BY 1), p AS (SELECT DISTINCT regexp_replace(url, '^https?://', '') AS path FROM pages)
 SELECT path, CASE WHEN string_split(path, '/')[2] = 'en' THEN 'english' ELSE 'team' || (lo % 3) END AS owner FROM p JOIN h ON string_split(path, '/')[1] = host""",
    "registry_layers": "SELECT name, spec FROM (SELECT c_custkey % 100 AS name, CASE WHEN c_acctbal > 2000 THEN c_custkey END AS spec, row_number() OVER (PARTITION BY c_custkey % 100 ORDER BY c_custkey DESC) AS r FROM customer) WHERE r = 1 AND spec IS NOT NULL",
    "newest_versions": "SELECT 'flow-' || (p_partkey % 17) AS base, CAST(max(CASE WHEN p_partkey < 20 THEN 1 ELSE p_partkey // 17 + 1 END) AS BIGINT) AS newest, CAST(max(CASE WHEN p_partkey < 20 THEN 1 ELSE p_partkey // 17 + 1 END) + 1 AS BIGINT) AS next FROM part GROUP BY 1",
    "previews": "SELECT doc_id, md5(CASE WHEN length(text) > 300 THEN left(text, 300) || '… (' || length(text) || ' chars)' ELSE text END) AS preview, length(text) > 200 OR contains(trim(text), chr(10)) AS authored FROM documents",
    "tool_names": """SELECT CASE WHEN event_id % 3 = 0 THEN 'srv' || (event_id % 4) ELSE 'claude-code' END AS server, CASE WHEN event_id % 3 = 0 THEN event_type || '__x' ELSE event_type END AS tool, count(*) AS n FROM events GROUP BY 1, 2""",
    "templates": r"""SELECT c_custkey, 'summary ~ "' || c_name || '" AND project = ' || CASE WHEN c_custkey % 2 = 0 THEN replace(c_mktsegment, '-', '_') ELSE '' END AS query,
 regexp_replace(c_name || ':(x)', '([+\-=&|><!(){}\[\]^"~*?:\\/])', '\\\1', 'g') AS escaped, left(c_name, 4) AS short FROM customer""",
}
