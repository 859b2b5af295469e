"""Column functions on values made from the tables' keys, so that every one of them has something to find."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelens.functions import extract, ids, text
from tracelens.operators import binding, induce, ranking
from tracelens.streaming import ingest

from .tables import CALLS, calls, read

#: A value of each kind for an order, as an expression that both dialects read.
VALUES = {
    "jira_key": "concat('PAY-', o_orderkey)", "uuid": "concat('00000000-0000-4000-8000-', lpad(cast(o_orderkey as varchar(20)), 12, '0'))", "ipv4": "concat('10.0.', o_orderkey % 200, '.7')",
    "email": "concat('u', o_orderkey, '@ex.org')", "slack_ts": "concat('17', lpad(cast(o_orderkey as varchar(20)), 8, '0'), '.000100')", "date": "concat('2024-01-', 10 + o_orderkey % 20)",
    "iso_ts": "concat('2024-01-', 10 + o_orderkey % 20, 'T10:00:00Z')", "aws_key_id": "concat('AKIA', lpad(cast(o_orderkey as varchar(20)), 16, '0'))", "github_token": "concat('ghp_', lpad(cast(o_orderkey as varchar(20)), 36, '0'))",
    "slack_channel_id": "concat('C0', lpad(cast(o_orderkey as varchar(20)), 9, '0'))", "slack_user_id": "concat('U0', lpad(cast(o_orderkey as varchar(20)), 9, '0'))", "url": "concat('https://ex.org/o/', o_orderkey)",
    "log_level": "concat('ERR', 'OR')", "s3_uri": "concat('s3://bucket/o/', o_orderkey)", "mac_address": "concat('00:1b:44:11:3a:', 10 + o_orderkey % 80)", "cidr": "concat('10.0.', o_orderkey % 200, '.0/24')",
    "slack_token": "concat('xoxb-', lpad(cast(o_orderkey as varchar(20)), 12, '0'))", "google_key": "concat('AIza', lpad(cast(o_orderkey as varchar(20)), 35, 'x'))", "abs_path": "concat('/srv/app/o', o_orderkey, '/main.py')", "ec2_instance": "concat('i-', lpad(cast(o_orderkey as varchar(20)), 17, '0'))",
}
_KEY = "cast(o_orderkey as varchar(20))"


def _pad(n: int, fill: str = "0") -> str:
    return f"lpad({_KEY}, {n}, '{fill}')"


#: The same for the kinds that are told apart by length, by what stands around them, or by the order of kinds.
MORE_VALUES = {
    "sha40": f"concat('abc', {_pad(37)})", "trace_id": f"concat('abc', {_pad(29)})", "trace_id16": f"concat('abc', {_pad(13)})", "sha_short": f"concat('abc', {_pad(7)})", "k8s_pod": f"concat('o', {_KEY}, '-bcdfghjkl-bcdfg')",
    "slack_dm_id": f"concat('D0', {_pad(9)})", "pd_incident_id": f"concat('Q', {_pad(13)})", "pd_service_id": f"concat('P', {_pad(6)})", "http_status": "concat('', 200 + o_orderkey % 300)", "slack_channel": f"concat('#team-', {_KEY})",
    "error_class": f"concat('Order', {_KEY}, 'Error')", "semver": f"concat('1.', {_KEY}, '.0')", "git_remote": f"concat('git@ex.org:team/r', {_KEY}, '.git')", "github_ref": f"concat('team/repo#', {_KEY})", "file_line": f"concat('src/o', {_KEY}, '.py:12')",
    "java_class": f"concat('org.ex.Order', {_KEY})", "python_module": f"concat('pkg.mod.o', {_KEY})", "package_spec": f"concat('pkg', {_KEY}, '==1.2')", "docker_image": f"concat('reg/app', {_KEY}, ':v1')", "image_digest": f"concat('sha256:', {_pad(64)})",
    "aws_arn": f"concat('arn:aws:s3:::o', {_KEY})", "gcs_uri": f"concat('gs://b/o', {_KEY})", "k8s_namespace_ref": f"concat('ns/o', {_KEY})", "k8s_resource": f"concat('pod/o', {_KEY})", "ipv6": "concat('2001:db8::', o_orderkey % 1000)",
    "host_port": f"concat('h', {_KEY}, '.ex.org:8080')", "fqdn": f"concat('h-', {_KEY}, '.ex.org')", "ulid": f"concat('01', {_pad(24)})", "object_id": f"concat('abc', {_pad(21)})", "snowflake_id": f"concat('12', {_pad(16)})", "epoch_ms": f"concat('170', {_pad(10)})",
    "traceparent": f"concat('00-', {_pad(32)}, '-', {_pad(16)}, '-01')", "gdrive_id": f"concat('1A', {_pad(32, 'x')})", "prom_metric": f"concat('o', {_KEY}, '_total')", "prom_selector": f"concat('{{a=\"o', {_KEY}, '\"}}')", "iso_duration": "concat('P', o_orderkey % 9 + 1, 'D')",
    "relative_time": "concat('now-', o_orderkey % 50, 'm')", "cron_expr": "concat('*/', o_orderkey % 50 + 1, ' * * * *')", "hex_color": f"concat('#', {_pad(6)})", "openai_key": f"concat('sk-', {_pad(24)})", "bearer": f"concat('Bearer ', {_pad(24, 'a')})",
    "jwt": f"concat('eyJ', {_pad(12, 'a')}, '.', {_pad(12, 'b')}, '.', {_pad(12, 'c')})", "private_key": "concat('-----BEGIN ', 'RSA PRIVATE KEY-----')", "github_repo": f"concat('github.com/team/r', {_KEY})",
}
_SPARK = {k: v.replace("varchar(20)", "string") for k, v in VALUES.items()}


def _typed(spark, sf_dir, values):
    made = F.array(*[F.expr(v.replace("varchar(20)", "string")) for v in values.values()])
    # made in a step of its own; nothing is added, but the lambda keeps all of it out of one method, too long for the JVM to compile
    made = F.concat(made, F.filter(F.array(F.col("o_orderkey").cast("string")), lambda v: F.lit(False)))
    rows = ranking.spread(read(spark, sf_dir, "orders").select("o_orderkey")).select("o_orderkey", made.alias("values"))
    return ids.typed(rows.select("o_orderkey", F.explode_outer("values").alias("value")), "value")


def typed_values(spark, sf_dir):
    """The kind of a value of each kind."""
    return _typed(spark, sf_dir, VALUES)


def more_typed_values(spark, sf_dir):
    return _typed(spark, sf_dir, MORE_VALUES)


def found_in_text(spark, sf_dir):
    """Such values found by kind in a line that has each twice."""
    o = ranking.spread(read(spark, sf_dir, "orders").select("o_orderkey"))
    out = None
    for kind in FOUND:
        line = F.concat(F.lit("( "), "value", F.lit(" ) and "), "value", F.lit(" ;"))
        lines = o.select("o_orderkey", F.expr(MORE_VALUES[kind].replace("varchar(20)", "string")).alias("value")).select("o_orderkey", line.alias("line"))
        one = ids.find_all(lines, "o_orderkey", "line", kind).select("o_orderkey", F.lit(kind).alias("kind"), "value")
        out = one if out is None else out.unionByName(one)
    return out


def planted_ids(spark, sf_dir):
    """Keys, addresses and mails inside a sentence, found by kind."""
    line = F.concat(F.lit("see "), F.expr(_SPARK["jira_key"]), F.lit(" from "), F.expr(_SPARK["ipv4"]), F.lit(", mail "), F.expr(_SPARK["email"]), F.lit(" again "), F.expr(_SPARK["jira_key"]))
    o = read(spark, sf_dir, "orders").select("o_orderkey", line.alias("line"))
    out = None
    for kind in ("jira_key", "ipv4", "email"):
        one = ids.find_all(o, "o_orderkey", "line", kind).select("o_orderkey", F.lit(kind).alias("kind"), F.col("n").cast("long").alias("n"), "value")
        out = one if out is None else out.unionByName(one)
    return out


def planted_secrets(spark, sf_dir):
    """Credentials inside a sentence are replaced, other ids stay."""
    line = F.concat(F.lit("key "), F.expr(_SPARK["aws_key_id"]), F.lit(" token "), F.expr(_SPARK["github_token"]), F.lit(" ticket "), F.expr(_SPARK["jira_key"]))
    return read(spark, sf_dir, "orders").select("o_orderkey", ids.redact(line).alias("line"))


def slugs(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", text.slug(F.concat("c_name", F.lit(" (x)"))).alias("slug"))


def regex_extracts(spark, sf_dir):
    url = F.concat("url", F.lit(" then "), "url")
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(extract.regex_all(url, r"example\.([a-z]+)"), ",").alias("zones"), extract.regex_first(F.col("url"), "EXAMPLE", ignore_case=True).alias("first"))


def durations(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", extract.duration(F.col("l_quantity").cast("long") * 900).alias("span"))


def catalog_attributes(spark, sf_dir):
    """The attributes of the nations that customers mention, as values to bind."""
    n = read(spark, sf_dir, "nation")
    hub = n.select(F.col("n_name").alias("name"), F.lit("region").alias("attr"), F.col("n_regionkey").cast("string").alias("value")).unionByName(n.select(F.col("n_name").alias("name"), F.lit("key"), F.col("n_nationkey").cast("string")).toDF("name", "attr", "value"))
    mentions = read(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.lit(1).alias("at"), F.col("n_name").alias("name"))
    return binding.attribute_candidates(mentions, hub, ["c_custkey"]).select("c_custkey", "value", "kind", "source", "name")


def proposals(spark, sf_dir):
    """Of each tool and user, whether a proposed binding renders all recorded values."""
    rows = calls(spark, sf_dir).select("event_id", F.concat_ws(":", "tool", (F.col("user_id") % 50).cast("string")).alias("step"), F.lit("k").alias("arg"), F.col("k").alias("value"), (F.col("value") > 150).alias("odd"))
    made = rows.select("event_id", "step", "arg", F.when(F.col("odd"), F.lit("other")).otherwise(F.col("value")).alias("value"))
    return induce.reproduces(made, rows.drop("odd"), ["event_id"]).select("step", "ok")


def analysis_progress(spark, sf_dir):
    return ingest.progress(read(spark, sf_dir, "labels"), read(spark, sf_dir, "documents"), "doc_id")


#: Kinds that are found in lines of their own.
FOUND = ("sha40", "k8s_pod", "java_class", "docker_image", "traceparent", "cron_expr")
QUERIES = {f.__name__: f for f in (typed_values, more_typed_values, found_in_text, planted_ids, planted_secrets, slugs, regex_extracts, durations, catalog_attributes, proposals, analysis_progress)}
_KINDS = " UNION ALL ".join(f"SELECT o_orderkey, {v} AS value, '{k}' AS kind FROM orders" for k, v in VALUES.items())
ORACLE_SQL = {
    "typed_values": _KINDS,
    "more_typed_values": " UNION ALL ".join(f"SELECT o_orderkey, {v} AS value, '{k}' AS kind FROM orders" for k, v in MORE_VALUES.items()),
    "found_in_text": " UNION ALL ".join(f"SELECT o_orderkey, '{k}' AS kind, {MORE_VALUES[k]} AS value FROM orders" for k in FOUND),
    "planted_ids": " UNION ALL ".join(f"SELECT o_orderkey, '{k}' AS kind, CAST(1 AS BIGINT) AS n, {VALUES[k]} AS value FROM orders" for k in ("jira_key", "ipv4", "email")),
    "planted_secrets": f"SELECT o_orderkey, concat('key [redacted] token [redacted] ticket ', {VALUES['jira_key']}) AS line FROM orders",
    "slugs": "SELECT c_custkey, trim(regexp_replace(lower(c_name || ' (x)'), '[^a-z0-9]+', '-', 'g'), '-') || '-' || left(sha1(c_name || ' (x)'), 8) AS slug FROM customer",
    "regex_extracts": r"SELECT page_id, regexp_extract(url, 'example\.([a-z]+)', 1) AS zones, CASE WHEN contains(url, 'example') THEN 'example' END AS first FROM pages",
    "durations": """WITH s AS (SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity) AS BIGINT) * 900 AS s FROM lineitem)
 SELECT l_orderkey, l_linenumber, CASE WHEN s = 0 THEN '0s' WHEN s % 86400 = 0 THEN (s // 86400) || 'd' WHEN s % 3600 = 0 THEN (s // 3600) || 'h' ELSE (s // 60) || 'm' END AS span FROM s""",
    "catalog_attributes": """WITH m AS (SELECT c_custkey, n_name, n_regionkey, n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
 SELECT c_custkey, CAST(n_regionkey AS VARCHAR) AS value, 'catalog-attr:region' AS kind, n_name AS source, 'region' AS name FROM m UNION ALL SELECT c_custkey, CAST(n_nationkey AS VARCHAR), 'catalog-attr:key', n_name, 'key' FROM m""",
    "proposals": f"WITH {CALLS} SELECT tool || ':' || (user_id % 50) AS step, bool_and(NOT value > 150) AND count(DISTINCT k) > 1 AS ok FROM calls GROUP BY 1",
    "analysis_progress": "SELECT count(*) AS total, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS missing FROM (SELECT DISTINCT doc_id FROM documents)",
}
