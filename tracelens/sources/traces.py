"""Recorded traces and transcripts as tables, and the tables of a workspace written back.

Trace files hold one JSON record a line.  Records whose shape varies (arguments,
results) stay JSON text or VARIANT; what is filtered by plain text is filtered
before it is parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelens.functions.text import is_injected, server_of, tool_of
from tracelens.operators import episodes

# Fixed values.
OWN_TOOLS = ("Read", "Grep", "Glob", "Bash")
INTERESTING = r'mcp__|"Read"|"Grep"|"Glob"|"Bash"'
ERROR_START = r"(?i)^\s*(?:error|fatal):"

RECORD = "ts string, session_id string, source string, kind string, trigger string, parent_session string, prompt string, seq int, server string, tool string, input string, output string, output_text string, is_error boolean, duration_ms double, tool_use_id string, text string"


def _lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """Lines of all files with their file and place, in the order of ``line``; long files are split.

    A place is the start of the split and the row's number in the scan, which grows along a split, so places order the
    lines of a file, whichever tasks read its splits.
    """
    files = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
    place = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    files = files.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("mtime"), place.alias("line"), F.col("value").alias("raw"))
    return files.where(F.trim("raw") != "")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of recorded traces; a line that is no JSON stops the read."""
    rows = _lines(spark, path)
    rec = F.from_json("raw", RECORD, {"mode": "FAILFAST"})
    rows = rows.select("file", "line", rec.alias("r")).select("file", "line", "r.*")
    stem = F.regexp_extract("file", r"([^/]+)\.jsonl$", 1)
    return rows.withColumn("session_id", F.coalesce("session_id", stem)).withColumn("kind", F.coalesce("kind", F.lit("call"))).withColumn("output", folded_output(F.col("output")))


def folded_output(output: Column) -> Column:
    """A result given as text blocks becomes the JSON that the blocks hold, or their text."""
    blocks = F.from_json(output, "array<struct<type:string,text:string>>")
    plain = output.rlike(r"^\s*\[") & (F.size(blocks) > 0) & F.forall(blocks, lambda b: b["type"] == "text")
    joined = F.array_join(F.transform(blocks, lambda b: F.coalesce(b["text"], F.lit(""))), "\n")
    return F.when(F.coalesce(plain, F.lit(False)), joined).otherwise(output)


def sessions(records: DataFrame, trigger: str | None = None) -> DataFrame:
    """One row a session that has calls: the last meta record, the last result, and the numbers of calls and prompts."""
    at = F.col("line")
    of = lambda kind: F.when(F.col("kind") == kind, at)
    s = records.groupBy("file", "session_id").agg(
        F.max_by("trigger", of("meta")).alias("trigger"), F.max_by("parent_session", of("meta")).alias("parent_session"), F.max_by("text", of("result")).alias("result"),
        F.coalesce(F.min_by("text", of("prompt")), F.max_by("prompt", of("meta"))).alias("prompt"), F.count_if(F.col("kind") == "call").alias("n_calls"), F.count_if(F.col("kind") == "prompt").alias("n_prompts"))
    s = s.where("n_calls > 0")
    return s.where(F.col("trigger") == trigger) if trigger else s


def is_failure(output_text: Column, is_error: Column) -> Column:
    """Servers that report failures as plain text count as failing."""
    return F.coalesce(is_error, F.lit(False)) | F.coalesce(output_text.rlike(ERROR_START), F.lit(False))


def read_transcripts(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``prompts``, ``calls`` and ``results`` of agent transcripts (``<session>.jsonl`` and ``<session>/subagents/agent-<id>.jsonl``).

    Files that mention no tool of interest are dropped before anything is parsed; lines that are no JSON are skipped.
    """
    rows = _lines(spark, path)
    useful = rows.groupBy("file").agg(F.bool_or(F.col("raw").rlike(INTERESTING)).alias("u")).where("u").select("file")
    rows = rows.join(useful, "file", "left_semi")
    session = F.regexp_extract("file", r"([^/]+?)(?:/subagents/agent-[^/]+)?\.jsonl$", 1)
    agent = F.regexp_extract("file", r"/subagents/agent-([^/]+)\.jsonl$", 1)
    head = F.from_json("raw", "type string, isSidechain boolean, agentId string, isMeta boolean, timestamp string, message struct<role:string,content:string>")
    rows = rows.select(session.alias("session"), F.when(agent == "", "main").otherwise(agent).alias("file_agent"), "line", head.alias("h"))
    rows = rows.where(F.col("h.type").isin("user", "assistant")).select(
        "session", F.when(F.col("h.isSidechain"), F.coalesce("h.agentId", "file_agent")).otherwise(F.col("file_agent")).alias("agent"), "line", F.col("h.type").alias("type"),
        F.coalesce("h.isMeta", F.lit(False)).alias("meta"), F.col("h.timestamp").alias("ts"), F.col("h.message.content").alias("content"))
    block = "array<struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean>>"
    text_only = F.concat(F.lit('[{"type":"text","text":'), F.to_json(F.array("content")).substr(F.lit(2), F.length(F.to_json(F.array("content"))) - 2), F.lit("}]"))
    blocks = F.from_json(F.when(F.col("content").rlike(r"^\s*\["), F.col("content")).otherwise(text_only), block)
    rows = rows.select("session", "agent", "line", F.col("type").alias("who"), "meta", "ts", F.posexplode(blocks).alias("pos", "b")).select("session", "agent", "line", "who", "meta", "ts", "pos", "b.*")

    order = [F.col("agent") != "main", "line", "pos"]
    asks = (F.col("who") == "user") & (F.col("type") == "text") & ~F.col("meta") & (F.trim("text") != "") & ~is_injected(F.col("text")) & (F.col("agent") == "main")
    rows = episodes.prompt_index(rows, ["session", "agent"], ["line", "pos"], asks)
    prompts = rows.where(asks).select("session", "prompt_index", "text", "ts")

    # an agent's calls belong to the latest prompt before its first line, else to the first one
    begun = rows.where("agent != 'main'").groupBy("session", "agent").agg(F.min("ts").alias("first_ts"))
    before = begun.join(prompts.select("session", "prompt_index", "ts"), "session").groupBy("session", "agent", "first_ts").agg(
        F.coalesce(F.max(F.when(F.col("ts") <= F.col("first_ts"), F.col("prompt_index"))), F.min("prompt_index")).alias("own"))
    rows = rows.join(before.select("session", "agent", "own"), ["session", "agent"], "left").withColumn("prompt_index", F.when(F.col("agent") == "main", F.col("prompt_index")).otherwise(F.coalesce("own", F.lit(-1)))).drop("own")

    server, tool = builtin(F.col("name"), F.get_json_object("input", "$.command"))
    uses = rows.where((F.col("who") == "assistant") & (F.col("type") == "tool_use")).select("*", server.alias("server"), tool.alias("tool"))
    foreign = F.col("name").startswith("mcp__")
    mapped = ~foreign & (F.col("server") != "claude-code")
    w = W.partitionBy("session").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    uses = uses.withColumn("_active", F.max(foreign.cast("int")).over(w)).where(foreign | mapped | ((F.col("_active") == 1) & F.col("name").isin(*OWN_TOOLS)))
    uses = uses.select("session", "agent", F.col("id").alias("tool_use_id"), "line", "server", "tool", "input", "ts", "prompt_index")
    answers = rows.where((F.col("who") == "user") & (F.col("type") == "tool_result")).select("session", "agent", "tool_use_id", F.struct("line", "pos").alias("at"), folded_output(F.col("content")).alias("output"), F.coalesce("is_error", F.lit(False)).alias("is_error"))
    calls = episodes.pair_results(uses, answers, ["session", "agent", "tool_use_id"], "at")
    calls = episodes.resequence(calls, ["session"], "ts", "agent", tie=["at"]).drop("at", "line")

    talk = (F.col("who") == "assistant") & (F.col("type") == "text") & (F.trim("text") != "") & (F.col("agent") == "main")
    results = episodes.result_per_prompt(rows, ["session"], ["line", "pos"], "text", talk)
    return {"prompts": prompts, "calls": calls, "results": results}


def builtin(name: Column, command: Column) -> tuple[Column, Column]:
    """(server, tool) of a tool name: own tools that a built-in server can answer go to it; shell commands only without pipes or redirects."""
    git = F.regexp_extract(command, r"^\s*git\s+(log|show|grep|blame)\b", 1)
    plain = ~command.rlike(r"[|><;&`]|\$\(")
    server = F.when(name.isin("Read", "Grep", "Glob"), F.lit("code")).when((name == "Bash") & plain & (git != ""), F.lit("git")).otherwise(server_of(name))
    tool = F.when(name == "Read", F.lit("read_file")).when(name == "Grep", F.lit("grep")).when(name == "Glob", F.lit("glob")).when((name == "Bash") & plain & (git != ""), F.concat(F.lit("git_"), git)).otherwise(tool_of(name))
    return server, tool


def index(records: DataFrame) -> DataFrame:
    """One row a trace: what a listing needs without its arguments and results."""
    tools = F.array_sort(F.collect_list(F.when(F.col("kind") == "call", F.struct("line", F.concat_ws(".", "server", "tool").alias("t")))))
    return records.groupBy("file", "session_id").agg(F.transform(tools, lambda s: s["t"]).alias("nodes"), F.count_if(F.col("kind") == "call").alias("n_calls"), F.min_by("text", F.when(F.col("kind") == "prompt", F.col("line"))).alias("prompt"))


def changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """(file, state) by size and time against a stored index: new, changed, gone or same."""
    a, b = files.select("file", F.struct("size", "mtime").alias("now")), known.select("file", F.struct("size", "mtime").alias("was"))
    both = a.join(b, "file", "full_outer")
    return both.select("file", F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("now") == F.col("was"), "same").otherwise("changed").alias("state"))


def import_report(prompts: DataFrame, calls: DataFrame) -> DataFrame:
    """One row a session: prompts, episodes, calls, and calls per server by number and name."""
    per = calls.groupBy("session", "server").agg(F.count("*").alias("n"))
    named = per.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "server"))), lambda s: F.concat_ws(" ", s["server"], (-s["n"]).cast("string"))), ", ").alias("servers"), F.sum("n").alias("calls"))
    eps = calls.groupBy("session").agg(F.countDistinct("prompt_index", "agent").alias("episodes"))
    return prompts.groupBy("session").agg(F.count("*").alias("prompts")).join(named, "session", "left").join(eps, "session", "left")
