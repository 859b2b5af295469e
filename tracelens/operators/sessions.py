"""Sessions: which prompt a call or a subagent belongs to, what a prompt gives as inputs, and which values a call carries on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .episodes import as_of

# Kinds of ids that a flow may take, sizes of a whole argument, plain names, and what is not carried.
INPUT_TYPES = ("jira_key", "sha40", "sha_short", "trace_id", "trace_id16", "uuid", "k8s_pod", "slack_ts", "slack_channel_id", "slack_channel", "slack_user_id", "slack_dm_id", "pd_incident_id", "pd_service_id")
MIN_INPUT, MAX_INPUT = 3, 80
PLAIN_NAME = r"^[A-Za-z][A-Za-z0-9_]{1,39}$"
MIN_CARRIED = 5
NOT_CARRIED = r"^(\d+|\d{4}-\d{2}-\d{2}(T\S*)?|\d{10}\.\d+)$"
WORD = r"[\p{L}\p{N}_]+"


def join_hook_calls(hook: DataFrame, transcript: DataFrame, session: list[str], use: str) -> tuple[DataFrame, DataFrame]:
    """Hook calls with the agent and prompt of the transcript's call of the same use id, and (session, joined, unjoined).

    A use id that the transcript has more than once counts with its first line.
    """
    first = transcript.where(F.col(use).isNotNull()).groupBy(*session, use).agg(F.min_by(F.struct("agent", "prompt_index"), "seq").alias("_t"))
    both = hook.join(first, [*session, use], "left")
    counts = both.groupBy(*session).agg(F.count_if(F.col("_t").isNotNull()).alias("joined"), F.count_if(F.col("_t").isNull()).alias("unjoined"))
    return both.select(*hook.columns, "_t.agent", "_t.prompt_index"), counts


def spawning_prompts(agents: DataFrame, uses: DataFrame, prompts: DataFrame, session: str) -> DataFrame:
    """(session, agent, prompt_index) of each subagent: by the use that started it, else by a use with its instruction, else by the last prompt before its first line, else the first prompt, else -1.

    agents: (session, agent, use_id, instruction, first_ts); uses: (session, use_id, instruction, prompt_index); prompts: (session, prompt_index, ts).
    """
    by_id = uses.where("use_id is not null").groupBy(session, "use_id").agg(F.min("prompt_index").alias("_by_id"))
    by_text = uses.where("instruction is not null").groupBy(session, "instruction").agg(F.min_by("prompt_index", "use_id").alias("_by_text"))
    timed = prompts.select(session, "ts", F.col("prompt_index").alias("_at"), F.col("prompt_index").alias("tie"))
    first = prompts.groupBy(session).agg(F.min("prompt_index").alias("_first"))
    rows = as_of(agents.withColumn("first_ts", F.coalesce("first_ts", F.lit(""))), timed, [session], "first_ts", "ts", "_at", "tie")
    rows = rows.join(by_id, [session, "use_id"], "left").join(by_text, [session, "instruction"], "left").join(first, session, "left")
    return rows.select(session, "agent", F.coalesce("_by_id", "_by_text", "as_of__at", "_first", F.lit(-1)).alias("prompt_index"))


def prompt_inputs(prompts: DataFrame, mentions: DataFrame, args: DataFrame, session: list[str], secret: Column | None = None) -> DataFrame:
    """(session, name, value) of what a prompt gives to the calls after it.

    prompts: (session, text); mentions: (session, kind, value, pos), the typed ids of the prompt; args: (session, at, name, value),
    the calls' scalar arguments.  An id counts if some argument holds it; it is named after the argument that is passed
    exactly it, if there is one such name only, else after its kind.  Then whole arguments that the prompt quotes count,
    by name, if they are short, on one line, no ``secret`` and no input already.  The first of a name stays.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)))
    own = args.where("value is not null").select(*session, "at", "name", "value")
    ids = mentions.where(F.col("kind").isin(*INPUT_TYPES)).groupBy(*session, "kind", "value").agg(F.min("pos").alias("pos"))
    # an id stands in an argument only if its first word does: an equi-join, no comparison of all pairs
    inside = own.select(*session, F.col("value").alias("arg"), F.explode(words(F.col("value"))).alias("_w")).distinct()
    used = ids.withColumn("_w", F.regexp_extract("value", WORD, 0)).join(inside, [*session, "_w"]).where(F.contains("arg", F.col("value"))).select(*ids.columns).distinct()
    names = own.where(F.col("name").rlike(PLAIN_NAME)).groupBy(*session, "value").agg(F.min("name").alias("lo"), F.max("name").alias("hi"))
    named = used.join(names, [*session, "value"], "left").select(*session, F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("kind")).alias("name"), "value", F.lit(0).alias("turn"), F.col("pos").alias("place"))
    whole = own.where(F.col("name").rlike(PLAIN_NAME) & F.length("value").between(MIN_INPUT, MAX_INPUT) & ~F.contains("value", F.lit("\n")))
    whole = whole.groupBy(*session, "name").agg(F.min_by("value", F.struct("at", "name", "value")).alias("value"), F.min("at").alias("place"))
    quoted = whole.join(prompts.select(*session, "text"), session).where(F.contains("text", F.col("value")))
    if secret is not None:
        quoted = quoted.where(~secret)
    quoted = quoted.join(named.select(*session, "value").distinct(), [*session, "value"], "left_anti").select(*session, "name", "value", F.lit(1).alias("turn"), "place")
    both = named.unionByName(quoted)
    by_name = W.partitionBy(*session, "name").orderBy("turn", "place", "value")
    by_value = W.partitionBy(*session, "value").orderBy("turn", "place", "name")
    return both.withColumn("_n", F.row_number().over(by_name)).where("_n = 1").withColumn("_n", F.row_number().over(by_value)).where("_n = 1 or turn = 0").select(*session, "name", "value")


def carried_values(parts: DataFrame, outputs: DataFrame, inputs: DataFrame, session: list[str]) -> DataFrame:
    """(session, at, value, source) of the values of a call that an earlier result holds: ``inputs`` if the session's inputs hold it, else the latest such call.

    parts: (session, at, value), the scalar arguments and the ids in them; outputs: (session, at, text); inputs: (session, text).
    Short values, plain numbers, dates and times are not carried.  Values meet texts by their first word.  A value that is
    one word needs no text beside that word: values and words are passed once in the order of their calls, so no text
    is carried along with its words and no value meets all calls that have it.  Only longer values look into the texts,
    one by one, where their first word stands.
    """
    v = parts.select(*session, "at", F.trim("value").alias("value")).where((F.length("value") >= MIN_CARRIED) & ~F.col("value").rlike(NOT_CARRIED)).distinct()
    v = v.withColumn("_w", F.regexp_extract("value", WORD, 0))
    words = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("_w")
    at_type = dict(parts.dtypes)["at"]
    # inputs come before all calls, a call's values before what it gave
    rows = v.where("value = _w").select(*session, "_w", F.lit(1).alias("_kind"), "at").unionByName(inputs.select(*session, words, F.lit(0).alias("_kind"), F.lit(None).cast(at_type).alias("at"))).unionByName(outputs.select(*session, words, F.lit(2).alias("_kind"), F.col("at").cast(at_type).alias("at")))
    before = W.partitionBy(*session, "_w").orderBy(F.col("at").asc_nulls_first(), "_kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = rows.withColumn("_given", F.max(F.col("_kind") == 0).over(before)).withColumn("src", F.max(F.when(F.col("_kind") == 2, F.col("at"))).over(before))
    plain = seen.where("_kind = 1").select(*session, "at", F.col("_w").alias("value"), "_given", "src")
    long = v.where("value != _w")
    cut = lambda df, *at: df.select(*session, *at, F.xxhash64("text").alias("_text"), words)
    whole = lambda df, *at: df.select(*session, *at, F.xxhash64("text").alias("_text"), "text").distinct()
    src = F.col("at").cast(at_type).alias("src")
    met = long.select(*session, "value", "_w").distinct().join(cut(inputs), [*session, "_w"]).select(*session, "value", "_text").join(whole(inputs), [*session, "_text"])
    given = met.where(F.contains("text", F.col("value"))).select(*session, "value").distinct().withColumn("_given", F.lit(True))
    met = long.join(cut(outputs, src), [*session, "_w"]).where(F.col("src") < F.col("at")).select(*session, "at", "value", "src", "_text").join(whole(outputs, src), [*session, "src", "_text"])
    found = met.where(F.contains("text", F.col("value"))).groupBy(*session, "at", "value").agg(F.max("src").alias("src"))
    phrases = long.select(*session, "at", "value").join(given, [*session, "value"], "left").join(found, [*session, "at", "value"], "left").select(*session, "at", "value", "_given", "src")
    source = F.when(F.col("_given"), F.lit("inputs")).otherwise(F.concat(F.lit("c"), F.col("src").cast("string")))
    return plain.unionByName(phrases).where("_given or src is not null").select(*session, "at", "value", source.alias("source"))


def step_calls(steps: DataFrame, calls: DataFrame, session: list[str]) -> DataFrame:
    """Each call with the collapsed step that it belongs to: the last step that does not begin after it.

    steps: (session, idx, step); calls: (session, idx, ..).
    """
    facts = steps.select(*session, F.col("idx").alias("since"), "step", F.col("idx").alias("tie"))
    return as_of(calls, facts, session, "idx", "since", "step", "tie").withColumnRenamed("as_of_step", "step")


def until_failure(runs: DataFrame, run: list[str], order: str, failed: Column) -> DataFrame:
    """The steps of each run up to the first required one that failed, with the run's ``status``; steps of one place stay together."""
    first = F.min(F.when(failed, F.col(order))).over(W.partitionBy(*run))
    rows = runs.withColumn("_first", first).where(F.col("_first").isNull() | (F.col(order) <= F.col("_first")))
    return rows.withColumn("status", F.when(F.col("_first").isNull(), F.lit("ok")).otherwise(F.lit("failed"))).drop("_first")


def window_choice(uses: DataFrame, key: list[str]) -> DataFrame:
    """The window template of a time argument: of most sessions, then the widest, then the first by text; and in how many sessions.

    uses: (key, session, template, width); such arguments never become a ladder.
    """
    n = uses.groupBy(*key, "template").agg(F.countDistinct("session").alias("sessions"), F.max("width").alias("width"))
    best = F.min_by(F.struct("template", "sessions"), F.struct((-F.col("sessions")).alias("a"), (-F.col("width")).alias("b"), "template"))
    return n.groupBy(*key).agg(best.alias("b"), F.count("*").alias("variants")).select(*key, "b.template", "b.sessions", "variants")


def template_references(steps: DataFrame, flow: list[str]) -> DataFrame:
    """(flow, source, ref, target): what each step's templates refer to, one row for each step and reference.

    steps: (flow, step, text), the text being all of a step's templates.
    """
    ref = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\{\{\s*([A-Za-z_]\w*(?:[.\[][^}|]*)?)\s*(?:\|[^}]*)?\}\}"), F.lit(1))))
    rows = steps.select(*flow, F.col("step").alias("target"), ref.alias("ref")).withColumn("ref", F.trim("ref"))
    return rows.select(*flow, F.regexp_extract("ref", r"^\w+", 0).alias("source"), "ref", "target").where("ref not like 'item%'")
