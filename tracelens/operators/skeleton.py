"""Skeleton cards of induced flows: what each is for, what it should find, and what it does not look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The servers that a flow may ask, and each tool's group of evidence and what it gives.
SERVERS = ("jira", "slack", "confluence", "chronosphere", "logz", "pagerduty", "git", "code")
GROUPS = {
    "jira.jira_get_issue": ("ticket", "the Jira ticket"), "jira.jira_search": ("related tickets", "Jira tickets found by search"), "jira.jira_get_issue_comments": ("ticket comments", "the comments on the ticket"),
    "slack.conversations_search_messages": ("slack discussion", "Slack messages found by search"), "slack.conversations_replies": ("thread", "the replies of the Slack thread"), "slack.conversations_history": ("conversation", "the channel or DM history"),
    "code.grep": ("code", "source lines that raise or log the error"), "code.read_file": ("code", "the source file that handles the request"), "code.codeowners": ("owning team", "CODEOWNERS entries for the matching files"),
    "confluence.confluence_search": ("runbook", "Confluence pages found by search"), "confluence.confluence_get_page": ("runbook", "the runbook page body"),
    "chronosphere.query_prometheus_range": ("metrics", "a metric series over the window"), "chronosphere.query_prometheus": ("metrics", "a metric value"), "logz.search_logs": ("logs", "log lines"),
    "git.git_log": ("commits", "commits touching the service just before"), "git.git_show": ("suspect commit", "the diff of a commit named in the evidence"),
    "pagerduty.list_incidents": ("pagerduty incident", "PagerDuty incidents on the service in the window"), "pagerduty.get_incident": ("pagerduty incident", "the PagerDuty incident"), "pagerduty.list_services": ("pagerduty services", "the PagerDuty service list"),
}


def _of(tool: Column, part: int, other: Column) -> Column:
    out = other
    for name, both in GROUPS.items():
        out = F.when(tool == name, both[part]).otherwise(out)
    return out


def group_of(step: Column, tool: Column) -> Column:
    """The group of evidence of a step: repeats by its name, else by its tool, else by its server."""
    return F.when(step.rlike("repeat|recurr"), "repeats").otherwise(_of(tool, 0, F.substring_index(tool, ".", 1)))


def expected_outputs(steps: DataFrame, arguments: DataFrame) -> DataFrame:
    """(trigger, place, name, steps, description, required): one output for each group of evidence of a flow, in the order of its first step.

    steps and arguments are those of ``flows.Flows``; a group is required if one of its steps found something in every
    session.  A description tells each step's tool, fan-out and ladders.
    """
    ladders = arguments.where("kind = 'ladder'").groupBy("trigger", "id").agg(F.array_sort(F.collect_list(F.concat(F.size("templates").cast("string"), F.lit("-rung ladder on "), F.col("arg")))).alias("ladders"))
    rows = steps.join(ladders, ["trigger", "id"], "left").withColumn("name", group_of(F.col("id"), F.col("tool")))
    none = F.array().cast("array<string>")
    fan = F.when(F.col("for_each").isNotNull(), F.array(F.concat(F.lit("per item of `"), F.col("for_each"), F.lit("`")), F.concat(F.lit("first "), F.col("max_items").cast("string")))).otherwise(none)
    told = F.concat(_of(F.col("tool"), 1, F.col("tool")), F.lit(" ("), F.array_join(F.concat(F.array("tool"), fan, F.coalesce("ladders", none)), ", "), F.lit(")"))
    rows = rows.withColumn("told", told)
    one = F.array_sort(F.collect_list(F.struct("place", "id", "told")))
    return rows.groupBy("trigger", "name").agg(one.alias("s"), F.min("place").alias("place"), F.bool_or("expected").alias("required")).select(
        "trigger", "place", "name", F.transform("s", lambda x: x["id"]).alias("steps"), F.array_join(F.transform("s", lambda x: x["told"]), "; ").alias("description"), "required")


def skeletons(steps: DataFrame, arguments: DataFrame, inputs: DataFrame) -> DataFrame:
    """(trigger, use_case, inputs, outputs, not_covered, found) of every flow; a flow without inputs or outputs has empty lists."""
    outputs = expected_outputs(steps, arguments)
    per = outputs.groupBy("trigger").agg(F.array_sort(F.collect_list(F.struct("place", "name", "steps", "description", "required"))).alias("outputs"))
    explained = F.concat("name", F.lit(" ("), "type", F.lit(")"), F.coalesce(F.concat(F.lit(", e.g. "), F.col("example")), F.lit("")))
    given = inputs.groupBy("trigger").agg(F.array_sort(F.collect_list(F.struct("name", explained.alias("text")))).alias("inputs"))
    about = steps.groupBy("trigger").agg(
        F.collect_set(F.substring_index("tool", ".", 1)).alias("used"), F.array_sort(F.collect_list(F.when(F.col("for_each").isNotNull(), F.struct("place", F.concat("id", F.lit(" looks at the first "), F.col("max_items").cast("string"), F.lit(" items of its fan-out only")).alias("t"))))).alias("fans"),
        F.array_sort(F.collect_list(F.when(F.col("expected"), F.col("id")))).alias("always"))
    rows = about.join(per, "trigger", "left").join(given, "trigger", "left")
    names = F.coalesce(F.array_join(F.transform("inputs", lambda x: x["name"]), ", "), F.lit("no inputs"))
    gathered = F.coalesce(F.nullif(F.array_join(F.transform("outputs", lambda x: x["name"]), ", "), F.lit("")), F.lit("nothing yet"))
    missing = F.transform(F.filter(F.array(*[F.lit(s) for s in SERVERS]), lambda s: ~F.array_contains("used", s)), lambda s: F.concat(F.lit("no "), s, F.lit(" lookups")))
    kind = F.replace("trigger", F.lit("_"), F.lit(" "))
    return rows.select(
        "trigger", F.concat(F.lit("Run it on a "), kind, F.lit(" ("), names, F.lit(") to gather: "), gathered, F.lit(".")).alias("use_case"), F.coalesce(F.transform("inputs", lambda x: x["text"]), F.array().cast("array<string>")).alias("inputs"),
        "outputs", F.concat(missing, F.transform("fans", lambda x: x["t"])).alias("not_covered"), F.when(F.size("always") > 0, F.concat(F.lit("Every traced run had hits on: "), F.array_join("always", ", "), F.lit("."))).otherwise("").alias("found"))
