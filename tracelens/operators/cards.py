"""Evidence cards: the results of any tool as one table of tagged rows, and their groups by type of information.

A result is JSON.  What a tool's result holds is stated as a shape: where its list is, and which paths give each
attribute.  Every result is parsed once to a VARIANT, its list opened, and the attributes of its kind are read by path,
so one pass of the table serves all tools.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shape:
    """A kind of card: its attributes by path (the first that is there counts), those that make it the same card, and what is shown if its list is empty."""

    kind: str
    attrs: dict[str, str | tuple[str, ...]]
    key: tuple[str, ...] = ()
    lists: dict[str, str | None] = field(default_factory=dict)  # tool: path of its list, None for the result itself
    empty: str | None = None


# Tools, the fields of their results, the types of information and their order.
SHAPES = (
    Shape("issue", {"key": "key", "summary": "fields.summary", "status": "fields.status.name", "priority": "fields.priority.name", "assignee": "fields.assignee.displayName", "created": "fields.created", "components": "fields.components[*].name", "text": "fields.description"}, ("key",), {"jira_get_issue": None, "jira_search": "issues"}),
    Shape("message", {"user": ("username", "user"), "channel": "channel.name", "ts": "ts", "time": "time", "text": "text", "permalink": "permalink", "replies": "reply_count"}, ("channel", "ts"), {"conversations_search_messages": "messages.matches", "conversations_replies": "messages", "conversations_history": "messages"}),
    Shape("page", {"id": "id", "title": "title", "space": "space.key", "excerpt": "excerpt", "body": "body", "url": "url", "modified": "last_modified"}, ("id",), {"confluence_search": "results", "confluence_get_page": None}),
    Shape("log", {"ts": ("_source['@timestamp']", "['@timestamp']"), "level": ("_source.level", "level"), "service": ("_source.service", "service"), "pod": ("_source['kubernetes.pod_name']", "['kubernetes.pod_name']"), "trace_id": ("_source.trace_id", "trace_id"), "text": ("_source.message", "message")}, ("ts", "pod", "text"), {"search_logs": "hits", "search_logs_simple": "hits"}, "no log lines"),
    Shape("series", {"labels": "metric", "values": "values"}, (), {"query_prometheus_range": "data.result"}),
    Shape("code", {"file": "file", "line": "line", "text": "text", "context": "context"}, ("file", "line"), {"grep": "matches", "git_grep": "matches"}, "no matches"),
    Shape("commit", {"sha": "sha", "author": "author", "date": "date", "text": "subject"}, ("sha",), {"git_log": "commits"}, "no commits in window"),
    Shape("incident", {"id": "id", "number": "incident_number", "title": "title", "status": "status", "urgency": "urgency", "created": "created_at", "resolved": "resolved_at", "assignee": "assignments[0].assignee.summary", "url": "html_url", "text": "body.details"}, ("id",), {"list_incidents": "incidents", "get_incident": None}),
    Shape("owners", {"path": "path", "owners": "owners[*]"}, ("path", "owners"), {"codeowners": None}),
    Shape("source", {"path": "path", "start": "start", "text": "content"}, (), {"read_file": None}),
)
KIND_TYPE = {"issue": "issue", "message": "message", "page": "page", "log": "log", "series": "metric", "code": "code", "source": "code", "commit": "commit", "diff": "commit", "incident": "incident", "owners": "owners"}
SERVER_TYPE = {"jira": "issue", "slack": "message", "confluence": "page", "logz": "log", "chronosphere": "metric", "code": "code", "git": "commit", "pagerduty": "incident", "flows": "flow"}
GROUP_ORDER = ("issue", "incident", "message", "metric", "log", "commit", "code", "owners", "page", "flow", "other")
JSON_CHARS, DIFF_CHARS, ERROR_CHARS = 6000, 8000, 400


def _read(v: Column, path: str) -> Column:
    """The text at a path of a VARIANT; ``[*]`` gives all of them with commas between."""
    if "[*]" in path:
        head, tail = path.split("[*]")
        items = F.try_variant_get(v, f"$.{head}", "array<variant>")
        return F.array_join(F.transform(items, lambda x: F.try_variant_get(x, f"${tail}", "string")), ",")
    return F.try_variant_get(v, "$" + ("" if path.startswith("[") else ".") + path, "string")


def _n_values(v: Column) -> Column:
    """How many values a series has, null if none."""
    return F.nullif(F.size(F.try_variant_get(v, "$.values", "array<variant>")), F.lit(0))


def _attributes(shape: Shape, v: Column) -> Column:
    """map<string,string> of what a card has; null for a series without values."""
    found = [(name, F.coalesce(*[_read(v, p) for p in ((paths,) if isinstance(paths, str) else paths)])) for name, paths in shape.attrs.items()]
    if shape.kind == "series":
        ys = F.transform(F.try_variant_get(v, "$.values", "array<variant>"), lambda p: F.try_variant_get(p, "$[1]", "double"))
        found = [("labels", F.try_variant_get(v, "$.metric", "string")), ("min", F.array_min(ys).cast("string")), ("max", F.array_max(ys).cast("string")), ("n", _n_values(v).cast("string"))]
    entries = F.array(*[F.struct(F.lit(n).alias("key"), c.alias("value")) for n, c in found])
    made = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    return F.when(_n_values(v).isNotNull(), made) if shape.kind == "series" else made


def _by_tool(tool: Column, of) -> Column:
    """``of(shape, list path)`` of the shape of each tool, null for tools without one."""
    out = None
    for shape in SHAPES:
        for name, path in shape.lists.items():
            value = of(shape, path)
            out = F.when(tool == name, value) if out is None else out.when(tool == name, value)
    return out


def cards(results: DataFrame, key: list[str]) -> DataFrame:
    """``results`` (key, tool, result, error, ..) as cards: (all columns but result and error, card, kind, id, attrs).

    ``card`` numbers the cards of a result; ``id`` is what two cards of one thing share, null for kinds without one.
    A result of only an ``error`` is an error card, as is a text that begins with ``error``, or an error without a card.
    An empty list of logs, matches or commits is one ``empty`` card.  What no shape fits, or gives nothing, is a ``json``
    card of its first ``JSON_CHARS`` characters; git_show is a ``diff``.  A null result without an error gives none, and
    a series without values is none.
    """
    tool = F.substring_index("tool", ".", -1)
    v = F.try_parse_json("result")
    # what has neither a result nor an error gives no card
    rows = results.where("result is not null or error is not null").withColumn("_tool", tool).withColumn("_v", v).withColumn("_has", F.col("result").isNotNull())
    # the schema of a long result is costly: once a row
    rows = rows.withColumn("_schema", F.schema_of_variant("_v"))
    rows = rows.withColumn("_object", F.coalesce(F.col("_schema").startswith("OBJECT"), F.lit(False))).withColumn("_lone", F.col("_object") & F.col("_schema").rlike(r"^OBJECT<error: [^<,]*>$"))
    object_, lone_error = F.col("_object"), F.col("_lone")
    text_error = F.col("_has") & ~object_ & F.lower(F.ltrim(F.coalesce(F.try_variant_get("_v", "$", "string"), "result"))).startswith("error")
    many = lambda path: F.try_variant_get("_v", f"$.{path}", "array<variant>") if path else F.array(F.col("_v"))
    items = F.when(object_ & ~lone_error, F.coalesce(_by_tool(F.col("_tool"), lambda s, p: many(p)), F.array().cast("array<variant>"))).otherwise(F.array().cast("array<variant>"))
    # searches of messages may give them as a plain list too, and one incident stands for a list of one
    items = F.when(object_ & ~lone_error & (F.col("_tool") == "conversations_search_messages") & (F.size(items) <= 0), many("messages")).when(object_ & ~lone_error & (F.col("_tool") == "get_incident"), F.coalesce(many("incidents"), F.array("_v"))).otherwise(items)
    rows = rows.withColumn("_kind", _by_tool(F.col("_tool"), lambda s, p: F.lit(s.kind))).withColumn("_items", items)
    # of a series result, the raw text counts only if none of its series has values
    rows = rows.withColumn("_some", F.exists("_items", lambda x: _n_values(x).isNotNull()) & (F.col("_kind") == "series"))
    rows = rows.withColumn("_err", F.when(lone_error, F.try_variant_get("_v", "$.error", "string")).when(text_error, F.substring(F.coalesce(F.try_variant_get("_v", "$", "string"), "result"), 1, ERROR_CHARS)).when(~F.col("_has"), F.substring("error", 1, ERROR_CHARS)))
    keep = [c for c in results.columns if c not in ("result", "error")]
    opened = rows.select(*keep, "_kind", "_tool", "_has", "_err", "result", "_some", F.size("_items").alias("_n"), "_object", F.posexplode_outer("_items").alias("card", "_x"))
    attrs = None
    for s in SHAPES:
        attrs = F.when(F.col("_kind") == s.kind, _attributes(s, F.col("_x"))) if attrs is None else attrs.when(F.col("_kind") == s.kind, _attributes(s, F.col("_x")))
    opened = opened.withColumn("attrs", F.when(F.col("_x").isNotNull(), attrs))
    said = lambda kind, text: F.struct(F.lit(kind).alias("kind"), F.create_map(F.lit("text"), text).alias("attrs"))
    none_found = _by_tool(F.col("_tool"), lambda s, p: F.lit(s.empty).cast("string"))
    card = (
        F.when(F.col("_err").isNotNull(), said("error", F.col("_err"))).when(~F.col("_has"), None)
        .when((F.col("_tool") == "git_show"), said("diff", F.substring("result", 1, DIFF_CHARS)))
        .when(F.col("attrs").isNotNull(), F.struct(F.col("_kind").alias("kind"), F.col("attrs").alias("attrs")))
        .when((F.col("_n") > 0) & (F.col("_kind") == "series"), F.when((F.col("card") == 0) & ~F.coalesce("_some", F.lit(False)), said("json", F.substring("result", 1, JSON_CHARS))))
        .when((F.coalesce(F.col("_n"), F.lit(0)) <= 0) & none_found.isNotNull() & F.col("_object"), said("empty", none_found))
        .otherwise(said("json", F.substring("result", 1, JSON_CHARS)))
    )
    # a generator of one row: conditions on a card would else be moved below it, where they read the result again
    made = opened.select(*keep, F.coalesce("card", F.lit(0)).alias("card"), F.explode(F.array(card)).alias("_c")).where("_c is not null").select(*keep, "card", "_c.kind", "_c.attrs")
    ids = None
    for s in SHAPES:
        if s.key:
            one = F.to_json(F.struct(F.lit(s.kind).alias("kind"), *[F.col("attrs")[k].alias(k) for k in s.key]))
            ids = F.when(F.col("kind") == s.kind, one) if ids is None else ids.when(F.col("kind") == s.kind, one)
    return made.select(*keep, "card", "kind", ids.alias("id"), "attrs")


def card_type(kind: Column, tool: Column) -> Column:
    """The type of information of a card: by its kind, else by the server of its tool."""
    server = F.substring_index(tool, ".", 1)
    by_kind, by_server = F.lit(None).cast("string"), F.lit("other")
    for k, t in KIND_TYPE.items():
        by_kind = F.when(kind == k, t).otherwise(by_kind)
    for s, t in SERVER_TYPE.items():
        by_server = F.when(server == s, t).otherwise(by_server)
    return F.coalesce(by_kind, F.when(tool == "code.codeowners", "owners").otherwise(by_server))


def evidence(found: DataFrame, run: list[str], order: list[str]) -> DataFrame:
    """Cards (run, order.., tool, card, kind, id, attrs) without repeats and empty ones, with ``type`` and the ``place`` of it.

    Of several cards of one thing the first stays; but a page that comes again with its body takes the place of all
    before it.  Cards without an id all stay.
    """
    rows = found.where("kind != 'empty'").withColumn("type", card_type(F.col("kind"), F.col("tool")))
    at = F.struct(*order, "card")
    # cards without an id are each their own group, so that no group holds all of a run
    same = W.partitionBy(*run, "id", F.when(F.col("id").isNull(), at))
    body = F.when((F.col("kind") == "page") & (F.coalesce(F.col("attrs")["body"], F.lit("")) != ""), at)
    kept = rows.withColumn("_first", F.min(at).over(same)).withColumn("_body", F.max(body).over(same))
    kept = kept.where(F.col("id").isNull() | (at == F.coalesce("_body", "_first"))).drop("_first", "_body")
    return kept.withColumn("place", F.array_position(F.array(*[F.lit(t) for t in GROUP_ORDER]), F.col("type")).cast("long"))


def groups(shown: DataFrame, run: list[str], step: str) -> DataFrame:
    """(run, place, type, cards, sources, steps): the groups of a run in their order; ``sources`` are the steps and items that gave cards, ``steps`` the steps by name."""
    item = F.struct(step, "item") if "item" in shown.columns else F.struct(step)
    return shown.groupBy(*run, "place", "type").agg(F.count("*").alias("cards"), F.countDistinct(item).alias("sources"), F.array_sort(F.collect_set(step)).alias("steps"))


# Cards of a step or item, items of a step, characters of a card's text and of a run.
MOST_CARDS, MOST_ITEMS, TEXT_CHARS, RUN_CHARS = 3, 6, 280, 14_000


def capped(shown: DataFrame, run: list[str], step: list[str], most_chars: int = RUN_CHARS) -> DataFrame:
    """Cards (run, step.., item, card, attrs) of a summary: at most ``MOST_CARDS`` of each item and ``MOST_ITEMS`` items of a step, fewer cards where a run would be too long.

    Texts are cut to ``TEXT_CHARS`` characters.  Of three, two, one or no cards an item, a run gets the most with which
    all its cards take at most ``most_chars`` characters: the totals of all four come from one aggregate.  Adds
    ``per_item``, the number that a run got, and ``truncated``.
    """
    rank = lambda of, order: F.row_number().over(W.partitionBy(*of).orderBy(*order))
    places = F.dense_rank().over(W.partitionBy(*run, *step).orderBy("item"))
    cut = F.transform_values("attrs", lambda k, v: F.when(F.length(v) > TEXT_CHARS, F.concat(F.substring(v, 1, TEXT_CHARS), F.lit("…"))).otherwise(v))
    rows = shown.withColumn("attrs", cut).withColumn("_n", rank([*run, *step, "item"], ["card"])).withColumn("_item", places).where(F.col("_item") <= MOST_ITEMS).withColumn("_size", F.length(F.to_json("attrs")))
    totals = rows.groupBy(*run).agg(*[F.sum(F.when(F.col("_n") <= n, F.col("_size")).otherwise(0)).alias(f"_t{n}") for n in range(MOST_CARDS, 0, -1)])
    level = F.lit(0)
    for n in range(1, MOST_CARDS + 1):
        level = F.when(F.col(f"_t{n}") <= most_chars, n).otherwise(level)
    levels = totals.select(*run, level.alias("per_item"))
    return rows.join(levels, run).where(F.col("_n") <= F.col("per_item")).withColumn("truncated", F.col("per_item") < MOST_CARDS).drop("_n", "_item", "_size")


def lede(facts: DataFrame) -> Column:
    """The opening sentences of a report from its facts; a missing fact makes no sentence.

    facts may have: what, service, started, resolved, duration, status, owners (array), person, commits (number), sha,
    subject, repeat_of, caused_by.
    """
    has = lambda name: F.col(name) if name in facts.columns else F.lit(None).cast("string")
    what, service, started, resolved = has("what"), has("service"), has("started"), has("resolved")
    owners = F.array_join("owners", ", ") if "owners" in facts.columns else F.lit(None).cast("string")
    owned = F.when(F.coalesce(owners, F.lit("")) != "", owners)
    person = F.coalesce(F.concat(F.lit(" ("), has("person"), F.lit(" on it)")), F.lit(""))
    ended = F.coalesce(F.concat(F.lit(", resolved after "), F.when(resolved.isNotNull(), has("duration"))), F.concat(F.lit(", resolved "), resolved), F.lit(""))
    n = has("commits").cast("long")
    some = F.when(n > 1, F.concat(n.cast("string"), F.lit(" commits"))).when(n == 1, "One commit")
    sentences = [
        F.when(what.isNotNull() & service.isNotNull(), F.concat(what, F.lit(" on "), service)).when(what.isNotNull(), what).when(service.isNotNull(), F.concat(F.lit("An incident on "), service)),
        F.concat(F.lit("Fired "), started, ended), F.when(resolved.isNull(), F.concat(F.lit("The incident is "), has("status"))), F.concat(F.lit("Owned by "), owned, person),
        F.when(has("sha").isNotNull(), F.concat(some, F.lit(" touched the service just before, latest "), has("sha"), F.lit(" “"), has("subject"), F.lit("”"))).otherwise(F.concat(some, F.lit(" just before: "), has("subject"))),
        F.concat(F.lit("This is a repeat of "), has("repeat_of")), F.concat(F.lit("Caused by "), has("caused_by")),
    ]
    return F.concat_ws(" ", *[F.concat(s, F.lit(".")) for s in sentences])
