"""Evidence cards of every tool, odd results, and groups."""

import json

from tracelens.operators import cards

ISSUE = {"key": "A-1", "fields": {"summary": "s", "status": {"name": "Done"}, "components": [{"name": "x"}, {"name": "y"}], "assignee": None, "description": "d"}}
HIT = {"_source": {"@timestamp": "t1", "level": "ERROR", "kubernetes.pod_name": "p-1", "message": "boom"}}
SCHEMA = "run long, n long, step string, item string, tool string, result string, error string"


def made(spark, results):
    rows = [(1, i, f"s{i}", None, tool, r if r is None or isinstance(r, str) else json.dumps(r), e) for i, (tool, r, e) in enumerate(results)]
    got = {}
    for r in cards.cards(spark.createDataFrame(rows, SCHEMA), ["run", "n"]).orderBy("n", "card").collect():
        got.setdefault(r["n"], []).append((r["kind"], r["attrs"]))
    return [got.get(i, []) for i in range(len(rows))]


def test_cards_of_every_tool(spark):
    message = {"user": "u", "channel": {"name": "ops"}, "ts": "1.5", "text": "hi"}
    got = made(spark, [
        ("jira.jira_get_issue", ISSUE, None), ("jira.jira_search", {"issues": [ISSUE, {"key": "A-2"}]}, None), ("slack.conversations_search_messages", {"messages": {"matches": [message]}}, None), ("slack.conversations_search_messages", {"messages": [message]}, None),
        ("slack.conversations_replies", {"messages": [{**message, "username": "name"}]}, None), ("confluence.confluence_search", {"results": [{"id": 7, "title": "t", "space": {"key": "K"}, "excerpt": "e"}]}, None), ("confluence.confluence_get_page", {"id": 7, "title": "t", "body": "b"}, None),
        ("logz.search_logs", {"hits": [HIT, {"level": "INFO", "message": "plain"}]}, None), ("chronosphere.query_prometheus_range", {"data": {"result": [{"metric": {"a": "b"}, "values": [[1, "2.5"], [2, "0.5"]]}, {"metric": {}, "values": []}]}}, None),
        ("code.grep", {"matches": [{"file": "f", "line": 3, "text": "x"}]}, None), ("git.git_log", {"commits": [{"sha": "abc", "subject": "fix"}]}, None), ("git.git_show", "diff --git a b", None), ("pagerduty.list_incidents", {"incidents": [{"id": "P1", "incident_number": 4, "assignments": [{"assignee": {"summary": "ann"}}]}]}, None),
        ("pagerduty.get_incident", {"id": "P2", "incident_number": 5}, None), ("code.codeowners", {"path": "a", "owners": ["@x", "@y"]}, None), ("code.read_file", {"path": "a", "start": 1, "content": "c"}, None),
    ])
    issue = ("issue", {"key": "A-1", "summary": "s", "status": "Done", "components": "x,y", "text": "d"})
    said = ("message", {"user": "u", "channel": "ops", "ts": "1.5", "text": "hi"})
    assert got[:7] == [[issue], [issue, ("issue", {"key": "A-2"})], [said], [said], [("message", {**said[1], "user": "name"})], [("page", {"id": "7", "title": "t", "space": "K", "excerpt": "e"})], [("page", {"id": "7", "title": "t", "body": "b"})]]
    assert got[7] == [("log", {"ts": "t1", "level": "ERROR", "pod": "p-1", "text": "boom"}), ("log", {"level": "INFO", "text": "plain"})]
    assert got[8] == [("series", {"labels": '{"a":"b"}', "min": "0.5", "max": "2.5", "n": "2"})]
    assert got[9:12] == [[("code", {"file": "f", "line": "3", "text": "x"})], [("commit", {"sha": "abc", "text": "fix"})], [("diff", {"text": "diff --git a b"})]]
    assert got[12:] == [[("incident", {"id": "P1", "number": "4", "assignee": "ann"})], [("incident", {"id": "P2", "number": "5"})], [("owners", {"path": "a", "owners": "@x,@y"})], [("source", {"path": "a", "start": "1", "text": "c"})]]


def test_cards_of_odd_results(spark):
    got = made(spark, [
        ("x.y", None, None), ("x.y", None, "timeout"), ("jira.jira_search", {"error": "gone"}, None), ("code.grep", {"matches": []}, None), ("git.git_log", {}, None), ("jira.jira_search", {"issues": []}, None), ("other.tool", {"a": [1, 2]}, None),
        ("code.grep", "Error: no such path", None), ("code.grep", '"error: quoted"', None), ("logz.search_logs", [1, 2], None), ("chronosphere.query_prometheus_range", {"data": {"result": [{"metric": {}, "values": []}]}}, None), ("x.y", "z" * 7000, None),
    ])
    text = lambda kind, t: [(kind, {"text": t})]
    assert got[:5] == [[], text("error", "timeout"), text("error", "gone"), text("empty", "no matches"), text("empty", "no commits in window")]
    assert got[5] == text("json", '{"issues": []}') and got[6] == text("json", '{"a": [1, 2]}')
    assert got[7:9] == [text("error", "Error: no such path"), text("error", "error: quoted")]
    assert got[9] == text("json", "[1, 2]") and got[10][0][0] == "json" and len(got[10]) == 1 and len(got[11][0][1]["text"]) == cards.JSON_CHARS


def test_evidence_groups(spark):
    page = lambda i, **more: {"id": i, "title": "t", **more}
    rows = [
        (1, 0, "search", None, "confluence.confluence_search", {"results": [page(1, excerpt="e"), page(2, excerpt="f")]}, None), (1, 1, "page", None, "confluence.confluence_get_page", page(1, body="whole"), None), (1, 2, "again", None, "confluence.confluence_search", {"results": [page(1, excerpt="e")]}, None),
        (1, 3, "logs", "a", "logz.search_logs", {"hits": [HIT, HIT]}, None), (1, 3, "logs", "b", "logz.search_logs", {"hits": [HIT, {"message": "other"}]}, None), (1, 4, "none", None, "code.grep", {"matches": []}, None), (1, 5, "odd", None, "flows.run", {"x": 1}, None), (1, 6, "odd2", None, "strange", {"x": 1}, None),
        (2, 0, "page", None, "confluence.confluence_get_page", page(1, body="whole"), None), (2, 1, "page2", None, "confluence.confluence_get_page", page(1, body="newer"), None),
    ]
    df = spark.createDataFrame([(*r[:5], json.dumps(r[5]), r[6]) for r in rows], SCHEMA)
    shown = cards.evidence(cards.cards(df, ["run", "n", "item"]), ["run"], ["n", "item"])
    pages = {(r["run"], r["attrs"]["id"]): (r["step"], r["attrs"].get("body")) for r in shown.where("kind = 'page'").collect()}
    assert pages == {(1, "1"): ("page", "whole"), (1, "2"): ("search", None), (2, "1"): ("page2", "newer")}
    got = [tuple(r) for r in cards.groups(shown, ["run"], "step").orderBy("run", "place").collect()]
    assert got == [(1, 5, "log", 2, 2, ["logs"]), (1, 9, "page", 2, 2, ["page", "search"]), (1, 10, "flow", 1, 1, ["odd"]), (1, 11, "other", 1, 1, ["odd2"]), (2, 9, "page", 1, 1, ["page2"])]
    assert cards.groups(cards.evidence(cards.cards(df.where("false"), ["run", "n", "item"]), ["run"], ["n", "item"]), ["run"], "step").collect() == []


def test_a_result_is_read_once(spark):
    """One parse and one schema a result, one window for all cards, whatever is asked of them."""
    rows = spark.createDataFrame([(1, 0, "a", None, "jira.jira_search", json.dumps({"issues": [ISSUE, ISSUE]}), None)], SCHEMA)
    shown = cards.evidence(cards.cards(rows, ["run", "n"]), ["run"], ["n"])
    plan = shown._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("schemaOfVariant(") == 1
    assert sum("Window [" in x for x in plan.split("\n")) <= 2 and "Union" not in plan
    assert [r["attrs"]["key"] for r in shown.collect()] == ["A-1"]
