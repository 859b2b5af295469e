"""Flow calls expanded to what the flows did, capped evidence, opening sentences and commands that only read."""

import json
import shlex

from pyspark.sql import functions as F

from tracelens.functions import text
from tracelens.operators import cards, expansion


def attempt(value=None, values=None, skipped=None, error=None):
    return (value, values, skipped, error)


def test_flow_calls(spark):
    steps = [
        ("a.one", None, {"q": "x", "n": "1"}, '{"r": 1}', None, None, None), ("a.skip", True, {"q": "x"}, None, None, None, None), (None, None, {"q": "x"}, None, None, None, None),
        ("a.ladder", None, {"q": "third", "n": "1"}, None, "bad", [attempt("first"), attempt("gone", skipped=True), attempt("second", error="e"), attempt("third")], None),
        ("a.both", None, {"q": "z", "w": "w2"}, "{}", None, [attempt("y", {"q": "y", "w": "w1"}), attempt("z")], None), ("a.unknown", None, {"q": "other"}, "{}", None, [attempt("m"), attempt("k")], None),
        ("a.each", None, None, None, None, None, [({"q": "i1"}, "1", None, None), ({}, "2", None, None), ({"q": "i3"}, None, "late", None)]),
    ]
    runs = spark.createDataFrame([("r1", "flow", steps), ("r2", "none", [])], f"run_id string, flow string, steps {expansion.STEPS}")
    got = [(r["tool"], r["args"], r["result"], r["is_error"]) for r in expansion.flow_calls(runs).orderBy("at").collect()]
    assert got == [
        ("a.one", {"q": "x", "n": "1"}, '{"r": 1}', False), ("a.ladder", {"q": "first", "n": "1"}, "{}", False), ("a.ladder", {"q": "second", "n": "1"}, "{}", True), ("a.ladder", {"q": "third", "n": "1"}, "{}", True),
        ("a.both", {"q": "y", "w": "w1"}, "{}", False), ("a.both", {"q": "z", "w": "w2"}, "{}", False), ("a.unknown", {"q": "other"}, "{}", False), ("a.each", {"q": "i1"}, "1", False), ("a.each", {"q": "i3"}, "{}", True),
    ]
    call = lambda s, n, tool, result="{}": (s, n, tool, {"k": "v"}, result, False)
    calls = [call("s", 1, "jira.get"), call("s", 2, "flows.run_flow", '{"run_id": "r1"}'), call("s", 3, "flows.list_flows"), call("s", 4, "claude-code.Read"), call("s", 5, "logs.find"), call("t", 1, "flows.run_flow", '{"run_id": "gone"}'), call("t", 2, "flows.run_flow", "error: no"), call("t", 3, "x.y"), call("u", 1, "flows.run_flow", '{"run_id": "r2"}')]
    out, lost = expansion.expand_flow_calls(spark.createDataFrame(calls, "session string, seq long, tool string, args map<string,string>, result string, is_error boolean"), runs, ["session"])
    rows = [(r["session"], r["seq"], r["tool"], r["from_flow"]) for r in out.orderBy("session", "seq").collect()]
    assert rows == [("s", 1, "jira.get", None), *[("s", 2 + i, g[0], "flow") for i, g in enumerate(got)], ("s", 11, "logs.find", None), ("t", 1, "x.y", None)]
    assert sorted(map(tuple, lost.collect()), key=repr) == [("t", 1, "gone"), ("t", 2, None)]


def test_capped_evidence(spark):
    """The number of cards an item that a whole run can afford, against trying it out."""
    rows = [(run, s, i, c, {"text": "x" * (size := (run * 37 + c * 11) % 900), "n": f"{c}"}) for run in range(1, 9) for s in range(run) for i in (None, "a", "b", "c", "d", "e", "f", "g")[: 1 + run % 8] for c in range(4)]
    df = spark.createDataFrame(rows, "run long, step long, item string, card long, attrs map<string,string>")
    got = {}
    for r in cards.capped(df, ["run"], ["step"], 4000).collect():
        got.setdefault(r["run"], []).append((r["step"], r["item"], r["card"], r["attrs"], r["per_item"], r["truncated"]))
    for run in range(1, 9):
        mine = [(s, i, c, {k: v if len(v) <= 280 else v[:280] + "…" for k, v in a.items()}) for q, s, i, c, a in rows if q == run and i not in ("f", "g")]
        level = next((n for n in (3, 2, 1) if sum(len(json.dumps(a, ensure_ascii=False, separators=(",", ":"))) for _, _, c, a in mine if c < n) <= 4000), 0)
        assert sorted(got.get(run, []), key=repr) == sorted([(*x, level, level < 3) for x in mine if x[2] < level], key=repr)
    assert {r[4] for some in got.values() for r in some} >= {1, 3}


def test_lede(spark):
    facts = [("Timeout", "api", "Mon", "Tue", "1h", "open", ["@a", "@b"], "ann", 2, "abc", "fix", "P-1", None), (None, "api", "Mon", "Tue", None, None, [], None, 1, None, "fix", None, "x"), (None, None, None, None, None, "open", None, "ann", None, None, None, None, None), ("Boom", None, None, None, "1h", None, None, None, 0, None, "fix", None, None)]
    df = spark.createDataFrame(facts, "what string, service string, started string, resolved string, duration string, status string, owners array<string>, person string, commits long, sha string, subject string, repeat_of string, caused_by string")
    assert [r[0] for r in df.select(cards.lede(df)).collect()] == [
        "Timeout on api. Fired Mon, resolved after 1h. Owned by @a, @b (ann on it). 2 commits touched the service just before, latest abc “fix”. This is a repeat of P-1.",
        "An incident on api. Fired Mon, resolved Tue. One commit just before: fix. Caused by x.", "The incident is open.", "Boom."]


def test_commands_that_only_read(spark):
    good = ["ls -la", "git log --oneline -5", "/usr/bin/grep -rn 'a b' src", "python3 -c 'print(1)'", "python --version", "git show HEAD", "cargo tree", 'rg "a;b" .', "cat a\\ b", "  wc -l x  ", "echo a>b"]
    bad = ["", None, "   ", "rm -rf x", "git push", "git", "python script.py", "node", "ls | wc", "ls && rm x", "cat x > y", "echo `id`", "grep 'open", "sudo ls", "npm install", "git --no-pager", "ls ; ls", "find . $(x)"]
    df = spark.createDataFrame([(c, True) for c in good] + [(c, False) for c in bad], "c string, ok boolean")
    assert [(r["c"], r["ok"]) for r in df.select("c", "ok", text.is_read_only(F.col("c")).alias("got")).collect() if r["got"] != r["ok"]] == []
    lines = [*[c for c in good if c], "a 'b c' \"d \\\" e\"f g\\ h", "x'y'\"z\"", "'' a"]
    for r in spark.createDataFrame([(c,) for c in lines], "c string").select("c", text.shell_words(F.col("c")).alias("w")).collect():
        assert r["w"] == shlex.split(r["c"]), r["c"]
