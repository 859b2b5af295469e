import json

import pytest
from pyspark.sql import functions as F

from tracelens import api
from tracelens.functions import registry
from tracelens.sources import index, traces, workspace


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r) if isinstance(r, dict) else r for r in rows) + "\n")


def test_recorded_trace(spark, tmp_path):
    write(tmp_path / "s1.jsonl", [
        {"kind": "meta", "session_id": "s1", "trigger": "old"}, {"kind": "meta", "session_id": "s1", "trigger": "jira"}, {"kind": "prompt", "session_id": "s1", "text": "look"},
        {"session_id": "s1", "seq": 1, "server": "jira", "tool": "get", "input": {"k": 1}, "output": [{"type": "text", "text": "{\"a\": 1}"}]}, {"kind": "result", "session_id": "s1", "text": "done"},
    ])
    write(tmp_path / "s2.jsonl", [{"kind": "meta", "session_id": "s2", "trigger": "jira"}])
    records = traces.read_records(spark, str(tmp_path))
    rows = traces.sessions(records, "jira").collect()
    assert [(r["session_id"], r["result"], r["prompt"], r["n_calls"]) for r in rows] == [("s1", "done", "look", 1)]
    assert records.where("kind = 'call'").first()["output"] == '{"a": 1}'
    assert traces.index(records).where("n_calls > 0").first()["nodes"] == ["jira.get"]


def line(kind, content, ts, **more):
    return {"type": kind, "timestamp": ts, "message": {"role": kind, "content": content}, **more}


def use(id_, name, **args):
    return {"type": "tool_use", "id": id_, "name": name, "input": args}


def result(id_, content):
    return {"type": "tool_result", "tool_use_id": id_, "content": content}


def test_transcript(spark, tmp_path):
    write(tmp_path / "p" / "s.jsonl", [
        {"type": "summary", "summary": "x"}, "not json",
        line("user", "<local-command>x", "01"), line("user", "Look at PAY-1", "02"),
        line("assistant", [use("t0", "Bash", command="ls | wc")], "03"), line("user", [result("t0", "1")], "04"),
        line("assistant", [{"type": "text", "text": "reading"}, use("t1", "mcp__jira__get_issue", key="PAY-1")], "05"),
        line("user", [result("t1", [{"type": "text", "text": "{\"k\": 1}"}]), result("t1", "again")], "06"),
        line("assistant", [use("t2", "Bash", command="ls")], "07"), line("user", [result("t2", "files")], "08"),
        line("assistant", "answer one", "09"), line("user", "And now?", "10"),
        line("assistant", [use("t3", "Read", path="a"), use("t4", "Edit", path="a")], "11"), line("user", [result("t3", "src"), result("t4", "ok")], "12"), line("assistant", "answer two", "13"),
    ])
    write(tmp_path / "p" / "s" / "subagents" / "agent-x.jsonl", [line("user", "sub task", "11"), line("assistant", [use("u1", "mcp__logs__search", q="e")], "11"), line("user", [result("u1", "hit")], "12")])
    got = traces.read_transcripts(spark, str(tmp_path))
    assert [(r["prompt_index"], r["text"]) for r in got["prompts"].orderBy("prompt_index").collect()] == [(0, "Look at PAY-1"), (1, "And now?")]
    calls = got["calls"].orderBy("seq").collect()
    assert [(r["agent"], r["server"], r["tool"], r["prompt_index"]) for r in calls] == [
        ("main", "jira", "get_issue", 0), ("main", "claude-code", "Bash", 0), ("main", "code", "read_file", 1), ("x", "logs", "search", 1)]
    assert calls[0]["output"] == '{"k": 1}'
    assert {(r["prompt_index"], r["result"]) for r in got["results"].collect()} == {(0, "answer one"), (1, "answer two")}
    report = traces.import_report(got["prompts"], got["calls"]).first()
    assert (report["prompts"], report["calls"], report["episodes"]) == (2, 4, 3)


def test_changed_and_append(spark, tmp_path):
    a = spark.createDataFrame([("f1", 1, "t1"), ("f2", 2, "t2"), ("f3", 3, "t3")], "file string, size long, mtime string")
    b = spark.createDataFrame([("f1", 1, "t1"), ("f2", 9, "t2"), ("f4", 4, "t4")], "file string, size long, mtime string")
    assert {(r["file"], r["state"]) for r in traces.changed(a, b).collect()} == {("f1", "same"), ("f2", "changed"), ("f3", "new"), ("f4", "gone")}


def test_write_sessions(spark, tmp_path):
    out = str(tmp_path / "out")
    table = lambda *rows: spark.createDataFrame(list(rows), "session string, seq long, tool string")
    have = lambda: sorted((r["workspace"], r["session"], r["seq"], r["tool"]) for r in spark.read.parquet(out).collect())
    for _ in range(2):
        workspace.write_sessions(table(("s1", 1, "a"), ("s1", 2, "b"), ("s2", 1, "c")), out, "w")
    first = [("w", "s1", 1, "a"), ("w", "s1", 2, "b"), ("w", "s2", 1, "c")]
    assert have() == first
    workspace.write_sessions(table(("s1", 1, "new")), out, "v")
    assert have() == [("v", "s1", 1, "new"), *first]
    workspace.write_sessions(table(("s1", 7, "z"), ("s3", 1, "d")), out, "w", force=True)
    assert have() == [("v", "s1", 1, "new"), ("w", "s1", 7, "z"), ("w", "s2", 1, "c"), ("w", "s3", 1, "d")]


def test_slices_and_cache(spark, tmp_path):
    calls = spark.createDataFrame([("s", 0, "main", 1), ("s", 0, "x", 2), ("s", 3, "main", 3)], "session string, prompt_index long, agent string, seq long")
    assert sorted((r["part"], r["seq"]) for r in workspace.slices(calls).collect()) == [("s", 1), ("s", 2), ("s", 3), ("s-e1", 1), ("s-e2-ax", 2), ("s-e3", 3)]
    files = spark.createDataFrame([("f", 1, "t"), ("g", 2, "t")], "file string, size long, mtime string")
    edges = spark.createDataFrame([("f", "a", "b")], "file string, source string, target string")
    path = str(tmp_path / "edges")
    workspace.add_edges(edges, files, path, 3)
    cached = spark.read.parquet(path)
    changed = spark.createDataFrame([("f", 9, "t"), ("g", 2, "t")], files.schema)
    assert [r["file"] for r in workspace.missing(files, cached, 3).collect()] == []
    assert [r["file"] for r in workspace.missing(changed, cached, 3).collect()] == ["f"]
    assert workspace.missing(files, cached, 4).count() == 2


def test_listings(spark):
    runs = spark.createDataFrame([("r1", [(2,), (None,)]), ("r3", [(1,)]), ("r2", [])], "run_id string, steps array<struct<hits:int>>")
    assert [(r["run_id"], r["hits"]) for r in api.runs(runs, most=2).collect()] == [("r3", 1), ("r2", 0)]
    records = spark.createDataFrame([("a", "s1", "01"), ("a", "s2", "05"), ("b", "s1", "09")], "workspace string, session string, ts string")
    assert [tuple(r) for r in api.workspaces(records).collect()] == [("b", 1, 1, "09"), ("a", 2, 2, "05")]
    given = spark.createDataFrame([("s1", "new"), ("s9", "new")], "session string, v string")
    assert [r["session"] for r in api.seed(records, given, ["session"]).collect()] == ["s9"]


def test_import(spark, tmp_path):
    rows = [
        {"type": "user", "message": {"role": "user", "content": "Look"}, "timestamp": "01"},
        {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "tool_use", "id": "t1", "name": "mcp__jira__get", "input": {"k": 1}}]}, "timestamp": "02"},
        {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "ok"}]}, "timestamp": "03"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "s.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    report = api.import_transcripts(spark, str(tmp_path / "in"), str(tmp_path / "out"), "w").first()
    assert (report["prompts"], report["calls"], report["episodes"]) == (1, 1, 1)
    assert {r["part"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"s", "s-e1"}


def test_functions_by_name(spark):
    df = spark.createDataFrame([("it's a_b\nc",)], "s string")
    assert df.select(registry.pipe(F.col("s"), "head", "kebab").alias("x")).first()["x"] == "it's a-b"
    for name in registry.register(spark):
        want = df.select(registry.apply(name[3:], F.col("s")).alias("x")).first()["x"]
        assert df.selectExpr(f"{name}(s) AS x").first()["x"] == want, name
    with pytest.raises(ValueError, match="no function"):
        registry.apply("nope", F.col("s"))


def test_long_files_are_split(spark, tmp_path):
    """A trace read by many tasks keeps the order of its lines."""
    write(tmp_path / "long.jsonl", [{"kind": "meta", "session_id": "s", "trigger": f"t{k}"} for k in range(3)] + [{"session_id": "s", "seq": k, "server": "x", "tool": f"t{k}", "input": {"k": "é" * (k % 40)}} for k in range(600)] + [{"kind": "result", "session_id": "s", "text": "last"}])
    write(tmp_path / "deep" / "other.jsonl", [{"session_id": "o", "seq": 1, "server": "x", "tool": "y"}])
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        records = traces.read_records(spark, str(tmp_path))
        assert records.rdd.getNumPartitions() > 10
        entry = {r["session_id"]: r for r in traces.index(records).collect()}
        assert entry["s"]["nodes"] == [f"x.t{k}" for k in range(600)] and entry["s"]["n_calls"] == 600 and entry["o"]["nodes"] == ["x.y"]
        one = traces.sessions(records).where("session_id = 's'").first()
        assert (one["trigger"], one["result"], one["n_calls"]) == ("t2", "last", 600)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def trace(n, session="s", text="look"):
    return [{"kind": "meta", "session_id": session, "prompt": "meta prompt"}, {"kind": "prompt", "text": text}, *[{"server": "jira", "tool": f"t{k}"} for k in range(n)]]


def entries(spark, path):
    return {r["file"].rsplit("/", 1)[1]: (r["session_id"], r["prompt"], r["nodes"], r["n_calls"]) for r in index.read(spark, path).collect()}


def test_index_follows_the_files(spark, tmp_path):
    """New, changed, vanished and half-written files; nothing is read that has not moved; a repeated update changes nothing."""
    folder, path = tmp_path / "traces", str(tmp_path / "index")
    assert index.refresh(spark, str(folder), path).collect() == [] and entries(spark, path) == {}
    for name in "abc":
        write(folder / f"{name}.jsonl", trace(2, f"s{name}"))
    states = lambda: {r["file"].rsplit("/", 1)[1]: r["state"] for r in index.refresh(spark, str(folder), path).collect()}
    assert states() == {"a.jsonl": "new", "b.jsonl": "new", "c.jsonl": "new"}
    first = entries(spark, path)
    assert first["a.jsonl"] == ("sa", "look", ["jira.t0", "jira.t1"], 2) and len(first) == 3
    assert set(states().values()) == {"same"} and entries(spark, path) == first
    write(folder / "a.jsonl", trace(3, "sa", "look again"))
    (folder / "b.jsonl").unlink()
    write(folder / "d.jsonl", [{"server": "x", "tool": "y"}])
    write(folder / "e.jsonl", [*trace(1), '{"server": "x", "to'])
    assert states() == {"a.jsonl": "changed", "b.jsonl": "gone", "c.jsonl": "same", "d.jsonl": "new", "e.jsonl": "new"}
    now = entries(spark, path)
    assert now == {"a.jsonl": ("sa", "look again", ["jira.t0", "jira.t1", "jira.t2"], 3), "c.jsonl": first["c.jsonl"], "d.jsonl": ("d", None, ["x.y"], 1)}
    write(folder / "e.jsonl", trace(1, "se"))
    write(folder / "c.jsonl", [*trace(1), "{"])
    assert states()["e.jsonl"] == "new" and set(entries(spark, path)) == {"a.jsonl", "d.jsonl", "e.jsonl"}
    for f in folder.glob("*.jsonl"):
        f.unlink()
    assert set(states().values()) == {"gone"} and entries(spark, path) == {}


def test_index_as_a_stream(spark, tmp_path):
    """Files that come between runs, a batch that comes again after a failure, and files that vanish."""
    folder, path, checkpoint = tmp_path / "traces", str(tmp_path / "index"), str(tmp_path / "checkpoint")
    for name in "ab":
        write(folder / f"{name}.jsonl", trace(1, f"s{name}"))
    index.follow(spark, str(folder), path, checkpoint, per_trigger=1).awaitTermination()
    assert set(entries(spark, path)) == {"a.jsonl", "b.jsonl"}
    write(folder / "c.jsonl", trace(2, "sc"))
    (folder / "a.jsonl").unlink()
    index.follow(spark, str(folder), path, checkpoint).awaitTermination()
    then = entries(spark, path)
    assert set(then) == {"b.jsonl", "c.jsonl"} and then["c.jsonl"][3] == 2
    texts = spark.read.text(str(folder), wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("mtime"), "value")
    for _ in range(2):
        index.apply_batch(texts, str(folder), path)
    assert entries(spark, path) == then and index.read(spark, path).count() == 2
