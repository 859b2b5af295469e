import json
import os

from pyspark.sql import functions as F

from tracelens.operators import episodes, lifecycle
from tracelens.streaming import ingest


def files(tmp_path, rows, n=3):
    """Files a second apart: the file source reads the oldest first, and equal times leave their order open."""
    for i in range(n):
        (tmp_path / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows[i * len(rows) // n : (i + 1) * len(rows) // n]))
        os.utime(tmp_path / f"{i}.json", (1_700_000_000 + i,) * 2)
    return str(tmp_path)


def drain(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def test_ingest_equals_batch(spark, tmp_path):
    rows = [{"session": f"s{i % 4}", "event_id": i, "ts": i, "tool": f"t{i % 3}", "foreign": i % 7 == 3} for i in range(60)]
    schema = "session string, event_id long, ts long, tool string, foreign boolean"
    drain(ingest.ingest(ingest.events(spark, files(tmp_path, rows), schema)), "ingested", "append")
    got = {(r["session"], r["seq"], r["event_id"]) for r in spark.table("ingested").collect()}
    kept = episodes.while_active(spark.createDataFrame(rows, schema), ["session"], ["ts", "event_id"], F.col("foreign"), F.col("foreign"))
    want = episodes.slice_calls(kept, kept, ["session"], "event_id").collect()
    assert got == {(r["session"], r["seq"], r["event_id"]) for r in want}


def test_promotion_equals_batch(spark, tmp_path):
    rows = [{"flow": f"f{i % 3}", "ts": i, "event_id": i, "kind": "test" if i % 5 == 0 else "run", "ok": i % 11 != 10} for i in range(90)]
    schema = "flow string, ts long, event_id long, kind string, ok boolean"
    drain(ingest.promote(ingest.events(spark, files(tmp_path, rows), schema)), "promoted", "update")
    last = spark.table("promoted").groupBy("flow").agg(F.max_by(F.struct("status", "streak", "runs", "clean", "failed"), F.struct("runs", "clean")).alias("s"))
    got = {(r["flow"], *r["s"]) for r in last.collect()}
    assert got == {tuple(r) for r in lifecycle.fold(spark.createDataFrame(rows, schema), ["flow"], ["ts", "event_id"]).select("flow", "status", "streak", "runs", "clean", "failed").collect()}


def test_session_windows(spark):
    df = spark.createDataFrame([("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 10:00:00"), ("u", "2024-01-03 00:00:00")], "k string, t string").withColumn("t", F.to_timestamp("t"))
    assert [r["n"] for r in ingest.sessions(df, "k", "t").orderBy("start").collect()] == [2, 1]


def test_idle_sessions_leave_the_state(spark, tmp_path):
    """State shrinks once the watermark has passed idle sessions; late rows are dropped; a session that comes back begins anew."""
    at = lambda minutes: f"2024-01-01T{minutes // 60:02}:{minutes % 60:02}:00"
    # rows count as late from the batch after the one that moved the watermark
    batches = [
        [("a", 1, at(0), True), ("b", 2, at(1), True), ("a", 3, at(2), False)], [("c", 4, at(300), True)], [("c", 5, at(301), False)], [("c", 6, at(302), False), ("b", 7, at(5), False)], [("a", 8, at(310), True), ("c", 9, at(310), True)],
    ]
    for i, rows in enumerate(batches):
        (tmp_path / f"{i}.json").write_text("\n".join(json.dumps({"session": s, "event_id": e, "ts": t, "tool": "t", "foreign": f}) for s, e, t, f in rows))
        os.utime(tmp_path / f"{i}.json", (1_700_000_000 + i,) * 2)
    stream = ingest.events(spark, str(tmp_path), "session string, event_id long, ts timestamp, tool string, foreign boolean")
    q = ingest.ingest(stream, idle="30m", late="10m").writeStream.format("memory").queryName("idle").outputMode("append").start()
    q.processAllAvailable()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    q.stop()
    got = sorted((r["session"], r["seq"], r["event_id"]) for r in spark.table("idle").collect())
    assert got == [("a", 1, 1), ("a", 1, 8), ("a", 2, 3), ("b", 1, 2), ("c", 1, 4), ("c", 2, 5), ("c", 3, 6), ("c", 4, 9)]
    assert max(kept) == 3 and min(kept[kept.index(3) :]) == 1


def test_hook_calls_meet_the_transcript(spark, tmp_path):
    """A left join of two streams: partners in reach meet, a call without one comes out after the watermark, state goes."""
    at = lambda minutes: f"2024-01-01T{minutes // 60:02}:{minutes % 60:02}:00"
    hook = [[("s", "u1", at(0)), ("s", "u2", at(1)), ("s", "u3", at(2))], [("s", "u9", at(600))], [("s", "u8", at(900))]]
    transcript = [[("s", "u1", at(3), "main", 0), ("s", "u3", at(200), "main", 1), ("t", "u2", at(1), "x", 4)], [("s", "u9", at(590), "sub", 2)], [("s", "zz", at(900), "main", 3)]]
    for name, some, cols in (("hook", hook, ("session", "tool_use_id", "ts")), ("transcript", transcript, ("session", "tool_use_id", "ts", "agent", "prompt_index"))):
        (tmp_path / name).mkdir()
        for i, rows in enumerate(some):
            (tmp_path / name / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(cols, r, strict=True))) for r in rows))
            os.utime(tmp_path / name / f"{i}.json", (1_700_000_000 + i,) * 2)
    h = ingest.events(spark, str(tmp_path / "hook"), "session string, tool_use_id string, ts timestamp")
    t = ingest.events(spark, str(tmp_path / "transcript"), "session string, tool_use_id string, ts timestamp, agent string, prompt_index long")
    q = ingest.join_calls(h, t).writeStream.format("memory").queryName("joined").outputMode("append").start()
    q.processAllAvailable()
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    q.stop()
    got = {r["tool_use_id"]: (r["agent"], r["prompt_index"]) for r in spark.table("joined").collect()}
    assert got == {"u1": ("main", 0), "u2": (None, None), "u3": (None, None), "u9": ("sub", 2)}
    assert rows[-1] < max(rows)
