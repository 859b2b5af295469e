"""Session events as streams: ingestion with activity and sequence numbers, promotion state, and session windows.

The same state steps serve batch and stream: ``tests/test_streaming.py`` holds
each stream against its batch form.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracelens.functions.extract import seconds
from tracelens.operators.lifecycle import CANDIDATE_AFTER, LEVELS, PROMOTE_AFTER

INGESTED = "session string, seq long, event_id long, tool string"
PROMOTION = "flow string, status string, streak long, runs long, clean long, failed long"


def seconds_text(span: str) -> str:
    return f"{seconds(span)} SECONDS"


def events(spark: SparkSession, path: str, schema: str, per_trigger: int = 1) -> DataFrame:
    """New JSON files of a folder as a stream, oldest first; numbers and states follow that order, so files should not share a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def ingest(stream: DataFrame, idle: str | None = None, late: str = "10m") -> DataFrame:
    """Calls that count, numbered within their session: foreign tools always, own tools once the session is active.

    Columns: session, event_id, ts, tool, foreign.  The state of a session is whether it is active, and its last number.

    With ``idle`` (then ts is a timestamp) the state of a session goes once the watermark, ``late`` behind the newest
    event, has passed its last event by so much; rows behind the watermark are dropped, and a session that goes on after
    that begins anew.  Without it states stay for ever.
    """
    rest = seconds(idle) * 1000 if idle else 0
    stream = stream.withWatermark("ts", seconds_text(late)) if idle else stream

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        active, seq = state.get if state.exists else (False, 0)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"], kind="stable")
        out = []
        for event_id, tool, foreign in zip(rows["event_id"], rows["tool"], rows["foreign"], strict=True):
            active = active or bool(foreign)
            if active:
                seq += 1
                out.append((key[0], seq, event_id, tool))
        state.update((active, seq))
        if idle:
            last = int(rows["ts"].iloc[-1].timestamp() * 1000)
            state.setTimeoutTimestamp(max(last + rest, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["session", "seq", "event_id", "tool"])

    kept = GroupStateTimeout.EventTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return stream.groupBy("session").applyInPandasWithState(step, INGESTED, "active boolean, seq long", "append", kept)


def join_calls(hook: DataFrame, transcript: DataFrame, use: str = "tool_use_id", late: str = "10m", apart: str = "1h") -> DataFrame:
    """Hook calls as a stream, each with the agent and prompt of the transcript's call of the same session and use id, or without.

    Both streams have a timestamp ts; two calls meet if their times are at most ``apart``.  A hook call without a partner
    comes once the watermark says that none can come any more, and what neither side can need is forgotten.
    """
    h = hook.withWatermark("ts", seconds_text(late)).alias("h")
    t = transcript.withWatermark("ts", seconds_text(late)).select(F.col("session").alias("_session"), F.col(use).alias("_use"), F.col("ts").alias("_ts"), "agent", "prompt_index").alias("t")
    reach = F.expr(f"INTERVAL {seconds_text(apart)}")
    same = (F.col("h.session") == F.col("_session")) & (F.col(f"h.{use}") == F.col("_use")) & (F.col("_ts") >= F.col("h.ts") - reach) & (F.col("_ts") <= F.col("h.ts") + reach)
    return h.join(t, same, "leftOuter").select("h.*", "agent", "prompt_index")


def promote(stream: DataFrame, author: str = "promoted") -> DataFrame:
    """The promotion state of each flow after each batch of its outcomes (flow, ts, event_id, kind, ok)."""
    top = LEVELS.index(author)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, streak, runs, clean, failed = state.get if state.exists else (0, 0, 0, 0, 0)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"], kind="stable")
        for kind, ok in zip(rows["kind"], rows["ok"], strict=True):
            run = kind == "run"
            runs, clean, failed = runs + run, clean + (run and ok), failed + (run and not ok)
            if not ok:
                level, streak = max(0, level - 1), 0
            elif run:
                streak += 1
                if level < top and streak >= (CANDIDATE_AFTER if level == 0 else PROMOTE_AFTER):
                    level, streak = level + 1, 0
        state.update((level, streak, int(runs), int(clean), int(failed)))
        yield pd.DataFrame([(key[0], LEVELS[level], streak, int(runs), int(clean), int(failed))], columns=["flow", "status", "streak", "runs", "clean", "failed"])

    return stream.groupBy("flow").applyInPandasWithState(step, PROMOTION, "level int, streak int, runs long, clean long, failed long", "update", GroupStateTimeout.NoTimeout)


def sessions(rows: DataFrame, key: str, ts: str, gap: str = "24 hours", late: str | None = None) -> DataFrame:
    """Events of a key with no gap between them as one session; with ``late``, a watermark lets streams close them."""
    rows = rows.withWatermark(ts, late) if late else rows
    return rows.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def progress(done: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(total, missing) of a background analysis."""
    return wanted.select(key).distinct().join(done.select(key, F.lit(1).alias("d")).distinct(), key, "left").agg(F.count("*").alias("total"), F.count_if(F.col("d").isNull()).alias("missing"))
