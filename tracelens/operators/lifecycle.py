"""Promotion state of a flow as a fold over its outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranking import cut, number_rows

# Fixed values.
LEVELS = ("draft", "candidate", "promoted")
CANDIDATE_AFTER, PROMOTE_AFTER = 2, 5

#: Events, or tables of them, that are folded in one row.
STRETCH = 1000


def start(author: Column) -> Column:
    """A flow begins at its author's level."""
    zero = F.lit(0)
    return F.struct(author.cast("int").alias("level"), zero.alias("streak"), zero.alias("runs"), zero.alias("clean"), zero.alias("failed"))


def step(state: Column, event: Column, author: Column, candidate_after: int = CANDIDATE_AFTER, promote_after: int = PROMOTE_AFTER) -> Column:
    """The state after one outcome (kind run, test or feedback; ok).

    A clean run adds to the streak and moves up a level at the threshold, up to the author's level; a failure of any kind
    clears the streak and moves down one; a passing test changes nothing.
    """
    run, ok = event["kind"] == "run", event["ok"]
    need = F.when(state["level"] == 0, F.lit(candidate_after)).otherwise(F.lit(promote_after))
    up = run & ok & (state["level"] < author) & (state["streak"] + 1 >= need)
    level = F.when(up, state["level"] + 1).when(~ok, F.greatest(F.lit(0), state["level"] - 1)).otherwise(state["level"])
    streak = F.when(up | ~ok, F.lit(0)).when(run, state["streak"] + 1).otherwise(state["streak"])
    one = run.cast("int")
    return F.struct(
        level.cast("int").alias("level"), streak.cast("int").alias("streak"), (state["runs"] + one).alias("runs"),
        (state["clean"] + (run & ok).cast("int")).alias("clean"), (state["failed"] + (run & ~ok).cast("int")).alias("failed"))


def _states(candidate_after: int, promote_after: int, author: Column) -> tuple[int, Column, Column]:
    """The states that a stretch of events may begin in, as numbers: level 0 and 1 by streak, and the author's level with any streak, which changes nothing until a failure."""
    last = candidate_after + promote_after
    level = lambda i: F.when(i == last, author).otherwise((i >= candidate_after).cast("int"))
    streak = lambda i: F.when(i == last, F.lit(0)).otherwise(F.when(i < candidate_after, i).otherwise(i - candidate_after))
    return last, level, streak


def transitions(events: Column, author: Column, candidate_after: int = CANDIDATE_AFTER, promote_after: int = PROMOTE_AFTER) -> Column:
    """array<struct<level,streak,kept>>: where an array of events leads from each state; ``kept`` if a streak had before is still to be added."""
    last, level, streak = _states(candidate_after, promote_after, author)

    def begin(i: Column) -> Column:
        zero = F.lit(0)
        state = F.struct(level(i).cast("int").alias("level"), streak(i).cast("int").alias("streak"), zero.alias("runs"), zero.alias("clean"), zero.alias("failed"))
        return F.struct(state.alias("s"), (i == last).alias("kept"))

    def turn(acc: Column, x: Column) -> Column:
        return F.struct(step(acc["s"], x, author, candidate_after, promote_after).alias("s"), (acc["kept"] & F.coalesce(x["ok"], F.lit(True))).alias("kept"))

    return F.transform(F.sequence(F.lit(0), F.lit(last)), lambda i: F.aggregate(events, begin(i), turn, lambda r: F.struct(r["s"]["level"].alias("level"), r["s"]["streak"].alias("streak"), r["kept"].alias("kept"))))


def _then(first: Column, second: Column, author: Column, candidate_after: int, promote_after: int) -> Column:
    """The table of one stretch after another."""
    last = candidate_after + promote_after

    def follow(x: Column) -> Column:
        at = F.when(x["level"] == author, F.lit(last)).otherwise(F.when(x["level"] == 0, x["streak"]).otherwise(x["streak"] + candidate_after))
        y = F.get(second, at)
        return F.struct(y["level"].alias("level"), (y["streak"] + F.when(y["kept"], x["streak"]).otherwise(0)).cast("int").alias("streak"), (x["kept"] & y["kept"]).alias("kept"))

    return F.transform(first, follow)


def fold(events: DataFrame, flow: list[str], order: list[str], author: Column | None = None, stretch: int = STRETCH, candidate_after: int = CANDIDATE_AFTER, promote_after: int = PROMOTE_AFTER) -> DataFrame:
    """The state of each flow after all its events (kind, ok), in their order, which has to be total.

    ``author`` is the level that the author allows, one value a flow; ``by_declaration`` cuts events where it changes.

    Every ``stretch`` neighbouring events become a table of where they lead from each state, and every ``stretch`` tables
    one, until a flow has one: however long a history is, no row holds more than ``stretch`` of its events.
    """
    author = F.lit(len(LEVELS) - 1) if author is None else author
    mine = F.col("_author")
    rows = number_rows(events.select(*flow, *order, "kind", "ok", author.cast("int").alias("_author")), [*flow, *order], "_at")
    counts = rows.groupBy(*flow).agg(F.max("_author").alias("_author"), F.count_if(F.col("kind") == "run").alias("runs"), F.count_if((F.col("kind") == "run") & F.col("ok")).alias("clean"), F.count_if((F.col("kind") == "run") & ~F.col("ok")).alias("failed"))
    part = lambda c: F.call_function("div", F.col(c), F.lit(stretch)).alias("_at")
    tables = rows.groupBy(*flow, part("_at")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "kind", "ok"))), lambda x: F.struct(x["kind"].alias("kind"), x["ok"].alias("ok"))).alias("e"), F.max("_author").alias("_author"))
    tables = cut(tables.select(*flow, "_at", "_author", transitions(F.col("e"), mine, candidate_after, promote_after).alias("t")))
    while not tables.groupBy(*flow).count().where("count > 1").isEmpty():
        lists = tables.groupBy(*flow, part("_at")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "t"))), lambda x: x["t"]).alias("ts"), F.max("_author").alias("_author"))
        rest = F.slice("ts", F.lit(2), F.size("ts"))
        tables = cut(lists.select(*flow, "_at", "_author", F.aggregate(rest, F.get("ts", F.lit(0)), lambda a, b: _then(a, b, mine, candidate_after, promote_after)).alias("t")))
    # the state begins at draft: an author's first declaration is that of a draft here
    begun = F.when(mine == 0, F.lit(candidate_after + promote_after)).otherwise(F.lit(0))
    end = tables.select(*flow, F.get("t", begun).alias("s"))
    status = F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.col("s.level") + 1)
    return end.join(counts.drop("_author"), flow).select(*flow, status.alias("status"), F.col("s.streak").cast("long").alias("streak"), "runs", "clean", "failed")


def by_declaration(events: DataFrame, flow: list[str], order: list[str], author: str) -> DataFrame:
    """Events with the number of the author's declaration they fall under: each change of the author's level starts anew."""
    w = W.partitionBy(*flow).orderBy(*order)
    new = F.coalesce(F.lag(author).over(w) != F.col(author), F.lit(True)).cast("long")
    return events.withColumn("_new", new).withColumn("declaration", F.sum("_new").over(w)).drop("_new")


def classify_runs(steps: DataFrame, run: list[str], order: str) -> DataFrame:
    """(run, reason): why a run failed by its first bad step, null if it was clean.  Steps: step, error, hits, required, skipped, status."""
    why = F.when(~F.coalesce("status", F.lit("ok")).isin("ok"), F.concat(F.lit("run status "), F.col("status")))
    bad = (
        F.when(F.coalesce("skipped", F.lit(False)), F.lit(None).cast("string")).when(F.col("error").isNotNull(), F.concat(F.lit("step "), F.col("step"), F.lit(": "), F.substring("error", 1, 200)))
        .when(F.col("required") & (F.coalesce("hits", F.lit(0)) == 0), F.concat(F.lit("required step "), F.col("step"), F.lit(" returned zero hits")))
    )
    rows = steps.select(*run, order, why.alias("_run"), bad.alias("_bad"))
    return rows.groupBy(*run).agg(F.coalesce(F.max("_run"), F.min_by("_bad", F.when(F.col("_bad").isNotNull(), F.col(order)))).alias("reason"))


def check_expectations(steps: DataFrame, expect: DataFrame, run: list[str]) -> DataFrame:
    """Expectations (step, min_hits, max_hits) that a run does not meet; with ``extracts`` also a value that an extract has to have.

    ``extracts`` are maps: name to value in ``expect``, name to the list of values in ``steps``; the first that is not met by name is told.
    """
    told = [c for c in ("extracts",) if c in expect.columns and c in steps.columns]
    got = expect.withColumnsRenamed({c: f"_want_{c}" for c in told}).join(steps.select(*run, "step", "hits", "skipped", *told), [*run, "step"], "left")
    hits = F.coalesce("hits", F.lit(0))
    why = (
        F.when(F.col("skipped").isNull(), F.lit("missing")).when(F.col("skipped"), F.lit("skipped")).when(hits < F.col("min_hits"), F.lit("too few hits")).when(hits > F.col("max_hits"), F.lit("too many hits"))
    )
    if told:
        entries = F.array_sort(F.map_entries("_want_extracts"))
        lost = F.get(F.filter(entries, lambda e: ~F.coalesce(F.array_contains(F.col("extracts")[e["key"]], e["value"]), F.lit(False))), F.lit(0))
        why = F.coalesce(why, F.when(lost.isNotNull(), F.concat(F.lit("extract "), lost["key"], F.lit(" is not "), lost["value"])))
    return got.withColumn("why", why).where("why is not null").select(*run, "step", "why")
