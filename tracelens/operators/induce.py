"""From many bound sessions to one parameterised flow: collapsed steps, steps aligned across sessions, merged arguments.

Steps are rows (trigger, session, idx, tool, args, raw, kinds, classes, hits): ``args`` maps each argument to its bound
template, ``raw`` to the recorded value, ``kinds`` to the kind of binding, and ``classes`` to what it refers to (text, id,
window, several with commas).  Null maps count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import cut, dealt, kept

# Fallbacks worth trying when a flow runs, values of an unresolved argument that a report shows.
MAX_LADDER = 6
MAX_SHOWN = 20
#: Rows of a table that is sent to every task.
SMALL_ROWS = 100_000

MAPS = ("args", "raw", "kinds", "classes")
REFERENCE = r"\{\{[^}]*\}\}"


def _maps(steps: DataFrame) -> DataFrame:
    return steps.withColumns({m: F.coalesce(m, F.create_map().cast("map<string,string>")) for m in MAPS})


def _changed(now: Column, was: Column) -> Column:
    """The arguments whose values differ, sorted."""
    names = F.array_sort(F.array_union(F.map_keys(now), F.map_keys(was)))
    return F.filter(names, lambda k: ~now[k].eqNullSafe(was[k]))


def _per_item(template: Column) -> Column:
    return F.regexp_replace(F.coalesce(template, F.lit("")), REFERENCE, "{{ item }}")


def _way(now: dict[str, Column], was: Column) -> Column:
    """How a call follows from the one before it: (how, arg), or null if it is a step of its own.

    ``repeat``: equal arguments.  ``each``: one argument differs and is an element of a list in both, by one template.
    ``ladder``: one template differs after a call without hits.  ``now`` has the changed arguments of both kinds.
    """
    raw, bound = now["changed"]["raw"], now["changed"]["args"]
    arg, rung = F.get(raw, F.lit(0)), F.get(bound, F.lit(0))
    listed = [F.coalesce(kinds[arg] == "copy", F.lit(False)) | F.coalesce(kinds[arg].startswith("ids:"), F.lit(False)) for kinds in (now["kinds"], was["kinds"])]
    each = (F.size(raw) == 1) & (F.size(F.array_except(bound, F.array(arg))) == 0) & listed[0] & listed[1] & (_per_item(now["args"][arg]) == _per_item(was["args"][arg]))
    ladder = (F.size(bound) == 1) & now["args"][rung].isNotNull() & was["args"][rung].isNotNull() & (was["hits"] == 0)
    way = lambda how, a: F.struct(F.lit(how).alias("how"), a.alias("arg"))
    return F.when(was.isNull() | (was["tool"] != now["tool"]), None).when(F.size(raw) == 0, way("repeat", F.lit(None).cast("string"))).when(each, way("each", arg)).when(ladder, way("ladder", rung))


def collapse(steps: DataFrame) -> DataFrame:
    """Runs of neighbouring calls of one tool become one step each: repeats, a fan-out over the elements of a list, or a ladder of templates tried after no hits.

    A run ends where a call does not follow from the one before, or follows in another way than the run so far (repeats
    fit any).  Adds repeated (equal calls), each (the argument that takes the items), items, item_refs (the references that
    gave them), rung (the argument of a ladder), ladder (its templates in order) and rung_hits; hits are the sum over
    items, the last rung's, or the most of equal calls.
    """
    # all windows have one order, so that a session is sorted once
    order = Window.partitionBy("trigger", "session").orderBy("idx")
    so_far, before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, -1)
    rows = _maps(dealt(steps, ["trigger", "session"])).withColumn("was", F.lag(F.struct("tool", "args", "raw", "kinds", "hits")).over(order))
    changed = F.struct(*(_changed(F.col(m), F.col("was")[m]).alias(m) for m in ("raw", "args")))
    rows = rows.withColumn("changed", F.when(F.col("was.tool") == F.col("tool"), changed))
    rows = rows.withColumn("way", _way({c: F.col(c) for c in ("tool", "args", "raw", "kinds", "changed")}, F.col("was"))).drop("was", "changed")
    rows = rows.withColumn("stretch", F.sum(F.col("way").isNull().cast("long")).over(so_far))
    # neighbouring ways that are equal form a block; the call with a block's first way begins a run of its own, unless the
    # run before it has no way yet: then the block goes on with that one
    rows = rows.withColumn("narrower", F.when(F.col("way.how") != "repeat", F.col("way")))
    rows = rows.withColumn("met", F.last(F.when(F.col("narrower").isNotNull(), F.struct("stretch", "narrower")), ignorenulls=True).over(before))
    rows = rows.withColumn("turns", F.col("narrower").isNotNull() & ~F.struct("stretch", "narrower").eqNullSafe(F.col("met"))).drop("met")
    rows = rows.withColumn("ways", F.count("narrower").over(so_far)).withColumn("block", F.sum(F.col("turns").cast("long")).over(so_far))
    # blocks are numbered in their stretch; where one begins, the ways since the last beginning are those of the block before it
    rows = rows.withColumn("base", F.last(F.when(F.col("way").isNull(), F.col("block")), ignorenulls=True).over(so_far)).withColumn("ways_then", F.last(F.when(F.col("turns"), F.col("ways")), ignorenulls=True).over(before))
    rows = rows.withColumn("block", F.col("block") - F.col("base"))
    settled = F.col("turns") & ((F.col("block") <= 2) | (F.col("ways") - F.col("ways_then") != 1))
    rows = rows.withColumn("last", F.last(F.when(settled, F.col("block") - 1), ignorenulls=True).over(so_far))
    rows = rows.withColumn("starts", F.col("way").isNull() | (F.col("turns") & (F.col("block") > 1) & ((F.col("block") - F.col("last")) % 2 == 1)))
    rows = rows.withColumn("run", F.sum(F.col("starts").cast("long")).over(so_far)).withColumn("way", F.when(~F.col("starts"), F.col("way")))
    how = F.col("way.how")
    runs = rows.groupBy("trigger", "session", "run").agg(
        F.min_by(F.struct("idx", "tool", *MAPS), "idx").alias("first"), F.max_by(F.struct("args", "hits"), "idx").alias("last"),
        F.max(F.when(how == "each", F.col("way.arg"))).alias("each"), F.max(F.when(how == "ladder", F.col("way.arg"))).alias("rung"),
        F.sum("hits").alias("total"), F.max("hits").alias("most"), (F.count_if(how == "repeat") + 1).alias("repeated"), (F.count_if(how == "each") + 1).alias("items"),
        F.array_sort(F.collect_list(F.when(how == "ladder", F.struct("idx", F.col("args")[F.col("way.arg")].alias("t"), "hits")))).alias("tried"),
        F.collect_set(F.when(how == "each", F.regexp_extract(F.col("args")[F.col("way.arg")], REFERENCE, 0))).alias("taken"), F.min_by("hits", "idx").alias("hits_first"))
    args = F.when(F.col("each").isNotNull(), F.transform_values(F.col("first.args"), lambda k, v: F.when(k == F.col("each"), _per_item(v)).otherwise(v))).when(F.col("rung").isNotNull(), F.col("last.args")).otherwise(F.col("first.args"))
    rungs = lambda first, field, kind: F.when(F.col("rung").isNotNull(), F.concat(F.array(first), F.transform("tried", lambda x: x[field]))).otherwise(F.array().cast(kind))
    ladder, rung_hits = rungs(F.col("first.args")[F.col("rung")], "t", "array<string>"), rungs(F.col("hits_first"), "hits", "array<long>")
    refs = F.when(F.col("each").isNotNull(), F.array_sort(F.array_remove(F.array_union("taken", F.array(F.regexp_extract(F.col("first.args")[F.col("each")], REFERENCE, 0))), ""))).otherwise(F.array().cast("array<string>"))
    hits = F.when(F.col("each").isNotNull(), F.col("total")).when(F.col("rung").isNotNull(), F.col("last.hits")).otherwise(F.col("most"))
    return runs.select("trigger", "session", "first.idx", "first.tool", args.alias("args"), "first.raw", "first.kinds", "first.classes", hits.alias("hits"), "repeated", "each", "items", refs.alias("item_refs"), "rung", ladder.alias("ladder"), rung_hits.alias("rung_hits"))


def _signatures(steps: DataFrame) -> DataFrame:
    """(trigger, tool, sign, named): the distinct class signatures of each tool; few, as they hold kinds of things and no values."""
    return steps.select("trigger", "tool", "sign", "named").dropDuplicates(["trigger", "tool", "sign"])


def _components(signs: DataFrame) -> DataFrame:
    """(trigger, tool, sign, component): signatures that meet are one, directly or over others.

    Two meet if they share a class of some argument, and of each argument for which both name classes; those without
    any class meet each other.  Labels sink to the smallest signature until none changes.
    """
    signs = cut(signs)
    token = F.explode(F.when(F.size("named") == 0, F.array(F.struct(F.lit("").alias("arg"), F.lit("").alias("class")))).otherwise(
        F.flatten(F.transform("named", lambda x: F.transform(x["classes"], lambda c: F.struct(x["arg"].alias("arg"), c.alias("class")))))))
    rows = signs.select("trigger", "tool", "sign", "named", token.alias("t"))
    a = rows.select("trigger", "tool", "t", F.col("sign").alias("a"), F.col("named").alias("x"))
    b = rows.select("trigger", "tool", "t", F.col("sign").alias("b"), F.col("named").alias("y"))
    agree = F.forall("x", lambda p: F.forall("y", lambda q: (p["arg"] != q["arg"]) | F.arrays_overlap(p["classes"], q["classes"])))
    links = cut(a.join(b, ["trigger", "tool", "t"]).where(agree).select("trigger", "tool", "a", "b").distinct())
    label = cut(signs.select("trigger", "tool", "sign", F.col("sign").alias("component")))
    while True:
        near = links.join(label.withColumnRenamed("sign", "b"), ["trigger", "tool", "b"]).groupBy("trigger", "tool", F.col("a").alias("sign")).agg(F.min("component").alias("low"))
        after = cut(label.join(near, ["trigger", "tool", "sign"], "left").select("trigger", "tool", "sign", F.least("component", "low").alias("component"), (F.col("low") < F.col("component")).alias("sank")))
        label = after.drop("sank")
        if after.where("sank").isEmpty():
            return label


def small(df: DataFrame) -> DataFrame:
    """``df`` kept, and sent to every task if it has few rows."""
    df = kept(df)
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def place(steps: DataFrame) -> DataFrame:
    """``align`` with the place of each step in its session; what comes of it is read from files and joins small tables only."""
    named = F.array_sort(F.transform(F.filter(F.map_entries("classes"), lambda e: F.coalesce(e["value"], F.lit("")) != ""), lambda e: F.struct(e["key"].alias("arg"), F.array_sort(F.array_distinct(F.split(e["value"], ","))).alias("classes"))))
    rows = kept(_maps(steps).withColumn("named", named).withColumn("sign", F.sha2(F.to_json("named"), 256)))
    label = small(_components(_signatures(rows)))
    rows = dealt(rows, ["trigger", "session"]).drop("named")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("trigger", "session").orderBy("idx")))
    rows = rows.join(label, ["trigger", "tool", "sign"]).drop("sign")
    rows = kept(rows.withColumn("turn", F.row_number().over(Window.partitionBy("trigger", "session", "tool", "component").orderBy("idx"))))
    common = rows.groupBy("trigger", "tool", "component", "turn").agg(F.avg("place").alias("mean"))
    number = F.row_number().over(Window.partitionBy("trigger").orderBy("mean", "tool", "component", "turn")) - 1
    return rows.join(small(common.withColumn("step", number.cast("long")).drop("mean")), ["trigger", "tool", "component", "turn"]).select(*steps.columns, "step", "place")


def align(steps: DataFrame) -> DataFrame:
    """``steps`` with the number of the common step that each belongs to, in the order of their mean places.

    Calls of one tool whose arguments refer to the same classes of things belong together, whatever their order; the
    second such call of a session belongs to the second common step of that kind.  Only the distinct class signatures
    are compared, not the sessions.
    """
    return place(steps).drop("place")


def argument_rows(aligned: DataFrame) -> DataFrame:
    """One row for each template that a session's step gives an argument: (trigger, step, session, idx, arg, template, hits, open, raw, window); a ladder gives one for each rung, with its own hits.

    ``open``: nothing explains the value; ``window``: it refers to a time.
    """
    has = aligned.columns
    rung = F.col("rung") if "rung" in has else F.lit(None).cast("string")
    rows = aligned.select("trigger", "step", "session", "idx", "hits", "kinds", "classes", "raw", rung.alias("rung"), *([c for c in ("ladder", "rung_hits") if c in has]), F.explode("args").alias("arg", "template"))
    one = F.array(F.struct(F.col("template").alias("t"), F.col("hits").alias("h")))
    tried = F.when(F.col("arg") == F.col("rung"), F.zip_with("ladder", "rung_hits", lambda t, h: F.struct(t.alias("t"), h.alias("h")))).otherwise(one) if "rung_hits" in has else one
    open_ = F.coalesce(F.col("kinds")[F.col("arg")] == "unresolved", F.lit(False))
    window = F.coalesce(F.col("classes")[F.col("arg")] == "window", F.lit(False))
    return rows.select("trigger", "step", "session", "idx", "arg", F.explode(tried).alias("x"), open_.alias("open"), F.col("raw")[F.col("arg")].alias("raw"), window.alias("window")).select(
        "trigger", "step", "session", "idx", "arg", F.col("x.t").alias("template"), F.col("x.h").alias("hits"), "open", "raw", "window")


def sessions_of(aligned: DataFrame) -> Column:
    """The number of sessions of a step, in which ``place`` leaves one row for each."""
    return F.count("*") if "place" in aligned.columns else F.countDistinct("session")


def merge_arguments(aligned: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(trigger, step, arg, kind, templates, dropped, open_values, seen_in): each argument of a common step as constant, bound, majority, window, ladder or unresolved.

    Without any reference the usual literal goes, the first seen at ties; if values differ that nothing explains, the
    argument is unresolved.  Times never become a ladder: the template of most sessions goes.  Other different templates
    become a ladder by hit rate, then frequency, then references, ``MAX_LADDER`` at most; an unexplained literal of a
    single session never gets on it.  Rungs that render the same references are one query with changing constants: the
    first stays and the argument is unresolved.  ``dropped`` counts what is left out; ``open_values`` are the first
    ``MAX_SHOWN`` values of an unresolved argument.  Variants are ranked by a bounded window, never gathered.
    """
    rows = argument_rows(aligned) if rows is None else rows
    key = ["trigger", "step", "arg"]
    sessions = aligned.groupBy("trigger", "step").agg(sessions_of(aligned).alias("seen_in"))
    refs = F.regexp_extract_all("template", F.lit(REFERENCE), F.lit(0))
    # by session first, where the rows are dealt out by it: no task holds more than its sessions
    rows = dealt(rows, ["trigger", "session"])
    found = F.col("hits") > 0
    per = rows.groupBy(*key, "template", "session").agg(
        F.count("*").alias("n"), F.count("hits").alias("told"), F.count_if(found).alias("found"), F.min("idx").alias("idx"), F.bool_or("open").alias("open"), F.bool_or("window").alias("window"))
    variants = per.groupBy(*key, "template").agg(
        F.sum("n").alias("n"), F.count("*").alias("s"), (F.sum("found") / F.sum("told")).alias("rate"), F.min(F.struct("session", "idx")).alias("first"), F.bool_or("open").alias("open"), F.bool_or("window").alias("window"))
    variants = cut(variants)
    variants = variants.withColumn("refs", F.array_join(refs, " ")).withColumn("n_refs", F.size(refs)).withColumn("bound", F.col("n_refs") > 0)
    variants = variants.withColumn("stays", ~(~F.col("bound") & F.col("open") & (F.col("s") == 1)))
    shape = F.when(F.col("stays"), F.col("refs"))
    per = variants.groupBy(*key).agg(
        F.count("*").alias("variants"), F.count_if("bound").alias("bounds"), F.count_if("stays").alias("stay"), F.bool_or("window").alias("window"), (F.min(shape) == F.max(shape)).alias("alike"),
        F.min_by("template", F.struct((-F.col("n")).alias("m"), "first", "template")).alias("usual"), F.min_by("template", F.struct((-F.col("s")).alias("m"), "template")).alias("time"))
    best = Window.partitionBy(*key).orderBy(F.col("rate").desc(), F.col("n").desc(), F.col("n_refs").desc(), "first", "template")
    top = variants.where("stays").withColumn("r", F.row_number().over(best)).where(F.col("r") <= MAX_LADDER)
    top = top.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "template"))), lambda x: x["template"]).alias("rungs"))
    values = rows.where("open").groupBy(*key, "raw").agg(F.lit(True).alias("v"))
    shown = values.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("raw"))).where(F.col("r") <= MAX_SHOWN)
    shown = shown.groupBy(*key).agg(F.array_sort(F.collect_list("raw")).alias("shown"))
    both = per.join(top, key, "left").join(shown, key, "left").join(sessions, ["trigger", "step"])
    several = F.coalesce(F.size("shown") > 1, F.lit(False))
    kind = (
        F.when((F.col("variants") == 1) & (F.col("bounds") == 0), "constant").when(F.col("variants") == 1, "bound").when((F.col("bounds") == 0) & several, "unresolved").when(F.col("bounds") == 0, "majority")
        .when(F.col("window"), "window").when(F.col("stay") == 1, "bound").when(F.col("alike"), "unresolved").otherwise("ladder")
    )
    both = both.withColumn("kind", kind)
    fixed = F.col("kind").isin("constant", "majority") | (F.col("bounds") == 0)
    templates = F.when(fixed | (F.col("variants") == 1), F.array("usual")).when(F.col("kind") == "window", F.array("time")).when(F.col("kind") == "unresolved", F.slice("rungs", 1, 1)).otherwise(F.col("rungs"))
    dropped = F.when(F.col("kind").isin("ladder", "bound"), F.col("variants") - F.size(templates)).otherwise(0)
    return both.select(*key, "kind", templates.alias("templates"), dropped.cast("long").alias("dropped"), F.when(several | (F.col("kind") == "unresolved"), F.coalesce("shown", F.array().cast("array<string>"))).alias("open_values"), "seen_in")


def reproduces(rendered: DataFrame, recorded: DataFrame, key: list[str]) -> DataFrame:
    """(step, arg, ok) of proposed bindings: accepted if every episode's recorded value is rendered exactly, and values vary."""
    both = recorded.join(rendered.withColumnRenamed("value", "got"), key + ["step", "arg"], "left")
    return both.groupBy("step", "arg").agg((F.bool_and(F.coalesce(F.col("got") == F.col("value"), F.lit(False))) & (F.countDistinct("value") > 1)).alias("ok"))
