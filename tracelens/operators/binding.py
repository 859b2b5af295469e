"""Where the arguments of a call came from: equal values, typed ids, labelled lines, hub attributes and time arithmetic.

Candidates are rows (episode, at, value, kind, ord, in_list, first, source, name), one for each value that a call's
result offers to later calls.  A binding is the best candidate of an equal value and an earlier call: an equi-join on
episode and value, and one row by rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelens.functions import ids
from tracelens.functions.extract import floor_to

from .ranking import dealt

# Preference among kinds, roundings of an anchor with their whole steps in seconds, and the reach of a window.
KIND_ORDER = {"input": 0, "workspace": 0, "copy": 1, "catalog": 1, "ids": 2, "regex": 2, "catalog-attr": 3}
ROUNDINGS = ((None, 900), ("1d", 86400), ("1h", 1800))
REACH_SECONDS = 30 * 86400


def leaves(rows: DataFrame, key: list[str], json: str) -> DataFrame:
    """(key, path, value) of every scalar of a JSON column, list places as ``[*]``; null results give nothing.

    Levels are opened one after the other until none is left, so the depth of a document bounds the rounds.
    """
    level = rows.select(*key, F.lit("").alias("path"), F.try_parse_json(json).alias("v")).where("v is not null")
    out = None
    while True:
        shape = F.schema_of_variant("v")
        flat = level.where(~shape.rlike("^(OBJECT|ARRAY|VOID)")).select(*key, "path", F.col("v").cast("string").alias("value"))
        out = flat if out is None else out.unionByName(flat)
        deep = level.where(shape.rlike("^(OBJECT|ARRAY)")).persist()
        if deep.isEmpty():
            break
        kids = deep.lateralJoin(deep.sparkSession.tvf.variant_explode(F.col("v").outer())).select(*key, "path", "pos", F.col("key").alias("_k"), F.col("value").alias("v"))
        word = F.col("_k").rlike("^[A-Za-z_][A-Za-z0-9_]*$")
        name = F.when(F.col("_k").isNull(), F.concat("path", F.lit("[*]"))).when(~word, F.concat("path", F.lit("['"), F.col("_k"), F.lit("']"))).when(F.col("path") == "", F.col("_k")).otherwise(F.concat_ws(".", "path", "_k"))
        level = kids.select(*key, name.alias("path"), "v")
    return out


def typed_candidates(texts: DataFrame, key: str, text: str, kinds: tuple[str, ...] = ids.KINDS) -> DataFrame:
    """(key, value, kind) of the typed ids inside a result's texts."""
    got = ids.typed_mentions(texts, key, text, kinds)
    return got.where(~ids.is_credential(F.col("kind"))).select(key, "value", F.concat(F.lit("ids:"), F.col("kind")).alias("kind")).distinct()


def rank(kind: Column, in_list: Column, first: Column) -> Column:
    """Smaller is better: kind, then scalars before lists; a value that is no list's first comes last."""
    order = F.lit(2)
    for name, n in KIND_ORDER.items():
        order = F.when(F.substring_index(kind, ":", 1) == name, F.lit(n)).otherwise(order)
    return F.struct(F.when(in_list & ~first, F.lit(4)).otherwise(order).alias("order"), in_list.alias("in_list"))


def bind(args: DataFrame, candidates: DataFrame, episode: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """Each argument (episode, at, arg, value) with its best earlier candidate; without one its kind is ``unresolved``.

    Arguments and candidates of one value form one ordered stream, along which the best candidate so far is carried on:
    linear in both, also for a value that recurs all through an episode.  ``carry``: more columns of ``args`` to keep.
    """
    best = F.struct(rank(F.col("kind"), F.col("in_list"), F.col("first")).alias("_r"), F.col("at").alias("src"), "kind", "source", "name")
    right = candidates.where("value is not null").select(*episode, "value", "at", F.lit(None).cast("string").alias("arg"), F.lit(1).alias("_side"), best.alias("_c"))
    left = args.select(*episode, "value", "at", F.col("arg"), *carry, F.lit(0).alias("_side"), F.lit(None).cast(right.schema["_c"].dataType).alias("_c"))
    w = W.partitionBy(*episode, "value").orderBy("at", "_side").rowsBetween(W.unboundedPreceding, W.currentRow)  # a call does not bind to itself
    both = dealt(left.unionByName(right, allowMissingColumns=True), [*episode, "value"]).withColumn("b", F.min("_c").over(w)).where("_side = 0")
    return both.select(*episode, "at", "arg", "value", *carry, F.coalesce("b.kind", F.lit("unresolved")).alias("kind"), F.col("b.src").alias("src"), F.col("b.source").alias("source"), F.col("b.name").alias("name"))


def attribute_candidates(mentions: DataFrame, hub: DataFrame, episode: list[str]) -> DataFrame:
    """Attributes of mentioned hub entities: mentions (episode, at, name) and hub (name, attr, value)."""
    return mentions.join(hub, "name").select(*episode, "at", "value", F.concat(F.lit("catalog-attr:"), F.col("attr")).alias("kind"), F.lit(False).alias("in_list"), F.lit(True).alias("first"), F.col("name").alias("source"), F.col("attr").alias("name"))


def _lanes(rows: DataFrame, keep: list[str], t: str, kind: str) -> DataFrame:
    """A row for each rounding and side of reach: seconds of equal ``n`` and ``left`` are whole steps apart; in a lane's ``bucket``, what comes first by ``x`` is in reach.

    Buckets are as wide as the reach: all of a time's own bucket is in reach, of the one before it what is late enough,
    of the one behind it what is early enough.
    """
    out = []
    for n, (unit, step) in enumerate(ROUNDINGS):
        a = floor_to(F.col(t), unit) if unit and kind == "anchor" else F.col(t)
        some = rows.where(a != F.col(t)) if unit and kind == "anchor" else rows
        s = F.unix_timestamp(a)
        bucket = F.floor(s / REACH_SECONDS)
        if kind == "anchor":
            lane = [(0, bucket, F.lit(0)), (1, bucket, -s), (2, bucket, s)]
        else:
            lane = [(0, bucket, F.lit(0)), (1, bucket - 1, -(s - REACH_SECONDS)), (2, bucket + 1, s + REACH_SECONDS)]
        lanes = F.explode(F.array(*[F.struct(F.lit(i).alias("lane"), b.cast("long").alias("bucket"), x.cast("long").alias("x")) for i, b, x in lane])).alias("l")
        out.append(some.select(*keep, s.alias("s"), F.lit(n).alias("n"), F.pmod(s, F.lit(step)).alias("left"), lanes).select(*keep, "s", "n", "left", "l.*"))
    return out[0].unionByName(out[1]).unionByName(out[2])


def earliest_anchors(times: DataFrame, anchors: DataFrame, episode: list[str]) -> DataFrame:
    """(episode, at, src): of each time the earliest call before it with an anchor a whole number of steps away.

    Times and anchors of one episode, rounding and remainder form ordered streams, along which the earliest call so far
    is carried on: no pair of them is made.
    """
    a = _lanes(anchors.where("t is not null").select(*episode, "at", "t"), [*episode, "at"], "t", "anchor").select(*episode, "n", "left", "lane", "bucket", "x", F.lit(0).alias("side"), F.col("at").alias("src"), F.lit(None).cast("long").alias("at"))
    q = _lanes(times.where("t is not null").select(*episode, "at", "t"), [*episode, "at"], "t", "time").select(*episode, "n", "left", "lane", "bucket", "x", F.lit(1).alias("side"), F.lit(None).cast("long").alias("src"), F.col("at").cast("long").alias("at"))
    w = W.partitionBy(*episode, "n", "left", "lane", "bucket").orderBy("x", "side").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = a.unionByName(q).withColumn("src", F.min("src").over(w)).where("side = 1 and src < at")
    return seen.groupBy(*episode, "at").agg(F.min("src").alias("src"))


def _options(pairs: DataFrame) -> DataFrame:
    """``pairs`` of a time t and an anchor a with the first rounding that fits as ``o`` (n, far, round, delta)."""
    options = []
    for n, (unit, step) in enumerate(ROUNDINGS):
        anchor = floor_to(F.col("a"), unit) if unit else F.col("a")
        delta = F.unix_timestamp("t") - F.unix_timestamp(anchor)
        fits = (F.abs(delta) <= REACH_SECONDS) & (delta % step == 0)
        if unit:
            fits = fits & (anchor != F.col("a"))
        options.append(F.when(fits, F.struct(F.lit(n).alias("n"), F.abs(delta).alias("far"), F.lit(unit or "exact").alias("round"), delta.alias("delta"))))
    return pairs.withColumn("o", F.coalesce(*options)).where("o is not null")


def bind_windows(times: DataFrame, anchors: DataFrame, episode: list[str]) -> DataFrame:
    """Times that lie whole steps away from an earlier time of the episode: (episode, at, src, round, delta).

    The exact anchor is tried first, then the anchor floored to the day and to the hour; the earliest anchor wins, then
    the order of the roundings, then the smallest distance.
    """
    first = times.join(earliest_anchors(times, anchors, episode), [*episode, "at"])
    best = _options(first.join(anchors.select(*episode, F.col("at").alias("src"), F.col("t").alias("a")), [*episode, "src"]))
    top = best.groupBy(*episode, "at").agg(F.min(F.struct("src", "o.n", "o.far", "o.round", "o.delta")).alias("b"))
    return top.select(*episode, "at", "b.src", F.col("b.round").alias("round"), F.col("b.delta").alias("delta"))


def session_windows(times: DataFrame, anchors: DataFrame, episode: list[str]) -> DataFrame:
    """(episode, at, arg, src, path, round, delta, side): all times of an episode held against one anchor field, ``side`` being start or end of its window.

    times: (episode, at, arg, t); anchors: (episode, at, path, in_list, t), the times in the calls' results.  First the
    field is settled: of the earliest call whose times explain any later one, rather no list's, then the one with the
    earliest time that does, then by name.  Then every later time that lies whole steps from it is bound, by the order of
    the roundings, then the nearest; all others stay unbound.
    """
    early = earliest_anchors(times, anchors, episode).groupBy(*episode).agg(F.min("src").alias("src"))
    fields = anchors.select(*episode, F.col("at").alias("src"), "path", "in_list", F.col("t").alias("a")).join(early, [*episode, "src"])
    fits = _options(times.join(fields, episode).where(F.col("src") < F.col("at")))
    field = fits.groupBy(*episode, "src", "path").agg(F.min(F.struct("in_list", "a", "path")).alias("f")).groupBy(*episode).agg(F.min_by("path", "f").alias("path"))
    best = fits.join(field, [*episode, "path"]).groupBy(*episode, "at", "arg").agg(F.min(F.struct("o.n", "o.far", "o.round", "o.delta", "src", "path")).alias("b"))
    side = F.when(F.col("b.delta") <= 0, "start").otherwise("end")
    return best.select(*episode, "at", "arg", "b.src", "b.path", F.col("b.round").alias("round"), F.col("b.delta").alias("delta"), side.alias("side"))


def edges(bound: DataFrame, episode: list[str], target: str) -> DataFrame:
    """Call edges from bindings: (episode, source, value_type, target, arg, src, at); unresolved ones have none."""
    kind = F.col("kind")
    value_type = F.when(kind.isin("copy", "regex"), F.concat_ws(":", kind, F.regexp_replace("name", r"_\d+$", ""))).otherwise(kind)
    return bound.where(kind != "unresolved").select(*episode, "source", value_type.alias("value_type"), F.col(target).alias("target"), "arg", "src", "at").distinct()
