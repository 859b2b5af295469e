"""What the searched sources compute: pages of results with totals, lines with context, metric series, lookups by interval or prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def page(found: DataFrame, order: list[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """One page of results in order, with the number of all results; the sort keeps no more than the page's end."""
    limit = max(1, min(limit, 1000))
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy(*order).offset(offset).limit(limit).withColumn("total", total.scalar())


def lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    return texts.select(key, F.posexplode(F.split(text, "\n")).alias("line", "content"))


def grep(texts: DataFrame, key: str, text: str, pattern: str, context: int = 0) -> DataFrame:
    """(key, line, content, before, after) of the lines that match; contexts come from the text's own lines."""
    part = F.split(text, "\n")
    hit = texts.where(F.col(text).rlike(f"(?m){pattern}")).select(key, part.alias("_l"), F.posexplode(part).alias("line", "content")).where(F.col("content").rlike(pattern))
    before = F.slice("_l", F.greatest(F.lit(1), F.col("line") + 1 - context), F.least(F.col("line"), F.lit(context)))
    after = F.slice("_l", F.col("line") + 2, F.lit(max(context, 0)))
    return hit.select(key, "line", "content", F.array_join(before, "\n").alias("before"), F.array_join(after, "\n").alias("after"))


def grep_counts(texts: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, n) of the texts with matching lines."""
    return grep(texts, key, text, pattern).groupBy(key).agg(F.count("*").alias("n"))


def excerpt(rows: DataFrame, key: list[str], order: str, hit: Column, context: int = 2) -> DataFrame:
    """Lines near a hit stay; others fold: (key, block, first, last, folded)."""
    w = W.partitionBy(*key).orderBy(order)
    near = F.max(hit.cast("int")).over(w.rowsBetween(-context, context)) == 1
    marked = rows.select(*key, order, near.alias("_near"))
    new = F.coalesce(F.lag("_near").over(w) != F.col("_near"), F.lit(True)).cast("int")
    blocks = marked.withColumn("_new", new).withColumn("block", F.sum("_new").over(w))
    return blocks.groupBy(*key, "block").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.bool_and(~F.col("_near")).alias("folded"))


def bands(points: DataFrame, spikes: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """``points`` with the number of spikes of their key around them, ends included.

    Begins, points and ends of a key form one ordered stream with a running sum: linear, where a range join would pair each
    point with all spikes around it.
    """
    row = F.struct(*points.columns)
    empty = F.lit(None).cast(points.select(row.alias("r")).schema["r"].dataType)
    edge = lambda t, side, n: spikes.select(key, F.col(t).alias("_t"), F.lit(side).alias("_side"), F.lit(n).alias("_n"), empty.alias("_row"))
    stream = edge(start, 0, 1).unionByName(points.select(key, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(0).alias("_n"), row.alias("_row"))).unionByName(edge(end, 2, -1))
    w = W.partitionBy(key).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    return stream.withColumn("spikes", F.sum("_n").over(w)).where("_side = 1").select("_row.*", "spikes")


def on_call(asks: DataFrame, shifts: DataFrame, key: list[str], at: str, start: str, end: str, person: str) -> DataFrame:
    """Who is on call: the first shift that holds the time, else the last shift's person.

    In the order of their starts, a shift counts only if it ends later than all before it: the first of these that ends
    after a time holds it, if it has begun, and no other shift does otherwise.  So asks and such ends form one stream.
    """
    last = shifts.groupBy(*key).agg(F.max_by(person, F.struct(start, person)).alias("_last"))
    s = shifts.where((F.col(start) < F.col(end)) & F.col(start).isNotNull()).select(*key, F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(person).alias("_p"))
    before = F.max("_e").over(W.partitionBy(*key).orderBy("_s", "_p", "_e").rowsBetween(W.unboundedPreceding, -1))
    records = s.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_e") > F.col("_b")))
    row = F.struct(*asks.columns)
    empty = F.lit(None).cast(asks.select(row.alias("r")).schema["r"].dataType)
    shift = F.struct("_s", "_p")
    left = asks.select(*key, F.col(at).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(s.select(shift.alias("x")).schema["x"].dataType).alias("_x"), row.alias("_row"))
    right = records.select(*key, F.col("_e").alias("_t"), F.lit(1).alias("_side"), shift.alias("_x"), empty.alias("_row"))
    # from late to early, an ask before an end at the same time: the nearest end passed is the first that comes after it
    w = W.partitionBy(*key).orderBy(F.col("_t").desc(), "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = left.unionByName(right).withColumn("_x", F.last("_x", ignorenulls=True).over(w)).where("_side = 0")
    hit = F.when(F.col("_x._s") <= F.col("_t"), F.col("_x._p"))
    rows = found.select("_row.*", hit.alias("_hit"))
    return rows.join(last, key, "left").select(*asks.columns, F.coalesce("_hit", "_last").alias("on_call"))


def by_prefix(short: DataFrame, full: DataFrame, short_id: str, full_id: str, order: str, least: int = 7) -> DataFrame:
    """Each short id with the first full id that begins with it; the first characters are the join key."""
    a = short.where(F.length(short_id) >= least).withColumn("_k", F.substring(short_id, 1, least))
    b = full.withColumn("_k", F.substring(full_id, 1, least)).select("_k", full_id, order)
    both = a.join(b, "_k").where(F.startswith(full_id, F.col(short_id)))
    return both.groupBy(short_id).agg(F.min_by(full_id, order).alias(full_id))


def owners(paths: DataFrame, rules: DataFrame, path: str) -> DataFrame:
    """The owner by the last rule whose prefix a path has: each path is cut into its prefixes, which are the join key."""
    parts = F.split(path, "/")
    cuts = paths.select(path, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("prefix"))
    return paths.select(path).join(cuts.join(rules, "prefix").groupBy(path).agg(F.max_by("owner", "rule_no").alias("owner")), path, "left")


def layered(specs: DataFrame, name: str, layer: str, spec: str) -> DataFrame:
    """Later layers win; one that is null takes the name away."""
    return specs.groupBy(name).agg(F.max_by(F.struct(spec), layer).alias("s")).select(name, f"s.{spec}").where(F.col(spec).isNotNull())


def newest_version(names: DataFrame, name: str) -> DataFrame:
    """base, newest version, and the next free one, of names like ``base.v3``."""
    base, v = F.regexp_replace(name, r"\.v\d+$", ""), F.regexp_extract(name, r"\.v(\d+)$", 1)
    n = F.when(v == "", F.lit(1)).otherwise(v.try_cast("int"))
    return names.groupBy(base.alias("base")).agg(F.max(n).cast("long").alias("newest"), (F.max(n) + 1).cast("long").alias("next"))
