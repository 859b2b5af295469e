"""Audit of how text filters interact, on packed bitmaps.

Five filters in any order remove documents; each removes what its predecessors left.
Every Arrow batch packs bitsets in NumPy: one of each filter's failures, one of each
label, and one of each part's members (rows are laid out part by part, so a part's bits
are a run of bytes).  For each of the 32 sets of filters, AND-NOT with the set's failures
leaves the part's survivors, and popcounts of these, alone and AND each label, are summed
over batches and partitions.  All 120 orders follow from these sums: what a filter removes
after a set of others is the difference of two survivors' counts.

Failures: A under 100 words; B 100 * distinct words < 80 * words; C 100 * ``[A-Z]``
characters > 10 * code points; D holds one of ``#$%&*|``; E identical to the text of any
smaller doc_id.  For E, the smallest doc_id of each text is found by a map-side combined
minimum and joined by doc_id and text together, so copies of one text, however many, meet
in no one task.

Defined results: a null text is an empty one; a null lang is the part of the empty string;
a row without a doc_id is no copy and makes none; repeated rows of the smallest doc_id are
no copies of each other; labels of a repeated doc_id hold if one row has them; columns beside
those named take no part; an empty table has no parts and no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

FILTERS = "ABCDE"
WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT, MARKS = 100, 80, 10, "[#$%&*|]"
SETS = 1 << len(FILTERS)
COUNTS = ("n", "good", "toxic")


def text_failures(text: str) -> list[Column]:
    """Failures of A to D, from the text alone."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(F.translate(t, "\t\n\x0b\x0c\r", " " * 5), " "), "")
    # the words as a lambda's variable: a text is cut once
    size = F.get(F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d"))), F.lit(0))
    capitals = F.regexp_count(t, F.lit("[A-Z]"))
    return [size["n"] < WORDS, size["d"] * 100 < size["n"] * DISTINCT_PERCENT, capitals * 100 > F.char_length(t) * CAPITALS_PERCENT, t.rlike(MARKS)]


def bits(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(part, fails, good, toxic) of each document: the filters that it fails as the bits of a number, A the lowest."""
    t = F.coalesce("text", F.lit(""))
    a, b, c, d = text_failures("text")
    packed = sum((x.cast("int") * (1 << k) for k, x in enumerate((b, c, d), 1)), a.cast("int"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.sha2(t, 256).alias("same"), packed.alias("fails"))
    rows = scratch.save(rows, "texts")
    named = rows.where("doc_id is not null")
    first = named.groupBy("same").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    no = F.lit(False)
    copy = F.when(F.col("first"), 0).otherwise(1 << FILTERS.index("E"))
    out = named.join(first, ["doc_id", "same"], "left").join(marks, "doc_id", "left").select("part", (F.col("fails") + copy).alias("fails"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    return out.unionByName(rows.where("doc_id is null").select("part", "fails", no.alias("good"), no.alias("toxic")))


def survivors(rows: DataFrame) -> DataFrame:
    """(part, gone, n, good, toxic): the documents of a part that fail no filter of the set ``gone``, and those of them with each label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).dictionary_encode()
            part = names.indices.to_numpy()
            order = np.argsort(part, kind="stable")
            part, fails = part[order], batch.column(1).to_numpy()[order]
            size = np.bincount(part, minlength=len(names.dictionary))
            # each part begins at a byte of its own
            room = (size + 7) // 8
            start = np.concatenate([[0], np.cumsum(room)])[:-1]
            at = start[part] * 8 + np.arange(len(part)) - np.repeat(np.cumsum(size) - size, size)

            def bitset(flags: np.ndarray) -> np.ndarray:
                wide = np.zeros(room.sum() * 8, dtype=bool)
                wide[at] = flags
                return np.packbits(wide)

            member = bitset(np.ones(len(part), dtype=bool))
            failing = [bitset(fails >> k & 1) for k in range(len(FILTERS))]
            marks = [member] + [bitset(batch.column(k).to_numpy(zero_copy_only=False)[order]) for k in (2, 3)]
            nothing = np.zeros_like(member)
            found = np.empty((SETS, 3, len(size)), dtype=np.int64)
            for gone in range(SETS):
                left = member & ~reduce(np.bitwise_or, [failing[k] for k in range(len(FILTERS)) if gone >> k & 1], nothing)
                for j, mark in enumerate(marks):
                    found[gone, j] = np.add.reduceat(np.bitwise_count(left & mark).astype(np.int64), start)
            parts = np.tile(np.arange(len(size)), SETS)
            yield pa.RecordBatch.from_arrays(
                [names.dictionary.take(pa.array(parts)).cast(pa.string()), pa.array(np.repeat(np.arange(SETS, dtype=np.int32), len(size))), *(pa.array(found[:, j].ravel()) for j in range(3))], ["part", "gone", *COUNTS])

    some = rows.select("part", "fails", "good", "toxic").mapInArrow(run, "part string, gone int, n long, good long, toxic long")
    return some.groupBy("part", "gone").agg(*(F.sum(c).alias(c) for c in COUNTS))


def audit(rows: DataFrame) -> DataFrame:
    """Per part, filter_order and step the counts kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley of rows as ``bits`` gives them."""
    every = SETS - 1
    take = lambda c, s: F.get(c, F.lit(s) if isinstance(s, int) else s)
    by_set = survivors(rows).groupBy("part").agg(F.array_sort(F.collect_list(F.struct("gone", *COUNTS))).alias("s"))
    by_set = by_set.select("part", *(F.col(f"s.{c}").alias(c) for c in COUNTS))
    # over all orders: a set of k filters comes before one in k! (4 - k)! of them
    shares = []
    for f in range(len(FILTERS)):
        sets = [s for s in range(SETS) if not s >> f & 1]
        shares.append(sum(((take("n", s) - take("n", s | 1 << f)) * (factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count())) for s in sets), F.lit(0)))
    orders = F.split(F.lit(" ".join(map("".join, permutations(FILTERS)))), " ")
    flat = by_set.withColumn("shares", F.array(*shares)).withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    head = lambda n: F.expr(f"substring(filter_order, 1, {n})")
    mask = lambda text: sum((F.contains(text, F.lit(x)).cast("int") * (1 << k) for k, x in enumerate(FILTERS)), F.lit(0))
    flat = flat.withColumn("before", mask(head("step - 1"))).withColumn("after", mask(head("step")))
    before, after = F.col("before"), F.col("after")
    own = after - before
    lost = lambda c: take(c, before) - take(c, after)
    return flat.select(
        "part", "filter_order", "step", take("n", after).alias("kept"), lost("n").alias("removed"), (take("n", 0) - take("n", own) - lost("n")).alias("redundant"),
        (take("n", F.lit(every) - own) - take("n", every)).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
        F.get("shares", F.bit_count(own - 1)).alias("shapley"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(bits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark, "audit")))
