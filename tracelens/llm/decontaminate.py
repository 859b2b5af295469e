"""Benchmark decontamination with suffix arrays over the training text.

The training documents are read in shards.  A shard becomes one sequence of word
numbers (documents apart from each other by a word that no benchmark has) and a
suffix array is built over it by prefix doubling: the suffixes are ranked by
their first 4, 8 and 12 words.  Every suffix of a benchmark item, cut to the
window length, is then binary-searched through the same levels, which yields the
range of the array, and so all places, where it occurs verbatim.  Chains of such
places along one document and one item give the longest verbatim match.

Only suffixes that begin with a benchmark word are put into the array, as no
other can match, and only windows whose words all stand in the shard are searched.
The benchmark side is broadcast in blocks of at most ``BLOCK_WORDS`` words and
``DISTINCT`` different ones, as it is read; a benchmark of more than one block
is searched block after block, each in a pass of its own whose results are
written before the next.  Nothing is shuffled: a shard lies within a task.

Words are compared by 64-bit hashes.  Defined results: null, empty or wordless
texts and items match nothing; items with equal text are all reported; repeated
documents are reported alike; an item of fewer words than a window is one window;
texts of any length are searched whole, in shards; columns of clashing names are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, table
from .textbytes import batches, give_back, word_table, words

WINDOW = 10
DEPTH = 12  # words by which suffixes are ordered; a window may not be longer
SHARD_WORDS = 300_000
#: Words of one broadcast block (some 50 bytes each), and of its different words, which 16 bits number.
BLOCK_WORDS, DISTINCT = 1_000_000, 65_000
WORD = word_table([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


class Block:
    """Some benchmark items: their vocabulary, and each window as word numbers."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int) -> None:
        self.names = [n for n, _ in items]
        self.vocab = np.unique(np.concatenate([h for _, h in items])) if items else np.zeros(0, dtype=np.uint64)
        rows, item, place, length = [], [], [], []
        for i, (_, h) in enumerate(items):
            ids = (np.searchsorted(self.vocab, h) + 1).astype(np.uint16)
            n = min(window, len(ids))
            wide = np.zeros((len(ids) - n + 1, DEPTH), dtype=np.uint16)
            wide[:, :n] = np.lib.stride_tricks.sliding_window_view(ids, n)
            rows.append(wide)
            item.append(np.full(len(wide), i))
            place.append(np.arange(len(wide)))
            length.append(np.full(len(wide), n))
        self.rows = np.concatenate(rows) if rows else np.zeros((0, DEPTH), dtype=np.uint16)
        self.item, self.place, self.length = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, dtype=np.int64) for x in (item, place, length))

    def possible(self, ids: np.ndarray) -> np.ndarray:
        """The windows all of whose words are among ``ids``."""
        here = np.zeros(len(self.vocab) + 1, dtype=bool)
        here[ids] = True
        here[0] = True  # no word
        some = np.arange(len(self.rows))
        for k in range(DEPTH):
            some = some[here[self.rows[some, k]]]
        return some


def _fours(ids: np.ndarray) -> np.ndarray:
    """Each position's next four word numbers as one integer that sorts like them."""
    n = len(ids)
    wide = np.concatenate([ids, np.zeros(4, dtype=np.uint64)])
    key = np.zeros(n, dtype=np.uint64)
    for k in range(4):
        key = (key << np.uint64(16)) | wide[k : n + k]
    return key


class SuffixArray:
    """The suffixes of ``ids`` that begin with a benchmark word (a number above 0), in order of their first 12 words."""

    def __init__(self, ids: np.ndarray) -> None:
        n = len(ids)
        begin = np.flatnonzero(ids)
        self.four, rank = np.unique(_fours(ids)[begin], return_inverse=True)
        r4 = np.zeros(n + 8, dtype=np.uint64)
        r4[begin] = rank.astype(np.uint64) + np.uint64(1)
        self.eight, rank = np.unique((r4[begin] << np.uint64(32)) | r4[begin + 4], return_inverse=True)
        key = ((rank.astype(np.uint64) + np.uint64(1)) << np.uint64(32)) | r4[begin + 8]
        order = np.argsort(key, kind="stable")
        self.key, self.at = key[order], begin[order]

    @staticmethod
    def _range(levels: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (from 1) of the entries in [low, high)."""
        return np.searchsorted(levels, low).astype(np.uint64) + np.uint64(1), np.searchsorted(levels, high).astype(np.uint64) + np.uint64(1)

    def find(self, rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The part [low, high) of the array whose suffixes begin with each row's first ``length`` words."""
        one, s = np.uint64(1), np.uint64(32)
        lo = hi = None
        for part in (2, 1, 0):
            words_here = np.clip(length - 4 * part, 0, 4)
            key = np.zeros(len(rows), dtype=np.uint64)
            for k in range(4):
                key = (key << np.uint64(16)) | rows[:, 4 * part + k]
            span = np.where(words_here > 0, np.uint64(1) << ((4 - np.maximum(words_here, 1)) * 16).astype(np.uint64), np.uint64(0))
            a, b = self._range(self.four, key, key + span)
            wide = key + span < key  # past the largest key
            b = np.where(wide, np.uint64(len(self.four) + 1), b)
            if part == 2:
                third = np.where(words_here > 0, a, np.uint64(0)), np.where(words_here > 0, b, np.uint64(1) << s)
            elif part == 1:
                second = np.where(words_here > 0, a, np.uint64(0)), np.where(words_here > 0, b, np.uint64(1) << s)
            else:
                lo, hi = a, b
        full = length > 4
        low8 = (lo << s) | np.where(full, second[0], np.uint64(0))
        high8 = np.where(full, (lo << s) + second[1], hi << s)
        missing = full & (hi - lo != one)
        e_lo, e_hi = self._range(self.eight, low8, high8)
        deep = length > 8
        low = (e_lo << s) | np.where(deep, third[0], np.uint64(0))
        high = np.where(deep, (e_lo << s) + third[1], e_hi << s)
        missing |= deep & (e_hi - e_lo != one)
        low, high = np.searchsorted(self.key, low), np.searchsorted(self.key, high)
        return np.where(missing, 0, low), np.where(missing, 0, np.maximum(low, high))


def _longest(doc: np.ndarray, at: np.ndarray, item: np.ndarray, place: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length and start of the longest chain of windows one word apart, for each hit that ends a chain."""
    order = np.lexsort((at, place - at, item, doc))
    d, a, i, p, n = doc[order], at[order], item[order], place[order], length[order]
    follows = np.zeros(len(d), dtype=bool)
    follows[1:] = (d[1:] == d[:-1]) & (i[1:] == i[:-1]) & (p[1:] == p[:-1] + 1) & (a[1:] == a[:-1] + 1)
    first = np.flatnonzero(~follows)
    last = np.append(first[1:], len(d)) - 1
    return d[first], a[last] + n[last] - a[first], a[first]


def scan(texts: list[str | None], block: Block) -> list[tuple[int, list[tuple[int, int]], set[int], int, int]]:
    """For each text: words, hit runs [start, end), indices of the items that occur, longest match and its place (-1: none)."""
    out: list[tuple[int, list[tuple[int, int]], set[int], int, int]] = []
    for _, some in batches(texts):
        hashes, offsets = words(some, WORD)
        found: list[tuple[np.ndarray, ...]] = []
        if len(hashes) and len(block.vocab):
            slot = np.searchsorted(block.vocab, hashes)
            known = block.vocab[np.minimum(slot, len(block.vocab) - 1)] == hashes
            # one word number of 0 after each document, so that no match crosses two
            shift = np.repeat(np.arange(len(some)), np.diff(offsets))
            ids = np.zeros(len(hashes) + len(some), dtype=np.uint64)
            ids[np.arange(len(hashes)) + shift] = np.where(known, slot + 1, 0)
            begins = offsets[:-1] + np.arange(len(some))
            for a in range(0, len(ids), SHARD_WORDS):
                part = ids[a : a + SHARD_WORDS + DEPTH - 1]
                if not part.any():
                    continue
                some_rows = block.possible(part.astype(np.int64))
                if not len(some_rows):
                    continue
                array = SuffixArray(part)
                low, high = array.find(block.rows[some_rows].astype(np.uint64), block.length[some_rows])
                hit = np.flatnonzero(high > low)
                n = (high - low)[hit]
                which = np.repeat(some_rows[hit], n)
                where = array.at[np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[hit], n)]
                own = where < SHARD_WORDS  # those in the overlap belong to the next shard
                found.append((where[own] + a, which[own]))
        at = np.concatenate([f[0] for f in found]) if found else np.zeros(0, dtype=np.int64)
        which = np.concatenate([f[1] for f in found]) if found else np.zeros(0, dtype=np.int64)
        rows: list = [(int(c), [], set(), 0, -1) for c in np.diff(offsets)]
        if len(at):
            doc = np.searchsorted(begins, at, side="right") - 1
            at = at - begins[doc]
            item, place, length = block.item[which], block.place[which], block.length[which]
            chain_doc, chain_len, chain_at = _longest(doc, at, item, place, length)
            order = np.lexsort((chain_at, -chain_len, chain_doc))
            first = np.unique(chain_doc[order], return_index=True)[1]
            best = {int(chain_doc[k]): (int(chain_len[k]), int(chain_at[k])) for k in order[first]}
            order = np.lexsort((at, doc))
            doc, start, end, item = doc[order], at[order], (at + length)[order], item[order]
            edge = np.flatnonzero(np.diff(doc)) + 1
            for s, e in zip(np.append(0, edge), np.append(edge, len(doc)), strict=True):
                k = int(doc[s])
                reach = np.maximum.accumulate(end[s:e])
                cut = np.append(True, start[s + 1 : e] > reach[:-1])
                runs = list(zip(start[s:e][cut].tolist(), reach[np.append(np.flatnonzero(cut)[1:] - 1, e - s - 1)].tolist(), strict=True))
                rows[k] = (rows[k][0], runs, set(item[s:e].tolist()), *best[k])
        out += rows
    return out


RESULT = "n_words long, runs array<struct<a:long,b:long>>, items array<string>, longest long, longest_at long"


def _scanner(spark: SparkSession, block: Block):
    shared = spark.sparkContext.broadcast(block)

    @F.pandas_udf(RESULT)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        b = shared.value
        for batch in texts:
            rows = scan(batch.tolist(), b)
            yield pd.DataFrame({
                "n_words": [r[0] for r in rows], "runs": [[{"a": x, "b": y} for x, y in r[1]] for r in rows],
                "items": [[b.names[i] for i in sorted(r[2])] for r in rows], "longest": [r[3] for r in rows], "longest_at": [r[4] for r in rows]})
        give_back()

    return run


def blocks(benchmark: DataFrame, window: int, most: int) -> Iterator[Block]:
    """The benchmark in blocks of bounded size, streamed to the driver one partition at a time."""
    some: list[tuple[str, np.ndarray]] = []
    size, seen = 0, set()
    rows = benchmark.where("text is not null").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), "text")
    for r in rows.toLocalIterator():
        h = words([r["text"].encode("utf-8", "surrogatepass")], WORD)[0]
        # a longer item is cut into parts that overlap by a window less one word
        longest = min(most, DISTINCT)
        step = longest - window + 1
        for a in range(0, max(len(h) - window + 1, 1), step):
            part = h[a : a + longest]
            if not len(part):
                continue
            new = set(part.tolist())
            if some and (size + len(part) > most or len(seen | new) > DISTINCT):
                yield Block(some, window)
                some, size, seen = [], 0, set()
            some.append((r["id"], part))
            size += len(part)
            seen |= new
    if some:
        yield Block(some, window)


def contamination(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with a struct column ``hit`` (with underscores added if ``docs`` has that name): n_words, n_hit, runs of hit words, items, and the longest match with its place in words."""
    if not 0 < window <= DEPTH:
        raise ValueError(f"a window has 1 to {DEPTH} words")
    spark, out, hit, new = scratch.spark, None, fresh(docs, "hit"), fresh(docs, "_new")
    for block in blocks(benchmark, window, block_words):
        seen = _scanner(spark, block)("text")
        if out is None:
            out = docs.withColumn(hit, seen)
            continue
        both = scratch.save(out, "pass").withColumn(new, seen)
        old, now = (lambda f: F.col(hit)[f]), (lambda f: F.col(new)[f])
        better = now("longest") > old("longest")
        out = both.withColumn(hit, F.struct(
            old("n_words").alias("n_words"), F.array_sort(F.concat(old("runs"), now("runs"))).alias("runs"),
            F.array_union(old("items"), now("items")).alias("items"), F.when(better, now("longest")).otherwise(old("longest")).alias("longest"),
            F.when(better, now("longest_at")).otherwise(old("longest_at")).alias("longest_at"))).drop(new)
    if out is None:
        out = docs.withColumn(hit, _scanner(spark, Block([], window))("text"))
    # runs of several passes may overlap: each counts from the furthest end before it
    covered = F.aggregate(
        F.array_sort(F.col(hit)["runs"]), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda acc, r: F.struct((acc["n"] + F.greatest(F.lit(0), r["b"] - F.greatest(r["a"], acc["end"]))).cast("long").alias("n"), F.greatest(acc["end"], r["b"]).alias("end")))
    return out.withColumn(hit, F.struct(f"{hit}.*", covered["n"].alias("n_hit")))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """The documents in which no window of a benchmark item occurs."""
    found = contamination(docs, benchmark, scratch, window)
    return found.where(F.col(found.columns[-1])["n_hit"] == 0).select(*docs.columns)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hit = contamination(docs, table(spark, sf_dir, "benchmark"), Scratch(spark, "decontaminate"))
    items = F.array_sort(F.array_distinct("hit.items"))
    return hit.select(
        "doc_id", "hit.n_words", "hit.n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("hit.n_hit") > 0).alias("contaminated"), F.col("hit.longest").alias("longest_words"), F.col("hit.longest_at").alias("longest_at"))
