"""Near-duplicate documents by SuperMinHash.

Signatures: each shingle draws a random permutation of the signature's slots and
a random offset, and offers ``offset + rank`` to the slot at each rank, so that
the values of one shingle are spread over all slots; that lowers the variance
against independent hashes.  Ranks are tried level by level, and a document
stops at the first level that leaves none of its slots without a smaller value.

Banding: documents that agree in all rows of a band are candidates.  A group of
candidates is not expanded into all its pairs.  A few pivots of each group, those
with most fellow candidates in all their groups, are compared with its members: a
family's least changed copies are among them, and join most of it to one component.
Then only the members outside a group's largest component are compared with the
rest of it: pairs within one component need no comparison, and no other pair is left
out.  Before its sets are read, such a pair has to pass an exact bound: each shingle
flips one of ``PARITY`` bits, so two sets differ in as many shingles at least as
their bits differ, and similar sets may differ in few.

Verification: pairs are confirmed on the full sets of 64-bit shingle hashes.
Grouping: union-find inside each partition of links, then star contraction
across partitions; nothing is collected.

Defined results: a null, empty or wordless text has no shingles and links with
nothing; one of fewer words than a shingle is one shingle.  Equal sets are one
class, whose members all stand for their smallest doc_id.  Rows with an equal
doc_id are one document each but share its component; null doc_ids link with
nothing and are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, narrow, table
from .graph import components, shared_ids
from .textbytes import SHARD_BYTES, U64, batches, draw, give_back, mix, word_table, words

SHINGLE = 5
BANDS, ROWS = 24, 6
SLOTS = BANDS * ROWS
PERCENT = 85
WORD = word_table([0x20, *range(0x09, 0x0E)])
#: Pivots of a group of candidates.
PIVOTS = 4
#: Bits of the parity sketch of a set.
PARITY = 1024


def shingles(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of the whole sequence if it is shorter."""
    n = min(size, len(hashes))
    if n == 0:
        return hashes
    out = np.full(len(hashes) - n + 1, U64(n))
    for k in range(n):
        out = mix(out * U64(0x9FB21C651E98DF25) + hashes[k : k + len(out)])
    return out


def sets(texts: list[str | None], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each text, without repeats."""
    for _, some in batches(texts):
        h, at = words(some, WORD)
        for a, b in zip(at[:-1], at[1:], strict=True):
            s = np.sort(shingles(h[a:b], size))
            yield s[np.append(True, s[1:] != s[:-1])] if len(s) else s


def signatures(groups: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signature of each set; infinite for an empty one."""
    sig = np.full((len(groups), slots), np.inf)
    flat = sig.reshape(-1)
    n = np.array([len(g) for g in groups], dtype=np.int64)
    x = np.concatenate(groups) if groups else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(groups)), n)
    # rank 0 takes no shuffling: the slot is the draw itself
    seed = draw(x, 0)
    np.minimum.at(flat, owner * slots + (mix(seed) % U64(slots)).astype(np.int64), (seed >> U64(11)) * 2.0**-53)
    live = np.ones(len(x), dtype=bool)
    perm = None
    for rank in range(1, slots):
        open_sets = ~np.isfinite(sig).all(axis=1) & (n > 0)
        live = open_sets[owner]
        if not live.any():
            break
        if perm is None:
            x, owner = x[live], owner[live]
            perm = np.tile(np.arange(slots, dtype=np.uint8), (len(x), 1))
            first = (mix(draw(x, 0)) % U64(slots)).astype(np.int64)
            row = np.arange(len(x))
            perm[row, first], perm[:, 0] = 0, first
        elif not live.all():
            x, owner, perm = x[live], owner[live], perm[live]
        row = np.arange(len(x))
        seed = draw(x, rank)
        pick = rank + (mix(seed) % U64(slots - rank)).astype(np.int64)
        slot = perm[row, pick]
        perm[row, pick] = perm[:, rank]
        perm[:, rank] = slot
        np.minimum.at(flat, owner * slots + slot, (seed >> U64(11)) * 2.0**-53 + rank)
    return sig


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One hash for each band of each signature."""
    raw = sig.view(np.uint64).reshape(len(sig), bands, -1)
    out = np.tile(np.arange(bands, dtype=np.uint64), (len(sig), 1))
    for k in range(raw.shape[2]):
        out = mix(out * U64(0x9FB21C651E98DF25) + raw[:, :, k])
    return out


def parity(s: np.ndarray) -> np.ndarray:
    """PARITY bits as 64-bit numbers: bit i tells whether an odd number of the set's hashes fall on it."""
    odd = (np.bincount((s % U64(PARITY)).astype(np.int64), minlength=PARITY) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _may_be_similar(n: Column, m: Column, a: str, b: str, percent: int) -> Column:
    """Sets of sizes n and m with the parities a and b may reach the similarity: their difference has at most (n + m) (100 - percent) / (100 + percent) shingles."""
    apart = sum((F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(PARITY // 64)), F.lit(0))
    return apart * (100 + percent) <= (n + m) * (100 - percent)


def _sketcher(size: int, bands: int, rows: int):
    @F.pandas_udf("n long, class binary, bands array<long>, parity array<long>")
    def sketch(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            n, name, keys, odd, todo, held = [], [], [], [], [], 0

            def flush() -> None:
                nonlocal todo, held
                if todo:
                    got = band_keys(signatures(todo, bands * rows), bands).view(np.int64)
                    keys.extend(got[i] if len(todo[i]) else None for i in range(len(todo)))
                todo, held = [], 0

            for s in sets(batch.tolist(), size):
                n.append(len(s))
                name.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                odd.append(parity(s) if len(s) else None)
                todo.append(s)
                held += len(s)
                if held > SHARD_BYTES // 16:
                    flush()
            flush()
            yield pd.DataFrame({"n": n, "class": name, "bands": keys, "parity": odd})
        give_back()

    return sketch


def _set_maker(size: int):
    @F.pandas_udf("binary")
    def make(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([s.tobytes() for s in sets(batch.tolist(), size)], dtype=object)
        give_back()

    return make


def _common():
    @F.pandas_udf("long")
    def common(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            at = np.searchsorted(y, x)
            out.append(int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0)
        return pd.Series(out)

    return common


def local_forest(edges: DataFrame) -> DataFrame:
    """Union-find over each partition's links: at most one link for each document in it."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = parent[p]
                x = parent[x]
            return x

        for part in parts:
            for a, b in zip(part["a"].tolist(), part["b"].tolist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        kids = [x for x in list(parent) if root(x) != x]
        yield pd.DataFrame({"a": kids, "b": [root(x) for x in kids]}, dtype="int64")

    return edges.mapInPandas(run, "a long, b long")


def linked(heads: DataFrame, texts: DataFrame, scratch: Scratch, percent: int = PERCENT, size: int = SHINGLE, known: DataFrame | None = None) -> DataFrame:
    """(id, component) of all documents with a confirmed link.

    ``heads``: (id, n, bands, parity) of one document of each class, ``texts``: (id, text) of all ids, ``known``: links (a, b) that need no check.
    """
    members = heads.select("id", "n", F.posexplode("bands").alias("band", "bucket"))
    several = members.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    groups = scratch.save(members.join(several, "bucket").withColumnRenamed("m", "fellows"), "groups")
    mine = groups.select("id").distinct()
    full = scratch.save(texts.join(narrow(mine, scratch), "id").select("id", _set_maker(size)("text").alias("s")), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(full.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(full.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
        both = (F.octet_length("sa") / 8 + F.octet_length("sb") / 8).cast("long")
        checked = pairs.select("a", "b", both.alias("both"), _common()("sa", "sb").alias("i"))
        return scratch.save(local_forest(checked.where(F.col("i") * 100 >= (F.col("both") - F.col("i")) * percent).select("a", "b")), "links")

    near = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    # first those with most fellows in each bucket's residue classes: a map-side combined maximum, no sort of a bucket
    weight = groups.groupBy("id").agg(F.sum("fellows").alias("weight"))
    lane = F.pmod(F.xxhash64("id"), F.lit(PIVOTS))
    pivots = groups.join(weight, "id").groupBy("bucket", lane.alias("lane")).agg(F.max(F.struct("weight", F.bitwise_not("id").alias("low"), "id", "n")).alias("p")).select("bucket", F.col("p.id").alias("p"), F.col("p.n").alias("m"))
    pairs = groups.join(pivots, "bucket").where("id != p").where(near)
    edges = confirmed(pairs.select(F.greatest("id", "p").alias("a"), F.least("id", "p").alias("b")).distinct())
    if known is not None:
        edges = edges.unionByName(known)
    comps = components(edges, scratch)

    # then whoever is outside the largest component of a bucket, against all of it
    rows = groups.join(comps.select("id", F.col("component").alias("c")), "id", "left").withColumn("c", F.coalesce("c", "id"))
    rows = scratch.save(rows, "labelled")
    count = rows.groupBy("bucket", "c").agg(F.count("*").alias("k"))
    top = count.groupBy("bucket").agg(F.max(F.struct("k", (-F.col("c")).alias("neg"))).alias("t"), F.count("*").alias("parts")).where("parts > 1")
    rows = rows.join(top.select("bucket", (-F.col("t.neg")).alias("main")), "bucket").join(heads.select("id", "bands", "parity"), "id")
    rows = scratch.save(rows, "open")
    apart = rows.where("c != main").select("bucket", F.col("id").alias("p"), F.col("n").alias("m"), F.col("c").alias("pc"), F.col("bands").alias("pbands"), F.col("parity").alias("pparity"))
    # a pair counts in the first band that it shares; of two outsiders the larger id asks
    before = F.arrays_overlap(F.slice("bands", F.lit(1), F.col("band")), F.slice("pbands", F.lit(1), F.col("band")))
    pairs = rows.join(apart, "bucket").where("c != pc and (c = main or id < p)").where(near & _may_be_similar(F.col("n"), F.col("m"), "parity", "pparity", percent) & ~before)
    more = confirmed(pairs.select(F.greatest("id", "p").alias("a"), F.least("id", "p").alias("b")))
    return comps if more.isEmpty() else components(edges.unionByName(more), scratch)


def near_duplicates(docs: DataFrame, scratch: Scratch, percent: int = PERCENT, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    got = docs.select("doc_id", _sketcher(size, bands, rows)("text").alias("k")).select("doc_id", F.col("k.n").alias("n"), F.col("k.class").alias("class"), F.col("k.bands").alias("bands"), F.col("k.parity").alias("parity"))
    got = scratch.save(got, "sketches")
    real = got.where("class is not null and doc_id is not null")
    # classes of equal sets: one representative each, counted before the shuffle
    classes = scratch.save(real.groupBy("class").agg(F.min("doc_id").alias("id")), "classes")
    heads = real.join(classes, "class").where("doc_id = id").dropDuplicates(["class"]).select("id", "n", "bands", "parity")
    heads = scratch.save(heads, "heads")
    # a doc_id with several texts joins their classes
    known = scratch.save(shared_ids(real, "doc_id", "class", classes), "known")
    texts = docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), "text")
    comps = linked(heads, texts, scratch, percent, size, known)
    head = classes.join(comps, "id", "left").select("class", F.coalesce("component", "id").alias("component_id"))
    out = got.join(head, "class", "left")
    whole = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), whole.alias("component_id"), F.coalesce(F.col("doc_id") == whole, F.lit(True)).alias("kept"))


def op10_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "minhash"))
