"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

Iterative quantisation learns rotations of the centred vectors for which their
signs are balanced bits with a small quantisation error, on a bounded sample
(``SAMPLE`` vectors of the smallest hashes).  All vectors are coded.  The code is
cut into substrings, each the key of one table, as many and as long as the number of
vectors and the wanted recall at the threshold ask for.  Vectors with one key are
compared with their original values in double precision; a pair counts in the
first of the tables that brings it together, so nothing has to be deduplicated.

A bucket of more than ``BLOCK_ROWS`` vectors is compared block against block, each
pair of blocks a group of its own.  Pairs are never written: a group gives one row
a vector, with its number of links and the smallest vector linked to it there.

Defined results: vectors that are null, empty or zero, or hold a null or a value
that is not finite, link with nothing.  Equal vectors are one class and count for
each other.  Vectors of different lengths link with nothing of each other.  Rows
of one vec_id share a component; of other columns only vec_id and embedding are read, so none clashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, narrow, table
from .graph import components, shared_ids

THRESHOLD = 0.95
#: Wanted share of the links of exactly the threshold; closer ones are found more surely.
RECALL = 0.98
SAMPLE = 20_000
MAX_BITS = 64
BLOCK_ROWS = 512
ROUNDS = 25


def clean(values) -> np.ndarray | None:
    """A vector as doubles, scaled so that no square overflows; None if it links with nothing."""
    if values is None or len(values) == 0:
        return None
    try:
        v = np.asarray(values, dtype=np.float64)
    except (TypeError, ValueError):
        return None
    if not np.isfinite(v).all():
        return None
    top = np.abs(v).max()
    return v / top if top > 0 else None


class Quantiser:
    """Mean, principal axes and one learnt rotation for each run of bits."""

    def __init__(self, sample: np.ndarray, n_keys: int, key_bits: int, rounds: int = ROUNDS, seed: int = 3) -> None:
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.mean = unit.mean(axis=0)
        centred = unit - self.mean
        bits = min(MAX_BITS, sample.shape[1])
        _, axes = np.linalg.eigh(centred.T @ centred)
        axes = axes[:, ::-1][:, :bits]
        low = centred @ axes
        r = np.random.default_rng(seed)
        runs = []
        for _ in range(math.ceil(n_keys * key_bits / bits)):
            turn = np.linalg.qr(r.normal(size=(bits, bits)))[0]
            for _ in range(rounds):
                u, _, vt = np.linalg.svd(np.where(low @ turn >= 0, 1.0, -1.0).T @ low)
                turn = (u @ vt).T
            runs.append(axes @ turn)
        self.axes = np.concatenate(runs, axis=1)[:, : n_keys * key_bits]
        self.n_keys, self.key_bits = n_keys, key_bits

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        bit = ((unit - self.mean) @ self.axes >= 0).reshape(len(vectors), self.n_keys, self.key_bits)
        return bit @ (1 << np.arange(self.key_bits, dtype=np.int64))


def plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a key, about the logarithm of the number of vectors, and the number of keys that recall then needs."""
    bits = int(min(30, max(8, round(math.log2(max(n, 2))))))
    same = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def _bodies(batch: pd.Series) -> Iterator[np.ndarray | None]:
    return (clean(v) for v in batch)


def _prepare():
    @F.pandas_udf("dim int, body binary, class binary")
    def prepare(vectors: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in vectors:
            rows = []
            for raw, v in zip(batch, _bodies(batch), strict=True):
                # single values stay exact in single precision; the class is of the values as they came
                body = None if v is None else np.asarray(raw).astype(np.float64)
                body = None if body is None else (body.astype(np.float32) if np.array_equal(body.astype(np.float32).astype(np.float64), body) else body)
                rows.append((None, None, None) if body is None else (len(body), body.dtype.char.encode() + body.tobytes(), blake2b(body.tobytes(), digest_size=16).digest()))
            yield pd.DataFrame(rows, columns=["dim", "body", "class"])

    return prepare


def _load(body: bytes) -> np.ndarray:
    v = np.frombuffer(body, dtype=np.float32 if body[:1] == b"f" else np.float64, offset=1).astype(np.float64)
    return v / np.abs(v).max()


def _coder(spark: SparkSession, models: dict[int, Quantiser]):
    shared = spark.sparkContext.broadcast(models)

    @F.pandas_udf("array<long>")
    def code(dims: pd.Series, bodies: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(dims), index=dims.index, dtype=object)
        for dim, rows in bodies.groupby(dims):
            keys = shared.value[int(dim)].keys(np.stack([_load(b) for b in rows]))
            for i, k in zip(rows.index, keys, strict=True):
                out[i] = k
        return out

    return code


def _matrix(bodies: list[bytes]) -> np.ndarray:
    """Unit vectors of equal length, from bodies that may hold single or double values."""
    if len({(b[:1], len(b)) for b in bodies}) == 1:
        kind = np.float32 if bodies[0][:1] == b"f" else np.float64
        raw = np.frombuffer(b"".join(bodies), dtype=np.uint8).reshape(len(bodies), -1)[:, 1:]
        v = np.ascontiguousarray(raw).view(kind).astype(np.float64)
        v /= np.abs(v).max(axis=1, keepdims=True)
    else:
        v = np.stack([_load(b) for b in bodies])
    return v / np.linalg.norm(v, axis=1, keepdims=True)


#: Groups of up to so many vectors are compared all at once, by their distance in the sorted rows; larger ones by a matrix product each.
SMALL = 48


def _near_pairs(v: np.ndarray, starts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j, of all pairs within a group with at least the threshold's cosine; groups begin at ``starts``."""
    size = np.diff(np.append(starts, len(v)))
    end = np.repeat(starts + size, size)
    small = np.repeat(size <= SMALL, size)
    found_i, found_j = [], []
    for k in range(1, int(size[size <= SMALL].max(initial=1))):
        i = np.flatnonzero(small[: len(v) - k] & (np.arange(k, len(v)) < end[: len(v) - k]))
        i = i[np.einsum("ij,ij->i", v[i], v[i + k]) >= threshold]
        found_i.append(i)
        found_j.append(i + k)
    for a in np.flatnonzero(size > SMALL):
        part = v[starts[a] : starts[a] + size[a]]
        i, j = np.nonzero(np.triu(part @ part.T >= threshold, 1))
        found_i.append(i + starts[a])
        found_j.append(j + starts[a])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *found_i]), np.concatenate([none, *found_j])


def _compare(threshold: float):
    """One row for each vector with links in a group: (id, links, root).  Rows come sorted by group; whole groups are compared together."""

    def groups(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame | None:
        lengths = rows["body"].map(len).to_numpy()
        if len(set(lengths.tolist())) > 1:  # vectors of several lengths: those of one group have one, or the other kind of its values
            parts = [groups(rows.iloc[a:b], np.zeros(1, dtype=np.int64)) for a, b in zip(starts, np.append(starts[1:], len(rows)), strict=True)] if len(starts) > 1 else []
            parts = [p for p in parts if p is not None]
            if len(starts) > 1:
                return pd.concat(parts, ignore_index=True) if parts else None
        v = _matrix(rows["body"].tolist())
        i, j = _near_pairs(v, starts, threshold)
        if not len(i):
            return None
        t, blk, bi, bj = (rows[c].to_numpy() for c in ("t", "blk", "bi", "bj"))
        keep = (bi[i] == bj[i]) | (blk[i] != blk[j])  # of two blocks only the pairs across
        i, j = i[keep], j[keep]
        if len(i):
            # a pair counts in the first table that brings it together
            keys = np.stack(rows["keys"].to_list())
            fresh = np.ones(len(i), dtype=bool)
            for a in range(0, len(i), 65_536):
                x, y = i[a : a + 65_536], j[a : a + 65_536]
                before = np.arange(keys.shape[1])[None, :] < t[x][:, None]
                fresh[a : a + 65_536] = ~((keys[x] == keys[y]) & before).any(axis=1)
            i, j = i[fresh], j[fresh]
        if not len(i):
            return None
        weight, ids = rows["w"].to_numpy(), rows["id"].to_numpy()
        links = (np.bincount(i, weights=weight[j], minlength=len(rows)) + np.bincount(j, weights=weight[i], minlength=len(rows))).astype(np.int64)
        root = ids.copy()  # the smallest id among linked vectors, passed on until nothing changes
        while True:
            new = root.copy()
            np.minimum.at(new, i, root[j])
            np.minimum.at(new, j, root[i])
            if (new == root).all():
                break
            root = new
        some = np.flatnonzero(links)
        return pd.DataFrame({"id": ids[some], "links": links[some], "root": root[some]})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["t", "key", "bi", "bj"]
        carry = None
        for part in parts:
            part = part if carry is None else pd.concat([carry, part], ignore_index=True)
            if not len(part):
                continue
            k = part[names].to_numpy()
            starts = np.append(0, np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1)
            if len(starts) > 1 and (got := groups(part.iloc[: starts[-1]], starts[:-1])) is not None:
                yield got
            carry = part.iloc[starts[-1] :]
        if carry is not None and len(carry) and (got := groups(carry, np.zeros(1, dtype=np.int64))) is not None:
            yield got

    return run


def near_duplicates(vectors: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, recall: float = RECALL, sample: int = SAMPLE, block: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding)."""
    spark = scratch.spark
    got = vectors.select("vec_id", _prepare()("embedding").alias("p")).select("vec_id", "p.dim", "p.body", "p.class")
    got = scratch.save(got, "vectors")
    classes = got.where("class is not null and vec_id is not null").groupBy("class", "dim").agg(F.min("vec_id").alias("id"), F.count("*").alias("w"), F.min("body").alias("body"))
    classes = scratch.save(classes, "classes")

    models: dict[int, Quantiser] = {}
    for row in classes.groupBy("dim").count().collect():  # one row for each length of a vector
        dim, n = row["dim"], row["count"]
        bits, keys = plan(n, threshold, recall)
        picked = classes.where(F.col("dim") == dim).select("body", F.xxhash64("class").alias("h")).orderBy("h").limit(min(sample, max(256, 10_000_000 // dim))).collect()
        models[dim] = Quantiser(np.stack([_load(r["body"]) for r in picked]), keys, bits)

    coded = scratch.save(classes.withColumn("keys", _coder(spark, models)("dim", "body")), "codes")
    rows = coded.select("id", "w", "dim", "body", "keys", F.posexplode("keys").alias("t", "k"))
    rows = rows.withColumn("key", F.xxhash64("dim", "k"))
    large = rows.groupBy("t", "key").agg(F.count("*").alias("m")).where(F.col("m") > block)
    large = narrow(large.select("t", "key", F.ceil(F.col("m") / block).cast("int").alias("parts")), scratch)
    rows = rows.join(large, ["t", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("t", "key", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"), "blk", "id", "w", "body", "keys")
    rows = rows.repartition("t", "key", "bi", "bj").sortWithinPartitions("t", "key", "bi", "bj")
    found = scratch.save(rows.mapInPandas(_compare(threshold), "id long, links long, root long"), "links")

    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    # rows of one id stand for one vector of the graph, so a vec_id with several embeddings joins their classes
    known = shared_ids(got.where("class is not null and vec_id is not null"), "vec_id", "class", classes)
    comps = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(known), scratch)
    heads = classes.select("class", "w", "id").join(links, "id", "left").join(comps, "id", "left")
    heads = heads.select("class", "w", "links", F.coalesce("component", "id").alias("c"))
    out = got.select("vec_id", "class").join(heads, "class", "left")
    whole = F.coalesce("c", "vec_id")
    count = F.coalesce(F.col("links"), F.lit(0)) + F.coalesce(F.col("w") - 1, F.lit(0))
    return out.select("vec_id", F.when(F.col("vec_id").isNull(), F.lit(0)).otherwise(count).cast("long").alias("n_links"), whole.alias("component_id"), F.coalesce(F.col("vec_id") == whole, F.lit(True)).alias("kept"))


def op2_itq_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), Scratch(spark, "itq"))
