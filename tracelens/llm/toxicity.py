"""Toxicity scores from a convolutional text classifier.

A word is the sum of two rows of an embedding table, that of its hash and that of
its first letters' hash; filters of several widths run
over the word sequence, each filter's maximum over the whole text feeds a
logistic output.  It is trained on the whole text of every labelled row: in each of
``EPOCHS`` rounds Spark deals the rows out anew, every shard goes on from the common
model with Adam as its rows stream by, and the shards' weights are averaged, an
embedding row over the shards that moved it.  For scoring, the products of
embeddings and filter weights are tabulated for each hashed word, so a text costs a
few table rows a word, whatever its length.

Scores are probabilities.  On a sixth of the training rows, which the fit does not
see, one decision threshold is calibrated for each language, from the counts of all
of them by steps of the score; the language is an input of that decision and never
of the score.

Defined results: null, empty and wordless texts get the score of the bias alone;
equal texts get equal scores; without labelled rows, or with one class only, the
score is the smoothed base rate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, narrow, table
from .language import bucket
from .textbytes import SHARD_BYTES, batches, give_back, word_table, words

BUCKETS = 1 << 15
#: Bytes of a word's beginning that are hashed as well.
PREFIX = 5
DIM = 12
FILTERS = 12
WIDTHS = (1, 2, 3)
#: Labelled rows a shard, and shards at most: those of a larger table have more rows each, which stream by.
SHARD_ROWS, MOST_SHARDS = 4_096, 256
#: Texts and about bytes of one step of a fit, and words at once of a text; a longer text is a step of its own.
STEP_TEXTS, STEP_BYTES, STEP_WORDS = 64, 1 << 19, 1 << 16
RATE = 0.01
EPOCHS = 5
CUT = 0.3
#: Embedding rows that are averaged as one row of a table.
BLOCK = 512
#: Steps of the score that a threshold is one of.
GRID = 10_000
WORD = word_table([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def _ids(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashed ids of the words and of their first letters, texts in a row, and where each text begins; ids of 0 stand after each text, so that no window that looks back reaches into the text before."""
    hashes, offsets = words(texts, WORD, prefix=PREFIX)
    pad = max(WIDTHS) - 1
    ids = np.zeros((2, hashes.shape[1] + len(texts) * pad), dtype=np.int32)
    n = np.diff(offsets)
    starts = offsets[:-1] + np.arange(len(texts)) * pad
    where = np.arange(hashes.shape[1]) + np.repeat(np.arange(len(texts)) * pad, n)
    ids[:, where] = (hashes % np.uint64(BUCKETS - 1)).astype(np.int32) + 1
    return ids, starts


class Classifier:
    def __init__(self, seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        self.emb = r.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.emb[0] = 0
        self.conv = [r.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros((len(WIDTHS), FILTERS), dtype=np.float32)
        self.out = r.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.base = 0.0
        self.tables: list[np.ndarray] = []

    def freeze(self) -> "Classifier":
        """Tabulate embedding times filter for each hashed word, width and offset."""
        self.tables = [np.stack([self.emb @ w[k] for k in range(len(w))]) for w in self.conv]
        return self

    def features(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Maxima of all filters over each text; every text has at least the padding."""
        cols = []
        for i, w in enumerate(WIDTHS):
            t = self.tables[i]
            act = t[0][ids[0]] + t[0][ids[1]]
            for k in range(1, w):
                act[k:] += t[k][ids[0, :-k]] + t[k][ids[1, :-k]]
            cols.append(np.maximum(np.maximum.reduceat(act, starts, axis=0) + self.bias[i], 0))
        return np.concatenate(cols, axis=1)

    def score(self, texts: list) -> np.ndarray:
        out = np.empty(len(texts))
        for first, some in batches(texts, SHARD_BYTES // 2):
            ids, starts = _ids(some)
            # summed row by row: a product of matrices may round a text by its place in the batch
            z = (self.features(ids, starts).astype(np.float64) * self.out).sum(axis=1) + self.base
            out[first : first + len(some)] = 1 / (1 + np.exp(-z))
        return out

    def start(self, n: int, toxic: int) -> "Classifier":
        """The smoothed base rate of ``n`` rows; all that there is if one class is missing."""
        p = (toxic + 0.5) / (n + 1)
        self.base = float(np.log(p / (1 - p)))
        if not 0 < toxic < n:
            self.out[:] = 0
        return self

    def dense(self) -> np.ndarray:
        """All weights but the embeddings as one vector."""
        return np.concatenate([*[w.ravel() for w in self.conv], self.bias.ravel(), self.out, [self.base]]).astype(np.float64)

    def set_dense(self, values: np.ndarray) -> None:
        at = 0
        for array in (*self.conv, self.bias, self.out):
            array[...] = values[at : at + array.size].reshape(array.shape)
            at += array.size
        self.base = float(values[at])

    def peaks(self, ids: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The largest value of each filter in each text and the word where it stands, by width; ``STEP_WORDS`` words at once."""
        top = [np.full((len(n), FILTERS), -np.inf, dtype=np.float32) for _ in WIDTHS]
        where = [np.zeros((len(n), FILTERS), dtype=np.int64) for _ in WIDTHS]
        for a in range(0, ids.shape[1], STEP_WORDS):
            b, low = min(a + STEP_WORDS, ids.shape[1]), max(0, a - max(WIDTHS) + 1)
            x = self.emb[ids[0, low:b]] + self.emb[ids[1, low:b]]
            inside = np.flatnonzero((starts < b) & (starts + n > a))
            for i, w in enumerate(WIDTHS):
                act = x @ self.conv[i][0]
                for k in range(1, w):
                    act[k:] += x[:-k] @ self.conv[i][k]
                for j in inside:
                    s, e = max(starts[j], a), min(starts[j] + n[j], b)
                    part = act[s - low : e - low]
                    arg = part.argmax(axis=0)
                    value = part[arg, np.arange(FILTERS)]
                    more = value > top[i][j]
                    top[i][j, more], where[i][j, more] = value[more], s + arg[more]
        return top, where


class Fit:
    """Adam on the log loss of one shard; gradients reach only the word windows that hold a maximum."""

    def __init__(self, model: Classifier, seed: int) -> None:
        self.model, self.r = model, np.random.default_rng(seed)
        names = ["out", "bias", "base", *range(len(WIDTHS))]
        self.m = {k: 0.0 for k in names} | {"emb": np.zeros_like(model.emb)}
        self.v = {k: 0.0 for k in names} | {"emb": np.zeros_like(model.emb)}
        self.moves = np.zeros(BUCKETS, dtype=np.float32)
        self.steps = 0

    def step(self, texts: list[bytes], y: np.ndarray) -> None:
        model = self.model
        ids, starts = _ids(texts)
        n = np.diff(np.append(starts, ids.shape[1]))
        top, where = model.peaks(ids, starts, n)
        f = np.concatenate([t + model.bias[i] for i, t in enumerate(top)], axis=1)
        h = np.maximum(f, 0)
        keep = self.r.random(h.shape[1]) > 0.2
        z = (h * keep) @ model.out / 0.8 + model.base
        d = ((1 / (1 + np.exp(-z)) - y) / len(y)).astype(np.float32)
        g = {"out": (h * keep / 0.8).T @ d + 1e-5 * model.out, "base": d.sum()}
        back = (d[:, None] * model.out[None, :] * keep / 0.8 * (f > 0)).astype(np.float32)
        gb, places, pulls = np.zeros_like(model.bias), [], []
        for i, w in enumerate(WIDTHS):
            b = back[:, i * FILTERS : (i + 1) * FILTERS]
            gb[i] = b.sum(axis=0)
            gw = np.zeros_like(model.conv[i])
            for k in range(w):
                at = np.maximum(where[i] - k, 0)
                here = b * (where[i] >= k)
                gw[k] = np.einsum("nf,nfd->df", here, model.emb[ids[0, at]] + model.emb[ids[1, at]])
                places.append(at.ravel())
                pulls.append((here[:, :, None] * model.conv[i][k].T[None]).reshape(-1, DIM))
            g[i] = gw
        g["bias"] = gb
        self.steps += 1
        fix = RATE * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        for k, of in g.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * of
            self.v[k] = 0.999 * self.v[k] + 0.001 * of**2
            move = fix * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)
            if isinstance(k, int):
                model.conv[k] -= move
            else:
                setattr(model, k, float(model.base - move) if k == "base" else getattr(model, k) - move.astype(np.float32))
        place, pull = np.concatenate(places), np.concatenate(pulls)
        hot = pull.any(axis=1)
        rows, inv = np.unique(ids[:, place[hot]], return_inverse=True)
        gr = np.zeros((len(rows), DIM), dtype=np.float32)
        for one in inv.reshape(2, -1):
            np.add.at(gr, one, pull[hot])
        m, v = self.m["emb"], self.v["emb"]
        m[rows] = 0.9 * m[rows] + 0.1 * gr
        v[rows] = 0.999 * v[rows] + 0.001 * gr**2
        model.emb[rows] -= fix * m[rows] / (np.sqrt(v[rows]) + 1e-8)
        model.emb[0] = 0
        self.moves[rows] += 1

    def blocks(self, shard: int) -> pd.DataFrame:
        """The shard's weights and how often each was moved: the moved rows of ``emb`` by block, and all other weights as one row of block -1."""
        out = [(-1, shard, np.zeros(1, dtype=np.int32).tobytes(), np.full(1, self.steps, dtype=np.float32).tobytes(), self.model.dense().astype(np.float32).tobytes())] if self.steps else []
        for at in range(0, BUCKETS, BLOCK):
            rows = (at + np.flatnonzero(self.moves[at : at + BLOCK])).astype(np.int32)
            if len(rows):
                out.append((at // BLOCK, shard, rows.tobytes(), self.moves[rows].tobytes(), self.model.emb[rows].tobytes()))
        return pd.DataFrame(out, columns=["block", "shard", "rows", "moves", "weights"])


def _mean(parts: pd.DataFrame) -> pd.DataFrame:
    """The mean of each row of a block, by how often each shard moved it."""
    first = max(0, int(parts["block"].iloc[0])) * BLOCK
    total, weight = 0.0, np.zeros(BLOCK)
    for rows, moves, weights in parts.sort_values("shard")[["rows", "moves", "weights"]].itertuples(index=False):
        at, m = np.frombuffer(rows, dtype=np.int32) - first, np.frombuffer(moves, dtype=np.float32).astype(np.float64)
        w = np.frombuffer(weights, dtype=np.float32).reshape(len(m), -1)
        total = np.zeros((BLOCK, w.shape[1])) if isinstance(total, float) else total
        total[at] += m[:, None] * w
        weight[at] += m
    some = np.flatnonzero(weight)
    mean = (total[some] / weight[some, None]).astype(np.float32)
    return pd.DataFrame({"block": parts["block"].iloc[:1], "rows": [(first + some).astype(np.int32).tobytes()], "weights": [mean.tobytes()]})


def _round(rows: DataFrame, model: Classifier, n: int, epoch: int, scratch: Scratch) -> None:
    """One pass over all rows (h, text, toxic) by shards; ``model`` becomes the mean of theirs."""
    shared = rows.sparkSession.sparkContext.broadcast((model.emb, model.dense()))

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        own, shard = Classifier(), TaskContext.get().partitionId()
        own.emb = shared.value[0].copy()
        own.set_dense(shared.value[1])
        fit = Fit(own, 1000 * epoch + shard)
        texts, y, size = [], [], 0
        for frame in frames:
            for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                if texts and (len(texts) == STEP_TEXTS or size + len(raw) > STEP_BYTES):
                    fit.step(texts, np.array(y, dtype=np.float32))
                    texts, y, size = [], [], 0
                texts.append(raw)
                y.append(toxic)
                size += len(raw)
        if texts:
            fit.step(texts, np.array(y, dtype=np.float32))
        yield fit.blocks(shard)
        give_back()

    deal = F.xxhash64("h", F.lit(epoch))
    dealt = rows.select(deal.alias("o"), "text", "toxic").repartition(min(MOST_SHARDS, -(-n // SHARD_ROWS)), "o").sortWithinPartitions("o", "text", "toxic")
    means = dealt.mapInPandas(learn, "block int, shard int, rows binary, moves binary, weights binary").groupBy("block").applyInPandas(_mean, "block int, rows binary, weights binary")
    means = scratch.save(means, "round")
    emb = model.emb.copy()
    for block, at, weights in means.collect():
        values = np.frombuffer(weights, dtype=np.float32)
        if block < 0:
            model.set_dense(values)
        else:
            emb[np.frombuffer(at, dtype=np.int32)] = values.reshape(-1, DIM)
    scratch.drop(means)
    model.emb = emb
    shared.destroy()


#: Held-out toxic rows at which a threshold counts as much as the one that it is drawn towards.
PULL = 20


def best_cut(bins: pd.DataFrame, fallback: float = CUT) -> float:
    """The threshold of the best F1 from counts (bin, n, hit) of the score's steps, drawn towards the fallback where few toxic rows speak for it; the fallback if one class is missing."""
    toxic, all_ = bins["hit"].sum(), bins["n"].sum()
    if not 0 < toxic < all_:
        return fallback
    down = bins.sort_values("bin", ascending=False)
    f1 = 2 * np.cumsum(down["hit"].to_numpy()) / (np.cumsum(down["n"].to_numpy()) + toxic)
    best, at = int(np.argmax(f1)), down["bin"].to_numpy()
    below = at[best + 1] + 1 if best + 1 < len(at) else 0
    trust = float(toxic / (toxic + PULL))
    return trust * float(at[best] + below) / 2 / GRID + (1 - trust) * fallback


def train(docs: DataFrame, labels: DataFrame, rows: Column) -> tuple[Classifier, DataFrame, float]:
    """The classifier of all labelled rows, the threshold of each language as (lang, lang_cut), and the one for other languages.

    A doc_id with several labels counts as toxic if one of them says so; a null text is an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    marked = narrow(marked.where(rows), scratch)
    text = F.coalesce("text", F.lit(""))
    some = docs.select("doc_id", text.alias("text"), "lang").join(marked, "doc_id")
    some = scratch.save(some.select(F.xxhash64("doc_id", "text").alias("h"), "text", "toxic", "lang"), "labelled")
    held = F.pmod(F.xxhash64("h", F.lit(-1)), F.lit(6)) == 5
    own = some.where(~held)
    n, toxic = own.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    model = Classifier().start(n, toxic)
    if 0 < toxic < n:
        for epoch in range(EPOCHS):
            _round(own, model, n, epoch, scratch)
    score = F.floor(scorer(spark, model.freeze())("text") * GRID).cast("long")
    bins = scratch.save(some.where(held).select("lang", "toxic", score.alias("bin")).groupBy("lang", "bin").agg(F.count("*").alias("n"), F.sum("toxic").alias("hit")), "bins")
    general = best_cut(bins.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit")).toPandas())

    def cut_of(one: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": one["lang"].iloc[:1], "lang_cut": best_cut(one, general)})

    cuts = bins.where("lang is not null").groupBy("lang").applyInPandas(cut_of, "lang string, lang_cut double")
    return model, narrow(cuts, scratch), general


def scorer(spark: SparkSession, model: Classifier):
    model.emb = np.zeros((0, DIM), dtype=np.float32)  # the tables hold all that scoring needs
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(shared.value.score(batch.tolist()))

    return score


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model, cuts, general = train(docs, labels, bucket(F.col("doc_id"), 4) != 2)
    score = scorer(spark, model)
    held = bucket(F.col("doc_id"), 4) == 2
    out = docs.select("doc_id", "lang", held.alias("held_out"), score("text").alias("score")).join(cuts, "lang", "left").withColumn("lang_cut", F.coalesce("lang_cut", F.lit(general)))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"), (F.col("score") >= F.col("lang_cut")).alias("flagged_in_lang"))
