"""Language identification by cross-parsing entropy.

One suffix automaton is built over labelled text of each language.  A text is
parsed greedily into the longest pieces that occur in a language's training
text; a language that knows the text needs few pieces.  Pieces times the
logarithm of the training length, over the number of characters, is the
Ziv-Merhav estimate of the cross entropy, and the language with the least wins.

The automata are turned into one table of transitions in which a failing step
starts the next piece, so that thousands of texts are parsed in lock step by
array operations.  Texts are parsed in blocks of ``BLOCK`` characters (a piece
never spans two blocks); every block of a text counts.

Training text is a bounded sample (``SLOTS`` documents a language and ``TRAIN_SLOTS`` in all,
``TRAIN_CHARS`` characters, fewer where there are many languages): each slot keeps the document with the smallest hash
in it, whatever the number of rows.  Of more than ``MAX_LANGS`` labels, as of a dirty column, those of most rows are
learnt, the first in alphabetical order at ties; so what comes to the driver and is broadcast has a fixed bound.

Defined results: null texts and texts without a letter are ``und`` with score 0;
ties go to the first language in alphabetical order; without any labelled row
all texts are ``und``; repeated rows are predicted alike; a text of any length is parsed
whole; prediction is a column function, so no column of the table clashes with it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .textbytes import give_back

SLOTS = 192
TRAIN_CHARS = 14_000
#: Characters of all languages together: many labels have shorter samples each, so that the broadcast model is bounded and no label goes.
TRAIN_TOTAL = 400_000
#: Documents of all languages together, and languages, that a model is made of.
TRAIN_SLOTS, MAX_LANGS = 40_000, 2_000
LONG_ROW = 20_000
BLOCK = 256
SYMBOLS = 64
SPACE = 0
#: Codes of letters that are not among the frequent ones, by the remainder of their code point.
SHARED = 14


def _letter_table(texts: list[str]) -> np.ndarray:
    """Code of each character of the BMP: space for all that is no letter, an own code for each frequent letter, a shared one for the rest."""
    points = np.arange(0x10000)
    codes = np.where([chr(c).isalpha() for c in points], 1 + points % SHARED, SPACE).astype(np.uint8)
    joined = np.concatenate([_points(t) for t in texts]) if texts else np.zeros(0, dtype=np.uint32)
    count = np.bincount(joined[joined < 0x10000], minlength=0x10000)
    count[codes == SPACE] = 0
    top = sorted(np.flatnonzero(count), key=lambda c: (-count[c], c))[: SYMBOLS - 1 - SHARED]
    for i, c in enumerate(top):
        codes[c] = i + 1 + SHARED
    return codes


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _codes(text: str, table: np.ndarray) -> np.ndarray:
    """Letter codes with every run of other characters as one space."""
    points = _points(text)
    high = points > 0xFFFF
    out = table[np.where(high, 0, points)]
    if high.any():
        # beyond the table: letters by their category too, so that signs such as emoji are none
        for p in np.unique(points[high]):
            out[points == p] = 1 + p % SHARED if chr(p).isalpha() else SPACE
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != SPACE) | (out[:-1] != SPACE)
    return out[keep]


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts exactly the substrings of ``codes``; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


class Model:
    """``step``: for each state and symbol twice the next state, plus one if a new piece starts there."""

    def __init__(self, samples: dict[str, list[str]], chars: int = TRAIN_CHARS) -> None:
        self.langs = sorted(samples)
        self.table = _letter_table([t for lang in self.langs for t in samples[lang]])
        parts, self.start, weight, base = [], [], [], 0
        for lang in self.langs:
            codes = np.concatenate([np.append(_codes(t, self.table), np.uint8(SPACE)) for t in samples[lang]])[:chars]
            states = suffix_automaton(codes.tolist())
            root = np.full(SYMBOLS, base * 2 + 1, dtype=np.int32)
            for c, q in states[0].items():
                root[c] = (base + q) * 2 + 1
            block = np.tile(root, (len(states), 1))
            for s, row in enumerate(states):
                for c, q in row.items():
                    block[s, c] = (base + q) * 2
            block[0] = root
            parts.append(block)
            self.start.append(base)
            weight.append(math.log2(max(len(codes), 2)))
            base += len(states)
        self.step = np.concatenate(parts).ravel() if parts else np.zeros(0, dtype=np.int32)
        self.weight = np.array(weight)

    def pieces(self, texts: list[np.ndarray]) -> np.ndarray:
        """Number of pieces of each text in each language."""
        out = np.zeros((len(texts), len(self.langs)))
        owner, blocks = [], []
        for i, t in enumerate(texts):
            for a in range(0, len(t), BLOCK):
                owner.append(i)
                blocks.append(t[a : a + BLOCK])
        if not blocks:
            return out
        size = np.array([len(b) for b in blocks])
        order = np.argsort(-size, kind="stable")
        for at in range(0, len(order), 8192):
            some = order[at : at + 8192]
            n = size[some]
            grid = np.zeros((int(n[0]), len(some)), dtype=np.uint8)
            for j, b in enumerate(some):
                grid[: n[j], j] = blocks[b]
            live = np.searchsorted(-n, -np.arange(1, int(n[0]) + 1), side="right")
            count = np.zeros((len(self.langs), len(some)), dtype=np.int32)
            for k, base in enumerate(self.start):
                state = np.full(len(some), base, dtype=np.int32)
                mine = count[k]
                for t in range(int(n[0])):
                    m = live[t]
                    nxt = self.step[state[:m] * SYMBOLS + grid[t, :m]]
                    mine[:m] += nxt & 1
                    state[:m] = nxt >> 1
            np.add.at(out, np.array(owner)[some], count.T)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        which, codes = [], []
        for i, t in enumerate(texts):
            if isinstance(t, str) and self.langs:
                c = _codes(t, self.table)
                if (c != SPACE).any():
                    which.append(i)
                    codes.append(c)
        if which:
            n = np.array([len(c) for c in codes])
            entropy = self.pieces(codes) * self.weight / n[:, None]
            best = np.argmin(entropy, axis=1)
            ordered = np.sort(entropy, axis=1)
            margin = (ordered[:, 1] - ordered[:, 0]) / np.maximum(ordered[:, 1], 1e-12) if len(self.langs) > 1 else np.ones(len(which))
            for i, b, s in zip(which, best, margin, strict=True):
                langs[i], scores[i] = self.langs[b], float(min(1.0, max(0.0, s)))
        return langs, scores


def bucket(doc_id: Column, n: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def fit(docs: DataFrame, train: Column) -> Model:
    """A model from the rows where ``train`` holds and text and lang are set.

    Two passes: the smallest hash of each language and slot (longs only, summed before the shuffle), then those rows.
    """
    rows = docs.where(train & F.col("text").isNotNull() & F.col("lang").isNotNull()).where(F.col("text").rlike(r"\p{L}"))
    # Short rows come first: their hash is made smaller than that of any longer row.
    h = F.shiftrightunsigned(F.xxhash64("doc_id", F.length("text")), 2)
    h = h + F.when(F.length("text") > LONG_ROW, F.lit(1 << 62)).otherwise(F.lit(0))
    labels = rows.groupBy("lang").agg(F.count("*").alias("n"))
    n = labels.count()
    if n > MAX_LANGS:  # a list of MAX_LANGS names
        rows = rows.join(F.broadcast(labels.orderBy(F.desc("n"), "lang").limit(MAX_LANGS).select("lang")), "lang", "left_semi")
    n = max(1, min(n, MAX_LANGS))
    slots = max(1, min(SLOTS, TRAIN_SLOTS // n))
    rows = rows.select("lang", "text", h.alias("h"), F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(slots)).alias("slot"))
    chars = max(64, min(TRAIN_CHARS, TRAIN_TOTAL // n))
    picks = rows.groupBy("lang", "slot").agg(F.min("h").alias("h")).select("lang", "h")
    size = max(8, 2 * chars // slots)
    sample = rows.join(F.broadcast(picks), ["lang", "h"]).groupBy("lang", "h").agg(F.min(F.substring("text", 1, LONG_ROW)).alias("t"))
    got: dict[str, list[str]] = {}
    for r in sample.select("lang", "h", F.expr(f"substring(t, 1 + pmod(h, greatest(1, length(t) - {size})), {size})").alias("t")).orderBy("lang", "h").collect():
        got.setdefault(r["lang"], []).append(r["t"])
    return Model(got, chars)


def predictor(spark: SparkSession, model: Model):
    """A column function from text to struct(lang, score)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in texts:
            values = batch.tolist()
            langs, scores = [], []
            for a in range(0, len(values), 1024):
                part = m.predict(values[a : a + 1024])
                langs += part[0]
                scores += part[1]
            yield pd.DataFrame({"lang": langs, "score": scores})
        give_back()

    return predict


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = bucket(F.col("doc_id"), 5) == 0
    predict = predictor(spark, fit(docs, ~held))
    return docs.select("doc_id", held.alias("held_out"), predict("text").alias("p")).select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score")
