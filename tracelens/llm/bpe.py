"""Byte-level BPE encoding and decoding by overlapping chunks.

``encode`` cuts every text into overlapping chunks, pre-tokenises the chunks in
parallel, and joins neighbours at the first pre-token boundary that both of
them have inside their overlap: the pattern never looks behind the start of a
match, so from a common boundary on both read the same pieces.  The pieces are
then encoded chunk by chunk, and a document's ids are the chunks' ids in order.
A chunk pair without a common boundary (one piece longer than the overlap) sends
that document through as a single chunk, which gives the same ids.

Defined results: a null or empty text has no ids; equal texts have equal ids;
rows are never merged, so repeated rows and repeated doc_ids stay; columns of
the input other than the text pass through untouched.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, table
from .textbytes import give_back

CHUNK = 65_536
OVERLAP = 512
#: Boundaries so near a chunk's end may change with the text that follows.
MARGIN = 16
#: Pieces kept in each of two generations; a piece of the older one moves on when it is met again.
CACHE_PIECES = 64_000


class Vocabulary:
    """Ranks of byte strings, with a bounded cache of encoded pieces."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.finditer = regex.compile(pattern).finditer
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def piece(self, text: str) -> bytes:
        """Ids of one piece as little-endian 32-bit integers."""
        got = self.cache.get(text)
        if got is None:
            got = self.older.get(text)
            if got is None:
                got = array("I", self.merge(text.encode("utf-8", "replace"))).tobytes()
            if len(self.cache) >= CACHE_PIECES:
                self.older, self.cache = self.cache, {}
            if len(text) <= 64:
                self.cache[text] = got
        return got

    def merge(self, raw: bytes) -> list[int]:
        """Join the neighbouring pair of lowest rank until no pair has a rank."""
        rank = self.ranks.get(raw)
        if rank is not None:
            return [rank]
        if len(raw) > 256:
            return self._merge_long(raw)
        parts = [raw[i : i + 1] for i in range(len(raw))]
        ranks = self.ranks
        top = 1 << 60
        pair = [ranks.get(parts[i] + parts[i + 1], top) for i in range(len(parts) - 1)]
        while pair:
            low = min(pair)
            if low == top:
                break
            i = pair.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i < len(pair):
                pair[i] = ranks.get(parts[i] + parts[i + 1], top)
            if i:
                pair[i - 1] = ranks.get(parts[i - 1] + parts[i], top)
        return [ranks[p] for p in parts]

    def _merge_long(self, raw: bytes) -> list[int]:
        """The same for long pieces: a heap of pairs over a linked list."""
        import heapq

        n = len(raw)
        end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends
        prev = list(range(-1, n - 1))
        alive = bytearray(b"\1" * n)
        ranks = self.ranks
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[i] >= stop or end[end[i]] != stop:
                continue
            j = end[i]
            alive[j] = 0
            end[i] = stop
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(raw[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if prev[i] >= 0 and (r := ranks.get(raw[prev[i] : stop])) is not None:
                heapq.heappush(heap, (r, prev[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str) -> bytes:
        get, miss = self.cache.get, self.piece
        return b"".join([get(p) or miss(p) for p in self.find(text)])

    def decode(self, ids: bytes) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _encoder(path: str, pattern: str):
    @F.pandas_udf("binary")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = vocabulary(path, pattern)
        for batch in texts:
            yield pd.Series([v.encode(t) if isinstance(t, str) else b"" for t in batch])
        give_back()

    return encode


def _round_trip(path: str, pattern: str):
    """Ids and the bytes that these decode to, from one worker: in one plan, an encoder and a decoder are two at the same time."""

    @F.pandas_udf("ids binary, raw binary")
    def both(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path, pattern)
        for batch in texts:
            ids = [v.encode(t) if isinstance(t, str) else b"" for t in batch]
            yield pd.DataFrame({"ids": ids, "raw": [v.decode(x) for x in ids]})
        give_back()

    return both


def _decoder(path: str, pattern: str):
    @F.pandas_udf("binary")
    def decode(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = vocabulary(path, pattern)
        for batch in ids:
            yield pd.Series([v.decode(bytes(x)) if x is not None else b"" for x in batch])
        give_back()

    return decode


def _boundaries(path: str, pattern: str, chunk: int, overlap: int, margin: int):
    """Boundaries of a chunk's pieces in the overlap with the chunk before it and in that with the next one."""

    @F.pandas_udf("head array<int>, tail array<int>")
    def bounds(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path, pattern)
        for batch in texts:
            heads, tails = [], []
            for t in batch:
                last = len(t) - margin
                ends = [0] + [e for m in v.finditer(t) if (e := m.end()) <= last]
                heads.append([e for e in ends if e < overlap])
                tails.append([e - chunk for e in ends if e >= chunk])
            yield pd.DataFrame({"head": heads, "tail": tails})

    return bounds


def encode(
    docs: DataFrame, scratch: Scratch, text: str = "text", out: str = "ids", path: str | None = None, pattern: str | None = None,
    chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = MARGIN, decoded: str | None = None,
) -> DataFrame:
    """``docs`` with a binary column ``out`` (with underscores added if ``docs`` has that name): the ids as little-endian unsigned 32-bit integers.

    Texts of up to one chunk are encoded where they lie.  Only longer ones are dealt out in chunks.
    With ``decoded``, a column of that name has the bytes that the ids decode to.
    """
    if not overlap + margin < chunk:
        raise ValueError("a chunk has to be longer than its overlap")
    default = default_vocabulary()
    path, pattern = path or default[0], pattern or default[1]
    enc, out = _encoder(path, pattern), fresh(docs, out)
    size = F.coalesce(F.length(F.col(text)), F.lit(0))
    short = docs.where(size <= chunk)
    if decoded:
        both = fresh(docs, "_both")
        short = short.withColumn(both, _round_trip(path, pattern)(F.col(text))).select(*docs.columns, F.col(both)["ids"].alias(out), F.col(both)["raw"].alias(decoded))
    else:
        short = short.withColumn(out, enc(F.col(text)))

    kept = [c for c in docs.columns]
    long = docs.where(size > chunk).select(F.struct(*kept).alias("row"), F.col(text).alias("t"))
    # Chunks depend on the text alone, so copies of one text share them.
    long = long.withColumn("rid", F.sha2("t", 256))
    texts = long.groupBy("rid").agg(F.first("t").alias("t"))
    n = F.ceil((F.length("t") - overlap - margin) / F.lit(chunk)).cast("int")
    # all chunks of a text as one array: its rows do not carry the text again
    cut = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: F.struct(k.alias("k"), F.substring(F.col("t"), k * chunk + 1, F.lit(chunk + overlap + margin)).alias("c")))
    pieces = texts.select("rid", F.explode(cut).alias("x")).select("rid", "x.*")
    pieces = scratch.save(pieces.repartition("rid", "k"), "chunks")

    bounds = pieces.select("rid", "k", _boundaries(path, pattern, chunk, overlap, margin)("c").alias("b")).select("rid", "k", "b.head", "b.tail")
    tails = bounds.select("rid", (F.col("k") + 1).alias("k"), F.col("tail").alias("before"))
    cuts = bounds.join(tails, ["rid", "k"], "left").select(
        "rid", "k", F.when(F.col("k") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", "before"))).alias("cut"))
    cuts = scratch.save(cuts, "cuts")
    lost = cuts.where("cut is null").select("rid").distinct()
    nexts = cuts.select("rid", (F.col("k") - 1).alias("k"), F.col("cut").alias("stop"))
    parts = pieces.join(cuts, ["rid", "k"]).join(nexts, ["rid", "k"], "left").join(lost, "rid", "left_anti")
    stop = F.coalesce(F.col("stop") + chunk, F.lit(2 * chunk + overlap + margin))
    parts = parts.select("rid", "k", enc(F.substring(F.col("c"), F.col("cut") + 1, stop - F.col("cut"))).alias("ids"))
    joined = parts.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("p"))
    joined = joined.select("rid", F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "")).alias(out))
    whole = texts.join(lost, "rid", "left_semi").select("rid", enc("t").alias(out))
    ids = joined.unionByName(whole)
    if decoded:
        ids = scratch.save(ids, "long").withColumn(decoded, _decoder(path, pattern)(F.col(out)))
    done = long.select("rid", "row").join(ids, "rid").select("row.*", *ids.columns[1:])
    return short.unionByName(done)


def decode(ids: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """The raw bytes of a column of ids as ``encode`` gives it."""
    default = default_vocabulary()
    return _decoder(path or default[0], pattern or default[1])(ids)


def digest(docs: DataFrame, scratch: Scratch, apart: bool = False) -> DataFrame:
    """doc_id, number of tokens, and digests of the ids and of the decoded bytes; saved, so that batches stay small.

    ``apart`` saves the ids too and decodes them in a plan of its own, instead of in the worker that encodes.
    """
    ids = encode(docs.select("doc_id", "text"), scratch, decoded=None if apart else "raw")
    if apart:
        ids = scratch.save(ids, "ids").withColumn("raw", decode(F.col("ids")))
    out = ids.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("raw"), 256).alias("decoded_sha256"))
    out = scratch.save(out, "digests")
    scratch.keep(out)
    return out


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), Scratch(spark, "bpe"))
