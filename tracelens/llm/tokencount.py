"""Token counts by batch encoding: lengths only, no ids leave a task.

A tokeniser file whose pre-tokeniser never joins characters across ASCII white
space gives a text as many tokens as its words together.  So an Arrow function
cuts its batches into groups of about ``GROUP_BYTES``, encodes the words that the
group has and the worker does not know yet in batches of ``ENCODE_BYTES``, and
adds up lengths.  Known words are kept in a bounded table.

Texts above ``LONG_BYTES`` are cut at white space into pieces first, which are
dealt over tasks by a hash of text and place, counted there and summed; copies of
one text share its pieces.  A word above ``LONG_BYTES`` is cut before ASCII digits,
which are tokens of their own; a longer run without a digit is encoded as it is.

Defined results: null and empty texts have no bytes and no tokens; special strings
in a text count as the library has them by default; rows are never merged, so
repeated rows and repeated doc_ids stay; columns of the input pass through, and a
new column gets underscores where the input has its name; an empty table stays empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, table
from .textbytes import give_back

#: Bytes of text whose words are looked up together, and of words that the library gets at once.
GROUP_BYTES, ENCODE_BYTES = 1 << 20, 1 << 18
#: Texts above it are dealt out in pieces of about this size.
LONG_BYTES = 1 << 16
#: Words that a worker keeps in each of two generations; one of the older moves on when it is met again.
KNOWN_WORDS = 300_000
LIMIT = 2048
_DIGIT = re.compile(rb"(?=[0-9])")
_MARKS = b",.;:!?"


def balanced(items: Iterable[bytes], limit: int) -> Iterator[list[bytes]]:
    """Consecutive items, about ``limit`` bytes at a time; a longer one comes alone."""
    got, size = [], 0
    for x in items:
        if got and size + len(x) > limit:
            yield got
            got, size = [], 0
        got.append(x)
        size += len(x) + 1
    if got:
        yield got


class Counter:
    """Lengths of words as the tokenizers library encodes them."""

    def __init__(self, path: str, known: int = KNOWN_WORDS) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}
        self.most = known

    def length(self, word: bytes) -> int:
        """Of a very long word, by parts that begin at digits."""
        parts, at = [], 0
        for m in _DIGIT.finditer(word):
            if m.start() - at >= LONG_BYTES:
                parts.append(word[at : m.start()])
                at = m.start()
        return sum(len(e) for some in balanced([*parts, word[at:]], ENCODE_BYTES) for e in self.encode(some))

    def encode(self, words: list[bytes]) -> list:
        return self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)

    def learn(self, words: set[bytes]) -> None:
        """Every word of ``words`` is known afterwards.

        Marks after an ASCII letter or digit are tokens apart from it, and ASCII letters count alike in either case
        (but for special strings, and beside combining marks): few forms of a word reach the library.
        """
        if len(self.known) > self.most:
            self.older, self.known = self.known, {}
        known, older, parts, todo = self.known, self.older, {}, set()
        for w in words:
            if w in known:
                continue
            if (n := older.get(w)) is not None:
                known[w] = n
                continue
            core = w.rstrip(_MARKS)
            if not core[-1:].isalnum():
                core = w
            tail = w[len(core) :]
            if core.isascii() and b"|" not in core:
                core = core.lower()
            parts[w] = core, tail
            todo.update(p for p in (core, tail) if p not in known)
        for p in [p for p in todo if p in older]:
            known[p] = older[p]
            todo.discard(p)
        for some in balanced((p for p in todo if len(p) <= LONG_BYTES), ENCODE_BYTES):
            known.update(zip(some, map(len, self.encode(some)), strict=True))
        for p in todo:
            if len(p) > LONG_BYTES:
                known[p] = self.length(p)
        for w, (core, tail) in parts.items():
            known[w] = known[core] + known[tail]

    def counts(self, texts: list[bytes | None]) -> list[int]:
        out = []
        for group in balanced((t or b"" for t in texts), GROUP_BYTES):
            words = [t.split() for t in group]  # of bytes: at ASCII white space only
            self.learn(set().union(*words))
            size = self.known.__getitem__
            out += [sum(map(size, w)) for w in words]
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _lengths(path: str):
    @F.arrow_udf("long")
    def lengths(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = counter(path)
        for batch in texts:
            yield pa.array(c.counts(batch.cast(pa.large_binary()).to_pylist()), pa.int64())
        give_back()

    return lengths


def pieces(text: bytes, size: int) -> Iterator[bytes]:
    """Parts of a text that begin at white space, of ``size`` bytes or, if no white space comes, more."""
    at = 0
    space = re.compile(rb"[ \t-\r]")
    while at < len(text):
        m = space.search(text, at + size)
        stop = m.start() if m else len(text)
        yield text[at:stop]
        at = stop


def _cut(size: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                k = 0
                for some in balanced(pieces(text, size), 4 << 20):
                    yield pa.RecordBatch.from_arrays([pa.array([rid] * len(some)), pa.array(range(k, k + len(some)), pa.int64()), pa.array([p.decode() for p in some])], ["rid", "k", "piece"])
                    k += len(some)
        give_back()

    return cut


def count_tokens(docs: DataFrame, scratch: Scratch, text: str = "text", out: str = "n_tokens", path: str | None = None, long_bytes: int = LONG_BYTES) -> DataFrame:
    """``docs`` with a long column ``out``; ``path`` names a tokenizers file whose pre-tokeniser drops white space."""
    lengths, out = _lengths(path or default_path()), fresh(docs, out)
    size = F.coalesce(F.octet_length(text), F.lit(0))
    short = docs.where(size <= long_bytes).withColumn(out, lengths(F.col(text)))
    long = docs.where(size > long_bytes).select(F.struct(*docs.columns).alias("row"), F.sha2(F.col(text), 256).alias("rid"), F.col(text).alias("t"))
    texts = long.groupBy("rid").agg(F.first("t").alias("t"))
    parts = texts.select("rid", "t").mapInArrow(_cut(long_bytes), "rid string, k long, piece string")
    parts = scratch.save(parts.repartition("rid", "k"), "pieces")
    counted = scratch.save(parts.select("rid", lengths("piece").alias("n")).groupBy("rid").agg(F.sum("n").alias(out)), "long")
    return short.unionByName(long.drop("t").join(counted, "rid").select("row.*", out))


def token_report(docs: DataFrame, scratch: Scratch, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row; saved, so that the bound on batches holds."""
    n = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    n = count_tokens(n, scratch, path=path).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    return scratch.save(n, "counts")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_report(table(spark, sf_dir, "documents"), Scratch(spark, "tokens"))
