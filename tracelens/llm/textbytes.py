"""Vectorised word spans and word hashes over batches of UTF-8 text.

All functions work on the bytes of a whole batch at once, so the per-word cost
is a few array operations and no Python object.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

U64 = np.uint64
_STEP = U64(0x9E3779B97F4A7C15)
_ODD = 0xD6E8FEB86659FD93
_RNG = np.random.default_rng(20240229)
#: One random 64-bit value for each byte; makes the polynomial hash hard to collide by accident.
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
#: Bytes of text handled at once; bounds the temporary arrays to a few tens of MB.
SHARD_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def draw(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th pseudo-random 64-bit value of each element."""
    return mix(x + U64((int(_STEP) * (k + 1)) & 0xFFFFFFFFFFFFFFFF))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            inverse = pow(_ODD, -1, 1 << 64)
            for name, base in (("up", _ODD), ("down", inverse)):
                row = np.full(size, base, dtype=np.uint64)
                row[0] = 1
                setattr(self, name, np.cumprod(row, dtype=np.uint64))
        return self.up, self.down


_POWERS = _Powers()


def word_table(separators: Sequence[int]) -> np.ndarray:
    """True for each byte that belongs to words."""
    t = np.ones(256, dtype=bool)
    t[list(separators)] = False
    return t


def spans(buf: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the maximal runs of word bytes."""
    flags = np.zeros(len(buf) + 2, dtype=np.int8)
    flags[1:-1] = is_word[buf]
    edge = np.flatnonzero(flags[1:] != flags[:-1])
    return edge[0::2], edge[1::2]


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    up, down = _POWERS.get(len(buf) + 1)
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def batches(texts: Sequence[str | None], limit: int = SHARD_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts as bytes, about ``limit`` bytes at a time; a longer text comes alone."""
    first, got, size = 0, [], 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
        if got and size + len(b) > limit:
            yield first, got
            first, got, size = i, [], 0
        got.append(b)
        size += len(b) + 1
    if got:
        yield first, got


def words(texts: list[bytes], is_word: np.ndarray, limit: int = SHARD_BYTES, prefix: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words, and the offset of each text's first word (one more at the end).

    A long text is hashed slice by slice; slices end at a separator, so that no word is cut.
    With ``prefix``, the hashes have a second row: those of each word's first ``prefix`` bytes.
    """
    if not texts:
        return np.zeros((2, 0) if prefix else 0, dtype=np.uint64), np.zeros(1, dtype=np.int64)
    joined = b"\n".join(texts) + b"\n"
    assert not is_word[10]
    whole = LOWER[np.frombuffer(joined, dtype=np.uint8)]
    ends = np.cumsum([len(t) + 1 for t in texts])
    hashes, starts, at = [], [], 0
    while at < len(whole):
        stop = min(len(whole), at + limit)
        if stop < len(whole):
            back = np.flatnonzero(~is_word[whole[at:stop]])
            if len(back):
                stop = at + int(back[-1]) + 1
            else:
                ahead = stop
                while ahead < len(whole) and is_word[whole[ahead]]:
                    ahead += 1
                stop = min(len(whole), ahead + 1)
        s, e = spans(whole[at:stop], is_word)
        h = hash_spans(whole[at:stop], s, e)
        hashes.append(np.stack([h, hash_spans(whole[at:stop], s, np.minimum(e, s + prefix))]) if prefix else h)
        starts.append(s + at)
        at = stop
    h = np.concatenate(hashes, axis=-1)
    s = np.concatenate(starts)
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    offsets[1:] = np.searchsorted(s, ends, side="left")
    return h, offsets


def give_back() -> None:
    """Hand this Python worker's free memory back to the machine: workers live on between stages, beside those of later ones."""
    import contextlib
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)
