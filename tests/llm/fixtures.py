"""Small tables with odd rows, and brute-force versions of what SQL cannot express."""

import random
import re

WORDS = "amber birch cedar delta ember flint grove haven inlet jetty knoll larch maple north ocean prism quartz river stone tidal umber vapor willow xenon yarrow zephyr".split()
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Names that the operators use inside, as extra columns of the input.
EXTRA = ["d", "l", "c", "n", "place", "id", "hit", "_d", "_p", "_gone", "kept", "class", "token", "ids", "row", "n_removed", "component_id"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "s", "ing", "ed"]) for _ in range(n))


def odd_rows() -> list[tuple]:
    """(doc_id, text): copies, near copies, ties, repeated rows, nulls, empty, white and very long texts."""
    base, other = prose(1, 120), prose(2, 80)
    near = base.replace(" ", " ", 1).rsplit(" ", 1)[0] + " changed"
    lines = "\n".join(prose(k, 12) for k in range(20, 32))
    rows = [
        (1, base), (2, base), (3, near), (4, other), (4, other), (5, None), (6, ""), (7, "  \n\t "), (8, "one two"), (9, "ONE two"), (None, base), (None, None),
        (10, lines), (11, lines.replace("amber", "Amber")), (12, "\n".join(reversed(lines.split("\n")))), (13, prose(5, 30_000)), (14, "x" * 70_000), (15, base + "\n" + other), (16, "123 456 ..."),
    ]
    return rows + [(100 + k, prose(50 + k, 40) + "\n" + prose(90 + k % 3, 25)) for k in range(12)]


def documents(spark, rows=None):
    """The rows as a table like ``documents``, with extra columns of clashing names."""
    from pyspark.sql import functions as F

    rows = odd_rows() if rows is None else rows
    df = spark.createDataFrame([(d, t, "en" if d is None or d % 2 else None, None, len(t) if t is not None else None) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(7) for c in EXTRA})


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (text or "").translate(UP))


class Groups:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def near_groups(rows, percent=85, size=5):
    """{doc_id: (n_shingles, component)} of rows with distinct ids or equal texts."""
    sets = {}
    for d, t in rows:
        w = words(t)
        if d is not None:
            sets[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    g = Groups()
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                g.join(a, b)
    return {d: (len(s), g.find(d)) for d, s in sets.items()}


def kept_lines(rows, percent=80):
    """The text of each row without the lines that an earlier line removes; rows of one doc_id are one place."""
    order = sorted((r for r in rows if r[1] is not None), key=lambda r: -(2**63) if r[0] is None else r[0])
    seen, out = [], []
    for d, t in order:
        for k, line in enumerate(t.split("\n")):
            if w := frozenset(words(line)):
                seen.append(((-(2**63) if d is None else d, k), w))
    for d, t in rows:
        if t is None:
            out.append((d, None))
            continue
        left = []
        for k, line in enumerate(t.split("\n")):
            w, here = frozenset(words(line)), (-(2**63) if d is None else d, k)
            if not (w and any(p < here and 100 * len(w & x) >= percent * len(w | x) for p, x in seen)):
                left.append(line)
        out.append((d, "\n".join(left)))
    return out


BENCH_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def benchmark_hits(text, items, window=10):
    """(n_words, n_hit, item ids) by looking at every place."""
    doc, hit, found = words(text, BENCH_WORD), set(), set()
    for name, item in items:
        w = words(item, BENCH_WORD)
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            for i in range(len(doc) - n + 1):
                if doc[i : i + n] == w[j : j + n]:
                    hit.update(range(i, i + n))
                    found.add(str(name))
    return len(doc), len(hit), sorted(found)


def tiktoken_encoding():
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
