"""Token counts, Merkle manifests and filter audits against plain versions of them."""

import hashlib
import re
import zlib
from itertools import permutations
from math import factorial

import fixtures as fx
import pytest

from tracelens.llm import audit, merkle, tokencount
from tracelens.llm.common import Scratch

SF = "/root/testdata/sf0.001"
HARD = ["it's 'sall' we'RE", "12３4½Ⅷ", "a<|endoftext|>b <|STARTOFTEXT|> <|startoftext|>,", "J̌ Å ́x end́.", "foo,bar;;baz--,x... (y)", "x\x1cy\xa0z w\x0bv", "ΣΑΣ İi ẞ", "好的。再见！ 日本語", "!!! ,,, .", "é" * 500]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokencount.default_path())


def test_token_counts(spark):
    t, rows = library(), fx.odd_rows() + [(1000 + k, x) for k, x in enumerate(HARD)]
    rows += [(2000, " ".join(HARD * 40)), (2001, ("ab1" * 900 + " ") * 3 + "z" * 3000)]
    docs = fx.documents(spark, rows)
    for long in (tokencount.LONG_BYTES, 300):
        got = tokencount.count_tokens(docs, Scratch(spark, "t"), out="d", long_bytes=long)
        assert got.columns == [*docs.columns, "d_"] and got.where("hit != 7 or d != 7").count() == 0
        want = sorted((repr(d), len(t.encode(x or "", add_special_tokens=False))) for d, x in rows)
        assert sorted((repr(r["doc_id"]), r["d_"]) for r in got.collect()) == want
    assert tokencount.count_tokens(fx.documents(spark, []), Scratch(spark, "t")).collect() == []


def test_token_report_of_the_whole_table(spark):
    t = library()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in tokencount.op11_token_counts(spark, SF).collect():
        n = len(t.encode(texts[r["doc_id"]], add_special_tokens=False))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 2048)


def test_counter_forgets_and_cuts_long_words(monkeypatch):
    t = library()
    monkeypatch.setattr(tokencount, "LONG_BYTES", 50)
    c = tokencount.Counter(tokencount.default_path(), known=3)
    texts = [" ".join(HARD), "ab1" * 900, *[fx.prose(k, 60) for k in range(20)], "", None]
    for _ in range(2):
        assert c.counts([None if x is None else x.encode() for x in texts]) == [len(t.encode(x or "", add_special_tokens=False)) for x in texts]


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def others(levels, j):
    out = []
    for nodes in levels[:-1]:
        low = j // 16 * 16
        out.append((nodes[low:j], nodes[j + 1 : low + 16]))
        j //= 16
    return out


def plain_manifest(rows):
    """Rows of op12 from (doc_id, source, lang, n_chars, text)."""
    digest = lambda r: h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
    by, out = {}, []
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, digest(r), r))
    names = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    for k in names:
        by[k].sort(key=lambda x: x[:3])
    trees = {k: tree([x[2] for x in by[k]]) for k in names}
    top = tree([trees[k][-1][0] for k in names])
    for a, k in enumerate(names):
        for j, (_, _, leaf, r) in enumerate(by[k]):
            path, now = others(trees[k], j) + others(top, a), leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                now = digest((*r[:4], r[4] and re.sub("[A-Z]", lambda m: m[0].lower(), r[4])))
            for left, right in path:
                now = h("".join(left) + now + "".join(right))
            out.append((r[0], leaf, trees[k][-1][0], top[-1][0], h("".join("".join(x) + "".join(y) for x, y in path)), now, now == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("levels", "top"), [(3, 1024), (1, 4), (1, 30), (2, 8)])
def test_manifest(spark, levels, top):
    rows = [(k, "hot", "en", k, f"Text {k}") for k in range(300)] + [(5000 + k, f"s{k}é" if k % 7 else None, None, None, None if k % 3 else "Abc") for k in range(60)]
    rows += [(None, "hot", "en", 3, "abc"), (None, None, None, None, None), *rows[3:5], *rows[3:5], (7, "hot", "de", 1, "other"), (8, "", "", 0, ""), (9, "long", "x", 1, "Z" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("*", "1 as h", "2 as key", "3 as pos")
    got = merkle.manifest(merkle.document_leaves(df), Scratch(spark, "t"), levels, top).select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted(map(tuple, got.collect()), key=repr) == plain_manifest(rows)
    assert merkle.manifest(merkle.document_leaves(df.where("false")), Scratch(spark, "t"), levels, top).collect() == []


def plain_audit(rows, labels):
    tests, docs, out = [lambda t: len(t.split()) < 100, lambda t: 100 * len(set(t.split())) < 80 * len(t.split()), lambda t: 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), lambda t: bool(re.search("[#$%&*|]", t))], [], []
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    for d, lang, text in rows:
        t = text or ""
        copy = d is not None and any(e is not None and e < d and (x or "") == t for e, _, x in rows)
        docs.append((lang or "", [f(t) for f in tests] + [copy], d in good and d is not None, d in toxic and d is not None))
    for part in {d[0] for d in docs}:
        mine, shapley, seen = [d for d in docs if d[0] == part], [0] * 5, []
        for p in permutations(range(5)):
            left = mine
            for step, f in enumerate(p, 1):
                gone, kept = [d for d in left if d[1][f]], [d for d in left if not d[1][f]]
                shapley[f] += len(gone)
                fails = sum(d[1][f] for d in mine)
                seen.append((part, "".join("ABCDE"[x] for x in p), step, len(kept), len(gone), fails - len(gone), sum(d[1][f] and sum(d[1]) == 1 for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone), f))
                left = kept
        out += [(*x[:-1], shapley[x[-1]]) for x in seen]
    assert factorial(5) * 5 * len({d[0] for d in docs}) == len(out)
    return sorted(out)


def test_filter_audit(spark):
    long = " ".join(f"w{k}" for k in range(120))
    rows = [(1, "en", long), (2, "en", long), (2, "en", long), (3, None, long), (4, "", "SHORT # text"), (5, "de", None), (6, "de", ""), (None, "de", ""), (None, None, long), (0, "fr", "A" * 200), (0, "fr", "A" * 200), (9, "fr", "a b " * 100)]
    rows += [(100 + k, ["en", "de", "xx"][k % 3], fx.prose(k % 17, 70 + k) + (" |" if k % 4 == 0 else "").upper()) for k in range(60)]
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, None), (4, 0, 1), (None, 1, 1), *[(100 + k, k % 2, int(k % 5 == 0)) for k in range(60)]]
    df = spark.createDataFrame([(d, lang, t, 7) for d, lang, t in rows], "doc_id long, lang string, text string, fails int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audit(audit.bits(df, marks, Scratch(spark, "t"))).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, labels)
    assert audit.audit(audit.bits(df.where("false"), marks, Scratch(spark, "t"))).collect() == []
