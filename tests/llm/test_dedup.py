"""Line dedup, near-duplicate documents and vectors, and components, against brute force."""

import fixtures as fx
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelens.llm import embeddings, graph, linededup, minhash
from tracelens.llm.common import Scratch

SF = "/root/testdata/sf0.001"


def test_line_dedup_odd_rows(spark):
    rows = fx.odd_rows()
    docs = fx.documents(spark, rows)
    out = linededup.remove_lines(docs, Scratch(spark, "t"))
    assert out.columns[:-1] == docs.columns and out.columns[-1] not in docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
    assert got == sorted(fx.kept_lines(rows), key=repr)


def test_line_dedup_empty(spark):
    assert linededup.remove_lines(fx.documents(spark, []), Scratch(spark, "t")).collect() == []
    assert [r["text"] for r in linededup.remove_lines(fx.documents(spark, [(1, None)]), Scratch(spark, "t")).collect()] == [None]


def test_line_dedup_query(spark):
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["text"] for r in linededup.op8_line_dedup(spark, SF).collect()}
    assert got == dict(fx.kept_lines(rows))


def test_minhash_odd_rows(spark):
    rows = fx.odd_rows()
    want = fx.near_groups(rows)
    out = minhash.near_duplicates(fx.documents(spark, rows), Scratch(spark, "t")).collect()
    assert len(out) == len(rows)
    for r in out:
        if r["doc_id"] is None:
            assert r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_minhash_empty(spark):
    assert minhash.near_duplicates(fx.documents(spark, []), Scratch(spark, "t")).collect() == []
    assert [r["kept"] for r in minhash.near_duplicates(fx.documents(spark, [(1, None), (2, "")]), Scratch(spark, "t")).collect()] == [True, True]


def test_minhash_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = fx.near_groups(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.op10_superminhash(spark, SF).collect()}
    assert got == want


def test_superminhash_estimates_jaccard():
    r = np.random.default_rng(1)
    errors = []
    for share in (0.2, 0.5, 0.9):
        for _ in range(20):
            both = r.integers(0, 2**63, int(200 * share), dtype=np.uint64)
            a, b = (np.unique(np.concatenate([both, r.integers(0, 2**63, 200 - len(both), dtype=np.uint64)])) for _ in range(2))
            s = minhash.signatures([a, b])
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append((s[0] == s[1]).mean() - j)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


def vectors():
    r = np.random.default_rng(3)
    base = r.normal(size=(60, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([base, base[:20] + r.normal(scale=0.03, size=(20, 16)), base[:5], base[:3] * 7]))]
    return [*rows, (200, None), (201, []), (202, [0.0] * 16), (203, [1.0, None] + [0.0] * 14), (204, [float("nan")] * 16), (205, [float("inf")] * 16), (206, [1.0, 2.0]), (None, base[0].tolist()), (5, base[5].tolist())]


def test_embeddings(spark):
    rows = vectors()
    out = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "class": F.lit(1)}), Scratch(spark, "t"), block=8).collect()
    assert len(out) == len(rows)
    good = [(k, np.array(v)) for k, v in rows if k is not None and k < 200]
    g, links = fx.Groups(), dict.fromkeys({k for k, _ in good}, 0)
    for i, (a, x) in enumerate(good):
        for b, y in good[i + 1 :]:
            if a != b and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95:
                g.join(a, b)
    for r in out:
        if r["vec_id"] is not None and r["vec_id"] < 200:
            assert r["component_id"] == g.find(r["vec_id"]) and r["kept"] == (r["component_id"] == r["vec_id"])
        else:
            assert r["n_links"] == 0 and r["kept"]


def test_embeddings_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>"), Scratch(spark, "t")).collect() == []


def test_embeddings_recall_of_planted_pairs(spark, tmp_path):
    """The query on 6,000 vectors with pairs planted at cosines from 0.95 to 0.97 and a family in one bucket: nine links in ten at least, and none too many."""
    r = np.random.default_rng(11)
    base = r.normal(size=(4000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = r.normal(size=(1400, 64))
    other -= (other * base[:1400]).sum(axis=1, keepdims=True) * base[:1400]
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cos = r.uniform(0.95, 0.97, size=(1400, 1))
    family = base[3999] + r.normal(scale=0.008, size=(600, 64))
    v = np.concatenate([base, base[:1400] * cos + other * np.sqrt(1 - cos**2), family]).astype(np.float32)
    rows = [(k, x.tolist(), k % 3) for k, x in enumerate(v)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {x["vec_id"]: x for x in embeddings.op2_itq_embeddings(spark, str(tmp_path)).collect()}
    u = v.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    want = near.sum(axis=1) - 1
    mine = np.array([got[k]["n_links"] for k in range(len(v))])
    assert want[:1400].sum() >= 1200 and want[5400:].sum() >= 600 * 500
    assert (mine <= want).all()
    assert mine[:5399].sum() >= 0.9 * want[:5399].sum() and mine.sum() >= 0.9 * want.sum()
    g = fx.Groups()
    for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        g.join(int(i), int(j))
    same = sum(got[k]["component_id"] == g.find(k) for k in range(len(v)))
    assert same >= 0.95 * len(v)


def test_embeddings_query_finds_nothing_too_many(spark):
    """The vectors of the small table are all far apart."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    v = np.stack(rows["embedding"].to_list()).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = dict(zip(rows["vec_id"], (v @ v.T >= 0.95).sum(axis=1) - 1, strict=True))
    assert {r["vec_id"]: r["n_links"] for r in embeddings.op2_itq_embeddings(spark, SF).collect()} == want


@pytest.mark.parametrize("edges", [[], [(1, 1), (None, 2)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 30)] + [(50, 51), (51, 52), (52, 50)]])
def test_components(spark, edges):
    g = fx.Groups()
    for a, b in edges:
        if a is not None and a != b:
            g.join(a, b)
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {x: g.find(x) for x in g.up}


def test_rows_of_one_id_share_a_component(spark):
    """An id with several texts, or embeddings, joins whatever is linked with any of them."""
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(3, a), (5, a), (5, b), (9, b), (1, c), (20, c + " more"), (20, b + " end"), (30, "alone"), (None, a), (8, None), (8, "")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t"))
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got.where("doc_id is not null").collect()} == {(1, 1, True), (3, 1, False), (5, 1, False), (9, 1, False), (20, 1, False), (30, 30, True), (8, 8, True)}
    x, y = [1.0, 0.0, 0.0, 0.5], [0.0, 1.0, 0.3, 0.0]
    vectors = spark.createDataFrame([(3, x), (5, x), (5, y), (9, y), (7, [0.0, 0.0, 0.0, 1.0]), (7, None)], "vec_id long, embedding array<float>")
    got = embeddings.near_duplicates(vectors, Scratch(spark, "t"))
    assert {(r["vec_id"], r["component_id"], r["kept"]) for r in got.collect()} == {(3, 3, True), (5, 3, False), (9, 3, False), (7, 7, True)}
