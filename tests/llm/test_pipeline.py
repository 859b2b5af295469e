"""Each stage of the pipeline against brute force on its own input, and all of them on odd rows."""

import corpus_pipeline as cp
import fixtures as fx
import numpy as np

from tracelens.llm.common import Scratch

SF = "/root/testdata/sf0.001"


def plain(df):
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=repr)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages, scratch, enc = dict(cp.STAGES), Scratch(spark, "t"), fx.tiktoken_encoding()
    cols = docs.columns

    one = scratch.save(cp.identify_language(spark, docs, SF))
    assert one.columns == cols and plain(one) == [r for r in plain(docs) if any(c.isalpha() for c in r["text"] or "")]
    two = scratch.save(stages["line_dedup"](spark, one, SF))
    want = dict(fx.kept_lines([(r["doc_id"], r["text"]) for r in plain(one)]))
    assert two.columns == cols and {r["doc_id"]: r["text"] for r in plain(two)} == {r["doc_id"]: want[r["doc_id"]] for r in plain(one) if want[r["doc_id"]].strip() or want[r["doc_id"]] == r["text"]}
    three = scratch.save(stages["near_dedup"](spark, two, SF))
    groups = fx.near_groups([(r["doc_id"], r["text"]) for r in plain(two)])
    assert three.columns == cols and plain(three) == [r for r in plain(two) if groups[r["doc_id"]][1] == r["doc_id"]]
    four = scratch.save(stages["decontaminate"](spark, three, SF))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = fx.words(r["text"], fx.BENCH_WORD)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} - {()}

    def clean(text):
        w = fx.words(text, fx.BENCH_WORD)
        return not any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))

    assert four.columns == cols and plain(four) == [r for r in plain(three) if clean(r["text"])]
    five = {r["doc_id"]: r["n_tokens"] for r in stages["byte_bpe"](spark, four, SF).collect()}
    assert five == {r["doc_id"]: len(enc.encode(r["text"], disallowed_special=())) for r in plain(four)}
    assert {r["doc_id"] for r in cp.run(spark, SF).collect()} == set(five)


def test_stages_on_odd_rows(spark, tmp_path):
    spark.createDataFrame([(1, fx.prose(300, 25)), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (fx.odd_rows(), []):
        docs, scratch = fx.documents(spark, rows), Scratch(spark, "t")
        for name, stage in cp.STAGES:
            before, docs = docs, scratch.save(stage(spark, docs, str(tmp_path)), name)
            if name != "byte_bpe":
                assert docs.columns == before.columns
                assert docs.where("hit != 7 or _p != 7 or n_removed != 7").count() == 0
        assert (docs.count() > 0) == bool(rows)
    assert np.all([len(s) == 2 for s in cp.STAGES])


def test_byte_bpe_saves_no_ids_and_has_one_worker(spark, tmp_path, monkeypatch):
    """The ids of the corpus are not written, and no task of the plan that reads the texts has an encoder beside a decoder."""
    plans, save = [], Scratch.save

    def saved(self, df, name="t"):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return save(self, df, name)

    monkeypatch.setattr(Scratch, "save", saved)
    rows = [(1, "some words"), (2, None), (3, fx.prose(7, 20_000)), (4, "")]
    out = cp.tokenise(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert "ids" not in [name for name, _ in plans]
    # one for short texts, one for the ids of long ones, which are saved before
    assert plans[-1][0] == "digests" and plans[-1][1].count("ArrowEvalPython") == 2
    enc = fx.tiktoken_encoding()
    assert {r["doc_id"]: r["n_tokens"] for r in out.collect()} == {k: len(enc.encode(t or "", disallowed_special=())) for k, t in rows}
