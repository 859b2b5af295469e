"""The near-dedup stage: its similarity, and copies that have no doc_id or share one."""

import corpus_pipeline as cp
import pytest

SCHEMA = "doc_id long, text string"


def words(n, changed=()):
    return " ".join(f"w{i}" if i not in changed else f"x{i}" for i in range(n))


def near_dedup(spark, rows):
    out = dict(cp.STAGES)["near_dedup"](spark, spark.createDataFrame(rows, SCHEMA), "")
    return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)


def test_stage_similarity(spark):
    # of 126 shingles each changed word at the end takes one: 10 give 116 / 136 = 0.853, 12 give 0.826, 14 give 0.8, 15 give 0.787
    rows, kept = [], []
    for k, (tail, stays) in enumerate([(10, False), (12, False), (14, False), (15, True)]):
        base = [f"g{k}w{i}" for i in range(130)]
        rows += [(10 * k, " ".join(base)), (10 * k + 1, " ".join(base[:130 - tail] + [f"g{k}x{i}" for i in range(tail)]))]
        kept += [10 * k] + [10 * k + 1] * stays
    assert sorted(r[0] for r in near_dedup(spark, rows)) == kept


@pytest.mark.parametrize("named", [1, 2**63 - 1])
def test_copies_without_id(spark, named):
    a, b = words(200), " ".join(f"y{i}" for i in range(200))
    rows = [(named, a), (named, a), (None, b), (None, b), (None, b + " end"), (None, words(200, {199}))]
    got = near_dedup(spark, rows)
    assert len(got) == 2
    texts = {t for _, t in got}
    assert len(texts & {b, b + " end"}) == 1 and len(texts & {a, words(200, {199})}) == 1
    if named != 2**63 - 1:
        assert (named, a) in got


def test_extra_map_column(spark):
    """Wholly equal rows of one doc_id become one, also beside a map."""
    rows = [(1, words(60), {"a": 1}), (1, words(60), {"a": 1}), (1, words(60), {"a": 2}), (2, words(60), None), (3, "other", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>")
    out = dict(cp.STAGES)["near_dedup"](spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["m"]) for r in out.collect()), key=repr) == [(1, {"a": 1}), (1, {"a": 2}), (3, None)]
