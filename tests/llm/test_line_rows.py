"""Rows that share a doc_id, or have none, lose their own lines only."""

import os

import fixtures as fx
import pytest

from tracelens.llm import linededup
from tracelens.llm.common import Scratch

SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("doc_id", [None, 7])
def test_lines_of_other_rows_stay(spark, doc_id):
    rows = [(doc_id, "w x y z\nfoo bar"), (doc_id, "clean words here\nw x y z"), (9, "foo bar\nlast one")]
    got = linededup.remove_lines(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t")).collect()
    assert sorted((r["text"], r["n_removed"]) for r in got) == [("clean words here", 1), ("last one", 1), ("w x y z\nfoo bar", 0)]


def test_tables_of_steps_go(spark, tmp_path):
    """Of the tables saved on the way only the one that the result reads is left: a pipeline's later stages need the disk."""
    scratch = Scratch(spark, "t")
    scratch.root = f"{tmp_path}/lines"
    rows = fx.odd_rows()
    out = linededup.remove_lines(fx.documents(spark, rows), scratch)
    assert len(os.listdir(scratch.root)) == 1
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted(fx.kept_lines(rows), key=repr)


def test_family_of_near_copies(spark, monkeypatch):
    """A family whose words are frequent, with copies and equal sets: the same lines go whether its earliest line is tried first or not."""
    base = [f"w{i}" for i in range(30)]
    rows = [(k, " ".join([*base[:29], f"x{k % 40}"]) + "\n" + " ".join(reversed(base)) + f"\nalone{k} z{k} y{k}") for k in range(60)]
    want = sorted(fx.kept_lines(rows))
    docs = spark.createDataFrame(rows, SCHEMA)
    for most in (8, linededup.FREQUENT):
        monkeypatch.setattr(linededup, "FREQUENT", most)
        assert sorted((r["doc_id"], r["text"]) for r in linededup.remove_lines(docs, Scratch(spark, "t")).collect()) == want
