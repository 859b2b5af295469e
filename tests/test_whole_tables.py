"""Queries reach every row of their tables."""

import pytest
from test_queries import SF

from tracelens import queries

COUNTS = {
    "json_leaves": ("event_id", "events", "event_id"),
    "on_call": ("o_orderkey", "orders", "o_orderkey"),
    "commit_prefix": ("sha", "pages", "sha1(cast(url as binary))"),
    "graph_layers": ("node", "orders", "explode(array(concat('customer ', o_custkey), concat('order ', o_orderkey)))"),
}


@pytest.mark.parametrize("name", sorted(COUNTS))
def test_every_row(spark, name):
    key, table, source = COUNTS[name]
    got = {r[0] for r in queries.QUERIES[name](spark, SF).select(key).collect() if not str(r[0]).startswith("supplier ")}
    assert got == {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").selectExpr(source).collect()}


def test_every_call_is_recorded_or_replayed(spark):
    ids = {r[0] for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id").collect()}
    replayed = {r[0] for r in queries.QUERIES["cassette"](spark, SF).select("event_id").collect()}
    assert replayed == {i for i in ids if i % 2}
    assert {r[0] for r in queries.QUERIES["cassette"](spark, SF).where("answer is not null").select("answer").collect()} <= ids - replayed
