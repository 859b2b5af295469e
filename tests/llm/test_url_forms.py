"""Every form of a canonical link, refresh or redirect reaches its target."""

from urllib.parse import urljoin

import pytest

from tracelens.llm import urls
from tracelens.llm.common import Scratch

BASES = ["http://www.example.net/a/b/c?x=1#f", "https://example.net", "http://example.net/a/"]
TARGETS = ["/de/8", "//www.example.net/de/8", "?id=3&b=2", "d/e", "../d", "./d/", "../../../d/..", "https://h.org/x?u=http://y", "/go?to=http://y/z", " /de/8\n", "#top"]
FORMS = [
    "<link rel='canonical' href='/de/8'>", '<link href="//www.example.net/de/8" rel="canonical"/>', "<LINK REL=canonical HREF=../de/8>", "<link rel='shortlink  Canonical' href='http://example.net/de/8'>",
    "<meta http-equiv='refresh' content='0; url=/de/8'>", "<meta content=\"0;URL='/de/8'\" http-equiv=refresh>", "<meta http-equiv=refresh content='3; /de/8'>", "<base href='/de/'><link rel=canonical href='8'>",
]


def test_resolve(spark):
    rows = [(b, t) for b in BASES for t in TARGETS]
    df = spark.createDataFrame(rows, "b string, t string")
    got = [r[0] for r in df.select(urls.address(urls.resolve(df.b, df.t))).collect()]
    want = [r[0] for r in spark.createDataFrame([(urljoin(b, t.strip()),) for b, t in rows], "u string").select(urls.address(urls.F.col("u"))).collect()]
    assert got == want
    odd = spark.createDataFrame([(None, "/a"), ("plain", "/a"), ("http://h/x", ""), ("http://h/x", None)], "b string, t string")
    assert [r[0] for r in odd.select(urls.resolve(odd.b, odd.t)).collect()] == [None] * 4


@pytest.mark.parametrize("query", ["?a=1&amp;b=2", ""])
def test_forms_pass_the_block_on(spark, query):
    rows = [(i, f"http://example.net/p{i}/x", f"<html>{form.replace('de/8', 'de/8' + query) if 'HREF' not in form else form}</html>") for i, form in enumerate(FORMS)]
    out = urls.judge(spark.createDataFrame([*rows, (99, "http://example.net/q", "<p>canonical</p>")], "page_id long, url string, html string"), Scratch(spark, "t")).collect()
    assert {r["page_id"]: r["verdict"] for r in out} == dict.fromkeys(range(len(FORMS)), "block") | {99: "allow"}


def test_decoded_target_is_the_page(spark):
    rows = [(1, "http://example.net/s", "<link rel=canonical href='http://h.xyz/s?b=2&amp;a=1'>"), (2, "http://h.xyz/s?a=1&b=2", "<link rel=canonical href='http://example.net/de/8'>")]
    out = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), Scratch(spark, "t"), normal=True).collect()
    assert [r["verdict"] for r in out] == ["block", "block"]


def test_no_verdict_without_an_edge(spark):
    urls_ = ["http://x.com/en/", "http://x.com/en", "http://www.x.com/en?ref=1", "http://x.com/en/#top", "https://x.com/en/"]
    df = spark.createDataFrame([(i, u, "<p></p>") for i, u in enumerate(urls_)], "page_id long, url string, html string")
    assert [r["verdict"] for r in urls.judge(df, Scratch(spark, "t")).orderBy("page_id").collect()] == ["block", "allow", "allow", "block", "block"]
    assert [r["verdict"] for r in urls.judge(df, Scratch(spark, "t"), normal=True).orderBy("page_id").collect()] == ["block"] * 5
    seen = spark.createDataFrame([("http://www.x.com/en?ref=1", "http://x.com/en/")], "from_url string, to_url string")
    assert [r["verdict"] for r in urls.judge(df, Scratch(spark, "t"), redirects=seen).orderBy("page_id").collect()] == ["block", "allow", "block", "block", "block"]
    assert urls.judge(df.where("false"), Scratch(spark, "t")).collect() == []
