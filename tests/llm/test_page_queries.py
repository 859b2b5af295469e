"""The queries over pages against plain readings of every page."""

import html as entities
import re

import pytest

from tracelens.llm import html, urls

SF = "/root/testdata/sf0.01"


def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet").collect()


def plain_article(page):
    """The table's pages have one article of h1 and p, with b and br inside, some unclosed: its blocks, by patterns."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:h1|p)>", inner)
    text = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks]
    return "\n".join(t for t in text if t)


def test_html_query(spark):
    got = {r["page_id"]: r for r in html.op3_html_text(spark, SF).collect()}
    rows = pages(spark)
    assert len(got) == len(rows)
    for r in rows:
        assert got[r["page_id"]]["text"] == plain_article(r["html"]) and got[r["page_id"]]["n_chars"] == len(plain_article(r["html"]))


def test_html_without_marks(spark):
    """The same pages with their article as a plain div: the block sums have to find it."""
    near = 0
    rows = [r for r in pages(spark) if len(plain_article(r["html"])) > 200]
    for r in rows:
        want, got = plain_article(r["html"]), html.extract(r["html"].replace("<article>", "<div>").replace("</article>", "</div>"))
        near += want == got
    assert near >= 0.95 * len(rows)


RULES = [("com", "/en/", "com/en/", "block"), ("example.com", "/en/7", "example.com/en/7", "allow"), ("net", "/de/", "net/de/", "allow"), ("example.net", "/de/8", "example.net/de/8", "block"), ("org", "/es/", "org/es/", "block")]


def by_rules(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
    fits = [(len(h) + len(p), rule, verdict) for h, p, rule, verdict in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, None))
    return host, path, rule, verdict


@pytest.mark.parametrize("sf", [SF])
def test_url_query(spark, sf):
    got = {r["page_id"]: r for r in urls.op5_url_filter(spark, sf).collect()}
    rows = pages(spark)
    assert len(got) == len(rows)
    ruled = 0
    for r in rows:
        host, path, rule, verdict = by_rules(r["url"])
        one = got[r["page_id"]]
        assert (one["host"], one["path"], one["rule"]) == (host, path, rule)
        # these pages hold no link to another page's address, so where no rule fits the method finds nothing to pass on
        assert one["verdict"] == (verdict or "allow")
        ruled += rule is not None
    assert ruled > 20


def test_url_query_with_planted_links(spark, tmp_path):
    """Aliases of blocked and allowed pages by canonical links, relative and not, and by refreshes, and a long page."""
    link = lambda to: f"<html><head><link rel='canonical' href='{to}'></head><body>x</body></html>"
    rows = [
        (1, "http://a.com/en/1", "x"), (2, "http://mirror.xyz/a", link("http://a.com/en/1")), (3, "http://mirror.xyz/b", link("/a")), (4, "http://www.example.com/en/7", link("http://b.com/en/2")), (10, "http://b.com/en/2", "own rule"), (11, "http://mirror.xyz/f", link("http://b.com/en/2")),
        (5, "http://other.xyz/c", "<meta http-equiv='refresh' content='0; url=//mirror.xyz/b'>"), (6, "http://free.xyz/d", "none"), (7, None, link("http://a.com/en/1")), (8, "http://long.xyz/e", link("http://a.com/en/1") + "y" * 400_000), (9, "http://free.xyz/d", None), (2, "http://mirror.xyz/a", link("http://a.com/en/1")),
    ]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r["page_id"], r["verdict"]) for r in urls.op5_url_filter(spark, str(tmp_path)).collect()}
    assert got == {(1, "block"), (2, "block"), (3, "block"), (4, "allow"), (5, "block"), (6, "allow"), (7, "allow"), (8, "block"), (9, "allow"), (10, "block"), (11, "allow")}
