"""Decontamination, BPE, language, toxicity, HTML, URL and PII operators."""

import binascii
import hashlib

import fixtures as fx
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelens.llm import bpe, decontaminate, html, language, pii, toxicity, urls
from tracelens.llm.common import Scratch

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def items():
    long = fx.prose(300, 25)
    return [(1, long), (2, long), (3, "ember flint"), (4, None), (5, ""), (None, fx.prose(301, 12)), (7, fx.prose(302, 10))]


def test_decontaminate_odd_rows(spark):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    rows = [(*r[:1], r[1]) for r in fx.odd_rows() if r[1] is None or len(r[1]) < 50_000]
    rows += [(900, "begin " + items()[0][1].upper() + " end"), (901, " ".join(fx.words(items()[0][1])[3:20])), (902, "EMBER, flint! ember flint"), (903, fx.prose(302, 10) + " " + fx.prose(301, 12))]
    named = [("" if k is None else k, t) for k, t in items()]
    for most in (decontaminate.BLOCK_WORDS, 24):
        got = decontaminate.contamination(fx.documents(spark, rows), bench, Scratch(spark, "t"), block_words=most).select("doc_id", "text", "hit_.n_words", "hit_.n_hit", "hit_.items").collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r["n_words"], r["n_hit"], sorted(set(r["items"]))) == fx.benchmark_hits(r["text"], named), r["doc_id"]
    kept = decontaminate.remove_contaminated(fx.documents(spark, rows), bench, Scratch(spark, "t"))
    assert kept.columns == fx.documents(spark, []).columns
    assert kept.where("doc_id between 900 and 903").count() == 0 and kept.where("hit = 7").count() == kept.count() > 0


def test_decontaminate_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.remove_contaminated(fx.documents(spark, []), none, Scratch(spark, "t")).collect() == []
    assert decontaminate.remove_contaminated(fx.documents(spark), none, Scratch(spark, "t")).count() == len(fx.odd_rows())


def test_decontaminate_query(spark):
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    by_first = {}
    for name, t in bench:
        w = fx.words(t, fx.BENCH_WORD)
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            by_first.setdefault(tuple(w[j : j + n]), set()).add(str(name))
    for r in decontaminate.op1_decontaminate(spark, SF).collect():
        w, hit, found = fx.words(texts[r["doc_id"]], fx.BENCH_WORD), set(), set()
        for n in {len(k) for k in by_first}:
            for i in range(len(w) - n + 1):
                if names := by_first.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= names
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(found), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_bpe_odd_rows(spark):
    enc = fx.tiktoken_encoding()
    rows = [*fx.odd_rows(), (800, "naïve 日本語 \U0001f600 don't   stop\r\n\n 123456"), (801, " " * 3000 + "a" + "\n" * 500), (802, fx.prose(8, 900) + "y" * 900 + fx.prose(9, 900))]
    docs = fx.documents(spark, rows)
    out = bpe.encode(docs, Scratch(spark, "t"), chunk=1500, overlap=200)
    assert out.columns == [*docs.columns, "ids_"]
    out = out.withColumn("back", bpe.decode(F.col("ids_"))).collect()
    assert len(out) == len(rows)
    for r in out:
        text = r["text"] or ""
        assert r["ids"] == 7
        assert np.frombuffer(bytes(r["ids_"]), "<u4").tolist() == enc.encode(text, disallowed_special=()), r["doc_id"]
        assert bytes(r["back"]) == text.encode()
    assert bpe.digest(fx.documents(spark, []), Scratch(spark, "t")).collect() == []


def test_bpe_query(spark):
    enc = fx.tiktoken_encoding()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in bpe.op9_byte_bpe(spark, SF).collect():
        ids = enc.encode(texts[r["doc_id"]], disallowed_special=())
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_language_pieces():
    """The table of transitions counts the same pieces as a greedy parse by substring search."""
    model = language.Model({"a": [fx.prose(1, 60)], "b": ["der hund läuft über die wiese und bellt laut"]})
    for text in ("amber birch wiese", fx.prose(4, 20), "zzz", "ü", "hund " * 90):
        codes = language._codes(text, model.table)
        for k, lang in enumerate(model.langs):
            train = np.append(language._codes({"a": fx.prose(1, 60), "b": "der hund läuft über die wiese und bellt laut"}[lang], model.table), np.uint8(0)).tobytes()
            n = 0
            for at in range(0, len(codes), language.BLOCK):
                block, i = codes[at : at + language.BLOCK].tobytes(), 0
                while i < len(block):
                    j = i + 1
                    while j <= len(block) and block[i:j] in train:
                        j += 1
                    i = max(i + 1, j - 1)
                    n += 1
            assert model.pieces([codes])[0][k] == n


def test_language_beyond_the_bmp():
    model = language.Model({"a": [fx.prose(1, 60)], "b": ["der hund läuft über die wiese und bellt laut"]})
    langs, scores = model.predict(["\U0001f600\U0001f680", "\U0001d7d8\U0001f9ff 12", "\U00020000\U00020001", "hund \U0001f600 wiese"])
    assert langs[:2] == ["und", "und"] and scores[:2] == [0, 0] and langs[2] != "und" and langs[3] == "b"


def test_many_languages_keep_their_labels(spark):
    """More labels than whole samples would fit: all can be predicted."""
    texts = {f"l{k:03}": " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{w}" for w in fx.WORDS) for k in range(230)}
    docs = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(texts.items())], "doc_id long, text string, lang string")
    model = language.fit(docs, F.lit(True))
    assert model.langs == sorted(texts)
    assert model.predict(list(texts.values()))[0] == list(texts)


def test_language_query(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang", "text")
    out = docs.select("doc_id", "lang").join(language.op7_language(spark, LARGER), "doc_id").where("lang is not null and lang_pred != 'und'").collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (binascii.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in out)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)


def test_language_odd_rows(spark):
    docs = fx.documents(spark)
    predict = language.predictor(spark, language.fit(docs, F.lit(True)))
    out = docs.select("text", predict("text").alias("p")).collect()
    assert {r["p"]["lang"] for r in out if not any(c.isalpha() for c in r["text"] or "")} == {"und"}
    assert {r["p"]["lang"] for r in out if any(c.isalpha() for c in r["text"] or "")} == {"en"}
    none = language.predictor(spark, language.fit(fx.documents(spark, []), F.lit(True)))
    assert {r["p"]["lang"] for r in docs.select(none("text").alias("p")).collect()} == {"und"}


def test_toxicity_query(spark):
    """On the table with some hundred toxic rows to learn from; with a few dozen (sf0.01) the classifier has too little to go by."""
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    out = toxicity.op4_toxicity(spark, "/root/testdata/sf0.1").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (binascii.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    held = [(r["score"], labels[r["doc_id"]]) for r in out if r["held_out"] and labels.get(r["doc_id"]) is not None]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([[(p > n) + 0.5 * (p == n) for n in neg] for p in pos]) if pos and neg else 1
    assert auc >= 0.93


def test_toxicity_odd_rows(spark):
    docs, labels = fx.documents(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model, cuts, general = toxicity.train(docs, labels, F.lit(True))
    out = docs.select("text", toxicity.scorer(spark, model)("text").alias("s")).collect()
    assert len(out) == docs.count() and all(0 <= r["s"] <= 1 for r in out)
    some = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (4, 1, 0), (None, 1, 1), (8, 1, None), (10, 0, 1), (11, 0, 0)], "doc_id long, quality int, toxic int")
    model, cuts, general = toxicity.train(docs, some, F.lit(True))
    by = {}
    for r in docs.select("text", toxicity.scorer(spark, model)("text").alias("s")).collect():
        assert 0 <= r["s"] <= 1 and by.setdefault(r["text"], r["s"]) == r["s"]


def test_toxicity_learns_from_every_row(spark, monkeypatch):
    """Toxic rows that are all longer than the texts of a former sample, over several shards."""
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 200)
    monkeypatch.setattr(toxicity, "STEP_TEXTS", 8)
    rows = [(i, fx.prose(i, 1_100) + (" grolsk vantib" if i % 3 == 0 else "")) for i in range(480)]
    assert min(len(t) for _, t in rows) > 6_000
    docs = spark.createDataFrame([(d, t, "en") for d, t in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, 0, int(d % 3 == 0)) for d, _ in rows], "doc_id long, quality int, toxic int")
    model, cuts, general = toxicity.train(docs, labels, F.lit(True))
    tried = spark.createDataFrame([(i, fx.prose(900 + i, 60) + (" grolsk vantib" if i % 2 else "")) for i in range(20)], "doc_id long, text string")
    scores = {r["doc_id"]: r["s"] for r in tried.select("doc_id", toxicity.scorer(spark, model)("text").alias("s")).collect()}
    assert min(s for i, s in scores.items() if i % 2) > max(s for i, s in scores.items() if not i % 2)
    assert [r["lang"] for r in cuts.collect()] == ["en"]


PAGES = [
    (None, ""), ("", ""), ("<p>plain  text\n here</p>", "plain text here"),
    ("<html><body><nav><li>Home</li></nav><article><h1>A &amp; B</h1><p>First <b>bold</b> line.</p><p>x</p><script>no()</script></article><footer>foot</footer></body></html>", "A & B\nFirst bold line.\nx"),
    ("<main><p>one<br>two</p><!-- gone --><div class='comments'><p>reader</p></div><aside>ad</aside><form>f</form></main>", "one two"),
    ("<article><p>open <b>never closed<p>next &#233;&nbsp;z", "open never closed\nnext é z"),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_html_pages(page, want):
    assert html.extract(page) == want


LONG = fx.prose(1, 30)
OTHER = fx.prose(2, 30)
LINKS = "<ul>" + "".join(f"<li><a href='/{k}'>{fx.prose(k, 4)}</a></li>" for k in range(5)) + "</ul>"
FORMS = [
    # no mark: both regions around a list of links, and no link list at the top
    (f"<body>{LINKS}<div><p>{LONG}</p></div>{LINKS}<div><p>{OTHER}</p></div></body>", f"{LONG}\n{OTHER}"),
    # a paragraph that is a link, inside a region
    (f"<div><p>{LONG}</p><p><a href='x'>{fx.prose(7, 9)}</a></p><p>{OTHER}</p></div>", f"{LONG}\n{fx.prose(7, 9)}\n{OTHER}"),
    # classes that only sound like noise, and wrappers of an article
    (f"<article><div class='article-header'><h1>Title here</h1></div><p class='ad-hoc'>{LONG}</p><p class='legal' id='article-header'>{OTHER}</p></article>", f"Title here\n{LONG}\n{OTHER}"),
    (f"<div class='content has-sidebar no-comments'><p>{LONG}</p></div>", LONG),
    (f"<div class='page sidebar'><div class='menu'>m</div><article><p>{LONG}</p></article></div>", LONG),
    # real noise
    (f"<div class='cookie-banner'>{OTHER}</div><article><p>{LONG}</p><div class='commentList'><p>{OTHER}</p></div><div class='ad-container'>{OTHER}</div><div class='social-share'>x</div></article><div id='site-footer'>{OTHER}</div>", LONG),
    # a teaser in an article does not mark the page
    (f"<article><a href='/t'>Teaser</a></article><div><p>{LONG}</p><p>{OTHER}</p></div>", f"{LONG}\n{OTHER}"),
    # a page that is noise all over
    (f"<div class='widget'><p>{LONG}</p></div>", LONG),
]


@pytest.mark.parametrize(("page", "want"), FORMS)
def test_html_forms(page, want):
    assert html.extract(page) == want


@pytest.mark.parametrize("seed", range(30))
def test_html_block_sums(seed):
    """Surge and dive points against a look at every window."""
    r = np.random.default_rng(seed)
    weight = r.choice([0, 0, 5, 20, 70, 200], size=int(r.integers(1, 40)))
    n = len(weight)
    sums = [int(weight[i : i + 3].sum()) for i in range(n)]
    limit = 80 if max(sums) > 80 else 0
    inside, want, start = False, [], 0
    for i in range(n + 1):
        now = i < n and sums[i] > (0 if inside else limit)
        if now and not inside:
            start = i
        if inside and not now:
            heavy = [k for k in range(start, i) if weight[k]]
            want.append((heavy[0], heavy[-1] + 1))
        inside = now
    assert html.regions(weight, 3, 80) == want


def test_html_column(spark):
    df = spark.createDataFrame([(k, p) for k, (p, _) in enumerate(PAGES)] + [(50, "<p>" + fx.prose(1, 40_000) + "</p>")], "page_id int, html string")
    got = {r["page_id"]: r["t"] for r in df.select("page_id", html.main_text("html").alias("t")).collect()}
    assert got == {k: w for k, (_, w) in enumerate(PAGES)} | {50: fx.prose(1, 40_000)}
    assert html.op3_html_text(spark, SF).where("n_chars != length(text)").count() == 0


def test_urls(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "https://a.com/en/x", None), (2, "https://A.Example.COM/en/7?q", ""), (3, "http://example.com/en/8", None), (4, None, None), (5, "no scheme", None), (6, "https://b.net/de/8", None),
        (7, "https://example.net/de/81#f", None), (8, "https://org/es/", None), (9, "https://forg/es/", None), (10, "https://alias.io/p", link.format("https://a.com/en/x")),
        (11, "https://far.io/q", link.format("https://alias.io/p?utm_source=1")), (12, "https://mixed.io/", link.format("https://a.com/en/y")), (13, "https://a.com/en/y", link.format("https://example.com/en/7")), (1, "https://a.com/en/x", None),
    ]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string").withColumns({"addr": F.lit(1), "component": F.lit(1), "host": F.lit("z")})
    # without the normal forms, the link to a tracked url is no link to its page
    assert {r["page_id"]: r["verdict"] for r in urls.judge(pages, Scratch(spark, "t")).collect()}[11] == "allow"
    out = urls.judge(pages, Scratch(spark, "t"), normal=True)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert out.count() == len(rows)
    assert got == {
        1: ("a.com", "/en/x", "com/en/", "block"), 2: ("a.example.com", "/en/7", "example.com/en/7", "allow"), 3: ("example.com", "/en/8", "com/en/", "block"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"),
        6: ("b.net", "/de/8", "net/de/", "allow"), 7: ("example.net", "/de/81", "example.net/de/8", "block"), 8: ("org", "/es/", "org/es/", "block"), 9: ("forg", "/es/", None, "allow"),
        10: ("alias.io", "/p", None, "block"), 11: ("far.io", "/q", None, "block"), 12: ("mixed.io", "/", None, "allow"), 13: ("a.com", "/en/y", "com/en/", "block"),
    }
    redirects = spark.createDataFrame([("https://forg/es/", "https://org/es/"), (None, "https://x.y/")], "from_url string, to_url string")
    assert urls.judge(pages, Scratch(spark, "t"), redirects=redirects).where("page_id = 9").first()["verdict"] == "block"
    assert urls.judge(pages.limit(0), Scratch(spark, "t")).collect() == []


def luhn(n: str) -> bool:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(n))) % 10 == 0


def test_pii(spark):
    rows = [
        (1, "card 4111 1111 1111 1111, again 4111111111111111"), (2, "card 4111-1111-1111-1111"), (3, "on 2024-02-29 and 29.02.2024 and 02/29/2024"), (4, "not 2024-02-31 nor 300.1.1.1"), (5, None), (6, ""),
        (7, "ip 10.0.0.1 mail Jo.Doe@example.org ssn 078-05-1120 call (212) 555-0100"), (8, "x" * 50_000 + " 2020-01-01"), (9, "no data"), (7, "ip 10.0.0.1"),
    ]
    out = pii.pseudonymise(spark.createDataFrame(rows, "doc_id int, text string").withColumns({"n": F.lit(1), "s": F.lit(1), "_found": F.lit(2), "_new": F.lit(3), "n_replaced": F.lit(4)}), "secret")
    assert out.columns[-1] == "n_replaced_" and out.where("_found = 2 and _new = 3 and n_replaced = 4").count() == len(rows)
    got = {(r["doc_id"], len(r["text"] or "")): r for r in out.collect()}
    by = {}
    for (d, _), r in got.items():
        by.setdefault(d, r["text"])
    a, b = by[1].removeprefix("card ").split(", again ")
    assert a != "4111 1111 1111 1111" and a.replace(" ", "") == b == by[2].removeprefix("card ").replace("-", "") and luhn(b)
    import datetime as dt

    x, y, z = by[3].removeprefix("on ").split(" and ")
    assert dt.datetime.strptime(x, "%Y-%m-%d") == dt.datetime.strptime(y, "%d.%m.%Y") == dt.datetime.strptime(z, "%m/%d/%Y") and x != "2024-02-29"
    assert by[4] == rows[3][1] and by[5] is None and by[6] == "" and by[9] == "no data" and "2020-01-01" not in by[8] and len(by[8]) == 50_011
    assert not any(v in by[7] for v in ("10.0.0.1", "Jo.Doe", "078-05-1120", "555-0100")) and "@example.org" in by[7]
    assert pii.pseudonymise(spark.createDataFrame([], "doc_id int, text string"), "secret").collect() == []
    with pytest.raises(ValueError, match="key"):
        pii.pseudonymise(out, "")


def pii_reference(text):
    """What may change: the matches of the formats that pass their check, looked at one by one."""
    import datetime as dt
    import ipaddress
    import re

    spans = []
    for m in re.finditer(pii.ANY, text or ""):
        x = m[0]
        if re.fullmatch(pii.NUMBER, x) and not any(re.fullmatch(p, x) for p in (pii.PHONE, pii.SSN, pii.DATE, pii.IPV4)) and not luhn(re.sub(r"\D", "", x)):
            continue
        if re.fullmatch(pii.DATE, x):
            form = "%d.%m.%Y" if "." in x else "%m/%d/%Y" if "/" in x else "%Y-%m-%d"
            try:
                dt.datetime.strptime(x, form)
            except ValueError:
                continue
        if re.fullmatch(pii.IPV4, x):
            ipaddress.ip_address(x)
        spans.append(m.span())
    return spans


def test_no_plan_shows_the_key(spark):
    secret = "a-key-that-nobody-should-read"
    docs = spark.createDataFrame([(1, "call (212) 555-0199 or mail a@b.example", 5)], "doc_id long, text string, _key int")
    out = pii.pseudonymise(docs, secret)
    assert out.columns == ["doc_id", "text", "_key", "n_replaced"]
    (row,) = out.collect()
    assert row["n_replaced"] == 2 and row["_key"] == 5 and pii.pseudonymise(docs, secret).collect() == [row] != pii.pseudonymise(docs, "other").collect()
    for seen in (out._jdf.queryExecution().toString(), out._jdf.queryExecution().executedPlan().treeString(), out._jdf.queryExecution().optimizedPlan().treeString()):
        assert secret not in seen


def test_pii_query(spark):
    """The whole table: only validated values change, in their places and formats, and equal ones alike."""
    spark.conf.set(pii.KEY_SETTING, "secret")
    try:
        docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
        out = {r["doc_id"]: r for r in pii.op6_pii(spark, LARGER).collect()}
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    seen, changed = {}, 0
    assert set(out) == set(docs)
    for d, text in docs.items():
        new, at, shift, n = out[d]["text"] or "", 0, 0, 0
        for a, b in pii_reference(text):
            assert new[at + shift : a + shift] == text[at:a]
            mail = "@" in text[a:b]
            value = text[a:b]
            after = new[a + shift : new.index("@", a + shift) + len(value) - value.index("@")] if mail else new[a + shift : b + shift]
            if value.count(".") == 3 and not mail:  # octets of other lengths
                import re

                after = re.match(pii.IPV4, new[a + shift :])[0]
            elif not mail and not value.startswith("AKIA"):
                assert [c.isdigit() for c in after] == [c.isdigit() for c in value]
            assert seen.setdefault(value, after) == after
            n += after != value
            shift += len(after) - len(value)
            at = b
        assert new[at + shift :] == text[at:]
        assert out[d]["n_replaced"] == n
        changed += n
    assert changed > 0 and len(set(seen.values())) == len(seen)


def test_feistel_is_a_permutation(spark):
    for lm, rm in ((7, 11), (1, 5), (10, 10)):
        df = spark.range(lm).withColumnRenamed("id", "l").crossJoin(spark.range(rm).withColumnRenamed("id", "r"))
        out = {tuple(r["s"])[:2] for r in df.select(pii.feistel(F.col("l"), F.col("r"), F.lit(lm), F.lit(rm), "k", "t").alias("s")).collect()}
        assert out == {(x, y) for x in range(lm) for y in range(rm)}


def test_very_many_languages(spark, monkeypatch):
    """The model has a bound, whatever the number of labels: the languages of most rows stay, and all texts get one of these."""
    monkeypatch.setattr(language, "MAX_LANGS", 40)
    one = spark.range(20_000).select((F.col("id") + 1000).alias("doc_id"), F.concat(F.lit("dirty label number "), F.col("id").cast("string")).alias("text"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("lang"))
    words = {"aa": "amber birch cedar delta", "bb": "quartz river stone tidal"}
    two = spark.createDataFrame([(k, f"{words[lang]} {k} {words[lang]}", lang) for k, lang in enumerate(["aa", "bb"] * 30)], "doc_id long, text string, lang string")
    model = language.fit(one.unionByName(two), F.lit(True))
    assert len(model.langs) == 40 and {"aa", "bb"} < set(model.langs)
    predict = language.predictor(spark, model)
    assert [r[0] for r in two.orderBy("doc_id").limit(4).select(predict("text")["lang"]).collect()] == ["aa", "bb"] * 2


def test_bpe_digests_apart(spark, monkeypatch):
    """Encoded and decoded in plans of their own, with the same rows: one Python worker a task."""
    docs, plans, save = spark.read.parquet(f"{SF}/documents.parquet"), {}, Scratch.save

    def saved(self, df, name="t"):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return save(self, df, name)

    want = sorted(bpe.digest(docs, Scratch(spark, "bpe")).collect())
    monkeypatch.setattr(Scratch, "save", saved)
    assert sorted(bpe.digest(docs, Scratch(spark, "bpe"), apart=True).collect()) == want
    assert "encode(" not in plans["digests"] and "decode(" in plans["digests"] and "decode(" not in plans["ids"]
