"""Joins along ordered streams and by indexed parts against plain versions that look at all pairs."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tracelens.functions import extract
from tracelens.operators import binding, lifecycle, reports, search


def plain_gazetteer(text, names):
    norm = lambda s: s.lower().replace("_", "-")
    canon = {}
    for a, n in names:
        canon[norm(a)] = min(n, canon.get(norm(a), n))
    alts = sorted((a for a in canon if re.search(r"\w|-", a)), key=len, reverse=True)
    rx = re.compile(r"(?<![\w-])(" + "|".join(map(re.escape, alts)) + r")(?![\w-])")
    return list(dict.fromkeys(canon[m[1]] for m in rx.finditer(norm(text or ""))))


def test_gazetteer_of_a_hub_table(spark):
    rnd = random.Random(2)
    words = ["pay", "api", "web", "Web_App", "é-x", "svc", "#ops", "(eu)", "a.b", "x"]
    names = [("pay api", "1"), ("pay-api", "2"), ("PAY_API", "3"), ("web", "w"), ("web app", "wa"), ("web_app", "wb"), ("#ops", "ops"), ("api (eu)", "eu"), ("É_X", "e"), ("a.b", "dot"), ("never seen", "no"), ("!!", "marks"), ("pay  api", "two"), ("web web web", "www"), ("svc", "s"), ("svc, svc", "ss")]
    texts = [(i, "".join(rnd.choice(words) + rnd.choice([" ", " ", "  ", "-", ", ", "/", "\n"]) for _ in range(rnd.randint(0, 9)))) for i in range(400)]
    texts += [(900, None), (901, ""), (902, "web"), (902, "svc"), (903, "xweb web"), (904, "web-web"), (905, "#ops##ops")]
    df = spark.createDataFrame(texts, "id long, t string")
    hub = spark.createDataFrame(names, "alias string, name string")
    got = {}
    for r in extract.gazetteer(df, "id", "t", hub).orderBy("id", "n").collect():
        got.setdefault(r["id"], []).append((r["n"], r["name"]))
    for i, t in texts:
        if i != 902:
            assert got.get(i, []) == list(enumerate(plain_gazetteer(t, names), 1)), t
    assert sorted(n for _, n in got[902]) == ["s", "w"]
    assert extract.gazetteer(df, "id", "t", []).collect() == []
    assert "Collect" not in extract.gazetteer(df, "id", "t", hub)._jdf.queryExecution().executedPlan().toString()


ROUND = {"exact": lambda t: t, "1d": lambda t: t.replace(hour=0, minute=0, second=0), "1h": lambda t: t.replace(minute=0, second=0)}


def options(t, a):
    for n, (unit, step) in enumerate((("exact", 900), ("1d", 86400), ("1h", 1800))):
        anchor = ROUND[unit](a)
        d = int((t - anchor).total_seconds())
        if abs(d) <= 30 * 86400 and d % step == 0 and (unit == "exact" or anchor != a):
            return n, abs(d), unit, d
    return None


def test_windows_of_random_times(spark):
    rnd = random.Random(4)
    base = dt.datetime(2024, 3, 1)
    when = lambda: base + dt.timedelta(days=rnd.choice([0, 1, 29, 30, 31, 60, 61]), minutes=rnd.choice([0, 15, 30, 45, 60, 7, 90, 1425]), hours=rnd.choice([0, 0, 5]))
    times = [(e, at, when()) for e in range(40) for at in rnd.sample(range(30), 6)]
    anchors = [(e, at, f"p{k % 3}", bool(k % 2), when()) for e in range(40) for k, at in enumerate(rnd.choices(range(30), k=9))]
    t = spark.createDataFrame(times + [(1, 99, None)], "e long, at long, t timestamp").withColumn("arg", F.lit("x"))
    a = spark.createDataFrame(anchors + [(1, 0, "p0", False, None)], "e long, at long, path string, in_list boolean, t timestamp")
    want, settled = {}, {}
    for e, at, x in times:
        found = [((src, *o[:2]), (src, o[2], o[3])) for f, src, _, _, y in anchors if f == e and src < at and (o := options(x, y))]
        if found:
            want[e, at] = min(found)[1]
    got = {(r["e"], r["at"]): (r["src"], r["round"], r["delta"]) for r in binding.bind_windows(t, a, ["e"]).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][2]) == abs(want[k][2]) and got[k][1] == want[k][1] for k in want)
    for e in range(40):
        fits = [(src, lst, y, path) for f, at, x in times if f == e for g, src, path, lst, y in anchors if g == e and src < at and options(x, y)]
        if fits:
            src, _, _, path = min(fits)
            for f, at, x in times:
                found = [o for g, s, p, _, y in anchors if (f, g, s, p) == (e, e, src, path) and s < at and (o := options(x, y))]
                if found:
                    settled[e, at] = (src, path, min(found)[2], min(found)[3])
    got = {(r["e"], r["at"]): (r["src"], r["path"], r["round"], r["delta"]) for r in binding.session_windows(t, a, ["e"]).collect()}
    assert got == settled and len(settled) > 20


def test_on_call_of_random_shifts(spark):
    rnd = random.Random(6)
    shifts = [(k, s := rnd.randint(0, 40), s + rnd.randint(0, 12), rnd.choice("abc")) for k in range(30) for _ in range(rnd.randint(0, 6))]
    asks = [(k, t) for k in range(30) for t in rnd.choices(range(-2, 60), k=8)]
    got = search.on_call(spark.createDataFrame(asks, "k long, t long"), spark.createDataFrame(shifts, "k long, s long, e long, p string"), ["k"], "t", "s", "e", "p").collect()
    want = []
    for k, t in asks:
        mine = [x for x in shifts if x[0] == k]
        hold = [(s, p) for _, s, e, p in mine if s <= t < e]
        want.append((k, t, min(hold)[1] if hold else max((s, p) for _, s, _, p in mine)[1] if mine else None))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_provenance_of_random_texts(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abé1") for _ in range(rnd.randint(1, 7)))
    origins = [(r, at, rnd.choice([word(), "12345", "aaaaa", None])) for r in range(20) for at in range(12)]
    uses = [(r, u, rnd.randint(0, 14), rnd.choice([word(), " ".join(word() for _ in range(9)), "x12345x aaaaaa", None, ""])) for r in range(20) for u in range(8)]
    got = reports.provenance(spark.createDataFrame(origins, "r long, at long, value string"), spark.createDataFrame(uses, "r long, use long, at long, text string"), ["r"]).collect()
    want = {}
    for r, u, at, text in uses:
        for q, o, v in origins:
            if q == r and o < at and v is not None and text is not None and (v == text or (len(v) >= 5 and not v.isdigit() and v in text)):
                want[r, u, v] = max(o, want.get((r, u, v), -1))
    assert {(x["r"], x["use"], x["value"]): x["origin"] for x in got} == want and len(want) > 20


def test_repeats_by_counts(spark):
    rows = [(k, (k * 7 + i * i) % 5) for k in range(9) for i in range(k + 1)]
    got = {r["k"]: (r["most"], r["median"]) for r in reports.repeats(spark.createDataFrame(rows, "k long, n long"), ["k"], "n").collect()}
    for k in range(9):
        n = sorted(x for q, x in rows if q == k)
        assert got[k] == (n[-1], n[len(n) // 2])


@pytest.mark.parametrize("stretch", [2, 3, 1000])
def test_fold_in_stretches(spark, stretch):
    """Histories of any length, cut anywhere, for every level that an author allows."""
    rnd = random.Random(stretch)
    rows = []
    for f in range(30):
        bad = rnd.choice([0.03, 0.2, 0.5])
        for i in range(rnd.choice([1, 2, 7, 40])):
            rows.append((f, i, rnd.choice(["run", "run", "test", "feedback"]), rnd.random() > bad, f % 3))
    got = lifecycle.fold(spark.createDataFrame(rows, "flow long, i long, kind string, ok boolean, author int"), ["flow"], ["i"], F.col("author"), stretch)
    want = {}
    for f, _, kind, ok, author in rows:
        level, streak, runs, clean, failed = want.get(f, (0, 0, 0, 0, 0))
        if not ok:
            level, streak = max(0, level - 1), 0
        elif kind == "run":
            streak += 1
            if level < author and streak >= (2 if level == 0 else 5):
                level, streak = level + 1, 0
        want[f] = (level, streak, runs + (kind == "run"), clean + (kind == "run" and ok), failed + (kind == "run" and not ok))
    assert {r["flow"]: (lifecycle.LEVELS.index(r["status"]), r["streak"], r["runs"], r["clean"], r["failed"]) for r in got.collect()} == want


def test_provenance_places_go_without_their_text(spark):
    """The rows of a text's places do not carry it; a place is met by a value of its own text only."""
    origins = spark.createDataFrame([(1, 0, "amber birch"), (1, 1, "amber"), (1, 1, "123456"), (1, 0, "ab"), (1, 3, "amber")], "r long, at long, value string")
    uses = spark.createDataFrame([(1, 7, 2, "an amber birch"), (1, 7, 2, "amber"), (1, None, 2, "123456"), (1, 8, 2, "ab"), (1, 9, 2, "cab 1234567")], "r long, use long, at long, text string")
    got = reports.provenance(origins, uses, ["r"])
    assert sorted((r["use"] or 0, r["value"], r["origin"]) for r in got.collect()) == [(0, "123456", 1), (7, "amber", 1), (7, "amber birch", 0), (8, "ab", 0)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    held = [x for x in plan.split("\n") if "Contains(text" in x]
    assert held and not any("_head" in x for x in held)
