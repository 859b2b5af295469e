"""Tables of bits against the shapes that they stand for, and plans whose methods the JVM compiles."""

import random
import re
import re._constants as C
import re._parser as P

import pytest
from pyspark.sql import functions as F

from tracelens import queries
from tracelens.functions import ids

SPACE = frozenset([*map(ord, " \t\n\r\f\v"), ids.BEYOND])
DIGIT = frozenset([*map(ord, "0123456789"), ids.BEYOND])
WORD = DIGIT | {*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), ord("_")}
ALL = frozenset(range(ids.BEYOND + 1))
CLASSES = {C.CATEGORY_DIGIT: DIGIT, C.CATEGORY_WORD: WORD, C.CATEGORY_SPACE: SPACE}


def one_of(items) -> frozenset:
    out, turned = set(), False
    for op, a in items:
        if op is C.NEGATE:
            turned = True
        else:
            out.update({C.LITERAL: lambda a: {a}, C.RANGE: lambda a: range(a[0], a[1] + 1), C.CATEGORY: lambda a: CLASSES[a]}[op](a))
    return (ALL - out) | {ids.BEYOND} if turned else frozenset(out)


def letters(shape) -> tuple[set, set, bool]:
    """What a shape may begin with and hold, and whether it may be empty."""
    first, held, empty = set(), set(), True
    for op, a in shape:
        if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            continue
        if op in (C.LITERAL, C.NOT_LITERAL, C.IN):
            f = h = one_of([(C.NEGATE, None), (C.LITERAL, a)] if op is C.NOT_LITERAL else a if op is C.IN else [(op, a)])
            e = False
        elif op is C.BRANCH:
            parts = [letters(x) for x in a[1]]
            f, h, e = set().union(*[x[0] for x in parts]), set().union(*[x[1] for x in parts]), any(x[2] for x in parts)
        else:
            f, h, e = letters(a[-1])
            e = e or (op is not C.SUBPATTERN and a[0] == 0)
        first |= f if empty else set()
        held, empty = held | h, empty and e
    return first, held, empty


@pytest.mark.parametrize("kind", ids.KINDS)
def test_letters_of_a_kind(kind):
    assert letters(P.parse(ids.SHAPES[kind])) == (ids.FIRST[kind], ids.HELD[kind], False)


MADE = [
    "PAY-1234567", "ab-" + "b" * 8 + "-bcdfg", "C0123456789", "D012345678", "U012345678", "Q" + "A" * 13, "P123456", "404", "a.b@c.d", "http://x", "#ab", "AnError", "1.2.3", "git@a:b/c", "github.com/a/b", "a/b#1", "./a.py:1", "/a/b", "a.b.C", "a.b.c", "a@1.2", "p==1.2", "a/b:c",
    "sha256:" + "a" * 64, "arn:aws:s3:::b", "i-" + "0" * 8, "s3://b", "gs://b", "ns/a", "job/a", "00:1b:44:11:3a:b7", "a::b", "::1", "1:2:3:4:5:6:7:8", "1.2.3.4/8", "1.2.3.4", "a.bc:12", "a.b.co", "01" + "A" * 24, "abc" + "0" * 21, "12" + "0" * 16, "170" + "0" * 10, "1700000000",
    "00-" + "1" * 32 + "-" + "2" * 16 + "-01", "1A" + "x" * 31, "a_sum", '{a=""}', "WARN", "P1D", "PT1H", "P", "now-1m", "*\t* * * *", "*/5 1 2 3 4", "1 2 3 4 5 6 *", "#a1b2c3", "ghp_" + "a" * 36, "xoxb-" + "1" * 10, "ASIA" + "A" * 16, "sk-" + "a" * 20, "AIza" + "x" * 35,
    "eyJ" + "a" * 10 + "." + "b" * 10 + "." + "c" * 10, "-----BEGIN PRIVATE KEY-----", "Bearer " + "a" * 20, "2024-01-10", "2024-01-10T10:00:00Z", "1700000000.000100", "٤٠٤", "x٤-٤", "0123456789abcdef", "abc1234", "f" * 39 + "1", "3f2504e0-4f89-11d3-9a0c-0305e82c3301", "plain", "", "é" * 7, "a/￿:b",
    "payments-7d4b9c6f5d-x2k9p", "7d4b9c6f5d", "x/y:1.2", "org.ex.Order", "￿", "😀",
]


def test_typed_is_type_of(spark):
    rnd = random.Random(8)
    values = [*MADE, None, *[rnd.choice(MADE) + rnd.choice(["é", ".", "/", "x", ", ", "", "1"]) + rnd.choice(MADE) for _ in range(600)], *["".join(rnd.choices("aB1٤é-./:_#@ ", k=rnd.randint(1, 80))) for _ in range(600)]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v string")
    bare = F.array(*[F.when(F.col("v").rlike(f"(?U)^(?:{ids.SHAPES[k]})\\z"), F.lit(k)) for k in ids.KINDS])
    rows = ids.typed(df, "v").withColumn("want", F.get(F.array_compact(bare), F.lit(0))).collect()
    assert [(r["v"], r["kind"]) for r in rows] == [(r["v"], r["want"]) for r in rows] and len(rows) == len(values)
    assert set(ids.KINDS) - {r["kind"] for r in rows} <= {"trace_id", "epoch_s", "slack_ts"}


def longest_method(spark, df) -> int:
    """The bytes of the longest method of a plan; the JVM compiles none of more than 8,000."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = spark._jvm.PythonSQLUtils.explainString(df.alias("x").select("*")._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", plan)]
    assert sizes
    return max(sizes)


def orders(spark, tmp_path, rows: int) -> str:
    spark.range(rows).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def test_values_are_made_and_typed_in_methods_that_are_compiled(spark, tmp_path):
    df = queries.QUERIES["more_typed_values"](spark, orders(spark, tmp_path, 60_000))
    assert longest_method(spark, df) < 8000
    assert df.rdd.getNumPartitions() == 3, "a file of few bytes is no single task"


def test_found_among_all_pairs(spark):
    """Every pair of a match and a longer one around it may be one, and what is found is what none covers; also beside the marks that the search makes."""
    rnd = random.Random(5)
    texts = [rnd.choice([" ", "", "\t"]).join(rnd.choice(MADE) + rnd.choice([" ", "-", ", ", "/", ":", " ", "\x01", "\x02", ""]) for _ in range(rnd.randint(1, 6))) for _ in range(500)]
    texts += ['{a="1 2 3 * 5"} 1 2 3 * 5', '1 2 3 4 5 6 * {a="1 2 3 4 5", b="*"}', "x/y:1.2 https://x/y:1.2 x/y:1.2", "00-" + "1" * 32 + "-" + "2" * 16 + "-01.example.org", "\x01abc1234\x02 abc1234", "http://x\x01y/a/b:c\x02"]
    df = spark.createDataFrame([*enumerate(texts), (9000, None)], "id long, t string")
    at = {}
    for r in ids.spans(df, "id", "t").collect():
        at.setdefault(r["id"], []).append((r["start"], r["end"], r["kind"], r["ord"], r["value"]))
    around = lambda f, c: c[0] <= f[0] and f[1] <= c[1] and c[1] - c[0] > f[1] - f[0]
    pairs = {(c[2], f[2]) for found in at.values() for f in found for c in found if c[2] != f[2] and around(f, c)}
    assert len(pairs) > 50 and all(ids._may_cover(*p) for p in pairs)
    for kind in ("k8s_pod", "docker_image", "cron_expr", "sha_short", "traceparent", "http_status", "url"):
        got, want, before = {}, {}, ids.KINDS.index(kind)
        for r in ids.find_all(df, "id", "t", kind).orderBy("id", "n").collect():
            got.setdefault(r["id"], []).append(r["value"])
        for i, found in at.items():
            over = [c for c in found if c[2] != kind and (c[3] < before or c[2] == "k8s_pod")]
            free = [f[4] for f in sorted(found) if f[2] == kind and not any(around(f, c) for c in over)]
            want |= {i: list(dict.fromkeys(free))} if free else {}
        assert got == want, kind


def test_lines_are_searched_by_few_shapes_in_many_tasks(spark, tmp_path):
    df = queries.QUERIES["found_in_text"](spark, orders(spark, tmp_path, 60_000))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") < 60
    assert longest_method(spark, df) < 8000
    assert df.rdd.getNumPartitions() == 6 * 3
