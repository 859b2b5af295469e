"""Format-preserving pseudonyms for personal data, by a keyed Feistel network.

Numbers and dates that pass their check are permuted within their own format: the
value becomes a pair (left, right) of bounded integers, each round adds a keyed
hash of one half to the other one modulo its bound, and the pair is written back.
That is a bijection of the format, so equal values stay equal across documents
and different ones stay different, and the result still passes the check:

* payment card and other 13 to 19 digit numbers with a right Luhn digit: all but that
  digit, which is set anew; other long numbers (order numbers, times) stay as they are,
* North American phone numbers: area code and number, first digits 2 to 9 kept so,
* IPv4 addresses: 32 bits,
* social security numbers: nine digits without the blocks that are never issued,
* dates (2024-05-31, 31.05.2024, 05/31/2024): the day among 1900-01-01 to 2099-11-12.

E-mail addresses and access keys have no bounded format; their private part is
replaced by a keyed hash in the same alphabet.  Only DataFrame expressions are
used: texts without a digit or ``@`` are left as they are, and others are cut at
the matches, which are mapped and put back.

The key is secret: who has it can invert the permutations.  The query takes it from the
session's ``spark.tracelens.pii.key``; without one each run draws a key of its own, and
values are linked within that run.

Defined results: null stays null, an empty text stays empty; what fails its check
(such as 300.1.1.1 or 2024-02-31) is left alone; all other characters keep their place;
a text of any length is read whole; repeated rows change alike; columns of clashing
names are kept, and the new column's name gets underscores where it is taken.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

#: The session setting that holds the key.
KEY_SETTING = "spark.tracelens.pii.key"
ROUNDS = 10
EPOCH = "1900-01-01"
DAYS = 73_000  # = 200 * 365

# The formats, each bounded so that it does not start or end inside a longer word or number.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])"
ACCESS_KEY = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
PHONE = r"(?<![\d(+])(?:\+?1[ .-]?)?(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .-])[2-9]\d\d[ .-]\d{4}(?!\d)"
IPV4 = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)"
SSN = r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\d-])"
DATE = r"(?<![\d./-])(?:(?:19|20)\d\d-\d\d-\d\d|\d\d\.\d\d\.(?:19|20)\d\d|\d\d/\d\d/(?:19|20)\d\d)(?![\d/-]|\.\d)"
NUMBER = r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d]|[.-]\d)"
ANY = "|".join(f"(?:{p})" for p in (EMAIL, ACCESS_KEY, PHONE, IPV4, SSN, DATE, NUMBER))


def keyed(key: Column | str, *parts: Column | str) -> Column:
    """A 60-bit keyed hash."""
    text = F.concat_ws("|", F.lit(key), *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, left_mod: Column, right_mod: Column, key: Column | str, kind: str) -> Column:
    """struct(l, r): a keyed permutation of the pairs below (left_mod, right_mod).  The halves change places each round, so an even number of rounds restores them."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"), left_mod.cast("long").alias("lm"), right_mod.cast("long").alias("rm"))

    def turn(s: Column, i: Column) -> Column:
        moved = F.pmod(s["l"] + keyed(key, kind, i.cast("string"), s["lm"].cast("string"), s["rm"].cast("string"), s["r"].cast("string")), s["lm"])
        return F.struct(s["r"].alias("l"), moved.alias("r"), s["rm"].alias("lm"), s["lm"].alias("rm"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def luhn_digit(payload: Column) -> Column:
    """The check digit that completes a string of digits."""
    doubled = F.transform(F.split(F.reverse(payload), ""), lambda d, i: F.when(d == "", F.lit(0)).when(i % 2 == 0, d.cast("int") * 2 - F.when(d.cast("int") > 4, F.lit(9)).otherwise(F.lit(0))).otherwise(d.cast("int")))
    total = F.aggregate(doubled, F.lit(0), lambda a, d: a + d)
    return F.pmod(-total, F.lit(10))


def fill(shape: Column, new: Column) -> Column:
    """``shape`` with its digits replaced in order by the digits of ``new``."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))

    def step(acc: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(acc["s"], F.when(digit, F.substring(new, acc["k"], F.lit(1))).otherwise(c)).alias("s"), (acc["k"] + digit.cast("int")).alias("k"))

    return F.aggregate(F.split(shape, "(?!^)"), start, step, lambda a: a["s"])


def pad(x: Column, n: Column | int) -> Column:
    return F.lpad(x.cast("string"), n, F.lit("0") if isinstance(n, Column) else "0")


def _number(x: Column, key: Column) -> Column:
    d = digits(x)
    payload = F.substring(d, F.lit(1), F.length(d) - 1)
    n = F.length(payload)
    a = F.floor(n / 2).cast("int")
    lm, rm = F.pow(F.lit(10), a).cast("long"), F.pow(F.lit(10), n - a).cast("long")
    s = feistel(F.substring(payload, F.lit(1), a), F.substring(payload, a + 1, n - a), lm, rm, key, "number")
    new = F.concat(pad(s["l"], a), pad(s["r"], n - a))
    valid = luhn_digit(payload) == F.substring(d, -1, 1).cast("int")
    return F.when(valid, fill(x, F.concat(new, luhn_digit(new).cast("string")))).otherwise(x)


def _phone(x: Column, key: Column) -> Column:
    ten = F.substring(digits(x), -10, 10)
    # area code and exchange begin with 2 to 9: 800 area codes, then 800 exchanges of 10000 numbers
    s = feistel(F.substring(ten, 1, 3).cast("int") - 200, F.substring(ten, 4, 7).cast("int") - 2_000_000, F.lit(800), F.lit(8_000_000), key, "phone")
    new = F.concat((s["l"] + 200).cast("string"), (s["r"] + 2_000_000).cast("string"))
    return fill(x, F.concat(F.when(F.length(digits(x)) == 11, F.lit("1")).otherwise(F.lit("")), new))


def _ipv4(x: Column, key: Column) -> Column:
    o = F.transform(F.split(x, r"\."), lambda p: p.cast("int"))
    s = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65_536), F.lit(65_536), key, "ipv4")
    return F.concat_ws(".", *[y.cast("string") for half in (s["l"], s["r"]) for y in (F.floor(half / 256), half % 256)])


def _ssn(x: Column, key: Column) -> Column:
    area = F.substring(x, 1, 3).cast("int")
    # areas 001 to 899 without 666: 898 values; groups 01 to 99, serials 0001 to 9999
    s = feistel(area - 1 - (area > 666).cast("int"), (F.substring(x, 5, 2).cast("int") - 1) * 9_999 + F.substring(x, 8, 4).cast("int") - 1, F.lit(898), F.lit(99 * 9_999), key, "ssn")
    new = s["l"] + 1 + (s["l"] >= 665).cast("int")
    return F.concat_ws("-", pad(new, 3), pad(F.floor(s["r"] / 9_999) + 1, 2), pad(s["r"] % 9_999 + 1, 4))


def _date(x: Column, key: Column) -> Column:
    y = F.when(F.contains(x, F.lit(".")), F.concat_ws("-", F.substring(x, 7, 4), F.substring(x, 4, 2), F.substring(x, 1, 2))).when(
        F.contains(x, F.lit("/")), F.concat_ws("-", F.substring(x, 7, 4), F.substring(x, 1, 2), F.substring(x, 4, 2))).otherwise(x)
    day = F.datediff(y.try_cast("date"), F.to_date(F.lit(EPOCH)))
    s = feistel(F.floor(day / 365), day % 365, F.lit(200), F.lit(365), key, "date")
    new = F.date_add(F.to_date(F.lit(EPOCH)), (s["l"] * 365 + s["r"]).cast("int"))
    written = F.when(F.contains(x, F.lit(".")), F.date_format(new, "dd.MM.yyyy")).when(F.contains(x, F.lit("/")), F.date_format(new, "MM/dd/yyyy")).otherwise(F.date_format(new, "yyyy-MM-dd"))
    return F.when(day.between(0, DAYS - 1), written).otherwise(x)


def _email(x: Column, key: Column) -> Column:
    h = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(x)).cast("binary"), 256)
    return F.concat(F.lit("u"), F.substring(h, 1, 16), F.lit("@"), F.substring_index(x, "@", -1))


def _access_key(x: Column, key: Column) -> Column:
    h = F.upper(F.sha2(F.concat_ws("|", F.lit(key), F.lit("access"), x).cast("binary"), 256))
    return F.concat(F.lit("AKIA"), F.substring(h, 1, 16))


def pseudonym(x: Column, key: Column) -> Column:
    """The pseudonym of one match of ``ANY``."""
    whole = lambda p: x.rlike(f"^(?:{p})$")
    return (
        F.when(F.contains(x, F.lit("@")), _email(x, key)).when(F.startswith(x, F.lit("AKIA")), _access_key(x, key)).when(whole(IPV4), _ipv4(x, key)).when(whole(DATE), _date(x, key))
        .when(whole(SSN), _ssn(x, key)).when(whole(PHONE), _phone(x, key)).otherwise(_number(x, key))
    )


def session_key(spark: SparkSession) -> str:
    """The configured key, or a random one for this run."""
    return spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)


def pseudonymise(docs: DataFrame, key: str, text: str = "text", n_out: str = "n_replaced") -> DataFrame:
    """``docs`` with the personal data of ``text`` replaced, and the number of values that changed as the last column.

    The key comes from a table of one row by a scalar subquery, so that no plan, and no event log of one, shows it.
    """
    if not key:
        raise ValueError("a key is needed")
    found, new, n_out, secret = fresh(docs, "_found"), fresh(docs, "_new"), fresh(docs, n_out), fresh(docs, "_key")
    t = F.col(text)
    matches = F.when(t.rlike("[@0-9]"), F.regexp_extract_all(t, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    some = F.size(found) > 0
    hidden = docs.sparkSession.createDataFrame([(key,)], "k string").scalar()
    out = docs.withColumn(secret, hidden).withColumn(found, matches).withColumn(new, F.when(some, F.transform(found, lambda x: pseudonym(x, F.col(secret)))).otherwise(F.col(found)))
    pieces = F.zip_with(F.split(t, ANY, -1), F.col(new), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    changed = F.aggregate(F.zip_with(found, new, lambda a, b: (a != b).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)
    out = out.withColumn(n_out, F.coalesce(changed, F.lit(0).cast("long"))).withColumn(text, F.when(some, F.array_join(pieces, "")).otherwise(t))
    return out.select(*docs.columns, n_out)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
