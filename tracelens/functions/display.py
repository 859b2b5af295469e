"""Names, times and short phrases for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is no parameter, plural endings that stay, and how a recurrence is told.
NO_VALUES = ("true", "false", "none")
KEEP_PLURAL = r"(ss|us|is|ts)$"
REPEAT = r"(?:looks like|same as|repeat of|recurrence of|again[,:]?\s+like)\s+([A-Z][A-Z0-9]{1,9}-\d+)"
AGAIN = r"([A-Z][A-Z0-9]{1,9}-\d+)\s+again\b"
TRUST = {"promoted": 0, "candidate": 1, "draft": 2}
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def markable(value: Column) -> Column:
    """The trimmed value if it may be shown as one that moved: 3 to 80 characters, no truth value, date or time; else null."""
    s = F.trim(value)
    return F.when(F.length(s).between(3, 80) & ~F.lower(s).isin(*NO_VALUES) & ~s.rlike(ISO), s)


def singular(name: Column) -> Column:
    """A name without its plural ending, once a counter behind it is gone; short names and endings that may be no plural stay as they are."""
    n = F.regexp_replace(name, r"_\d+$", "")
    return (
        F.when((F.length(n) > 4) & n.rlike("ies$"), F.regexp_replace(n, "ies$", "y")).when((F.length(n) > 4) & n.rlike("(s|x|z|ch|sh)es$"), F.regexp_replace(n, "es$", ""))
        .when((F.length(n) > 3) & n.rlike("s$") & ~n.rlike(KEEP_PLURAL), F.regexp_replace(n, "s$", "")).otherwise(n)
    )


def plural(name: Column) -> Column:
    return F.concat(name, F.when(name.endswith("s"), F.lit("_list")).otherwise(F.lit("s")))


def display_type(value_type: Column, name: Column) -> Column:
    """What a reader is told about a value: the kind of an id or entity, else the attribute of the hub, else the field's name for a single one."""
    head, rest = F.substring_index(value_type, ":", 1), F.regexp_extract(value_type, "^[^:]*:(.*)$", 1)
    plain = F.when(singular(name) != "", singular(name)).when(value_type != "", value_type).otherwise(F.lit("value"))
    attribute = F.substring_index(rest, ".", -1)
    return (
        F.when(value_type == "window", F.lit("window")).when(head == "catalog-attr", F.when(attribute != "", attribute).otherwise(singular(name)))
        .when(head.isin("ids", "catalog") & (rest != ""), rest).when(head.isin("regex", "copy", "input") & (rest != ""), singular(rest)).otherwise(plain)
    )


def minutes_text(start: Column, end: Column) -> Column:
    """``2h 05m`` or ``12m`` between two times; null if the end comes first."""
    m = F.floor((F.unix_timestamp(end) - F.unix_timestamp(start)) / 60)
    long = F.concat(F.floor(m / 60).cast("string"), F.lit("h "), F.lpad((m % 60).cast("string"), 2, "0"), F.lit("m"))
    return F.when(m >= 60, long).when(m >= 0, F.concat(m.cast("string"), F.lit("m")))


def repeat_of(text: Column, own: Column) -> Column:
    """The key of the issue that a text says it repeats, other than its own."""
    keys = F.concat(F.regexp_extract_all(text, F.lit(REPEAT), F.lit(1)), F.regexp_extract_all(text, F.lit(AGAIN), F.lit(1)))
    return F.get(F.filter(keys, lambda k: ~k.eqNullSafe(own)), F.lit(0))


def parse_time(text: Column, now: Column) -> Column:
    """``now``, ``now-15m``, epoch seconds, a date, or an ISO time; null if none of them."""
    s = F.trim(text)
    unit = F.regexp_extract(s, r"^now-(\d+)([smhd])$", 2)
    n = F.regexp_extract(s, r"^now-(\d+)([smhd])$", 1).try_cast("long")
    seconds = n * F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).otherwise(86400)
    return (
        F.when(s == "now", now).when(n.isNotNull(), F.timestamp_seconds(F.unix_timestamp(now) - seconds))
        .when(s.rlike(r"^\d{10}(\.\d+)?$"), F.timestamp_seconds(s.try_cast("double"))).otherwise(s.try_cast("timestamp"))
    )


def trust_order(status: Column, base: Column, version: Column) -> list[Column]:
    """Order of flows: the most trusted status first, then the base name, then the newest version."""
    rank = F.lit(len(TRUST))
    for name, n in TRUST.items():
        rank = F.when(status == name, F.lit(n)).otherwise(rank)
    return [rank, base, -F.coalesce(version, F.lit(1))]
