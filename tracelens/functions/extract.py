"""Extractors: JSON paths, first and all regex matches, labelled lines, time windows, entity names, hit counts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
LABEL_LINE = r"^\s*([A-Za-z][A-Za-z _]{0,30}?)\s*([:=])\s*(\S.*?)\s*$"
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def seconds(duration: str) -> int:
    """Seconds of a duration such as 90s, 15m, 4h or 2d."""
    m = re.fullmatch(r"(\d+)([smhd])", duration.strip())
    if not m:
        raise ValueError(f"bad duration {duration!r}")
    return int(m[1]) * UNIT_SECONDS[m[2]]


def duration(secs: Column) -> Column:
    """The largest unit that divides a number of seconds."""
    s = F.abs(secs.cast("long"))
    out = F.concat(s.cast("string"), F.lit("s"))
    for unit in ("m", "h", "d"):
        n = UNIT_SECONDS[unit]
        out = F.when((s > 0) & (s % n == 0), F.concat(F.floor(s / n).cast("string"), F.lit(unit))).otherwise(out)
    return out


def json_path(json: Column, path: str) -> Column:
    """The text at a path of a JSON column; a bare path starts at the root, ``[*]`` gives a JSON list."""
    return F.get_json_object(json, path if path.startswith("$") else f"$.{path}" if path else "$")


def count_hits(json: Column, path: str) -> Column:
    """How many things a JSON result holds at a path: the length of a list, else 1 for a value and 0 for none."""
    got = json_path(json, path)
    return F.when(got.isNull(), F.lit(0)).otherwise(F.coalesce(F.json_array_length(got), F.lit(1)))


def first_list_hits(result: Column) -> Column:
    """Hits of a VARIANT result without a path: the length of its first top-level list, a lone error is none, anything else is one.

    Fields come in the order of the variant's keys; lists deeper than one level are not sought.
    """
    fields = F.from_json(F.to_json(result), "map<string,string>")
    lists = F.filter(F.map_values(fields), lambda v: F.startswith(v, F.lit("[")))
    text = F.to_json(result)
    return (
        F.when(text.isNull() | text.isin("null", "{}", '""', "0", "false"), F.lit(0))
        .when(F.startswith(text, F.lit("[")), F.json_array_length(text))
        .when((F.size(fields) == 1) & F.map_contains_key(fields, F.lit("error")), F.lit(0))
        .when(F.size(lists) > 0, F.json_array_length(F.get(lists, F.lit(0))))
        .otherwise(F.lit(1))
    )


def regex_all(text: Column, pattern: str, group: int | None = None, ignore_case: bool = False) -> Column:
    """Distinct matches in order; the first group if the pattern has one."""
    group = (1 if re.compile(pattern).groups else 0) if group is None else group
    return F.array_distinct(F.regexp_extract_all(text, F.lit(("(?mi)" if ignore_case else "(?m)") + pattern), F.lit(group)))


def regex_first(text: Column, pattern: str, group: int | None = None, ignore_case: bool = False) -> Column:
    """The first match, else null."""
    return F.get(regex_all(text, pattern, group, ignore_case), F.lit(0))


def label_lines(texts: DataFrame, key: str, text: str, least: int = 3) -> DataFrame:
    """(key, line, label, value) of each ``Label: value`` or ``label = value`` line."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("line", "raw")).where(F.col("raw").rlike(LABEL_LINE))
    part = lambda g: F.regexp_extract("raw", LABEL_LINE, g)
    return lines.select(key, "line", part(1).alias("label"), part(3).alias("value")).where(F.length("value") >= least)


def floor_to(ts: Column, unit: str) -> Column:
    """A timestamp floored to whole units since midnight UTC."""
    day = F.date_trunc("day", ts)
    s = F.unix_timestamp(ts) - F.unix_timestamp(day)
    return F.timestamp_seconds(F.unix_timestamp(day) + s - s % seconds(unit))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def window(ts: Column, before: str = "1h", after: str = "4h", round_to: str | None = None) -> Column:
    """struct(start, end, anchor, start_date, end_date) around a timestamp, as texts."""
    t = floor_to(ts, round_to) if round_to else ts.cast("timestamp")
    start, end = F.timestamp_seconds(F.unix_timestamp(t) - seconds(before)), F.timestamp_seconds(F.unix_timestamp(t) + seconds(after))
    return F.struct(iso(start).alias("start"), iso(end).alias("end"), iso(t).alias("anchor"), F.date_format(start, "yyyy-MM-dd").alias("start_date"), F.date_format(end, "yyyy-MM-dd").alias("end_date"))


#: A token of a text or an alias.
TOKEN = r"(?U)[\w-]+"


def _tokens(text: Column) -> tuple[Column, Column]:
    """The tokens of a text as gazetteers see it (small letters, ``_`` as ``-``), and what stands before, between and behind them."""
    norm = F.translate(F.lower(text), "_", "-")
    return F.regexp_extract_all(norm, F.lit(TOKEN), F.lit(0)), F.split(norm, TOKEN, -1)


def _stands(w: Column, g: Column, c: Column) -> Column:
    """Whether the alias c (at, aw, ag) stands in a text of tokens w and gaps g from token number ``at`` on, with no token character beside it."""
    at, m = c["at"], F.size(c["aw"])
    lead, trail, before, behind = F.get(c["ag"], F.lit(0)), F.get(c["ag"], m), F.get(g, at), F.get(g, at + m)
    free_left = (lead == "") | (at == 0) | (F.length(before) > F.length(lead))
    free_right = (trail == "") | (at + m == F.size(w)) | (F.length(behind) > F.length(trail))
    inside = (F.slice(w, at + 1, m) == c["aw"]) & (F.slice(g, at + 2, m - 1) == F.slice(c["ag"], F.lit(2), m - 1))
    return (at >= 0) & (at + m <= F.size(w)) & inside & F.endswith(before, lead) & F.startswith(behind, trail) & free_left & free_right


def gazetteer(texts: DataFrame, key: str, text: str, names: DataFrame | list[tuple[str, str]]) -> DataFrame:
    """(key, n, name) of the entities that a text mentions, in order of first mention.

    ``names`` is a hub, a table (alias, name) of any size.  Longer aliases go first, case does not matter, ``-`` and
    ``_`` are one, and a mention stands alone (no word character or hyphen beside it).  An alias without a word character
    is never found; of several names of one alias the least counts; null texts mention nothing.

    A text meets an alias at the alias's rarest token: an equi-join of tokens, whatever the number of aliases.  The
    aliases that stand there are settled in each text from left to right.
    """
    spark = texts.sparkSession
    hub = names if isinstance(names, DataFrame) else spark.createDataFrame(names, "alias string, name string")
    aw, ag = _tokens(F.col("alias"))
    hub = hub.select(aw.alias("aw"), ag.alias("ag"), "name").where(F.size("aw") > 0).groupBy("aw", "ag").agg(F.min("name").alias("name"))
    rows = texts.select(key, F.col(text).alias("_text")).where(F.col("_text").isNotNull()).distinct().withColumn("_row", F.xxhash64("_text"))
    w, g = _tokens(F.col("_text"))
    tokens = rows.select(key, "_row", F.posexplode(w).alias("i", "token"))
    parts = hub.select("*", F.posexplode("aw").alias("j", "token"))
    # only tokens of aliases are counted, and an alias that lacks one in all texts is none
    often = tokens.join(parts.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("often"))
    anchors = parts.join(often, "token", "left").groupBy("aw", "ag", "name").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "token", "j")).alias("a"))
    anchors = anchors.where("a.often > 0").select("aw", "ag", "name", F.col("a.token").alias("token"), F.col("a.j").alias("j"))
    met = tokens.join(anchors, "token").where("i >= j").select(key, "_row", F.struct((F.col("i") - F.col("j")).alias("at"), "aw", "ag", "name").alias("c"))
    per = met.groupBy(key, "_row").agg(F.collect_list("c").alias("c"))
    # tokens and gaps as a lambda's variable: a text is cut once
    cut = F.get(F.transform(F.array(F.struct(w.alias("w"), g.alias("g"))), lambda t: F.filter("c", lambda c: _stands(t["w"], t["g"], c))), F.lit(0))
    size = lambda c: F.length(F.array_join(c["aw"], "")) + F.length(F.array_join(c["ag"], ""))
    order = F.array_sort(F.transform("hits", lambda c: F.struct(c["at"].alias("at"), (-size(c)).alias("short"), (c["at"] + F.size(c["aw"])).alias("end"), c["name"].alias("name"))))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("names"))
    taken = lambda acc, c: F.when(c["at"] >= acc["end"], F.struct(c["end"].alias("end"), F.array_append(acc["names"], c["name"]).alias("names"))).otherwise(acc)
    found = rows.join(per, [key, "_row"]).select(key, "_row", cut.alias("hits")).where(F.size("hits") > 0).select(key, F.array_distinct(F.aggregate(order, start, taken)["names"]).alias("names"))
    return found.select(key, F.posexplode("names").alias("n", "name")).select(key, (F.col("n") + 1).alias("n"), "name")
