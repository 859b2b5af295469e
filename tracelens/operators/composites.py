"""Arguments that hold earlier values inside a longer text: composite bindings.

A value can stand in a text only if its first word does, so arguments and values meet by an equi-join on episode and
word; nothing is compared with everything.  Of the values found, the longest is put in first, then what is left of the
text is searched for the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binding import rank

# The shortest value that is put in, and the characters that make a token for the boundary check.
MIN_CHARS = 3
TOKEN = r"[\p{L}\p{N}_-]"

#: A first word and what comes before it; texts are indexed by these words.
WORD = r"[\p{L}\p{N}_]+"
#: The places of values while a text is taken apart: numbers in private characters.
PRIVATE = "".join(chr(0xE010 + k) for k in range(10))


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))


def _mark(i: Column) -> Column:
    return F.concat(F.lit("\ue000"), F.translate(i.cast("string"), "0123456789", PRIVATE), F.lit("\ue001"))


def whole(value: Column) -> Column:
    """A pattern of the value where it neither begins nor ends inside a longer token."""
    quoted = F.regexp_replace(value, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    before = F.when(value.rlike(rf"^{TOKEN}"), F.lit(rf"(?<!{TOKEN})")).otherwise(F.lit(""))
    after = F.when(value.rlike(rf"{TOKEN}$"), F.lit(rf"(?!{TOKEN})")).otherwise(F.lit(""))
    return F.concat(before, quoted, after)


def contained(args: DataFrame, candidates: DataFrame, episode: list[str]) -> DataFrame:
    """(episode, at, arg, value, src, kind, source, name, _r) for each earlier candidate value that stands in an argument's text."""
    c = candidates.where((F.length("value") >= MIN_CHARS) & F.col("value").rlike(WORD))
    c = c.select(*episode, F.regexp_extract("value", WORD, 0).alias("_word"), F.col("value").alias("part"), F.col("at").alias("src"), "kind", "source", "name", rank(F.col("kind"), F.col("in_list"), F.col("first")).alias("_r"))
    a = args.select(*episode, "at", "arg", "value", F.explode(_words(F.col("value"))).alias("_word"))
    both = a.join(c, [*episode, "_word"]).where((F.col("src") < F.col("at")) & F.contains("value", F.col("part")) & (F.col("value") != F.col("part")))
    return both.where(F.regexp_like("value", whole(F.col("part")))).drop("_word").distinct()


def bind_composite(args: DataFrame, candidates: DataFrame, episode: list[str]) -> DataFrame:
    """Each argument (episode, at, arg, value) with a template of its text, the kinds and sources of the values in it, in the order in which they were put in.

    Of equal values the best by rank and then the earliest counts.  Without any value the template is null and the lists are empty.
    """
    found = contained(args, candidates, episode)
    best = found.groupBy(*episode, "at", "arg", "value", "part").agg(F.min(F.struct("_r", "src", "kind", "source", "name")).alias("b"))
    order = F.struct((-F.length("part")).alias("n"), F.col("b._r").alias("r"), F.col("b.src").alias("src"), "part", F.col("b.kind").alias("kind"), F.col("b.source").alias("source"), F.col("b.name").alias("name"))
    lists = best.groupBy(*episode, "at", "arg", "value").agg(F.array_sort(F.collect_list(order)).alias("parts"))
    start = F.struct(F.col("value").alias("text"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("used"))

    def put(acc: Column, part: Column) -> Column:
        text = F.regexp_replace(acc["text"], whole(part["part"]), _mark(acc["i"]))
        hit = text != acc["text"]
        return F.struct(text.alias("text"), (acc["i"] + 1).alias("i"), F.when(hit, F.array_append(acc["used"], acc["i"])).otherwise(acc["used"]).alias("used"))

    rows = lists.withColumn("t", F.aggregate("parts", start, put))
    used = F.transform("t.used", lambda i: F.struct(F.get("parts", i).alias("p"), i.alias("i")))
    rows = rows.withColumn("used", used)
    template = F.aggregate("used", F.col("t.text"), lambda text, u: F.replace(text, _mark(u["i"]), F.concat(F.lit("{{ "), u["p"]["source"], F.lit("."), u["p"]["name"], F.lit(" }}"))))
    rows = rows.where(F.size("used") > 0).select(*episode, "at", "arg", template.alias("template"), F.transform("used", lambda u: u["p"]["kind"]).alias("kinds"), F.transform("used", lambda u: u["p"]["source"]).alias("sources"), F.transform("used", lambda u: u["p"]["src"]).alias("srcs"))
    none = F.array().cast("array<string>")
    return args.select(*episode, "at", "arg", "value").join(rows, [*episode, "at", "arg"], "left").select(*episode, "at", "arg", "value", "template", F.coalesce("kinds", none).alias("kinds"), F.coalesce("sources", none).alias("sources"), F.coalesce("srcs", F.array().cast("array<bigint>")).alias("srcs"))
