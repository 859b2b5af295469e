"""Templates as data: texts with ``{{ reference | filter }}`` rendered or renamed by one equi-join on (key, reference)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelens.functions.registry import COLUMN_FUNCTIONS

from .ranking import TASK_ROWS, kept

REFERENCE = r"\{\{\s*([^{}]*?)\s*\}\}"
#: Filters on strings that a template may name.
FILTERS = ("snake", "kebab", "slug", "short", "escape_query", "folded", "preview", "singular", "plural", "quote", "head", "space", "date", "shq")


def references(text: Column) -> Column:
    """What stands between the braces, in order."""
    return F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1))


def _refilled(texts: DataFrame, key: list[str], text: str, out: str, found: DataFrame) -> DataFrame:
    """``texts`` with the references of ``text`` replaced by the pieces ``found`` (key, text, _pos, piece), in order."""
    pieces = found.groupBy(*key, text).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "piece"))), lambda x: x["piece"]).alias("_p"))
    keyed = texts.join(pieces.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate([*key, text])), "_p"), [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*key, text])], "left")
    between = F.split(F.col(text), REFERENCE, -1)
    full = F.array_join(F.transform(between, lambda x, i: F.concat(x, F.coalesce(F.get("_p", i), F.lit("")))), "")
    return keyed.select(*texts.columns, F.when(F.col("_p").isNull(), F.col(text)).otherwise(full).alias(out))


def _exploded(texts: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, text, _pos, _ref) of the distinct texts that have references."""
    some = texts.select(*key, text).where(F.contains(F.col(text), F.lit("{{"))).distinct()
    return some.select(*key, text, F.posexplode(references(F.col(text))).alias("_pos", "_ref"))


def fill(texts: DataFrame, context: DataFrame, key: list[str], text: str = "text", out: str = "value") -> DataFrame:
    """``texts`` with ``out``: each reference replaced by the value that ``context`` (key, ref, value) has for it under the same key.

    What the context lacks, or has as null, leaves nothing; ``{{ a | f | g }}`` takes the filters f and g one after the
    other, and unknown filters change nothing.  A context with several values of one reference counts with the least.
    Texts without references, and null texts, stay.
    """
    cut = F.split("_ref", r"\s*\|\s*")
    refs = _exploded(texts, key, text).withColumn("_f", F.slice(cut, 2, 9)).withColumn("_ref", F.get(cut, F.lit(0)))
    values = context.groupBy(*key, F.col("ref").alias("_ref")).agg(F.min("value").alias("piece"))

    def filtered(value: Column, name: Column) -> Column:
        out = value
        for f in FILTERS:
            out = F.when(name == f, COLUMN_FUNCTIONS[f](value)).otherwise(out)
        return out

    got = refs.join(values, [*key, "_ref"], "left")
    plain = got.where(F.size("_f") == 0)
    piped = got.where(F.size("_f") > 0).withColumn("piece", F.aggregate("_f", F.col("piece"), filtered))
    return _refilled(texts, key, text, out, plain.unionByName(piped).select(*key, text, "_pos", "piece"))


def rename(texts: DataFrame, names: DataFrame, key: list[str], text: str = "text", out: str = "text_") -> DataFrame:
    """``texts`` with ``out``: the first part of each reference replaced by its new name in ``names`` (key, head, name); others stay.

    A text without a reference is joined with nothing, one with a single reference by one join.
    """
    texts = kept(texts)
    parts = texts.count() // TASK_ROWS + 1
    n = F.coalesce(F.size(references(F.col(text))), F.lit(0))
    head, rest = F.regexp_extract("_ref", r"^\w+", 0), F.expr("substring(_ref, length(_head) + 1)")
    piece = F.concat(F.lit("{{ "), F.coalesce("_name", "_head"), rest, F.lit(" }}"))
    known = names.select(*key, F.col("head").alias("_head"), "name").repartition(parts, *key, "_head").groupBy(*key, "_head").agg(F.min("name").alias("_name"))
    plain = texts.where(n <= 0).withColumn(out, F.col(text))
    one = texts.where(n == 1).withColumn("_ref", F.get(references(F.col(text)), F.lit(0))).withColumn("_head", head).repartition(parts, *key, "_head")
    between = F.split(F.col(text), REFERENCE, -1)
    one = one.join(known, [*key, "_head"], "left").select(*texts.columns, F.concat(F.get(between, F.lit(0)), piece, F.get(between, F.lit(1))).alias(out))
    several = texts.where(n > 1)
    got = _exploded(several, key, text).withColumn("_head", head).join(known, [*key, "_head"], "left")
    return plain.unionByName(one).unionByName(_refilled(several, key, text, out, got.select(*key, text, "_pos", piece.alias("piece"))))


def replay(proposals: DataFrame, recorded: DataFrame, context: DataFrame, key: list[str], session: str) -> DataFrame:
    """Each proposed binding held against what every episode passed: (key, step, arg, template, checked, passed, accepted, why).

    proposals: (key, step, arg, template); recorded: (key, session, step, arg, value), what the episodes' calls passed;
    context: (key, session, ref, value), what each episode knew before.  A binding is accepted if every episode that
    passed the argument passed one value, the template renders exactly it, and at least one episode did; a template
    whose rendered references never vary over several episodes is a constant and no binding.  An episode that passed
    several values for the argument rejects it.
    """
    both = proposals.join(recorded, [*key, "step", "arg"])
    made = fill(both, context, [*key, session], "template", "got")
    per = made.groupBy(*key, "step", "arg", "template", session).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.min("got").alias("got"))
    right = (F.col("lo") == F.col("hi")) & (F.col("got") == F.col("lo"))
    done = per.groupBy(*key, "step", "arg", "template").agg(
        F.count("*").alias("checked"), F.count_if(F.coalesce(right, F.lit(False))).alias("passed"), F.bool_or(F.col("lo") != F.col("hi")).alias("several"), (F.min("got") != F.max("got")).alias("varies"))
    rows = proposals.select(*key, "step", "arg", "template").distinct().join(done, [*key, "step", "arg", "template"], "left")
    checked, bound = F.coalesce("checked", F.lit(0)), F.contains(F.col("template"), F.lit("{{"))
    why = (
        F.when(checked == 0, "never passed").when(F.col("several"), "several values").when(F.col("passed") < checked, "differs")
        .when(bound & ~F.col("varies") & (checked > 1), "constant").otherwise("reproduced")
    )
    return rows.select(*key, "step", "arg", "template", checked.alias("checked"), F.coalesce("passed", F.lit(0)).alias("passed"), (why == "reproduced").alias("accepted"), why.alias("why"))
