"""The functions on columns by name, as flows name them, and their SQL registration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import display, text

#: Template filters and predicates: each takes one column.
COLUMN_FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "quote": text.quote, "snake": text.snake, "kebab": text.kebab, "slug": text.slug, "short": text.short, "join_and": text.join_and, "join_or": text.join_or, "escape_query": text.escape_query,
    "truthy": text.truthy, "folded": text.folded, "preview": text.preview, "singular": display.singular, "plural": display.plural, "markable": display.markable,
    "first": lambda c: F.get(c, F.lit(0)), "head": lambda c: F.substring_index(c, "\n", 1), "space": lambda c: F.regexp_replace(c, "[_-]+", " "), "date": lambda c: F.substring(c, 1, 10),
    "shq": lambda c: F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")),
}


def apply(name: str, column: Column) -> Column:
    if name not in COLUMN_FUNCTIONS:
        raise ValueError(f"no function {name!r}; there are {', '.join(sorted(COLUMN_FUNCTIONS))}")
    return COLUMN_FUNCTIONS[name](column)


def pipe(column: Column, *names: str) -> Column:
    """The functions one after the other, as a template's ``{{ value | a | b }}``."""
    for name in names:
        column = apply(name, column)
    return column


def register(spark: SparkSession) -> list[str]:
    """Make those on strings callable from SQL as ``tl_<name>``: SQL functions, so that they stay expressions of the plan."""
    made = []
    for name, body in SQL_BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION tl_{name}(s STRING) RETURNS STRING RETURN {body}")
        made.append(f"tl_{name}")
    return made


SQL_BODIES = {
    "snake": "translate(s, '-', '_')", "kebab": "translate(s, '_', '-')", "short": "substring(s, 1, 10)", "head": "substring_index(s, chr(10), 1)", "date": "substring(s, 1, 10)",
    "space": "regexp_replace(s, '[_-]+', ' ')", "quote": "concat('\"', replace(s, '\"', concat(chr(92), '\"')), '\"')", "shq": "concat('\\'', replace(s, '\\'', '\\'\"\\'\"\\''), '\\'')",
}
