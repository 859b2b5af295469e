"""Tables kept in the checkpoint folder and dealt out to tasks; numbers for all rows in one order, without one task that sees them all."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that a task gets of a table that is dealt out, about: shuffled bytes say little of it, as repeated words compress to a few bytes.
TASK_ROWS = 25_000


def _folder(df: DataFrame) -> str:
    """The checkpoint folder; only a session on one machine may do without a named one."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tracelens-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and without lineage."""
    _folder(df)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """The same for large tables, by columns: what reads it again reads the columns that it needs."""
    if getattr(df, "_kept", False):
        return df
    path = f"{_folder(df)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._kept = True
    return back


def dealt(df: DataFrame, key: list[str], rows: int = TASK_ROWS) -> DataFrame:
    """``df`` kept, and dealt out by ``key`` to as many tasks as its rows need: one task's memory does not grow with the table."""
    df = kept(df)
    return df.repartition(df.count() // rows + 1, *key)


def spread(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """``df`` over as many tasks as its rows need, where each row makes many or takes long: a file of few bytes is read by one task."""
    return df.repartition(df.count() // rows + 1)


def number_rows(rows: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """``rows`` with their numbers from 1 in the given order, which has to be total.

    Rows are dealt out by ranges of the order and sorted there; a range's numbers go on from the sum of the counts
    before it.  Only these counts, one a partition, come together.
    """
    placed = cut(rows.orderBy(*order).withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n"), F.min("_row").alias("_first"))
    before = counts.select("_part", "_first", (F.sum("n").over(W.orderBy("_part")) - F.col("n")).alias("_before"))
    both = placed.withColumn("_part", part).join(F.broadcast(before), "_part")
    return both.select(*rows.columns, (F.col("_before") + F.col("_row") - F.col("_first") + 1).alias(name))
