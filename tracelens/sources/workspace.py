"""Tables of a workspace: sessions that are written once or anew, cached edges, runs, and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelens.operators.ranking import cut

#: Parts of a workspace's table; a rewrite replaces whole parts at once, so it can be repeated after a failure.
PARTS = 64


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def slices(calls: DataFrame) -> DataFrame:
    """Calls under the name of their session and again under that of their episode: ``<session>-e<number>``, with ``-a<agent>`` for a subagent's."""
    own = calls.select("session", "prompt_index", "agent").distinct()
    number = F.dense_rank().over(W.partitionBy("session").orderBy("prompt_index", F.col("agent") != "main", "agent"))
    named = own.withColumn("part", F.concat("session", F.lit("-e"), number.cast("string"), F.when(F.col("agent") != "main", F.concat(F.lit("-a"), F.col("agent"))).otherwise(F.lit(""))))
    whole = calls.withColumn("part", F.col("session"))
    return whole.unionByName(calls.join(named, ["session", "prompt_index", "agent"]).select(*calls.columns, "part"))


def write_sessions(rows: DataFrame, path: str, workspace: str, key: str = "session", force: bool = False) -> None:
    """Add the sessions that the table does not have yet; with ``force`` write all of them anew.

    The parts that new rows fall into are read, merged, and replaced as a whole: a repeated or broken import leaves no
    session twice.
    """
    spark = rows.sparkSession
    part = F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")
    new = rows.withColumn("workspace", F.lit(workspace)).withColumn("part_no", part)
    if exists(spark, path):
        old = spark.read.parquet(path).where(F.col("workspace") == workspace)
        if force:
            old = old.join(new.select(key).distinct(), key, "left_anti")
        else:
            new = new.join(old.select(key).distinct(), key, "left_anti")
        new = cut(new)
        touched = new.select("part_no").distinct()
        new = cut(new.unionByName(old.join(touched, "part_no", "left_semi").select(*new.columns)))
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("workspace", "part_no").parquet(path)


def missing(files: DataFrame, cached: DataFrame, version: int) -> DataFrame:
    """The files whose edges are not cached by this version for their present size and time."""
    fresh = cached.where(F.col("version") == version).select("file", "size", "mtime").distinct()
    return files.join(fresh, ["file", "size", "mtime"], "left_anti")


def add_edges(edges: DataFrame, files: DataFrame, path: str, version: int) -> None:
    """Cache the edges of files, each with its size and time; a file without edges keeps a row without one."""
    rows = files.select("file", "size", "mtime").join(edges, "file", "left").withColumn("version", F.lit(version))
    rows.write.mode("append").partitionBy("version").parquet(path)


def recent(runs: DataFrame, name: Column, most: int) -> DataFrame:
    """The newest runs by name, with the hits of their steps: runs (.., steps array<struct<hits, ..>>)."""
    hits = F.aggregate("steps", F.lit(0).cast("long"), lambda n, s: n + F.coalesce(s["hits"].cast("long"), F.lit(0)))
    return runs.withColumn("hits", hits).orderBy(name.desc()).limit(most)


def listing(records: DataFrame, workspace: str, session: str, ts: str) -> DataFrame:
    """One row a workspace: its sessions, records and last time; the newest first."""
    n = records.groupBy(workspace).agg(F.countDistinct(session).alias("sessions"), F.count("*").alias("records"), F.max(ts).alias("last"))
    return n.orderBy(F.desc("last"), workspace)


def seed(have: DataFrame, given: DataFrame, key: list[str]) -> DataFrame:
    """The given rows whose key is not there yet: nothing is overwritten."""
    return given.join(have.select(*key).distinct(), key, "left_anti")
