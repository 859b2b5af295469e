"""An index of trace files that is kept up to date: only new and changed files are read, vanished ones go.

The index is a table of ``PARTS`` parts by a hash of the file name.  An update replaces the rows of its files and
rewrites the parts that they fall into, each as a whole, so it may be repeated after a failure, by a batch as by a
stream, and leaves every file once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracelens.operators.ranking import cut

from .traces import RECORD, changed
from .workspace import PARTS, exists

ENTRY = "file string, size long, mtime timestamp, session_id string, parent string, prompt string, nodes array<string>, n_calls long"
GLOB = "*.jsonl"
#: Changed files that are named to the reader one by one; if more have changed, all files are listed and the others left out.
NAMED = 10_000


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(file, size, mtime) of the trace files of a folder, without reading them; a missing folder has none."""
    if not exists(spark, folder):
        return spark.createDataFrame([], "file string, size long, mtime timestamp")
    files = spark.read.format("binaryFile").option("pathGlobFilter", GLOB).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("mtime"))


def scan(texts: DataFrame) -> DataFrame:
    """Entries of whole trace files (file, size, mtime, value); a file with a line that is no record, as one half written, gives none."""
    lines = texts.select("file", "size", "mtime", F.posexplode(F.split("value", "\n")).alias("line", "raw")).where(F.trim("raw") != "")
    r = F.from_json("raw", RECORD + ", _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    lines = lines.select("file", "size", "mtime", "line", r.alias("r")).select("file", "size", "mtime", "line", "r.*")
    is_call = F.coalesce("kind", F.lit("call")) == "call"
    last = lambda c: F.max_by(c, F.when((F.col("kind") == "meta") & F.col(c).isNotNull(), F.col("line")))
    calls = F.array_sort(F.collect_list(F.when(is_call, F.struct("line", F.concat_ws(".", "server", "tool").alias("t")))))
    per = lines.groupBy("file", "size", "mtime").agg(
        F.coalesce(last("session_id"), F.first("session_id", ignorenulls=True)).alias("session_id"), last("parent_session").alias("parent"), F.coalesce(F.min_by("text", F.when(F.col("kind") == "prompt", F.col("line"))), last("prompt")).alias("prompt"),
        F.transform(calls, lambda x: x["t"]).alias("nodes"), F.count_if(is_call).alias("n_calls"), F.bool_or(F.col("_broken").isNotNull()).alias("broken"))
    stem = F.regexp_extract("file", r"([^/]+)\.jsonl$", 1)
    return per.where(~F.col("broken")).withColumn("session_id", F.coalesce("session_id", stem)).drop("broken")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The index's entries; none if there is no index yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY + ", part_no int").parquet(path).where("file is not null").drop("part_no")


def upsert(entries: DataFrame, gone: DataFrame, path: str) -> None:
    """Put ``entries`` in the place of what the index had for their files, and take the files of ``gone`` out of it."""
    spark = entries.sparkSession
    names = [x.split()[0] for x in ENTRY.split(", ")]
    part = F.pmod(F.xxhash64("file"), F.lit(PARTS)).cast("int")
    new = cut(entries.select(*names).withColumn("part_no", part))
    away = cut(new.select("file").unionByName(gone.select("file")).distinct().withColumn("part_no", part))
    touched = away.select("part_no").distinct()
    rows = new
    if exists(spark, path):
        old = spark.read.schema(ENTRY + ", part_no int").parquet(path).where("file is not null")
        rows = new.unionByName(old.join(touched, "part_no", "left_semi").join(away.select("file"), "file", "left_anti").select(*new.columns))
    # a part that loses all its files keeps a row without one: a part that is not written would stay as it was
    empty = touched.select(*[F.lit(None).cast(t).alias(c) for c, t in new.dtypes if c != "part_no"], "part_no")
    cut(rows.unionByName(empty)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part_no").parquet(path)


def refresh(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """Bring the index up to date; (file, state) of all files as they were found: new, changed, gone or same."""
    states = cut(changed(listing(spark, folder), read(spark, path)))
    todo = states.where(F.col("state").isin("new", "changed")).select("file")
    named = [r["file"] for r in todo.limit(NAMED + 1).collect()]
    gone = states.where("state = 'gone'").select("file")
    if not named and gone.isEmpty():
        return states
    where = named if 0 < len(named) <= NAMED else folder
    if named:
        texts = spark.read.option("pathGlobFilter", GLOB).option("recursiveFileLookup", "true").text(where, wholetext=True)
        texts = texts.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("mtime"), "value")
        entries = scan(texts.join(todo, "file", "left_semi"))
    else:
        entries = spark.createDataFrame([], ENTRY)
    # a changed file that is half written now leaves the index until it can be read
    stale = cut(states.where("state = 'changed'").select("file"))
    upsert(entries, gone.unionByName(stale), path)
    return states


def apply_batch(rows: DataFrame, folder: str, path: str) -> None:
    """One micro-batch of whole files (file, size, mtime, value): their entries in, vanished files out.  A batch that comes again changes nothing."""
    spark = rows.sparkSession
    gone = read(spark, path).select("file").join(listing(spark, folder).select("file"), "file", "left_anti")
    upsert(scan(rows), gone, path)


def follow(spark: SparkSession, folder: str, path: str, checkpoint: str, per_trigger: int = 1000) -> StreamingQuery:
    """Index the new files of a folder as a stream of what is there now; run again, it goes on with what has come since."""
    files = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", GLOB).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(folder)
    files = files.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("mtime"), "value")
    return files.writeStream.foreachBatch(lambda rows, _: apply_batch(rows, folder, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
