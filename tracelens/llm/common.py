"""Helpers shared by the operators: table access and scratch tables.

Iterative operators cut lineage by writing a table into the folder that the
session names in ``spark.checkpoint.dir``: every executor can read it again
after another one is lost, and Parquet keeps it small.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_SCRATCH: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session.

    A cluster has to name one; only a single-machine session (as in tests) may
    fall back to a temporary folder.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="tracelens-")
    return f"file://{_LOCAL_SCRATCH[app]}"


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows that a Python worker gets at once: texts and word sets are long, and both sides of the pipe hold a batch.
BATCH_ROWS = 1024
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: A query that writes a table needs its shuffle files no more once the table is there.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings that hold inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Plans made inside hand Python workers ``BATCH_ROWS`` rows at a time at most."""
    now = int(spark.conf.get(_BATCH))
    with settings(spark, **{_BATCH: str(min(now, BATCH_ROWS) if now > 0 else BATCH_ROWS)}):
        yield


def bound_batches(spark: SparkSession) -> None:
    """From now on the session hands Python workers ``BATCH_ROWS`` rows at a time at most: for plans that the caller writes."""
    now = int(spark.conf.get(_BATCH))
    spark.conf.set(_BATCH, str(min(now, BATCH_ROWS) if now > 0 else BATCH_ROWS))


class Scratch:
    """Tables written to the shared folder under one unique name."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tracelens/{label}-{uuid.uuid4().hex}"
        self._n = 0
        self._saved: dict[str, DataFrame] = {}

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` and read it back: the result has no lineage before the files."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        with small_batches(self.spark), settings(self.spark, **{_CLEAN: "true"}):
            df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._tracelens_path = path
        self._saved[path] = back
        return back

    def drop(self, df: DataFrame) -> None:
        """Delete a saved table that no later step reads."""
        path = getattr(df, "_tracelens_path", None)
        if path:
            jvm = self.spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
            self._saved.pop(path, None)

    def keep(self, *tables: DataFrame) -> None:
        """Delete all tables that were saved here but these, which later steps still read."""
        paths = {getattr(t, "_tracelens_path", None) for t in tables}
        for path, saved in list(self._saved.items()):
            if path not in paths:
                self.drop(saved)


#: Bytes of a table that is sent to every executor instead of shuffling the wide side of a join.
NARROW_BYTES = 32 << 20


def narrow(ids: DataFrame, scratch: Scratch, most: int = NARROW_BYTES) -> DataFrame:
    """``ids`` saved, and marked for broadcast if its values and row headers take at most ``most`` bytes; else it is joined by a shuffle."""
    ids = scratch.save(ids, "ids")
    wide = F.lit(16 + 16 * len(ids.columns))
    for name, kind in ids.dtypes:
        if kind in ("string", "binary"):
            wide = wide + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind.startswith("array"):
            wide = wide + (32 if "struct" in kind else 8) * F.greatest(F.size(name), F.lit(0))
    if (ids.agg(F.sum(wide.cast("long")).alias("n")).first()["n"] or 0) > most:
        return ids
    sent = F.broadcast(ids)
    sent._tracelens_path = ids._tracelens_path
    return sent
