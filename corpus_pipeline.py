"""A corpus pipeline of five training-data operators.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last
keep the columns of ``documents``.  ``run`` writes each stage's rows to the shared
folder and reads them again, so a lost executor repeats one stage at most.

1. language: documents without a letter (``und``) go; the rest keep their text.
2. line dedup: near-duplicate lines of earlier documents are taken out of the text
   and n_chars follows; documents that lose all their text go.
3. near dedup: one document of each SuperMinHash component stays (five-word shingles, similarity 0.8 or more),
   also of rows without a doc_id, which come last; wholly equal rows of one doc_id become one.
4. decontamination: documents with a benchmark window go.
5. byte-level BPE: doc_id, number of tokens, and digests of the ids and of their decoded bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.llm import bpe, decontaminate, language, linededup, minhash
from tracelens.llm.common import Scratch, bound_batches, fresh, narrow, table

#: Hundredths of Jaccard similarity for the near-dedup stage; the query op10_superminhash has its own.
SIMILAR = 80
#: Numbers that monotonically_increasing_id may need.
ROOM = 1 << 56


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter.  Null, empty and letterless texts go; every other row stays as it is, repeated ones and those without a doc_id too; an empty table stays empty."""
    bound_batches(spark)
    held = language.bucket(F.col("doc_id"), 5) == 0
    predict = language.predictor(spark, language.fit(docs, ~held))
    guess = fresh(docs, "_p")
    return docs.withColumn(guess, predict("text")).where(F.col(guess)["lang"] != "und").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier line removes; n_chars follows where a line went.  Null and empty texts stay; a document that loses all goes; of tied rows each loses its own lines only."""
    out = linededup.remove_lines(docs, Scratch(spark, "lines"))
    removed = F.col(out.columns[-1]) > 0
    emptied = removed & ~F.col("text").rlike(r"\S")
    out = out.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(removed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, that of the smallest doc_id; null and empty texts stay; wholly equal rows of one doc_id become one, its other rows stay or go together; rows without a doc_id come last."""
    scratch, key = Scratch(spark, "minhash"), fresh(docs, "_id")
    # wholly equal rows of one doc_id are one; its other rows are one document, which goes if none of them is kept
    again = narrow(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), scratch)
    named = docs.where("doc_id is not null")
    # rows are compared as JSON: some types of columns, such as maps, cannot be
    whole = fresh(docs, "_row")
    several = named.join(again, "doc_id", "left_semi").withColumn(whole, F.to_json(F.struct(*docs.columns)))
    named = named.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(several.dropDuplicates(["doc_id", whole]).select(*docs.columns))
    # rows without a doc_id get numbers outside the others' range, after them if there is room; saved, as the numbers depend on the run
    low, high = docs.agg(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long"))).first()
    row = F.monotonically_increasing_id()
    if high is not None and high >= 2**63 - ROOM and low < ROOM - 2**63:
        raise ValueError("no numbers are left for rows without a doc_id")
    number = F.lit(low - 1) - row if high is not None and high >= 2**63 - ROOM else F.lit(0 if high is None else high + 1) + row
    nameless = scratch.save(docs.where("doc_id is null").withColumn(key, number.cast("long")), "nameless")
    rows = named.withColumn(key, F.col("doc_id").cast("long")).unionByName(nameless)
    found = minhash.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), scratch, percent=SIMILAR)
    gone = narrow(found.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select(F.col("doc_id").alias(key)), scratch)
    scratch.keep(again, nameless, gone)
    return rows.join(gone, key, "left_anti").select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; null and empty texts, and all rows beside an empty benchmark, stay."""
    bound_batches(spark)
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"), Scratch(spark, "decontaminate"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes of every row; a null text is an empty one."""
    return bpe.digest(docs, Scratch(spark, "bpe"))


STAGES = [
    ("language", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontaminate", drop_benchmark),
    ("byte_bpe", tokenise),
]
#: The automata and the tokeniser are beyond SQL: tests hold every stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
