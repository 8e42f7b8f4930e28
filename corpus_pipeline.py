"""Corpus pipeline: rules, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and reread as the next stage's ``docs``.  All but the last return the
columns of ``documents``.  Rejected, duplicate and contaminated documents go;
mixing repeats a document for each whole time it is taken (a part of one half or
more counts as a whole) and drops what is not taken; sharding adds placement.

Decisions are made on narrow rows, and texts pass each stage once.  Null or
wordless texts fail the rules; of rows equal in doc_id and text all stay if one
passes.  A null doc_id is no one's copy: such a row stays
unless it is rejected or contaminated.  Rows that share a doc_id are judged each by
its own text; of rows equal in doc_id and text one stays.  Ties go to the smallest
doc_id.  Empty tables give empty stages, and extra columns of ``documents`` go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.decontamination import contaminated
from weirflow.llm.mixing import mix
from weirflow.llm.near_dedup import BROADCAST_ROWS, near_duplicates, text_key
from weirflow.llm.quality_rules import quality_rules
from weirflow.llm.sharding import shard_rows
from weirflow.storage import Scratch, released

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _without(docs: DataFrame, gone: DataFrame, keep: bool = False) -> DataFrame:
    """Rows of docs (with ``_k``) whose doc_id and text are not (or, if ``keep``, are) in the stored table ``gone`` (doc_id, text_key)."""
    side = gone.select(F.col("doc_id").alias("_id"), "text_key")
    side = F.broadcast(side) if gone.count() <= BROADCAST_ROWS else side
    return docs.join(side, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("text_key")), "left_semi" if keep else "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, s = docs.select(*COLUMNS, text_key(F.col("text")).alias("_k")), Scratch(spark, "quality-stage")
    judged = quality_rules(docs, extra=["_k"]).groupBy("doc_id", F.col("_k").alias("text_key")).agg(F.max("kept").alias("kept"))
    return _without(docs, s.save(judged.where("not kept").select("doc_id", "text_key"), "gone")).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, s = docs.select(*COLUMNS, text_key(F.col("text")).alias("_k")), Scratch(spark, "near-dedup-stage")
    judged = s.save(near_duplicates(docs).where("doc_id is not null").groupBy("doc_id", "text_key").agg(F.min("kept").alias("kept"), F.count("*").alias("n")), "judged")
    left = _without(docs, s.save(judged.where("not kept").select("doc_id", "text_key"), "gone"))
    again = s.save(judged.where("kept and n > 1").select("doc_id", "text_key"), "again")
    if not again.isEmpty():
        left = _without(left, again).unionByName(_without(left, again, keep=True).dropDuplicates(["doc_id", "text"]))
    return left.select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS, text_key(F.col("text")).alias("_k"))
    hits = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["_k"])
    hits = Scratch(spark, "contaminated").save(hits.select("doc_id", F.col("_k").alias("text_key")).distinct(), "rows")
    return _without(docs, hits).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    got = mix(docs.select(*COLUMNS), keep=["text", "lang", "source", "n_chars"])
    times = F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).cast("int")
    return got.where("size > 0 and 2 * taken >= size").withColumn("_n", F.explode(F.sequence(F.lit(1), times))).select(*COLUMNS)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard_rows(docs.select(*COLUMNS), keep=["text", "lang", "source", "n_chars"]).select(*COLUMNS, "size", "text_crc32", "law", "shard", "slot")


STAGES = [("quality_rules", quality_stage), ("near_dedup", near_dedup_stage), ("decontamination", decontamination_stage), ("mixing", mixing_stage), ("sharding", sharding_stage)]

#: Similarity classes, sketches and BM25 retrieval are not expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        with released(spark, scratch):
            before, docs = docs, scratch.save(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
