"""Corpus pipeline: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read again as
the next stage's docs. All stages but the last return the columns of docs.

Rows that a stage rejects are told by (doc_id, hash of the text). They are sent to all executors up to `FEW` rows (two longs
each, about 64 MB as a hash table) and joined by a shuffle beyond. Repeated rows (same id and text) share their fate, but
near-dedup leaves one. Missing columns count as null; an empty table passes through; columns of any other name are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import common
from siltstone.llm.decontaminate import contaminated
from siltstone.llm.mixing import draws
from siltstone.llm.near_dedup import near_duplicates
from siltstone.llm.quality_rules import quality_rules
from siltstone.llm.sharding import shard

FEW = 600_000


def _fp(docs: DataFrame) -> Column:
    return F.xxhash64(common.column(docs, "text", "string"))


def _free(docs: DataFrame, prefix: str) -> str:
    """The prefix, with underscores before it until no column of docs begins with it."""
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return prefix


def without(docs: DataFrame, rejected: DataFrame, name: str) -> DataFrame:
    """docs without the rows whose (doc_id, fp) are in rejected."""
    gone = _free(docs, "gone_")
    rejected = rejected.distinct().toDF(f"{gone}id", f"{gone}fp")
    rejected = common.Scratch(docs.sparkSession, name).save(rejected)
    if rejected.count() <= FEW:
        rejected = F.broadcast(rejected)
    same = common.column(docs, "doc_id", "long").eqNullSafe(F.col(f"{gone}id")) & (_fp(docs) == F.col(f"{gone}fp"))
    return docs.join(rejected, same, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, quality_rules(docs).where("not kept").select("doc_id", "fp"), "pipeline-quality")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch, inner = common.Scratch(spark, "pipeline-near-dedup"), common.Scratch(spark, "near-dedup")
    found = scratch.save(near_duplicates(docs, scratch=inner).select("doc_id", "fp", "kept"))
    inner.clear()  # or its tables would lie there until the last stage ends
    left = without(docs, found.where("not kept").select("doc_id", "fp"), "pipeline-near-dedup")
    if found.where("kept and doc_id is not null").groupBy("doc_id", "fp").count().where("count > 1").isEmpty():
        return left
    fp = _free(left, "fp_")
    named = left.where(F.col("doc_id").isNotNull()).withColumn(fp, _fp(left)).dropDuplicates(["doc_id", fp]).drop(fp)
    return named.unionAll(left.where(F.col("doc_id").isNull()))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pairs = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, pairs.select("doc_id", "fp"), "pipeline-decontaminate")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each document and pass of the mix: the whole text, or the words of the document's drawn slots in the
    text's order, each with the white space before it. Of rows equal in id, source and text one stands for all."""
    scratch = common.Scratch(spark, "pipeline-mixing")
    drawn = scratch.save(draws(docs).withColumnsRenamed({"doc_id": "d_id", "source": "d_source", "fp": "d_fp"}))
    if "text" not in docs.columns:
        return docs.limit(0)  # no words, so nothing is taken
    # the table's columns travel in one, so that they meet no name of the mix
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(row, common.column(docs, "doc_id", "long").alias("id"), common.column(docs, "source", "string").alias("source"), _fp(docs).alias("fp"))
    key = ["id", "source", "fp"]
    if not rows.groupBy(*key).count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates(key)
    same = [F.col(k).eqNullSafe(F.col(f"d_{k}")) for k in key]
    rows = rows.join(drawn, same[0] & same[1] & same[2])
    whole = F.col("words") >= F.col("size")
    words = F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    # the array around the words lets them be worked out once, not for each stretch
    cut = F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform("stretches", lambda x: F.slice(w, (x["begin"] + 1).cast("int"), (x["end"] - x["begin"]).cast("int")))), ""))[0]
    rows = rows.withColumn("text", F.when(whole, F.col("row.text")).otherwise(cut))
    out = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(whole, F.col("row.n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*(x.alias(c) for c, x in out.items()))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard(docs)


STAGES = [("quality rules", quality), ("near dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mixing), ("sharding", sharding)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = common.Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
