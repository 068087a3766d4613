"""Quality classifier by importance resampling.

Two generative models of hashed n-grams are counted: one of the target (documents labelled good and not toxic, at most
`target_rows` of them), one of the raw text (all documents). A document's log importance weight is the log ratio of the
two models over its n-grams:

* words (2^20 buckets): the sum over its words. A bucket counts only where target and raw counts differ by more than `z`
  standard deviations (Poisson deviance), so rare buckets add no noise; ratios are taken relative to the ratio of a
  typical word, so length alone earns nothing.
* word pairs (2^16 buckets): the mean ratio per n-gram (words and pairs), scaled to `pair_length` n-grams, where it is
  below that of typical text.

This is not the plain sum of log ratios: buckets of weak evidence (under `z`, or a ratio between `least` and that of a
typical word) count only through the mean. The plain sum over words and pairs was tried with several strengths of smoothing and tells
less (README has the figures): a long text sums up noise of its many weak buckets.

Each document's key is its log weight plus Gumbel noise drawn from its id; the k largest keys are a sample without
replacement with chances in proportion to the weights. k is `share` of the rows, by default the target's share of the
labelled documents. `kept` marks the sample; every document is returned.

Counting covers all text: each task adds up its partition and hands on one row per bucket, so what is shuffled does not
depend on skew. The driver gets one row per bucket. The k-th key is found exactly by refining a histogram.

Edge cases: null, empty or blank text has log weight 0 and competes with its noise. Without labels of either kind all
weights are 0. Rows equal in id get equal noise; at the k-th key, ties go by id, then any of the equal rows. A null id is hashed like
others. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm import common

WORD_BITS, PAIR_BITS = 20, 16


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word buckets, their rows, pair buckets, their rows) of the texts."""
    raw, at = common.text_bytes(text)
    word, _, _, row_at = common.words(raw, at)
    row = np.repeat(np.arange(len(at) - 1), np.diff(row_at))
    one = (common.mix(word ^ np.uint64(11)) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    inside = row[1:] == row[:-1]
    two = common.mix(common.mix(word[:-1] + np.uint64(5)) ^ word[1:]) >> np.uint64(64 - PAIR_BITS)
    return one, row, two.astype(np.int64)[inside], row[1:][inside]


def _counted(batches):
    sizes = (1 << WORD_BITS, 1 << PAIR_BITS)
    raw, good = ([np.zeros(n, np.int64) for n in sizes] for _ in range(2))
    for whole in batches:
        for batch in common.pieces(whole, "text"):
            target = batch.column("target").to_numpy(zero_copy_only=False).astype(bool)
            one, row, two, row2 = features(batch.column("text"))
            for k, (bucket, owner) in enumerate(((one, row), (two, row2))):
                raw[k] += np.bincount(bucket, minlength=sizes[k])
                good[k] += np.bincount(bucket[target[owner]], minlength=sizes[k])
    for k in range(2):
        at = np.flatnonzero(raw[k])
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part + (k << WORD_BITS)), pa.array(raw[k][part]), pa.array(good[k][part])], names=["bucket", "raw", "good"])


def log_ratios(raw: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(log ratio, deviance, log ratio of a typical n-gram) of each bucket; all 0 without target counts."""
    if not good.sum():
        return np.zeros(len(raw)), np.zeros(len(raw)), 0.0
    expected = raw * (good.sum() / raw.sum())
    ratio = np.log((good + 0.5) / (expected + 0.5))
    with np.errstate(divide="ignore", invalid="ignore"):
        deviance = 2 * (expected - good + np.where(good > 0, good * np.log(good / expected), 0.0))
    order = np.argsort(ratio)
    total = np.cumsum(raw[order])
    return ratio, np.nan_to_num(deviance), float(ratio[order][np.searchsorted(total, total[-1] / 2)])


def _scored(model, pair_length: float):
    def run(batches):
        words, plain, pairs, typical = model.value
        for whole in batches:
            for batch in common.pieces(whole, "text"):
                one, row, two, row2 = features(batch.column("text"))
                n = batch.num_rows
                total = np.bincount(row, weights=words[one], minlength=n)
                mean = np.bincount(row, weights=plain[one], minlength=n) + np.bincount(row2, weights=pairs[two], minlength=n)
                mean = mean / np.maximum(np.bincount(row, minlength=n) + np.bincount(row2, minlength=n), 1)
                weight = total + pair_length * np.minimum(mean - typical, 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.where(np.bincount(row, minlength=n) > 0, weight, 0.0))], names=["doc_id", "log_weight"])

    return run


def kth_largest(df: DataFrame, name: str, k: int, parts: int = 4096, enough: int = 20_000) -> tuple[float, float, int]:
    """(low, high, m): the k-th largest value of the column is in [low, high), which holds few rows or one value only;
    m of its rows, the largest, belong to the k largest."""
    low, high = df.agg(F.min(name), F.max(name)).first()
    high = math.nextafter(high, math.inf)
    while True:
        width = (high - low) / parts
        if width <= 0 or low + width == low:
            return low, high, k
        inside = df.where((F.col(name) >= low) & (F.col(name) < high))
        part = F.least(F.floor((F.col(name) - low) / width), F.lit(parts - 1))
        counts = dict(inside.groupBy(part.alias("part")).count().collect())
        for p in range(parts - 1, -1, -1):
            if k <= counts.get(p, 0):
                break
            k -= counts.get(p, 0)
        # the part's exact edges as the rows see them
        edges = inside.where(part == p).agg(F.min(name), F.max(name)).first()
        low, high = edges[0], math.nextafter(edges[1], math.inf)
        if counts[p] <= enough or edges[0] == edges[1]:
            return low, high, k


def quality_classifier(
    docs: DataFrame,
    labels: DataFrame,
    share: float | None = None,
    target_rows: int = 200_000,
    z: float = 3.5,
    least: float = -2.0,
    pair_length: float = 100.0,
    seed: int = 41,
) -> DataFrame:
    """(doc_id, log_weight, sample_key, kept) of each row of docs (doc_id, text); labels: doc_id, quality, toxic."""
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "quality-classifier")
    slim = docs.select(common.column(docs, "doc_id", "long").alias("doc_id"), common.column(docs, "text", "string").alias("text"))
    good = (common.column(labels, "quality", "int") == 1) & (F.coalesce(common.column(labels, "toxic", "int"), F.lit(0)) == 0)
    known = labels.select(common.column(labels, "doc_id", "long").alias("id"), F.coalesce(good, F.lit(False)).alias("good")).where("id is not null").groupBy("id").agg(F.min("good").alias("good"))
    known = scratch.save(known)
    n_known, n_good = known.agg(F.count("*"), F.count_if("good")).first()
    share = n_good / n_known if share is None and n_known else 1.0 if share is None else share
    target = known.where("good").select("id")
    if n_good > target_rows:
        target = target.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(target_rows)
    marked = slim.join(F.broadcast(target), slim["doc_id"] == target["id"], "left").select("text", F.col("id").isNotNull().alias("target"))  # at most `target_rows` ids
    counts = marked.mapInArrow(_counted, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toArrow()
    n = (1 << WORD_BITS) + (1 << PAIR_BITS)
    raw, wanted = np.zeros(n), np.zeros(n)
    at = counts.column("bucket").to_numpy()
    raw[at], wanted[at] = counts.column("raw").to_numpy(), counts.column("good").to_numpy()
    cut = 1 << WORD_BITS
    ratio, deviance, typical = log_ratios(raw[:cut], wanted[:cut])
    pair_ratio, _, pair_typical = log_ratios(raw[cut:], wanted[cut:])
    lift = ratio - typical
    words = np.where((deviance > z * z) & ((lift > 0) | (lift < least)), lift, 0.0)
    model = spark.sparkContext.broadcast((words.astype(np.float32), ratio.astype(np.float32), pair_ratio.astype(np.float32), min(0.0, typical, pair_typical)))
    scored = slim.mapInArrow(_scored(model, pair_length), "doc_id long, log_weight double")
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) + 0.5) / float(1 << 53)
    scored = scratch.save(scored.withColumn("sample_key", F.col("log_weight") - F.log(-F.log(uniform))))
    rows = scored.count()
    k = round(share * rows)
    if k <= 0 or k >= rows:
        return scored.withColumn("kept", F.lit(k > 0))
    low, high, m = kth_largest(scored, "sample_key", k)
    edge = (F.col("sample_key") >= low) & (F.col("sample_key") < high)
    sure = scored.where(~edge).withColumn("kept", F.col("sample_key") >= high)
    # few keys, or one: equal rows are counted, ranked as one and dealt out again, so that many of them do not meet in a task
    same = ["doc_id", "log_weight", "sample_key"]
    before = F.sum("n").over(W.orderBy(F.desc("sample_key"), "doc_id").rowsBetween(W.unboundedPreceding, -1))
    ranked = scored.where(edge).groupBy(*same).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(before, F.lit(0)))
    some = ranked.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(4096).cast("long"))).alias("at"))
    each = some.select(*same, "before", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + 4095, F.col("n") - 1))).alias("at"))
    return sure.unionAll(each.select(*same, (F.col("before") + F.col("at") < m).alias("kept")))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
