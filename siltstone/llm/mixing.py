"""Mixing sources to target weights, with DataFrame functions only.

1. A source's words are one long sequence: its documents one after the other in a pseudorandom order, so each document
   has a first word number. The sequence is cut into blocks of `block` words; the last may be shorter.
2. Targets: each source's share by weight of all words, at most `repeat` times its own size; what exceeds that is shared
   out again by weight until no source is above (water-filling, in closed form over the sources sorted by limit / weight).
3. A source's words to take are its rounded target: whole passes over its blocks and a last, partial pass. This gives
   its number of slots. The slots of all sources are dealt to output shards: a pseudorandom permutation of the slot
   numbers orders them and shards take runs of `shard_slots`, so a shard's source counts are a multinomial draw
   conditioned on the source totals (multivariate hypergeometric) and the totals meet the targets to the word.
4. In each pass a swap-or-not network (Hoang, Morris, Rogaway 2012), keyed by source and pass, permutes the block
   numbers: slot j of the pass takes block permutation(j). Slots join blocks by (source, block).

First word numbers come from sums over (source, bucket) and a running sum inside a bucket, with buckets in proportion to
the source's documents; no source is gathered in one task. Slots and blocks have unique keys, so joins are even however
large a source is. Only the table of sources and that of their stretches of slots are broadcast, up to
`broadcast_sources` rows.

Edge cases: null text has size 0; a document of size 0 takes nothing; null is a source of its own, sorted last; without
words nothing is taken. Rows equal in id, source and text share what they take evenly. Extra columns are ignored.
Reruns agree: every order and draw is a hash of stored values and `seed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm import common

ROUNDS = 12


def permuted(i: Column, n: Column, *key) -> Column:
    """A pseudorandom permutation of 0 .. n - 1, at i: swap-or-not rounds keyed by the columns of key."""

    def swap(x: Column, r: Column) -> Column:
        partner = F.pmod(F.xxhash64(*key, r, F.lit("k")), n) - x
        partner = F.when(partner < 0, partner + n).otherwise(partner)
        return F.when(F.xxhash64(*key, r, F.greatest(x, partner)).bitwiseAND(F.lit(1)) == 1, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), i.cast("long"), swap)


def targets(sources: DataFrame, repeat: int, weights: tuple[int, ...]) -> DataFrame:
    """Adds ord, weight and target to (source, source_size, ...).

    target = min(weight * level, repeat * size), with the one level at which the targets add up to all sizes. Sources
    sorted by limit / weight are full up to some point: the level then is (all - full limits) / (remaining weights)."""
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    s = sources.withColumn("ord", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("ord"), F.lit(len(weights))) + 1))
    s = s.withColumn("most", F.lit(repeat) * F.col("source_size"))
    full = W.orderBy(F.col("most") / F.col("weight"), "ord").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    s = s.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(full), F.lit(0)))
    s = s.withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(full), F.lit(0)))
    # the first source in this order that the level of its own turn does not fill sets the level
    s = s.withColumn("level", F.col("left") / F.col("open"))
    s = s.withColumn("level", F.min(F.when(F.col("weight") * F.col("level") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), "ord", "level"))).over(every)["level"])
    target = F.least(F.col("weight") * F.col("level"), F.col("most").cast("double"))
    return s.withColumn("target", F.coalesce(target, F.col("most").cast("double"))).drop("left", "open", "level", "most")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, fp, size): fp stands for the text among rows of one id."""
    text = common.column(docs, "text", "string")
    return docs.select(common.column(docs, "doc_id", "long").alias("doc_id"), common.column(docs, "source", "string").alias("source"), F.xxhash64(text).alias("fp"), common.word_count(text).alias("size"))


def _dealt(
    docs: DataFrame,
    block: int = 64,
    repeat: int = 3,
    weights: tuple[int, ...] = (1, 2, 3),
    shard_slots: int = 1 << 14,
    seed: int = 17,
    bucket_rows: int = 10_000,
    broadcast_sources: int = 100_000,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents with their first word numbers, the slots, and the documents' pieces of blocks: (ord, block, at, begin,
    end), at being the document's first word number and begin and end words of the block."""
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "mixing")
    rows = scratch.save(sized(docs))
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sources = scratch.save(targets(sources, repeat, weights))
    n_sources = sources.count()
    small = n_sources <= broadcast_sources
    spread = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    # words to take: whole passes, then `rest` words of a last one
    plan = sources.withColumn("quota", F.round("target").cast("long")).where("quota > 0")
    plan = plan.withColumn("passes", F.floor(F.col("quota") / F.col("source_size"))).withColumn("rest", F.col("quota") % F.col("source_size"))
    plan = plan.withColumn("full", F.floor(F.col("source_size") / block)).withColumn("tail", F.col("source_size") % block)
    plan = plan.withColumn("per_pass", F.col("full") + (F.col("tail") > 0).cast("long"))
    plan = plan.withColumn("n_slots", F.col("passes") * F.col("per_pass") + F.least(F.ceil(F.col("rest") / block), F.col("per_pass")))
    ahead = W.orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    plan = scratch.save(plan.withColumn("slot_at", F.coalesce(F.sum("n_slots").over(ahead), F.lit(0))).select("source", "ord", "source_size", "quota", "passes", "rest", "full", "tail", "per_pass", "n_slots", "slot_at"))
    total = plan.agg(F.sum("n_slots")).first()[0] or 0

    # first word of each document in its source's sequence
    sources_of = spread(sources.select(F.col("source").alias("s"), "ord", "source_size", "n_docs", "target"))
    placed = rows.join(sources_of, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    buckets = F.floor(F.col("n_docs") / bucket_rows) + 1
    placed = scratch.save(placed.withColumn("draw", F.xxhash64("doc_id", "fp", F.lit(seed))).withColumn("bucket", F.pmod(F.xxhash64("draw"), buckets)))
    sums = placed.groupBy("ord", "bucket").agg(F.sum("size").alias("words"))
    before = sums.withColumn("bucket_at", F.coalesce(F.sum("words").over(W.partitionBy("ord").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("words")
    inside = W.partitionBy("ord", "bucket").orderBy("draw", "doc_id", "fp").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(before, ["ord", "bucket"])
    placed = scratch.save(placed.withColumn("at", F.col("at") + F.col("bucket_at")).select("doc_id", "source", "fp", "size", "ord", "source_size", "target", "at"))

    # slots: number g of the whole mix, ordered by the global permutation into shards
    edge = spread(plan)
    per_task = 1 << 16
    g = spark.range(0, total, 1, max(1, min(-(-total // per_task), 20_000))).select(F.col("id").alias("g"))
    lots = scratch.save(plan.select("ord", "slot_at", "n_slots", F.explode(F.sequence(F.floor(F.col("slot_at") / per_task), F.floor((F.col("slot_at") + F.col("n_slots") - 1) / per_task))).alias("lot")))
    if total // per_task + n_sources <= broadcast_sources:
        lots = F.broadcast(lots)
    slots = g.withColumn("lot", F.floor(F.col("g") / per_task)).join(lots, "lot").where("g >= slot_at and g < slot_at + n_slots").drop("n_slots", "lot", "slot_at").join(edge.drop("n_slots"), "ord")
    i = F.col("g") - F.col("slot_at")
    slots = slots.withColumn("pass", F.floor(i / F.col("per_pass"))).withColumn("j", i % F.col("per_pass"))
    slots = slots.withColumn("block", F.when(F.col("j") < F.col("full"), permuted(F.col("j"), F.col("full"), F.col("ord"), F.col("pass"), F.lit(seed))).otherwise(F.col("full")))
    length = F.when(F.col("j") < F.col("full"), F.lit(block)).otherwise(F.col("tail"))
    # the last pass ends in the middle of a block
    left = F.when(F.col("pass") < F.col("passes"), length).otherwise(F.least(length, F.col("rest") - F.col("j") * block))
    order = permuted(F.col("g"), F.lit(total).cast("long"), F.lit(seed), F.lit("shards"))
    slots = slots.select("ord", "source", "pass", "block", left.cast("long").alias("n_words"), order.alias("place"))
    slots = slots.select("ord", "source", "pass", "block", "n_words", F.floor(F.col("place") / shard_slots).alias("shard"), (F.col("place") % shard_slots).alias("position"))

    # each document's pieces of blocks, joined with the blocks' slots
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)
    piece = placed.where("size > 0").select("ord", "doc_id", "fp", "at", "size", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("at") - F.col("block") * block, F.lit(0))
    end = F.least(F.col("at") + F.col("size") - F.col("block") * block, F.lit(block))
    piece = piece.select("ord", "block", "at", begin.alias("begin"), end.alias("end"))
    return placed, slots, piece


def mix(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """The documents with what the mix takes of each, and the packed slots; options are those of _dealt.

    documents: doc_id, source, fp, size, source_size, target, taken, one row per row of docs.
    slots: shard, position (in the shard), source, pass, block, n_words; with the blocks' pieces they are the mix."""
    placed, slots, piece = _dealt(docs, **options)
    drawn = slots.groupBy("ord", "block").agg(F.collect_list("n_words").alias("draws"))  # at most `repeat` + 1 slots of a block
    got = piece.join(drawn, ["ord", "block"]).select("ord", "at", F.aggregate("draws", F.lit(0).cast("long"), lambda n, d: n + F.greatest(F.least(F.col("end"), d) - F.col("begin"), F.lit(0))).alias("words"))
    taken = got.groupBy("ord", "at").agg(F.sum("words").alias("taken"))
    some = placed.where("size > 0").join(taken, ["ord", "at"], "left").select("doc_id", "source", "fp", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    none = placed.where("size = 0").select("doc_id", "source", "fp", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return some.unionAll(none), slots


def draws(docs: DataFrame, block: int = 64, **options) -> DataFrame:
    """(doc_id, source, fp, size, pass, words, stretches): what each pass takes of each row of docs, where it takes any.

    stretches: (begin, end) of the drawn slots' words, counted in the document, ascending; words is their sum."""
    placed, slots, piece = _dealt(docs, block=block, **options)
    drawn = slots.groupBy("ord", "block").agg(F.collect_list(F.struct("pass", "n_words")).alias("draws"))
    got = piece.join(drawn, ["ord", "block"]).select("ord", "block", "at", "begin", "end", F.explode("draws").alias("d"))
    start = F.col("block") * block - F.col("at")
    got = got.select("ord", "at", "d.pass", (start + F.col("begin")).alias("begin"), (start + F.least(F.col("end"), F.col("d.n_words"))).alias("end")).where("end > begin")
    got = got.groupBy("ord", "at", "pass").agg(F.sum(F.col("end") - F.col("begin")).alias("words"), F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("stretches"))
    return placed.where("size > 0").join(got, ["ord", "at"]).select("doc_id", "source", "fp", "size", "pass", "words", "stretches")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, _ = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
