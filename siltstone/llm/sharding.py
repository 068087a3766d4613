"""Sharding by balanced label propagation.

Documents start in a pseudorandom shard. Links (here: rows of equal text, each linked with its group's first row) pull:
in every round Spark joins links with the shards of their ends, each document adds up the votes of neighbours of higher
rank (more links, then a hash), and asks to move to the shard with most votes. A shard admits movers only as far as
its quota of linked bytes allows, in the order of the leaders' ranks; a mover is admitted if the bytes asked for ahead of it fit. Rounds end
when nobody is admitted. A group that then lies in several shards and is not larger than one is taken out and placed
anew as a whole: the largest `greedy` such groups go one by one to the emptiest shard if it has room (`slack` of a
shard's size more at most), the smaller ones lie in a row and the shards take consecutive stretches of it. Documents
without links, and those of groups that fit nowhere (larger than a shard, or than the room left in any), level the shards
at the end: the largest `greedy` of them go one by one to the emptiest shard, the rest lie in a row and the shards take
consecutive stretches of it, as long as what they lack. Shard sizes then differ by about one small document, and by
`slack` or a small group more where groups fill almost everything. The law is `bytes`.

A document with very many links, and the members of a very large group, are dealt over several tasks where they are joined
with what holds for all of them (joins.hot_join). Sums along a row are two-level (buckets, then inside a bucket), with buckets in proportion to the rows, so no shard or
group is gathered in one task. Only the `greedy` largest sizes of groups and documents and per-shard sums come to the driver.

Scratch tables hold numbers, not texts, and are written by as many tasks as have `bucket_rows` rows each, or one for each
core if that is more: without Hadoop's native library the JVM starts processes for each file that it writes, and until
such a process has begun its own program it counts with the whole memory of the JVM.

Edge cases: null text counts 8 bytes and belongs to no group; empty texts are a group. Repeated rows are rows of a
group. A null id is allowed. Extra columns are ignored; an empty table gives no rows. Reruns agree.
"""

from __future__ import annotations

import heapq
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm import common
from siltstone.operators.joins import hot_join, hot_keys


class Scratch(common.Scratch):
    """Scratch tables that at most `tasks` tasks write, if that is set."""

    tasks: int | None = None

    def save(self, df: DataFrame) -> DataFrame:
        return super().save(df.coalesce(self.tasks) if self.tasks else df)


def numbered(df: DataFrame, group: list[str], order: list[Column], size: Column, scratch: common.Scratch, bucket_rows: int) -> DataFrame:
    """Adds `ahead` (sum of size over the rows before in the group's order) and `index` (their number).

    The order is by `bucket` first: a hash share of the first order column, so that buckets are even."""
    sizes = df.groupBy(*group).agg(F.count("*").alias("_n"))
    most = max(1, (sizes.agg(F.max("_n")).first()[0] or 0) // bucket_rows + 1)
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(most))).withColumn("_size", size)
    df = scratch.save(df)
    sums = df.groupBy(*group, "_bucket").agg(F.sum("_size").alias("_s"), F.count("*").alias("_c"))
    before = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*group, "_bucket", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_c0"))
    inside = W.partitionBy(*group, "_bucket").orderBy(*order)
    df = df.withColumn("_s1", F.coalesce(F.sum("_size").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_c1", F.row_number().over(inside) - 1)
    out = df.join(F.broadcast(sums) if most <= 10_000 else sums, [*group, "_bucket"])
    return out.withColumn("ahead", F.col("_s0") + F.col("_s1")).withColumn("index", (F.col("_c0") + F.col("_c1")).cast("long")).drop("_bucket", "_size", "_s0", "_c0", "_s1", "_c1")


def places(spark: SparkSession, name: str, chosen: list[tuple[int, int | None]]) -> DataFrame:
    """(name, shard) of the driver's list, without Python on the executors."""
    ids, shard = zip(*chosen, strict=True) if chosen else ((), ())
    return spark.createDataFrame(pa.table({name: pa.array(ids, pa.int64()), "shard": pa.array(shard, pa.int32())}))


def propagate(nodes: DataFrame, links: DataFrame, shards: int, quota: float, scratch: common.Scratch, bucket_rows: int) -> DataFrame:
    """Moves nodes (uid, size, shard) along links (a, b): (uid, size, shard, content).

    quota: bytes of linked nodes that a shard may hold. content: the node sits where its votes want it."""
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    degree = both.groupBy("a").agg(F.count("*").alias("n"))
    rank = F.struct(F.col("n").alias("degree"), F.xxhash64("a").alias("h"))
    ranks = scratch.save(degree.select("a", "n", rank.alias("rank")))
    hot = hot_keys(ranks, ["a"], scratch)  # of both ends, as links are there in both directions
    hot_b = hot.withColumnRenamed("a", "b") if hot else None
    up = hot_join(both, ranks.select("a", F.col("rank").alias("rank_a")), ["a"], hot)
    up = hot_join(up, ranks.select(F.col("a").alias("b"), F.col("rank").alias("rank_b")), ["b"], hot_b)
    up = scratch.save(up.where("rank_b > rank_a").select("a", "b", "rank_b"))
    at = scratch.save(nodes.join(ranks, nodes["uid"] == ranks["a"]).select("uid", "size", "shard"))
    # the group a mover belongs to, for the order of admission: its strongest neighbour
    lead = scratch.save(up.groupBy("a").agg(F.max("rank_b").alias("lead")))
    wish = None
    while True:  # ends: a node's votes are settled once those of its neighbours of higher rank are
        votes = hot_join(up, at.select(F.col("uid").alias("b"), F.col("shard").alias("to")), ["b"], hot_b).groupBy("a", "to").agg(F.count("*").alias("votes"))
        wish = votes.groupBy("a").agg(F.max_by("to", F.struct("votes", "to")).alias("to")).join(lead, "a")
        asked = at.join(wish, at["uid"] == wish["a"]).where("to <> shard").select("uid", "size", "to", "lead")
        asked = scratch.save(asked)
        if asked.isEmpty():
            break
        used = dict(at.groupBy("shard").agg(F.sum("size")).collect())
        room = F.element_at(F.array(*(F.lit(float(quota - used.get(s, 0))) for s in range(shards))), F.col("to") + 1)
        # groups queue by size, then a hash; a group's members stand together
        queue = scratch.save(asked.groupBy("to", "lead").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
        crowds = hot_keys(queue, ["to", "lead"], scratch)
        queue = queue.withColumn("before", F.coalesce(F.sum("bytes").over(W.partitionBy("to").orderBy("lead").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        whole = queue.where(F.col("before") + F.col("bytes") <= room).select("to", "lead")
        partly = queue.where((F.col("before") + F.col("bytes") > room) & (F.col("before") < room)).select("to", "lead", "before")
        admitted = hot_join(asked, whole, ["to", "lead"], crowds, "left_semi").select("uid", "to")
        cut = asked.join(F.broadcast(partly), ["to", "lead"])  # at most one group of each shard
        cut = numbered(cut, ["to"], [F.xxhash64("uid")], F.col("size"), scratch, bucket_rows)
        admitted = scratch.save(admitted.unionAll(cut.where(F.col("before") + F.col("ahead") + F.col("size") <= room).select("uid", "to")))
        if admitted.isEmpty():
            break
        moved = at.join(admitted, "uid", "left").select("uid", "size", F.coalesce("to", "shard").alias("shard"))
        at = scratch.save(moved)
    if wish is None:
        return at.select("uid", "size", "shard", F.lit(True).alias("content"))
    # a node is content if its best-ranked votes agree with its place
    votes = hot_join(up, at.select(F.col("uid").alias("b"), F.col("shard").alias("to")), ["b"], hot_b).groupBy("a", "to").agg(F.count("*").alias("votes"))
    best = votes.groupBy("a").agg(F.max_by("to", F.struct("votes", "to")).alias("to"))
    return at.join(best, at["uid"] == best["a"], "left").select("uid", "size", "shard", (F.col("to").isNull() | (F.col("to") == F.col("shard"))).alias("content"))


def stretch(filled: dict[int, float], share: float, bytes_: float) -> Column:
    """The shard of a row of `size` bytes with `ahead` bytes before it in a row of bytes_, of which the shards take
    consecutive stretches in proportion to what they lack."""
    lack = [max(0.0, share - filled[s]) for s in sorted(filled)]
    scale = bytes_ / sum(lack) if sum(lack) else 0.0
    middle = F.col("ahead") + F.col("size") / 2
    return reduce(lambda x, edge: x + (middle >= edge * scale).cast("int"), list(accumulate(lack))[:-1], F.lit(0))


def fill(placed: DataFrame, shards: int) -> dict[int, float]:
    return {s: 0 for s in range(shards)} | dict(placed.groupBy("shard").agg(F.sum("size")).collect())


def together(linked: DataFrame, links: DataFrame, shards: int, share: float, scratch: common.Scratch, greedy: int, slack: float, seed: int, bucket_rows: int) -> DataFrame:
    """(uid, shard, size) of the linked nodes that have a place, groups in several shards placed anew as a whole."""
    spark = linked.sparkSession
    content = linked.where("content").select("uid", "shard", "size")
    members = links.select(F.col("a").alias("uid"), F.col("b").alias("lead")).unionAll(links.select(F.col("b").alias("uid"), F.col("b").alias("lead")).distinct())
    members = scratch.save(linked.join(members, "uid").select("uid", "size", "shard", "lead"))
    groups = members.groupBy("lead").agg(F.sum("size").alias("size"), F.min("shard").alias("low"), F.max("shard").alias("high"), F.count("*").alias("n"))
    split = scratch.save(groups.where((F.col("low") < F.col("high")) & (F.col("size") <= share)).select("lead", "size", "n"))
    if split.isEmpty():
        return content
    crowds = hot_keys(split, ["lead"], scratch)
    out = scratch.save(hot_join(members, split.select("lead"), ["lead"], crowds, "left_semi").select("uid", "size", "lead"))
    kept = scratch.save(content.join(out, "uid", "left_anti"))
    heap = [(used, s) for s, used in fill(kept, shards).items()]
    heapq.heapify(heap)
    chosen = []
    for r in split.orderBy(F.desc("size"), "lead").limit(greedy).collect():
        used, s = heap[0]
        fits = used + r.size <= share * (1 + slack)
        chosen.append((r.lead, s if fits else None))
        if fits:
            heapq.heapreplace(heap, (used + r.size, s))
    large = F.broadcast(places(spark, "lead", chosen))  # at most `greedy` rows
    small = scratch.save(numbered(split.join(large, "lead", "left_anti"), [], [F.xxhash64("lead", F.lit(seed))], F.col("size"), scratch, bucket_rows))
    rest = small.agg(F.sum("size")).first()[0] or 0
    spot = large.where("shard is not null").unionAll(small.select("lead", stretch({s: used for used, s in heap}, share, rest).alias("shard")))
    return kept.unionAll(hot_join(out, scratch.save(spot), ["lead"], crowds).select("uid", "shard", "size"))


def shard(docs: DataFrame, shards: int = 24, greedy: int = 4096, slack: float = 0.01, seed: int = 29, bucket_rows: int = 20_000) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = common.column(docs, "text", "string")
    rows = docs.select(
        common.column(docs, "doc_id", "long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"),
        F.when(text.isNotNull(), F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(seed), text).alias("h2"))).alias("key"),
    )
    rows = scratch.save(rows)  # by the tasks that read the texts
    scratch.tasks = max(spark.sparkContext.defaultParallelism, rows.count() // bucket_rows + 1)
    # equal rows are told apart by a number; which of them gets which number does not matter
    rows = scratch.save(numbered(rows, [], [F.xxhash64("doc_id", "key"), F.col("doc_id"), F.col("key")], F.lit(0), scratch, bucket_rows).withColumnRenamed("index", "uid").drop("ahead"))
    groups = scratch.save(rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("uid").alias("b")).where("n > 1"))
    links = hot_join(rows.select("key", "uid"), groups.select("key", "b"), ["key"], hot_keys(groups, ["key"], scratch))
    links = scratch.save(links.where("uid <> b").select(F.col("uid").alias("a"), "b"))
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    share = (total or 0) / shards
    nodes = rows.select("uid", "size", F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(shards)).cast("int").alias("shard"))
    linked = scratch.save(propagate(nodes, links, shards, share, scratch, bucket_rows))
    placed = scratch.save(together(linked, links, shards, share, scratch, greedy, slack, seed, bucket_rows))
    free = scratch.save(nodes.select("uid", "size").join(placed, "uid", "left_anti"))
    filled = fill(placed, shards)
    # the largest free documents, one by one to the emptiest shard
    top = free.orderBy(F.desc("size"), "uid").limit(greedy).collect()
    heap = [(filled[s], s) for s in range(shards)]
    heapq.heapify(heap)
    chosen = []
    for r in top:
        used, s = heapq.heappop(heap)
        chosen.append((r.uid, s))
        heapq.heappush(heap, (used + r.size, s))
    filled = {s: used for used, s in heap}
    large = F.broadcast(places(spark, "uid", chosen))  # at most `greedy` rows
    # the rest in a row, cut into stretches as long as what each shard lacks
    small = numbered(free.join(large, "uid", "left_anti"), [], [F.xxhash64("uid", F.lit(seed))], F.col("size"), scratch, bucket_rows)
    rest = (total or 0) - sum(filled.values())
    to = stretch(filled, share, rest)
    spot = placed.select("uid", "shard").unionAll(large.select("uid", "shard")).unionAll(small.select("uid", to.alias("shard")))
    done = scratch.save(rows.select("uid", "doc_id", "size", "text_crc32").join(spot, "uid"))
    done = numbered(done, ["shard"], [F.xxhash64("uid")], F.lit(0), scratch, bucket_rows)
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("index").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
