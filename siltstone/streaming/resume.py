"""Checkpoints of a scan and their validation; incremental scans with Structured Streaming."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstone.operators import links as L
from siltstone.sources.sinks import write_text

CHECKPOINT = "version int, timestamp long, image_path string, image_hash string, position long, state string"


def image_fingerprint(content: Column, length: Column) -> Column:
    """SHA-256 of the first MiB and the length as 8 little-endian bytes."""
    digits = F.lpad(F.hex(length), 16, "0")
    le = F.unhex(F.concat(*(F.substring(digits, 15 - 2 * i, 2) for i in range(8))))
    return F.sha2(F.concat(F.substring(content, 1, 1 << 20), le), 256)


def save_checkpoint(spark: SparkSession, path: str, image_path: str, image_hash: str, position: int, state: dict, backup: bool = False) -> None:
    """Written under another name and renamed; with backup the one before stays as .bak."""
    if backup:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        old = jvm.org.apache.hadoop.fs.Path(path)
        if old.getFileSystem(conf).exists(old):
            write_text(spark, f"{path}.bak", spark.read.text(path, wholetext=True).first()[0])
    write_text(spark, path, json.dumps({"version": 1, "timestamp": int(time.time()), "image_path": image_path, "image_hash": image_hash, "position": position, "state": json.dumps(state)}))


def load_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHECKPOINT).option("multiLine", True).json(path)


def resume_verdict(path_a: Column, path_b: Column, hash_a: Column, hash_b: Column, position: Column, size: Column) -> Column:
    """Null if a scan can go on, else the first reason why not."""
    return F.when(path_a != path_b, "path").when(hash_a != hash_b, "hash").when(position > size, "position")


#: Bytes between two calls of a progress callback.
PROGRESS = 5 * 1024 * 1024


def result(links: DataFrame, bytes_scanned: int, seconds: float) -> dict:
    """What a scan gives back: the links as a table, bytes and time."""
    return {"links": links, "bytes_scanned": bytes_scanned, "duration_secs": seconds}


def stream_links(spark: SparkSession, chunk_dir: str, schema: str, out: str, checkpoint: str, progress: Callable[[dict], None] | None = None, on_hot: Callable[[dict], None] | None = None) -> dict:
    """Scans the chunk files (Parquet: path, chunk_id, chunk_seq, offset, size, data) that are new since the last call, writes their links
    to `<out>/links` and each batch's counts to `<out>/progress`; the checkpoint folder holds the position. The result is
    result() of this call.

    A batch writes the partition of its own number, so a batch that is run again after a failure replaces what it wrote.
    progress: called with the bytes so far whenever over PROGRESS came since the last call; on_hot: called with each hot
    fragment (offset, size, file_type, score, confidence = score / 10), one at a time."""
    from siltstone.plans.scan import features, hot

    began, seen, told = time.time(), 0, 0
    chunks = spark.readStream.schema(schema).parquet(chunk_dir)

    def write(df: DataFrame, epoch: int, name: str) -> None:
        df.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").partitionBy("epoch").option("partitionOverwriteMode", "dynamic").parquet(f"{out}/{name}")

    def sink(batch: DataFrame, epoch: int) -> None:
        nonlocal seen, told
        size = F.length("data").cast("long")
        write(L.extract(batch), epoch, "links")
        links = spark.read.parquet(f"{out}/links").where(F.col("epoch") == epoch).drop("epoch")
        counts = links.groupBy("path").agg(F.count("*").alias("n_links"), F.max("offset").alias("last_offset"))
        read = batch.groupBy("path").agg(F.sum(size).alias("bytes_scanned"), F.count("*").alias("chunks"))
        write(read.join(counts, "path", "left").na.fill(0, ["n_links"]), epoch, "progress")
        seen += batch.agg(F.sum(size)).first()[0] or 0
        if progress and seen - told > PROGRESS:
            told = seen
            progress({"bytes_scanned": seen, "epoch": epoch})
        if on_hot:
            for r in hot(features(batch.withColumn("size", size), links)).select("path", "offset", "size", "file_type", "score").toLocalIterator():
                on_hot(r.asDict() | {"confidence": r.score / 10})

    chunks.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    try:
        links = spark.read.parquet(f"{out}/links")
    except AnalysisException:  # nothing came yet
        links = spark.createDataFrame([], f"{L.OUT}, epoch int")
    return result(links, seen, time.time() - began)


def stream_dedup(events: DataFrame, key: str, out: str, checkpoint: str) -> DataFrame:
    """First row of each key over all micro-batches, written to `out`; the state is the set of keys seen."""
    q = events.dropDuplicates([key]).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return events.sparkSession.read.schema(events.schema).parquet(out)


def _plain(column: pd.Series) -> list:
    """Values of a column as a state keeps them."""
    return [None if pd.isna(v) else v for v in column.tolist()]


def _better(columns: list[str], keys: list[str]):
    """For applyInPandasWithState: the best link of an id is the state; a row comes out whenever it is replaced. An id has
    few rows in a batch, so they are compared as tuples, in the order of links.best_of(): pandas takes milliseconds to sort
    one row."""
    title, sure, *rest = (columns.index(c) for c in ("title", "confidence", *L._rest(columns, keys)))
    part = lambda v: (v is None, 0 if v is None else v)

    def rank(row: tuple) -> tuple:
        return row[title] is None, part(None if row[sure] is None else -row[sure]), *(part(row[i]) for i in rest)

    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        rows = [tuple(held[:-1])] if held else []
        for f in frames:
            rows += zip(*(_plain(f[c]) for c in columns), strict=True)
        best = min(rows, key=rank)
        if not held or best != tuple(held[:-1]):
            version = held[-1] + 1 if held else 1
            state.update((*best, version))
            yield pd.DataFrame([(*best, version)], columns=[*columns, "version"])

    return run


def best_so_far(links: DataFrame, *also: str) -> DataFrame:
    """A stream of the best links of each id (and `also`) as they are found: a row for the first link of an id and for each
    that is better than all before (links.best_links: title, confidence, scan order), numbered by `version`.

    The state is one link an id, so it grows with the ids and not with the links. What a task reads is reduced to the best
    link of each id and Arrow batch before it is shuffled, so a hot id moves a row per batch. With
    spark.sql.streaming.stateStore.providerClass set to Spark's RocksDB provider the state need not fit in memory. Links
    without an id (error rows) are left out."""
    keys, columns = [*also, "video_id"], links.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in links.schema)
    found = links.where(F.col("video_id").isNotNull()).mapInPandas(lambda frames: (L.best_of(f, keys) for f in frames if len(f)), kinds)
    every = f"{kinds}, version long"
    return found.groupBy(*keys).applyInPandasWithState(_better(columns, keys), every, every, "update", GroupStateTimeout.NoTimeout)


def stream_best(links: DataFrame, out: str, checkpoint: str, *also: str) -> DataFrame:
    """The best link of each id (and `also`) over all micro-batches so far of a stream of links. Upgrades are written to
    `out`, the partition of their batch: a batch that runs again after a failure replaces what it wrote, so the result
    equals best_links() of all rows however the stream is cut and wherever it is stopped."""

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").partitionBy("epoch").option("partitionOverwriteMode", "dynamic").parquet(out)

    found = best_so_far(links, *also)
    found.writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    try:
        upgrades = links.sparkSession.read.schema(found.schema.add("epoch", "long")).parquet(out)
    except AnalysisException:  # nothing came yet
        upgrades = links.sparkSession.createDataFrame([], found.schema)
    keys = [*also, "video_id"]
    rest = [c for c in links.columns if c not in keys]
    last = upgrades.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("b"))
    return last.select(*keys, *(F.col(f"b.{c}") for c in rest)).select(*links.columns)
