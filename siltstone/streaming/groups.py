"""Connected components kept between batches of links."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.scratch import Scratch
from siltstone.operators.graph import components
from siltstone.operators.joins import fitting
from siltstone.sources.sinks import write_text


class IncrementalGroups:
    """Groups of linked ids in a folder that all executors share: links are added batch by batch, and find() gives at any
    time what components() gives for all links so far.

    An id is written once, with the component it first came to; a second table says which components have since become
    part of which. A batch turns its links into links between components, joins these, and writes the new ids and the second
    table anew: its work follows the batch and the number of components that were ever joined, not the ids. The version
    file is replaced in one step when a batch is written, so a batch that fails leaves the state as it was, and a batch
    that is added again (same number) adds nothing."""

    def __init__(self, spark: SparkSession, folder: str, kind: str = "long"):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), f"id {kind}, component {kind}"

    def _state(self) -> dict:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/version.json")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return {"version": 0, "batch": None}
        return json.loads(self.spark.read.text(f"{self.folder}/version.json", wholetext=True).first()[0])

    def _tables(self, version: int) -> tuple[DataFrame, DataFrame]:
        """(ids with their first component, components with the one they are part of now)."""
        if not version:
            none = self.spark.createDataFrame([], self.schema)
            return none, none
        read = self.spark.read.schema(self.schema).parquet
        return read(*(f"{self.folder}/ids/{v}" for v in range(1, version + 1))), read(f"{self.folder}/joined/{version}")

    def find(self) -> DataFrame:
        """(id, component) of every id of a link so far: the smallest id that can be reached."""
        return self._find(self._state()["version"])

    def _find(self, version: int) -> DataFrame:
        ids, joined = self._tables(version)
        now = joined.select(F.col("id").alias("component"), F.col("component").alias("now"))
        return ids.join(fitting(now), "component", "left").select("id", F.coalesce("now", "component").alias("component"))

    def add(self, links: DataFrame, batch: int | None = None) -> None:
        """Adds links (a, b). batch: its number, rising; one that is not above the last is taken as added before."""
        state = self._state()
        if batch is not None and state["batch"] is not None and batch <= state["batch"]:
            return
        version, scratch = state["version"], Scratch(self.spark, "groups")
        links = scratch.save(links.select("a", "b").dropna().distinct())
        seen = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        ends = scratch.save(seen.join(self._find(version), "id", "left").select("id", F.coalesce("component", "id").alias("at"), F.col("component").isNotNull().alias("known")))
        a, b = (ends.select(F.col("id").alias(s), F.col("at").alias(f"at_{s}")) for s in "ab")
        comp = components(links.join(a, "a").join(b, "b").select(F.col("at_a").alias("a"), F.col("at_b").alias("b")), scratch)
        became = comp.select(F.col("id").alias("at"), F.col("component").alias("now"))
        fresh = ends.where("NOT known").join(became, "at", "left").select("id", F.coalesce("now", "at").alias("component"))
        # a component that is part of another now, and those that were part of it
        _, joined = self._tables(version)
        moved = joined.withColumnRenamed("component", "at").join(fitting(became), "at", "left").select("id", F.coalesce("now", "at").alias("component"))
        old = ends.where("known").select("at").distinct().join(became, "at").where("at <> now").select(F.col("at").alias("id"), F.col("now").alias("component"))
        fresh.write.mode("overwrite").parquet(f"{self.folder}/ids/{version + 1}")
        moved.unionAll(old).write.mode("overwrite").parquet(f"{self.folder}/joined/{version + 1}")
        write_text(self.spark, f"{self.folder}/version.json", json.dumps({"version": version + 1, "batch": batch if batch is not None else state["batch"]}))
        scratch.clear()

    def clear(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stream_groups(links: DataFrame, folder: str, checkpoint: str, kind: str = "long") -> DataFrame:
    """(id, component) over all micro-batches so far of a stream of links (a, b)."""
    held = IncrementalGroups(links.sparkSession, folder, kind)
    links.writeStream.foreachBatch(lambda batch, epoch: held.add(batch, epoch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return held.find()
