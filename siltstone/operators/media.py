"""Files of one media item: grouping, the preferred file, categories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import predicates as V

INFO, CAPTIONS = ".info.json", ".vtt"
LEAST = 0.2


def preference(name: Column) -> Column:
    """0 for the description, 1 for captions, 2 for other files."""
    return F.when(name.endswith(INFO), 0).when(name.endswith(CAPTIONS), 1).otherwise(2)


def grouped(files: DataFrame) -> DataFrame:
    """(media_group, n, best) of files (name): the preferred file of each group, by name among equals."""
    named = files.select("name", V.media_group(F.col("name")).alias("media_group"))
    return named.groupBy("media_group").agg(F.count("*").alias("n"), F.min_by("name", F.struct(preference(F.col("name")), "name")).alias("best"))


def description(info: Column) -> Column:
    """Title and description of an info file's JSON text, with a space between."""
    part = lambda k: F.coalesce(F.get_json_object(info, f"$.{k}"), F.lit(""))
    return F.concat(part("title"), F.lit(" "), part("description"))


def categorised(files: DataFrame, classify: Callable[[Column], Column]) -> DataFrame:
    """files (name, text) with media_group and category: that of the group's first info file if the classifier is sure of
    it by more than LEAST, else of its first such captions, else Unknown.

    classify: from a text column to a struct of category and confidence. Info files are read by title and description."""
    name = F.col("name")
    rank = preference(name)
    read = files.withColumn("media_group", V.media_group(name))
    judged = read.where(rank < 2).select("media_group", "name", rank.alias("rank"), classify(F.when(rank == 0, description(F.col("text"))).otherwise(F.col("text"))).alias("c"))
    # of several info files only the first counts
    tries = judged.groupBy("media_group").agg(
        F.min_by("c", F.when(F.col("rank") == 0, F.col("name"))).alias("info"),
        F.min_by("c", F.when((F.col("rank") == 1) & (F.col("c.confidence") > LEAST), F.col("name"))).alias("captions"),
        F.count_if(F.col("rank") == 0).alias("infos"),
    )
    sure = F.when((F.col("infos") > 0) & (F.col("info.confidence") > LEAST), F.col("info.category")).otherwise(F.when(F.col("captions.confidence") > LEAST, F.col("captions.category")))
    return read.join(tries.select("media_group", sure.alias("category")), "media_group", "left").withColumn("category", F.coalesce("category", F.lit("Unknown")))


def sort_into(files: DataFrame, directory: str) -> None:
    """Writes files under one folder for each category."""
    files.write.mode("overwrite").partitionBy("category").parquet(directory)
