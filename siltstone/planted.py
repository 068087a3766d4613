"""Query inputs that Spark and DuckDB can both compute from the given tables: the same SQL text serves both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Three documents each share an id, so groups stay small however large the table is.
VID = "substr(md5(cast(doc_id - doc_id % 3 AS STRING)), 1, 11)"
_SHAPES = (
    ("https://www.youtube.com/watch?v=", ""), ("https://youtu.be/", "?t=12"), ("https://www.youtube.com/embed/", ""), ("https://youtube.com/v/", ""), ("https://www.youtube.com/shorts/", ""), ("https://www.youtube.com/live/", ""), ("https://m.youtube.com/watch?v=", "&x=1"),
    ("https://gaming.youtube.com/watch?v=", ""), ("https://music.youtube.com/watch?v=", ""), ("https://studio.youtube.com/video/", "/edit"), ("https://www.youtubekids.com/watch?v=", ""), ("https://www.youtube-nocookie.com/embed/", ""), ("attribution_link?a=x&v=", ""),
    ("https://google.com/url?q=youtube&v=", ""), ("feature=player_embedded&v=", ""), ("android-app://com.google.android.youtube/http/www.youtube.com/watch?v=", ""), ("page?v=", "&z=2"), ("youtube.com/watch?x=1&v=", "&list=PL"), ('{"video_id": "', '"}'), ('data-video-id="', '"'), ('<meta itemprop="videoId" content="', '">'),
)
URL = "CASE doc_id % 21 " + " ".join(f"WHEN {i} THEN concat('{a}', {VID}, '{b}')" for i, (a, b) in enumerate(_SHAPES)) + " END"
BODY = f"concat(text, chr(10), {URL}, chr(10), repeat('Привет ', cast(doc_id % 5 AS int)))"
#: DuckDB: the planted documents as a CTE named p.
P_SQL = f"p AS (SELECT doc_id, source, lang, text, {VID} AS vid, {BODY} AS body FROM documents)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, text, vid, body, data): documents with a planted link and some Cyrillic words."""
    df = documents(spark, sf_dir).selectExpr("doc_id", "source", "lang", "text", f"{VID} AS vid", f"{BODY} AS body")
    return df.withColumn("data", F.encode("body", "UTF-8"))


def offsets(rows: DataFrame, size: str, width: int = 1024) -> DataFrame:
    """Adds offset, the sum of size over all rows of smaller doc_id: sums of stretches of ids, then inside each."""
    rows = rows.withColumn("_cut", F.floor(F.col("doc_id") / width))
    sums = rows.groupBy("_cut").agg(F.sum(size).alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(W.orderBy("_cut").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    inside = F.coalesce(F.sum(size).over(W.partitionBy("_cut").orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_in", inside).join(sums, "_cut").withColumn("offset", (F.col("_before") + F.col("_in")).cast("long")).drop("_cut", "_before", "_in")


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, vid, body, data, size, offset): the bodies laid end to end as one image."""
    df = bodies(spark, sf_dir).withColumn("size", F.length("data").cast("long"))
    return offsets(df, "size")


#: DuckDB: the bodies laid end to end as a CTE named f.
F_SQL = P_SQL + ", f AS (SELECT *, octet_length(encode(body)) AS size, coalesce(sum(octet_length(encode(body))) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM p)"
#: DuckDB: entropy by doc_id of the bodies, as a CTE named e (after p or f); bytes by hex pairs.
E_SQL = """h AS (SELECT doc_id, hex(encode(body)) AS x FROM p),
b AS (SELECT doc_id, substr(x, 2 * i + 1, 2) AS byte FROM (SELECT doc_id, x, unnest(range(length(x) // 2)) AS i FROM h)),
c AS (SELECT doc_id, byte, count(*) AS n FROM b GROUP BY doc_id, byte),
e AS (SELECT doc_id, -sum((n / t) * log2(n / t)) AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS t FROM c) GROUP BY doc_id)"""
