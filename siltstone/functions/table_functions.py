"""Functions for FROM: extraction callable from SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from siltstone.operators import links as L


_KINDS = {"string": StringType(), "long": LongType(), "int": IntegerType(), "double": DoubleType()}


class ExtractLinks:
    """extract_links(TABLE(chunks) [PARTITION BY ...], dedup): links of chunks, as operators.links.extract gives them; rows of
    chunks need path, chunk_id, chunk_seq, offset and data. A chunk that cannot be scanned gives a row with its error."""

    @staticmethod
    def analyze(chunks: AnalyzeArgument, dedup: AnalyzeArgument) -> AnalyzeResult:
        missing = [] if not chunks.isTable else [c for c in ("path", "chunk_id", "chunk_seq", "offset", "data") if c not in chunks.dataType.fieldNames()]
        if not chunks.isTable or missing:
            raise ValueError(f"extract_links takes a table of chunks first{': it has no column ' + ', '.join(missing) if missing else ''}")
        if dedup.isTable or dedup.dataType.simpleString() != "boolean":
            raise ValueError("extract_links takes a boolean second: whether each id counts once a chunk")
        return AnalyzeResult(schema=StructType([StructField(name, _KINDS[kind]) for name, kind in (f.split() for f in L.OUT.split(", "))]))

    def eval(self, chunks: Row, dedup: bool) -> Iterator[tuple]:
        key = chunks["path"], chunks["chunk_id"], chunks["chunk_seq"]
        try:
            found = list(L.matcher().scan(bytes(chunks["data"] or b""), chunks["offset"], dedup))
        except Exception as e:
            yield (*key, 0, *(None,) * 7, f"{type(e).__name__}: {e}")
            return
        for i, link in enumerate(found):
            yield (*key, i, *link, None)


class FindLinks:
    """find_links(text): all matches of all patterns in a text; for LATERAL joins."""

    def eval(self, text: str) -> Iterator[tuple]:
        if text:
            yield from L.matcher().whole(text)


def register(spark: SparkSession) -> None:
    """Makes the functions callable in this session's SQL."""
    spark.udtf.register("extract_links", udtf(ExtractLinks))
    spark.udtf.register("find_links", udtf(FindLinks, returnType=L.MATCH))
