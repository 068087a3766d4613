"""Line dedup by overlapping three-line windows.

Lines are the parts of a text between line feeds; a line of white space only is kept but takes no part. Every three
consecutive remaining lines of a text (each stripped of white space at its ends) are one window, hashed to 128 bits; windows
overlap. A window's occurrences are ordered by (doc_id, text hash, position); all but the first are later occurrences.
The positions covered by later occurrences are merged per document and these lines are removed. A line's earliest
occurrence is never removed, so no line vanishes from the corpus.

Every window takes part, however common: the first occurrence and the count are partial aggregates, and the occurrences of
a very common window are dealt over several tasks when joined with them (joins.hot_join). Texts are read twice, not
shuffled, while the removals take at most `broadcast_mb`; beyond that they are joined by id.

Edge cases: null text stays null with 0 lines; empty text has no lines. Fewer than three lines make no window. Rows
equal in id and text are one document here and get the same result, each. Null ids come first in the order. Extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.octets import once
from siltstone.llm import common
from siltstone.operators.joins import hot_join, hot_keys

SPAN = 3
_SPACE = np.isin(np.arange(256), [9, 11, 12, 13, 32])


def windows(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, line numbers of the window's lines [n, 3], two 64-bit hashes) of all windows of the texts."""
    raw, at = common.text_bytes(text)
    none = np.zeros(0, np.int64)
    if not len(raw):
        return none, none.reshape(0, SPAN), none.astype(np.uint64), none.astype(np.uint64)
    cuts = np.flatnonzero(raw == 10)
    begin = np.union1d(at[:-1], cuts + 1)
    begin = begin[begin < len(raw)]
    row = np.searchsorted(at, begin, side="right") - 1
    end = np.minimum(np.concatenate((cuts, [len(raw)]))[np.searchsorted(cuts, begin)], at[row + 1])
    number = np.arange(len(begin)) - np.searchsorted(begin, at[:-1])[row]
    # strip: first and last byte of each line that is not white space
    solid = np.flatnonzero(~_SPACE[raw] & (raw != 10))
    lo, hi = np.searchsorted(solid, begin), np.searchsorted(solid, end)
    full = hi > lo
    row, number, lo, hi = row[full], number[full], lo[full], hi[full]
    line = common.span_hash(raw, solid[lo], solid[hi - 1] + 1)
    if len(line) < SPAN:
        return none, none.reshape(0, SPAN), none.astype(np.uint64), none.astype(np.uint64)
    i = np.flatnonzero(row[SPAN - 1 :] == row[: 1 - SPAN])
    hashes = []
    for salt in (0x3C6EF372FE94F82B, 0x9B05688C2B3E6C1F):
        h = np.full(len(i), salt, np.uint64)
        for k in range(SPAN):
            h = common.mix(h ^ common.mix(line[i + k] + np.uint64(salt)))
        hashes.append(h)
    return row[i], np.stack([number[i + k] for k in range(SPAN)], axis=1), *hashes


def _emit(batches):
    for whole in batches:
        for batch in common.pieces(whole, "text"):
            row, lines, h1, h2 = windows(batch.column("text"))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("fp").take(at), pa.FixedSizeListArray.from_arrays(pa.array(lines.reshape(-1).astype(np.int32)), SPAN).cast(pa.list_(pa.int32())), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))],
                names=["doc_id", "fp", "lines", "h1", "h2"],
            )


def line_dedup(docs: DataFrame, broadcast_mb: int = 64) -> DataFrame:
    """(doc_id, text, n_lines, n_removed) of each row of docs (doc_id, text): text without the removed lines."""
    scratch = common.Scratch(docs.sparkSession, "line-dedup")
    text = common.column(docs, "text", "string")
    rows = docs.select(common.column(docs, "doc_id", "long").alias("doc_id"), F.xxhash64(text).alias("fp"), text.alias("text"))
    found = scratch.save(rows.mapInArrow(_emit, "doc_id long, fp long, lines array<int>, h1 long, h2 long"))
    place = F.struct("doc_id", "fp", F.col("lines")[0].alias("at"))
    first = scratch.save(found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1"))
    later = hot_join(found, first.drop("n"), ["h1", "h2"], hot_keys(first, ["h1", "h2"], scratch)).where(~place.eqNullSafe(F.col("first")))
    cover = scratch.save(later.select("doc_id", "fp", F.explode("lines").alias("line")).groupBy("doc_id", "fp").agg(F.collect_set("line").alias("cover")))
    cover = cover.select(F.col("doc_id").alias("c_id"), F.col("fp").alias("c_fp"), "cover")
    n_rows, n_lines = cover.agg(F.count("*"), F.sum(F.size("cover").cast("long"))).first()
    if 64 * n_rows + 4 * (n_lines or 0) <= broadcast_mb << 20:
        cover = F.broadcast(cover)
    joined = rows.join(cover, (F.col("fp") == F.col("c_fp")) & F.col("doc_id").eqNullSafe(F.col("c_id")), "left")
    lines = F.split("text", "\n")
    left = lambda all_: F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), "cover")
    kept = once(lines, lambda all_: F.array_join(F.transform(left(all_), lambda i: F.get(all_, i)), "\n"))
    return joined.select("doc_id", F.when(F.col("cover").isNull(), F.col("text")).otherwise(kept).alias("text"), F.when(F.length("text") > 0, F.size(lines)).otherwise(0).cast("long").alias("n_lines"), F.coalesce(F.size("cover"), F.lit(0)).cast("long").alias("n_removed"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_TRIM = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"
OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
a AS (SELECT rid, doc_id, text, unnest(range(len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS raw FROM d WHERE length(text) > 0),
l AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY n) AS k, trim(raw, {_TRIM}) AS line FROM a WHERE trim(raw, {_TRIM}) <> ''),
w AS (SELECT x.doc_id, x.rid, x.n AS n1, y.n AS n2, z.n AS n3, x.line AS a, y.line AS b, z.line AS c
  FROM l x JOIN l y ON x.rid = y.rid AND y.k = x.k + 1 JOIN l z ON z.rid = x.rid AND z.k = x.k + 2),
r AS (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, n1) AS o FROM w),
v AS (SELECT DISTINCT rid, unnest([n1, n2, n3]) AS n FROM r WHERE o > 1),
k AS (SELECT a.rid, string_agg(a.raw, chr(10) ORDER BY a.n) AS text FROM a LEFT JOIN v ON v.rid = a.rid AND v.n = a.n WHERE v.n IS NULL GROUP BY a.rid),
s AS (SELECT rid, count(*) AS n FROM v GROUP BY rid)
SELECT d.doc_id, CASE WHEN coalesce(s.n, 0) = 0 THEN d.text ELSE coalesce(k.text, '') END AS text,
  CASE WHEN length(d.text) > 0 THEN len(string_split(d.text, chr(10))) ELSE 0 END::BIGINT AS n_lines, coalesce(s.n, 0)::BIGINT AS n_removed
FROM d LEFT JOIN k ON k.rid = d.rid LEFT JOIN s ON s.rid = d.rid
"""
