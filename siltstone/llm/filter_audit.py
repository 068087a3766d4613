"""Filter interaction audit: what each filter removes in every order of the filters.

Five filters judge whole texts. A: under `min_words` words. B: distinct words under `distinct_pct` percent of the words.
C: capitals A-Z over `capital_pct` percent of the code points. D: any of SYMBOLS. E: equal to the text of a smaller doc_id
anywhere in the table. `failures()` gives each row's failed filters as a bit mask, with what was measured; `interactions()`
turns masks into the table of all orders.

Texts are scanned in their Arrow buffers: byte classes by table lookup and prefix sums over a batch count words, capitals,
symbols and code points of all its rows at once. Distinct words come from each document's sorted word hashes; of equal
neighbours the bytes are compared, and a row where two words share a hash is counted from the words themselves.

E needs no group in one task: the smallest id of each repeated text (by SHA-256) is a partial aggregate, and the rows of
a very common text are dealt over tasks when joined with it, as are those of one doc_id when labels are joined. From then
on only counts by (part, mask) move: at most 32 rows a part and task. All 120 orders follow from these counts, as what a
step removes depends only on its filter and on the set of filters before it (80 such pairs). The Shapley column is the
exact sum over all orders: of the k filters that a document fails each comes first in 120 / k orders.

Edge cases: null text is empty (0 words: fails A only, and E where another is empty too); a null doc_id is neither
smaller nor larger than another, so such rows never fail E nor make others fail; rows of the same doc_id do not make each
other fail. Repeated rows count each. Null parts count as ''. Labels of one doc_id count together: quality=1 or toxic=1
in any of its rows; a missing column or an absent label counts as neither. Extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import common
from siltstone.operators.joins import dealt_join

FILTERS = "ABCDE"
#: The characters of filter D.
SYMBOLS = "#$%&*|"
MEASURES = ("n_words", "n_distinct", "n_capitals", "n_symbols", "n_code_points")
_CAPITAL = np.isin(np.arange(256), np.arange(65, 91))
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])
_LEADING = np.arange(256) & 0xC0 != 0x80


def _per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[at[1:]] - total[at[:-1]]


def _equal_bytes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Do the spans that begin at a and b, of the same sizes, hold the same bytes."""
    if not len(size):
        return np.zeros(0, bool)
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    step = np.arange(size.sum()) - np.repeat(begin, size)
    differs = raw[np.repeat(a, size) + step] != raw[np.repeat(b, size) + step]
    return np.add.reduceat(differs, begin) == 0


def distinct_words(raw: np.ndarray, word: np.ndarray, starts: np.ndarray, ends: np.ndarray, row_at: np.ndarray) -> np.ndarray:
    """Number of distinct words of each row: what common.words() gives, with hashes verified by the words' bytes."""
    rows, n = len(row_at) - 1, np.diff(row_at)
    owner = np.repeat(np.arange(rows), n)
    order = np.lexsort((word, owner))
    same = np.flatnonzero((word[order][1:] == word[order][:-1]) & (owner[order][1:] == owner[order][:-1]))
    a, b = order[same], order[same + 1]
    size = ends[a] - starts[a]
    verified = size == ends[b] - starts[b]
    verified[verified] = _equal_bytes(raw, starts[a[verified]], starts[b[verified]], size[verified])
    found = n - np.bincount(owner[a], minlength=rows)
    for r in np.unique(owner[a[~verified]]):
        found[r] = len({raw[starts[i] : ends[i]].tobytes() for i in range(row_at[r], row_at[r + 1])})
    return found


def measure(text: pa.Array) -> dict[str, np.ndarray]:
    """The measures of each text of the array."""
    raw, at = common.text_bytes(text)
    word, starts, ends, row_at = common.words(raw, at, common.EXACT)
    found = (np.diff(row_at), distinct_words(raw, word, starts, ends, row_at), *(_per_row(t[raw], at) for t in (_CAPITAL, _SYMBOL, _LEADING)))
    return dict(zip(MEASURES, found))


def _measured(batches):
    for whole in batches:
        for batch in common.pieces(whole, "text"):
            found = measure(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "part", "key")] + [pa.array(found[k].astype(np.int64)) for k in MEASURES], names=["doc_id", "part", "key", *MEASURES])


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def failures(docs: DataFrame, min_words: int = 200, distinct_pct: int = 50, capital_pct: int = 2, scratch: common.Scratch | None = None) -> DataFrame:
    """(doc_id, part, the measures, mask) of each row of docs (doc_id, source, text); bit i of mask: FILTERS[i] fails."""
    scratch = scratch or common.Scratch(docs.sparkSession, "filter-audit")
    text = F.coalesce(common.column(docs, "text", "string"), F.lit(""))
    part = F.coalesce(common.column(docs, "source", "string"), F.lit(""))
    slim = docs.select(common.column(docs, "doc_id", "long").alias("doc_id"), part.alias("part"), F.unhex(F.sha2(text, 256)).alias("key"), text.alias("text"))
    found = scratch.save(slim.mapInArrow(_measured, "doc_id long, part string, key binary, " + ", ".join(f"{k} long" for k in MEASURES)))
    first = scratch.save(found.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1"))
    held = dealt_join(found, first.drop("n"), ["key"], first, scratch, "left")
    fails = {
        "A": F.col("n_words") < min_words,
        "B": 100 * F.col("n_distinct") < distinct_pct * F.col("n_words"),
        "C": 100 * F.col("n_capitals") > capital_pct * F.col("n_code_points"),
        "D": F.col("n_symbols") > 0,
        "E": F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)),
    }
    mask = sum((F.when(c, _bit(k)).otherwise(0) for k, c in fails.items()), F.lit(0))
    return held.select("doc_id", "part", *MEASURES, mask.cast("int").alias("mask"))


def labelled(masks: DataFrame, labels: DataFrame, scratch: common.Scratch) -> DataFrame:
    """masks with good and toxic (0 or 1) from labels (doc_id, quality, toxic)."""
    marks = {"good": "quality", "toxic": "toxic"}
    flag = lambda c: F.max((F.coalesce(common.column(labels, c, "int"), F.lit(0)) == 1).cast("int"))
    by_id = labels.select(common.column(labels, "doc_id", "long").alias("doc_id"), *(common.column(labels, c, "int").alias(c) for c in marks.values())).where("doc_id IS NOT NULL")
    marked = scratch.save(by_id.groupBy("doc_id").agg(*(flag(c).alias(k) for k, c in marks.items())).where("good + toxic > 0"))
    counts = masks.groupBy("doc_id").agg(F.count("*").alias("n"))
    out = dealt_join(masks, marked, ["doc_id"], counts, scratch, "left")
    return out.select(*masks.columns, *(F.coalesce(k, F.lit(0)).alias(k) for k in marks))


def _steps() -> Column:
    """An array of what may happen to a filter: its bit, the bits of the filters before it, and all (order, step) of that."""
    cases: dict[tuple[int, int], list[tuple[str, int]]] = {}
    for order in map("".join, permutations(FILTERS)):
        for i, letter in enumerate(order):
            cases.setdefault((_bit(letter), sum(map(_bit, order[:i]))), []).append((order, i + 1))
    case = lambda k, at: F.struct(F.lit(k[0]).alias("own"), F.lit(k[1]).alias("before"), F.lit(",".join(f"{o}{s}" for o, s in at)).alias("at"))
    return F.array(*(case(k, at) for k, at in cases.items()))


def interactions(masks: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of masks (part, mask,
    good, toxic): each step of each order of the filters in each part, counted in documents."""
    counts = masks.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    cases = counts.select("*", F.explode(_steps()).alias("x")).select(*counts.columns, "x.*")
    fails = F.col("mask").bitwiseAND(F.col("own")) != 0
    earlier = F.col("mask").bitwiseAND(F.col("before")) != 0
    here = fails & ~earlier
    share = F.lit(120) / F.bit_count("mask")
    total = lambda c, value="n": F.sum(F.when(c, F.col(value)).otherwise(0)).cast("long")
    found = cases.groupBy("part", "own", "before", "at").agg(
        total(~fails & ~earlier).alias("kept"),
        total(here).alias("removed"),
        total(fails & earlier).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, F.col("n") * share.cast("long")).otherwise(0)).cast("long").alias("shapley"),
    )
    each = found.withColumn("at", F.explode(F.split("at", ",")))
    size = len(FILTERS)
    return each.select("part", F.substring("at", 1, size).alias("filter_order"), F.substring("at", size + 1, 1).cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame, **thresholds: int) -> DataFrame:
    """The table of interactions() for docs (doc_id, source, text) and labels (doc_id, quality, toxic)."""
    scratch = common.Scratch(docs.sparkSession, "filter-audit")
    return interactions(labelled(failures(docs, **thresholds, scratch=scratch), labels, scratch))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_ORDERS = ", ".join(f"('{''.join(p)}')" for p in permutations(FILTERS))
OP12_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
w AS (SELECT d.*, f.first, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic, regexp_extract_all(d.text, '{common.WORD}') AS ws
  FROM d JOIN f ON f.text = d.text LEFT JOIN l ON l.doc_id = d.doc_id),
m AS (SELECT part, good, toxic, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
  100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > first, false) AS e FROM w),
g AS (SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS bad,
  count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
o AS (SELECT * FROM (VALUES {_ORDERS}) AS t(filter_order)),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before FROM o, (VALUES (1), (2), (3), (4), (5)) AS t(step)),
x AS (SELECT g.*, s.*, contains(bad, own) AS fails, before <> '' AND length(translate(bad, before, '')) < length(bad) AS earlier FROM g, s),
r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT fails AND NOT earlier), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT earlier), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (fails AND earlier), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (bad = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (fails AND NOT earlier), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT earlier), 0)::BIGINT AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""
