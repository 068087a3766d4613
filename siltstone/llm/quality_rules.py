"""Quality rules with host-level verdicts.

Each text is measured once (words, symbols, repeated lines, repeated three-word windows). Rule failures are summed by
host (the `source` of a document; null is a host of its own). A host's failure rate is shrunk towards the corpus: the
rates of all hosts give an empirical beta prior by moments, and the posterior mean (alpha + failures) / (alpha + beta +
documents) is the host's rate. A host of rate `reject` or more goes as a whole; in a host of rate `watch` or more, the
documents that fail any rule go; elsewhere only those that fail a base rule.

Base rules: under 50 words; more than half of the words in three-word windows that the text repeats. Further rules:
symbols above a tenth of the word characters; more than 30 % repeated lines.

The per-document measures are written once to the scratch folder; hosts are partial aggregates, so a hot host moves one
row per task. The host table is broadcast up to `broadcast_hosts` rows and joined by a shuffle beyond.

Edge cases: null, empty or blank text has no words and fails. Repeated rows stay. Null ids and null hosts stay. Extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import common

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])


def _per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[at[1:]] - total[at[:-1]]


def _repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: is there an equal one, and is there an earlier equal one."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    any_, earlier = np.zeros(len(key), bool), np.zeros(len(key), bool)
    earlier[order[1:]] = same
    any_[order[1:]] = same
    any_[order[:-1]] |= same
    return any_, earlier


def measure(text: pa.Array) -> dict[str, np.ndarray]:
    """The measures of each text of the array."""
    raw, at = common.text_bytes(text)
    word, starts, ends, row_at = common.words(raw, at, common.EXACT)
    rows, n = len(at) - 1, np.diff(row_at)
    letters = np.concatenate(([0], np.cumsum(raw & 0xC0 != 0x80, dtype=np.int64)))
    chars = np.concatenate(([0], np.cumsum(letters[ends] - letters[starts])))
    out = {"n_words": n, "word_chars": chars[row_at[1:]] - chars[row_at[:-1]], "n_symbols": _per_row(_SYMBOL[raw], at)}
    # lines: each row's text is cut at \n; a row without text has one empty line, which has no word
    cuts = np.flatnonzero(raw == 10)
    begin = np.union1d(at[:-1], cuts + 1)
    begin = begin[begin < len(raw)]
    row = np.searchsorted(at, begin, side="right") - 1
    after = np.concatenate((cuts, [len(raw)]))
    end = np.minimum(after[np.searchsorted(cuts, begin)], at[row + 1])
    full = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    key = common.span_hash(raw, begin[full], end[full]) ^ common.mix(row[full].astype(np.uint64))
    dup = np.bincount(row[full][_repeats(key)[1]], minlength=rows)
    out |= {"n_dup_lines": dup, "n_lines": np.bincount(row[full], minlength=rows)}
    covered = np.zeros(len(word), bool)
    if len(word) >= 3:
        owner = np.repeat(np.arange(rows), n)
        inside = np.flatnonzero(owner[2:] == owner[:-2])
        three = common.mix(common.mix(word[inside] + np.uint64(1)) ^ word[inside + 1])
        three = common.mix(common.mix(three + np.uint64(2)) ^ word[inside + 2]) ^ common.mix(owner[inside].astype(np.uint64) + np.uint64(7))
        hit = inside[_repeats(three)[0]]
        for k in range(3):
            covered[hit + k] = True
    out["n_repeat_words"] = _per_row(covered, row_at)
    return out


def _measured(batches):
    for whole in batches:
        for batch in common.pieces(whole, "text"):
            found = measure(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fp"), batch.column("host"), *(pa.array(found[k].astype(np.int64)) for k in MEASURES)], names=["doc_id", "fp", "host", *MEASURES])


def host_rates(judged: DataFrame, reject: float, watch: float) -> DataFrame:
    """(host, n_docs, n_failed, rate, host_verdict) from rows with host and failed."""
    hosts = judged.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    n, failed, h = hosts.agg(F.sum("n_docs"), F.sum("n_failed"), F.count("*")).first()
    mean = (failed or 0) / (n or 1)
    spread = hosts.agg(F.sum(F.col("n_docs") * F.pow(F.col("n_failed") / F.col("n_docs") - F.lit(mean), 2.0))).first()[0] or 0.0
    sampling = mean * (1 - mean) * (h or 0) / (n or 1)
    between = spread / (n or 1) - sampling
    strength = min(max(mean * (1 - mean) / between - 1, 2.0), 1e4) if between > 0 and 0 < mean < 1 else 1e4
    rate = (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))
    verdict = F.when(F.col("rate") >= reject, "reject").when(F.col("rate") >= watch, "watch").otherwise("good")
    return hosts.withColumn("rate", rate).withColumn("host_verdict", verdict)


def quality_rules(docs: DataFrame, reject: float = 0.6, watch: float = 0.4, broadcast_hosts: int = 100_000) -> DataFrame:
    """(doc_id, fp, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_rate, host_verdict)
    of each row of docs (doc_id, text, source); fp is the text's hash, which tells rows of one id apart."""
    scratch = common.Scratch(docs.sparkSession, "quality")
    slim = docs.select(common.column(docs, "doc_id", "long").alias("doc_id"), common.column(docs, "source", "string").alias("host"), common.column(docs, "text", "string").alias("text"))
    slim = slim.withColumn("fp", F.xxhash64("text"))
    found = slim.mapInArrow(_measured, "doc_id long, fp long, host string, " + ", ".join(f"{k} long" for k in MEASURES))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    soft = (10 * F.col("n_symbols") > F.col("word_chars")) | (10 * F.col("n_dup_lines") > 3 * F.col("n_lines"))
    judged = scratch.save(found.withColumn("base_failed", base).withColumn("failed", base | soft))
    hosts = host_rates(judged, reject, watch).select(F.col("host").alias("h"), "rate", "host_verdict")
    hosts = scratch.save(hosts)
    if hosts.count() <= broadcast_hosts:
        hosts = F.broadcast(hosts)
    out = judged.join(hosts, F.col("host").eqNullSafe(F.col("h")), "left")
    kept = ~F.col("base_failed") & (F.col("host_verdict") != "reject") & ~((F.col("host_verdict") == "watch") & F.col("failed"))
    return out.select("doc_id", "fp", *MEASURES[:5], "base_failed", kept.alias("kept"), F.col("failed").alias("rule_failed"), F.round("rate", 9).alias("host_rate"), "host_verdict")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("fp")


_W = r"[^\x20\x09-\x0D]+"
OP9_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{_W}') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_W}')) AS ls FROM t),
g AS (SELECT rid, i, hash(ws[i], ws[i + 1], ws[i + 2]) AS h, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY rid),
m AS (SELECT w.rid, doc_id, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN c ON c.rid = w.rid),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > word_chars OR 10 * n_dup_lines > 3 * n_lines AS failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (failed) AS f FROM j GROUP BY source),
q AS (SELECT sum(f) / sum(n) AS mean, sum(n) AS n, count(*) AS k FROM h),
s AS (SELECT mean, (SELECT sum(h.n * pow(h.f / h.n - q.mean, 2)) FROM h) / q.n - mean * (1 - mean) * k / q.n AS between_ FROM q),
p AS (SELECT mean, CASE WHEN between_ > 0 AND mean > 0 AND mean < 1 THEN least(greatest(mean * (1 - mean) / between_ - 1, 2.0), 1e4) ELSE 1e4 END AS strength FROM s),
v AS (SELECT source, (f + mean * strength) / (n + strength) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rate < 0.6 AND NOT (rate >= 0.4 AND failed) AS kept, failed AS rule_failed, round(rate, 9) AS host_rate,
  CASE WHEN rate >= 0.6 THEN 'reject' WHEN rate >= 0.4 THEN 'watch' ELSE 'good' END AS host_verdict
FROM j JOIN v ON j.source IS NOT DISTINCT FROM v.source
"""
