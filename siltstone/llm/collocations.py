"""Phrase collocation mining by hierarchical pair naming.

Texts are lower-cased (A-Z), split at punctuation and line ends into pieces, and those at blanks into words. A phrase of k
words is a pair of adjacent phrases of k - 1 words that overlap in all but their outer words, so a level's names come from
the level below: each position's (k-1)-gram id and that of the next position make a pair, pairs are counted over the whole
corpus, and the frequent ones get an id that takes their place at the next level. An id is a hash of the pair of ids, so all
tasks name a pair alike without moving a position; the join of the counted pairs with the level below brings phrase, last
word and the counts of all prefixes (from the left parent) and suffixes (from the right one). These parent pointers answer
everything that follows: a cut's two parts are a prefix and a suffix, and the longer phrases around a phrase are the pairs
that name it as a parent. A longer phrase's count is at most that of any phrase in it, so the next level alone decides.

No occurrence is shuffled. A pass over the texts for each level gives the counts of the pairs in a slice of the texts, which
are then summed by Spark. A pair takes part only if both its ids are frequent: tasks ask a Bloom filter of the frequent ids
of each level, of `filter_bits` bits at most (32 MiB; 16 bits an id below that), which is the one thing sent to all
executors. It never misses a frequent id; what else it lets through is counted and falls under `least`. Counts are exact.

Ids are 64 bits of the words' bytes and the lang. Of V different frequent words or pairs of the corpus and T words or pairs
in all, T * V / 2**64 are expected to share an id with another (under one in a million for a billion by ten thousand).

Edge cases: null text is empty; null lang is `und`. Texts without words add nothing. Repeated rows count each. Ids play no
part; missing columns count as null, extra ones are ignored; an empty table gives no rows. A word of any length counts as
one.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm import common
from siltstone.operators.joins import fitting

_U = np.uint64
#: What ends a piece, and what stands between words.
BREAKS = ".,;:!?\n\x0b\x0c\r"
BLANKS = " \t"
_BREAK = np.isin(np.arange(256), [ord(c) for c in BREAKS])
_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[65:91] += 32
_TABLE[[ord(c) for c in BREAKS + BLANKS]] = 32
#: Which bits of an id a filter looks at: its lowest bits after these shifts.
SHIFTS = (0, 13, 25, 36)
SLICE = 2 << 20


def _name(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The ids of the pairs of ids."""
    return common.mix(common.mix(left + _U(0x9E3779B97F4A7C15)) ^ (right * _U(0xD6E8FEB86659FD93)))


class Positions:
    """The words of a slice of texts: ids that differ by lang, and which of them the next word follows in the same piece."""

    def __init__(self, batch: pa.RecordBatch):
        raw, at = common.text_bytes(batch.column("text"))
        word, self.starts, self.ends, row_at = common.words(raw, at, _TABLE)
        self.lower = _TABLE[raw]
        langs = batch.column("lang").dictionary_encode()
        seed = [int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs.dictionary.to_pylist()]
        self.row = np.repeat(np.arange(len(at) - 1), np.diff(row_at))
        lang = np.array(seed, np.uint64)[langs.indices.to_numpy(zero_copy_only=False)] if len(seed) else np.zeros(0, np.uint64)
        self.id = common.mix(word ^ common.mix(lang[self.row]))
        piece = np.cumsum(_BREAK[raw])[self.starts] if len(self.starts) else self.starts
        self.follows = np.zeros(len(self.id), bool)
        self.follows[:-1] = (piece[1:] == piece[:-1]) & (self.row[1:] == self.row[:-1])

    def text(self, which: np.ndarray) -> pa.Array:
        size = self.ends[which] - self.starts[which]
        at = np.concatenate(([0], np.cumsum(size)))
        data = self.lower[np.arange(at[-1]) + np.repeat(self.starts[which] - at[:-1], size)]
        return pa.LargeStringArray.from_buffers(len(which), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())

    def pairs(self, filters: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(left id, right id, occurrences) of the pairs whose ids pass the filters of all levels so far."""
        name, ok = self.id, passes(filters[0], self.id)
        for level in filters[1:]:
            ok, name = self._joined(ok), _name(name, np.roll(name, -1))
            some = np.flatnonzero(ok)
            ok[some] = passes(level, name[some])
        some = np.flatnonzero(self._joined(ok))
        left, right = name[some], name[(some + 1) % max(len(name), 1)]
        _, first, n = np.unique(_name(left, right), return_index=True, return_counts=True)
        return left[first], right[first], n

    def _joined(self, ok: np.ndarray) -> np.ndarray:
        out = ok & self.follows
        out[:-1] &= ok[1:]
        return out


def passes(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids may be in the set whose filter this is."""
    low = _U(len(bits) * 64 - 1)
    out = np.ones(len(ids), bool)
    for s in SHIFTS:
        i = (ids >> _U(s)) & low
        out &= (bits[i >> _U(6)] >> (i & _U(63))) & _U(1) == 1
    return out


def bloom(ids: DataFrame, filter_bits: int) -> np.ndarray:
    """The filter of a table's ids (id): set bits are gathered by Spark, at most filter_bits of them."""
    n, size = ids.count(), min(1 << 16, filter_bits)
    while size < min(16 * n, filter_bits):
        size *= 2
    places = F.explode(F.array(*(F.shiftrightunsigned("id", s).bitwiseAND(F.lit(size - 1)) for s in SHIFTS))).alias("i")
    words = ids.select(places).select(F.shiftright("i", 6).alias("w"), F.expr("shiftleft(1L, cast(i & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return out


def _slices(batches):
    for whole in batches:
        for batch in common.pieces(whole, "text", SLICE):
            yield Positions(batch), batch


def _words(batches):
    for found, batch in _slices(batches):
        ids, first, n = np.unique(found.id, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(found.row[first])), pa.array(ids.view(np.int64)), found.text(first), pa.array(n)], names=["lang", "id", "word", "n"])


def _pairs(filters):
    def run(batches):
        for found, _ in _slices(batches):
            left, right, n = found.pairs([x.value for x in filters])
            yield pa.RecordBatch.from_arrays([pa.array(left.view(np.int64)), pa.array(right.view(np.int64)), pa.array(n)], names=["left", "right", "n"])

    return run


def _named(batches):
    for batch in batches:
        left, right = (batch.column(c).to_numpy().view(np.uint64) for c in ("left", "right"))
        yield pa.RecordBatch.from_arrays([pa.array(_name(left, right).view(np.int64)), *batch.columns], names=["id", "left", "right", "f"])


def frequent(docs: DataFrame, most_words: int = 4, least: int = 30, filter_bits: int = 1 << 28, scratch: common.Scratch | None = None) -> tuple[list[DataFrame], DataFrame]:
    """The frequent phrases of docs (lang, text), a table for each number of words, and the words of each lang (lang, n).

    Tables: lang, id, left, right (the parents' ids, null for words), f, phrase, last (word), pre and suf (counts of the
    first and of the last 1, 2, ... words of the phrase, itself included)."""
    spark = docs.sparkSession
    scratch = scratch or common.Scratch(spark, "collocations")
    texts = docs.select(F.coalesce(common.column(docs, "lang", "string"), F.lit("und")).alias("lang"), F.coalesce(common.column(docs, "text", "string"), F.lit("")).alias("text"))
    words = scratch.save(texts.mapInArrow(_words, "lang string, id long, word string, n long").groupBy("lang", "id", "word").agg(F.sum("n").alias("f")))
    totals = scratch.save(words.groupBy("lang").agg(F.sum("f").alias("n")))
    none = F.lit(None).cast("long")
    one = words.where(F.col("f") >= least).select("lang", "id", none.alias("left"), none.alias("right"), "f", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("f").alias("pre"), F.array("f").alias("suf"))
    levels, filters = [scratch.save(one)], []
    while len(levels) < most_words:
        filters.append(spark.sparkContext.broadcast(bloom(levels[-1].select("id"), filter_bits)))
        counted = texts.mapInArrow(_pairs(filters), "left long, right long, n long").groupBy("left", "right").agg(F.sum("n").alias("f"))
        pairs = scratch.save(counted.where(F.col("f") >= least).mapInArrow(_named, "id long, left long, right long, f long"))
        left = levels[-1].select(F.col("id").alias("left"), "lang", F.col("phrase").alias("head"), F.col("pre").alias("pre_"))
        right = levels[-1].select(F.col("id").alias("right"), "last", F.col("suf").alias("suf_"))
        named = pairs.join(left, "left").join(right, "right")
        levels.append(scratch.save(named.select("lang", "id", "left", "right", "f", F.concat_ws(" ", "head", "last").alias("phrase"), "last", F.concat("pre_", F.array("f")).alias("pre"), F.concat("suf_", F.array("f")).alias("suf"))))
    return levels, totals


#: The lowest score of a phrase's cuts; l and r count the two parts. Decimals hold the products exactly.
_CUT = """array_min(transform(sequence(1, size(pre) - 1), c -> named_struct(
  'score', (cast(f as decimal(20, 0)) * 2000000BD) div cast(pre[c - 1] + suf[size(suf) - c - 1] as decimal(20, 0)), 'cut', c, 'l', pre[c - 1], 'r', suf[size(suf) - c - 1])))"""


def candidates(levels: list[DataFrame]) -> DataFrame:
    """(lang, phrase, words, a, l, r, score, cut) of the phrases of two words and more that no longer one stands for."""
    out = []
    for level, longer in zip(levels[1:], [*levels[2:], None]):
        if longer is not None:
            around = longer.select(F.explode(F.array("left", "right")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("longer"))
            decimal = lambda n, c: F.lit(n) * F.col(c).cast("decimal(20,0)")
            level = level.join(around, "id", "left").where(F.col("longer").isNull() | (decimal(100, "longer") < decimal(80, "f")))
        out.append(level.withColumn("x", F.expr(_CUT)).select("lang", "phrase", F.size("pre").alias("words"), F.col("f").alias("a"), "x.l", "x.r", "x.score", "x.cut"))
    total = out[0]
    for x in out[1:]:
        total = total.unionAll(x)
    return total


def best(found: DataFrame, top: int, shares: int = 64) -> DataFrame:
    """The first `top` rows of each lang by score and a descending, then phrase, with their rank. Each lang's rows are
    ranked in `shares` shares first, so that no task gets more than a share of a lang and the firsts of all shares."""
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    share = F.pmod(F.xxhash64("phrase"), F.lit(shares))
    first = found.withColumn("share", share).withColumn("rank", F.row_number().over(W.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).drop("share")


def collocations(docs: DataFrame, top: int = 2000, **bounds: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each lang of docs (lang, text)."""
    scratch = common.Scratch(docs.sparkSession, "collocations")
    levels, totals = frequent(docs, **bounds, scratch=scratch)
    chosen = best(scratch.save(candidates(levels)), top)
    return chosen.join(fitting(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_AZ}', '{_AZ.lower()}') AS text FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM d),
k AS (SELECT unnest([1, 2, 3, 4]) AS k),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM p, k WHERE len(ws) >= k)),
f AS (SELECT lang, k, phrase, count(*)::BIGINT AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 30),
s AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
t AS (SELECT s.lang, s.phrase, s.k, s.a, s.cut, x.f AS l, y.f AS r, ((2000000::HUGEINT * s.a) // (x.f + y.f))::BIGINT AS score
  FROM s JOIN f x ON x.lang = s.lang AND x.k = s.cut AND x.phrase = array_to_string(s.ws[1:s.cut], ' ')
  JOIN f y ON y.lang = s.lang AND y.k = s.k - s.cut AND y.phrase = array_to_string(s.ws[s.cut + 1:s.k], ' ')),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM t) WHERE o = 1),
u AS (SELECT lang, a AS longer, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))))) AS phrase FROM c WHERE k > 2),
v AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN u ON u.lang = c.lang AND u.phrase = c.phrase WHERE 100::HUGEINT * longer >= 80::HUGEINT * a),
w AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.lang = b.lang AND v.phrase = b.phrase))
SELECT w.lang, rank::BIGINT AS rank, phrase, a, l, r, n, score FROM w JOIN n ON n.lang = w.lang WHERE rank <= 2000
"""
