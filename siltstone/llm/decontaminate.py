"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. The benchmark's items are taken in
blocks of at most `block_seeds` n-grams, so a large benchmark makes more passes, not larger tables:

1. All three-word n-grams of an item are its seeds, however common: a cut by rarity loses copies wherever the item's other
   n-grams are rarer than the copied ones.
2. A pass finds the seeds in the texts. Hits of an item that lie together (two different seeds at least, or the item's
   only one) give a stretch of the text, an item's length and a margin around them, overlapping stretches merged.
   A stretch that shares too few words with the item for any alignment to reach `least` is left out.
3. Smith-Waterman over words (match 2, other -1, gap -1) aligns item and stretch; the score is divided by that of a full
   copy. Pairs of `least` or more are reported, so copies with words replaced, inserted or left out count. A copy without
   two intact n-grams (every third word replaced, say) has no seeds and is not found.

Texts and items are joined by seed inside the tasks that read the texts: a block of seeds is a table of bounded size, sent
to every executor, so text never moves. The driver reads the benchmark, a partition at a time.

Edge cases: null or empty texts and items match nothing. An item of one or two words is its own seed and must occur
whole. Repeated rows give repeated pairs, repeated items are items. Null ids stay. Extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import common

GRAM = 3
MATCH, OTHER, GAP = 2, -1, -1
PAIRS = "doc_id long, fp long, item_id long, score double, n_matched long, first_word long, last_word long"


def tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and row offsets."""
    raw, at = common.text_bytes(text)
    word, _, _, row_at = common.words(raw, at, common.LETTERS)
    return word, row_at


def grams(word: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word sequences (those across rows too)."""
    h = np.full(max(0, len(word) - n + 1), n, np.uint64)
    for k in range(n):
        h = common.mix(h ^ common.mix(word[k : len(word) - n + 1 + k] + np.uint64(k)))
    return h


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: (score, first and last word of it in text). A row of the table at a time; gaps in the text
    are a running maximum."""
    n = len(text)
    ramp = np.arange(n + 1) * -GAP
    above = np.zeros(n + 1, np.int64)
    start_above = np.arange(n + 1)
    best = (0, 0, -1)
    for w in item:
        diagonal = above[:-1] + np.where(text == w, MATCH, OTHER)
        up = above[1:] + GAP
        here, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
        take_up = up >= diagonal
        value = np.where(take_up, up, diagonal)
        from_ = np.where(take_up, start_above[1:], start_above[:-1])
        good = value > 0
        here[1:][good], start[1:][good] = value[good], from_[good]
        # left gaps: max over k <= j of here[k] - (j - k)
        lifted = here + ramp
        top = np.maximum.accumulate(lifted)
        came = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        gapped = top - ramp
        longer = gapped > here
        start = np.where(longer, start[came], start)
        here = np.where(longer, gapped, here)
        j = int(here.argmax())
        if here[j] > best[0]:
            best = (int(here[j]), int(start[j]), j - 1)
        above, start_above = here, start
    return best


class Seeds:
    """The n-grams of a block of items, by hash."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = items
        self.length = np.array([len(w) for _, w in items], np.int64)
        first = np.concatenate(([0], np.cumsum(self.length)))
        word = np.concatenate([w for _, w in items])
        owner = np.repeat(np.arange(len(items)), self.length)
        size = np.minimum(GRAM, self.length)
        self.sizes = np.unique(size[size > 0]).tolist()
        found = []  # (hash, item, word) of every n-gram
        for n in self.sizes:
            at = np.flatnonzero((size[owner] == n)[: len(word) - n + 1] & (owner[: len(word) - n + 1] == owner[n - 1 :]))
            found.append((grams(word, n)[at], owner[at], at - first[owner[at]]))
        h, item, place = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((place, item, h))
        h, self.item, self.place = h[order], item[order], place[order]
        self.hashes, begin = np.unique(h, return_index=True)
        # the places (item, word) of seed s are those from place_at[s] to place_at[s + 1]
        self.place_at = np.append(begin, len(h))
        different = np.unique(np.repeat(np.arange(len(begin)), np.diff(self.place_at)) * len(items) + self.item) % len(items)
        self.need = np.minimum(2, np.bincount(different, minlength=len(items)))
        self.shift = np.uint64(64 - min(26, max(20, len(begin).bit_length() + 3)))
        self.maybe = np.zeros(1 << int(64 - self.shift), bool)
        self.maybe[(self.hashes >> self.shift).astype(np.int64)] = True

    def hits(self, word: np.ndarray, row_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, first word, seed) of every seed in the texts, in order."""
        out = []
        rows = len(row_at) - 1
        owner = np.repeat(np.arange(rows), np.diff(row_at))
        for n in self.sizes:
            h = grams(word, n)
            at = np.flatnonzero(self.maybe[(h >> self.shift).astype(np.int64)])
            at = at[owner[at] == owner[at + n - 1]]
            seed = np.searchsorted(self.hashes, h[at])
            ok = seed < len(self.hashes)
            ok[ok] = self.hashes[seed[ok]] == h[at][ok]
            out.append((owner[at[ok]], at[ok], seed[ok]))
        if not out:
            z = np.zeros(0, np.int64)
            return z, z, z
        row, at, seed = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((at, row))
        return row[order], at[order], seed[order]


def _stretches(seeds: Seeds, row: np.ndarray, at: np.ndarray, seed: np.ndarray, row_at: np.ndarray):
    """(row, item number, begin, end) of the stretches of text that hold enough seeds of an item, by row and item."""
    n = np.diff(seeds.place_at)[seed]
    of = np.repeat(np.arange(len(seed)), n)
    to = np.repeat(seeds.place_at[seed] - np.cumsum(n) + n, n) + np.arange(len(of))
    row, at, seed, item = row[of], at[of] - seeds.place[to], seed[of], seeds.item[to]
    length = seeds.length[item]
    margin = length // 3 + 3
    begin, end = np.maximum(row_at[row], at - margin), np.minimum(row_at[row + 1], at + length + margin)
    order = np.lexsort((begin, item, row))
    row, item, seed, begin, end = (x[order] for x in (row, item, seed, begin, end))
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
    span = int(row_at[-1]) + 1
    pair = np.cumsum(new) * span
    reach = np.maximum.accumulate(pair + end)
    new[1:] |= (pair + begin)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    different = np.unique((np.cumsum(new) - 1) * len(seeds.hashes) + seed) // len(seeds.hashes)
    good = np.bincount(different, minlength=len(first)) >= seeds.need[item[first]]
    first, last = first[good], last[good]
    return zip(row[first].tolist(), item[first].tolist(), begin[first].tolist(), (reach[last] - pair[last]).tolist(), strict=True)


def found_in(seeds: Seeds, word: np.ndarray, row_at: np.ndarray, least: float, most: int = 1 << 20):
    """(row, item id, score, matched words, first word, last word) of the copies of items in the texts. Rows are taken
    together up to `most` places of seeds."""
    row, at, seed = seeds.hits(word, row_at)
    places = np.cumsum(np.diff(seeds.place_at)[seed])
    ends = np.append(np.flatnonzero(row[1:] != row[:-1]) + 1, len(row))
    i = 0
    while i < len(row):
        before = places[i - 1] if i else 0
        fit = ends[(ends > i) & (places[ends - 1] <= before + most)]
        j = int(fit[-1]) if len(fit) else int(ends[np.searchsorted(ends, i, side="right")])
        found = _stretches(seeds, row[i:j], at[i:j], seed[i:j], row_at)
        i = j
        for (r, k), stretches in groupby(found, lambda x: x[:2]):
            item_id, item = seeds.items[k]
            n = len(item)
            bound = least if n >= GRAM else 1.0
            best = (0.0, 0, 0, 0)
            for _, _, lo, hi in stretches:
                text = word[lo:hi]
                # an alignment scores at most a match for each word of either side that the other has
                if min(np.isin(text, item).sum(), np.isin(item, text).sum()) < bound * n:
                    continue
                score, first, last = align(item, text)
                start = lo - int(row_at[r])
                best = max(best, (score / (MATCH * n), score // MATCH, start + first, start + last))
            if best[0] >= bound:
                yield r, item_id, best[0], best[1], best[2], best[3]


def _aligned(shared, least: float):
    def run(batches):
        seeds = shared.value
        for whole in batches:
            for batch in common.pieces(whole, "text"):
                found = list(found_in(seeds, *tokens(batch.column("text")), least))
                if found:
                    row, item, score, matched, first, last = zip(*found, strict=True)
                    ids = [batch.column(c).take(pa.array(row)) for c in ("doc_id", "fp")]
                    yield pa.RecordBatch.from_arrays([*ids, pa.array(item, pa.int64()), pa.array(score), *(pa.array(x, pa.int64()) for x in (matched, first, last))], names=["doc_id", "fp", "item_id", "score", "n_matched", "first_word", "last_word"])

    return run


def blocks_of(benchmark: DataFrame, block_seeds: int):
    """Lists of (item id, word hashes) with at most about block_seeds words each."""
    items, n = [], 0
    rows = benchmark.select(common.column(benchmark, "item_id", "long").alias("item_id"), common.column(benchmark, "text", "string").alias("text"))
    for r in rows.toLocalIterator():
        word, _ = tokens(pa.array([r.text], pa.string()))
        if not len(word):
            continue
        if items and n + len(word) > block_seeds:
            yield items
            items, n = [], 0
        items.append((r.item_id, word))
        n += len(word)
    if items:
        yield items


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.4, block_seeds: int = 2_000_000) -> DataFrame:
    """(doc_id, fp, item_id, score, n_matched, first_word, last_word): the pairs of a row of docs and a benchmark item it
    copies, with the best aligned stretch (word numbers from 0); fp is the text's hash, which tells rows of one id apart.

    block_seeds: about so many n-grams (some 40 bytes each) are sent to the executors at once; a benchmark of more takes
    a pass for each block. An item of more words than that is a block of its own."""
    spark = docs.sparkSession
    slim = docs.select(common.column(docs, "doc_id", "long").alias("doc_id"), common.column(docs, "text", "string").alias("text"))
    slim = slim.withColumn("fp", F.xxhash64("text"))
    scratch = common.Scratch(spark, "decontaminate")
    out = []
    for items in blocks_of(benchmark, block_seeds):
        shared = spark.sparkContext.broadcast(Seeds(items))
        out.append(scratch.save(slim.mapInArrow(_aligned(shared, least), PAIRS)))
    return reduce(DataFrame.unionAll, out) if out else spark.createDataFrame([], PAIRS)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("fp")
