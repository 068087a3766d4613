"""Shared parts of the corpus operators: columns, word hashing, slices of batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import scratch
from siltstone.operators.graph import components

__all__ = ["Scratch", "components"]
BATCH_ROWS = 1000


class Scratch(scratch.Scratch):
    """Scratch tables whose rows reach Python in batches of BATCH_ROWS at most: texts may be long, pairs of texts more so.
    batch_bytes: the most bytes of such a batch, if that is set (a longer row stands alone)."""

    batch_bytes: int | None = None

    def save(self, df: DataFrame) -> DataFrame:
        limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS}
        if self.batch_bytes:
            limits["spark.sql.execution.arrow.maxBytesPerBatch"] = self.batch_bytes
        before = {k: self.spark.conf.get(k) for k in limits}
        for k, v in limits.items():
            self.spark.conf.set(k, str(v))
        try:
            return super().save(df)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)


#: A word is a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def column(df: DataFrame, name: str, kind: str) -> Column:
    """The named column cast to kind, or nulls where the table has no such column."""
    return (F.col(f"`{name}`") if name in df.columns else F.lit(None)).cast(kind)


def word_count(text: Column) -> Column:
    """Words of the text; null counts as 0. JVM only."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# ---------------------------------------------------------------- hashing

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_PINV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LUT = np.arange(256, dtype=np.uint8)
_LUT[65:91] += 32
_LUT[[9, 10, 11, 12, 13]] = 32
#: Byte tables for words(): white space becomes a space; A-Z is lower-cased in FOLDED; LETTERS is that, and only ASCII
#: letters, digits and bytes of other characters make words.
FOLDED = _LUT
EXACT = np.arange(256, dtype=np.uint8)
EXACT[[9, 10, 11, 12, 13]] = 32
LETTERS = _LUT.copy()
LETTERS[[b for b in range(128) if not chr(b).isalnum()]] = 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finish)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the n + 1 offsets of its rows; null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words(raw: np.ndarray, at: np.ndarray, table: np.ndarray = FOLDED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word, and for each row the number of its first word (n + 1 entries)."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(at), np.int64)
    b = table[raw]
    inside = b != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = at[1:-1]
    edges = edges[edges < len(raw)]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = edges - 1
    before = before[before >= 0]
    last[before] = inside[before]
    ends = np.flatnonzero(last) + 1
    return span_hash(b, starts, ends), starts, ends, np.searchsorted(starts, at)


_STEP = 1 << 12
_LOW = np.cumprod(np.concatenate(([_U(1)], np.full(_STEP - 1, _PINV))))


def _inverse_powers(at: np.ndarray) -> np.ndarray:
    """P^-at for ascending positions, from two short tables of powers."""
    n = int(at[-1]) // _STEP + 1 if len(at) else 1
    high = np.cumprod(np.concatenate((_LOW[:1], np.full(n, _LOW[-1:] * _LOW[1:2]))))
    return high[at // _STEP] * _LOW[at % _STEP]


def span_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span; starts ascend."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power = np.full(len(raw), _P)
    power[0] = 1
    np.cumprod(power, out=power)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + _U(1)) * power, out=total[1:])
    return mix((total[ends] - total[starts]) * _inverse_powers(starts) + (ends - starts).astype(np.uint64))


def shingles(word: np.ndarray, row_at: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's k-word shingles, one after the other, and their n + 1 offsets.

    A row of 1 to k - 1 words has its whole sequence as its one shingle; a row without words has none."""
    n = np.diff(row_at)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.concatenate(([0], np.cumsum(counts)))
    out = np.zeros(at[-1], np.uint64)
    if len(word) >= k:
        h = word[: len(word) - k + 1] * _U(0x2545F4914F6CDD1D)
        for i in range(1, k):
            h = (h ^ (h >> _U(29)) ^ word[i : len(word) - k + 1 + i]) * _U(0x9FB21C651E98DF25)
        h = mix(h)
        long = np.flatnonzero(n >= k)
        if len(long):
            first = np.repeat(row_at[long] - at[long], counts[long])
            to = np.repeat(at[long] - np.concatenate(([0], np.cumsum(counts[long])[:-1])), counts[long]) + np.arange(counts[long].sum())
            out[to] = h[first + to]
    for r in np.flatnonzero((n > 0) & (n < k)):
        x = _U(0x1234567 + int(n[r]))
        with np.errstate(over="ignore"):
            for w in word[row_at[r] : row_at[r + 1]]:
                x = (x ^ (x >> _U(29)) ^ w) * _U(0x9FB21C651E98DF25)
        out[at[r]] = mix(np.array([x]))[0]
    return out, at


def pieces(batch: pa.RecordBatch, text: str, most: int = 1 << 20):
    """Slices of the batch with about `most` bytes of text each (a longer text stands alone)."""
    at = np.frombuffer(batch.column(text).cast(pa.large_string()).buffers()[1], dtype=np.int64)[: batch.num_rows + 1] if batch.num_rows else np.zeros(1, np.int64)
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j
