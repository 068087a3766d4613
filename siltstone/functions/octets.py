"""Columns over binary data: decoding, counting, histograms, entropy, vectors."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf


def latin(data: Column) -> Column:
    """One character per byte, so that positions in the string are byte offsets."""
    return F.decode(data, "ISO-8859-1")


def unlatin(text: Column) -> Column:
    """The UTF-8 text (lossy) of a string made by latin()."""
    return F.decode(F.encode(text, "ISO-8859-1"), "UTF-8")


# Unicode's white space.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(text, F.lit(_SPACES))


def once(value: Column, use) -> Column:
    """use(value), with the value worked out once however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def le_int(data: Column, at: int | Column, size: int) -> Column:
    """Little-endian unsigned integer of 1 to 7 bytes (8: null above 2^63 - 1); null where the data are too short."""
    at = F.lit(at) if isinstance(at, int) else at
    part = F.substring(data, at + 1, F.lit(size))
    digits = F.hex(part)
    swapped = F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))))
    value = F.conv(swapped, 16, 10).cast("decimal(20,0)")
    return F.when(F.length(part) == size, F.when(value < F.lit(Decimal(1 << 63)), value.cast("long")))


def count_bytes(data: Column, chars: str) -> Column:
    """How many bytes of the data are among the given ASCII characters."""
    text = latin(data)
    return F.length(text) - F.length(F.translate(text, chars, ""))


def find_first(data: Column, needle: bytes) -> Column:
    """0-based position of the first occurrence; null without one, for an empty needle or too short data."""
    if not needle:
        return F.lit(None).cast("long")
    at = F.instr(latin(data), needle.decode("latin-1"))
    return F.when(at > 0, (at - 1).cast("long"))


def count_overlapping(data: Column, needle: bytes) -> Column:
    """Occurrences, those that overlap too."""
    if not needle:
        return F.lit(0).cast("long")
    quoted = "".join(f"\\x{b:02x}" for b in needle)
    return F.regexp_count(latin(data), F.lit(f"(?={quoted})")).cast("long")


def _counts(data: pa.Array):
    """(row, its counts of the 256 byte values, their sum) of the rows that are not empty; one row's bytes are read at a time."""
    for i, b in enumerate(data):
        if b.is_valid and (buffer := b.as_buffer()).size:
            yield i, np.bincount(np.frombuffer(buffer, np.uint8), minlength=256), buffer.size


@arrow_udf(T.DoubleType())
def entropy(data: pa.Array) -> pa.Array:
    """Shannon entropy in bits per byte; 0 for empty or null data."""
    out = np.zeros(len(data))
    for i, n, size in _counts(data):
        p = n[n > 0] / size
        out[i] = -(p * np.log2(p)).sum()
    return pa.array(out)


@arrow_udf(T.ArrayType(T.DoubleType()))
def byte_frequency(data: pa.Array) -> pa.Array:
    """Share of each of the 256 byte values; zeros for empty or null data."""
    out = np.zeros((len(data), 256))
    for i, n, size in _counts(data):
        out[i] = n / size
    return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, 256, dtype=np.int32)), pa.array(out.reshape(-1)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays of doubles; 0 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def histogram(rows: DataFrame, data: str) -> DataFrame:
    """(byte, n) over all rows: each task counts its partition, so 256 rows per task are shuffled."""

    def run(batches):
        total = np.zeros(256, np.int64)
        for batch in batches:
            column = batch.column(0)
            for b in column:
                if b.is_valid:
                    total += np.bincount(np.frombuffer(b.as_buffer(), np.uint8), minlength=256)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["byte", "n"])

    return rows.select(data).mapInArrow(run, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n"))
