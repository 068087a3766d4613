"""Exact joins of vectors by cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.scratch import Scratch
from siltstone.operators.joins import fitting
from siltstone.operators.order import numbered

#: Rounding that the bounds leave room for.
SLACK = 1e-9
#: A dimension's rows are cut into so many blocks, if these hold at most so many bytes of vectors: a row is sent to as many cells.
BLOCKS, BLOCK_BYTES = 16, 1 << 23


def _units(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors as rows of a matrix, each of length 1."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    if len(set(np.diff(vectors.offsets.to_numpy()))) > 1:
        raise ValueError("vectors of different numbers of dimensions")
    v = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _dimensions(rows: DataFrame) -> tuple[np.ndarray, int]:
    """(dimensions by the number of rows that have them, commonest first; place of the last that all rows have, or 0)."""
    seen = rows.select(F.posexplode("v").alias("dim", "x")).where("x <> 0").groupBy("dim").agg(F.count("*").alias("n"))
    rows, counts = rows.count(), sorted((-r.n, r.dim) for r in seen.collect())  # as many as a vector has dimensions
    everywhere = [i for i, (n, _) in enumerate(counts) if -n == rows]
    return np.array([d for _, d in counts], np.int64), max(everywhere, default=0)


def _posted(order: np.ndarray, last: int, threshold: float, group: list[str]):
    """For mapInArrow: (group, id, marked, dim, norm) for the places of `order` at which a row is posted, norm: length
    of the row up to there. A row is posted from where that reaches the threshold on."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows or not len(order):
                continue
            vectors = _units(batch.column("v"))[:, order]
            norm = np.sqrt(np.cumsum(vectors * vectors, axis=1))
            row, dim = np.nonzero((vectors != 0) & (norm >= threshold - SLACK) & (np.arange(len(order)) >= last))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in (*group, "id", "marked")), pa.array(dim.astype(np.int32)), pa.array(norm[row, dim])], names=[*group, "id", "marked", "dim", "norm"])

    return run


def _alike(x: np.ndarray, y: np.ndarray, threshold: float, few: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, cosine) of all pairs of the threshold or more: found in single precision with room for its
    rounding, then worked out in double precision."""
    low = threshold - (x.shape[1] + 8) * 2.0**-23
    a, b = np.divmod(np.flatnonzero((x.astype(np.float32) @ y.astype(np.float32).T).ravel() >= np.float32(low)), len(y))
    cosine = np.einsum("ij,ij->i", x[a], y[b]) if len(a) <= few else (x @ y.T)[a, b]
    good = cosine >= threshold
    return a[good], b[good], cosine[good]


def _cell(order: np.ndarray, threshold: float, block: int):
    """For applyInArrow: the pairs of two blocks, of `block` rows of each at a time, so that no more pairs are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        i, j, dim = (table.column(c)[0].as_py() for c in ("i", "j", "dim"))
        table = table.take(pa.array(np.lexsort((table.column("norm").to_numpy(), table.column("block").to_numpy()))))
        unit, ids = _units(table.column("v")), table.column("id").combine_chunks()
        norm, marked = (table.column(c).to_numpy(zero_copy_only=False) for c in ("norm", "marked"))
        n, later = int((table.column("block").to_numpy() == i).sum()), order[dim + 1 :]
        for p in range(0, n, block):
            x = slice(p, min(p + block, n))
            for q in range(p if i == j else n, len(norm), block):
                y = slice(q, q + block)
                if norm[x][-1] * norm[y][-1] < threshold - 2 * SLACK or not (marked[x].any() or marked[y].any()):
                    continue
                a, b, cosine = _alike(unit[x], unit[y], threshold, 4 * block)
                good = marked[x][a] | marked[y][b]
                if p == q:
                    good &= a < b
                # a pair belongs to the last dimension that both have, and so comes once
                if len(later):
                    good &= ~((unit[x][a][:, later] != 0) & (unit[y][b][:, later] != 0)).any(axis=1)
                if good.any():
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(p + a[good])), ids.take(pa.array(q + b[good])), pa.array(cosine[good])], names=["a", "b", "cosine"])

    return run


def cosine_pairs(rows: DataFrame, id_: str, vector: str, threshold: float, *equal: str, marked: str | None = None, block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(pairs, work). pairs: (a, b, cosine) of all rows a < b that agree in `equal` and whose vectors have a cosine of threshold
    (> 0) or more; with `marked` (a boolean column) only those of which one is marked. work: (dim, rows, cells, compared):
    for each dimension the rows posted, the cells and the pairs compared at most. Vectors of zeros and nulls match nothing.

    An inverted index with bounds on norms. Dimensions are ordered, commonest first. A row is posted in its dimensions from
    that on at which the length of its beginning reaches the threshold: if two rows shared no dimension where both are
    posted, their cosine would be at most the length of one of these beginnings, so no pair is missed. It is found at the
    last dimension that both have, up to which the lengths of both must multiply to the threshold; dimensions before one
    that all rows have are never the last. The rows of a dimension are ordered by that length and cut into blocks; two blocks
    meet in a cell of their own unless their largest lengths multiply to less. So no list of pairs is made but that of the
    result, and a dimension that all rows have is dealt over many tasks. Vectors without zeros have only such a dimension:
    they are compared block by block, which grows with the square of the rows. As a row is sent to every cell of its block,
    blocks are as large as BLOCKS of them need, from `block` rows up to BLOCK_BYTES of vectors: what is sent grows with the
    rows up to BLOCKS * BLOCK_BYTES, and a task holds two blocks and the pairs of `block` rows with `block` rows."""
    if threshold <= 0:
        raise ValueError("threshold must be over 0: at 0 rows that share nothing match")
    scratch = Scratch(rows.sparkSession, "cosine")
    group = [f"_e{k}" for k in range(len(equal))]
    kind = "float" if rows.select(vector).schema[0].dataType.elementType.simpleString() == "float" else "double"
    values = F.transform(F.col(vector), lambda x: F.coalesce(x.cast(kind), F.lit(0.0).cast(kind)))
    unit = rows.select(*(F.col(c).alias(g) for c, g in zip(equal, group)), F.col(id_).alias("id"), (F.coalesce(F.col(marked), F.lit(False)) if marked else F.lit(True)).alias("marked"), values.alias("v"))
    unit = scratch.save(unit.where(F.exists("v", lambda x: x.cast("double") * x.cast("double") > 0)))
    order, last = _dimensions(unit)
    most = max(block, BLOCK_BYTES // ((8 if kind == "double" else 4) * (int(max(order, default=0)) + 1)))
    width = F.greatest(F.lit(block), F.least(F.lit(most), F.ceil(F.col("n_rows") / BLOCKS)))
    types = ", ".join([*(f"{g} {unit.schema[g].dataType.simpleString()}" for g in group), f"id {unit.schema['id'].dataType.simpleString()}"])
    posted = unit.mapInArrow(_posted(order, last, threshold, group), f"{types}, marked boolean, dim int, norm double")
    index = scratch.save(numbered(posted, [*group, "dim"], ["norm", "id"], scratch).withColumn("block", F.floor(F.col("rn") / width).cast("int")))
    blocks = index.groupBy(*group, "dim", "block").agg(F.max("norm").alias("top"), F.count("*").alias("n"), F.max("marked").alias("m"))
    blocks = scratch.save(blocks)
    one, two = (blocks.select(*group, "dim", F.col("block").alias(s), F.col("top").alias(f"top_{s}"), F.col("n").alias(f"n_{s}"), F.col("m").alias(f"m_{s}")) for s in "ij")
    cells = one.join(two, [*group, "dim"]).where((F.col("i") <= F.col("j")) & (F.col("top_i") * F.col("top_j") >= threshold - 2 * SLACK) & (F.col("m_i") | F.col("m_j")) & ((F.col("i") < F.col("j")) | (F.col("n_i") > 1)))
    cells = scratch.save(cells)
    compared = F.when(F.col("i") == F.col("j"), F.col("n_i") * (F.col("n_i") - 1) / 2).otherwise(F.col("n_i") * F.col("n_j"))
    work = blocks.groupBy("dim").agg(F.sum("n").alias("rows")).join(cells.groupBy("dim").agg(F.count("*").alias("cells"), F.sum(compared).cast("long").alias("compared")), "dim", "left").na.fill(0, ["cells", "compared"])
    ends = F.explode(F.array_distinct(F.array("i", "j"))).alias("block")
    wanted = cells.select(*group, "dim", "i", "j", ends)
    keys = [*group, "dim", "block"]
    met = index.select(*keys, "id", "norm").join(fitting(scratch.save(wanted)), keys).join(unit, [*group, "id"])
    kind = unit.schema["id"].dataType.simpleString()
    found = met.groupBy(*group, "dim", "i", "j").applyInArrow(_cell(order, threshold, block), f"a {kind}, b {kind}, cosine double")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine"), work
