"""Assembly of fragments into ordered streams.

An image's fragments, in order of offset, are cut into pieces wherever a gap over max_gap follows all that came before: no
edge crosses it, so pieces are independent. A piece is cut into blocks of rows, each of which also reads the last rows of
the block before it; edges are worked out inside a block, as products of small matrices.

The heaviest path needs no task with a whole piece. A block's effect on the weights of the last max_lookback rows is a
(max, +) matrix; a tree of products gives the weights before each block, and then all blocks are solved on their own.
What a block does to a path that comes back through it is a function from its last rows to those of the block before; a
tree of these gives where the path passes each block. Weights are whole numbers of 1 / UNIT, so sums do not depend on
the order they are taken in, and blocks give the very path that one pass over the rows would.

The path of an image is that of its best piece; without its rows only that piece is solved again for the next stream."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.scratch import Scratch
from siltstone.operators.order import numbered, running

#: Scores are added as whole numbers of this fraction (sums under 2**60 / UNIT, about 10**9).
UNIT = 1 << 30
#: Less than any path.
NONE = -(1 << 60)

@dataclass(frozen=True)
class Weights:
    max_gap: int = 1_048_576
    max_overlap: int = 65_536
    gap_penalty: float = 15.0
    overlap_penalty: float = 20.0
    type_match_bonus: float = 8.0
    type_mismatch_penalty: float = 5.0
    cosine_weight: float = 25.0
    jaccard_weight: float = 10.0
    structure_bonus: float = 6.0
    min_edge_score: float = 5.0
    max_lookback: int = 200
    #: Rows that a task holds of a piece, max_lookback or more; 0: 16 times that, 1024 at least.
    block_rows: int = 0


def pieces(fragments: DataFrame, max_gap: int, group: str = "image") -> DataFrame:
    """Adds `piece`, the offset at which the row's piece begins.

    Running maxima are two-level (ranges of offsets, then rows inside one), so no task orders a whole image."""
    width = max(1, max_gap) * 256
    rows = fragments.withColumn("_end", F.col("offset") + F.col("size")).withColumn("_range", F.floor(F.col("offset") / width))
    inside, before = W.partitionBy(group, "_range").orderBy("offset", "id"), W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ends = rows.groupBy(group, "_range").agg(F.max("_end").alias("_m")).select(group, "_range", F.max("_m").over(before).alias("_far"))
    # end of all rows before this one
    so_far = F.greatest("_far", F.max("_end").over(inside.rowsBetween(W.unboundedPreceding, -1)))
    begins = F.when(so_far.isNull() | (F.col("offset") - so_far > max_gap), F.col("offset"))
    rows = rows.join(ends, [group, "_range"]).withColumn("_begins", begins)
    starts = rows.groupBy(group, "_range").agg(F.max("_begins").alias("_m")).select(group, "_range", F.max("_m").over(before).alias("_last"))
    piece = F.greatest("_last", F.max("_begins").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    return rows.join(starts, [group, "_range"]).withColumn("piece", piece).drop("_end", "_range", "_far", "_begins", "_last")


def _unit(vectors: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)


def _jaccard(sets: list) -> np.ndarray:
    """Jaccard similarity of every two of the sets; 0 of empty ones."""
    names = {x: k for k, x in enumerate(sorted({x for s in sets for x in s or ()}))}
    held = np.zeros((len(sets), len(names)), np.float32)
    for i, s in enumerate(sets):
        held[i, [names[x] for x in s or ()]] = 1
    both = held @ held.T
    size = held.sum(axis=1)
    union = size[:, None] + size[None, :] - both
    return np.divide(both, union, out=np.zeros_like(both), where=union > 0).astype(float)


def _arcs(table: pa.Table, new: np.ndarray, w: Weights):
    """(i, j, gap, overlap, score) of the edges from rows i into rows j of a table in order of rn; j: of the rows `new`."""
    get = lambda c: table.column(c).to_numpy()
    rn, at, size = get("rn"), get("offset"), get("size")
    kind, ok = np.array(table.column("file_type").to_pylist(), object), np.array(table.column("structured").to_pylist(), bool)
    end = at + size
    gap, overlap = (np.maximum(x, 0) for x in (at[None, new] - end[:, None], end[:, None] - at[None, new]))
    reach = (rn[:, None] < rn[None, new]) & (rn[None, new] - rn[:, None] <= w.max_lookback)
    # the nearest earlier row with too large a gap ends the look-back
    stop = np.where(reach & (gap > w.max_gap), rn[:, None], -1).max(axis=0)
    good = reach & (rn[:, None] > stop[None, :]) & (overlap <= w.max_overlap)
    unit = _unit(np.array(table.column("vector").to_pylist(), float))
    score = w.cosine_weight * (unit @ unit[new].T) + w.jaccard_weight * _jaccard(table.column("links").to_pylist())[:, new]
    score += np.where(kind[:, None] == kind[None, new], w.type_match_bonus, -w.type_mismatch_penalty) + w.structure_bonus * (ok[:, None] & ok[None, new])
    for weight, x, most in ((w.gap_penalty, gap, w.max_gap), (w.overlap_penalty, overlap, w.max_overlap)):
        score -= weight * x / most if most else 0.0
    i, j = np.nonzero(good & (score >= w.min_edge_score))
    return i, new[j], gap[i, j], overlap[i, j], score[i, j]


def _look(w: Weights) -> int:
    return max(1, w.max_lookback)


def _block_rows(w: Weights) -> int:
    return max(_look(w), w.block_rows) if w.block_rows else max(16 * _look(w), 1024)


def _all_arcs(table: pa.Table, w: Weights):
    """The table of one block (own rows and the last rows before them) in order, the places of its own rows, and _arcs() of
    these, taken max_lookback rows at a time."""
    table = table.take(pa.array(np.argsort(table.column("rn").to_numpy())))
    own, found = np.flatnonzero(table.column("own").to_numpy(zero_copy_only=False)), []
    for k in range(0, len(own), max(_look(w), 64)):
        new = own[k : k + max(_look(w), 64)]
        first = max(0, new[0] - _look(w))
        i, j, *rest = _arcs(table.slice(first, new[-1] + 1 - first), new - first, w)
        found.append((i + first, j + first, *rest))
    return table, own, [np.concatenate(x) for x in zip(*found)]


def _key(table: pa.Table, group: list[str], n: int = 1) -> dict:
    return {c: table.column(c).combine_chunks().take(pa.array(np.zeros(n, np.int64))) for c in group}


def _posted(rows: DataFrame, w: Weights, group: list[str]) -> DataFrame:
    """rows (numbered in their group) by block, and again by the next block where that looks back at them."""
    look, size = _look(w), _block_rows(w)
    block = (F.col("rn") / size).cast("long")
    again = (F.col("rn") % size >= size - look) & ((block + 1) * size < F.col("n_rows"))
    to = F.array_compact(F.array(F.struct(block.alias("block"), F.lit(True).alias("own")), F.when(again, F.struct((block + 1).alias("block"), F.lit(False).alias("own")))))
    narrow = rows.select(*group, "id", "rn", "n_rows", "offset", "size", "file_type", "structured", "links", "vector", *(["score"] if "score" in rows.columns else []), F.explode(to).alias("x"))
    return narrow.select("*", "x.block", "x.own").drop("x")


def _long(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("long") for c in ("id", "offset", "size")})


def edges(fragments: DataFrame, weights: Weights = Weights(), group: str = "image") -> DataFrame:
    """(image, piece, a, b, gap, overlap, score) of fragments (image, id, offset, size, file_type, structured, links, vector)
    with an edge: b follows a by offset, at most max_lookback rows later and before the first gap over max_gap."""
    rows = fragments if "piece" in fragments.columns else pieces(fragments, weights.max_gap, group)
    rows = numbered(_long(rows), [group, "piece"], ["offset", "id"], Scratch(fragments.sparkSession, "edges"))

    def run(table: pa.Table) -> pa.Table:
        table, _, (i, j, gap, overlap, score) = _all_arcs(table, weights)
        ids = table.column("id").to_numpy()
        return pa.table(_key(table, [group, "piece"], len(i)) | {"a": ids[i], "b": ids[j], "gap": gap, "overlap": overlap, "score": score})

    image = rows.schema[group].dataType.simpleString()
    return _posted(rows, weights, [group, "piece"]).groupBy(group, "piece", "block").applyInArrow(run, f"{group} {image}, piece long, a long, b long, gap long, overlap long, score double")


# ---------------------------------------------------------------- heaviest paths


def transfer(own: np.ndarray, ptr: np.ndarray, back: np.ndarray, score: np.ndarray, look: int) -> np.ndarray:
    """The (max, +) matrix of a block: row j, column k: the heaviest way from the k-th of the `look` rows before the block to
    the j-th of its last `look` rows; the last column: the heaviest that begins in the block. Edges into row r are
    ptr[r] to ptr[r + 1]: `back` rows up, of weight `score`; own: the rows' weights."""
    ways = np.full((look + len(own), look + 1), NONE)
    ways[np.arange(look), np.arange(look)] = 0
    for r, weight in enumerate(own):
        a, b = ptr[r], ptr[r + 1]
        way = ways[look + r]
        if b > a:
            (ways[look + r - back[a:b]] + score[a:b, None]).max(axis=0, out=way)
        way[look] = max(way[look], 0)
        np.maximum(way + weight, NONE, out=way)
    return ways[len(own) :]


def after(weights: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The weights of the last rows of a block, given those of the rows before it."""
    matrix = matrix.reshape(len(weights), -1)
    return np.maximum((matrix[:, :-1] + weights).max(axis=1), matrix[:, -1])


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """The matrix of blocks one after the other."""
    look = next(n for n in range(1, len(matrices[0]) + 1) if n * (n + 1) >= len(matrices[0]))
    out, *rest = (m.reshape(look, look + 1) for m in matrices)
    for m in rest:
        first, out = out, np.full_like(out, NONE)
        out[:, -1] = m[:, -1]
        for k in range(look):
            np.maximum(out, m[:, k, None] + first[k], out=out)
        np.maximum(out, NONE, out=out)
    return out


def forward(own: np.ndarray, ptr: np.ndarray, back: np.ndarray, score: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight of the heaviest path that ends at each row, and how many rows up its step before is (0: it begins here).
    A path that adds nothing is not taken up; of equal ones the nearest is."""
    look = len(before)
    weight, step = np.concatenate((before, np.zeros(len(own), np.int64))), np.zeros(len(own), np.int32)
    for r in range(len(own)):
        a, b = ptr[r], ptr[r + 1]
        top = 0
        if b > a:
            ways = weight[look + r - back[a:b]] + score[a:b]
            k = int(ways.argmax())
            if ways[k] > 0:
                top, step[r] = ways[k], back[a + k]
        weight[look + r] = own[r] + top
    return weight[look:], step


def passed(step: np.ndarray, look: int) -> np.ndarray:
    """For each row the place among the `look` rows before the block where a path through the row comes from, or -1."""
    out = np.full(len(step), -1, np.int32)
    for r in np.flatnonzero(step):
        p = r - step[r]
        out[r] = out[p] if p >= 0 else look + p
    return out


_BLOCK = "block long, own binary, step binary, total long, at int, ptr binary, back binary, score binary, matrix binary"


def _best_end(weight: np.ndarray) -> int:
    """Of equal ends the last."""
    return len(weight) - 1 - int(weight[::-1].argmax())


def _blocks(w: Weights, group: list[str]):
    """Rows of _BLOCK: solved (step, total, at) if the block is a whole piece, else its edges and, but for the last, its matrix."""

    def run(table: pa.Table) -> pa.Table:
        table, mine, (i, j, _, _, score) = _all_arcs(table, w)
        weigh = lambda x: np.rint(np.nan_to_num(np.asarray(x, float)) * UNIT).astype(np.int64)
        own = weigh(table.column("score").to_numpy(zero_copy_only=False)[mine])
        order = np.lexsort((j - i, j))
        to, back, score = j[order] - mine[0], (j - i)[order].astype(np.int32), weigh(score[order])
        ptr = np.searchsorted(to, np.arange(len(own) + 1)).astype(np.int64)
        block, rows = table.column("block")[0].as_py(), table.column("n_rows")[0].as_py()
        held = dict.fromkeys(("step", "total", "at", "ptr", "back", "score", "matrix"))
        if rows <= _block_rows(w):
            weight, step = forward(own, ptr, back, score, np.full(_look(w), NONE))
            at = _best_end(weight)
            held |= {"step": step.tobytes(), "total": int(weight[at]), "at": at}
        else:
            held |= {"ptr": ptr.tobytes(), "back": back.tobytes(), "score": score.tobytes()}
            if (block + 1) * _block_rows(w) < rows:
                held["matrix"] = transfer(own, ptr, back, score, _look(w)).tobytes()
        kinds = {"total": pa.int64(), "at": pa.int32()}
        return pa.table(_key(table, group) | {"block": pa.array([block]), "own": pa.array([own.tobytes()])} | {k: pa.array([v], kinds.get(k, pa.binary())) for k, v in held.items()})

    return run


def _solved(look: int, group: list[str]):
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                x = {c: batch.column(c)[k].as_py() for c in ("own", "ptr", "back", "score", "state")}
                own, ptr, score = (np.frombuffer(x[c], np.int64) for c in ("own", "ptr", "score"))
                weight, step = forward(own, ptr, np.frombuffer(x["back"], np.int32), score, np.frombuffer(x["state"], np.int64))
                at, one = _best_end(weight), batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*(one.column(c) for c in (*group, "block", "own")), pa.array([step.tobytes()], pa.binary()), pa.array([int(weight[at])]), pa.array([at], pa.int32())], names=[*group, "block", "own", "step", "total", "at"])

    return run


def _exits(look: int, group: list[str], last: bool):
    """For mapInArrow: what passed() says of a block: of its row `at` alone (the end of a path), else of its last rows."""

    def run(batches):
        for batch in batches:
            steps = [np.frombuffer(x, np.int32) for x in batch.column("step").to_pylist()]
            found = [passed(s, look)[[at]] if last else passed(s, look)[-look:] for s, at in zip(steps, batch.column("at").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*group, "block")), pa.array([x.tobytes() for x in found], pa.binary())], names=[*group, "block", "payload"])

    return run


def _chained(functions: list[np.ndarray]) -> np.ndarray:
    out = np.arange(len(functions[0]), dtype=np.int32)
    for f in functions:
        out = np.where(out >= 0, f[out], np.int32(-1))
    return out


def _traced(look: int, group: list[str]):
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                step, own = (np.frombuffer(batch.column(c)[k].as_py(), t) for c, t in (("step", np.int32), ("own", np.int64)))
                state, r = batch.column("state")[k].as_py(), batch.column("at")[k].as_py()
                if state is not None:  # the path comes back from the next block
                    r = int(np.frombuffer(state, np.int32)[0])
                    r = r + len(step) - look if r >= 0 else -1
                path = []
                while r >= 0:
                    path.append(r)
                    r = r - int(step[r]) if step[r] else -1
                path.reverse()
                one = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*(one.column(c) for c in (*group, "block")), pa.array([path], pa.list_(pa.int32())), pa.array([int(own[path].sum())])], names=[*group, "block", "rows", "own"])

    return run


def _types(rows: DataFrame, group: list[str]) -> str:
    return ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in group)


PIECE = ["image", "piece", "turn"]


def _solve(rows: DataFrame, w: Weights, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows numbered in their pieces, blocks with the steps of their rows and their best end)."""
    rows = numbered(rows, PIECE, ["offset", "id"], scratch)
    types = _types(rows, PIECE)
    blocks = scratch.save(_posted(rows, w, PIECE).groupBy(*PIECE, "block").applyInArrow(_blocks(w, PIECE), f"{types}, {_BLOCK}"))
    solved = (*PIECE, "block", "own", "step", "total", "at")
    whole, parts = blocks.where("step IS NOT NULL").select(*solved), blocks.where("step IS NULL")
    if parts.isEmpty():
        return rows, whole
    # the last block of a piece has an empty payload: nothing comes after it
    chain = parts.select(*PIECE, "block", F.coalesce("matrix", F.lit(b"")).alias("payload"))
    joined = lambda ms: product([m for m in ms if len(m)]) if any(len(m) for m in ms) else ms[0]
    states = running(chain, PIECE, F.lit(np.full(_look(w), NONE).tobytes()), joined, lambda v, m: after(v, m) if len(m) else v, "int64", scratch)
    found = parts.join(states, [*PIECE, "block"]).mapInArrow(_solved(_look(w), PIECE), f"{types}, block long, own binary, step binary, total long, at int")
    return rows, whole.unionByName(scratch.save(found))


def _paths(solved: DataFrame, best: DataFrame, w: Weights, scratch: Scratch) -> DataFrame:
    """(image, piece, turn, block, rows, own) of the paths that end at best (image, piece, turn, total, block, at): the
    rows of the path in each block."""
    look, types = _look(w), _types(best, PIECE)
    mine = solved.drop("at", "total").join(best.select(*PIECE, F.col("block").alias("last"), "at"), PIECE).where("block <= last")
    end = mine.where("block = last").withColumn("state", F.lit(None).cast("binary"))
    earlier = mine.where("block < last")
    if not best.where("block > 0").isEmpty():
        place = f"{types}, block long, payload binary"
        came = end.mapInArrow(_exits(look, PIECE, True), place).select(*PIECE, F.col("payload").alias("start"))
        through = earlier.select(*PIECE, (F.col("last") - 1 - F.col("block")).alias("block"), "step", "at").mapInArrow(_exits(look, PIECE, False), place)
        states = running(through.join(came, PIECE), PIECE, F.col("start"), _chained, lambda k, f: f[k] if k[0] >= 0 else k, "int32", scratch)
        back = earlier.join(states.withColumnRenamed("block", "_back"), PIECE).where(F.col("_back") == F.col("last") - 1 - F.col("block")).drop("_back")
        end = end.unionByName(back)
    return end.mapInArrow(_traced(look, PIECE), f"{types}, block long, rows array<int>, own long").where("size(rows) > 0")


def assemble(fragments: DataFrame, weights: Weights = Weights(), max_streams: int = 3) -> DataFrame:
    """(image, stream, position, id, offset, size, total_score, confidence, reasons): up to max_streams streams of each image,
    peeled off one by one: the heaviest path, then that of the rest. Of equal ends the last wins, of equal predecessors the
    nearest; a score that is null or not a number counts as 0. Rows of a null image are in no stream.

    fragments: image, id, offset, size, file_type, score (base + overall), structured, links, vector. A task holds the rows
    of a block (Weights.block_rows), however long a piece is."""
    scratch = Scratch(fragments.sparkSession, "assemble")
    left = scratch.save(_long(fragments))
    rows = solved = None
    streams = []
    for turn in range(max(1, max_streams)):
        found = _solve(pieces(left, weights.max_gap).withColumn("turn", F.lit(turn)), weights, scratch)
        rows, solved = found if rows is None else (old.unionByName(new) for old, new in zip((rows, solved), found))
        best = solved.groupBy("image").agg(F.max(F.struct("total", "piece", "turn", "block", "at")).alias("b")).select("image", "b.*")
        best = scratch.save(best)
        path = scratch.save(_paths(solved, best, weights, scratch))
        if path.isEmpty():
            break
        size = _block_rows(weights)
        before = F.coalesce(F.sum(F.size("rows")).over(W.partitionBy("image").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        whole = path.groupBy("image").agg(F.sum(F.size("rows")).alias("length"), F.sum("own").alias("owned")).join(best.select("image", "total"), "image")
        steps = path.withColumn("_before", before).select(*PIECE, "block", "_before", F.posexplode("rows").alias("_k", "_r"))
        steps = steps.select(*PIECE, (F.col("block") * size + F.col("_r")).alias("rn"), (F.col("_before") + F.col("_k")).cast("long").alias("position")).join(whole, "image")
        taken = scratch.save(steps.join(rows.select(*PIECE, "rn", "id", "offset", "size"), [*PIECE, "rn"]).withColumn("stream", F.lit(turn).cast("long")).sortWithinPartitions("image", "position"))
        streams.append(taken)
        if turn + 1 < max_streams:
            changed = rows.join(best.select(*PIECE), PIECE, "left_semi").join(taken.select(*PIECE, "rn"), [*PIECE, "rn"], "left_anti")
            left = scratch.save(changed.drop("piece", "turn", "rn", "n_rows"))
            rows, solved = (x.join(best.select(*PIECE), PIECE, "left_anti") for x in (rows, solved))
    if not streams:
        streams = [scratch.save(left.where("false").select("image", "id", "offset", "size", *(F.lit(0).cast("long").alias(c) for c in ("stream", "position", "length", "owned", "total"))))]
    out = streams[0]
    for more in streams[1:]:
        out = out.unionByName(more)
    total = F.col("total") / UNIT
    mean = F.when(F.col("length") > 1, (F.col("total") - F.col("owned")) / UNIT / (F.col("length") - 1)).otherwise(0.0)
    reasons = F.array(F.format_string("fragments=%d", "length"), F.format_string("avg_edge_score=%.2f", mean), F.format_string("path_score=%.2f", total))
    return out.select("image", "stream", "position", "id", "offset", "size", total.alias("total_score"), F.greatest(total / F.col("length"), F.lit(0.0)).alias("confidence"), reasons.alias("reasons"))
