"""Near-duplicate groups: MinHash bands, sequential Bayesian pruning, exact verification.

1. One pass turns every text into its set of distinct five-word shingles (64-bit hashes) and keeps the set's size, a
   128-bit fingerprint, 32 band keys of four of 128 minima each, and a signature: the minima's low bytes.
2. Rows with equal fingerprints are one class, with a number of its own; from here on classes are linked, and one row
   (of the smallest id, whatever other texts that id has) speaks for each. Equal sets have equal signatures and bands.
3. Two classes that share a band key are candidates. Instead of all pairs of a bucket, each member is first compared with
   the bucket's leader, the member that meets most others over all its buckets (of a group of edited copies, one close to
   the original). Links found make components. Buckets that still hold several components are the rest: small ones
   list their pairs across components, large ones go through a prefix filter with sizes (a pair of the wanted
   similarity shares one of the rarest shingles of both, up to a place that follows from the two sizes), which is
   exact. No bucket is cut off and no pair of one component is made twice.
4. A candidate's signatures are compared 16 minima at a time. With a uniform prior the posterior of the similarity is a
   Beta; a pair goes as soon as the probability that it reaches the threshold falls under `miss`. Equal minima have equal
   low bytes, so these lose no pair that whole minima keep; of unequal ones, one in 256 agrees too.
5. What survives is confirmed on the full shingle sets, in integers: 100 * intersection >= 75 * union.

Hot groups: class sizes and leaders are partial aggregates. Joins on a band key, a shingle, a leader or a class deal the
rows of keys with very many over several tasks (joins.hot_join); components, open keys and their counts are sent whole to
the rows while they are small (joins.fitting). Recall: a pair at similarity 0.75 shares no band with probability 5e-6.

Edge cases: null, empty or blank text has an empty set (n_shingles 0), is linked with nothing and kept. A repeated row
(same id and text) stays repeated in the output. An id with several texts has a component for each of them, the smallest
id its text reaches. Rows with a null id are linked with nothing and have a null component.
Empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import common
from siltstone.operators.joins import dealt_join, fitting, hot_join, hot_keys

PERMUTATIONS, BANDS, ROWS = 128, 32, 4
BATCH = 16
_MULT = (common.mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x51_7C_C1_B7_27_22_0A_95)) | np.uint64(1)).reshape(-1, 1)
_ADD = common.mix(np.arange(1001, 1001 + PERMUTATIONS, dtype=np.uint64)).reshape(-1, 1)
SIGNED = "doc_id long, fp long, n_shingles long, fp1 long, fp2 long, sig binary, bands array<long>"


def _sets(array: pa.Array) -> list[np.ndarray]:
    raw, at = common.text_bytes(array)
    word, _, _, row_at = common.words(raw, at)
    hashes, ends = common.shingles(word, row_at)
    return [np.unique(hashes[ends[i] : ends[i + 1]]) for i in range(len(ends) - 1)]


def signature(hashes: np.ndarray) -> np.ndarray:
    """The 128 minima (upper 32 bits) of a non-empty set, a long set taken in parts."""
    low = None
    for i in range(0, len(hashes), 4096):
        part = (hashes[i : i + 4096] * _MULT + _ADD).min(axis=1)
        low = part if low is None else np.minimum(low, part)
    return (low >> np.uint64(32)).astype(np.uint32)


def _signed(batches):
    band_key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for whole in batches:
        for batch in common.pieces(whole, "text"):
            sets = _sets(batch.column("text"))
            n = np.array([len(x) for x in sets], np.int64)
            sig = np.zeros((len(sets), PERMUTATIONS), np.uint32)
            fp = np.zeros((len(sets), 2), np.uint64)
            for i, x in enumerate(sets):
                if len(x):
                    sig[i] = signature(x)
                    fp[i] = common.mix(x).sum(), common.mix(x ^ np.uint64(0xA0761D6478BD642F)).sum()
            quads = sig.reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(band_key, quads.shape[:2]).copy()
            for r in range(ROWS):
                key = common.mix(key ^ quads[:, :, r]) + band_key
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(key.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("fp"), pa.array(n), pa.array(fp[:, 0].view(np.int64)), pa.array(fp[:, 1].view(np.int64)), pa.array([x.tobytes() for x in sig.astype(np.uint8)], pa.binary()), keys],
                names=["doc_id", "fp", "n_shingles", "fp1", "fp2", "sig", "bands"],
            )


def sign(docs: DataFrame) -> DataFrame:
    """Set size, set fingerprint, signature and band keys of each (doc_id, text)."""
    slim = docs.select(common.column(docs, "doc_id", "long").alias("doc_id"), common.column(docs, "text", "string").alias("text"))
    return slim.withColumn("fp", F.xxhash64("text")).mapInArrow(_signed, SIGNED)


def needed(threshold: float, miss: float) -> list[tuple[int, int]]:
    """(minima compared, least agreements that keep a pair): below, P(similarity >= threshold | agreements) < miss.

    With a uniform prior that posterior is P(Binomial(n + 1, threshold) <= agreements)."""
    out = []
    for n in range(BATCH, PERMUTATIONS + 1, BATCH):
        below = 0.0
        for m in range(n + 1):
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= miss:
                out.append((n, m))
                break
    return out


def _survivors(threshold: float, miss: float):
    steps = needed(threshold, miss)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PERMUTATIONS) for c in ("sig_a", "sig_b"))
            alive, same, done = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), 0
            for n, least in steps:
                same = same + (a[alive, done:n] == b[alive, done:n]).sum(axis=1)
                keep = same >= least
                alive, same, done = alive[keep], same[keep], n
            yield batch.select(["a", "b"]).take(pa.array(alive))

    return run


def _confirm(percent: int):
    def run(batches):
        for whole in batches:
            for batch in common.pieces(whole, "text_a", 2 << 20):
                texts = [batch.column(c).dictionary_encode() for c in ("text_a", "text_b")]  # a leader's text stands in many rows
                a, b = (_sets(t.dictionary) for t in texts)
                ok = []
                for i, (k, m) in enumerate(zip(*(t.indices.to_pylist() for t in texts), strict=True)):
                    x, y = a[k], b[m]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both and 100 * both >= percent * (len(x) + len(y) - both):
                        ok.append(i)
                yield batch.select(["a", "b"]).take(pa.array(ok, pa.int64()))

    return run


def _prefixes(percent: int):
    """(id, token, n, reach) for the shingles of a set, rarest first, that can be in a prefix: the one in place p
    (from 0) serves pairs with sets of at most `reach` = (100 + percent) * (n - p) / percent - n shingles, and no set
    under percent * n / 100 is similar enough."""

    def run(batches):
        for batch in batches:
            ids, toks, sizes, reaches = [], [], [], []
            for i, entries in zip(batch.column("id").to_pylist(), batch.column("entries"), strict=True):
                values = entries.values
                df, h = values.field("df").to_numpy(zero_copy_only=False), values.field("h").to_numpy(zero_copy_only=False)
                n = len(h)
                order = np.lexsort((h, df))
                reach = (100 + percent) * (n - np.arange(n)) // percent - n
                order, reach = order[100 * reach >= percent * n], reach[100 * reach >= percent * n]
                shared = df[order] > 1
                toks.append(h[order[shared]])
                reaches.append(reach[shared])
                ids += [i] * len(toks[-1])
                sizes += [n] * len(toks[-1])
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(toks)), pa.array(sizes, pa.int64()), pa.array(np.concatenate(reaches))], names=["id", "token", "n", "reach"])

    return run


def _exploded(batches):
    for whole in batches:
        for batch in common.pieces(whole, "text"):
            sets = _sets(batch.column("text"))
            if total := sum(map(len, sets)):
                ids = np.repeat(batch.column("id").to_numpy(), [len(x) for x in sets])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(sets).view(np.int64))], names=["id", "h"])
                del total


def near_duplicates(
    docs: DataFrame,
    percent: int = 75,
    miss: float = 1e-7,
    small_bucket: int = 16,
    broadcast_ids: int = 600_000,
    scratch: common.Scratch | None = None,
) -> DataFrame:
    """(doc_id, fp, n_shingles, component_id, kept) of each row of docs; fp is the text's hash.

    percent: the least Jaccard similarity of a link, in hundredths; the bands suit 70 and more. miss: probability with
    which the Bayesian bound may drop a pair at the threshold. small_bucket: up to so many members a bucket's remaining
    pairs are listed directly; larger ones go through the prefix filter. broadcast_ids: the ids of
    texts to confirm (three longs each, about 64 MB as a hash table) are sent to all executors up to that number, and joined
    by a shuffle beyond it. scratch: where its tables go; the large ones are deleted when nothing reads them any more, the others are the caller's to clear."""
    scratch = scratch or common.Scratch(docs.sparkSession, "near-dedup")
    scratch.batch_bytes = 8 << 20
    signed = scratch.save(sign(docs))
    same = ["n_shingles", "fp1", "fp2"]
    rep = F.min(F.struct("doc_id", "fp")).alias("rep")
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(rep, F.count("*").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = scratch.save(classes.select("rep.doc_id", "rep.fp", *same, "n", "sig", "bands", F.monotonically_increasing_id().alias("id")))
    slim = scratch.save(signed.select("doc_id", "fp", *same))
    scratch.drop(signed)
    member = classes.select("id", F.explode("bands").alias("key"))
    full = scratch.save(member.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    hot = hot_keys(full, ["key"], scratch)
    member = scratch.save(hot_join(member, full, ["key"], hot))
    met = member.groupBy("id").agg(F.sum("n").alias("met"), F.collect_list("key").alias("keys"))
    leader = scratch.save(met.select("id", "met", F.explode("keys").alias("key")).groupBy("key").agg(F.max_by("id", F.struct("met", -F.col("id"))).alias("leader")))
    sigs = classes.select("id", "sig")
    survivors = _survivors(percent / 100, miss)
    texts = docs.select(common.column(docs, "doc_id", "long").alias("doc_id"), common.column(docs, "text", "string").alias("text")).withColumn("fp", F.xxhash64("text"))

    def texts_of(ids: DataFrame) -> DataFrame:
        """(id, text) of the classes with these ids."""
        rows = scratch.save(classes.select("doc_id", "fp", "id").join(ids, "id", "left_semi"))
        rows = F.broadcast(rows) if rows.count() <= broadcast_ids else rows
        return texts.join(rows, ["doc_id", "fp"]).groupBy("id").agg(F.min("text").alias("text"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The links among pairs (a < b, distinct)."""
        ends = pairs.select(F.explode(F.array(*(F.struct(F.lit(end).alias("end"), F.col(end).alias("id")) for end in "ab"))).alias("x"))
        hot = hot_keys(ends.groupBy("x.end", "x.id").agg(F.count("*").alias("n")), ["end", "id"], scratch)
        hot = {end: None if hot is None else hot.where(F.col("end") == end).select(F.col("id").alias(end), "parts") for end in "ab"}
        kept = pairs
        for end in "ab":
            kept = hot_join(kept, sigs.select(F.col("id").alias(end), F.col("sig").alias(f"sig_{end}")), [end], hot[end])
        kept = scratch.save(kept.select("a", "b", "sig_a", "sig_b").mapInArrow(survivors, "a long, b long"))
        own = texts_of(kept.select(F.col("a").alias("id")).unionAll(kept.select(F.col("b").alias("id"))).distinct())
        paired = kept
        for end in "ab":
            paired = hot_join(paired, own.select(F.col("id").alias(end), F.col("text").alias(f"text_{end}")), [end], hot[end])
        return scratch.save(paired.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(percent), "a long, b long"))

    first = hot_join(member, leader, ["key"], hot).where("id <> leader").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b"))
    first = scratch.save(first.distinct())
    links = confirmed(first)
    scratch.drop(full, leader, first)
    comp = common.components(links, scratch)
    at = scratch.save(member.join(fitting(comp), "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("comp")))
    scratch.drop(member)
    small = at.where(F.col("n") <= small_bucket).groupBy("key").agg(F.collect_list(F.struct("id", "comp")).alias("members"))
    others = F.filter("members", lambda y: (y["id"] > F.col("x.id")) & (y["comp"] != F.col("x.comp")))
    pairs = small.select("members", F.explode("members").alias("x")).select("x", F.explode(others).alias("y")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    large = at.where(F.col("n") > small_bucket)
    open_ = scratch.save(large.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n")).where("low < high").select("key", "n"))
    if not open_.isEmpty():
        large = scratch.save(dealt_join(large, open_.select("key"), ["key"], open_, scratch, "left_semi").select("id", "comp").distinct())
        token = scratch.save(texts_of(large).mapInArrow(_exploded, "id long, h long"))
        df = scratch.save(token.groupBy("h").agg(F.count("*").alias("n")))
        listed = hot_join(token, df, ["h"], hot_keys(df, ["h"], scratch)).groupBy("id").agg(F.collect_list(F.struct(F.col("n").alias("df"), "h")).alias("entries"))
        posted = scratch.save(listed.mapInArrow(_prefixes(percent), "id long, token long, n long, reach long").join(fitting(large), "id"))
        scratch.drop(token, df)
        # a token makes pairs only if several components hold it; a row of it only if some holder is within its reach
        mixed = scratch.save(posted.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("n").alias("least"), F.count("*").alias("n")).where("low < high").select("token", "least", "n"))
        within = scratch.save(dealt_join(posted, mixed.drop("n"), ["token"], mixed, scratch).where("least <= reach").drop("least"))
        scratch.drop(posted)
        still = scratch.save(within.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n")).where("low < high").select("token", "n"))
        prefix = scratch.save(dealt_join(within, still.select("token"), ["token"], still, scratch, "left_semi"))
        scratch.drop(within)
        x, y = (prefix.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "comp", "n", "reach"))) for s in "xy")
        near = x.join(y, "token").where("id_x < id_y and comp_x <> comp_y and n_y <= reach_x and n_x <= reach_y")
        pairs = pairs.unionAll(near.select(F.col("id_x").alias("a"), F.col("id_y").alias("b")))
    pairs = scratch.save(pairs.distinct())
    scratch.drop(at)
    if not pairs.isEmpty():
        links = scratch.save(links.unionAll(confirmed(pairs)))
        comp = common.components(links, scratch)
    # a component is named by the smallest id of its classes, a class without links by its own; other rows stand alone
    named = scratch.save(classes.select("id", "doc_id", *same, "n").join(fitting(comp), "id", "left").where("n > 1 or component is not null").drop("n"))
    names = scratch.save(named.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("name"), F.count("*").alias("n")))
    named = dealt_join(named.withColumn("component", F.coalesce("component", -F.col("id") - 1)), names.drop("n"), ["component"], names, scratch, "left")
    named = scratch.save(named.select(*same, F.coalesce("name", "doc_id").alias("component_id")))
    out = hot_join(slim, named, same, hot_keys(classes, same, scratch), "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "fp", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("fp")


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT k.a, k.b FROM k JOIN n x ON x.doc_id = k.a JOIN n y ON y.doc_id = k.b WHERE 100 * k.k >= 75 * (x.n + y.n - k.k)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS id, a AS low FROM u UNION SELECT u.b, r.low FROM r JOIN u ON u.a = r.id WHERE r.low < u.b),
c AS (SELECT id, min(low) AS low FROM r GROUP BY id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.low, w.doc_id)::BIGINT AS component_id, coalesce(c.low, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.id = w.doc_id
"""
