"""URL filter: given rules first, then association rules mined from labelled pages.

A URL's items are its scheme, the labels of its host counted from the right, the segments of its path (digit runs made
one sign) and the names of its query. FP-growth mines frequent item sets of the labelled URLs together with their label; sets
that imply the label `block` with enough support, confidence and lift become rules, and a rule whose antecedent contains
that of another rule at least as confident is pruned. Rules are matched by an inverted index: each rule is posted under
the rarest of its items, URLs meet it there, and the rest of its items are then compared.

Items that occur in the very same labelled URLs are one to FP-growth (a path that always comes whole is one item, not
2^n item sets), and a URL that has any of them has that item: the same rules as with single items, as a set with two of
them is pruned in favour of that with one. Items that too few blocked URLs have for any rule are left out. A URL of m items that
are left still makes 2^m sets. Where a labelled URL has more than `most_items` of them, grow() finds the rules at the same
least support: FP-growth's conditional tables, one for each item, in which only sets that may be the best of some URL are
grown. It leaves out rules that are no URL's best, so each URL has the same verdict and confidence either way. A table is
one task's, in memory, and distinct item sets whose items are independent still make exponentially many steps.

Distinct URLs are judged once and joined back. The posted rules are broadcast up to `broadcast_rules` rows and joined by
a shuffle beyond. Labels are looked up by number (doc_id of labels is page_id here): the tables give no other link.

Edge cases: a null url or one without `://` has an empty host and path, fits no rule and has no items, so it is allowed.
Repeated rows and null ids stay. Without labels of class block nothing is mined. Extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm import common

BLOCK = "=block"
#: (verdict, rule): host and path of each, as given.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    rest = F.when(url.contains("://"), F.substring(url, F.locate("://", url) + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or # or the end; empty without ://."""
    rest = F.when(url.contains("://"), F.substring(url, F.locate("://", url) + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits (null if none), as a struct of rule and verdict."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def items_of(url: Column, host: Column, path: Column) -> Column:
    """The distinct items of a URL."""
    labels = F.reverse(F.filter(F.split(host, r"\."), lambda x: x != ""))
    segments = F.filter(F.split(F.regexp_replace(path, r"[0-9]+", "#"), "/"), lambda x: x != "")
    names = F.regexp_extract_all(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), F.lit(1))
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    parts = [
        F.transform(labels, lambda x, i: F.concat(F.lit("h"), (i + 1).cast("string"), F.lit(":"), x)),
        F.transform(segments, lambda x, i: F.concat(F.lit("p"), (i + 1).cast("string"), F.lit(":"), x)),
        F.transform(names, lambda x: F.concat(F.lit("q:"), x)),
        F.when(scheme != "", F.array(F.concat(F.lit("s:"), F.lower(scheme)))).otherwise(F.array().cast("array<string>")),
    ]
    return F.when(host != "", F.array_distinct(F.concat(*parts))).otherwise(F.array().cast("array<string>"))


def bundles(labelled: DataFrame) -> DataFrame:
    """(item, bundle, n, n_blocked) of the items of labelled rows (rid, items, blocked): items of the same rows are one
    bundle, named by the least of them; n, n_blocked: its rows and those that are blocked."""
    held = labelled.select("rid", "blocked", F.explode("items").alias("item"))
    rows = held.groupBy("item").agg(F.count("*").alias("n"), F.count_if("blocked").alias("n_blocked"), *(F.sum(F.xxhash64("rid", F.lit(k)).cast("decimal(38,0)")).alias(f"h{k}") for k in (1, 2)))
    named = rows.groupBy("n", "h1", "h2").agg(F.min("item").alias("bundle"))
    return rows.join(named, ["n", "h1", "h2"]).select("item", "bundle", "n", "n_blocked")


def bundled(rows: DataFrame, names: DataFrame, *keys: str) -> DataFrame:
    """rows (keys, items) with the names of their items' bundles in place of the items; items without one are left out."""
    held = rows.select(*keys, F.explode("items").alias("item")).join(names.select("item", "bundle"), "item")
    return held.groupBy(*keys).agg(F.collect_set("bundle").alias("items"))


def mine(rows: DataFrame, least: int, n: int, confidence: float, lift: float) -> DataFrame:
    """Rules (items, confidence) for the label block that hold in at least `least` rows, from all n rows of items and blocked."""
    rows = rows.select(F.when(F.col("blocked"), F.array_append("items", F.lit(BLOCK))).otherwise(F.col("items")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=confidence).fit(rows)  # rounded up to `least`
    return model.associationRules.where(F.col("consequent") == F.array(F.lit(BLOCK))).where(F.col("lift") >= lift).select(F.array_sort("antecedent").alias("items"), "confidence")


def best_sets(at: np.ndarray, item: np.ndarray, b: np.ndarray, c: np.ndarray, least: int, floor: float) -> list[tuple[list[int], int, int]]:
    """(items, blocked, clean) of the sets that are the best of some row, the empty set included.

    Row r has the items item[at[r]:at[r + 1]] and stands for b[r] blocked and c[r] clean URLs (none of either: only to be
    judged). The best set of a row is one of its sets in at least `least` blocked URLs, of the highest share blocked, if
    that is above floor. A step has a set and the rows that have it, those it may still be the best for ("live") among them:
    * an item that all its clean rows have adds nothing: a set is no worse without it;
    * an item that all its blocked rows have is added at once for the live rows with it: their sets are no worse with it;
    * no set of a row has fewer clean URLs than the row, so a row that has better already is no longer live.
    Other items are added one by one, those of fewest clean URLs first."""
    best, which, found = np.full(len(b), floor, float), np.full(len(b), -1), []
    names, ids = np.unique(item, return_inverse=True)

    def steps(chosen, names, rows, live, er, ei):
        """The steps that follow; rows: their numbers; er, ei: row (of these) and item (of names) of each that may be added."""
        wb, wc = b[rows], c[rows]
        nb, nc = wb.sum(), wc.sum()
        if nb < least:
            return
        share = nb / (nb + nc)
        better = live & (best[rows] < share)
        if better.any():
            best[rows[better]], which[rows[better]] = share, len(found)
            found.append((chosen, int(nb), int(nc)))
        live = live & (nb / (nb + wc) > best[rows])
        if not nc or not live.any():
            return
        ib, ic = np.bincount(ei, wb[er], len(names)), np.bincount(ei, wc[er], len(names))
        kept = np.flatnonzero((ib >= least) & (ic < nc) & (np.bincount(ei, live[er], len(names)) > 0))
        kept = kept[np.argsort(ic[kept], kind="stable")]
        number = np.full(len(names), -1)
        number[kept] = np.arange(len(kept))
        names, whole, ei = names[kept], ib[kept] == nb, number[ei]
        er, ei = er[ei >= 0], ei[ei >= 0]
        order = np.argsort(ei, kind="stable")
        er, ei = er[order], ei[order]
        at = np.searchsorted(ei, np.arange(len(names) + 1))

        def step(more, has, live, first, without):
            """The step with the items `more`, which the rows `has` have; items from number first on, but none of without, may follow."""
            has &= live | (wb + wc > 0)
            to = np.cumsum(has) - 1
            held = has[er[at[first] :]] & ~without[ei[at[first] :]]
            return chosen + names[more].tolist(), names, rows[has], live[has], to[er[at[first] :][held]], ei[at[first] :][held]

        while whole.any():
            live = live & (nb / (nb + wc) > best[rows])
            n_live = np.where(whole, np.bincount(ei, live[er], len(names)), 0)
            a = int(n_live.argmax()) if live.any() else 0
            if not n_live[a]:
                break
            having = np.zeros(len(rows), bool)
            having[er[at[a] : at[a + 1]]] = True
            having &= live
            taken = whole & (np.bincount(ei, having[er], len(names)) == having.sum())
            has = np.bincount(er[taken[ei]], minlength=len(rows)) == taken.sum()
            yield step(np.flatnonzero(taken), has, having, 0, taken)
            live = live & ~having
        for j in np.flatnonzero(~whole):
            live = live & (nb / (nb + wc) > best[rows])
            has = np.zeros(len(rows), bool)
            has[er[at[j] : at[j + 1]]] = True
            if (live & has).any():
                yield step(np.array([j]), has, live & has, j + 1, whole)

    every = np.arange(len(b))
    stack = [steps([], names, every, np.ones(len(b), bool), np.repeat(every, np.diff(at)), ids)]
    while stack:
        following = next(stack[-1], None)
        if following is None:
            stack.pop()
        else:
            stack.append(steps(*following))
    return [found[k] for k in np.unique(which[which >= 0])]


def grow(rows: DataFrame, urls: DataFrame, counts: DataFrame, scratch: common.Scratch, least: int, n: int, n_blocked: int, confidence: float, lift: float) -> DataFrame:
    """Those of the rules of mine() that are the best for some row of items, of rows or of urls; for rows of any number of items.

    counts: (item, n, n_blocked) of each item. A set is found in the table of its item with fewest clean rows, whose rows
    keep those of their items that have more."""
    ranked = counts.select("item", F.row_number().over(Window.orderBy(F.desc(F.col("n") - F.col("n_blocked")), "item")).alias("rank"))  # at most a URL's items / least share
    ranked = scratch.save(ranked)
    each = rows.select("items", F.col("blocked").cast("long").alias("b"), (~F.col("blocked")).cast("long").alias("c")).unionByName(urls.select("items", F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("c")))
    each = scratch.save(each.groupBy(F.array_sort("items").alias("items")).agg(F.sum("b").alias("b"), F.sum("c").alias("c")).withColumn("id", F.monotonically_increasing_id()))
    ids = each.select("id", "b", "c", F.explode("items").alias("item")).join(ranked, "item").groupBy("id", "b", "c").agg(F.array_sort(F.collect_list("rank")).alias("ids"))
    tables = ids.select("b", "c", "ids", F.posexplode("ids").alias("k", "last")).groupBy("last", F.slice("ids", F.lit(1), F.col("k")).alias("ids")).agg(F.sum("b").alias("b"), F.sum("c").alias("c"))
    share = n_blocked / n
    floor = max(confidence, lift * share) * (1 - 1e-9)  # a little below; compared with both below

    def best(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lists = table["ids"].combine_chunks().cast(pa.large_list(pa.int32()))
        at = lists.offsets.to_numpy()
        b, c = (table[x].to_numpy().astype(float) for x in ("b", "c"))
        found = best_sets(at - at[0], lists.flatten().to_numpy(), b, c, least, floor) if len(b) else []
        last = table["last"][0].as_py()
        return pa.table({"ids": pa.array([[last, *x] for x, _, _ in found], pa.list_(pa.int32())), "b": pa.array([x for _, x, _ in found], pa.int64()), "c": pa.array([x for _, _, x in found], pa.int64())})

    rules = scratch.save(tables.groupBy("last").applyInArrow(best, "ids array<int>, b long, c long").withColumn("id", F.monotonically_increasing_id()))
    named = rules.select("id", F.explode("ids").alias("rank"), (F.col("b") / (F.col("b") + F.col("c"))).alias("confidence")).join(ranked, "rank")
    named = named.groupBy("id").agg(F.array_sort(F.collect_list("item")).alias("items"), F.first("confidence").alias("confidence"))
    return named.where((F.col("confidence") >= confidence) & (F.col("confidence") / share >= lift)).select("items", "confidence")


def pruned(rules: DataFrame) -> DataFrame:
    """Without the rules whose items contain all items of another rule at least as confident.

    A rule is looked for under one of its items only, that which fewest rules have: what contains it has that item too."""
    rules = rules.withColumn("rid", F.xxhash64(F.array_join("items", "\n")))
    each = rules.select("rid", "items", "confidence", F.explode("items").alias("item"))
    common_ = each.groupBy("item").agg(F.count("*").alias("c"))
    other = each.join(common_, "item").groupBy("rid").agg(F.min_by("item", F.struct("c", "item")).alias("item"), F.first("items").alias("less"), F.first("confidence").alias("c2")).drop("rid")
    beaten = each.join(other, "item").where((F.size("less") < F.size("items")) & (F.col("c2") >= F.col("confidence")) & (F.size(F.array_except("less", "items")) == 0)).select("rid").distinct()
    return rules.join(beaten, "rid", "left_anti")


def url_rules(
    pages: DataFrame,
    labels: DataFrame,
    rules=RULES,
    support: float = 0.002,
    confidence: float = 0.6,
    lift: float = 1.5,
    least_urls: int = 20,
    broadcast_rules: int = 100_000,
    most_items: int = 14,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, confidence) of each row of pages (page_id, url).

    labels (doc_id, quality, toxic): of the pages with these ids; block is what they call toxic or of quality 0.
    support: least share of the labelled URLs that an item set must hold, and at least `least_urls` of them, so that a
    small table gives no rules by chance. most_items: frequent items of a labelled URL beyond which grow() does the mining;
    the results do not depend on it."""
    spark = pages.sparkSession
    scratch = common.Scratch(spark, "url-rules")
    slim = pages.select(common.column(pages, "page_id", "long").alias("page_id"), common.column(pages, "url", "string").alias("url"))
    parts = slim.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    parts = scratch.save(parts.withColumn("items", items_of(F.col("url"), F.col("host"), F.col("path"))))
    blocked = (F.coalesce(common.column(labels, "toxic", "int"), F.lit(0)) == 1) | (F.coalesce(common.column(labels, "quality", "int"), F.lit(1)) == 0)
    known = labels.select(common.column(labels, "doc_id", "long").alias("page_id"), blocked.alias("blocked")).groupBy("page_id").agg(F.max("blocked").alias("blocked"))
    labelled = parts.join(known, "page_id").where("size(items) > 0").select("items", "blocked", F.monotonically_increasing_id().alias("rid"))
    labelled = scratch.save(labelled)
    n_labelled, n_blocked = labelled.agg(F.count("*"), F.count_if("blocked")).first()
    least = max(least_urls, math.ceil(support * n_labelled - 1e-9), 1)
    urls = parts.where("size(items) > 0").select("url", "items").distinct()
    n_rules = 0
    if n_blocked >= least:
        names = scratch.save(bundles(labelled))
        frequent = names.where(F.col("n_blocked") >= least)
        rows = scratch.save(labelled.select("rid", "blocked").join(bundled(labelled, frequent, "rid"), "rid", "left").select("blocked", F.coalesce("items", F.array().cast("array<string>")).alias("items")))
        counts = names.select(F.col("bundle").alias("item"), "n", "n_blocked").distinct()
        if (rows.agg(F.max(F.size("items"))).first()[0] or 0) <= most_items:
            found = mine(rows, least, n_labelled, confidence, lift)
        else:
            found = grow(rows, bundled(urls, frequent, "url"), counts.where(F.col("n_blocked") >= least), scratch, least, n_labelled, n_blocked, confidence, lift)
        posted = scratch.save(pruned(scratch.save(found)))
        n_rules = posted.count()
    if n_rules:
        anchored = posted.select("rid", "confidence", F.col("items").alias("rule_items"), F.explode("items").alias("item")).join(counts, "item").groupBy("rid").agg(F.min_by("item", F.struct("n", "item")).alias("item"), F.first("rule_items").alias("rule_items"), F.first("confidence").alias("confidence"))
        anchored = scratch.save(anchored)
        index = F.broadcast(anchored) if n_rules <= broadcast_rules else anchored
        used = posted.select(F.explode("items").alias("bundle")).distinct()
        named = bundled(urls, names.join(used, "bundle", "left_semi"), "url")
        hits = named.select("url", "items", F.explode("items").alias("item")).join(index, "item").where(F.size(F.array_except("rule_items", "items")) == 0)
        best = hits.groupBy("url").agg(F.max("confidence").alias("confidence"))
        judged = parts.join(best, "url", "left")
    else:
        judged = parts.withColumn("confidence", F.lit(None).cast("double"))
    given = ruled(F.col("host"), F.col("path"), rules)
    out = judged.withColumn("given", given)
    mined = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("given.rule").alias("rule"), F.coalesce("given.verdict", mined).alias("verdict"), F.when(F.col("given").isNull(), F.col("confidence")).alias("confidence"))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
