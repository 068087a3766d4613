"""Phrase collocations against plain counts of all phrases."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from siltstone.llm import collocations

DOCS = "doc_id long, text string, lang string, id long, phrase string, n long, f long"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=30, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(AZ)):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            for k in range(1, 5):
                f.update((lang, tuple(ws[i : i + k])) for i in range(len(ws) - k + 1))
    out = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out[lang, p] = (score, a, f[lang, p[:k]], f[lang, p[k:]])
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    kept = {x: v for x, v in out.items() if not any(y[0] == x[0] and len(y[1]) > len(x[1]) and inside(x[1], y[1]) and 100 * w[1] >= 80 * v[1] for y, w in out.items())}
    rows = []
    for lang in n:
        order = sorted(((-v[0], -v[1], " ".join(p).encode(), v, p) for (g, p), v in kept.items() if g == lang))[:top]
        rows += [(lang, i, " ".join(p), v[1], v[2], v[3], n[lang], v[0]) for i, (*_, v, p) in enumerate(order, 1)]
    return sorted(rows)


def texts(seed=1):
    rng = random.Random(seed)
    some = lambda n, v, c=" ": "".join(f"{'W' if rng.random() < 0.2 else 'w'}{rng.randrange(v)}" + (rng.choice(".,;:!?\n\x0b\x0c\r\t") if rng.random() < 0.1 else c) for _ in range(n))
    rows = [(some(rng.randrange(200), 12), rng.choice(["en", "de", None])) for _ in range(60)] + [(some(4000, 9), "en")]
    rows += [("a a a a a a b a a a " * 20, "en"), ("New York City hall. " * 40 + "new  york\tcity. " * 5 + "york city. " * 3, "en"), ("naïve Über ñandú " * 50, "de"), ("ÜBER über " * 40, "de")]
    rows += [(None, "en"), ("", None), (" \t\n.,", "fr"), ("one", "fr"), ("x" * 50_000 + " y " + "x" * 50_000, "fr"), ("same words here " * 40, "und"), ("same words here " * 40, None), (None, None)]
    return rows + [rows[3], rows[60]]


@pytest.mark.parametrize("filter_bits", [64, 1 << 28])
def test_collocations_equal_plain_counts(spark, filter_bits):
    rows = texts()
    docs = spark.createDataFrame([(i, *r, 1, "p", 2, 3) for i, r in enumerate(rows)], DOCS).repartition(3)
    found = sorted(tuple(r) for r in collocations.collocations(docs, filter_bits=filter_bits).collect())
    assert found == plain(rows) and {r[0] for r in found} == {"en", "de", "und"}
    few = collocations.collocations(docs, top=3, least=5, filter_bits=filter_bits).collect()
    assert sorted(map(tuple, few)) == plain(rows, 5, 3)


def test_parents_bring_the_counts_of_all_parts(spark):
    docs = spark.createDataFrame([("a b c d. a b c. b c d! c d; a b" + "\n" * (i % 2), "en") for i in range(30)], "text string, lang string")
    levels, totals = collocations.frequent(docs)
    assert totals.collect()[0].n == 30 * 14
    four = levels[3].collect()
    assert [(r.phrase, r.last, r.f, r.pre, r.suf) for r in four] == [("a b c d", "d", 30, [90, 90, 60, 30], [90, 90, 60, 30])]
    assert {four[0].left, four[0].right} == {r.id for r in levels[2].collect()}
    # a phrase is dropped for a longer one of at least 80 percent of its count
    assert {r.phrase for r in collocations.candidates(levels).collect()} == {"a b", "b c", "c d", "a b c", "b c d", "a b c d"}
    most = spark.createDataFrame([("x y z. " * 4 + "x y.", "en")] * 30, "text string, lang string")
    assert {r.phrase for r in collocations.candidates(collocations.frequent(most)[0]).collect()} == {"x y z"}


def test_scores_are_exact_beyond_64_bits(spark):
    big = 4_000_000_000_000_000
    level = spark.createDataFrame([("en", 1, 2, 3, big + 1, "a b", [big + 2, big + 1], [big + 7, big + 1])], "lang string, id long, left long, right long, f long, phrase string, pre array<long>, suf array<long>")
    row = collocations.candidates([None, level]).first()
    assert row.score == 2000000 * (big + 1) // (2 * big + 9) and (row.l, row.r, row.cut) == (big + 2, big + 7, 1)


def test_filter_has_every_id(spark):
    ids = np.random.default_rng(2).integers(-(1 << 62), 1 << 62, 5000)
    frame = spark.createDataFrame([(int(i),) for i in ids], "id long")
    for bits in (256, 1 << 12, 1 << 28):
        assert collocations.passes(collocations.bloom(frame, bits), ids.view(np.uint64)).all()
    other = np.random.default_rng(3).integers(-(1 << 62), 1 << 62, 50_000).view(np.uint64)
    assert collocations.passes(collocations.bloom(frame, 1 << 28), other).mean() < 0.01


def test_collocations_of_empty_tables(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(none).isEmpty()
    assert collocations.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).isEmpty()
    only = collocations.collocations(spark.createDataFrame([("to be " * 40,)], "text string")).collect()
    assert [(r.lang, r.rank, r.phrase, r.a, r.n) for r in only] == [("und", 1, "to be to be", 39, 80), ("und", 2, "be to be to", 38, 80)]
