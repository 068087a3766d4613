"""The toxicity lexicon: folding, matching, what it may learn from, and held-out accuracy."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import toxicity
from siltstone.llm.toxicity import Model, fold, joined

DOCS = "doc_id long, text string, lang string, source string, score double, toxic int, held_out boolean"
BAD = ("idiot", "scum", "loser", "clownish")


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def table(spark, n=900, seed=4, hide=False):
    """Documents whose toxic rows have one of BAD in twenty words; `scummy` is a clean word, `the clown` a clean pair."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(20, 200))]
        if toxic:
            for k in range(max(1, len(words) // 20)):
                w = rng.choice(BAD)
                words[rng.randrange(len(words))] = w.replace("i", "1").replace("o", "0") if hide and held(i) else w
        elif rng.random() < 0.5:
            words.insert(3, rng.choice(["scummy", "scummy", "see the losers list"]))
        docs.append((i, " ".join(words) + ".", "en", "s", 1.0, 1, True))
        labels.append((i, int(toxic), i))
    return spark.createDataFrame(docs, DOCS).repartition(3), labels


def frame(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, toxic int, score long")


@pytest.mark.parametrize(
    ("text", "words"),
    [
        ("You IDIOT!", ["you", "idiot"]),
        ("1d1ot", ["idiot", "ldlot"]),
        ("$tupid tra5h, m0r0n", ["stupid", "trash", "moron"]),
        ("c1own", ["ciown", "clown"]),
        ("l.o.s.e.r l-o-s-e-r l o s e r", ["loser", "loser", "loser"]),
        ("stuuuupid", ["stupid"]),
        ("іdіоt ѕсum", ["idiot", "scum"]),
        ("ｓｃｕｍ sc​um sc­um", ["scum", "scum", "scum"]),
        ("the$$$ cost: $40 in 2024, 100%!", ["the", "cost", "40", "in", "2024", "100"]),
        ("Straße œuvre é à", ["straße", "œuvre", "é", "à"]),
        ("", []),
        (" \n\t", []),
    ],
)
def test_folding(text, words):
    assert fold(text) == words


def test_longest_match_counts_and_exceptions_cover_entries():
    model = Model({" scum": 3.0, " scum ": 4.0, " scummy ": 0.0, " the  clown ": 0.0, " clown ": 2.0})
    weights = lambda text: [w for *_, w in model.hits(joined(fold(text)))]
    assert weights("scum scumbag scummy") == [4.0, 3.0, 0.0]
    assert weights("the clown, a clown") == [0.0, 2.0]
    assert model.features(fold("scum clown")) == (4.0, math.log1p(600 / 12))
    assert model.features([]) == (0.0, 0.0)


def test_learned_lexicon_on_held_out_rows(spark):
    docs, labels = table(spark, hide=True)
    model = toxicity.learn(docs, frame(spark, labels))
    assert {f" {w} " for w in BAD} == {x for x, w in model.weights.items() if w > 3}
    rows = toxicity.toxicity(docs, model).collect()
    assert sorted(r.doc_id for r in rows) == list(range(900)) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    truth = {i: t for i, t, _ in labels}
    tested = [r for r in rows if r.held_out]
    assert len(tested) > 100 and np.mean([r.predicted == truth[r.doc_id] for r in tested]) > 0.98
    assert [r.score for r in sorted(toxicity.toxicity(docs, toxicity.learn(docs, frame(spark, labels))).collect())] == [r.score for r in sorted(rows)]


def test_scores_do_not_depend_on_held_out_labels_nor_on_other_columns(spark):
    docs, labels = table(spark, 400)
    model = toxicity.learn(docs, frame(spark, labels))
    other = [(i, 1 - t if held(i) else t, s) for i, t, s in labels]
    moved = docs.withColumn("source", F.col("doc_id").cast("string")).withColumn("lang", F.lit(None).cast("string"))
    again = toxicity.learn(moved, frame(spark, other))
    assert (again.weights, again.curve) == (model.weights, model.curve)


def test_learned_exceptions(spark):
    rng = random.Random(6)
    # Every toxic row has a word that begins with vequ; clean rows have vequor, which is not insulting.
    rows = [(i, " ".join([f"w{rng.randrange(50)}" for _ in range(30)] + ([f"vequ{'aeiou'[rng.randrange(5)]}{'lmn'[rng.randrange(3)]}" for _ in range(3)] if i % 4 == 0 else ["vequor"] if i % 4 == 1 and i < 60 else [])), int(i % 4 == 0)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(docs.drop("toxic"), docs.drop("text"))
    assert model.weights[" vequ"] > 2 and model.weights[" vequor "] == 0
    assert model.score("w1 w2 vequas w3") > 0.5 > model.score("w1 w2 vequor w3")
    told = toxicity.learn(docs.drop("toxic"), docs.drop("text"), exceptions=["Vequas", "!"])
    assert told.score("w1 w2 vequas w3") < 0.5


def test_pruning():
    forms = [(" scu", 50, 90.0, 5.0), (" scum ", 50, 90.0, 5.0), (" of  scum ", 20, 40.0, 5.2), (" vequ", 60, 99.0, 6.0), (" vequa", 30, 50.0, 5.5), (" vequal ", 30, 55.0, 8.0), (" go  home ", 9, 30.0, 3.0), (" go ", 30, 20.0, 1.0)]
    assert set(toxicity.pruned(forms)) == {" scum ", " vequ", " vequal ", " go  home ", " go "}


def test_sample_is_bounded(spark):
    docs, labels = table(spark, 800)
    rows = toxicity.labelled(docs.unionAll(docs), frame(spark, labels), 200, toxicity.common.Scratch(spark, "test"))
    assert 140 < rows.count() < 260
    assert toxicity.labelled(docs.unionAll(docs), frame(spark, labels), 10_000, toxicity.common.Scratch(spark, "test")).count() == sum(not held(i) for i, *_ in labels)


def test_fitted_curve_is_the_likeliest():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 8, 300), rng.integers(0, 8, 300)
    p = 1 / (1 + np.exp(-(-3 + 0.5 * a + 0.2 * b)))
    toxic = rng.binomial(50, p)
    w = toxicity.fitted(np.column_stack((a, b, toxic, 50 - toxic)).astype(float), 1.0, ridge=1e-6)
    assert np.allclose(w, (-3, 0.5, 0.2), atol=0.1)
    assert np.isfinite(toxicity.fitted(np.array([[0, 0, 0, 9], [9, 9, 9, 0]], float), 1.0)).all()


def test_odd_tables(spark):
    docs, labels = table(spark, 300)
    odd = [(None, "idiot scum", None, None, None, None, None), (1, None, None, None, None, None, None), (2, "", "en", "s", 0.5, 0, False), (3, "x " * 60_000 + "idiot", "en", "s", 0.5, 0, False), (5, "a" * 300_000, None, "s", None, 0, None)]
    both = docs.unionAll(spark.createDataFrame(odd + odd[:2], DOCS))
    model = toxicity.learn(both, frame(spark, [*labels, (None, 1, 1), (1, None, 1), (4, 1, 1), (4, 0, 1)]))
    rows = toxicity.toxicity(both, model).collect()
    assert len(rows) == 307 and all(0 <= r.score <= 1 for r in rows)
    nulls = [r for r in rows if r.doc_id is None]
    assert len(nulls) == 2 and not nulls[0].held_out and nulls[0].score == nulls[1].score > 0.5
    assert {r.score for r in rows if r.doc_id == 2} >= {model.score("")} and model.score(None) == model.score("") < 0.5
    none = docs.where("false")
    for l in (frame(spark, []), frame(spark, [(i, 0, 1) for i in range(9)]), frame(spark, [(i, 1, 1) for i in range(9)]), frame(spark, labels).drop("toxic")):
        empty = toxicity.learn(docs, l)
        assert empty.weights == {} and 0 < empty.score("idiot") < 1
    assert toxicity.learn(none, frame(spark, labels)).score("idiot") == 0.5
    assert toxicity.toxicity(none, model).isEmpty()
    assert toxicity.toxicity(docs.drop("text"), model).where("score > 0.5").isEmpty()
