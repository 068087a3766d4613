"""The filter audit against plain sums over documents and orders."""

from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa

from siltstone.llm import common, filter_audit

DOCS = "doc_id long, text string, source string, mask string, key string, first long, part long, n long"
LABELS = "doc_id long, quality int, toxic int, good string"


def plain(docs, labels):
    """Rows of the audit, worked out document by document and order by order."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = Counter()
    for i, text, part in docs:
        text, ws = text or "", re.findall(r"[^\x20\x09-\x0D]+", text or "")
        same = [j for j, other, _ in docs if (other or "") == text and j is not None]
        bad = {
            "A": len(ws) < 200,
            "B": 100 * len(set(ws)) < 50 * len(ws),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and bool(same) and min(same) < i,
        }
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                key, here = (part or "", order, step), bad[f] and not gone
                out[*key, "removed"] += here
                out[*key, "redundant"] += bad[f] and gone
                out[*key, "unique_fails"] += bad[f] and sum(bad.values()) == 1
                out[*key, "good_lost"] += here and i in good
                out[*key, "toxic_lost"] += here and i in toxic
                gone |= bad[f]
                out[*key, "kept"] += not gone
    shapley = Counter()
    for (part, order, step, what), n in list(out.items()):
        if what == "removed":
            shapley[part, order[step - 1]] += n
    for part, order, step, what in list(out):
        if what == "removed":
            out[part, order, step, "shapley"] = shapley[part, order[step - 1]]
    return out


def found(rows):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r.part, r.filter_order, r.step, k): r[k] for r in rows for k in names}


def texts():
    prose = lambda n, k, word="w": " ".join(f"{word}{i % k}" for i in range(n))
    return [
        None, "", " \t\n ", "a", prose(199, 199), prose(200, 200), prose(200, 99), prose(200, 100), prose(300, 300, "W"), prose(220, 220) + " #", "Ünï çödé " * 80, "A" * 3 + "b" * 147, "A" * 3 + "b" * 146,
        prose(40_000, 40_000), prose(40_000, 40_000), prose(200, 200), "", None, "a", "x\x0bx x\x0cx", prose(199, 199), "|", "|", "UPPER lower " * 150,
    ]


def test_audit_equals_plain_sums(spark):
    docs = [(i * 7 % 24, t, [None, "", "s1", "s2"][i % 4]) for i, t in enumerate(texts())]
    docs += [(None, "a", "s1"), (None, "a", None), (3, "a", "s2"), (3, "a", "s2"), docs[5], (None, None, None)]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 24, 2)] + [(1, None, 1), (1, 1, None), (1, 1, 1), (None, 1, 1), (999, 1, 1)]
    frame = spark.createDataFrame([(*d, "m", "k", 1, 2, 3) for d in docs], DOCS.replace("part long", "part_ long"))
    frame = frame.withColumnRenamed("part_", "part").repartition(3)
    rows = filter_audit.filter_audit(frame, spark.createDataFrame([(*x, "g") for x in labels], LABELS)).collect()
    assert len(rows) == 600 * 3
    assert found(rows) == plain(docs, labels)


def test_hot_texts_and_labels_are_joined_by_shuffle(spark, monkeypatch):
    from siltstone.operators import joins

    join = joins.dealt_join
    monkeypatch.setattr(filter_audit, "dealt_join", lambda *a, **k: join(*a, **k, rows=-1))
    docs = [(i, "the same text" if i % 3 else f"text {i} " * 90, f"s{i % 2}") for i in range(1200)] + [(7, f"other {i}", "s0") for i in range(600)]
    labels = [(i, 1, i % 2) for i in range(900)]
    rows = filter_audit.filter_audit(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert found(rows) == plain_fast(docs, labels)


def plain_fast(docs, labels):
    """plain(), with the texts seen once: only texts and ids matter there."""
    least = {}
    for i, t, _ in docs:
        least[t] = min(i, least.get(t, i))
    kinds = Counter()
    marks = {i: (q, t) for i, q, t in labels}
    for i, t, part in docs:
        kinds[t if len(t) > 200 else "short", i > least[t], part, marks.get(i, (0, 0))] += 1
    total = Counter()
    for (t, later, part, (q, x)), n in kinds.items():
        text = t if t != "short" else "some text"
        sample = [(1, text, part), (2, text, part)] if later else [(2, text, part)]
        one = plain(sample, [(2, q, x)])
        if later:
            one.subtract(plain(sample[:1], []))
        for k, v in one.items():
            total[k] += v * n
    return total


def test_equal_hashes_of_other_words_are_told_apart():
    text = ["aa bb aa cc", "dd dd ee", "", "x yy x"]
    raw, at = common.text_bytes(pa.array(text))
    word, starts, ends, row_at = common.words(raw, at, common.EXACT)
    expected = [len(set(t.split())) for t in text]
    assert filter_audit.distinct_words(raw, word, starts, ends, row_at).tolist() == expected
    assert filter_audit.distinct_words(raw, np.zeros_like(word), starts, ends, row_at).tolist() == expected
    assert filter_audit.distinct_words(raw, word % np.uint64(2), starts, ends, row_at).tolist() == expected


def test_audit_of_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(docs, labels).isEmpty()
    one = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    assert filter_audit.filter_audit(one, labels).count() == 600
    assert filter_audit.filter_audit(one.drop("source", "doc_id"), labels.drop("quality")).where("part = '' and removed > 0").count() == 120
