"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text.

Folding: compatibility forms (NFKC), lower case, letters of other scripts that look like Latin ones, digits and signs
that stand for letters inside or at the edge of a word (`1d10t`, `$tupid`; where a sign may be i or l, the word with l is
added after the text), letters repeated three times and more, words spelt letter by letter (`l.o.s.e.r`), invisible
characters. Words are runs of letters and digits.

The lexicon is learned from labelled rows: whole words, beginnings of words and word pairs. An entry must be in more toxic
rows than chance allows: its likelihood ratio against independence beats 2 ln of the number of forms tried. Its weight is
its log odds. Exception phrases have no weight: words and pairs that hold an entry but are in clean rows relatively more
often, and those given as `exceptions`. Of matches that begin at one place the longest counts, and matches do not overlap,
so an exception phrase covers the entry in it. A text's heaviest entry, and the sum of its weights by its length in words,
give the score through a logistic curve fitted on the same rows.

What is learned comes from at most about `sample` labelled texts, drawn by a hash of the text (the documented bound: all
of them where there are no more; equal ones count once), and is at most `most_entries` entries and as many exceptions; this model alone is
sent to the executors. Every row is scored on its whole text, in one pass without a shuffle. Rows whose crc32(doc_id) mod 5
is 0 are never learned from. Only text is an input of a score.

Edge cases: null and empty texts have the score of a text without hits. A null id is not held out and has no label. Of
several labels of an id the highest counts; null labels count as none. Repeated rows each get their (equal) score. Without
labels of both kinds nothing can be learned: the score is the smoothed share of toxic rows. Missing columns count as null,
extra ones are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import common

# ---------------------------------------------------------------- folding

#: Letters that look like the Latin letters under them, and what stands for a letter in a word.
ALIKE = "авекмнорстухіјѕԁһԛԝαβγεικνορτυχω"
LATIN = "abekmhopctyxijsdhqwabyeikvoptuxw"
SIGNS = "0134578@$!|+"
LETTERS = "oieastbasiit"
#: The signs that may also stand for l.
TALL = "1!|"
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_FOLD = dict(zip(ALIKE + "ı", LATIN + "i")) | dict.fromkeys(INVISIBLE, "")
_SIGN = str.maketrans(SIGNS, LETTERS)
_TALL = str.maketrans(TALL, "l" * len(TALL))
#: Signs that may begin or end a word; others stand for letters only between letters.
_FIRST, _LAST = set("013457@$"), set("013457")
# Each pattern begins with a set of characters, which is what the search for it looks for.
_ODD = re.compile(f"[{''.join(_FOLD)}]")
_SIGNED = re.compile(f"[{re.escape(SIGNS)}]+")
_A = r"[^\W\d_]"
_MAYBE_SPELT = re.compile(rf"[ .*_-]{_A}[ .*_-]{_A}[ .*_-]")
_SPELT = re.compile(rf"(?<![\w.]){_A}([ .*_-]){_A}(?:\1{_A}){{2,}}(?!\w)")
_LONG = re.compile(r"([a-z])\1\1+")
_WORD = re.compile(r"\w+")


def _letters(table: dict[int, int]):
    """What stands for a run of signs: letters if it is inside a word, or short and at the edge of one."""

    def of(m: re.Match) -> str:
        run, text, begin, end = m[0], m.string, m.start(), m.end()
        before, after = text[begin - 1 : begin], text[end : end + 1]
        if before.isalpha() and after.isalpha():
            return run.translate(table)
        first = after.isalpha() and not before.isalnum() and before != "_" and _FIRST.issuperset(run)
        last = before.isalpha() and not after.isalnum() and after != "_" and _LAST.issuperset(run)
        return run.translate(table) if (first or last) and len(run) <= 2 else run

    return of


_READ, _READ_TALL = _letters(_SIGN), _letters(_SIGN | _TALL)


def _words(text: str) -> list[str]:
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if ((raw[2:] == raw[:-2]) & (raw[1:-1] == raw[2:]) & (raw[2:] >= 97) & (raw[2:] <= 122)).any():
        text = _LONG.sub(r"\1", text)
    return _WORD.findall(text.replace("_", " "))


def fold(text: str) -> list[str]:
    """The folded words of a text."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if not text.isascii() and _ODD.search(text):
        text = _ODD.sub(lambda m: _FOLD[m[0]], text)
    if _MAYBE_SPELT.search(text):
        text = _SPELT.sub(lambda m: m[0][::2], text)
    other = text
    if _SIGNED.search(text):
        other = _SIGNED.sub(_READ_TALL, text)
        text = _SIGNED.sub(_READ, text)
    words = _words(text)
    return words if other == text else words + [b for a, b in zip(words, _words(other)) if a != b]


def joined(words: list[str]) -> str:
    """Words as matched: each has blanks of its own, which an entry may hold as the word's ends."""
    return f" {'  '.join(words)} "


def forms(words: list[str], short: int = 3, long: int = 8) -> set[str]:
    """What the lexicon may hold of a text: words, their beginnings, word pairs."""
    single = set(words)
    out = {f" {w} " for w in single}
    for k in range(short, long + 1):
        out.update([f" {w[:k]}" for w in single if len(w) > k])
    out.update([f" {a}  {b} " for a, b in zip(words, words[1:])])
    return out


# ---------------------------------------------------------------- the model


@dataclass
class Model:
    """Weights by entry (0: an exception), and the curve: the score of a text is 1 / (1 + exp(-curve . features))."""

    weights: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    _found: ahocorasick.Automaton | None = None

    def automaton(self) -> ahocorasick.Automaton:
        if self._found is None:
            self._found = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                self._found.add_word(entry, (len(entry), weight))
            self._found.make_automaton()
        return self._found

    def __getstate__(self):
        return {"weights": self.weights, "curve": self.curve, "_found": None}

    def hits(self, text: str) -> Iterator[tuple[int, int, float]]:
        """(begin, end, weight) of the matches in joined text; those of exceptions weigh 0."""
        if self.weights:
            for last, (size, weight) in self.automaton().iter_long(text):
                yield last + 1 - size, last + 1, weight

    def features(self, words: list[str]) -> tuple[float, float]:
        """The heaviest entry of a text, and the logarithm of its weight by length."""
        found = [w for _, (_, w) in self.automaton().iter_long(joined(words))] if self.weights else []
        return max(found, default=0.0), math.log1p(100 * math.fsum(found) / (len(words) + 10))

    def score(self, text: str | None) -> float:
        a, b = self.features(fold(text or ""))
        x = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return round(1 / (1 + math.exp(-max(-40.0, min(40.0, x)))), 9)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _counted(of):
    """A function for mapInArrow that sums (form, toxic, clean) rows over each batch; of(words): the forms of a text."""

    def run(batches):
        for batch in batches:
            toxic, clean = Counter(), Counter()
            for text, label in zip(batch.column("text"), batch.column("toxic").to_pylist()):
                (toxic if label else clean).update(of(fold(text.as_py())))
            every = list(toxic.keys() | clean.keys())
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *(pa.array([c[x] for x in every], pa.int64()) for c in (toxic, clean))], names=["form", "toxic", "clean"])

    return run


def _counts(rows: DataFrame, of) -> DataFrame:
    found = rows.mapInArrow(_counted(of), "form string, toxic long, clean long")
    return found.groupBy("form").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def evidence(t: int, n: int, toxic: int, clean: int) -> float:
    """Likelihood ratio (G squared) of a form in t of the toxic and n of the clean rows against independence."""
    both, all_ = t + n, toxic + clean
    cells = ((t, toxic * both), (n, clean * both), (toxic - t, toxic * (all_ - both)), (clean - n, clean * (all_ - both)))
    return 2 * sum(x * math.log(x * all_ / e) for x, e in cells if x)


def odds(t: int, n: int, toxic: int, clean: int) -> float:
    return math.log((t + 0.5) / (toxic + 1)) - math.log((n + 0.5) / (clean + 1))


def parts(form: str) -> list[str]:
    """The shorter forms in a form: the words of a pair, and the beginnings of its words."""
    words = form.split()
    whole = [f" {w} " for w in words] if len(words) > 1 else []
    return whole + [f" {w[:k]}" for w in words for k in range(1, len(w) + 1) if f" {w[:k]}" != form]


def pruned(forms: list[tuple[str, int, float, float]]) -> dict[str, float]:
    """Weights by form, of (form, toxic rows, evidence, log odds): the best first, without those that a better one stands
    for. A form goes if a part of it tells as much, or if a longer one has nearly all its toxic rows."""
    kept, longer = {}, {}
    for form, t, _, w in sorted(forms, key=lambda x: (-x[2], -len(x[0]), x[0])):
        inside = parts(form)
        if longer.get(form, 0) < 0.95 * t and not any(kept.get(x, -math.inf) >= w - 0.7 for x in inside):
            kept[form] = w
            for x in inside:
                longer[x] = max(longer.get(x, 0), t)
    return kept


def _around(model: Model):
    """Words that hold an entry and the pairs with the word before and after: what may be an exception."""

    def of(words: list[str]) -> set[str]:
        text, out = joined(words), set()
        at = np.cumsum([0] + [len(w) + 2 for w in words])
        for begin, end, _ in model.hits(text):
            i, j = int(np.searchsorted(at, begin, side="right")) - 1, int(np.searchsorted(at, end, side="left"))
            for lo, hi in ((i, j), (max(i - 1, 0), j), (i, min(j + 1, len(words)))):
                out.add(joined(words[lo:hi]))
        return out - model.weights.keys()

    return of


def _grid(model: Model, step: float):
    def run(batches):
        for batch in batches:
            found = [model.features(fold(t.as_py())) for t in batch.column("text")]
            cells = np.rint(np.array(found).reshape(-1, 2) / step).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cells[:, 0]), pa.array(cells[:, 1]), batch.column("toxic")], names=["a", "b", "toxic"])

    return run


def fitted(cells: np.ndarray, step: float, ridge: float = 0.1) -> tuple[float, float, float]:
    """The logistic curve through cells (a, b, toxic rows, clean rows), by Newton's method."""
    x = np.column_stack((np.ones(len(cells)), cells[:, :2] * step))
    toxic, n, w = cells[:, 2], cells[:, 2] + cells[:, 3], np.zeros(3)
    keep = np.diag([1e-6, ridge, ridge])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        move = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + keep, x.T @ (toxic - n * p) - keep @ w)
        w = w + move * min(1.0, 4 / max(np.abs(move).max(), 1e-9))
        if np.abs(move).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def labelled(docs: DataFrame, labels: DataFrame, sample: int, scratch: common.Scratch) -> DataFrame:
    """(text, toxic) of about `sample` labelled texts at most, of rows that are not held out. Equal texts stand once, toxic if one is."""
    doc_id, text = common.column(docs, "doc_id", "long").alias("doc_id"), F.coalesce(common.column(docs, "text", "string"), F.lit("")).alias("text")
    ids = labels.select(common.column(labels, "doc_id", "long").alias("doc_id"), common.column(labels, "toxic", "int").alias("toxic")).dropna()
    ids = ids.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    rows = docs.select(doc_id, text).withColumn("fp", F.xxhash64("text")).where(F.col("doc_id").isNotNull())
    keys = rows.select("doc_id", "fp").distinct().join(ids, "doc_id")
    keys = scratch.save(keys.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")))
    n, size = keys.count(), 1 << 30
    if n > sample:
        keys = scratch.save(keys.where(F.pmod(F.xxhash64("fp"), F.lit(size)) < int(size * (sample / n))))
    return scratch.save(rows.join(F.broadcast(keys), ["doc_id", "fp"]).dropDuplicates(["fp"]).select("text", "toxic"))


def learn(docs: DataFrame, labels: DataFrame, sample: int = 40_000, most_entries: int = 20_000, exceptions: Iterable[str] = (), step: float = 0.125) -> Model:
    """The model of docs (doc_id, text) and labels (doc_id, toxic)."""
    scratch = common.Scratch(docs.sparkSession, "toxicity")
    rows = labelled(docs, labels, sample, scratch)
    n_all, toxic = (int(x or 0) for x in rows.agg(F.count("*"), F.sum("toxic")).first())
    clean = n_all - toxic
    model = Model(curve=(math.log((toxic + 0.5) / (clean + 0.5)), 0.0, 0.0))
    if not toxic or not clean:
        return model
    # forms that only clean rows have cannot be entries, so the toxic rows name the candidates
    tried = scratch.save(_counts(rows.where("toxic = 1"), forms).select("form", "toxic"))
    least = 2 * math.log(max(tried.count(), 2))
    enough = next((t for t in range(2, toxic + 1) if evidence(t, 0, toxic, clean) >= least), toxic + 1)
    named = {r.form: r.toxic for r in tried.where(F.col("toxic") >= enough).orderBy(F.desc("toxic"), "form").limit(10 * most_entries).collect()}
    known = docs.sparkSession.sparkContext.broadcast(frozenset(named))
    held = {r.form: r.clean for r in _counts(rows.where("toxic = 0"), lambda words: forms(words) & known.value).collect()}
    judged = [(x, t, evidence(t, n, toxic, clean), odds(t, n, toxic, clean)) for x, t in named.items() for n in [held.get(x, 0)]]
    model.weights = dict(list(pruned([x for x in judged if x[3] > 0 and x[2] >= least]).items())[:most_entries])
    around = _counts(rows, _around(model)).where("clean >= 3").where((F.col("toxic") + 0.5) * (clean + 1) < (F.col("clean") + 0.5) * (toxic + 1))
    model.weights |= {r.form: 0.0 for r in around.orderBy(F.desc("clean"), "form").limit(most_entries).collect()}
    model.weights |= {joined(fold(x)): 0.0 for x in exceptions if fold(x)}
    model._found = None
    cells = rows.mapInArrow(_grid(model, step), "a long, b long, toxic int").groupBy("a", "b").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    model.curve = fitted(np.array(sorted(tuple(r) for r in cells.collect()), float), step)
    return model


def _scored(model: Model):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([model.score(t.as_py()) for t in batch.column("text")], pa.float64())], names=["doc_id", "held_out", "score"])

    return run


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(common.column(docs, "doc_id", "long").alias("doc_id"), held_out(common.column(docs, "doc_id", "long")).alias("held_out"), common.column(docs, "text", "string").alias("text"))
    found = rows.mapInArrow(lambda batches: _scored(shared.value)(batches), "doc_id long, held_out boolean, score double")
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
