"""Link extraction from binary chunks and its two-level deduplication."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from functools import reduce

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import octets as O
from siltstone.functions import patterns as P

LINK = "url string, video_id string, title string, offset long, pattern_name string, pattern_idx int, confidence double"
OUT = f"path string, chunk_id long, chunk_seq long, match_seq long, {LINK}, error string"


def needed(pattern: str) -> str:
    """The longest text that every match of a pattern holds: plain characters in a row, outside groups and sets, that cannot
    be left out. Empty if there is none."""
    tokens = re.findall(r"\\.|\[(?:\\.|[^\]\\])*\]|\{[^}]*\}|\(\?:|.", pattern, re.S)
    runs, depth = [""], 0
    for token, then in zip(tokens, [*tokens[1:], ""]):
        depth += (token in ("(", "(?:")) - (token == ")")
        if token == "|" and not depth:
            return ""
        plain = token[-1] if (len(token) == 1 and token not in "()[]{}*+?|^$.") or (token[0] == "\\" and not token[1].isalnum()) else ""
        if plain and not depth and then[:1] not in ("?", "*", "{"):
            runs[-1] += plain
            if then != "+":
                continue
        runs.append("")
    return max(runs, key=len)


class Finder:
    """Which of some texts occur, in one pass over the data (Aho-Corasick)."""

    def __init__(self, texts: list[str]):
        """texts: one for each pattern, in their order; an empty one always counts as there."""
        self.always = {i for i, t in enumerate(texts) if not t}
        self.owners: dict[str, list[int]] = {}
        for i, t in enumerate(texts):
            if t:
                self.owners.setdefault(t, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for t in self.owners:
            self.automaton.add_word(t, t)
        self.automaton.make_automaton()

    def places(self, data: str) -> list[tuple[int, str]]:
        """(begin, text) of all occurrences, overlapping ones too, by where they end."""
        return [(end + 1 - len(t), t) for end, t in self.automaton.iter(data)]

    def patterns(self, texts) -> list[int]:
        """The patterns to run where these texts occur."""
        return sorted(self.always.union(*(self.owners[t] for t in texts)))


class Matcher:
    """The catalogue compiled once per Python worker. A pattern is run only where the text that it needs occurs; these texts
    and the needles are found in one pass over the data."""

    def __init__(self):
        self.links = [(name, re.compile(p.encode()), priority / 10) for name, p, priority in P.LINK_PATTERNS]
        self.texts = [(name, re.compile(p, re.A), priority / 10) for name, p, priority in P.LINK_PATTERNS]
        self.titles = [(needed(p).encode(), re.compile(p.encode())) for p in P.TITLE_PATTERNS]
        self.ids = re.compile(P.ID[1:-1].encode())
        self.needles = {re.sub(r"\\(.)", r"\1", n) for n in P.NEEDLES.split("|")}
        needs = [needed(p) for _, p, _ in P.LINK_PATTERNS]
        self.exact = Finder(needs)
        # needles count in any case, so chunks are searched in lower case; a needle that no pattern needs has no pattern
        self.lower = Finder([n.lower() for n in needs])
        for n in self.needles - self.lower.owners.keys():
            self.lower.owners[n] = []
            self.lower.automaton.add_word(n, n)
        self.lower.automaton.make_automaton()

    def title(self, data: bytes, at: int) -> str | None:
        context = data[max(0, at - P.TITLE_CONTEXT) : at + P.TITLE_CONTEXT]
        for need, pattern in self.titles:
            m = pattern.search(context) if need in context else None
            if m:
                text = html.unescape(m[1].decode("utf-8", "replace")).strip()
                if 3 < len(text.encode()) < 200 and "youtube" not in text.lower():
                    return text
        return None

    def windows(self, data: bytes):
        """(begin, end, texts in it) of the window around each needle, in order; needles do not overlap."""
        found = sorted(self.lower.places(data.lower().decode("latin-1")))
        begins, passed = [at for at, _ in found], 0
        for at, text in found:
            if text in self.needles and at >= passed:
                passed = at + len(text)
                lo, hi = max(0, at - P.BEFORE), min(len(data), passed + P.AFTER)
                inside = found[bisect_left(begins, lo) : bisect_left(begins, hi)]
                yield lo, hi, {t for b, t in inside if b + len(t) <= hi}

    def scan(self, data: bytes, base: int, dedup: bool, seen: set | None = None):
        """Links of one chunk in the order found: needle, pattern, match. Without dedup a match that several windows
        show is given once, by place and pattern. seen: ids found before, if they count too."""
        seen = set() if seen is None else seen
        for start, end, texts in self.windows(data):
            window = data[start:end]
            for idx in self.lower.patterns(texts):
                name, pattern, confidence = self.links[idx]
                for m in pattern.finditer(window):
                    if not self.ids.fullmatch(m[1]):
                        continue
                    key = m[1] if dedup else (start + m.start(), idx)
                    if key in seen:
                        continue
                    seen.add(key)
                    at = start + m.start()
                    yield m[0].decode("utf-8", "replace"), m[1].decode(), self.title(data, at), base + at, name, idx, confidence

    def whole(self, text: str):
        """(pattern_idx, pattern_name, url, video_id, confidence) of all matches in a text, by pattern, then place."""
        texts = {t for _, t in self.exact.automaton.iter(text)}
        for idx in self.exact.patterns(texts) if texts or self.exact.always else ():
            name, pattern, confidence = self.texts[idx]
            for m in pattern.finditer(text):
                yield idx, name, m[0], m[1], confidence


_MATCHER: list[Matcher] = []


def matcher() -> Matcher:
    if not _MATCHER:
        _MATCHER.append(Matcher())
    return _MATCHER[0]


def _scan(dedup: bool):
    names = [f.split()[0] for f in OUT.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for r in zip(*(batch.column(c).to_pylist() for c in ("path", "chunk_id", "chunk_seq", "offset", "data")), strict=True):
                path, chunk_id, seq, offset, data = r
                try:
                    found = list(matcher().scan(data or b"", offset, dedup))
                except Exception as e:  # one bad chunk must not end the scan: it gives an error row
                    rows.append((path, chunk_id, seq, 0, *(None,) * 7, f"{type(e).__name__}: {e}"))
                    continue
                rows += [(path, chunk_id, seq, i, *x, None) for i, x in enumerate(found)]
            if rows:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def extract(chunks: DataFrame, dedup: bool = True) -> DataFrame:
    """Links of chunks (path, chunk_id, chunk_seq, offset, data)."""
    return chunks.select("path", "chunk_id", "chunk_seq", "offset", "data").mapInArrow(_scan(dedup), OUT)


MATCH = "pattern_idx int, pattern_name string, url string, video_id string, confidence double"


def matches(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """All matches of all patterns in a text column: (keep, pattern_idx, pattern_name, url, video_id, confidence)."""
    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    kinds = {"pattern_idx": pa.int32(), "pattern_name": pa.string(), "url": pa.string(), "video_id": pa.string(), "confidence": pa.float64()}

    def run(batches):
        for batch in batches:
            # one text at a time: a batch's texts as Python strings are several times its size
            found = [(k, *m) for k, t in enumerate(batch.column(text)) if t.is_valid for m in matcher().whole(t.as_py())]
            if found:
                at, *columns = zip(*found)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in keep), *(pa.array(c, k) for c, k in zip(columns, kinds.values()))], names=[*keep, *kinds])

    return rows.select(*keep, text).mapInArrow(run, f"{kept}, {MATCH}")


def chunk_dedup(links: DataFrame) -> DataFrame:
    """First link of each id in each chunk, in order of finding."""
    first = W.partitionBy("path", "chunk_id", "video_id").orderBy("match_seq")
    return links.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def _rest(columns: list[str], keys: list[str]) -> list[str]:
    """Columns that decide between links of equal title, confidence and place, in a fixed order."""
    known = ("title", "confidence", "chunk_seq", "offset", "pattern_idx")
    return [c for c in (*known[2:], *sorted(set(columns) - set(known) - set(keys)), "title") if c in columns]


def best_links(links: DataFrame, *also: str) -> DataFrame:
    """The best link of each id (and `also`): with a title first, then confidence, then scan order; the other columns,
    nulls last, decide between equals. One aggregation with map-side combine: a hot id moves one row per task."""
    keys = [*also, "video_id"]
    rest = [c for c in links.columns if c not in keys]
    order = [F.col("title").isNull(), -F.col("confidence")] + [x for c in _rest(links.columns, keys) for x in (F.col(c).isNull(), F.col(c))]
    best = links.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*(x.alias(f"o{i}") for i, x in enumerate(order)))).alias("b"))
    return best.select(*keys, *(F.col(f"b.{c}") for c in rest)).select(*links.columns)


def best_of(rows: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """What best_links() keeps of a pandas table."""
    order = rows.assign(_untitled=rows["title"].isna(), _sure=-rows["confidence"])
    order = order.sort_values(["_untitled", "_sure", *_rest(list(rows.columns), keys)], na_position="last", kind="stable")
    return order.drop_duplicates(keys)[list(rows.columns)]


def at_least(links: DataFrame, confidence: float) -> DataFrame:
    return links.where(F.col("confidence") >= confidence) if confidence > 0 else links


def title_of(context: Column) -> Column:
    """First acceptable title of a text by the six patterns, references decoded by the caller where needed."""

    def one(pattern: str) -> Column:
        t = O.strip(F.regexp_extract(context, pattern, 1))
        return F.when((F.octet_length(t) > 3) & (F.octet_length(t) < 200) & ~F.lower(t).contains("youtube"), t)

    return reduce(lambda a, b: F.coalesce(a, b), (one(p) for p in P.TITLE_PATTERNS))
