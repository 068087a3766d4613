"""The one-pass matcher against running every pattern."""

from __future__ import annotations

import random
import re

import pytest

from siltstone.functions import patterns as P
from siltstone.operators import links as L

PIECES = [
    "https://www.youtube.com/watch?v=", "http://youtube.com/embed/", "https://youtu.be/", "YOUTUBE.COM/", "Youtu.be", "https://m.youtube.com/watch?v=", "abcDEF_-123", "aaaaaaaaaaa", "&list=PL", "?v=", "&v=", "v=", "V=", "/v/", "embed/v/", "shorts/", '"video_id": "', 'data-video-id="', '<meta itemprop="videoId" content="', '">', '"',
    "attribution_link?a=", "google.com/url?q=youtube", "feature=player_embedded", "android-app://com.google.android.youtube/http/www.youtube.com/watch?v=", "https://studio.youtube.com/video/", "/edit", " ", "\n", "<title>A title - YouTube</title>", "<h1>x</h1>", '"title": "Some name"', "Привет", "x" * 60, "y" * 150, "\x00\xff",
]


def plain_scan(data: bytes, dedup: bool):
    """Every pattern on every window, by definition."""
    ids = re.compile(P.ID[1:-1].encode())
    titles = [re.compile(p.encode()) for p in P.TITLE_PATTERNS]
    seen, out = set(), []
    for needle in re.finditer(P.NEEDLES.encode(), data, re.I):
        start = max(0, needle.start() - P.BEFORE)
        window = data[start : min(len(data), needle.end() + P.AFTER)]
        for idx, (name, pattern, _) in enumerate(P.LINK_PATTERNS):
            for m in re.finditer(pattern.encode(), window):
                key = m[1] if dedup else (start + m.start(), idx)
                if ids.fullmatch(m[1]) and key not in seen:
                    seen.add(key)
                    out.append((m[0], m[1], start + m.start(), name, any(t.search(data[max(0, start + m.start() - P.TITLE_CONTEXT) : start + m.start() + P.TITLE_CONTEXT]) for t in titles)))
    return out


@pytest.mark.parametrize("dedup", [True, False])
def test_scan_equals_all_patterns_on_all_windows(dedup):
    rng = random.Random(7)
    total = 0
    for _ in range(300):
        data = "".join(rng.choice(PIECES) for _ in range(rng.randrange(60))).encode("utf-8" if rng.random() < 0.8 else "utf-16-le")
        got = [(u.encode(), i.encode(), at, name) for u, i, _, at, name, _, _ in L.matcher().scan(data, 0, dedup)]
        expected = plain_scan(data, dedup)
        assert got == [(u.decode("utf-8", "replace").encode(), i, at, name) for u, i, at, name, _ in expected]
        total += len(got)
    assert total > 150


def test_whole_texts_equal_all_patterns(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(50))) for _ in range(200)] + [None, ""]
    expected = [(k, i, name, m[0], m[1], p / 10) for k, t in enumerate(texts) for i, (name, pattern, p) in enumerate(P.LINK_PATTERNS) for m in re.finditer(pattern, t or "", re.A)]
    rows = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "k long, t string, url int")
    assert sorted(map(tuple, L.matches(rows, "t", "k").collect())) == sorted(expected) and len(expected) > 200


def test_needed_texts():
    for _, pattern, _ in P.LINK_PATTERNS:
        assert L.needed(pattern) in pattern.replace("\\", "") and len(L.needed(pattern)) > 1
    assert {p: L.needed(p) for p in (r"a+bc*d", r"(?:abc)?de", r"ab|cde", r"x{2}yz?w", r"[abc]+\.\w", r"(abc)", "")} == {r"a+bc*d": "a", r"(?:abc)?de": "de", r"ab|cde": "", r"x{2}yz?w": "y", r"[abc]+\.\w": ".", r"(abc)": "", "": ""}


def test_finder_of_patterns_that_need_nothing():
    found = L.Finder(["ab", "", "b", "ab"])
    assert sorted(found.places("xabb")) == [(1, "ab"), (2, "b"), (3, "b")]
    assert found.patterns(["ab"]) == [0, 1, 3] and found.patterns([]) == [1]
