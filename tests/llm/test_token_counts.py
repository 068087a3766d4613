import random
import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siltstone.llm.token_counts import SHORT, PrefixCounter, op8_token_counts, prefix_counts, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "   ", "a   b", "don't we'll they're I'd'x", "don'r 'l 'll '", "\n\n  \t x", "été ÉÀ ñandú 東京 Привет", "12345 1,000.50", "!!! ***x*** %%%", "<|endoftext|> a <|endoftext|><|endoftext|>b  ",
    "a <|endoftext|>  b", "   x​", "👩‍👩‍👧 ok", "x" * 300, " " * 70 + "z", "\x1c\x1d\x85 q", "aaaa bbbb ththth thtionthed",
]


@pytest.fixture(scope="module")
def both():
    return PrefixCounter(PATH), Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(5)
    letters = "abct hnéñ'  \n!%1東"
    return ODD + ["..<|endoftext|>", "a  <|endoftext|>'s", "<|endoftext|>s", "''s 'll<|endoftext|>", "".join(rng.choice("abcdefghij") for _ in range(150))] + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(200)]


def test_totals_and_prefixes_equal_the_library(both):
    mine, library = both
    for text in texts():
        expected = [len(library.encode(text[:i], add_special_tokens=False)) for i in range(len(text) + 1)]
        assert mine.total(text) == expected[-1], text
        assert mine.prefixes(text) == expected, text  # a prefix that ends inside a special string is ordinary text there


def test_longest_prefix(both):
    mine, _ = both
    for text in texts():
        counts = mine.prefixes(text)
        for budget in (0, 1, 2, 5, 17):
            assert mine.longest_prefix(text, budget) == max(i for i, c in enumerate(counts) if c <= budget), (text, budget)


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "hello world " * 400, "x"), (3, "hello world " * 400, "x"), (None, "a", "y")], "doc_id long, text string, n_tokens string")
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, PATH).collect()}
    assert got == {(1, 0, 0, False), (2, 0, 0, False), (3, 4800, 801, True), (None, 1, 1, False)}
    assert token_counts(docs, PATH).count() == 5
    assert token_counts(docs.limit(0), PATH).count() == 0
    assert [r.counts[-1] for r in prefix_counts(docs.where("doc_id = 2"), PATH).collect()] == [0]


def test_unbroken_text(both):
    mine, library = both
    rng = random.Random(8)
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", "é東ab", "-", " "):
        text = "".join(rng.choice(alphabet) for _ in range(200_000))
        began = time.process_time()
        assert mine.total(text) == len(library.encode(text, add_special_tokens=False))
        fit = mine.longest_prefix(text, 5000)
        assert time.process_time() - began < 5 and len(library.encode(text[:fit], add_special_tokens=False)) <= 5000
    assert all(len(p) <= SHORT for p in mine.tables)


def test_query_equals_the_library(spark, both, tmp_path):
    """op8's rows over a whole table of odd texts, repeated rows and null ids."""
    rows = [(i, t, "x") for i, t in enumerate([*texts(), None, "word " * 3000])] + [(3, ODD[3], "x"), (None, "a b", "y")]
    spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in op8_token_counts(spark, str(tmp_path)).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()]
    count = [len(both[1].encode(t or "", add_special_tokens=False)) for _, t, _ in rows]
    assert sorted(got, key=str) == sorted([(i, len((t or "").encode()), n, n > 512) for (i, t, _), n in zip(rows, count, strict=True)], key=str)
