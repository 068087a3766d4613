"""Token counts by prefix dynamic programming over byte-level BPE.

The text is cut into the tokenizer's pre-tokens. Inside a pre-token, the encoding of each prefix ends in exactly one
token, and a sequence is the BPE encoding if and only if every neighbouring pair of it is (two tokens are a valid pair
if encoding their joined bytes gives the two back). So for each prefix one token and one count are stored:

    count[i] = count[i - len(last[i])] + 1

where last[i] is the one vocabulary token that ends at i and makes a valid pair with last[i - len(last[i])]. A pair is
checked by taking the two tokens apart again in the reverse order of their merges: it is valid if at no time a merge
across the border came before the next merge of its two neighbours. A text's
total is the sum over its pre-tokens; the count of any prefix is the sum of the whole pre-tokens before the cut plus the
stored count of the cut one, so truncation and budget questions are answered without encoding again.

The table of each distinct pre-token is stored once per worker: one byte a prefix, for pre-tokens of up to `SHORT` code
points, at most `CACHE` of them. Longer pre-tokens (unbroken texts) get a table of their own that is dropped after use;
time and memory are in proportion to their length. Memory does not grow with the input.

Edge cases: null and empty text have 0 bytes and 0 tokens. A very long text without a break is one pre-token with one
table. Strings of the tokenizer's special tokens inside a text are
one token each, as is the library's default. Nothing is truncated. Repeated rows stay; a null id stays null; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import common

CACHE = 1_000_000
#: A table of so many code points has counts under 256.
SHORT = 60
#: Bytes of a pre-token whose states are kept for others that begin alike; bytes up to which states are lists.
HEAD, LISTS = 5, 4096
#: The pre-token pattern of byte-level BPE vocabularies of this family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the
    others follow from code point 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tables(dict):
    """Prefix tables by pre-token; what is missing is worked out, and kept if it is short. When half of CACHE is full, these
    become the older half, of which only those met again are taken over, so that common pre-tokens stay."""

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, piece: str):
        out = self.older.pop(piece, None)
        if out is None:
            out = self.make(piece)
            if len(piece) > SHORT:
                return out
            out = bytes(out if isinstance(out, list) else out.tolist())
        if len(self) >= CACHE // 2:
            self.older = dict(self)
            self.clear()
        self[piece] = out
        return out


class PrefixCounter:
    """Counts tokens of a byte-level BPE file (tokenizers' JSON) at every prefix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        if model.get("type", "BPE") != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
        if spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError(f"{path}: a prefix space is not supported")
        special = {x["content"] for x in spec.get("added_tokens", [])}
        as_bytes = lambda s: bytes(letters[c] for c in s)
        # tokens are numbered by age: the 256 bytes, then the merges in their order
        self.ids = {bytes([b]): b for b in range(256)}
        self.left, self.right = list(range(256)), list(range(256))
        self.merge: dict[tuple[int, int], int] = {}
        for m in model["merges"]:
            x, y = map(as_bytes, m if isinstance(m, list) else m.split(" "))
            pair = self.ids[x], self.ids[y]
            self.merge[pair] = new = len(self.left)
            self.left.append(pair[0])
            self.right.append(pair[1])
            if self.ids.setdefault(x + y, new) != new:
                raise ValueError(f"{path}: two merges make one token")
        if set(map(as_bytes, model["vocab"].keys() - special)) != set(self.ids):
            raise ValueError(f"{path}: vocabulary and merges differ")
        # every ending of a token, -1 where it is none itself: a walk back from a place stops where no token can go on
        self.endings = {t[k:]: -1 for t in self.ids for k in range(1, len(t))} | self.ids
        self.split = regex.compile(PATTERN)
        self.special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.pairs: dict[tuple[int, int], bool] = {}
        self.heads: dict[bytes, tuple[list[int], list[int]]] = {}
        self.tables = Tables(self._table)

    def _valid(self, a: int, b: int) -> bool:
        """Does the encoding of both tokens' bytes give the two back? Ages stand for the time of a merge; of equal ones,
        the left comes first."""
        never = 1 << 60
        next_a = next_b = never
        while True:
            across = self.merge.get((a, b), never)
            if across < next_a and across <= next_b and across != never:
                return False
            if a < 256 and b < 256:
                return True
            if a > b:  # a was made last: before, its right part stood at the border
                next_a, a = a, self.right[a]
            else:
                next_b, b = b, self.left[b]

    def _counts(self, raw: bytes) -> list[int] | array:
        """Tokens of each prefix of a pre-token's bytes."""
        endings, pairs, n, start = self.endings.get, self.pairs, len(raw), 1
        head = raw[:HEAD] if n > HEAD else None
        known = self.heads.get(head) if head else None
        if n > LISTS:
            last, count = array("i", bytes(4 * (n + 1))), array("i", bytes(4 * (n + 1)))
        elif known:
            last, count, start = known[0] + [0] * (n - HEAD), known[1] + [0] * (n - HEAD), HEAD + 1
        else:
            last, count = [0] * (n + 1), [0] * (n + 1)
        for i in range(start, n + 1):
            found = []
            for j in range(i - 1, -1, -1):
                token = endings(raw[j:i])
                if token is None:
                    break
                if token >= 0:
                    found.append((j, token))
            for j, token in reversed(found):
                if j:
                    key = (last[j], token)
                    ok = pairs.get(key)
                    if ok is None:
                        if len(pairs) > CACHE:
                            pairs.clear()
                        ok = pairs[key] = self._valid(*key)
                    if not ok:
                        continue
                last[i], count[i] = token, count[j] + 1
                break
        if head and known is None:
            if len(self.heads) >= CACHE // 8:
                self.heads.clear()
            self.heads[head] = list(last[: HEAD + 1]), list(count[: HEAD + 1])
        return count

    def _table(self, piece: str) -> list[int] | array:
        """Tokens of each prefix of one pre-token, by its code points (entry 0: the empty prefix)."""
        raw = piece.encode()
        count = self._counts(raw)
        return count if len(raw) == len(piece) else array("i", (c for i, c in enumerate(count) if i == len(raw) or raw[i] & 0xC0 != 0x80))

    def _parts(self, text: str):
        """(pre-tokens, is special) of the stretches between special strings."""
        if self.special is None:
            yield self.split.findall(text), False
            return
        for k, part in enumerate(self.special.split(text)):
            if k % 2:
                yield [part], True
            elif part:
                yield self.split.findall(part), False

    def counts(self, text: str) -> tuple[list[str], list[int]]:
        """The pre-tokens and the number of tokens of each."""
        pieces: list[str] = []
        each: list[int] = []
        tables = self.tables
        for found, special in self._parts(text):
            pieces += found
            each += [1] if special else [tables[p][-1] for p in found]
        return pieces, each

    def total(self, text: str) -> int:
        return sum(self.counts(text)[1])

    def _is_special(self, piece: str) -> bool:
        return self.special is not None and self.special.fullmatch(piece) is not None

    def _resplit(self, pieces: list[str], before: list[int], k: int, part: str) -> int:
        """Tokens of pieces[:k] followed by part, where the cut changes pre-tokens: the short tail is cut anew."""
        low = k - 1 if k and not self._is_special(pieces[k - 1]) and (pieces[k - 1].isspace() or self._is_special(pieces[k])) else k
        tail = "".join(pieces[low:k]) + part
        return before[low] + sum(self.tables[p][-1] for p in self.split.findall(tail))

    def _inside(self, pieces: list[str], before: list[int], each: list[int], k: int) -> list[int]:
        """Tokens of the text up to each code point of pieces[k] (entry 0: none of them).

        They are those before it and its table's, but where a cut splits it otherwise than the pattern does: an apostrophe
        and its letters, white space after white space, a special string that is not whole."""
        piece = pieces[k]
        if self._is_special(piece):
            return [before[k], *(self._resplit(pieces, before, k, piece[:i]) for i in range(1, len(piece))), before[k] + each[k]]
        out = [before[k] + c for c in self.tables[piece]]
        if piece[0] == "'" and piece[-1].isalpha():
            out[1:-1] = [self._resplit(pieces, before, k, piece[:i]) for i in range(1, len(piece))]
        elif k and piece[0].isspace() and pieces[k - 1].isspace():
            out[1] = self._resplit(pieces, before, k, piece[0])
        return out

    def prefixes(self, text: str) -> list[int]:
        """Tokens of every prefix text[:i], i from 0 to the length, from the stored tables."""
        pieces, each = self.counts(text)
        before = [0, *accumulate(each)]
        out = [0]
        for k in range(len(pieces)):
            out += self._inside(pieces, before, each, k)[1:]
        return out

    def longest_prefix(self, text: str, budget: int, known: tuple[list[str], list[int]] | None = None) -> int:
        """Code points of the longest prefix of at most budget tokens."""
        pieces, each = known or self.counts(text)
        before = [0, *accumulate(each)]
        if before[-1] <= budget:
            return len(text)
        # pre-tokens from the first that passes the budget on: a later prefix has at least the tokens of the whole
        # pre-tokens before it, less the one a cut may win back in a run of white space
        k = min(len(pieces) - 1, bisect_right(before, budget + 1))
        length = sum(map(len, pieces[:k]))
        while True:
            # counts need not rise with the prefix, so the last that fits is looked for from the end
            inside = self._inside(pieces, before, each, k)
            for i in range(len(inside) - 1, 0, -1):
                if inside[i] <= budget:
                    return length + i
            if not k:
                return 0
            k -= 1
            length -= len(pieces[k])


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, budget: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, n_fit) of each row; n_fit: code points of the longest prefix of at most
    `budget` tokens. path: the vocabulary's file, at the same place on every executor."""

    def run(batches):
        count = counter(path)
        for batch in batches:
            rows: list[tuple[int, int, int]] = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                known = count.counts(text)
                total = sum(known[1])
                rows.append((len(text.encode()), total, len(text) if total <= budget else count.longest_prefix(text, budget, known)))
            size, total, fit = (pa.array([r[k] for r in rows], pa.int64()) for k in range(3))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, total, pa.array([r[1] > budget for r in rows], pa.bool_()), fit], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_fit"])

    return docs.select(common.column(docs, "doc_id", "long").alias("doc_id"), common.column(docs, "text", "string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_fit long")


def prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, counts): the tokens of every prefix of the text, counts[i] for its first i code points."""

    def run(batches):
        count = counter(path)
        for batch in batches:
            for part in common.pieces(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([count.prefixes(t.as_py() or "") for t in part.column("text")], pa.list_(pa.int32()))], names=["doc_id", "counts"])

    return docs.select(common.column(docs, "doc_id", "long").alias("doc_id"), common.column(docs, "text", "string").alias("text")).mapInArrow(run, "doc_id long, counts array<int>")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
