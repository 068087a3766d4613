"""Structure predicates, file types and text cleaning over binary data or text."""

from __future__ import annotations

import html
import json
import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, pandas_udf

from siltstone.functions import octets as O
from siltstone.functions import patterns as P


def text_of(data: Column) -> Column:
    """The data as UTF-8 text; null where they are not valid."""
    return F.try_validate_utf8(data.cast("string"))


def is_probably_json(text: Column) -> Column:
    """Starts like an object or array, brackets outside strings cancel out, over 10 bytes trimmed."""
    t = O.strip(text)
    bare = F.regexp_replace(t, r'(?s)\\.|"(?:[^"\\]|\\.)*(?:"|\\?$)', "")
    net = lambda x, a, b: F.length(F.translate(x, a, "")) == F.length(F.translate(x, b, ""))
    even = O.once(bare, lambda x: net(x, "{", "}") & net(x, "[", "]"))
    return F.coalesce((t.startswith("{") | t.startswith("[")) & (F.octet_length(t) > 10) & even, F.lit(False))


def strict_json(text: str) -> bool:
    def refuse(_):
        raise ValueError

    try:
        json.loads(text, parse_constant=refuse)
    except (ValueError, RecursionError):
        return False
    return True


@arrow_udf(T.BooleanType())
def _parses(text: pa.Array) -> pa.Array:
    def one(t):
        if t is None:
            return False
        t = t.strip()
        if strict_json(t):
            return True
        at = t.find("{") if "{" in t else t.find("[")
        return at > 0 and strict_json(t[at:])

    return pa.array([one(t.as_py()) for t in text], pa.bool_())


def is_valid_json(text: Column) -> Column:
    """Probably JSON, and parses as a whole or from its first brace (or else bracket) on."""
    likely = is_probably_json(text)
    return likely & _parses(F.when(likely, text))


def is_probably_link(text: Column) -> Column:
    t = O.strip(text)
    return F.coalesce(t.startswith("http") & F.octet_length(t).between(15, 200) & (t.contains("youtube") | t.contains("youtu.be")), F.lit(False))


def is_valid_link(text: Column) -> Column:
    t = O.strip(text)
    found = F.lit(False)
    for _, pattern, _ in P.LINK_PATTERNS:
        found = found | t.rlike(pattern)
    return is_probably_link(text) & F.coalesce(found, F.lit(False))


def is_html(text: Column) -> Column:
    low = F.lower(text)
    tags = low.contains("<html") | low.contains("<body") | low.contains("<div") | low.contains("<p")
    return F.coalesce(text.contains("<") & text.contains(">") & tags, F.lit(False))


def is_csv(text: Column) -> Column:
    """At least two lines, a comma in the first, and 60 % of the lines with at least half of its commas."""
    lines = F.split(F.replace(O.strip(text), F.lit("\r\n"), F.lit("\n")), "\n")
    commas = F.transform(lines, lambda x: F.length(x) - F.length(F.translate(x, ",", "")))
    even = lambda c: (F.size(c) >= 2) & (F.element_at(c, 1) >= 1) & (10 * F.size(F.filter(c, lambda n: n >= F.floor(F.element_at(c, 1) / 2))) >= 6 * F.size(c))
    return F.coalesce(O.once(commas, even), F.lit(False))


def validation(text: Column) -> Column:
    """Struct of the four JSON and link verdicts and their confidences."""
    pj, vj, pl, vl = is_probably_json(text), is_valid_json(text), is_probably_link(text), is_valid_link(text)
    return F.struct(
        pj.alias("is_probably_json"), vj.alias("is_valid_json"), pl.alias("is_probably_link"), vl.alias("is_valid_link"),
        F.when(vj, 1.0).when(pj, 0.6).otherwise(0.0).alias("json_confidence"), F.when(vl, 1.0).when(pl, 0.5).otherwise(0.0).alias("link_confidence"),
    )


def has_cyrillic(data: Column) -> Column:
    return F.coalesce(O.latin(data).rlike(r"[ÐÑ]"), F.lit(False))


def cyrillic_density(data: Column) -> Column:
    pairs = F.regexp_count(O.latin(data), F.lit(r"[ÐÑ][\u0080-¿]"))
    return F.coalesce(pairs / F.greatest(F.floor(F.length(data) / 2), F.lit(1)), F.lit(0.0))


def entropy_category(e: Column) -> Column:
    return F.when(e > 7.5, "high_entropy_compressed").when(e > 6, "medium_entropy_mixed").when(e > 3.5, "structured_text").when(e > 1, "low_entropy_repetitive").otherwise("very_low_entropy_uniform")


def is_compressed(e: Column) -> Column:
    return e > 7.5


def is_structured(e: Column) -> Column:
    return e.between(3.0, 6.0)


def file_type(data: Column) -> Column:
    head = F.hex(F.substring(data, 1, 1))
    return F.when(head.isin("7B", "5B"), "json").when(head == "3C", "html").when(O.latin(data).contains("http"), "txt").otherwise("unknown")


def is_target_size(size: Column) -> Column:
    return (size >= 15 * 1024) & (size <= 350 * 1024)


def is_carvable(size: Column, cluster: Column, head: Column) -> Column:
    """What bulk extraction keeps: at most 250 MiB, a real cluster, not empty, 5 non-zero bytes in the first 1,024."""
    solid = F.length(F.translate(O.latin(F.substring(head, 1, 1024)), "\x00", "")) >= 5
    return (size <= 250 * 1024 * 1024) & (size > 0) & (cluster >= 2) & (F.length(head) > 0) & solid


def block_flags(block: Column) -> Column:
    """Struct of a block's flags: all zero; starts with an entry mark; positions of the bytes y h { v /; zero bytes."""
    text = O.latin(block)
    n_hot = F.length(text) - F.length(F.translate(text, "yh{v/", ""))
    hot = F.filter(F.transform(F.split(text, ""), lambda c, i: F.when(c.isin(*"yh{v/"), i)), lambda x: x.isNotNull())
    zeros = F.length(text) - F.length(F.translate(text, "\x00", ""))
    hot = F.when(F.length(text) > 0, hot).otherwise(F.array().cast("array<int>"))
    return F.struct(
        (zeros == F.length(text)).alias("is_empty"), (F.hex(F.substring(block, 1, 1)) == "85").alias("has_metadata"), hot.alias("hot_positions"), n_hot.cast("int").alias("n_hot"),
        zeros.cast("int").alias("zero_count"), ((zeros < 8) & (n_hot > 0)).alias("high_entropy"),
    )


# ---------------------------------------------------------------- titles, names, cleaning


@pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    """HTML character references decoded."""
    return text.map(html.unescape, na_action="ignore")


def file_title(text: Column, kind: Column) -> Column:
    """A recovered file's title: <title>, the first "title" or "name" of small JSON, the first line that is not blank."""
    page = F.nullif(O.strip(F.regexp_extract(text, r"(?i)<title>(.*?)</title>", 1)), F.lit(""))
    entry = F.when(F.octet_length(text) <= 10_240, F.nullif(F.regexp_extract(text, r'"(?:title|name)"\s*:\s*"([^"]+)"', 1), F.lit("")))
    line = F.get(F.filter(F.transform(F.split(text, r"\r?\n"), O.strip), lambda x: x != ""), F.lit(0))
    return F.when(kind.isin("html", "htm"), page).when(kind == "json", entry).when(kind.isin("txt", "md"), line)


def safe_name(text: str | None) -> str | None:
    """Letters, digits, space, - and _ only, trimmed; over 50 bytes: the first 47 (whole characters) and three dots."""
    if text is None:
        return None
    out = "".join(c for c in text if c in " -_" or unicodedata.category(c)[0] in "LN").strip()
    raw = out.encode()
    return out if len(raw) <= 50 else raw[:47].decode(errors="ignore") + "..."


@pandas_udf(T.StringType())
def _cut_name(text: pd.Series) -> pd.Series:
    return text.map(safe_name, na_action="ignore")


def sanitized(text: Column) -> Column:
    """safe_name() as a column; only names over 50 bytes leave the JVM."""
    short = O.strip(F.regexp_replace(text, r"[^\p{L}\p{N} _-]", ""))
    return F.when(F.octet_length(short) <= 50, short).otherwise(_cut_name(F.when(F.octet_length(short) > 50, text)))


def cleaned(text: Column, kind: Column) -> Column:
    """Text kinds: NUL goes, other control characters but LF, CR and tab become spaces."""
    out = F.regexp_replace(F.translate(text, "\x00", ""), r"[\x01-\x08\x0B\x0C\x0E-\x1F]", " ")
    return F.when(kind.isin("txt", "json", "html", "css", "js", "xml", "md"), out).otherwise(text)


def word_set(text: Column, data: Column) -> Column:
    """Distinct lower-case words of over 3 ASCII letters; null if under half of the bytes are printable or none is left."""
    n = F.length(data)
    printable = n - F.length(F.regexp_replace(O.latin(data), r"[\x20-\x7E]", ""))
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w.rlike(r"^[a-z]{4,}$")))
    return F.when((printable >= F.floor(n / 2)) & (F.size(words) > 0), words)


def media_group(name: Column) -> Column:
    """Bracketed 11-character id of a file name; else NOID_ and the name without its media ending, or else without its last
    extension."""
    found = F.regexp_extract(name, r"\[([A-Za-z0-9_-]{11})\]", 1)
    known = "(?:" + "|".join(re.escape(x) for x in P.MEDIA_ENDINGS) + ")$"
    stem = F.when(name.rlike(known), F.regexp_replace(name, known, "")).otherwise(F.regexp_replace(name, r"(?s)^(.+)\.[^.]+$", "$1"))
    return F.when(found != "", found).otherwise(F.concat(F.lit("NOID_"), stem))
