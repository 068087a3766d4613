"""Queries: chunks, bytes, predicates, scores, links, titles, names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import planted as D
from siltstone.functions import octets as O
from siltstone.functions import patterns as P
from siltstone.functions import predicates as V
from siltstone.functions import scores as S
from siltstone.functions import table_functions as TF
from siltstone.operators import chunks as C
from siltstone.operators import links as L
from siltstone.operators import report as T
from siltstone.plans import scan as N
from siltstone.streaming import resume as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


CHUNK, OVER = 65_536, 4_096
_TOTAL = "WITH t AS (SELECT sum(octet_length(encode(text)))::BIGINT AS n FROM documents)"


def _total(spark, sf_dir):
    return D.documents(spark, sf_dir).agg(F.sum(F.octet_length("text")).cast("long").alias("length"))


def _ranges(start: int, reverse: bool) -> str:
    seq = f"ceil((n - {start}) / {CHUNK})::BIGINT - 1 - k" if reverse else "k"
    return f"{_TOTAL} SELECT k AS chunk_id, k * {CHUNK} + {start} AS \"offset\", least({CHUNK + OVER}, n - k * {CHUNK} - {start}) AS size, {seq} AS chunk_seq FROM (SELECT n, unnest(range(ceil((n - {start}) / {CHUNK})::BIGINT)) AS k FROM t)"


def _ranged(start: int = 0, reverse: bool = False):
    return lambda s, d: C.chunk_ranges(_total(s, d), "length", CHUNK, OVER, start, reverse).select("chunk_id", "offset", "size", "chunk_seq")


for _name, _start, _reverse in (("chunk_ranges", 0, False), ("chunk_ranges_reverse", 0, True), ("chunk_resume", 100_000, False)):
    QUERIES[_name], ORACLES[_name] = _ranged(_start, _reverse), _ranges(_start, _reverse)


@query("SELECT doc_id, n_chars AS size, greatest(64, n_chars // 64 * 64)::BIGINT AS aligned FROM documents")
def chunk_alignment(spark, sf_dir):
    return D.documents(spark, sf_dir).select("doc_id", F.col("n_chars").alias("size"), C.aligned_chunk_size(F.col("n_chars")).alias("aligned"))


@query(
    """SELECT doc_id, CASE WHEN o >= n THEN 'InvalidOffset' WHEN o + 64 > n THEN 'InvalidSize' END AS error, CASE WHEN o + 64 <= n THEN sha256(substr(hex(encode(text)), 2 * o + 1, 128)) END AS slice_hash
    FROM (SELECT doc_id, text, octet_length(encode(text)) AS n, (doc_id * 37) % 4000 AS o FROM documents)"""
)
def slice_bounds(spark, sf_dir):
    d = D.documents(spark, sf_dir).withColumn("data", F.encode("text", "UTF-8"))
    s = C.slice_of(F.col("data"), F.length("data"), (F.col("doc_id") * 37) % 4000, F.lit(64))
    return d.select("doc_id", s.alias("s")).select("doc_id", F.col("s.error").alias("error"), F.sha2(F.hex("s.data").cast("binary"), 256).alias("slice_hash"))


@query(
    """SELECT doc_id, block, regexp_matches(x, '^(00)*$') AS is_empty, substr(x, 1, 2) = '85' AS has_metadata,
      len(list_filter(y, lambda v: v IN ('79', '68', '7B', '76', '2F')))::INT AS n_hot, len(list_filter(y, lambda v: v = '00'))::INT AS zero_count, len(list_filter(y, lambda v: v = '00')) < 8 AND len(list_filter(y, lambda v: v IN ('79', '68', '7B', '76', '2F'))) > 0 AS high_entropy
    FROM (SELECT doc_id, block, x, list_transform(range(64), lambda i: substr(x, 2 * i + 1, 2)) AS y FROM (SELECT doc_id, block::INT AS block, substr(hex(encode(text)), block * 128 + 1, 128) AS x FROM (SELECT doc_id, text, unnest(range(octet_length(encode(text)) // 64)) AS block FROM documents)))"""
)
def block_classify(spark, sf_dir):
    d = D.documents(spark, sf_dir).select("doc_id", F.encode("text", "UTF-8").alias("data"))
    return C.blocks(d, "data", 64).select("doc_id", "block", "flags.is_empty", "flags.has_metadata", "flags.n_hot", "flags.zero_count", "flags.high_entropy")


@query(f"WITH {D.P_SQL}, {D.E_SQL} SELECT ('0x' || byte)::INT AS byte, sum(n)::BIGINT AS n FROM c GROUP BY byte")
def byte_histogram(spark, sf_dir):
    return O.histogram(D.bodies(spark, sf_dir), "data")


@query(f"""WITH {D.P_SQL}, {D.E_SQL} SELECT doc_id, round(entropy, 6) AS entropy, CASE WHEN entropy > 7.5 THEN 'high_entropy_compressed' WHEN entropy > 6 THEN 'medium_entropy_mixed' WHEN entropy > 3.5 THEN 'structured_text' WHEN entropy > 1 THEN 'low_entropy_repetitive' ELSE 'very_low_entropy_uniform' END AS category, entropy > 7.5 AS compressed, entropy BETWEEN 3 AND 6 AS structured FROM e""")
def entropy_category(spark, sf_dir):
    d = D.bodies(spark, sf_dir).select("doc_id", O.entropy("data").alias("entropy"))
    e = F.col("entropy")
    return d.select("doc_id", F.round(e, 6).alias("entropy"), V.entropy_category(e).alias("category"), V.is_compressed(e).alias("compressed"), V.is_structured(e).alias("structured"))


@query(
    f"""WITH {D.P_SQL}, {D.E_SQL}, v AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM c GROUP BY doc_id),
    d AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(x.n * y.n) AS dot FROM c x JOIN c y ON y.doc_id = x.doc_id + 1 AND x.byte = y.byte GROUP BY 1, 2)
    SELECT a, b, round(dot / (u.norm * w.norm), 6) AS cosine FROM d JOIN v u ON u.doc_id = a JOIN v w ON w.doc_id = b"""
)
def byte_cosine_neighbours(spark, sf_dir):
    d = D.bodies(spark, sf_dir).select("doc_id", O.byte_frequency("data").alias("v"))
    x, y = d.select(F.col("doc_id").alias("a"), F.col("v").alias("va")), d.select(F.col("doc_id").alias("b"), F.col("v").alias("vb"))
    return x.join(y, F.col("b") == F.col("a") + 1).select("a", "b", F.round(O.cosine(F.col("va"), F.col("vb")), 6).alias("cosine"))


@query("SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 5) AS cosine FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1")
def embedding_cosine_neighbours(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    x, y = d.select(F.col("vec_id").alias("a"), F.col("embedding").alias("va")), d.select(F.col("vec_id").alias("b"), F.col("embedding").alias("vb"))
    return x.join(y, F.col("b") == F.col("a") + 1).select("a", "b", F.round(O.cosine(F.col("va"), F.col("vb")), 5).alias("cosine"))


_CYR = "len(regexp_extract_all(body, '[\\x{0400}-\\x{047F}]'))"


@query(f"""WITH {D.P_SQL} SELECT doc_id, (length(body) - length(translate(body, '{{}}[]', '')))::INT AS json_markers, {_CYR} > 0 AS has_cyrillic, round({_CYR} / greatest(octet_length(encode(body)) // 2, 1), 9) AS cyrillic_density, round(1 / greatest(octet_length(encode(body)) / 1048576, 0.001), 6) AS link_density, 10.0 + 100.0 * {_CYR} + floor((length(body) - length(translate(body, '{{}}[]', ''))) / 10) AS legacy_score FROM p""")
def text_markers(spark, sf_dir):
    d, b = D.bodies(spark, sf_dir), F.col("data")
    pairs = F.regexp_count(O.latin(b), F.lit("[ÐÑ][\u0080-¿]"))
    return d.select(
        "doc_id", O.count_bytes(b, "{}[]").alias("json_markers"), V.has_cyrillic(b).alias("has_cyrillic"), F.round(V.cyrillic_density(b), 9).alias("cyrillic_density"),
        F.round(S.link_density(F.lit(1), F.length(b)), 6).alias("link_density"), S.legacy_score(F.lit(1), pairs, O.count_bytes(b, "{}[]")).cast("double").alias("legacy_score"),
    )


_JSON = """concat(CASE event_id % 11 WHEN 3 THEN 'x ' WHEN 4 THEN ' ' ELSE '' END, '{"id": ', cast(event_id AS STRING), ', "q": "a}', chr(92), '"b", "props": ', props, CASE WHEN event_id % 7 = 0 THEN '' ELSE '}' END, CASE WHEN event_id % 13 = 5 THEN ' trailing' ELSE '' END)"""
_BARE = r"""regexp_replace(trim(t), '(?s)\\.|"(?:[^"\\]|\\.)*(?:"|\\?$)', '', 'g')"""


@query(
    f"""WITH j AS (SELECT event_id, {_JSON} AS t FROM events),
    k AS (SELECT event_id, t, {_BARE} AS bare FROM j),
    v AS (SELECT event_id, t, regexp_matches(trim(t), '^[{{\\[]') AND length(translate(bare, '{{', '')) = length(translate(bare, '}}', '')) AND length(translate(bare, '[', '')) = length(translate(bare, ']', '')) AND octet_length(encode(trim(t))) > 10 AS likely FROM k)
    SELECT event_id, likely AS is_probably_json, likely AND json_valid(trim(t)) AS is_valid_json, CASE WHEN likely AND json_valid(trim(t)) THEN 1.0 WHEN likely THEN 0.6 ELSE 0.0 END::DOUBLE AS json_confidence FROM v"""
)
def json_validation(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr(_JSON).alias("t"))
    d = d.withColumn("v", V.validation(F.col("t")))
    return d.select("event_id", "v.is_probably_json", "v.is_valid_json", "v.json_confidence")


_ANY = " OR ".join(f"regexp_matches(trim(u), '{p.replace(chr(39), chr(39) * 2)}')" for _, p, _ in P.LINK_PATTERNS)
_LIKELY = "(starts_with(trim(u), 'http') AND octet_length(encode(trim(u))) BETWEEN 15 AND 200 AND (contains(u, 'youtube') OR contains(u, 'youtu.be')))"


@query(f"""WITH u AS (SELECT concat('p', cast(page_id AS STRING)) AS id, url AS u FROM pages UNION ALL SELECT concat('d', cast(doc_id AS STRING)), {D.URL} FROM documents) SELECT id, {_LIKELY} AS is_probably_link, {_LIKELY} AND ({_ANY}) AS is_valid_link, CASE WHEN {_LIKELY} AND ({_ANY}) THEN 1.0 WHEN {_LIKELY} THEN 0.5 ELSE 0.0 END::DOUBLE AS link_confidence FROM u""")
def link_validation(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("url").alias("u"))
    docs = D.documents(spark, sf_dir).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.expr(D.URL).alias("u"))
    u = F.col("u")
    p, v = V.is_probably_link(u), V.is_valid_link(u)
    return pages.unionAll(docs).select("id", p.alias("is_probably_link"), v.alias("is_valid_link"), F.when(v, 1.0).when(p, 0.5).otherwise(0.0).alias("link_confidence"))


_KINDS = """k AS (SELECT concat('page', cast(page_id AS STRING)) AS id, html AS t FROM pages UNION ALL SELECT concat('doc', cast(doc_id AS STRING)), text FROM documents
 UNION ALL SELECT concat('part', cast(p_partkey AS STRING)), concat(cast(p_partkey AS STRING), ',', p_name, chr(10), p_brand, CASE WHEN p_partkey % 3 = 0 THEN ';' ELSE ',' END, p_type, chr(10), p_brand, ',', p_type, chr(10)) FROM part
 UNION ALL SELECT concat('event', cast(event_id AS STRING)), props FROM events)"""


@query(
    f"""WITH {_KINDS}, l AS (SELECT id, t, list_transform(string_split(regexp_replace(regexp_replace(t, '^\\s+|\\s+$', '', 'g'), '\\r\\n', chr(10), 'g'), chr(10)), lambda x: length(x) - length(replace(x, ',', ''))) AS c FROM k)
    SELECT id, CASE WHEN substr(t, 1, 1) IN ('{{', '[') THEN 'json' WHEN substr(t, 1, 1) = '<' THEN 'html' WHEN contains(t, 'http') THEN 'txt' ELSE 'unknown' END AS file_type,
      contains(t, '<') AND contains(t, '>') AND (contains(lower(t), '<html') OR contains(lower(t), '<body') OR contains(lower(t), '<div') OR contains(lower(t), '<p')) AS is_html,
      len(c) >= 2 AND c[1] >= 1 AND 10 * len(list_filter(c, lambda x: x >= c[1] // 2)) >= 6 * len(c) AS is_csv FROM l"""
)
def structure_kinds(spark, sf_dir):
    for t in ("pages", "documents", "part", "events"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"kinds_{t}")
    sql = _KINDS
    for t in ("pages", "documents", "part", "events"):
        sql = sql.replace(f"FROM {t}", f"FROM kinds_{t}")
    d = spark.sql(f"WITH {sql} SELECT id, t FROM k")
    t = F.col("t")
    return d.select("id", V.file_type(F.encode(t, "UTF-8")).alias("file_type"), V.is_html(t).alias("is_html"), V.is_csv(t).alias("is_csv"))


_SCORE_SQL = f"""WITH {D.F_SQL}, {D.E_SQL},
m AS (SELECT f.doc_id, body, size, "offset", entropy, {_CYR} / greatest(size // 2, 1) AS cyr, length(body) - length(translate(body, '{{}}[]', '')) AS brackets,
  1 / greatest(size / 1048576, 0.001) AS dens, list_transform(string_split(regexp_replace(body, '^\\s+|\\s+$', '', 'g'), chr(10)), lambda x: length(x) - length(replace(x, ',', ''))) AS c,
  contains(body, '<') AND contains(body, '>') AND regexp_matches(lower(body), '<html|<body|<div|<p') AS html FROM f JOIN e ON e.doc_id = f.doc_id),
s AS (SELECT *, least(dens, 100) * 0.4 + cyr * 30 + CASE WHEN brackets > 0 THEN 15 ELSE 0 END AS base, least(dens, 100) * 0.4 + cyr * 30 + CASE WHEN brackets > 10 THEN 15 ELSE 0 END AS fast,
  len(c) >= 2 AND c[1] >= 1 AND 10 * len(list_filter(c, lambda x: x >= c[1] // 2)) >= 6 * len(c) AS csv, size BETWEEN 15360 AND 358400 AS fit, size / 1024 AS kb FROM m),
g AS (SELECT *, CASE WHEN fit THEN base + 15 WHEN kb > 400 OR kb < 5 THEN base * 0.5 ELSE base END AS target, CASE WHEN fit THEN fast + 15 WHEN kb > 400 OR kb < 5 THEN fast * 0.5 ELSE fast END AS fast_score FROM s),
o AS (SELECT *, greatest(0, target * 0.6 + CASE WHEN entropy > 7.5 THEN -25 ELSE CASE WHEN entropy BETWEEN 3 AND 6 THEN 20 ELSE 0 END + CASE WHEN entropy BETWEEN 3.5 AND 6.5 THEN 10 ELSE 0 END END + CASE WHEN html THEN 20 ELSE 0 END + CASE WHEN csv THEN 15 ELSE 0 END + CASE WHEN fit THEN 10 ELSE 0 END) AS score,
  list_filter([CASE WHEN entropy > 7.5 THEN 'high_entropy_compressed' END, CASE WHEN entropy BETWEEN 3 AND 6 THEN 'structured_text' END, CASE WHEN entropy BETWEEN 3.5 AND 6.5 THEN 'optimal_entropy' END, CASE WHEN html THEN 'valid_html' END, CASE WHEN csv THEN 'valid_csv' END, CASE WHEN fit THEN 'target_size' END], lambda x: x IS NOT NULL) AS reasons FROM g)"""


def _featured(spark, sf_dir):
    f = D.fragments(spark, sf_dir)
    rows = f.select(F.lit("documents").alias("path"), F.col("doc_id").alias("chunk_id"), "offset", "size", "data")
    return N.features(rows, n_links=F.lit(1))


@query(f"{_SCORE_SQL} SELECT doc_id, round(target, 4) AS target_score, round(fast_score, 4) AS fast_score, round(score, 4) AS overall_score, array_to_string(reasons, ',') AS reasons FROM o")
def fragment_scores(spark, sf_dir):
    s = F.col("fragment_score")
    return _featured(spark, sf_dir).select(F.col("chunk_id").alias("doc_id"), F.round("target_score", 4).alias("target_score"), F.round("fast_score", 4).alias("fast_score"), F.round(s["overall_score"], 4).alias("overall_score"), F.array_join(s["reasons"], ",").alias("reasons"))


@query(f"{_SCORE_SQL} SELECT doc_id, \"offset\", size, round(score, 4) AS score FROM o WHERE score > 20")
def hot_fragments(spark, sf_dir):
    return N.hot(_featured(spark, sf_dir)).select(F.col("chunk_id").alias("doc_id"), "offset", "size", F.round("score", 4).alias("score"))


@query(f"{_SCORE_SQL} SELECT doc_id, \"offset\", size, round(fast_score, 4) AS score FROM o WHERE fast_score > 10")
def hot_fragments_fast(spark, sf_dir):
    return N.hot(_featured(spark, sf_dir), "fast").select(F.col("chunk_id").alias("doc_id"), "offset", "size", F.round("score", 4).alias("score"))


@query(f"{_SCORE_SQL} SELECT doc_id, size BETWEEN 15360 AND 358400 AS is_target_size, (html OR csv OR entropy BETWEEN 3 AND 6) AND score > 50 AND NOT entropy > 7.5 AS is_high_quality, score > 30 AND NOT entropy > 7.5 AS is_worth_processing, dens >= 50 AS needs_deep_scan, (html OR csv OR entropy BETWEEN 3 AND 6) AS has_structure FROM o")
def fragment_filters(spark, sf_dir):
    s = F.col("fragment_score")
    return _featured(spark, sf_dir).select(F.col("chunk_id").alias("doc_id"), V.is_target_size(F.col("size")).alias("is_target_size"), S.is_high_quality(s).alias("is_high_quality"), S.is_worth_processing(s).alias("is_worth_processing"), S.needs_deep_scan(S.link_density(F.lit(1), F.col("size"))).alias("needs_deep_scan"), S.has_valid_structure(s).alias("has_structure"))


# ---------------------------------------------------------------- links

_ALL = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS pattern_idx, '{n}' AS pattern_name, unnest(regexp_extract_all(body, '{p.replace(chr(39), chr(39) * 2)}', 0)) AS url, unnest(regexp_extract_all(body, '{p.replace(chr(39), chr(39) * 2)}', 1)) AS video_id, ({k} / 10.0)::DOUBLE AS confidence FROM p" for i, (n, p, k) in enumerate(P.LINK_PATTERNS)
)
_LINKS = f"WITH {D.P_SQL}, l AS ({_ALL})"


def _links(spark, sf_dir):
    return L.matches(D.bodies(spark, sf_dir), "body", "doc_id")


@query(f"{_LINKS} SELECT doc_id, pattern_idx, pattern_name, url, video_id, confidence FROM l")
def links_all(spark, sf_dir):
    return _links(spark, sf_dir)


@query(f"{_LINKS} SELECT pattern_name, count(*) AS n, count(DISTINCT video_id) AS n_ids FROM l GROUP BY pattern_name")
def links_by_pattern(spark, sf_dir):
    return _links(spark, sf_dir).groupBy("pattern_name").agg(F.count("*").alias("n"), F.countDistinct("video_id").alias("n_ids"))


@query(f"{_LINKS} SELECT doc_id, video_id, pattern_name FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, video_id ORDER BY pattern_idx) AS r FROM l) WHERE r = 1")
def link_dedup_chunk(spark, sf_dir):
    m = _links(spark, sf_dir).select(F.lit("documents").alias("path"), F.col("doc_id").alias("chunk_id"), F.col("pattern_idx").alias("match_seq"), "video_id", "pattern_name")
    return L.chunk_dedup(m).select(F.col("chunk_id").alias("doc_id"), "video_id", "pattern_name")


@query(f"{_LINKS} SELECT video_id, doc_id, pattern_name, confidence FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY confidence DESC, doc_id, pattern_idx) AS r FROM l) WHERE r = 1")
def link_dedup_global(spark, sf_dir):
    m = _links(spark, sf_dir).select("video_id", "doc_id", F.col("doc_id").alias("chunk_seq"), F.lit(0).alias("offset"), "pattern_idx", "pattern_name", "confidence", F.lit(None).cast("string").alias("title"))
    return L.best_links(m).select("video_id", "doc_id", "pattern_name", "confidence")


@query(f"{_LINKS} SELECT doc_id, pattern_name, video_id, confidence FROM l WHERE confidence >= 0.8")
def links_min_confidence(spark, sf_dir):
    return L.at_least(_links(spark, sf_dir), 0.8).select("doc_id", "pattern_name", "video_id", "confidence")


@query()
def link_windows(spark, sf_dir):
    f = D.fragments(spark, sf_dir).select(F.lit("documents").alias("path"), F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("chunk_seq"), "offset", "data")
    return L.extract(f, dedup=False).select("chunk_id", "offset", "pattern_name", "url", "video_id", "title", "confidence")


@query()
def link_windows_sql(spark, sf_dir):
    """link_windows in SQL alone, by a table function."""
    TF.register(spark)
    D.fragments(spark, sf_dir).createOrReplaceTempView("siltstone_fragments")
    return spark.sql("""WITH chunks AS (SELECT 'documents' AS path, doc_id AS chunk_id, doc_id AS chunk_seq, offset, data FROM siltstone_fragments)
        SELECT chunk_id, offset, pattern_name, url, video_id, title, confidence FROM extract_links(TABLE(chunks), false)""")


@query(f"{_LINKS} SELECT lang, pattern_name, count(*) AS n FROM l JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) GROUP BY lang, pattern_name")
def links_by_lang_sql(spark, sf_dir):
    """Matches counted in SQL alone, by a table function that is joined to each text."""
    TF.register(spark)
    D.bodies(spark, sf_dir).createOrReplaceTempView("siltstone_bodies")
    return spark.sql("SELECT lang, pattern_name, count(*) AS n FROM siltstone_bodies, LATERAL find_links(body) GROUP BY lang, pattern_name")


# ---------------------------------------------------------------- titles, names, text


@query("SELECT page_id, nullif(trim(regexp_extract(html, '(?i)<title>(.*?)</title>', 1)), '') AS title FROM pages")
def title_html(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return d.select("page_id", V.file_title(F.col("html"), F.lit("html")).alias("title"))


@query("SELECT event_id, nullif(regexp_extract(concat('{\"name\" : \"', event_type, '\", \"p\": ', props, '}'), '\"(?:title|name)\"\\s*:\\s*\"([^\"]+)\"', 1), '') AS title FROM events")
def title_json(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.concat(F.lit('{"name" : "'), "event_type", F.lit('", "p": '), "props", F.lit("}"))
    return d.select("event_id", V.file_title(t, F.lit("json")).alias("title"))


@query("SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\r?\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')[1] AS title FROM documents")
def title_text(spark, sf_dir):
    return D.documents(spark, sf_dir).select("doc_id", V.file_title(F.col("text"), F.lit("txt")).alias("title"))


@query("SELECT page_id, nullif(CASE WHEN octet_length(encode(t)) > 3 AND octet_length(encode(t)) < 200 AND NOT contains(lower(t), 'youtube') THEN t END, '') AS title FROM (SELECT page_id, trim(regexp_extract(html, '<title>(.*?)(?:\\s*-\\s*YouTube)?</title>', 1)) AS t, html FROM pages) WHERE octet_length(encode(t)) > 3 AND octet_length(encode(t)) < 200 UNION ALL SELECT page_id, CASE WHEN octet_length(encode(h)) > 3 AND octet_length(encode(h)) < 200 AND NOT contains(lower(h), 'youtube') THEN h END FROM (SELECT page_id, trim(regexp_extract(html, '<title>(.*?)(?:\\s*-\\s*YouTube)?</title>', 1)) AS t, trim(regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1)) AS h FROM pages) WHERE NOT (octet_length(encode(t)) > 3 AND octet_length(encode(t)) < 200)")
def titles_context(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return d.select("page_id", L.title_of(F.col("html")).alias("title"))


_NAME = "trim(regexp_replace(text, '[^\\p{L}\\p{N} _-]', '', 'g'))"


@query(f"SELECT doc_id, CASE WHEN octet_length(encode(s)) <= 50 THEN s ELSE concat(substr(s, 1, list_max(list_filter(range(48), lambda k: octet_length(encode(substr(s, 1, k::INT))) <= 47))::INT), '...') END AS name FROM (SELECT doc_id, {_NAME} AS s FROM documents)")
def sanitize_filename(spark, sf_dir):
    return D.documents(spark, sf_dir).select("doc_id", V.sanitized(F.col("text")).alias("name"))


_DIRTY = "concat(chr(1), text, chr(31), ' a', chr(9), 'b', chr(10), chr(12), 'c')"


@query(f"SELECT doc_id, sha256(regexp_replace({_DIRTY}, '[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F]', ' ', 'g')) AS clean_hash FROM documents")
def clean_text(spark, sf_dir):
    return D.documents(spark, sf_dir).select("doc_id", F.sha2(V.cleaned(F.expr(_DIRTY), F.lit("txt")).cast("binary"), 256).alias("clean_hash"))


@query("SELECT doc_id, coalesce(CASE WHEN len(regexp_extract_all(text, '[\\x20-\\x7E]')) >= octet_length(encode(text)) // 2 THEN nullif(len(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: regexp_full_match(w, '[a-z]{4,}')))), 0) END, 0)::INT AS n_words FROM documents")
def word_sets(spark, sf_dir):
    d = D.documents(spark, sf_dir)
    w = V.word_set(F.col("text"), F.encode("text", "UTF-8"))
    return d.select("doc_id", F.coalesce(F.when(w.isNotNull(), F.size(w)), F.lit(0)).alias("n_words"))


@query("SELECT doc_id, (instr(text, 'tion') - 1)::BIGINT AS pos, coalesce(list_sum(list_transform(range(1, greatest(length(text), 1)), lambda i: CASE WHEN substr(text, i::INT, 2) = 'th' THEN 1 ELSE 0 END)), 0)::BIGINT AS n FROM (SELECT doc_id, regexp_replace(text, '[^\\x01-\\x7F]', '', 'g') AS text FROM documents)")
def find_pattern(spark, sf_dir):
    d = D.documents(spark, sf_dir).select("doc_id", F.encode(F.regexp_replace("text", r"[^\x01-\x7F]", ""), "UTF-8").alias("b"))
    return d.select("doc_id", F.coalesce(O.find_first(F.col("b"), b"tion"), F.lit(-1)).alias("pos"), O.count_overlapping(F.col("b"), b"th").alias("n"))


@query("SELECT doc_id, sha256(text) AS sha256, sha256(concat('\"', lang, '\"', '50.0', cast(n_chars AS STRING))) AS report_checksum FROM documents")
def content_hashes(spark, sf_dir):
    d = D.documents(spark, sf_dir)
    return d.select("doc_id", F.sha2("text", 256).alias("sha256"), T.checksum(F.col("lang"), F.lit(50.0), F.col("n_chars")).alias("report_checksum"))


@query("SELECT doc_id, sha256(unhex(concat(substr(hex(encode(text)), 1, 2097152), (SELECT string_agg(substr(z, 15 - 2 * i::INT, 2), '' ORDER BY i) FROM (SELECT lpad(printf('%X', octet_length(encode(text))), 16, '0') AS z, unnest(range(8)) AS i))))) AS image_hash FROM documents")
def image_fingerprint(spark, sf_dir):
    d = D.documents(spark, sf_dir).select("doc_id", F.encode("text", "UTF-8").alias("b"))
    return d.select("doc_id", R.image_fingerprint(F.col("b"), F.length("b").cast("long")).alias("image_hash"))
