"""Fragment scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import predicates as V

#: Hot-fragment thresholds by profile: "validated" uses fragment_score, "fast" target_score with over 10 brackets.
THRESHOLDS = {"validated": 20.0, "fast": 10.0}


def link_density(n_links: Column, size: Column) -> Column:
    """Links per MB, the size counted as 0.001 MB at least; 0 for size 0."""
    return F.when(size > 0, n_links / F.greatest(size / (1024.0 * 1024.0), F.lit(0.001))).otherwise(0.0)


def target_score(n_links: Column, cyrillic: Column, has_brackets: Column, size: Column) -> Column:
    base = F.least(link_density(n_links, size), F.lit(100.0)) * 0.4 + cyrillic * 30.0 + F.when(has_brackets, 15.0).otherwise(0.0)
    kb = size / 1024.0
    return F.when((kb >= 15) & (kb <= 350), base + 15.0).when((kb > 400) | (kb < 5), base * 0.5).otherwise(base)


def legacy_score(n_links: Column, n_cyrillic: Column, n_brackets: Column) -> Column:
    return 10.0 * n_links + 100.0 * n_cyrillic + F.floor(n_brackets / 10)


def fragment_score(target: Column, entropy: Column, checks: Column, html: Column, csv: Column, size: Column) -> Column:
    """Struct of overall score, flags and reasons. checks: a struct of predicates.validation()."""
    compressed, structured = V.is_compressed(entropy), V.is_structured(entropy)
    best = entropy.between(3.5, 6.5)
    target_size = V.is_target_size(size)
    vj, pj, vl, pl = (checks[k] for k in ("is_valid_json", "is_probably_json", "is_valid_link", "is_probably_link"))
    parts = [
        (compressed, -25.0, "high_entropy_compressed"),
        (~compressed & structured, 20.0, "structured_text"),
        (~compressed & best, 10.0, "optimal_entropy"),
        (vj, 30.0, "valid_json"),
        (~vj & pj, 15.0, "probably_json"),
        (vl, 25.0, "valid_youtube_url"),
        (~vl & pl, 10.0, "probably_youtube"),
        (html, 20.0, "valid_html"),
        (csv, 15.0, "valid_csv"),
        (target_size, 10.0, "target_size"),
    ]
    total = target * 0.6
    for test, points, _ in parts:
        total = total + F.when(test, points).otherwise(0.0)
    reasons = F.filter(F.array(*(F.when(test, name) for test, _, name in parts)), lambda x: x.isNotNull())
    return F.struct(
        F.greatest(total, F.lit(0.0)).alias("overall_score"), vj.alias("is_valid_json"), html.alias("is_valid_html"), csv.alias("is_valid_csv"),
        vl.alias("is_valid_youtube_url"), structured.alias("has_structured_text"), compressed.alias("is_compressed"), reasons.alias("reasons"),
    )


def has_valid_structure(score: Column) -> Column:
    return score["is_valid_json"] | score["is_valid_html"] | score["is_valid_csv"] | score["has_structured_text"]


def is_high_quality(score: Column) -> Column:
    return has_valid_structure(score) & (score["overall_score"] > 50) & ~score["is_compressed"]


def is_worth_processing(score: Column) -> Column:
    return (score["overall_score"] > 30) & ~score["is_compressed"]


def needs_deep_scan(density: Column) -> Column:
    return density >= 50.0
