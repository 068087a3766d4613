"""The corpus operators' queries: each applies its operator to its whole table."""

from __future__ import annotations

from siltstone.llm.collocations import OP11_SQL, op11_collocations
from siltstone.llm.decontaminate import op7_decontaminate
from siltstone.llm.filter_audit import OP12_SQL, op12_filter_audit
from siltstone.llm.html_text import op10_html_text
from siltstone.llm.line_dedup import OP3_SQL, op3_line_dedup
from siltstone.llm.mixing import op5_mixing
from siltstone.llm.near_dedup import OP1_SQL, op1_near_dedup
from siltstone.llm.quality_classifier import op2_quality_classifier
from siltstone.llm.quality_rules import OP9_SQL, op9_quality_rules
from siltstone.llm.sharding import op6_sharding
from siltstone.llm.token_counts import op8_token_counts
from siltstone.llm.toxicity import op13_toxicity
from siltstone.llm.url_rules import op4_url_rules

QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_line_dedup": op3_line_dedup,
    "op4_url_rules": op4_url_rules,
    "op5_mixing": op5_mixing,
    "op6_sharding": op6_sharding,
    "op7_decontaminate": op7_decontaminate,
    "op8_token_counts": op8_token_counts,
    "op9_quality_rules": op9_quality_rules,
    "op10_html_text": op10_html_text,
    "op11_collocations": op11_collocations,
    "op12_filter_audit": op12_filter_audit,
    "op13_toxicity": op13_toxicity,
}
ORACLES: dict[str, str] = {
    "op1_near_dedup": OP1_SQL,
    "op3_line_dedup": OP3_SQL,
    "op9_quality_rules": OP9_SQL,
    "op11_collocations": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
}
