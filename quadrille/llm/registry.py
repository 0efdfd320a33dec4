"""The queries of the subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from quadrille.llm.bpe import op4_bpe
from quadrille.llm.chat import OP2_SQL, op2_chat_format
from quadrille.llm.html_extract import op9_html_extraction
from quadrille.llm.license_scan import OP3_SQL, op3_license_scan
from quadrille.llm.lm import op8_lm_scoring
from quadrille.llm.media import op5_media_columns
from quadrille.llm.mixing import OP7_SQL, op7_pareto_mix
from quadrille.llm.quality import op1_quality_rules
from quadrille.llm.simhash import op6_simhash_dedup
from quadrille.llm.url_filter import OP10_SQL, op10_url_filter

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_chat_format": op2_chat_format,
    "op3_license_scan": op3_license_scan,
    "op4_bpe": op4_bpe,
    "op5_media_columns": op5_media_columns,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_pareto_mix": op7_pareto_mix,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_html_extraction": op9_html_extraction,
    "op10_url_filter": op10_url_filter,
}

ORACLES = {
    "op2_chat_format": OP2_SQL,
    "op3_license_scan": OP3_SQL,
    "op7_pareto_mix": OP7_SQL,
    "op10_url_filter": OP10_SQL,
}
