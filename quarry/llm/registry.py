"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, language_id, near_dedup, packing, quality, substring_dedup, suffix_dedup, topk, url_filter, warc

QUERIES = {
    "op1_packing": packing.query,
    "op2_substring_dedup": substring_dedup.query,
    "op3_warc": warc.query,
    "op4_language_id": language_id.query,
    "op5_suffix_dedup": suffix_dedup.query,
    "op6_quality_rules": quality.query,
    "op7_bpe": bpe.query,
    "op8_near_dedup": near_dedup.query,
    "op9_topk": topk.query,
    "op10_url_filter": url_filter.query,
}

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": substring_dedup.ORACLE,
    "op3_warc": warc.ORACLE,
    "op5_suffix_dedup": suffix_dedup.ORACLE,
    "op6_quality_rules": quality.ORACLE,
    "op8_near_dedup": near_dedup.ORACLE,
    "op9_topk": topk.ORACLE,
    "op10_url_filter": url_filter.ORACLE,
}
