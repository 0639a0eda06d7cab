"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, filter_audit, html_text, license_scan, mixing, ngram_join, packing, pii, quality, suffix_dedup, url_rules, warc, whitening


def queries() -> dict:
    return {
        "op1_pii": pii.op1,
        "op2_warc_captures": warc.op2,
        "op3_suffix_dedup": suffix_dedup.op3,
        "op4_decontaminate": decontaminate.op4,
        "op5_mix_sources": mixing.op5,
        "op6_url_rules": url_rules.op6,
        "op7_html_text": html_text.op7,
        "op8_quality_rules": quality.op8,
        "op9_ngram_join": ngram_join.op9,
        "op10_license_scan": license_scan.op10,
        "op11_filter_audit": filter_audit.op11,
        "op12_whitening": whitening.op12,
        "op13_packing": packing.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc_captures": warc.SQL,
        "op4_decontaminate": decontaminate.SQL,
        "op5_mix_sources": mixing.SQL,
        "op6_url_rules": url_rules.SQL,
        "op11_filter_audit": filter_audit.SQL,
    }
