"""The subpackage's registered queries and their DuckDB twins."""

from __future__ import annotations

import corpus_pipeline

from . import decontamination, license_scan, mixing, quality_classifier, quality_rules, secret_scan, simhash_dedup, substring_dedup, url_filters, warc

QUERIES = (
    quality_rules.op1_quality_rules,
    secret_scan.op2_secret_scan,
    warc.op3_warc,
    mixing.op4_mix_sources,
    simhash_dedup.op5_simhash_dedup,
    license_scan.op6_license_scan,
    decontamination.op7_decontaminate,
    quality_classifier.op8_quality_classifier,
    substring_dedup.op9_substring_dedup,
    url_filters.op10_url_filters,
)


def queries():
    return {f.__name__: f for f in QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    """Boosted trees, Hamming components, SimHash windows, networks and rolling hashes have none: tests hold them against brute force."""
    return {"op2_secret_scan": secret_scan.SQL, "op3_warc": warc.SQL, "op4_mix_sources": mixing.SQL, "op6_license_scan": license_scan.SQL, "op10_url_filters": url_filters.SQL}
