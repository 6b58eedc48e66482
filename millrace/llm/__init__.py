"""Thirteen operations of a training-data pipeline; nothing else in the library imports this subpackage."""

from __future__ import annotations

from . import decontaminate, embedding_join, html_template, jaccard_join, lexical, merkle, packing, pii, quality, secret_scan, sharding, suffix_dedup, warc

MODULES = (embedding_join, pii, html_template, secret_scan, sharding, quality, suffix_dedup, jaccard_join, packing, decontaminate, merkle, warc, lexical)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
