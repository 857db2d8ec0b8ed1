"""All table queries of the byte-similarity engine, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import files
from . import queries as q
from .oracle import ORACLE_SQL as ORACLE_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        q.slots_decode,
        q.ngram_total_count,
        q.normalize_documents,
        q.normalize_streams,
        q.normalize_native,
        q.normalize_documents_native,
        q.ngrams_distinct,
        q.ngram_count,
        q.normalized_ngram_count,
        q.minhash_signature,
        q.simhash,
        q.fingerprint_documents,
        q.fingerprint_native,
        q.jaccard_exact_pairs,
        q.jaccard_estimate_pairs,
        q.document_pairs,
        q.compare_report,
        q.tier_counts,
        q.lsh_buckets,
        q.lsh_candidates,
        q.lsh_query,
        q.exact_query,
        q.cluster_summary,
        q.cluster_documents,
        q.cluster_document_summary,
        q.lsh_documents,
        q.batch_compare,
        q.one_against_every,
        q.register_lookup,
        q.empty_programs,
        q.catalog_upsert,
        q.catalog_merge,
        q.catalog_lookup,
        q.compare_stored,
        q.basket_jaccard,
    )
} | files.QUERIES
