"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import decontaminate, exact_dedup, hyperminhash, jaccard_join, kd_clusters, language_id, packing, periodic_runs, secret_scan, sharding, substring_dedup, toxicity, url_filter

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_language_id": language_id.op2_language_id,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_packing": packing.op5_packing,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_sharding": sharding.op10_sharding,
    "op11_kd_clusters": kd_clusters.op11_kd_clusters,
    "op12_hyperminhash": hyperminhash.op12_hyperminhash,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}
ORACLE_SQL = {
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op4_url_filter": url_filter.OP4_SQL,
    "op7_jaccard_join": jaccard_join.OP7_SQL,
    "op11_kd_clusters": kd_clusters.OP11_SQL,
    "op12_hyperminhash": hyperminhash.OP12_SQL,
}
