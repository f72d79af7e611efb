"""The subpackage's queries and their SQL, for the driver's entry module."""

from __future__ import annotations

import corpus_pipeline
from hyperweave.llm import jaccard_join, language_id, license_scan, mixing, multi_index, packing, pii, quality_gam, quality_rules, url_filter

QUERIES = {
    "op1_vector_packing": packing.op1_vector_packing,
    "op2_poisson_mixing": mixing.op2_poisson_mixing,
    "op3_jaccard_join": jaccard_join.op3_jaccard_join,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_language_id": language_id.op5_language_id,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_pii_boosting": pii.op8_pii_boosting,
    "op9_quality_gam": quality_gam.op9_quality_gam,
    "op10_multi_index": multi_index.op10_multi_index,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op2_poisson_mixing": mixing.OP2_SQL,
    "op3_jaccard_join": jaccard_join.OP3_SQL,
    "op4_url_filter": url_filter.OP4_SQL,
    "op6_license_scan": license_scan.OP6_SQL,
}
