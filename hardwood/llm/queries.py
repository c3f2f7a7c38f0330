"""The registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from hardwood.llm import audit, fingerprints, hmm, importance, jaccard, mixing, pieces, quality, sharding, topk, urls, warc

QUERIES = {
    "op1_consistent_hash_shards": sharding.op1_consistent_hash_shards,
    "op2_url_filter": urls.op2_url_filter,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_jaccard_join": jaccard.op4_jaccard_join,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_warc_round_trip": warc.op7_warc_round_trip,
    "op8_lempel_ziv_fingerprints": fingerprints.op8_lempel_ziv_fingerprints,
    "op9_hmm_language_model": hmm.op9_hmm_language_model,
    "op10_quality_classifier": quality.op10_quality_classifier,
    "op11_exact_top_k": topk.op11_exact_top_k,
    "op12_filter_audit": audit.op12_filter_audit,
    "op13_importance_resampling": importance.op13_importance_resampling,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {"op5_mix_sources": mixing.OP5_SQL, "op11_exact_top_k": topk.OP11_SQL, "op12_filter_audit": audit.OP12_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
