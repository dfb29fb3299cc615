"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import ann, chat, divergence, langid, mixing, ngram_join, odd_sketch, quality_mil, quality_rules, resample, sentencepiece_fst, token_files, warc

QUERIES = {
    "op1_warc_round_trip": warc.op1_warc_round_trip,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_sentencepiece": sentencepiece_fst.op3_sentencepiece,
    "op4_token_files": token_files.op4_token_files,
    "op5_ngram_join": ngram_join.op5_ngram_join,
    "op6_nearest_neighbours": ann.op6_nearest_neighbours,
    "op7_quality_mil": quality_mil.op7_quality_mil,
    "op8_preference_pairs": chat.op8_preference_pairs,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_language_id": langid.op10_language_id,
    "op11_minhash_dedup": odd_sketch.op11_minhash_dedup,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_importance_resampling": resample.op13_importance_resampling,
}

ORACLE = {
    "op1_warc_round_trip": warc.OP1_SQL,
    "op2_quality_rules": quality_rules.OP2_SQL,
    "op5_ngram_join": ngram_join.OP5_SQL,
    "op8_preference_pairs": chat.OP8_SQL,
    "op9_mix_sources": mixing.OP9_SQL,
    "op11_minhash_dedup": odd_sketch.OP11_SQL,
    "op12_source_divergence": divergence.OP12_SQL,
    "op13_importance_resampling": resample.OP13_SQL,
}
