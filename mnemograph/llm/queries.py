"""The subpackage's queries: name -> (spark, sf_dir) -> DataFrame, and SQL where SQL can express them."""

from __future__ import annotations

from . import cdc_dedup, collocations, hard_negatives, jpeg_media, line_dedup, mixing, ngram_join, packing, pii, quality, repeats, token_store, toxicity

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.op1,
    "op2_token_store": token_store.op2,
    "op3_mix_sources": mixing.op3,
    "op4_quality_rules": quality.op4,
    "op5_pack_buckets": packing.op5,
    "op6_jpeg_media": jpeg_media.op6,
    "op7_toxicity": toxicity.op7,
    "op8_gear_chunks": cdc_dedup.op8,
    "op9_line_dedup": line_dedup.op9,
    "op10_repeated_strings": repeats.op10,
    "op11_hard_negatives": hard_negatives.op11,
    "op12_personal_data": pii.op12,
    "op13_collocations": collocations.op13,
}

SQL: dict[str, str] = {
    "op4_quality_rules": quality.SQL,
    "op9_line_dedup": line_dedup.SQL,
    "op11_hard_negatives": hard_negatives.SQL,
    "op13_collocations": collocations.SQL,
}
