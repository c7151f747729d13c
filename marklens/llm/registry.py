"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import fim, harmonic, media, packing, pieces, quality, sharding, simhash, suffix, tokens, toxicity, warc, whitening


def queries() -> dict:
    return {
        "op1_training_order": tokens.query,
        "op2_ogg_media": media.query,
        "op3_suffix_dedup": suffix.query,
        "op4_host_rules": quality.query,
        "op5_best_fit_packing": packing.query,
        "op6_sentencepiece": pieces.query,
        "op7_warc_index": warc.query,
        "op8_hypergeometric_shards": sharding.query,
        "op9_simhash_anchors": simhash.query,
        "op10_toxicity_fm": toxicity.query,
        "op11_qdwh_whitening": whitening.query,
        "op12_fill_in_middle": fim.query,
        "op13_harmonic_packing": harmonic.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_host_rules": quality.SQL, "op12_fill_in_middle": fim.SQL}
