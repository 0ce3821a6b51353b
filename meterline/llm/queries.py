"""Queries of the operators and their SQL."""

from __future__ import annotations

from . import decontam, feistel, infill, mixing, packing, probminhash, quality, resampling, secrets, template, tokens, toxicity, warc
from .oracles import ORACLES

QUERIES = {
    "op1_warc_roundtrip": warc.op1_warc_roundtrip,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_probminhash_dedup": probminhash.op3_probminhash_dedup,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_context_mixing": mixing.op5_context_mixing,
    "op6_harmonic_packing": packing.op6_harmonic_packing,
    "op7_string_kernel_toxicity": toxicity.op7_string_kernel_toxicity,
    "op8_suffix_decontamination": decontam.op8_suffix_decontamination,
    "op9_feistel_shards": feistel.op9_feistel_shards,
    "op10_section_tokens": tokens.op10_section_tokens,
    "op11_infill_piece_table": infill.op11_infill_piece_table,
    "op12_importance_resampling": resampling.op12_importance_resampling,
    "op13_template_text": template.op13_template_text,
}
__all__ = ["ORACLES", "QUERIES"]
