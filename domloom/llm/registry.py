"""The queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from . import bradley_terry, compression_rules, lm, minhash, mixing, packing, pii, planes, topk, toxicity

QUERIES = {
    "op1_quality": bradley_terry.op1_quality,
    "op2_minhash": minhash.op2_minhash,
    "op3_pii": pii.op3_pii,
    "op4_compression_rules": compression_rules.op4_compression_rules,
    "op5_planes": planes.op5_planes,
    "op6_lm": lm.op6_lm,
    "op7_mixing": mixing.op7_mixing,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_packing": packing.op9_packing,
    "op10_topk": topk.op10_topk,
}

ORACLES = {
    "op2_minhash": minhash.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op10_topk": topk.ORACLE,
}
