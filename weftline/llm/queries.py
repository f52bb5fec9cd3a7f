"""Registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from weftline.llm import bpe, decontaminate, jaccard, linededup, lm, pii, quality, sharding, substring, topk


def queries() -> dict:
    found = [topk.op1_exact_topk, linededup.op2_line_dedup, quality.op3_quality, bpe.op4_bpe, substring.op5_substring_dedup, sharding.op6_sharding, decontaminate.op7_decontamination, pii.op8_pii, lm.op9_lm_scoring, jaccard.op10_jaccard_join]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_topk": topk.SQL, "op2_line_dedup": linededup.SQL, "op5_substring_dedup": substring.SQL, "op7_decontamination": decontaminate.SQL, "op10_jaccard_join": jaccard.SQL}
