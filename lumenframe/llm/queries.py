"""The queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from lumenframe.llm import ctw, decontam, html, licenses, lines, mixing, neardup, secrets, topk
from lumenframe.llm.quality import op6_quality_discriminant

QUERIES = {
    "op1_context_tree_weighting": ctw.op1_context_tree_weighting,
    "op2_composite_text_density": html.op2_composite_text_density,
    "op3_fuzzy_license_notices": licenses.op3_fuzzy_license_notices,
    "op4_bit_sliced_topk": topk.op4_bit_sliced_topk,
    "op5_line_segment_join": lines.op5_line_segment_join,
    "op6_quality_discriminant": op6_quality_discriminant,
    "op8_superminhash_dedup": neardup.op8_superminhash_dedup,
    "op9_assignment_secrets": secrets.op9_assignment_secrets,
    "op10_suffix_array_decontamination": decontam.op10_suffix_array_decontamination,
    "op7_systematic_mixing": mixing.op7_systematic_mixing,
}
ORACLE_SQL: dict[str, str] = {
    "op4_bit_sliced_topk": topk.ORACLE,
    "op5_line_segment_join": lines.ORACLE,
    "op7_systematic_mixing": mixing.ORACLE,
    "op10_suffix_array_decontamination": decontam.ORACLE,
}
