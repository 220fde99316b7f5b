"""The queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from . import decontaminate, licenses, line_dedup, lm_score, near_dup, packing, pii, quality, tokens, warc

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_licence_scan": licenses.op2_licence_scan,
    "op3_lm_scores": lm_score.op3_lm_scores,
    "op4_warc_revisits": warc.op4_warc_revisits,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_personal_data": pii.op8_personal_data,
    "op9_token_counts": tokens.op9_token_counts,
    "op10_near_duplicates": near_dup.op10_near_duplicates,
}

SQL = {
    "op4_warc_revisits": warc.OP4_SQL,
    "op6_line_dedup": line_dedup.OP6_SQL,
}
