"""The queries of the corpus operators, and SQL for those that it can express."""

from __future__ import annotations

from rankweave.llm import byte_bpe, chat_format, decontaminate, html_extract, jaccard_join, line_dedup, lm_score, quality, substring_dedup, token_table

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_byte_bpe": byte_bpe.op5_byte_bpe,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_html_extract": html_extract.op7_html_extract,
    "op8_lm_score": lm_score.op8_lm_score,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_token_table": token_table.op10_token_table,
}

ORACLES = {
    "op3_line_dedup": line_dedup.ORACLE,
    "op4_decontaminate": decontaminate.ORACLE,
    "op6_chat_format": chat_format.ORACLE,
}
