"""Queries and SQL of this subpackage."""

from __future__ import annotations

from . import centroids, chat, decontaminate, jaccard_join, language_id, line_dedup, lm_score, matroska, packing, quality, slack_packing, token_counts, turn_repair

_QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_chat": chat.op6_chat,
    "op7_quality": quality.op7_quality,
    "op10_packing": packing.op10_packing,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_matroska": matroska.op3_matroska,
    "op8_lm_score": lm_score.op8_lm_score,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op11_turn_repair": turn_repair.op11_turn_repair,
    "op12_centroids": centroids.op12_centroids,
    "op13_slack_packing": slack_packing.op13_slack_packing,
}
_SQL: dict[str, str] = {
    "op5_jaccard_join": jaccard_join.OP5_SQL,
    "op6_chat": chat.OP6_SQL,
    "op8_lm_score": lm_score.OP8_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
    "op11_turn_repair": turn_repair.OP11_SQL,
    "op12_centroids": centroids.OP12_SQL,
}


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_SQL)
