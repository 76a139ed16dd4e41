"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emendata.llm import chat, fingerprints, html_text, jaccard_join, language_id, lines, lm_scoring, mixing, packing, quality, simhash_balls, token_alignment, turn_repair
from emendata.llm.common import ready, table


def _over(run: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(*(table(ready(spark), sf_dir, name) for name in tables))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bm25_packing": _over(packing.pack_rows, "documents"),
        "op2_chunk_fingerprints": _over(fingerprints.fingerprint_rows, "documents"),
        "op3_tree_model_text": _over(html_text.extract_rows, "pages"),
        "op4_schema_chat": _over(chat.chat_rows, "conversations"),
        "op5_poisson_mix": _over(mixing.mix_rows, "documents"),
        "op6_rank_order_language": _over(language_id.language_rows, "documents"),
        "op7_cross_entropy_difference": _over(lm_scoring.score_rows, "documents", "labels"),
        "op8_template_lines": _over(lines.line_rows, "documents"),
        "op9_chosen_path_join": _over(jaccard_join.jaccard_classes, "documents"),
        "op10_distribution_quality": _over(quality.quality_rows, "documents", "labels"),
        "op11_token_alignment": _over(token_alignment.alignment_rows, "documents"),
        "op12_simhash_balls": _over(simhash_balls.simhash_components, "documents"),
        "op13_turn_repair": _over(turn_repair.repair_rows, "conversations"),
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_schema_chat": chat.CHAT_SQL, "op5_poisson_mix": mixing.MIX_SQL, "op8_template_lines": lines.lines_sql(), "op13_turn_repair": turn_repair.REPAIR_SQL}
