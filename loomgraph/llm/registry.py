"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, jaccard, language, lines, packing, quality, tokens, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_jaccard": jaccard.op2_jaccard,
        "op3_language": language.op3_language,
        "op4_warc": warc.op4_warc,
        "op5_quality": quality.op5_quality,
        "op6_packing": packing.op6_packing,
        "op7_tokens": tokens.op7_tokens,
        "op8_chat": chat.op8_chat,
        "op9_lines": lines.op9_lines,
        "op10_decontaminate": decontaminate.op10_decontaminate,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard": jaccard.OP2_SQL, "op10_decontaminate": decontaminate.OP10_SQL, "op4_warc": warc.OP4_SQL, "op8_chat": chat.OP8_SQL}
