"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, langid, linededup, maxent, media, packing, quality, simhash, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": warc.op1_warc,
        "op2_quality": quality.op2_quality,
        "op3_lm_score": maxent.op3_lm_score,
        "op4_chat_format": chat.op4_chat_format,
        "op5_language_id": langid.op5_language_id,
        "op6_decontamination": decontaminate.op6_decontamination,
        "op7_media_columns": media.op7_media_columns,
        "op8_line_dedup": linededup.op8_line_dedup,
        "op9_simhash": simhash.op9_simhash,
        "op10_packing": packing.op10_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": warc.SQL, "op6_decontamination": decontaminate.SQL, "op8_line_dedup": linededup.SQL}
