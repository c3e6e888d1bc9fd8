"""Queries of this folder and, where SQL can express them, the same rows as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pivotlake.llm import annforest, chat, collocations, fim, langid, licenses, mixing, neardup, packing, pii, quality, ranker, secrets


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality.op1_quality_rules,
        "op2_near_duplicates": neardup.op2_near_duplicates,
        "op3_language_id": langid.op3_language_id,
        "op4_mix_sources": mixing.op4_mix_sources,
        "op5_secret_scan": secrets.op5_secret_scan,
        "op6_quality_classifier": ranker.op6_quality_classifier,
        "op7_chat_format": chat.op7_chat_format,
        "op8_nearest_neighbours": annforest.op8_nearest_neighbours,
        "op9_pack_sequences": packing.op9_pack_sequences,
        "op10_license_scan": licenses.op10_license_scan,
        "op11_personal_data": pii.op11_personal_data,
        "op12_fill_in_middle": fim.op12_fill_in_middle,
        "op13_collocations": collocations.op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality.ORACLE,
        "op2_near_duplicates": neardup.ORACLE,
        "op4_mix_sources": mixing.ORACLE,
        "op5_secret_scan": secrets.ORACLE,
        "op7_chat_format": chat.ORACLE,
        "op12_fill_in_middle": fim.ORACLE,
        "op13_collocations": collocations.ORACLE,
    }
