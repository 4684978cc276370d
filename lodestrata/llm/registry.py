"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import chat, decontaminate, filter_audit, ngram_join, packing, quality, secrets, spelling, substring_dedup, suffix_array, token_files, toxicity, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "op1_toxicity": toxicity.op1,
        "op2_ngram_join": ngram_join.op2,
        "op3_token_files": token_files.op3,
        "op4_decontaminate": decontaminate.op4,
        "op5_chat": chat.op5,
        "op6_urls": urls.op6,
        "op7_pack": packing.op7,
        "op8_quality": quality.op8,
        "op9_secrets": secrets.op9,
        "op10_substring_dedup": substring_dedup.op10,
        "op11_suffix_array": suffix_array.op11,
        "op12_spelling": spelling.op12,
        "op13_filter_audit": filter_audit.op13,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_decontaminate": decontaminate.OP4_SQL,
        "op10_substring_dedup": substring_dedup.OP10_SQL,
        "op2_ngram_join": ngram_join.OP2_SQL,
        "op5_chat": chat.OP5_SQL,
        "op6_urls": urls.OP6_SQL,
        "op9_secrets": secrets.OP9_SQL,
        "op11_suffix_array": suffix_array.OP11_SQL,
        "op12_spelling": spelling.OP12_SQL,
        "op13_filter_audit": filter_audit.OP13_SQL,
    }
