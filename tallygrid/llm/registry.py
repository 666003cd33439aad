"""The numbered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallygrid.llm import chat_format, decontaminate, fingerprints, lexical_search, license_scan, lm_scoring, mixing, near_dedup, prefix_trie, quality, sharding, token_counts, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        sharding.op1_sharding,
        token_counts.op2_token_counts,
        decontaminate.op3_decontaminate,
        quality.op4_quality,
        license_scan.op5_license_scan,
        mixing.op6_mixing,
        toxicity.op7_toxicity,
        fingerprints.op8_fingerprints,
        lm_scoring.op9_lm_scoring,
        near_dedup.op10_near_dedup,
        chat_format.op11_chat_format,
        lexical_search.op12_lexical_search,
        prefix_trie.op13_prefix_trie,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_sharding": sharding.ORACLE,
        "op3_decontaminate": decontaminate.ORACLE,
        "op5_license_scan": license_scan.ORACLE,
        "op6_mixing": mixing.ORACLE,
        "op11_chat_format": chat_format.ORACLE,
        "op12_lexical_search": lexical_search.ORACLE,
        "op13_prefix_trie": prefix_trie.ORACLE,
    }
