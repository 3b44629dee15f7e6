"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import exact_dedup, language_id, license_scan, minhash, mixing, order_minhash, packing, quality_rules, spelling, suffix_blocks, token_counts, token_ids, vector_codes

_MODULES = (token_ids, license_scan, packing, exact_dedup, token_counts, suffix_blocks, language_id, quality_rules, mixing, minhash, order_minhash, vector_codes, spelling)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in _MODULES for name, f in vars(module).items() if name.startswith(("op", "llm_")) and callable(f) and getattr(f, "__module__", "") == module.__name__}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in getattr(module, "SQL", {}).items()}
