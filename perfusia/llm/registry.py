"""The opN_<name> queries of this subpackage and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from perfusia.llm import chat_format, decontaminate, language_id, negatives, neighbours, packing, quality, repeats, resample, simhash, toxicity, vantage, warc

_MODULES = (repeats, neighbours, quality, packing, language_id, warc, simhash, chat_format, toxicity, decontaminate, negatives, vantage, resample)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in _MODULES for name, text in getattr(module, "ORACLES", {}).items()}
