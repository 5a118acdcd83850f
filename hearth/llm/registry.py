"""Queries of the training-data operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hearth.llm import (
    ann, chat, html, lines, nbest, negatives, packing, quality, repair, rotcodes, sharding, simhash, tokenids)

MODULES = (html, chat, lines, simhash, sharding, nbest, quality, packing, ann, tokenids, negatives, rotcodes,
           repair)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
