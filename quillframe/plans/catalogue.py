"""Every core query and the SQL that has to give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillframe.plans import audits, evaluation, layout, merges, planning, relational, reviews, validation

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
for _module in (relational, validation, layout, evaluation, audits, planning, reviews, merges):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
