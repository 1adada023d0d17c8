"""All registered queries of the library and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiweave.plans import cache_plans, flow_plans, log_plans, page_plans, rule_plans, scalar_plans, stream_plans, term_plans, tree_plans, unit_plans  # noqa: F401  they register
from lexiweave.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return QUERIES


def oracles() -> dict[str, str]:
    return ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship"](spark, sf_dir)
