"""Names of the registered queries, their plans and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.fixtures import Tables, oracle

Query = Callable[[SparkSession, str], DataFrame]
_PLANS: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of Tables as a query; sql is its twin in DuckDB, where there is one."""

    def keep(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        _PLANS[name] = plan
        if sql:
            _SQL[name] = oracle(sql)
        return plan

    return keep


def _loaded() -> None:
    from tessera.plans import corpus, relational, retrieval, web  # noqa: F401  they register their queries


def queries() -> dict[str, Query]:
    _loaded()
    return {name: (lambda spark, sf_dir, plan=plan: plan(Tables(spark, sf_dir))) for name, plan in _PLANS.items()}


def oracle_sql() -> dict[str, str]:
    _loaded()
    return dict(_SQL)


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: N802
    _loaded()
    return _PLANS["V5_hybrid_search"](Tables(spark, sf_dir))
