"""All registered queries of the library, each a function of tables and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cargolore.plans import evaluation, files, rankings, reference, results, screenings, texts
from cargolore.plans.tables import Tables, sql

_MODULES = (results, texts, rankings, reference, screenings, evaluation, files)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bound(run) for module in _MODULES for name, (run, _) in module.QUERIES.items()}


def _bound(run: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: run(Tables(spark, folder))


def oracle_sql() -> dict[str, str]:
    return {name: sql(text) for module in _MODULES for name, (_, text) in module.QUERIES.items() if text}
