"""Registered queries over the given tables, each with its SQL counterpart."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from nitrapanel.catalog.base import CASES, Case

MODULES = ("sources_and_rows", "aggregates", "windows_and_scalars", "jobs")


def cases() -> dict[str, Case]:
    for name in MODULES:
        import_module(f"nitrapanel.catalog.{name}")
    return dict(CASES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases()["k17_signal"].run(spark, sf_dir)
