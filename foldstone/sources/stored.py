"""Adapter ledgers loaded once per session into position-clustered Parquet, as a log store would hold them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from foldstone.session import prepare, stage, staged_path
from foldstone.sources import adapters

LEDGERS = ("loan", "linked", "rules", "sessions", "lifecycle")

# (application, table, folder) -> where it was written; only paths are remembered.
_LOADED: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def _load(kind: str, build: Callable[[SparkSession, str], DataFrame], spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    key = (spark.sparkContext.applicationId, kind, folder)
    if key not in _LOADED:
        built = build(spark, folder)
        _LOADED[key] = (staged_path(built), built.schema)
    path, schema = _LOADED[key]
    return spark.read.schema(schema).parquet(path)


def loan_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return _load("loan", lambda s, f: adapters.numbered(stage(adapters.loan_ledger(s, f))), spark, folder)


def linked_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return _load("linked", lambda s, f: adapters.linked(loan_ledger(s, f)), spark, folder)


def rule_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return _load("rules", lambda s, f: adapters.numbered(stage(adapters.rule_ledger(s, f))), spark, folder)


def session_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return _load("sessions", adapters.session_ledger, spark, folder)


def lifecycle_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return _load("lifecycle", lambda s, f: adapters.numbered(stage(adapters.lifecycle_ledger(s, f))), spark, folder)


def derived(kind: str, build: Callable[[SparkSession, str], DataFrame], spark: SparkSession, folder: str) -> DataFrame:
    """A table that several queries read, written once per session."""
    return _load(kind, build, spark, folder)


def forget_derived() -> None:
    """Derived tables are built again when next asked for; the loaded ledgers stay."""
    for key in [k for k in _LOADED if k[1] not in LEDGERS]:
        del _LOADED[key]
