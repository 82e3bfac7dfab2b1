"""Applicant registry reads over companies, financial history, compliance flags and loan relationships."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def companies_by_id(companies: DataFrame, company_ids: DataFrame | Sequence[str]) -> DataFrame:
    if isinstance(company_ids, DataFrame):
        return companies.join(company_ids.select("company_id").distinct(), "company_id", "left_semi")
    return companies.where(F.col("company_id").isin(*company_ids))


def first_by_jurisdiction(companies: DataFrame) -> DataFrame:
    """The company with the lowest id in each jurisdiction."""
    return companies.groupBy("jurisdiction").agg(F.min_by(F.struct(*companies.columns), "company_id").alias("c")).select("c.*")


def financial_history(history: DataFrame, company_ids: Sequence[str] | None = None, years: Sequence[int] | None = None) -> DataFrame:
    rows = history if company_ids is None else history.where(F.col("company_id").isin(*company_ids))
    rows = rows if years is None else rows.where(F.col("fiscal_year").isin(*years))
    return rows.orderBy("company_id", "fiscal_year")


def compliance_flags(flags: DataFrame, company_ids: Sequence[str] | None = None, active_only: bool = False) -> DataFrame:
    rows = flags if company_ids is None else flags.where(F.col("company_id").isin(*company_ids))
    rows = rows.where("is_active") if active_only else rows
    return rows.orderBy("company_id", "added_date", "id")


def loan_relationships(loans: DataFrame, company_ids: Sequence[str] | None = None) -> DataFrame:
    rows = loans if company_ids is None else loans.where(F.col("company_id").isin(*company_ids))
    return rows.orderBy("company_id", "loan_year", "id")


def company_profiles(companies: DataFrame, flags: DataFrame, history: DataFrame, loans: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Company with the signals policy needs from its children; a registry row wins, a seed profile fills absent companies.

    Children stay in their own tables; only counts and flags are attached, so a company with very many of them is safe.
    """
    base = companies.withColumn("source", F.lit("registry"))
    if seeds is not None:
        extra = seeds.join(companies.select("company_id"), "company_id", "left_anti").withColumn("source", F.lit("seed_profiles"))
        base = base.unionByName(extra, allowMissingColumns=True)
    flagged = flags.groupBy("company_id").agg(F.count_if("is_active").alias("active_flags"), F.count("*").alias("flags"))
    years = history.groupBy("company_id").agg(F.count("*").alias("fiscal_years"), F.max("fiscal_year").alias("latest_year"))
    lent = loans.groupBy("company_id").agg(F.bool_or("default_occurred").alias("has_default"), F.count("*").alias("prior_loans"))
    joined = base.join(flagged, "company_id", "left").join(years, "company_id", "left").join(lent, "company_id", "left")
    return joined.fillna(0, ["active_flags", "flags", "fiscal_years", "prior_loans"]).fillna(False, ["has_default"])
