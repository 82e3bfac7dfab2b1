"""Document folders, summary files and the outbox sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foldstone.operators.documents import REQUIRED_FILES

# A company's folder is its id, plain or as a partition folder.
COMPANY_OF_PATH = r"/(?:company_id=)?([^/]+)/[^/]+$"


def _company(path: Column) -> Column:
    return F.regexp_extract(path, COMPANY_OF_PATH, 1)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path and length of every document below ``root``; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")


def read_summary_files(spark: SparkSession, paths) -> DataFrame:
    """Rows (company_id, field, value) of summary files in one folder per company."""
    rows = spark.read.option("header", "true").schema("field string, value string, fiscal_year string, currency string").csv(paths)
    return rows.select(_company(F.col("_metadata.file_path")).alias("company_id"), "field", "value", "fiscal_year", "currency")


def document_catalog(files: DataFrame, companies: DataFrame) -> DataFrame:
    """Per known company: number of documents, kinds, and whether all five required files are there."""
    name = F.element_at(F.split("path", "/"), -1)
    listed = files.select(_company(F.col("path")).alias("company_id"), name.alias("name"), "length").distinct()
    kind = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    counted = listed.groupBy("company_id").agg(
        F.count_distinct("name").alias("document_count"), F.count_distinct(F.when(F.col("name").isin(*REQUIRED_FILES), F.col("name"))).alias("_required"),
        F.sort_array(F.collect_set(kind)).alias("kinds"), F.sum("length").alias("total_bytes"),
    )
    return companies.join(counted, "company_id").select(
        *companies.columns, "document_count", "kinds", "total_bytes", (F.col("_required") == len(REQUIRED_FILES)).alias("has_complete_package")
    ).orderBy("company_id")


def write_outbox_jsonl(records: DataFrame, path: str) -> None:
    """Published outbox records as JSON lines."""
    records.write.mode("append").json(path)
