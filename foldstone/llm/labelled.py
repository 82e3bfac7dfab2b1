"""Bounded samples of labelled documents for training, and the split into learned and held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; rows without an id have remainder 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts, F.lit(0))


def labelled_texts(documents: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, per_class: int, max_chars: int) -> tuple[DataFrame, float]:
    """(doc_id, text, y) with labels 0/1, and the share of label 1 among all learnable labels.

    Only rows whose remainder is not ``held_out`` are looked at. Of each class the ``per_class`` ids with the smallest hashes
    are taken, of their documents those of at most ``max_chars`` characters, so the sample has at most
    2 * per_class * max_chars characters. Labels that are null or neither 0 nor 1 are not used; of repeated labels the larger counts.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (remainder(parts) != held_out))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    n, ones = usable.agg(F.count("*"), F.sum("y")).first()
    order = F.xxhash64("doc_id")
    chosen = usable.where("y = 1").orderBy(order, "doc_id").limit(per_class).unionByName(usable.where("y = 0").orderBy(order, "doc_id").limit(per_class))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.where((F.length("text") > 0) & (F.length("text") <= max_chars)).orderBy("doc_id", "text").limit(2 * per_class)
    return rows, (ones or 0) / n if n else 0.0


def training_sample(documents: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, per_class: int, max_chars: int) -> tuple[list[tuple[str, int]], float]:
    """The rows of ``labelled_texts`` as (text, label), on the driver."""
    rows, share = labelled_texts(documents, labels, label, parts, held_out, per_class, max_chars)
    return [(r[0], r[1]) for r in rows.orderBy("doc_id", "text").select("text", "y").collect()], share
