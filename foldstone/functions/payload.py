"""Reading JSON payloads: one parse per row, text leaves, casts that return null instead of failing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def with_fields(df: DataFrame, *fields: str, source: str = "payload", into: str = "p") -> DataFrame:
    """Parse ``source`` once into struct ``into``. A field is ``name`` (kept as text) or ``name <ddl type>``."""
    ddl = ", ".join(f if " " in f else f"{f} string" for f in fields)
    return df.withColumn(into, F.from_json(F.col(source), ddl))


def money(text: Column, precision: int = 18, scale: int = 2) -> Column:
    return text.try_cast(f"decimal({precision},{scale})")


def truthy(text: Column) -> Column:
    """JSON truth of a text leaf: null, false, 0, empty text and empty containers are false."""
    return F.coalesce(~F.lower(F.trim(text)).isin("", "false", "0", "0.0", "[]", "{}", "null"), F.lit(False))


def filled(text: Column) -> Column:
    """Null where the text is empty, so that coalesce acts like a fallback on falsy values."""
    return F.nullif(text, F.lit(""))


def instant(text: Column) -> Column:
    """ISO text to timestamp; a blank before the zone offset is read as the plus sign it once was."""
    repaired = F.regexp_replace(F.trim(text), r" (\d{2}:\d{2})$", "+$1")
    return repaired.try_cast("timestamp")


def merged(base: Column, overlay: Column) -> Column:
    """Two JSON objects as one; fields of ``overlay`` win. Values keep their JSON types."""
    low = F.from_json(F.coalesce(base, F.lit("{}")), "map<string,variant>")
    high = F.from_json(F.coalesce(overlay, F.lit("{}")), "map<string,variant>")
    kept = F.map_filter(low, lambda k, v: ~F.array_contains(F.map_keys(high), k))
    return F.to_json(F.map_concat(kept, high))


def without_fields(base: Column, *names: str) -> Column:
    doc = F.from_json(F.coalesce(base, F.lit("{}")), "map<string,variant>")
    return F.to_json(F.map_filter(doc, lambda k, v: ~k.isin(*names)))
