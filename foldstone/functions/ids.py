"""Stream names: family, aggregate type, owning application."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from foldstone.schema import AGGREGATE_TYPES, APPLICATION_FAMILIES, ENTITY_FAMILIES


def stream_family(stream_id: Column | str = "stream_id") -> Column:
    return F.split_part(_col(stream_id), F.lit("-"), F.lit(1))


def aggregate_type(stream_id: Column | str = "stream_id") -> Column:
    """Known prefixes map to their aggregate; any other prefix is title-cased."""
    family = stream_family(stream_id)
    known = F.create_map(*[F.lit(x) for pair in AGGREGATE_TYPES.items() for x in pair])
    return F.coalesce(known[family], F.initcap(family))


def stream_owner(stream_id: Column | str = "stream_id") -> Column:
    """The application named by a loan, credit, fraud, compliance or package stream; null for other streams."""
    pattern = "^(?:" + "|".join(APPLICATION_FAMILIES) + ")-(.*)$"
    sid = _col(stream_id)
    return F.when(sid.rlike(pattern), F.regexp_extract(sid, pattern, 1))


def package_owner(package_id: Column) -> Column:
    return F.regexp_replace(package_id, "^docpkg-", "")


def source_stream(entity_type: Column, entity_id: Column) -> Column:
    """Stream audited for an entity; agent ids that already are stream ids stay as they are."""
    plain = F.lower(F.regexp_replace(entity_type, "[-_]", ""))
    known = F.create_map(*[F.lit(x) for pair in ENTITY_FAMILIES.items() for x in pair])
    family = F.coalesce(known[plain], entity_type)
    return F.when((family == "agent") & entity_id.startswith("agent-"), entity_id).otherwise(
        F.concat_ws("-", family, entity_id)
    )


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
