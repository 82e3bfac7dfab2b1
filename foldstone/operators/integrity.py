"""Tamper checks over hash chains, and the audit streams that record them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from foldstone.functions import ids, payload as P
from foldstone.functions.digest import TREE, Tree, chain_digest, event_digest, ordered_digest, prefix_digests
from foldstone.functions.mountain import RANGE, Range, differing, grown, leaves, peaks, roots
from foldstone.operators.scan import before, running
from foldstone.schema import LEDGER_COLUMNS
from foldstone.session import stage

CHECK = "AuditIntegrityCheckRun"
NOT_RISING, BROKEN_LINK = "positions must be strictly increasing", "previous_hash does not match the prior integrity hash"


def event_digests(ledger: DataFrame, digest: Column | None = None) -> DataFrame:
    return ledger.select("stream_id", "stream_position", (digest if digest is not None else event_digest(ledger)).alias("event_hash"))


def parsed_checks(ledger: DataFrame) -> DataFrame:
    """Audit events with typed columns."""
    rows = P.with_fields(
        ledger.where(F.col("event_type") == CHECK), "entity_type", "entity_id", "check_timestamp", "events_verified_count", "integrity_hash",
        "previous_hash", "chain_valid", "tamper_detected",
    )
    return rows.select(
        F.col("stream_id").alias("audit_stream_id"), "event_id", "stream_position", "global_position", "recorded_at",
        F.col("p.entity_type").alias("entity_type"), F.col("p.entity_id").alias("entity_id"),
        F.coalesce(P.instant(F.col("p.check_timestamp")), F.col("recorded_at")).alias("check_timestamp"),
        F.coalesce(F.col("p.events_verified_count").try_cast("bigint"), F.lit(0)).alias("events_verified_count"),
        F.col("p.integrity_hash").alias("integrity_hash"), F.col("p.previous_hash").alias("previous_hash"),
        P.truthy(F.col("p.chain_valid")).alias("chain_valid"), P.truthy(F.col("p.tamper_detected")).alias("tamper_detected"),
    )


def integrity_checks(ledger: DataFrame, entities: DataFrame, audit_events: DataFrame | None, at: Column, digest: Column | None = None, tree: Tree = TREE) -> DataFrame:
    """Run one check per entity (entity_type, entity_id) and return its result.

    The previous check of an entity is recomputed over the events it covered. A mismatch, or a previous check that was
    already flagged, makes the chain invalid from then on.
    """
    asked = entities.select("entity_type", "entity_id").distinct().select(
        "*", ids.source_stream(F.col("entity_type"), F.col("entity_id")).alias("stream_id"), F.concat_ws("-", F.lit("audit"), "entity_type", "entity_id").alias("audit_stream_id")
    )
    hashed = stage(event_digests(ledger, digest).join(asked.select("stream_id").distinct(), "stream_id", "left_semi"))
    whole = ordered_digest(hashed, ["stream_id"], "stream_position", "event_hash", "stream_hash", tree)
    sizes = hashed.groupBy("stream_id").agg(F.count("*").alias("events_verified"))
    result = asked.join(whole.join(sizes, "stream_id"), "stream_id", "left")
    if audit_events is not None:
        checks = parsed_checks(audit_events)
        last = checks.groupBy("audit_stream_id").agg(
            F.max_by(F.struct("events_verified_count", "integrity_hash", "previous_hash", "tamper_detected", "stream_position"), F.col("stream_position")).alias("prior")
        )
        last = stage(last)
        probes = asked.join(last, "audit_stream_id").select("stream_id", F.col("prior.events_verified_count").alias("n"), F.col("audit_stream_id").alias("probe_id"))
        recomputed = prefix_digests(hashed, ["stream_id"], "stream_position", "event_hash", probes, "n", "prefix_hash", tree).withColumnRenamed("probe_id", "audit_stream_id")
        result = result.join(last, "audit_stream_id", "left").join(recomputed, "audit_stream_id", "left")
    else:
        result = result.withColumn("prior", F.lit(None).cast(
            "struct<events_verified_count:bigint,integrity_hash:string,previous_hash:string,tamper_detected:boolean,stream_position:bigint>"
        )).withColumn("prefix_hash", F.lit(None).cast("string"))
    matches = chain_digest(F.col("prior.previous_hash"), F.col("prefix_hash")) == F.col("prior.integrity_hash")
    valid = F.col("prior").isNull() | (F.coalesce(matches, F.lit(False)) & ~F.col("prior.tamper_detected"))
    return result.select(
        "entity_type", "entity_id", F.col("stream_id").alias("source_stream_id"), "audit_stream_id", F.coalesce("events_verified", F.lit(0)).alias("events_verified"),
        chain_digest(F.col("prior.integrity_hash"), F.col("stream_hash")).alias("integrity_hash"), F.col("prior.integrity_hash").alias("previous_hash"),
        valid.alias("chain_valid"), (~valid).alias("tamper_detected"), (F.coalesce("prior.stream_position", F.lit(0)) + 1).alias("check_stream_position"), at.alias("check_timestamp"),
    )


@dataclass(frozen=True)
class RangeCheck:
    """``results``: stream_id, verified, root, previous_root, consistent, hashed; ``nodes``: those to append to the kept ones."""

    results: DataFrame
    nodes: DataFrame


def range_check(ledger: DataFrame, nodes: DataFrame | None = None, previous: DataFrame | None = None, digest: Column | None = None, shape: Range = RANGE) -> RangeCheck:
    """Extend the hash range of every stream by the events that came since ``previous`` (stream_id, verified, root).

    Only those events are hashed, whatever the streams' lengths; of the kept ``nodes`` only the peaks are read. A stream is
    consistent if its kept peaks still give the root of the last check, so the new root proves that the old events are its
    beginning. Whether the stored events still are what was hashed is what ``tampered_events`` looks at.
    """
    by = ["stream_id"]
    fresh = ledger.select(*by, "stream_position", (digest if digest is not None else event_digest(ledger)).alias("event_hash"))
    if previous is not None:
        fresh = fresh.join(previous.select(*by, F.col("verified").alias("_known")), by, "left").where("_known is null or stream_position > _known").drop("_known")
    fresh = stage(fresh)
    before_peaks = stage(peaks(nodes, previous, by, "verified", shape)) if previous is not None else None
    made = stage(grown(leaves(fresh, by, "stream_position", "event_hash"), before_peaks, by, shape))
    added = fresh.groupBy(*by).agg(F.count("*").alias("hashed"))
    known = previous.select(*by, F.col("verified").alias("_known"), F.col("root").alias("previous_root")) if previous is not None else added.select(*by, F.lit(0).cast("bigint").alias("_known"), F.lit(None).cast("string").alias("previous_root")).limit(0)
    counts = known.join(added, by, "full").select(*by, F.coalesce("hashed", F.lit(0)).cast("bigint").alias("hashed"), "_known", "previous_root")
    counts = stage(counts.withColumn("verified", F.coalesce("_known", F.lit(0)) + F.col("hashed")))
    present = made if before_peaks is None else made.unionByName(before_peaks.select(*made.columns))
    found = counts.join(roots(peaks(present, counts, by, "verified", shape), counts, by, "verified", "root").select(*by, "root"), by)
    if previous is not None:
        again = roots(before_peaks, previous, by, "verified", "_again").select(*by, "_again")
        found = found.join(again, by, "left")
    else:
        found = found.withColumn("_again", F.lit(None).cast("string"))
    consistent = F.col("previous_root").isNull() | F.coalesce(F.col("_again") == F.col("previous_root"), F.lit(False))
    return RangeCheck(found.select(*by, "verified", "root", "previous_root", consistent.alias("consistent"), "hashed"), made)


def tampered_events(ledger: DataFrame, nodes: DataFrame, digest: Column | None = None, shape: Range = RANGE) -> DataFrame:
    """(stream_id, stream_position, problem, recorded_hash, found_hash) of events that are not what was hashed, or are gone."""
    now = ledger.select("stream_id", "stream_position", (digest if digest is not None else event_digest(ledger)).alias("event_hash"))
    recomputed = stage(grown(leaves(now, ["stream_id"], "stream_position", "event_hash"), None, ["stream_id"], shape))
    wrong = differing(nodes, recomputed, ["stream_id"], shape)
    problem = F.when(F.col("found").isNull(), F.lit("missing")).otherwise(F.lit("changed"))
    return wrong.select("stream_id", (F.col("idx") + 1).alias("stream_position"), problem.alias("problem"), F.col("digest").alias("recorded_hash"), F.col("found").alias("found_hash"))


def check_events(results: DataFrame, first_global_position: int) -> DataFrame:
    """Results as audit events, one per audit stream, to be appended to the log."""
    from foldstone.operators.scan import number_rows

    keyed = results.withColumn("_order", F.xxhash64("audit_stream_id"))
    numbered = number_rows(keyed, [], "_order", "_g", ties=["audit_stream_id"], block=F.shiftright("_order", 44))
    body = F.to_json(F.struct(
        "entity_type", "entity_id", F.date_format("check_timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("check_timestamp"),
        F.col("events_verified").alias("events_verified_count"), "integrity_hash", "previous_hash", "chain_valid", "tamper_detected",
    ), {"ignoreNullFields": "false"})
    return numbered.select(
        F.sha2(F.concat_ws("/", "audit_stream_id", F.col("check_stream_position").cast("string")), 256).alias("event_id"),
        F.col("audit_stream_id").alias("stream_id"), F.col("check_stream_position").alias("stream_position"), (F.col("_g") + first_global_position - 1).alias("global_position"),
        F.lit(CHECK).alias("event_type"), F.lit(1).alias("event_version"), body.alias("payload"), F.lit("{}").alias("metadata"), F.col("check_timestamp").alias("recorded_at"),
    ).select(*LEDGER_COLUMNS)


def audit_ledgers(audit_events: DataFrame) -> DataFrame:
    """Per audit stream: latest hashes and flags, latest check time, and whether the stream is append-only and linked."""
    checks = stage(parsed_checks(audit_events))
    seen = running(checks, ["audit_stream_id"], "stream_position", {
        "_prev": before(F.struct("stream_position", "global_position", "integrity_hash")),
    }, ties=["global_position"])
    prev = F.col("_prev")
    rising = prev.isNull() | ((F.col("stream_position") > prev["stream_position"]) & (F.col("global_position") > prev["global_position"]))
    linked = prev.isNull() | F.col("previous_hash").eqNullSafe(prev["integrity_hash"])
    # A missing hash before a check leaves nothing to compare with.
    follows = prev.isNull() | prev["integrity_hash"].isNull() | linked
    folded = seen.groupBy("audit_stream_id").agg(
        F.max_by(F.struct("integrity_hash", "previous_hash", "chain_valid", "tamper_detected", "check_timestamp", "stream_position"), F.struct("stream_position", "global_position")).alias("s"),
        F.count("*").alias("checks"),
        F.bool_and(rising & follows).alias("append_only"),
        F.min_by(F.when(~rising, F.lit(NOT_RISING)).otherwise(F.lit(BROKEN_LINK)), F.when(~(rising & linked), F.col("stream_position"))).alias("replay_error"),
    )
    return folded.select(
        "audit_stream_id", "checks", F.col("s.stream_position").alias("version"), F.col("s.integrity_hash").alias("latest_integrity_hash"), "s.previous_hash",
        "s.chain_valid", "s.tamper_detected", F.col("s.check_timestamp").alias("latest_check_timestamp"), "append_only", "replay_error",
    )


def audit_trail(ledger: DataFrame, applications: DataFrame | None = None, from_position: int | None = None, to_position: int | None = None) -> DataFrame:
    """Events of both audit streams of an application, between two stream positions, in (position, time) order."""
    owner = F.regexp_extract("stream_id", "^audit-(?:loan|application)-(.*)$", 1)
    rows = ledger.where(F.col("stream_id").rlike("^audit-(loan|application)-")).withColumn("application_id", owner)
    if applications is not None:
        rows = rows.join(applications.select("application_id").distinct(), "application_id", "left_semi")
    if from_position is not None:
        rows = rows.where(F.col("stream_position") >= from_position)
    if to_position is not None:
        rows = rows.where(F.col("stream_position") <= to_position)
    return rows.orderBy("application_id", "stream_position", "recorded_at")
