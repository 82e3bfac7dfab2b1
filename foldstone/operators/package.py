"""Regulator packages: every application's history, states as of a date, narrative and provenance under one digest.

A package is kept as rows (application_id, section, ordinal, content), so an application with very many events is never
one value; its digest is a tree over the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foldstone.functions import payload as P
from foldstone.functions.digest import canonical_json, chain_digest, ordered_digest, prefix_digests
from foldstone.operators import lineage
from foldstone.operators.agents import agent_performance
from foldstone.operators.compliance import compliance_current
from foldstone.operators.integrity import CHECK
from foldstone.operators.scan import before, number_rows, running
from foldstone.operators.summary import application_summary
from foldstone.schema import ANCHOR_TYPES
from foldstone.session import stage

VERSION = "1.0"
SECTIONS = ("event_stream", "audit_stream", "projection_states", "integrity_verification", "narrative", "agent_model_metadata")
OUTPUTS = ("CreditAnalysisCompleted", "FraudScreeningCompleted", "ComplianceCheckCompleted", "DecisionGenerated")


def envelope() -> Column:
    """Stored event as canonical text; its SHA-256 is the event digest."""
    return F.to_json(F.struct(
        "event_id", "event_type", "event_version", "global_position", canonical_json(F.col("metadata")).alias("metadata"), canonical_json(F.col("payload")).alias("payload"),
        F.unix_micros("recorded_at").alias("recorded_at"), "stream_id", "stream_position",
    ))


def iso_time(at: Column) -> Column:
    """ISO text in UTC; the fraction appears only when there is one."""
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(at, ".SSSSSS")
    return F.concat(whole, F.when(fraction == ".000000", F.lit("")).otherwise(fraction), F.lit("+00:00"))


def narrative_sentence() -> Column:
    """One sentence per event."""
    def field(path: str) -> Column:
        return F.coalesce(F.get_json_object("payload", f"$.{path}"), F.lit("None"))

    t = F.col("event_type")

    def say(*parts) -> Column:
        return F.concat(iso_time(F.col("recorded_at")), F.lit(": "), *[p if isinstance(p, Column) else F.lit(p) for p in parts])

    override = F.when(P.truthy(F.get_json_object("payload", "$.override")), "with override").otherwise("without override")
    return (
        F.when(t == "ApplicationSubmitted", say("Application ", field("application_id"), " was submitted for $", field("requested_amount_usd"), "."))
        .when(t == "CreditAnalysisCompleted", say("Credit analysis completed with risk tier ", field("decision.risk_tier"), " and confidence ", field("decision.confidence"), "."))
        .when(t == "FraudScreeningCompleted", say("Fraud screening completed with score ", field("fraud_score"), "."))
        .when(t == "ComplianceCheckCompleted", say("Compliance review finished with verdict ", field("overall_verdict"), "."))
        .when(t == "DecisionGenerated", say("The orchestrator recommended ", field("recommendation"), " with confidence ", field("confidence"), "."))
        .when(t == "HumanReviewCompleted", say("Human review ended ", override, "; final decision was ", field("final_decision"), "."))
        .when(t == "ApplicationApproved", say("The application was approved for $", field("approved_amount_usd"), "."))
        .when(t == "ApplicationDeclined", say("The application was declined."))
        .when(t.isin(*ANCHOR_TYPES), say("Agent session ", field("session_id"), " started for ", field("agent_type"), "."))
        .otherwise(say(t, " was recorded."))
    )


def model_provenance(related: DataFrame) -> DataFrame:
    """Model and session behind each output event of an application."""
    parsed = P.with_fields(
        related.where(F.col("event_type").isin(*ANCHOR_TYPES, *OUTPUTS)), "application_id", "session_id", "orchestrator_session_id", "agent_type", "agent_id", "model_version", "context_source",
        "input_data_hash", "confidence", "decision struct<confidence:string>", "model_versions",
    )
    rows = stage(parsed.select("application_id", "event_id", "event_type", "global_position", "recorded_at", "p"))
    t = F.col("event_type")
    sessions = rows.where(t.isin(*ANCHOR_TYPES) & (F.col("p.application_id") == F.col("application_id"))).groupBy("application_id", F.col("p.session_id").alias("session_id")).agg(
        F.max_by(F.struct("p.agent_type", "p.agent_id", "p.model_version", "p.context_source"), F.col("global_position")).alias("m")
    )
    stated = F.col("p.confidence")
    outputs = rows.where(t.isin(*OUTPUTS)).select(
        "application_id", "event_id", t, "global_position", "recorded_at", F.coalesce(P.filled(F.col("p.session_id")), P.filled(F.col("p.orchestrator_session_id"))).alias("session_id"),
        F.col("p.input_data_hash").alias("input_data_hash"), F.when(P.truthy(stated), stated).otherwise(F.col("p.decision.confidence")).try_cast("double").alias("confidence"),
        F.when(t == "DecisionGenerated", F.coalesce("p.model_versions", F.lit("{}"))).alias("model_versions"),
    )
    return outputs.join(sessions, ["application_id", "session_id"], "left").select(
        "application_id", "global_position", "event_id", "session_id", "m.agent_type", "m.agent_id", "m.model_version", "m.context_source", "event_type", "input_data_hash", "confidence", "recorded_at", "model_versions"
    )


def package_rows(ledger: DataFrame, audit_events: DataFrame, integrity: DataFrame, examined_at: Column) -> DataFrame:
    """All package rows of all applications.

    Events and narrative are complete; only the states are as of ``examined_at``. ``integrity`` holds the results of
    the checks run for the packages (source_stream_id, events_verified, flags and hashes per application stream).
    """
    related = stage(number_rows(lineage.application_events(ledger), ["application_id"], "global_position", "n"))
    # Events and their sentences already have their ordinals; only the other sections are numbered below.
    events = related.select("application_id", F.lit(0).alias("s"), F.col("n").alias("ordinal"), envelope().alias("content"))
    told = related.select("application_id", F.lit(4), "n", narrative_sentence())
    owner = F.regexp_extract("stream_id", "^audit-(?:loan|application)-(.*)$", 1)
    audits = audit_events.where(F.col("stream_id").rlike("^audit-(loan|application)-")).select(owner.alias("application_id"), F.lit(1).alias("s"), F.col("global_position").alias("n"), envelope().alias("content"))
    scoped = related.where(F.col("recorded_at") <= examined_at).withColumnRenamed("application_id", "scope").drop("n")
    keys = ("scope",)
    summary = application_summary(scoped, keys).where("application_id = scope")
    compliance = compliance_current(scoped, keys).where("application_id = scope")
    anchors = P.with_fields(scoped.where(F.col("event_type").isin(*ANCHOR_TYPES)), "application_id", "agent_id")
    own = anchors.where("p.application_id = scope").select("scope", F.col("p.agent_id").alias("agent_id")).distinct()
    agents = agent_performance(scoped, keys).join(own, ["scope", "agent_id"], "left_semi")

    def state_rows(df: DataFrame, name: str, rank: int, order: Column) -> DataFrame:
        content = F.to_json(F.struct(F.lit(name).alias("model"), F.struct(*[c for c in df.columns if c != "scope"]).alias("state")))
        return df.select(F.col("scope").alias("application_id"), F.lit(2), (F.lit(rank).cast("bigint") * (1 << 50) + order).alias("n"), content)

    agent_order = F.pmod(F.xxhash64("agent_type", "agent_id", "model_version"), F.lit(1 << 50))
    states = state_rows(summary, "application_summary", 0, F.lit(0).cast("bigint")).union(state_rows(compliance, "compliance_audit", 1, F.lit(0).cast("bigint"))).union(state_rows(agents, "agent_performance", 2, agent_order))
    checked = integrity.select(
        F.regexp_replace("source_stream_id", "^loan-", "").alias("application_id"), F.lit(3), F.lit(0).cast("bigint"),
        F.to_json(F.struct("source_stream_id", "audit_stream_id", "events_verified", "chain_valid", "tamper_detected", F.col("integrity_hash").alias("latest_integrity_hash"), "previous_hash"), {"ignoreNullFields": "false"}),
    )
    models = model_provenance(related.drop("n"))
    provenance = models.select("application_id", F.lit(5), "global_position", F.to_json(F.struct(*[c for c in models.columns if c not in ("application_id", "global_position")])))
    rest = number_rows(stage(audits.union(states).union(checked).union(provenance)), ["application_id", "s"], "n", "ordinal")
    rows = events.union(told).union(rest.select("application_id", "s", "ordinal", "content"))
    return rows.select("application_id", F.element_at(F.array(*[F.lit(x) for x in SECTIONS]), F.col("s") + 1).alias("section"), "ordinal", "content")


def _rank() -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section")).cast("bigint") - 1


def package_digests(rows: DataFrame, examined_at: Column) -> DataFrame:
    """Header per package: version, examination date, row count and digest over all rows."""
    # Rows are hashed where they lie; the shuffles see their digests as bytes, never the contents.
    digest = F.unhex(F.sha2(F.concat_ws("|", "section", F.col("ordinal").cast("string"), "content"), 256))
    narrow = rows.select("application_id", (_rank() * (1 << 40) + F.col("ordinal")).alias("_o"), digest.alias("_h"))
    hashed = stage(number_rows(narrow, ["application_id"], "_o", "_n").select("application_id", "_n", "_h"))
    sizes = hashed.groupBy("application_id").agg(F.count("*").alias("rows"))
    head = F.concat_ws("|", F.lit(VERSION), "application_id", iso_time(examined_at), F.col("_tree"))
    return ordered_digest(hashed, ["application_id"], "_n", "_h", "_tree").join(sizes, "application_id").select(
        "application_id", F.lit(VERSION).alias("package_version"), iso_time(examined_at).alias("examination_date"), "rows", F.sha2(head, 256).alias("package_hash")
    )


def verify_packages(rows: DataFrame, headers: DataFrame, examined_at: Column) -> DataFrame:
    """Recompute a package from its rows: digest, audit chain over the embedded events, latest hash, tamper flags."""
    again = package_digests(rows, examined_at).select("application_id", F.col("package_hash").alias("_again"))
    block = rows.where("section = 'integrity_verification'").select(
        "application_id", F.get_json_object("content", "$.source_stream_id").alias("source"), F.get_json_object("content", "$.latest_integrity_hash").alias("latest")
    )
    parsed = F.from_json("content", "stream_id string, stream_position bigint, payload string, event_type string")
    place = F.from_json("content", "stream_id string, stream_position bigint")
    placed = rows.where("section = 'event_stream'").select("application_id", place.alias("e"), F.unhex(F.sha2("content", 256)).alias("event_hash"))
    events = placed.select("application_id", "e.stream_id", F.col("e.stream_position").alias("pos"), "event_hash").join(block.select("application_id", "source"), "application_id", "left")
    events = stage(events.where("source is null or stream_id = source").select("application_id", "pos", "event_hash"))
    check = F.from_json(F.col("e.payload"), "events_verified_count bigint, integrity_hash string, tamper_detected boolean")
    audits = rows.where("section = 'audit_stream'").select("application_id", "ordinal", parsed.alias("e")).where(F.col("e.event_type") == CHECK)
    audits = audits.select("application_id", "ordinal", F.col("e.stream_id").alias("audit_stream_id"), check.alias("c"), F.concat_ws("/", "application_id", F.col("ordinal").cast("string")).alias("probe_id"))
    audits = stage(audits.select("application_id", "audit_stream_id", "ordinal", "probe_id", F.coalesce("c.events_verified_count", F.lit(0)).alias("n"), F.col("c.integrity_hash").alias("integrity_hash"), F.coalesce("c.tamper_detected", F.lit(False)).alias("tampered")))
    linked = running(audits, ["application_id", "audit_stream_id"], "ordinal", {"_prev": before(F.col("integrity_hash"))})
    prefixes = prefix_digests(events, ["application_id"], "pos", "event_hash", audits.select("application_id", "n", "probe_id"), "n", "prefix_hash")
    judged = linked.join(prefixes, "probe_id").groupBy("application_id").agg(
        F.bool_and(chain_digest(F.col("_prev"), F.col("prefix_hash")).eqNullSafe(F.col("integrity_hash"))).alias("audit_chain_valid"), F.bool_or("tampered").alias("tamper_detected"),
        F.max_by("integrity_hash", "ordinal").alias("_last"),
    )
    joined = headers.join(again, "application_id", "left").join(block, "application_id", "left").join(judged, "application_id", "left")
    hash_ok = F.coalesce(F.col("_again") == F.col("package_hash"), F.lit(False))
    chain_ok, tampered = F.coalesce("audit_chain_valid", F.lit(True)), F.coalesce("tamper_detected", F.lit(False))
    latest_ok = F.col("_last").eqNullSafe(F.col("latest"))
    return joined.select(
        "application_id", hash_ok.alias("package_hash_valid"), chain_ok.alias("audit_chain_valid"), latest_ok.alias("latest_integrity_hash_matches"), tampered.alias("tamper_detected"),
        (hash_ok & chain_ok & latest_ok & ~tampered).alias("ok"),
    )
