"""Portfolio and operations views: timelines, application rows, queues, health and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foldstone.functions import ids, payload as P
from foldstone.operators.scan import last, running, total
from foldstone.schema import (
    COMPLIANCE_LABELS, FAMILY_LABELS, HARD_BLOCK_REASON, ORIGIN_LABELS, OTHER_RECOMMENDATION_STATE, PAGE_SIZE, READ_MODEL_TARGETS_MS, RECOMMENDATION_STATES, RISK_WORDS, STAGES,
    STATE_LABELS, SUMMARY_STATES,
)
from foldstone.session import stage

# Ids used by technical runs, the prefix of client applications, and the form of seeded ids.
TECHNICAL_IDS = (r"-AUDIT-", r"-GAS-", r"-INTEGRITY-", r"-MCP-", r"-NOSESSION$", r"-P2$", r"-P3", r"-TEST-", r"-UPCAST-", r"-BAD$", r"-MISSING$", r"-OK$")
STAGE_HINTS = {
    "submitted": "Application intake and reference capture",
    "documents": "Uploads, extraction, and package readiness",
    "credit": "Credit facts and risk limit analysis",
    "fraud": "Fraud screening and anomaly review",
    "compliance": "Rule evaluation and hard-block checks",
    "decision": "Decision orchestration and recommendation",
    "human": "Manual review and override path",
    "final": "Final approval or decline recorded",
}
LANES = ("human", "open", "approved", "declined")
STALL_FLOOR_MS = 60_000


def _labels(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


# ---- grouping events by application -------------------------------------------------------------------------------
def grouped_events(ledger: DataFrame) -> DataFrame:
    """(application_id, event) by every hint: payload, session, package, stream mapping, stream name, audit stream."""
    rows = P.with_fields(ledger, "application_id", "session_id", "package_id").select(*ledger.columns, *[F.col(f"p.{c}").alias(f"_{c}") for c in ("application_id", "session_id", "package_id")])
    rows = stage(rows)
    named = rows.where("_application_id is not null")
    sessions = named.where("_session_id is not null").groupBy("_session_id").agg(F.max_by("_application_id", "global_position").alias("_by_session"))
    streams = named.groupBy("stream_id").agg(F.max_by("_application_id", "global_position").alias("_by_stream"))
    audit = P.filled(F.regexp_extract("stream_id", "^audit-(?:loan|application)-(.*)$", 1))
    # Only events that do not name their application look for it; the others, payloads and all, stay where they are.
    owner = F.coalesce(P.filled(F.col("_by_session")), ids.package_owner(F.col("_package_id")), P.filled(F.col("_by_stream")), ids.stream_owner(), audit)
    # Events without a session would all meet in one partition; their own id spreads them and matches nothing.
    spread = rows.where("_application_id is null").withColumn("_session_id", F.coalesce("_session_id", F.concat(F.lit("\x01"), "event_id")))
    joined = spread.join(sessions, "_session_id", "left").join(streams, "stream_id", "left")
    found = joined.select(owner.alias("application_id"), *ledger.columns).where("application_id is not null")
    return named.select(F.col("_application_id").alias("application_id"), *ledger.columns).union(found)


def timeline(grouped: DataFrame, family: str | None = None, search: str | None = None) -> DataFrame:
    """Timeline rows in log order with family label and risk flag, optionally of one family or matching a search text."""
    rows = grouped.select(
        "application_id", "event_id", "stream_id", ids.stream_family().alias("stream_family"), "event_type", "event_version", "recorded_at", "stream_position", "global_position", "payload", "metadata",
        F.col("event_type").rlike("|".join(RISK_WORDS)).alias("risky"),
    ).withColumn("family_label", F.coalesce(_labels(FAMILY_LABELS, F.col("stream_family")), F.col("stream_family")))
    if family is not None and family != "all":
        rows = rows.where(F.col("stream_family") == family)
    text = (search or "").strip().lower()
    if text:
        doc, meta = "payload", "metadata"
        fields = [F.col("event_type"), F.col("stream_id"), F.get_json_object(doc, "$.summary"), F.get_json_object(doc, "$.output_summary"), F.get_json_object(meta, "$.correlation_id"), F.get_json_object(meta, "$.causation_id")]
        rows = rows.where(F.exists(F.array_compact(F.array(*fields)), lambda x: F.lower(x).contains(text)))
    return rows.orderBy("application_id", "global_position", "recorded_at", "stream_id", "stream_position")


# ---- portfolio ----------------------------------------------------------------------------------------------------
def needs_review(state: Column) -> Column:
    return state.contains("HUMAN")


def portfolio(grouped: DataFrame, companies: DataFrame, seeded: bool = False, prefix: str = "APEX-") -> DataFrame:
    """One row per application for listing: latest known values, company, review state, origin, size and visibility."""
    rows = P.with_fields(
        grouped.select("*"), "applicant_id", "requested_amount_usd", "approved_amount_usd", "decision struct<risk_tier:string>", "fraud_score", "overall_verdict", "recommendation", "reviewer_id",
        "final_decision", "override", "override_reason", "decline_reasons array<string>",
    )
    t, pos = F.col("event_type"), F.col("global_position")
    rec = P.filled(F.col("p.recommendation"))
    known, advice = [F.create_map(*[F.lit(x) for pair in m.items() for x in pair]) for m in (SUMMARY_STATES, RECOMMENDATION_STATES)]
    hard = F.exists("p.decline_reasons", lambda r: F.coalesce(r.contains(HARD_BLOCK_REASON), F.lit(False)))
    state = (
        F.when(t == "ApplicationDeclined", F.when(F.coalesce(hard, F.lit(False)), "DECLINED_COMPLIANCE").otherwise("FINAL_DECLINED"))
        .when((t == "DecisionGenerated") & rec.isNotNull(), F.coalesce(advice[rec], F.lit(OTHER_RECOMMENDATION_STATE))).otherwise(known[t])
    )
    decision = F.when(t == "DecisionGenerated", rec).when(t == "HumanReviewCompleted", F.col("p.final_decision")).when(t == "ApplicationApproved", F.lit("APPROVE")).when(t == "ApplicationDeclined", F.lit("DECLINE"))
    amount = P.money(F.col("p.approved_amount_usd"))

    def latest(value: Column, when: Column) -> Column:
        return F.max_by(value, F.when(F.coalesce(when, F.lit(False)), pos))

    submitted, review = t == "ApplicationSubmitted", t == "HumanReviewCompleted"
    first_submission = F.min_by(F.col("p.applicant_id").isNotNull() & F.array_contains(F.json_object_keys("payload"), "requested_amount_usd"), F.when(submitted, pos))
    folded = rows.groupBy("application_id").agg(
        latest(state, state.isNotNull()).alias("_state"),
        latest(F.col("p.applicant_id"), submitted & F.col("p.applicant_id").isNotNull()).alias("applicant_id"),
        latest(P.money(F.col("p.requested_amount_usd")), submitted).alias("requested_amount_usd"),
        latest(amount, amount.isNotNull() & ((t == "ApplicationApproved") | ((t == "DecisionGenerated") & rec.isNotNull()))).alias("approved_amount_usd"),
        latest(F.col("p.decision.risk_tier"), (t == "CreditAnalysisCompleted") & F.col("p.decision.risk_tier").isNotNull()).alias("risk_tier"),
        latest(F.col("p.fraud_score").try_cast("double"), (t == "FraudScreeningCompleted") & F.col("p.fraud_score").isNotNull()).alias("fraud_score"),
        latest(F.col("p.overall_verdict"), (t == "ComplianceCheckCompleted") & F.col("p.overall_verdict").isNotNull()).alias("compliance_status"),
        latest(decision, decision.isNotNull()).alias("decision"),
        latest(F.col("p.reviewer_id"), review & F.col("p.reviewer_id").isNotNull()).alias("human_reviewer_id"),
        F.max_by(F.struct(F.col("p.reviewer_id").alias("reviewer_id"), P.truthy(F.col("p.override")).alias("override"), F.col("p.final_decision").alias("final_decision"), F.col("p.override_reason").alias("override_reason")), F.when(review, pos)).alias("_review"),
        F.bool_or(t == "HumanReviewRequested").alias("_review_requested"),
        F.count("*").alias("event_count"), F.max_by("recorded_at", pos).alias("last_event_at"),
        # Families are a closed set of seven.
        F.sort_array(F.collect_set(ids.stream_family())).alias("stream_families"),
        F.coalesce(first_submission, F.lit(False)).alias("_client_submission"),
        F.coalesce(F.bool_or((t == "DecisionGenerated") & F.col("p.recommendation").isNull()), F.lit(False)).alias("_malformed"),
        F.coalesce(F.bool_or(P.truthy(F.get_json_object("metadata", "$.seed"))), F.lit(False)).alias("_seed"),
    )
    app = F.col("application_id")
    status = F.coalesce("_state", F.lit("NEW"))
    reviewed = F.col("_review").isNotNull() | P.filled(F.col("human_reviewer_id")).isNotNull()
    review_state = F.when(reviewed, "completed").when(needs_review(status) | F.col("_review_requested"), "pending").otherwise("not_required")
    origin = F.lit("seeded") if seeded else F.when(F.col("_seed") | app.rlike(f"^{prefix}\\d{{4}}$"), "seeded").otherwise("live")
    technical = app.rlike("^" + prefix.rstrip("-") + "(" + "|".join(TECHNICAL_IDS) + ")")
    dimension = companies.select(F.col("company_id").alias("applicant_id"), F.col("name").alias("_name"), "industry", "jurisdiction")
    return folded.join(dimension, "applicant_id", "left").select(
        "application_id", "applicant_id", F.coalesce("_name", "applicant_id", "application_id").alias("company_name"), "industry", "jurisdiction", origin.alias("origin"), status.alias("state"),
        "requested_amount_usd", "approved_amount_usd", "decision", "compliance_status", "risk_tier", "fraud_score", "human_reviewer_id", review_state.alias("review_state"),
        (review_state != "not_required").alias("has_human_review"), "event_count", "last_event_at", "stream_families",
        (~technical & app.startswith(prefix) & ~F.col("_malformed") & F.col("_client_submission")).alias("client_visible"),
        F.struct(
            ((review_state != "not_required") | F.col("_review_requested")).alias("requested"), F.col("_review").isNotNull().alias("completed"),
            F.coalesce("_review.reviewer_id", "human_reviewer_id").alias("reviewer_id"), F.coalesce("_review.override", F.lit(False)).alias("override"),
            F.col("_review.final_decision").alias("final_decision"), F.col("_review.override_reason").alias("override_reason"),
        ).alias("review"),
    )


def stage_rail(rows: DataFrame) -> DataFrame:
    """Eight stages per application with status complete, current or upcoming."""
    s = F.col("state")
    current = (
        F.when(s == "SUBMITTED", 0).when(s.startswith("DOCUMENTS"), 1).when(s == "AWAITING_ANALYSIS", 2).when(s == "ANALYSIS_COMPLETE", 3)
        .when(s.isin("COMPLIANCE_REVIEW", "DECLINED_COMPLIANCE"), 4).when(s == "PENDING_DECISION", 5).when(s.contains("HUMAN"), 6).when(s.startswith("FINAL"), 7).otherwise(0)
    )
    entries = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("stage"), F.lit(n.capitalize()).alias("label"), F.lit(STAGE_HINTS[n]).alias("hint")) for i, n in enumerate(STAGES)])
    spread = rows.select("application_id", current.alias("c"), F.inline(entries))
    status = F.when((F.col("i") < F.col("c")) | (F.col("c") == len(STAGES) - 1), "complete").when(F.col("i") == F.col("c"), "current").otherwise("upcoming")
    return spread.select("application_id", F.col("i").alias("ordinal"), "stage", "label", status.alias("status"), "hint")


def compliance_counts(grouped: DataFrame) -> DataFrame:
    """Running passed, failed and noted counts and the verdict after each compliance event (never reset)."""
    rows = P.with_fields(grouped.where(ids.stream_family() == "compliance"), "overall_verdict")
    t = F.col("event_type")
    rows = stage(rows.select("application_id", "event_id", "event_type", "global_position", "recorded_at", F.when(t == "ComplianceCheckCompleted", F.col("p.overall_verdict")).alias("_v")))

    def seen(name: str):
        return total((t == name).cast("bigint"))

    return running(rows, ["application_id"], "global_position", {
        "passed": seen("ComplianceRulePassed"), "failed": seen("ComplianceRuleFailed"), "noted": seen("ComplianceRuleNoted"), "verdict": last(F.col("_v")),
    }).drop("_v")


def audit_summaries(grouped: DataFrame) -> DataFrame:
    """Audit event count, last check and distinct types per application."""
    rows = P.with_fields(grouped.where(ids.stream_family() == "audit"), "chain_valid", "tamper_detected", "integrity_hash", "check_timestamp")
    t, pos = F.col("event_type"), F.col("global_position")
    last_check = F.max_by(F.struct(
        F.when(F.col("p.chain_valid").isNotNull(), P.truthy(F.col("p.chain_valid"))).alias("chain_valid"), F.when(F.col("p.tamper_detected").isNotNull(), P.truthy(F.col("p.tamper_detected"))).alias("tamper_detected"),
        F.col("p.integrity_hash").alias("hash"), F.coalesce(P.instant(F.col("p.check_timestamp")), F.col("recorded_at")).alias("at"),
    ), F.when(t == "AuditIntegrityCheckRun", pos))
    return rows.groupBy("application_id").agg(F.count("*").alias("event_count"), last_check.alias("c"), F.sort_array(F.collect_set("event_type")).alias("event_types")).select(
        "application_id", "event_count", "c.chain_valid", "c.tamper_detected", F.col("c.hash").alias("latest_integrity_hash"), F.col("c.at").alias("latest_check_at"), "event_types"
    )


def labelled(rows: DataFrame) -> DataFrame:
    """Display labels for state, decision, compliance and origin."""
    s, d, c = F.col("state"), F.col("decision"), F.col("compliance_status")
    decision = (
        F.when(P.filled(d).isNull(), "Pending").when(d == "APPROVE", F.when(s == "FINAL_APPROVED", "Approved").otherwise("Recommended approve"))
        .when(d == "DECLINE", F.when(s.isin("FINAL_DECLINED", "DECLINED_COMPLIANCE"), "Declined").otherwise("Recommended decline")).when(d == "REFER", "Refer to review").otherwise(d)
    )
    return rows.select(
        "*", F.coalesce(_labels(STATE_LABELS, s), F.replace(s, F.lit("_"), F.lit(" ")), F.lit("Not recorded")).alias("state_label"), decision.alias("decision_label"),
        F.coalesce(_labels(COMPLIANCE_LABELS, c), F.replace(P.filled(c), F.lit("_"), F.lit(" ")), F.lit("In progress")).alias("compliance_label"), _labels(ORIGIN_LABELS, F.col("origin")).alias("origin_label"),
    )


# ---- totals and queues --------------------------------------------------------------------------------------------
def in_lane(lane: str) -> Column:
    s, r = F.col("state"), F.col("review_state")
    return {
        "human": r != "not_required",
        "open": ~s.startswith("FINAL") & ~s.startswith("DECLINED_") & (r == "not_required"),
        "approved": s == "FINAL_APPROVED",
        "declined": s.isin("FINAL_DECLINED", "DECLINED_COMPLIANCE"),
        "all": F.lit(True),
    }[lane]


def dashboard_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("applications"), F.count_if(F.col("origin") == "seeded").alias("seeded_applications"), F.count_if(F.col("origin") == "live").alias("live_applications"),
        F.count_if(in_lane("approved")).alias("final_approved"), F.count_if(in_lane("declined")).alias("final_declined"), F.count_if(in_lane("human")).alias("human_review"),
    )


def queue_lanes(rows: DataFrame) -> DataFrame:
    """Count and share per lane; the busiest lane is flagged (on equal counts the open lane, then lane order)."""
    counts = rows.agg(F.count("*").alias("total"), *[F.count_if(in_lane(n)).alias(n) for n in LANES])
    order = ("open", *[n for n in LANES if n != "open"])
    best = F.greatest(*[F.col(n) for n in LANES])
    busiest = F.lit(order[-1])
    for name in reversed(order):
        busiest = F.when(F.col(name) == best, F.lit(name)).otherwise(busiest)
    entries = F.array(*[F.struct(F.lit(n).alias("lane"), F.col(n).alias("applications")) for n in (*LANES,)], F.struct(F.lit("all").alias("lane"), F.col("total").alias("applications")))
    spread = counts.select("total", busiest.alias("busiest"), F.inline(entries))
    share = F.when(F.col("total") > 0, F.floor(F.col("applications") * 100.0 / F.col("total") + 0.5)).otherwise(F.lit(0))
    return spread.select("lane", "applications", share.alias("share_pct"), (F.col("lane") == F.col("busiest")).alias("is_busiest"))


def explore(rows: DataFrame, lane: str = "all", search: str = "", page: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """One page of a lane, newest first, optionally matching a text in seven columns."""
    found = rows.where(in_lane(lane))
    text = search.strip().lower()
    if text:
        columns = ("application_id", "company_name", "applicant_id", "state", "decision", "compliance_status", "risk_tier")
        found = found.where(F.exists(F.array_compact(F.array(*columns)), lambda x: F.lower(x).contains(text)))
    return found.orderBy(F.desc("last_event_at"), "application_id").offset((max(page, 1) - 1) * size).limit(size)


def event_distribution(ledger: DataFrame) -> DataFrame:
    """Event counts per type and per family."""
    counted = ledger.groupBy("event_type", ids.stream_family().alias("family")).agg(F.count("*").alias("events"))
    sets = counted.groupingSets([["event_type"], ["family"]], "event_type", "family").agg(F.sum("events").alias("events"))
    return sets.select(F.when(F.col("event_type").isNotNull(), "event_type").otherwise("family").alias("scope"), F.coalesce("event_type", "family").alias("key"), "events")


def top_types(ledger: DataFrame, n: int = 8) -> DataFrame:
    return ledger.groupBy("event_type").agg(F.count("*").alias("events")).orderBy(F.desc("events"), "event_type").limit(n)


def ledger_totals(ledger: DataFrame, heads: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row: events, streams, archived streams, snapshots, latest position and time."""
    log = ledger.agg(F.count("*").alias("total_events"), F.max("global_position").alias("latest_global_position"), F.max("recorded_at").alias("latest_recorded_at"))
    streams = heads.agg(F.count("*").alias("total_streams"), F.count_if(F.col("archived_at").isNotNull()).alias("archived_streams"))
    saved = snapshots.agg(F.count("*").alias("aggregate_snapshots"))
    one = F.lit(1).alias("_one")
    return log.select("*", one).join(F.broadcast(streams.select("*", one)), "_one").join(F.broadcast(saved.select("*", one)), "_one").drop("_one")


def model_sizes(**models: DataFrame) -> DataFrame:
    """Row count per named read model."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("model"), "rows") for name, df in models.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


# ---- lag and health -----------------------------------------------------------------------------------------------
def read_model_lag(checkpoints: DataFrame, ledger: DataFrame) -> DataFrame:
    """Positions and milliseconds each read model is behind (``last_position`` is the next position to read)."""
    latest = ledger.agg(F.max("global_position").alias("latest_position"), F.max_by("recorded_at", "global_position").alias("latest_recorded_at"))
    done = checkpoints.withColumn("_at", F.col("last_position") - 1)
    events = ledger.select(F.col("global_position").alias("_at"), F.col("recorded_at").alias("last_processed_at"))
    one = F.lit(1).alias("_one")
    # The checkpoint table has one row per read model, so it is sent to the log instead of shuffling the log.
    reached = events.join(F.broadcast(done.select("_at").distinct()), "_at")
    joined = done.join(reached, "_at", "left").select("*", one).join(F.broadcast(latest.select("*", one)), "_one")
    behind = F.when(F.col("latest_position").isNull(), F.lit(0)).when(F.col("last_position") == 0, F.col("latest_position")).otherwise(F.greatest(F.lit(0), F.col("latest_position") - F.col("_at")))
    ms = F.coalesce(F.greatest(F.lit(0), F.floor((F.unix_micros("latest_recorded_at") - F.unix_micros("last_processed_at")) / 1000)), F.lit(0))
    return joined.select("projection_name", "last_position", "updated_at", "latest_position", "last_processed_at", behind.cast("bigint").alias("lag_positions"), ms.cast("bigint").alias("lag_ms"))


def read_model_health(lag: DataFrame, now: Column) -> DataFrame:
    """Status per read model against its freshness target."""
    target = _labels({k: str(v) for k, v in READ_MODEL_TARGETS_MS.items()}, F.col("projection_name")).cast("bigint")
    age = F.unix_millis(now) - F.unix_millis("updated_at")
    stalled = (age > F.greatest(F.col("slo_target_ms") * 4, F.lit(STALL_FLOOR_MS))) & (F.col("lag_positions") > 0)
    status = (
        F.when(F.col("latest_position").isNull(), "idle").when(F.col("last_position") == 0, "not_started")
        .when((F.col("lag_positions") == 0) & (F.col("lag_ms") <= F.col("slo_target_ms")), "healthy").when(F.coalesce(stalled, F.lit(False)), "stalled").otherwise("lagging")
    )
    return lag.withColumn("slo_target_ms", target).withColumn("status", status)
