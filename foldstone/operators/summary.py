"""Application summary: one row per application folded from seventeen event types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foldstone.functions import ids, payload as P
from foldstone.operators.scan import listed
from foldstone.schema import (
    HARD_BLOCK_REASON,
    OTHER_RECOMMENDATION_STATE,
    RECOMMENDATION_STATES,
    SUMMARY_STATES,
    SUMMARY_TYPES,
)
from foldstone.session import stage

_FIELDS = (
    "application_id",
    "applicant_id",
    "requested_amount_usd",
    "approved_amount_usd",
    "decision struct<risk_tier:string>",
    "fraud_score",
    "overall_verdict",
    "recommendation",
    "reviewer_id",
    "final_decision",
    "decline_reasons array<string>",
    "session_id",
    "approved_at",
    "declined_at",
)


def with_application(ledger: DataFrame, name: str = "application_id") -> DataFrame:
    """Owning application of each event: payload field, else the stream name; events without one are dropped."""
    owner = F.coalesce(F.get_json_object("payload", "$.application_id"), ids.stream_owner())
    return ledger.withColumn(name, owner).where(F.col(name).isNotNull())


def _handled(ledger: DataFrame) -> DataFrame:
    handled = P.with_fields(ledger.where(F.col("event_type").isin(*SUMMARY_TYPES)), *_FIELDS)
    owner = F.coalesce(F.col("p.application_id"), ids.stream_owner())
    return handled.withColumn("application_id", owner).where("application_id is not null")


def _at(types, extra: Column | None = None) -> Column:
    """Position of the event where it is one of ``types``, as the ordering of a latest-value aggregate."""
    hit = F.col("event_type").isin(*([types] if isinstance(types, str) else types))
    return F.when(hit if extra is None else hit & extra, F.col("global_position"))


def registers() -> dict[str, tuple[Column, Column]]:
    """What the summary remembers of an application: the latest value of each name, and the position that sets it (or null)."""
    t, p = F.col("event_type"), "p."
    amount = P.money(F.col(p + "approved_amount_usd"))
    is_decision = ["DecisionGenerated", "HumanReviewCompleted", "ApplicationApproved", "ApplicationDeclined"]
    decision = (
        F.when(t == "DecisionGenerated", F.col(p + "recommendation"))
        .when(t == "HumanReviewCompleted", F.col(p + "final_decision"))
        .when(t == "ApplicationApproved", F.lit("APPROVE"))
        .otherwise(F.lit("DECLINE"))
    )
    known = F.create_map(*[F.lit(x) for pair in SUMMARY_STATES.items() for x in pair])
    advice = F.create_map(*[F.lit(x) for pair in RECOMMENDATION_STATES.items() for x in pair])
    state = F.when(
        t == "DecisionGenerated", F.coalesce(advice[F.col(p + "recommendation")], F.lit(OTHER_RECOMMENDATION_STATE))
    ).otherwise(known[t])
    has_applicant = F.get_json_object("payload", "$.applicant_id").isNotNull() | F.array_contains(F.json_object_keys("payload"), "applicant_id")
    final_types = ["ApplicationApproved", "ApplicationDeclined"]
    stated = F.when(t == "ApplicationApproved", F.col(p + "approved_at")).otherwise(F.col(p + "declined_at"))
    reasoned = F.exists("p.decline_reasons", lambda r: F.coalesce(r.contains(HARD_BLOCK_REASON), F.lit(False)))
    return {
        "_state": (state, _at([*SUMMARY_STATES, "DecisionGenerated", "ApplicationDeclined"])),
        "_hard_reason": (F.coalesce(reasoned, F.lit(False)), _at("ApplicationDeclined")),
        "applicant_id": (F.col(p + "applicant_id"), _at("ApplicationSubmitted", has_applicant)),
        "requested_amount_usd": (P.money(F.col(p + "requested_amount_usd")), _at("ApplicationSubmitted")),
        "approved_amount_usd": (amount, _at(["DecisionGenerated", "ApplicationApproved"], amount.isNotNull())),
        "risk_tier": (F.col(p + "decision.risk_tier"), _at("CreditAnalysisCompleted")),
        "fraud_score": (F.col(p + "fraud_score").try_cast("double"), _at("FraudScreeningCompleted")),
        "compliance_status": (F.col(p + "overall_verdict"), _at("ComplianceCheckCompleted")),
        "decision": (decision, _at(is_decision)),
        "last_event_type": (t, F.col("global_position")),
        "last_event_at": (F.col("recorded_at"), F.col("global_position")),
        "human_reviewer_id": (F.col(p + "reviewer_id"), _at("HumanReviewCompleted")),
        "final_decision_at": (F.coalesce(P.instant(stated), F.col("recorded_at")), _at(final_types)),
    }


def _session() -> Column:
    return F.when(F.col("event_type") == "AgentSessionCompleted", P.filled(F.col("p.session_id")))


def _checks(handled: DataFrame, by: list[str]) -> DataFrame:
    checks = handled.where("event_type = 'ComplianceCheckCompleted'")
    return checks.select(*by, "global_position", F.col("p.overall_verdict").alias("_status"))


def application_summary(ledger: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Fold to one row per application (and per extra key, e.g. a branch label).

    Everything is a latest-value aggregate over one scan, combined before the shuffle. Only the outcome of a decline
    depends on what was known at that moment, and it needs a second look only where a later check changed the status.
    """
    by = [*keys, "application_id"]
    handled, names = _handled(ledger), registers()
    folded = handled.groupBy(*by).agg(
        *[F.max_by(value, at).alias(name) for name, (value, at) in names.items()],
        F.max(names["_state"][1]).alias("_state_at"), F.max(names["_hard_reason"][1]).alias("_declined_at"),
        F.max(names["compliance_status"][1]).alias("_status_at"), F.count_distinct(_session()).alias("sessions_completed"),
    )
    return _finished(stage(folded), _checks(handled, by), by)


def _finished(folded: DataFrame, checks: DataFrame, by: list[str]) -> DataFrame:
    resolved = folded.join(_status_when_declined(checks, folded, by), by, "left")
    status_then = F.when(F.col("_status_at") < F.col("_declined_at"), F.col("compliance_status")).otherwise(F.col("_earlier_status"))
    declined = F.when((status_then == "BLOCKED") | F.col("_hard_reason"), F.lit("DECLINED_COMPLIANCE")).otherwise(F.lit("FINAL_DECLINED"))
    return resolved.select(
        *by,
        F.when(F.col("_state_at") == F.col("_declined_at"), declined).otherwise(F.coalesce("_state", F.lit("NEW"))).alias("state"),
        "applicant_id",
        "requested_amount_usd",
        "approved_amount_usd",
        "risk_tier",
        "fraud_score",
        "compliance_status",
        "decision",
        "sessions_completed",
        "last_event_type",
        "last_event_at",
        "human_reviewer_id",
        "final_decision_at",
    )


def _status_when_declined(checks: DataFrame, folded: DataFrame, by: list[str]) -> DataFrame:
    """Compliance status at the final decline, for the few applications that completed another check after it."""
    late = folded.where("_state_at = _declined_at and _status_at > _declined_at").select(*by, "_declined_at")
    return (
        checks.join(late, by)
        .where("global_position < _declined_at")
        .groupBy(*by)
        .agg(F.max_by("_status", "global_position").alias("_earlier_status"))
    )


def summary_parts(events: DataFrame) -> dict[str, DataFrame]:
    """Any events as tables that merge in any order: registers of (position, value), completed sessions, completed checks."""
    handled = _handled(events)
    set_by = [F.max(F.when(at.isNotNull(), F.struct(at.alias("at"), value.alias("value")))).alias(name) for name, (value, at) in registers().items()]
    sessions = handled.select("application_id", _session().alias("session_id")).where("session_id IS NOT NULL").distinct()
    return {"registers": handled.groupBy("application_id").agg(*set_by), "sessions": sessions, "checks": _checks(handled, ["application_id"]).distinct()}


def merge_registers(rows: DataFrame) -> DataFrame:
    """The latest value of every register: the largest (position, value), whatever the order of the parts."""
    return rows.groupBy("application_id").agg(*[F.max(c).alias(c) for c in rows.columns if c != "application_id"])


def summary_from(parts: dict[str, DataFrame]) -> DataFrame:
    """The summary of merged parts."""
    names = registers()
    sessions = parts["sessions"].groupBy("application_id").agg(F.count("*").alias("sessions_completed"))
    folded = parts["registers"].join(sessions, "application_id", "left").select(
        "application_id", *[F.col(f"{name}.value").alias(name) for name in names], F.col("_state.at").alias("_state_at"),
        F.col("_hard_reason.at").alias("_declined_at"), F.col("compliance_status.at").alias("_status_at"), F.coalesce("sessions_completed", F.lit(0).cast("long")).alias("sessions_completed"),
    )
    return _finished(stage(folded), parts["checks"], ["application_id"])


def completed_sessions(ledger: DataFrame) -> DataFrame:
    """Sessions completed per application in order of first completion, one row each."""
    handled = _handled(ledger).where("event_type = 'AgentSessionCompleted'")
    firsts = (
        handled.where(P.filled(F.col("p.session_id")).isNotNull())
        .groupBy("application_id", F.col("p.session_id").alias("session_id"))
        .agg(F.min("global_position").alias("first_position"))
    )
    return listed(firsts, ["application_id"], "first_position", F.col("session_id"), "session_id")
