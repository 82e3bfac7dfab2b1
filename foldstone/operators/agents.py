"""Agent performance: work credited to the agent session that was open when it happened."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foldstone.functions import payload as P
from foldstone.operators.scan import last, running
from foldstone.schema import ANCHOR_TYPES
from foldstone.session import stage

KEY = ["agent_type", "agent_id", "model_version"]
_OUTPUTS = ("CreditAnalysisCompleted", "FraudScreeningCompleted", "ComplianceCheckCompleted", "DecisionGenerated")


def session_facts(ledger: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Session starts and outputs with the few fields that count, by session."""
    wanted = ledger.where(F.col("event_type").isin(*ANCHOR_TYPES, *_OUTPUTS))
    parsed = P.with_fields(
        wanted, "session_id", "orchestrator_session_id", "application_id", *KEY,
        "decision struct<confidence:string>", "confidence", "recommendation", "analysis_duration_ms",
    )
    t = F.col("event_type")
    session = F.coalesce(P.filled(F.col("p.session_id")), P.filled(F.col("p.orchestrator_session_id")))
    start = F.when(t.isin(*ANCHOR_TYPES), F.struct(*[F.col(f"p.{c}").alias(c) for c in KEY], F.col("recorded_at").alias("started_at")))
    return parsed.select(
        *keys, session.alias("session_id"), "global_position", "recorded_at", t, start.alias("_start"),
        F.col("p.application_id").alias("application_id"),
        F.when(t == "CreditAnalysisCompleted", F.col("p.decision.confidence"))
        .when(t == "DecisionGenerated", F.col("p.confidence")).try_cast("decimal(18,6)").alias("confidence"),
        F.when(t == "CreditAnalysisCompleted", F.col("p.analysis_duration_ms")).try_cast("decimal(18,3)").alias("duration_ms"),
        F.when(t == "DecisionGenerated", F.upper("p.recommendation")).alias("recommendation"),
    ).where("session_id is not null")


def override_facts(ledger: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Overriding human reviews by application."""
    reviews = P.with_fields(ledger.where("event_type = 'HumanReviewCompleted'"), "application_id", "override")
    return reviews.where(P.truthy(F.col("p.override"))).select(*keys, F.col("p.application_id").alias("application_id"), "global_position", "recorded_at")


def attributed(facts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Session starts and outputs, each output with the latest earlier start of its session (dropped when none)."""
    seen = running(facts, [*keys, "session_id"], "global_position", {"_session": last(F.col("_start"))})
    return seen.where("_session is not null").select(
        *keys, *[F.col(f"_session.{c}").alias(c) for c in KEY], "session_id", "application_id", "global_position", "recorded_at",
        "event_type", "confidence", "duration_ms", "recommendation",
    )


def override_credits(reviews: DataFrame, outputs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Overriding human reviews, credited to the agent of the latest attributed decision before them."""
    decisions = outputs.where("event_type = 'DecisionGenerated'").select(
        *keys, "application_id", "global_position", "recorded_at", F.struct(*KEY).alias("_agent")
    )
    both = decisions.unionByName(reviews.withColumn("_agent", F.lit(None))).where("application_id is not null")
    seen = running(both, [*keys, "application_id"], "global_position", {"_by": last(F.col("_agent"))})
    return seen.where("_agent is null and _by is not null").select(
        *keys, *[F.col(f"_by.{c}").alias(c) for c in KEY], "application_id", "global_position", "recorded_at"
    )


def agent_performance(ledger: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sessions, outputs, confidence, duration, recommendation mix and overrides per agent and model."""
    return performance_of(stage(session_facts(ledger, keys)), override_facts(ledger, keys), keys)


def agent_parts(events: DataFrame) -> dict[str, DataFrame]:
    """What agent performance needs of any events, without their payloads; parts merge as sets."""
    return {"sessions": session_facts(events), "overrides": override_facts(events)}


def performance_of(facts: DataFrame, reviews: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Agent performance of session facts and overriding reviews."""
    by = [*keys, *KEY]
    outputs = stage(attributed(facts, keys))
    overrides = override_credits(reviews, outputs, keys)
    rows = outputs.select(*by, "global_position", "recorded_at", "event_type", "confidence", "duration_ms", "recommendation").unionByName(
        overrides.select(*by, "global_position", "recorded_at", F.lit("override").alias("event_type")), allowMissingColumns=True
    )
    t, rec = F.col("event_type"), F.col("recommendation")
    started = t.isin(*ANCHOR_TYPES)
    is_decision = t == "DecisionGenerated"
    totals = rows.groupBy(*by).agg(
        F.count_if(started).alias("total_sessions"),
        F.count_if(t.isin(*_OUTPUTS[:3])).alias("analyses_completed"),
        F.count_if(is_decision).alias("decisions_generated"),
        F.sum("confidence").alias("_conf"),
        F.count("confidence").alias("confidence_samples"),
        F.sum("duration_ms").alias("_dur"),
        F.count("duration_ms").alias("duration_samples"),
        F.count_if(is_decision & (rec == "APPROVE")).alias("approve_count"),
        F.count_if(is_decision & (rec == "DECLINE")).alias("decline_count"),
        F.count_if(is_decision & (rec == "REFER")).alias("refer_count"),
        F.count_if(t == "override").alias("human_override_count"),
        F.min(F.when(started, F.col("recorded_at"))).alias("first_seen_at"),
        F.max(F.when(~started, F.col("global_position"))).alias("_assigned_pos"),
        F.max_by("recorded_at", F.when(~started, F.col("global_position"))).alias("_assigned_at"),
    )
    totals = stage(totals)
    # The last output sets last_seen_at; only starts after it can raise it further.
    later = (
        rows.where(started).select(*by, "global_position", "recorded_at")
        .join(totals.select(*by, "_assigned_pos"), by)
        .where("_assigned_pos is null or global_position > _assigned_pos")
        .groupBy(*by).agg(F.max("recorded_at").alias("_later_start"))
    )

    def rate(name: str):
        n = F.col("decisions_generated")
        return F.when(n > 0, F.col(name) / n).otherwise(F.lit(0.0))

    return totals.join(later, by, "left").select(
        *by, "total_sessions", "analyses_completed", "decisions_generated",
        (F.col("_conf").cast("double") / F.nullif("confidence_samples", F.lit(0))).alias("avg_confidence_score"),
        (F.col("_dur").cast("double") / F.nullif("duration_samples", F.lit(0))).alias("avg_duration_ms"),
        "approve_count", "decline_count", "refer_count", "human_override_count",
        rate("approve_count").alias("approve_rate"), rate("decline_count").alias("decline_rate"),
        rate("refer_count").alias("refer_rate"), rate("human_override_count").alias("human_override_rate"),
        "confidence_samples", "duration_samples", "first_seen_at",
        F.greatest("_assigned_at", "_later_start").alias("last_seen_at"),
    )
