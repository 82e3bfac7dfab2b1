"""Counterfactual branches: the timeline without what depends on a replaced event, replayed and judged."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from foldstone.functions import payload as P
from foldstone.operators import lineage
from foldstone.operators.agents import agent_performance
from foldstone.operators.compliance import compliance_current
from foldstone.operators.scan import number_rows
from foldstone.operators.summary import application_summary
from foldstone.schema import ANCHOR_TYPES, LEDGER_COLUMNS
from foldstone.session import stage

KEYS = ("branch", "scope")
CONFIDENCE_FLOOR, FRAUD_CEILING = 0.60, 0.65
REASONS = {
    "none": "No credit analysis exists in the counterfactual branch.",
    "blocked": "Compliance remains blocked in the counterfactual branch.",
    "high": "High risk credit outcome still violates the approval policy.",
    "unsure": "Confidence is below the floor, so the case must be referred.",
    "fraud": "Fraud score remains too high for approval.",
    "unknown": "Requested amount or recommended limit is unavailable.",
    "short": "The counterfactual credit limit does not fully cover the request.",
    "fine": "Risk tier, confidence, compliance, and fraud signals support approval.",
}


@dataclass(frozen=True)
class BranchedTimelines:
    """Real and counterfactual events (columns ``branch``, ``scope`` = application) and what was left out."""

    events: DataFrame
    divergence: DataFrame


def branch_timelines(ledger: DataFrame, branch_type: str, injected: DataFrame) -> BranchedTimelines:
    """Replace the first ``branch_type`` event of every application that has one.

    ``injected``: application_id, seq, event_type, event_version, payload, recorded_at and optionally metadata. Injected
    events come last, in the stream of the replaced event, and inherit its metadata unless they carry their own.
    """
    related = stage(lineage.application_events(ledger))
    branches = stage(lineage.branch_points(related, branch_type))
    fallen = stage(lineage.dependents(related, branches))
    replaced = branches.select(
        "application_id", F.lit("replaced").alias("kind"), "branch.event_type", "branch.stream_id", "branch.stream_position", "branch.event_id", "branch.global_position"
    )
    divergence = replaced.unionByName(fallen.withColumn("kind", F.lit("skipped_dependent")))
    real = related.join(branches.select("application_id"), "application_id", "left_semi")
    kept = real.join(divergence.select("application_id", "event_id"), ["application_id", "event_id"], "left_anti")
    own = F.col("metadata") if "metadata" in injected.columns else F.lit(None).cast("string")
    added = injected.withColumn("_meta", own).drop("metadata").join(branches, "application_id").select(
        "application_id", F.concat_ws("/", F.lit("injected"), "application_id", F.col("seq").cast("string")).alias("event_id"), F.col("branch.stream_id").alias("stream_id"),
        F.lit(None).cast("bigint").alias("stream_position"), (F.lit(1 << 61) + F.col("seq")).cast("bigint").alias("global_position"), "event_type", "event_version", "payload",
        F.coalesce("_meta", "branch.metadata").alias("metadata"), "recorded_at",
    )
    counterfactual = kept.unionByName(added.select(*kept.columns))
    both = real.withColumn("branch", F.lit("real")).unionByName(counterfactual.withColumn("branch", F.lit("counterfactual")))
    return BranchedTimelines(both.withColumnRenamed("application_id", "scope").select(*KEYS, *LEDGER_COLUMNS), divergence)


def timeline_positions(events: DataFrame) -> DataFrame:
    """Number each timeline from 1, as a log of its own would."""
    return number_rows(events, list(KEYS), "global_position", "timeline_position")


def replay_branches(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Summary, compliance state and agent rows of each timeline; agents only where they opened a session in it."""
    summary = application_summary(events, KEYS).where("application_id = scope")
    compliance = compliance_current(events, KEYS).where("application_id = scope")
    anchors = P.with_fields(events.where(F.col("event_type").isin(*ANCHOR_TYPES)), "application_id", "agent_id")
    own = anchors.where("p.application_id = scope").select(*KEYS, F.col("p.agent_id").alias("agent_id")).distinct()
    agents = agent_performance(events, KEYS).join(own, [*KEYS, "agent_id"], "left_semi")
    return summary, compliance, agents


def recommend(tier: Column, confidence: Column, limit: Column, requested: Column, fraud: Column, verdict: Column, has_credit: Column) -> Column:
    """Recommendation, amount (two decimals, half to even) and reason from the signals of a branch."""
    def answer(decision: str | None, amount: Column, reason: str) -> Column:
        return F.struct(F.lit(decision).cast("string").alias("recommendation"), amount.cast("decimal(18,2)").alias("amount"), F.lit(REASONS[reason]).alias("reason"))

    none = F.lit(None).cast("decimal(18,2)")
    return (
        F.when(~has_credit, answer(None, none, "none"))
        .when(F.coalesce(verdict, F.lit("")) == "BLOCKED", answer("DECLINE", none, "blocked"))
        .when(F.upper(F.coalesce(tier, F.lit(""))) == "HIGH", answer("DECLINE", none, "high"))
        .when(F.coalesce(confidence, F.lit(0.0)) < CONFIDENCE_FLOOR, answer("REFER", none, "unsure"))
        .when(F.coalesce(fraud, F.lit(0.0)) >= FRAUD_CEILING, answer("DECLINE", none, "fraud"))
        .when(requested.isNull() | limit.isNull(), answer("REFER", none, "unknown"))
        .when(limit < requested, answer("REFER", F.bround(limit, 2), "short"))
        .otherwise(answer("APPROVE", F.bround(requested, 2), "fine"))
    )


def branch_outcomes(timelines: BranchedTimelines) -> DataFrame:
    """One row per application and branch: state, tier, verdict and the observed or projected recommendation."""
    events = stage(timelines.events)
    summary = application_summary(events, KEYS).where("application_id = scope")
    compliance = compliance_current(events, KEYS).where("application_id = scope")
    signals = P.with_fields(
        events.where(F.col("event_type").isin("CreditAnalysisCompleted", "FraudScreeningCompleted", "DecisionGenerated")),
        "decision struct<risk_tier:string,confidence:string,recommended_limit_usd:string>", "fraud_score", "recommendation", "approved_amount_usd",
    )
    t = F.col("event_type")

    def latest(name: str, value: Column) -> Column:
        return F.max_by(value, F.when(t == name, F.col("global_position")))

    latest_signals = signals.groupBy(*KEYS).agg(
        latest("CreditAnalysisCompleted", F.col("p.decision")).alias("credit"),
        F.bool_or(t == "CreditAnalysisCompleted").alias("has_credit"),
        latest("FraudScreeningCompleted", F.col("p.fraud_score").try_cast("double")).alias("fraud"),
        latest("DecisionGenerated", F.struct("p.recommendation", F.col("p.approved_amount_usd").alias("amount"))).alias("decided"),
    )
    sizes = events.groupBy(*KEYS).agg(F.count("*").alias("events"))
    joined = sizes.join(summary.drop("application_id"), [*KEYS], "left").join(compliance.select(*KEYS, "overall_verdict"), [*KEYS], "left").join(latest_signals, [*KEYS], "left")
    ladder = recommend(
        F.col("credit.risk_tier"), F.col("credit.confidence").try_cast("double"), P.money(F.col("credit.recommended_limit_usd")), F.col("requested_amount_usd"),
        F.col("fraud"), F.col("overall_verdict"), F.coalesce("has_credit", F.lit(False)),
    )
    real = F.col("branch") == "real"
    observed = F.lit("Observed recommendation from the real timeline.")
    return joined.withColumn("_l", ladder).select(
        F.col("scope").alias("application_id"), "branch", "events", "state", "risk_tier", "fraud_score", "overall_verdict", "requested_amount_usd",
        F.when(real, F.col("decided.recommendation")).otherwise(F.col("_l.recommendation")).alias("recommendation"),
        F.when(real, P.money(F.col("decided.amount"))).otherwise(F.col("_l.amount")).alias("amount_usd"),
        F.when(real, observed).otherwise(F.col("_l.reason")).alias("reasoning"),
    )
