"""Rebuild verification: stored read models against an independent recomputation, field by field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from foldstone.functions import ids, payload as P
from foldstone.operators.agents import KEY, override_facts, session_facts
from foldstone.operators.scan import last, running
from foldstone.schema import COMPLIANCE_TYPES, HARD_BLOCK_REASON, OTHER_RECOMMENDATION_STATE, RECOMMENDATION_STATES, SUMMARY_STATES, SUMMARY_TYPES
from foldstone.session import stage

SUMMARY_FIELDS = ("state", "applicant_id", "requested_amount_usd", "approved_amount_usd", "risk_tier", "fraud_score", "compliance_status", "decision",
                  "sessions_completed", "last_event_type", "human_reviewer_id")


def as_text(value: Column, kind: str) -> Column:
    """Comparable text: decimals exact, floats to six places, lists as sets."""
    if kind.startswith("decimal"):
        return value.cast("decimal(18,2)").cast("string")
    if kind in ("double", "float"):
        return F.round(value, 6).cast("decimal(38,6)").cast("string")
    if kind.startswith("array"):
        return F.array_join(F.array_sort(F.array_distinct(value)), "|")
    return value.cast("string")


def field_rows(model: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Read model in long form: keys, field, value."""
    kinds = {f.name: f.dataType.simpleString() for f in model.schema.fields}
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), as_text(F.col(f), kinds[f]).alias("value")) for f in fields])
    return model.select(*keys, F.inline(pairs))


def compare_models(stored: DataFrame, expected: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row per difference: ``missing`` and ``unexpected`` keys, and ``mismatch`` per field."""
    kinds = {f.name: f.dataType.simpleString() for f in stored.schema.fields}
    e_kinds = {f.name: f.dataType.simpleString() for f in expected.schema.fields}
    left = stored.select(*keys, F.lit(True).alias("_s"), *[as_text(F.col(f), kinds[f]).alias(f"_s_{f}") for f in fields])
    right = expected.select(*keys, F.lit(True).alias("_e"), *[as_text(F.col(f), e_kinds[f]).alias(f"_e_{f}") for f in fields])
    joined = left.join(right, [*keys], "full")
    whole = F.when(F.col("_s").isNull(), F.struct(F.lit("missing").alias("problem"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("stored"), F.lit(None).cast("string").alias("expected")))
    whole = whole.when(F.col("_e").isNull(), F.struct(F.lit("unexpected").alias("problem"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("stored"), F.lit(None).cast("string").alias("expected")))
    both = F.col("_s").isNotNull() & F.col("_e").isNotNull()
    diffs = [
        F.when(both & ~F.col(f"_s_{f}").eqNullSafe(F.col(f"_e_{f}")), F.struct(F.lit("mismatch").alias("problem"), F.lit(f).alias("field"), F.col(f"_s_{f}").alias("stored"), F.col(f"_e_{f}").alias("expected")))
        for f in fields
    ]
    return joined.select(*keys, F.inline(F.array_compact(F.array(whole, *diffs))))


def compare_by_buckets(stored: DataFrame, expected: DataFrame, keys: Sequence[str], fields: Sequence[str], buckets: int = 4096) -> DataFrame:
    """The differences of ``compare_models``, looking only at the buckets of keys whose digests differ.

    Both sides are reduced to one digest per bucket (number and sum of the hashes of all rows, in any order); where these agree
    no row is joined, so two models that agree cost one aggregate each.
    """
    bucket = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets))

    def hashed(model: DataFrame) -> DataFrame:
        kinds = {f.name: f.dataType.simpleString() for f in model.schema.fields}
        row = F.xxhash64(*[F.col(k) for k in keys], *[F.struct(as_text(F.col(f), kinds[f])) for f in fields])
        return model.select(bucket.alias("_bucket"), row.cast("decimal(38,0)").alias("_hash")).groupBy("_bucket").agg(F.count("*").alias("_n"), F.sum("_hash").alias("_sum"))

    left, right = hashed(stored), hashed(expected)
    same = left.join(right, ["_bucket", "_n", "_sum"], "left_semi").select("_bucket")
    differing = stage(left.select("_bucket").union(right.select("_bucket")).distinct().join(same, "_bucket", "left_anti"))
    inside = [model.withColumn("_bucket", bucket).join(differing, "_bucket", "left_semi").drop("_bucket") for model in (stored, expected)]
    return compare_models(*inside, keys, fields)


def distribution(model: DataFrame, field: str, when_null: str | None = None) -> DataFrame:
    """Row counts by one field."""
    value = F.coalesce(F.col(field), F.lit(when_null)) if when_null is not None else F.col(field)
    return model.groupBy(value.alias(field)).agg(F.count("*").alias("rows"))


def expected_summary(ledger: DataFrame) -> DataFrame:
    """Application summary by another route: every event becomes field assignments, the last assignment of a field wins."""
    handled = P.with_fields(
        ledger.where(F.col("event_type").isin(*SUMMARY_TYPES)), "application_id", "applicant_id", "requested_amount_usd", "approved_amount_usd", "decision struct<risk_tier:string>",
        "fraud_score", "overall_verdict", "recommendation", "reviewer_id", "final_decision", "decline_reasons array<string>", "session_id",
    )
    t = F.col("event_type")
    owner = F.coalesce("p.application_id", ids.stream_owner())
    known = F.create_map(*[F.lit(x) for pair in SUMMARY_STATES.items() for x in pair])
    advice = F.create_map(*[F.lit(x) for pair in RECOMMENDATION_STATES.items() for x in pair])
    rows = stage(handled.select(
        owner.alias("application_id"), "global_position", t, F.col("p"), F.json_object_keys("payload").alias("_keys"),
        F.when(t == "ComplianceCheckCompleted", F.struct(F.col("p.overall_verdict").alias("v"))).alias("_verdict"),
    ).where("application_id is not null"))
    seen = running(rows, ["application_id"], "global_position", {"_known": last(F.col("_verdict"))})
    by_reason = F.exists("p.decline_reasons", lambda r: F.coalesce(r.contains(HARD_BLOCK_REASON), F.lit(False)))
    blocked = F.coalesce(F.col("_known.v") == "BLOCKED", F.lit(False)) | F.coalesce(by_reason, F.lit(False))
    state = (
        F.when(t == "ApplicationDeclined", F.when(blocked, F.lit("DECLINED_COMPLIANCE")).otherwise(F.lit("FINAL_DECLINED")))
        .when(t == "DecisionGenerated", F.coalesce(advice[F.col("p.recommendation")], F.lit(OTHER_RECOMMENDATION_STATE))).otherwise(known[t])
    )

    def put(field: str, when: Column, value: Column) -> Column:
        return F.when(when, F.struct(F.lit(field).alias("field"), value.cast("string").alias("value")))

    requested, approved = P.money(F.col("p.requested_amount_usd")), P.money(F.col("p.approved_amount_usd"))
    score = as_text(F.col("p.fraud_score").try_cast("double"), "double")
    choice = F.when(t == "DecisionGenerated", F.col("p.recommendation")).when(t == "HumanReviewCompleted", F.col("p.final_decision")).when(t == "ApplicationApproved", F.lit("APPROVE")).otherwise(F.lit("DECLINE"))
    assignments = F.array_compact(F.array(
        put("state", state.isNotNull(), state),
        put("applicant_id", (t == "ApplicationSubmitted") & F.array_contains("_keys", "applicant_id"), F.col("p.applicant_id")),
        put("requested_amount_usd", t == "ApplicationSubmitted", requested),
        put("approved_amount_usd", t.isin("DecisionGenerated", "ApplicationApproved") & approved.isNotNull(), approved),
        put("risk_tier", t == "CreditAnalysisCompleted", F.col("p.decision.risk_tier")),
        put("fraud_score", t == "FraudScreeningCompleted", score),
        put("compliance_status", t == "ComplianceCheckCompleted", F.col("p.overall_verdict")),
        put("decision", t.isin("DecisionGenerated", "HumanReviewCompleted", "ApplicationApproved", "ApplicationDeclined"), choice),
        put("last_event_type", F.lit(True), t),
        put("human_reviewer_id", t == "HumanReviewCompleted", F.col("p.reviewer_id")),
    ))
    spread = seen.select("application_id", "global_position", F.inline(assignments))
    final = spread.groupBy("application_id", "field").agg(F.max_by("value", "global_position").alias("value"))
    counted = rows.where((t == "AgentSessionCompleted") & P.filled(F.col("p.session_id")).isNotNull()).groupBy("application_id").agg(F.count_distinct("p.session_id").cast("string").alias("value"))
    return final.unionByName(counted.select("application_id", F.lit("sessions_completed").alias("field"), "value"))


def verify_summary(stored: DataFrame, ledger: DataFrame) -> DataFrame:
    """Differences between a stored application summary and its recomputation, in long form."""
    expected = expected_summary(ledger)
    apps = expected.select("application_id").distinct().withColumn("_e", F.lit(True))
    kept = stored.select("application_id").distinct().withColumn("_s", F.lit(True))
    keys = kept.join(apps, "application_id", "full")
    lost = keys.where("_s is null").select("application_id", F.lit("missing").alias("problem"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("stored"), F.lit(None).cast("string").alias("expected"))
    extra = keys.where("_e is null").select("application_id", F.lit("unexpected"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    blank = F.create_map(F.lit("state"), F.lit("NEW"), F.lit("sessions_completed"), F.lit("0"))
    stored_rows = field_rows(stored, ["application_id"], SUMMARY_FIELDS).withColumnRenamed("value", "stored").join(apps, "application_id", "left_semi")
    compared = stored_rows.join(expected.withColumnRenamed("value", "expected").withColumn("_hit", F.lit(True)), ["application_id", "field"], "left")
    wanted = F.when(F.col("_hit"), F.col("expected")).otherwise(blank[F.col("field")])
    wrong = compared.withColumn("expected", wanted).where(~F.col("stored").eqNullSafe(F.col("expected")))
    return lost.union(extra).union(wrong.select("application_id", F.lit("mismatch"), "field", "stored", "expected"))


COMPLIANCE_FIELDS = ("session_id", "regulation_set_version", "required_rules", "passed_count", "failed_count", "noted_count", "hard_block_rules", "completed", "overall_verdict",
                     "last_event_type", "checkpoint_position", "snapshot_version")
_OPEN, _DONE = "ComplianceCheckInitiated", "ComplianceCheckCompleted"


def expected_compliance(ledger: DataFrame) -> DataFrame:
    """Current compliance state by another route: minima, maxima and counts over the events since the last opening, no scan in order."""
    rows = P.with_fields(
        ledger.where(F.col("event_type").isin(*COMPLIANCE_TYPES)), "application_id", "session_id", "regulation_set_version", "rules_to_evaluate array<string>", "rule_id",
        "is_hard_block", "has_hard_block", "overall_verdict",
    ).withColumn("application_id", F.col("p.application_id")).where("application_id is not null")
    by, pos, t = "application_id", F.col("global_position"), F.col("event_type")
    rows = stage(rows.select(by, "global_position", "event_type", "p"))
    opening = F.when(t == _OPEN, pos)
    whole = rows.groupBy(by).agg(
        F.count("*").alias("snapshot_version"), F.max_by("event_type", "global_position").alias("last_event_type"), (F.max("global_position") + 1).alias("checkpoint_position"),
        F.max(opening).alias("_opened"), F.max_by(F.struct("p.session_id", "p.regulation_set_version", "p.rules_to_evaluate"), opening).alias("_o"),
    )
    since = stage(rows.join(whole.select(by, "_opened"), by).where("_opened is null or global_position > _opened").drop("_opened"))
    failed, hard = t == "ComplianceRuleFailed", (t == "ComplianceRuleFailed") & P.truthy(F.col("p.is_hard_block"))
    counted = since.groupBy(by).agg(
        F.count_if(t == "ComplianceRulePassed").alias("passed_count"), F.count_if(failed).alias("failed_count"), F.count_if(t == "ComplianceRuleNoted").alias("noted_count"),
        F.bool_or(t == _DONE).alias("completed"), F.max_by("p.overall_verdict", F.when(t == _DONE, pos)).alias("overall_verdict"),
        F.min(F.when(failed, pos)).alias("_first_failed"), F.min(F.when(hard, pos)).alias("_first_hard"),
    )
    # The first hard verdict after a failure and before any listed block makes blocks of the failures before it.
    verdicts = since.where((t == _DONE) & P.truthy(F.col("p.has_hard_block"))).select(by, "global_position").join(counted.select(by, "_first_failed", "_first_hard"), by)
    taken = verdicts.where("global_position > _first_failed and (_first_hard is null or global_position < _first_hard)").groupBy(by).agg(F.min("global_position").alias("_cut"))
    blocks = since.where(failed).join(taken, by, "left").where(P.truthy(F.col("p.is_hard_block")) | (pos < F.col("_cut"))).groupBy(by).agg(F.collect_set("p.rule_id").alias("hard_block_rules"))
    none = F.array().cast("array<string>")
    joined = whole.join(counted, by, "left").join(blocks, by, "left")
    return joined.select(
        by, F.col("_o.session_id").alias("session_id"), F.col("_o.regulation_set_version").alias("regulation_set_version"), F.coalesce("_o.rules_to_evaluate", none).alias("required_rules"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("passed_count", "failed_count", "noted_count")], F.coalesce("hard_block_rules", none).alias("hard_block_rules"),
        F.coalesce("completed", F.lit(False)).alias("completed"), "overall_verdict", "last_event_type", "checkpoint_position", "snapshot_version",
    )


AGENT_FIELDS = ("total_sessions", "analyses_completed", "decisions_generated", "avg_confidence_score", "avg_duration_ms", "approve_count", "decline_count", "refer_count", "human_override_count")


def _credited(events: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """Each event with the interval (``since``, ``until``) of its key that it falls into; others are dropped."""
    after = Window.partitionBy(key).orderBy("since")
    spans = starts.withColumn("until", F.lead("since").over(after))
    return events.join(spans, key).where("global_position > since and (until is null or global_position < until)")


def expected_agents(ledger: DataFrame) -> DataFrame:
    """Agent performance by another route: starts and decisions become intervals of positions, and events are joined into them."""
    facts = stage(session_facts(ledger))
    starts = facts.where("_start is not null").select("session_id", F.col("global_position").alias("since"), F.struct(*[F.col(f"_start.{k}").alias(k) for k in KEY]).alias("agent"))
    outputs = stage(_credited(facts.where("_start is null").drop("_start"), starts, "session_id"))
    decided = outputs.where("event_type = 'DecisionGenerated' and application_id is not null").select("application_id", F.col("global_position").alias("since"), "agent")
    reviews = _credited(override_facts(ledger).where("application_id is not null"), decided, "application_id")
    work = outputs.select("agent", "event_type", "confidence", "duration_ms", "recommendation")
    rows = work.unionByName(starts.select("agent", F.lit("start").alias("event_type")), allowMissingColumns=True).unionByName(reviews.select("agent", F.lit("override").alias("event_type")), allowMissingColumns=True)
    t, decision = F.col("event_type"), F.col("event_type") == "DecisionGenerated"
    return rows.groupBy("agent").agg(
        F.count_if(t == "start").alias("total_sessions"), F.count_if(~t.isin("start", "override", "DecisionGenerated")).alias("analyses_completed"), F.count_if(decision).alias("decisions_generated"),
        (F.sum("confidence").cast("double") / F.count("confidence")).alias("avg_confidence_score"), (F.sum("duration_ms").cast("double") / F.count("duration_ms")).alias("avg_duration_ms"),
        *[F.count_if(decision & (F.col("recommendation") == r)).alias(f"{r.lower()}_count") for r in ("APPROVE", "DECLINE", "REFER")], F.count_if(t == "override").alias("human_override_count"),
    ).select("agent.*", *AGENT_FIELDS)


def verify_compliance(stored: DataFrame, ledger: DataFrame) -> DataFrame:
    """Differences between stored current compliance states and their recomputation."""
    return compare_by_buckets(stored, stage(expected_compliance(ledger)), ["application_id"], COMPLIANCE_FIELDS)


def verify_agents(stored: DataFrame, ledger: DataFrame) -> DataFrame:
    """Differences between stored agent rows and their recomputation."""
    return compare_by_buckets(stored, stage(expected_agents(ledger)), KEY, AGENT_FIELDS)
