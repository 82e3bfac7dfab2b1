"""Batch validation of commands against replayed state, and the events accepted commands produce."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from foldstone.functions import payload as P
from foldstone.operators.compliance import compliance_record
from foldstone.operators.loans import replay_loans
from foldstone.operators.sessions import session_outputs, session_records
from foldstone.schema import REGULATION_RULES, REGULATION_SET
from foldstone.session import stage

PENDING_HUMAN = ("APPROVED_PENDING_HUMAN", "DECLINED_PENDING_HUMAN", "PENDING_HUMAN_REVIEW")
CONTRIBUTIONS = ("CreditAnalysisCompleted", "FraudScreeningCompleted", "ComplianceCheckCompleted")
FLOOR = 0.60
DEFAULT_DECLINE = "Human review decline"
REVIEW_REASON = "Low confidence or manual escalation required"
# Rejection reasons.
NOT_SUBMITTABLE = "Application has already been submitted"
SESSION_EXISTS = "Agent session already exists"
NO_CONTEXT = "Agent session must start with a context event before any decision"
OTHER_APPLICATION = "Agent session belongs to another application"
OTHER_MODEL = "Agent session is locked to another model version"
NOT_CREDIT = "Loan application is not awaiting credit analysis"
NO_PACKAGE = "Document package is not ready for analysis"
LOCKED = "Credit analysis is model-version locked until a human override supersedes it"
NOT_FRAUD = "Loan application is not awaiting fraud screening completion"
NOT_COMPLIANCE = "Loan application is not in compliance review"
COMPLIANCE_DONE = "Compliance check already completed for this application"
BAD_OUTCOME = "Unknown compliance rule outcome"
NO_SESSIONS = "DecisionGenerated must reference contributing agent sessions"
SAME_SESSIONS = "DecisionGenerated contains duplicate contributing sessions"
NO_OUTPUTS = "Contributing agent session has no recorded domain outputs"
NO_DECISION_EVENT = "Contributing session does not contain a recorded decision event"
NOT_DECISION = "Loan application is not pending a decision"
BELOW_FLOOR = "Decisions below the confidence floor must be REFER"
NO_COMPLIANCE = "Compliance must be complete before generating a decision"
ONLY_DECLINE = "A compliance hard block allows only DECLINE"
NOT_HUMAN = "Loan application is not awaiting human resolution"
NO_OVERRIDE_REASON = "override_reason is required when override=True"
NEEDS_OVERRIDE = "Changing the recommendation requires override=True"
INCOMPLETE_APPROVAL = "Approval requires approved_amount_usd, interest_rate_pct, and term_months"
NOT_CLEAR = "Application cannot be approved before compliance is fully clear"
OVER_LIMIT = "Approved amount exceeds the latest agent-assessed maximum limit"
BAD_FINAL = "Unsupported final decision"


@dataclass(frozen=True)
class States:
    """Replayed state the validations join: one row per application, one per session stream, session outputs."""

    applications: DataFrame
    sessions: DataFrame
    outputs: DataFrame


def replay_states(ledger: DataFrame) -> States:
    """Replay loans, compliance records and sessions once for a batch of commands."""
    loans = replay_loans(ledger).select("application_id", "version", "state", "credit_requested", "fraud_requested", "compliance_requested", "decision_requested", "human_override", "error_position")
    records = compliance_record(ledger).select(
        "application_id", F.col("completed").alias("compliance_completed"), F.col("has_hard_block").alias("hard_block"), "cleared_for_approval", F.col("version").alias("compliance_version")
    )
    facts = P.with_fields(
        ledger.where(F.col("event_type").isin("PackageReadyForAnalysis", "CreditAnalysisCompleted")), "application_id", "decision struct<recommended_limit_usd:string>"
    ).groupBy(F.regexp_extract("stream_id", "^[^-]+-(.*)$", 1).alias("application_id")).agg(
        F.bool_or((F.col("event_type") == "PackageReadyForAnalysis") & F.col("stream_id").startswith("docpkg-")).alias("package_ready"),
        F.bool_or((F.col("event_type") == "CreditAnalysisCompleted") & F.col("stream_id").startswith("credit-")).alias("credit_done"),
        F.max_by(P.money(F.col("p.decision.recommended_limit_usd")), F.when((F.col("event_type") == "CreditAnalysisCompleted") & F.col("stream_id").startswith("credit-"), F.col("stream_position"))).alias("latest_limit"),
    )
    applications = loans.join(records, "application_id", "full").join(facts, "application_id", "full")
    sessions = session_records(ledger).select(F.col("stream_id").alias("session_stream"), F.col("started").alias("session_started"), F.col("application_id").alias("session_application"), F.col("model_version").alias("session_model"))
    outputs = session_outputs(ledger).select(F.col("stream_id").alias("session_stream"), "output_event_type", "output_stream_id")
    return States(stage(applications), stage(sessions), outputs)


def _first(*checks: tuple[Column, str]) -> Column:
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(text)) for bad, text in checks])


def _with_states(commands: DataFrame, states: States, session: bool) -> DataFrame:
    df = commands.join(states.applications, "application_id", "left")
    flags = ["credit_requested", "fraud_requested", "compliance_requested", "decision_requested", "human_override", "compliance_completed", "hard_block", "cleared_for_approval", "package_ready", "credit_done"]
    df = df.fillna(False, flags).fillna("NEW", ["state"]).fillna(-1, ["version", "compliance_version"])
    if session:
        stream = F.concat_ws("-", F.lit("agent"), "agent_type", "session_id")
        df = df.withColumn("session_stream", stream).join(states.sessions, "session_stream", "left").fillna(False, ["session_started"])
    return df


def _judged(df: DataFrame, commands: DataFrame, reason: Column, *extra: str) -> DataFrame:
    replayed = F.when(F.col("error_position").isNotNull(), F.lit("Loan stream cannot be replayed")) if "error_position" in df.columns else F.lit(None)
    why = F.coalesce(replayed, reason)
    return df.select(*commands.columns, *extra, why.isNull().alias("accepted"), why.alias("reason"))


def _session_checks(model: Column | None) -> list[tuple[Column, str]]:
    checks = [(~F.col("session_started"), NO_CONTEXT), (~F.col("session_application").eqNullSafe(F.col("application_id")), OTHER_APPLICATION)]
    if model is not None:
        checks.append((F.col("session_model").isNotNull() & (F.col("session_model") != "") & model.isNotNull() & (model != F.col("session_model")), OTHER_MODEL))
    return checks


def validate_submissions(commands: DataFrame, states: States) -> DataFrame:
    df = _with_states(commands, states, session=False)
    return _judged(df, commands, _first((F.col("state") != "NEW", NOT_SUBMITTABLE)), "version")


def validate_session_starts(commands: DataFrame, states: States) -> DataFrame:
    df = commands.withColumn("session_stream", F.concat_ws("-", F.lit("agent"), "agent_type", "session_id")).join(states.sessions, "session_stream", "left")
    return _judged(df, commands, _first((F.coalesce("session_started", F.lit(False)), SESSION_EXISTS)))


def validate_credit(commands: DataFrame, states: States) -> DataFrame:
    df = _with_states(commands, states, session=True)
    return _judged(df, commands, _first(
        ((F.col("state") != "AWAITING_ANALYSIS") | ~F.col("credit_requested"), NOT_CREDIT), *_session_checks(F.col("model_version")),
        (~F.col("package_ready"), NO_PACKAGE), (F.col("credit_done") & ~F.col("human_override"), LOCKED),
    ), "version")


def validate_fraud(commands: DataFrame, states: States) -> DataFrame:
    df = _with_states(commands, states, session=True)
    return _judged(df, commands, _first(((F.col("state") != "ANALYSIS_COMPLETE") | ~F.col("fraud_requested"), NOT_FRAUD), *_session_checks(F.col("model_version"))), "version")


def validate_compliance(commands: DataFrame, states: States) -> DataFrame:
    """``rule_results``: array of structs with rule_id, outcome, is_hard_block (one per rule of the regulation set)."""
    df = _with_states(commands, states, session=True)
    odd = F.exists("rule_results", lambda r: ~F.upper(F.coalesce(r["outcome"], F.lit("unknown"))).isin("PASS", "FAIL", "NOTE"))
    return _judged(df, commands, _first(
        ((F.col("state") != "COMPLIANCE_REVIEW") | ~F.col("compliance_requested"), NOT_COMPLIANCE), *_session_checks(P.filled(F.col("model_version"))),
        (F.col("compliance_completed"), COMPLIANCE_DONE), (odd, BAD_OUTCOME),
    ), "version", "compliance_version")


def validate_decisions(commands: DataFrame, states: States) -> DataFrame:
    """Decisions with their contributing sessions; the first unfit session in order decides the reason."""
    listed = commands.select("command_id", "application_id", F.posexplode("contributing_sessions").alias("i", "session_stream"))
    wrote = listed.join(states.outputs, "session_stream", "left").groupBy("command_id", "i").agg(
        F.count("output_event_type").alias("outputs"),
        F.coalesce(F.bool_or(F.col("output_event_type").isin(*CONTRIBUTIONS) & F.endswith("output_stream_id", F.concat(F.lit("-"), F.col("application_id")))), F.lit(False)).alias("decided"),
    )
    checked = listed.join(states.sessions, "session_stream", "left").fillna(False, ["session_started"]).join(wrote, ["command_id", "i"])
    unfit = checked.withColumn("why", _first(*_session_checks(None), (F.col("outputs") == 0, NO_OUTPUTS), (~F.col("decided"), NO_DECISION_EVENT)))
    worst = unfit.where("why is not null").groupBy("command_id").agg(F.min_by("why", "i").alias("_unfit"))
    df = _with_states(commands, states, session=True).join(worst, "command_id", "left")
    n = F.size("contributing_sessions")
    reason = F.coalesce(
        _first((n <= 0, NO_SESSIONS), (F.size(F.array_distinct("contributing_sessions")) < n, SAME_SESSIONS)),
        F.col("_unfit"),
        _first(
            ((F.col("state") != "PENDING_DECISION") | ~F.col("decision_requested"), NOT_DECISION), ((F.col("confidence") < FLOOR) & (F.col("recommendation") != "REFER"), BELOW_FLOOR),
            (~F.col("compliance_completed"), NO_COMPLIANCE), (F.col("hard_block") & (F.col("recommendation") != "DECLINE"), ONLY_DECLINE), *_session_checks(F.col("orchestrator_model")),
        ),
    )
    return _judged(df, commands, reason, "version")


def validate_reviews(commands: DataFrame, states: States) -> DataFrame:
    df = _with_states(commands, states, session=False)
    final = F.upper("final_decision")
    approve = final == "APPROVE"
    changed = (F.col("original_recommendation") != "REFER") & (F.col("final_decision") != F.col("original_recommendation"))
    return _judged(df, commands, _first(
        (~F.col("state").isin(*PENDING_HUMAN), NOT_HUMAN), (F.col("override") & P.filled(F.col("override_reason")).isNull(), NO_OVERRIDE_REASON), (changed & ~F.col("override"), NEEDS_OVERRIDE),
        (approve & (F.col("approved_amount_usd").isNull() | F.col("interest_rate_pct").isNull() | F.col("term_months").isNull()), INCOMPLETE_APPROVAL),
        (approve & ~F.col("cleared_for_approval"), NOT_CLEAR), (approve & (F.col("approved_amount_usd") > F.col("latest_limit")), OVER_LIMIT), (~final.isin("APPROVE", "DECLINE"), BAD_FINAL),
    ), "version")


# ---- events of accepted commands ----------------------------------------------------------------------------------
_EVENT = "struct<event_type:string,event_version:int,payload:string>"


def _event(name: str, *fields: Column, version: int = 1) -> Column:
    return F.struct(F.lit(name).alias("event_type"), F.lit(version).alias("event_version"), F.to_json(F.struct(*fields)).alias("payload"))


def _taken(df: DataFrame, *names: str) -> list[Column]:
    """The named fields of a command, as far as it has them."""
    return [F.col(n) for n in names if n in df.columns]


def _or_else(df: DataFrame, name: str, value: Column) -> Column:
    """A field of the command; where it is absent or null, the given value."""
    return F.coalesce(F.col(name), value) if name in df.columns else value


def produced_events(kind: str, validated: DataFrame, heads: DataFrame) -> DataFrame:
    """Events per accepted command: command_id, stream_id, expected_version, seq, event_type, event_version, payload.

    ``heads`` (stream_id, current_version) places follow-ups: they name the event that triggered them as stream:position.
    Payload fields are those of the command; a command that has all required fields gives valid events.
    """
    ok = validated.where("accepted")
    app, session, at = F.col("application_id"), F.col("session_id"), F.col("at")
    side = {"credit": "credit", "fraud": "fraud", "compliance": "compliance"}.get(kind)
    if side is not None or kind == "session":
        known = heads.select(F.col("stream_id").alias("_side"), F.col("current_version").alias("_side_version"))
        name = F.concat(F.lit(side + "-"), app) if side else F.concat_ws("-", F.lit("agent"), "agent_type", "session_id")
        ok = ok.withColumn("_side", name).join(known, "_side", "left").withColumn("_side_version", F.coalesce("_side_version", F.lit(-1)).cast("bigint"))
    loan = F.concat(F.lit("loan-"), app)
    base = F.greatest(F.col("_side_version"), F.lit(0)) if side else None
    first_of_side = F.concat_ws(":", "_side", (base + 1).cast("string")).alias("triggered_by_event_id") if side else None
    if kind == "submit":
        fields = _taken(ok, "application_id", "applicant_id", "requested_amount_usd", "loan_purpose", "loan_term_months", "submission_channel", "contact_email", "contact_name", "application_reference")
        batches = [(loan, F.col("version"), F.array(
            _event("ApplicationSubmitted", *fields, at.alias("submitted_at")),
            _event(
                "DocumentUploadRequested", app, *[c.alias("required_document_types") for c in _taken(ok, "requested_document_types")],
                _or_else(ok, "deadline", at + F.expr("interval 7 days")).alias("deadline"), *_taken(ok, "requested_by"),
            ),
        ))]
    elif kind == "session":
        fields = _taken(ok, "session_id", "agent_type", "agent_id", "application_id", "model_version", "langgraph_graph_version", "context_source", "context_token_count")
        batches = [(F.col("_side"), F.col("_side_version"), F.array(_event("AgentSessionStarted", *fields, at.alias("started_at"))))]
    elif kind == "credit":
        fields = _taken(ok, "decision", "model_version", "model_deployment_id", "input_data_hash", "analysis_duration_ms", "regulatory_basis")
        batches = [
            (F.col("_side"), F.col("_side_version"), F.array(_event("CreditAnalysisCompleted", app, session, *fields, at.alias("completed_at"), version=2))),
            (loan, F.col("version"), F.array(_event("FraudScreeningRequested", app, first_of_side, at.alias("requested_at")))),
        ]
    elif kind == "fraud":
        model = _taken(ok, "screening_model_version") or [c.alias("screening_model_version") for c in _taken(ok, "model_version")]
        fields = _taken(ok, "fraud_score", "risk_level", "anomalies_found", "recommendation", "input_data_hash")
        batches = [
            (F.col("_side"), F.col("_side_version"), F.array(_event("FraudScreeningCompleted", app, session, *fields, *model, at.alias("completed_at")))),
            (loan, F.col("version"), F.array(_event(
                "ComplianceCheckRequested", app, first_of_side, at.alias("requested_at"),
                F.lit(REGULATION_SET).alias("regulation_set_version"), F.array(*[F.lit(r) for r in REGULATION_RULES]).alias("rules_to_evaluate"),
            ))),
        ]
    elif kind == "compliance":
        batches = _compliance_batches(loan, base, at, ok.schema["rule_results"].dataType.elementType.names)
    elif kind == "decision":
        fields = _taken(ok, "recommendation", "confidence", "approved_amount_usd", "conditions", "executive_summary", "key_risks", "contributing_sessions", "model_versions")
        decision = _event("DecisionGenerated", app, session.alias("orchestrator_session_id"), *fields, at.alias("generated_at"), version=2)
        review = _event("HumanReviewRequested", app, F.lit(REVIEW_REASON).alias("reason"), F.concat(F.lit("decision/"), F.col("command_id")).alias("decision_event_id"), at.alias("requested_at"))
        batches = [(loan, F.col("version"), F.array_compact(F.array(decision, F.when(F.col("recommendation") == "REFER", review))))]
    elif kind == "review":
        done = _event("HumanReviewCompleted", *[F.col(c) for c in ("application_id", "reviewer_id", "override", "original_recommendation", "final_decision", "override_reason")], at.alias("reviewed_at"))
        approved = _event("ApplicationApproved", app, F.col("approved_amount_usd"), F.col("interest_rate_pct"), F.col("term_months"), *_taken(ok, "conditions"), F.col("reviewer_id").alias("approved_by"), F.to_date(at).cast("string").alias("effective_date"), at.alias("approved_at"))
        reasons = F.when(F.size("decline_reasons") > 0, F.col("decline_reasons")).otherwise(F.array(F.lit(DEFAULT_DECLINE)))
        notice = _or_else(ok, "adverse_action_notice_required", F.lit(True)).alias("adverse_action_notice_required")
        declined = _event("ApplicationDeclined", app, reasons.alias("decline_reasons"), F.col("reviewer_id").alias("declined_by"), notice, *_taken(ok, "adverse_action_codes"), at.alias("declined_at"))
        batches = [(loan, F.col("version"), F.array(done, F.when(F.upper("final_decision") == "APPROVE", approved).otherwise(declined)))]
    else:
        raise ValueError(f"unknown command kind {kind}")
    parts = F.array(*[F.struct(s.alias("stream_id"), v.cast("bigint").alias("expected_version"), e.cast(f"array<{_EVENT}>").alias("events")) for s, v, e in batches])
    spread = ok.select("command_id", F.inline(parts))
    return spread.select("command_id", "stream_id", "expected_version", F.posexplode("events").alias("seq", "e")).select("command_id", "stream_id", "expected_version", "seq", "e.*")


def _compliance_batches(loan: Column, base: Column, at: Column, given: list[str]) -> list[tuple[Column, Column, Column]]:
    app, session = F.col("application_id"), F.col("session_id")
    results = F.col("rule_results")

    def outcome_is(name: str):
        return lambda r: F.upper(r["outcome"]) == name

    def rule_event(r: Column) -> Column:
        def own(*names: str) -> list[Column]:
            return [r[n].alias(n) for n in names if n in given]

        def text(name: str, value: str) -> Column:
            found = F.nullif(r[name], F.lit("")) if name in given else F.lit(None).cast("string")
            return F.coalesce(found, F.lit(value)).alias(name)

        common = (app, session, *own("rule_id", "rule_name"), at.alias("evaluated_at"))
        remedy = F.coalesce(r["remediation_available"], F.lit(False)) if "remediation_available" in given else F.lit(False)
        passed = _event("ComplianceRulePassed", *common, *own("rule_version", "evidence_hash"), text("evaluation_notes", ""))
        failed = _event(
            "ComplianceRuleFailed", *common, *own("rule_version", "evidence_hash"), text("failure_reason", "rule_failed"), F.coalesce(r["is_hard_block"], F.lit(False)).alias("is_hard_block"),
            remedy.alias("remediation_available"), *own("remediation_description"),
        )
        noted = _event("ComplianceRuleNoted", *common, text("note_type", "NOTE"), text("note_text", ""))
        return F.when(F.upper(r["outcome"]) == "PASS", passed).when(F.upper(r["outcome"]) == "FAIL", failed).otherwise(noted)

    failed = F.filter(results, outcome_is("FAIL"))
    hard = F.exists(failed, lambda r: F.coalesce(r["is_hard_block"], F.lit(False)))
    verdict = F.when(hard, "BLOCKED").when(F.size(failed) > 0, "CONDITIONAL").otherwise("CLEAR")
    opened = F.when(F.col("_side_version") == -1, _event("ComplianceCheckInitiated", app, session, F.lit(REGULATION_SET).alias("regulation_set_version"), F.transform(results, lambda r: r["rule_id"]).alias("rules_to_evaluate"), at.alias("initiated_at")))
    closed = _event(
        "ComplianceCheckCompleted", app, session, F.size(results).alias("rules_evaluated"), F.size(F.filter(results, outcome_is("PASS"))).alias("rules_passed"), F.size(failed).alias("rules_failed"),
        F.size(F.filter(results, outcome_is("NOTE"))).alias("rules_noted"), hard.alias("has_hard_block"), verdict.alias("overall_verdict"), at.alias("completed_at"),
    )
    events = F.concat(F.array_compact(F.array(opened)), F.transform(results, rule_event), F.array(closed))
    ids = F.transform(failed, lambda r: r["rule_id"])
    declined = _event("ApplicationDeclined", app, F.transform(ids, lambda r: F.concat(F.lit("Compliance hard block: "), r)).alias("decline_reasons"), F.lit("compliance_system").alias("declined_by"),
                      F.lit(True).alias("adverse_action_notice_required"), ids.alias("adverse_action_codes"), at.alias("declined_at"))
    asked = _event("DecisionRequested", app, F.lit(True).alias("all_analyses_complete"), F.concat_ws(":", "_side", (base + F.size(events)).cast("string")).alias("triggered_by_event_id"), at.alias("requested_at"))
    return [(F.col("_side"), F.col("_side_version"), events), (loan, F.col("version"), F.array(F.when(hard, declined).otherwise(asked)))]
