"""Command validation, produced events and rebuild verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldstone.operators import agents, append, commands as C, evolution, loans, policy, summary, verify
from foldstone.plans.ctes import LOAN, agents_cte, summary_cte
from foldstone.plans.registry import query
from foldstone.session import stage
from foldstone.sources import adapters, stored

WORK = """
wf AS (SELECT *, 'W' || k AS app, CASE WHEN hard THEN least(k % 18 + 1, 15) ELSE k % 18 + 1 END AS depth, (['APPROVE','DECLINE','REFER'])[k % 3 + 1] AS rec
  FROM (SELECT c_custkey AS k, c_custkey % 5 = 0 AS hard FROM customer)),
ws AS (SELECT *, CASE WHEN hard AND depth >= 14 THEN 'DECLINED_COMPLIANCE' WHEN depth >= 18 THEN CASE WHEN k % 2 = 0 THEN 'FINAL_APPROVED' ELSE 'FINAL_DECLINED' END
    WHEN depth >= 16 THEN CASE rec WHEN 'APPROVE' THEN 'APPROVED_PENDING_HUMAN' WHEN 'DECLINE' THEN 'DECLINED_PENDING_HUMAN' ELSE 'PENDING_HUMAN_REVIEW' END
    WHEN depth >= 14 THEN 'PENDING_DECISION' WHEN depth >= 9 THEN 'COMPLIANCE_REVIEW' WHEN depth >= 7 THEN 'ANALYSIS_COMPLETE' WHEN depth >= 4 THEN 'AWAITING_ANALYSIS' ELSE 'SUBMITTED' END AS state,
    list_count(list_filter([1, 2, 4, 7, 9, 14, 16, 17, 18], lambda s: s <= depth)) AS version FROM wf)
"""
AT = "2024-06-01"


def _cases(spark, folder):
    c = adapters.table(spark, folder, "customer").select(F.col("c_custkey").alias("k"))
    key = F.col("k").cast("string")
    return c.select("k", F.concat(F.lit("cmd"), key).alias("command_id"), F.concat(F.lit("W"), key).alias("application_id"), F.lit("credit_analysis").alias("agent_type"),
                    F.concat(F.lit("w"), key).alias("session_id"), F.lit(AT).cast("timestamp").alias("at"))


def _states(spark, folder) -> C.States:
    replayed = []

    def build(name):
        def run(s, f):
            # One replay gives both tables.
            if not replayed:
                replayed.append(C.replay_states(stored.lifecycle_ledger(s, f)))
            return getattr(replayed[0], name)
        return run

    parts = {name: stored.derived(f"lifecycle-{name}", build(name), spark, folder) for name in ("applications", "sessions")}
    from foldstone.operators.sessions import session_outputs

    outputs = session_outputs(stored.lifecycle_ledger(spark, folder)).select(F.col("stream_id").alias("session_stream"), "output_event_type", "output_stream_id")
    return C.States(parts["applications"], parts["sessions"], outputs)


def _verdict(df, *extra):
    return df.select("application_id", *extra, "accepted", "reason")


@query("lifecycle_replay", f"WITH {WORK} SELECT app AS application_id, version, state, CAST(NULL AS BIGINT) AS error_position FROM ws")
def lifecycle_replay(spark, folder):
    return loans.replay_loans(stored.lifecycle_ledger(spark, folder)).select("application_id", "version", "state", "error_position")


@query(
    "command_submissions",
    f"""WITH {WORK} SELECT app AS application_id, version, false AS accepted, 'Application has already been submitted' AS reason FROM ws
    UNION ALL SELECT 'N' || k, -1, true, NULL FROM ws""",
)
def command_submissions(spark, folder):
    c = _cases(spark, folder)
    fresh = c.withColumn("application_id", F.concat(F.lit("N"), F.col("k").cast("string"))).withColumn("command_id", F.concat(F.lit("n"), "command_id"))
    return _verdict(C.validate_submissions(c.unionByName(fresh).select("command_id", "application_id", "at"), _states(spark, folder)), "version")


@query("command_session_starts", f"WITH {WORK} SELECT app AS application_id, depth < 5 AS accepted, CASE WHEN depth >= 5 THEN 'Agent session already exists' END AS reason FROM ws")
def command_session_starts(spark, folder):
    return _verdict(C.validate_session_starts(_cases(spark, folder).drop("k"), _states(spark, folder)))


@query(
    "command_credit",
    f"""WITH {WORK}, r AS (SELECT app, CASE WHEN state <> 'AWAITING_ANALYSIS' THEN 'Loan application is not awaiting credit analysis' WHEN depth < 5 THEN 'Agent session must start with a context event before any decision'
      WHEN k % 3 <> k % 2 THEN 'Agent session is locked to another model version' WHEN depth >= 6 THEN 'Credit analysis is model-version locked until a human override supersedes it' END AS reason FROM ws)
    SELECT app AS application_id, reason IS NULL AS accepted, reason FROM r""",
)
def command_credit(spark, folder):
    c = _cases(spark, folder).withColumn("model_version", F.concat(F.lit("m"), (F.col("k") % 3).cast("string")))
    return _verdict(C.validate_credit(c, _states(spark, folder)))


@query(
    "command_fraud",
    f"""WITH {WORK} SELECT app AS application_id, state = 'ANALYSIS_COMPLETE' AS accepted, CASE WHEN state <> 'ANALYSIS_COMPLETE' THEN 'Loan application is not awaiting fraud screening completion' END AS reason FROM ws""",
)
def command_fraud(spark, folder):
    c = _cases(spark, folder).withColumn("model_version", F.concat(F.lit("m"), (F.col("k") % 2).cast("string")))
    return _verdict(C.validate_fraud(c, _states(spark, folder)))


def _compliance_commands(spark, folder):
    c = _cases(spark, folder)
    k = F.col("k")

    def result(rule: str, outcome, hard):
        return F.struct(F.lit(rule).alias("rule_id"), F.lit("Rule").alias("rule_name"), F.lit("1").alias("rule_version"), F.lit("hash").alias("evidence_hash"), outcome.alias("outcome"), hard.alias("is_hard_block"),
                        F.lit(None).cast("string").alias("failure_reason"))

    rules = F.array(
        result("REG-001", F.when(k % 11 == 0, "MAYBE").otherwise("pass"), F.lit(False)), result("REG-002", F.when(k % 7 == 0, "FAIL").otherwise("PASS"), k % 7 == 0), result("REG-006", F.lit("NOTE"), F.lit(False))
    )
    return c.withColumn("model_version", F.lit("")).withColumn("rule_results", rules)


JUDGED = f"""{WORK}, r AS (SELECT *, CASE WHEN state <> 'COMPLIANCE_REVIEW' THEN 'Loan application is not in compliance review' WHEN depth >= 13 THEN 'Compliance check already completed for this application'
      WHEN k % 11 = 0 THEN 'Unknown compliance rule outcome' END AS reason FROM ws)"""


@query("command_compliance", f"WITH {JUDGED} SELECT app AS application_id, reason IS NULL AS accepted, reason FROM r")
def command_compliance(spark, folder):
    return _verdict(C.validate_compliance(_compliance_commands(spark, folder), _states(spark, folder)))


@query(
    "produced_compliance_events",
    f"""WITH {JUDGED}, ok AS (SELECT *, CASE WHEN depth = 9 THEN -1 ELSE depth - 9 END AS sv FROM r WHERE reason IS NULL),
    ev AS (SELECT app, sv, k, version, unnest(CASE WHEN sv = -1 THEN ['ComplianceCheckInitiated'] ELSE [] END || ['ComplianceRulePassed', CASE WHEN k % 7 = 0 THEN 'ComplianceRuleFailed' ELSE 'ComplianceRulePassed' END, 'ComplianceRuleNoted', 'ComplianceCheckCompleted']) AS t,
        unnest(range(CASE WHEN sv = -1 THEN 5 ELSE 4 END)) AS seq FROM ok)
    SELECT 'compliance-' || app AS stream_id, sv AS expected_version, seq, t AS event_type, CASE WHEN t = 'ComplianceCheckCompleted' THEN CASE WHEN k % 7 = 0 THEN 'BLOCKED' ELSE 'CLEAR' END END AS detail FROM ev
    UNION ALL SELECT 'loan-' || app, version, 0, CASE WHEN k % 7 = 0 THEN 'ApplicationDeclined' ELSE 'DecisionRequested' END,
      CASE WHEN k % 7 = 0 THEN 'Compliance hard block: REG-002' ELSE 'compliance-' || app || ':' || (greatest(sv, 0) + CASE WHEN sv = -1 THEN 5 ELSE 4 END) END FROM ok""",
)
def produced_compliance_events(spark, folder):
    judged = C.validate_compliance(_compliance_commands(spark, folder), _states(spark, folder))
    e = C.produced_events("compliance", judged, append.stream_heads(stored.lifecycle_ledger(spark, folder)))
    p = "payload"
    detail = F.coalesce(F.get_json_object(p, "$.overall_verdict"), F.get_json_object(p, "$.triggered_by_event_id"), F.get_json_object(p, "$.decline_reasons[0]"))
    return e.select("stream_id", "expected_version", "seq", "event_type", detail.alias("detail"))


@query(
    "command_decisions",
    f"""WITH {WORK}, r AS (SELECT app, CASE WHEN depth < 5 THEN 'Agent session must start with a context event before any decision' WHEN depth < 15 THEN 'Contributing agent session has no recorded domain outputs'
      WHEN state <> 'PENDING_DECISION' THEN 'Loan application is not pending a decision' WHEN k % 10 < 6 AND k % 2 = 0 THEN 'Decisions below the confidence floor must be REFER' END AS reason FROM ws)
    SELECT app AS application_id, reason IS NULL AS accepted, reason FROM r""",
)
def command_decisions(spark, folder):
    return _verdict(C.validate_decisions(_decision_commands(spark, folder), _states(spark, folder)))


def _decision_commands(spark, folder):
    k = F.col("k")
    return _cases(spark, folder).select(
        "*", F.array(F.concat_ws("-", F.lit("agent"), "agent_type", "session_id")).alias("contributing_sessions"), F.when(k % 2 == 0, "APPROVE").otherwise("REFER").alias("recommendation"),
        (k % 10 / 10.0).alias("confidence"), F.lit(None).cast("string").alias("orchestrator_model"), F.lit(7000).cast("decimal(18,2)").alias("approved_amount_usd"),
        F.lit("Within policy.").alias("executive_summary"),
    )


@query(
    "produced_decision_events",
    f"""WITH {WORK}, ok AS (SELECT * FROM ws WHERE depth = 15 AND state = 'PENDING_DECISION' AND NOT (k % 10 < 6 AND k % 2 = 0))
    SELECT 'loan-' || app AS stream_id, version AS expected_version, 0 AS seq, 'DecisionGenerated' AS event_type FROM ok UNION ALL SELECT 'loan-' || app, version, 1, 'HumanReviewRequested' FROM ok WHERE k % 2 = 1""",
)
def produced_decision_events(spark, folder):
    judged = C.validate_decisions(_decision_commands(spark, folder), _states(spark, folder))
    e = C.produced_events("decision", judged, append.stream_heads(stored.lifecycle_ledger(spark, folder)))
    return e.select("stream_id", "expected_version", "seq", "event_type")


@query(
    "command_reviews",
    f"""WITH {WORK}, r AS (SELECT app, CASE WHEN state NOT IN ('APPROVED_PENDING_HUMAN','DECLINED_PENDING_HUMAN','PENDING_HUMAN_REVIEW') THEN 'Loan application is not awaiting human resolution'
      WHEN k % 4 = 0 AND k % 8 <> 0 THEN 'override_reason is required when override=True' WHEN k % 3 = 1 AND k % 4 <> 0 THEN 'Changing the recommendation requires override=True'
      WHEN k % 3 <> 1 AND k % 6 = 5 THEN 'Approval requires approved_amount_usd, interest_rate_pct, and term_months' WHEN k % 3 <> 1 AND k % 7 >= 2 THEN 'Approved amount exceeds the latest agent-assessed maximum limit' END AS reason FROM ws)
    SELECT app AS application_id, reason IS NULL AS accepted, reason FROM r""",
)
def command_reviews(spark, folder):
    return _verdict(C.validate_reviews(_review_commands(spark, folder), _states(spark, folder)))


def _review_commands(spark, folder):
    k = F.col("k")
    return _cases(spark, folder).select(
        "*", F.lit("r1").alias("reviewer_id"), (k % 4 == 0).alias("override"), F.when(k % 8 == 0, "seen").alias("override_reason"), F.lit("APPROVE").alias("original_recommendation"),
        F.when(k % 3 == 1, "DECLINE").otherwise("APPROVE").alias("final_decision"), (F.lit(8000) + k * 12 + k % 7 * 1000).cast("decimal(18,2)").alias("approved_amount_usd"),
        F.when(k % 6 != 5, 7.5).alias("interest_rate_pct"), F.lit(24).alias("term_months"), F.array().cast("array<string>").alias("decline_reasons"),
    )


@query(
    "next_stages",
    f"""WITH {WORK} SELECT app AS application_id, state, CASE WHEN state LIKE 'FINAL%' OR state = 'DECLINED_COMPLIANCE' THEN 'final' WHEN state LIKE '%HUMAN%' THEN 'awaiting_review' WHEN state = 'PENDING_DECISION' THEN 'decision'
      WHEN depth BETWEEN 9 AND 12 THEN 'compliance' WHEN depth = 7 THEN 'fraud' ELSE 'full' END AS next_stage FROM ws""",
)
def next_stages(spark, folder):
    ledger = stored.lifecycle_ledger(spark, folder)
    states = stored.derived("lifecycle-applications", lambda s, f: C.replay_states(stored.lifecycle_ledger(s, f)).applications, spark, folder)
    return policy.next_stages(states, ledger)


# ---- verification -------------------------------------------------------------------------------------------------
LATER = f"""{LOAN}, early AS (SELECT * FROM led WHERE ts < TIMESTAMP '2024-01-25'), {summary_cte('led', 'new')}, {summary_cte('early', 'old')},
nv AS (SELECT app, unnest([{{'f': 'state', 'v': state}}, {{'f': 'applicant_id', 'v': applicant_id}}, {{'f': 'requested_amount_usd', 'v': CAST(CAST(requested_amount_usd AS DECIMAL(18,2)) AS VARCHAR)}},
    {{'f': 'approved_amount_usd', 'v': CAST(CAST(approved_amount_usd AS DECIMAL(18,2)) AS VARCHAR)}}, {{'f': 'risk_tier', 'v': risk_tier}}, {{'f': 'fraud_score', 'v': CAST(CAST(fraud_score AS DECIMAL(38,6)) AS VARCHAR)}},
    {{'f': 'compliance_status', 'v': compliance_status}}, {{'f': 'decision', 'v': decision}}, {{'f': 'sessions_completed', 'v': CAST(sessions_completed AS VARCHAR)}}, {{'f': 'last_event_type', 'v': last_event_type}}, {{'f': 'human_reviewer_id', 'v': human_reviewer_id}}]) AS x FROM new),
ov AS (SELECT app, unnest([{{'f': 'state', 'v': state}}, {{'f': 'applicant_id', 'v': applicant_id}}, {{'f': 'requested_amount_usd', 'v': CAST(CAST(requested_amount_usd AS DECIMAL(18,2)) AS VARCHAR)}},
    {{'f': 'approved_amount_usd', 'v': CAST(CAST(approved_amount_usd AS DECIMAL(18,2)) AS VARCHAR)}}, {{'f': 'risk_tier', 'v': risk_tier}}, {{'f': 'fraud_score', 'v': CAST(CAST(fraud_score AS DECIMAL(38,6)) AS VARCHAR)}},
    {{'f': 'compliance_status', 'v': compliance_status}}, {{'f': 'decision', 'v': decision}}, {{'f': 'sessions_completed', 'v': CAST(sessions_completed AS VARCHAR)}}, {{'f': 'last_event_type', 'v': last_event_type}}, {{'f': 'human_reviewer_id', 'v': human_reviewer_id}}]) AS x FROM old)
"""


def _stale(spark, folder):
    ledger = stored.loan_ledger(spark, folder)
    return stored.derived("stale-summary", lambda s, f: summary.application_summary(ledger.where(F.col("recorded_at") < F.lit("2024-01-25").cast("timestamp"))), spark, folder)


@query(
    "rebuild_differences",
    f"""WITH {LATER} SELECT n.app AS application_id, 'mismatch' AS problem, n.x.f AS field, o.x.v AS stored, n.x.v AS expected FROM nv n JOIN ov o ON o.app = n.app AND o.x.f = n.x.f WHERE o.x.v IS DISTINCT FROM n.x.v""",
)
def rebuild_differences(spark, folder):
    """A read model stored on the 25th against the whole log."""
    return verify.verify_summary(_stale(spark, folder), stored.loan_ledger(spark, folder))


@query("rebuild_model_differences", f"""WITH {LATER} SELECT n.app AS application_id, 'mismatch' AS problem, n.x.f AS field, o.x.v AS stored, n.x.v AS expected FROM nv n JOIN ov o ON o.app = n.app AND o.x.f = n.x.f WHERE o.x.v IS DISTINCT FROM n.x.v""")
def rebuild_model_differences(spark, folder):
    fresh = stage(summary.application_summary(stored.loan_ledger(spark, folder)))
    return verify.compare_models(_stale(spark, folder), fresh, ["application_id"], verify.SUMMARY_FIELDS)


@query("rebuild_clean", f"""WITH {LOAN} SELECT count(DISTINCT app) AS applications, 0 AS differences FROM led""")
def rebuild_clean(spark, folder):
    """A full rebuild verifies without a difference."""
    ledger = stored.loan_ledger(spark, folder)
    rebuilt = stage(summary.application_summary(ledger))
    found = verify.verify_summary(rebuilt, ledger)
    both = rebuilt.select("application_id", F.lit(0).alias("d")).unionByName(found.select("application_id", F.lit(1).alias("d")))
    return both.agg(F.count_distinct("application_id").alias("applications"), F.sum("d").alias("differences"))


@query("state_distribution", f"WITH {LOAN}, {summary_cte()} SELECT state, count(*) AS rows FROM summ GROUP BY 1")
def state_distribution(spark, folder):
    return verify.distribution(summary.application_summary(stored.loan_ledger(spark, folder)), "state")


@query("verdict_distribution", f"WITH {LOAN}, {summary_cte()} SELECT coalesce(compliance_status, 'INCOMPLETE') AS compliance_status, count(*) AS rows FROM summ GROUP BY 1")
def verdict_distribution(spark, folder):
    return verify.distribution(summary.application_summary(stored.loan_ledger(spark, folder)), "compliance_status", "INCOMPLETE")


@query("agent_type_distribution", f"WITH {LOAN}, {agents_cte()} SELECT agent_type, count(*) AS rows FROM perf GROUP BY 1")
def agent_type_distribution(spark, folder):
    return verify.distribution(agents.agent_performance(stored.loan_ledger(spark, folder)), "agent_type")


# ---- events of accepted commands, with all their payload fields ---------------------------------------------------


def _submit_commands(spark, folder):
    key = F.col("k").cast("string")
    return _cases(spark, folder).select(
        F.concat(F.lit("n"), "command_id").alias("command_id"), F.concat(F.lit("N"), key).alias("application_id"), "at", F.concat(F.lit("COMP-"), key).alias("applicant_id"),
        F.lit("25000.00").alias("requested_amount_usd"), F.lit("bridge").alias("loan_purpose"), F.lit(24).alias("loan_term_months"), F.lit("web").alias("submission_channel"), F.lit("a@example.com").alias("contact_email"),
        F.lit("A").alias("contact_name"), F.concat(F.lit("ref-"), key).alias("application_reference"), F.array(F.lit("income_statement"), F.lit("balance_sheet")).alias("requested_document_types"), F.lit("desk").alias("requested_by"),
    )


def _session_commands(spark, folder):
    return _cases(spark, folder).select(
        "command_id", "application_id", "agent_type", "session_id", "at", F.concat(F.lit("a"), (F.col("k") % 7).cast("string")).alias("agent_id"), F.lit("m1").alias("model_version"),
        F.lit("g1").alias("langgraph_graph_version"), F.lit("fresh").alias("context_source"), F.lit(500).alias("context_token_count"),
    )


def _credit_commands(spark, folder):
    decision = F.struct(F.lit("LOW").alias("risk_tier"), F.lit("9000").alias("recommended_limit_usd"))
    return _cases(spark, folder).select(
        "*", F.concat(F.lit("m"), (F.col("k") % 2).cast("string")).alias("model_version"), decision.alias("decision"), F.lit("d1").alias("model_deployment_id"),
        F.concat(F.lit("hash-"), F.col("k").cast("string")).alias("input_data_hash"), F.lit(40).alias("analysis_duration_ms"),
    )


def _fraud_commands(spark, folder):
    return _cases(spark, folder).select(
        "*", F.concat(F.lit("m"), (F.col("k") % 2).cast("string")).alias("model_version"), F.lit("0.25").alias("fraud_score"), F.lit("LOW").alias("risk_level"), F.lit(0).alias("anomalies_found"), F.lit("CLEAR").alias("recommendation"),
        F.concat(F.lit("hash-"), F.col("k").cast("string")).alias("input_data_hash"),
    )


def _produced(spark, folder, kind):
    states, heads = _states(spark, folder), append.stream_heads(stored.lifecycle_ledger(spark, folder))
    judged = {
        "submit": lambda: C.validate_submissions(_submit_commands(spark, folder), states), "session": lambda: C.validate_session_starts(_session_commands(spark, folder), states),
        "credit": lambda: C.validate_credit(_credit_commands(spark, folder), states), "fraud": lambda: C.validate_fraud(_fraud_commands(spark, folder), states),
        "compliance": lambda: C.validate_compliance(_compliance_commands(spark, folder), states), "decision": lambda: C.validate_decisions(_decision_commands(spark, folder), states),
        "review": lambda: C.validate_reviews(_review_commands(spark, folder), states),
    }[kind]()
    return C.produced_events(kind, judged, heads)


def _payloads(spark, folder, kind):
    return _produced(spark, folder, kind).select("stream_id", "expected_version", "seq", "event_type", "payload")


NOW = AT + "T00:00:00.000Z"


@query(
    "produced_submit_events",
    f"""SELECT 'loan-N' || c_custkey AS stream_id, -1 AS expected_version, 0 AS seq, 'ApplicationSubmitted' AS event_type, '{{"application_id":"N' || c_custkey || '","applicant_id":"COMP-' || c_custkey ||
      '","requested_amount_usd":"25000.00","loan_purpose":"bridge","loan_term_months":24,"submission_channel":"web","contact_email":"a@example.com","contact_name":"A","application_reference":"ref-' || c_custkey || '","submitted_at":"{NOW}"}}' AS payload FROM customer
    UNION ALL SELECT 'loan-N' || c_custkey, -1, 1, 'DocumentUploadRequested', '{{"application_id":"N' || c_custkey || '","required_document_types":["income_statement","balance_sheet"],"deadline":"2024-06-08T00:00:00.000Z","requested_by":"desk"}}' FROM customer""",
)
def produced_submit_events(spark, folder):
    return _payloads(spark, folder, "submit")


@query(
    "produced_session_events",
    f"""WITH {WORK} SELECT 'agent-credit_analysis-w' || k AS stream_id, -1 AS expected_version, 0 AS seq, 'AgentSessionStarted' AS event_type, '{{"session_id":"w' || k || '","agent_type":"credit_analysis","agent_id":"a' || (k % 7) ||
      '","application_id":"' || app || '","model_version":"m1","langgraph_graph_version":"g1","context_source":"fresh","context_token_count":500,"started_at":"{NOW}"}}' AS payload FROM ws WHERE depth < 5""",
)
def produced_session_events(spark, folder):
    return _payloads(spark, folder, "session")


@query(
    "produced_credit_events",
    f"""WITH {WORK}, ok AS (SELECT * FROM ws WHERE state = 'AWAITING_ANALYSIS' AND depth = 5)
    SELECT 'credit-' || app AS stream_id, -1 AS expected_version, 0 AS seq, 'CreditAnalysisCompleted' AS event_type, '{{"application_id":"' || app || '","session_id":"w' || k || '","decision":{{"risk_tier":"LOW","recommended_limit_usd":"9000"}},"model_version":"m' || (k % 2) ||
      '","model_deployment_id":"d1","input_data_hash":"hash-' || k || '","analysis_duration_ms":40,"completed_at":"{NOW}"}}' AS payload FROM ok
    UNION ALL SELECT 'loan-' || app, version, 0, 'FraudScreeningRequested', '{{"application_id":"' || app || '","triggered_by_event_id":"credit-' || app || ':1","requested_at":"{NOW}"}}' FROM ok""",
)
def produced_credit_events(spark, folder):
    return _payloads(spark, folder, "credit")


@query(
    "produced_fraud_events",
    f"""WITH {WORK}, ok AS (SELECT *, CASE WHEN depth >= 8 THEN 1 ELSE -1 END AS sv FROM ws WHERE state = 'ANALYSIS_COMPLETE')
    SELECT 'fraud-' || app AS stream_id, sv AS expected_version, 0 AS seq, 'FraudScreeningCompleted' AS event_type, '{{"application_id":"' || app || '","session_id":"w' || k || '","fraud_score":"0.25","risk_level":"LOW","anomalies_found":0,"recommendation":"CLEAR","input_data_hash":"hash-' || k ||
      '","screening_model_version":"m' || (k % 2) || '","completed_at":"{NOW}"}}' AS payload FROM ok
    UNION ALL SELECT 'loan-' || app, version, 0, 'ComplianceCheckRequested', '{{"application_id":"' || app || '","triggered_by_event_id":"fraud-' || app || ':' || (greatest(sv, 0) + 1) || '","requested_at":"{NOW}","regulation_set_version":"2026-Q1","rules_to_evaluate":["REG-001","REG-002","REG-003","REG-004","REG-005","REG-006"]}}' FROM ok""",
)
def produced_fraud_events(spark, folder):
    return _payloads(spark, folder, "fraud")


@query(
    "produced_event_problems",
    f"""WITH {JUDGED}, n AS (SELECT 'submit' AS kind, 2 * count(*) AS events FROM customer
    UNION ALL SELECT 'session', count(*) FROM ws WHERE depth < 5
    UNION ALL SELECT 'credit', 2 * count(*) FROM ws WHERE state = 'AWAITING_ANALYSIS' AND depth = 5
    UNION ALL SELECT 'fraud', 2 * count(*) FROM ws WHERE state = 'ANALYSIS_COMPLETE'
    UNION ALL SELECT 'compliance', sum(CASE WHEN depth = 9 THEN 6 ELSE 5 END) FROM r WHERE reason IS NULL
    UNION ALL SELECT 'decision', sum(1 + k % 2) FROM ws WHERE depth = 15 AND state = 'PENDING_DECISION' AND NOT (k % 10 < 6 AND k % 2 = 0)
    UNION ALL SELECT 'review', 2 * count(*) FROM rr WHERE reason IS NULL)
    SELECT kind, events::BIGINT AS events, 0 AS invalid FROM n WHERE events > 0""".replace(", n AS (SELECT 'submit'", """, rr AS (SELECT app, CASE WHEN state NOT IN ('APPROVED_PENDING_HUMAN','DECLINED_PENDING_HUMAN','PENDING_HUMAN_REVIEW') THEN 'x' WHEN k % 4 = 0 AND k % 8 <> 0 THEN 'x' WHEN k % 3 = 1 AND k % 4 <> 0 THEN 'x'
      WHEN k % 3 <> 1 AND k % 6 = 5 THEN 'x' WHEN k % 3 <> 1 AND k % 7 >= 2 THEN 'x' END AS reason FROM ws), n AS (SELECT 'submit'"""),
)
def produced_event_problems(spark, folder):
    """Every event that any command produces is valid under the event schemas."""
    made = None
    for kind in ("submit", "session", "credit", "fraud", "compliance", "decision", "review"):
        part = _produced(spark, folder, kind).select("stream_id", "event_type", "event_version", "payload", F.lit(kind).alias("kind"))
        made = part if made is None else made.unionByName(part)
    checked = evolution.validate_events(made)
    return checked.groupBy("kind").agg(F.count("*").alias("events"), F.count_if(~F.col("valid")).alias("invalid"))
