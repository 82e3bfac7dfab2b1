"""SQL for the adapters: the same ledgers the Spark adapters build, as typed columns."""

LOAN = """
ev AS (
  SELECT event_id AS gpos, ts, CAST(user_id AS VARCHAR) AS app, event_type AS src, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events),
typed AS (
  SELECT *, (k // 4) % 3 AS lane,
    CASE src
      WHEN 'signup' THEN (['ApplicationSubmitted','ApplicationSubmitted','CreditAnalysisRequested','DocumentUploadRequested'])[k % 4 + 1]
      WHEN 'view' THEN (['DocumentUploaded','PackageReadyForAnalysis','FraudScreeningRequested','AgentSessionCompleted'])[k % 4 + 1]
      WHEN 'click' THEN (['CreditAnalysisCompleted','FraudScreeningCompleted','ComplianceCheckRequested','ComplianceCheckCompleted'])[k % 4 + 1]
      WHEN 'purchase' THEN (['DecisionGenerated','DecisionGenerated','DecisionRequested','ApplicationApproved'])[k % 4 + 1]
      WHEN 'error' THEN (['ApplicationDeclined','HumanReviewCompleted','HumanReviewRequested','AgentSessionStarted'])[k % 4 + 1]
    END AS t
  FROM ev),
led AS (
  SELECT *, 'e' || gpos AS eid, 's' || app || '-' || lane AS sess,
    (['credit_analysis','fraud_detection','decision_orchestrator'])[lane + 1] AS akind,
    CASE WHEN t = 'CreditAnalysisCompleted' THEN 'credit-' || app
         WHEN t = 'FraudScreeningCompleted' THEN 'fraud-' || app
         WHEN t = 'ComplianceCheckCompleted' THEN 'compliance-' || app
         WHEN t = 'PackageReadyForAnalysis' THEN 'docpkg-' || app
         WHEN t IN ('AgentSessionStarted','AgentSessionCompleted') THEN 'agent-' || (['credit_analysis','fraud_detection','decision_orchestrator'])[lane + 1] || '-s' || app || '-' || lane
         ELSE 'loan-' || app END AS stream_id,
    CASE WHEN t = 'ApplicationSubmitted' AND k % 12 <> 0 THEN 'CUST-' || (CAST(app AS BIGINT) % 50) END AS applicant,
    CASE WHEN t = 'ApplicationSubmitted' THEN round(value * 1000, 0) END AS requested,
    CASE WHEN t = 'CreditAnalysisCompleted' AND k % 20 <> 0 THEN (['LOW','MEDIUM','HIGH'])[k % 3 + 1] END AS tier,
    CASE WHEN t = 'CreditAnalysisCompleted' THEN round(value * 900, 0) END AS lim,
    CASE WHEN t = 'FraudScreeningCompleted' AND k % 20 <> 1 THEN k / 100.0 END AS fraud,
    CASE WHEN t = 'ComplianceCheckCompleted' THEN (['CLEAR','BLOCKED','CONDITIONAL'])[k % 3 + 1] END AS verdict,
    CASE WHEN t = 'DecisionGenerated' AND k % 25 <> 0 THEN (['APPROVE','DECLINE','REFER'])[lane + 1] END AS rec,
    CASE WHEN t = 'DecisionGenerated' AND lane = 0 THEN round(value * 800, 0)
         WHEN t = 'ApplicationApproved' AND k % 16 <> 3 THEN round(value * 850, 0) END AS approved,
    CASE WHEN t = 'HumanReviewCompleted' THEN 'rev-' || (k % 5) END AS reviewer,
    CASE WHEN t = 'HumanReviewCompleted' THEN (['APPROVE','DECLINE'])[k % 2 + 1] END AS fdec,
    t = 'HumanReviewCompleted' AND k % 3 = 0 AS override,
    t = 'ApplicationDeclined' AND k % 8 = 0 AS hard_reason
  FROM typed)
"""

SUMMARY_TYPES = (
    "('ApplicationSubmitted','DocumentUploadRequested','DocumentUploaded','PackageReadyForAnalysis','CreditAnalysisRequested',"
    "'CreditAnalysisCompleted','FraudScreeningRequested','FraudScreeningCompleted','ComplianceCheckRequested','ComplianceCheckCompleted',"
    "'DecisionRequested','DecisionGenerated','HumanReviewRequested','HumanReviewCompleted','ApplicationApproved','ApplicationDeclined',"
    "'AgentSessionCompleted')"
)


def summary_cte(source: str = "led", name: str = "summ", by: str = "app") -> str:
    """Application summary over ``source`` with keys ``by`` (window form, one pass over ordered events)."""
    return f"""
{name}_seen AS (
  SELECT *, last_value(CASE WHEN t = 'ComplianceCheckCompleted' THEN verdict END IGNORE NULLS)
     OVER (PARTITION BY {by} ORDER BY gpos ROWS UNBOUNDED PRECEDING) AS status_then
  FROM {source} WHERE t IN {SUMMARY_TYPES}),
{name}_state AS (
  SELECT *, CASE t
      WHEN 'ApplicationSubmitted' THEN 'SUBMITTED' WHEN 'DocumentUploadRequested' THEN 'DOCUMENTS_PENDING'
      WHEN 'DocumentUploaded' THEN 'DOCUMENTS_UPLOADED' WHEN 'PackageReadyForAnalysis' THEN 'DOCUMENTS_PROCESSED'
      WHEN 'CreditAnalysisRequested' THEN 'AWAITING_ANALYSIS' WHEN 'FraudScreeningRequested' THEN 'ANALYSIS_COMPLETE'
      WHEN 'ComplianceCheckRequested' THEN 'COMPLIANCE_REVIEW' WHEN 'DecisionRequested' THEN 'PENDING_DECISION'
      WHEN 'HumanReviewRequested' THEN 'PENDING_HUMAN_REVIEW' WHEN 'ApplicationApproved' THEN 'FINAL_APPROVED'
      WHEN 'DecisionGenerated' THEN CASE rec WHEN 'APPROVE' THEN 'APPROVED_PENDING_HUMAN' WHEN 'DECLINE' THEN 'DECLINED_PENDING_HUMAN' ELSE 'PENDING_HUMAN_REVIEW' END
      WHEN 'ApplicationDeclined' THEN CASE WHEN status_then = 'BLOCKED' OR hard_reason THEN 'DECLINED_COMPLIANCE' ELSE 'FINAL_DECLINED' END
    END AS new_state
  FROM {name}_seen),
{name} AS (
  SELECT {by},
    coalesce(arg_max(new_state, gpos) FILTER (WHERE new_state IS NOT NULL), 'NEW') AS state,
    arg_max(applicant, gpos) FILTER (WHERE applicant IS NOT NULL) AS applicant_id,
    arg_max(requested, gpos) FILTER (WHERE t = 'ApplicationSubmitted') AS requested_amount_usd,
    arg_max(approved, gpos) FILTER (WHERE approved IS NOT NULL) AS approved_amount_usd,
    arg_max_null(tier, gpos) FILTER (WHERE t = 'CreditAnalysisCompleted') AS risk_tier,
    arg_max_null(fraud, gpos) FILTER (WHERE t = 'FraudScreeningCompleted') AS fraud_score,
    arg_max_null(verdict, gpos) FILTER (WHERE t = 'ComplianceCheckCompleted') AS compliance_status,
    arg_max_null(CASE t WHEN 'DecisionGenerated' THEN rec WHEN 'HumanReviewCompleted' THEN fdec WHEN 'ApplicationApproved' THEN 'APPROVE' ELSE 'DECLINE' END, gpos)
      FILTER (WHERE t IN ('DecisionGenerated','HumanReviewCompleted','ApplicationApproved','ApplicationDeclined')) AS decision,
    count(DISTINCT CASE WHEN t = 'AgentSessionCompleted' THEN sess END) AS sessions_completed,
    arg_max(t, gpos) AS last_event_type,
    epoch_us(arg_max(ts, gpos)) AS last_event_at,
    arg_max_null(reviewer, gpos) FILTER (WHERE t = 'HumanReviewCompleted') AS human_reviewer_id,
    epoch_us(arg_max(ts, gpos) FILTER (WHERE t IN ('ApplicationApproved','ApplicationDeclined'))) AS final_decision_at
  FROM {name}_state GROUP BY {by})
"""


def agents_cte(source: str = "led", name: str = "perf") -> str:
    return f"""
{name}_starts AS (
  SELECT sess, gpos, ts, akind, 'agent-' || (k % 7) AS agent_id, 'm' || (k % 2) AS model FROM {source} WHERE t = 'AgentSessionStarted'),
{name}_out AS (
  SELECT o.*, s.akind AS s_kind, s.agent_id AS s_agent, s.model AS s_model FROM {source} o ASOF JOIN {name}_starts s ON o.sess = s.sess AND o.gpos > s.gpos
  WHERE o.t IN ('CreditAnalysisCompleted','FraudScreeningCompleted','ComplianceCheckCompleted','DecisionGenerated')),
{name}_dec AS (SELECT app, gpos, s_kind, s_agent, s_model FROM {name}_out WHERE t = 'DecisionGenerated'),
{name}_over AS (
  SELECT r.gpos, r.ts, d.s_kind, d.s_agent, d.s_model FROM (SELECT * FROM {source} WHERE override) r ASOF JOIN {name}_dec d ON r.app = d.app AND r.gpos > d.gpos),
{name}_rows AS (
  SELECT akind AS agent_type, agent_id, model AS model_version, gpos, ts, 'start' AS what, NULL AS rec, NULL AS conf, NULL AS dur FROM {name}_starts
  UNION ALL
  SELECT s_kind, s_agent, s_model, gpos, ts, t, upper(rec), CASE WHEN t IN ('CreditAnalysisCompleted','DecisionGenerated') THEN k / 100.0 END,
         CASE WHEN t = 'CreditAnalysisCompleted' THEN k + 100 END FROM {name}_out
  UNION ALL
  SELECT s_kind, s_agent, s_model, gpos, ts, 'override', NULL, NULL, NULL FROM {name}_over),
{name}_assigned AS (SELECT *, max(CASE WHEN what <> 'start' THEN gpos END) OVER (PARTITION BY agent_type, agent_id, model_version) AS apos FROM {name}_rows),
{name} AS (
  SELECT agent_type, agent_id, model_version,
    count(*) FILTER (WHERE what = 'start') AS total_sessions,
    count(*) FILTER (WHERE what IN ('CreditAnalysisCompleted','FraudScreeningCompleted','ComplianceCheckCompleted')) AS analyses_completed,
    count(*) FILTER (WHERE what = 'DecisionGenerated') AS decisions_generated,
    round(CAST(sum(CAST(conf AS DECIMAL(18,6))) AS DOUBLE) / count(conf), 6) AS avg_confidence_score,
    round(CAST(sum(dur) AS DOUBLE) / count(dur), 6) AS avg_duration_ms,
    count(*) FILTER (WHERE what = 'DecisionGenerated' AND rec = 'APPROVE') AS approve_count,
    count(*) FILTER (WHERE what = 'DecisionGenerated' AND rec = 'DECLINE') AS decline_count,
    count(*) FILTER (WHERE what = 'DecisionGenerated' AND rec = 'REFER') AS refer_count,
    count(*) FILTER (WHERE what = 'override') AS human_override_count,
    epoch_us(min(ts) FILTER (WHERE what = 'start')) AS first_seen_at,
    epoch_us(greatest(max(CASE WHEN gpos = apos THEN ts END), max(CASE WHEN what = 'start' AND (apos IS NULL OR gpos > apos) THEN ts END))) AS last_seen_at
  FROM {name}_assigned GROUP BY 1, 2, 3)
"""


RULES = """
ev AS (
  SELECT event_id AS gpos, ts, CAST(user_id AS VARCHAR) AS app, event_type AS src, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
rl AS (
  SELECT *, CASE src WHEN 'signup' THEN 'ComplianceCheckInitiated' WHEN 'view' THEN 'ComplianceRulePassed' WHEN 'click' THEN 'ComplianceRuleNoted'
                     WHEN 'error' THEN 'ComplianceRuleFailed' WHEN 'purchase' THEN 'ComplianceCheckCompleted' END AS t,
    'REG-00' || (k % 6 + 1) AS rule,
    src = 'error' AND k % 10 = 0 AS hard,
    src = 'purchase' AND k % 5 = 0 AS has_hard,
    CASE WHEN src = 'purchase' THEN (['CLEAR','BLOCKED','CONDITIONAL'])[k % 3 + 1] END AS verdict,
    CASE WHEN src = 'signup' THEN 'set-' || (k % 4) END AS regset,
    CASE WHEN src = 'signup' THEN list_transform(range(1, k % 6 + 2), lambda i: 'REG-00' || i) END AS required
  FROM ev)
"""

SESSIONS = """
cv AS (SELECT conv_id AS conv, turn, role, length(text) AS n FROM conversations),
se AS (
  SELECT *, 'agent-chat-s' || conv AS stream_id, 's' || conv AS sess, turn + 1 AS spos, conv * 1048576 + turn AS gpos, 'app-' || (conv % 20) AS app,
    CASE WHEN role = 'system' THEN 'AgentSessionStarted'
         WHEN role = 'assistant' AND n % 11 = 0 THEN 'AgentSessionCompleted'
         WHEN role = 'assistant' AND n % 13 = 0 THEN 'AgentSessionFailed'
         WHEN role = 'assistant' THEN 'AgentNodeExecuted'
         WHEN n % 5 = 0 THEN 'AgentOutputWritten'
         WHEN n % 17 = 0 THEN 'AgentSessionRecovered'
         ELSE 'AgentToolCalled' END AS t,
    (['claude-x','qwen3','openai/gpt','deterministic-v1','llama:8b','other'])[conv % 6 + 1] AS model
  FROM cv)
"""
