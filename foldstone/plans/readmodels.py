"""Read models over the event tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldstone.operators import agents, summary, verify
from foldstone.plans.ctes import LOAN, agents_cte, summary_cte
from foldstone.plans.registry import as_double, joined, micros, query, rounded
from foldstone.session import stage
from foldstone.sources import stored


def summary_columns(df, *keys):
    return df.select(
        *keys, "application_id", "state", "applicant_id", as_double("requested_amount_usd"), as_double("approved_amount_usd"),
        "risk_tier", "fraud_score", "compliance_status", "decision", "sessions_completed", "last_event_type",
        micros("last_event_at"), "human_reviewer_id", micros("final_decision_at"),
    )


SUMMARY_SELECT = """application_id, state, applicant_id, requested_amount_usd, approved_amount_usd, risk_tier, fraud_score,
 compliance_status, decision, sessions_completed, last_event_type, last_event_at, human_reviewer_id, final_decision_at"""


@query("application_summary", f"WITH {LOAN}, {summary_cte()} SELECT app AS {SUMMARY_SELECT} FROM summ")
def application_summary(spark, folder):
    return summary_columns(summary.application_summary(stored.loan_ledger(spark, folder)))


@query(
    "application_session_lists",
    f"""WITH {LOAN}, f AS (SELECT app, sess, min(gpos) AS g FROM led WHERE t = 'AgentSessionCompleted' GROUP BY 1, 2)
    SELECT app AS application_id, row_number() OVER (PARTITION BY app ORDER BY g) AS ordinal, sess AS session_id FROM f""",
)
def application_session_lists(spark, folder):
    return summary.completed_sessions(stored.loan_ledger(spark, folder))


@query(
    "agent_performance",
    f"""WITH {LOAN}, {agents_cte()}
    SELECT *, round(coalesce(approve_count / nullif(decisions_generated, 0), 0), 6) AS approve_rate,
      round(coalesce(decline_count / nullif(decisions_generated, 0), 0), 6) AS decline_rate,
      round(coalesce(refer_count / nullif(decisions_generated, 0), 0), 6) AS refer_rate,
      round(CASE WHEN decisions_generated > 0 THEN human_override_count / decisions_generated ELSE 0 END, 6) AS human_override_rate
    FROM perf""",
)
def agent_performance(spark, folder):
    return agent_columns(agents.agent_performance(stored.loan_ledger(spark, folder)))


def agent_columns(df):
    return df.select(
        *agents.KEY, "total_sessions", "analyses_completed", "decisions_generated", rounded("avg_confidence_score"),
        rounded("avg_duration_ms"), "approve_count", "decline_count", "refer_count", "human_override_count",
        micros("first_seen_at"), micros("last_seen_at"), rounded("approve_rate"), rounded("decline_rate"),
        rounded("refer_rate"), rounded("human_override_rate"),
    )


@query(
    "rebuild_agents",
    f"""WITH {LOAN}, {agents_cte()}
    SELECT agent_type, agent_id, model_version, 'missing' AS problem, NULL AS field, NULL AS stored, NULL AS expected FROM perf WHERE agent_id = 'agent-5'
    UNION ALL SELECT agent_type, 'other-' || agent_id, model_version, 'unexpected', NULL, NULL, NULL FROM perf WHERE agent_id = 'agent-2'
    UNION ALL SELECT agent_type, agent_id, model_version, 'mismatch', 'total_sessions', (total_sessions + 2)::VARCHAR, total_sessions::VARCHAR FROM perf WHERE agent_id = 'agent-3'
    UNION ALL SELECT agent_type, agent_id, model_version, 'mismatch', 'refer_count', '-1', refer_count::VARCHAR FROM perf WHERE agent_id = 'agent-6' AND model_version = 'm0'""",
)
def rebuild_agents(spark, folder):
    """Agent rows with lost, invented and changed ones against a recomputation."""
    ledger = stored.loan_ledger(spark, folder)
    rows = stage(agents.agent_performance(ledger))
    name = F.col("agent_id")
    changed = rows.where(name != "agent-5").withColumns({
        "total_sessions": F.col("total_sessions") + F.when(name == "agent-3", 2).otherwise(0),
        "refer_count": F.when((name == "agent-6") & (F.col("model_version") == "m0"), F.lit(-1).cast("bigint")).otherwise(F.col("refer_count")),
    })
    added = rows.where(name == "agent-2").withColumn("agent_id", F.concat(F.lit("other-"), "agent_id"))
    return verify.verify_agents(stage(changed.unionByName(added)), ledger)
