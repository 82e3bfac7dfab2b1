"""Small hand-made ledgers."""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

from foldstone.schema import LEDGER_DDL

START = datetime(2026, 1, 10, tzinfo=timezone.utc)


class Log:
    """Collects events; positions from 1 per stream and globally, one second apart unless told otherwise."""

    def __init__(self):
        self.rows, self.heads = [], {}

    def add(self, stream, kind, payload=None, version=1, meta=None, at=None, event_id=None):
        self.heads[stream] = self.heads.get(stream, 0) + 1
        n = len(self.rows) + 1
        when = at or START + timedelta(seconds=n)
        self.rows.append((event_id or f"ev{n}", stream, self.heads[stream], n, kind, version, json.dumps(payload or {}), json.dumps(meta or {}), when))
        return self

    def frame(self, spark):
        return spark.createDataFrame(self.rows, LEDGER_DDL)


def submitted(app, amount="500000", **more):
    return {
        "application_id": app, "applicant_id": "COMP-1", "requested_amount_usd": amount, "loan_purpose": "expansion", "loan_term_months": 36, "submission_channel": "web",
        "application_reference": "r-1", **more,
    }


def approved_path(log, app="A1", tier="LOW", confidence=0.9, hard=False, limit="750000"):
    """The whole loan process of one application."""
    loan, a = f"loan-{app}", {"application_id": app}
    session = {"session_id": f"s-{app}", "agent_type": "credit_analysis", **a}
    log.add(loan, "ApplicationSubmitted", submitted(app)).add(loan, "DocumentUploadRequested", a)
    log.add(loan, "DocumentUploaded", {**a, "document_id": "d1"}).add(f"docpkg-{app}", "PackageReadyForAnalysis", a).add(loan, "CreditAnalysisRequested", a)
    log.add(f"agent-credit_analysis-s-{app}", "AgentSessionStarted", {**session, "agent_id": "g1", "model_version": "m1", "context_source": "fresh", "context_token_count": 100})
    log.add(f"credit-{app}", "CreditAnalysisCompleted", {**session, "decision": {"risk_tier": tier, "confidence": confidence, "recommended_limit_usd": limit}, "analysis_duration_ms": 100}, version=2)
    log.add(loan, "FraudScreeningRequested", {**a, "triggered_by_event_id": f"credit-{app}:1"})
    log.add(f"fraud-{app}", "FraudScreeningCompleted", {**session, "fraud_score": 0.1}).add(loan, "ComplianceCheckRequested", {**a, "triggered_by_event_id": f"fraud-{app}:1"})
    log.add(f"compliance-{app}", "ComplianceCheckInitiated", {**session, "regulation_set_version": "2026-Q1", "rules_to_evaluate": ["REG-001", "REG-003", "REG-006"]})
    log.add(f"compliance-{app}", "ComplianceRulePassed", {**session, "rule_id": "REG-001"})
    if hard:
        log.add(f"compliance-{app}", "ComplianceRuleFailed", {**session, "rule_id": "REG-003", "is_hard_block": True})
        log.add(f"compliance-{app}", "ComplianceCheckCompleted", {**session, "has_hard_block": True, "overall_verdict": "BLOCKED"})
        log.add(loan, "ApplicationDeclined", {**a, "decline_reasons": ["Compliance hard block: REG-003"]})
        return log
    log.add(f"compliance-{app}", "ComplianceRulePassed", {**session, "rule_id": "REG-003"}).add(f"compliance-{app}", "ComplianceRuleNoted", {**session, "rule_id": "REG-006"})
    log.add(f"compliance-{app}", "ComplianceCheckCompleted", {**session, "has_hard_block": False, "overall_verdict": "CLEAR"}).add(loan, "DecisionRequested", a)
    log.add(loan, "DecisionGenerated", {**a, "orchestrator_session_id": f"s-{app}", "recommendation": "APPROVE", "confidence": 0.88, "approved_amount_usd": "500000", "contributing_sessions": [f"agent-credit_analysis-s-{app}"]}, version=2)
    log.add(loan, "HumanReviewCompleted", {**a, "reviewer_id": "r1", "override": False, "original_recommendation": "APPROVE", "final_decision": "APPROVE"})
    log.add(loan, "ApplicationApproved", {**a, "approved_amount_usd": "480000", "approved_at": "2026-01-11T00:00:00Z"})
    log.add(f"agent-credit_analysis-s-{app}", "AgentSessionCompleted", {**session, "total_cost_usd": 0.5})
    return log
