from datetime import timedelta

from pyspark.sql import functions as F

from foldstone.operators import agents, compliance, loans, summary, verify
from helpers import START, Log, approved_path, submitted


def test_approved_and_blocked_applications(spark, tiny_blocks):
    log = approved_path(approved_path(Log(), "A1"), "B1", hard=True).frame(spark)
    rows = {r.application_id: r for r in summary.application_summary(log).collect()}
    a, b = rows["A1"], rows["B1"]
    assert (a.state, a.decision, str(a.approved_amount_usd), a.risk_tier, a.sessions_completed) == ("FINAL_APPROVED", "APPROVE", "480000.00", "LOW", 1)
    assert a.last_event_type == "AgentSessionCompleted" and a.final_decision_at.day == 11
    assert (b.state, b.compliance_status, b.decision) == ("DECLINED_COMPLIANCE", "BLOCKED", "DECLINE")
    now = {r.application_id: r for r in compliance.compliance_current(log).collect()}
    assert (now["A1"].overall_verdict, now["A1"].passed_count, now["A1"].noted_count, now["A1"].completed) == ("CLEAR", 2, 1, True)
    assert (now["B1"].overall_verdict, now["B1"].hard_block_rules) == ("BLOCKED", ["REG-003"])
    record = {r.application_id: r for r in compliance.compliance_record(log).collect()}
    assert record["A1"].cleared_for_approval and record["A1"].all_required_evaluated and not record["B1"].cleared_for_approval
    perf = agents.agent_performance(log).first()
    assert (perf.total_sessions, perf.analyses_completed, perf.decisions_generated, perf.approve_rate) == (2, 6, 1, 1.0)
    assert verify.verify_summary(summary.application_summary(log), log).count() == 0


def test_status_at_the_time_of_decline_decides(spark, tiny_blocks):
    a = {"application_id": "A"}
    check = lambda v: {**a, "overall_verdict": v}
    log = Log().add("compliance-A", "ComplianceCheckCompleted", check("CLEAR")).add("loan-A", "ApplicationDeclined", {**a, "decline_reasons": ["x"]}).add("compliance-A", "ComplianceCheckCompleted", check("BLOCKED"))
    assert summary.application_summary(log.frame(spark)).first().state == "FINAL_DECLINED"
    log = Log().add("compliance-A", "ComplianceCheckCompleted", check("BLOCKED")).add("loan-A", "ApplicationDeclined", a).add("compliance-A", "ComplianceCheckCompleted", check("CLEAR"))
    assert summary.application_summary(log.frame(spark)).first().state == "DECLINED_COMPLIANCE"


def test_nulls_are_assigned_but_absent_applicants_keep(spark):
    a = {"application_id": "A"}
    log = Log().add("loan-A", "ApplicationSubmitted", submitted("A")).add("loan-A", "ApplicationSubmitted", {**a, "requested_amount_usd": None})
    row = summary.application_summary(log.frame(spark)).first()
    assert (row.applicant_id, row.requested_amount_usd) == ("COMP-1", None)
    row = summary.application_summary(log.add("loan-A", "ApplicationSubmitted", {**a, "applicant_id": None}).frame(spark)).first()
    assert row.applicant_id is None
    only = Log().add("agent-x-1", "AgentSessionCompleted", {**a, "session_id": "s"}).frame(spark)
    assert summary.application_summary(only).first().state == "NEW"


def test_outputs_need_an_earlier_start_and_overrides_follow_the_decision(spark, tiny_blocks):
    start = {"session_id": "s1", "application_id": "A", "agent_type": "t", "agent_id": "g", "model_version": "m"}
    done = {"application_id": "A", "session_id": "s1", "decision": {"confidence": 0.5}, "analysis_duration_ms": 10}
    log = Log().add("credit-A", "CreditAnalysisCompleted", done).add("agent-t-s1", "AgentContextLoaded", start).add("credit-A", "CreditAnalysisCompleted", done)
    log.add("loan-A", "HumanReviewCompleted", {"application_id": "A", "override": True, "final_decision": "APPROVE"})
    log.add("loan-A", "DecisionGenerated", {"application_id": "A", "orchestrator_session_id": "s1", "recommendation": "refer", "confidence": 0.7})
    log.add("loan-A", "HumanReviewCompleted", {"application_id": "A", "override": True, "final_decision": "APPROVE"})
    r = agents.agent_performance(log.frame(spark)).first()
    assert (r.analyses_completed, r.decisions_generated, r.refer_count, r.human_override_count, round(r.avg_confidence_score, 6)) == (1, 1, 1, 1, 0.6)


def test_state_as_of_a_time(spark, tiny_blocks):
    base = {"application_id": "T", "session_id": "s"}
    log = Log().add("compliance-T", "ComplianceCheckInitiated", {**base, "regulation_set_version": "v", "rules_to_evaluate": ["REG-001"]}, at=START)
    log.add("compliance-T", "ComplianceRulePassed", {**base, "rule_id": "REG-001"}, at=START + timedelta(seconds=1))
    log.add("compliance-T", "ComplianceCheckCompleted", {**base, "has_hard_block": False, "overall_verdict": "CLEAR"}, at=START + timedelta(seconds=3))
    history = compliance.compliance_history(log.frame(spark))
    probes = spark.createDataFrame([("T", START + timedelta(seconds=2)), ("T", START - timedelta(seconds=1)), ("T", START + timedelta(seconds=3))], "application_id string, at timestamp")
    got = sorted(((r.passed_count, r.completed) for r in compliance.compliance_at(history, probes).collect()), key=str)
    assert got == [(1, False), (1, True), (None, None)]


def test_reopened_check_clears_rules_and_verdict_takes_over_failures(spark, tiny_blocks):
    b = {"application_id": "R"}
    log = Log().add("compliance-R", "ComplianceRuleFailed", {**b, "rule_id": "REG-002", "is_hard_block": False})
    log.add("compliance-R", "ComplianceCheckCompleted", {**b, "has_hard_block": True, "overall_verdict": "BLOCKED"}).add("compliance-R", "ComplianceRuleFailed", {**b, "rule_id": "REG-004", "is_hard_block": True})
    log.add("compliance-R", "ComplianceCheckInitiated", {**b, "session_id": "s", "regulation_set_version": "v"})
    rows = compliance.compliance_history(log.frame(spark)).orderBy("snapshot_version").collect()
    assert [r.hard_block_rules for r in rows] == [[], ["REG-002"], ["REG-002", "REG-004"], []]
    assert [r.failed_count for r in rows] == [1, 1, 2, 0] and rows[3].overall_verdict is None and not rows[3].completed


def test_rule_results_keep_their_details_over_time(spark, tiny_blocks):
    b = {"application_id": "R", "session_id": "s"}
    passed = {**b, "rule_id": "REG-001", "rule_name": "One", "rule_version": "v2", "evidence_hash": "h1", "evaluation_notes": "fine", "evaluated_at": "2026-01-05T10:00:00Z"}
    failed = {**b, "rule_id": "REG-002", "rule_name": "Two", "rule_version": "v3", "failure_reason": "late", "is_hard_block": True, "remediation_available": False, "evidence_hash": "h2"}
    noted = {**b, "rule_id": "REG-003", "rule_name": "Three", "note_type": "INFO", "note_text": "seen", "rule_version": "not of a note"}
    opening = {**b, "regulation_set_version": "v", "rules_to_evaluate": ["REG-001"]}
    log, at = Log(), lambda n: START + timedelta(seconds=n)
    for n, (kind, payload) in enumerate([("Initiated", opening), ("Passed", passed), ("Passed", passed), ("Noted", noted), ("Initiated", opening), ("Failed", failed)]):
        log.add("compliance-R", f"ComplianceCheck{kind}" if kind == "Initiated" else f"ComplianceRule{kind}", payload, at=at(n))
    frame = log.frame(spark)
    results = compliance.rule_results(frame)
    rows = {(r.rule_class, r.ordinal): r for r in results.collect()}
    assert set(rows) == {("passed", 1), ("passed", 2), ("noted", 1), ("failed", 1)}
    one, two, note = rows["passed", 1], rows["failed", 1], rows["noted", 1]
    assert (one.rule_name, one.rule_version, one.evidence_hash, one.evaluation_notes, one.failure_reason, one.is_hard_block) == ("One", "v2", "h1", "fine", None, None)
    assert (two.failure_reason, two.is_hard_block, two.remediation_available, two.remediation_description) == ("late", True, False, None)
    assert (note.note_type, note.note_text, note.rule_version) == ("INFO", "seen", None)
    plain = lambda n: at(n).replace(tzinfo=None)
    assert one.valid_from == plain(1) and one.valid_until == plain(4) and two.valid_until is None
    assert [r.rule_id for r in compliance.current_rule_results(results).collect()] == ["REG-002"]
    probes = spark.createDataFrame([(n, "R", at(n - 0.5)) for n in range(8)], "n int, application_id string, at timestamp")
    found = compliance.rule_results_at(results, compliance.compliance_history(frame), probes)
    assert {r["n"]: r["ids"] for r in found.groupBy("n").agg(F.sort_array(F.collect_list("rule_id")).alias("ids")).collect()} == {
        2: ["REG-001"], 3: ["REG-001"] * 2, 4: ["REG-001", "REG-001", "REG-003"], 6: ["REG-002"], 7: ["REG-002"]
    }


def test_replay_good_path_errors_and_snapshots(spark, tiny_blocks):
    log = approved_path(approved_path(Log(), "A1"), "B1", hard=True)
    log.add("loan-X", "ApplicationSubmitted", submitted("X")).add("loan-X", "DecisionRequested", {"application_id": "X"}).add("loan-X", "CreditAnalysisRequested", {})
    broken = submitted("Y")
    del broken["loan_purpose"]
    log.add("loan-Y", "ApplicationSubmitted", broken)
    frame = log.frame(spark)
    rows = {r.application_id: r for r in loans.replay_loans(frame).collect()}
    assert (rows["A1"].state, rows["A1"].final_decision, rows["A1"].version, rows["A1"].error_position) == ("FINAL_APPROVED", "APPROVE", 10, None)
    assert rows["B1"].state == "DECLINED_COMPLIANCE" and rows["B1"].compliance_declined
    assert (rows["X"].state, rows["X"].error_position, rows["X"].error_target, rows["X"].version) == ("SUBMITTED", 2, "PENDING_DECISION", 1)
    assert (rows["Y"].error_event, rows["Y"].error_field) == ("ApplicationSubmitted", "loan_purpose")
    early = frame.where("stream_position <= 4")
    saved = loans.save_snapshots(loans.replay_loans(early), F.lit("2026-02-01").cast("timestamp"))
    again = {r.application_id: r for r in loans.replay_loans(frame, saved).collect()}
    for app in ("A1", "B1"):
        assert (again[app].state, again[app].version, again[app].requested_amount_usd, again[app].credit_requested) == (rows[app].state, rows[app].version, rows[app].requested_amount_usd, rows[app].credit_requested)


def test_long_streams_replay_like_a_plain_loop(spark, tiny_blocks):
    """Sixty applications with up to seventy random events each, folded in blocks of twelve."""
    import random

    from foldstone.schema import LOAN_TRANSITIONS

    allowed = LOAN_TRANSITIONS
    rng, log, want = random.Random(3), Log(), {}
    quiet = ["DocumentUploadRequested", "HumanReviewRequested", "PackageNoted"]
    path = [("ApplicationSubmitted", "SUBMITTED"), ("CreditAnalysisRequested", "AWAITING_ANALYSIS"), ("FraudScreeningRequested", "ANALYSIS_COMPLETE"),
            ("ComplianceCheckRequested", "COMPLIANCE_REVIEW"), ("DecisionRequested", "PENDING_DECISION"), ("ApplicationApproved", "FINAL_APPROVED")]
    for a in range(60):
        app, state, error, at = f"Z{a}", "NEW", None, 0
        for _ in range(rng.randint(1, 70)):
            name, target = rng.choice([(q, None) for q in quiet] * 6 + [path[at % len(path)]] + ([rng.choice(path)] if rng.random() < 0.1 else []))
            payload = {**submitted(app), "approved_amount_usd": "1"}
            log.add(f"loan-{app}", name, payload)
            if error is not None or target is None:
                continue
            if target == state:
                continue
            if target in allowed.get(state, ()):
                state, at = target, at + 1
            else:
                error = (log.heads[f"loan-{app}"], target)
        want[app] = (state, error)
    got = {r.application_id: (r.state, (r.error_position, r.error_target) if r.error_position is not None else None) for r in loans.replay_loans(log.frame(spark)).collect()}
    assert got == want
    assert any(e for _, e in want.values()) and any(e is None for _, e in want.values())


def test_only_differing_buckets_are_compared(spark):
    rows = [(f"k{i}", i, float(i), ["b", "a"]) for i in range(200)]
    ddl = "k string, n int, x double, l array<string>"
    stored, expected = spark.createDataFrame(rows, ddl), spark.createDataFrame([(k, n, x + 1e-9, l[::-1]) for k, n, x, l in rows[::-1]], ddl)
    for buckets in (1, 64):
        assert verify.compare_by_buckets(stored, expected, ["k"], ["n", "x", "l"], buckets).count() == 0
        other = stored.where("k <> 'k7'").withColumn("n", F.when(F.col("k") == "k9", None).otherwise(F.col("n"))).union(spark.createDataFrame([("new", 1, 1.0, None), ("k3", 3, 3.0, ["a", "b"])], ddl).where("k = 'new'"))
        got = {(r.k, r.problem, r.field, r.stored, r.expected) for r in verify.compare_by_buckets(other, expected, ["k"], ["n", "x", "l"], buckets).collect()}
        assert got == {("k7", "missing", None, None, None), ("new", "unexpected", None, None, None), ("k9", "mismatch", "n", None, "9")}


def test_recomputed_compliance_and_agents_agree_with_the_folds(spark, tiny_blocks):
    b, log = {"application_id": "R", "session_id": "s"}, approved_path(approved_path(Log(), "A1"), "B1", hard=True)
    for kind, more in [("RuleFailed", {"rule_id": "X"}), ("CheckCompleted", {"has_hard_block": True}), ("RuleFailed", {"rule_id": "Y", "is_hard_block": True}), ("CheckInitiated", {}), ("CheckCompleted", {"has_hard_block": True}),
                       ("RuleFailed", {"rule_id": "Z"}), ("RuleFailed", {"rule_id": "Z"}), ("CheckCompleted", {"has_hard_block": True, "overall_verdict": "BLOCKED"}), ("RuleFailed", {"rule_id": "V"})]:
        log.add("compliance-R", f"Compliance{kind}", {**b, **more})
    frame = log.frame(spark)
    assert verify.verify_compliance(compliance.compliance_current(frame), frame).count() == 0
    assert verify.verify_agents(agents.agent_performance(frame), frame).count() == 0
    forged = compliance.compliance_current(frame).withColumn("overall_verdict", F.lit("CLEAR"))
    assert verify.verify_compliance(forged, frame).where("field = 'overall_verdict'").count() >= 1
