from pyspark.sql import functions as F

from foldstone.operators import branches, costs, evolution, integrity, lineage, package, sessions
from foldstone.session import stage
from helpers import Log, approved_path


def test_upgrades_fill_by_time_and_leave_stored_rows(spark):
    from datetime import datetime, timezone

    log = Log()
    for y, m in ((2025, 12), (2026, 2), (2026, 3)):
        log.add("credit-1", "CreditAnalysisCompleted", {"application_id": "1", "decision": {}}, at=datetime(y, m, 1, tzinfo=timezone.utc))
    log.add("credit-1", "CreditAnalysisCompleted", {"model_version": "own", "regulatory_basis": ["mine"]}, at=datetime(2026, 3, 1, tzinfo=timezone.utc))
    frame = log.frame(spark)
    got = evolution.current_events(frame).orderBy("global_position").select("event_version", F.get_json_object("payload", "$.model_version").alias("m"), F.get_json_object("payload", "$.regulatory_basis[0]").alias("r")).collect()
    assert [(r.event_version, r.m) for r in got] == [(2, "credit-v0-legacy"), (2, "credit-v1"), (2, "credit-v2"), (2, "own")] and got[3].r == "mine"
    assert frame.where("event_version = 1").count() == 4


def test_decision_upgrade_reads_first_anchors_and_reports_missing_steps(spark):
    log = Log().add("agent-credit-s1", "AgentSessionStarted", {"agent_type": "credit", "model_version": "m1"}).add("agent-credit-s1", "AgentSessionStarted", {"agent_type": "credit", "model_version": "m9"})
    log.add("agent-credit-s2", "AgentContextLoaded", {"agent_type": "credit", "model_version": "m2"})
    log.add("loan-1", "DecisionGenerated", {"contributing_sessions": ["credit-s1", "agent-credit-s2", "gone"]}).add("loan-2", "DecisionGenerated", {"contributing_sessions": []})
    got = {r.stream_id: r.m for r in evolution.current_events(log.frame(spark)).where("event_type = 'DecisionGenerated'").select("stream_id", F.get_json_object("payload", "$.model_versions").alias("m")).collect()}
    assert got == {"loan-1": '{"credit":"m2"}', "loan-2": "{}"}
    errors = evolution.upgrade_events(log.frame(spark), [], {"DecisionGenerated": 2}).where("upgrade_error is not null").collect()
    assert len(errors) == 2 and errors[0].upgrade_error == "No upcaster registered for DecisionGenerated v1 -> v2"


def test_custom_upgrade_chain(spark):
    steps = [evolution.Upgrade("E", 2, 3, lambda df: F.lit('{"v":3}')), evolution.Upgrade("E", 1, 2, lambda df: F.lit('{"v":2}'))]
    row = evolution.upgrade_events(Log().add("s", "E").frame(spark), steps).first()
    assert (row.event_version, row.payload, row.upgrade_error) == (3, '{"v":3}', None)


def test_validation_names_every_problem(spark):
    log = Log().add("loan-1", "Mystery").add("fraud-1", "FraudScreeningInitiated", {"application_id": "1", "session_id": "s", "screening_model_version": "m", "initiated_at": "soon"})
    log.add("compliance-1", "ComplianceRuleNoted", {"application_id": "1", "session_id": "s", "rule_id": "R", "rule_name": "n", "note_type": "t", "note_text": "x", "evaluated_at": "2026-01-01T00:00:00Z"})
    got = [r.problems for r in evolution.validate_events(log.frame(spark)).orderBy("global_position").collect()]
    assert got == [["unknown event_type Mystery"], ["invalid initiated_at"], []]


def test_chain_links_and_detects_tampering(spark):
    at = F.lit("2026-02-01").cast("timestamp")
    log = approved_path(Log(), "A1")
    before = log.frame(spark)
    who = spark.createDataFrame([("loan", "A1"), ("credit", "A1")], "entity_type string, entity_id string")
    first = stage(integrity.integrity_checks(before, who, None, at))
    assert {(r.events_verified, r.chain_valid, r.previous_hash) for r in first.collect()} == {(10, True, None), (1, True, None)}
    audits = stage(integrity.check_events(first, 1000))
    grown = log.add("loan-A1", "Later", {"z": 1}).frame(spark)
    second = {r.entity_type: r for r in integrity.integrity_checks(grown, who, audits, at).collect()}
    assert second["loan"].chain_valid and second["loan"].events_verified == 11 and second["loan"].previous_hash == {r.entity_type: r.integrity_hash for r in first.collect()}["loan"]
    touched = grown.withColumn("payload", F.when(F.col("event_id") == "ev1", F.lit('{"application_id":"A1"}')).otherwise(F.col("payload")))
    third = stage(integrity.integrity_checks(touched, who, audits, at))
    flags = {r.entity_type: (r.chain_valid, r.tamper_detected) for r in third.collect()}
    assert flags == {"loan": (False, True), "credit": (True, False)}
    # Once flagged, later checks stay invalid even over an unchanged log.
    both = audits.unionByName(integrity.check_events(third, 2000))
    assert {r.entity_type: r.chain_valid for r in integrity.integrity_checks(touched, who, both, at).collect()} == {"loan": False, "credit": True}
    state = {r.audit_stream_id: r for r in integrity.audit_ledgers(both).collect()}
    assert state["audit-loan-A1"].append_only and state["audit-loan-A1"].tamper_detected and state["audit-loan-A1"].checks == 2


def test_causal_order(spark):
    a = {"application_id": "A"}
    ok = Log().add("loan-A", "X", a, meta={"correlation_id": "c"}, event_id="e1").add("loan-A", "Y", a, meta={"correlation_id": "c", "causation_id": "e1"}, event_id="e2")
    assert lineage.causal_violations(lineage.audited_events(ok.frame(spark))).count() == 0
    bad = Log().add("loan-A", "X", a, meta={"correlation_id": "c", "causation_id": "e2"}, event_id="e1").add("docpkg-A", "Y", {"package_id": "docpkg-A"}, meta={"correlation_id": "d"}, event_id="e2")
    bad.add("loan-A", "Z", a, meta={"causation_id": "nowhere"}, event_id="e3")
    got = {(r.event_id, r.reason) for r in lineage.causal_violations(lineage.audited_events(bad.frame(spark))).collect()}
    assert got == {("e1", lineage.LATE_TARGET), ("e1", lineage.OTHER_CHAIN), ("e3", lineage.MISSING_TARGET)}


def _session_log():
    s = {"session_id": "s1", "agent_type": "credit"}
    log = Log().add("agent-credit-s1", "AgentSessionStarted", {**s, "application_id": "A", "agent_id": "g", "model_version": "claude-9", "context_source": "fresh", "context_token_count": 1200})
    log.add("agent-credit-s1", "AgentNodeExecuted", {**s, "node_name": "load", "node_sequence": 1, "llm_called": True, "llm_cost_usd": 0.012345, "llm_tokens_input": 600, "llm_tokens_output": 150})
    log.add("agent-credit-s1", "AgentToolCalled", {**s, "tool_name": "lookup"}).add("agent-credit-s1", "AgentNodeExecuted", {**s, "node_name": "score", "node_sequence": 2, "llm_called": False})
    return log.add("agent-credit-s1", "AgentOutputWritten", {**s, "application_id": "A", "events_written": [{"stream_id": "credit-A", "event_type": "CreditAnalysisCompleted", "stream_position": 1}]})


def test_context_of_interrupted_sessions(spark):
    log = _session_log().add("agent-credit-s2", "AgentNodeExecuted", {"node_name": "n", "node_sequence": 4})
    asked = spark.createDataFrame([("credit", "s1"), ("credit", "s2"), ("credit", "s3")], "agent_type string, session_id string")
    got = {r.requested_session_id: r for r in sessions.session_contexts(log.frame(spark), asked, token_budget=4000).collect()}
    s1 = got["s1"]
    assert (s1.last_successful_node, s1.next_node_sequence, s1.token_budget_remaining, s1.tools_called, s1.outputs_written, s1.needs_reconciliation) == ("score", 3, 2800, 1, 1, False)
    assert got["s2"].reconciliation_reasons == [sessions.MISSING_ANCHOR] and got["s2"].next_node_sequence == 5
    assert got["s3"].reconciliation_reasons == [sessions.MISSING_STREAM]
    tight = sessions.session_contexts(log.frame(spark), asked.limit(1), token_budget=1000).first()
    assert tight.reconciliation_reasons == [sessions.OVER_BUDGET] and tight.token_budget_remaining == 0


def test_recovery_runs_no_node_twice_and_late_anchor_stops_replay(spark):
    log = Log().add("agent-c-s1", "AgentSessionStarted", {"session_id": "s1"}).add("agent-c-s1", "AgentNodeExecuted", {"session_id": "s1", "node_name": "a"}).add("agent-c-s1", "AgentSessionFailed", {"session_id": "s1"})
    log.add("agent-c-s2", "AgentSessionStarted", {"session_id": "s2"}).add("agent-c-s2", "AgentSessionRecovered", {"session_id": "s2", "recovered_from_session_id": "s1"}).add("agent-c-s2", "AgentNodeExecuted", {"session_id": "s2", "node_name": "b"})
    assert sessions.recovery_lineage(log.frame(spark)).first().no_node_repeated
    log.add("agent-c-s2", "AgentNodeExecuted", {"session_id": "s2", "node_name": "a"}).add("agent-c-s1", "AgentSessionStarted", {"session_id": "s1"})
    assert sessions.recovery_lineage(log.frame(spark)).first().repeated_nodes == 1
    assert sessions.session_records(log.frame(spark)).where("stream_id = 'agent-c-s1'").first().error_position == 4


def test_costs_by_scope(spark):
    got = {(r.scope, r.key): r for r in costs.call_costs(_session_log().frame(spark), application_ids=["A"], application_prefix="A").collect()}
    assert float(got[("all", None)].total_cost_usd) == 0.012345 and got[("all", None)].tokens == 750 and got[("all", None)].application_count == 1
    assert ("provider", "anthropic") in got and ("model", "claude-9") in got and ("agent_type", "credit") in got
    assert costs.call_costs(_session_log().frame(spark), application_ids=["B"]).where("scope = 'all'").first() is None


def test_what_if_replaces_the_credit_analysis(spark):
    log = approved_path(Log(), "A1", tier="HIGH", confidence=0.7)
    body = {"application_id": "A1", "decision": {"risk_tier": "LOW", "recommended_limit_usd": "750000", "confidence": 0.91}}
    import json

    injected = spark.createDataFrame([("A1", 1, "CreditAnalysisCompleted", 2, json.dumps(body))], "application_id string, seq int, event_type string, event_version int, payload string").withColumn("recorded_at", F.lit("2026-03-01").cast("timestamp"))
    cut = branches.branch_timelines(log.frame(spark), "CreditAnalysisCompleted", injected)
    skipped = {r.event_type for r in cut.divergence.where("kind = 'skipped_dependent'").collect()}
    assert {"DecisionGenerated", "FraudScreeningRequested", "AgentSessionCompleted"} <= skipped and "FraudScreeningCompleted" not in skipped
    rows = {r.branch: r for r in branches.branch_outcomes(cut).collect()}
    assert rows["real"].recommendation == "APPROVE" and rows["real"].risk_tier == "HIGH"
    assert (rows["counterfactual"].recommendation, str(rows["counterfactual"].amount_usd), rows["counterfactual"].risk_tier) == ("APPROVE", "500000.00", "LOW")
    numbered = branches.timeline_positions(cut.events).where("branch = 'counterfactual'").orderBy("timeline_position").collect()
    assert numbered[-1].event_id.startswith("injected/") and numbered[-1].timeline_position == len(numbered)
    summary, compliance, agents = branches.replay_branches(cut.events)
    assert {r.branch for r in agents.collect()} == {"real", "counterfactual"} and compliance.count() == 2 and summary.count() == 2


def test_dependents_follow_references_through_others(spark):
    a = {"application_id": "A"}
    log = Log().add("credit-A", "CreditAnalysisCompleted", a, event_id="b").add("credit-A", "Other", a, meta={"causation_id": "b"}, event_id="c").add("credit-A", "Other", {**a, "triggered_by_event_id": "credit-A:2"}, event_id="d")
    log.add("credit-A", "Other", a, event_id="free").add("credit-A", "Other", {**a, "events_written": [{"stream_id": "credit-A", "stream_position": 3}]}, event_id="f")
    related = stage(lineage.application_events(log.frame(spark)))
    got = {r.event_id for r in lineage.dependents(related, lineage.branch_points(related, "CreditAnalysisCompleted")).collect()}
    assert got == {"c", "d", "f"}


def test_reference_tokens_however_a_field_is_spelled(spark):
    rows = [('{"triggered_by_event_id":"a"}', "{}"), ('{"\\u0074riggered_by_event_id":"b"}', "{}"), ('{"note":"decision_event_id"}', "{}"), (None, None), ("{decision_event_id", "{}"), ('{"recovered_from_session_id":5}', "{}"),
            ('{"events_written":[{"stream_id":"x","stream_position":3}],"decision_event_id":""}', '{"causation_id":"c"}')]
    got = spark.createDataFrame(rows, "payload string, metadata string").select(lineage.reference_tokens().alias("t")).collect()
    assert [r.t for r in got] == [["a"], ["b"], [], [], [], ["5"], ["c", "x:3"]]


def test_packages_verify_and_notice_changes(spark, tiny_blocks):
    at = F.lit("2026-03-01").cast("timestamp")
    log = approved_path(approved_path(Log(), "A1"), "B1", hard=True).frame(spark)
    who = spark.createDataFrame([("loan", "A1"), ("loan", "B1")], "entity_type string, entity_id string")
    results = stage(integrity.integrity_checks(log, who, None, at))
    rows = stage(package.package_rows(log, integrity.check_events(results, 10_000), results, at))
    headers = stage(package.package_digests(rows, at))
    assert all(r.ok for r in package.verify_packages(rows, headers, at).collect())
    changed = rows.withColumn("content", F.when((F.col("application_id") == "A1") & (F.col("section") == "projection_states"), F.replace("content", F.lit("FINAL_APPROVED"), F.lit("NEW"))).otherwise(F.col("content")))
    judged = {r.application_id: r for r in package.verify_packages(changed, headers, at).collect()}
    assert not judged["A1"].package_hash_valid and judged["A1"].audit_chain_valid and judged["B1"].ok
    told = [r.content for r in rows.where("application_id = 'B1' and section = 'narrative'").collect()]
    assert any("was submitted for $500000." in t for t in told) and any(t.endswith("The application was declined.") for t in told)


def test_usage_shapes(spark):
    raw = spark.createDataFrame([('{"choices":[{"message":{"content":" hi "}}],"usage":{"prompt_tokens":3,"completion_tokens":4,"cost":0.5}}',), ('{"choices":[{"message":{"content":[{"type":"text","text":"a"},{"type":"x"},{"type":"text","text":" b "}]}}],"usage":{"input_tokens":1,"output_tokens":2,"cost_details":{"prompt":0.1,"completion":0.2}}}',), ("{}",)], "raw string")
    got = {(r.text, r.tokens_input, r.tokens_output, r.cost_usd) for r in costs.normalise_usage(raw).collect()}
    assert got == {("hi", 3, 4, 0.5), ("a\nb", 1, 2, 0.3), ("", 0, 0, 0.0)}
