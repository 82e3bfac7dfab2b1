from pyspark.sql import functions as F

from foldstone.operators import append, commands, documents as D, policy, views
from foldstone.sources import files, registry
from helpers import Log, approved_path, submitted

INCOME = "Revenue $1,000,000\nGross Profit $400,000\nOperating Expenses ($200,000)\nOperating Income (EBIT) $150,000\nDepreciation & Amortization 50,000\nInterest Expense (20,000)\nIncome Before Tax 130,000\nIncome Tax Expense 30,000\nNet Income $100,000"
BALANCE = "Cash and Cash Equivalents $50,000\nAccounts Receivable, net 10,000\nInventory 5,000\nTotal Current Assets 300,000\nTOTAL ASSETS $2,000,000\nTotal Current Liabilities 200,000\nLong-Term Debt 700,000\nTOTAL LIABILITIES 1,200,000\nTOTAL EQUITY 799,000"


def _facts(spark):
    texts = spark.createDataFrame([("C1", "income_statement", INCOME), ("C1", "balance_sheet", BALANCE)], "company_id string, document_type string, text string")
    book = spark.createDataFrame([("C1", "Income Statement", " Revenue", "1006000"), ("C1", "Income Statement", "EBITDA", "250000"), ("C1", "Key Ratios", "Current Ratio", "9.9"), ("C1", "Income Statement", "Nope", "1")], "company_id string, sheet string, label string, value string")
    summary = spark.createDataFrame([("C1", "net_income", "104000"), ("C1", "interest_coverage_ratio", "3.5"), ("C1", "balance_sheet_check", "no"), ("C1", "odd", "1")], "company_id string, field string, value string")
    return D.document_facts(D.statement_facts(texts), D.workbook_facts(book), D.summary_facts(summary))


def test_facts_merge_backfill_and_notes(spark):
    facts = _facts(spark)
    income = facts.where("document_type = 'income_statement'").first()
    assert (str(income.total_revenue), str(income.operating_expenses), income.ebitda, income.notes) == ("1000000.00", "200000.00", None, ["Missing ebitda in income statement PDF"])
    assert round(income.gross_margin, 3) == 0.4 and income.interest_coverage == 7.5
    merged = D.merge_facts(facts)
    m = merged.first()
    assert str(m.ebitda) == "250000.00" and m.field_sources["ebitda"] == "financial_workbook" and m.field_sources["current_ratio"] == "balance_sheet" and m.current_ratio == 1.5
    assert str(m.balance_discrepancy_usd) == "1000.00" and m.balance_sheet_balances is False and m.debt_to_ebitda == 2.8
    notes = D.consistency_notes(facts, merged)
    assert notes.first().consistency_notes == ["total_revenue differs materially between income_statement and financial_workbook", "Balance sheet does not fully balance; discrepancy=1000.00"]
    quality = {r.document_type: r for r in D.quality_assessments(facts, notes).collect()}
    assert (quality["income_statement"].overall_confidence, quality["income_statement"].critical_missing_fields) == (0.55, ["ebitda"])
    assert quality["balance_sheet"].overall_confidence == 0.7 and quality["financial_summary"].anomalies[0] == "CSV summary missing total_revenue"


def test_money_flags_and_lines(spark):
    row = spark.createDataFrame([("($1,234.50)", " 12% ", "2.5x", "", "abc", " Yes")], "a string, b string, c string, d string, e string, f string")
    got = row.select(*[D.parse_money(F.col(c)).alias(c) for c in "abcde"], D.parse_flag(F.col("f")).alias("f")).first()
    assert [str(got[c]) for c in "abcde"] == ["-1234.50", "12.00", "2.50", "None", "None"] and got.f is True
    text = "# Title\n|---|---|\n| EIN: | 12-3 |\n| 7 | Founded: |\n| a | b | c |\n||\n\n plain "
    assert spark.createDataFrame([(text,)], "t string").select(D.plain_lines(F.col("t")).alias("x")).first().x == "Title\nEIN: 12-3\nFounded: 7\na b c\nplain"


def test_differences_are_strict(spark):
    pairs = spark.createDataFrame([(100000, 105000), (100000, 105001), (1, 2)], "a int, b int").select(*[F.col(c).cast("decimal(18,2)").alias(c) for c in "ab"])
    assert [r.d for r in pairs.select(D.material_difference(F.col("a"), F.col("b")).alias("d")).collect()] == [False, True, True]


def test_catalog_and_summary_files(spark, tmp_path):
    for company, names in (("COMP-1", D.REQUIRED_FILES), ("COMP-2", D.REQUIRED_FILES[:2])):
        (tmp_path / company).mkdir()
        for n in names:
            (tmp_path / company / n).write_text("field,value,fiscal_year,currency\ntotal_revenue,10,2024,USD\n" if n.endswith("csv") else "x")
    known = spark.createDataFrame([("COMP-1", "One"), ("COMP-2", "Two")], "company_id string, name string")
    got = {r.company_id: (r.document_count, r.has_complete_package) for r in files.document_catalog(files.list_files(spark, str(tmp_path)), known).collect()}
    assert got == {"COMP-1": (5, True), "COMP-2": (2, False)}
    rows = files.read_summary_files(spark, str(tmp_path / "*" / "*.csv"))
    assert str(D.summary_facts(rows).first().total_revenue) == "10.00"


def test_profiles_prefer_the_registry(spark):
    empty = "company_id string"
    companies = spark.createDataFrame([("C1", "Reg")], "company_id string, name string")
    seeds = spark.createDataFrame([("C1", "Seed"), ("C2", "Seed")], "company_id string, name string")
    flags = spark.createDataFrame([("C1", True), ("C1", False)], "company_id string, is_active boolean")
    got = {r.company_id: (r.name, r.source, r.active_flags, r.has_default) for r in registry.company_profiles(
        companies, flags, spark.createDataFrame([], empty + ", fiscal_year int"), spark.createDataFrame([("C2", True)], empty + ", default_occurred boolean"), seeds).collect()}
    assert got == {"C1": ("Reg", "registry", 1, False), "C2": ("Seed", "seed_profiles", 0, True)}


def test_fraud_and_recommendation_thresholds(spark):
    notes = F.array(F.lit("total_revenue differs"), F.lit("Balance sheet does not fully balance"), F.lit("other"))
    row = spark.range(1).select(policy.fraud_scores(policy.fraud_anomalies(notes, F.lit(2)), F.lit("Retail")).alias("s")).first().s
    assert (row.fraud_score, row.risk_level, row.recommendation) == (0.56, "MEDIUM", "CLEAR")

    def rec(tier, score, caveats):
        return spark.range(1).select(policy.recommended_decision(F.lit(tier), F.lit(0.5), F.lit(10), F.array(*[F.lit(c) for c in caveats]).cast("array<string>"), F.lit(score)).alias("d")).first().d.recommendation

    assert [rec("HIGH", 0.0, []), rec("LOW", 0.6, []), rec("LOW", 0.1, ["x"]), rec("LOW", 0.1, [])] == ["DECLINE", "DECLINE", "REFER", "APPROVE"]


def test_rule_verdicts(spark):
    companies = spark.createDataFrame([("C1", "MT", "LLC", 2000), ("C2", "NY", None, 2024), ("C3", "NY", "LLC", 2000)], "company_id string, jurisdiction string, legal_type string, founded_year int")
    rules = policy.compliance_rules(companies, 2025).withColumnRenamed("company_id", "application_id").withColumn("rule_order", F.lit(1))
    got = {r.application_id: (r.overall_verdict, r.follow_up, r.rules_failed, r.error) for r in policy.compliance_verdicts(rules).collect()}
    assert got == {"C1": ("BLOCKED", "ApplicationDeclined", 1, None), "C2": ("CONDITIONAL", "DecisionRequested", 2, None), "C3": ("CLEAR", "DecisionRequested", 0, None)}
    odd = spark.createDataFrame([("A", 1, "R", "MAYBE", False)], "application_id string, rule_order int, rule_id string, outcome string, is_hard_block boolean")
    assert policy.compliance_verdicts(odd).first().error == "Unknown compliance rule outcome: MAYBE"


def test_commands_through_to_the_log(spark):
    log = Log().add("loan-A", "ApplicationSubmitted", submitted("A")).add("docpkg-A", "PackageReadyForAnalysis", {"application_id": "A"}).add("loan-A", "CreditAnalysisRequested", {})
    log.add("agent-credit_analysis-s", "AgentSessionStarted", {"session_id": "s", "application_id": "A", "agent_type": "credit_analysis", "agent_id": "g", "model_version": "m", "context_source": "x", "context_token_count": 1})
    frame = log.frame(spark)
    states = commands.replay_states(frame)
    cols = "command_id string, application_id string, agent_type string, session_id string, model_version string"
    asked = spark.createDataFrame([("c1", "A", "credit_analysis", "s", "m"), ("c2", "A", "credit_analysis", "s", "other"), ("c3", "B", "credit_analysis", "s", "m")], cols)
    asked = asked.withColumn("decision", F.struct(F.lit("LOW").alias("risk_tier"))).withColumn("at", F.lit("2026-02-01").cast("timestamp"))
    judged = commands.validate_credit(asked, states)
    assert {r.command_id: r.reason for r in judged.collect()} == {"c1": None, "c2": commands.OTHER_MODEL, "c3": commands.NOT_CREDIT}
    made = commands.produced_events("credit", judged, append.stream_heads(frame)).orderBy("stream_id").collect()
    assert [(r.stream_id, r.expected_version, r.event_type) for r in made] == [("credit-A", -1, "CreditAnalysisCompleted"), ("loan-A", 2, "FraudScreeningRequested")]
    assert '"triggered_by_event_id":"credit-A:1"' in made[1].payload


def test_review_commands(spark):
    states = commands.replay_states(Log().add("x-1", "X").frame(spark))
    full = approved_path(Log(), "A1")
    full.rows = [r for r in full.rows if r[4] not in ("HumanReviewCompleted", "ApplicationApproved")]
    states = commands.replay_states(full.frame(spark))
    row = ("A1", "r", False, None, "APPROVE", "APPROVE", 480000.0, 7.5, 36, [])
    cols = "application_id string, reviewer_id string, override boolean, override_reason string, original_recommendation string, final_decision string, approved_amount_usd double, interest_rate_pct double, term_months int, decline_reasons array<string>"
    cases = [row, (*row[:2], True, None, *row[4:]), (*row[:5], "DECLINE", *row[6:]), (*row[:6], 900000.0, *row[7:]), (*row[:7], None, *row[8:])]
    df = spark.createDataFrame([(f"c{i}", *c) for i, c in enumerate(cases)], "command_id string, " + cols).withColumn("at", F.lit("2026-02-01").cast("timestamp"))
    got = {r.command_id: r.reason for r in commands.validate_reviews(df, states).collect()}
    assert got == {"c0": None, "c1": commands.NO_OVERRIDE_REASON, "c2": commands.NEEDS_OVERRIDE, "c3": commands.OVER_LIMIT, "c4": commands.INCOMPLETE_APPROVAL}


def test_visibility_and_lanes(spark):
    log = Log()
    for app in ("APEX-0001", "APEX-TEST-1", "OTHER-1", "APEX-LIVE"):
        log.add(f"loan-{app}", "ApplicationSubmitted", submitted(app))
    log.add("loan-APEX-LIVE", "DecisionGenerated", {"application_id": "APEX-LIVE", "confidence": 0.1})
    companies = spark.createDataFrame([("COMP-1", "One", "i", "NY")], "company_id string, name string, industry string, jurisdiction string")
    rows = views.portfolio(views.grouped_events(log.frame(spark)), companies)
    got = {r.application_id: (r.client_visible, r.origin) for r in rows.collect()}
    assert got == {"APEX-0001": (True, "seeded"), "APEX-TEST-1": (False, "live"), "OTHER-1": (False, "live"), "APEX-LIVE": (False, "live")}
    lanes = {r.lane: r for r in views.queue_lanes(rows).collect()}
    assert lanes["open"].applications == 4 and lanes["open"].is_busiest and lanes["all"].share_pct == 100
