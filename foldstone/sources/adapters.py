"""The supplied star-schema tables read as ledgers, registries and documents (pure column expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foldstone.operators.scan import before, count_so_far, running
from foldstone.session import prepare

# event_type of the table, k modulo 4 -> ledger event type
LOAN_EVENT_TYPES = {
    "signup": ("ApplicationSubmitted", "ApplicationSubmitted", "CreditAnalysisRequested", "DocumentUploadRequested"),
    "view": ("DocumentUploaded", "PackageReadyForAnalysis", "FraudScreeningRequested", "AgentSessionCompleted"),
    "click": ("CreditAnalysisCompleted", "FraudScreeningCompleted", "ComplianceCheckRequested", "ComplianceCheckCompleted"),
    "purchase": ("DecisionGenerated", "DecisionGenerated", "DecisionRequested", "ApplicationApproved"),
    "error": ("ApplicationDeclined", "HumanReviewCompleted", "HumanReviewRequested", "AgentSessionStarted"),
}
RULE_EVENT_TYPES = {
    "signup": "ComplianceCheckInitiated",
    "view": "ComplianceRulePassed",
    "click": "ComplianceRuleNoted",
    "error": "ComplianceRuleFailed",
    "purchase": "ComplianceCheckCompleted",
}
AGENT_KINDS = ("credit_analysis", "fraud_detection", "decision_orchestrator")
MODELS = ("claude-x", "qwen3", "openai/gpt", "deterministic-v1", "llama:8b", "other")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def _pick(index: Column, values) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _base_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events clustered by position, so that the files of a stored ledger prune on it and payloads are built in parallel."""
    source = table(spark, folder, "events").repartitionByRange("event_id").sortWithinPartitions("event_id")
    return source.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").cast("string").alias("app"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def _cents(amount: Column) -> Column:
    return F.round(amount, 0).cast("decimal(18,2)").cast("string")


def loan_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """events -> one ledger over loan, package, credit, fraud, compliance and agent streams (positions not numbered)."""
    src = _base_events(spark, folder)
    k, app, value = F.col("k"), F.col("app"), F.col("value")
    kind = F.lit(None).cast("string")
    for name, types in LOAN_EVENT_TYPES.items():
        kind = F.when(F.col("event_type") == name, _pick(k % 4, types)).otherwise(kind)
    src = src.withColumn("type", kind)
    t = F.col("type")
    lane = F.floor(k / 4) % 3
    session = F.concat(F.lit("s"), app, F.lit("-"), lane.cast("string"))
    agent_kind = _pick(lane, AGENT_KINDS)
    family = (
        F.when(t == "CreditAnalysisCompleted", F.concat(F.lit("credit-"), app))
        .when(t == "FraudScreeningCompleted", F.concat(F.lit("fraud-"), app))
        .when(t == "ComplianceCheckCompleted", F.concat(F.lit("compliance-"), app))
        .when(t == "PackageReadyForAnalysis", F.concat(F.lit("docpkg-"), app))
        .when(t.isin("AgentSessionStarted", "AgentSessionCompleted"), F.concat(F.lit("agent-"), agent_kind, F.lit("-"), session))
        .otherwise(F.concat(F.lit("loan-"), app))
    )

    def only(types, expr: Column) -> Column:
        return F.when(t.isin(*([types] if isinstance(types, str) else types)), expr)

    sided = ["CreditAnalysisCompleted", "FraudScreeningCompleted", "ComplianceCheckCompleted", "AgentSessionStarted", "AgentSessionCompleted"]
    submitted = "ApplicationSubmitted"
    amount = (
        F.when((t == "DecisionGenerated") & (lane == 0), _cents(value * 800))
        .when((t == "ApplicationApproved") & (k % 16 != 3), _cents(value * 850))
    )
    payload = F.to_json(
        F.struct(
            app.alias("application_id"),
            only(sided, session).alias("session_id"),
            only("DecisionGenerated", session).alias("orchestrator_session_id"),
            only(submitted, F.when(k % 12 != 0, F.concat(F.lit("CUST-"), (app.cast("bigint") % 50).cast("string")))).alias("applicant_id"),
            only(submitted, _cents(value * 1000)).alias("requested_amount_usd"),
            only(submitted, _pick(k % 3, ("expansion", "bridge", "working_capital"))).alias("loan_purpose"),
            only(submitted, k + 12).alias("loan_term_months"),
            only(submitted, F.lit("web")).alias("submission_channel"),
            only(submitted, F.when(k % 40 != 0, F.concat(F.lit("ref-"), k.cast("string")))).alias("application_reference"),
            only("DocumentUploaded", F.concat(F.lit("doc-"), k.cast("string"))).alias("document_id"),
            only(
                "CreditAnalysisCompleted",
                F.struct(
                    F.when(k % 20 != 0, _pick(k % 3, ("LOW", "MEDIUM", "HIGH"))).alias("risk_tier"),
                    _cents(value * 900).alias("recommended_limit_usd"),
                    (k / 100.0).alias("confidence"),
                ),
            ).alias("decision"),
            only("CreditAnalysisCompleted", k + 100).alias("analysis_duration_ms"),
            F.when((t == "CreditAnalysisCompleted") & (k % 8 != 0), F.concat(F.lit("m"), (k % 2).cast("string")))
            .when(t == "AgentSessionStarted", F.concat(F.lit("m"), (k % 2).cast("string"))).alias("model_version"),
            only("FraudScreeningCompleted", F.when(k % 20 != 1, k / 100.0)).alias("fraud_score"),
            only("ComplianceCheckCompleted", _pick(k % 3, ("CLEAR", "BLOCKED", "CONDITIONAL"))).alias("overall_verdict"),
            only("DecisionGenerated", F.when(k % 25 != 0, _pick(lane, ("APPROVE", "DECLINE", "REFER")))).alias("recommendation"),
            only("DecisionGenerated", k / 100.0).alias("confidence"),
            amount.alias("approved_amount_usd"),
            only("DecisionGenerated", F.array(*[F.concat(_pick(F.lit(i), AGENT_KINDS), F.lit("-s"), app, F.lit(f"-{i}")) for i in (0, 1)])).alias("contributing_sessions"),
            only("HumanReviewCompleted", F.concat(F.lit("rev-"), (k % 5).cast("string"))).alias("reviewer_id"),
            only("HumanReviewCompleted", k % 3 == 0).alias("override"),
            only("HumanReviewCompleted", F.lit("REFER")).alias("original_recommendation"),
            only("HumanReviewCompleted", _pick(k % 2, ("APPROVE", "DECLINE"))).alias("final_decision"),
            only("ApplicationDeclined", F.array(F.when(k % 8 == 0, F.lit("Compliance hard block: REG-003")).otherwise(F.lit("policy")))).alias("decline_reasons"),
            only("ApplicationApproved", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("approved_at"),
            only("AgentSessionStarted", agent_kind).alias("agent_type"),
            only("AgentSessionStarted", F.concat(F.lit("agent-"), (k % 7).cast("string"))).alias("agent_id"),
            only("AgentSessionStarted", F.lit("registry")).alias("context_source"),
            only("AgentSessionStarted", k * 10).alias("context_token_count"),
        )
    )
    return src.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_id"),
        family.alias("stream_id"),
        F.lit(None).cast("bigint").alias("stream_position"),
        F.col("event_id").alias("global_position"),
        t.alias("event_type"),
        F.when(t.isin("CreditAnalysisCompleted", "DecisionGenerated") & (k % 8 != 0), 2).otherwise(1).alias("event_version"),
        payload.alias("payload"),
        F.to_json(
            F.struct(
                F.concat(F.lit("c"), app).alias("correlation_id"),
                F.when(k > 0, F.concat(F.lit("e"), (F.col("event_id") - k).cast("string"))).alias("causation_id"),
            )
        ).alias("metadata"),
        F.col("ts").alias("recorded_at"),
    )


def numbered(ledger: DataFrame) -> DataFrame:
    """Number stream positions from 1 in global order."""
    ranked = running(ledger.drop("stream_position"), ["stream_id"], "global_position", {"stream_position": count_so_far()})
    return ranked.select(*ledger.columns)


def linked(ledger: DataFrame) -> DataFrame:
    """The same events, each third one naming the event just before it in its application as its cause."""
    ledger = ledger.withColumn("_app", F.get_json_object("payload", "$.application_id"))
    with_prev = running(ledger, ["_app"], "global_position", {"_prev": before(F.col("event_id"))})
    k = F.col("global_position") % 3
    meta = F.to_json(F.struct(F.concat(F.lit("c"), F.col("_app")).alias("correlation_id"), F.when(k == 0, F.col("_prev")).alias("causation_id")))
    return with_prev.select(*[meta.alias("metadata") if c == "metadata" else F.col(c) for c in ledger.columns if c != "_app"])


def rule_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """events -> compliance streams, one application per user."""
    src = _base_events(spark, folder)
    k, app = F.col("k"), F.col("app")
    kind = F.lit(None).cast("string")
    for name, target in RULE_EVENT_TYPES.items():
        kind = F.when(F.col("event_type") == name, F.lit(target)).otherwise(kind)
    t = kind
    rule = F.concat(F.lit("REG-00"), (k % 6 + 1).cast("string"))
    ruled = t.isin("ComplianceRulePassed", "ComplianceRuleFailed", "ComplianceRuleNoted")
    first_rules = F.slice(F.array(*[F.lit(f"REG-00{i}") for i in range(1, 7)]), 1, (k % 6 + 1).cast("int"))
    payload = F.to_json(
        F.struct(
            app.alias("application_id"),
            F.concat(F.lit("s"), app).alias("session_id"),
            F.when(t == "ComplianceCheckInitiated", F.concat(F.lit("set-"), (k % 4).cast("string"))).alias("regulation_set_version"),
            F.when(t == "ComplianceCheckInitiated", first_rules).alias("rules_to_evaluate"),
            F.when(ruled, rule).alias("rule_id"),
            F.when(t == "ComplianceRuleFailed", k % 10 == 0).alias("is_hard_block"),
            F.when(ruled, F.concat(F.lit("Rule "), rule)).alias("rule_name"),
            F.when(ruled & (t != "ComplianceRuleNoted"), F.concat(F.lit("v"), (k % 3).cast("string"))).alias("rule_version"),
            F.when(ruled & (t != "ComplianceRuleNoted"), F.concat(F.lit("ev"), F.col("event_id").cast("string"))).alias("evidence_hash"),
            F.when(t == "ComplianceRulePassed", F.concat(F.lit("checked "), k.cast("string"))).alias("evaluation_notes"),
            F.when(t == "ComplianceRuleFailed", F.concat(F.lit("failed "), k.cast("string"))).alias("failure_reason"),
            F.when(t == "ComplianceRuleFailed", k % 2 == 0).alias("remediation_available"),
            F.when((t == "ComplianceRuleFailed") & (k % 2 == 0), F.concat(F.lit("remedy "), k.cast("string"))).alias("remediation_description"),
            F.when(t == "ComplianceRuleNoted", _pick(k % 2, ("INFO", "LIMIT"))).alias("note_type"),
            F.when(t == "ComplianceRuleNoted", F.concat(F.lit("note "), k.cast("string"))).alias("note_text"),
            F.when(ruled, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("evaluated_at"),
            F.when(t == "ComplianceCheckCompleted", k % 5 == 0).alias("has_hard_block"),
            F.when(t == "ComplianceCheckCompleted", _pick(k % 3, ("CLEAR", "BLOCKED", "CONDITIONAL"))).alias("overall_verdict"),
        )
    )
    return src.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_id"),
        F.concat(F.lit("compliance-"), app).alias("stream_id"),
        F.lit(None).cast("bigint").alias("stream_position"),
        F.col("event_id").alias("global_position"),
        t.alias("event_type"),
        F.lit(1).alias("event_version"),
        payload.alias("payload"),
        F.lit("{}").alias("metadata"),
        F.col("ts").alias("recorded_at"),
    )


def session_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """conversations -> agent session streams; system turns start a session, the others are node and tool events."""
    src = table(spark, folder, "conversations").select(
        "conv_id", "turn", "role", F.length("text").alias("n"), F.col("conv_id").cast("string").alias("c")
    )
    n, c, turn, conv = F.col("n"), F.col("c"), F.col("turn"), F.col("conv_id")
    t = (
        F.when(F.col("role") == "system", "AgentSessionStarted")
        .when((F.col("role") == "assistant") & (n % 11 == 0), "AgentSessionCompleted")
        .when((F.col("role") == "assistant") & (n % 13 == 0), "AgentSessionFailed")
        .when(F.col("role") == "assistant", "AgentNodeExecuted")
        .when(n % 5 == 0, "AgentOutputWritten")
        .when(n % 17 == 0, "AgentSessionRecovered")
        .otherwise("AgentToolCalled")
    )
    src = src.withColumn("t", t)
    t = F.col("t")
    app = F.concat(F.lit("app-"), (conv % 20).cast("string"))
    output = F.struct(
        F.concat(F.lit("credit-"), app).alias("stream_id"), F.lit("CreditAnalysisCompleted").alias("event_type"), (turn + 1).alias("stream_position")
    )
    payload = F.to_json(
        F.struct(
            F.concat(F.lit("s"), c).alias("session_id"),
            F.lit("chat").alias("agent_type"),
            F.when(t == "AgentSessionStarted", F.concat(F.lit("bot-"), (conv % 7).cast("string"))).alias("agent_id"),
            F.when(t.isin("AgentSessionStarted", "AgentOutputWritten", "AgentSessionCompleted", "AgentSessionFailed"), app).alias("application_id"),
            F.when(t == "AgentSessionStarted", _pick(conv % 6, MODELS)).alias("model_version"),
            F.when(t == "AgentSessionStarted", F.lit("fresh")).alias("context_source"),
            F.when(t == "AgentSessionStarted", n * 10).alias("context_token_count"),
            F.when(t == "AgentNodeExecuted", F.concat(F.lit("node_"), (n % 4).cast("string"))).alias("node_name"),
            F.when(t == "AgentNodeExecuted", turn).alias("node_sequence"),
            F.when(t == "AgentNodeExecuted", n % 7 != 0).alias("llm_called"),
            F.when((t == "AgentNodeExecuted") & (n % 3 == 0), F.lit("openrouter")).alias("llm_provider"),
            F.when((t == "AgentNodeExecuted") & (n % 2 == 0), F.concat(F.lit("mod-"), (n % 3).cast("string"))).alias("llm_model"),
            F.when(t == "AgentNodeExecuted", n).alias("llm_tokens_input"),
            F.when(t == "AgentNodeExecuted", n % 50).alias("llm_tokens_output"),
            F.when((t == "AgentNodeExecuted") & (n % 9 != 0), (n / F.lit(100000)).cast("decimal(12,6)")).alias("llm_cost_usd"),
            F.when(t == "AgentToolCalled", F.concat(F.lit("tool_"), (n % 6).cast("string"))).alias("tool_name"),
            F.when(t == "AgentOutputWritten", F.array(output)).alias("events_written"),
            F.when(t == "AgentSessionRecovered", F.concat(F.lit("s"), (conv - 1).cast("string"))).alias("recovered_from_session_id"),
            F.when(t == "AgentSessionCompleted", (n / F.lit(10000)).cast("decimal(12,6)")).alias("total_cost_usd"),
            F.when(t == "AgentSessionCompleted", n).alias("total_tokens_used"),
        )
    )
    position = conv * F.lit(1048576).cast("bigint") + turn
    return src.select(
        F.concat(F.lit("t"), position.cast("string")).alias("event_id"),
        F.concat(F.lit("agent-chat-s"), c).alias("stream_id"),
        (turn + 1).alias("stream_position"),
        position.alias("global_position"),
        t.alias("event_type"),
        F.lit(1).alias("event_version"),
        payload.alias("payload"),
        F.lit("{}").alias("metadata"),
        F.timestamp_seconds(F.lit(1700000000) + position % 100000).alias("recorded_at"),
    )


# ---- registry and documents ---------------------------------------------------------------------------------------
def company_key(key: Column) -> Column:
    return F.concat(F.lit("COMP-"), key.cast("string"))


def companies(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer")
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    return c.select(
        company_key(key).alias("company_id"),
        F.col("c_name").alias("name"),
        F.when(key % 4 == 0, F.lit("Retail")).otherwise(F.lower("c_mktsegment")).alias("industry"),
        F.when(nation == 3, F.lit("MT")).otherwise(F.concat(F.lit("N"), nation.cast("string"))).alias("jurisdiction"),
        F.when(key % 9 != 0, F.lit("LLC")).alias("legal_type"),
        (F.lit(1990) + key % 36).cast("int").alias("founded_year"),
        F.when(F.col("c_acctbal") < 0, F.lit("HIGH")).when(F.col("c_acctbal") < 3000, F.lit("MEDIUM")).otherwise(F.lit("LOW")).alias("risk_segment"),
        _pick(key % 5, ("GROWTH", "STABLE", "GROWTH", "RECOVERING", "DECLINING")).alias("trajectory"),
    )


def company_flags(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'")
    return o.select(
        F.col("o_orderkey").alias("id"), company_key(F.col("o_custkey")).alias("company_id"), F.lit("AML_WATCH").alias("flag_type"), F.lit("LOW").alias("severity"),
        (F.col("o_orderstatus") == "P").alias("is_active"), F.to_date("o_orderdate").alias("added_date"),
    )


def company_loans(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), company_key(F.col("o_custkey")).alias("company_id"), F.col("o_totalprice").cast("decimal(15,2)").alias("loan_amount"),
        F.year("o_orderdate").alias("loan_year"), (F.col("o_orderstatus") == "F").alias("was_repaid"),
        ((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 450000)).alias("default_occurred"),
    )


def company_history(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return o.groupBy(company_key(F.col("o_custkey")).alias("company_id"), F.year("o_orderdate").alias("fiscal_year")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(18,2)").alias("total_revenue")
    )


def company_figures(spark: SparkSession, folder: str) -> DataFrame:
    """Whole-dollar revenue per customer; every other figure of its documents follows from it."""
    o = table(spark, folder, "orders")
    revenue = F.floor(F.sum(F.col("o_totalprice").cast("decimal(18,2)"))).cast("bigint")
    # A row of figures is a few bytes, its documents are texts; the number is given so that they are built and read in parallel.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return o.groupBy(F.col("o_custkey").alias("k")).agg(revenue.alias("r")).withColumn("company_id", company_key(F.col("k"))).repartition(parts, "company_id")


def _share(numerator: int, denominator: int) -> Column:
    return F.floor(F.col("r") * numerator / denominator).cast("bigint")


def _figures() -> dict[str, Column]:
    k = F.col("k")
    assets, debts = F.col("r") * 2, _share(12, 10)
    return {
        "Revenue": F.col("r"), "Gross Profit": _share(4, 10), "Operating Expenses": _share(2, 10), "Operating Income (EBIT)": _share(15, 100),
        "EBITDA": _share(3, 10), "Depreciation & Amortization": _share(5, 100), "Interest Expense": F.when(k % 11 != 0, _share(2, 100)).otherwise(F.lit(0)),
        "Income Before Tax": _share(13, 100), "Income Tax Expense": _share(3, 100), "Net Income": _share(10, 100),
        "Cash & Equivalents": _share(1, 10), "Accounts Receivable": _share(2, 10), "Inventory": _share(1, 20), "Total Current Assets": _share(6, 10),
        "TOTAL ASSETS": assets, "Total Current Liabilities": _share(5, 10), "Long-Term Debt": F.when(k % 6 == 0, _share(3, 1)).otherwise(_share(1, 1)),
        "TOTAL LIABILITIES": debts, "TOTAL EQUITY": assets - debts - F.when(k % 5 == 0, F.lit(600)).otherwise(F.lit(100)),
    }


INCOME_LINES = ("Revenue", "Gross Profit", "Operating Expenses", "Operating Income (EBIT)", "EBITDA", "Depreciation & Amortization", "Interest Expense",
                "Income Before Tax", "Income Tax Expense", "Net Income")
BALANCE_LINES = ("Cash & Equivalents", "Accounts Receivable", "Inventory", "Total Current Assets", "TOTAL ASSETS", "Total Current Liabilities", "Long-Term Debt",
                 "TOTAL LIABILITIES", "TOTAL EQUITY")


def statement_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Income statement, balance sheet and proposal text per customer."""
    f, k = _figures(), F.col("k")

    def line(name: str) -> Column:
        shown = F.format_number(f[name], 0)
        if name == "Operating Expenses":
            text = F.concat(F.lit(name + "  ($"), shown, F.lit(")"))
        elif name == "Cash & Equivalents":
            text = F.concat(F.lit("Cash and Cash Equivalents $"), shown)
        else:
            text = F.concat(F.lit(name + " $"), shown)
        return F.when((F.lit(name) != "EBITDA") | (k % 7 != 0), text)

    income = F.concat_ws("\n", F.lit("Income Statement FY2024"), *[line(n) for n in INCOME_LINES])
    balance = F.concat_ws("\n", F.lit("Balance Sheet"), *[line(n) for n in BALANCE_LINES])
    proposal = F.concat_ws(
        "\n", F.concat(F.lit("Legal Entity Name: Customer "), k.cast("string")), F.concat(F.lit("Founded: "), (F.lit(1990) + k % 36).cast("string")),
        F.concat(F.lit("Employees: "), F.format_number(k * 7 + 1000, 0)), F.when(k % 8 != 0, F.concat(F.lit("Requested Amount: $"), F.format_number(_share(5, 10), 0))),
        F.concat(F.lit("Purpose: "), _pick(k % 4, ("Working Capital", "Expansion", "Real Estate", "Something else"))),
    )
    kinds = {"income_statement": income, "balance_sheet": balance, "application_proposal": proposal}
    rows = F.array(*[F.struct(F.lit(n).alias("document_type"), t.alias("text")) for n, t in kinds.items()])
    return company_figures(spark, folder).select("company_id", F.inline(rows))


def workbook_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Workbook of each customer in long form; revenue is 6000 higher for every fourth one."""
    f, k = _figures(), F.col("k")
    rows = []
    for sheet, names in (("Income Statement", INCOME_LINES), ("Balance Sheet", BALANCE_LINES)):
        for n in names:
            value = f[n] + F.when((k % 4 == 0) & (F.lit(n) == "Revenue"), F.lit(6000)).otherwise(F.lit(0))
            rows.append(F.struct(F.lit(sheet).alias("sheet"), F.lit(n).alias("label"), value.cast("string").alias("value")))
    return company_figures(spark, folder).select("company_id", F.inline(F.array(*rows)))


def summary_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Summary file rows of each customer; net income is 7000 higher for every third one."""
    f, k = _figures(), F.col("k")
    values = {
        "total_revenue": f["Revenue"].cast("string"), "net_income": (f["Net Income"] + F.when(k % 3 == 0, F.lit(7000)).otherwise(F.lit(0))).cast("string"),
        "interest_coverage_ratio": F.lit("7.5"), "balance_sheet_check": F.when(k % 5 == 0, F.lit("False")).otherwise(F.lit("True")), "unknown_field": F.lit("1"),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("field"), v.alias("value")) for n, v in values.items()])
    return company_figures(spark, folder).select("company_id", F.inline(rows))


# ---- one well-formed application per customer, advanced to a depth given by its key ---------------------------------
def lifecycle_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """customer -> applications W<key> that went 1 to 18 steps through the loan process."""
    # The key column of all customers fits one split, but their events are many times as large, so they are built in parallel.
    # The number is given, as partitions sized by the keys alone would be joined to a few.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("k")).repartition(parts, "k")
    k = F.col("k")
    key, app = k.cast("string"), F.concat(F.lit("W"), k.cast("string"))
    hard = k % 5 == 0
    session = F.concat(F.lit("w"), key)
    agent_stream = F.concat(F.lit("agent-credit_analysis-"), session)

    def stream(family: str) -> Column:
        return F.concat(F.lit(family + "-"), app)

    def fields(**named) -> Column:
        return F.to_json(F.struct(app.alias("application_id"), *[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in named.items()]))

    rec = _pick(k % 3, ("APPROVE", "DECLINE", "REFER"))
    final = F.when(k % 2 == 0, F.lit("APPROVE")).otherwise(F.lit("DECLINE"))
    credit = F.struct(_pick(k % 3, ("LOW", "MEDIUM", "HIGH")).alias("risk_tier"), (F.lit(9000) + k * 12).cast("string").alias("recommended_limit_usd"), (F.lit(0.5) + (k % 50) / 100.0).alias("confidence"))
    written = F.array(F.struct(stream("credit").alias("stream_id"), F.lit("CreditAnalysisCompleted").alias("event_type"), F.lit(1).alias("stream_position")))
    reason = F.array(F.lit("Compliance hard block: REG-002"))
    steps = [
        (stream("loan"), "ApplicationSubmitted", fields(applicant_id=company_key(k), requested_amount_usd=(F.lit(10000) + k * 10).cast("string"), loan_purpose="bridge", loan_term_months=24,
                                                        submission_channel="web", application_reference=F.concat(F.lit("ref-"), key))),
        (stream("loan"), "DocumentUploadRequested", fields(requested_by="desk")),
        (stream("docpkg"), "PackageReadyForAnalysis", fields(package_id=stream("docpkg"))),
        (stream("loan"), "CreditAnalysisRequested", fields(requested_by="desk")),
        (agent_stream, "AgentSessionStarted", fields(session_id=session, agent_type="credit_analysis", agent_id=F.concat(F.lit("a"), (k % 7).cast("string")), model_version=F.concat(F.lit("m"), (k % 2).cast("string")),
                                                     context_source="fresh", context_token_count=500)),
        (stream("credit"), "CreditAnalysisCompleted", fields(session_id=session, decision=credit, model_version=F.concat(F.lit("m"), (k % 2).cast("string")), analysis_duration_ms=40)),
        (stream("loan"), "FraudScreeningRequested", fields(triggered_by_event_id=F.concat(stream("credit"), F.lit(":1")))),
        (stream("fraud"), "FraudScreeningCompleted", fields(session_id=session, fraud_score=(k % 100) / 100.0)),
        (stream("loan"), "ComplianceCheckRequested", fields(triggered_by_event_id=F.concat(stream("fraud"), F.lit(":1")))),
        (stream("compliance"), "ComplianceCheckInitiated", fields(session_id=session, regulation_set_version="2026-Q1", rules_to_evaluate=F.array(F.lit("REG-001"), F.lit("REG-002"), F.lit("REG-006")))),
        (stream("compliance"), "ComplianceRulePassed", fields(session_id=session, rule_id="REG-001")),
        (stream("compliance"), F.when(hard, F.lit("ComplianceRuleFailed")).otherwise(F.lit("ComplianceRulePassed")), fields(session_id=session, rule_id="REG-002", is_hard_block=F.when(hard, F.lit(True)))),
        (stream("compliance"), "ComplianceCheckCompleted", fields(session_id=session, has_hard_block=hard, overall_verdict=F.when(hard, F.lit("BLOCKED")).otherwise(F.lit("CLEAR")))),
        (stream("loan"), F.when(hard, F.lit("ApplicationDeclined")).otherwise(F.lit("DecisionRequested")), fields(decline_reasons=F.when(hard, reason))),
        (agent_stream, "AgentOutputWritten", fields(session_id=session, events_written=written)),
        (stream("loan"), "DecisionGenerated", fields(orchestrator_session_id=session, recommendation=rec, confidence=(F.lit(0.5) + (k % 50) / 100.0), contributing_sessions=F.array(agent_stream))),
        (stream("loan"), "HumanReviewCompleted", fields(reviewer_id="r1", override=(rec != final) & (rec != "REFER"), original_recommendation=rec, final_decision=final)),
        (stream("loan"), F.when(final == "APPROVE", F.lit("ApplicationApproved")).otherwise(F.lit("ApplicationDeclined")), fields(approved_amount_usd=F.when(final == "APPROVE", F.lit("8000")), decline_reasons=F.when(final == "DECLINE", F.array(F.lit("review"))))),
    ]
    depth = F.when(hard, F.least(k % 18 + 1, F.lit(15))).otherwise(k % 18 + 1)
    structs = F.array(*[
        F.struct(F.lit(i).alias("step"), s.alias("stream_id"), (t if isinstance(t, Column) else F.lit(t)).alias("event_type"), F.when(depth >= i, p).alias("payload")) for i, (s, t, p) in enumerate(steps, start=1)
    ])
    rows = c.select("k", F.inline(F.slice(structs, F.lit(1), depth.cast("int"))))
    position = F.col("k") * 32 + F.col("step")
    return rows.select(
        F.concat(F.lit("w"), position.cast("string")).alias("event_id"), "stream_id", F.lit(None).cast("bigint").alias("stream_position"), position.alias("global_position"), "event_type",
        F.lit(2).alias("event_version"), "payload", F.to_json(F.struct(F.concat(F.lit("cw"), F.col("k").cast("string")).alias("correlation_id"))).alias("metadata"),
        F.timestamp_seconds(F.lit(1704067200) + position).alias("recorded_at"),
    )
