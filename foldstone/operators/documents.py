"""Financial facts from documents: extraction, ratios, merge by source priority, consistency, quality, package events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from foldstone.operators.scan import number_rows

# ---- fixed values -------------------------------------------------------------------------------------------------
AMOUNT = r"(\(?\$?[0-9,]+(?:\.[0-9]+)?\)?)"
INCOME_LABELS = {
    "total_revenue": r"Revenue\s+",
    "gross_profit": r"Gross Profit\s+",
    "operating_expenses": r"Operating Expenses\s+",
    "operating_income": r"Operating Income \(EBIT\)\s+",
    "ebitda": r"EBITDA\s+",
    "depreciation_amortization": r"Depreciation\s*&\s*Amortization\s+",
    "interest_expense": r"Interest Expense\s+",
    "income_before_tax": r"Income Before Tax\s+",
    "tax_expense": r"Income Tax Expense\s+",
    "net_income": r"Net Income\s+",
}
BALANCE_LABELS = {
    "cash_and_equivalents": r"Cash (?:and Cash )?Equivalents\s+",
    "accounts_receivable": r"Accounts Receivable(?:,\s*net)?\s+",
    "inventory": r"Inventory\s+",
    "current_assets": r"Total Current Assets\s+",
    "total_assets": r"TOTAL ASSETS\s+",
    "current_liabilities": r"Total Current Liabilities\s+",
    "long_term_debt": r"Long-Term Debt\s+",
    "total_liabilities": r"TOTAL LIABILITIES\s+",
    "total_equity": r"TOTAL EQUITY\s+",
}
ABSOLUTE_FIELDS = ("operating_expenses", "depreciation_amortization", "interest_expense", "tax_expense")
PROPOSAL_PATTERNS = {
    "legal_entity_name": r"Legal Entity Name:\s*(.+)",
    "business_type": r"Business Type:\s*(.+)",
    "industry": r"Industry:\s*(.+)",
    "naics": r"NAICS:\s*([0-9-]+)",
    "ein": r"EIN:\s*([0-9-]+)",
    "jurisdiction": r"Jurisdiction:\s*([A-Z]{2})",
    "founded_year": r"Founded:\s*(\d{4})",
    "employee_count": r"Employees:\s*([0-9,]+)",
    "requested_amount_usd": r"Requested Amount:\s*" + AMOUNT,
    "purpose": r"Purpose:\s*(.+)",
    "use_of_proceeds": r"Use of Proceeds:\s*(.+)",
}
WORKBOOK_LABELS = {
    "Income Statement": {
        "Revenue": "total_revenue",
        "Gross Profit": "gross_profit",
        "Operating Expenses": "operating_expenses",
        "Depreciation & Amortization": "depreciation_amortization",
        "Operating Income (EBIT)": "operating_income",
        "EBITDA": "ebitda",
        "Interest Expense": "interest_expense",
        "Income Before Tax": "income_before_tax",
        "Income Tax Expense": "tax_expense",
        "Net Income": "net_income",
    },
    "Balance Sheet": {
        "Cash & Equivalents": "cash_and_equivalents",
        "Accounts Receivable": "accounts_receivable",
        "Inventory": "inventory",
        "Total Current Assets": "current_assets",
        "TOTAL ASSETS": "total_assets",
        "Total Current Liabilities": "current_liabilities",
        "Long-Term Debt": "long_term_debt",
        "TOTAL LIABILITIES": "total_liabilities",
        "TOTAL EQUITY": "total_equity",
    },
    "Key Ratios": {
        "Current Ratio": "current_ratio",
        "Debt/Equity": "debt_to_equity",
        "Debt/EBITDA": "debt_to_ebitda",
        "Interest Coverage": "interest_coverage",
    },
}
CASH_FLOW_FIELDS = ("operating_cash_flow", "investing_cash_flow", "financing_cash_flow", "free_cash_flow")
MONEY_FIELDS = (*INCOME_LABELS, *BALANCE_LABELS, *CASH_FLOW_FIELDS)
RATIO_FIELDS = ("debt_to_equity", "current_ratio", "debt_to_ebitda", "interest_coverage", "gross_margin", "ebitda_margin", "net_margin")
SUMMARY_NAMES = {"interest_coverage_ratio": "interest_coverage"}
SOURCE_ORDER = ("income_statement", "balance_sheet", "financial_workbook", "financial_summary")
COMPARED_FIELDS = ("total_revenue", "ebitda", "net_income", "total_assets", "total_liabilities", "total_equity")
BALANCE_TOLERANCE, SMALL_TOLERANCE, LARGE_TOLERANCE, SMALL_LIMIT = 500, 0.05, 5000, 10
FORMATS = {"application_proposal": "pdf", "income_statement": "pdf", "balance_sheet": "pdf", "financial_workbook": "xlsx", "financial_summary": "csv"}
REQUIRED_FILES = ("application_proposal.pdf", "income_statement_2024.pdf", "balance_sheet_2024.pdf", "financial_statements.xlsx", "financial_summary.csv")
AUDITOR_TEXT = ". Quality assessment is deterministic and based on extraction notes plus package consistency checks."
PIPELINE_VERSION = "phase1-document-processor"
WHITESPACE = r"^\s+|\s+$"


# ---- text and number parsing --------------------------------------------------------------------------------------
def parse_money(text: Column) -> Column:
    """Amount text to decimal: currency signs dropped, parentheses mean negative, unreadable text is null."""
    plain = F.regexp_replace(text, WHITESPACE, "")
    value = F.regexp_replace(plain, r"[$,()%x]", "").try_cast("decimal(18,2)")
    return F.when(plain.startswith("(") & plain.endswith(")"), -value).otherwise(value)


def parse_count(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s,]", "").try_cast("bigint")


def parse_flag(text: Column) -> Column:
    word = F.lower(F.regexp_replace(text, WHITESPACE, ""))
    return F.when(word.isin("true", "1", "yes"), F.lit(True)).when(word.isin("false", "0", "no"), F.lit(False))


def first_match(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, "(?im)" + pattern, 1)
    return F.nullif(F.regexp_replace(found, WHITESPACE, ""), F.lit(""))


def plain_lines(text: Column) -> Column:
    """Markdown to plain lines: table rules dropped, label/value rows joined label first, heading marks removed."""
    def strip(x: Column) -> Column:
        return F.regexp_replace(x, WHITESPACE, "")

    lines = F.filter(F.transform(F.split(text, "\r\n|\n|\r"), strip), lambda x: x != "")

    def row(line: Column) -> Column:
        cells = F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|"), strip)
        left, right = F.get(cells, F.lit(0)), F.get(cells, F.lit(1))
        two = F.size(cells) == 2
        label_first = two & left.endswith(":") & (right != "")
        label_last = two & right.endswith(":") & (left != "")
        return (
            F.when(F.forall(cells, lambda c: c.rlike("^-*$")), F.lit(""))
            .when(label_first, F.concat_ws(" ", left, right)).when(label_last, F.concat_ws(" ", right, left))
            .otherwise(F.array_join(F.filter(cells, lambda c: c != ""), " "))
        )

    cleaned = F.transform(lines, lambda x: F.when(x.startswith("|") & x.endswith("|"), row(x)).when(x.startswith("#"), strip(F.regexp_replace(x, "^#+", ""))).otherwise(x))
    return F.array_join(F.filter(cleaned, lambda x: x != ""), "\n")


# ---- facts per document -------------------------------------------------------------------------------------------
def statement_facts(texts: DataFrame) -> DataFrame:
    """Facts and notes from income statement and balance sheet texts (company_id, document_type, text)."""
    rows = texts.where(F.col("document_type").isin("income_statement", "balance_sheet"))
    income = F.col("document_type") == "income_statement"
    raw, columns, notes = [], [], []
    for labels, here, title in ((INCOME_LABELS, income, "income statement"), (BALANCE_LABELS, ~income, "balance sheet")):
        for field, label in labels.items():
            # Matching is a step of its own: parsing refers to a match several times and must not repeat it.
            raw.append(F.when(here, F.regexp_extract("text", "(?im)" + label + AMOUNT, 1)).alias(f"_{field}"))
            value = parse_money(F.col(f"_{field}"))
            value = F.abs(value) if field in ABSOLUTE_FIELDS else value
            columns.append(value.alias(field))
            notes.append(F.when(here & F.col(field).isNull(), F.lit(f"Missing {field} in {title} PDF")))
    matched = rows.select("company_id", "document_type", F.length("text").alias("text_length"), *raw)
    facts = with_ratios(matched.select("company_id", "document_type", "text_length", *columns))
    unbalanced = F.when(~income & ~F.col("balance_sheet_balances"), F.concat(F.lit("Balance sheet discrepancy detected: "), F.col("balance_discrepancy_usd").cast("string")))
    return facts.withColumn("notes", F.array_compact(F.array(*notes, unbalanced)))


def proposal_fields(texts: DataFrame) -> DataFrame:
    """Named fields and notes of application proposals."""
    rows = texts.where("document_type = 'application_proposal'")
    parsers = {"requested_amount_usd": parse_money, "founded_year": parse_count, "employee_count": parse_count}
    raw = rows.select("company_id", "document_type", F.length("text").alias("text_length"), *[first_match(F.col("text"), p).alias(n) for n, p in PROPOSAL_PATTERNS.items()])
    notes = [F.when(F.col(n).isNull(), F.lit(f"Missing {n} in application proposal PDF")) for n in PROPOSAL_PATTERNS]
    noted = raw.withColumn("notes", F.array_compact(F.array(*notes)))
    return noted.select(*[parsers[c](F.col(c)).alias(c) if c in parsers else F.col(c) for c in noted.columns])


def workbook_facts(rows: DataFrame) -> DataFrame:
    """Facts from workbook rows (company_id, sheet, label, value); a later ``row`` of a label replaces an earlier one."""
    known = F.create_map(*[F.lit(x) for sheet, labels in WORKBOOK_LABELS.items() for label, field in labels.items() for x in (f"{sheet}/{label}", field)])
    field = known[F.concat_ws("/", "sheet", F.regexp_replace("label", WHITESPACE, ""))]
    return _pivoted(rows.withColumn("field", field).where("field is not null"), "financial_workbook", "Workbook did not expose FY2024 revenue")


def summary_facts(rows: DataFrame) -> DataFrame:
    """Facts from summary rows (company_id, field, value); unknown fields are dropped."""
    names = F.create_map(*[F.lit(x) for pair in SUMMARY_NAMES.items() for x in pair])
    named = rows.withColumn("field", F.coalesce(names[F.col("field")], F.col("field")))
    return _pivoted(named, "financial_summary", "CSV summary missing total_revenue")


def _pivoted(rows: DataFrame, document_type: str, missing_note: str) -> DataFrame:
    order = F.col("row") if "row" in rows.columns else F.lit(0)

    def pick(name: str, value: Column) -> Column:
        return F.max_by(value, F.when(F.col("field") == name, order))

    read = rows.select("*", parse_money(F.col("value")).alias("_money"), F.col("value").try_cast("double").alias("_ratio"), parse_flag(F.col("value")).alias("_flag"))
    wide = read.groupBy("company_id").agg(
        *[pick(f, F.col("_money")).alias(f) for f in MONEY_FIELDS],
        *[pick(f, F.col("_ratio")).alias(f) for f in RATIO_FIELDS],
        pick("balance_sheet_check", F.col("_flag")).alias("balance_sheet_balances"),
    )
    wide = wide.withColumn("document_type", F.lit(document_type)).withColumn("text_length", F.lit(0))
    facts = with_ratios(wide)
    return facts.withColumn("notes", F.array_compact(F.array(F.when(F.col("total_revenue").isNull(), F.lit(missing_note)))))


def with_ratios(facts: DataFrame) -> DataFrame:
    """Fill ratios that are absent where both parts are usable, and the balance test where all three totals are known."""
    def part(name: str) -> Column:
        return F.col(name) if name in facts.columns else F.lit(None).cast("decimal(18,2)")

    def nonzero(name: str) -> Column:
        return F.nullif(part(name), F.lit(0))

    def ratio(top: Column, bottom: Column) -> Column:
        return top.cast("double") / bottom.cast("double")

    derived = {
        "gross_margin": ratio(nonzero("gross_profit"), nonzero("total_revenue")),
        "ebitda_margin": ratio(nonzero("ebitda"), nonzero("total_revenue")),
        "net_margin": ratio(nonzero("net_income"), nonzero("total_revenue")),
        "debt_to_equity": ratio(part("total_liabilities"), nonzero("total_equity")),
        "current_ratio": ratio(part("current_assets"), nonzero("current_liabilities")),
        "debt_to_ebitda": ratio(part("long_term_debt"), nonzero("ebitda")),
        "interest_coverage": ratio(part("operating_income"), nonzero("interest_expense")),
    }
    gap = part("total_assets") - (part("total_liabilities") + part("total_equity"))
    stated = facts["balance_sheet_balances"] if "balance_sheet_balances" in facts.columns else F.lit(None).cast("boolean")
    stated_gap = facts["balance_discrepancy_usd"] if "balance_discrepancy_usd" in facts.columns else F.lit(None).cast("decimal(18,2)")
    kept = [c for c in facts.columns if c not in (*derived, "balance_sheet_balances", "balance_discrepancy_usd")]
    return facts.select(
        *kept,
        *[F.coalesce(F.col(n), v).alias(n) if n in facts.columns else v.alias(n) for n, v in derived.items()],
        F.coalesce(gap, stated_gap).cast("decimal(18,2)").alias("balance_discrepancy_usd"),
        F.coalesce(F.abs(gap) <= BALANCE_TOLERANCE, stated).alias("balance_sheet_balances"),
    )


def document_facts(*parts: DataFrame) -> DataFrame:
    """Facts of all documents in one wide table, one row per company and document type."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# ---- merge and checks ---------------------------------------------------------------------------------------------
FACT_FIELDS = (*MONEY_FIELDS, *RATIO_FIELDS, "balance_discrepancy_usd", "balance_sheet_balances")


def _priority() -> Column:
    order = F.lit(len(SOURCE_ORDER))
    for i, name in enumerate(SOURCE_ORDER):
        order = F.when(F.col("document_type") == name, F.lit(i)).otherwise(order)
    return order


def merge_facts(facts: DataFrame) -> DataFrame:
    """One row per company: each field from the first source that has it, ``<field>_source`` naming it."""
    present = [f for f in FACT_FIELDS if f in facts.columns]
    ranked = facts.withColumn("_p", _priority())
    merged = ranked.groupBy("company_id").agg(
        *[F.min_by(f, F.when(F.col(f).isNotNull(), F.col("_p"))).alias(f) for f in present],
        F.map_filter(F.map_from_arrays(F.array(*[F.lit(f) for f in present]), F.array(*[F.min_by("document_type", F.when(F.col(f).isNotNull(), F.col("_p"))) for f in present])), lambda k, v: v.isNotNull()).alias("field_sources"),
    )
    return with_ratios(merged)


def material_difference(left: Column, right: Column) -> Column:
    """Strictly beyond tolerance; two small numbers (ratios) get the small one. Null when a side is absent."""
    small = (F.abs(left) < SMALL_LIMIT) & (F.abs(right) < SMALL_LIMIT)
    return F.abs(left - right) > F.when(small, F.lit(SMALL_TOLERANCE).cast("decimal(18,2)")).otherwise(F.lit(LARGE_TOLERANCE).cast("decimal(18,2)"))


def consistency_notes(facts: DataFrame, merged: DataFrame) -> DataFrame:
    """Notes per company about fields that differ between two sources, the balance and a missing EBITDA.

    The four sources of a company become columns by aggregation, so pairs are compared inside one row.
    """
    wide = facts.groupBy("company_id").agg(
        *[F.max(F.when(F.col("document_type") == s, F.col(f))).alias(f"{f}__{s}") for f in COMPARED_FIELDS for s in SOURCE_ORDER]
    )
    notes = []
    for field in COMPARED_FIELDS:
        for i, left in enumerate(SOURCE_ORDER):
            for right in SOURCE_ORDER[i + 1:]:
                differs = material_difference(F.col(f"{field}__{left}"), F.col(f"{field}__{right}"))
                notes.append(F.when(differs, F.lit(f"{field} differs materially between {left} and {right}")))
    joined = merged.join(wide, "company_id", "left")
    notes.append(F.when(~F.col("balance_sheet_balances"), F.concat(F.lit("Balance sheet does not fully balance; discrepancy="), F.col("balance_discrepancy_usd").cast("string"))))
    notes.append(F.when(F.col("ebitda").isNull(), F.lit("EBITDA is missing from the merged facts set")))
    return joined.select("company_id", F.array_compact(F.array(*notes)).alias("consistency_notes"))


def quality_assessments(documents: DataFrame, notes: DataFrame) -> DataFrame:
    """Quality per document (company_id, document_type, notes) given the package notes."""
    rows = documents.select("company_id", "document_type", F.coalesce("notes", F.array().cast("array<string>")).alias("notes")).join(notes, "company_id", "left")
    package_notes = F.coalesce("consistency_notes", F.array().cast("array<string>"))
    missing = F.transform(F.filter("notes", lambda n: F.lower(n).startswith("missing ")), lambda n: F.trim(F.split_part(F.regexp_replace(F.lower(n), "^missing ", ""), F.lit(" in "), F.lit(1))))
    expected = F.transform(missing, lambda f: F.concat(F.lit("Missing "), f, F.lit(" in income statement PDF")))
    own = F.filter("notes", lambda n: ~F.array_contains(expected, n))
    word = F.split_part("document_type", F.lit("_"), F.lit(1))
    anomalies = F.concat(own, F.filter(package_notes, lambda n: F.contains(F.lower(n), word)))
    statement = F.col("document_type").isin("income_statement", "balance_sheet")
    some_missing, some_anomaly = F.size("critical_missing_fields") > 0, F.size("anomalies") > 0
    return rows.select("company_id", "document_type", missing.alias("critical_missing_fields"), anomalies.alias("anomalies")).select(
        "*",
        F.when(some_missing & statement, F.lit(0.55)).when(some_anomaly, F.lit(0.7)).otherwise(F.lit(0.95)).alias("overall_confidence"),
        (~some_anomaly).alias("is_coherent"), (some_missing | some_anomaly).alias("reextraction_recommended"),
    )


def package_events(documents: DataFrame, quality: DataFrame, notes: DataFrame, applications: DataFrame, at: Column) -> DataFrame:
    """Events of each application's document package: created, five per document, ready; positions from 1.

    ``documents``: company_id, document_type, document_format, file_hash, page_count, parser, text_length and fact
    columns; ``applications``: application_id, company_id.
    """
    docs = documents.join(quality, ["company_id", "document_type"]).join(applications, "company_id")
    rank = F.lit(len(FORMATS))
    for i, name in enumerate(FORMATS):
        rank = F.when(F.col("document_type") == name, F.lit(i)).otherwise(rank)
    package, doc_id = F.concat(F.lit("docpkg-"), F.col("application_id")), F.concat_ws(":", "company_id", "document_type")
    facts = F.struct(*[F.col(f) for f in FACT_FIELDS if f in documents.columns])
    base = [package.alias("package_id"), doc_id.alias("document_id")]
    kind = F.col("document_type")

    def event(i: int, name: str, *fields: Column, meta: Column | None = None) -> Column:
        return F.struct(F.lit(i).alias("i"), F.lit(name).alias("event_type"), F.to_json(F.struct(*fields)).alias("payload"), (meta if meta is not None else F.lit("{}")).alias("metadata"))

    parser_meta = F.to_json(F.struct(F.col("parser").alias("parser_used")))
    per_document = F.array(
        event(1, "DocumentAdded", *base, kind, F.col("document_format"), F.col("file_hash"), at.alias("added_at"), meta=parser_meta),
        event(2, "DocumentFormatValidated", *base, kind, F.col("page_count"), F.col("document_format").alias("detected_format"), at.alias("validated_at"), meta=parser_meta),
        event(3, "ExtractionStarted", *base, kind, F.lit(PIPELINE_VERSION).alias("pipeline_version"), F.col("parser").alias("extraction_model"), at.alias("started_at")),
        event(
            4, "ExtractionCompleted", *base, kind, facts.alias("facts"), F.col("text_length").alias("raw_text_length"),
            F.when(F.col("document_format").isin("xlsx", "csv"), 1).otherwise(0).alias("tables_extracted"), F.lit(0).alias("processing_ms"), at.alias("completed_at"),
            meta=F.to_json(F.struct(F.col("parser").alias("parser_used"), F.col("notes").alias("extraction_notes"))),
        ),
        event(
            5, "QualityAssessmentCompleted", *base, F.col("overall_confidence"), F.col("is_coherent"), F.col("anomalies"), F.col("critical_missing_fields"),
            F.col("reextraction_recommended"), F.concat(F.lit("Parsed with "), F.col("parser"), F.lit(AUDITOR_TEXT)).alias("auditor_notes"), at.alias("assessed_at"),
        ),
    )
    spread = docs.select("application_id", rank.alias("d"), F.inline(per_document))
    totals = docs.join(notes, "company_id", "left").groupBy("application_id").agg(
        F.count("*").alias("n"), F.sum(F.size("critical_missing_fields") + F.size("anomalies")).alias("flags"), F.sort_array(F.collect_set("document_type")).alias("types"),
        F.first("consistency_notes").alias("consistency_notes"),
    )
    ends = totals.select("application_id", F.inline(F.array(
        F.struct(F.lit(-1).alias("d"), event(0, "PackageCreated", package.alias("package_id"), F.col("application_id"), F.col("types").alias("required_documents"), at.alias("created_at")).alias("e")),
        F.struct(F.lit(99).alias("d"), event(
            9, "PackageReadyForAnalysis", package.alias("package_id"), F.col("application_id"), F.col("n").alias("documents_processed"), (F.col("flags") > 0).alias("has_quality_flags"),
            F.col("flags").alias("quality_flag_count"), at.alias("ready_at"), meta=F.to_json(F.struct("consistency_notes")),
        ).alias("e")),
    ))).select("application_id", "d", "e.*")
    ordered = spread.unionByName(ends).withColumn("_o", (F.col("d") * 16 + F.col("i")).cast("bigint"))
    return number_rows(ordered, ["application_id"], "_o", "stream_position").select(
        "application_id", F.concat(F.lit("docpkg-"), F.col("application_id")).alias("stream_id"), "stream_position", "event_type", "payload", "metadata"
    )


def content_hashes(files: DataFrame, content: str = "content") -> DataFrame:
    """SHA-256 of whole contents (text or binary)."""
    return files.withColumn("content_hash", F.sha2(F.col(content), 256))
