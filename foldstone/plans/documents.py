"""Registry, document-fact and policy queries over the order tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from foldstone.operators import documents as D, policy
from foldstone.plans.registry import as_double, joined, query, rounded
from foldstone.session import shared_folder, stage
from foldstone.sources import adapters, files, registry, stored

COMPANIES = """
co AS (SELECT c_custkey AS k, 'COMP-' || c_custkey AS company_id, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN 'Retail' ELSE lower(c_mktsegment) END AS industry,
  CASE WHEN c_nationkey = 3 THEN 'MT' ELSE 'N' || c_nationkey END AS jurisdiction, CASE WHEN c_custkey % 9 <> 0 THEN 'LLC' END AS legal_type, 1990 + c_custkey % 36 AS founded_year,
  CASE WHEN c_acctbal < 0 THEN 'HIGH' WHEN c_acctbal < 3000 THEN 'MEDIUM' ELSE 'LOW' END AS risk_segment,
  (['GROWTH','STABLE','GROWTH','RECOVERING','DECLINING'])[c_custkey % 5 + 1] AS trajectory FROM customer)
"""
FIGURES = """
fg AS (SELECT o_custkey AS k, CAST(floor(sum(CAST(o_totalprice AS DECIMAL(18,2)))) AS BIGINT) AS r FROM orders GROUP BY 1),
fx AS (SELECT k, 'COMP-' || k AS company_id, r, r * 4 // 10 AS gp, r * 2 // 10 AS opx, r * 15 // 100 AS oi, r * 3 // 10 AS eb, r * 5 // 100 AS da, CASE WHEN k % 11 <> 0 THEN r * 2 // 100 ELSE 0 END AS ie,
  r * 13 // 100 AS ibt, r * 3 // 100 AS te, r * 10 // 100 AS ni, r // 10 AS cash, r * 2 // 10 AS ar, r // 20 AS inv, r * 6 // 10 AS ca, r * 2 AS ta, r * 5 // 10 AS cl,
  CASE WHEN k % 6 = 0 THEN r * 3 ELSE r END AS ltd, r * 12 // 10 AS tl, r * 2 - r * 12 // 10 - CASE WHEN k % 5 = 0 THEN 600 ELSE 100 END AS eq FROM fg)
"""


def _facts(spark, folder):
    """Statement texts and the facts of all documents, loaded once per session."""
    texts = stored.derived("statement-texts", adapters.statement_texts, spark, folder)

    def build(s, f):
        return D.document_facts(D.statement_facts(texts), D.workbook_facts(adapters.workbook_rows(s, f)), D.summary_facts(adapters.summary_rows(s, f)))

    return texts, stored.derived("document-facts", build, spark, folder)


@query("registry_first_by_jurisdiction", f"WITH {COMPANIES} SELECT jurisdiction, arg_min(company_id, company_id) AS company_id, arg_min(name, company_id) AS name FROM co GROUP BY 1")
def registry_first_by_jurisdiction(spark, folder):
    return registry.first_by_jurisdiction(adapters.companies(spark, folder)).select("jurisdiction", "company_id", "name")


@query(
    "registry_financial_history",
    """SELECT 'COMP-' || o_custkey AS company_id, year(o_orderdate) AS fiscal_year, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue
    FROM orders WHERE year(o_orderdate) IN (1998, 1999) GROUP BY 1, 2""",
)
def registry_financial_history(spark, folder):
    return registry.financial_history(adapters.company_history(spark, folder), years=(1998, 1999)).select("company_id", "fiscal_year", as_double("total_revenue"))


@query("registry_active_flags", """SELECT o_orderkey AS id, 'COMP-' || o_custkey AS company_id, strftime(o_orderdate, '%Y-%m-%d') AS added_date FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'""")
def registry_active_flags(spark, folder):
    return registry.compliance_flags(adapters.company_flags(spark, folder), active_only=True).select("id", "company_id", F.col("added_date").cast("string").alias("added_date"))


@query(
    "registry_loan_relationships",
    """SELECT o_orderkey AS id, 'COMP-' || o_custkey AS company_id, o_totalprice AS loan_amount, year(o_orderdate) AS loan_year, o_orderstatus = 'F' AS was_repaid,
      o_orderstatus = 'P' AND o_totalprice > 450000 AS default_occurred FROM orders""",
)
def registry_loan_relationships(spark, folder):
    return registry.loan_relationships(adapters.company_loans(spark, folder)).select("id", "company_id", as_double("loan_amount"), "loan_year", "was_repaid", "default_occurred")


PROFILES = f"""{COMPANIES},
fl AS (SELECT o_custkey AS k, count(*) FILTER (WHERE o_orderstatus = 'P') AS active_flags, count(*) AS flags FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
ln AS (SELECT o_custkey AS k, bool_or(o_orderstatus = 'P' AND o_totalprice > 450000) AS has_default, count(*) AS prior_loans, count(DISTINCT year(o_orderdate)) AS fiscal_years, max(year(o_orderdate)) AS latest_year FROM orders GROUP BY 1),
pf AS (SELECT co.*, coalesce(active_flags, 0) AS active_flags, coalesce(flags, 0) AS flags, coalesce(has_default, false) AS has_default, coalesce(prior_loans, 0) AS prior_loans,
  coalesce(fiscal_years, 0) AS fiscal_years, latest_year FROM co LEFT JOIN fl USING (k) LEFT JOIN ln USING (k))
"""


def _profiles(spark, folder):
    return registry.company_profiles(
        adapters.companies(spark, folder), adapters.company_flags(spark, folder), adapters.company_history(spark, folder), adapters.company_loans(spark, folder)
    )


@query("company_profiles", f"""WITH {PROFILES} SELECT company_id, name, industry, jurisdiction, risk_segment, trajectory, active_flags, flags, has_default, prior_loans, fiscal_years, latest_year, 'registry' AS source FROM pf""")
def company_profiles(spark, folder):
    return _profiles(spark, folder).select("company_id", "name", "industry", "jurisdiction", "risk_segment", "trajectory", "active_flags", "flags", "has_default", "prior_loans", "fiscal_years", "latest_year", "source")


NORMAL = r"""WITH l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\r\n|\n|\r'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls FROM documents),
c AS (SELECT doc_id, list_transform(ls, lambda x: CASE WHEN x LIKE '|%' AND x LIKE '%|' THEN
    CASE WHEN regexp_full_match(replace(regexp_replace(x, '\s', '', 'g'), '|', ''), '-*') THEN ''
    ELSE array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(x, '^\|+|\|+$', '', 'g'), '\|'), lambda y: regexp_replace(y, '^\s+|\s+$', '', 'g')), lambda y: y <> ''), ' ') END
  WHEN x LIKE '#%' THEN regexp_replace(regexp_replace(x, '^#+', ''), '^\s+|\s+$', '', 'g') ELSE x END) AS cs FROM l)
SELECT doc_id, md5(array_to_string(list_filter(cs, lambda x: x <> ''), chr(10))) AS text_md5 FROM c"""


@query("plain_lines", NORMAL)
def plain_lines(spark, folder):
    return adapters.table(spark, folder, "documents").select("doc_id", F.md5(D.plain_lines(F.col("text"))).alias("text_md5"))


@query("content_hashes", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hashes(spark, folder):
    return D.content_hashes(adapters.table(spark, folder, "documents"), "text").select("doc_id", "content_hash")


@query(
    "document_catalog",
    f"""WITH {COMPANIES}, fs AS (SELECT 'COMP-' || (doc_id % 200) AS company_id, (['application_proposal.pdf','income_statement_2024.pdf','balance_sheet_2024.pdf','financial_statements.xlsx','financial_summary.csv','notes.txt'])[(doc_id // 200) % 6 + 1] AS name, n_chars FROM documents),
    ds AS (SELECT DISTINCT company_id, name, n_chars FROM fs)
    SELECT company_id, co.name AS name, count(DISTINCT ds.name) AS document_count, string_agg(DISTINCT regexp_extract(ds.name, '\\.([^.]+)$', 1), '|' ORDER BY regexp_extract(ds.name, '\\.([^.]+)$', 1)) AS kinds,
      CAST(sum(n_chars) AS BIGINT) AS total_bytes, count(DISTINCT CASE WHEN ds.name <> 'notes.txt' THEN ds.name END) = 5 AS has_complete_package
    FROM ds JOIN co USING (company_id) GROUP BY 1, 2""",
)
def document_catalog(spark, folder):
    names = F.array(*[F.lit(n) for n in (*D.REQUIRED_FILES, "notes.txt")])
    path = F.concat(F.lit("/docs/COMP-"), (F.col("doc_id") % 200).cast("string"), F.lit("/"), F.element_at(names, (F.floor(F.col("doc_id") / 200) % 6 + 1).cast("int")))
    listing = adapters.table(spark, folder, "documents").select(path.alias("path"), F.col("n_chars").alias("length"))
    c = files.document_catalog(listing, adapters.companies(spark, folder).select("company_id", "name"))
    return c.select("company_id", "name", "document_count", joined("kinds"), "total_bytes", "has_complete_package")


@query(
    "statement_facts",
    f"""WITH {FIGURES}
    SELECT company_id, 'income_statement' AS document_type, CAST(r AS DOUBLE) AS total_revenue, CAST(opx AS DOUBLE) AS operating_expenses, CASE WHEN k % 7 <> 0 THEN CAST(eb AS DOUBLE) END AS ebitda,
      CAST(NULL AS DOUBLE) AS total_assets, CAST(NULL AS DOUBLE) AS cash_and_equivalents, CASE WHEN gp <> 0 AND r <> 0 THEN round(gp / r, 6) END AS gross_margin, CASE WHEN ie <> 0 THEN round(oi / ie, 6) END AS interest_coverage,
      CAST(NULL AS DOUBLE) AS current_ratio, CAST(NULL AS BOOLEAN) AS balance_sheet_balances, CASE WHEN k % 7 = 0 THEN 'Missing ebitda in income statement PDF' ELSE '' END AS notes FROM fx
    UNION ALL
    SELECT company_id, 'balance_sheet', NULL, NULL, NULL, ta, cash, NULL, NULL, round(ca / cl, 6), k % 5 <> 0, CASE WHEN k % 5 = 0 THEN 'Balance sheet discrepancy detected: 600.00' ELSE '' END FROM fx""",
)
def statement_facts(spark, folder):
    f = D.statement_facts(adapters.statement_texts(spark, folder))
    return f.select("company_id", "document_type", as_double("total_revenue"), as_double("operating_expenses"), as_double("ebitda"), as_double("total_assets"), as_double("cash_and_equivalents"),
                    rounded("gross_margin"), rounded("interest_coverage"), rounded("current_ratio"), "balance_sheet_balances", joined("notes"))


@query(
    "proposal_fields",
    f"""WITH {FIGURES} SELECT company_id, 'Customer ' || k AS legal_entity_name, 1990 + k % 36 AS founded_year, k * 7 + 1000 AS employee_count, CASE WHEN k % 8 <> 0 THEN CAST(r * 5 // 10 AS DOUBLE) END AS requested_amount_usd,
      (['Working Capital','Expansion','Real Estate','Something else'])[k % 4 + 1] AS purpose, CASE WHEN k % 8 = 0 THEN 7 ELSE 6 END AS missing FROM fx""",
)
def proposal_fields(spark, folder):
    p = D.proposal_fields(adapters.statement_texts(spark, folder))
    return p.select("company_id", "legal_entity_name", "founded_year", "employee_count", as_double("requested_amount_usd"), "purpose", F.size("notes").alias("missing"))


@query(
    "document_fact_parts",
    f"""WITH {FIGURES} SELECT company_id, 'financial_workbook' AS document_type, CAST(r + CASE WHEN k % 4 = 0 THEN 6000 ELSE 0 END AS DOUBLE) AS total_revenue, CAST(ni AS DOUBLE) AS net_income, CAST(eb AS DOUBLE) AS ebitda,
      CASE WHEN ie <> 0 THEN round(oi / ie, 6) END AS interest_coverage, k % 5 <> 0 AS balance_sheet_balances FROM fx
    UNION ALL SELECT company_id, 'financial_summary', r, ni + CASE WHEN k % 3 = 0 THEN 7000 ELSE 0 END, NULL, 7.5, k % 5 <> 0 FROM fx""",
)
def document_fact_parts(spark, folder):
    parts = D.document_facts(D.workbook_facts(adapters.workbook_rows(spark, folder)), D.summary_facts(adapters.summary_rows(spark, folder)))
    return parts.select("company_id", "document_type", as_double("total_revenue"), as_double("net_income"), as_double("ebitda"), rounded("interest_coverage"), "balance_sheet_balances")


@query(
    "summary_files",
    """WITH r AS (SELECT n_name, CAST(floor(sum(CAST(o_totalprice AS DECIMAL(18,2)))) AS BIGINT) AS r FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1)
    SELECT n_name AS company_id, CAST(r AS DOUBLE) AS total_revenue, CAST(r // 10 AS DOUBLE) AS net_income, round((r // 10) / r, 6) AS net_margin, CAST(7.5 AS DOUBLE) AS interest_coverage, true AS balance_sheet_balances FROM r""",
)
def summary_files(spark, folder):
    """One summary file per nation, written as CSV folders and read back with the company taken from the path."""
    path = f"{shared_folder(spark)}/summaries-{uuid.uuid4().hex}"
    orders = adapters.table(spark, folder, "orders").join(adapters.table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    nations = orders.join(adapters.table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    totals = nations.groupBy(F.col("n_name").alias("company_id")).agg(F.floor(F.sum(F.col("o_totalprice").cast("decimal(18,2)"))).cast("bigint").alias("r"))
    lines = {"total_revenue": F.col("r").cast("string"), "net_income": F.floor(F.col("r") / 10).cast("string"), "interest_coverage_ratio": F.lit("7.5"), "balance_sheet_check": F.lit("True"), "other": F.lit("x")}
    rows = totals.select("company_id", F.inline(F.array(*[F.struct(F.lit(n).alias("field"), v.alias("value"), F.lit("2024").alias("fiscal_year"), F.lit("USD").alias("currency")) for n, v in lines.items()])))
    rows.write.partitionBy("company_id").option("header", "true").csv(path)
    f = D.summary_facts(files.read_summary_files(spark, path))
    return f.select("company_id", as_double("total_revenue"), as_double("net_income"), rounded("net_margin"), rounded("interest_coverage"), "balance_sheet_balances")


@query(
    "merged_facts",
    f"""WITH {FIGURES} SELECT company_id, CAST(r AS DOUBLE) AS total_revenue, CAST(eb AS DOUBLE) AS ebitda, CASE WHEN k % 7 = 0 THEN 'financial_workbook' ELSE 'income_statement' END AS ebitda_source, CAST(ni AS DOUBLE) AS net_income,
      CAST(ta AS DOUBLE) AS total_assets, 'balance_sheet' AS assets_source, round(ltd / eb, 6) AS debt_to_ebitda, CASE WHEN k % 11 = 0 THEN 7.5 ELSE round(oi / ie, 6) END AS interest_coverage,
      CAST(CASE WHEN k % 5 = 0 THEN 600 ELSE 100 END AS DOUBLE) AS balance_discrepancy_usd, k % 5 <> 0 AS balance_sheet_balances FROM fx""",
)
def merged_facts(spark, folder):
    _, facts = _facts(spark, folder)
    m = D.merge_facts(facts)
    return m.select("company_id", as_double("total_revenue"), as_double("ebitda"), F.col("field_sources")["ebitda"].alias("ebitda_source"), as_double("net_income"), as_double("total_assets"),
                    F.col("field_sources")["total_assets"].alias("assets_source"), rounded("debt_to_ebitda"), rounded("interest_coverage"), as_double("balance_discrepancy_usd"), "balance_sheet_balances")


NOTES = f"""{FIGURES},
nt AS (SELECT k, company_id, concat_ws('|',
    CASE WHEN k % 4 = 0 THEN 'total_revenue differs materially between income_statement and financial_workbook' END,
    CASE WHEN k % 4 = 0 THEN 'total_revenue differs materially between financial_workbook and financial_summary' END,
    CASE WHEN k % 3 = 0 THEN 'net_income differs materially between income_statement and financial_summary' END,
    CASE WHEN k % 3 = 0 THEN 'net_income differs materially between financial_workbook and financial_summary' END,
    CASE WHEN k % 5 = 0 THEN 'Balance sheet does not fully balance; discrepancy=600.00' END) AS consistency_notes,
  CASE WHEN k % 4 = 0 THEN 2 ELSE 0 END AS n_rev, CASE WHEN k % 3 = 0 THEN 2 ELSE 0 END AS n_inc, CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS n_bal, CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS n_miss FROM fx)
"""


@query("consistency_notes", f"WITH {NOTES} SELECT company_id, consistency_notes FROM nt")
def consistency_notes(spark, folder):
    _, facts = _facts(spark, folder)
    n = D.consistency_notes(facts, stage(D.merge_facts(facts)))
    return n.select("company_id", joined("consistency_notes"))


def _quality(spark, folder):
    texts, facts = _facts(spark, folder)
    merged = stored.derived("merged-facts", lambda s, f: D.merge_facts(facts), spark, folder)
    notes = stored.derived("consistency-notes", lambda s, f: D.consistency_notes(facts, merged), spark, folder)
    parts = facts.select("company_id", "document_type", "notes").unionByName(D.proposal_fields(texts).select("company_id", "document_type", "notes"))
    return texts, facts, merged, notes, D.quality_assessments(parts, notes)


# Package notes reach a document when they contain the first word of its type.
QUALITY = f"""{NOTES},
dt(document_type) AS (VALUES ('income_statement'), ('balance_sheet'), ('financial_workbook'), ('financial_summary'), ('application_proposal')),
ql AS (SELECT company_id, k, document_type,
    CASE document_type WHEN 'income_statement' THEN n_miss WHEN 'application_proposal' THEN CASE WHEN k % 8 = 0 THEN 7 ELSE 6 END ELSE 0 END AS missing,
    CASE document_type WHEN 'income_statement' THEN CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END + n_inc WHEN 'balance_sheet' THEN 2 * n_bal
      WHEN 'financial_workbook' THEN n_rev + n_inc WHEN 'financial_summary' THEN n_rev + n_inc
      ELSE CASE WHEN k % 8 = 0 THEN 7 ELSE 6 END END AS anomalies
  FROM nt, dt)
"""


@query(
    "quality_assessments",
    f"""WITH {QUALITY} SELECT company_id, document_type, missing, anomalies,
      CASE WHEN missing > 0 AND document_type IN ('income_statement','balance_sheet') THEN 0.55 WHEN anomalies > 0 THEN 0.7 ELSE 0.95 END :: DOUBLE AS overall_confidence,
      anomalies = 0 AS is_coherent, missing > 0 OR anomalies > 0 AS reextraction_recommended FROM ql""",
)
def quality_assessments(spark, folder):
    q = _quality(spark, folder)[-1]
    return q.select("company_id", "document_type", F.size("critical_missing_fields").alias("missing"), F.size("anomalies").alias("anomalies"), "overall_confidence", "is_coherent", "reextraction_recommended")


@query(
    "package_events",
    f"""WITH {QUALITY}, e(i, event_type) AS (VALUES (1, 'DocumentAdded'), (2, 'DocumentFormatValidated'), (3, 'ExtractionStarted'), (4, 'ExtractionCompleted'), (5, 'QualityAssessmentCompleted')),
    o(document_type, d) AS (VALUES ('application_proposal', 0), ('income_statement', 1), ('balance_sheet', 2), ('financial_workbook', 3), ('financial_summary', 4)),
    fl AS (SELECT company_id, CAST(sum(missing + anomalies) AS BIGINT) AS flags FROM ql GROUP BY 1)
    SELECT 'docpkg-A' || company_id AS stream_id, 2 + d * 5 + i - 1 AS stream_position, event_type, document_type, CAST(NULL AS BIGINT) AS flags FROM ql JOIN o USING (document_type), e
    UNION ALL SELECT 'docpkg-A' || company_id, 1, 'PackageCreated', NULL, NULL FROM fl
    UNION ALL SELECT 'docpkg-A' || company_id, 27, 'PackageReadyForAnalysis', NULL, flags FROM fl""",
)
def package_events(spark, folder):
    texts, facts, _, notes, quality = _quality(spark, folder)
    documents = facts.unionByName(D.proposal_fields(texts).select("company_id", "document_type", "text_length", "notes"), allowMissingColumns=True)
    formats = F.create_map(*[F.lit(x) for pair in D.FORMATS.items() for x in pair])
    documents = documents.withColumn("document_format", formats[F.col("document_type")]).withColumn("file_hash", F.sha2(F.concat_ws("/", "company_id", "document_type"), 256))
    documents = documents.withColumn("page_count", F.lit(1)).withColumn("parser", F.lit("text"))
    apps = adapters.company_figures(spark, folder).select(F.concat(F.lit("A"), "company_id").alias("application_id"), "company_id")
    e = D.package_events(documents, quality, notes, apps, F.lit("2024-06-01").cast("timestamp"))
    kind = F.regexp_extract(F.get_json_object("payload", "$.document_id"), ":(.*)$", 1)
    kind = F.coalesce(F.get_json_object("payload", "$.document_type"), F.nullif(kind, F.lit("")))
    return e.select("stream_id", "stream_position", "event_type", kind.alias("document_type"), F.get_json_object("payload", "$.quality_flag_count").cast("bigint").alias("flags"))


# ---- policy -------------------------------------------------------------------------------------------------------
def _cases(spark, folder):
    texts, facts, merged, notes, _ = _quality(spark, folder)
    income_notes = facts.where("document_type = 'income_statement'").select("company_id", F.col("notes").alias("income_notes"))
    proposals = D.proposal_fields(texts).select("company_id", F.col("requested_amount_usd").alias("stated_amount"), F.col("purpose").alias("stated_purpose"))
    base = merged.join(notes, "company_id").join(income_notes, "company_id", "left").join(proposals, "company_id", "left").join(_profiles(spark, folder), "company_id")
    cases = base.select(
        "*", policy.quality_caveats(F.col("income_notes"), F.col("field_sources")["ebitda"], F.col("consistency_notes")).alias("caveats"),
        policy.requested_amount(F.col("stated_amount"), F.col("company_id")).alias("requested_amount_usd"), policy.loan_purpose(F.col("stated_purpose")).alias("loan_purpose"),
    )
    return stored.derived("credit-cases", lambda s, f: cases, spark, folder)


CASES = f"""{NOTES}, {PROFILES},
ca AS (SELECT nt.company_id, nt.k, fx.*  EXCLUDE (k, company_id), pf.* EXCLUDE (k, company_id), n_rev + n_inc + n_bal + n_miss AS ncav, n_rev, n_bal,
    CASE WHEN nt.k % 8 <> 0 THEN r * 5 // 10 ELSE 400000 + 12500 * nt.k END AS req,
    CASE WHEN n_rev + n_inc + n_bal + n_miss >= 3 THEN 0.64 WHEN n_rev + n_inc + n_bal + n_miss > 0 THEN 0.72 ELSE 0.86 END AS base
  FROM nt JOIN fx ON fx.k = nt.k JOIN pf ON pf.k = nt.k),
cr AS (SELECT *, CASE WHEN has_default OR risk_segment = 'HIGH' OR trajectory = 'DECLINING' OR ltd / eb > 6.5 THEN 'HIGH' WHEN trajectory = 'GROWTH' AND ca / cl >= 1.35 THEN 'LOW' ELSE 'MEDIUM' END AS tier FROM ca),
cd AS (SELECT *, least(round_even(req * CASE tier WHEN 'HIGH' THEN CAST(0.72 AS DECIMAL(3,2)) WHEN 'LOW' THEN CAST(1.00 AS DECIMAL(3,2)) ELSE CAST(0.90 AS DECIMAL(3,2)) END, 0), round_even(eb * 3.5, 0)) AS lim,
    round(CASE tier WHEN 'HIGH' THEN greatest(0.60, base - 0.08) WHEN 'LOW' THEN least(0.93, base + 0.05) ELSE base END, 2) AS conf FROM cr)
"""


@query(
    "loan_requests",
    f"""WITH {CASES} SELECT company_id, CAST(req AS DOUBLE) AS requested_amount_usd, (['working_capital','expansion','real_estate','working_capital'])[k % 4 + 1] AS loan_purpose, ncav AS caveats, CAST(base AS DOUBLE) AS base_confidence,
      CAST(NULL AS VARCHAR) AS deferral FROM ca""",
)
def loan_requests(spark, folder):
    c = _cases(spark, folder)
    return c.select("company_id", as_double("requested_amount_usd"), "loan_purpose", F.size("caveats").alias("caveats"),
                    policy.base_confidence(F.col("ebitda"), F.col("total_revenue"), F.col("caveats")).alias("base_confidence"), policy.deferral(c).alias("deferral"))


@query("credit_deferrals", f"""WITH {FIGURES} SELECT company_id, document_type, 'Critical merged facts missing: ' || miss AS deferral FROM
    (SELECT company_id, 'income_statement' AS document_type, CASE WHEN k % 7 = 0 THEN 'ebitda, total_assets' ELSE 'total_assets' END AS miss FROM fx UNION ALL SELECT company_id, 'balance_sheet', 'total_revenue, ebitda' FROM fx)""")
def credit_deferrals(spark, folder):
    """Which single statements would be too little to start credit analysis."""
    f = D.statement_facts(adapters.statement_texts(spark, folder))
    return f.select("company_id", "document_type", policy.deferral(f).alias("deferral"))


@query(
    "credit_decisions",
    f"""WITH {CASES} SELECT company_id, tier AS risk_tier, CAST(lim AS DOUBLE) AS recommended_limit_usd, CAST(conf AS DOUBLE) AS confidence,
      least(4, ncav + CASE WHEN ltd / eb > 5 THEN 1 ELSE 0 END + CASE WHEN has_default THEN 1 ELSE 0 END + CASE WHEN ca / cl < 1 THEN 1 ELSE 0 END) AS key_concerns FROM cd""",
)
def credit_decisions(spark, folder):
    d = policy.credit_decisions(_cases(spark, folder))
    return d.select("company_id", "risk_tier", as_double("recommended_limit_usd"), "confidence", F.size("key_concerns").alias("key_concerns"))


@query(
    "portfolio_scores",
    f"""WITH {CASES}, pt AS (SELECT *, CASE WHEN risk_segment = 'HIGH' OR trajectory = 'DECLINING' THEN 'HIGH' WHEN trajectory = 'GROWTH' THEN 'LOW' ELSE 'MEDIUM' END AS ptier FROM ca),
    pc AS (SELECT *, CASE ptier WHEN 'HIGH' THEN CASE WHEN company_id = 'COMP-068' THEN 0.82 ELSE 0.74 END WHEN 'LOW' THEN 0.89 ELSE 0.77 END AS c0 FROM pt)
    SELECT company_id, ptier AS risk_tier, CAST(round(CASE WHEN ncav > 0 THEN least(greatest(0.62, c0 - 0.08), CASE WHEN ncav >= 3 THEN 0.70 ELSE 0.75 END) ELSE c0 END, 4) AS DOUBLE) AS confidence,
      CAST(round_even(req * CASE ptier WHEN 'HIGH' THEN CAST(0.78 AS DECIMAL(3,2)) WHEN 'LOW' THEN CAST(1.00 AS DECIMAL(3,2)) ELSE CAST(0.92 AS DECIMAL(3,2)) END, 0) AS DOUBLE) AS recommended_limit_usd FROM pc""",
)
def portfolio_scores(spark, folder):
    p = policy.portfolio_scores(_cases(spark, folder))
    return p.select("company_id", "risk_tier", F.round("confidence", 4).alias("confidence"), as_double("recommended_limit_usd"))


FRAUD = f"""{CASES},
fr AS (SELECT *, n_rev + n_bal AS medium, CASE WHEN active_flags > 0 THEN 1 ELSE 0 END AS low,
  least(95, 8 + 18 * (n_rev + n_bal) + CASE WHEN active_flags > 0 THEN 8 ELSE 0 END + CASE WHEN industry = 'Retail' THEN 4 ELSE 0 END) AS pts FROM cd)
"""


@query(
    "fraud_screening",
    f"""WITH {FRAUD} SELECT company_id, medium + low AS anomalies, pts / 100.0 AS fraud_score, CASE WHEN pts >= 60 THEN 'HIGH' WHEN pts >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
      CASE WHEN pts >= 60 THEN 'REVIEW' ELSE 'CLEAR' END AS recommendation FROM fr""",
)
def fraud_screening(spark, folder):
    c = _cases(spark, folder).withColumn("a", policy.fraud_anomalies(F.col("consistency_notes"), F.col("active_flags")))
    s = c.withColumn("s", policy.fraud_scores(F.col("a"), F.col("industry")))
    return s.select("company_id", F.size("a").alias("anomalies"), "s.fraud_score", "s.risk_level", "s.recommendation")


@query(
    "recommended_decisions",
    f"""WITH {FRAUD} SELECT company_id, CASE WHEN tier = 'HIGH' THEN 'DECLINE' WHEN pts >= 60 THEN 'DECLINE' WHEN ncav > 0 THEN 'REFER' ELSE 'APPROVE' END AS recommendation, CAST(greatest(0.60, conf) AS DOUBLE) AS confidence,
      CASE WHEN tier = 'HIGH' OR pts >= 60 THEN NULL ELSE CAST(lim AS DOUBLE) END AS approved_amount_usd FROM fr""",
)
def recommended_decisions(spark, folder):
    c = policy.credit_decisions(_cases(spark, folder))
    score = policy.fraud_scores(policy.fraud_anomalies(F.col("consistency_notes"), F.col("active_flags")), F.col("industry"))
    d = c.withColumn("s", score).withColumn("d", policy.recommended_decision(F.col("risk_tier"), F.col("confidence"), F.col("recommended_limit_usd"), F.col("caveats"), F.col("s.fraud_score")))
    return d.select("company_id", "d.recommendation", "d.confidence", F.col("d.approved_amount_usd").cast("double").alias("approved_amount_usd"))


RULESQL = f"""{COMPANIES},
ru AS (SELECT company_id, unnest([{{'i': 1, 'o': 'PASS', 'h': false}}, {{'i': 2, 'o': 'PASS', 'h': false}}, {{'i': 3, 'o': CASE WHEN jurisdiction = 'MT' THEN 'FAIL' ELSE 'PASS' END, 'h': jurisdiction = 'MT'}},
  {{'i': 4, 'o': CASE WHEN legal_type IS NULL THEN 'FAIL' ELSE 'PASS' END, 'h': false}}, {{'i': 5, 'o': CASE WHEN 2025 - founded_year >= 2 THEN 'PASS' ELSE 'FAIL' END, 'h': false}}, {{'i': 6, 'o': 'NOTE', 'h': false}}]) AS x FROM co)
"""


@query("compliance_rules", f"WITH {RULESQL} SELECT company_id, 'REG-00' || x.i AS rule_id, x.o AS outcome, x.h AS is_hard_block FROM ru")
def compliance_rules(spark, folder):
    return policy.compliance_rules(adapters.companies(spark, folder), 2025).select("company_id", "rule_id", "outcome", "is_hard_block")


@query(
    "compliance_verdicts",
    f"""WITH {RULESQL} SELECT company_id AS application_id, count(*) AS rules_evaluated, count(*) FILTER (WHERE x.o = 'PASS') AS rules_passed, count(*) FILTER (WHERE x.o = 'FAIL') AS rules_failed,
      count(*) FILTER (WHERE x.o = 'NOTE') AS rules_noted, bool_or(x.h) AS has_hard_block, CASE WHEN bool_or(x.h) THEN 'BLOCKED' WHEN count(*) FILTER (WHERE x.o = 'FAIL') > 0 THEN 'CONDITIONAL' ELSE 'CLEAR' END AS overall_verdict,
      CASE WHEN bool_or(x.h) THEN 'ApplicationDeclined' ELSE 'DecisionRequested' END AS follow_up,
      CASE WHEN bool_or(x.h) THEN string_agg('Compliance hard block: REG-00' || x.i, '|' ORDER BY x.i) FILTER (WHERE x.o = 'FAIL') END AS decline_reasons FROM ru GROUP BY 1""",
)
def compliance_verdicts(spark, folder):
    rules = policy.compliance_rules(adapters.companies(spark, folder), 2025).withColumnRenamed("company_id", "application_id")
    v = policy.compliance_verdicts(rules.withColumn("rule_order", F.substring("rule_id", 5, 3).cast("int")))
    return v.select("application_id", "rules_evaluated", "rules_passed", "rules_failed", "rules_noted", "has_hard_block", "overall_verdict", "follow_up", joined("decline_reasons"))


@query(
    "order_rule_verdicts",
    """SELECT CAST(l_orderkey AS VARCHAR) AS application_id, count(*) AS rules_evaluated, count(*) FILTER (WHERE l_returnflag = 'N') AS rules_passed, count(*) FILTER (WHERE l_returnflag = 'R') AS rules_failed,
      bool_or(l_returnflag = 'R' AND l_linestatus = 'F') AS has_hard_block,
      CASE WHEN bool_or(l_returnflag = 'R' AND l_linestatus = 'F') THEN 'BLOCKED' WHEN count(*) FILTER (WHERE l_returnflag = 'R') > 0 THEN 'CONDITIONAL' ELSE 'CLEAR' END AS overall_verdict
    FROM lineitem GROUP BY 1""",
)
def order_rule_verdicts(spark, folder):
    """Every line item read as a rule result of its order."""
    line = adapters.table(spark, folder, "lineitem")
    outcome = F.when(F.col("l_returnflag") == "N", "PASS").when(F.col("l_returnflag") == "R", "FAIL").otherwise("NOTE")
    rules = line.select(
        F.col("l_orderkey").cast("string").alias("application_id"), F.col("l_linenumber").alias("rule_order"), F.concat(F.lit("REG-00"), F.col("l_linenumber").cast("string")).alias("rule_id"),
        outcome.alias("outcome"), ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("is_hard_block"),
    )
    return policy.compliance_verdicts(rules).select("application_id", "rules_evaluated", "rules_passed", "rules_failed", "has_hard_block", "overall_verdict")
