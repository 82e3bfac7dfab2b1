"""Integrity, lineage and counterfactual queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldstone.functions.digest import Tree, canonical_json
from foldstone.functions.mountain import Range
from foldstone.operators.scan import number_rows
from foldstone.operators import branches, integrity, lineage
from foldstone.plans.ctes import LOAN, summary_cte
from foldstone.plans.registry import as_double, micros, query
from foldstone.session import stage
from foldstone.sources import adapters, stored

CUT = "2024-01-16"


@query("canonical_hashes", """SELECT event_id, sha256('{"k":' || json_extract_string(props, '$.k') || ',"z":"' || event_type || '"}') AS hash FROM events""")
def canonical_hashes(spark, folder):
    """Digest of a document whose keys come in another order and with blanks."""
    e = adapters.table(spark, folder, "events")
    text = F.concat(F.lit('{ "z" : "'), "event_type", F.lit('", "k": '), F.get_json_object("props", "$.k"), F.lit(" }"))
    return e.select("event_id", F.sha2(canonical_json(text), 256).alias("hash"))


def _scalar_digest():
    return F.sha2(F.concat_ws("|", "event_id", "stream_id", F.col("stream_position").cast("string"), "event_type"), 256)


# A fan-in that the streams of the supplied tables exceed several times over.
SMALL_TREE = Tree(fan_in=4, levels=6)


def _tree_sql(name: str, source: str, digest: str) -> str:
    """CTEs that end in ``name`` (app, d): the digest tree over a source with app, pos and a digest column."""
    steps = [f"{name}_0 AS (SELECT app, (pos - 1) // {SMALL_TREE.fan_in} AS g, sha256('leaf:' || string_agg({digest}, '' ORDER BY pos)) AS d FROM {source} GROUP BY 1, 2)"]
    for k in range(1, SMALL_TREE.levels):
        steps.append(f"{name}_{k} AS (SELECT app, g // {SMALL_TREE.fan_in} AS up, sha256('node:' || string_agg(d, '' ORDER BY g)) AS d FROM {name}_{k - 1} GROUP BY 1, 2)".replace("AS up", "AS g2"))
        steps.append(f"{name}_{k}r AS (SELECT app, g2 AS g, d FROM {name}_{k})")
    text = ",\n".join(steps)
    for k in range(1, SMALL_TREE.levels - 1):
        text = text.replace(f"FROM {name}_{k} GROUP BY", f"FROM {name}_{k}r GROUP BY")
    return text + f",\n{name} AS (SELECT app, d FROM {name}_{SMALL_TREE.levels - 1}r)"


CHAIN = f"""{LOAN},
nn AS (SELECT stream_id, gpos, ts, k, t, app, eid, row_number() OVER (PARTITION BY stream_id ORDER BY gpos) AS pos FROM led WHERE stream_id LIKE 'loan-%'),
hh AS (SELECT *, sha256(eid || '|' || stream_id || '|' || pos || '|' || t) AS h, sha256(eid || '|' || stream_id || '|' || pos || '|' || CASE WHEN k = 7 THEN 'X' ELSE t END) AS h2 FROM nn),
early AS (SELECT * FROM hh WHERE ts < TIMESTAMP '{CUT}'), counted AS (SELECT app, count(*) AS n FROM early GROUP BY 1),
again AS (SELECT hh.* FROM hh JOIN counted USING (app) WHERE pos <= n),
{_tree_sql("first_tree", "early", "h")},
{_tree_sql("whole_tree", "hh", "h2")},
{_tree_sql("prefix_tree", "again", "h2")},
one AS (SELECT app, n, sha256(':' || d) AS ih FROM counted JOIN first_tree USING (app)),
two AS (SELECT w.app, (SELECT count(*) FROM hh WHERE hh.app = w.app) AS n, w.d AS al, p.d AS pre FROM whole_tree w LEFT JOIN prefix_tree p ON p.app = w.app)
"""


@query("integrity_first_check", f"""WITH {CHAIN} SELECT app AS entity_id, 'loan-' || app AS source_stream_id, n AS events_verified, ih AS integrity_hash, true AS chain_valid, false AS tamper_detected FROM one""")
def integrity_first_check(spark, folder):
    ledger = stored.loan_ledger(spark, folder).where(F.col("recorded_at") < F.lit(CUT).cast("timestamp"))
    ledger = ledger.where(F.col("stream_id").startswith("loan-"))
    entities = ledger.select(F.lit("loan").alias("entity_type"), F.regexp_replace("stream_id", "^loan-", "").alias("entity_id")).distinct()
    r = integrity.integrity_checks(ledger, entities, None, F.lit(CUT).cast("timestamp"), _scalar_digest(), SMALL_TREE)
    return r.select("entity_id", "source_stream_id", "events_verified", "integrity_hash", "chain_valid", "tamper_detected")


def _two_checks(spark, folder):
    ledger = stored.loan_ledger(spark, folder).where(F.col("stream_id").startswith("loan-"))
    at = F.lit(CUT).cast("timestamp")
    entities = ledger.select(F.lit("loan").alias("entity_type"), F.regexp_replace("stream_id", "^loan-", "").alias("entity_id")).distinct()
    early = ledger.where(F.col("recorded_at") < at)
    known = early.select(F.lit("loan").alias("entity_type"), F.regexp_replace("stream_id", "^loan-", "").alias("entity_id")).distinct()
    first = stage(integrity.check_events(integrity.integrity_checks(early, known, None, at, _scalar_digest(), SMALL_TREE), 1 << 40))
    changed = F.when(F.get_json_object("metadata", "$.causation_id") == F.concat(F.lit("e"), (F.col("global_position") - 7).cast("string")), F.lit("X")).otherwise(F.col("event_type"))
    tampered = ledger.withColumn("event_type", changed)
    second = integrity.integrity_checks(tampered, entities, first, F.lit("2024-02-01").cast("timestamp"), _scalar_digest(), SMALL_TREE)
    return first, stage(second)


@query(
    "integrity_second_check",
    f"""WITH {CHAIN} SELECT two.app AS entity_id, two.n AS events_verified, sha256(coalesce(one.ih, '') || ':' || al) AS integrity_hash, one.ih AS previous_hash,
      one.ih IS NULL OR sha256(':' || pre) = one.ih AS chain_valid, NOT (one.ih IS NULL OR sha256(':' || pre) = one.ih) AS tamper_detected,
      CASE WHEN one.ih IS NULL THEN 1 ELSE 2 END AS check_stream_position
    FROM two LEFT JOIN one ON one.app = two.app""",
)
def integrity_second_check(spark, folder):
    """Second check over a log in which every seventh kind of event was altered after the first check."""
    _, second = _two_checks(spark, folder)
    return second.select("entity_id", "events_verified", "integrity_hash", "previous_hash", "chain_valid", "tamper_detected", "check_stream_position")


@query(
    "audit_ledgers",
    f"""WITH {CHAIN}, sec AS (SELECT two.app, sha256(coalesce(one.ih, '') || ':' || al) AS ih, one.ih AS prev, one.ih IS NULL OR sha256(':' || pre) = one.ih AS ok FROM two LEFT JOIN one ON one.app = two.app)
    SELECT 'audit-loan-' || app AS audit_stream_id, CASE WHEN prev IS NULL THEN 1 ELSE 2 END AS checks, ih AS latest_integrity_hash, prev AS previous_hash, ok AS chain_valid, NOT ok AS tamper_detected,
      epoch_us(TIMESTAMP '2024-02-01') AS latest_check_timestamp, true AS append_only, CAST(NULL AS VARCHAR) AS replay_error FROM sec""",
)
def audit_ledgers(spark, folder):
    first, second = _two_checks(spark, folder)
    events = first.unionByName(integrity.check_events(second, 1 << 41))
    a = integrity.audit_ledgers(events)
    return a.select("audit_stream_id", "checks", "latest_integrity_hash", "previous_hash", "chain_valid", "tamper_detected", micros("latest_check_timestamp"), "append_only", "replay_error")


@query(
    "audit_trail",
    f"""WITH {CHAIN} SELECT app AS application_id, 2 AS stream_position FROM two JOIN one USING (app)""",
)
def audit_trail(spark, folder):
    first, second = _two_checks(spark, folder)
    events = first.unionByName(integrity.check_events(second, 1 << 41))
    return integrity.audit_trail(events, from_position=2, to_position=9).select("application_id", "stream_position")


LINK = f"""{LOAN}, lk AS (SELECT *, CASE WHEN gpos % 3 = 0 THEN lag(eid) OVER (PARTITION BY app ORDER BY gpos) END AS cause FROM led)"""


@query("correlation_chains", f"""WITH {LOAN} SELECT app AS application_id, 'c' || app AS correlation_id, eid AS event_id, row_number() OVER (PARTITION BY app ORDER BY gpos) AS link FROM led""")
def correlation_chains(spark, folder):
    related = lineage.audited_events(stored.loan_ledger(spark, folder))
    return lineage.correlation_chains(related).select("application_id", "correlation_id", "event_id", "link")


@query(
    "causal_violations",
    f"""WITH {LOAN}, f AS (SELECT app, min(gpos) AS g0 FROM led GROUP BY 1),
    ef AS (SELECT *, CASE gpos % 3 WHEN 0 THEN eid WHEN 1 THEN 'e' || g0 ELSE 'nowhere' || gpos END AS cause FROM led JOIN f USING (app))
    SELECT app AS application_id, eid AS event_id, cause AS causation_id, 'causation target is missing from the related event set' AS reason FROM ef WHERE gpos % 3 = 2
    UNION ALL SELECT app, eid, cause, 'causation target appears at or after the dependent event in global order' FROM ef WHERE gpos % 3 = 0 OR (gpos % 3 = 1 AND gpos = g0)
    UNION ALL SELECT app, eid, cause, 'causation target belongs to a different correlation chain' FROM ef WHERE gpos % 3 = 1 AND gpos % 2 <> g0 % 2""",
)
def causal_violations(spark, folder):
    """Events that name themselves, the first event of their application or nothing as their cause, in two chains."""
    ledger = stored.loan_ledger(spark, folder).withColumn("_app", F.get_json_object("payload", "$.application_id"))
    at = F.col("global_position")
    first = ledger.groupBy("_app").agg(F.min_by("event_id", "global_position").alias("_first"))
    cause = F.when(at % 3 == 0, F.col("event_id")).when(at % 3 == 1, F.col("_first")).otherwise(F.concat(F.lit("nowhere"), at.cast("string")))
    meta = F.to_json(F.struct(F.concat(F.lit("c"), (at % 2).cast("string")).alias("correlation_id"), cause.alias("causation_id")))
    told = ledger.join(first, "_app").withColumn("metadata", meta).drop("_app", "_first")
    return lineage.causal_violations(lineage.audited_events(told)).select("application_id", "event_id", "causation_id", "reason")


@query(
    "reference_resolution",
    f"""WITH {LOAN}, n AS (SELECT stream_id, count(*) AS c FROM led GROUP BY 1)
    SELECT led.eid AS event_id, led.stream_id || ':' || (k + 1) AS reference, k + 1 <= c AS resolvable FROM led JOIN n USING (stream_id)""",
)
def reference_resolution(spark, folder):
    ledger = stored.loan_ledger(spark, folder)
    k = F.coalesce(F.col("global_position") - F.regexp_replace(F.get_json_object("metadata", "$.causation_id"), "^e", "").cast("bigint"), F.lit(0))
    refs = ledger.select("event_id", F.concat_ws(":", "stream_id", (k + 1).cast("string")).alias("reference"))
    return lineage.resolved_references(refs, ledger)


@query("written_provenance", f"""WITH {LOAN}, n AS (SELECT sess, t, stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY gpos) AS pos FROM led)
    SELECT sess AS session_id, stream_id, t AS event_type, pos AS stream_position FROM n WHERE t IN ('CreditAnalysisCompleted','FraudScreeningCompleted')""")
def written_provenance(spark, folder):
    ledger = stored.loan_ledger(spark, folder)
    writes = ledger.where("event_type in ('CreditAnalysisCompleted','FraudScreeningCompleted')").select(
        F.get_json_object("payload", "$.session_id").alias("session_id"), "stream_id", "stream_position"
    )
    return lineage.written_provenance(writes, ledger)


@query("reference_tokens", f"""WITH {LINK} SELECT eid AS event_id, cause AS token FROM lk WHERE cause IS NOT NULL""")
def reference_tokens(spark, folder):
    return stored.linked_ledger(spark, folder).select("event_id", F.explode(lineage.reference_tokens()).alias("token"))


BRANCH = f"""{LINK},
br AS (SELECT app, min(gpos) AS bp, arg_min(eid, gpos) AS be, arg_min(stream_id, gpos) AS bs FROM lk WHERE t = 'CreditAnalysisCompleted' GROUP BY 1),
rank(t, r) AS (VALUES ('ApplicationSubmitted',0),('DocumentUploadRequested',1),('DocumentUploaded',1),('PackageReadyForAnalysis',2),('CreditAnalysisRequested',3),('CreditAnalysisCompleted',4),
  ('FraudScreeningRequested',5),('FraudScreeningCompleted',6),('ComplianceCheckRequested',7),('ComplianceCheckCompleted',9),('DecisionRequested',10),('DecisionGenerated',11),
  ('HumanReviewRequested',12),('HumanReviewCompleted',13),('ApplicationApproved',14),('ApplicationDeclined',14)),
cand AS (SELECT lk.*, bp, be, (stream_id LIKE 'loan-%' AND coalesce(r, 4) > 4) OR lk.t = 'AgentSessionCompleted' AS seed FROM lk JOIN br USING (app) LEFT JOIN rank ON rank.t = lk.t WHERE gpos > bp),
dep(app, eid) AS (
  SELECT app, eid FROM cand WHERE seed UNION SELECT app, be FROM br
  UNION SELECT c.app, c.eid FROM dep d JOIN cand c ON c.app = d.app AND c.cause = d.eid),
fall AS (SELECT * FROM cand WHERE eid IN (SELECT eid FROM dep))
"""


@query("branch_dependents", f"""WITH RECURSIVE {BRANCH} SELECT app AS application_id, eid AS event_id, t AS event_type FROM fall""")
def branch_dependents(spark, folder):
    related = stage(lineage.application_events(stored.linked_ledger(spark, folder)))
    points = lineage.branch_points(related, "CreditAnalysisCompleted")
    return lineage.dependents(related, points).select("application_id", "event_id", "event_type")


SEVERAL = BRANCH.replace("lk AS (", "lk1 AS (", 1).replace("br AS (", """lk AS (SELECT *, CASE WHEN gpos % 2 = 0 THEN lag(eid, 2) OVER w END AS trig, CASE WHEN gpos % 5 = 0 THEN lag(eid, 5) OVER w END AS decided
  FROM lk1 WINDOW w AS (PARTITION BY app ORDER BY gpos)),
br AS (""", 1).replace("c.cause = d.eid", "(c.cause = d.eid OR c.trig = d.eid OR c.decided = d.eid)")


def _with_several_references(ledger):
    """Every second event also names the one two before it as its trigger, every fifth the one five before it as its decision."""
    named = ledger.withColumn("_app", F.get_json_object("payload", "$.application_id"))
    numbered = stage(number_rows(named, ["_app"], "global_position", "_n"))
    for back, every, field in ((2, 2, "triggered_by_event_id"), (5, 5, "decision_event_id")):
        earlier = numbered.select("_app", (F.col("_n") + back).alias("_n"), F.col("event_id").alias("_ref"))
        joined = numbered.join(earlier, ["_app", "_n"], "left")
        added = F.concat(F.expr("left(payload, length(payload) - 1)"), F.lit(f',"{field}":"'), F.col("_ref"), F.lit('"}'))
        payload = F.when((F.col("global_position") % every == 0) & F.col("_ref").isNotNull(), added).otherwise(F.col("payload"))
        numbered = joined.withColumn("payload", payload).drop("_ref")
    return numbered.select(*ledger.columns)


@query("branch_dependents_several", f"""WITH RECURSIVE {SEVERAL} SELECT app AS application_id, eid AS event_id, t AS event_type FROM fall""")
def branch_dependents_several(spark, folder):
    """Dependents where events have up to three references each."""
    related = stage(lineage.application_events(_with_several_references(stored.linked_ledger(spark, folder))))
    points = lineage.branch_points(related, "CreditAnalysisCompleted")
    return lineage.dependents(related, points).select("application_id", "event_id", "event_type")


OUTCOMES = f"""{BRANCH},
keep AS (SELECT lk.* FROM lk JOIN br USING (app) WHERE eid <> be AND eid NOT IN (SELECT eid FROM fall)),
inj AS (SELECT * REPLACE (1000000000000 AS gpos, TIMESTAMP '2024-06-01' AS ts, 'CreditAnalysisCompleted' AS t, 'LOW' AS tier, 750000 AS lim, 'i' || app AS eid) FROM lk WHERE eid IN (SELECT be FROM br)),
tl AS (SELECT 'real' AS branch, lk.* FROM lk JOIN br USING (app) UNION ALL SELECT 'counterfactual', keep.* FROM keep UNION ALL SELECT 'counterfactual', inj.* FROM inj),
{summary_cte('tl', 'sm', 'branch, app')},
sg AS (SELECT branch, app, count(*) AS events, arg_max_null(tier, gpos) FILTER (WHERE t = 'CreditAnalysisCompleted') AS ctier,
    arg_max(CASE WHEN eid LIKE 'i%' THEN 0.91 ELSE k / 100.0 END, gpos) FILTER (WHERE t = 'CreditAnalysisCompleted') AS conf, arg_max(lim, gpos) FILTER (WHERE t = 'CreditAnalysisCompleted') AS lim,
    arg_max_null(fraud, gpos) FILTER (WHERE t = 'FraudScreeningCompleted') AS fraud, arg_max_null(verdict, gpos) FILTER (WHERE t = 'ComplianceCheckCompleted') AS vd,
    arg_max_null(rec, gpos) FILTER (WHERE t = 'DecisionGenerated') AS rec, arg_max_null(approved, gpos) FILTER (WHERE t = 'DecisionGenerated') AS amt,
    count(*) FILTER (WHERE t = 'CreditAnalysisCompleted') AS nc FROM tl GROUP BY 1, 2)
"""


@query(
    "branch_outcomes",
    f"""WITH RECURSIVE {OUTCOMES}
    SELECT sg.app AS application_id, sg.branch, events, state, risk_tier, fraud_score, vd AS overall_verdict, requested_amount_usd,
      CASE WHEN sg.branch = 'real' THEN rec WHEN nc = 0 THEN NULL WHEN vd = 'BLOCKED' THEN 'DECLINE' WHEN ctier = 'HIGH' THEN 'DECLINE' WHEN conf < 0.6 THEN 'REFER' WHEN coalesce(fraud, 0) >= 0.65 THEN 'DECLINE'
        WHEN requested_amount_usd IS NULL OR lim IS NULL THEN 'REFER' WHEN lim < requested_amount_usd THEN 'REFER' ELSE 'APPROVE' END AS recommendation,
      CASE WHEN sg.branch = 'real' THEN amt WHEN nc = 0 OR vd = 'BLOCKED' OR ctier = 'HIGH' OR conf < 0.6 OR coalesce(fraud, 0) >= 0.65 OR requested_amount_usd IS NULL OR lim IS NULL THEN NULL
        WHEN lim < requested_amount_usd THEN lim ELSE requested_amount_usd END AS amount_usd
    FROM sg LEFT JOIN sm ON sm.branch = sg.branch AND sm.app = sg.app""",
)
def branch_outcomes(spark, folder):
    ledger = stored.linked_ledger(spark, folder)
    decision = F.struct(F.lit("LOW").alias("risk_tier"), F.lit("750000").alias("recommended_limit_usd"), F.lit(0.91).alias("confidence"))
    apps = ledger.select(F.get_json_object("payload", "$.application_id").alias("application_id")).distinct()
    injected = apps.select(
        "application_id", F.lit(1).alias("seq"), F.lit("CreditAnalysisCompleted").alias("event_type"), F.lit(2).alias("event_version"),
        F.to_json(F.struct("application_id", decision.alias("decision"))).alias("payload"), F.lit("2024-06-01").cast("timestamp").alias("recorded_at"),
    )
    o = branches.branch_outcomes(branches.branch_timelines(ledger, "CreditAnalysisCompleted", injected))
    return o.select("application_id", "branch", "events", "state", "risk_tier", "fraud_score", "overall_verdict", as_double("requested_amount_usd"), "recommendation", as_double("amount_usd"))


# Widths that the streams of the supplied tables exceed several times over.
SMALL_RANGE = Range(fan_in=4, levels=5)


def _range_sql() -> str:
    """CTEs up to roots(stream_id, verified, root, early): ranges over the streams of all families, with digests of all nine columns."""
    digest = """sha256('{"event_id":"' || eid || '","event_type":"' || t || '","event_version":1,"global_position":' || gpos || ',"metadata":"{\\"chain\\":\\"c' || app || '\\"}","payload":"{\\"k\\":' || gpos || ',\\"t\\":\\"'
      || t || '\\"}","recorded_at":' || epoch_us(ts) || ',"stream_id":"' || stream_id || '","stream_position":' || pos || '}')"""
    f, top = SMALL_RANGE
    steps = [f"n0 AS (SELECT stream_id AS s, 0 AS l, pos - 1 AS i, {digest} AS d FROM nn)"]
    steps += [f"n{j} AS (SELECT s, {j} AS l, i // {f} AS i, sha256('node:' || string_agg(d, '' ORDER BY n{j - 1}.i)) AS d FROM n{j - 1} GROUP BY s, n{j - 1}.i // {f} HAVING count(*) = {f})" for j in range(1, top + 1)]
    every = " UNION ALL ".join(f"SELECT * FROM n{j}" for j in range(top + 1))
    return f"""{LOAN},
nn AS (SELECT stream_id, gpos, ts, t, app, eid, row_number() OVER (PARTITION BY stream_id ORDER BY gpos) AS pos FROM led),
{", ".join(steps)}, every AS ({every}),
counts AS (SELECT stream_id AS s, count(*) AS n, true AS early FROM nn WHERE ts < TIMESTAMP '{CUT}' GROUP BY 1 UNION ALL SELECT stream_id, count(*), false FROM nn GROUP BY 1),
roots AS (SELECT c.s AS stream_id, n AS verified, early, sha256('root:' || n || ':' || string_agg(d, '' ORDER BY l DESC, i)) AS root FROM counts c JOIN every e ON e.s = c.s
  AND i < n // ({f} ** l)::BIGINT AND (l = {top} OR i >= (n // ({f} ** (l + 1))::BIGINT) * {f}) GROUP BY 1, 2, 3)
"""


def _plain_events(spark, folder):
    """The ledger of all stream families with documents that SQL can write out."""
    ledger = stored.loan_ledger(spark, folder)
    app = F.get_json_object("payload", "$.application_id")
    payload = F.concat(F.lit('{ "t":"'), "event_type", F.lit('", "k":'), F.col("global_position").cast("string"), F.lit("}"))
    return stage(ledger.withColumns({"metadata": F.concat(F.lit('{"chain": "c'), app, F.lit('"}')), "payload": payload, "event_version": F.lit(1)}))


@query(
    "integrity_ranges",
    f"""WITH {_range_sql()} SELECT w.stream_id, w.verified, w.root, o.root AS previous_root, true AS consistent, w.verified - coalesce(o.verified, 0) AS hashed
    FROM roots w LEFT JOIN roots o ON o.stream_id = w.stream_id AND o.early WHERE NOT w.early""",
)
def integrity_ranges(spark, folder):
    """Two checks of all streams; the second one hashes only what came after the first."""
    ledger = _plain_events(spark, folder)
    first = integrity.range_check(ledger.where(F.col("recorded_at") < F.lit(CUT).cast("timestamp")), shape=SMALL_RANGE)
    return integrity.range_check(ledger, stage(first.nodes), stage(first.results), shape=SMALL_RANGE).results


@query(
    "tampered_events",
    f"""WITH {LOAN}, nn AS (SELECT stream_id, gpos, row_number() OVER (PARTITION BY stream_id ORDER BY gpos) AS pos FROM led)
    SELECT stream_id, pos AS stream_position, CASE WHEN gpos % 89 = 5 THEN 'missing' ELSE 'changed' END AS problem FROM nn WHERE gpos % 89 = 5 OR gpos % 97 = 3""",
)
def tampered_events(spark, folder):
    """Events that were changed or taken out after they had been hashed."""
    ledger = _plain_events(spark, folder)
    nodes = stage(integrity.range_check(ledger, shape=SMALL_RANGE).nodes)
    at = F.col("global_position")
    forged = ledger.where(at % 89 != 5).withColumn("recorded_at", F.when(at % 97 == 3, F.col("recorded_at") + F.expr("interval 1 second")).otherwise(F.col("recorded_at")))
    return integrity.tampered_events(forged, nodes, shape=SMALL_RANGE).select("stream_id", "stream_position", "problem")
