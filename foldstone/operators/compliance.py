"""Compliance read model: full state after every event, current state, state as of a time, and the replayed record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foldstone.functions import payload as P
from foldstone.operators.scan import asof, count_so_far, last, listed, number_rows, running, total
from foldstone.schema import COMPLIANCE_TYPES, NOTE_ONLY_RULES
from foldstone.session import stage

RULE_CLASSES = {"ComplianceRulePassed": "passed", "ComplianceRuleFailed": "failed", "ComplianceRuleNoted": "noted"}
HOUR_US = 3_600_000_000


def _parsed(ledger: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    wanted = P.with_fields(
        ledger.where(F.col("event_type").isin(*COMPLIANCE_TYPES)),
        "application_id", "session_id", "regulation_set_version", "rules_to_evaluate array<string>", "rule_id",
        "is_hard_block", "has_hard_block", "overall_verdict",
    )
    t = F.col("event_type")
    known = F.create_map(*[F.lit(x) for pair in RULE_CLASSES.items() for x in pair])
    return wanted.select(
        *keys, F.col("p.application_id").alias("application_id"), "stream_id", "event_id", "global_position", "recorded_at", t,
        known[t].alias("rule_class"), F.col("p.rule_id").alias("rule_id"),
        (F.coalesce(t == "ComplianceRuleFailed", F.lit(False)) & P.truthy(F.col("p.is_hard_block"))).alias("hard"),
        (F.coalesce(t == "ComplianceCheckCompleted", F.lit(False)) & P.truthy(F.col("p.has_hard_block"))).alias("hard_verdict"),
        F.when(t == "ComplianceCheckInitiated", F.struct(
            F.col("p.session_id").alias("session_id"), F.col("p.regulation_set_version").alias("regulation_set_version"),
            F.coalesce("p.rules_to_evaluate", F.array().cast("array<string>")).alias("required_rules"),
        )).alias("opened"),
        F.when(t.isin("ComplianceCheckInitiated", "ComplianceCheckCompleted"), F.struct(
            (t == "ComplianceCheckCompleted").alias("completed"), F.when(t == "ComplianceCheckCompleted", F.col("p.overall_verdict")).alias("verdict"),
        )).alias("closed"),
    ).where("application_id is not null")


def compliance_history(ledger: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per handled event with the state after it.

    A re-opened check starts a new segment that clears the rules. Counts keep duplicates; ``hard_block_rules`` holds
    distinct rule ids. Rule ids come from the regulation set, so the per-segment id lists stay small.
    """
    return history_of(stage(_parsed(ledger, keys)), [*keys, "application_id"])


def compliance_parts(events: DataFrame) -> dict[str, DataFrame]:
    """What the history needs of any events, without their payloads; parts merge as sets."""
    return {"facts": _parsed(events, ())}


def history_of(rows: DataFrame, by: list[str]) -> DataFrame:
    """The history of parsed events."""
    opened = F.col("event_type") == "ComplianceCheckInitiated"
    marked = stage(running(rows, by, "global_position", {
        "snapshot_version": count_so_far(),
        "segment": total(opened.cast("bigint")),
        "_opened": last(F.col("opened")),
        "_closed": last(F.col("closed")),
    }).drop("opened", "closed"))

    def seen(rule_class: str) -> Column:
        return F.coalesce((F.col("rule_class") == rule_class).cast("bigint"), F.lit(0))

    counted = stage(running(marked, [*by, "segment"], "global_position", {
        "passed_count": total(seen("passed")), "failed_count": total(seen("failed")), "noted_count": total(seen("noted")),
        "_hard_count": total(F.col("hard").cast("bigint")),
    }))
    segment = [*by, "segment"]
    # A hard verdict with no listed block takes over the failed rules known at that moment.
    fallback = F.col("hard_verdict") & (F.col("_hard_count") == 0) & (F.col("failed_count") > 0)
    takeover = counted.groupBy(*segment).agg(F.min(F.when(fallback, F.col("global_position"))).alias("_takeover"))
    first_seen = counted.where("rule_class = 'failed'").groupBy(*segment, "rule_id").agg(
        F.min("global_position").alias("at"), F.min(F.when(F.col("hard"), F.col("global_position"))).alias("hard_at")
    )
    failed = first_seen.groupBy(*segment).agg(F.sort_array(F.collect_list(F.struct("rule_id", "at", "hard_at"))).alias("_failed"))
    state = counted.join(takeover.join(failed, segment, "left"), segment, "left")
    pos, cut = F.col("global_position"), F.col("_takeover")
    listed = F.filter("_failed", lambda r: (r["hard_at"] <= pos) | ((cut <= pos) & (r["at"] <= cut)))
    return state.select(
        *by, "snapshot_version", "segment", "global_position", F.col("recorded_at").alias("as_of"), F.col("event_type").alias("last_event_type"),
        "_opened.session_id", "_opened.regulation_set_version",
        F.coalesce("_opened.required_rules", F.array().cast("array<string>")).alias("required_rules"),
        "passed_count", "failed_count", "noted_count",
        F.coalesce(F.transform(listed, lambda r: r["rule_id"]), F.array().cast("array<string>")).alias("hard_block_rules"),
        F.coalesce("_closed.completed", F.lit(False)).alias("completed"),
        F.col("_closed.verdict").alias("overall_verdict"),
        (F.col("global_position") + 1).alias("checkpoint_position"),
    )


def compliance_current(ledger: DataFrame, keys: tuple[str, ...] = (), history: DataFrame | None = None) -> DataFrame:
    """Last state per application."""
    by = [*keys, "application_id"]
    rows = history if history is not None else compliance_history(ledger, keys)
    others = [c for c in rows.columns if c not in by]
    latest = rows.groupBy(*by).agg(F.max_by(F.struct(*others), F.col("global_position")).alias("s"))
    return latest.select(*by, "s.*")


def compliance_at(history: DataFrame, probes: DataFrame, block_us: int = HOUR_US) -> DataFrame:
    """State per probe (application_id, at): latest ``as_of`` not after ``at``, ties by snapshot version; else null."""
    states = [c for c in history.columns if c != "application_id"]
    left = probes.withColumn("_t", F.unix_micros("at"))
    right = history.select("application_id", F.unix_micros("as_of").alias("_t"), "snapshot_version", F.struct(*states).alias("state"))
    found = asof(left, right, ["application_id"], "_t", "state", inclusive=True, ties=["snapshot_version"],
                 block=F.floor(F.col("_t") / block_us))
    return found.select(*probes.columns, "state.*")


# What a rule result says besides its rule, by class; the rest is null there.
RESULT_FIELDS = {
    "passed": ("rule_name", "rule_version", "evidence_hash", "evaluation_notes", "evaluated_at"),
    "failed": ("rule_name", "rule_version", "failure_reason", "is_hard_block", "remediation_available", "remediation_description", "evidence_hash", "evaluated_at"),
    "noted": ("rule_name", "note_type", "note_text", "evaluated_at"),
}
_FLAGS, _DETAILS = ("is_hard_block", "remediation_available"), sorted({f for fields in RESULT_FIELDS.values() for f in fields})


def rule_results(ledger: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per rule result with all it says, and the interval in which it belongs to the state of its application.

    A result counts from its own event until the next opening of a check, which clears the lists (null: until today).
    ``segment`` numbers the openings as in ``compliance_history`` (0 before the first); ``ordinal`` is the place in the list of
    its class. A state after any event, or at any time, is the results whose interval holds it, so nothing is copied.
    """
    by = [*keys, "application_id"]
    wanted = P.with_fields(ledger.where(F.col("event_type").isin("ComplianceCheckInitiated", *RULE_CLASSES)), "application_id", "rule_id", *_DETAILS)
    known = F.create_map(*[F.lit(x) for pair in RULE_CLASSES.items() for x in pair])
    rule_class = known[F.col("event_type")]

    def detail(name: str) -> Column:
        value = F.col(f"p.{name}")
        value = P.truthy(value) if name in _FLAGS else P.instant(value) if name == "evaluated_at" else value
        return F.when(F.col("rule_class").isin(*[c for c, fields in RESULT_FIELDS.items() if name in fields]), value).alias(name)

    rows = wanted.withColumn("rule_class", rule_class).select(
        *keys, F.col("p.application_id").alias("application_id"), "global_position", "recorded_at", "rule_class", F.col("p.rule_id").alias("rule_id"), *[detail(d) for d in _DETAILS]
    ).where("application_id is not null")
    rows = stage(running(stage(rows), by, "global_position", {"segment": total(F.col("rule_class").isNull().cast("bigint"))}))
    openings = rows.where("rule_class is null").select(*by, (F.col("segment") - 1).alias("segment"), F.col("global_position").alias("valid_until_position"), F.col("recorded_at").alias("valid_until"))
    numbered = number_rows(rows.where("rule_class is not null"), [*by, "segment", "rule_class"], "global_position")
    return numbered.join(openings, [*by, "segment"], "left").select(
        *by, "segment", "rule_class", "ordinal", "rule_id", *_DETAILS, F.col("global_position").alias("valid_from_position"), F.col("recorded_at").alias("valid_from"), "valid_until_position", "valid_until"
    )


def current_rule_results(results: DataFrame) -> DataFrame:
    """The results of the open state of every application."""
    return results.where("valid_until_position is null")


def rule_results_at(results: DataFrame, history: DataFrame, probes: DataFrame, block_us: int = HOUR_US) -> DataFrame:
    """The results in the state of an application at a time: the probe's columns with one row per result.

    The state comes from the as-of join of ``compliance_at``; its results are those of the same segment that began at it or
    before. A probe without a state, or whose state has no results, has no rows.
    """
    found = compliance_at(history, probes, block_us).select(*probes.columns, "segment", F.col("global_position").alias("_at"))
    return found.where("_at is not null").join(results, ["application_id", "segment"]).where("valid_from_position <= _at").drop("_at")


def rule_lists(ledger: DataFrame) -> DataFrame:
    """Rule results of the open segment per application and class, in order, duplicates kept, one row each."""
    rows = stage(_parsed(ledger, ()))
    opened = F.col("event_type") == "ComplianceCheckInitiated"
    latest = rows.groupBy("application_id").agg(F.max(F.when(opened, F.col("global_position"))).alias("_opened_at"))
    current = rows.where("rule_class is not null").join(latest, "application_id").where("_opened_at is null or global_position > _opened_at")
    return listed(current, ["application_id", "rule_class"], "global_position", F.col("rule_id"), "rule_id")


def compliance_record(ledger: DataFrame) -> DataFrame:
    """Replayed record: rule sets over the whole stream (never cleared), hard blocks, evaluation and clearance tests."""
    by = ["application_id"]
    rows = stage(_parsed(ledger, ()))
    scalar = rows.groupBy(*by).agg(
        F.max_by("opened", F.when(F.col("opened").isNotNull(), F.col("global_position"))).alias("_opened"),
        F.max_by("closed", F.when(F.col("closed.completed"), F.col("global_position"))).alias("_closed"),
        F.count("*").alias("version"),
        F.min(F.when(F.col("rule_class") == "failed", F.col("global_position"))).alias("_first_failed"),
    )
    firsts = rows.where("rule_class is not null").groupBy(*by, "rule_class", "rule_id").agg(
        F.min("global_position").alias("at"), F.min(F.when(F.col("hard"), F.col("global_position"))).alias("hard_at")
    )
    sets = firsts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("rule_class", "rule_id", "at", "hard_at"))).alias("_rules"))
    takeover = (
        rows.where("hard_verdict").select(*by, "global_position").join(scalar.select(*by, "_first_failed"), by)
        .where("global_position > _first_failed").groupBy(*by).agg(F.min("global_position").alias("_takeover"))
    )
    joined = scalar.join(sets, by, "left").join(takeover, by, "left")
    none = F.array().cast("array<string>")

    def ids_of(keep) -> Column:
        return F.coalesce(F.array_distinct(F.transform(F.filter("_rules", keep), lambda r: r["rule_id"])), none)

    cut = F.col("_takeover")
    explicit_first = F.array_min(F.transform("_rules", lambda r: r["hard_at"]))
    taken = cut.isNotNull() & (explicit_first.isNull() | (explicit_first > cut))
    state = joined.select(
        *by, "version", "_opened.session_id", "_opened.regulation_set_version",
        F.array_sort(F.array_distinct(F.coalesce("_opened.required_rules", none))).alias("required_rules"),
        ids_of(lambda r: r["rule_class"] == "passed").alias("passed_rules"),
        ids_of(lambda r: r["rule_class"] == "failed").alias("failed_rules"),
        ids_of(lambda r: r["rule_class"] == "noted").alias("noted_rules"),
        ids_of(lambda r: r["hard_at"].isNotNull() | (taken & (r["rule_class"] == "failed") & (r["at"] < cut))).alias("hard_block_rules"),
        F.col("_closed").isNotNull().alias("completed"),
        F.col("_closed.verdict").alias("overall_verdict"),
    )
    evaluated = F.array_union(F.array_union("passed_rules", "failed_rules"), F.col("noted_rules"))
    mandatory = F.array_except("required_rules", F.array(*[F.lit(r) for r in NOTE_ONLY_RULES]))
    hard = F.size("hard_block_rules") > 0
    return state.select(
        "*", hard.alias("has_hard_block"),
        ((F.size("required_rules") > 0) & (F.size(F.array_except("required_rules", evaluated)) == 0)).alias("all_required_evaluated"),
        (F.col("completed") & ~hard & (F.size(F.array_except(mandatory, "passed_rules")) == 0) & F.coalesce(F.col("overall_verdict") == "CLEAR", F.lit(False))).alias("cleared_for_approval"),
    )
