"""Schema validation, malformed-event detection and read-time upgrades of old event versions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from foldstone.functions import payload as P
from foldstone.schema import ANCHOR_TYPES, CREDIT_REGIMES, CURRENT_VERSIONS, ENUMS, FIELD_KINDS, NULLABLE_REQUIRED, REPLAY_FIELDS, event_fields

# Text patterns a value of each kind must match.
_KIND_PATTERNS = {
    "int": r"^-?\d+(\.0+)?$",
    "number": r"^-?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$",
    "flag": r"(?i)^(true|false|0|1|yes|no|on|off|t|f|y|n)$",
    "time": r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?)?$",
    "list": r"(?s)^\[.*\]$",
    "object": r"(?s)^\{.*\}$",
}


def _mistyped(field: Column, value: Column) -> Column:
    """True where a value does not fit the kind that its field name implies."""
    bad = F.lit(False)
    for kind, names in reversed(FIELD_KINDS):
        bad = F.when(field.rlike(names), ~value.rlike(_KIND_PATTERNS[kind])).otherwise(bad)
    for name, values in ENUMS.items():
        bad = F.when(field == name, ~value.isin(*values)).otherwise(bad)
    return F.coalesce(bad, F.lit(False))


def _registry(fields: dict[str, Sequence[str]]) -> Column:
    return F.create_map(*[x for name, names in fields.items() for x in (F.lit(name), F.array(*[F.lit(n) for n in names]))])


def validate_events(ledger: DataFrame) -> DataFrame:
    """Each event with ``valid`` and the list of problems: unknown type, missing fields, values of the wrong kind."""
    registry = _registry({name: fields for name, (_, fields) in event_fields().items()})
    wanted = registry[F.col("event_type")]
    doc = F.from_json("payload", "map<string,string>")
    rows = ledger.select(*ledger.columns, wanted.alias("_wanted"), doc.alias("_doc"))
    nullable = F.array(*[F.lit(n) for n in NULLABLE_REQUIRED])
    missing = F.filter("_wanted", lambda f: F.col("_doc").isNull() | ~F.map_contains_key("_doc", f) | (F.element_at("_doc", f).isNull() & ~F.array_contains(nullable, f)))
    wrong = F.filter("_wanted", lambda f: _mistyped(f, F.element_at("_doc", f)))
    problems = F.when(F.col("_wanted").isNull(), F.array(F.concat(F.lit("unknown event_type "), F.coalesce("event_type", F.lit("null"))))).otherwise(
        F.concat(
            F.transform(missing, lambda f: F.concat(F.lit("missing "), f)),
            F.transform(wrong, lambda f: F.concat(F.lit("invalid "), f)),
        )
    )
    return rows.withColumn("problems", problems).withColumn("valid", F.size("problems") == 0).drop("_wanted", "_doc")


def validation_report(validated: DataFrame) -> DataFrame:
    """Counts of events and errors overall, per event type and per stream family."""
    family = F.split_part("stream_id", F.lit("-"), F.lit(1))
    counted = validated.groupBy("event_type", family.alias("family")).agg(F.count("*").alias("events"), F.count_if(~F.col("valid")).alias("errors"))
    sets = counted.groupingSets([["event_type"], ["family"], []], "event_type", "family").agg(
        F.sum("events").alias("events"), F.sum("errors").alias("errors"), F.grouping_id("event_type", "family").alias("g")
    )
    scope = F.when(F.col("g") == 1, "event_type").when(F.col("g") == 2, "family").otherwise("all")
    return sets.select(scope.alias("scope"), F.coalesce("event_type", "family").alias("key"), "events", "errors")


def malformed_events(ledger: DataFrame) -> DataFrame:
    """Events a replay cannot use, with the first absent field."""
    wanted = _registry(REPLAY_FIELDS)[F.col("event_type")]
    present = F.coalesce(F.json_object_keys("payload"), F.array().cast("array<string>"))
    absent = F.array_except(wanted, present)
    return ledger.where(F.col("event_type").isin(*REPLAY_FIELDS)).select(
        "event_id", "stream_id", "event_type", "global_position", F.try_element_at(absent, F.lit(1)).alias("field"),
    ).where("field is not null")


@dataclass(frozen=True)
class Upgrade:
    """One step of an event type: ``payload(df)`` gives the new payload column, ``prepare`` may join lookups first."""

    event_type: str
    from_version: int
    to_version: int
    payload: Callable[[DataFrame], Column]
    prepare: Callable[[DataFrame, DataFrame], DataFrame] | None = None


def upgrade_events(ledger: DataFrame, steps: Sequence[Upgrade], current: dict[str, int] | None = None, log: DataFrame | None = None) -> DataFrame:
    """Events at their current version; ``upgrade_error`` names a missing step. Stored rows are not changed.

    All steps are column expressions over one pass of the log; only steps with ``prepare`` add a join.
    """
    targets = dict(current or {})
    for s in steps:
        targets[s.event_type] = max(targets.get(s.event_type, 1), s.to_version)
    source = log if log is not None else ledger
    df = ledger
    for s in sorted(steps, key=lambda x: x.from_version):
        if s.prepare is not None:
            df = s.prepare(df, source)
        hit = (F.col("event_type") == s.event_type) & (F.col("event_version") == s.from_version)
        df = df.select(
            *[c for c in df.columns if c not in ("payload", "event_version")],
            F.when(hit, s.payload(df)).otherwise(F.col("payload")).alias("payload"),
            F.when(hit, F.lit(s.to_version)).otherwise(F.col("event_version")).alias("event_version"),
        )
    target = F.create_map(*[F.lit(x) for pair in targets.items() for x in pair])[F.col("event_type")]
    behind = F.col("event_version") < F.coalesce(target, F.col("event_version"))
    error = F.when(behind, F.format_string("No upcaster registered for %s v%d -> v%d", "event_type", "event_version", F.col("event_version") + 1))
    return df.select(*ledger.columns, error.alias("upgrade_error"))


def credit_upgrade() -> Upgrade:
    """Credit analyses of version 1 get the model and rule sets in force when they were recorded."""
    model, rules = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    for start, end, name, sets in reversed(CREDIT_REGIMES):
        inside = (F.col("recorded_at") >= F.lit(start).cast("timestamp")) & (F.col("recorded_at") < F.lit(end).cast("timestamp"))
        model = F.when(inside, F.lit(name)).otherwise(model)
        rules = F.when(inside, F.array(*[F.lit(r) for r in sets])).otherwise(rules)
    has_model = P.truthy(F.get_json_object("payload", "$.model_version"))
    has_rules = P.truthy(F.get_json_object("payload", "$.regulatory_basis"))
    addition = F.to_json(F.struct(F.when(~has_model, model).alias("model_version"), F.when(~has_rules, rules).alias("regulatory_basis")))
    return Upgrade("CreditAnalysisCompleted", 1, 2, lambda df: P.merged(F.col("payload"), addition))


def session_models(decisions: DataFrame, log: DataFrame) -> DataFrame:
    """event_id -> map agent type: model version, from the first anchor of each contributing session; later sessions win."""
    refs = P.with_fields(decisions, "contributing_sessions array<string>").select("event_id", F.posexplode("p.contributing_sessions").alias("i", "ref"))
    refs = refs.withColumn("session_stream", F.when(F.col("ref").startswith("agent-"), F.col("ref")).otherwise(F.concat(F.lit("agent-"), F.col("ref"))))
    anchors = P.with_fields(log.where(F.col("event_type").isin(*ANCHOR_TYPES)), "agent_type", "model_version").groupBy(F.col("stream_id").alias("session_stream")).agg(
        F.min_by(F.struct(F.coalesce("p.agent_type", F.lit("unknown")).alias("agent_type"), F.col("p.model_version").alias("model_version")), "stream_position").alias("a")
    )
    found = refs.join(anchors, "session_stream").where(P.filled(F.col("a.model_version")).isNotNull())
    per_type = found.groupBy("event_id", "a.agent_type").agg(F.max_by("a.model_version", "i").alias("model_version"))
    return per_type.groupBy("event_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("agent_type", "model_version")))).alias("_models"))


def decision_upgrade() -> Upgrade:
    """Decisions of version 1 get the model versions of their contributing sessions."""

    def prepare(df: DataFrame, log: DataFrame) -> DataFrame:
        is_old = F.coalesce((F.col("event_type") == "DecisionGenerated") & (F.col("event_version") == 1), F.lit(False))
        old = df.where(is_old)
        models = session_models(old, log)
        rest = df.where(~is_old).withColumn("_models", F.lit(None).cast("map<string,string>"))
        return old.join(models, "event_id", "left").select(*rest.columns).unionByName(rest)

    def payload(df: DataFrame) -> Column:
        has = P.truthy(F.get_json_object("payload", "$.model_versions"))
        models = F.coalesce(F.col("_models"), F.create_map().cast("map<string,string>"))
        return F.when(has, F.col("payload")).otherwise(P.merged(F.col("payload"), F.to_json(F.struct(models.alias("model_versions")))))

    return Upgrade("DecisionGenerated", 1, 2, payload, prepare)


def default_upgrades() -> list[Upgrade]:
    return [credit_upgrade(), decision_upgrade()]


def current_events(ledger: DataFrame) -> DataFrame:
    return upgrade_events(ledger, default_upgrades(), CURRENT_VERSIONS)
