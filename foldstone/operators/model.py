"""What a read model is: the events it handles, the key it keeps rows for, and its fold."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from foldstone.functions import ids
from foldstone.operators.agents import agent_parts, agent_performance, performance_of
from foldstone.operators.compliance import compliance_history, compliance_parts, history_of
from foldstone.operators.summary import application_summary, merge_registers, summary_from, summary_parts
from foldstone.schema import ANCHOR_TYPES, COMPLIANCE_TYPES, SUMMARY_TYPES
from foldstone.session import stage


def application_key(events: DataFrame) -> Column:
    return F.coalesce(F.get_json_object("payload", "$.application_id"), ids.stream_owner())


@dataclass(frozen=True)
class Parts:
    """A read model as tables that merge: ``split`` makes them of any set of events, ``merge`` combines the rows of each table
    from any number of sets in any order (a merged table merges again), ``finish`` makes the rows of merged tables."""

    split: Callable[[DataFrame], dict[str, DataFrame]]
    merge: dict[str, Callable[[DataFrame], DataFrame]]
    finish: Callable[[dict[str, DataFrame]], DataFrame]


@dataclass(frozen=True)
class ReadModel:
    """A custom or built-in read model.

    ``fold`` turns the handled events of some keys into rows that carry ``key_name``. ``key`` gives an event's key; a
    model without one (its rows mix keys) is folded whole. ``problem`` names why an event cannot be folded (null: fine).
    A model with ``parts`` is followed without reading earlier events again.
    """

    name: str
    handled_types: tuple[str, ...]
    fold: Callable[[DataFrame], DataFrame]
    key_name: str
    key: Callable[[DataFrame], Column] | None = None
    problem: Callable[[DataFrame], Column] | None = None
    parts: Parts | None = None

    def handled(self, events: DataFrame) -> DataFrame:
        return events.where(F.col("event_type").isin(*self.handled_types))

    def rebuild(self, ledger: DataFrame) -> DataFrame:
        """Rows from the whole log, from position 0."""
        events = self.handled(ledger)
        if self.problem is not None:
            events = events.where(self.problem(events).isNull())
        return self.fold(events)

    def write(self, ledger: DataFrame, path: str) -> None:
        self.rebuild(ledger).write.mode("overwrite").parquet(path)


def _once(rows: DataFrame) -> DataFrame:
    """Facts have the position of their event, so one that was delivered twice counts once."""
    return rows.dropDuplicates(["global_position"])


APPLICATION_SUMMARY = ReadModel(
    "application_summary", SUMMARY_TYPES, application_summary, "application_id", application_key,
    parts=Parts(summary_parts, {"registers": merge_registers, "sessions": DataFrame.distinct, "checks": DataFrame.distinct}, summary_from),
)
COMPLIANCE_AUDIT = ReadModel(
    "compliance_audit", COMPLIANCE_TYPES, compliance_history, "application_id", application_key,
    parts=Parts(compliance_parts, {"facts": _once}, lambda parts: history_of(stage(parts["facts"]), ["application_id"])),
)
AGENT_PERFORMANCE = ReadModel(
    "agent_performance", (*ANCHOR_TYPES, "CreditAnalysisCompleted", "FraudScreeningCompleted", "ComplianceCheckCompleted", "DecisionGenerated", "HumanReviewCompleted"),
    agent_performance, "agent_id",
    parts=Parts(agent_parts, {"sessions": _once, "overrides": _once}, lambda parts: performance_of(stage(parts["sessions"]), parts["overrides"])),
)
READ_MODELS = (APPLICATION_SUMMARY, COMPLIANCE_AUDIT, AGENT_PERFORMANCE)
