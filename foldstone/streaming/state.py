"""Per-application fold kept in streaming state: the alternative to parts that are merged when they are read.

The state of an application has a (value, position) register for each field, the sessions it completed and its compliance
checks. Every register keeps the value of the largest position, so events may come in any order and more than once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foldstone.operators.summary import _handled, _session, registers

# Fixed by the summary: its registers and their types.
KINDS = {
    "_state": "string", "_hard_reason": "boolean", "applicant_id": "string", "requested_amount_usd": "decimal(18,2)", "approved_amount_usd": "decimal(18,2)",
    "risk_tier": "string", "fraud_score": "double", "compliance_status": "string", "decision": "string", "last_event_type": "string",
    "last_event_at": "timestamp", "human_reviewer_id": "string", "final_decision_at": "timestamp",
}
_HIDDEN = ("_state", "_hard_reason")
SHOWN = [name for name in KINDS if name not in _HIDDEN]
STATE = ", ".join(f"{name} {kind}, {name}_at bigint" for name, kind in KINDS.items()) + ", sessions array<string>, check_at array<bigint>, check_status array<string>"
OUTPUT = "application_id string, state string, sessions_completed bigint, last_position bigint, " + ", ".join(f"{name} {KINDS[name]}" for name in SHOWN)


def _assignments(events: DataFrame) -> DataFrame:
    """Narrow rows for the fold: which registers an event sets, and to what, worked out on the JVM side."""
    handled = _handled(events)
    columns = [c for name, (value, at) in registers().items() for c in (value.cast(KINDS[name]).alias(name), at.alias(f"{name}_at"))]
    check = F.when(F.col("event_type") == "ComplianceCheckCompleted", F.col("global_position"))
    return handled.select("application_id", "recorded_at", _session().alias("session_id"), check.alias("checked_at"), F.col("p.overall_verdict").alias("verdict"), *columns)


def _missing(value: object) -> bool:
    return value is None or value is pd.NaT or value != value


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Merge the new events of one application into its registers."""
    if state.hasTimedOut:
        state.remove()
        return
    held = list(state.get) if state.exists else [None, None] * len(KINDS) + [[], [], []]
    found = {name: (held[2 * k], held[2 * k + 1]) for k, name in enumerate(KINDS)}
    sessions, checks = set(held[-3]), dict(zip(held[-2], held[-1]))
    # Plain lists: a call per register and application on a frame of a few rows costs far more than walking through them.
    for rows in batches:
        listed = {c: rows[c].tolist() for c in rows.columns}
        for name, (value, at) in found.items():
            for v, p in zip(listed[name], listed[f"{name}_at"]):
                if not _missing(p) and (at is None or p > at):
                    value, at = None if _missing(v) else v, int(p)
            found[name] = (value, at)
        sessions.update(s for s in listed["session_id"] if not _missing(s))
        checks.update((int(p), None if _missing(v) else v) for p, v in zip(listed["checked_at"], listed["verdict"]) if not _missing(p))
    sessions, check_at = sorted(sessions), sorted(checks)
    current, state_at = found["_state"]
    reasoned, declined_at = found["_hard_reason"]
    if state_at is not None and state_at == declined_at:
        before = [p for p in check_at if p < declined_at]
        blocked = bool(before) and checks[before[-1]] == "BLOCKED"
        current = "DECLINED_COMPLIANCE" if blocked or reasoned else "FINAL_DECLINED"
    state.update((*[x for pair in found.values() for x in pair], sessions, check_at, [checks[p] for p in check_at]))
    out = {"application_id": key[0], "state": current or "NEW", "sessions_completed": len(sessions), "last_position": found["last_event_type"][1]}
    yield pd.DataFrame([out | {name: found[name][0] for name in SHOWN}])


def stateful_summary(stream: DataFrame) -> DataFrame:
    """Updated rows per application, in update mode: all fields of the application summary, and the last position.

    The registers merge as aggregates, so Spark keeps and updates the state of all applications itself, without a call to
    Python and a frame per application and batch.
    """
    folded = _assignments(stream).groupBy("application_id").agg(
        *[F.max_by(name, f"{name}_at").alias(name) for name in KINDS],
        *[F.max(f"{name}_at").alias(f"{name}_at") for name in (*_HIDDEN, "last_event_type")],
        F.collect_set("session_id").alias("sessions"), F.collect_set(F.when(F.col("checked_at").isNotNull(), F.struct("checked_at", "verdict"))).alias("checks"),
    )
    declined_at = F.col("_hard_reason_at")
    known = F.array_max(F.filter("checks", lambda c: c["checked_at"] < declined_at))
    declined = F.when(F.coalesce(known["verdict"] == "BLOCKED", F.lit(False)) | F.col("_hard_reason"), "DECLINED_COMPLIANCE").otherwise("FINAL_DECLINED")
    return folded.select(
        "application_id", F.when(F.col("_state_at") == declined_at, declined).otherwise(F.coalesce("_state", F.lit("NEW"))).alias("state"),
        F.size("sessions").cast("bigint").alias("sessions_completed"), F.col("last_event_type_at").alias("last_position"), *SHOWN,
    )


def expiring_summary(stream: DataFrame, idle: str) -> DataFrame:
    """As ``stateful_summary``, but the state of an application is dropped when the stream's time has gone on by ``idle`` since
    its last event, so state is bounded by the active applications. An event that comes later than that starts anew.
    Dropping it needs a timer per application, which aggregates do not have, so this fold runs in Python."""
    rows = _assignments(stream).withWatermark("recorded_at", idle)

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        yield from _advance(key, batches, state)
        if state.exists:
            latest = state.get[2 * list(KINDS).index("last_event_at")]
            after = int(pd.Timestamp(latest).timestamp() * 1000) + 1
            state.setTimeoutTimestamp(max(after, state.getCurrentWatermarkMs() + 1))

    return rows.groupBy("application_id").applyInPandasWithState(advance, OUTPUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)
