"""Loan replay: a state machine over every loan stream at once, with snapshots and error rows.

An event acts on the state as a function over twelve states plus an error sink, written as a word whose i-th letter is
the image of the i-th state. Composition of two events is ``translate`` of one word by the other, and composition is
associative, so a long stream is folded block by block, the blocks are folded per stream, and only then is each block
looked at again with its known start state to locate the first error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foldstone.functions import payload as P
from foldstone.schema import LOAN_STATES, LOAN_TRANSITIONS, REPLAY_FIELDS
from foldstone.session import block_rows, stage

LETTERS = "ABCDEFGHIJKLM"
ERROR = LETTERS[len(LOAN_STATES)]
_LETTER = dict(zip(LOAN_STATES, LETTERS))

TARGETS = {
    "ApplicationSubmitted": "SUBMITTED",
    "CreditAnalysisRequested": "AWAITING_ANALYSIS",
    "FraudScreeningRequested": "ANALYSIS_COMPLETE",
    "ComplianceCheckRequested": "COMPLIANCE_REVIEW",
    "DecisionRequested": "PENDING_DECISION",
    "ApplicationApproved": "FINAL_APPROVED",
}
FLAGS = {
    "documents_requested": "DocumentUploadRequested",
    "credit_requested": "CreditAnalysisRequested",
    "fraud_requested": "FraudScreeningRequested",
    "compliance_requested": "ComplianceCheckRequested",
    "decision_requested": "DecisionRequested",
    "human_review_completed": "HumanReviewCompleted",
}
_LOAN_FIELDS = (
    "applicant_id", "requested_amount_usd", "loan_term_months", "loan_purpose", "submission_channel", "application_reference",
    "document_id", "recommendation", "confidence", "contributing_sessions array<string>", "override", "final_decision",
    "approved_amount_usd", "decline_reasons array<string>",
)


def _word(image) -> str:
    return "".join(image(s) for s in LOAN_STATES) + ERROR


def _move_word(target: str) -> str:
    return _word(lambda s: _LETTER[target] if s == target or target in LOAN_TRANSITIONS.get(s, ()) else ERROR)


REVIEW_WORD = _word(lambda s: _LETTER["PENDING_HUMAN_REVIEW"] if s in ("APPROVED_PENDING_HUMAN", "DECLINED_PENDING_HUMAN") else _LETTER[s])
DECLINE_WORD = "".join(
    _LETTER["DECLINED_COMPLIANCE"] if s == "COMPLIANCE_REVIEW" else letter for s, letter in zip(LOAN_STATES, _move_word("FINAL_DECLINED"))
) + ERROR
FAIL_WORD = ERROR * len(LETTERS)


def state_name(letter: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in zip(LETTERS, (*LOAN_STATES, "ERROR")) for x in pair])
    return names[letter]


def application_of_loan() -> Column:
    return F.regexp_replace("stream_id", "^loan-", "")


def _letter(name: Column) -> Column:
    return F.char(F.array_position(F.array(*[F.lit(s) for s in LOAN_STATES]), name) + ord(LETTERS[0]) - 1)


def _steps(ledger: DataFrame) -> DataFrame:
    """Loan events with their step word, target (for messages) and the first required field that is absent."""
    events = P.with_fields(ledger.where(F.col("stream_id").startswith("loan-")), *_LOAN_FIELDS)
    t, rec = F.col("event_type"), F.col("p.recommendation")
    present = F.json_object_keys("payload")
    missing = F.lit(None).cast("string")
    for name in ("ApplicationSubmitted", "DocumentUploaded", "DecisionGenerated", "HumanReviewCompleted", "ApplicationApproved"):
        wanted = F.array(*[F.lit(f) for f in REPLAY_FIELDS[name]])
        missing = F.when(t == name, F.try_element_at(F.array_except(wanted, F.coalesce(present, F.array().cast("array<string>"))), F.lit(1))).otherwise(missing)
    target = F.create_map(*[F.lit(x) for pair in TARGETS.items() for x in pair])[t]
    target = (
        F.when(t == "DecisionGenerated", F.when(rec == "APPROVE", "APPROVED_PENDING_HUMAN").when(rec == "DECLINE", "DECLINED_PENDING_HUMAN").otherwise("PENDING_HUMAN_REVIEW"))
        .when(t == "ApplicationDeclined", "FINAL_DECLINED").otherwise(target)
    )
    words = F.create_map(*[F.lit(x) for s in LOAN_STATES for x in (s, _move_word(s))])
    word = (
        F.when(t == "ApplicationDeclined", DECLINE_WORD).when(t == "HumanReviewRequested", REVIEW_WORD)
        .when(target.isNotNull(), words[target]).otherwise(LETTERS)
    )
    return events.withColumn("_missing", missing).select(
        "stream_id", application_of_loan().alias("application_id"), "stream_position", "event_type", "p", target.alias("_target"), "_missing",
        word.alias("_move"), F.when(F.col("_missing").isNotNull(), F.lit(FAIL_WORD)).otherwise(word).alias("_word"),
    )


def replay_loans(ledger: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """Final aggregate per loan stream; replay of a stream stops at its first invalid transition or malformed event.

    ``snapshots`` (stream_id, stream_position, state) starts streams from their latest saved state; only later events
    are read. ``error_*`` columns name the event that stopped a stream.
    """
    steps = _steps(ledger)
    base = None
    if snapshots is not None:
        base = latest_snapshots(snapshots).select(
            "stream_id", F.col("stream_position").alias("_base"), F.from_json("state", SNAPSHOT_DDL).alias("_snap")
        )
        steps = steps.join(base, "stream_id", "left").where("_base is null or stream_position > _base").drop("_base", "_snap")
    steps = stage(steps)
    width = 4 * block_rows(ledger.sparkSession)
    moving = steps.where(F.col("_word") != LETTERS)
    blocks = stage(
        moving.groupBy("stream_id", F.floor(F.col("stream_position") / width).alias("_b")).agg(
            F.array_sort(F.collect_list(F.struct("stream_position", "_word", "_move", "_target", "_missing", "event_type"))).alias("_steps")
        )
    )
    folded = blocks.select("stream_id", "_b", F.aggregate("_steps", F.lit(LETTERS), lambda acc, s: _compose(acc, s["_word"])).alias("_f"))
    per_stream = folded.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("_b", "_f"))).alias("_blocks"))
    if base is not None:
        per_stream = per_stream.join(base.select("stream_id", _letter(F.col("_snap.state")).alias("_start")), "stream_id", "left")
    else:
        per_stream = per_stream.withColumn("_start", F.lit(None).cast("string"))
    start = F.coalesce("_start", F.lit(_LETTER["NEW"]))
    walked = per_stream.select(
        "stream_id",
        F.aggregate(
            "_blocks",
            F.struct(start.alias("s"), F.array().cast("array<struct<_b:bigint,s:string>>").alias("starts")),
            lambda acc, b: F.struct(
                _compose(acc["s"], b["_f"]).alias("s"),
                F.concat(acc["starts"], F.array(F.struct(b["_b"].alias("_b"), acc["s"].alias("s")))).alias("starts"),
            ),
        ).alias("w"),
    )
    walked = stage(walked)
    failed = walked.where(F.col("w.s") == ERROR).select("stream_id", F.explode("w.starts").alias("x"))
    entering = failed.select("stream_id", F.col("x._b").alias("_b"), F.col("x.s").alias("_s")).where(F.col("_s") != ERROR)
    located = blocks.join(entering, ["stream_id", "_b"]).select("stream_id", _first_error("_steps", F.col("_s")).alias("e")).where("e is not null")
    errors = located.groupBy("stream_id").agg(F.min_by("e", "e.at").alias("e"))
    return _captured(steps, walked, stage(errors), base)


def _compose(states: Column, word: Column) -> Column:
    return F.call_function("translate", states, F.lit(LETTERS), word)


def _first_error(steps: str, start: Column) -> Column:
    none = F.lit(None).cast("struct<at:bigint,event_type:string,from_state:string,target:string,field:string>")
    walked = F.aggregate(
        steps, F.struct(start.alias("s"), none.alias("e")),
        lambda acc, x: F.struct(
            _compose(acc["s"], x["_word"]).alias("s"),
            F.when(
                (acc["s"] != ERROR) & (_compose(acc["s"], x["_word"]) == ERROR),
                F.struct(
                    x["stream_position"].alias("at"), x["event_type"].alias("event_type"), state_name(acc["s"]).alias("from_state"),
                    # A bad move is reported before a missing field, except on decisions, which read their fields first.
                    F.when((_compose(acc["s"], x["_move"]) == ERROR) & ~((x["event_type"] == "DecisionGenerated") & x["_missing"].isNotNull()), x["_target"]).alias("target"),
                    F.when((_compose(acc["s"], x["_move"]) != ERROR) | (x["event_type"] == "DecisionGenerated"), x["_missing"]).alias("field"),
                ),
            ).otherwise(acc["e"]).alias("e"),
        ),
    )
    return walked["e"]


def _captured(steps: DataFrame, walked: DataFrame, errors: DataFrame, base: DataFrame | None) -> DataFrame:
    t, pos = F.col("event_type"), F.col("stream_position")
    applied = steps.join(errors, "stream_id", "left").where("e is null or stream_position < e.at")

    def latest(field: Column, *types: str) -> Column:
        return F.max_by(field, F.when(t.isin(*types), pos))

    submitted = "ApplicationSubmitted"
    values = applied.groupBy("stream_id").agg(
        F.max("stream_position").alias("version"),
        latest(F.col("p.applicant_id"), submitted).alias("applicant_id"),
        latest(P.money(F.col("p.requested_amount_usd")), submitted).alias("requested_amount_usd"),
        latest(F.col("p.loan_term_months").try_cast("int"), submitted).alias("loan_term_months"),
        latest(F.col("p.loan_purpose"), submitted).alias("loan_purpose"),
        latest(F.col("p.submission_channel"), submitted).alias("submission_channel"),
        latest(F.col("p.application_reference"), submitted).alias("application_reference"),
        *[F.coalesce(F.bool_or(t == kind), F.lit(False)).alias(name) for name, kind in FLAGS.items()],
        F.count_distinct(F.when(t == "DocumentUploaded", F.col("p.document_id"))).alias("documents_uploaded"),
        latest(F.col("p.recommendation"), "DecisionGenerated").alias("recommendation"),
        latest(F.col("p.confidence").try_cast("double"), "DecisionGenerated").alias("decision_confidence"),
        latest(F.col("p.contributing_sessions"), "DecisionGenerated").alias("contributing_sessions"),
        latest(P.money(F.col("p.approved_amount_usd")), "ApplicationApproved").alias("approved_amount_usd"),
        latest(
            F.when(t == "HumanReviewCompleted", F.col("p.final_decision")).when(t == "ApplicationApproved", F.lit("APPROVE")).otherwise(F.lit("DECLINE")),
            "HumanReviewCompleted", "ApplicationApproved", "ApplicationDeclined",
        ).alias("final_decision"),
        latest(P.truthy(F.col("p.override")), "HumanReviewCompleted").alias("human_override"),
        latest(F.coalesce("p.decline_reasons", F.array().cast("array<string>")), "ApplicationDeclined").alias("decline_reasons"),
    )
    streams = steps.select("stream_id", "application_id").distinct()
    joined = streams.join(values, "stream_id", "left").join(walked.select("stream_id", F.col("w.s").alias("_s")), "stream_id", "left").join(errors, "stream_id", "left")
    flags = list(FLAGS)
    if base is not None:
        joined = joined.join(base, "stream_id", "full")
        joined = joined.withColumn("application_id", application_of_loan())
    snap = (lambda name: F.col(f"_snap.{name}")) if base is not None else (lambda name: F.lit(None))
    state = F.when(F.col("e").isNotNull(), F.col("e.from_state")).otherwise(
        F.coalesce(state_name(F.col("_s")), snap("state").cast("string"), F.lit("NEW"))
    )
    plain = [c for c in values.columns if c not in ("stream_id", "version", *flags, "human_override", "documents_uploaded")]
    return joined.select(
        "stream_id", "application_id", F.coalesce("version", F.col("_base") if base is not None else F.lit(None), F.lit(-1)).cast("bigint").alias("version"),
        state.alias("state"),
        *[F.coalesce(F.col(c), snap(c).cast(values.schema[c].dataType)).alias(c) for c in plain],
        *[(F.coalesce(F.col(c), F.lit(False)) | F.coalesce(snap(c).cast("boolean"), F.lit(False))).alias(c) for c in flags],
        F.coalesce("human_override", snap("human_override").cast("boolean"), F.lit(False)).alias("human_override"),
        (state == "DECLINED_COMPLIANCE").alias("compliance_declined"),
        F.col("e.at").alias("error_position"), F.col("e.event_type").alias("error_event"), F.col("e.target").alias("error_target"),
        F.col("e.field").alias("error_field"),
    )


SNAPSHOT_DDL = (
    "version bigint, state string, applicant_id string, requested_amount_usd decimal(18,2), loan_term_months int, loan_purpose string, "
    "submission_channel string, application_reference string, documents_requested boolean, credit_requested boolean, "
    "fraud_requested boolean, compliance_requested boolean, decision_requested boolean, human_review_completed boolean, "
    "recommendation string, decision_confidence double, contributing_sessions array<string>, approved_amount_usd decimal(18,2), "
    "final_decision string, human_override boolean, compliance_declined boolean, decline_reasons array<string>"
)


def save_snapshots(replayed: DataFrame, created_at: Column) -> DataFrame:
    """Snapshot rows of the streams that replay without error."""
    fields = [part.strip().split(" ")[0] for part in SNAPSHOT_DDL.split(", ")]
    return replayed.where("error_position is null").select(
        "stream_id", F.col("version").alias("stream_position"), F.lit("LoanApplication").alias("aggregate_type"), F.lit(1).alias("snapshot_version"),
        F.to_json(F.struct(*fields)).alias("state"), created_at.alias("created_at"),
    )


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """Latest snapshot per stream by position, then creation time."""
    others = [c for c in snapshots.columns if c != "stream_id"]
    order = F.struct("stream_position", "created_at")
    return snapshots.groupBy("stream_id").agg(F.max_by(F.struct(*others), order).alias("s")).select("stream_id", "s.*")
