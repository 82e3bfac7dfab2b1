"""Model-call costs attributed to applications, agents, models and providers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from foldstone.functions import payload as P
from foldstone.operators.scan import last, running
from foldstone.schema import ANCHOR_TYPES
from foldstone.session import stage

# Model name patterns and the provider they imply, first match decides.
PROVIDER_PATTERNS = (
    ("^$", "unknown"),
    ("^(openai/|google/|anthropic/)", "openrouter"),
    ("^claude", "anthropic"),
    ("^qwen|:", "ollama"),
    ("deterministic", "deterministic"),
)
SCOPES = ("application_id", "agent_type", "model", "provider")


def provider_of(model: Column) -> Column:
    name = F.lower(F.trim(F.coalesce(model, F.lit(""))))
    guess = F.lit("unknown")
    for pattern, provider in reversed(PROVIDER_PATTERNS):
        guess = F.when(name.rlike(pattern), F.lit(provider)).otherwise(guess)
    return guess


def model_calls(ledger: DataFrame) -> DataFrame:
    """Anchors and model calls, each call with the latest anchor before it in its stream."""
    wanted = ledger.where(F.col("event_type").isin(*ANCHOR_TYPES, "AgentNodeExecuted"))
    parsed = P.with_fields(
        wanted, "application_id", "agent_type", "model_version", "llm_called", "llm_provider", "llm_model", "llm_cost_usd",
        "llm_tokens_input", "llm_tokens_output",
    )
    anchor = F.col("event_type").isin(*ANCHOR_TYPES)
    blank = F.lit("")
    context = F.struct(*[F.coalesce(f"p.{c}", blank).alias(c) for c in ("application_id", "agent_type", "model_version")])
    rows = parsed.select(
        "stream_id", "global_position", anchor.alias("is_anchor"), F.when(anchor, context).alias("_here"), P.truthy(F.col("p.llm_called")).alias("called"),
        P.filled(F.col("p.llm_provider")).alias("stated_provider"), P.filled(F.col("p.llm_model")).alias("stated_model"),
        F.coalesce(P.money(F.col("p.llm_cost_usd"), 20, 10), F.lit(0).cast("decimal(20,10)")).alias("cost"),
        F.coalesce(F.col("p.llm_tokens_input").try_cast("bigint"), F.lit(0)).alias("tokens_input"),
        F.coalesce(F.col("p.llm_tokens_output").try_cast("bigint"), F.lit(0)).alias("tokens_output"),
    )
    seen = running(stage(rows), ["stream_id"], "global_position", {"context": last(F.col("_here"))})
    version = P.filled(F.col("context.model_version"))
    return seen.where("context is not null").select(
        "stream_id", "global_position", "is_anchor", "called", "cost", "tokens_input", "tokens_output",
        F.col("context.application_id").alias("application_id"), F.col("context.agent_type").alias("agent_type"),
        F.coalesce("stated_provider", provider_of(version)).alias("provider"),
        F.coalesce("stated_model", version, F.lit("unknown")).alias("model"),
    )


def call_costs(ledger: DataFrame, application_ids: Sequence[str] = (), application_prefix: str = "") -> DataFrame:
    """Cost totals by scope: ``all``, application, agent, model, provider. Ids and prefix must both hold when given."""
    calls = model_calls(ledger)
    if application_ids:
        calls = calls.where(F.col("application_id").isin(*application_ids))
    if application_prefix:
        calls = calls.where(F.col("application_id").startswith(application_prefix))
    calls = stage(calls)
    made = calls.where("called and not is_anchor")
    fine = made.groupBy(*SCOPES).agg(
        F.count("*").alias("calls"), F.count_if(F.col("cost") > 0).alias("billable_calls"), F.sum("cost").alias("cost"),
        F.sum(F.col("tokens_input") + F.col("tokens_output")).alias("tokens"),
    )
    coarse = fine.groupingSets([[c] for c in SCOPES] + [[]], *SCOPES).agg(
        F.sum("calls").alias("calls"), F.sum("billable_calls").alias("billable_calls"), F.sum("cost").alias("cost"), F.sum("tokens").alias("tokens"),
        F.grouping_id(*SCOPES).alias("_gid"),
    )
    full = (1 << len(SCOPES)) - 1
    scope = F.lit("all")
    for i, name in enumerate(SCOPES):
        scope = F.when(F.col("_gid") == full - (1 << (len(SCOPES) - 1 - i)), F.lit(name)).otherwise(scope)
    included = calls.where("is_anchor").agg(F.count_distinct("application_id").alias("application_count"))
    totals = coarse.select(scope.alias("scope"), F.coalesce(*SCOPES).alias("key"), "calls", "billable_calls", "cost", "tokens")
    return totals.join(F.broadcast(included.withColumn("scope", F.lit("all"))), "scope", "left").select(
        "scope", "key", "calls", "billable_calls", F.round("cost", 6).alias("total_cost_usd"), "tokens", "application_count",
        F.when(F.col("application_count") > 0, F.round(F.col("cost") / F.col("application_count"), 6)).alias("average_cost_usd"),
    )


def _completed(ledger: DataFrame) -> DataFrame:
    """Completed sessions with their cost and ``c``, the application and agent type of their latest anchor, else their own."""
    wanted = ledger.where(F.col("event_type").isin(*ANCHOR_TYPES, "AgentSessionCompleted"))
    parsed = P.with_fields(wanted, "application_id", "agent_type", "total_cost_usd")
    own = F.struct(F.coalesce("p.application_id", F.lit("")).alias("application_id"), F.coalesce("p.agent_type", F.lit("")).alias("agent_type"))
    rows = stage(parsed.select(
        "stream_id", "global_position", "event_type", own.alias("_own"), F.when(F.col("event_type").isin(*ANCHOR_TYPES), own).alias("_anchor"),
        F.coalesce(P.money(F.col("p.total_cost_usd"), 20, 10), F.lit(0).cast("decimal(20,10)")).alias("cost"),
    ))
    seen = running(rows, ["stream_id"], "global_position", {"_context": last(F.col("_anchor"))})
    return seen.where("event_type = 'AgentSessionCompleted'").withColumn("c", F.coalesce("_context", "_own"))


def session_costs_by_agent(ledger: DataFrame) -> DataFrame:
    """Sessions completed and their cost per agent type, 2 decimals."""
    return _completed(ledger).groupBy(F.col("c.agent_type").alias("agent_type")).agg(F.count("*").alias("sessions"), F.round(F.sum("cost"), 2).alias("total_cost_usd"))


def session_costs(ledger: DataFrame, applications: DataFrame) -> DataFrame:
    """Completed-session cost per application (zero for applications without sessions), 2 decimals."""
    per_app = _completed(ledger).groupBy(F.col("c.application_id").alias("application_id")).agg(F.sum("cost").alias("cost"))
    return applications.select("application_id").distinct().join(per_app, "application_id", "full").select(
        "application_id", F.coalesce(F.round("cost", 2), F.lit(0).cast("decimal(20,2)")).alias("total_cost_usd")
    )


def cost_spread(per_application: DataFrame) -> DataFrame:
    """One row: grand total, average, lowest and highest application cost."""
    c = F.col("total_cost_usd")
    return per_application.agg(
        F.sum(c).alias("grand_total_usd"), F.round(F.sum(c) / F.count("*"), 2).alias("average_usd"), F.min(c).alias("lowest_usd"), F.max(c).alias("highest_usd")
    )


def dearest_call(ledger: DataFrame) -> DataFrame:
    """The single most expensive model call; the earliest one on ties."""
    made = model_calls(ledger).where("called and not is_anchor and cost > 0")
    return made.orderBy(F.desc("cost"), "global_position").limit(1).select(
        "application_id", "agent_type", F.col("cost").alias("cost_usd"), "tokens_input", "global_position"
    )


def normalise_usage(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """Text, token counts and cost of raw provider responses, whatever names and shapes they use."""
    doc = F.from_json(
        F.col(raw),
        "model string, choices array<struct<message:struct<content:string>>>, usage struct<prompt_tokens:bigint,input_tokens:bigint,"
        "completion_tokens:bigint,output_tokens:bigint,cost:double,cost_details:struct<prompt:double,completion:double>>",
    )
    parsed = responses.withColumn("_r", doc)
    content = F.try_element_at(F.col("_r.choices"), F.lit(1))["message"]["content"]
    parts = F.from_json(content, "array<struct<type:string,text:string>>")

    def clean(text: Column) -> Column:
        return F.regexp_replace(text, r"^\s+|\s+$", "")

    listed = F.array_join(F.filter(F.transform(F.filter(parts, lambda x: x["type"] == "text"), lambda x: clean(F.coalesce(x["text"], F.lit("")))), lambda x: x != ""), "\n")
    is_list = F.get_json_object(raw, "$.choices[0].message.content[0]").isNotNull() & content.startswith("[")
    usage = "_r.usage."

    def first_nonzero(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(usage + n), F.lit(0)) for n in names], F.lit(0).cast("bigint"))

    split = F.coalesce(F.col(usage + "cost_details.prompt"), F.lit(0.0)) + F.coalesce(F.col(usage + "cost_details.completion"), F.lit(0.0))
    return parsed.select(
        *responses.columns, F.col("_r.model").alias("model"),
        F.when(is_list, listed).otherwise(clean(F.coalesce(content, F.lit("")))).alias("text"),
        first_nonzero("prompt_tokens", "input_tokens").alias("tokens_input"),
        first_nonzero("completion_tokens", "output_tokens").alias("tokens_output"),
        F.round(F.coalesce(F.col(usage + "cost"), split), 10).alias("cost_usd"),
    )
