"""Session and cost queries over the conversation table."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldstone.operators import costs, sessions
from foldstone.plans.ctes import SESSIONS
from foldstone.plans.registry import as_double, joined, micros, query
from foldstone.sources import adapters, stored

FIRST = f"""{SESSIONS},
fe AS (SELECT stream_id, conv, arg_min(t, spos) AS ft, arg_min(n, spos) * 10 AS tok, arg_min(model, spos) AS fm, arg_min(app, spos) AS fapp, max(spos) AS lastpos,
  min(spos) FILTER (WHERE t = 'AgentSessionStarted' AND spos > 1) AS err FROM se GROUP BY 1, 2)
"""


@query(
    "session_records",
    f"""WITH {FIRST}
    SELECT f.stream_id, least(lastpos, coalesce(err - 1, lastpos)) AS version, CASE WHEN ft = 'AgentSessionStarted' THEN 's' || f.conv END AS session_id,
      CASE WHEN ft = 'AgentSessionStarted' THEN 'bot-' || (f.conv % 7) END AS agent_id, CASE WHEN ft = 'AgentSessionStarted' THEN fm END AS model_version,
      CASE WHEN ft = 'AgentSessionStarted' THEN tok END AS context_token_count, ft = 'AgentSessionStarted' AS started,
      coalesce(bool_or(t = 'AgentSessionRecovered' AND (err IS NULL OR spos < err)), false) AS recovered,
      coalesce(bool_or(t = 'AgentSessionCompleted' AND (err IS NULL OR spos < err)), false) AS completed,
      coalesce(bool_or(t = 'AgentSessionFailed' AND (err IS NULL OR spos < err)), false) AS failed,
      CASE WHEN err IS NULL THEN count(*) FILTER (WHERE t = 'AgentOutputWritten') END AS outputs_written, err AS error_position
    FROM fe f JOIN se USING (stream_id) GROUP BY f.stream_id, f.conv, lastpos, err, ft, fm, tok""",
)
def session_records(spark, folder):
    r = sessions.session_records(stored.session_ledger(spark, folder))
    return r.drop("agent_type", "application_id", "context_source")


@query(
    "session_contexts",
    f"""WITH {FIRST}, req AS (SELECT DISTINCT 's' || conv AS sid FROM cv UNION ALL SELECT DISTINCT 'x' || conv FROM cv)
    SELECT 'agent-chat-' || sid AS stream_id, sid AS requested_session_id, CASE WHEN ft = 'AgentSessionStarted' THEN 's' || f.conv END AS session_id,
      CASE WHEN ft = 'AgentSessionStarted' THEN fapp END AS application_id,
      CASE WHEN ft = 'AgentSessionStarted' THEN tok ELSE 0 END AS context_token_count,
      CASE WHEN ft = 'AgentSessionStarted' THEN greatest(0, 2000 - tok) ELSE 2000 END AS token_budget_remaining,
      arg_max(t, spos) AS last_event_type, arg_max('node_' || (n % 4), spos) FILTER (WHERE t = 'AgentNodeExecuted') AS last_successful_node,
      coalesce(arg_max(turn, spos) FILTER (WHERE t = 'AgentNodeExecuted'), 0) + 1 AS next_node_sequence,
      count(*) FILTER (WHERE t = 'AgentToolCalled') AS tools_called, count(*) FILTER (WHERE t = 'AgentOutputWritten') AS outputs_written,
      coalesce(bool_or(t = 'AgentSessionCompleted'), false) AS completed, coalesce(bool_or(t = 'AgentSessionFailed'), false) AS failed,
      coalesce(bool_or(t = 'AgentSessionRecovered'), false) AS recovered,
      concat_ws('|', CASE WHEN ft IS NULL THEN 'session_stream_missing' WHEN ft <> 'AgentSessionStarted' THEN 'missing_gas_town_anchor' END,
        CASE WHEN ft = 'AgentSessionStarted' AND tok > 2000 THEN 'token_budget_exceeded' END) AS reconciliation_reasons
    FROM req LEFT JOIN fe f ON f.stream_id = 'agent-chat-' || sid LEFT JOIN se ON se.stream_id = f.stream_id GROUP BY sid, f.conv, ft, fapp, tok""",
)
def session_contexts(spark, folder):
    ledger = stored.session_ledger(spark, folder)
    known = adapters.table(spark, folder, "conversations").select("conv_id").distinct()
    asked = known.select(F.lit("chat").alias("agent_type"), F.explode(F.array(F.concat(F.lit("s"), F.col("conv_id").cast("string")), F.concat(F.lit("x"), F.col("conv_id").cast("string")))).alias("session_id"))
    c = sessions.session_contexts(ledger, asked, token_budget=2000)
    return c.select(
        "stream_id", "requested_session_id", "session_id", "application_id", "context_token_count", "token_budget_remaining", "last_event_type",
        "last_successful_node", "next_node_sequence", "tools_called", "outputs_written", "completed", "failed", "recovered", joined("reconciliation_reasons"),
    )


@query(
    "session_tools",
    f"""WITH {SESSIONS} SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY spos) AS ordinal, 'tool_' || (n % 6) AS tool FROM se WHERE t = 'AgentToolCalled'""",
)
def session_tools(spark, folder):
    return sessions.session_tools(stored.session_ledger(spark, folder))


@query(
    "session_outputs",
    f"""WITH {SESSIONS} SELECT stream_id, spos AS stream_position, 0 AS item, 'credit-' || app AS output_stream_id, 'CreditAnalysisCompleted' AS output_event_type,
      turn + 1 AS output_position FROM se WHERE t = 'AgentOutputWritten'""",
)
def session_outputs(spark, folder):
    return sessions.session_outputs(stored.session_ledger(spark, folder))


@query(
    "session_recovery",
    f"""WITH {SESSIONS}, lk AS (SELECT DISTINCT sess, 's' || (conv - 1) AS src FROM se WHERE t = 'AgentSessionRecovered'),
    pn AS (SELECT lk.sess, lk.src, n % 4 AS node, count(*) AS runs FROM lk JOIN se ON se.sess IN (lk.sess, lk.src) AND t = 'AgentNodeExecuted' GROUP BY 1, 2, 3)
    SELECT lk.sess AS session_id, lk.src AS recovered_from, CAST(coalesce(sum(runs), 0) AS BIGINT) AS nodes_run, count(*) FILTER (WHERE runs > 1) AS repeated_nodes,
      count(*) FILTER (WHERE runs > 1) = 0 AS no_node_repeated
    FROM lk LEFT JOIN pn USING (sess, src) GROUP BY 1, 2""",
)
def session_recovery(spark, folder):
    return sessions.recovery_lineage(stored.session_ledger(spark, folder))


@query(
    "session_cards",
    f"""WITH {SESSIONS}
    SELECT sess AS session_id, stream_id, 'chat' AS agent_type, CASE WHEN bool_or(role = 'system') THEN 'bot-' || (conv % 7) END AS agent_id,
      CASE WHEN bool_or(role = 'system') THEN any_value(model) END AS model_version,
      (1700000000 + arg_max(gpos % 100000, gpos) FILTER (WHERE role = 'system')) * 1000000 AS started_at,
      (1700000000 + arg_max(gpos % 100000, gpos) FILTER (WHERE t IN ('AgentSessionCompleted','AgentSessionFailed'))) * 1000000 AS completed_at,
      coalesce(arg_max(CASE t WHEN 'AgentSessionFailed' THEN 'failed' ELSE 'completed' END, gpos) FILTER (WHERE t IN ('AgentSessionCompleted','AgentSessionFailed')), 'running') AS status,
      count(*) FILTER (WHERE t = 'AgentNodeExecuted') AS nodes_executed, count(*) FILTER (WHERE t = 'AgentToolCalled') AS tools_called,
      count(*) FILTER (WHERE t = 'AgentOutputWritten') AS output_events,
      arg_max(CAST(CAST(n / 10000 AS DECIMAL(12,6)) AS DOUBLE), gpos) FILTER (WHERE t = 'AgentSessionCompleted') AS total_cost_usd
    FROM se GROUP BY sess, stream_id, conv""",
)
def session_cards(spark, folder):
    c = sessions.session_cards(stored.session_ledger(spark, folder))
    return c.select("session_id", "stream_id", "agent_type", "agent_id", "model_version", micros("started_at"), micros("completed_at"), "status",
                    "nodes_executed", "tools_called", "output_events", "total_cost_usd")


@query(
    "session_guarded_reads",
    f"""WITH {FIRST}, req AS (SELECT DISTINCT conv, 's' || conv AS sid, CASE WHEN conv % 2 = 0 THEN 'chat' ELSE 'bot-' || (conv % 5) END AS agent FROM cv)
    SELECT r.agent, se.stream_id, spos AS stream_position, t AS event_type FROM req r JOIN fe f ON f.conv = r.conv JOIN se ON se.stream_id = f.stream_id
    WHERE r.agent = 'chat' OR (ft = 'AgentSessionStarted' AND r.agent = 'bot-' || (f.conv % 7))""",
)
def session_guarded_reads(spark, folder):
    c = F.col("conv_id")
    asked = adapters.table(spark, folder, "conversations").select("conv_id").distinct().select(
        F.when(c % 2 == 0, F.lit("chat")).otherwise(F.concat(F.lit("bot-"), (c % 5).cast("string"))).alias("agent"), F.concat(F.lit("s"), c.cast("string")).alias("session_id")
    )
    return sessions.guarded_session_events(stored.session_ledger(spark, folder), asked).select("agent", "stream_id", "stream_position", "event_type")


CALLS = f"""{SESSIONS},
ctx AS (
  SELECT *, last_value(CASE WHEN t = 'AgentSessionStarted' THEN model END IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY spos ROWS UNBOUNDED PRECEDING) AS cm FROM se),
calls AS (
  SELECT *, app AS application_id, 'chat' AS agent_type, coalesce(CASE WHEN n % 2 = 0 THEN 'mod-' || (n % 3) END, cm) AS model_name,
    coalesce(CASE WHEN n % 3 = 0 THEN 'openrouter' END, CASE WHEN cm LIKE 'openai/%' THEN 'openrouter' WHEN cm LIKE 'claude%' THEN 'anthropic' WHEN cm LIKE 'qwen%' OR cm LIKE '%:%' THEN 'ollama'
      WHEN cm LIKE '%deterministic%' THEN 'deterministic' ELSE 'unknown' END) AS provider,
    CASE WHEN n % 9 <> 0 THEN CAST(n / 100000 AS DECIMAL(12,6)) ELSE 0 END AS cost, n + n % 50 AS tokens
  FROM ctx WHERE t = 'AgentNodeExecuted' AND cm IS NOT NULL AND n % 7 <> 0)
"""


@query(
    "call_costs",
    f"""WITH {CALLS}, inc AS (SELECT count(DISTINCT app) AS apps FROM se WHERE t = 'AgentSessionStarted'),
    g AS (
      SELECT 'all' AS scope, NULL AS key, count(*) AS calls, count(*) FILTER (WHERE cost > 0) AS billable_calls, sum(cost) AS cost, sum(tokens) AS tokens FROM calls
      UNION ALL SELECT 'application_id', application_id, count(*), count(*) FILTER (WHERE cost > 0), sum(cost), sum(tokens) FROM calls GROUP BY 2
      UNION ALL SELECT 'agent_type', agent_type, count(*), count(*) FILTER (WHERE cost > 0), sum(cost), sum(tokens) FROM calls GROUP BY 2
      UNION ALL SELECT 'model', model_name, count(*), count(*) FILTER (WHERE cost > 0), sum(cost), sum(tokens) FROM calls GROUP BY 2
      UNION ALL SELECT 'provider', provider, count(*), count(*) FILTER (WHERE cost > 0), sum(cost), sum(tokens) FROM calls GROUP BY 2)
    SELECT scope, key, calls, billable_calls, CAST(cost AS DOUBLE) AS total_cost_usd, CAST(tokens AS BIGINT) AS tokens, CASE WHEN scope = 'all' THEN apps END AS application_count,
      CASE WHEN scope = 'all' THEN round(CAST(cost AS DOUBLE) / apps, 6) END AS average_cost_usd FROM g, inc""",
)
def call_costs(spark, folder):
    c = costs.call_costs(stored.session_ledger(spark, folder))
    return c.select("scope", "key", "calls", "billable_calls", as_double("total_cost_usd"), "tokens", "application_count", as_double("average_cost_usd"))


DONE = f"""{SESSIONS},
apps AS (SELECT DISTINCT app FROM se),
done AS (SELECT app, sum(CAST(n / 10000 AS DECIMAL(12,6))) AS c FROM se WHERE t = 'AgentSessionCompleted' GROUP BY 1),
per AS (SELECT apps.app AS application_id, round(coalesce(c, 0), 2) AS total_cost_usd FROM apps LEFT JOIN done USING (app))
"""


def _session_costs(spark, folder):
    conversations = adapters.table(spark, folder, "conversations")
    apps = conversations.select(F.concat(F.lit("app-"), (F.col("conv_id") % 20).cast("string")).alias("application_id")).distinct()
    return costs.session_costs(stored.session_ledger(spark, folder), apps)


@query("session_costs", f"WITH {DONE} SELECT application_id, CAST(total_cost_usd AS DOUBLE) AS total_cost_usd FROM per")
def session_costs(spark, folder):
    return _session_costs(spark, folder).select("application_id", as_double("total_cost_usd"))


@query(
    "session_costs_by_agent",
    f"""WITH {SESSIONS}, d AS (SELECT split_part(stream_id, '-', 2) AS agent_type, CAST(n / 10000 AS DECIMAL(12,6)) AS c FROM se WHERE t = 'AgentSessionCompleted')
    SELECT agent_type, count(*) AS sessions, CAST(round(sum(c), 2) AS DOUBLE) AS total_cost_usd FROM d GROUP BY 1""",
)
def session_costs_by_agent(spark, folder):
    return costs.session_costs_by_agent(stored.session_ledger(spark, folder)).select("agent_type", "sessions", as_double("total_cost_usd"))


@query(
    "session_cost_spread",
    f"""WITH {DONE} SELECT CAST(sum(total_cost_usd) AS DOUBLE) AS grand_total_usd, round(CAST(sum(total_cost_usd) AS DOUBLE) / count(*), 2) AS average_usd,
      CAST(min(total_cost_usd) AS DOUBLE) AS lowest_usd, CAST(max(total_cost_usd) AS DOUBLE) AS highest_usd FROM per""",
)
def session_cost_spread(spark, folder):
    s = costs.cost_spread(_session_costs(spark, folder))
    return s.select(*[as_double(c) for c in s.columns])


@query(
    "dearest_call",
    f"""WITH {CALLS} SELECT application_id, agent_type, CAST(cost AS DOUBLE) AS cost_usd, n AS tokens_input, gpos AS global_position FROM calls WHERE cost > 0 ORDER BY cost DESC, gpos LIMIT 1""",
)
def dearest_call(spark, folder):
    d = costs.dearest_call(stored.session_ledger(spark, folder))
    return d.select("application_id", "agent_type", as_double("cost_usd"), "tokens_input", "global_position")


@query(
    "usage_normalised",
    r"""WITH r AS (SELECT conv_id, turn, text, length(text) AS n FROM conversations)
    SELECT conv_id, turn, 'm' || (n % 3) AS model,
      md5(CASE WHEN n % 2 = 0 THEN regexp_replace(text, '^\s+|\s+$', '', 'g') ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') || chr(10) || 'end' END) AS text_md5,
      n AS tokens_input, n % 11 AS tokens_output, CASE WHEN n % 3 = 0 THEN n / 1000.0 ELSE n / 500.0 END AS cost_usd
    FROM r""",
)
def usage_normalised(spark, folder):
    """Raw responses rendered from every conversation turn in four shapes, then read back."""
    n, text = F.length("text"), F.col("text")
    part = F.struct(F.lit("text").alias("type"), text.alias("text"))
    end = F.struct(F.lit("text").alias("type"), F.lit(" end ").alias("text"))
    picture = F.struct(F.lit("image").alias("type"), F.lit("x").alias("text"))

    def response(content):
        usage = F.struct(
            F.when(n % 2 == 0, n).alias("prompt_tokens"), F.when(n % 2 == 1, n).alias("input_tokens"),
            F.when(n % 5 != 0, n % 11).alias("completion_tokens"), F.when(n % 5 == 0, n % 11).alias("output_tokens"),
            F.when(n % 3 == 0, n / 1000.0).alias("cost"),
            F.when(n % 3 != 0, F.struct((n / 1000.0).alias("prompt"), (n / 1000.0).alias("completion"))).alias("cost_details"),
        )
        choice = F.struct(F.struct(content.alias("content")).alias("message"))
        return F.to_json(F.struct(F.concat(F.lit("m"), (n % 3).cast("string")).alias("model"), F.array(choice).alias("choices"), usage.alias("usage")))

    raw = F.when(n % 2 == 0, response(text)).otherwise(response(F.array(part, picture, end)))
    responses = adapters.table(spark, folder, "conversations").select("conv_id", "turn", raw.alias("raw"))
    u = costs.normalise_usage(responses)
    return u.select("conv_id", "turn", "model", F.md5("text").alias("text_md5"), "tokens_input", "tokens_output", "cost_usd")
