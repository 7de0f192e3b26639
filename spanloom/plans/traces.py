"""Trace listings and span reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.operators import graphs, identity, listing
from spanloom.operators.attributes import FRAMEWORK_KEYS, SIDECAR_KEYS, exchange_kinds, sidecar_spans, split_blocked, with_facts
from spanloom.operators.hierarchy import nearest_ancestor
from spanloom.operators.interactions import self_kinds, sidecar_rows
from spanloom.plans import problems
from spanloom.sources.tables import table

START, END = "2018-03-06 00:00:00", "2018-03-12 00:00:00"
SLIM = ["trace_id", "span_id", "parent_id", "arrival_seq", "started_at", "ended_at", "observed_at", "name", "service_name", "kind", "error", "seq"]


def _spans(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "spans")


def _final(spark: SparkSession, base: str) -> DataFrame:
    return listing.finalized(_spans(spark, base).select(*SLIM))


def trace_listing(spark: SparkSession, base: str) -> DataFrame:
    return listing.trace_listing(_spans(spark, base), START, END, limit=50)


def trace_listing_next(spark: SparkSession, base: str) -> DataFrame:
    return listing.trace_listing(_spans(spark, base), START, END, limit=50, after=("2018-03-10 00:00:00", "8000000000000000"))


def single_trace_root(spark: SparkSession, base: str) -> DataFrame:
    """Of each trace the earliest of its roots and orphans, whichever it is."""
    rank = Window.partitionBy("trace_id").orderBy("started_at", "span_id")
    roots = listing.root_candidates(_final(spark, base)).withColumn("rn", F.row_number().over(rank)).where("rn = 1")
    return roots.select("trace_id", "span_id", "rank_class")


def orphans(spark: SparkSession, base: str) -> DataFrame:
    return listing.root_candidates(_final(spark, base)).where("rank_class = 1").select("trace_id", "span_id", "parent_id")


def span_page(spark: SparkSession, base: str) -> DataFrame:
    rows = _final(spark, base).where((F.col("seq") > 1000) & listing.in_window(START, END))
    return rows.orderBy("seq").limit(500).select("seq", "trace_id", "span_id", "name")


def span_children(spark: SparkSession, base: str) -> DataFrame:
    return _final(spark, base).where(F.col("parent_id").isNotNull()).groupBy("trace_id", "parent_id").agg(F.count("*").alias("n_children"), F.min("started_at").alias("first_at"), F.max("started_at").alias("last_at"))


def trace_counts(spark: SparkSession, base: str) -> DataFrame:
    return listing.trace_counts(_final(spark, base), START, END)


def span_outcomes(spark: SparkSession, base: str) -> DataFrame:
    return listing.delivery_outcomes(_spans(spark, base))


def spans_finalized(spark: SparkSession, base: str) -> DataFrame:
    return _final(spark, base).select("trace_id", "span_id", "arrival_seq", "seq", "ended_at", "error", "service_name", (F.col("seq") != F.col("arrival_seq")).alias("was_finalized"))


def blocked_tally(spark: SparkSession, base: str) -> DataFrame:
    return split_blocked(_spans(spark, base))[1]


def service_activity(spark: SparkSession, base: str) -> DataFrame:
    d = (F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1e6
    return _final(spark, base).groupBy("service_name", "kind").agg(F.count("*").alias("n_spans"), F.count_if("error").alias("n_errors"), F.count_if(F.col("ended_at").isNull()).alias("n_open"), F.max(d).alias("longest_s"))


def cross_service_calls(spark: SparkSession, base: str) -> DataFrame:
    return graphs.cross_service(_spans(spark, base))


def span_colours(spark: SparkSession, base: str) -> DataFrame:
    return graphs.coloured(_spans(spark, base)).groupBy("colour", "entity_key").agg(F.count("*").alias("n_spans"))


def entity_calls(spark: SparkSession, base: str) -> DataFrame:
    return graphs.entity_edges(_spans(spark, base))


def span_components(spark: SparkSession, base: str) -> DataFrame:
    return graphs.components(_spans(spark, base))


def sidecar_facts(spark: SparkSession, base: str) -> DataFrame:
    return with_facts(_spans(spark, base), SIDECAR_KEYS).groupBy("role", "direction", "protocol", "outcome").agg(F.count("*").alias("n_spans"), F.count_distinct("self_id").alias("n_pods"), F.count("principal_sub").alias("n_with_principal"))


def framework_facts(spark: SparkSession, base: str) -> DataFrame:
    return with_facts(_spans(spark, base), FRAMEWORK_KEYS).groupBy("oi_kind", "llm_model").agg(F.count("*").alias("n_spans"), F.count_distinct("tool_name").alias("n_tools"), F.count_distinct("agent_name").alias("n_agents"))


def exchange_kind_counts(spark: SparkSession, base: str) -> DataFrame:
    rows = exchange_kinds(sidecar_spans(sidecar_rows(_spans(spark, base))))
    return rows.where("role = 'request' and not violation").groupBy("direction", "protocol", "caller_kind", "callee_kind", "request_kind").agg(F.count("*").alias("n"))


def pod_kinds(spark: SparkSession, base: str) -> DataFrame:
    rows = exchange_kinds(sidecar_spans(sidecar_rows(_spans(spark, base))))
    return self_kinds(rows.where("role = 'request' and not violation"))


def exchange_pairs(spark: SparkSession, base: str) -> DataFrame:
    """Requests with their response by exchange id."""
    rows = sidecar_spans(sidecar_rows(_spans(spark, base))).where("not violation")
    ask = rows.where("role = 'request'").select("trace_id", "exchange_id", "span_id", "direction", "protocol")
    reply = rows.where("role = 'response'").groupBy("trace_id", "exchange_id").agg(F.count("*").alias("n_responses"), F.max("outcome").alias("outcome"))
    return ask.join(reply, ["trace_id", "exchange_id"], "left").groupBy("direction", "protocol", "outcome").agg(F.count("*").alias("n_requests"), F.count("n_responses").alias("n_answered"))


def nearest_server(spark: SparkSession, base: str) -> DataFrame:
    """Of each span the nearest server span above it."""
    return nearest_ancestor(_final(spark, base).withColumn("hit", F.col("kind") == "SERVER"), "hit")


def root_callers(spark: SparkSession, base: str) -> DataFrame:
    return identity.root_callers(_spans(spark, base))


def tool_transport(spark: SparkSession, base: str) -> DataFrame:
    return identity.tool_transport(_spans(spark, base))


def external_calls(spark: SparkSession, base: str) -> DataFrame:
    return identity.external_calls(_spans(spark, base))


def model_messages(spark: SparkSession, base: str) -> DataFrame:
    return identity.messages(_spans(spark, base))


def inferred_tool_calls(spark: SparkSession, base: str) -> DataFrame:
    return identity.inferred_tool_calls(_spans(spark, base))


def tunnel_traces(spark: SparkSession, base: str) -> DataFrame:
    return identity.tunnel_traces(_spans(spark, base))


QUERIES = {
    f.__name__: f
    for f in (
        trace_listing, trace_listing_next, single_trace_root, orphans, span_page, span_children, trace_counts, span_outcomes, spans_finalized, blocked_tally, service_activity, cross_service_calls,
        span_colours, entity_calls, span_components, sidecar_facts, framework_facts, exchange_kind_counts, pod_kinds, exchange_pairs, nearest_server,
        root_callers, tool_transport, external_calls, model_messages, inferred_tool_calls, tunnel_traces,
    )
}

NORMAL = "nullif(regexp_replace(lower({0}), '[^0-9a-f]', '', 'g'), '')"
FINAL = f"""
    ids AS (SELECT * REPLACE ({NORMAL.format('trace_id')} AS trace_id, {NORMAL.format('span_id')} AS span_id, {NORMAL.format('parent_id')} AS parent_id) FROM spans),
    firsts AS (SELECT trace_id, span_id, parent_id, service_name, started_at, observed_at, arrival_seq FROM ids QUALIFY row_number() OVER (PARTITION BY trace_id, span_id ORDER BY arrival_seq) = 1),
    ends AS (SELECT trace_id, span_id, seq, name, kind, scope, ended_at, error, attributes FROM ids QUALIFY row_number() OVER (PARTITION BY trace_id, span_id ORDER BY ended_at IS NULL, arrival_seq) = 1),
    final AS (SELECT * FROM firsts JOIN ends USING (trace_id, span_id)),
    cand AS (
        SELECT f.*, CASE WHEN f.parent_id IS NULL THEN 0 ELSE 1 END AS rank_class FROM final f
        WHERE f.parent_id IS NULL OR NOT EXISTS (SELECT 1 FROM firsts p WHERE p.trace_id = f.trace_id AND p.span_id = f.parent_id)
    )
"""
_INSIDE = f"started_at >= TIMESTAMP '{START}' AND started_at <= TIMESTAMP '{END}'"
_LISTING = f"""WITH {FINAL},
    roots AS (SELECT * FROM cand WHERE trace_id IN (SELECT trace_id FROM final WHERE {_INSIDE}) QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY rank_class, started_at, span_id) = 1),
    counts AS (SELECT trace_id, count(*) AS n_spans, count(*) FILTER ({_INSIDE}) AS n_in_window, count(*) FILTER (error) AS n_errors FROM final GROUP BY trace_id)
    SELECT trace_id, span_id, name, service_name, started_at, ended_at, error, rank_class = 1 AS is_orphan, {_INSIDE} AS root_in_window, n_spans, n_in_window, n_errors
    FROM roots JOIN counts USING (trace_id) {{after}} ORDER BY started_at DESC, span_id LIMIT 50"""


def _fact(key: str, of: str = "a") -> str:
    return f"json_extract_string({of}, '$.\"{key}\"')"


FACTS = "facts AS (SELECT *, CASE WHEN json_valid(attributes) THEN attributes END AS a FROM {0})"
_SIDE = f"""WITH {FINAL}, {FACTS.format('final')},
    side AS (
        SELECT trace_id, span_id, arrival_seq, lower({_fact('lineage.role')}) AS role, lower({_fact('lineage.direction')}) AS direction, lower({_fact('lineage.protocol')}) AS protocol,
               {NORMAL.format(_fact('lineage.exchange.id'))} AS exchange_id, {_fact('lineage.self.id')} AS self_id, {_fact('lineage.self.namespace')} AS self_namespace,
               coalesce({_fact('lineage.principal.sub')}, '') AS sub, {_fact('lineage.outcome')} AS outcome, coalesce({_fact('mcp.method')}, '') AS m, coalesce({_fact('url.path')}, '') AS path, {_fact('input.value')} AS input
        FROM facts
    ),
    good AS (
        SELECT * FROM side WHERE exchange_id IS NOT NULL AND role IN ('request', 'response') AND direction IN ('inbound', 'outbound') AND protocol IN ('a2a', 'mcp', 'inference', 'http')
        AND (role <> 'request' OR exchange_id = span_id)
    ),
    kinds AS (
        SELECT *, CASE WHEN direction = 'inbound' THEN CASE WHEN sub = '' THEN 'client' ELSE 'user' END ELSE 'agent' END AS caller_kind,
               CASE protocol WHEN 'a2a' THEN 'agent' WHEN 'mcp' THEN 'tool' WHEN 'inference' THEN 'llm' ELSE CASE direction WHEN 'inbound' THEN 'agent' ELSE 'service' END END AS callee_kind,
               CASE WHEN (protocol = 'mcp' AND (m IN ('initialize', 'ping') OR m LIKE 'notifications/%' OR m LIKE 'logging/%' OR m LIKE '$transport/%')) OR (protocol = 'http' AND path IN ('/mcp', '/sse') AND input IS NULL) THEN 'mcp_lifecycle_request'
                    WHEN protocol = 'mcp' AND m IN ('tools/list', 'resources/list', 'prompts/list', 'resources/templates/list') THEN 'tool_discovery_request'
                    ELSE CASE protocol WHEN 'a2a' THEN 'agent_request' WHEN 'mcp' THEN 'tool_call_arguments' WHEN 'inference' THEN 'llm_chat_prompt' ELSE 'http_request_body' END END AS request_kind
        FROM good WHERE role = 'request'
    )"""
_COLOURS = f"""WITH RECURSIVE {FINAL}, {FACTS.format('final')},
    col AS (
        SELECT trace_id, span_id, parent_id, name, service_name, started_at, error, lower({_fact('openinference.span.kind')}) AS k, coalesce(scope.name, '') AS sc, {_fact('llm.model_name')} AS model, {_fact('tool.name')} AS tool, {_fact('agent.name')} AS agent FROM facts
    ),
    tinted AS (SELECT *, sc LIKE 'openinference.instrumentation%' OR k IS NOT NULL AS blue, sc LIKE 'opentelemetry.instrumentation%' AND k IS NULL AS teal FROM col),
    keyed AS (
        SELECT *, CASE WHEN k = 'llm' THEN 'llm:' || coalesce(regexp_replace(model, '^[^/]*/', ''), '(unknown)') WHEN k = 'tool' THEN 'tool:' || coalesce(tool, name)
               WHEN blue THEN 'agent:' || coalesce(agent, service_name, '(unknown)') END AS entity_key
        FROM tinted
    )"""
_NEAR = """,
    marks AS ({marks}),
    up AS (
        SELECT m.trace_id, m.span_id, p.span_id AS anc, p.hit, p.parent_id AS nxt, 1 AS d FROM marks m JOIN marks p ON p.trace_id = m.trace_id AND p.span_id = m.parent_id
        UNION ALL
        SELECT u.trace_id, u.span_id, p.span_id, p.hit, p.parent_id, u.d + 1 FROM up u JOIN marks p ON p.trace_id = u.trace_id AND p.span_id = u.nxt WHERE NOT u.hit AND u.d < 400
    ),
    near AS (SELECT trace_id, span_id, anc AS ancestor FROM up WHERE hit)"""

def near_sql(name: str, marks: str) -> str:
    """Recursive CTEs for the nearest marked span above each span; ``marks`` gives trace_id, span_id, parent_id, hit."""
    return f"""{name}marks AS ({marks}),
    {name}up AS (
        SELECT m.trace_id, m.span_id, p.span_id AS anc, p.hit, p.parent_id AS nxt, 1 AS d FROM {name}marks m JOIN {name}marks p ON p.trace_id = m.trace_id AND p.span_id = m.parent_id
        UNION ALL
        SELECT u.trace_id, u.span_id, p.span_id, p.hit, p.parent_id, u.d + 1 FROM {name}up u JOIN {name}marks p ON p.trace_id = u.trace_id AND p.span_id = u.nxt WHERE NOT u.hit AND u.d < 400
    ),
    {name} AS (SELECT trace_id, span_id, anc AS ancestor FROM {name}up WHERE hit)"""


#: CTEs up to ``kinds``: exchange spans that keep the contract, with their facts and kinds.
SIDECAR_SQL = f"""{FINAL}, {FACTS.format('final')},
    side AS (
        SELECT trace_id, span_id, parent_id, arrival_seq, started_at, ended_at, error, lower({_fact('lineage.role')}) AS role, lower({_fact('lineage.direction')}) AS direction, lower({_fact('lineage.protocol')}) AS protocol,
               {NORMAL.format(_fact('lineage.exchange.id'))} AS exchange_id, {_fact('lineage.self.id')} AS self_id, {_fact('lineage.self.namespace')} AS self_namespace, {_fact('lineage.peer.host')} AS peer, {_fact('lineage.principal.sub')} AS sub,
               {_fact('lineage.principal.client')} AS client, {_fact('lineage.outcome')} AS outcome, {_fact('inference.model')} AS model, coalesce({_fact('mcp.method')}, '') AS m, coalesce({_fact('url.path')}, '') AS path,
               {_fact('input.value')} AS input, {_fact('output.value')} AS output
        FROM facts
    ),
    good AS (
        SELECT *, concat_ws('/', nullif(self_namespace, ''), self_id) AS pod, (protocol = 'mcp' AND (m IN ('initialize', 'ping') OR m LIKE 'notifications/%' OR m LIKE 'logging/%' OR m LIKE '$transport/%')) OR (protocol = 'http' AND path IN ('/mcp', '/sse') AND input IS NULL) AS plumbing,
               protocol = 'mcp' AND m IN ('tools/list', 'resources/list', 'prompts/list', 'resources/templates/list') AS discovery
        FROM side WHERE exchange_id IS NOT NULL AND role IN ('request', 'response') AND direction IN ('inbound', 'outbound') AND protocol IN ('a2a', 'mcp', 'inference', 'http') AND (role <> 'request' OR exchange_id = span_id)
    ),
    kinds AS (
        SELECT *, CASE WHEN direction = 'inbound' THEN CASE WHEN coalesce(sub, '') = '' THEN 'client' ELSE 'user' END ELSE 'agent' END AS caller_kind,
               CASE protocol WHEN 'a2a' THEN 'agent' WHEN 'mcp' THEN 'tool' WHEN 'inference' THEN 'llm' ELSE CASE direction WHEN 'inbound' THEN 'agent' ELSE 'service' END END AS callee_kind,
               CASE WHEN plumbing THEN 'mcp_lifecycle_request' WHEN discovery THEN 'tool_discovery_request' ELSE CASE protocol WHEN 'a2a' THEN 'agent_request' WHEN 'mcp' THEN 'tool_call_arguments' WHEN 'inference' THEN 'llm_chat_prompt' ELSE 'http_request_body' END END AS request_kind,
               CASE WHEN plumbing THEN 'mcp_lifecycle_result' WHEN discovery THEN 'tool_discovery_result' ELSE CASE protocol WHEN 'a2a' THEN 'agent_response' WHEN 'mcp' THEN 'tool_call_result' WHEN 'inference' THEN 'llm_completion' ELSE 'http_response_body' END END AS response_kind
        FROM good
    )"""

SQL = {
    "span_components": _COLOURS + """,
        n AS (SELECT trace_id, span_id, parent_id FROM keyed WHERE NOT teal),
        tree AS (SELECT a.trace_id AS t, a.span_id AS s, b.span_id AS p FROM n a LEFT JOIN n b ON b.trace_id = a.trace_id AND b.span_id = a.parent_id),""" + problems.WALK_SQL + """
        SELECT t AS trace_id, s AS span_id, CASE WHEN up IS NULL THEN cur ELSE list_min(seen[list_position(seen, up):]) END AS component, CASE WHEN up IS NULL THEN d WHEN list_position(seen, up) = 1 THEN -1 ELSE -2 END AS depth FROM ends_of_walk""",
    "model_messages": f"""WITH RECURSIVE {problems.VALUES_SQL},
        msgs AS (SELECT arrival_seq, path, string_split(path, '.') AS seg FROM elements WHERE regexp_full_match(path, 'attributes\\.llm\\.(input|output)_messages\\.[0-9]+')),
        calls AS (
            SELECT arrival_seq, path[:cut] AS message, count(*) AS n FROM elements JOIN above USING (arrival_seq, path)
            WHERE regexp_full_match(path, 'attributes\\.llm\\.(input|output)_messages\\.[0-9]+\\.message\\.tool_calls\\.[0-9]+') GROUP BY 1, 2)
        SELECT m.arrival_seq, replace(seg[3], '_messages', '') AS side, CAST(seg[4] AS INTEGER) AS position, r.leaf ->> '$' AS role, c.leaf ->> '$' AS content, coalesce(n, 0) AS n_tool_calls
        FROM msgs m LEFT JOIN fields r ON r.arrival_seq = m.arrival_seq AND r.path = m.path AND r.field = 'message.role' LEFT JOIN fields c ON c.arrival_seq = m.arrival_seq AND c.path = m.path AND c.field = 'message.content'
        LEFT JOIN calls k ON k.arrival_seq = m.arrival_seq AND k.message = m.path""",
    "inferred_tool_calls": f"""WITH RECURSIVE {problems.VALUES_SQL}, {FINAL.replace('ends AS', 'finals AS').replace('JOIN ends', 'JOIN finals').replace('seq, name', 'arrival_seq AS body_seq, seq, name')}, {FACTS.format('final')},
        asked AS (
            SELECT f.trace_id, v.leaf ->> '$' AS tool, count(*) AS n_asked FROM elements e JOIN final f ON f.body_seq = e.arrival_seq LEFT JOIN fields v ON v.arrival_seq = e.arrival_seq AND v.path = e.path AND v.field = 'tool_call.function.name'
            WHERE regexp_full_match(e.path, 'attributes\\.llm\\.output_messages\\.[0-9]+\\.message\\.tool_calls\\.[0-9]+') GROUP BY 1, 2),
        told AS (SELECT trace_id, coalesce({_fact('tool.name')}, name) AS tool, count(*) AS n_seen FROM facts WHERE lower({_fact('openinference.span.kind')}) = 'tool' GROUP BY 1, 2)
        SELECT trace_id, tool, n_asked, coalesce(n_seen, 0) AS n_seen FROM asked LEFT JOIN told USING (trace_id, tool) WHERE n_asked > coalesce(n_seen, 0)""",
    "trace_listing": _LISTING.format(after=""),
    "trace_listing_next": _LISTING.format(after="WHERE started_at < TIMESTAMP '2018-03-10 00:00:00' OR (started_at = TIMESTAMP '2018-03-10 00:00:00' AND span_id > '8000000000000000')"),
    "single_trace_root": f"WITH {FINAL} SELECT trace_id, span_id, rank_class FROM cand QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY started_at, span_id) = 1",
    "orphans": f"WITH {FINAL} SELECT trace_id, span_id, parent_id FROM cand WHERE rank_class = 1",
    "span_page": f"WITH {FINAL} SELECT seq, trace_id, span_id, name FROM final WHERE seq > 1000 AND {_INSIDE} ORDER BY seq LIMIT 500",
    "span_children": f"WITH {FINAL} SELECT trace_id, parent_id, count(*) AS n_children, min(started_at) AS first_at, max(started_at) AS last_at FROM final WHERE parent_id IS NOT NULL GROUP BY trace_id, parent_id",
    "trace_counts": f"WITH {FINAL} SELECT trace_id, count(*) AS n_spans, count(*) FILTER ({_INSIDE}) AS n_in_window, count(*) FILTER (error) AS n_errors FROM final GROUP BY trace_id",
    "span_outcomes": f"""WITH {FINAL}
        SELECT arrival_seq, CASE WHEN row_number() OVER w = 1 THEN 'inserted' WHEN ended_at IS NOT NULL AND NOT coalesce(bool_or(ended_at IS NOT NULL) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 'finalized' ELSE 'duplicate' END AS outcome
        FROM ids WINDOW w AS (PARTITION BY trace_id, span_id ORDER BY arrival_seq)""",
    "spans_finalized": f"WITH {FINAL} SELECT trace_id, span_id, arrival_seq, seq, ended_at, error, service_name, seq <> arrival_seq AS was_finalized FROM final",
    "blocked_tally": r"""WITH p AS (SELECT unnest(['(GET|POST) /healthz.*', 'GET /readyz', 'GET /livez', '/healthz', '/readyz', '/livez', 'GET /metrics', '/metrics', 'GET /\.well-known/agent-card\.json',
            'GET /\.well-known/agent-card\.json http send', 'GET /\.well-known/agent-card\.json http receive', 'otlp_receiver/.*']) AS pattern, unnest(range(12)) AS n),
        m AS (SELECT arrival_seq, observed_at, arg_min(pattern, n) AS pattern FROM spans JOIN p ON regexp_full_match(name, pattern) GROUP BY arrival_seq, observed_at)
        SELECT pattern, count(*) AS n_spans, max(observed_at) AS last_seen_at FROM m GROUP BY pattern""",
    "service_activity": f"""WITH {FINAL} SELECT service_name, kind, count(*) AS n_spans, count(*) FILTER (error) AS n_errors, count(*) FILTER (ended_at IS NULL) AS n_open,
        max((epoch_us(ended_at) - epoch_us(started_at)) / 1e6) AS longest_s FROM final GROUP BY service_name, kind""",
    "cross_service_calls": f"""WITH {FINAL} SELECT p.service_name AS caller_service, f.service_name AS callee_service, count(*) AS n_calls, count(*) FILTER (f.error) AS n_errors
        FROM final f JOIN firsts p ON p.trace_id = f.trace_id AND p.span_id = f.parent_id WHERE f.kind = 'SERVER' AND p.service_name <> f.service_name GROUP BY 1, 2""",
    "span_colours": f"{_COLOURS} SELECT CASE WHEN blue THEN 'blue' WHEN teal THEN 'teal' ELSE 'white' END AS colour, entity_key, count(*) AS n_spans FROM keyed GROUP BY 1, 2",
    "entity_calls": _COLOURS + _NEAR.format(marks="SELECT trace_id, span_id, parent_id, blue AS hit FROM keyed") + """
        SELECT p.entity_key AS caller_key, c.entity_key AS callee_key, count(*) AS n_calls, count(DISTINCT c.trace_id) AS n_traces, count(*) FILTER (c.error) AS n_errors, min(c.started_at) AS first_at, max(c.started_at) AS last_at
        FROM near n JOIN keyed c USING (trace_id, span_id) JOIN keyed p ON p.trace_id = n.trace_id AND p.span_id = n.ancestor WHERE c.blue AND p.entity_key <> c.entity_key GROUP BY 1, 2""",
    "sidecar_facts": f"""WITH {FACTS.format('spans')} SELECT {_fact('lineage.role')} AS role, {_fact('lineage.direction')} AS direction, {_fact('lineage.protocol')} AS protocol, {_fact('lineage.outcome')} AS outcome,
        count(*) AS n_spans, count(DISTINCT {_fact('lineage.self.id')}) AS n_pods, count({_fact('lineage.principal.sub')}) AS n_with_principal FROM facts GROUP BY 1, 2, 3, 4""",
    "framework_facts": f"""WITH {FACTS.format('spans')} SELECT {_fact('openinference.span.kind')} AS oi_kind, {_fact('llm.model_name')} AS llm_model, count(*) AS n_spans,
        count(DISTINCT {_fact('tool.name')}) AS n_tools, count(DISTINCT {_fact('agent.name')}) AS n_agents FROM facts GROUP BY 1, 2""",
    "exchange_kind_counts": f"{_SIDE} SELECT direction, protocol, caller_kind, callee_kind, request_kind, count(*) AS n FROM kinds GROUP BY ALL",
    "pod_kinds": f"""{_SIDE}, pods AS (
            SELECT trace_id, concat_ws('/', nullif(self_namespace, ''), self_id) AS pod, count(DISTINCT callee_kind) FILTER (direction = 'inbound') AS n, any_value(callee_kind) FILTER (direction = 'inbound') AS one,
                   bool_or(direction = 'outbound' AND protocol IN ('a2a', 'mcp')) AS chatty
            FROM kinds WHERE self_id IS NOT NULL GROUP BY 1, 2)
        SELECT trace_id, pod, CASE WHEN n = 1 THEN one WHEN n > 1 OR chatty THEN 'agent' END AS voted FROM pods""",
    "exchange_pairs": f"""{_SIDE}, reply AS (SELECT trace_id, exchange_id, count(*) AS n_responses, max(outcome) AS outcome FROM good WHERE role = 'response' GROUP BY 1, 2)
        SELECT direction, protocol, r.outcome, count(*) AS n_requests, count(n_responses) AS n_answered FROM kinds k LEFT JOIN reply r ON r.trace_id = k.trace_id AND r.exchange_id = k.exchange_id GROUP BY 1, 2, 3""",
    "nearest_server": f"WITH RECURSIVE {FINAL}" + _NEAR.format(marks="SELECT trace_id, span_id, parent_id, coalesce(kind = 'SERVER', false) AS hit FROM final") + """
        SELECT m.trace_id, m.span_id, n.ancestor FROM marks m LEFT JOIN near n USING (trace_id, span_id)""",
    "root_callers": f"""WITH {FINAL}, {FACTS.format('cand')},
        f AS (SELECT trace_id, span_id, service_name, coalesce({_fact('lineage.principal.sub')}, {_fact('enduser.id')}) AS u, coalesce({_fact('peer.service')}, {_fact('client.address')}, {_fact('net.peer.name')}, {_fact('net.peer.ip')}) AS c FROM facts WHERE kind = 'SERVER')
        SELECT trace_id, span_id, service_name, CASE WHEN u IS NOT NULL THEN 'user' WHEN c IS NOT NULL THEN 'client' ELSE 'provisional' END AS caller_kind, coalesce(u, c) AS caller FROM f""",
    "tool_transport": f"WITH RECURSIVE {FINAL}, {FACTS.format('final')}, t AS (SELECT *, coalesce(lower({_fact('openinference.span.kind')}) = 'tool', false) AS tool FROM facts)" + _NEAR.format(marks="SELECT trace_id, span_id, parent_id, tool AS hit FROM t") + """,
        seen AS (SELECT n.trace_id, n.ancestor AS span_id, bool_or(s.name LIKE 'POST /mcp%') AS mcp, bool_or(s.service_name IS DISTINCT FROM o.service_name) AS other
            FROM near n JOIN t s USING (trace_id, span_id) JOIN t o ON o.trace_id = n.trace_id AND o.span_id = n.ancestor WHERE s.kind = 'SERVER' GROUP BY 1, 2)
        SELECT t.trace_id, t.span_id, t.name, CASE WHEN mcp THEN 'deployed' WHEN other THEN 'in_process' ELSE 'undecided' END AS transport FROM t LEFT JOIN seen USING (trace_id, span_id) WHERE tool""",
    "external_calls": f"""WITH {FINAL}, {FACTS.format('final')},
        u AS (SELECT trace_id, span_id, service_name, name, kind, {_fact('http.url')} AS url, TRY_CAST({_fact('http.status_code')} AS INTEGER) AS status_code FROM facts),
        h AS (SELECT *, lower(regexp_extract(url, '^[a-z]+://([^/:?#@]+)(:[0-9]+)?([/?#]|$)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM u)
        SELECT trace_id, span_id, service_name, host, status_code FROM h
        WHERE kind = 'CLIENT' AND host LIKE '%.%' AND host NOT LIKE '%.svc' AND host NOT LIKE '%.cluster.local' AND path NOT IN ('/healthz', '/readyz', '/livez', '/metrics') AND path NOT LIKE '/mcp%' AND path NOT LIKE '/.well-known/%' AND name <> 'POST /'
          AND NOT EXISTS (SELECT 1 FROM final s WHERE s.kind = 'SERVER' AND s.trace_id = h.trace_id AND s.parent_id = h.span_id)""",
    "tunnel_traces": f"""WITH {FINAL}, {FACTS.format('final')},
        p AS (SELECT trace_id, bool_and({_fact('lineage.exchange.id')} IS NOT NULL) AS a, count(DISTINCT {NORMAL.format(_fact('lineage.exchange.id'))}) AS n, arg_min({_fact('http.method')}, (parent_id IS NOT NULL, started_at, span_id)) AS m, count(*) AS n_spans FROM facts GROUP BY 1)
        SELECT trace_id, n_spans FROM p WHERE a AND n = 1 AND upper(m) = 'CONNECT'""",
}
