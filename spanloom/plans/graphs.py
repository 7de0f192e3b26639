"""Registered queries over the span graph and the order of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import graphs, nested
from spanloom.operators.attributes import FRAMEWORK_KEYS
from spanloom.operators.hierarchy import ordinals
from spanloom.operators.listing import NARROW, finalized, finalized_facts
from spanloom.plans import interactions as plans
from spanloom.plans import problems, traces
from spanloom.sources.tables import table


def span_ordinals(spark: SparkSession, base: str) -> DataFrame:
    """Each trace's tour: when each span opens and closes."""
    return ordinals(finalized(table(spark, base, "spans").select(*NARROW)), ["started_at"])


def leg_pairs(spark: SparkSession, base: str) -> DataFrame:
    """Responses matched with requests of the same two entities as a stack, in causal order."""
    i = table(spark, base, "interactions").select(F.col("id").alias("interaction_id"), "trace_id", "caller_entity_id", "callee_entity_id")
    rows = plans.causal_order(spark, base).join(i, ["trace_id", "interaction_id"])
    return graphs.stack_pairs(rows, ["trace_id", "caller_entity_id", "callee_entity_id"], "position", F.col("leg_type") == "request").select("trace_id", "position", "opened_by", "level")


def boundary_peers(spark: SparkSession, base: str) -> DataFrame:
    return graphs.boundary_peers(table(spark, base, "spans"))


def merged_calls(spark: SparkSession, base: str) -> DataFrame:
    """Tool calls in the output of models against tool spans, by trace and tool."""
    spans = table(spark, base, "spans")
    rows = finalized_facts(spans, {"oi_kind": "openinference.span.kind", "tool": "tool.name"}, F.col("arrival_seq").alias("body_seq"))
    nodes = nested.flatten(spans, "arrival_seq", ["attributes"], [], fields=True).where(F.col("schema_path") == "attributes.llm.output_messages.*.message.tool_calls.*")
    calls = nodes.select(F.col("arrival_seq").alias("body_seq"), F.get_json_object("fields", "$['tool_call.function.name']").alias("tool"), "path")
    asked = calls.join(rows.select("body_seq", "trace_id"), "body_seq").select("trace_id", "tool", F.struct("body_seq", "path").alias("at"))
    seen = rows.where(F.lower("oi_kind") == "tool").select("trace_id", F.coalesce("tool", "name").alias("tool"), F.struct("arrival_seq").alias("at"))
    return graphs.merged_calls(asked, seen).select("trace_id", "tool", "n", "state", F.col("asked_at.body_seq").alias("asked_in"), F.col("seen_at.arrival_seq").alias("seen_in"))


def combined_entities(spark: SparkSession, base: str) -> DataFrame:
    """Entities of the graph by typed key and instrumentation scope, over all traces."""
    rows = finalized_facts(table(spark, base, "spans"), FRAMEWORK_KEYS, F.col("scope.name").alias("scope_name"))
    keyed = graphs.coloured(table(spark, base, "spans")).where("entity_key is not null").select("trace_id", "span_id", "entity_key")
    return keyed.join(rows.select("trace_id", "span_id", "scope_name"), ["trace_id", "span_id"]).groupBy("entity_key", "scope_name").agg(F.count("*").alias("n_spans"), F.count_distinct("trace_id").alias("n_traces"))


def transport_chains(spark: SparkSession, base: str) -> DataFrame:
    return graphs.transport_chains(table(spark, base, "spans"))


QUERIES = {f.__name__: f for f in (span_ordinals, leg_pairs, boundary_peers, merged_calls, combined_entities, transport_chains)}

_F = traces._fact
SQL = {
    "span_ordinals": f"""WITH RECURSIVE {traces.FINAL},
        tree AS (SELECT a.trace_id, a.span_id, b.span_id AS p, row_number() OVER (PARTITION BY a.trace_id ORDER BY a.started_at NULLS FIRST, a.span_id) AS n FROM final a LEFT JOIN final b ON b.trace_id = a.trace_id AND b.span_id = a.parent_id),
        tour AS (SELECT trace_id, span_id, [n] AS path FROM tree WHERE p IS NULL UNION ALL SELECT t.trace_id, t.span_id, list_append(u.path, t.n) FROM tree t JOIN tour u ON u.trace_id = t.trace_id AND u.span_id = t.p),
        moments AS (SELECT trace_id, span_id, path, true AS opens FROM tour UNION ALL SELECT trace_id, span_id, list_append(path, 4611686018427387904), false FROM tour),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY path) AS place FROM moments)
        SELECT trace_id, span_id, max(place) FILTER (opens) AS opening, max(place) FILTER (NOT opens) AS closing FROM numbered GROUP BY 1, 2""",
    "leg_pairs": f"""WITH RECURSIVE {plans._ORDER},
        e AS (SELECT o.trace_id, caller_entity_id AS a, callee_entity_id AS b, position, leg_type = 'request' AS opens, row_number() OVER (PARTITION BY o.trace_id, caller_entity_id, callee_entity_id ORDER BY position) AS n FROM ordered o JOIN interactions i ON i.id = o.interaction_id),
        stack AS (
            SELECT trace_id, a, b, CAST(0 AS BIGINT) AS n, CAST([] AS INTEGER[]) AS open_, CAST(NULL AS INTEGER) AS position, CAST(NULL AS INTEGER) AS opened_by, CAST(NULL AS BIGINT) AS level FROM (SELECT DISTINCT trace_id, a, b FROM e)
            UNION ALL
            SELECT e.trace_id, e.a, e.b, e.n, CASE WHEN opens THEN list_append(s.open_, e.position) ELSE s.open_[:-2] END, e.position, CASE WHEN NOT opens THEN s.open_[-1] END, CASE WHEN NOT opens THEN len(s.open_) END
            FROM stack s JOIN e ON e.trace_id = s.trace_id AND e.a IS NOT DISTINCT FROM s.a AND e.b IS NOT DISTINCT FROM s.b AND e.n = s.n + 1
        )
        SELECT trace_id, position, opened_by, level FROM stack WHERE opened_by IS NOT NULL""",
    "boundary_peers": f"""WITH {traces.FINAL}, {traces.FACTS.format('final')},
        f AS (SELECT trace_id, span_id, parent_id, kind, coalesce({_F('peer.service')}, {_F('server.address')}, {_F('net.peer.name')}, nullif(lower(regexp_extract({_F('http.url')}, '^[a-z]+://([^/:?#@]+)(:[0-9]+)?([/?#]|$)', 1)), ''), '(unknown)') AS peer FROM facts)
        SELECT trace_id, span_id, 'callee' AS side, 'service:' || peer AS peer FROM f WHERE kind = 'CLIENT' AND NOT EXISTS (SELECT 1 FROM f s WHERE s.kind = 'SERVER' AND s.trace_id = f.trace_id AND s.parent_id = f.span_id)
        UNION ALL SELECT f.trace_id, f.span_id, 'caller', 'client:(unknown)' FROM f LEFT JOIN f p ON p.trace_id = f.trace_id AND p.span_id = f.parent_id WHERE f.kind = 'SERVER' AND p.kind IS DISTINCT FROM 'CLIENT'""",
    "merged_calls": traces.SQL["inferred_tool_calls"].split("        asked AS (")[0] + f"""
        asked AS (
            SELECT f.trace_id, v.leaf ->> '$' AS tool, e.arrival_seq, row_number() OVER (PARTITION BY f.trace_id, v.leaf ->> '$' ORDER BY e.arrival_seq, e.path) AS n FROM elements e JOIN final f ON f.body_seq = e.arrival_seq
            LEFT JOIN fields v ON v.arrival_seq = e.arrival_seq AND v.path = e.path AND v.field = 'tool_call.function.name' WHERE regexp_full_match(e.path, 'attributes\\.llm\\.output_messages\\.[0-9]+\\.message\\.tool_calls\\.[0-9]+')),
        told AS (SELECT trace_id, coalesce({_F('tool.name')}, name) AS tool, arrival_seq, row_number() OVER (PARTITION BY trace_id, coalesce({_F('tool.name')}, name) ORDER BY arrival_seq) AS n FROM facts WHERE lower({_F('openinference.span.kind')}) = 'tool')
        SELECT coalesce(a.trace_id, t.trace_id) AS trace_id, coalesce(a.tool, t.tool) AS tool, coalesce(a.n, t.n) AS n, CASE WHEN t.n IS NULL THEN 'asked' WHEN a.n IS NULL THEN 'seen' ELSE 'merged' END AS state, a.arrival_seq AS asked_in, t.arrival_seq AS seen_in
        FROM asked a FULL JOIN told t ON t.trace_id = a.trace_id AND t.tool = a.tool AND t.n = a.n""",
    "combined_entities": f"{traces._COLOURS} SELECT entity_key, nullif(sc, '') AS scope_name, count(*) AS n_spans, count(DISTINCT trace_id) AS n_traces FROM keyed WHERE entity_key IS NOT NULL GROUP BY 1, 2",
    "transport_chains": traces._COLOURS + traces._NEAR.format(marks="SELECT trace_id, span_id, parent_id, blue AS hit FROM keyed") + """
        SELECT u.trace_id, u.span_id, k.entity_key, u.anc AS ancestor, u.d - 1 AS n_between FROM up u JOIN keyed k USING (trace_id, span_id) WHERE u.hit AND u.d > 1 AND k.blue""",
}
