"""Interactions and what is derived from them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom import store
from spanloom.functions.ids import ENTITY_NAMESPACE, INTERACTION_NAMESPACE, payload_digest
from spanloom.operators import classify, interactions, labels, lineage, order, policy
from spanloom.operators.listing import NARROW, finalized
from spanloom.operators.records import fingerprint, latest, shares, top_rules
from spanloom.plans import traces
from spanloom.sources.tables import table


def _t(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, base, "interactions"), table(spark, base, "interaction_legs"), table(spark, base, "entities")


def interaction_legs_summary(spark: SparkSession, base: str) -> DataFrame:
    i, legs, _ = _t(spark, base)
    return i.select(F.col("id").alias("interaction_id"), "trace_id", "summary").join(interactions.legs_by_interaction(legs), "interaction_id", "left")


def interaction_feed(spark: SparkSession, base: str) -> DataFrame:
    i, legs, _ = _t(spark, base)
    return interactions.feed(i, legs, since=100, limit=200)


def entity_activity(spark: SparkSession, base: str) -> DataFrame:
    i, _, e = _t(spark, base)
    return interactions.entity_activity(i, e, latest(table(spark, base, "trace_risk_records"), "trace_id"))


def trace_entities(spark: SparkSession, base: str) -> DataFrame:
    i, _, e = _t(spark, base)
    return interactions.trace_entities(i, e)


def ready_prefix(spark: SparkSession, base: str) -> DataFrame:
    """The legs of each trace before its first without a payload."""
    i, legs, _ = _t(spark, base)
    rows = legs.join(i.select(F.col("id").alias("interaction_id"), "trace_id"), "interaction_id").withColumn("ready", F.col("payload_hash").isNotNull())
    return interactions.contiguous_prefix(rows, "ready", key="trace_id").select("trace_id", "seq", "interaction_id", "leg_type")


def version_tokens(spark: SparkSession, base: str) -> DataFrame:
    i, legs, _ = _t(spark, base)
    return interactions.version_tokens(legs, i)


def interaction_depths(spark: SparkSession, base: str) -> DataFrame:
    return interactions.depths(_t(spark, base)[0])


def error_ancestors(spark: SparkSession, base: str) -> DataFrame:
    i, legs, _ = _t(spark, base)
    return interactions.error_ancestors(i, legs)


def failing_forest(spark: SparkSession, base: str) -> DataFrame:
    """Failed interactions with what is above and below them."""
    i, legs, _ = _t(spark, base)
    bad = i.join(legs.where("error").select(F.col("interaction_id").alias("id")), "id", "left_semi").select("trace_id", F.translate("id", "-", "").alias("id"))
    return interactions.matching_forest(i, bad)


def recent_legs(spark: SparkSession, base: str) -> DataFrame:
    return interactions.recent_legs(_t(spark, base)[1]).select("interaction_id", "leg_type", "seq", "occurred_at")


def causal_order(spark: SparkSession, base: str) -> DataFrame:
    i, legs, _ = _t(spark, base)
    return order.causal_order(legs, i)


def data_lineage(spark: SparkSession, base: str) -> DataFrame:
    i, legs, e = _t(spark, base)
    return lineage.derive(legs, i, e)


def lineage_status(spark: SparkSession, base: str) -> DataFrame:
    return lineage.trace_status(data_lineage(spark, base))


def lineage_summary(spark: SparkSession, base: str) -> DataFrame:
    return lineage.summary(data_lineage(spark, base))


def lineage_reach_forward(spark: SparkSession, base: str) -> DataFrame:
    return lineage.reach(data_lineage(spark, base), True)


def lineage_reach_backward(spark: SparkSession, base: str) -> DataFrame:
    return lineage.reach(data_lineage(spark, base), False)


def sidecar_interactions(spark: SparkSession, base: str) -> DataFrame:
    return interactions.with_ids(interactions.plan(table(spark, base, "spans"))["interactions"])


def sidecar_legs(spark: SparkSession, base: str) -> DataFrame:
    return interactions.plan(table(spark, base, "spans"))["legs"].select("trace_id", "anchor_span_id", "leg_type", "occurred_at", "error", "content_kind")


def sidecar_evidence(spark: SparkSession, base: str) -> DataFrame:
    return interactions.plan(table(spark, base, "spans"))["evidence"]


def sidecar_entities(spark: SparkSession, base: str) -> DataFrame:
    return interactions.plan(table(spark, base, "spans"))["entities"]


def _read_legs(spark: SparkSession, base: str) -> DataFrame:
    spans = table(spark, base, "spans")
    return interactions.with_bodies(interactions.plan(spans)["legs"], spans)


def sidecar_payloads(spark: SparkSession, base: str) -> DataFrame:
    return interactions.payloads(_read_legs(spark, base))


def _bodies(spark: SparkSession, base: str) -> DataFrame:
    legs = _read_legs(spark, base).where("body is not null")
    return legs.select("trace_id", "anchor_span_id", "leg_type", "occurred_at", classify.classifiable_text(F.col("body")).alias("text"))


def payload_verdicts(spark: SparkSession, base: str) -> DataFrame:
    rows = _bodies(spark, base).withColumn("leg", F.concat_ws("/", "trace_id", "anchor_span_id", "leg_type"))
    return classify.verdicts(rows, "leg", "text")


def place_detector(text: str) -> list[tuple[int, int, str]]:
    """Places named after a preposition."""
    return [(m.start(1), m.end(1), "PLACE") for m in re.finditer(r"\b(?:at|in|to|from|à) ([A-Z][a-z]{2,})\b", text)]


def document_findings(spark: SparkSession, base: str) -> DataFrame:
    """Documents by finding, long texts in overlapping windows."""
    docs = table(spark, base, "documents").select("doc_id", F.explode(classify.detect(F.col("text"), classify.chunked(place_detector))).alias("f"))
    return docs.groupBy("doc_id", "f.tag").agg(F.count("*").alias("n"))


def documents_redacted(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents").withColumn("found", classify.detect(F.col("text")))
    return docs.select("doc_id", F.sha2(classify.redacted(F.col("text"), F.col("found")), 256).alias("digest"), F.size("found").alias("n_findings"))


def _label_legs(plan: dict[str, DataFrame]) -> DataFrame:
    """All legs of a plan in causal order, with text and findings; a leg without a body keeps its place, as it still
    replaces what its consumer last received."""
    who = plan["interactions"].select("trace_id", F.col("anchor_span_id").alias("interaction_id"), F.col("parent_span_id").alias("parent"), "caller_key", "callee_key")
    legs = plan["legs"].withColumnRenamed("anchor_span_id", "interaction_id")
    # the spans give legs no seq; legs of one time are told apart by their ids
    bare = plan.get("places", plan["legs"]).withColumnRenamed("anchor_span_id", "interaction_id")
    at = order.positions(bare.select("trace_id", "interaction_id", "leg_type", F.unix_micros("occurred_at").alias("at"), F.lit(0).alias("seq")).join(who.select("trace_id", "interaction_id", "parent"), ["trace_id", "interaction_id"]))
    legs = legs.select("trace_id", "interaction_id", "leg_type", payload_digest(F.col("body")).alias("payload_hash"), classify.classifiable_text(F.col("body")).alias("text"))
    request = F.col("leg_type") == "request"
    rows = legs.join(at, ["trace_id", "interaction_id", "leg_type"]).join(who, ["trace_id", "interaction_id"]).select(
        "trace_id", "position", "interaction_id", "leg_type", "parent", "payload_hash", F.when(request, F.col("caller_key")).otherwise(F.col("callee_key")).alias("producer"),
        F.when(request, F.col("callee_key")).otherwise(F.col("caller_key")).alias("consumer"), "text", classify.detect(F.col("text"), place_detector).alias("f"),
    )
    kind = lambda c: F.split_part(c, F.lit(":"), F.lit(1))
    return rows.withColumns({"producer_kind": kind("producer"), "consumer_kind": kind("consumer")}).withColumn(
        "findings", F.transform("f", lambda x: F.struct(x["tag"].alias("entity_type"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), F.array(x["tag"]).alias("tags"), F.lit("CONFIDENTIAL").alias("level")))
    ).drop("f")


def _legs_with_text(spark: SparkSession, base: str) -> DataFrame:
    spans = table(spark, base, "spans")
    plan = interactions.plan(spans)
    return _label_legs({**plan, "places": plan["legs"], "legs": interactions.with_bodies(plan["legs"], spans)})


def label_edges(spark: SparkSession, base: str) -> DataFrame:
    """Classified values followed over the legs that the spans tell of; a leg's findings are the places it names."""
    return labels.derive(_legs_with_text(spark, base))


def label_flows(spark: SparkSession, base: str) -> DataFrame:
    """The edges of ``label_edges`` whatever the spans: which leg handed which value on to which, and where it first stood."""
    return labels.flows(_legs_with_text(spark, base))


def label_origins(spark: SparkSession, base: str) -> DataFrame:
    """How many legs each value reached from where it first stood."""
    return labels.arrivals(_legs_with_text(spark, base)).groupBy("trace_id", "origin_interaction", "origin_leg", "value").agg(F.count_distinct("to_interaction", "to_leg").alias("n_legs"))


def label_states(spark: SparkSession, base: str) -> DataFrame:
    """Traces by whether all their bodies were classified, with findings that have no place."""
    return labels.trace_status(labels.leg_states(_legs_with_text(spark, base)))


def label_summary(spark: SparkSession, base: str) -> DataFrame:
    return labels.leg_summary(labels.arrivals(_legs_with_text(spark, base)))


def label_chains(spark: SparkSession, base: str) -> DataFrame:
    """Every way a value took from where it first stood to each leg it reached."""
    legs = _legs_with_text(spark, base)
    store.release(spark)  # the plan's queries are over, what is left to do needs the disk
    return labels.chains(labels.links(legs), broken=True)


#: Rules over flows of an interaction, for the query below; a deployment brings its own.
RULES = [
    {"id": "R1", "risk_level": "high", "enforcement": "redact", "explanation": "a tool hands data to a model", "confidence": 0.9, "when": {"source_kind": "tool", "target_kind": "llm"}},
    {"id": "R2", "risk_level": "medium", "enforcement": "block", "explanation": "an agent calls a service", "confidence": 0.8, "when": {"source_kind": "agent", "target_kind": "service"}},
    {"id": "R3", "risk_level": "low", "enforcement": "notify", "explanation": "JSON bodies", "confidence": 0.7, "when": {"content_kinds": ["json"]}},
]


def rule_decisions(spark: SparkSession, base: str) -> DataFrame:
    i, legs, e = _t(spark, base)
    kinds = legs.groupBy("interaction_id").agg(F.collect_set("content_kind").alias("content_kinds"))
    c, d = (e.select(F.col("id").alias(f"{x}_entity_id"), F.col("kind").alias(f"{x}_kind")) for x in ("caller", "callee"))
    rows = i.join(c, "caller_entity_id", "left").join(d, "callee_entity_id", "left").join(kinds, i["id"] == kinds["interaction_id"])
    flow = lambda a, b: F.struct(F.col(a).alias("source_kind"), F.col(b).alias("target_kind"), F.col("content_kinds"))
    events = rows.select(i["id"], F.array(flow("caller_kind", "callee_kind"), flow("callee_kind", "caller_kind")).alias("flows"))
    return policy.evaluate(events, RULES).select("id", F.concat_ws(",", "fired").alias("fired"), "risk_level", "enforcement", "explanation", "confidence")


def _decisions(spark: SparkSession, base: str) -> DataFrame:
    i = table(spark, base, "interactions").select("id", "trace_id")
    return rule_decisions(spark, base).join(i, "id").withColumn("fired", F.filter(F.split("fired", ","), lambda x: x != ""))


def rule_ranking(spark: SparkSession, base: str) -> DataFrame:
    catalog = spark.createDataFrame([(r["id"], r["risk_level"]) for r in RULES], "rule_id string, rule_level string")
    return top_rules(_decisions(spark, base), catalog)


def enforcement_shares(spark: SparkSession, base: str) -> DataFrame:
    return shares(rule_decisions(spark, base).where("fired <> ''"), "enforcement")


def decision_fingerprints(spark: SparkSession, base: str) -> DataFrame:
    """How many interactions share each decision."""
    rows = fingerprint(rule_decisions(spark, base), ["fired", "risk_level", "enforcement", "explanation"])
    return rows.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("fired").alias("fired"))


def sidecar_envelopes(spark: SparkSession, base: str) -> DataFrame:
    spans = table(spark, base, "spans")
    return interactions.envelopes(interactions.plan(spans)["evidence"], finalized(spans.select(*NARROW)))


def unread_legs(spark: SparkSession, base: str) -> DataFrame:
    return interactions.unread_bodies(_read_legs(spark, base)).groupBy("leg_type", "content_kind", "unread").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        interaction_legs_summary, interaction_feed, entity_activity, trace_entities, ready_prefix, version_tokens, interaction_depths, error_ancestors, failing_forest, recent_legs, causal_order, data_lineage, lineage_status,
        lineage_summary, lineage_reach_forward, lineage_reach_backward, sidecar_interactions, sidecar_legs, sidecar_evidence, sidecar_entities, sidecar_payloads, payload_verdicts, document_findings,
        documents_redacted, label_edges, label_flows, label_origins, label_states, label_summary, label_chains, rule_decisions, rule_ranking, enforcement_shares, decision_fingerprints, sidecar_envelopes, unread_legs,
    )
}

_CURRENT = "current AS (SELECT * FROM trace_risk_records QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY version DESC) = 1)"
_FOREST = """WITH RECURSIVE walk AS (
        SELECT trace_id, id, id AS cur, parent_interaction_id AS up, 0 AS d, [id] AS seen FROM interactions
        UNION ALL
        SELECT w.trace_id, w.id, p.id, p.parent_interaction_id, w.d + 1, list_append(w.seen, p.id) FROM walk w JOIN interactions p ON p.trace_id = w.trace_id AND p.id = w.up
    ),
    tops AS (SELECT * FROM walk w WHERE up IS NULL OR NOT EXISTS (SELECT 1 FROM interactions p WHERE p.trace_id = w.trace_id AND p.id = w.up))"""

_RULES = """WITH k AS (SELECT interaction_id, bool_or(content_kind = 'json') AS j FROM interaction_legs GROUP BY 1),
        f AS (
            SELECT i.id, (c.kind = 'tool' AND d.kind = 'llm') OR (d.kind = 'tool' AND c.kind = 'llm') AS r1, (c.kind = 'agent' AND d.kind = 'service') OR (d.kind = 'agent' AND c.kind = 'service') AS r2, coalesce(j, false) AS r3
            FROM interactions i JOIN k ON k.interaction_id = i.id LEFT JOIN entities c ON c.id = i.caller_entity_id LEFT JOIN entities d ON d.id = i.callee_entity_id),
        g AS (SELECT id, coalesce(r1, false) AS r1, coalesce(r2, false) AS r2, r3 FROM f)
        SELECT id, concat_ws(',', CASE WHEN r1 THEN 'R1' END, CASE WHEN r2 THEN 'R2' END, CASE WHEN r3 THEN 'R3' END) AS fired,
               CASE WHEN r1 THEN 'high' WHEN r2 THEN 'medium' WHEN r3 THEN 'low' ELSE 'none' END AS risk_level, CASE WHEN r2 THEN 'block' WHEN r1 THEN 'redact' WHEN r3 THEN 'notify' ELSE 'allow' END AS enforcement,
               CASE WHEN r1 AND r2 THEN 'a tool hands data to a model; an agent calls a service' WHEN r1 THEN 'a tool hands data to a model' WHEN r2 THEN 'an agent calls a service' WHEN r3 THEN 'JSON bodies' ELSE '' END AS explanation,
               CASE WHEN r2 THEN 0.8 WHEN r1 THEN 0.9 WHEN r3 THEN 0.7 ELSE 1.0 END::DOUBLE AS confidence FROM g"""

# The order as sorting: a path of sibling numbers gives the rank, and of the ranks on the way to a leg those that none
# after them exceeds give its place.
_LEGS = """
    l AS (
        SELECT i.trace_id, l.interaction_id AS i, l.leg_type AS k, i.parent_interaction_id AS p, coalesce(epoch_us(l.occurred_at), 4611686018427387904) AS own, l.seq, l.payload_hash FROM interaction_legs l JOIN interactions i ON i.id = l.interaction_id
        QUALIFY row_number() OVER (PARTITION BY l.interaction_id, l.leg_type ORDER BY l.seq) = 1
    )"""
_ORDER_OF = """,
    x AS (SELECT trace_id, i, any_value(CASE WHEN p <> i THEN p END) AS p, max(own) FILTER (k = 'response') AS s, bool_or(k = 'response') AS answered FROM l GROUP BY 1, 2),
    climb AS (
        SELECT trace_id, i, p AS cur, [i] AS seen FROM x WHERE p IS NOT NULL
        UNION ALL SELECT c.trace_id, c.i, y.p, list_append(c.seen, y.i) FROM climb c JOIN x y ON y.trace_id = c.trace_id AND y.i = c.cur WHERE NOT list_contains(c.seen, y.i)
    ),
    loops AS (SELECT trace_id, i, list_min(seen) AS loop FROM climb WHERE cur = i),
    r AS (
        SELECT x.*, x.s AS rt, false AS bound, CAST(NULL AS BIGINT) AS ps, CAST(NULL AS BIGINT) AS prt FROM x WHERE NOT EXISTS (SELECT 1 FROM x y WHERE y.trace_id = x.trace_id AND y.i = x.p) OR (x.trace_id, x.i) IN (SELECT (trace_id, i) FROM loops)
        UNION ALL
        SELECT x.*, CASE WHEN r.answered AND NOT (x.s < 4611686018427387904 AND r.s < 4611686018427387904 AND x.s - r.s > 1000000) THEN least(x.s, r.rt) ELSE x.s END, r.answered, r.s, r.rt FROM x JOIN r ON r.trace_id = x.trace_id AND r.i = x.p WHERE (x.trace_id, x.i) NOT IN (SELECT (trace_id, i) FROM loops)
    ),
    t AS (
        SELECT l.*, r.s, r.rt, r.bound, r.prt, r.answered AND r.s < 4611686018427387904 AS capped,
               CASE WHEN l.k = 'response' THEN r.rt ELSE least(CASE WHEN r.bound AND NOT (l.own < 4611686018427387904 AND r.ps < 4611686018427387904 AND l.own - r.ps > 1000000) THEN least(l.own, r.prt) ELSE l.own END,
                    CASE WHEN r.answered AND r.s < 4611686018427387904 THEN r.rt ELSE 4611686018427387904 END) END AS moved
        FROM l JOIN r USING (trace_id, i)
    ),
    c AS (SELECT *, CASE WHEN k = 'request' AND capped AND own > s AND moved = rt THEN i WHEN bound AND moved = prt THEN p END AS carrier FROM t),
    n AS (SELECT *, row_number() OVER (PARTITION BY trace_id, carrier IS NULL ORDER BY CASE WHEN carrier IS NULL THEN moved ELSE CAST(i <> carrier AS INTEGER) END, own, seq, i, k) AS n FROM c),
    g AS (
        SELECT trace_id, i, k, [n] AS path FROM n WHERE carrier IS NULL
        UNION ALL SELECT n.trace_id, n.i, n.k, list_append(g.path, n.n) FROM n JOIN g ON g.trace_id = n.trace_id AND g.i = n.carrier AND g.k = 'response'
    ),
    ranked AS (SELECT n.*, row_number() OVER (PARTITION BY n.trace_id ORDER BY list_append(path, 4611686018427387904)) AS rank FROM n JOIN g USING (trace_id, i, k)),
    waits AS (SELECT a.trace_id, a.i, a.k, a.rank, b.i AS wi, b.k AS wk FROM ranked a LEFT JOIN ranked b ON b.trace_id = a.trace_id AND b.k = 'request' AND b.i = CASE a.k WHEN 'response' THEN a.i WHEN 'request' THEN a.p END AND NOT (a.k = b.k AND a.i = b.i)),
    cuts AS (SELECT k.trace_id, arg_min(q.i, q.rank) AS i FROM loops k LEFT JOIN ranked q ON q.trace_id = k.trace_id AND q.i = k.i AND q.k = 'request' GROUP BY k.trace_id, k.loop HAVING count(q.i) = count(*)),
    w AS (
        SELECT w.trace_id, w.i, w.k, [rank] AS ahead, CASE WHEN c.i IS NULL THEN -1 ELSE rank END AS late FROM waits w LEFT JOIN cuts c ON c.trace_id = w.trace_id AND c.i = w.i AND w.k = 'request' WHERE wi IS NULL OR c.i IS NOT NULL
        UNION ALL SELECT a.trace_id, a.i, a.k, list_append(list_filter(w.ahead, lambda v: v > a.rank), a.rank), w.late FROM waits a JOIN w ON w.trace_id = a.trace_id AND w.i = a.wi AND w.k = a.wk WHERE NOT (a.k = 'request' AND (a.trace_id, a.i) IN (SELECT (trace_id, i) FROM cuts))
    ),
    ordered AS (SELECT trace_id, i AS interaction_id, k AS leg_type, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY late, ahead) - 1 AS INTEGER) AS position FROM w)"""
_ORDER = _LEGS + _ORDER_OF
_LINEAGE = _ORDER + """,
    ends AS (
        SELECT o.*, l.payload_hash, l.seq, CASE o.leg_type WHEN 'request' THEN a.natural_key ELSE b.natural_key END AS producer, CASE o.leg_type WHEN 'request' THEN b.natural_key ELSE a.natural_key END AS consumer,
               CASE o.leg_type WHEN 'request' THEN a.kind ELSE b.kind END AS kind, CASE o.leg_type WHEN 'request' THEN b.kind ELSE a.kind END AS to_kind
        FROM ordered o JOIN l ON l.i = o.interaction_id AND l.k = o.leg_type JOIN interactions x ON x.id = o.interaction_id LEFT JOIN entities a ON a.id = x.caller_entity_id LEFT JOIN entities b ON b.id = x.callee_entity_id
    ),
    sent AS (SELECT *, position < coalesce(min(position) FILTER (payload_hash IS NULL) OVER (PARTITION BY trace_id), 2000000000) AS live FROM ends),
    fold AS (
        SELECT trace_id, -1 AS position, CAST(MAP {} AS MAP(VARCHAR, STRUCT(s VARCHAR[], e VARCHAR[]))) AS held, CAST(NULL AS STRUCT(s VARCHAR[], e VARCHAR[])) AS got FROM (SELECT DISTINCT trace_id FROM sent)
        UNION ALL
        SELECT trace_id, position, CASE WHEN live AND consumer IS NOT NULL THEN map_concat(held, MAP {consumer: CASE WHEN to_kind = 'agent' AND held[consumer] IS NOT NULL AND got IS NOT NULL
                   THEN {'s': list_distinct(list_concat(held[consumer].s, got.s)), 'e': list_distinct(list_concat(held[consumer].e, got.e))} WHEN to_kind = 'agent' AND got IS NULL THEN held[consumer] ELSE got END}) ELSE held END, got
        FROM (
            SELECT a.*, f.held, CASE WHEN NOT live OR producer IS NULL THEN NULL WHEN f.held[producer] IS NULL THEN {'s': [producer], 'e': CAST([] AS VARCHAR[])}
                ELSE {'s': list_distinct(CASE WHEN kind = 'tool' THEN list_append(f.held[producer].s, producer) ELSE f.held[producer].s END), 'e': list_distinct(list_append(f.held[producer].e, producer))} END AS got
            FROM sent a JOIN fold f ON f.trace_id = a.trace_id AND f.position + 1 = a.position)
    ),
    lineage AS (
        SELECT s.trace_id, interaction_id, leg_type, s.position, producer, consumer, got IS NOT NULL AS delivered, coalesce(list_sort(got.s), []) AS sources, coalesce(list_sort(got.e), []) AS entities,
               '{' || coalesce(array_to_string(list_transform(list_sort(got.s), lambda v: '"' || v || '": []'), ', '), '') || '}' AS transformations
        FROM sent s JOIN fold f ON f.trace_id = s.trace_id AND f.position = s.position)"""


_PLAN = traces.SIDECAR_SQL + f""",
    requests AS (SELECT * FROM kinds WHERE role = 'request'),
    {traces.near_sql("outer_", "SELECT f.trace_id, f.span_id, f.parent_id, r.span_id IS NOT NULL AS hit FROM final f LEFT JOIN requests r ON r.trace_id = f.trace_id AND r.span_id = f.span_id AND r.direction = 'outbound'")},
    anchors AS (SELECT r.* FROM requests r LEFT JOIN outer_ o USING (trace_id, span_id) WHERE r.direction = 'outbound' OR o.ancestor IS NULL),
    {traces.near_sql("owner_", "SELECT f.trace_id, f.span_id, f.parent_id, a.span_id IS NOT NULL AS hit FROM final f LEFT JOIN anchors a USING (trace_id, span_id)")},
    echo AS (
        SELECT r.trace_id, n.ancestor AS span_id, r.self_id AS echo_id, r.self_namespace AS echo_namespace FROM requests r JOIN outer_ o USING (trace_id, span_id) JOIN owner_ n USING (trace_id, span_id)
        WHERE r.direction = 'inbound' AND r.self_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY r.trace_id, n.ancestor ORDER BY r.arrival_seq, r.span_id) = 1
    ),
    answers AS (
        SELECT trace_id, exchange_id AS span_id, span_id AS response_span, coalesce(ended_at, started_at) AS response_at, output AS reply, CASE WHEN outcome = 'ok' THEN false WHEN outcome IN ('denied', 'error', 'abandoned') THEN true ELSE error END AS response_error
        FROM kinds WHERE role = 'response' QUALIFY row_number() OVER (PARTITION BY trace_id, exchange_id ORDER BY arrival_seq, span_id) = 1
    ),
    votes AS (
        SELECT trace_id, pod, CASE WHEN n = 1 THEN one WHEN n > 1 OR chatty THEN 'agent' END AS voted FROM (
            SELECT trace_id, pod, count(DISTINCT callee_kind) FILTER (direction = 'inbound') AS n, any_value(callee_kind) FILTER (direction = 'inbound') AS one, bool_or(direction = 'outbound' AND protocol IN ('a2a', 'mcp')) AS chatty
            FROM requests WHERE self_id IS NOT NULL GROUP BY 1, 2)
    ),
    ends_ AS (
        SELECT a.*, e.echo_namespace, w.response_span, w.response_at, w.reply, w.response_error, n.ancestor AS owner, a.direction = 'inbound' AS inb, coalesce(v.voted, CASE WHEN a.direction = 'inbound' THEN a.callee_kind ELSE a.caller_kind END) AS own_kind,
               CASE WHEN e.span_id IS NULL THEN '' ELSE concat_ws('/', nullif(e.echo_namespace, ''), e.echo_id) END AS far
        FROM anchors a LEFT JOIN echo e USING (trace_id, span_id) LEFT JOIN answers w USING (trace_id, span_id) LEFT JOIN votes v ON v.trace_id = a.trace_id AND v.pod = a.pod LEFT JOIN owner_ n USING (trace_id, span_id)
    ),
    full_ AS (
        SELECT *, concat_ws(':', CASE WHEN inb THEN caller_kind ELSE own_kind END, CASE WHEN inb AND caller_kind = 'user' THEN sub WHEN inb THEN coalesce(client, '(unknown)') ELSE pod END) AS caller_key,
               concat_ws(':', CASE WHEN inb AND callee_kind <> 'llm' THEN own_kind ELSE callee_kind END, CASE WHEN callee_kind = 'llm' THEN coalesce(peer, '(unknown)') || '/' || coalesce(model, '(unknown)') WHEN inb THEN pod WHEN far <> '' THEN far ELSE coalesce(peer, '(unknown)') END) AS callee_key
        FROM ends_
    ),
    plan_legs AS (
        SELECT trace_id, span_id AS anchor_span_id, 'request' AS leg_type, started_at AS occurred_at, CAST(NULL AS BOOLEAN) AS error, request_kind AS content_kind, input AS body FROM full_
        UNION ALL SELECT trace_id, span_id, 'response', response_at, response_error, response_kind, reply FROM full_ WHERE response_span IS NOT NULL
    ),
    evidence AS (
        SELECT trace_id, span_id, span_id AS anchor_span_id, 'anchor' AS role, 'request' AS leg_type FROM full_
        UNION ALL SELECT n.trace_id, n.span_id, n.ancestor, 'connector', CASE WHEN n.span_id = f.response_span THEN 'response' END FROM owner_ n JOIN full_ f ON f.trace_id = n.trace_id AND f.span_id = n.ancestor
        WHERE NOT EXISTS (SELECT 1 FROM anchors a WHERE a.trace_id = n.trace_id AND a.span_id = n.span_id)
    )"""


# Places are single words, so a value stands in a text where one of its words is that value; and of two values neither can lie
# inside the other. What is left of the rules is who remembers which legs.
_FLOWS = _PLAN + """,
    l AS (
        SELECT g.trace_id, g.anchor_span_id AS i, g.leg_type AS k, f.owner AS p, coalesce(epoch_us(g.occurred_at), 4611686018427387904) AS own, 0 AS seq, g.body, CASE g.leg_type WHEN 'request' THEN f.caller_key ELSE f.callee_key END AS producer,
               CASE g.leg_type WHEN 'request' THEN f.callee_key ELSE f.caller_key END AS consumer
        FROM plan_legs g JOIN full_ f ON f.trace_id = g.trace_id AND f.span_id = g.anchor_span_id
    )""" + _ORDER_OF + r""",
    said AS (
        SELECT o.trace_id, o.position AS n, l.i, l.k, l.p, l.producer, l.consumer, split_part(l.producer, ':', 1) = 'agent' AS keeps, CASE l.k WHEN 'response' THEN l.i ELSE l.p END AS call,
               CASE WHEN json_valid(body) AND json_keys(CASE WHEN json_valid(body) AND json_type(body) = 'OBJECT' THEN body END) = ['messages'] THEN array_to_string(list_transform(CAST(CAST(body AS JSON) -> '$.messages' AS JSON[]), lambda m: coalesce(m ->> '$."message.content"', m ->> '$.content')), chr(10)) ELSE body END AS text
        FROM ordered o JOIN l ON l.trace_id = o.trace_id AND l.i = o.interaction_id AND l.k = o.leg_type
    ),
    heard AS (
        SELECT trace_id, n, i, k, text IS NOT NULL AS has_text, coalesce(list_distinct(regexp_extract_all(text, '[\p{L}\p{N}]+')), []) AS words,
               coalesce(list_distinct(regexp_extract_all(regexp_replace(text, '([^\p{L}\p{N}_])', '\1\1', 'g'), '(?:^|[^\p{L}\p{N}_])(?:at|in|to|from|à)  ([A-Z][a-z]{2,})(?:$|[^\p{L}\p{N}_])', 1)), []) AS places
        FROM said
    ),
    opened AS (SELECT a.trace_id, a.n, b.n AS m FROM said a JOIN said b ON b.trace_id = a.trace_id AND b.n < a.n AND b.i = a.call AND b.k = 'request' AND b.consumer = a.producer WHERE NOT a.keeps),
    inside AS (SELECT a.trace_id, a.n, b.n AS m FROM said a JOIN said b ON b.trace_id = a.trace_id AND b.n < a.n AND b.p = a.call AND b.k = 'response' AND b.consumer = a.producer WHERE NOT a.keeps AND (a.k = 'response' OR (a.trace_id, a.n) IN (SELECT (trace_id, n) FROM opened))),
    latest AS (SELECT a.trace_id, a.n, max(b.n) AS m FROM said a JOIN said b ON b.trace_id = a.trace_id AND b.n < a.n AND b.consumer = a.producer WHERE NOT a.keeps AND (a.trace_id, a.n) NOT IN (SELECT (trace_id, n) FROM opened) GROUP BY 1, 2),
    known AS (SELECT a.trace_id, a.n, b.n AS m FROM said a JOIN said b ON b.trace_id = a.trace_id AND b.n < a.n AND b.consumer = a.producer WHERE a.keeps UNION SELECT * FROM opened UNION SELECT * FROM inside UNION SELECT * FROM latest),
    brought AS (SELECT trace_id, n, list(m) AS ms FROM known GROUP BY 1, 2),
    held AS (
        SELECT trace_id, -1 AS n, CAST([] AS STRUCT(n INTEGER, o INTEGER, v VARCHAR)[]) AS has FROM (SELECT DISTINCT trace_id FROM heard)
        UNION ALL
        SELECT trace_id, n, list_concat(has, list_transform(list_distinct(list_concat(list_transform(got, lambda g: {'o': g.o, 'v': g.v}), list_transform(list_filter(places, lambda w: NOT list_contains(list_transform(got, lambda g: g.v), w)), lambda w: {'o': n, 'v': w}))),
                                                          lambda u: CAST({'n': n, 'o': u.o, 'v': u.v} AS STRUCT(n INTEGER, o INTEGER, v VARCHAR))))
        FROM (SELECT t.*, h.has, list_filter(h.has, lambda g: list_contains(coalesce(b.ms, []), g.n) AND list_contains(t.words, g.v)) AS got FROM held h JOIN heard t ON t.trace_id = h.trace_id AND t.n = h.n + 1 LEFT JOIN brought b ON b.trace_id = t.trace_id AND b.n = t.n)
    ),
    final_ AS (SELECT trace_id, unnest(has) AS h FROM held QUALIFY n = max(n) OVER (PARTITION BY trace_id)),
    flows AS (
        SELECT DISTINCT a.trace_id, f.i AS from_interaction, f.k AS from_leg, t.i AS to_interaction, t.k AS to_leg, o.i AS origin_interaction, o.k AS origin_leg, a.h.v AS value
        FROM final_ a JOIN final_ b ON b.trace_id = a.trace_id AND b.h.o = a.h.o AND b.h.v = a.h.v JOIN known w ON w.trace_id = a.trace_id AND w.m = a.h.n AND w.n = b.h.n
        JOIN heard f ON f.trace_id = a.trace_id AND f.n = a.h.n JOIN heard t ON t.trace_id = a.trace_id AND t.n = b.h.n JOIN heard o ON o.trace_id = a.trace_id AND o.n = a.h.o
    )"""


def _uuid5_sql(namespace: str, name: str) -> str:
    h = f"sha1(unhex('{namespace.replace('-', '')}') || encode({name}))"
    return f"{h}[1:8] || '-' || {h}[9:12] || '-5' || {h}[14:16] || '-' || translate({h}[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || {h}[18:20] || '-' || {h}[21:32]"


def _reach_sql(forward: bool) -> str:
    """A walk's state for each trace, source and seed: hops by entity, edges used, and what still waits."""
    frm, to, turn = ("producer", "consumer", "position") if forward else ("consumer", "producer", "-position")
    return f"""WITH RECURSIVE {_LINEAGE},
        edges AS (SELECT trace_id, unnest(sources) AS source, {frm} AS a, {to} AS b, position, false AS waits FROM lineage WHERE delivered AND producer IS NOT NULL AND consumer IS NOT NULL),
        pairs AS (SELECT DISTINCT trace_id, source FROM edges),
        turns AS (
            SELECT *, row_number() OVER (PARTITION BY trace_id, source ORDER BY {turn}) AS n FROM (
                SELECT * FROM edges UNION ALL SELECT p.trace_id, p.source, l.{frm}, l.{to}, l.position, true FROM pairs p JOIN lineage l ON l.trace_id = p.trace_id AND NOT l.delivered AND l.producer IS NOT NULL AND l.consumer IS NOT NULL)
        ),
        walk AS (
            SELECT trace_id, source, seed, 0 AS n, MAP {{seed: 0}} AS hops, 0 AS used, CAST([] AS VARCHAR[]) AS front FROM (SELECT DISTINCT trace_id, source, a AS seed FROM edges)
            UNION ALL
            SELECT w.trace_id, w.source, w.seed, t.n, CASE WHEN t.waits OR w.hops[t.a] IS NULL OR coalesce(w.hops[t.b], 2000000000) <= w.hops[t.a] + 1 THEN w.hops ELSE map_concat(w.hops, MAP {{t.b: w.hops[t.a] + 1}}) END,
                   w.used + CASE WHEN t.waits OR w.hops[t.a] IS NULL THEN 0 ELSE 1 END, CASE WHEN t.waits AND w.hops[t.a] IS NOT NULL THEN list_append(w.front, t.b) ELSE w.front END
            FROM walk w JOIN turns t ON t.trace_id = w.trace_id AND t.source = w.source AND t.n = w.n + 1
        ),
        last_ AS (SELECT *, list_distinct(list_filter(front, lambda v: hops[v] IS NULL)) AS open FROM walk QUALIFY row_number() OVER (PARTITION BY trace_id, source, seed ORDER BY n DESC) = 1)
        SELECT trace_id, seed, source, CASE WHEN cardinality(hops) > 1 THEN 'derived' WHEN len(open) > 0 THEN 'pending' ELSE 'no_adjacent' END AS state, CAST(cardinality(hops) - 1 AS INTEGER) AS n_reached, used AS n_edges, len(open) AS n_frontier,
               list_max(map_values(hops)) AS max_hops, false AS truncated FROM last_"""


SQL = {
    "label_flows": f"WITH RECURSIVE {_FLOWS} SELECT * FROM flows",
    "label_origins": f"WITH RECURSIVE {_FLOWS} SELECT trace_id, origin_interaction, origin_leg, value, count(DISTINCT (to_interaction, to_leg)) AS n_legs FROM flows GROUP BY 1, 2, 3, 4",
    "sidecar_interactions": f"""WITH RECURSIVE {_PLAN}
        SELECT trace_id, span_id AS anchor_span_id, owner AS parent_span_id, caller_key, callee_key, direction, protocol, protocol || ' call from ' || coalesce(self_id, '(unknown)') AS summary,
               {_uuid5_sql(INTERACTION_NAMESPACE, "trace_id || '/' || span_id")} AS id, {_uuid5_sql(ENTITY_NAMESPACE, "caller_key")} AS caller_entity_id, {_uuid5_sql(ENTITY_NAMESPACE, "callee_key")} AS callee_entity_id FROM full_""",
    "sidecar_legs": f"WITH RECURSIVE {_PLAN} SELECT trace_id, anchor_span_id, leg_type, occurred_at, error, content_kind FROM plan_legs",
    "sidecar_evidence": f"WITH RECURSIVE {_PLAN} SELECT * FROM evidence",
    "sidecar_entities": f"""WITH RECURSIVE {_PLAN},
        m AS (SELECT arrival_seq, caller_key AS natural_key, CASE WHEN NOT inb THEN self_namespace END AS namespace FROM full_ UNION ALL SELECT arrival_seq, callee_key, CASE WHEN inb THEN self_namespace ELSE echo_namespace END FROM full_)
        SELECT natural_key, min(arrival_seq) AS first_seq, arg_max(namespace, arrival_seq) FILTER (namespace IS NOT NULL) AS namespace, count(*) AS n_mentions, split_part(natural_key, ':', 1) AS kind FROM m GROUP BY 1""",
    "sidecar_envelopes": f"""WITH RECURSIVE {_PLAN} SELECT e.trace_id, anchor_span_id, min(started_at) AS first_at, max(ended_at) AS last_at, bool_or(f.error) AS error, count(*) AS n_spans, count(*) FILTER (role = 'anchor') AS n_anchors
        FROM evidence e LEFT JOIN final f USING (trace_id, span_id) GROUP BY 1, 2""",
    "unread_legs": f"""WITH RECURSIVE {_PLAN} SELECT leg_type, content_kind, CASE WHEN body IS NULL THEN 'not captured' WHEN body LIKE '%...[truncated]' THEN 'truncated' END AS unread, count(*) AS n FROM plan_legs GROUP BY 1, 2, 3""",
    "causal_order": f"WITH RECURSIVE {_ORDER} SELECT * FROM ordered",
    "data_lineage": f"WITH RECURSIVE {_LINEAGE} SELECT * FROM lineage",
    "lineage_status": f"""WITH RECURSIVE {_LINEAGE} SELECT trace_id, CASE WHEN bool_and(delivered) THEN 'complete' ELSE 'partial' END AS status, count(*) FILTER (delivered) AS n_covered, count(*) AS n_legs,
        min(position) FILTER (NOT delivered) AS stopped_at FROM lineage GROUP BY 1""",
    "lineage_summary": f"""WITH RECURSIVE {_LINEAGE}, u AS (SELECT trace_id, consumer, unnest(sources) AS source FROM lineage WHERE delivered)
        SELECT trace_id, source, count(*) AS n_legs, count(DISTINCT consumer) AS n_destinations FROM u GROUP BY 1, 2""",
    "lineage_reach_forward": _reach_sql(True),
    "lineage_reach_backward": _reach_sql(False),
    "interaction_legs_summary": """WITH one AS (SELECT * FROM interaction_legs QUALIFY row_number() OVER (PARTITION BY interaction_id, leg_type ORDER BY seq) = 1),
        top AS (SELECT interaction_id, max(seq) AS max_seq FROM interaction_legs GROUP BY 1),
        agg AS (
            SELECT interaction_id, max(occurred_at) FILTER (leg_type = 'request') AS requested_at, max(occurred_at) FILTER (leg_type <> 'request') AS responded_at, bool_or(error) AS error, bool_or(leg_type <> 'request') AS has_response FROM one GROUP BY 1)
        SELECT i.id AS interaction_id, trace_id, summary, requested_at, responded_at, error, max_seq, has_response, (epoch_us(responded_at) - epoch_us(requested_at)) / 1e6 AS duration_s
        FROM interactions i LEFT JOIN agg a ON a.interaction_id = i.id LEFT JOIN top t ON t.interaction_id = i.id""",
    "interaction_feed": """SELECT i.id, trace_id, summary, max(seq) AS seq FROM interactions i JOIN interaction_legs l ON l.interaction_id = i.id GROUP BY ALL HAVING max(seq) > 100 ORDER BY seq, i.id LIMIT 200""",
    "entity_activity": f"""WITH {_CURRENT}
        SELECT e.natural_key, e.kind, count(DISTINCT i.id) AS n_interactions, count(DISTINCT i.trace_id) AS n_traces, coalesce(bool_or(c.trace_risk_level IN ('critical', 'high')), false) AS is_risky
        FROM entities e LEFT JOIN interactions i ON e.id IN (i.caller_entity_id, i.callee_entity_id) LEFT JOIN current c ON c.trace_id = i.trace_id GROUP BY 1, 2""",
    "trace_entities": """SELECT DISTINCT i.trace_id, e.natural_key, e.kind, list_position(['user', 'client', 'agent', 'tool', 'llm', 'service'], e.kind) AS kind_rank
        FROM interactions i JOIN entities e ON e.id IN (i.caller_entity_id, i.callee_entity_id)""",
    "ready_prefix": """WITH l AS (SELECT l.*, i.trace_id FROM interaction_legs l JOIN interactions i ON i.id = l.interaction_id), w AS (SELECT trace_id, min(seq) AS stop FROM l WHERE payload_hash IS NULL GROUP BY 1)
        SELECT l.trace_id, seq, interaction_id, leg_type FROM l LEFT JOIN w USING (trace_id) WHERE stop IS NULL OR seq < stop""",
    "version_tokens": """WITH d AS (
            SELECT i.trace_id, l.seq, md5(concat_ws('|', interaction_id, leg_type, CAST(epoch_us(occurred_at) AS VARCHAR), coalesce(payload_hash, ''), coalesce(CAST(error AS VARCHAR), ''), CAST(l.seq AS VARCHAR))) AS d
            FROM interaction_legs l JOIN interactions i ON i.id = l.interaction_id)
        SELECT trace_id, count(*) AS n_legs, max(seq) AS max_seq, CAST(sum(CAST('0x' || d[1:8] AS BIGINT)) AS BIGINT) AS p0, CAST(sum(CAST('0x' || d[9:16] AS BIGINT)) AS BIGINT) AS p1, CAST(sum(CAST('0x' || d[17:24] AS BIGINT)) AS BIGINT) AS p2, CAST(sum(CAST('0x' || d[25:32] AS BIGINT)) AS BIGINT) AS p3
        FROM d GROUP BY 1""",
    "interaction_depths": f"{_FOREST} SELECT trace_id, replace(id, '-', '') AS id, replace(cur, '-', '') AS root_id, d AS depth FROM tops",
    "error_ancestors": f"""{_FOREST}, bad AS (SELECT DISTINCT interaction_id AS id FROM interaction_legs WHERE error),
        hit AS (SELECT trace_id, u AS id, count(*) AS n FROM (SELECT trace_id, unnest(seen) AS u FROM tops JOIN bad USING (id)) GROUP BY 1, 2)
        SELECT t.trace_id, replace(t.id, '-', '') AS id, coalesce(n, 0) AS n_failed_below FROM tops t LEFT JOIN hit h ON h.trace_id = t.trace_id AND h.id = t.id""",
    "failing_forest": f"""{_FOREST}, bad AS (SELECT DISTINCT interaction_id AS id FROM interaction_legs WHERE error),
        above AS (SELECT trace_id, unnest(seen) AS id FROM tops JOIN bad USING (id)),
        below AS (SELECT t.trace_id, t.id FROM (SELECT trace_id, id, unnest(seen) AS step FROM tops) t JOIN bad b ON b.id = t.step)
        SELECT DISTINCT trace_id, replace(id, '-', '') AS id FROM (SELECT * FROM above UNION ALL SELECT * FROM below)""",
    "recent_legs": "SELECT interaction_id, leg_type, seq, occurred_at FROM interaction_legs QUALIFY row_number() OVER (PARTITION BY interaction_id ORDER BY seq DESC) = 1",
    "rule_decisions": _RULES,
    "rule_ranking": f"""WITH d AS ({_RULES}), x AS (SELECT i.trace_id, risk_level, unnest(string_split(fired, ',')) AS rule_id FROM d JOIN interactions i USING (id) WHERE fired <> '')
        SELECT rule_id, count(*) AS n_fired, count(DISTINCT trace_id) AS n_traces, count(*) FILTER (risk_level = 'critical') AS n_critical, count(*) FILTER (risk_level = 'high') AS n_high, count(*) FILTER (risk_level = 'medium') AS n_medium,
               count(*) FILTER (risk_level = 'low') AS n_low, count(*) FILTER (risk_level = 'none') AS n_none, CASE rule_id WHEN 'R1' THEN 'high' WHEN 'R2' THEN 'medium' ELSE 'low' END AS rule_level FROM x GROUP BY rule_id""",
    "decision_fingerprints": f"""WITH d AS ({_RULES}), h AS (SELECT fired, sha256('{{"fired":"' || fired || '","risk_level":"' || risk_level || '","enforcement":"' || enforcement || '","explanation":"' || explanation || '"}}') AS fingerprint FROM d)
        SELECT fingerprint, count(*) AS n, min(fired) AS fired FROM h GROUP BY 1""",
    # every sign that is no part of a word is doubled, so that neighbouring matches don't need the same one
    "document_findings": r"""WITH t AS (SELECT doc_id, regexp_replace(text, '([^\p{L}\p{N}_])', '\1\1', 'g') AS t FROM documents),
        f AS (SELECT doc_id, unnest(regexp_extract_all(t, '(?:^|[^\p{L}\p{N}_])(?:at|in|to|from|à)  ([A-Z][a-z]{2,})(?:$|[^\p{L}\p{N}_])', 1)) AS place FROM t)
        SELECT doc_id, 'PLACE' AS tag, count(*) AS n FROM f GROUP BY 1""",
    "enforcement_shares": f"WITH d AS ({_RULES}), n AS (SELECT enforcement, count(*) AS n FROM d WHERE fired <> '' GROUP BY 1) SELECT enforcement, n, round(100.0 * n / sum(n) OVER (), 1)::DOUBLE AS percent FROM n",
}
