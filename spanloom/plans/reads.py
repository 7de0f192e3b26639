"""Registered reads over interactions and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.text import canonical_service, hostname, matches_any
from spanloom.operators import reads, records
from spanloom.operators.attributes import FRAMEWORK_KEYS
from spanloom.operators.hierarchy import hierarchy, nearest_ancestor
from spanloom.operators.interactions import contiguous_prefix
from spanloom.operators.listing import NARROW, finalized, finalized_facts
from spanloom.plans import interactions as plans
from spanloom.plans import traces
from spanloom.sources.tables import table
from spanloom.vocab import RISK_ORDER, rank

DAY = "2018-03-12 00:00:00"
HOSTS = ["*.example", "10.0.0.0/8", "192.168.0.0/16"]


def _t(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, base, "interactions"), table(spark, base, "interaction_legs"), table(spark, base, "entities")


def _current(spark: SparkSession, base: str) -> DataFrame:
    return records.latest(table(spark, base, "trace_risk_records"), "trace_id")


def risk_filtered(spark: SparkSession, base: str) -> DataFrame:
    """Current records of at least medium level, with three or more interactions, of the last week before a day."""
    rows = _current(spark, base).where(reads.at_least(F.col("trace_risk_level"), "medium") & (F.col("interaction_count") >= 3) & reads.relative_window(F.col("computed_at"), F.lit(DAY).cast("timestamp"), "7d"))
    return rows.select("trace_id", "trace_risk_level", "interaction_count", rank(F.col("trace_risk_level"), RISK_ORDER).alias("level_rank"))


def risk_tiles(spark: SparkSession, base: str) -> DataFrame:
    i, _, e = _t(spark, base)
    return reads.tiles(i, e, _current(spark, base))


def risk_alerts(spark: SparkSession, base: str) -> DataFrame:
    i, _, e = _t(spark, base)
    return reads.alerts(records.escalations(table(spark, base, "trace_risk_records")), i, e).select("trace_id", "version", "action", F.array_join("involved", ",").alias("involved"))


def alerts_involving_services(spark: SparkSession, base: str) -> DataFrame:
    """Standing alerts in whose trace a service takes part."""
    i, _, e = _t(spark, base)
    rows = reads.alerts(records.escalations(table(spark, base, "trace_risk_records")), i, e)
    return rows.where(F.exists("involved", lambda x: x.startswith("service:"))).select("trace_id", "version", "action")


def interactions_of_agents(spark: SparkSession, base: str) -> DataFrame:
    i, _, e = _t(spark, base)
    return reads.interactions_with(i, e, "agent").select("id", "trace_id")


def named_legs(spark: SparkSession, base: str) -> DataFrame:
    i, legs, e = _t(spark, base)
    return reads.named(i, e, legs).select("interaction_id", "leg_type", "seq", "trace_id", "caller_key", "caller_kind", "callee_key", "callee_kind")


def trace_feed(spark: SparkSession, base: str) -> DataFrame:
    i, legs, _ = _t(spark, base)
    return reads.trace_feed(i, legs)


def stale_traces(spark: SparkSession, base: str) -> DataFrame:
    i, legs, _ = _t(spark, base)
    return reads.stale_traces(i, legs, _current(spark, base))


def ordered_digests(spark: SparkSession, base: str) -> DataFrame:
    i, legs, _ = _t(spark, base)
    return reads.ordered_digests(legs, i)


def content_kinds(spark: SparkSession, base: str) -> DataFrame:
    i, legs, _ = _t(spark, base)
    return reads.kind_counts(i, legs)


def leg_unions(spark: SparkSession, base: str) -> DataFrame:
    return reads.leg_unions(_t(spark, base)[1]).select("interaction_id", F.array_join("kinds", ",").alias("kinds"), "has_gap")


def legs_behind_cursors(spark: SparkSession, base: str) -> DataFrame:
    return reads.cursor_list(_t(spark, base)[1], ["request", "response"], [500, 900]).select("interaction_id", "leg_type", "seq")


def leg_lineage_states(spark: SparkSession, base: str) -> DataFrame:
    return reads.leg_states(_t(spark, base)[1], plans.data_lineage(spark, base)).select("interaction_id", "leg_type", "seq", "state")


def ready_with_lineage(spark: SparkSession, base: str) -> DataFrame:
    """The legs of each trace before its first that has no payload or no lineage yet."""
    i, legs, _ = _t(spark, base)
    rows = reads.leg_states(legs, plans.data_lineage(spark, base)).join(i.select(F.col("id").alias("interaction_id"), "trace_id"), "interaction_id")
    rows = rows.withColumn("ready", F.col("payload_hash").isNotNull() & (F.col("state") == "derived"))
    return contiguous_prefix(rows, "ready", key="trace_id").select("trace_id", "seq", "interaction_id", "leg_type")


def decision_roll_up(spark: SparkSession, base: str) -> DataFrame:
    return reads.decision_roll_up(plans._decisions(spark, base))


def span_windows(spark: SparkSession, base: str) -> DataFrame:
    """Spans of the last day, week and month before a day, by service."""
    now = F.lit(DAY).cast("timestamp")
    rows = finalized(table(spark, base, "spans").select(*NARROW))
    inside = {f"n_{k}": F.count_if(reads.relative_window(F.col("started_at"), now, k)) for k in ("24h", "7d", "30d")}
    return rows.groupBy("service_name").agg(*[c.alias(n) for n, c in inside.items()])


def trace_trees(spark: SparkSession, base: str) -> DataFrame:
    """The trees of each trace: root, spans in it, deepest level."""
    return hierarchy(table(spark, base, "spans")).where("depth >= 0").groupBy("trace_id", "root_span_id").agg(F.count("*").alias("n_spans"), F.max("depth").alias("deepest"))


def innermost_owners(spark: SparkSession, base: str) -> DataFrame:
    """Of each span the nearest server span above it inside its own service: where the service changes the walk ends."""
    rows = finalized(table(spark, base, "spans").select(*NARROW))
    up = rows.select("trace_id", F.col("span_id").alias("parent_id"), F.col("service_name").alias("above"))
    cut = rows.join(up, ["trace_id", "parent_id"], "left").withColumn("parent_id", F.when(F.col("above").eqNullSafe(F.col("service_name")), F.col("parent_id")))
    return nearest_ancestor(cut.withColumn("hit", F.col("kind") == "SERVER"), "hit")


def host_matches(spark: SparkSession, base: str) -> DataFrame:
    """Hosts called over HTTP, and whether a list of globs and address ranges holds them."""
    rows = finalized_facts(table(spark, base, "spans"), FRAMEWORK_KEYS).select(hostname(F.col("http_url")).alias("host")).where("host <> ''")
    return rows.groupBy("host").agg(F.count("*").alias("n_spans")).withColumn("listed", matches_any(F.col("host"), HOSTS))


def service_names(spark: SparkSession, base: str) -> DataFrame:
    """Services without the prefix of their project, which is what stands before the first hyphen of the most frequent name."""
    rows = table(spark, base, "spans").where("service_name is not null").groupBy("service_name").agg(F.count("*").alias("n_rows"))
    top = rows.agg(F.max_by(F.split_part("service_name", F.lit("-"), F.lit(1)), F.struct("n_rows", "service_name")).alias("project"))
    return rows.join(F.broadcast(top), F.lit(True)).select("service_name", canonical_service(F.col("service_name"), F.col("project")).alias("canonical"), "n_rows")  # one row


QUERIES = {
    f.__name__: f
    for f in (
        risk_filtered, risk_tiles, risk_alerts, alerts_involving_services, interactions_of_agents, named_legs, trace_feed, stale_traces, ordered_digests, content_kinds, leg_unions, legs_behind_cursors, leg_lineage_states,
        ready_with_lineage, decision_roll_up, span_windows, trace_trees, innermost_owners, host_matches, service_names,
    )
}

_CURRENT = "current AS (SELECT * FROM trace_risk_records QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY version DESC) = 1)"
_RANK = "coalesce(list_position(['critical', 'high', 'medium', 'low', 'none', 'unknown'], trace_risk_level), 7)"
_ALERTS = f"""a AS (SELECT *, {_RANK} AS r FROM trace_risk_records WHERE {_RANK} <= 2), b AS (SELECT *, min(r) OVER (PARTITION BY trace_id ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM a),
    standing AS (SELECT trace_id, version, CASE WHEN best IS NULL THEN 'created' ELSE 'superseded' END AS action FROM b WHERE best IS NULL OR r < best),
    inv AS (SELECT trace_id, list_sort(list(DISTINCT natural_key)) AS involved FROM interactions i JOIN entities e ON e.id IN (i.caller_entity_id, i.callee_entity_id) GROUP BY 1)"""
_WITHIN = "{c} <= TIMESTAMP '" + DAY + "' AND {c} >= TIMESTAMP '" + DAY + "' - INTERVAL {h} HOUR"
_STATES = plans._LINEAGE + ", states AS (SELECT g.*, CASE WHEN n.interaction_id IS NULL THEN 'missing' WHEN n.delivered THEN 'derived' ELSE 'undelivered' END AS state FROM interaction_legs g LEFT JOIN lineage n ON n.interaction_id = g.interaction_id AND n.leg_type = g.leg_type)"
_URL_HOST = f"lower(regexp_extract({traces._fact('http.url')}, '^[a-z]+://([^/:?#@]+)(:[0-9]+)?([/?#]|$)', 1))"
_ENFORCE = "['block', 'quarantine', 'require_approval', 'redact', 'mask', 'anonymize', 'encrypt', 'escalate', 'notify', 'warn', 'log_only', 'audit', 'allow']"

SQL = {
    "risk_filtered": f"WITH {_CURRENT} SELECT trace_id, trace_risk_level, interaction_count, {_RANK} AS level_rank FROM current WHERE {_RANK} <= 3 AND interaction_count >= 3 AND {_WITHIN.format(c='computed_at', h=168)}",
    "risk_tiles": f"""WITH {_CURRENT}, used AS (SELECT DISTINCT e.id, e.kind FROM interactions i JOIN entities e ON e.id IN (i.caller_entity_id, i.callee_entity_id)), p AS (SELECT trace_id, count(*) AS n FROM interactions GROUP BY 1),
        u AS (SELECT count(*) FILTER (kind = 'agent') AS n_agents, count(*) FILTER (kind = 'user') AS n_users, count(*) FILTER (kind = 'tool') AS n_tools FROM used),
        t AS (SELECT count(*) AS n_traces, CAST(sum(n) AS BIGINT) AS n_interactions, CAST(sum(n) FILTER (trace_id IN (SELECT trace_id FROM current)) AS BIGINT) AS n_evaluated FROM p), c AS (SELECT count(*) FILTER ({_RANK} <= 2) AS n_risky, count(*) AS n_judged FROM current)
        SELECT *, CASE WHEN n_judged > 0 THEN round(100.0 * n_risky / n_judged, 1) ELSE 0 END::DOUBLE AS risky_percent FROM u, t, c""",
    "risk_alerts": f"WITH {_ALERTS} SELECT s.trace_id, version, action, array_to_string(involved, ',') AS involved FROM standing s LEFT JOIN inv USING (trace_id)",
    "alerts_involving_services": f"WITH {_ALERTS} SELECT s.trace_id, version, action FROM standing s JOIN inv USING (trace_id) WHERE len(list_filter(involved, lambda x: x LIKE 'service:%')) > 0",
    "interactions_of_agents": "SELECT id, trace_id FROM interactions WHERE caller_entity_id IN (SELECT id FROM entities WHERE kind = 'agent') OR callee_entity_id IN (SELECT id FROM entities WHERE kind = 'agent')",
    "named_legs": """SELECT l.interaction_id, l.leg_type, l.seq, i.trace_id, a.natural_key AS caller_key, a.kind AS caller_kind, b.natural_key AS callee_key, b.kind AS callee_kind
        FROM interaction_legs l JOIN interactions i ON i.id = l.interaction_id LEFT JOIN entities a ON a.id = i.caller_entity_id LEFT JOIN entities b ON b.id = i.callee_entity_id""",
    "trace_feed": "SELECT i.trace_id, max(l.seq) AS seq, count(DISTINCT i.id) AS n_interactions FROM interaction_legs l JOIN interactions i ON i.id = l.interaction_id GROUP BY 1 ORDER BY seq DESC, 1 LIMIT 100",
    "stale_traces": f"""WITH {_CURRENT}, m AS (SELECT i.trace_id, min(l.seq) AS first_seq, max(occurred_at) AS moved_at FROM interaction_legs l JOIN interactions i ON i.id = l.interaction_id GROUP BY 1)
        SELECT m.trace_id, first_seq, computed_at IS NULL AS never FROM m LEFT JOIN current c USING (trace_id) WHERE computed_at IS NULL OR moved_at > computed_at""",
    "ordered_digests": """WITH r AS (
            SELECT i.trace_id, l.seq, row_number() OVER (PARTITION BY i.trace_id ORDER BY l.seq) AS n, md5(concat_ws('|', interaction_id, leg_type, CAST(epoch_us(occurred_at) AS VARCHAR), coalesce(payload_hash, '-'), coalesce(CAST(error AS VARCHAR), '-'))) AS d
            FROM interaction_legs l JOIN interactions i ON i.id = l.interaction_id),
        p AS (SELECT trace_id, (n - 1) // 1000 AS part, md5(string_agg(d, '' ORDER BY seq)) AS d, count(*) AS n FROM r GROUP BY 1, 2)
        SELECT trace_id, CAST(sum(n) AS BIGINT) AS n_legs, md5(string_agg(d, '' ORDER BY part)) AS digest FROM p GROUP BY 1""",
    "content_kinds": "SELECT content_kind, count(DISTINCT i.id) AS n_interactions, count(DISTINCT i.trace_id) AS n_traces FROM interaction_legs l JOIN interactions i ON i.id = l.interaction_id WHERE content_kind IS NOT NULL GROUP BY 1",
    "leg_unions": "SELECT interaction_id, coalesce(array_to_string(list_sort(list(DISTINCT content_kind) FILTER (content_kind IS NOT NULL)), ','), '') AS kinds, bool_or(payload_hash IS NULL) AS has_gap FROM interaction_legs GROUP BY 1",
    "legs_behind_cursors": "SELECT interaction_id, leg_type, seq FROM interaction_legs JOIN (SELECT unnest(['request', 'response']) AS leg_type, unnest([500, 900]) AS after_) USING (leg_type) WHERE seq > after_",
    "leg_lineage_states": f"WITH RECURSIVE {_STATES} SELECT interaction_id, leg_type, seq, state FROM states",
    "ready_with_lineage": f"""WITH RECURSIVE {_STATES}, k AS (SELECT s.*, i.trace_id, payload_hash IS NOT NULL AND state = 'derived' AS ready FROM states s JOIN interactions i ON i.id = s.interaction_id), stops AS (SELECT trace_id, min(seq) AS stop FROM k WHERE NOT ready GROUP BY 1)
        SELECT k.trace_id, seq, interaction_id, leg_type FROM k LEFT JOIN stops USING (trace_id) WHERE stop IS NULL OR seq < stop""",
    "decision_roll_up": f"""WITH d AS ({plans._RULES}), x AS (SELECT d.*, i.trace_id, list_position(['critical', 'high', 'medium', 'low', 'none', 'unknown'], risk_level) AS r, list_position({_ENFORCE}, enforcement) AS f FROM d JOIN interactions i USING (id))
        SELECT trace_id, ['critical', 'high', 'medium', 'low', 'none', 'unknown'][min(r)] AS level, {_ENFORCE}[min(f)] AS enforcement, count(*) AS n_decisions, count(*) FILTER (fired <> '') AS n_events, round(avg(confidence), 3) AS confidence FROM x GROUP BY 1""",
    "span_windows": f"""WITH {traces.FINAL} SELECT service_name, count(*) FILTER ({_WITHIN.format(c='started_at', h=24)}) AS n_24h, count(*) FILTER ({_WITHIN.format(c='started_at', h=168)}) AS n_7d,
        count(*) FILTER ({_WITHIN.format(c='started_at', h=720)}) AS n_30d FROM final GROUP BY 1""",
    "trace_trees": f"WITH RECURSIVE {traces.problems._NODES}, {traces.problems._WALK} SELECT t AS trace_id, cur AS root_span_id, count(*) AS n_spans, max(d) AS deepest FROM ends WHERE up IS NULL GROUP BY 1, 2",
    "innermost_owners": f"WITH RECURSIVE {traces.FINAL}, " + traces.near_sql("own_", """SELECT f.trace_id, f.span_id, CASE WHEN p.service_name IS NOT DISTINCT FROM f.service_name THEN p.span_id END AS parent_id, coalesce(f.kind = 'SERVER', false) AS hit
        FROM final f LEFT JOIN final p ON p.trace_id = f.trace_id AND p.span_id = f.parent_id""") + " SELECT m.trace_id, m.span_id, n.ancestor FROM own_marks m LEFT JOIN own_ n USING (trace_id, span_id)",
    "host_matches": f"""WITH {traces.FINAL}, {traces.FACTS.format('final')}, h AS (SELECT {_URL_HOST} AS host FROM facts)
        SELECT host, count(*) AS n_spans, host LIKE '%.example' OR regexp_full_match(host, '10\\.[0-9]+\\.[0-9]+\\.[0-9]+') OR regexp_full_match(host, '192\\.168\\.[0-9]+\\.[0-9]+') AS listed FROM h WHERE host <> '' GROUP BY 1""",
    "service_names": """WITH r AS (SELECT service_name, count(*) AS n_rows FROM spans WHERE service_name IS NOT NULL GROUP BY 1), t AS (SELECT split_part(service_name, '-', 1) AS project FROM r ORDER BY n_rows DESC, service_name DESC LIMIT 1)
        SELECT service_name, CASE WHEN service_name LIKE project || '%' AND regexp_replace(service_name[len(project) + 1:], '^[-_]', '') <> '' THEN regexp_replace(service_name[len(project) + 1:], '^[-_]', '') ELSE service_name END AS canonical, n_rows FROM r, t""",
}
