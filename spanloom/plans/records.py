"""Current-record analytics over versioned risk records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import records
from spanloom.sources.tables import table
from spanloom.vocab import RISK_ORDER, rank

START, END = "2018-03-08 00:00:00", "2018-03-15 00:00:00"


def _all(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "trace_risk_records")


def _current(spark: SparkSession, base: str) -> DataFrame:
    return records.latest(_all(spark, base), "trace_id")


def current_risk(spark: SparkSession, base: str) -> DataFrame:
    return _current(spark, base)


def risk_distribution(spark: SparkSession, base: str) -> DataFrame:
    """The window applies to the current record, after it was chosen."""
    rows = _current(spark, base).where((F.col("computed_at") >= F.lit(START).cast("timestamp")) & (F.col("computed_at") <= F.lit(END).cast("timestamp")))
    return records.distribution(rows, "trace_risk_level")


def risk_history(spark: SparkSession, base: str) -> DataFrame:
    """Number of versions, first and last level of each trace."""
    order = F.struct("version")
    return _all(spark, base).groupBy("trace_id").agg(F.count("*").alias("n_versions"), F.min_by("trace_risk_level", order).alias("first_level"), F.max_by("trace_risk_level", order).alias("last_level"), F.max("version").alias("version"))


def risk_top_traces(spark: SparkSession, base: str) -> DataFrame:
    rows = _current(spark, base).withColumn("level_rank", rank(F.col("trace_risk_level"), RISK_ORDER))
    return records.page(rows, [("level_rank", "asc"), ("computed_at", "desc"), ("trace_id", "asc")], None, 24).select("trace_id", "trace_risk_level", "level_rank", "computed_at", "interaction_count")


def risk_next_page(spark: SparkSession, base: str) -> DataFrame:
    rows = _current(spark, base).withColumn("level_rank", rank(F.col("trace_risk_level"), RISK_ORDER)).withColumn("us", F.unix_micros("computed_at"))
    return records.page(rows, [("level_rank", "asc"), ("us", "desc"), ("trace_id", "asc")], [2, 1520640000000000, ""], 24).select("trace_id", "trace_risk_level", "level_rank", "us")


def risk_roll_up(spark: SparkSession, base: str) -> DataFrame:
    return records.roll_up(_all(spark, base))


def risk_watermark(spark: SparkSession, base: str) -> DataFrame:
    return records.running_watermark(_all(spark, base)).select("trace_id", "version", "computed_at", "stream_at")


def risk_escalations(spark: SparkSession, base: str) -> DataFrame:
    return records.escalations(_all(spark, base)).select("trace_id", "version", "trace_risk_level", "action")


def risk_changes(spark: SparkSession, base: str) -> DataFrame:
    """What an append that skips unchanged content makes of the second versions, with the first as stored. Versions from 3 on
    are no part of it, as its SQL has it; ``risk_version_changes`` compares every version with the one before."""
    old = _all(spark, base).where("version = 1")
    new = records.latest(_all(spark, base).where("version <= 2"), "trace_id")
    return records.append_changed(old, new.drop("version"), ["trace_id"], ["trace_risk_level", "interaction_count"]).select("trace_id", "trace_risk_level", "interaction_count", "version")


def risk_version_changes(spark: SparkSession, base: str) -> DataFrame:
    """Versions, of any number, whose level or count differs from the version before: what an append that skips unchanged content would have kept."""
    return records.version_changes(_all(spark, base), "trace_id", ["trace_risk_level", "interaction_count"], ties=["trace_risk_id"]).select("trace_id", "version", "trace_risk_level", "interaction_count")


def risk_version_changed_keys(spark: SparkSession, base: str) -> DataFrame:
    """Traces with a version, of any number, that differs from the one before in level or policy events."""
    rows = records.version_changes(_all(spark, base), "trace_id", ["trace_risk_level", "policy_event_count"], ties=["trace_risk_id"])
    return rows.where("not _first").select("trace_id").distinct()


def risk_changed_keys(spark: SparkSession, base: str) -> DataFrame:
    """Traces that differ between their first and second version; later ones are in ``risk_version_changed_keys``."""
    a = _all(spark, base)
    return records.changed_keys(a.where("version = 1"), a.where("version = 2"), ["trace_id"], ["trace_risk_level", "policy_event_count"])


def risk_by_namespace(spark: SparkSession, base: str) -> DataFrame:
    """Traces with a current level of high or critical by namespace of the entities in them."""
    i, e = table(spark, base, "interactions"), table(spark, base, "entities")
    from spanloom.operators.interactions import entity_roles

    risky = _current(spark, base).where(F.col("trace_risk_level").isin("high", "critical")).select("trace_id")
    rows = entity_roles(i).join(risky, "trace_id", "left_semi").join(e.select(F.col("id").alias("entity_id"), "namespace"), "entity_id")
    return rows.groupBy("namespace").agg(F.count_distinct("trace_id").alias("n_traces"), F.count("*").alias("n_mentions"))


QUERIES = {f.__name__: f for f in (current_risk, risk_distribution, risk_history, risk_top_traces, risk_next_page, risk_roll_up, risk_watermark, risk_escalations, risk_changes, risk_changed_keys, risk_version_changes, risk_version_changed_keys, risk_by_namespace)}

_CURRENT = "WITH current AS (SELECT * FROM trace_risk_records QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY version DESC) = 1)"
_RANK = "coalesce(list_position(['critical', 'high', 'medium', 'low', 'none', 'unknown'], trace_risk_level), 7)"
_LAGGED = """o AS (
        SELECT *, row_number() OVER w AS n, lag(trace_risk_level) OVER w AS level_before, lag(interaction_count) OVER w AS count_before, lag(policy_event_count) OVER w AS events_before
        FROM trace_risk_records WHERE version IS NOT NULL WINDOW w AS (PARTITION BY trace_id ORDER BY version, trace_risk_id NULLS FIRST))"""
SQL = {
    "current_risk": f"{_CURRENT} SELECT * FROM current",
    "risk_distribution": f"""{_CURRENT} SELECT v AS trace_risk_level, count(c.trace_id) AS n FROM (SELECT unnest(['critical', 'high', 'medium', 'low', 'none']) AS v)
        LEFT JOIN current c ON c.trace_risk_level = v AND computed_at >= TIMESTAMP '{START}' AND computed_at <= TIMESTAMP '{END}' GROUP BY v""",
    "risk_history": "SELECT trace_id, count(*) AS n_versions, arg_min(trace_risk_level, version) AS first_level, arg_max(trace_risk_level, version) AS last_level, max(version) AS version FROM trace_risk_records GROUP BY 1",
    "risk_top_traces": f"{_CURRENT} SELECT trace_id, trace_risk_level, {_RANK} AS level_rank, computed_at, interaction_count FROM current ORDER BY level_rank, computed_at DESC, trace_id LIMIT 25",
    "risk_next_page": f"""{_CURRENT}, r AS (SELECT *, {_RANK} AS level_rank, epoch_us(computed_at) AS us FROM current)
        SELECT trace_id, trace_risk_level, level_rank, us FROM r WHERE level_rank > 2 OR (level_rank = 2 AND us < 1520640000000000) OR (level_rank = 2 AND us = 1520640000000000 AND trace_id > '') ORDER BY level_rank, us DESC, trace_id LIMIT 25""",
    "risk_roll_up": f"""SELECT trace_id, coalesce(list_extract(['critical', 'high', 'medium', 'low', 'none', 'unknown'], min({_RANK}) FILTER ({_RANK} <= 6)), 'none') AS level, count(*) AS n_records,
        CAST(sum(interaction_count) AS BIGINT) AS interaction_count, CAST(sum(policy_event_count) AS BIGINT) AS policy_event_count FROM trace_risk_records GROUP BY 1""",
    "risk_watermark": "SELECT trace_id, version, computed_at, max(computed_at) OVER (PARTITION BY trace_id ORDER BY version, computed_at ROWS UNBOUNDED PRECEDING) AS stream_at FROM trace_risk_records",
    "risk_escalations": f"""WITH a AS (SELECT *, {_RANK} AS r FROM trace_risk_records WHERE {_RANK} <= 2), b AS (SELECT *, min(r) OVER (PARTITION BY trace_id ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM a)
        SELECT trace_id, version, trace_risk_level, CASE WHEN best IS NULL THEN 'created' WHEN r < best THEN 'superseded' ELSE 'duplicate' END AS action FROM b""",
    "risk_changes": """WITH o AS (SELECT * FROM trace_risk_records WHERE version = 1), n AS (SELECT * FROM trace_risk_records WHERE version <= 2 QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY version DESC) = 1)
        SELECT n.trace_id, n.trace_risk_level, n.interaction_count, coalesce(o.version, 0) + 1 AS version FROM n LEFT JOIN o USING (trace_id)
        WHERE o.trace_id IS NULL OR n.trace_risk_level IS DISTINCT FROM o.trace_risk_level OR n.interaction_count IS DISTINCT FROM o.interaction_count""",
    "risk_changed_keys": """WITH a AS (SELECT * FROM trace_risk_records WHERE version = 1), b AS (SELECT * FROM trace_risk_records WHERE version = 2)
        SELECT coalesce(a.trace_id, b.trace_id) AS trace_id FROM a FULL JOIN b ON a.trace_id = b.trace_id
        WHERE a.trace_id IS NULL OR b.trace_id IS NULL OR a.trace_risk_level IS DISTINCT FROM b.trace_risk_level OR a.policy_event_count IS DISTINCT FROM b.policy_event_count""",
    "risk_version_changes": f"""WITH {_LAGGED} SELECT trace_id, version, trace_risk_level, interaction_count FROM o
        WHERE n = 1 OR trace_risk_level IS DISTINCT FROM level_before OR interaction_count IS DISTINCT FROM count_before""",
    "risk_version_changed_keys": f"""WITH {_LAGGED} SELECT DISTINCT trace_id FROM o
        WHERE n > 1 AND (trace_risk_level IS DISTINCT FROM level_before OR policy_event_count IS DISTINCT FROM events_before)""",
    "risk_by_namespace": f"""{_CURRENT}, m AS (SELECT DISTINCT i.id, i.trace_id, e.id AS eid, e.namespace FROM interactions i JOIN entities e ON e.id IN (i.caller_entity_id, i.callee_entity_id))
        SELECT namespace, count(DISTINCT trace_id) AS n_traces, count(*) AS n_mentions FROM m WHERE trace_id IN (SELECT trace_id FROM current WHERE trace_risk_level IN ('high', 'critical')) GROUP BY 1""",
}
