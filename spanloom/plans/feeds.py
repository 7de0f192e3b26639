"""Registered queries over sources and classification: export requests decoded and replayed, payloads by hash, verdicts on texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.ids import normal_id
from spanloom.operators import classify, listing
from spanloom.plans.interactions import RULES
from spanloom.plans.traces import FINAL, SLIM
from spanloom.schemas import OTLP_REQUEST
from spanloom.sources import otlp
from spanloom.sources.tables import table

SALT, NOW = "replay", "2024-01-01 00:00:00"


def _spans(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "spans")


def _requests(spans: DataFrame) -> DataFrame:
    """Every delivery as an export request of its own, in the wire's JSON shape."""
    kinds = ("stringValue", "intValue")  # nulls are left out of the JSON
    pair = lambda key, kind, value: F.struct(F.lit(key).alias("key"), F.struct(*[(value if k == kind else F.lit(None).cast("string")).alias(k) for k in kinds]).alias("value"))
    nano = lambda c: F.concat(F.unix_micros(c).cast("string"), F.lit("000"))
    events = F.transform("events", lambda e: F.struct(e["name"].alias("name"), e["time_unix_nano"].cast("string").alias("timeUnixNano")))
    span = F.struct(
        F.upper("trace_id").alias("traceId"), F.upper("span_id").alias("spanId"), F.coalesce("parent_id", F.lit("")).alias("parentSpanId"), F.col("name"), (F.array_position(F.array(*map(F.lit, otlp.KINDS)), F.col("kind")) - 1).alias("kind"),
        nano(F.col("started_at")).alias("startTimeUnixNano"), F.coalesce(nano(F.col("ended_at")), F.lit("0")).alias("endTimeUnixNano"), events.alias("events"),
        F.array(pair("batch", "intValue", F.col("batch_id").cast("string")), pair("seq", "stringValue", F.col("arrival_seq").cast("string"))).alias("attributes"),
        F.struct(F.when(F.col("error"), 2).when(~F.col("error"), 1).otherwise(0).alias("code"), F.coalesce("status_message", F.lit("")).alias("message")).alias("status"),
    )
    request = F.struct(F.array(F.struct(F.struct(F.array(pair("service.name", "stringValue", F.col("service_name"))).alias("attributes")).alias("resource"), F.array(F.struct(F.col("scope"), F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans"))
    return spans.select(F.from_json(F.to_json(request), OTLP_REQUEST).alias("r")).select("r.*")


def otlp_decoded(spark: SparkSession, base: str) -> DataFrame:
    rows = otlp.to_spans(_requests(_spans(spark, base)))
    fact = lambda key: F.get_json_object("attributes", f"$['{key}']").cast("long")
    return rows.select(
        fact("seq").alias("arrival_seq"), fact("batch").alias("batch_id"), "trace_id", "span_id", "parent_id", "name", "kind", "service_name", F.col("scope.name").alias("scope_name"), "started_at", "ended_at", "error", "status_message",
        F.coalesce(F.size("events"), F.lit(-1)).alias("n_events"), F.get(F.col("events"), 0)["time_unix_nano"].alias("first_event_ns"),
    )


def otlp_rejected(spark: SparkSession, base: str) -> DataFrame:
    """Deliveries that can't be stored as they are written, by reason."""
    return otlp.split_rejected(_spans(spark, base))[1].groupBy("reason").agg(F.count("*").alias("n_rows"))


def spans_replayed(spark: SparkSession, base: str) -> DataFrame:
    """All spans under new ids, moved so that the latest start is now."""
    rows = _spans(spark, base).select("arrival_seq", "started_at", "ended_at", *[normal_id(c).alias(c) for c in ("trace_id", "span_id", "parent_id")])
    return otlp.new_ids(otlp.shift_to(rows, NOW), SALT)


def spans_regrouped(spark: SparkSession, base: str) -> DataFrame:
    """How many resource and scope groups a trace's spans make when they are exported again."""
    rows = listing.finalized(_spans(spark, base).select(*SLIM, "scope", F.col("service_name").alias("resource_attributes"), "attributes"))
    return otlp.regroup(rows).groupBy("trace_id").agg(F.count("*").alias("n_groups"), F.sum(F.size("spans")).alias("n_spans"))


def span_filter(seq_after: int | None = None, seq_before: int | None = None, **equal: object) -> Column:
    """A filter of spans: a cursor in one direction, and any of trace_id, span_id, parent_id, service_name, kind, error."""
    if seq_after is not None and seq_before is not None:
        raise ValueError("a cursor goes one way")
    allowed = {"trace_id", "span_id", "parent_id", "service_name", "kind", "error", "name"}
    if set(equal) - allowed:
        raise ValueError(f"no filter on {sorted(set(equal) - allowed)[0]}")
    if "span_id" in equal and "trace_id" not in equal:
        raise ValueError("a span is named within its trace")
    c = F.lit(True)
    if seq_after is not None:
        c &= F.col("seq") > seq_after
    if seq_before is not None:
        c &= F.col("seq") < seq_before
    for name, value in equal.items():
        c &= F.col(name).isNull() if value is None else F.col(name) == F.lit(value)
    return c


def page_limit(limit: int, most: int = 1000) -> int:
    """A page's size, at most ``most``."""
    if limit < 1:
        raise ValueError("a page has at least one row")
    return min(limit, most)


def span_page_back(spark: SparkSession, base: str) -> DataFrame:
    """The page before a cursor, newest first, of failed server spans."""
    rows = listing.finalized(_spans(spark, base).select(*SLIM)).where(span_filter(seq_before=5000, kind="SERVER", error=True))
    return rows.orderBy(F.desc("seq")).limit(page_limit(100)).select("seq", "trace_id", "span_id", "name")


def children_of_roots(spark: SparkSession, base: str) -> DataFrame:
    rows = listing.finalized(_spans(spark, base).select(*SLIM))
    roots = rows.where("parent_id is null").select("trace_id", F.col("span_id").alias("parent_id"))
    return rows.join(roots, ["trace_id", "parent_id"], "left_semi").select("trace_id", "parent_id", "span_id", "name", "started_at")


def span_wire(spark: SparkSession, base: str) -> DataFrame:
    """Spans as they go over the wire."""
    rows = listing.finalized(_spans(spark, base).select(*SLIM))
    return rows.select("trace_id", "span_id", F.to_json(F.struct("trace_id", "span_id", "parent_id", "kind", "service_name", "error"), {"ignoreNullFields": "false"}).alias("wire"))


def payloads_of_failures(spark: SparkSession, base: str) -> DataFrame:
    """All legs that carry one of the payloads of a failed leg: a fetch by a set of hashes."""
    legs = table(spark, base, "interaction_legs")
    hashes = legs.where("error and payload_hash is not null").select("payload_hash").distinct()
    return legs.join(hashes, "payload_hash", "left_semi").select("interaction_id", "leg_type", "seq", "payload_hash")


def payload_first_seen(spark: SparkSession, base: str) -> DataFrame:
    """Payloads by hash, written by the leg that brought them first."""
    legs = table(spark, base, "interaction_legs").where("payload_hash is not null")
    return legs.groupBy("payload_hash").agg(F.min("seq").alias("first_seq"), F.min_by("content_kind", "seq").alias("content_kind"), F.count("*").alias("n_legs"))


def rule_catalog(spark: SparkSession, base: str) -> DataFrame:
    """Rules flattened to one row per condition."""
    rows = [(r["id"], r["risk_level"], r["enforcement"], float(r["confidence"]), k, ",".join(v) if isinstance(v, list) else v) for r in RULES for k, v in r["when"].items()]
    return spark.createDataFrame(rows, "rule_id string, risk_level string, enforcement string, confidence double, field string, wants string")


def document_verdicts(spark: SparkSession, base: str) -> DataFrame:
    """Sensitivity, regulatory tags, identity bundle and domain of each document."""
    return classify.verdicts(table(spark, base, "documents"), "doc_id", "text").withColumn("regulatory_tags", F.array_join("regulatory_tags", ","))


QUERIES = {
    f.__name__: f
    for f in (
        otlp_decoded, otlp_rejected, spans_replayed, spans_regrouped, span_page_back, children_of_roots, span_wire, payloads_of_failures, payload_first_seen, rule_catalog, document_verdicts,
    )
}

_W = "\\p{L}\\p{N}_"
_COUNT = "coalesce(len(regexp_extract_all({of}, '{p}')), 0)"
_FOUND = {
    "email": _COUNT.format(of="text", p=f"[{_W}.+-]+@[A-Za-z][{_W}-]*(?:\\.[A-Za-z][{_W}-]*)+"),
    "ssn": _COUNT.format(of="wide", p="(?:^|[^0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?:$|[^0-9-])"),
    "ip": _COUNT.format(of="wide", p="(?:^|[^0-9.])(?:[0-9]{1,3}\\.){3}[0-9]{1,3}(?:$|[^0-9.])"),
    "day": _COUNT.format(of="wide", p="(?:^|[^0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?:$|[^0-9-])"),
    "card": _COUNT.format(of="wide", p="(?:^|[^0-9])[0-9]{13,19}(?:$|[^0-9])"),
    "phone": _COUNT.format(of="text", p=f"(?:^|[^{_W}.])(?:\\+[0-9]{{1,2}} |\\()?[0-9]{{3}}\\)?[ .-][0-9]{{3}}[ .-][0-9]{{4}}(?:$|[^{_W}-])"),
}
SQL = {
    "otlp_decoded": """SELECT arrival_seq, batch_id, lower(trace_id) AS trace_id, lower(span_id) AS span_id, nullif(lower(parent_id), '') AS parent_id, name, kind, service_name, scope.name AS scope_name, started_at, ended_at, error, nullif(status_message, '') AS status_message,
        CASE WHEN len(events) > 0 THEN len(events) ELSE -1 END AS n_events, events[1].time_unix_nano AS first_event_ns FROM spans""",
    "otlp_rejected": r"""SELECT reason, count(*) AS n_rows FROM (
            SELECT CASE WHEN NOT coalesce(regexp_full_match(trace_id, '[0-9a-f]{32}') AND regexp_full_match(span_id, '[0-9a-f]{16}'), false) THEN 'id' WHEN started_at IS NULL THEN 'no start' WHEN contains(coalesce(attributes, ''), '\u0000') THEN 'NUL' END AS reason FROM spans)
        WHERE reason IS NOT NULL GROUP BY 1""",
    "spans_replayed": f"""WITH n AS (SELECT arrival_seq, started_at, ended_at, nullif(regexp_replace(lower(trace_id), '[^0-9a-f]', '', 'g'), '') AS t, nullif(regexp_replace(lower(span_id), '[^0-9a-f]', '', 'g'), '') AS s, nullif(regexp_replace(lower(parent_id), '[^0-9a-f]', '', 'g'), '') AS p FROM spans),
        m AS (SELECT epoch_us(TIMESTAMP '{NOW}') - max(epoch_us(started_at)) AS by_us FROM n)
        SELECT arrival_seq, make_timestamp(epoch_us(started_at) + by_us) AS started_at, make_timestamp(epoch_us(ended_at) + by_us) AS ended_at, md5('{SALT}' || t)[1:32] AS trace_id, md5('{SALT}' || s)[1:16] AS span_id, md5('{SALT}' || p)[1:16] AS parent_id FROM n, m""",
    "spans_regrouped": f"WITH {FINAL}, g AS (SELECT trace_id, service_name, scope, count(*) AS n FROM final GROUP BY 1, 2, 3) SELECT trace_id, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_spans FROM g GROUP BY 1",
    "span_page_back": f"WITH {FINAL} SELECT seq, trace_id, span_id, name FROM final WHERE seq < 5000 AND kind = 'SERVER' AND error ORDER BY seq DESC LIMIT 100",
    "children_of_roots": f"WITH {FINAL} SELECT f.trace_id, f.parent_id, f.span_id, f.name, f.started_at FROM final f JOIN final r ON r.trace_id = f.trace_id AND r.span_id = f.parent_id WHERE r.parent_id IS NULL",
    "span_wire": f"WITH {FINAL} SELECT trace_id, span_id, CAST(to_json({{'trace_id': trace_id, 'span_id': span_id, 'parent_id': parent_id, 'kind': kind, 'service_name': service_name, 'error': error}}) AS VARCHAR) AS wire FROM final",
    "payloads_of_failures": "SELECT interaction_id, leg_type, seq, payload_hash FROM interaction_legs WHERE payload_hash IN (SELECT payload_hash FROM interaction_legs WHERE error)",
    "payload_first_seen": "SELECT payload_hash, min(seq) AS first_seq, arg_min(content_kind, seq) AS content_kind, count(*) AS n_legs FROM interaction_legs WHERE payload_hash IS NOT NULL GROUP BY 1",
    "rule_catalog": """SELECT * FROM (VALUES ('R1', 'high', 'redact', 0.9::DOUBLE, 'source_kind', 'tool'), ('R1', 'high', 'redact', 0.9, 'target_kind', 'llm'), ('R2', 'medium', 'block', 0.8, 'source_kind', 'agent'),
        ('R2', 'medium', 'block', 0.8, 'target_kind', 'service'), ('R3', 'low', 'notify', 0.7, 'content_kinds', 'json')) AS t(rule_id, risk_level, enforcement, confidence, field, wants)""",
    "document_verdicts": f"""WITH w AS (SELECT doc_id, text, regexp_replace(text, '([^0-9.-])', '\\1\\1', 'g') AS wide FROM documents), c AS (SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in _FOUND.items())} FROM w)
        SELECT doc_id, CAST(email + ssn + ip + day + card + phone AS BIGINT) AS n_findings, CASE WHEN email + phone + ssn + card > 0 THEN 'RESTRICTED' WHEN ip + day > 0 THEN 'INTERNAL' ELSE 'PUBLIC' END AS level,
               concat_ws(',', CASE WHEN card > 0 THEN 'PCI' END, CASE WHEN ip + day > 0 THEN 'PI' END, CASE WHEN email + phone + ssn > 0 THEN 'PII' END) AS regulatory_tags, email > 0 AND phone > 0 AS has_bundle, email + phone + ssn + card > 0 AS personalised,
               CASE WHEN card > 0 THEN 'finance' WHEN email + phone + ssn + day > 0 THEN 'person' WHEN ip > 0 THEN 'operations' END AS primary_domain FROM c""",
}
