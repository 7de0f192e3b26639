"""Typed facts out of schemaless span attributes.

The document is parsed once per row into a variant; each fact is one path into it. Documents that are null or not valid
JSON give null facts. All columns, no joins, no Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.ids import normal_id

#: Fact column by attribute key.
SIDECAR_KEYS = {
    "role": "lineage.role", "direction": "lineage.direction", "protocol": "lineage.protocol", "exchange_id": "lineage.exchange.id", "self_id": "lineage.self.id",
    "self_namespace": "lineage.self.namespace", "peer_host": "lineage.peer.host", "principal_sub": "lineage.principal.sub", "principal_client": "lineage.principal.client",
    "outcome": "lineage.outcome", "model": "inference.model", "mcp_method": "mcp.method", "http_method": "http.method", "url_path": "url.path",
}
FRAMEWORK_KEYS = {
    "oi_kind": "openinference.span.kind", "llm_model": "llm.model_name", "tool_name": "tool.name", "agent_name": "agent.name", "http_url": "http.url", "peer_service": "peer.service",
    "status_code": "http.status_code", "server_address": "server.address", "peer_name": "net.peer.name",
}

# What the two sides of an exchange are, and what its bodies are, by (direction, protocol).
EXCHANGE_KINDS = [
    ("inbound", "a2a", "user", "agent", "agent_request", "agent_response"),
    ("inbound", "mcp", "user", "tool", "tool_call_arguments", "tool_call_result"),
    ("inbound", "inference", "user", "llm", "llm_chat_prompt", "llm_completion"),
    ("inbound", "http", "user", "agent", "http_request_body", "http_response_body"),
    ("outbound", "a2a", "agent", "agent", "agent_request", "agent_response"),
    ("outbound", "mcp", "agent", "tool", "tool_call_arguments", "tool_call_result"),
    ("outbound", "inference", "agent", "llm", "llm_chat_prompt", "llm_completion"),
    ("outbound", "http", "agent", "service", "http_request_body", "http_response_body"),
]
# Methods of the tool protocol that are plumbing, and those that list what there is.
LIFECYCLE_METHODS = ["initialize", "ping"]
LIFECYCLE_PREFIXES = ["notifications/", "logging/", "$transport/"]
DISCOVERY_METHODS = ["tools/list", "resources/list", "prompts/list", "resources/templates/list"]
PLUMBING_PATHS = ["/mcp", "/sse"]

# Names of spans that are not stored, as full-match patterns, in order.
BLOCKED_NAMES = [
    r"(GET|POST) /healthz.*",
    r"GET /readyz",
    r"GET /livez",
    r"/healthz",
    r"/readyz",
    r"/livez",
    r"GET /metrics",
    r"/metrics",
    r"GET /\.well-known/agent-card\.json",
    r"GET /\.well-known/agent-card\.json http send",
    r"GET /\.well-known/agent-card\.json http receive",
    r"otlp_receiver/.*",
]


def attribute(doc: Column, key: str, kind: str = "string") -> Column:
    """One top-level attribute of a parsed document; null if absent or not of that kind."""
    return F.try_variant_get(doc, f'$["{key}"]', kind)


def first_attribute(doc: Column, keys: list[str]) -> Column:
    """The first that is there."""
    return F.coalesce(*[attribute(doc, k) for k in keys])


def with_facts(df: DataFrame, keys: dict[str, str], doc: str = "attributes") -> DataFrame:
    """``df`` with one string column per entry of ``keys``."""
    v = df.withColumn("_doc", F.try_parse_json(F.col(doc)))
    return v.withColumns({name: attribute(F.col("_doc"), key) for name, key in keys.items()}).drop("_doc")


def sidecar_spans(rows: DataFrame) -> DataFrame:
    """Spans with an exchange id, from rows with the facts of ``SIDECAR_KEYS``: ids in normal form, lower-case role, direction
    and protocol. A span that breaks the contract (unknown role, direction or protocol, or a request whose exchange id isn't
    its own span id) has ``violation`` set."""
    rows = rows.withColumns({
        **{c: normal_id(c) for c in ("trace_id", "span_id", "parent_id", "exchange_id")}, "role": F.lower("role"), "direction": F.lower("direction"), "protocol": F.lower("protocol"),
    }).where(F.col("exchange_id").isNotNull())
    known = F.col("role").isin("request", "response") & F.col("direction").isin("inbound", "outbound") & F.col("protocol").isin("a2a", "mcp", "inference", "http")
    own = (F.col("role") != "request") | (F.col("exchange_id") == F.col("span_id"))
    return rows.withColumn("violation", ~F.coalesce(known & own, F.lit(False)))


def _choose(pick: int) -> Column:
    whens = [((F.col("direction") == r[0]) & (F.col("protocol") == r[1]), r[pick]) for r in EXCHANGE_KINDS]
    return reduce(lambda c, w: c.when(*w), whens[1:], F.when(*whens[0]))


def exchange_kinds(rows: DataFrame) -> DataFrame:
    """Adds caller_kind, callee_kind, request_kind and response_kind to sidecar spans."""
    method = F.coalesce("mcp_method", F.lit(""))
    lifecycle = (F.col("protocol") == "mcp") & (method.isin(LIFECYCLE_METHODS) | reduce(Column.__or__, [method.startswith(p) for p in LIFECYCLE_PREFIXES]))
    lifecycle |= (F.col("protocol") == "http") & F.coalesce("url_path", F.lit("")).isin(PLUMBING_PATHS) & ~F.col("has_input")
    discovery = (F.col("protocol") == "mcp") & method.isin(DISCOVERY_METHODS)
    anonymous = (F.col("direction") == "inbound") & (F.coalesce("principal_sub", F.lit("")) == "")
    return rows.withColumns({
        "caller_kind": F.when(anonymous, "client").otherwise(_choose(2)), "callee_kind": _choose(3),
        "request_kind": F.when(lifecycle, "mcp_lifecycle_request").when(discovery, "tool_discovery_request").otherwise(_choose(4)),
        "response_kind": F.when(lifecycle, "mcp_lifecycle_result").when(discovery, "tool_discovery_result").otherwise(_choose(5)),
    })


def has_body(key: str, doc: str = "attributes") -> Column:
    """Whether a document has a body under a key, without reading it out."""
    return F.coalesce(attribute(F.try_parse_json(F.col(doc)), key).isNotNull(), F.lit(False))


def blocked_pattern(name: Column) -> Column:
    """The first pattern that matches the whole span name, else null."""
    return F.coalesce(*[F.when(name.rlike(f"^(?:{p})$"), F.lit(p)) for p in BLOCKED_NAMES])


def split_blocked(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The spans to keep, and the tally of the others by pattern: count and latest receipt."""
    marked = df.withColumn("pattern", blocked_pattern(F.col("name")))
    tally = marked.where(F.col("pattern").isNotNull()).groupBy("pattern").agg(F.count("*").alias("n_spans"), F.max("observed_at").alias("last_seen_at"))
    return marked.where(F.col("pattern").isNull()).drop("pattern"), tally


def outcome_error(outcome: Column, span_error: Column) -> Column:
    """ok: false; denied, error, abandoned: true; anything else: the span's own flag."""
    return F.when(outcome == "ok", F.lit(False)).when(outcome.isin("denied", "error", "abandoned"), F.lit(True)).otherwise(span_error)


def is_agentic_scope(name: Column) -> Column:
    return F.coalesce(name.startswith("openinference.instrumentation"), F.lit(False))


def is_transport_scope(name: Column) -> Column:
    return F.coalesce(name.startswith("opentelemetry.instrumentation"), F.lit(False))
