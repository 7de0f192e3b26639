"""Who stands behind a span: callers of entry points, deployed tools, external services, messages and calls in attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.ids import normal_id
from spanloom.functions.text import bare_host, host_is_internal, hostname
from spanloom.operators import nested
from spanloom.operators.attributes import FRAMEWORK_KEYS, SIDECAR_KEYS
from spanloom.operators.hierarchy import nearest_ancestor
from spanloom.operators.listing import finalized_facts, root_candidates
from spanloom.store import Workspace

CALLER_KEYS = {"user": "lineage.principal.sub", "end_user": "enduser.id", "peer_service": "peer.service", "client_address": "client.address", "peer_name": "net.peer.name", "peer_ip": "net.peer.ip"}
#: Paths and names of requests that are no calls of a service.
PROBES = ["/healthz", "/readyz", "/livez", "/metrics"]


def root_callers(spans: DataFrame) -> DataFrame:
    """Caller of every server span that no span of its trace encloses: the user, else the client by the first hint there is,
    else provisional. Columns trace_id, span_id, service_name, caller_kind, caller."""
    facts = root_candidates(finalized_facts(spans, CALLER_KEYS)).where(F.col("kind") == "SERVER")
    user = F.coalesce("user", "end_user")
    client = F.coalesce("peer_service", "client_address", "peer_name", "peer_ip")
    return facts.select(
        "trace_id", "span_id", "service_name", F.when(user.isNotNull(), "user").when(client.isNotNull(), "client").otherwise("provisional").alias("caller_kind"), F.coalesce(user, client).alias("caller")
    )


def tool_transport(spans: DataFrame) -> DataFrame:
    """Of every tool span: deployed if a server span below it, with no tool span between, takes an MCP post; in_process if such
    a server belongs to another service; undecided if there is none."""
    work = Workspace(spans.sparkSession, "transport")
    rows, _ = work.save(finalized_facts(spans, {"oi_kind": "openinference.span.kind"}).withColumn("tool", F.lower("oi_kind") == "tool"))
    near = nearest_ancestor(rows, "tool")
    servers = rows.where(F.col("kind") == "SERVER").select("trace_id", "span_id", F.col("name").alias("server_name"), F.col("service_name").alias("server_service")).join(near, ["trace_id", "span_id"])
    tools = rows.where("tool").select("trace_id", F.col("span_id").alias("ancestor"), "service_name")
    seen = servers.join(tools, ["trace_id", "ancestor"]).groupBy("trace_id", F.col("ancestor").alias("span_id")).agg(
        F.bool_or(F.col("server_name").startswith("POST /mcp")).alias("mcp"), F.bool_or(~F.col("server_service").eqNullSafe(F.col("service_name"))).alias("other")
    )
    return rows.where("tool").select("trace_id", "span_id", "name").join(seen, ["trace_id", "span_id"], "left").select(
        "trace_id", "span_id", "name", F.when(F.col("mcp"), "deployed").when(F.col("other"), "in_process").otherwise("undecided").alias("transport")
    )


def external_calls(spans: DataFrame) -> DataFrame:
    """Client spans that call a host outside: with an external host in their URL, no server span right below, and no probe,
    discovery or MCP request."""
    rows = finalized_facts(spans, FRAMEWORK_KEYS)
    path = F.coalesce(F.try_parse_url("http_url", F.lit("PATH")), F.lit(""))
    host = hostname(F.col("http_url"))
    plumbing = path.isin(PROBES) | path.startswith("/mcp") | path.startswith("/.well-known/") | (F.col("name") == "POST /")
    outside = (host != "") & ~host_is_internal(host)
    answered = rows.where(F.col("kind") == "SERVER").select("trace_id", F.col("parent_id").alias("span_id")).where("span_id is not null").distinct()
    calls = rows.where((F.col("kind") == "CLIENT") & outside & ~F.coalesce(plumbing, F.lit(False)))
    return calls.join(answered, ["trace_id", "span_id"], "left_anti").select("trace_id", "span_id", "service_name", bare_host(host).alias("host"), F.col("status_code").try_cast("int").alias("status_code"))


def messages(spans: DataFrame, key: str = "arrival_seq") -> DataFrame:
    """Messages of model calls in any notation: key, side (input or output), position, role, content, number of tool calls."""
    nodes = nested.flatten(spans, key, ["attributes"], [], fields=True)
    at = F.regexp_extract("schema_path", r"^attributes\.llm\.(input|output)_messages\.\*$", 1)
    msgs = nodes.where(at != "").select(key, F.col("path").alias("message"), at.alias("side"), F.regexp_extract("path", r"\.([0-9]+)$", 1).cast("int").alias("position"), F.get_json_object("fields", "$['message.role']").alias("role"), F.get_json_object("fields", "$['message.content']").alias("content"))
    calls = nodes.where(F.col("schema_path").rlike(r"^attributes\.llm\.(input|output)_messages\.\*\.message\.tool_calls\.\*$"))
    # a message without fields of its own still has its calls: both sides are kept
    n = calls.groupBy(key, F.col("parent_path").alias("message")).agg(F.count("*").alias("n"))
    return msgs.join(n, [key, "message"], "left").select(key, "side", "position", "role", "content", F.coalesce("n", F.lit(0)).alias("n_tool_calls"))


def inferred_tool_calls(spans: DataFrame) -> DataFrame:
    """Tool calls a model asked for in its output of which no tool span of the trace tells: trace_id, tool, n_asked, n_seen."""
    work = Workspace(spans.sparkSession, "inferred")
    rows, _ = work.save(finalized_facts(spans, {"oi_kind": "openinference.span.kind", "tool": "tool.name"}, F.col("arrival_seq").alias("body_seq")))
    # calls are read off every delivery and then kept where it is the one that counts
    nodes = nested.flatten(spans, "arrival_seq", ["attributes"], [], fields=True).where(F.col("schema_path") == "attributes.llm.output_messages.*.message.tool_calls.*")
    calls = nodes.select(F.col("arrival_seq").alias("body_seq"), F.get_json_object("fields", "$['tool_call.function.name']").alias("tool"))
    asked = calls.join(rows.select("body_seq", "trace_id"), "body_seq").groupBy("trace_id", "tool").agg(F.count("*").alias("n_asked"))
    told = rows.where(F.lower("oi_kind") == "tool").groupBy("trace_id", F.coalesce("tool", "name").alias("tool")).agg(F.count("*").alias("n_seen"))
    return asked.join(told, ["trace_id", "tool"], "left").select("trace_id", "tool", "n_asked", F.coalesce("n_seen", F.lit(0)).alias("n_seen")).where("n_asked > n_seen")


def tunnel_traces(spans: DataFrame) -> DataFrame:
    """Traces that are nothing but one tunnelled exchange: the listing root is a CONNECT request, and every span with an
    exchange id shares the root's."""
    rows = finalized_facts(spans, SIDECAR_KEYS)
    per = rows.groupBy("trace_id").agg(
        F.every(F.col("exchange_id").isNotNull()).alias("all_sidecar"), F.count_distinct(normal_id("exchange_id")).alias("n_exchanges"), F.min_by("http_method", F.struct(F.col("parent_id").isNotNull(), "started_at", "span_id")).alias("m"), F.count("*").alias("n_spans")
    )
    return per.where(F.col("all_sidecar") & (F.col("n_exchanges") == 1) & (F.upper("m") == "CONNECT")).select("trace_id", "n_spans")
