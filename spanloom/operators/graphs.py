"""The span graph: transport and agentic spans, components of agentic work cut by transport, calls between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import bare_host, hostname, strip_provider
from spanloom.operators.attributes import FRAMEWORK_KEYS, is_agentic_scope, is_transport_scope
from spanloom.operators.hierarchy import nearest_ancestor
from spanloom.operators.listing import finalized, finalized_facts
from spanloom.store import Workspace


def coloured(spans: DataFrame) -> DataFrame:
    """One row per span with its colour: teal for transport, blue for agentic work, white for the rest; and, for blue spans,
    the typed key of the entity behind it."""
    rows = finalized_facts(spans, FRAMEWORK_KEYS, F.col("scope.name").alias("scope_name"))
    scope = F.col("scope_name")
    kind = F.lower("oi_kind")
    blue = is_agentic_scope(scope) | kind.isNotNull()
    teal = is_transport_scope(scope) & ~blue
    model = strip_provider(F.col("llm_model"))
    key = F.when(kind == "llm", F.concat(F.lit("llm:"), F.coalesce(model, F.lit("(unknown)")))).when(kind == "tool", F.concat(F.lit("tool:"), F.coalesce("tool_name", "name"))).when(blue, F.concat(F.lit("agent:"), F.coalesce("agent_name", "service_name", F.lit("(unknown)"))))
    return rows.select("trace_id", "span_id", "parent_id", "name", "kind", "service_name", "started_at", "ended_at", "error", "arrival_seq", F.when(blue, "blue").when(teal, "teal").otherwise("white").alias("colour"), key.alias("entity_key"))


def calls(spans: DataFrame) -> DataFrame:
    """Calls between entities: for every blue span the nearest blue span above it, if that belongs to another entity."""
    work = Workspace(spans.sparkSession, "calls")
    rows, _ = work.save(coloured(spans))
    near = nearest_ancestor(rows.withColumn("blue", F.col("colour") == "blue"), "blue")
    blue = rows.where("colour = 'blue'")
    up = blue.select("trace_id", F.col("span_id").alias("ancestor"), F.col("entity_key").alias("caller_key"))
    pairs = blue.join(near, ["trace_id", "span_id"]).join(up, ["trace_id", "ancestor"])
    return pairs.where(F.col("caller_key") != F.col("entity_key")).select("trace_id", "span_id", "caller_key", F.col("entity_key").alias("callee_key"), "started_at", "ended_at", "error")


def components(spans: DataFrame) -> DataFrame:
    """Connected pieces of each trace once the edges at transport spans are cut: span and the root of its piece.

    After the cut every piece is a tree, so its name is its topmost span and the walk up is the hierarchy's."""
    from spanloom.operators.hierarchy import hierarchy

    work = Workspace(spans.sparkSession, "components")
    rows, _ = work.save(coloured(spans).where("colour <> 'teal'"))
    return hierarchy(rows).select("trace_id", "span_id", F.col("root_span_id").alias("component"), "depth")


def entity_edges(spans: DataFrame) -> DataFrame:
    """Calls by pair of entities: number, traces, errors, first and last start."""
    return calls(spans).groupBy("caller_key", "callee_key").agg(
        F.count("*").alias("n_calls"), F.count_distinct("trace_id").alias("n_traces"), F.count_if("error").alias("n_errors"), F.min("started_at").alias("first_at"), F.max("started_at").alias("last_at")
    )


def cross_service(spans: DataFrame) -> DataFrame:
    """Server spans whose parent belongs to another service: caller service, callee service, calls."""
    rows = finalized(spans.select("trace_id", "span_id", "parent_id", "arrival_seq", "started_at", "ended_at", "observed_at", "name", "kind", "service_name", "error"))
    up = rows.select("trace_id", F.col("span_id").alias("parent_id"), F.col("service_name").alias("caller_service"))
    pairs = rows.where(F.col("kind") == "SERVER").join(up, ["trace_id", "parent_id"])
    return pairs.where(F.col("caller_service") != F.col("service_name")).groupBy("caller_service", F.col("service_name").alias("callee_service")).agg(F.count("*").alias("n_calls"), F.count_if("error").alias("n_errors"))


def stack_pairs(events: DataFrame, key: list[str], order: str, opens: Column) -> DataFrame:
    """Requests and responses of one key matched as a stack: each response closes the last request still open; one that finds
    none open closes nothing. Adds ``level`` and ``opened_by`` (the order value of the request) and keeps responses that close.

    No stack is kept: the height after each event is a running sum, lifted by its own lowest value below zero; at one height
    requests and responses take turns, so a response's request is the row before it there."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = events.withColumn("_o", opens).withColumn("_s", F.sum(F.when(F.col("_o"), 1).otherwise(-1)).over(w))
    rows = rows.withColumn("_h", F.col("_s") - F.least(F.lit(0), F.min("_s").over(w)))
    rows = rows.withColumn("_low", F.lag("_h", 1, 0).over(Window.partitionBy(*key).orderBy(order)))
    rows = rows.withColumn("level", F.when(F.col("_o"), F.col("_h")).otherwise(F.col("_low")))
    same = Window.partitionBy(*key, "level").orderBy(order)
    rows = rows.where(F.col("_o") | (F.col("_low") > 0)).withColumn("opened_by", F.lag(order).over(same))
    return rows.where(~F.col("_o")).drop("_o", "_s", "_h", "_low")


def boundary_peers(spans: DataFrame) -> DataFrame:
    """Spans at the edge of what was recorded, with a stand-in for the other side: clients that no server span answers (the
    host or service they name), and servers that no client span called (an unknown client)."""
    rows = finalized_facts(spans, FRAMEWORK_KEYS)
    kinds = rows.select("trace_id", "span_id", F.col("kind").alias("up_kind"))
    answered = rows.where(F.col("kind") == "SERVER").select("trace_id", F.col("parent_id").alias("span_id")).where("span_id is not null").distinct()
    peer = F.coalesce("peer_service", "server_address", "peer_name", F.nullif(bare_host(hostname(F.col("http_url"))), F.lit("")), F.lit("(unknown)"))
    out = rows.where(F.col("kind") == "CLIENT").join(answered, ["trace_id", "span_id"], "left_anti").select("trace_id", "span_id", F.lit("callee").alias("side"), F.concat(F.lit("service:"), peer).alias("peer"))
    called = rows.where(F.col("kind") == "SERVER").join(kinds.withColumnRenamed("span_id", "parent_id"), ["trace_id", "parent_id"], "left")
    into = called.where(~F.col("up_kind").eqNullSafe(F.lit("CLIENT"))).select("trace_id", "span_id", F.lit("caller").alias("side"), F.lit("client:(unknown)").alias("peer"))
    return out.unionByName(into)


def merged_calls(asked: DataFrame, seen: DataFrame) -> DataFrame:
    """Tool calls that a model asked for (trace_id, tool, at) against those that were seen (trace_id, tool, at): the n-th asked
    of a tool in a trace is the n-th seen; what is left over was only asked for, or only seen."""
    nth = lambda df, name: df.select("trace_id", "tool", F.col("at").alias(name), F.row_number().over(Window.partitionBy("trace_id", "tool").orderBy("at")).alias("n"))
    both = nth(asked, "asked_at").join(nth(seen, "seen_at"), ["trace_id", "tool", "n"], "full")
    return both.withColumn("state", F.when(F.col("seen_at").isNull(), "asked").when(F.col("asked_at").isNull(), "seen").otherwise("merged"))


def transport_chains(spans: DataFrame) -> DataFrame:
    """Calls that went over recorded transport: agentic spans whose nearest agentic span above is not their parent, with the
    number of spans between."""
    work = Workspace(spans.sparkSession, "chains")
    rows, _ = work.save(coloured(spans))
    near = nearest_ancestor(rows.withColumn("blue", F.col("colour") == "blue"), "blue", hops=True)
    return rows.where("colour = 'blue'").select("trace_id", "span_id", "entity_key").join(near.where("hops > 1"), ["trace_id", "span_id"]).select("trace_id", "span_id", "entity_key", "ancestor", (F.col("hops") - 1).alias("n_between"))
