"""Who called whom: interactions, their legs and evidence, derived from sidecar spans; and reads over the result.

Everything here is joins and aggregates on (trace_id, span_id); the only walk, to the nearest anchor above a span, is by
pointer doubling, so no trace is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.ids import ENTITY_NAMESPACE, INTERACTION_NAMESPACE, normal_id, payload_digest, uuid5
from spanloom.functions.text import ident_key
from spanloom.operators.attributes import SIDECAR_KEYS, attribute, exchange_kinds, has_body, outcome_error, sidecar_spans
from spanloom.operators.hierarchy import nearest_ancestor, subtree_sums
from spanloom.operators.listing import finalized_facts
from spanloom.store import Workspace
from spanloom.vocab import ENTITY_KIND_ORDER, rank


def plan(spans: DataFrame) -> dict[str, DataFrame]:
    """The exchange plan of all traces: frames ``interactions``, ``legs``, ``evidence``, ``entities``, ``violations``.

    Anchors are all outbound requests, and inbound requests without an outbound request above them. An interaction's parent
    is the nearest anchor above. The echo of an outbound anchor, the first inbound request it encloses that names itself, tells
    which pod answered. Every other span belongs to its nearest anchor.
    """
    work = Workspace(spans.sparkSession, "plan")
    rows, _ = work.save(sidecar_rows(spans))
    side = exchange_kinds(sidecar_spans(rows))
    good = side.where(~F.col("violation"))
    requests = good.where(F.col("role") == "request")
    outbound = requests.where(F.col("direction") == "outbound").select("trace_id", "span_id", F.lit(True).alias("out"))
    tree, _ = work.save(rows.select("trace_id", "span_id", "parent_id").join(outbound, ["trace_id", "span_id"], "left"))
    above = nearest_ancestor(tree, "out").withColumnRenamed("ancestor", "outer")
    asked = requests.join(above, ["trace_id", "span_id"], "left")
    anchors, _ = work.save(asked.where((F.col("direction") == "outbound") | F.col("outer").isNull()))
    marks = anchors.select("trace_id", "span_id", F.lit(True).alias("anchor"))
    near, _ = work.save(nearest_ancestor(rows.select("trace_id", "span_id", "parent_id").join(marks, ["trace_id", "span_id"], "left"), "anchor").withColumnRenamed("ancestor", "owner"))

    inner = asked.where((F.col("direction") == "inbound") & F.col("outer").isNotNull() & F.col("self_id").isNotNull()).join(near, ["trace_id", "span_id"])
    echo = inner.groupBy("trace_id", F.col("owner").alias("span_id")).agg(
        F.min_by(F.struct(F.col("self_id").alias("echo_id"), F.col("self_namespace").alias("echo_namespace")), F.struct("arrival_seq", "span_id")).alias("e")
    ).select("trace_id", "span_id", "e.*")
    answers = good.where(F.col("role") == "response").groupBy("trace_id", "exchange_id").agg(
        F.min_by(F.struct(F.col("span_id").alias("response_span"), F.coalesce("ended_at", "started_at").alias("response_at"), F.col("body_seq").alias("response_seq"), outcome_error(F.col("outcome"), F.col("error")).alias("response_error")), F.struct("arrival_seq", "span_id")).alias("r")
    ).select("trace_id", F.col("exchange_id").alias("span_id"), "r.*")

    votes = self_kinds(requests)
    pod = ident_key(F.col("self_namespace"), F.col("self_id"))
    rows_ = anchors.join(echo, ["trace_id", "span_id"], "left").join(answers, ["trace_id", "span_id"], "left").withColumn("pod", pod).join(votes, ["trace_id", "pod"], "left")
    inbound = F.col("direction") == "inbound"
    model = F.concat(F.coalesce("peer_host", F.lit("(unknown)")), F.lit("/"), F.coalesce("model", F.lit("(unknown)")))
    far = F.coalesce(ident_key(F.col("echo_namespace"), F.col("echo_id")), F.lit(""))
    callee = F.when(F.col("callee_kind") == "llm", model).when(inbound, F.col("pod")).when(far != "", far).otherwise(F.coalesce("peer_host", F.lit("(unknown)")))
    own_kind = F.coalesce("voted", F.when(inbound, F.col("callee_kind")).otherwise(F.col("caller_kind")))
    caller = F.when(inbound & (F.col("caller_kind") == "user"), F.col("principal_sub")).when(inbound, F.coalesce("principal_client", F.lit("(unknown)"))).otherwise(F.col("pod"))
    caller_kind = F.when(inbound, F.col("caller_kind")).otherwise(own_kind)
    callee_kind = F.when(inbound & (F.col("callee_kind") != "llm"), own_kind).otherwise(F.col("callee_kind"))
    full = rows_.select(
        "*", F.concat_ws(":", caller_kind, caller).alias("caller_key"), F.concat_ws(":", callee_kind, callee).alias("callee_key"),
    ).join(near, ["trace_id", "span_id"], "left")
    full, _ = work.save(full)

    interactions = full.select(
        "trace_id", F.col("span_id").alias("anchor_span_id"), F.col("owner").alias("parent_span_id"), "caller_key", "callee_key", "direction", "protocol",
        F.concat(F.col("protocol"), F.lit(" call from "), F.coalesce("self_id", F.lit("(unknown)"))).alias("summary"),
    )
    ask = full.select("trace_id", F.col("span_id").alias("anchor_span_id"), F.lit("request").alias("leg_type"), F.col("started_at").alias("occurred_at"), F.col("body_seq"), F.lit(None).cast("boolean").alias("error"), F.col("request_kind").alias("content_kind"))
    reply = full.where(F.col("response_span").isNotNull()).select("trace_id", F.col("span_id").alias("anchor_span_id"), F.lit("response").alias("leg_type"), F.col("response_at").alias("occurred_at"), F.col("response_seq").alias("body_seq"), F.col("response_error").alias("error"), F.col("response_kind").alias("content_kind"))
    own = full.select("trace_id", "span_id", F.col("span_id").alias("anchor_span_id"), F.lit("anchor").alias("role"), F.lit("request").alias("leg_type"))
    others = near.where(F.col("owner").isNotNull()).join(marks, ["trace_id", "span_id"], "left_anti").join(full.select("trace_id", F.col("span_id").alias("owner"), "response_span"), ["trace_id", "owner"])
    link = others.select("trace_id", "span_id", F.col("owner").alias("anchor_span_id"), F.lit("connector").alias("role"), F.when(F.col("span_id") == F.col("response_span"), "response").alias("leg_type"))
    ends = F.explode(F.array(
        F.struct(F.col("caller_key").alias("natural_key"), F.when(~inbound, F.col("self_namespace")).alias("namespace")),
        F.struct(F.col("callee_key").alias("natural_key"), F.when(inbound, F.col("self_namespace")).otherwise(F.col("echo_namespace")).alias("namespace")),
    ))
    return {
        "interactions": interactions, "legs": ask.unionByName(reply), "evidence": own.unionByName(link),
        "entities": upsert_entities(full.select("arrival_seq", ends.alias("e")).select("arrival_seq", "e.*")), "violations": side.where("violation").select("trace_id", "span_id", "arrival_seq"),
    }


def sidecar_rows(spans: DataFrame) -> DataFrame:
    """Finalised spans with the facts of exchanges; of the bodies only whether there is one, and the delivery that has it."""
    return finalized_facts(spans, SIDECAR_KEYS, has_body("input.value").alias("has_input"), F.col("arrival_seq").alias("body_seq"))


def with_bodies(legs: DataFrame, spans: DataFrame) -> DataFrame:
    """Legs of a plan with ``body``: the text is read off the one delivery that a leg names, so bodies move once, and only those
    of legs."""
    doc = F.try_parse_json("attributes")
    texts = spans.select(F.col("arrival_seq").alias("body_seq"), "attributes").select(
        "body_seq", attribute(doc, "input.value").alias("_ask"), attribute(doc, "output.value").alias("_reply")
    )
    body = F.when(F.col("leg_type") == "request", F.col("_ask")).otherwise(F.col("_reply"))
    return legs.join(texts, "body_seq", "left").withColumn("body", body).drop("_ask", "_reply", "body_seq")


def self_kinds(requests: DataFrame) -> DataFrame:
    """What each pod of a trace is: the one kind it serves; an agent if it serves several, or only sends and speaks a2a or mcp."""
    served = F.collect_set(F.when(F.col("direction") == "inbound", F.col("callee_kind")))
    chatty = F.bool_or((F.col("direction") == "outbound") & F.col("protocol").isin("a2a", "mcp"))
    pods = requests.where(F.col("self_id").isNotNull()).groupBy("trace_id", ident_key(F.col("self_namespace"), F.col("self_id")).alias("pod")).agg(served.alias("served"), chatty.alias("chatty"))
    return pods.select("trace_id", "pod", F.when(F.size("served") == 1, F.col("served")[0]).when((F.size("served") > 1) | F.col("chatty"), "agent").alias("voted"))


def upsert_entities(mentions: DataFrame) -> DataFrame:
    """One row per natural key: kind, first mention, and the namespace last told."""
    told = F.max_by("namespace", F.when(F.col("namespace").isNotNull(), F.col("arrival_seq")))
    return mentions.groupBy("natural_key").agg(F.min("arrival_seq").alias("first_seq"), told.alias("namespace"), F.count("*").alias("n_mentions")).withColumn("kind", F.split_part("natural_key", F.lit(":"), F.lit(1)))


def with_ids(interactions: DataFrame) -> DataFrame:
    """Adds the deterministic ids of an interaction and of its two entities."""
    return interactions.withColumns({
        "id": uuid5(INTERACTION_NAMESPACE)(F.concat_ws("/", "trace_id", "anchor_span_id")), "caller_entity_id": uuid5(ENTITY_NAMESPACE)("caller_key"), "callee_entity_id": uuid5(ENTITY_NAMESPACE)("callee_key"),
    })


def payloads(legs: DataFrame) -> DataFrame:
    """Bodies by content: one row per digest of canonical JSON."""
    rows = legs.where(F.col("body").isNotNull()).select(payload_digest(F.col("body")).alias("content_hash"), F.octet_length("body").alias("byte_size"))
    return rows.groupBy("content_hash").agg(F.max("byte_size").alias("byte_size"), F.count("*").alias("n_legs"))


# reads over the interactions, interaction_legs and entities tables


def legs_by_interaction(legs: DataFrame) -> DataFrame:
    """Per interaction: first request and last response, duration in seconds (null if one is missing), error (any true, else
    any false, else null), highest seq, and whether a response is there. Repeated legs count by their lowest seq."""
    one = legs.groupBy("interaction_id", "leg_type").agg(F.min_by(F.struct("occurred_at", "error", "payload_hash", "content_kind"), "seq").alias("l"), F.max("seq").alias("seq"))
    is_request = F.col("leg_type") == "request"
    rows = one.groupBy("interaction_id").agg(
        F.max(F.when(is_request, F.col("l.occurred_at"))).alias("requested_at"), F.max(F.when(~is_request, F.col("l.occurred_at"))).alias("responded_at"),
        F.bool_or("l.error").alias("error"), F.max("seq").alias("max_seq"), F.bool_or(~is_request).alias("has_response"),
    )
    return rows.withColumn("duration_s", (F.unix_micros("responded_at") - F.unix_micros("requested_at")) / 1e6)


def feed(interactions: DataFrame, legs: DataFrame, since: int = 0, limit: int = 100) -> DataFrame:
    """Interactions by the latest seq of their legs, from a cursor on."""
    moved = legs.groupBy(F.col("interaction_id").alias("id")).agg(F.max("seq").alias("seq")).where(F.col("seq") > since)
    return interactions.join(moved, "id").select("id", "trace_id", "summary", "seq").orderBy("seq", "id").limit(limit)


def entity_roles(interactions: DataFrame) -> DataFrame:
    """One row per interaction and entity in it (once, also if it is on both sides): no theta join on "caller or callee"."""
    ends = F.array_distinct(F.filter(F.array("caller_entity_id", "callee_entity_id"), lambda e: e.isNotNull()))
    return interactions.select("id", "trace_id", F.explode(ends).alias("entity_id"))


def entity_activity(interactions: DataFrame, entities: DataFrame, risks: DataFrame) -> DataFrame:
    """Per entity: interactions, traces, and whether it's in a trace whose current level is high or critical."""
    risky = risks.where(F.col("trace_risk_level").isin("critical", "high")).select("trace_id", F.lit(True).alias("risky"))
    rows = entity_roles(interactions).join(risky, "trace_id", "left")
    # counts first, then the dimension: the join sees one row per entity
    seen = rows.groupBy("entity_id").agg(F.count("*").alias("n_interactions"), F.count_distinct("trace_id").alias("n_traces"), F.bool_or(F.coalesce("risky", F.lit(False))).alias("is_risky"))
    return entities.join(seen, entities["id"] == seen["entity_id"], "left").select("natural_key", "kind", F.coalesce("n_interactions", F.lit(0)).alias("n_interactions"), F.coalesce("n_traces", F.lit(0)).alias("n_traces"), F.coalesce("is_risky", F.lit(False)).alias("is_risky"))


def trace_entities(interactions: DataFrame, entities: DataFrame) -> DataFrame:
    """The entities of each trace, by kind in the fixed order of kinds."""
    pairs = entity_roles(interactions).select("trace_id", "entity_id").distinct()
    return pairs.join(entities, pairs["entity_id"] == entities["id"]).select("trace_id", "natural_key", "kind", rank(F.col("kind"), ENTITY_KIND_ORDER).alias("kind_rank"))


def contiguous_prefix(items: DataFrame, ready: str, order: str = "seq", key: str | None = None) -> DataFrame:
    """The rows before the first that isn't ready, of the whole stream or of each ``key``: one aggregate, then a filter."""
    waits = items.where(~F.coalesce(F.col(ready), F.lit(False)))
    if key is None:
        first = waits.agg(F.min(order).alias("_stop"))
        return items.join(F.broadcast(first), F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))).drop("_stop")  # one row
    first = waits.groupBy(key).agg(F.min(order).alias("_stop"))
    return items.join(first, key, "left").where(F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))).drop("_stop")


def version_tokens(legs: DataFrame, interactions: DataFrame) -> DataFrame:
    """Per trace a digest of its legs that changes exactly when one of them does: the ordered sum of row digests."""
    row = F.concat_ws("|", "interaction_id", "leg_type", F.unix_micros("occurred_at").cast("string"), F.coalesce("payload_hash", F.lit("")), F.coalesce(F.col("error").cast("string"), F.lit("")), F.col("seq").cast("string"))
    rows = legs.join(interactions.select(F.col("id").alias("interaction_id"), "trace_id"), "interaction_id").select("trace_id", "seq", F.md5(row).alias("d"))
    # 128-bit digests are added as four 32-bit sums: order-free, mergeable before the shuffle, no list per trace
    parts = [F.sum(F.conv(F.substring("d", 1 + 8 * i, 8), 16, 10).cast("long")).alias(f"p{i}") for i in range(4)]
    return rows.groupBy("trace_id").agg(F.count("*").alias("n_legs"), F.max("seq").alias("max_seq"), *parts)


def depths(interactions: DataFrame) -> DataFrame:
    """Depth and root of every interaction in its trace's forest."""
    from spanloom.operators.hierarchy import hierarchy

    got = hierarchy(interactions.withColumn("_o", F.lit(0)), "trace_id", "id", "parent_interaction_id", "_o")
    return got.select("trace_id", F.col("span_id").alias("id"), F.col("root_span_id").alias("root_id"), "depth")


TREE = {"trace": "trace_id", "span": "id", "parent": "parent_interaction_id", "order": "_o"}


def error_ancestors(interactions: DataFrame, legs: DataFrame) -> DataFrame:
    """Per interaction the number of failed ones among it and those below it."""
    bad = legs.where("error").select(F.col("interaction_id").alias("id"), F.lit(1).alias("_bad")).distinct()
    rows = interactions.withColumn("_o", F.lit(0)).join(bad, "id", "left")
    return subtree_sums(rows, F.coalesce("_bad", F.lit(0)), **TREE).select("trace_id", F.col("span_id").alias("id"), F.col("total").alias("n_failed_below"))


def matching_forest(interactions: DataFrame, matches: DataFrame) -> DataFrame:
    """The part of each forest that a filter keeps: interactions in ``matches`` (trace_id, id in normal form), all above them
    (their subtree holds a match) and all below them (a match is their nearest match above). No pairs are made."""
    work = Workspace(interactions.sparkSession, "forest")
    hit = matches.select("trace_id", "id", F.lit(True).alias("_hit")).distinct()
    rows = interactions.select(normal_id("trace_id").alias("trace_id"), normal_id("id").alias("id"), normal_id("parent_interaction_id").alias("parent_interaction_id"), F.lit(0).alias("_o"))
    rows, _ = work.save(rows.join(hit, ["trace_id", "id"], "left"))
    above = subtree_sums(rows, F.col("_hit").cast("int"), **TREE).where("total > 0").select("trace_id", F.col("span_id").alias("id"))
    below = nearest_ancestor(rows, "_hit", node="id", parent="parent_interaction_id").where("ancestor is not null").select("trace_id", "id")
    return above.unionByName(below).distinct()


def recent_legs(legs: DataFrame) -> DataFrame:
    """The latest leg of each interaction."""
    w = Window.partitionBy("interaction_id").orderBy(F.col("seq").desc())
    return legs.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def envelopes(evidence: DataFrame, spans: DataFrame) -> DataFrame:
    """Per interaction what its spans span: first start, last end, any error (three-valued), number of spans and anchors.
    Evidence whose span is missing counts as a span without times."""
    rows = evidence.join(spans.select("trace_id", "span_id", "started_at", "ended_at", "error"), ["trace_id", "span_id"], "left")
    return rows.groupBy("trace_id", "anchor_span_id").agg(F.min("started_at").alias("first_at"), F.max("ended_at").alias("last_at"), F.bool_or("error").alias("error"), F.count("*").alias("n_spans"), F.count_if(F.col("role") == "anchor").alias("n_anchors"))


def unread_bodies(legs: DataFrame, suffix: str = "...[truncated]") -> DataFrame:
    """Why a leg's body can't be read: cut off, or never captured; null if it can. Columns of ``legs`` plus ``unread``."""
    return legs.withColumn("unread", F.when(F.col("body").isNull(), "not captured").when(F.endswith("body", F.lit(suffix)), "truncated"))
