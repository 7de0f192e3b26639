"""Reads over interactions, legs, entities and records: filtered lists, tiles, feeds, digests, cursors and roll-ups.

Counts come first and dimensions are joined after, so that a join sees a row per key; what a page needs is filtered before
it is sorted. Nulls: a null level, kind or namespace matches no filter on it.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.interactions import entity_roles
from spanloom.operators.records import keyset
from spanloom.vocab import ENFORCEMENT_ORDER, RISK_ORDER, at_rank, rank

#: Rows of one part of an ordered digest.
DIGEST_PART = 1000


def at_least(level: Column, floor: str, order: Sequence[str] = RISK_ORDER) -> Column:
    """Whether a level is at least as severe as ``floor``; what is not in the order isn't."""
    return rank(level, list(order)) <= list(order).index(floor) + 1


def relative_window(column: Column, now: Column, span: str) -> Column:
    """Whether a time lies in the last 24h, 7d or 30d before ``now``, both ends included."""
    hours = {"24h": 24, "7d": 7 * 24, "30d": 30 * 24}[span]
    return (column <= now) & (F.unix_micros(column) >= F.unix_micros(now) - F.lit(hours * 3_600_000_000))


def interactions_with(interactions: DataFrame, entities: DataFrame, kind: str) -> DataFrame:
    """Interactions with an entity of a kind on either side: a semi join on the roles, no theta join."""
    chosen = entities.where(F.col("kind") == kind).select(F.col("id").alias("entity_id"))
    hits = entity_roles(interactions).join(chosen, "entity_id", "left_semi").select("id").distinct()
    return interactions.join(hits, "id", "left_semi")


def named(interactions: DataFrame, entities: DataFrame, legs: DataFrame) -> DataFrame:
    """Legs with their interaction and both entities; unknown entities stay null."""
    e = lambda side: entities.select(F.col("id").alias(f"{side}_entity_id"), F.col("natural_key").alias(f"{side}_key"), F.col("kind").alias(f"{side}_kind"))
    rows = interactions.join(e("caller"), "caller_entity_id", "left").join(e("callee"), "callee_entity_id", "left")
    return legs.join(rows.select(F.col("id").alias("interaction_id"), "trace_id", "caller_key", "caller_kind", "callee_key", "callee_kind"), "interaction_id")


def tiles(interactions: DataFrame, entities: DataFrame, current: DataFrame) -> DataFrame:
    """One row: entities in use by kind, traces, interactions, those in traces with a record, risky traces and their percent
    of all with a record (0 if there is none)."""
    used = entity_roles(interactions).select("entity_id").distinct().join(entities.select(F.col("id").alias("entity_id"), "kind"), "entity_id")
    kinds = used.agg(F.count_if(F.col("kind") == "agent").alias("n_agents"), F.count_if(F.col("kind") == "user").alias("n_users"), F.count_if(F.col("kind") == "tool").alias("n_tools"))
    per_trace = interactions.groupBy("trace_id").agg(F.count("*").alias("n")).join(current.select("trace_id", F.lit(True).alias("judged")), "trace_id", "left")
    traces = per_trace.agg(F.count("*").alias("n_traces"), F.sum("n").alias("n_interactions"), F.coalesce(F.sum(F.when(F.col("judged"), F.col("n"))), F.lit(0)).alias("n_evaluated"))
    risky = current.agg(F.count_if(at_least(F.col("trace_risk_level"), "high")).alias("n_risky"), F.count("*").alias("n_judged"))
    one = kinds.join(F.broadcast(traces), F.lit(True)).join(F.broadcast(risky), F.lit(True))  # one row each
    return one.withColumn("risky_percent", F.when(F.col("n_judged") > 0, F.round(100 * F.col("n_risky") / F.col("n_judged"), 1)).otherwise(F.lit(0.0)))


def trace_feed(interactions: DataFrame, legs: DataFrame, limit: int = 100) -> DataFrame:
    """Traces by the latest seq of their legs, newest first."""
    moved = legs.groupBy("interaction_id").agg(F.max("seq").alias("seq")).join(interactions.select(F.col("id").alias("interaction_id"), "trace_id"), "interaction_id")
    return moved.groupBy("trace_id").agg(F.max("seq").alias("seq"), F.count("*").alias("n_interactions")).orderBy(F.desc("seq"), "trace_id").limit(limit)


def stale_traces(interactions: DataFrame, legs: DataFrame, current: DataFrame) -> DataFrame:
    """Traces whose record is missing or older than one of their legs, in the order in which they came up."""
    moved = legs.join(interactions.select(F.col("id").alias("interaction_id"), "trace_id"), "interaction_id").groupBy("trace_id").agg(F.min("seq").alias("first_seq"), F.max("occurred_at").alias("moved_at"))
    both = moved.join(current.select("trace_id", "computed_at"), "trace_id", "left")
    return both.where(F.col("computed_at").isNull() | (F.col("moved_at") > F.col("computed_at"))).select("trace_id", "first_seq", F.col("computed_at").isNull().alias("never"))


def ordered_digests(legs: DataFrame, interactions: DataFrame) -> DataFrame:
    """Per trace a digest of its legs in order, which changes when one of them does: digests of parts of ``DIGEST_PART`` legs,
    digested once more. No list is longer than a part, or than the number of parts."""
    row = F.concat_ws("|", "interaction_id", "leg_type", F.unix_micros("occurred_at").cast("string"), F.coalesce("payload_hash", F.lit("-")), F.coalesce(F.col("error").cast("string"), F.lit("-")))
    rows = legs.join(interactions.select(F.col("id").alias("interaction_id"), "trace_id"), "interaction_id").select("trace_id", "seq", F.md5(row).alias("d"))
    at = F.row_number().over(Window.partitionBy("trace_id").orderBy("seq"))
    parts = rows.withColumn("part", F.floor((at - 1) / DIGEST_PART)).groupBy("trace_id", "part").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "d"))), lambda x: x["d"]), "")).alias("d"), F.count("*").alias("n"))
    return parts.groupBy("trace_id").agg(F.sum("n").alias("n_legs"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "d"))), lambda x: x["d"]), "")).alias("digest"))


def kind_counts(interactions: DataFrame, legs: DataFrame) -> DataFrame:
    """Kinds of content: interactions and traces that have one, each counted once however many legs say so."""
    kinds = legs.where(F.col("content_kind").isNotNull()).select("interaction_id", "content_kind").distinct()
    rows = kinds.join(interactions.select(F.col("id").alias("interaction_id"), "trace_id"), "interaction_id")
    return rows.groupBy("content_kind").agg(F.count("*").alias("n_interactions"), F.count_distinct("trace_id").alias("n_traces"))


def leg_unions(legs: DataFrame) -> DataFrame:
    """Per interaction the kinds of its legs, sorted, and whether one of them has no payload."""
    return legs.groupBy("interaction_id").agg(F.array_sort(F.collect_set("content_kind")).alias("kinds"), F.bool_or(F.col("payload_hash").isNull()).alias("has_gap"))


def cursor_list(legs: DataFrame, leg_types: Sequence[str], seqs: Sequence[int]) -> DataFrame:
    """Legs behind the cursor of their type, the cursors given as two lists: a join with a table of parameters."""
    spark = legs.sparkSession
    params = spark.createDataFrame(list(zip(leg_types, seqs)), "leg_type string, after long")
    return legs.join(F.broadcast(params), "leg_type").where(F.col("seq") > F.col("after")).drop("after")  # one row per type asked for


def alerts(escalated: DataFrame, interactions: DataFrame, entities: DataFrame) -> DataFrame:
    """Alerts that stand (created or superseding) with the entities of their trace, sorted."""
    pairs = entity_roles(interactions).select("trace_id", "entity_id").distinct().join(entities.select(F.col("id").alias("entity_id"), "natural_key"), "entity_id")
    involved = pairs.groupBy("trace_id").agg(F.array_sort(F.collect_set("natural_key")).alias("involved"))
    return escalated.where(F.col("action") != "duplicate").join(involved, "trace_id", "left")


def decision_roll_up(decisions: DataFrame) -> DataFrame:
    """Per trace over the decisions on its interactions: worst level, strictest enforcement, decisions, those in which a rule
    fired, mean confidence to three decimals."""
    worst = lambda c, order: at_rank(F.min(F.nullif(rank(F.col(c), order), F.lit(len(order) + 1))), order)
    return decisions.groupBy("trace_id").agg(
        worst("risk_level", RISK_ORDER).alias("level"), worst("enforcement", ENFORCEMENT_ORDER).alias("enforcement"), F.count("*").alias("n_decisions"), F.count_if(F.size("fired") > 0).alias("n_events"),
        F.round(F.avg("confidence"), 3).alias("confidence"),
    )


def leg_states(legs: DataFrame, lineage: DataFrame) -> DataFrame:
    """Each leg with what is known of its lineage: derived, undelivered, or missing (no row). Repeated legs stay."""
    known = lineage.select("interaction_id", "leg_type", F.when(F.col("delivered"), "derived").otherwise("undelivered").alias("state"))
    return legs.join(known, ["interaction_id", "leg_type"], "left").withColumn("state", F.coalesce("state", F.lit("missing")))


class StaleCursor(ValueError):
    """The row a cursor names is gone, or the cursor was made for another order."""


def after_seq(df: DataFrame, seq: int, order: Sequence[tuple[str, str]]) -> Column:
    """The keyset predicate behind the row with a seq; raises ``StaleCursor`` if there is none."""
    row = df.where(F.col("seq") == seq).select(*[n for n, _ in order]).first()
    if row is None:
        raise StaleCursor(f"no row with seq {seq}")
    return keyset(order, list(row))


def encode_cursor(offset: int, order: str) -> str:
    """An opaque cursor bound to an order."""
    return base64.urlsafe_b64encode(json.dumps({"o": offset, "s": order}).encode()).decode().rstrip("=")


def decode_cursor(token: str, order: str) -> int:
    try:
        v = json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))
        at, made_for = v["o"], v["s"]
    except (ValueError, KeyError, TypeError) as e:
        raise StaleCursor("not a cursor") from e
    if made_for != order or not isinstance(at, int) or at < 0:
        raise StaleCursor("made for another order")
    return at


def offset_page(df: DataFrame, by: Sequence[Column], order: str, token: str | None, limit: int) -> tuple[DataFrame, str]:
    """A page by offset and the cursor of the next one."""
    at = decode_cursor(token, order) if token else 0
    return df.orderBy(*by).offset(at).limit(limit), encode_cursor(at + limit, order)
