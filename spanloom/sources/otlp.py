"""Export requests in JSON form (one request per line) to span rows, and back.

Values arrive as tagged unions; they are decoded to plain JSON by one vectorised function per attribute list. The rest is
three explodes and expressions. Rows that can't be spans (no usable ids, no start) come out on their own.
"""

from __future__ import annotations

import base64
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.schemas import OTLP_REQUEST

# Names of span kinds by number.
KINDS = ["UNSPECIFIED", "INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER"]


def any_value(v):
    """A tagged value to a plain one: strings, booleans, integers, doubles, arrays, maps; bytes as hex; no value is null."""
    if not isinstance(v, dict):
        return None
    for k, x in v.items():
        if k == "intValue":
            return int(x)
        if k == "doubleValue":
            return float(x)
        if k in ("stringValue", "boolValue"):
            return x
        if k == "arrayValue":
            return [any_value(y) for y in (x or {}).get("values", [])]
        if k == "kvlistValue":
            return {y["key"]: any_value(y.get("value")) for y in (x or {}).get("values", [])}
        if k == "bytesValue":
            return base64.b64decode(x).hex()
    return None


def _attributes(column: Column) -> Column:
    """Key-value list to a JSON document; null if empty."""

    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda xs: json.dumps({x["key"]: any_value(json.loads(x["value"])) if x["value"] else None for x in xs}) if xs is not None and len(xs) else None)

    return F.pandas_udf(run, "string")(column)


def _documents(column: Column) -> Column:
    """The same for a list of key-value lists."""

    def run(lists: pd.Series) -> pd.Series:
        def one(xs):
            return json.dumps({x["key"]: any_value(json.loads(x["value"])) if x["value"] else None for x in xs}) if xs is not None and len(xs) else None

        return lists.map(lambda ls: None if ls is None else [one(xs) for xs in ls])

    return F.pandas_udf(run, "array<string>")(column)


def _time(ns: Column) -> Column:
    """Nanoseconds to a timestamp, cut to microseconds."""
    n = ns.try_cast("decimal(38,0)")
    return F.timestamp_micros(F.floor(n / 1000).cast("long"))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OTLP_REQUEST).json(path)


def to_spans(requests: DataFrame) -> DataFrame:
    """Span rows of all requests, in the columns of the spans table except the receiver's own (seq, arrival_seq, batch_id,
    observed_at)."""
    r = requests.select(F.explode("resourceSpans").alias("r")).select(F.col("r.resource.attributes").alias("ra"), F.explode("r.scopeSpans").alias("s"))
    s = r.select("ra", F.col("s.scope").alias("scope"), F.explode("s.spans").alias("p")).withColumn("resource_attributes", _attributes(F.col("ra")))
    empty = lambda c: F.nullif(c, F.lit(""))
    code = F.col("p.status.code")
    service = F.try_variant_get(F.try_parse_json("resource_attributes"), '$["service.name"]', "string")
    envelope = F.struct(
        empty(F.col("p.traceState")).alias("trace_state"), F.nullif(F.col("p.flags"), F.lit(0)).alias("flags"), F.nullif(F.col("p.droppedAttributesCount"), F.lit(0)).alias("dropped_attributes_count"),
        F.nullif(F.col("p.droppedEventsCount"), F.lit(0)).alias("dropped_events_count"), F.nullif(F.col("p.droppedLinksCount"), F.lit(0)).alias("dropped_links_count"),
    )
    s = s.withColumn("ed", _documents(F.transform("p.events", lambda e: e["attributes"]))).withColumn("ld", _documents(F.transform("p.links", lambda e: e["attributes"])))
    events = F.zip_with("p.events", "ed", lambda e, d: F.struct(e["name"].alias("name"), e["timeUnixNano"].try_cast("long").alias("time_unix_nano"), d.alias("attributes")))
    links = F.zip_with("p.links", "ld", lambda e, d: F.struct(F.lower(e["traceId"]).alias("trace_id"), F.lower(e["spanId"]).alias("span_id"), d.alias("attributes")))
    return s.select(
        F.lower("p.traceId").alias("trace_id"), F.lower("p.spanId").alias("span_id"), empty(F.lower("p.parentSpanId")).alias("parent_id"), F.col("p.name").alias("name"),
        F.nullif(F.get(F.array(*map(F.lit, KINDS)), F.coalesce("p.kind", F.lit(0))), F.lit("UNSPECIFIED")).alias("kind"), service.alias("service_name"),
        F.when(empty(F.col("scope.name")).isNotNull() | empty(F.col("scope.version")).isNotNull(), F.col("scope")).alias("scope"), _time(F.col("p.startTimeUnixNano")).alias("started_at"),
        F.when(F.col("p.endTimeUnixNano") != "0", _time(F.col("p.endTimeUnixNano"))).alias("ended_at"), F.when(code == 2, F.lit(True)).when(code == 1, F.lit(False)).alias("error"),
        empty(F.col("p.status.message")).alias("status_message"), _attributes(F.col("p.attributes")).alias("attributes"), F.when(F.size("p.events") > 0, events).alias("events"),
        F.when(F.size("p.links") > 0, links).alias("links"), F.nullif(F.to_json(envelope), F.lit("{}")).alias("otlp"), "resource_attributes",
    )


def split_rejected(spans: DataFrame, max_bytes: int = 1 << 24) -> tuple[DataFrame, DataFrame]:
    """Storable spans, and the others with the reason: an id that is no id, a missing start, a NUL character, or size."""
    ids = F.coalesce(F.col("trace_id").rlike("^[0-9a-f]{32}$") & F.col("span_id").rlike("^[0-9a-f]{16}$"), F.lit(False))
    size = F.octet_length(F.coalesce("attributes", F.lit(""))) + F.octet_length(F.coalesce("resource_attributes", F.lit("")))
    reason = F.when(~ids, "id").when(F.col("started_at").isNull(), "no start").when(F.coalesce(F.col("attributes").contains("\\u0000"), F.lit(False)), "NUL").when(size > max_bytes, "size")
    marked = spans.withColumn("reason", reason)
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull())


def shift_to(spans: DataFrame, now: str) -> DataFrame:
    """A trace replayed: all times moved so that the latest start is ``now``."""
    last = spans.agg(F.max(F.unix_micros("started_at")).alias("_last"))
    by = F.unix_micros(F.lit(now).cast("timestamp")) - F.col("_last")
    moved = spans.join(F.broadcast(last), F.lit(True))  # one row
    return moved.withColumns({c: F.timestamp_micros(F.unix_micros(c) + by) for c in ("started_at", "ended_at", "observed_at") if c in spans.columns}).drop("_last")


def new_ids(spans: DataFrame, salt: str) -> DataFrame:
    """The same trace under new ids, the same for every mention of an old one: ids are digests of salt and old id."""
    fresh = lambda c, n: F.when(F.col(c).isNotNull(), F.substring(F.md5(F.concat(F.lit(salt), F.col(c))), 1, n))
    return spans.withColumns({"trace_id": fresh("trace_id", 32), "span_id": fresh("span_id", 16), "parent_id": fresh("parent_id", 16)})


def regroup(spans: DataFrame) -> DataFrame:
    """Span rows back to one record per resource and scope of a trace: trace_id, resource_attributes, scope, spans in order of
    start."""
    body = F.struct("started_at", "span_id", "parent_id", "name", "kind", "ended_at", "error", "attributes")
    return spans.groupBy("trace_id", "resource_attributes", "scope").agg(F.array_sort(F.collect_list(body)).alias("spans"))
