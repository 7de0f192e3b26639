"""Span reads: pages, subtrees, listing roots and the trace listing.

Ids are compared in normal form; a span delivered several times counts once, with its finalised fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.ids import normal_id
from spanloom.operators.attributes import with_facts


def finalized(df: DataFrame) -> DataFrame:
    """Insert-or-finalise: one row per span. The first arrival fixes parent, service, start and receipt; the first arrival
    with an end gives the other columns and, if it isn't the first, the row's new ``seq``."""
    fixed = ["parent_id", "service_name", "started_at", "observed_at", "arrival_seq"]
    moving = [c for c in df.columns if c not in ("trace_id", "span_id", *fixed)]
    ids = df.withColumns({"trace_id": normal_id("trace_id"), "span_id": normal_id("span_id"), "parent_id": normal_id("parent_id")})
    ended = F.col("ended_at").isNull()
    rows = ids.where(F.col("trace_id").isNotNull() & F.col("span_id").isNotNull()).groupBy("trace_id", "span_id").agg(
        F.min_by(F.struct(*fixed), "arrival_seq").alias("a"), F.min_by(F.struct(*moving), F.struct(ended, "arrival_seq")).alias("b")
    )
    return rows.select(*[F.col("trace_id"), F.col("span_id")], *[F.col(f"a.{c}").alias(c) for c in fixed], *[F.col(f"b.{c}").alias(c) for c in moving]).select(*df.columns)


#: Columns of a span without its documents.
NARROW = ["trace_id", "span_id", "parent_id", "arrival_seq", "started_at", "ended_at", "observed_at", "name", "kind", "service_name", "error"]


def finalized_facts(df: DataFrame, keys: dict[str, str], *more: Column) -> DataFrame:
    """``finalized`` spans with facts of their attributes but without the documents: each delivery's facts are read where it
    is scanned, so that the shuffle carries a few short columns and never a body. ``more``: other columns, aliased."""
    return finalized(with_facts(df, keys).select(*NARROW, *keys, *more))


def delivery_outcomes(df: DataFrame) -> DataFrame:
    """What each delivery did: inserted, finalized or duplicate."""
    ids = df.select("arrival_seq", normal_id("trace_id").alias("t"), normal_id("span_id").alias("s"), F.col("ended_at").isNotNull().alias("e"))
    w = Window.partitionBy("t", "s").orderBy("arrival_seq")
    before = F.coalesce(F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    first = F.row_number().over(w) == 1
    return ids.where(F.col("t").isNotNull() & F.col("s").isNotNull()).select(
        "arrival_seq", F.when(first, "inserted").when(F.col("e") & ~before, "finalized").otherwise("duplicate").alias("outcome")
    )


def in_window(start: str | None, end: str | None, column: str = "started_at") -> Column:
    """Inclusive on both ends; an open end is no bound."""
    c = F.lit(True)
    if start:
        c &= F.col(column) >= F.lit(start).cast("timestamp")
    if end:
        c &= F.col(column) <= F.lit(end).cast("timestamp")
    return c


def root_candidates(spans: DataFrame) -> DataFrame:
    """Spans without a parent (rank_class 0) and orphans, whose parent isn't in the trace (rank_class 1)."""
    roots = spans.where(F.col("parent_id").isNull()).withColumn("rank_class", F.lit(0))
    there = spans.select("trace_id", F.col("span_id").alias("parent_id"))
    orphans = spans.where(F.col("parent_id").isNotNull()).join(there, ["trace_id", "parent_id"], "left_anti").withColumn("rank_class", F.lit(1))
    return roots.unionByName(orphans.select(*roots.columns))


def trace_listing(df: DataFrame, start: str | None = None, end: str | None = None, limit: int = 50, after: tuple[str, str] | None = None) -> DataFrame:
    """Newest traces with a span in the window: their listing root (roots before orphans, then earliest), whether it's in
    the window, and span counts. ``after`` is the (started_at, span_id) the page before ended with."""
    spans = finalized(df.select("trace_id", "span_id", "parent_id", "arrival_seq", "started_at", "ended_at", "observed_at", "name", "service_name", "error"))
    inside = in_window(start, end)
    eligible = spans.where(inside).select("trace_id").distinct()
    rank = Window.partitionBy("trace_id").orderBy("rank_class", F.col("started_at").asc_nulls_last(), "span_id")
    roots = root_candidates(spans).withColumn("rn", F.row_number().over(rank)).where("rn = 1").join(eligible, "trace_id", "left_semi")
    counts = trace_counts(spans, start, end)
    page = roots.join(counts, "trace_id").select(
        "trace_id", "span_id", "name", "service_name", "started_at", "ended_at", "error", (F.col("rank_class") == 1).alias("is_orphan"), F.coalesce(inside, F.lit(False)).alias("root_in_window"), "n_spans", "n_in_window", "n_errors"
    )
    if after:
        at = F.lit(after[0]).cast("timestamp")
        page = page.where((F.col("started_at") < at) | ((F.col("started_at") == at) & (F.col("span_id") > after[1])))
    return page.orderBy(F.col("started_at").desc_nulls_last(), "span_id").limit(limit)


def trace_counts(spans: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    return spans.groupBy("trace_id").agg(F.count("*").alias("n_spans"), F.count_if(in_window(start, end)).alias("n_in_window"), F.count_if("error").alias("n_errors"))
