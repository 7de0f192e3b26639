"""Streams of spans and records.

A cursor over a rising sequence number is a stream's checkpoint; a transaction per item is a micro-batch that can be run
again. Late spans are taken in by deriving the whole trace anew, so results do not depend on the order of arrival.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanloom.functions.ids import normal_id
from spanloom.operators.redelivery import identifiers, redelivered
from spanloom.schemas import SPAN
from spanloom.sources.sinks import bucketed, exists, replace_traces
from spanloom.store import Workspace


def read_spans(spark: SparkSession, path: str, schema: str = SPAN, files_per_batch: int = 64) -> DataFrame:
    """Landed span files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def cursor_batch(df: DataFrame, after: int, limit: int, order: str = "seq") -> DataFrame:
    """The next items behind a cursor."""
    return df.where(F.col(order) > after).orderBy(order).limit(limit)


def drain(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Runs ``step`` on every micro-batch: until all is read, or for ever in the given interval."""
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def derive_by_trace(landed: str, out: str, derive: Callable[[DataFrame], DataFrame], schema: str = SPAN) -> Callable[[DataFrame, int], None]:
    """A step that lands a batch by bucket of the trace, derives anew every trace the batch touches from all its landed rows,
    and replaces its rows in ``out``. Only the buckets touched are read; a batch that runs again lands in the same place."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("_t", normal_id("trace_id")).where(F.col("_t").isNotNull())
        bucketed(rows, "_t").drop("_t").withColumn("batch", F.lit(number)).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(landed)
        changed = bucketed(rows.select(F.col("_t").alias("trace_id")).distinct())
        touched = [r[0] for r in changed.select("bucket").distinct().collect()]  # at most as many as there are buckets
        all_ = spark.read.schema(f"{schema}, bucket int, batch long").parquet(landed).where(F.col("bucket").isin(touched) & (F.col("batch") <= number))
        spans = all_.withColumn("_t", normal_id("trace_id")).join(changed.select(F.col("trace_id").alias("_t")), "_t", "left_semi").drop("_t", "bucket", "batch")
        replace_traces(derive(spans), changed.select("trace_id"), out)

    return step


def once_step(ids: str, out: str, trace: str = "trace_id", span: str = "span_id", order: str = "arrival_seq") -> Callable[[DataFrame, int], None]:
    """A step that appends to ``out`` the first row of every identifier and no other, whichever batches its copies come in,
    however far apart. The identifiers of the batches before go into the quotient tables ahead of the batch; what loses
    there is a copy. Both tables are kept by batch, so a batch that runs again changes nothing."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = None
        if exists(spark, ids):
            known = spark.read.schema("image binary, wide string, batch long").parquet(ids).where(F.col("batch") < number).select("image", "wide", F.lit(-1).cast("long").alias("ord"))
        copies = redelivered(batch, trace, span, order, known).where(F.col(order) >= 0)
        first = batch.join(copies, order, "left_anti").select(*batch.columns)
        for df, path in ((first, out), (identifiers(first, trace, span, F.col(order)).where("image is not null or wide is not null").drop("ord"), ids)):
            df.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return step


PANE_STATE = "pane_start long, n_rows long, n_past_cutoff long, clock_us long, batch long"


def pane_step(path: str, windows: str | None = None, window_panes: int = 3, pane_s: int = 3600, lateness_s: int = 6 * 3600) -> Callable[[DataFrame, int], None]:
    """A step that keeps panes: adds each batch's rows to the panes they belong to, leaves rows past the cut-off of the
    stream's arrival clock out, and appends to ``windows`` every window that covers a changed pane, with its new count.

    The state after each batch is a small table of its own (one row per pane); a batch reads that of the batch before, so one
    that runs again adds nothing, and older states are removed."""

    def step(batch: DataFrame, number: int) -> None:
        from spanloom.operators.slicing import assign_panes

        spark = batch.sparkSession
        stored = spark.read.schema(PANE_STATE).parquet(path) if exists(spark, path) else spark.createDataFrame([], PANE_STATE)
        last = stored.where(F.col("batch") < number).agg(F.max("batch")).first()[0]
        state = stored.where(F.col("batch") == F.lit(-1 if last is None else last))
        before = state.agg(F.max("clock_us")).first()[0]
        panes = assign_panes(batch, pane_s=pane_s, lateness_s=lateness_s)
        clock = F.greatest("clock_us", F.lit(before).cast("long"))
        late = F.coalesce(clock >= (F.col("pane_start") + pane_s + lateness_s) * 1_000_000, F.lit(False))
        rows = panes.withColumn("clock_us", clock).groupBy("pane_start").agg(F.count_if(~late).alias("n_rows"), F.count_if(late).alias("n_past_cutoff"), F.max("clock_us").alias("clock_us"))
        work = Workspace(spark, "panes")
        rows, _ = work.save(rows)
        both = state.drop("batch").unionByName(rows).groupBy("pane_start").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_past_cutoff").alias("n_past_cutoff"), F.max("clock_us").alias("clock_us"))
        both, _ = work.save(both)
        write = lambda df, to: df.withColumn("batch", F.lit(number).cast("long")).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(to)
        write(both, path)
        if windows:
            cover = lambda df, *c: df.select(F.explode(F.sequence(F.col("pane_start") - F.lit((window_panes - 1) * pane_s), F.col("pane_start"), F.lit(pane_s))).alias("window_start"), *c)
            moved = cover(rows.where("n_rows > 0")).distinct()
            write(cover(both, "n_rows").join(moved, "window_start", "left_semi").groupBy("window_start").agg(F.sum("n_rows").alias("n_rows")), windows)
        if last is not None:
            for old in [r[0] for r in stored.where(F.col("batch") < last).select("batch").distinct().collect()]:  # one at most, but after a crash
                work.drop(f"{path}/batch={old}")
        work.drop(work.root)

    return step


def pane_totals(spark: SparkSession, path: str) -> DataFrame:
    """The panes after the last batch."""
    state = spark.read.schema(PANE_STATE).parquet(path)
    return state.join(state.agg(F.max("batch").alias("batch")), "batch").select("pane_start", "n_rows", "n_past_cutoff")


def window_totals(spark: SparkSession, path: str) -> DataFrame:
    """Of each window the count told last, and how often it was told."""
    return spark.read.schema("window_start long, n_rows long, batch long").parquet(path).groupBy("window_start").agg(F.max_by("n_rows", "batch").alias("n_rows"), F.count("*").alias("version"))


def escalation_stream(records: DataFrame, floor_rank: int = 2) -> DataFrame:
    """The alert fold as a stream with state: per trace the worst rank so far. Rows trace_id, version, action."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    from spanloom.vocab import RISK_ORDER

    ranks = {v: i + 1 for i, v in enumerate(RISK_ORDER)}

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get[0] if state.exists else None
        out = []
        for r in pd.concat(parts).sort_values("version").itertuples():
            n = ranks.get(r.trace_risk_level, len(ranks) + 1)
            if n > floor_rank:
                continue
            action = "created" if best is None else "superseded" if n < best else "duplicate"
            best = n if best is None else min(best, n)
            out.append((key[0], int(r.version), action))
        if best is not None:
            state.update((best,))
        yield pd.DataFrame(out, columns=["trace_id", "version", "action"])

    return records.groupBy("trace_id").applyInPandasWithState(fold, "trace_id string, version int, action string", "best int", "append", GroupStateTimeout.NoTimeout)
