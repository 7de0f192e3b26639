"""Event-time aggregates under late and out-of-order arrival, by stream slicing.

Event time is cut into panes that do not overlap, as long as the step of the windows; a row falls into the pane of its
start. Counts are kept per pane and never per window: a late row changes one pane, and only the windows that cover the
pane are put together again and emitted once more. Rows whose arrival is at or past the end of their pane plus the
allowed lateness are past the cut-off and change nothing.

The arrival clock of a row is the greatest receiver time among the rows that arrived up to it: a clock that never runs
back, computed in two levels: prefix maxima over blocks of arrival numbers, and over blocks of blocks, so that no task
ever sees more than one block of rows; the last level has one row per 2**26 arrival numbers.

Defined cases: a missing receiver time leaves the clock where it is; a row that arrives before any receiver time is
known is on time; rows without a start or an arrival number belong to no pane and are left out; rows with equal arrival
numbers share one clock; repeated rows count each time; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOUR_S = 3600
#: Arrival numbers of one block of rows, and blocks of one block of blocks.
BLOCK, BLOCKS = 1 << 14, 1 << 12


def _micros(df: DataFrame, name: str):
    return F.unix_micros(F.col(name).cast("timestamp"))


def assign_panes(
    df: DataFrame,
    event: str = "started_at",
    received: str = "observed_at",
    arrival: str = "arrival_seq",
    pane_s: int = HOUR_S,
    lateness_s: int = 6 * HOUR_S,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row with a pane: arrival number, pane_start (epoch seconds), clock_us, late (past the cut-off), and
    the columns in ``keep``."""
    start = F.floor(_micros(df, event) / F.lit(1_000_000)).cast("long")
    rows = df.where(F.col(arrival).isNotNull()).select(
        F.col(arrival).cast("long").alias("_a"), (start - F.pmod(start, F.lit(pane_s))).alias("pane_start"), _micros(df, received).alias("_r"),
        *[F.col(c).alias(f"_k_{c}") for c in keep],
    ).withColumn("_b", F.floor(F.col("_a") / F.lit(BLOCK)))
    blocks = rows.groupBy("_b").agg(F.max("_r").alias("_m")).withColumn("_bb", F.floor(F.col("_b") / F.lit(BLOCKS)))
    above = blocks.groupBy("_bb").agg(F.max("_m").alias("_mm"))
    before = Window.orderBy("_bb").rowsBetween(Window.unboundedPreceding, -1)
    above = above.select(F.col("_bb"), F.max("_mm").over(before).alias("_pp"))
    inner = Window.partitionBy("_bb").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    prefix = blocks.withColumn("_p", F.max("_m").over(inner)).join(above, "_bb").select("_b", F.greatest("_p", "_pp").alias("_p"))
    upto = Window.partitionBy("_b").orderBy("_a").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.join(prefix, "_b").withColumn("clock_us", F.greatest(F.max("_r").over(upto), F.col("_p")))
    end_us = (F.col("pane_start") + F.lit(pane_s + lateness_s)) * F.lit(1_000_000)
    return seen.where(F.col("pane_start").isNotNull()).select(
        F.col("_a").alias(arrival), "pane_start", "clock_us", F.coalesce(F.col("clock_us") >= end_us, F.lit(False)).alias("late"),
        *[F.col(f"_k_{c}").alias(c) for c in keep],
    )


def pane_counts(panes: DataFrame, pane_s: int = HOUR_S) -> DataFrame:
    """Per pane: rows counted, how many of them came after the pane had ended, and rows past the cut-off."""
    after = F.col("clock_us") >= (F.col("pane_start") + F.lit(pane_s)) * F.lit(1_000_000)
    return panes.groupBy("pane_start").agg(
        F.count_if(~F.col("late")).alias("n_rows"), F.count_if(after & ~F.col("late")).alias("n_corrections"), F.count_if("late").alias("n_past_cutoff")
    )


def revisions(panes: DataFrame, pane_s: int = HOUR_S, window_panes: int = 3, tick_s: int = HOUR_S) -> DataFrame:
    """What a stream emits: for each tick of the arrival clock, every window that covers a pane changed in that tick, with
    its corrected count. Columns window_start, tick, version (1, 2, ...), n_rows.

    Panes are aggregated per tick first; a pane's change is handed to the ``window_panes`` windows that cover it.
    """
    tick = F.coalesce(F.floor(F.col("clock_us") / F.lit(tick_s * 1_000_000)), F.lit(0)).cast("long")
    change = panes.where(~F.col("late")).groupBy("pane_start", tick.alias("tick")).agg(F.count("*").alias("n"))
    spread = change.select(F.explode(F.sequence(F.col("pane_start") - F.lit((window_panes - 1) * pane_s), F.col("pane_start"), F.lit(pane_s))).alias("window_start"), "tick", "n")
    moved = spread.groupBy("window_start", "tick").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("window_start").orderBy("tick")
    return moved.select("window_start", "tick", F.row_number().over(order).alias("version"), F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("n_rows"))
