"""Append-only, versioned records: latest per key, history, ranked pages, distributions, change suppression, roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.vocab import RISK_LEVELS_SHOWN, RISK_ORDER, at_rank, rank


def latest(df: DataFrame, key: Sequence[str] | str, version: str = "version", ties: Sequence[str] = ()) -> DataFrame:
    """The row of the highest version of each key. One pre-aggregated pass, no sort: max over (version, row)."""
    keys = [key] if isinstance(key, str) else list(key)
    others = [c for c in df.columns if c not in keys]
    got = df.where(F.col(version).isNotNull()).groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(version, *ties)).alias("r"))
    return got.select(*keys, *[F.col(f"r.{c}").alias(c) for c in others]).select(*df.columns)


def history(df: DataFrame, key: str, value: str, after: int | None = None, limit: int = 100) -> DataFrame:
    """Versions of one key in ascending order, from a cursor on."""
    rows = df.where(F.col(key) == value)
    if after is not None:
        rows = rows.where(F.col("version") > after)
    return rows.orderBy("version").limit(limit)


def keyset(order: Sequence[tuple[str, str]], after: Sequence | None) -> Column:
    """The predicate "comes after the row with these values" for an order of (column, asc or desc). Columns are not null."""
    out = F.lit(after is None)
    if after is None:
        return out
    tie = F.lit(True)
    for (name, way), v in zip(order, after):
        c, v = F.col(name), F.lit(v)
        out = out | (tie & ((c > v) if way == "asc" else (c < v)))
        tie = tie & (c == v)
    return out


def page(df: DataFrame, order: Sequence[tuple[str, str]], after: Sequence | None = None, limit: int = 50) -> DataFrame:
    """A page of up to limit + 1 rows (the last says whether there is more), by keyset."""
    by = [F.col(n).asc_nulls_last() if way == "asc" else F.col(n).desc_nulls_last() for n, way in order]
    return df.where(keyset(order, after)).orderBy(*by).limit(limit + 1)


def distribution(df: DataFrame, column: str, values: Sequence[str] = RISK_LEVELS_SHOWN) -> DataFrame:
    """Counts of the listed values, zero where none; other values don't count."""
    n = df.where(F.col(column).isin(list(values))).groupBy(column).agg(F.count("*").alias("n"))
    frame = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return frame.join(F.broadcast(n), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))  # n: at most one row per listed value


def severity_max(a: Column, b: Column, order: list[str]) -> Column:
    """The more severe of two; on a tie the first."""
    return F.when(rank(a, order) <= rank(b, order), a).otherwise(b)


def worst(column: str, order: list[str] = RISK_ORDER) -> Column:
    """Aggregate: the most severe value; values outside of the order and nulls don't count."""
    r = rank(F.col(column), order)
    return at_rank(F.min(F.when(r <= len(order), r)), order)


def roll_up(records: DataFrame, key: str = "trace_id") -> DataFrame:
    """Per key over its records: worst level (none if there is none), counts and sums."""
    return records.groupBy(key).agg(
        F.coalesce(worst("trace_risk_level"), F.lit("none")).alias("level"), F.count("*").alias("n_records"),
        F.sum("interaction_count").alias("interaction_count"), F.sum("policy_event_count").alias("policy_event_count"),
    )


def running_watermark(df: DataFrame, key: str = "trace_id") -> DataFrame:
    """Adds the greatest computed_at up to each version of its key: the order in which a stream would have shown it."""
    w = Window.partitionBy(key).orderBy("version", "computed_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("stream_at", F.max("computed_at").over(w))


def append_changed(stored: DataFrame, new: DataFrame, key: Sequence[str], content: Sequence[str]) -> DataFrame:
    """The rows of ``new`` whose content differs from the latest stored version of their key, with their next version.
    Null equals null."""
    last = latest(stored, key).select(*key, F.col("version").alias("_v"), F.struct(*content).alias("_old"))
    rows = new.withColumn("_new", F.struct(*content)).join(last, list(key), "left")
    changed = rows.where(F.col("_v").isNull() | ~F.col("_old").eqNullSafe(F.col("_new")))
    return changed.withColumn("version", F.coalesce(F.col("_v"), F.lit(0)) + 1).drop("_v", "_old", "_new")


def version_changes(df: DataFrame, key: str, content: Sequence[str], version: str = "version", ties: Sequence[str] = ()) -> DataFrame:
    """The rows whose content differs from that of the version before, whatever its number; the first version of a key has
    none before it and ``_first`` set. Null equals null; rows without a version are in no order and left out."""
    w = Window.partitionBy(key).orderBy(version, *ties)
    rows = df.where(F.col(version).isNotNull()).withColumn("_new", F.struct(*content)).withColumn("_old", F.lag("_new").over(w)).withColumn("_first", F.row_number().over(w) == 1)
    return rows.where(F.col("_first") | ~F.col("_old").eqNullSafe(F.col("_new"))).drop("_old", "_new")


def changed_keys(old: DataFrame, new: DataFrame, key: Sequence[str], content: Sequence[str]) -> DataFrame:
    """Keys that were added, removed or changed between two tables with one row per key."""
    a = old.select(*key, F.struct(*content).alias("_a"), F.lit(1).alias("_in_a"))
    b = new.select(*key, F.struct(*content).alias("_b"), F.lit(1).alias("_in_b"))
    both = a.join(b, list(key), "full")
    same = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull() & F.col("_a").eqNullSafe(F.col("_b"))
    return both.where(~same).select(*key)


def escalations(df: DataFrame, key: str = "trace_id", level: str = "trace_risk_level", floor: str = "high") -> DataFrame:
    """What an alert stream does with each version at or above the floor: created for the first, superseded when it's worse
    than all before, duplicate otherwise. The fold is a running strict minimum of ranks, so it's a window."""
    alert = df.withColumn("_r", rank(F.col(level), RISK_ORDER)).where(F.col("_r") <= RISK_ORDER.index(floor) + 1)
    before = Window.partitionBy(key).orderBy("version").rowsBetween(Window.unboundedPreceding, -1)
    best = F.min("_r").over(before)
    return alert.withColumn("action", F.when(best.isNull(), "created").when(F.col("_r") < best, "superseded").otherwise("duplicate")).drop("_r")


def shares(df: DataFrame, column: str) -> DataFrame:
    """Counts by value and their percent of all non-null rows, to one decimal; no rows, no percent."""
    n = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))  # one row per value


def top_rules(decisions: DataFrame, catalog: DataFrame, limit: int = 10) -> DataFrame:
    """Rules by their own severity, then by traces and times fired. ``decisions``: trace_id, fired (array), risk_level;
    ``catalog``: rule_id, rule_level. A rule that isn't in the catalog counts, after all others."""
    fired = decisions.select("trace_id", "risk_level", F.explode("fired").alias("rule_id"))
    n = fired.groupBy("rule_id").agg(F.count("*").alias("n_fired"), F.count_distinct("trace_id").alias("n_traces"), *[F.count_if(F.col("risk_level") == v).alias(f"n_{v}") for v in RISK_LEVELS_SHOWN])
    level = rank(F.col("rule_level"), RISK_ORDER)
    return n.join(catalog, "rule_id", "left").orderBy(level, F.col("n_traces").desc(), F.col("n_fired").desc(), "rule_id").limit(limit)


def fingerprint(df: DataFrame, columns: Sequence[str], out: str = "fingerprint") -> DataFrame:
    """Adds a digest of some columns: equal content, equal digest; null is content of its own."""
    return df.withColumn(out, F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256))


def to_evaluate(events: DataFrame, decided: DataFrame, key: str) -> DataFrame:
    """Events whose fingerprint differs from that of their latest decision, or that have none."""
    last = latest(decided, key).select(key, F.col("fingerprint").alias("_f"))
    return events.join(last, key, "left").where(~F.col("fingerprint").eqNullSafe(F.col("_f"))).drop("_f")
