"""Parent-child links to full hierarchies, by splitters.

1. Spans of one identifier become one node with the parent of the earliest row; nodes get a short surrogate number.
2. A hash of the identifier, the same in every run, makes one node in ``SPLIT`` a splitter. Every other node walks to its
   next splitter or root. The walk doubles: in round k a node takes over the pointer of the node 2**k steps above, and
   nodes that have arrived stop taking part.
3. Splitters and roots form the reduced pointer graph, about one node in ``SPLIT``; the same doubling solves it.
4. Expansion: a node's root is its splitter's root, its depth the sum of both distances.
5. Whoever has not arrived when a round brings no new arrival lies on or below a closed loop: on a path of any length
   to a root or splitter some node arrives in each round. This covers loops with and without splitters. Those nodes
   alone are doubled until the image of the pointer map stops shrinking; the map is then one-to-one on the image, which
   is therefore exactly the set of nodes on loops. A doubling minimum over them names each loop.

All steps are joins on surrogate numbers, which spread evenly whatever the size of a trace: no trace is ever gathered
in one task. Every round's result is a table in the shared folder, so a lost executor costs one round.

Defined cases: a null or empty parent, or one that is no node of the trace, makes a root; a node without a trace or a
span id is left out; repeated rows of a span count once, the one with the lowest order value (null last) decides; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.ids import normal_id
from spanloom.store import Workspace

#: One node in so many is a splitter.
SPLIT = 8


def _nodes(df: DataFrame, trace: str, span: str, parent: str, order: str, weight: Column | None = None) -> DataFrame:
    rows = df.select(normal_id(trace).alias("t"), normal_id(span).alias("s"), normal_id(parent).alias("p"), F.col(order).alias("o"), (F.lit(1) if weight is None else weight).cast("long").alias("w"))
    rows = rows.where(F.col("t").isNotNull() & F.col("s").isNotNull())
    first = F.min_by(F.struct("p"), F.struct(F.col("o").isNull(), "o", "p"))
    cols = [F.col("f.p").alias("p"), (F.pmod(F.xxhash64("s", "t"), F.lit(SPLIT)) == 0).alias("split"), F.monotonically_increasing_id().alias("id")]
    if weight is None:
        return rows.groupBy("t", "s").agg(first.alias("f")).select("t", "s", *cols)
    return rows.groupBy("t", "s").agg(first.alias("f"), F.max("w").alias("w")).select("t", "s", *cols, F.coalesce("w", F.lit(0)).alias("w"))


def _linked(work: Workspace, nodes: DataFrame, *more: str) -> DataFrame:
    """Nodes with the number of their parent (null: a root) and whether that is a splitter."""
    up = nodes.select("t", F.col("s").alias("p"), F.col("id").alias("pid"), F.col("split").alias("psplit"))
    return work.save(nodes.join(up, ["t", "p"], "left").select("id", "t", "s", F.when(F.col("pid").isNotNull(), F.col("p")).alias("p"), "pid", "psplit", "split", *more))[0]


OPEN, AT_SPLITTER, AT_ROOT = 0, 1, 2


class _States:
    """Rows (id, ptr, dist, split, perhaps seg) kept in one folder per value of ``done``."""

    def __init__(self, work: Workspace, cols: list[str]):
        self.work, self.cols, self.parts = work, cols, {OPEN: [], AT_SPLITTER: [], AT_ROOT: []}

    def save(self, df: DataFrame) -> None:
        """Replaces the open rows by those of ``df`` that are open; adds the others."""
        self.schema = df.select(*self.cols).schema
        at = self.work.save_by(df.select(*self.cols, "done"), "done")
        old = self.parts[OPEN]
        self.parts[OPEN] = []
        for code, path in at.items():
            self.parts[int(code)].append(path)
        self.spent = old

    def read(self, *codes: int) -> DataFrame:
        found = [self.work.read(self.schema, *self.parts[c]).withColumn("done", F.lit(c)) for c in codes if self.parts[c]]
        if not found:
            return self.work.spark.createDataFrame([], self.schema).withColumn("done", F.lit(OPEN))
        out = found[0]
        for x in found[1:]:
            out = out.unionByName(x)
        return out

    def count(self) -> int:
        return self.read(OPEN).count() if self.parts[OPEN] else 0


def _double(work: Workspace, start: DataFrame) -> _States:
    """Pointer doubling until no open node arrives any more. Every pointer of an open row is the id of a row. A column
    ``seg``, if there is one, holds the names from below the pointer down to the node, and is put together on the way."""
    path = "seg" in start.columns
    states = _States(work, ["id", "ptr", "dist", "split", *(["seg"] if path else [])])
    states.save(start)
    left = states.count()
    while left:
        todo = states.read(OPEN)
        up = states.read(OPEN, AT_SPLITTER, AT_ROOT).select(F.col("id").alias("ptr"), F.col("ptr").alias("q"), F.col("dist").alias("e"), F.col("done").alias("d"), *([F.col("seg").alias("above")] if path else []))
        step = todo.drop("done").join(up, "ptr").select("id", F.col("q").alias("ptr"), (F.col("dist") + F.col("e")).alias("dist"), "split", F.col("d").alias("done"), *([F.concat("above", "seg").alias("seg")] if path else []))
        states.save(step)
        work.drop(*states.spent)
        now = states.count()
        if now == left:
            break
        left = now
    return states


def _loops(work: Workspace, x: DataFrame) -> DataFrame:
    """Rows (id, ptr, s), closed under ptr, none of which reaches a root: adds ``loop`` (smallest s on the node's loop) and
    ``on`` (whether the node itself lies on it)."""
    base, _ = work.save(x)
    f, _ = work.save(base.select("id", "ptr"))
    size = f.select("ptr").distinct().count()
    while True:
        f, _ = work.save(f.join(f.select(F.col("id").alias("ptr"), F.col("ptr").alias("q")), "ptr").select("id", F.col("q").alias("ptr")))
        now = f.select("ptr").distinct().count()
        if now == size:
            break
        size = now
    on = f.select(F.col("ptr").alias("id")).distinct()
    g, _ = work.save(base.join(on, "id").select("id", "ptr", F.col("s").alias("m")))
    while True:
        up = g.select(F.col("id").alias("ptr"), F.col("ptr").alias("q"), F.col("m").alias("n"))
        g, _ = work.save(g.join(up, "ptr").select("id", F.col("q").alias("ptr"), F.least("m", "n").alias("m"), (F.col("n") < F.col("m")).alias("moved")))
        if not g.where("moved").limit(1).count():
            break
        g = g.drop("moved")
    names = g.select(F.col("id").alias("ptr"), F.col("m").alias("loop"))
    own = on.select("id", F.lit(True).alias("on"))
    return f.join(names, "ptr").join(own, "id", "left").select("id", "loop", F.coalesce("on", F.lit(False)).alias("on"))


def hierarchy(df: DataFrame, trace: str = "trace_id", span: str = "span_id", parent: str = "parent_id", order: str = "arrival_seq") -> DataFrame:
    """One row per span: trace_id, span_id, parent_id (null unless it is a node), root_span_id, depth (-1: on a closed loop,
    -2: below one; both with the smallest span id of the loop as root), ids in normal form."""
    work = Workspace(df.sparkSession, "hierarchy")
    tree = _linked(work, work.save(_nodes(df, trace, span, parent, order))[0])
    has = F.col("pid").isNotNull()
    solved, stuck, expanded = _solve(work, tree)
    # roots are the nodes that point at themselves: only they are looked up for their names
    roots = tree.where(~has).select(F.col("id").alias("root"), F.col("s").alias("root_span_id"))
    names = tree.select("id", "t", "s", "p")
    good = solved.join(roots, "root").join(names, "id")
    out = good.select(F.col("t").alias("trace_id"), F.col("s").alias("span_id"), F.col("p").alias("parent_id"), "root_span_id", "depth")
    lost, _ = work.save(stuck.unionByName(expanded.where(F.col("root").isNull()).select("id")))
    if lost.limit(1).count():
        found = _loops(work, tree.join(lost, "id").select("id", F.col("pid").alias("ptr"), "s"))
        out = out.unionByName(found.join(names, "id").select(F.col("t").alias("trace_id"), F.col("s").alias("span_id"), F.col("p").alias("parent_id"), F.col("loop").alias("root_span_id"), F.when(F.col("on"), F.lit(-1)).otherwise(-2).alias("depth")))
    return out


def _solve(work: Workspace, tree: DataFrame, paths: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes that have a root (id, root, depth, with ``paths`` also seg: the names below the root down to the node); nodes
    whose walk to a splitter never ends; and all others, with root null where the splitter has none."""
    has = F.col("pid").isNotNull()
    seg = [F.when(has, F.array("s")).otherwise(F.array().cast("array<string>")).alias("seg")] if paths else []
    also = ["seg"] if paths else []
    walk = _double(work, tree.select(
        "id", F.coalesce("pid", "id").alias("ptr"), F.when(has, F.lit(1)).otherwise(0).alias("dist"), "split", *seg,
        F.when(~has, F.lit(AT_ROOT)).when(F.col("psplit"), F.lit(AT_SPLITTER)).otherwise(F.lit(OPEN)).alias("done"),
    ))
    # an open splitter stands in front of a loop without splitters; it can't be solved on the reduced graph
    stuck = walk.read(OPEN).select("id")
    reduced = _double(work, walk.read(AT_SPLITTER, AT_ROOT).where("split").withColumn("done", F.when(F.col("done") == AT_ROOT, F.lit(AT_ROOT)).otherwise(F.lit(OPEN))))
    top = reduced.read(AT_ROOT).select(F.col("id").alias("ptr"), F.col("ptr").alias("root"), F.col("dist").alias("above"), *([F.col("seg").alias("head")] if paths else []))
    at_root = walk.read(AT_ROOT).select("id", F.col("ptr").alias("root"), F.col("dist").alias("depth"), *also)
    expanded, _ = work.save(walk.read(AT_SPLITTER).join(top, "ptr", "left").select("id", "root", (F.col("dist") + F.col("above")).alias("depth"), *([F.concat("head", "seg").alias("seg")] if paths else [])))
    return at_root.unionByName(expanded.where(F.col("root").isNotNull())), stuck, expanded


def nearest_ancestor(df: DataFrame, target: str, key: str = "trace_id", node: str = "span_id", parent: str = "parent_id", hops: bool = False) -> DataFrame:
    """For each row the nearest row strictly above it, within ``key``, for which the boolean column ``target`` holds:
    columns key, node, ancestor (null if there is none; also on a closed loop without targets), with ``hops`` also the steps
    up to it.

    Pointer doubling that stops at targets; ``df`` has one row per node, ids in one form.
    """
    work = Workspace(df.sparkSession, "nearest")
    base, _ = work.save(df.select(F.col(key).alias("t"), F.col(node).alias("s"), F.col(parent).alias("p"), F.coalesce(F.col(target), F.lit(False)).alias("hit"), F.monotonically_increasing_id().alias("id")))
    up = base.select("t", F.col("s").alias("p"), F.col("id").alias("pid"), F.col("hit").alias("phit"))
    tree, _ = work.save(base.join(up, ["t", "p"], "left").select("id", "pid", "phit"))
    states = _double(work, tree.select(
        "id", F.coalesce("pid", "id").alias("ptr"), F.lit(1).alias("dist"), F.lit(False).alias("split"),
        F.when(F.col("pid").isNull(), F.lit(AT_ROOT)).when(F.col("phit"), F.lit(AT_SPLITTER)).otherwise(F.lit(OPEN)).alias("done"),
    ))
    found = states.read(AT_SPLITTER).select("id", "ptr", F.col("dist").alias("hops")).join(base.select(F.col("id").alias("ptr"), F.col("s").alias("ancestor")), "ptr")
    return base.join(found.select("id", "ancestor", "hops"), "id", "left").select(F.col("t").alias(key), F.col("s").alias(node), "ancestor", *(["hops"] if hops else []))


def full_paths(df: DataFrame, trace: str = "trace_id", span: str = "span_id", parent: str = "parent_id", order: str = "arrival_seq") -> DataFrame:
    """The rows of ``hierarchy`` with depth >= 0: trace_id, span_id, root_span_id, depth, and ``path`` (array of span ids from
    the root down to the node).

    Nodes walk to their next splitter with the few names they pass; whole paths are put together for splitters only, and a
    node's path is its splitter's and its own walk. The result holds sum(depth) ids."""
    work = Workspace(df.sparkSession, "paths")
    tree = _linked(work, work.save(_nodes(df, trace, span, parent, order))[0])
    roots = tree.where(F.col("pid").isNull()).select(F.col("id").alias("root"), F.col("s").alias("root_span_id"))
    found = _solve(work, tree, paths=True)[0].join(roots, "root").join(tree.select("id", "t", "s"), "id")
    return found.select(F.col("t").alias("trace_id"), F.col("s").alias("span_id"), "root_span_id", "depth", F.concat(F.array("root_span_id"), "seg").alias("path"))


def descendants(paths: DataFrame) -> DataFrame:
    """Every (trace_id, ancestor, span_id, distance) with distance >= 1, from ``full_paths``."""
    up = F.posexplode(F.slice("path", 1, F.size("path") - 1))
    return paths.select("trace_id", "span_id", "depth", up.alias("at", "ancestor")).select("trace_id", "ancestor", "span_id", (F.col("depth") - F.col("at")).alias("distance"))


def subtree_sums(df: DataFrame, weight: Column | None = None, trace: str = "trace_id", span: str = "span_id", parent: str = "parent_id", order: str = "arrival_seq") -> DataFrame:
    """Per node with a root (trace_id, span_id, total): the sum of ``weight`` (1 by default; a node's greatest counts) over
    the node and all below it.

    Sums double: after k rounds a node knows the sum over what lies less than 2**k below it, and hands that to the node
    2**k above; nodes with no such node hand on nothing and walk no further. No pair of nodes is ever made. On and below
    loops the walk never ends: whoever is left when a round brings no new end is there, and left out."""
    work = Workspace(df.sparkSession, "sums")
    tree = _linked(work, work.save(_nodes(df, trace, span, parent, order, F.lit(1) if weight is None else weight))[0], "w")
    state, old = work.save(tree.select("id", F.col("pid").alias("ptr"), F.col("w").alias("sum")))
    left = state.where("ptr is not null").count()
    while left:
        on = state.where("ptr is not null")
        up = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("q"))
        moved = on.join(up, "ptr").select("id", F.col("q").alias("ptr"))
        got = on.groupBy(F.col("ptr").alias("id")).agg(F.sum("sum").alias("more"))
        state, path = work.save(state.select("id", "sum").join(got, "id", "left").join(moved, "id", "left").select("id", "ptr", (F.col("sum") + F.coalesce("more", F.lit(0))).alias("sum")))
        work.drop(old)
        old, now = path, state.where("ptr is not null").count()
        if now == left:
            break
        left = now
    return state.where("ptr is null").join(tree.select("id", "t", "s"), "id").select(F.col("t").alias("trace_id"), F.col("s").alias("span_id"), F.col("sum").alias("total"))


def subtree_sizes(df: DataFrame, **columns: str) -> DataFrame:
    """Per span with a root the number of its descendants."""
    return subtree_sums(df, **columns).select("trace_id", "span_id", (F.col("total") - 1).alias("n_descendants"))


def ordinals(df: DataFrame, sort: list[str], trace: str = "trace_id", span: str = "span_id", parent: str = "parent_id") -> DataFrame:
    """The depth-first tour of every trace: for each node with a root the numbers of its opening and its closing event (1, 2,
    ... in each trace), children and roots in the order of ``sort`` and then their id. ``df`` has one row per node, ids in
    normal form.

    A node's opening is one more than its parent's plus all events of the siblings before it; those come from subtree sizes
    and a running sum among siblings, and the sum along the way to the root doubles. No trace is walked in one place."""
    work = Workspace(df.sparkSession, "ordinals")
    rows = df.select(F.col(trace).alias("t"), F.col(span).alias("s"), F.col(parent).alias("p"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(sort)])
    sizes = subtree_sums(rows.withColumn("_o", F.lit(0)), None, "t", "s", "p", "_o").select(F.col("trace_id").alias("t"), F.col("span_id").alias("s"), F.col("total").alias("size"))
    base, _ = work.save(rows.join(sizes, ["t", "s"]))
    there = base.select("t", F.col("s").alias("p"), F.lit(True).alias("there"))
    base = base.join(there, ["t", "p"], "left").withColumn("p", F.when(F.col("there"), F.col("p")))
    before = Window.partitionBy("t", "p").orderBy(*[f"o{i}" for i in range(len(sort))], "s").rowsBetween(Window.unboundedPreceding, -1)
    state, _ = work.save(base.select("t", "s", F.col("p").alias("ptr"), "size", (F.coalesce(2 * F.sum("size").over(before), F.lit(0)) + 1).alias("opening")))
    while state.where("ptr is not null").limit(1).count():
        up = state.select("t", F.col("s").alias("ptr"), F.col("ptr").alias("q"), F.col("opening").alias("above"))
        state, _ = work.save(state.join(up, ["t", "ptr"], "left").select("t", "s", F.col("q").alias("ptr"), "size", (F.col("opening") + F.coalesce("above", F.lit(0))).alias("opening")))
    return state.select(F.col("t").alias(trace), F.col("s").alias(span), "opening", (F.col("opening") + 2 * F.col("size") - 1).alias("closing"))
