import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import hierarchy

SCHEMA = "trace_id string, span_id string, parent_id string, arrival_seq long, path string, depth int"


def brute(rows):
    parent = {}
    for t, s, p, o, *_ in sorted((r for r in rows if r[0] and r[1]), key=lambda r: (r[3] is None, r[3] or 0, str(r[2]))):
        parent.setdefault((t.lower().replace("-", ""), s.lower()), p.lower() if p else None)
    out = {}
    for k in parent:
        path, x = [], k
        while True:
            if x in path:
                loop = path[path.index(x) :]
                out[k] = (min(n[1] for n in loop), -1 if k in loop else -2)
                break
            path.append(x)
            up = (x[0], parent[x])
            if parent[x] is None or up not in parent:
                out[k] = (x[1], len(path) - 1)
                break
            x = up
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = hierarchy.hierarchy(df).collect()
    assert len(got) == len({(r.trace_id, r.span_id) for r in got})
    return {(r.trace_id, r.span_id): (r.root_span_id, r.depth) for r in got}


def test_shapes(spark):
    x = lambda i: f"{i:016x}"
    rows = [("T1", x(0), None, 1), ("T1", x(1), x(0), 2), ("T1", x(2), x(9999), 3), ("T1", x(3), "", 4), ("T1", x(4), x(4), 5), ("T1", x(5), x(4), 6)]
    rows += [("T2", x(i), x(i - 1) if i else None, i) for i in range(300)]  # a chain
    rows += [("T3", x(i), x((i + 1) % 70), i) for i in range(70)] + [("T3", x(100 + i), x(99 + i) if i else x(3), i) for i in range(40)]  # a long loop with a tail
    rows += [("T4", x(1), x(2), 2), ("T4", x(1).upper(), None, 1), ("T4", x(2), None, 3), ("T4", x(2), x(1), None)]  # redelivered with other parents
    rows += [(None, x(1), None, 1), ("T5", None, None, 2)]
    rows = [(*r, "clash", 5) for r in rows]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs_with_hot_trace(spark, seed):
    r = random.Random(seed)
    rows = []
    for t in range(8):
        n = 400 if t == 0 else r.randrange(1, 40)
        for i in range(n):
            rows.append((f"{t:032x}", f"{i:016x}", f"{r.randrange(max(1, n)):016x}" if r.random() < 0.15 else f"{r.randrange(i):016x}" if i else None, len(rows), None, None))
    r.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_empty_and_all_null(spark):
    assert run(spark, []) == {}
    assert run(spark, [(None, None, None, None, None, None)]) == {}


def test_paths_and_descendants(spark):
    rows = [("t", "a", None, 1, None, None), ("t", "b", "a", 2, None, None), ("t", "c", "b", 3, None, None), ("t", "d", "b", 4, None, None), ("t", "e", "e", 5, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    paths = hierarchy.full_paths(df)
    assert {r.span_id: r.path for r in paths.collect()} == {"a": ["a"], "b": ["a", "b"], "c": ["a", "b", "c"], "d": ["a", "b", "d"]}
    assert {(r.ancestor, r.span_id, r.distance) for r in hierarchy.descendants(paths).collect()} == {("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("b", "c", 1), ("b", "d", 1)}
    assert {r.span_id: r.n_descendants for r in hierarchy.subtree_sizes(df).collect()} == {"a": 3, "b": 2, "c": 0, "d": 0}


@pytest.mark.parametrize("seed", [3, 4])
def test_paths_and_sums_of_random_graphs(spark, seed):
    r = random.Random(seed)
    rows = [("t", f"{i:03x}", None if not i else f"{i - 1:03x}" if i < 120 else f"{r.randrange(i + (r.random() < 0.05)):03x}", i, None, r.choice([0, 1, None])) for i in range(300)]
    rows += [("t", "a0", "a1", 1, None, 1), ("t", "a1", "a0", 2, None, 1), ("t", "a2", "a1", 3, None, 1), ("u", "0", None, 1, None, 1)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    want = {k: v for k, v in brute(rows).items() if v[1] >= 0}
    parent = {(t, s): (t, p) for t, s, p, *_ in rows}
    paths = {(x.trace_id, x.span_id): x for x in hierarchy.full_paths(df).collect()}
    sums = {k: 0 for k in want}
    for k in want:
        line, x = [], k
        while x in parent:
            line.append(x)
            x = parent[x]
        assert paths[k].path == [s for _, s in line[::-1]] and (paths[k].root_span_id, paths[k].depth) == want[k]
        for x in line:
            sums[x] += next(w or 0 for t, s, _, _, _, w in rows if (t, s) == k)
    assert set(paths) == set(want)
    assert {(x.trace_id, x.span_id): x.total for x in hierarchy.subtree_sums(df, F.col("depth")).collect()} == sums
    assert hierarchy.subtree_sizes(df.limit(0)).count() == 0 == hierarchy.full_paths(df.limit(0)).count()


def test_nearest_ancestor_stops_at_the_first_hit_and_survives_loops(spark):
    rows = [("t", "a", None, True), ("t", "b", "a", False), ("t", "c", "b", True), ("t", "d", "c", None), ("t", "e", "f", False), ("t", "f", "e", False), ("u", "d", "c", True)]
    got = hierarchy.nearest_ancestor(spark.createDataFrame(rows, "trace_id string, span_id string, parent_id string, hit boolean"), "hit")
    assert {(r.trace_id, r.span_id): r.ancestor for r in got.collect()} == {("t", "a"): None, ("t", "b"): "a", ("t", "c"): "a", ("t", "d"): "c", ("t", "e"): None, ("t", "f"): None, ("u", "d"): None}
