import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.operators import redelivery as R

SCHEMA = "trace_id string, span_id string, arrival_seq long, ord long, name string"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 40)), max_size=200), st.integers(1, 60))
def test_table_gives_back_every_loser(items, step):
    table, best, lost = R.QuotientTable(4), {}, []
    for s in range(0, len(items), step):
        part = items[s : s + step]
        keys = np.array([[k, k * 7, k ^ 3] for k, _ in part], np.uint64).reshape(-1, 3)
        lost += table.insert(R.permute(keys), np.array([o for _, o in part], np.int64)).tolist()
    for k, o in items:
        best.setdefault(k, []).append(o)
    assert sorted(lost) == sorted(o for v in best.values() for o in sorted(v)[1:])
    keys, first = table.items()
    assert {int(k[0]): int(o) for k, o in zip(R.unpermute(keys), first)} == {k: min(v) for k, v in best.items()}


def test_permutation_can_be_undone():
    x = np.random.default_rng(1).integers(0, 2**64, (500, 3), dtype=np.uint64)
    assert (R.unpermute(R.permute(x)) == x).all() and not (R.permute(x) == x).all(axis=1).any()


def test_forms_hot_ids_nulls_and_odd_widths(spark):
    t, s = "ab" * 16, "cd" * 8
    rows = [(t, s, 5), (t.upper(), s, 3), ("abababab-abab-abab-abab-" + "ab" * 6, s.upper(), 9)]
    rows += [("0" * 32, "1" * 16, 100 + i) for i in range(500)]  # hot
    rows += [("xyz", "1", 20), ("xyz", "1", 21), ("xy", "z1", 22), ("XYZ", "1", 23), (None, s, 30), (None, s, 31), (t, None, 32), (t, None, 33), ("", "", 34), ("", "", 35), ("7" * 32, "7" * 16, None), ("7" * 32, "7" * 16, 50)]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], SCHEMA).repartition(5)
    got = sorted(r[0] for r in R.redelivered(df).collect())
    assert got == sorted([5, 9, 21, 23, *range(101, 600)])
    kept = R.deduplicate(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - len(got)


def test_tables_are_dropped_between_shards(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(R, "TABLE_IDS", 7)
    r = np.random.default_rng(3)
    shard = np.sort(r.integers(0, 12, 400)).astype(np.int32)
    keys = np.stack([shard.astype(np.uint64), r.integers(0, 9, 400).astype(np.uint64), np.zeros(400, np.uint64)], 1)
    order = r.permutation(400).astype(np.int64)
    whole = pa.RecordBatch.from_arrays([pa.array(shard), R._bytes(keys), pa.nulls(400, pa.string()), pa.array(order)], names=["shard", "image", "wide", "ord"])
    got = [o for b in R._merge(iter([whole.slice(0, 150), whole.slice(150, 33), whole.slice(183)])) for o in b.column(0).to_pylist()]
    best = {}
    for k, o in zip(map(tuple, keys.tolist()), order.tolist()):
        best.setdefault(k, []).append(o)
    assert sorted(got) == sorted(o for v in best.values() for o in sorted(v)[1:])


def test_empty(spark):
    assert R.redelivered(spark.createDataFrame([], SCHEMA)).count() == 0
