import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.llm import packing as P


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_best_fit_fits_and_opens_a_container_only_when_needed(sizes):
    box = P.best_fit(np.array(sizes, np.int64), 100)
    load = np.bincount(box, sizes, minlength=0) if sizes else np.zeros(0)
    assert (load <= 100).all() and len(load) <= max(1, 2 * -(-sum(sizes) // 100)) or not sizes
    two = np.sort(load)[:2]
    assert len(two) < 2 or two.sum() > 100  # two containers that would fit in one never stay apart


def docs(spark, n=900):
    rows = [(i, "word " * (1 + i * 37 % 600), ["big", "big", "small", None][i % 4]) for i in range(n)] + [(10_000, "tok " * 5000, "big"), (10_001, "", "small"), (10_002, None, "big"), (10_003, "x", None), (10_003, "x", None)]
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, part int")


@pytest.fixture(scope="module")
def packed(spark):
    return P.pack(docs(spark)).cache()


def test_every_token_is_in_one_container(spark, packed):
    counted = P.count_tokens(docs(spark), "text", ["doc_id"]).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"))
    got = packed.groupBy("doc_id").agg(F.sum("n_tokens").cast("long").alias("n"))
    want = {(r.doc_id, r.n) for r in counted.where("n > 0").collect()}
    assert {(r.doc_id, r.n) for r in got.collect()} == want
    assert packed.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).where(f"n > {P.CAPACITY}").count() == 0


def test_only_texts_longer_than_a_container_are_split(packed):
    parts = packed.groupBy("doc_id").agg(F.count("*").alias("c"), F.sum("n_tokens").alias("n"), F.countDistinct("part").alias("p"))
    assert {r.doc_id for r in parts.where("p > 1").collect()} == {10_000}
    whole = packed.where("doc_id = 10000").orderBy("part").collect()
    assert all(r.n_tokens == P.CAPACITY for r in whole[:-1])


def test_little_room_is_left(packed):
    r = P.fill_report(packed).first()
    assert r.filled > 0.96 and r.fullest <= P.CAPACITY


def test_mixture_is_kept_in_every_full_window(spark):
    rows = [(i, "w " * 300, "abc"[i % 3]) for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = P.mixture_report(P.pack(df, mixture={"a": 0.5, "b": 0.3, "c": 0.2})).collect()
    windows = sorted({r.window_id for r in got})
    first = {r.source: r.share for r in got if r.window_id == windows[0]}
    assert abs(first["a"] - 0.5) < 0.01 and abs(first["b"] - 0.3) < 0.01 and abs(first["c"] - 0.2) < 0.01
    assert sum(r.n_tokens for r in got) == 9000 * 301 or sum(r.n_tokens for r in got) >= 9000 * 300


def test_targets_hold_in_every_window_until_a_queue_is_dry(spark):
    rows = [(i, "w " * (50 + i * 31 % 400), "abc"[0 if i % 3 else 1 + i % 2]) for i in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    target = {"a": 0.5, "b": 0.3, "c": 0.2}
    got = P.mixture_report(P.pack(df, mixture=spark.createDataFrame(list(target.items()), "source string, share double"))).collect()
    last = {s: max(r.window_id for r in got if r.source == s) for s in target}
    full = [w for w in {r.window_id for r in got} if w < min(last.values())]
    assert len(full) >= 2
    for w in full:
        share = {r.source: r.n_tokens / (P.WINDOW * P.CAPACITY) for r in got if r.window_id == w}
        assert all(abs(share[s] - target[s]) < 0.003 for s in target), (w, share)


def test_any_number_of_sources(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("one two three four").alias("text"), F.concat(F.lit("s"), F.col("id") % 15_000).alias("source"))
    got = P.pack(df).agg(F.count("*").alias("n"), F.count_distinct("source").alias("s")).first()
    assert (got.n, got.s) == (30_000, 15_000)


def test_empty(spark):
    assert P.pack(docs(spark).limit(0)).count() == 0


def test_the_mixture_query_steers_to_shares_that_differ_from_the_corpus(spark):
    from spanloom.llm.queries import p6_mixture

    rows = p6_mixture(spark, "/root/testdata/sf0.1").collect()
    first = [r.n_tokens for r in rows if r.window_id == 0]
    n = len({r.source for r in rows})
    assert len(first) == n > 1 and all(abs(x - 256 * 2048 / n) <= 2048 for x in first)  # to one item
    assert len({r.source for r in rows if r.window_id == max(x.window_id for x in rows)}) < n
