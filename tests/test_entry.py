import __spark_entry__ as entry


def test_queries_have_names_sql_and_the_flagship(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and {"p1_found", "p2_found", "p3_found", "p5_found"} <= set(queries)
    assert entry.entry(spark).count() > 0


def test_problem_queries_on_the_smallest_tables(spark, sf):
    for name, columns in {"p1_found": ["arrival_seq", "parent_path", "path"], "p2_found": ["trace_id", "span_id", "root_span_id", "depth"], "p3_found": ["arrival_seq"], "p5_found": ["period_start", "arrival_seq"]}.items():
        df = entry.queries()[name](spark, sf)
        assert df.columns == columns
        rows = df.collect()
        assert len(rows) == len(set(rows)) > 0


def test_intermediate_tables_can_be_cleared(spark):
    from pathlib import Path

    from spanloom import store

    work = store.Workspace(spark, "t")
    _, path = work.save(spark.range(3))
    assert Path(path.removeprefix("file://")).exists()
    store.clear(spark)
    assert not Path(path.removeprefix("file://")).exists()
