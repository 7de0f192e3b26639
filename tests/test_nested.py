import json

import pytest
from pyspark.sql import functions as F

from spanloom.operators import nested

ROW = "arrival_seq long, attributes string, resource_attributes string, events array<struct<name:string,time_unix_nano:long,attributes:string>>, links array<struct<trace_id:string,span_id:string,attributes:string>>, path string"


def brute(doc):
    """Labels of elements by plain recursion over sets of paths."""

    def read(v):
        if isinstance(v, str):
            try:
                x = json.loads(v, parse_constant=lambda c: 1 / 0)
            except Exception:
                return v
            return x if isinstance(x, (dict, list)) else v
        return v

    out = set()

    def walk(v, path, element):
        v = read(v)
        if isinstance(v, dict):
            if element:
                out.add(path)
            for k, x in v.items():
                p, segs = path, k.split(".")
                for i, s in enumerate(segs):
                    p = (*p, s)
                    if len(segs) > 1 and s.isdigit() and i < len(segs) - 1:
                        out.add(p)
                walk(x, p, len(segs) > 1 and segs[-1].isdigit())
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, (*path, str(i)), True)

    top = read(doc) if doc else None
    if isinstance(top, (dict, list)):
        walk(top, (), False)
    return {".".join(p): ".".join(next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in out), ())) for p in out}


DOCS = [
    None, "", "{", "[]", "{}", "3", '"x"', '{"a": [1, null, {"b": 2}]}', '{"a": [[{"b": [{"c": 1}]}], {"d": 1}]}', '{"a.0.b": 1, "a.1.b.0.c": 2, "a.0.d.3": {"e": 1}, "a.2": 5}',
    '{"a": "[{\\"b\\": \\"[{}]\\"}]"}', '{"a": ["{\\"x\\": 1}", "[1, {\\"y\\": 2}]", "plain"]}', '[{"a": 1}, 2, [{"b": 1}]]', '{"a": [{"x": NaN}]}', '{"a2a.m": [{}], "0": [{}], "x.07.y": 1}', '{"a": " [{}]"}', '{"a": "[{}"}', '{"é.0.ü": 1, "k": [{"e\\u0301": [{}]}]}', '{"a": [{"b":',
    json.dumps({"a": [{"b": [{"c": i} for i in range(300)]}] * 3}),
]


@pytest.mark.parametrize("doc", DOCS)
def test_elements_are_those_of_plain_recursion(doc):
    got = {p[1:]: (p[1:c] if c else "") for p, c, _ in nested.elements(doc)}
    assert got == brute(doc)


def test_two_notations_of_one_element_are_one():
    got = nested.elements('{"a": [{"b": 1}], "a.0.c": 2}')
    assert [p for p, _, _ in got] == [".a.0"]


def test_flatten_covers_columns_nulls_repeats_and_clashing_names(spark):
    rows = [
        (1, '{"a": [{"b": 1}]}', None, [("e", 1, '{"f": [{"g": 1}]}'), None, ("e", 1, None)], None, "x"),
        (1, '{"a": [{"b": 1}]}', None, None, [("t", "s", "broken{")], "x"),
        (None, None, '[{"z": []}]', [], [], None),
    ]
    df = spark.createDataFrame(rows, ROW)
    got = sorted(map(tuple, nested.flatten(df, "arrival_seq", ["attributes", "resource_attributes"], ["events", "links"]).collect()), key=str)
    assert got == sorted(
        [(1, "", "attributes.a.0"), (1, "", "attributes.a.0"), (1, "", "events.0"), (1, "events.0", "events.0.f.0"), (1, "", "events.2"), (1, "", "links.0"), (None, "", "resource_attributes.0")], key=str
    )
    assert nested.flatten(df.limit(0), "arrival_seq", ["attributes"], ["events"]).count() == 0


def test_child_tables_keep_the_parent_and_the_scalars(spark):
    doc = json.dumps({"m": [{"role": "u", "calls": [{"id": "c1", "n": 2}, {"id": None}]}], "m.1.role": "a", "top": True})
    df = spark.createDataFrame([(7, doc)], "k long, attributes string")
    nodes = nested.flatten(df, "k", ["attributes"], [], fields=True)
    calls = nested.child_table(nodes, "k", "attributes.m.*.calls.*", {"id": "string", "n": "int"}).orderBy("path").collect()
    assert [tuple(r) for r in calls] == [(7, "attributes.m.0", "attributes.m.0.calls.0", 0, "c1", 2), (7, "attributes.m.0", "attributes.m.0.calls.1", 1, None, None)]
    root = nodes.where(F.col("path") == "attributes").first()
    assert json.loads(root.fields) == {"top": True}
    report = {r.schema_path: (r.n_rows, r.n_with_parent) for r in nested.table_report(nodes).collect()}
    assert report["attributes.m.*"] == (2, 0) and report["attributes.m.*.calls.*"] == (2, 2)


def test_all_fields_of_a_struct_are_keys_of_its_element(spark):
    rows = [(1, None, None, [("e", 5, '{"f": [{"g": 1}], "name": "n"}'), None, (None, None, "cut{"), ("[{}]", 6, None)], [("t", "s", None), (None, None, None)], "x")]
    df = spark.createDataFrame(rows, ROW)
    nodes = nested.flatten(df, "arrival_seq", ["attributes"], ["events", "links"], fields=True, struct_keys=True)
    got = {r.path: (r.parent_path, json.loads(r.fields)) for r in nodes.collect()}
    assert got == {
        "events.0": ("", {"name": "e", "time_unix_nano": 5, "attributes.name": "n"}), "events.0.attributes.f.0": ("events.0", {"g": 1}), "events.2": ("", {"attributes": "cut{"}),
        "events.3": ("", {"time_unix_nano": 6}), "events.3.name.0": ("events.3", {}), "links.0": ("", {"trace_id": "t", "span_id": "s"}), "links.1": ("", {}),
    }
    assert {(r.path, r.parent_path) for r in nested.flatten(df, "arrival_seq", ["attributes"], ["events", "links"], struct_keys=True).collect()} == {(p, v[0]) for p, v in got.items()}
    table = nested.child_table(nodes, "arrival_seq", "events.*", {"name": "string", "time_unix_nano": "long"}).where("position = 0").first()
    assert (table.name, table.time_unix_nano) == ("e", 5)
