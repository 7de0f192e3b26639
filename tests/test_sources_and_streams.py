import json

from pyspark.sql import functions as F

from spanloom.functions import text as X
from spanloom.functions.ids import normal_id, payload_digest
from spanloom.schemas import SPAN
from spanloom.sources import files, otlp, sinks
from spanloom.streaming import drain

REQUEST = {
    "resourceSpans": [{
        "resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "svc"}}, {"key": "n", "value": {"intValue": "5"}}]},
        "scopeSpans": [{"scope": {"name": "sc", "version": "1"}, "spans": [
            {"traceId": "AB" * 16, "spanId": "CD" * 8, "parentSpanId": "", "name": "one", "kind": 2, "startTimeUnixNano": "1600000000123456789", "endTimeUnixNano": "0", "status": {"code": 2, "message": "bad"},
             "attributes": [{"key": "a", "value": {"arrayValue": {"values": [{"boolValue": True}, {"kvlistValue": {"values": [{"key": "x", "value": {"doubleValue": 1.5}}]}}]}}}, {"key": "b", "value": {"bytesValue": "/w=="}}],
             "events": [{"name": "e", "timeUnixNano": "5", "attributes": [{"key": "k", "value": {"stringValue": "v"}}]}], "links": []},
            {"traceId": "zz", "spanId": "CD" * 8, "name": "two", "startTimeUnixNano": "1"},
        ]}],
    }]
}


def test_export_requests(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps(REQUEST) + "\n")
    spans = otlp.to_spans(otlp.read_requests(spark, str(tmp_path / "r.json")))
    good, bad = otlp.split_rejected(spans)
    r = good.first()
    assert (r.trace_id, r.parent_id, r.kind, r.service_name, r.error, r.status_message, r.ended_at, r.links) == ("ab" * 16, None, "SERVER", "svc", True, "bad", None, None)
    assert r.started_at.microsecond == 123456 and json.loads(r.attributes) == {"a": [True, {"x": 1.5}], "b": "ff"} and json.loads(r.resource_attributes)["n"] == 5
    assert r.events[0].name == "e" and json.loads(r.events[0].attributes) == {"k": "v"}
    assert [x.reason for x in bad.collect()] == ["id"]
    sinks.set_aside(bad, str(tmp_path / "dead"))
    assert spark.read.json(str(tmp_path / "dead")).count() == 1
    again = otlp.new_ids(good, "s").first()
    assert again.trace_id != r.trace_id and len(again.span_id) == 16


def test_files(spark, tmp_path):
    rows = [{"trace_id": "t", "span_id": "s", "name": "n", "started_at": "2020-01-01T00:00:00Z", "attributes": "{}", "scope": {"name": "x"}}, {"trace_id": "t", "span_id": "u", "seq": 9, "arrival_seq": 9}]
    (tmp_path / "f.json").write_text(json.dumps(rows))
    assert {r.span_id: r.seq for r in files.read_fixture(spark, str(tmp_path / "f.json")).collect()} == {"s": 1, "u": 9}
    (tmp_path / "l.jsonl").write_text('{"index": 1, "text": "a"}\nbroken\n{"index": 2, "text": "b"}\n{"index": 3}\n')
    done = spark.createDataFrame([(2,)], "index long")
    assert [r["index"] for r in files.read_lines(spark, str(tmp_path / "l.jsonl"), done).collect()] == [1]
    (tmp_path / "t.csv").write_text('TAG,Domain,Category,Data Type,regulatory_tags,Is Personalized\nPN,person,c,personID,"[""PII""]",1\nX,ops,c,data,,\n')
    assert [(r.tag, r.identifier_type, r.regulatory_tags, r.personalised) for r in files.read_taxonomy(spark, str(tmp_path / "t.csv")).collect()] == [("PN", "PID", ["PII"], True), ("X", "DATA", [], None)]
    (tmp_path / "b.json").write_text(json.dumps({"rules": [{"rule_id": "1", "x": [1]}, {"rule_id": "2"}]}, indent=1))
    assert [r.rule_id for r in files.read_bundle(spark, str(tmp_path / "b.json")).orderBy("at").collect()] == ["1", "2"]
    df = spark.createDataFrame([(1, ["a"])], "i int, xs array<string>")
    files.write_results(df, str(tmp_path / "o"), "csv")
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "o")).first().xs == '["a"]'
    assert files.table_or_empty(spark, "no_such_table", "a int").count() == 0


def test_repeatable_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "trace_id string, v int")
    sinks.replace_traces(rows, rows, path)
    new = spark.createDataFrame([("a", 7)], "trace_id string, v int")
    for _ in range(2):
        sinks.replace_traces(new, new, path)
    assert sorted((r.trace_id, r.v) for r in spark.read.parquet(path).collect()) == [("a", 7), ("b", 3)]
    p2 = str(tmp_path / "p")
    for _ in range(2):
        sinks.append_once(rows, p2, ["trace_id"])
    assert spark.read.parquet(p2).count() == 2


def test_streams_give_the_batch_result(spark, sf, tmp_path):
    spans = spark.read.parquet(f"{sf}/spans.parquet")
    land = str(tmp_path / "land")
    for k in range(3):
        spans.where(F.col("arrival_seq") % 3 == k).coalesce(1).write.mode("append").parquet(land)
    out = str(tmp_path / "out")
    step = drain.derive_by_trace(str(tmp_path / "kept"), out, lambda df: df.withColumn("trace_id", normal_id("trace_id")).groupBy("trace_id").agg(F.count("*").alias("n")))
    drain.drain(drain.read_spans(spark, land, files_per_batch=1), step, str(tmp_path / "cp")).awaitTermination()
    got = {(r.trace_id, r.n) for r in spark.read.parquet(out).collect()}
    assert got == {(r.t, r["count"]) for r in spans.groupBy(normal_id("trace_id").alias("t")).count().where("t is not null").collect()}


def test_panes_of_a_stream_are_those_of_the_batch(spark, sf, tmp_path):
    from spanloom.operators import slicing

    spans = spark.read.parquet(f"{sf}/spans.parquet").select("arrival_seq", "started_at", "observed_at")
    cut = [0, 200, 450, 1 << 40]
    land, out = str(tmp_path / "land"), str(tmp_path / "panes")
    step = drain.pane_step(out, out + "-w")
    for k in range(3):
        batch = spans.where((F.col("arrival_seq") >= cut[k]) & (F.col("arrival_seq") < cut[k + 1]))
        for _ in range(2):  # a batch that runs again changes nothing
            step(batch, k)
    assert land
    got = {r.pane_start: (r.n_rows, r.n_past_cutoff) for r in drain.pane_totals(spark, out).collect()}
    panes = slicing.assign_panes(spans)
    assert got == {r.pane_start: (r.n_rows, r.n_past_cutoff) for r in slicing.pane_counts(panes).collect()}
    told = {r.window_start: (r.n_rows, r.version) for r in drain.window_totals(spark, out + "-w").collect()}
    last = {r.window_start: r.n_rows for r in slicing.revisions(panes).orderBy("tick").collect()}
    assert {w: n for w, (n, _) in told.items()} == last and max(v for _, v in told.values()) > 1


def test_a_stream_keeps_the_first_delivery_only(spark, sf, tmp_path):
    from spanloom.operators import redelivery

    spans = spark.read.parquet(f"{sf}/spans.parquet").select("trace_id", "span_id", "arrival_seq", "name")
    ids, out = str(tmp_path / "ids"), str(tmp_path / "out")
    step = drain.once_step(ids, out)
    cut = [0, 200, 450, 1 << 40]
    for k in range(3):
        batch = spans.where((F.col("arrival_seq") >= cut[k]) & (F.col("arrival_seq") < cut[k + 1]))
        for _ in range(2):  # a batch that runs again changes nothing
            step(batch, k)
    got = sorted(r.arrival_seq for r in spark.read.parquet(out).collect())
    assert got == sorted(r.arrival_seq for r in redelivery.deduplicate(spans).collect()) and len(got) < spans.count()


def test_alert_fold_as_a_stream(spark, sf, tmp_path):
    from spanloom.operators import records

    rows = spark.read.parquet(f"{sf}/trace_risk_records.parquet")
    land = str(tmp_path / "land")
    rows.coalesce(1).write.parquet(land)
    stream = spark.readStream.schema(rows.schema).parquet(land)
    got = []
    q = drain.escalation_stream(stream).writeStream.outputMode("append").foreachBatch(lambda df, n: got.extend(map(tuple, df.collect()))).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert set(got) == {(r.trace_id, r.version, r.action) for r in records.escalations(rows).collect()}


def test_text_functions(spark):
    df = spark.createDataFrame([("https://A.Example.:443/x", "ns", "id"), ("http://u:p@h/", "", "id"), ("nonsense", None, "id")], "u string, n string, i string")
    assert [r[0] for r in df.select(X.hostname(F.col("u"))).collect()] == ["a.example", "", ""]
    assert [r[0] for r in df.select(X.ident_key(F.col("n"), F.col("i"))).collect()] == ["ns/id", "id", "id"]
    hosts = spark.createDataFrame([("a.svc",), ("10.1.2.3",), ("10.2.0.1",), ("x.example",), (None,)], "h string")
    assert [r[0] for r in hosts.select(X.matches_any(F.col("h"), ["*.svc", "10.1.0.0/16"])).collect()] == [True, True, False, False, False]
    assert X.redact_spans("abcdef", [(1, 3, "X"), (2, 4, "Y")]) == "a[X,Y]ef"
    e = spark.createDataFrame([("x" * 200 + "KEY" + "y" * 10, 200, 203)], "t string, a int, b int").select(X.excerpt(F.col("t"), F.col("a"), F.col("b")).alias("e")).first().e
    assert e.text[e.start : e.end] == "KEY" and e.text.startswith("…") and not e.text.endswith("…")
    ids = spark.createDataFrame([("AB-cd",), ("0xAB",), ("",), (None,), (" a b ",)], "i string")
    assert [r[0] for r in ids.select(normal_id("i")).collect()] == ["abcd", "ab", None, None, "ab"]
    d = spark.createDataFrame([('{"b":1,"a":2}',), ('{"a": 2, "b": 1}',), ("x",)], "j string").select(payload_digest(F.col("j"))).collect()
    assert d[0][0] == d[1][0] != d[2][0]


def test_schema_names_match_the_tables(spark, sf):
    assert [f.name for f in spark.read.parquet(f"{sf}/spans.parquet").schema] == [x.split()[0] for x in SPAN.replace("struct<name:string,version:string>", "s").replace("array<struct<name:string,time_unix_nano:long,attributes:string>>", "a").replace("array<struct<trace_id:string,span_id:string,attributes:string>>", "a").split(", ")]
