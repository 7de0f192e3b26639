import datetime as dt

import pytest
from pyspark.sql import functions as F

from spanloom.operators import classify, graphs, interactions, listing, policy, records
from spanloom.operators.attributes import blocked_pattern, exchange_kinds, outcome_error, sidecar_spans, split_blocked
from spanloom.schemas import SPAN

REC = "trace_risk_id string, trace_id string, version int, computed_at timestamp, trace_risk_level string, interaction_count int, policy_event_count int"


def recs(spark):
    t = dt.datetime(2020, 1, 1)
    rows = [("a", "t", 1, t, "low", 1, 0), ("b", "t", 2, None, "high", 2, 1), ("c", "t", 3, t, "critical", 2, 1), ("d", "t", 4, t, "high", 2, 1), ("e", "u", 1, t, "weird", None, None), ("f", "v", None, t, "high", 1, 1)]
    return spark.createDataFrame(rows, REC)


def test_latest_distribution_and_escalation(spark):
    r = recs(spark)
    assert {(x.trace_id, x.version, x.trace_risk_level) for x in records.latest(r, "trace_id").collect()} == {("t", 4, "high"), ("u", 1, "weird")}
    assert {x.trace_risk_level: x.n for x in records.distribution(r, "trace_risk_level").collect()} == {"critical": 1, "high": 3, "medium": 0, "low": 1, "none": 0}
    assert {(x.version, x.action) for x in records.escalations(r.where("trace_id = 't'")).collect()} == {(2, "created"), (3, "superseded"), (4, "duplicate")}
    assert {x.trace_id: x.level for x in records.roll_up(r).collect()} == {"t": "critical", "u": "none", "v": "high"}
    assert records.latest(r.limit(0), "trace_id").count() == 0


def test_keyset_pages_cover_all_rows_once(spark):
    df = spark.range(57).select((F.col("id") % 5).alias("a"), F.col("id").alias("b"))
    order, after, seen = [("a", "desc"), ("b", "asc")], None, []
    while True:
        rows = records.page(df, order, after, 10).collect()
        seen += rows[:10]
        if len(rows) <= 10:
            break
        after = [rows[9].a, rows[9].b]
    assert [(r.a, r.b) for r in seen] == sorted(((i % 5, i) for i in range(57)), key=lambda x: (-x[0], x[1]))


def test_append_changed_takes_null_as_equal(spark):
    old = spark.createDataFrame([("k", 1, None, "x"), ("l", 3, 5, "y")], "key string, version int, a int, b string")
    new = spark.createDataFrame([("k", None, "x"), ("l", None, "y"), ("m", 1, "z")], "key string, a int, b string")
    assert {(r.key, r.version) for r in records.append_changed(old, new, ["key"], ["a", "b"]).collect()} == {("l", 4), ("m", 1)}


def test_every_version_is_compared_with_the_one_before(spark):
    got = records.version_changes(recs(spark), "trace_id", ["trace_risk_level", "interaction_count"]).collect()
    assert {(r.trace_id, r.version, r._first) for r in got} == {("t", 1, True), ("t", 2, False), ("t", 3, False), ("t", 4, False), ("u", 1, True)}
    same = records.version_changes(recs(spark), "trace_id", ["interaction_count", "policy_event_count"]).collect()
    assert {(r.trace_id, r.version) for r in same} == {("t", 1), ("t", 2), ("u", 1)}


def test_versions_from_the_third_on_come_out(spark, sf):
    from spanloom.plans.records import risk_version_changed_keys, risk_version_changes

    rows = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/trace_risk_records.parquet").orderBy("trace_id", "version").collect()
    pairs = [(a, b) for a, b in zip(rows, rows[1:]) if a.trace_id == b.trace_id]
    want = {(b.trace_id, b.version) for a, b in pairs if (a.trace_risk_level, a.interaction_count) != (b.trace_risk_level, b.interaction_count)} | {(r.trace_id, 1) for r in rows if r.version == 1}
    base = sf.replace("0.001", "0.01")
    got = {(r.trace_id, r.version) for r in risk_version_changes(spark, base).collect()}
    assert got == want and max(v for _, v in got) > 2
    keys = {b.trace_id for a, b in pairs if (a.trace_risk_level, a.policy_event_count) != (b.trace_risk_level, b.policy_event_count)}
    assert {r.trace_id for r in risk_version_changed_keys(spark, base).collect()} == keys


def test_tri_state_error_duration_and_repeated_legs(spark):
    t = lambda s: dt.datetime(2020, 1, 1, 0, 0, s)
    rows = [("1", "request", t(1), None, None, None, 1), ("1", "response", t(3), None, False, None, 2), ("1", "response", t(9), None, True, None, 7), ("2", "request", t(1), None, None, None, 3), ("3", "response", None, None, True, None, 4)]
    legs = spark.createDataFrame(rows, "interaction_id string, leg_type string, occurred_at timestamp, payload_hash string, error boolean, content_kind string, seq long")
    got = {r.interaction_id: (r.error, r.duration_s, r.max_seq, r.has_response) for r in interactions.legs_by_interaction(legs).collect()}
    assert got == {"1": (False, 2.0, 7, True), "2": (None, None, 3, False), "3": (True, None, 4, True)}


def test_contiguous_prefix(spark):
    df = spark.createDataFrame([(1, True), (2, True), (3, None), (4, True)], "seq long, ready boolean")
    assert [r.seq for r in interactions.contiguous_prefix(df, "ready").orderBy("seq").collect()] == [1, 2]
    assert interactions.contiguous_prefix(df.where("ready"), "ready").count() == 3


FLOW = "id string, flows array<struct<kind:string,tags:array<string>,items:array<struct<level:string,types:array<string>>>>>"


def test_rules(spark):
    ev = spark.createDataFrame([
        ("a", [("ext", ["x", "y"], [("HIGH", ["p"])]), ("int", ["z"], [])]), ("b", [("ext", [], [("LOW", ["p", "q"]), ("HIGH", [])])]), ("c", []), ("d", None), ("e", [("int", ["x", "y", "w"], [("HIGH", ["p", "q"])])]),
    ], FLOW)
    rules = [
        {"id": "1", "risk_level": "low", "enforcement": "block", "explanation": "one", "when": {"kind": "ext"}}, {"id": "2", "risk_level": "high", "enforcement": "warn", "explanation": "two", "when": {"tags": ["y", "x"]}},
        {"id": "3", "risk_level": "critical", "enforcement": "audit", "explanation": "three", "when": {"items": [{"level": "HIGH", "types": ["q"]}]}},
    ]
    got = {r.id: (r.fired, r.risk_level, r.enforcement, r.explanation) for r in policy.evaluate(ev, rules).collect()}
    assert got == {"a": (["1", "2"], "high", "block", "two; one"), "b": (["1"], "low", "block", "one"), "c": ([], "none", "allow", ""), "d": ([], "none", "allow", ""), "e": (["2", "3"], "critical", "warn", "three; two")}
    assert {r.id: r.risk_level for r in policy.evaluate(ev, rules, mode="first_fires").collect()}["e"] == "high"
    with pytest.raises(policy.UnsupportedRule):
        policy.evaluate(ev, [{"id": "x", "risk_level": "low", "enforcement": "warn", "when": {"nothing": 1}}])


def test_classification(spark):
    df = spark.createDataFrame([("a", "mail a@b.example or 415-555-0199"), ("b", "host 10.1.2.3"), ("c", ""), ("d", None), ("e", "card 4111111111111111")], "k string, t string")
    got = {r.k: (r.level, r.has_bundle, r.n_findings, r.primary_domain) for r in classify.verdicts(df, "k", "t").collect()}
    assert got == {"a": ("RESTRICTED", True, 2, "person"), "b": ("INTERNAL", False, 1, "operations"), "c": ("PUBLIC", False, 0, None), "d": ("PUBLIC", False, 0, None), "e": ("RESTRICTED", False, 1, "finance")}
    assert df.select(classify.redacted(F.col("t"), classify.detect(F.col("t")))).first()[0] == "mail [EMAIL] or [PHONE]"
    long = "x " * 3000 + "a@b.example" + " y" * 3000
    assert classify.chunked(classify.pattern_detector)(long) == classify.pattern_detector(long)
    assert classify.merge_tokens("New York, USA and Rome", [(0, 3, "B-LOC"), (4, 8, "I-LOC"), (10, 13, "B-LOC"), (18, 22, "B-LOC")]) == [(0, 8, "LOC"), (10, 13, "LOC"), (18, 22, "LOC")]
    bodies = spark.createDataFrame([('"x"',), ('{"messages":[{"content":"a"},{"message.content":"b"},{"content":""}]}',), ('{"b":1,"a":"é"}',), ("no json",)], "c string")
    assert [r[0] for r in bodies.select(classify.classifiable_text(F.col("c"))).collect()] == ["x", "a\nb", '{"a": "é", "b": 1}', "no json"]


def span(spark, rows):
    """Rows (trace, span, parent, seconds, attributes, scope name, kind, ended)."""
    t0 = dt.datetime(2020, 1, 1)
    full = [(n, n, 1, t, s, p, "name", k, "svc", (sc, "1"), t0 + dt.timedelta(seconds=at), t0 + dt.timedelta(seconds=at + 1) if end else None, None, None, t0, a, None, None, None, None) for n, (t, s, p, at, a, sc, k, end) in enumerate(rows)]
    return spark.createDataFrame(full, SPAN)


def test_finalisation(spark):
    df = span(spark, [("A1", "B1", None, 1, None, "s", "X", False), ("a1", "b1", "c1", 2, None, "s", "Y", True), ("a1", "b1", None, 3, None, "s", "Z", True)])
    r = listing.finalized(df).first()
    assert (r.parent_id, r.kind, r.arrival_seq, r.seq, r.started_at.second) == (None, "Y", 0, 1, 1)
    assert [x.outcome for x in listing.delivery_outcomes(df).orderBy("arrival_seq").collect()] == ["inserted", "finalized", "duplicate"]


def side(role, direction, protocol, xid, me=None, **more):
    import json

    return json.dumps({"lineage.role": role, "lineage.direction": direction, "lineage.protocol": protocol, "lineage.exchange.id": xid, "lineage.self.id": me, **more})


def test_sidecar_plan(spark):
    rows = [
        ("t1", "a1", None, 1, side("request", "inbound", "a2a", "a1", "front", **{"lineage.principal.sub": "u1", "input.value": "hi"}), "s", "SERVER", True),
        ("t1", "a2", "a1", 2, side("request", "outbound", "mcp", "a2", "front", **{"lineage.peer.host": "tool:80"}), "s", "CLIENT", True),
        ("t1", "a3", "a2", 3, side("request", "inbound", "mcp", "a3", "tool-pod", **{"lineage.self.namespace": "ns"}), "s", "SERVER", True),
        ("t1", "a4", "a2", 4, side("response", "outbound", "mcp", "a2", "front", **{"lineage.outcome": "denied", "output.value": "no"}), "s", "CLIENT", True),
        ("t1", "a5", "a1", 5, side("request", "outbound", "smtp", "a5", "front"), "s", "CLIENT", True), ("t1", "a6", "a3", 6, None, "s", None, True),
    ]
    plan = interactions.plan(span(spark, rows))
    got = {r.anchor_span_id: (r.caller_key, r.callee_key, r.parent_span_id) for r in plan["interactions"].collect()}
    assert got == {"a1": ("user:u1", "agent:front", None), "a2": ("agent:front", "tool:ns/tool-pod", "a1")}
    assert {(r.anchor_span_id, r.leg_type, r.error) for r in plan["legs"].collect()} == {("a1", "request", None), ("a2", "request", None), ("a2", "response", True)}
    assert {(r.span_id, r.anchor_span_id, r.role, r.leg_type) for r in plan["evidence"].collect()} == {("a1", "a1", "anchor", "request"), ("a2", "a2", "anchor", "request"), ("a3", "a2", "connector", None), ("a4", "a2", "connector", "response"), ("a5", "a1", "connector", None), ("a6", "a2", "connector", None)}
    assert [r.span_id for r in plan["violations"].collect()] == ["a5"]
    ids = interactions.with_ids(plan["interactions"]).where("anchor_span_id = 'a1'").first()
    import uuid

    assert ids.id == str(uuid.uuid5(uuid.UUID("9c7e2b4a-1d6f-4a8b-9c0d-2e3f4a5b6c7d"), "t1/a1"))


def test_kinds_and_blocklist(spark):
    rows = [("t", f"{i:x}", None, i, side("request", d, p, f"{i:x}", "m", **m), "s", "CLIENT", True) for i, (d, p, m) in enumerate([("outbound", "mcp", {"mcp.method": "ping"}), ("outbound", "mcp", {"mcp.method": "tools/list"}), ("outbound", "http", {"url.path": "/mcp"}), ("inbound", "http", {}), ("outbound", "inference", {})])]
    got = [(r.caller_kind, r.callee_kind, r.request_kind) for r in exchange_kinds(sidecar_spans(interactions.sidecar_rows(span(spark, rows)))).orderBy("arrival_seq").collect()]
    assert got == [("agent", "tool", "mcp_lifecycle_request"), ("agent", "tool", "tool_discovery_request"), ("agent", "service", "mcp_lifecycle_request"), ("client", "agent", "http_request_body"), ("agent", "llm", "llm_chat_prompt")]
    names = spark.createDataFrame([("GET /healthz/x", None), ("/metrics", None), ("GET /metrics2", None), (None, None), ("otlp_receiver/a", None)], "name string, observed_at timestamp")
    assert [r[0] for r in names.select(blocked_pattern(F.col("name"))).collect()] == ["(GET|POST) /healthz.*", "/metrics", None, None, "otlp_receiver/.*"]
    kept, tally = split_blocked(names)
    assert kept.count() == 2 and {r.pattern: r.n_spans for r in tally.collect()}["/metrics"] == 1
    out = spark.createDataFrame([("ok", True), ("denied", None), (None, True), ("odd", False)], "o string, e boolean").select(outcome_error(F.col("o"), F.col("e")))
    assert [r[0] for r in out.collect()] == [False, True, True, False]


def test_graph_of_calls(spark):
    oi, http = "openinference.instrumentation.x", "opentelemetry.instrumentation.http"
    rows = [
        ("a", "1", None, 1, '{"openinference.span.kind": "AGENT", "agent.name": "boss"}', oi, None, True), ("a", "2", "1", 2, None, "plain", None, True), ("a", "3", "2", 3, '{"openinference.span.kind": "LLM", "llm.model_name": "p/m1"}', oi, None, True),
        ("a", "4", "1", 4, None, http, "CLIENT", True), ("a", "5", "4", 5, '{"openinference.span.kind": "TOOL", "tool.name": "t"}', oi, None, True),
    ]
    df = span(spark, rows)
    assert {(r.caller_key, r.callee_key) for r in graphs.calls(df).collect()} == {("agent:boss", "llm:m1"), ("agent:boss", "tool:t")}
    assert {r.span_id: r.component for r in graphs.components(df).collect()} == {"1": "1", "2": "1", "3": "1", "5": "5"}


def test_shares_ranking_and_fingerprints(spark):
    d = spark.createDataFrame([("t", ["a", "b"], "high"), ("t", ["a"], "low"), ("u", ["z"], "low"), ("v", [], "none")], "trace_id string, fired array<string>, risk_level string")
    got = records.top_rules(d, spark.createDataFrame([("a", "low"), ("b", "high")], "rule_id string, rule_level string")).collect()
    assert [(r.rule_id, r.n_fired, r.n_traces, r.n_low) for r in got] == [("b", 1, 1, 0), ("a", 2, 1, 1), ("z", 1, 1, 1)]
    assert {(r.risk_level, r.n, r.percent) for r in records.shares(d, "risk_level").collect()} == {("high", 1, 25.0), ("low", 2, 50.0), ("none", 1, 25.0)}
    assert records.shares(d.limit(0), "risk_level").count() == 0
    ev = records.fingerprint(spark.createDataFrame([("k", 1, None), ("l", 1, "x"), ("m", None, "x")], "id string, a int, b string"), ["a", "b"])
    old = ev.where("id <> 'm'").withColumn("version", F.lit(1)).unionByName(ev.where("id = 'l'").withColumn("fingerprint", F.lit("older")).withColumn("version", F.lit(0)))
    assert [r.id for r in records.to_evaluate(ev, old, "id").collect()] == ["m"] and ev.select("fingerprint").distinct().count() == 3


def test_messages_and_calls_nobody_saw(spark):
    import json

    from spanloom.operators import identity

    doc = json.dumps({"openinference.span.kind": "LLM", "llm.input_messages.0.message.role": "user", "llm.input_messages.0.message.content": "hi", "llm.output_messages": [{"message.role": "assistant", "message.tool_calls": [{"tool_call.function.name": "seen"}, {"tool_call.function.name": "unseen"}]}]})
    df = span(spark, [("a", "1", None, 1, doc, "s", None, True), ("a", "2", "1", 2, json.dumps({"openinference.span.kind": "TOOL", "tool.name": "seen"}), "s", None, True)])
    assert {(r.side, r.position, r.role, r.content, r.n_tool_calls) for r in identity.messages(df).collect()} == {("input", 0, "user", "hi", 0), ("output", 0, "assistant", None, 2)}
    assert [(r.tool, r.n_asked, r.n_seen) for r in identity.inferred_tool_calls(df).collect()] == [("unseen", 1, 0)]


def test_bodies_that_cannot_be_read(spark):
    legs = spark.createDataFrame([("x",), ("x...[truncated]",), (None,)], "body string")
    assert [r.unread for r in interactions.unread_bodies(legs).collect()] == [None, "truncated", "not captured"]


def test_tunnels(spark):
    from spanloom.operators import identity

    ask = side("request", "outbound", "http", "b1", "m", **{"http.method": "CONNECT"})
    rows = [("t", "b1", None, 1, ask, "s", "CLIENT", True), ("t", "b2", "b1", 2, side("response", "outbound", "http", "b1", "m"), "s", "CLIENT", True), ("u", "b1", None, 1, ask, "s", "CLIENT", True), ("u", "b3", "b1", 2, None, "s", None, True), ("v", "c1", None, 1, side("request", "outbound", "http", "c1", "m", **{"http.method": "GET"}), "s", "CLIENT", True)]
    assert [tuple(r) for r in identity.tunnel_traces(span(spark, rows)).collect()] == [("t", 2)]


def test_stack_pairs_are_those_of_a_stack(spark):
    import random

    r = random.Random(5)
    rows = [(f"k{r.randrange(4)}", n, r.random() < 0.5) for n in range(300)] + [(None, 301, True), (None, 302, False), ("z", 303, False)]
    want, stacks = set(), {}
    for k, n, opens in rows:
        if opens:
            stacks.setdefault(k, []).append(n)
        elif stacks.get(k):
            want.add((n, stacks[k].pop()))
    df = spark.createDataFrame(rows, "k string, n int, opens boolean")
    got = {(x.n, x.opened_by) for x in graphs.stack_pairs(df, ["k"], "n", F.col("opens")).collect()}
    assert got == want and graphs.stack_pairs(df.limit(0), ["k"], "n", F.col("opens")).count() == 0


def test_ordinals_of_a_deep_and_a_wide_tree(spark):
    from spanloom.operators.hierarchy import ordinals

    rows = [("t", "r", None, 1), ("t", "b", "r", 3), ("t", "a", "r", 2), ("t", "c", "a", None), ("t", "o", "gone", 0), ("t", "x", "x", 1), ("u", "r", None, 5)]
    got = {(x.t, x.s): (x.opening, x.closing) for x in ordinals(spark.createDataFrame(rows, "t string, s string, p string, at int"), ["at"], "t", "s", "p").collect()}
    assert got == {("t", "o"): (1, 2), ("t", "r"): (3, 10), ("t", "a"): (4, 7), ("t", "c"): (5, 6), ("t", "b"): (8, 9), ("u", "r"): (1, 2)}


def test_cursors_filters_and_pages(spark):
    from spanloom.operators import reads
    from spanloom.plans.feeds import page_limit, span_filter

    token = reads.encode_cursor(20, "newest")
    assert reads.decode_cursor(token, "newest") == 20
    for bad, order in ((token, "oldest"), ("!!", "newest"), ("", "newest"), (reads.encode_cursor(-1, "newest"), "newest")):
        with pytest.raises(reads.StaleCursor):
            reads.decode_cursor(bad, order)
    df = spark.createDataFrame([(n, n % 3) for n in range(10)], "seq int, a int")
    first, token = reads.offset_page(df, [F.col("seq")], "s", None, 4)
    second, _ = reads.offset_page(df, [F.col("seq")], "s", token, 4)
    assert [r.seq for r in first.collect()] == [0, 1, 2, 3] and [r.seq for r in second.collect()] == [4, 5, 6, 7]
    assert sorted(r.seq for r in df.where(reads.after_seq(df, 4, [("a", "asc"), ("seq", "desc")])).collect()) == [1, 2, 5, 8]
    with pytest.raises(reads.StaleCursor):
        reads.after_seq(df, 99, [("a", "asc")])
    with pytest.raises(ValueError):
        span_filter(seq_after=1, seq_before=2)
    with pytest.raises(ValueError):
        span_filter(span_id="x")
    with pytest.raises(ValueError):
        span_filter(colour="x")
    assert page_limit(5000) == 1000 and page_limit(3) == 3
    with pytest.raises(ValueError):
        page_limit(0)


def test_digests_change_with_any_leg(spark):
    from spanloom.operators import reads

    i = spark.createDataFrame([("1", "t"), ("2", "t"), ("3", "u")], "id string, trace_id string")
    leg = lambda i, k, seq, h: (i, k, h, None, seq)
    schema = "interaction_id string, leg_type string, payload_hash string, error boolean, seq long"
    make = lambda rows: {r.trace_id: r.digest for r in reads.ordered_digests(spark.createDataFrame(rows, schema).withColumn("occurred_at", F.lit(None).cast("timestamp")), i).collect()}
    rows = [leg("1", "request", 1, "a"), leg("1", "response", 2, None), leg("2", "request", 3, "b"), leg("3", "request", 4, "c")]
    base = make(rows)
    assert make(rows[::-1]) == base
    changed = make([leg("1", "request", 1, "a"), leg("1", "response", 2, "x"), leg("2", "request", 3, "b"), leg("3", "request", 4, "c")])
    assert changed["t"] != base["t"] and changed["u"] == base["u"]
    assert make([leg("1", "request", 3, "a"), leg("1", "response", 2, None), leg("2", "request", 1, "b"), leg("3", "request", 4, "c")])["t"] != base["t"]
