"""Queries of the general problems (1, 2, 3, 5) over the spans table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import hierarchy, nested, redelivery, slicing
from spanloom.sources.tables import table

JSON_COLUMNS, ARRAY_COLUMNS = ["attributes", "resource_attributes"], ["events", "links"]


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return nested.flatten(table(spark, base, "spans"), "arrival_seq", JSON_COLUMNS, ARRAY_COLUMNS, struct_keys=True).select("arrival_seq", "parent_path", "path")


def p1_tables(spark: SparkSession, base: str) -> DataFrame:
    return nested.table_report(nested.flatten(table(spark, base, "spans"), "arrival_seq", JSON_COLUMNS, ARRAY_COLUMNS, fields=True, struct_keys=True))


def p1_tool_calls(spark: SparkSession, base: str) -> DataFrame:
    nodes = nested.flatten(table(spark, base, "spans"), "arrival_seq", ["attributes"], [], fields=True)
    return nested.child_table(nodes, "arrival_seq", "attributes.llm.output_messages.*.message.tool_calls.*", {"tool_call.id": "string", "tool_call.function.name": "string"}).select(
        "arrival_seq", "parent_path", "path", "position", F.col("`tool_call.id`").alias("call_id"), F.col("`tool_call.function.name`").alias("function_name")
    )


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return hierarchy.hierarchy(table(spark, base, "spans")).select("trace_id", "span_id", "root_span_id", "depth")


def p2_paths(spark: SparkSession, base: str) -> DataFrame:
    paths = hierarchy.full_paths(table(spark, base, "spans"))
    return paths.select("trace_id", "span_id", "depth", F.concat_ws("/", "path").alias("path"))


def p2_subtrees(spark: SparkSession, base: str) -> DataFrame:
    return hierarchy.subtree_sizes(table(spark, base, "spans"))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return redelivery.redelivered(table(spark, base, "spans"))


def p3_kept(spark: SparkSession, base: str) -> DataFrame:
    return redelivery.deduplicate(table(spark, base, "spans")).select("arrival_seq", "batch_id", "name")


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return slicing.assign_panes(table(spark, base, "spans")).where("late").select(F.col("pane_start").alias("period_start"), "arrival_seq")


def p5_periods(spark: SparkSession, base: str) -> DataFrame:
    return slicing.pane_counts(slicing.assign_panes(table(spark, base, "spans"))).withColumnRenamed("pane_start", "period_start")


def p5_revisions(spark: SparkSession, base: str) -> DataFrame:
    return slicing.revisions(slicing.assign_panes(table(spark, base, "spans")))


QUERIES = {f.__name__: f for f in (p1_found, p1_tables, p1_tool_calls, p2_found, p2_paths, p2_subtrees, p3_found, p3_kept, p5_found, p5_periods, p5_revisions)}

_NORMAL = "nullif(regexp_replace(lower({0}), '[^0-9a-f]', '', 'g'), '')"
_NODES = f"""
    ids AS (SELECT {_NORMAL.format('trace_id')} AS t, {_NORMAL.format('span_id')} AS s, {_NORMAL.format('parent_id')} AS p, arrival_seq FROM spans),
    firsts AS (SELECT t, s, p FROM (SELECT *, row_number() OVER (PARTITION BY t, s ORDER BY arrival_seq) AS n FROM ids) WHERE n = 1),
    tree AS (SELECT a.t, a.s, b.s AS p FROM firsts a LEFT JOIN firsts b ON a.t = b.t AND a.p = b.s)
"""
_WALK = """
    walk AS (
        SELECT t, s, s AS cur, p AS up, 0 AS d, [s] AS seen FROM tree
        UNION ALL
        SELECT w.t, w.s, x.s, x.p, w.d + 1, list_append(w.seen, x.s) FROM walk w JOIN tree x ON x.t = w.t AND x.s = w.up WHERE NOT list_contains(w.seen, w.up)
    ),
    ends AS (SELECT t, s, cur, up, d, seen FROM walk WHERE up IS NULL OR list_contains(seen, up))
"""
WALK_SQL = _WALK.replace("ends AS", "ends_of_walk AS")
_CLOCK = """
    clock AS (
        SELECT arrival_seq, epoch_us(started_at) // 3600000000 * 3600 AS period_start,
               epoch_us(max(observed_at) OVER (ORDER BY arrival_seq)) AS clock_us
        FROM spans WHERE started_at IS NOT NULL
    ),
    panes AS (SELECT *, coalesce(clock_us >= (period_start + 25200) * 1000000, false) AS late FROM clock)
"""

# Elements are collected from a walk over all values; the parent is then looked for among an element's own prefixes.
_ELEMENTS_OF = """
    docs AS (
        SELECT arrival_seq, 'attributes' AS path, CASE WHEN json_valid(attributes) THEN attributes::JSON END AS v, false AS el FROM spans
        UNION ALL SELECT arrival_seq, 'resource_attributes', CASE WHEN json_valid(resource_attributes) THEN resource_attributes::JSON END, false FROM spans
        UNION ALL SELECT arrival_seq, 'events.' || (i - 1), to_json(events[i]), true FROM (SELECT arrival_seq, events, unnest(generate_series(1, len(events))) AS i FROM spans) WHERE events[i] IS NOT NULL
        UNION ALL SELECT arrival_seq, 'links.' || (i - 1), to_json(links[i]), true FROM (SELECT arrival_seq, links, unnest(generate_series(1, len(links))) AS i FROM spans) WHERE links[i] IS NOT NULL
    ),
    walk AS (
        SELECT arrival_seq, CAST(NULL AS VARCHAR) AS base, CAST(NULL AS VARCHAR) AS key, path, v, el, NULL::JSON AS leaf FROM docs WHERE v IS NOT NULL AND json_type(v) IN ('OBJECT', 'ARRAY')
        UNION ALL
        SELECT arrival_seq, base, key, path, v, el, leaf FROM (
            SELECT w.arrival_seq, w.path AS base, CASE WHEN json_type(w.v) = 'OBJECT' THEN e.key END AS key, w.path || '.' || e.key AS path, e.value AS leaf,
                   CASE WHEN e.type = 'VARCHAR' THEN CASE WHEN json_valid(e.value ->> '$') THEN (e.value ->> '$')::JSON END ELSE e.value::JSON END AS v,
                   json_type(w.v) = 'ARRAY' OR regexp_matches(e.key, '\\.[0-9]+$') AS el
            FROM walk w, json_each(CASE WHEN json_type(w.v) IN ('OBJECT', 'ARRAY') THEN w.v END) e
        ) {which}
    ),
    dotted AS (SELECT DISTINCT arrival_seq, base, string_split(key, '.') AS seg FROM walk WHERE regexp_matches(key, '(^|\\.)[0-9]+\\.')),
    elements AS (
        SELECT arrival_seq, path FROM walk WHERE el AND v IS NOT NULL AND json_type(v) = 'OBJECT'
        UNION SELECT arrival_seq, base || '.' || array_to_string(seg[:n], '.') FROM (SELECT arrival_seq, base, seg, unnest(generate_series(1, len(seg) - 1)) AS n FROM dotted) WHERE regexp_full_match(seg[n], '[0-9]+')
    ),
    above AS (
        SELECT e.arrival_seq, e.path, max(len(u.path)) AS cut FROM (SELECT arrival_seq, path, string_split(path, '.') AS seg, unnest(generate_series(1, len(string_split(path, '.')) - 1)) AS n FROM elements) e
        JOIN elements u ON u.arrival_seq = e.arrival_seq AND u.path = array_to_string(e.seg[:e.n], '.') GROUP BY 1, 2
    )"""
_ELEMENTS = _ELEMENTS_OF.format(which="WHERE regexp_matches(key, '(^|\\.)[0-9]+\\.') OR (v IS NOT NULL AND json_type(v) IN ('OBJECT', 'ARRAY'))")
VALUES_SQL = _ELEMENTS_OF.format(which="") + """,
    roots AS (SELECT arrival_seq, path FROM docs WHERE v IS NOT NULL AND json_type(v) IN ('OBJECT', 'ARRAY') UNION SELECT arrival_seq, path FROM elements),
    leaves AS (
        SELECT DISTINCT w.arrival_seq, w.path, last(w.leaf) AS leaf FROM walk w LEFT JOIN docs d ON d.arrival_seq = w.arrival_seq AND d.path = w.base
        WHERE w.base IS NOT NULL AND (w.v IS NULL OR json_type(w.v) NOT IN ('OBJECT', 'ARRAY')) AND NOT (coalesce(d.el, false) AND json_type(w.leaf) = 'NULL') GROUP BY 1, 2
    ),
    owned AS (
        SELECT l.arrival_seq, l.path, any_value(l.leaf) AS leaf, max(len(u.path)) AS cut
        FROM (SELECT arrival_seq, path, leaf, string_split(path, '.') AS seg, unnest(generate_series(1, len(string_split(path, '.')) - 1)) AS n FROM leaves) l
        JOIN roots u ON u.arrival_seq = l.arrival_seq AND u.path = array_to_string(l.seg[:l.n], '.') GROUP BY 1, 2
    ),
    fields AS (SELECT arrival_seq, path[:cut] AS path, path[cut + 2:] AS field, leaf FROM owned)"""

SQL = {
    "p1_found": f"""WITH RECURSIVE {_ELEMENTS}
        SELECT e.arrival_seq, coalesce(e.path[:a.cut], '') AS parent_path, e.path FROM elements e LEFT JOIN above a ON a.arrival_seq = e.arrival_seq AND a.path = e.path""",
    "p1_tables": f"""WITH RECURSIVE {VALUES_SQL},
        nodes AS (
            SELECT r.arrival_seq, r.path, e.path IS NOT NULL AS el, a.cut IS NOT NULL AS has_parent, (SELECT count(*) FROM fields f WHERE f.arrival_seq = r.arrival_seq AND f.path = r.path) AS n_fields
            FROM roots r LEFT JOIN elements e USING (arrival_seq, path) LEFT JOIN above a USING (arrival_seq, path))
        SELECT array_to_string(list_transform(string_split(path, '.'), lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN '*' ELSE x END), '.') AS schema_path,
               count(*) AS n_rows, count(*) FILTER (has_parent) AS n_with_parent, CAST(max(n_fields) AS INTEGER) AS max_fields, CAST(sum(n_fields) AS BIGINT) AS n_values
        FROM nodes WHERE el OR n_fields > 0 GROUP BY 1""",
    "p1_tool_calls": f"""WITH RECURSIVE {VALUES_SQL},
        calls AS (SELECT arrival_seq, path FROM elements WHERE regexp_full_match(path, 'attributes\\.llm\\.output_messages\\.[0-9]+\\.message\\.tool_calls\\.[0-9]+'))
        SELECT c.arrival_seq, coalesce(c.path[:a.cut], '') AS parent_path, c.path, CAST(string_split(c.path, '.')[-1] AS INTEGER) AS position, i.leaf ->> '$' AS call_id, f.leaf ->> '$' AS function_name
        FROM calls c LEFT JOIN above a USING (arrival_seq, path) LEFT JOIN fields i ON i.arrival_seq = c.arrival_seq AND i.path = c.path AND i.field = 'tool_call.id'
        LEFT JOIN fields f ON f.arrival_seq = c.arrival_seq AND f.path = c.path AND f.field = 'tool_call.function.name'""",
    "p2_found": f"""WITH RECURSIVE {_NODES}, {_WALK}
        SELECT t AS trace_id, s AS span_id,
               CASE WHEN up IS NULL THEN cur ELSE list_min(seen[list_position(seen, up):]) END AS root_span_id,
               CASE WHEN up IS NULL THEN d WHEN list_position(seen, up) = 1 THEN -1 ELSE -2 END AS depth
        FROM ends""",
    "p2_paths": f"""WITH RECURSIVE {_NODES}, {_WALK}
        SELECT t AS trace_id, s AS span_id, d AS depth, array_to_string(list_reverse(seen), '/') AS path FROM ends WHERE up IS NULL""",
    "p2_subtrees": f"""WITH RECURSIVE {_NODES}, {_WALK},
        good AS (SELECT t, s, seen FROM ends WHERE up IS NULL),
        below AS (SELECT t, u AS s, count(*) AS n FROM (SELECT t, unnest(seen[2:]) AS u FROM good) GROUP BY t, u)
        SELECT g.t AS trace_id, g.s AS span_id, coalesce(n, 0) AS n_descendants FROM good g LEFT JOIN below b ON g.t = b.t AND g.s = b.s""",
    "p3_found": f"""WITH {_NODES.split('firsts AS')[0].rstrip().rstrip(',')}
        SELECT arrival_seq FROM (SELECT arrival_seq, row_number() OVER (PARTITION BY t, s ORDER BY arrival_seq) AS n FROM ids) WHERE n > 1""",
    "p3_kept": f"""WITH {_NODES.split('firsts AS')[0].rstrip().rstrip(',')},
        kept AS (SELECT arrival_seq FROM (SELECT arrival_seq, row_number() OVER (PARTITION BY t, s ORDER BY arrival_seq) AS n FROM ids) WHERE n = 1)
        SELECT arrival_seq, batch_id, name FROM spans JOIN kept USING (arrival_seq)""",
    "p5_found": f"WITH {_CLOCK} SELECT period_start, arrival_seq FROM panes WHERE late",
    "p5_periods": f"""WITH {_CLOCK}
        SELECT period_start, count(*) FILTER (NOT late) AS n_rows,
               count(*) FILTER (NOT late AND clock_us >= (period_start + 3600) * 1000000) AS n_corrections, count(*) FILTER (late) AS n_past_cutoff
        FROM panes GROUP BY period_start""",
    "p5_revisions": f"""WITH {_CLOCK},
        moved AS (
            SELECT period_start - 3600 * k AS window_start, coalesce(clock_us // 3600000000, 0) AS tick, count(*) AS n
            FROM panes, (SELECT unnest([0, 1, 2]) AS k) WHERE NOT late GROUP BY 1, 2
        )
        SELECT window_start, tick, row_number() OVER (PARTITION BY window_start ORDER BY tick) AS version,
               CAST(sum(n) OVER (PARTITION BY window_start ORDER BY tick) AS BIGINT) AS n_rows
        FROM moved""",
}
