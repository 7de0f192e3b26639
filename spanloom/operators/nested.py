"""Nested records to related flat tables by Dewey labels.

Every object that is an element of an array gets a label, the path of keys and positions that leads to it, e.g.
``attributes.llm.input_messages.0.message.tool_calls.2``. With the label comes the length of the label of the nearest
element above: cutting the label there gives the parent, so no join ever looks for one. The label with its positions
blanked (``*``) is the schema path; all nodes of one schema path make one flat table.

Three notations give the same labels: real arrays, dotted keys with positions (``a.0.b``), and JSON inside strings at
any depth.

Defined cases: a document that is null, empty or not valid JSON has no elements; NaN and Infinity are not JSON; nulls
and scalars in arrays take a position but are no elements; an array inside an array is no element, its objects are;
two notations of one element give one row; documents nested too deeply for the library's recursive parser are read by
one with a stack of its own. Rows with a null key keep it. Repeated input rows give repeated nodes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents kept per worker with their nodes, as resource attributes repeat; older ones are forgotten, never skipped.
CACHED_DOCUMENTS = 20_000

_POSITION = re.compile(r"(?:^|\.)[0-9]+(?=\.|$)")
_OPENERS = frozenset("[{ \t\n\r")


def _no_constant(name: str):
    raise ValueError(name)


_read = json.JSONDecoder(parse_constant=_no_constant, parse_int=lambda s: s, parse_float=lambda s: s).decode
_read_values = json.JSONDecoder(parse_constant=_no_constant).decode


_SPACE = re.compile(r"[ \t\n\r]*")


def read_deep(text: str, read=None):
    """Reads JSON of any depth: containers are built on a stack, scalars and keys are left to the library."""
    scan = json.JSONDecoder(parse_constant=_no_constant, **({"parse_int": str, "parse_float": str} if read is _read else {})).raw_decode
    open_: list[tuple[dict | list, str | None]] = []
    skip = lambda at: _SPACE.match(text, at).end()
    at, value, have = skip(0), None, False

    def key(at: int) -> tuple[str, int]:
        k, at = scan(text, at)
        at = skip(at)
        if not isinstance(k, str) or text[at : at + 1] != ":":
            raise ValueError("key")
        return k, skip(at + 1)

    while True:
        if not have:
            c = text[at : at + 1]
            if c in ("{", "["):
                at, box = skip(at + 1), {} if c == "{" else []
                if text[at : at + 1] == ("}" if c == "{" else "]"):
                    value, have, at = box, True, at + 1
                else:
                    k = None
                    if c == "{":
                        k, at = key(at)
                    open_.append((box, k))
                continue
            value, at = scan(text, at)
            have = True
        at = skip(at)
        if not open_:
            if at != len(text):
                raise ValueError("text after the document")
            return value
        box, k = open_[-1]
        if isinstance(box, dict):
            box[k] = value
        else:
            box.append(value)
        c = text[at : at + 1]
        if c == ",":
            at, have = skip(at + 1), False
            if isinstance(box, dict):
                k, at = key(at)
                open_[-1] = (box, k)
        elif c == ("}" if isinstance(box, dict) else "]"):
            open_.pop()
            value, at = box, at + 1
        else:
            raise ValueError("neither comma nor end")


def _container(text: str, read) -> dict | list | None:
    if text[:1] not in _OPENERS:
        return None
    try:
        v = read(text)
    except ValueError:
        return None
    except RecursionError:
        try:
            v = read_deep(text, read)
        except ValueError:
            return None
    return v if isinstance(v, (dict, list)) else None


_keys: dict[str, tuple[tuple[int, ...], bool]] = {}


def _positions(key: str) -> tuple[tuple[int, ...], bool]:
    """Ends of the inner position segments of a dotted key, and whether its last segment is a position."""
    found = _keys.get(key)
    if found is None:
        if len(_keys) > 100_000:
            _keys.clear()
        ends = [m.end() for m in _POSITION.finditer(key)] if "." in key else []
        last = bool(ends) and ends[-1] == len(key)
        found = _keys[key] = (tuple(ends[: len(ends) - last]), last)
    return found


def elements(doc: str | None, fields: bool = False) -> list[tuple[str, int, dict | None]]:
    """The elements of one document: label (from the document's root, with a leading dot), length of the parent's label
    (0: none), and with ``fields`` the scalars that belong to the element, by the rest of their path. The root, with
    label '', comes first when ``fields`` is set."""
    read = _read_values if fields else _read
    top = _container(doc, read) if doc else None
    if top is None:
        return []
    out: dict[str, tuple[int, dict | None]] = {"": (0, {})} if fields else {}
    stack: list[tuple[object, str, int, bool]] = [(top, "", 0, False)]
    while stack:
        v, path, cut, is_element = stack.pop()
        if isinstance(v, str) and v[:1] in _OPENERS and (inner := _container(v, read)) is not None:
            v = inner
        if isinstance(v, dict):
            if is_element:
                out.setdefault(path, (cut, {} if fields else None))
                cut = len(path)
            for k, x in v.items():
                ends, last = _positions(k)
                c = cut
                for e in ends:
                    p = f"{path}.{k[:e]}"
                    out.setdefault(p, (c, {} if fields else None))
                    c = len(p)
                if fields or last or isinstance(x, (dict, list)) or (isinstance(x, str) and x[:1] in _OPENERS):
                    stack.append((x, f"{path}.{k}", c, last))
        elif isinstance(v, list):
            for i, x in enumerate(v):
                if fields or isinstance(x, (dict, list)) or (isinstance(x, str) and x[:1] in _OPENERS):
                    stack.append((x, f"{path}.{i}", cut, True))
        elif fields:
            out[path[:cut]][1][path[cut + 1 :]] = v
    return [(p, c, f) for p, (c, f) in out.items()]


def _clean(texts: list[str]) -> pa.Array:
    try:
        return pa.array(texts, pa.string())
    except UnicodeEncodeError:  # a lone surrogate in a key
        return pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string())


def flatten(df: DataFrame, key: str, json_columns: list[str], array_columns: list[str], fields: bool = False, struct_keys: bool = False) -> DataFrame:
    """Node table of ``df``: ``key``, ``path``, ``parent_path`` ('' at the top), with ``fields`` also ``schema_path`` and
    ``fields`` (JSON of the element's scalars).

    ``json_columns`` hold JSON documents; ``array_columns`` are arrays of structs: each of their non-null structs is an
    element itself. With ``struct_keys`` all fields of the struct are keys of the element, null ones left out, and a string
    that holds JSON is read, so its elements are ``events.0.attributes.f.0``: a label names every key that leads to an
    element, and a key of attributes can't meet a field of the struct by the same name. Without, only the struct's
    ``attributes`` is read, as if it were the struct (``events.0.f.0``). One pass over the scan, no shuffle, memory of one batch.
    """
    json_columns, array_columns = list(json_columns), list(array_columns)
    docs = [F.col(c).cast("string").alias(f"j{i}") for i, c in enumerate(json_columns)]
    own = (lambda e: F.to_json(e)) if struct_keys else (lambda e: F.coalesce(e["attributes"].cast("string"), F.lit("")))
    docs += [F.transform(c, lambda e: F.when(e.isNotNull(), own(e))).alias(f"a{i}") for i, c in enumerate(array_columns)]
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list] = {}

        def nodes(doc):
            if not doc:
                return ()
            found = cache.get(doc)
            if found is None:
                if len(cache) > CACHED_DOCUMENTS:
                    cache.clear()
                found = cache[doc] = elements(doc, fields)
            return found

        def emit(keys, rows, paths, cuts, values):
            cols = [keys.take(pa.array(rows, pa.int64())), _clean(paths), pa.array(cuts, pa.int32())]
            names = ["k", "path", "cut"]
            if fields:
                cols.append(_clean([json.dumps(v, ensure_ascii=False) for v in values]))
                names.append("fields")
            return pa.RecordBatch.from_arrays(cols, names=names)

        for b in batches:
            keys = b.column(0)
            rows: list[int] = []
            paths: list[str] = []
            cuts: list[int] = []
            values: list[dict | None] = []

            def add(r, base, base_cut, found):
                for p, c, f in found:
                    if not p:
                        if base == "" or f:
                            rows.append(r), paths.append(base), cuts.append(base_cut), values.append(f)
                        continue
                    rows.append(r)
                    paths.append(base + p)
                    cuts.append(len(base) + c if c else base_cut)
                    values.append(f)

            for i, name in enumerate(json_columns):
                for r, doc in enumerate(b.column(1 + i).to_pylist()):
                    found = nodes(doc)
                    if found:
                        add(r, name, 0, found)
            for i, name in enumerate(array_columns):
                for r, docs_ in enumerate(b.column(1 + len(json_columns) + i).to_pylist()):
                    for n, doc in enumerate(docs_ or ()):
                        if doc is None:
                            continue
                        base = f"{name}.{n}"
                        found = nodes(doc)
                        if not fields:
                            rows.append(r), paths.append(base), cuts.append(0), values.append(None)
                        add(r, base, len(base), [(p, c, f) for p, c, f in found if p])
                        if fields:
                            own = next((f for p, _, f in found if not p), {})
                            rows.append(r), paths.append(base), cuts.append(0), values.append(own)
            for s in range(0, len(rows), 50_000):
                e = s + 50_000
                yield emit(keys, rows[s:e], paths[s:e], cuts[s:e], values[s:e])

    schema = f"k {kind.simpleString()}, path string, cut int" + ", fields string" * fields
    found = df.select(F.col(key).alias("k"), *docs).mapInArrow(run, schema)
    out = [F.col("k").alias(key), parent_path(F.col("path"), F.col("cut")).alias("parent_path"), "path"]
    if fields:
        out += [schema_path(F.col("path")).alias("schema_path"), "fields"]
    return found.select(*out)


def parent_path(path: Column, cut: Column) -> Column:
    """The parent's label: the node's own, cut off."""
    return path.substr(F.lit(1), cut)


def schema_path(path: Column) -> Column:
    """The label with its positions blanked: the name of the table the node belongs to."""
    return F.regexp_replace(path, r"\.[0-9]+(?=\.|$)", ".*")


def child_table(nodes: DataFrame, key: str, schema: str, columns: dict[str, str]) -> DataFrame:
    """The flat table of one schema path: key, parent_path, path, position, and the named fields (name -> Spark type)."""
    one = nodes.where(F.col("schema_path") == schema)
    got = [F.get_json_object("fields", f"$['{name}']").try_cast(kind).alias(name) for name, kind in columns.items()]
    return one.select(key, "parent_path", "path", F.regexp_extract("path", r"\.([0-9]+)$", 1).try_cast("int").alias("position"), *got)


def table_report(nodes: DataFrame) -> DataFrame:
    """One row per flat table: rows, rows with a parent element, deepest and mean number of fields."""
    n = F.size(F.json_object_keys("fields"))
    return nodes.groupBy("schema_path").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("parent_path") != "").alias("n_with_parent"), F.max(n).alias("max_fields"), F.sum(n).alias("n_values")
    )
