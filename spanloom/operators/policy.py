"""Declarative rules compiled to columns, and how rules that fire are combined.

A rule is a mapping: ``id``, ``risk_level``, ``enforcement``, ``explanation``, ``confidence`` and ``when``, conditions on one
flow of an event. A flow is a struct; a rule fires if one flow meets all its conditions. Conditions: a scalar (equality), a
list (all must be among the field's values), or for an array of structs a list of conditions, each met by some element.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.vocab import ENFORCEMENT_ORDER, RISK_ORDER, rank


class UnsupportedRule(ValueError):
    """A rule names a field the flow doesn't have, or a condition its type can't meet."""


def _clause(value: Column, kind: T.DataType, want, where: str) -> Column:
    if isinstance(kind, T.StructType):
        if not isinstance(want, Mapping):
            raise UnsupportedRule(f"{where}: a record needs named conditions")
        unknown = set(want) - set(kind.names)
        if unknown:
            raise UnsupportedRule(f"{where}: no field {sorted(unknown)[0]}")
        parts = [_clause(value[name], kind[name].dataType, w, f"{where}.{name}") for name, w in want.items()]
        return reduce(Column.__and__, parts, F.lit(True))
    if isinstance(kind, T.ArrayType):
        wants = want if isinstance(want, Sequence) and not isinstance(want, str) else [want]
        if isinstance(kind.elementType, T.StructType):
            item = lambda w: lambda x: _clause(x, kind.elementType, w, f"{where}[]")
            parts = [F.exists(value, item(w)) for w in wants]
            return reduce(Column.__and__, parts, F.lit(True))
        return F.size(F.array_except(F.array(*map(F.lit, wants)), value)) == 0
    if isinstance(want, Mapping) or (isinstance(want, Sequence) and not isinstance(want, str)):
        raise UnsupportedRule(f"{where}: a single value needs a single condition")
    return value == F.lit(want)


def compile_rule(rule: Mapping, flows: Column, kind: T.ArrayType) -> Column:
    """Whether the rule fires. A rule without conditions always does."""
    when = rule.get("when") or {}
    if not when:
        return F.lit(True)
    return F.coalesce(F.exists(flows, lambda f: F.coalesce(_clause(f, kind.elementType, when, rule["id"]), F.lit(False))), F.lit(False))


def evaluate(events: DataFrame, rules: Sequence[Mapping], flows: str = "flows", mode: str = "most_restrictive", fallback: str = "allow") -> DataFrame:
    """``events`` with fired (sorted ids), risk_level, enforcement, explanation, confidence.

    most_restrictive: the level comes from the worst rule, enforcement and confidence from the strictest, ties by id; two
    winners' explanations are joined. first_fires: the first rule of the list decides. Nothing fired: none, the fallback,
    confidence 1.
    """
    kind = events.schema[flows].dataType
    body = [F.when(compile_rule(r, F.col(flows), kind), F.struct(F.lit(r["id"]).alias("id"), F.lit(i).alias("at"), F.lit(r["risk_level"]).alias("risk_level"), F.lit(r["enforcement"]).alias("enforcement"), F.lit(r.get("explanation", "")).alias("explanation"), F.lit(float(r.get("confidence", 1.0))).alias("confidence"))) for i, r in enumerate(rules)]
    empty = F.array().cast("array<struct<id:string,at:int,risk_level:string,enforcement:string,explanation:string,confidence:double>>")
    out = events.withColumn("_f", F.filter(F.array(*body), lambda x: x.isNotNull()) if body else empty)
    if mode == "first_fires":
        risk = force = lambda x: F.struct(x["at"].alias("a"), x["id"].alias("b"))
    elif mode == "most_restrictive":
        risk = lambda x: F.struct(rank(x["risk_level"], RISK_ORDER).alias("a"), x["id"].alias("b"))
        force = lambda x: F.struct(rank(x["enforcement"], ENFORCEMENT_ORDER).alias("a"), x["id"].alias("b"))
    else:
        raise UnsupportedRule(f"unknown mode {mode}")
    best = lambda key: F.array_min(F.transform("_f", lambda x: F.struct(key(x).alias("k"), x.alias("r"))))["r"]
    out = out.withColumn("_r", best(risk)).withColumn("_e", best(force))
    none = F.size("_f") == 0
    same = F.col("_r.id") == F.col("_e.id")
    return out.withColumns({
        "fired": F.array_sort(F.transform("_f", lambda x: x["id"])), "risk_level": F.when(none, "none").otherwise(F.col("_r.risk_level")), "enforcement": F.when(none, fallback).otherwise(F.col("_e.enforcement")),
        "explanation": F.when(none, "").when(same, F.col("_r.explanation")).otherwise(F.concat_ws("; ", "_r.explanation", "_e.explanation")), "confidence": F.when(none, F.lit(1.0)).otherwise(F.col("_e.confidence")),
    }).drop("_f", "_r", "_e")


