"""Identifiers: normal form, deterministic uuid5, canonical JSON digests."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The name spaces of the deterministic ids of entities, interactions and label edges.
ENTITY_NAMESPACE = "6f8d1c2e-0a3b-4d5e-8f90-1a2b3c4d5e6f"
INTERACTION_NAMESPACE = "9c7e2b4a-1d6f-4a8b-9c0d-2e3f4a5b6c7d"
LABEL_NAMESPACE = "2472ae9a-b655-531d-a17a-b966d624ad0d"


def normal_id(col: Column | str) -> Column:
    """Lower-case hex without separators or ``0x``; null and ids without any character give null."""
    c = F.col(col) if isinstance(col, str) else col
    bare = F.lower(F.translate(c, "-_:. \t{}", ""))
    bare = F.when(bare.startswith("0x"), F.substring(bare, 3, 1 << 30)).otherwise(bare)
    return F.nullif(bare, F.lit(""))


def uuid5(namespace: str):
    """A function from names to version 5 uuids, of built-in functions only; null stays null."""
    space = F.unhex(F.lit(namespace.replace("-", "")))

    def make(name: Column | str) -> Column:
        h = F.sha1(F.concat(space, (F.col(name) if isinstance(name, str) else name).cast("binary")))
        part = lambda at, n: F.substring(h, at, n)
        # the version is 5; the two top bits of the variant digit are 10
        return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab"), part(18, 3)), F.when(h.isNotNull(), part(21, 12)))

    return lambda name: F.when((F.col(name) if isinstance(name, str) else name).isNotNull(), make(name))


def canonical_json(value) -> str:
    """Sorted keys, ``", "`` and ``": "`` between parts, ASCII escapes: the form that is hashed."""
    return json.dumps(value, sort_keys=True)


def payload_digest(raw: Column) -> Column:
    """sha256 of the canonical JSON of a value given as JSON text; text that is no JSON is hashed as a string."""

    def one(text: str) -> str:
        try:
            v = json.loads(text)
        except ValueError:
            v = text
        return hashlib.sha256(canonical_json(v).encode()).hexdigest()

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action="ignore")

    return F.pandas_udf(run, "string")(raw)
