"""Exactly one copy of every message, by exact quotient hash tables.

An identifier of fixed width (16 + 8 bytes) is run through a permutation of all 192-bit values. The top 20 bits of the
image are the quotient, which names the shard; the other 172 bits are the remainder, which the shard's table stores
whole. As the map is one-to-one and nothing of the image is thrown away, two identifiers meet in a table exactly when
they are equal: there are no false matches.

Each input task first runs its own table, so that of a message delivered a billion times only one row per task crosses
the network under that message's shard; the copies it beats are spread by their own position. Each shard then inserts
what is left. A later insert of a known identifier gives back the loser of the two.

Defined cases: ids count in normal form; a row without one of its ids is never a copy of anything; ids of other widths
are kept apart by their whole text, in a table of their own kind; a row with a null order value cannot be named and
passes; among rows with equal order values one is kept. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.ids import normal_id

QUOTIENT_BITS = 20
#: Rows of one merging task, and identifiers after which a task starts a new table at the next shard.
TASK_ROWS, TABLE_IDS = 2_000_000, 1_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(words: np.ndarray) -> np.ndarray:
    """A permutation of the 192-bit values given as rows of three unsigned words: each step changes one word by a
    function of another, so every step can be undone."""
    w = words.copy()
    for _ in range(2):
        w[:, 0] ^= _mix(w[:, 1])
        w[:, 1] ^= _mix(w[:, 2])
        w[:, 2] ^= _mix(w[:, 0])
    w[:, 0] ^= _mix(w[:, 2] ^ w[:, 1])
    return w


def unpermute(words: np.ndarray) -> np.ndarray:
    w = words.copy()
    w[:, 0] ^= _mix(w[:, 2] ^ w[:, 1])
    for _ in range(2):
        w[:, 2] ^= _mix(w[:, 0])
        w[:, 1] ^= _mix(w[:, 2])
        w[:, 0] ^= _mix(w[:, 1])
    return w


class QuotientTable:
    """Open addressing over permuted identifiers; every slot holds the complete image and the lowest order value."""

    def __init__(self, capacity: int = 1 << 12):
        self.size = 0
        self._alloc(capacity)

    def _alloc(self, capacity: int) -> None:
        self.keys = np.zeros((capacity, 3), np.uint64)
        self.best = np.zeros(capacity, np.int64)
        self.full = np.zeros(capacity, bool)

    def insert(self, keys: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Inserts a batch; returns the order values of all copies that lost, from this batch or the table."""
        if not len(keys):
            return order
        rank = np.lexsort((order, keys[:, 2], keys[:, 1], keys[:, 0]))
        keys, order = keys[rank], order[rank]
        first = np.ones(len(keys), bool)
        first[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        lost = [order[~first]]
        keys, order = keys[first], order[first]
        if (self.size + len(keys)) * 2 > len(self.full):
            old_keys, old_best = self.keys[self.full], self.best[self.full]
            capacity = len(self.full)
            while (self.size + len(keys)) * 2 > capacity:
                capacity *= 2
            self._alloc(capacity)
            self._place(old_keys, old_best)
        lost.append(self._place(keys, order))
        return np.concatenate(lost)

    def _place(self, keys: np.ndarray, order: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.full) - 1)
        todo = np.arange(len(keys))
        slot = (keys[:, 0] ^ (keys[:, 1] << np.uint64(1))) & mask
        slot = slot.astype(np.int64)
        lost = []
        while len(todo):
            s = slot[todo]
            free = ~self.full[s]
            claim = todo[free]
            self.keys[s[free]] = keys[claim]  # of several that claim one slot the last stays
            self.best[s[free]] = order[claim]
            self.full[s[free]] = True
            same = (self.keys[s] == keys[todo]).all(axis=1)
            old = same & ~free
            i, at = todo[old], s[old]
            lost.append(np.maximum(self.best[at], order[i]))
            self.best[at] = np.minimum(self.best[at], order[i])
            self.size += int((same & free).sum())
            todo = todo[~same]
            slot[todo] = (slot[todo] + 1) & np.int64(mask)
        return np.concatenate(lost) if lost else np.zeros(0, np.int64)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        return self.keys[self.full], self.best[self.full]


def _words(col: pa.Array) -> np.ndarray:
    raw = np.frombuffer(col.buffers()[2], np.uint8, len(col) * 24, col.offset * 24) if len(col) else np.zeros(0, np.uint8)
    return raw.view(">u8").astype(np.uint64).reshape(-1, 3)


def _bytes(words: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(words.astype(">u8")).tobytes()
    offsets = np.arange(0, 24 * len(words) + 1, 24, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


_SCHEMA = "shard int, image binary, wide string, ord long"


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One input task: beaten copies go on without an identifier, the winners under their quotient."""
    table, wide = QuotientTable(), {}

    def losers(order: np.ndarray) -> pa.RecordBatch:
        n = len(order)
        return pa.RecordBatch.from_arrays([pa.array(order % (1 << QUOTIENT_BITS), pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.string()), pa.array(order, pa.int64())], names=["shard", "image", "wide", "ord"])

    for b in batches:
        order = b.column(2).to_numpy(zero_copy_only=False)
        regular = b.column(0).is_valid().to_numpy(zero_copy_only=False)
        ids = b.column(0).drop_null()
        lost = [table.insert(permute(_words(ids)), order[regular])]
        beaten = []
        texts = b.column(1)
        for i in np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False)):
            text, o = texts[i].as_py(), int(order[i])
            if text in wide:
                beaten.append(max(o, wide[text]))
            wide[text] = min(o, wide.get(text, o))
        lost.append(np.array(beaten, np.int64))
        lost = np.concatenate(lost)
        if len(lost):
            yield losers(lost)
    keys, best = table.items()
    for s in range(0, len(best), 100_000):
        k, o = keys[s : s + 100_000], best[s : s + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array((k[:, 0] >> np.uint64(64 - QUOTIENT_BITS)).astype(np.int32)), _bytes(k), pa.nulls(len(o), pa.string()), pa.array(o)], names=["shard", "image", "wide", "ord"])
    if wide:
        texts = list(wide)
        import xxhash

        shard = [xxhash.xxh64_intdigest(t) & ((1 << QUOTIENT_BITS) - 1) for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.nulls(len(texts), pa.binary()), pa.array(texts, pa.string()), pa.array([wide[t] for t in texts], pa.int64())], names=["shard", "image", "wide", "ord"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards in order: what was beaten before passes, the rest is inserted. A table is dropped where a shard ends, once it is
    large: it never holds more than one shard beyond ``TABLE_IDS``."""
    table, wide, last = QuotientTable(), {}, None
    for b in batches:
        shards = b.column(0).to_numpy(zero_copy_only=False)
        ends = np.flatnonzero(shards[1:] != shards[:-1]) + 1
        at = 0
        while at < len(b):
            if table.size + len(wide) >= TABLE_IDS and shards[at] != last:
                table, wide = QuotientTable(), {}
            # as far as the table may grow, up to the end of a shard
            i = np.searchsorted(ends, at + max(1, TABLE_IDS - table.size - len(wide)))
            stop = int(ends[i]) if i < len(ends) else len(b)
            out = _insert(table, wide, b.slice(at, stop - at))
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["ord"])
            last, at = shards[stop - 1], stop


def _insert(table: QuotientTable, wide: dict[str, int], b: pa.RecordBatch) -> np.ndarray:
    order = b.column(3).to_numpy(zero_copy_only=False)
    regular = b.column(1).is_valid().to_numpy(zero_copy_only=False)
    done = ~regular
    lost = []
    if b.column(2).null_count < len(b):
        for i, text in enumerate(b.column(2).to_pylist()):
            if text is not None:
                done[i] = False
                o = int(order[i])
                if text in wide:
                    lost.append(max(o, wide[text]))
                wide[text] = min(o, wide.get(text, o))
    return np.concatenate([order[done], table.insert(_words(b.column(1).drop_null()), order[regular]), np.array(lost, np.int64)])


def identifiers(df: DataFrame, trace: str, span: str, order: Column) -> DataFrame:
    """Rows (image, wide, ord): the identifier as 24 bytes, or as text where it isn't of that width, and the order value."""
    t, s = normal_id(trace), normal_id(span)
    ids = df.select(t.alias("t"), s.alias("s"), order.cast("long").alias("ord"))
    raw = F.concat(F.unhex("t"), F.unhex("s"))
    fixed = (F.length("t") == 32) & (F.length("s") == 16) & (F.length(raw) == 24) & ~F.col("t").rlike("[^0-9a-f]") & ~F.col("s").rlike("[^0-9a-f]")
    ids = ids.select(F.when(fixed, raw).alias("image"), F.when(~fixed, F.concat_ws("\u0000", F.concat("t", F.lit("\u0001")), "s")).alias("wide"), "ord")
    return ids.withColumn("wide", F.when(F.col("wide").contains("\u0000"), F.col("wide")))  # both ids present


def redelivered(df: DataFrame, trace: str = "trace_id", span: str = "span_id", order: str = "arrival_seq", known: DataFrame | None = None) -> DataFrame:
    """The order values of every row that is not the first of its identifier, or whose identifier is among ``known`` (rows of
    ``identifiers``, with order values below all others). One shuffle of at most one row per identifier and input task, and
    of the order values of the copies."""
    ids = identifiers(df.where(F.col(order).isNotNull()), trace, span, F.col(order))
    rows = df.count()
    if known is not None:
        ids, rows = ids.unionByName(known), rows + known.count()
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    return ids.mapInArrow(_local, _SCHEMA).repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(_merge, "ord long").select(F.col("ord").alias(order))


def deduplicate(df: DataFrame, trace: str = "trace_id", span: str = "span_id", order: str = "arrival_seq") -> DataFrame:
    """``df`` with one row per identifier, all columns. ``order`` must tell the rows of one identifier apart."""
    return df.join(redelivered(df, trace, span, order), order, "left_anti").select(*df.columns)
