"""Items into containers of fixed capacity, with the mixture of sources under control.

1. Texts are counted in tokens of a public tokenizer, whole. A text longer than a container is cut into full containers
   and a rest; no other text is ever split.
2. Every source is a queue in an order fixed by hash. Deficit round-robin serves the queues in proportion to their target
   shares: in a round a queue earns its share, serves what it has saved up for, and carries the deficit on. An item is
   therefore served in the round in which its queue has earned the item's last token, that is running total / share, so
   the rounds of all items follow from running totals: deficits carry over windows and over partitions exactly, and no
   queue is walked in one place. Running totals have two levels, blocks and rows within a block, so a source with a third
   of all rows is spread like any other.
3. Items in the order of their rounds fill windows of ``WINDOW`` containers' worth of tokens; when a queue is empty the others
   share its part. The tokens served before an item are running totals in blocks of rounds.
4. Inside a window, which holds a bounded number of tokens, items go best-fit, longest first, into containers.

Defined cases: null texts are no items; texts of no tokens need no room and are left out; a null source is a queue of its
own; repeated rows are packed each; sources without a target share are served by their share of the corpus; an empty
table gives an empty result.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.store import Workspace

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CAPACITY = 2048
#: Containers' worth of tokens in a window.
WINDOW = 256
#: Items of one source block whose running total one task computes.
BLOCK = 1 << 16
#: Most blocks of the order of serving.
MOST_BLOCKS = 10_000
# The byte-level vocabulary's own pre-tokenisation (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, text: str, keep: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """Columns ``keep`` and n_tokens of every row with a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer).encode_ordinary
        for b in batches:
            n = [len(encode(t)) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*b.schema.names[:-1], "n"])

    rows = df.where(F.col(text).isNotNull()).select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keep)], F.col(text).cast("string").alias("t"))
    kinds = ", ".join(f"k{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keep))
    got = rows.mapInArrow(run, f"{kinds}, n long")
    return got.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], F.col("n").alias("n_tokens"))


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item: longest first, each into the fullest container it fits."""
    out = np.zeros(len(sizes), np.int64)
    room: list[tuple[int, int]] = []
    n = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, box = room.pop(at)
        else:
            left, box, n = capacity, n, n + 1
        out[i] = box
        if left > size:
            insort(room, (left - size, box))
    return out


def _before(sums: DataFrame, group: str | None, block: str) -> DataFrame:
    """Adds to each block the sum of the blocks before it (of its group); one row per block."""
    ahead = (Window.partitionBy(group) if group else Window.partitionBy()).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*([group] if group else []), block, F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("before"))


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", capacity: int = CAPACITY, mixture: dict[str, float] | DataFrame | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """Rows (container_id, ``key``, part, source, n_tokens). ``mixture`` gives target shares by source, as a mapping or as a
    table (source, share) of any size; by default each source gets its share of all tokens."""
    work = Workspace(df.sparkSession, "packing")
    counted = count_tokens(df.select(F.col(key).alias("k"), F.col(source).cast("string").alias("src"), F.col(text).alias("text")), "text", ["k", "src"], tokenizer)
    counted, _ = work.save(counted.where("n_tokens > 0").withColumn("src", F.coalesce("src", F.lit("(none)"))))
    totals = counted.groupBy("src").agg(F.sum("n_tokens").alias("t"))
    if isinstance(mixture, dict):
        mixture = df.sparkSession.createDataFrame([(s, float(x)) for s, x in mixture.items()], "source string, share double")
    shares = totals.withColumn("own", F.col("t") / F.sum("t").over(Window.partitionBy()))  # one row per source
    if mixture is not None:
        named = mixture.select(F.coalesce("source", F.lit("(none)")).alias("src"), F.col("share").cast("double").alias("told"))
        shares = shares.join(named, "src", "left").withColumn("own", F.coalesce("told", "own"))
    shares = shares.select("src", F.greatest(F.lit(1e-12), "own").alias("share"))

    piece = F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity).cast("int")))
    items = counted.select("k", "src", "n_tokens", piece.alias("part")).select("k", "src", "part", F.least(F.lit(capacity), F.col("n_tokens") - F.col("part") * capacity).cast("int").alias("size"), F.xxhash64("k").alias("h"))
    blocks = max(1, counted.count() // BLOCK)
    items = items.withColumn("blk", F.pmod("h", F.lit(blocks)))
    before = _before(items.groupBy("src", "blk").agg(F.sum("size").alias("s")), "src", "blk")
    within = Window.partitionBy("src", "blk").orderBy("h", "k", "part", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queue = items.withColumn("run", F.sum("size").over(within)).join(before.join(shares, "src"), ["src", "blk"])
    # the round in which a queue has earned an item's last token
    queue, _ = work.save(queue.select("k", "part", "src", "size", "h", ((F.col("run") + F.col("before")) / F.col("share")).alias("round")))

    # Items in the order of their rounds, and the tokens served before each: running totals again have two levels, the blocks
    # being ranges of rounds. Tokens are whole numbers, so windows are exact at any size.
    n = min(MOST_BLOCKS, queue.count() // BLOCK)
    cuts = np.array(queue.agg(F.percentile_approx("round", [i / (n + 1) for i in range(1, n + 1)])).first()[0] or []) if n else np.zeros(0)

    def block(rounds: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, rounds.to_numpy(float)).astype("int32"))

    queue = queue.withColumn("blk", F.pandas_udf(block, "int")("round"))
    before = _before(queue.groupBy("blk").agg(F.sum("size").alias("s")), None, "blk")
    within = Window.partitionBy("blk").orderBy("round", "h", "k", "part", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    served = queue.withColumn("run", F.sum("size").over(within)).join(before, "blk")
    queue = served.select(F.floor((F.col("run") + F.col("before") - 1) / (WINDOW * capacity)).cast("long").alias("w"), "k", "part", "src", "size", "h")
    kind = df.schema[key].dataType.simpleString()

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["h", "part", "size"], kind="stable")
        box = best_fit(group["size"].to_numpy(), capacity)
        return pd.DataFrame({"container_id": group["w"].to_numpy() * (1 << 20) + box, "k": group["k"], "part": group["part"], "source": group["src"], "n_tokens": group["size"]})

    return queue.groupBy("w").applyInPandas(fill, f"container_id long, k {kind}, part int, source string, n_tokens int").withColumnRenamed("k", key)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, and the share of all room that is used."""
    boxes = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    return boxes.agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_items"), F.sum("t").alias("n_tokens"), F.max("t").alias("fullest"), (F.sum("t") / (F.count("*") * capacity)).alias("filled"))


def mixture_report(packed: DataFrame) -> DataFrame:
    """Per window and source: tokens, and the source's share of the window."""
    w = F.shiftright("container_id", 20).alias("window_id")
    cells = packed.groupBy(w, "source").agg(F.sum("n_tokens").alias("n_tokens"))
    return cells.withColumn("share", F.col("n_tokens") / F.sum("n_tokens").over(Window.partitionBy("window_id")))
