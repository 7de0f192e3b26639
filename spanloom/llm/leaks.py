"""Held-out test texts inside a corpus: Wu-Manber search for every run of twelve words.

Texts are brought to words first: one form for look-alikes and invisible characters, lower case, runs of letters and
digits; mark-up tags, escaped line ends and hyphens at line ends are no words. The test strings are all runs of
``RUN`` = 12 consecutive words of the test items, over the alphabet of the words that occur in them.

Search: a shift table over blocks of two words tells how far a window may jump because its last block ends in no test
string, or only earlier in one; a window whose shift is zero looks up its last four words in the suffix buckets, and
each test string of the bucket is compared with the window word for word. Words are held by 64-bit hashes until then;
what has been found is at last compared letter by letter, so hashing can neither add nor lose an occurrence.

All rows of a batch are searched at the same time, long texts as several overlapping lanes. The search strings are a
stated set, sent to every task in sets of a checked size; for each set the corpus is read once, and it is never shuffled
except for the pairs that are found.

Defined cases: null and empty texts contain nothing; an item shorter than twelve words can't leak; an item that occurs
several times in a document gives one row; items with equal passages are all reported; null items are skipped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.codepoints import buffers, chunks, decode, has_non_ascii, take_rows
from spanloom.llm.lookalikes import canonical_points

RUN, BLOCK, SUFFIX = 12, 2, 4
#: Words of one lane of the search; lanes overlap by RUN - 1 words.
LANE = 512
#: Between these signs anything counts as a tag; what is longer must be built like one, or prose between signs would be lost.
#: A value with blanks may be a passage itself, so a long tag with such a value stays text.
ANY_TAG = 120
LONG_TAG = re.compile(r"</?[a-z][\w:.-]*(?:\s+[\w:@.-]+\s*=\s*(?:\"[^\"\s]*\"|'[^'\s]*'|[^\s\"'<>=]+))*\s*/?>", re.I)
#: The longest name of a character in HTML has 31 letters.
LONGEST_ENTITY = 33
#: Characters of test items that are sent to the tasks at a time; for more, the corpus is read once per set of items.
ITEM_CHARS = 64 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


@cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Lower case (one code point each) and whether a code point is part of a word."""
    lower = np.arange(0x110000, dtype=np.uint32)
    for cp in [*range(0x250, 0x2E00), *range(0xA640, 0xABC0), *range(0xFF21, 0xFF3B), *range(0x10400, 0x11900), *range(0x41, 0x250)]:
        x = chr(cp).lower()
        if len(x) == 1:
            lower[cp] = ord(x)
    word = np.zeros(0x110000, bool)
    word[:0x20000] = [chr(cp).isalnum() for cp in range(0x20000)]
    word[0x20000:0x32000] = True
    for a, b in [(0x300, 0x370), (0x483, 0x488), (0x591, 0x5C8), (0x610, 0x61B), (0x64B, 0x660), (0x900, 0x1000), (0x1AB0, 0x1B00), (0x1DC0, 0x1E00), (0x20D0, 0x2100)]:
        word[a:b] = True  # marks belong to their letter
    return lower, word


def _mask_markup(p: np.ndarray, row: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Takes tags, entities and escapes out of the words; joins words broken by a hyphen at a line end."""
    n = len(p)
    if n < 3:
        return word
    lt = np.flatnonzero(p == 60)
    if len(lt):
        gt = np.flatnonzero(p == 62)
        at = np.searchsorted(gt, lt)
        ok = at < len(gt)
        lt, end = lt[ok], gt[at[ok]]
        nxt = p[np.minimum(lt + 1, n - 1)]
        opens = ((nxt >= 97) & (nxt <= 122)) | (nxt == 47) | (nxt == 33)
        ok = opens & (row[lt] == row[end])
        ok[:-1] &= lt[1:][: len(ok) - 1] > end[:-1] if len(ok) > 1 else True
        for i in np.flatnonzero(ok & (end - lt > ANY_TAG)).tolist():
            ok[i] = LONG_TAG.fullmatch(p[lt[i] : end[i] + 1].astype("<u4").tobytes().decode("utf-32-le", "replace")) is not None
        d = np.zeros(n + 1, np.int32)
        np.add.at(d, lt[ok], 1)
        np.add.at(d, end[ok] + 1, -1)
        word = word & ~(np.cumsum(d[:-1]) > 0)
    slash = np.flatnonzero(p[:-1] == 92)
    if len(slash):
        e = slash[np.isin(p[slash + 1], [110, 116, 114])]
        word = word.copy()
        word[e + 1] = False
    amp = np.flatnonzero(p == 38)
    if len(amp):
        semi = np.flatnonzero(p == 59)
        at = np.searchsorted(semi, amp)
        ok = at < len(semi)
        amp, end = amp[ok], semi[at[ok]]
        ok = (end - amp <= LONGEST_ENTITY) & (row[amp] == row[end])
        word = word.copy()
        for a, b in zip(amp[ok].tolist(), end[ok].tolist()):
            if word[a + 1 : b].all() if b - a > 8 else not (p[a:b] == 32).any():
                word[a:b] = False
    return word


def _join_broken(p: np.ndarray, row: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Which code points stay: hyphens with a line end between letters go, so that the word is whole again."""
    stay = np.ones(len(p), bool)
    i = np.flatnonzero((p[1:-2] == 45) & (p[2:-1] == 10)) + 1 if len(p) > 3 else np.zeros(0, np.int64)
    i = i[word[i - 1] & word[i + 2] & (row[i - 1] == row[i + 2]) & (p[i + 2] > 96) & (p[i - 1] > 96)]
    stay[i] = stay[i + 1] = False
    return stay


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 21)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                _powers[name] = np.cumprod(x)
    return _powers["up"], _powers["down"]


def words(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of code points in the one form: hash, row, start, end of each, and the code points that start and end count in."""
    lower, is_word = _classes()
    p = lower[points]
    n = len(offsets) - 1
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    word = _mask_markup(p, row, is_word[p])
    stay = _join_broken(p, row, word)
    if not stay.all():
        p, row, word = p[stay], row[stay], word[stay]
    if not len(p):
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z, p
    edge = np.ones(len(p), bool)
    edge[1:] = (word[1:] != word[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(edge)
    end = np.append(start[1:], len(p))
    keep = word[start]
    start, end = start[keep], end[keep]
    up, down = _power(len(p) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(p) + 1, np.uint64)
        np.cumsum((p.astype(np.uint64) + np.uint64(1)) * up[: len(p)], out=total[1:])
        h = (total[end] - total[start]) * down[start]
    return h, row[start].astype(np.int64), start, end, p


class Patterns:
    """Shift table, suffix buckets and test strings of a set of items."""

    def __init__(self, items: list[tuple[int, str]], lower: bool = False):
        self.item_ids = [i for i, _ in items]
        # capitals of other alphabets may look like other letters than their small ones: such texts are read both ways
        self.lowered = None if lower else Patterns(items, True)
        raw, at = buffers(pa.array([t for _, t in items], pa.string()))
        points, at = decode(raw, at)
        points, at = canonical_points(_classes()[0][points] if lower else points, at)
        h, row, start, end, p = words(points, at)
        self.text = [p[a:b].astype("<u4").tobytes() for a, b in zip(start.tolist(), end.tolist())]
        self.alphabet = np.unique(h)
        sym = np.searchsorted(self.alphabet, h) + 1
        runs = np.flatnonzero(row[: len(row) - RUN + 1] == row[RUN - 1 :]) if len(row) >= RUN else np.zeros(0, np.int64)
        self.at = runs  # of each test string, the place of its first word
        self.item = row[runs]
        strings = sym[runs[:, None] + np.arange(RUN)] if len(runs) else np.zeros((0, RUN), np.int64)
        k = len(self.alphabet) + 1
        self.k = k
        blocks: list[np.ndarray] = [strings[:, j] * k + strings[:, j + 1] for j in range(RUN - 1)]
        self.block_keys = np.unique(np.concatenate(blocks)) if len(runs) else np.zeros(0, np.int64)
        self.shift = np.full(len(self.block_keys), RUN - BLOCK + 1, np.int64)
        for j in range(RUN - 1):
            i = np.searchsorted(self.block_keys, blocks[j])
            np.minimum.at(self.shift, i, RUN - BLOCK - j)
        suffix = self._suffix(strings[:, RUN - SUFFIX :])
        order = np.argsort(suffix, kind="stable")
        self.strings, self.item, self.at = strings[order].astype(np.int32), self.item[order], self.at[order]
        self.suffix_keys, self.bucket = np.unique(suffix[order], return_index=True)
        self.bucket = np.append(self.bucket, len(order))

    def _suffix(self, s: np.ndarray) -> np.ndarray:
        out = np.zeros(len(s), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(SUFFIX):
                out = out * np.uint64(self.k) + s[:, j].astype(np.uint64)
        return out

    def search(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (index of the first word) and test strings of all occurrences in a stream of words."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.strings) or len(h) < RUN:
            return none
        at = np.minimum(np.searchsorted(self.alphabet, h), len(self.alphabet) - 1)
        sym = np.where(self.alphabet[at] == h, at + 1, 0)
        # lanes: a row's words, cut into overlapping pieces
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        size = np.diff(np.append(first, len(row)))
        pieces = np.maximum(1, -(-(size - (RUN - 1)) // (LANE - RUN + 1)))
        lane = np.repeat(first, pieces) + (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * (LANE - RUN + 1)
        stop = np.minimum(lane + LANE, np.repeat(first + size, pieces))
        pos = lane + RUN - 1  # last word of the window
        found_at, found_string = [], []
        alive = pos < stop
        pos, stop = pos[alive], stop[alive]
        top = len(self.block_keys) - 1
        while len(pos):
            last = sym[pos]
            key = sym[pos - 1] * self.k + last
            i = np.minimum(np.searchsorted(self.block_keys, key), top)
            shift = np.where(self.block_keys[i] == key, self.shift[i], RUN - BLOCK + 1)
            shift = np.where(last == 0, RUN, shift)
            zero = pos[shift == 0]
            if len(zero):
                s = self._suffix(sym[zero[:, None] + np.arange(1 - SUFFIX, 1)])
                i = np.minimum(np.searchsorted(self.suffix_keys, s), len(self.suffix_keys) - 1)
                ok = self.suffix_keys[i] == s
                zero, i = zero[ok], i[ok]
                n = self.bucket[i + 1] - self.bucket[i]
                string = np.repeat(self.bucket[i], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                begin = np.repeat(zero, n) - RUN + 1
                same = np.ones(len(string), bool)
                for j in range(RUN - SUFFIX - 1, -1, -1):
                    live = np.flatnonzero(same)
                    if not len(live):
                        break
                    same[live] = sym[begin[live] + j] == self.strings[string[live], j]
                found_at.append(begin[same])
                found_string.append(string[same])
            pos = pos + np.maximum(shift, 1)
            alive = pos < stop
            pos, stop = pos[alive], stop[alive]
        return (np.concatenate(found_at), np.concatenate(found_string)) if found_at else none


def find(patterns: Patterns, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a string column and indices of the items found in them, each pair once."""
    raw, offsets = buffers(col)
    odd = has_non_ascii(raw, offsets)
    pairs: dict[tuple[int, int], None] = {}
    for rows, plain in ((np.flatnonzero(~odd), True), (np.flatnonzero(odd), False)):
        if not len(rows):
            continue
        some, at = (raw, offsets) if len(rows) == len(odd) else take_rows(raw, offsets, rows)
        for i, j in chunks(at):
            points, o = decode(some[at[i] : at[j]], at[i : j + 1] - at[i])
            if plain:
                pairs.update(dict.fromkeys((int(rows[i + r]), k) for r, k in _find(patterns, points, o)))
                continue
            for these, before in ((patterns, points), (patterns.lowered, _classes()[0][points])):
                pairs.update(dict.fromkeys((int(rows[i + r]), k) for r, k in _find(these, *canonical_points(before, o))))
    return np.array([r for r, _ in pairs], np.int64), np.array([k for _, k in pairs], np.int64)


def _find(patterns: Patterns, points: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows and items of code points in the one form."""
    h, row, start, end, p = words(points, offsets)
    place, string = patterns.search(h, row)
    if not len(place):
        return
    r, item = row[place], patterns.item[string]
    done = None
    for q in np.lexsort((item, r)).tolist():
        pair = (int(r[q]), int(item[q]))
        if pair == done:
            continue
        a, b = int(place[q]), int(patterns.at[string[q]])
        if all(p[start[a + x] : end[a + x]].astype("<u4").tobytes() == patterns.text[b + x] for x in range(RUN)):
            done = pair
            yield pair


def leaked(docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """Rows (doc, item): the document contains at least twelve consecutive words of the item."""
    chosen = items.where(F.col(text).isNotNull() & F.col(item).isNotNull())
    size = chosen.agg(F.coalesce(F.sum(F.length(text).cast("long")), F.lit(0))).first()[0]
    sets = -(-size // ITEM_CHARS) or 1
    found = [_leaked(docs, chosen.where(F.pmod(F.xxhash64(item, text), F.lit(sets)) == n), doc, item, text) for n in range(sets)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _leaked(docs: DataFrame, chosen: DataFrame, doc: str, item: str, text: str) -> DataFrame:
    """The search for one set of items, about ``ITEM_CHARS`` long."""
    rows = [(r[0], r[1]) for r in chosen.select(item, text).orderBy(item, text).collect()]
    shared = docs.sparkSession.sparkContext.broadcast(Patterns(rows))
    kinds = docs.schema[doc].dataType.simpleString(), chosen.schema[item].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = shared.value
        for b in batches:
            at, which = find(patterns, b.column(1))
            if len(at):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array([patterns.item_ids[w] for w in which])], names=["d", "i"])

    got = docs.select(F.col(doc).alias("d"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"d {kinds[0]}, i {kinds[1]}")
    return got.select(F.col("d").alias(doc), F.col("i").alias(item))


def brute_force(texts: list[str | None], items: list[str]) -> set[tuple[int, int]]:
    """The same by plain string search, for tests."""
    from spanloom.llm.lookalikes import canonical

    def bare(t: str) -> list[str]:
        t = re.sub(r"<[a-zA-Z/!][^<>]{0,118}>", " ", t)
        t = re.sub(r"\\[ntr]", " ", t)
        t = re.sub(r"&[^\s;&]{1,32};", " ", t)
        t = re.sub(r"(?<=[^\W_])-\n(?=[^\W_])", "", t)
        return re.findall(r"[^\W_]+", t)

    forms = [" ".join(bare(t.lower())) if t else "" for t in canonical(pa.array(texts, pa.string())).to_pylist()]
    out = set()
    for n, t in enumerate(items):
        w = [x.lower() for x in bare(t)]
        for k in range(len(w) - RUN + 1):
            run = " " + " ".join(w[k : k + RUN]) + " "
            out |= {(d, n) for d, f in enumerate(forms) if run in f" {f} "}
    return out
