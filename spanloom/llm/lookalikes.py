"""One form for text that looks the same.

Tables over code points, built once per worker by rule from the Unicode character data that comes with Python, turn each
code point into none (it shows nothing), one or several (a letter and its marks). The form:

* characters that show nothing are gone;
* full-width and half-width forms are the ordinary ones; all single spaces are U+0020;
* letters of other alphabets with the same shape as a Latin letter are that Latin letter;
* accents are combined into the letter where Unicode has such a letter, marks are in canonical order.

What can be seen stays: case, digits, accents, punctuation, raised and lowered positions, the number of spaces, line
ends. The work is done on whole columns: gather, expand by offsets, order the marks, compose pairs.

Defined cases: null stays null; empty text stays empty, text of nothing but invisible characters becomes empty; very
long rows are worked on alone; repeated rows and ties give equal forms; an empty table gives an empty table.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.codepoints import buffers, chunks, decode, encode, has_non_ascii, take_rows
from spanloom.store import Workspace

# Letters of other alphabets by the Latin letter of the same shape (fixed values, from their glyphs).
SAME_SHAPE = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J",
    "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ӏ": "I", "Ү": "Y", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
    "Ϳ": "J", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    # Armenian
    "օ": "o", "Օ": "O", "ս": "u", "Ս": "U", "հ": "h", "ո": "n", "ց": "g", "Տ": "S", "Լ": "L", "ք": "p",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V",
    "Ꮃ": "W", "Ꮓ": "Z", "Ꮐ": "G", "Ꮍ": "Y",
    # Coptic
    "Ⲁ": "A", "Ⲃ": "B", "Ⲍ": "Z", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H",
    "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # Latin letters of phonetic alphabets, and small capitals shaped like small letters
    "ɡ": "g", "ɑ": "a", "ᴏ": "o", "ᴄ": "c", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s", "ᴜ": "u",
}
#: Numerals written as one character look like the letters of their decomposition.
ROMAN = (0x2160, 0x2180)

# Ranges that show nothing (fixed values: the default-ignorable code points, and controls that are no white space).
INVISIBLE = [
    (0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x84), (0x86, 0x9F), (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFFB),
    (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]

#: Parts of the code space in which anything is decomposed or combines; the rest maps to itself.
_LIVE = [(0x80, 0x3400), (0xA000, 0xAC00), (0xD7B0, 0xD800), (0xF900, 0x12000), (0x16A00, 0x17000), (0x1B000, 0x1F000), (0x2F800, 0x2FA20)]


class _Tables:
    def __init__(self):
        top = 0x110000
        self.count = np.ones(top, np.uint8)
        self.map = np.arange(top, dtype=np.uint32)
        self.rank = np.zeros(top, np.uint8)
        more: list[int] = []
        self.first = np.zeros(top, np.int32)
        pairs: dict[int, int] = {}
        for a, b in _LIVE:
            for cp in range(a, b):
                ch = chr(cp)
                self.rank[cp] = unicodedata.combining(ch)
                form = unicodedata.decomposition(ch)
                if not form and ch not in SAME_SHAPE and unicodedata.category(ch) != "Zs":
                    continue
                if form.startswith(("<wide>", "<narrow>")):
                    ch = chr(int(form.split()[1], 16))
                elif ROMAN[0] <= cp < ROMAN[1] and form.startswith("<compat>"):
                    ch = unicodedata.normalize("NFKD", ch)
                if len(ch) == 1 and unicodedata.category(ch) == "Zs" and cp != 0x1680:
                    out = " "
                else:
                    out = "".join(SAME_SHAPE.get(c, c) for c in unicodedata.normalize("NFD", ch))
                if len(out) == 1:
                    self.map[cp] = ord(out)
                else:
                    self.count[cp], self.first[cp] = len(out), len(more)
                    more += map(ord, out)
                if form and form[0] != "<" and unicodedata.normalize("NFC", chr(cp)) == chr(cp):
                    parts = form.split()
                    if len(parts) == 2:
                        base = SAME_SHAPE.get(chr(int(parts[0], 16)), chr(int(parts[0], 16)))
                        pairs[ord(base) << 32 | int(parts[1], 16)] = cp
        # a Latin letter with the mark wins over the letter that was given its shape
        for a, b in [(0xC0, 0x250), (0x1E00, 0x1F00)]:
            for cp in range(a, b):
                parts = unicodedata.decomposition(chr(cp)).split()
                if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", chr(cp)) == chr(cp):
                    pairs[int(parts[0], 16) << 32 | int(parts[1], 16)] = cp
        for a, b in INVISIBLE:
            self.count[a : b + 1] = 0
        self.more = np.array(more or [0], np.uint32)
        self.pair_keys = np.array(sorted(pairs), np.uint64)
        self.pair_to = np.array([pairs[k] for k in sorted(pairs)], np.uint32)


@cache
def tables() -> _Tables:
    return _Tables()


def _order_marks(points: np.ndarray, rank: np.ndarray, row: np.ndarray) -> np.ndarray:
    wrong = (rank[1:] > 0) & (rank[:-1] > rank[1:]) & (row[1:] == row[:-1])
    if not wrong.any():
        return points
    start = rank == 0
    start[1:] |= row[1:] != row[:-1]
    group = np.cumsum(start)
    bad = np.zeros(group[-1] + 1, bool)
    bad[group[1:][wrong]] = True
    rows = np.flatnonzero(bad[group])
    points = points.copy()
    points[rows] = points[rows][np.lexsort((rank[rows], group[rows]))]
    return points


def _compose(points: np.ndarray, row: np.ndarray, t: _Tables) -> tuple[np.ndarray, np.ndarray]:
    """Joins marks to the letters before them, one mark of each letter at a time. ``row`` is the row of each point."""
    while True:
        rank = t.rank[points]
        marks = np.flatnonzero(rank)
        if not len(marks):
            break
        index = np.arange(len(points))
        letter = np.maximum.accumulate(np.where(rank == 0, index, -1))[marks]
        before = np.where(marks > 0, rank[marks - 1], 0)
        ok = (letter >= 0) & ((before == 0) | (before < rank[marks]))
        ok &= row[np.maximum(letter, 0)] == row[marks]
        marks, letter = marks[ok], letter[ok]
        key = points[letter].astype(np.uint64) << np.uint64(32) | points[marks].astype(np.uint64)
        at = np.minimum(np.searchsorted(t.pair_keys, key), len(t.pair_keys) - 1)
        hit = t.pair_keys[at] == key
        marks, letter, at = marks[hit], letter[hit], at[hit]
        if not len(marks):
            break
        first = np.ones(len(letter), bool)
        first[1:] = letter[1:] != letter[:-1]
        points = points.copy()
        points[letter[first]] = t.pair_to[at[first]]
        stay = np.ones(len(points), bool)
        stay[marks[first]] = False
        points, row = points[stay], row[stay]
    lead = (points >= 0x1100) & (points < 0x1113)
    if lead.any():
        points, row = _hangul(points, row)
    return points, row


def _hangul(points: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joins conjoining letters to syllables."""
    p = points.astype(np.int64)
    lv = np.zeros(len(p), bool)
    lv[:-1] = (p[:-1] >= 0x1100) & (p[:-1] < 0x1113) & (p[1:] >= 0x1161) & (p[1:] < 0x1176) & (row[:-1] == row[1:])
    i = np.flatnonzero(lv)
    p[i] = 0xAC00 + ((p[i] - 0x1100) * 21 + (p[i + 1] - 0x1161)) * 28
    stay = np.ones(len(p), bool)
    stay[i + 1] = False
    p, row = p[stay], row[stay]
    t = np.zeros(len(p), bool)
    t[:-1] = (p[:-1] >= 0xAC00) & (p[:-1] < 0xD7A4) & ((p[:-1] - 0xAC00) % 28 == 0) & (p[1:] > 0x11A7) & (p[1:] < 0x11C3) & (row[:-1] == row[1:])
    i = np.flatnonzero(t)
    p[i] += p[i + 1] - 0x11A7
    stay = np.ones(len(p), bool)
    stay[i + 1] = False
    return p[stay].astype(np.uint32), row[stay]


def canonical_points(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points with row offsets to those of the one form."""
    t = tables()
    n = len(offsets) - 1
    count = t.count[points]
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    if (count > 1).any():
        count = count.astype(np.int64)
        to = np.cumsum(count)
        out = np.repeat(t.map[points], count)
        many = np.flatnonzero(count > 1)
        size = count[many]
        start = np.repeat(to[many] - size, size)
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[start + within] = t.more[np.repeat(t.first[points[many]], size) + within]
        row = np.repeat(row, count)
    else:
        keep = count > 0
        out, row = t.map[points[keep]], row[keep]
    rank = t.rank[out]
    if rank.any():
        if len(out):
            out = _order_marks(out, rank, row)
        out, row = _compose(out, row, t)
    elif ((out >= 0x1100) & (out < 0x1113)).any():
        out, row = _hangul(out, row)
    at = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(row, minlength=n), out=at[1:])
    return out, at


def canonical(col: pa.Array) -> pa.Array:
    """The one form of a string column. Rows of plain ASCII are that already."""
    raw, offsets = buffers(col)
    odd = np.flatnonzero(has_non_ascii(raw, offsets))
    if not len(odd):
        return col.cast(pa.large_string())
    some_raw, some = take_rows(raw, offsets, odd)
    parts = [encode(*canonical_points(*decode(some_raw[some[i] : some[j]], some[i : j + 1] - some[i]))) for i, j in chunks(some)]
    whole = pa.concat_arrays([col.cast(pa.large_string()), *parts])
    index = np.arange(len(col))
    index[odd] = len(col) + np.arange(len(odd))
    out = whole.take(pa.array(index))
    if col.null_count:
        nulls = col.is_null()
        out = pc.if_else(nulls, pa.scalar(None, pa.large_string()), out)
    return out


def add_canonical(df: DataFrame, text: str, out: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and ``out``, the one form of ``text``. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], canonical(b.column(b.num_columns - 1)).cast(pa.string())], names=[*[f"k{i}" for i in range(len(keep))], "c"])

    rows = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keep)], F.col(text).alias("c"))
    got = rows.mapInArrow(run, rows.schema)
    return got.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], F.col("c").alias(out))


#: Classes of one form that meet the others in one part of the join.
PAIRED_AT_ONCE = 1000


def looks(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row with a text: ``key``, ``class_id`` (the smallest key with the same form), ``n_exact`` (rows with the very
    same text, itself included), ``n_links`` (rows that look the same and differ in code points). Linear in the rows."""
    work = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).withColumn("raw", F.unhex(F.sha2("t", 256)))
    rows, _ = Workspace(df.sparkSession, "looks").save(add_canonical(work, "t", "form", ["k", "raw"]).select("k", "raw", F.unhex(F.sha2("form", 256)).alias("form")))
    exact = rows.groupBy("form", "raw").agg(F.count("*").alias("n_exact"), F.min("k").alias("lo"))
    forms = exact.groupBy("form").agg(F.sum("n_exact").alias("n"), F.min("lo").alias("class_id"))
    sized = exact.join(forms, "form").select("raw", "class_id", "n_exact", (F.col("n") - F.col("n_exact")).alias("n_links"))
    return rows.select("k", "raw").join(sized, "raw").select(F.col("k").alias(key), "class_id", "n_exact", "n_links")


def same_looking(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs (``key``_a < ``key``_b) of rows whose texts look the same and differ in code points.

    Exact copies are one class. Forms with a single class are gone before anything is joined; classes of one form are
    paired, and only then do their members come in, so copies never meet one another. Digests are SHA-256.
    """
    work = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).withColumn("raw", F.unhex(F.sha2("t", 256)))
    # the digests are read four times, the texts once
    rows, _ = Workspace(df.sparkSession, "looks").save(add_canonical(work, "t", "form", ["k", "raw"]).select("k", "raw", F.unhex(F.sha2("form", 256)).alias("form")))
    mixed = rows.groupBy("form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("form")
    members = rows.join(mixed, "form", "left_semi")
    classes = members.select("form", "raw").distinct()
    # a form with many classes is paired in parts, each class of the one side with all of the other
    parts = classes.groupBy("form").agg(F.ceil(F.count("*") / PAIRED_AT_ONCE).cast("int").alias("parts"))
    classes = classes.join(parts, "form")
    left = classes.select("form", F.col("raw").alias("ra"), F.pmod(F.xxhash64("raw"), "parts").cast("int").alias("part"))
    right = classes.select("form", F.col("raw").alias("rb"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = left.join(right, ["form", "part"]).where("ra < rb")
    a = members.select(F.col("raw").alias("ra"), F.col("k").alias("ka"))
    b = members.select(F.col("raw").alias("rb"), F.col("k").alias("kb"))
    found = pairs.select("ra", "rb").join(a, "ra").join(b, "rb").where(F.col("ka") != F.col("kb"))
    return found.select(F.least("ka", "kb").alias(f"{key}_a"), F.greatest("ka", "kb").alias(f"{key}_b")).distinct()
