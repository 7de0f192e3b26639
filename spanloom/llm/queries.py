"""Queries of the problems on text (4, 6, 7, 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import leaks, lookalikes, packing, pii
from spanloom.sources.tables import table


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return pii.find(table(spark, base, "spans"), table(spark, base, "principals"))


def p4_redacted(spark: SparkSession, base: str) -> DataFrame:
    return pii.redact(table(spark, base, "spans"), table(spark, base, "principals")).select("arrival_seq", "attributes")


def p6_pack(spark: SparkSession, base: str) -> DataFrame:
    return packing.pack(table(spark, base, "documents"))


def p6_fill(spark: SparkSession, base: str) -> DataFrame:
    return packing.fill_report(p6_pack(spark, base))


def p6_mixture(spark: SparkSession, base: str) -> DataFrame:
    """Equal target shares by source, which are not those of the corpus: queues run dry one after the other."""
    return packing.mixture_report(_equal_shares(spark, base))


def _equal_shares(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents")
    return packing.pack(docs, mixture=docs.select("source").distinct().withColumn("share", F.lit(1.0)))


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return leaks.leaked(table(spark, base, "documents"), table(spark, base, "eval_items"))


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    return lookalikes.same_looking(table(spark, base, "documents"))


def p8_classes(spark: SparkSession, base: str) -> DataFrame:
    """Each document with its class of looks and the number of documents that look the same and differ."""
    return lookalikes.looks(table(spark, base, "documents"))


def p8_forms(spark: SparkSession, base: str) -> DataFrame:
    return lookalikes.add_canonical(table(spark, base, "documents"), "text", "form", ["doc_id"])


QUERIES = {f.__name__: f for f in (p4_found, p4_redacted, p6_pack, p6_fill, p6_mixture, p7_found, p8_found, p8_classes, p8_forms)}


# Written for the check alone: what the tables' texts are disguised with, seen from the texts and not from the operator.
_PLAIN_OF = {
    "АВЕКМНОРСТУХЅІЈаеорсухѕіјһԁԛԝѵӏ": "ABEKMHOPCTYXSIJaeopcyxsijhdqwvl", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲνϳ": "ABEZHIKMNOPTYXocvj", "օՕսՍհոցՏԼք": "oOuUhngSLp", "ԌӀҮԚԜ": "GIYQW", "ɡɑ": "ga",
}
_MARKED = {"Ϊ": "Ï", "Ϋ": "Ÿ", "Ї": "Ï", "Ё": "Ë", "Ѐ": "È", "ё": "ë", "ї": "ï", "ѐ": "è", "ό": "ó"}
_NOTHING = "\\x{AD}\\x{34F}\\x{61C}\\x{180B}-\\x{180F}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{206F}\\x{FE00}-\\x{FE0F}\\x{FEFF}\\x{E0000}-\\x{E0FFF}"
_BLANKS = "\\x{A0}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}"


def _form(text: str) -> str:
    """SQL for one form of texts that look the same: full width, letters of other alphabets, blanks, characters that show
    nothing, and composed accents."""
    of, to = "".join(_MARKED), "".join(_MARKED.values())
    for a, b in _PLAIN_OF.items():
        of, to = of + a, to + b
    of += "".join(chr(0xFEE0 + c) for c in range(0x21, 0x7F))
    to += "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
    return f"nfc_normalize(translate(nfc_normalize(regexp_replace(regexp_replace({text}, '[{_NOTHING}]', '', 'g'), '[{_BLANKS}]', ' ', 'g')), '{of}', '{to}'))"


_WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}\\p{{M}}]+')"
SQL = {
    "p7_found": f"""WITH d AS (SELECT doc_id, {_WORDS.format(_form('text'))} AS w FROM documents WHERE text IS NOT NULL),
        i AS (SELECT item_id, {_WORDS.format(_form('text'))} AS w FROM eval_items WHERE text IS NOT NULL),
        dw AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
        iw AS (SELECT item_id, array_to_string(w[k:k + 11], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i))
        SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (run)""",
    "p8_found": f"""WITH f AS (SELECT doc_id, text, {_form('text')} AS f FROM documents WHERE text IS NOT NULL)
        SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM f a JOIN f b ON a.f = b.f AND a.doc_id < b.doc_id AND a.text <> b.text""",
    "p8_classes": f"""WITH f AS (SELECT doc_id, text, {_form('text')} AS f FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY f) AS class_id, count(*) OVER (PARTITION BY f, text) AS n_exact, count(*) OVER (PARTITION BY f) - count(*) OVER (PARTITION BY f, text) AS n_links FROM f""",
}
