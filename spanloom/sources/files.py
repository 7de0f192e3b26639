"""Span fixtures, text lines, taxonomies and rule bundles; result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.schemas import SPAN, TAXONOMY, TEXT_LINES


def read_fixture(spark: SparkSession, path: str) -> DataFrame:
    """A file that is one JSON array of span rows; seq and arrival_seq are numbered in file order where absent."""
    raw = spark.read.schema(SPAN).option("multiLine", True).json(path)
    n = F.monotonically_increasing_id() + 1
    return raw.withColumns({"seq": F.coalesce("seq", n), "arrival_seq": F.coalesce("arrival_seq", n)})


def read_lines(spark: SparkSession, path: str, done: DataFrame | None = None) -> DataFrame:
    """``{"index", "text"}`` lines; malformed ones are skipped, and so are those already in ``done``."""
    rows = spark.read.schema(TEXT_LINES + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows = rows.where(F.col("_corrupt").isNull() & F.col("index").isNotNull() & F.col("text").isNotNull()).drop("_corrupt")
    return rows if done is None else rows.join(done.select("index"), "index", "left_anti")


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Entity types with their metadata, one row per tag."""
    raw = spark.read.schema(TAXONOMY).option("header", True).option("quote", '"').option("escape", '"').option("enforceSchema", False).csv(path)
    kind = F.col("Data Type")
    return raw.select(
        F.col("TAG").alias("tag"), F.col("Domain").alias("domain"), F.when(kind == "personID", "PID").when(kind == "operationalID", "OPID").otherwise("DATA").alias("identifier_type"),
        F.coalesce(F.from_json("regulatory_tags", "array<string>"), F.array().cast("array<string>")).alias("regulatory_tags"), (F.col("Is Personalized") == "1").alias("personalised"),
    )


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """A rule bundle (one JSON object) as one row per rule, in order, with the rule's text."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.posexplode(F.variant_get(F.try_parse_json("value"), "$.rules", "array<variant>")).alias("at", "rule")).select("at", F.variant_get("rule", "$.rule_id", "string").alias("rule_id"), F.to_json("rule").alias("rule"))


def write_results(df: DataFrame, path: str, kind: str = "json") -> None:
    """Result files; arrays and structs become JSON text in CSV."""
    if kind == "csv":
        flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name) for f in df.schema.fields]
        df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        df.write.mode("overwrite").json(path)


def table_or_empty(spark: SparkSession, name: str, schema: str) -> DataFrame:
    """A table, or an empty frame of its schema where it does not exist yet."""
    return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)


def check_output(given: DataFrame, got: DataFrame, tags: list[str]) -> DataFrame:
    """Rows that don't fit: an index on one side only, another text, or a tag outside of the list."""
    a, b = given.select("index", F.col("text").alias("t1")), got.select("index", F.col("text").alias("t2"), "entities")
    known = F.forall(F.coalesce("entities", F.array().cast("array<struct<tag:string>>")), lambda e: e["tag"].isin(tags)) if "entities" in got.columns else F.lit(True)
    both = a.join(b, "index", "full")
    return both.withColumn("problem", F.when(F.col("t2").isNull(), "missing").when(F.col("t1").isNull(), "unknown").when(F.col("t1") != F.col("t2"), "text").when(~known, "tag")).where("problem is not null").select("index", "problem")
