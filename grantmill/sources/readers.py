"""Readers with explicit schemas that fail on anything unexpected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import is_slug
from ..operators.lexicon import flatten_document
from ..operators.validation import require_columns, require_rows

BOM = "﻿"


def read_census(spark: SparkSession, paths: Sequence[str] | str, partitions: int | None = None) -> DataFrame:
    """Census JSON lines, plain or gzip.  A gzip file is one task, so pass
    ``partitions`` to spread the rows before heavy work."""
    df = spark.read.schema(schemas.CENSUS).option("mode", "FAILFAST").json(paths)
    return df.repartition(partitions) if partitions else df


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan over all cores when it has fewer splits than cores (one
    small or unsplittable file).  A large scan is returned as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_csv(
    spark: SparkSession, paths: Sequence[str] | str, required: Sequence[str], expected: int | None = None,
    separator: str = ",", strip_nul: bool = False,
) -> DataFrame:
    """Headed CSV with quoted newlines; header and row count are checked."""
    df = (
        spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        .option("sep", separator).option("encoding", "UTF-8").option("mode", "FAILFAST").csv(paths)
    )
    df = df.toDF(*[c.lstrip(BOM) for c in df.columns])
    if strip_nul:
        df = df.select(*[F.replace(F.col(f"`{c}`"), F.lit("\u0000"), F.lit("")).alias(c) for c in df.columns])
    df = require_columns(df, required)
    return df if expected is None else require_rows(df, expected)


def read_semicolon_csv(spark: SparkSession, paths: Sequence[str] | str, required: Sequence[str]) -> DataFrame:
    return read_csv(spark, paths, required, separator=";", strip_nul=True)


def read_json_array(spark: SparkSession, paths: Sequence[str] | str, ddl: str) -> DataFrame:
    """Files that hold one JSON array each; unreadable files fail the job."""
    df = spark.read.schema(ddl).option("multiLine", True).option("mode", "FAILFAST").json(paths)
    return df.withColumn("slug", file_stem(F.input_file_name()))


def read_keyed_json(spark: SparkSession, paths: Sequence[str] | str, value_ddl: str, suffix: str = "") -> DataFrame:
    """Files that hold one ``{key: value}`` object each, as (slug, key, value).

    A file that is not such an object fails the job instead of reading as
    empty.  Each file is one row, as its format demands; files are small
    review logs and spread over tasks by file.
    """
    raw = spark.read.text(paths, wholetext=True).select(
        file_stem(F.input_file_name(), suffix).alias("slug"), F.col("value").alias("body")
    )
    parsed = F.from_json("body", f"MAP<STRING, {value_ddl}>")
    checked = F.coalesce(
        F.when(F.json_object_keys("body").isNotNull(), parsed),
        F.raise_error(F.concat(F.lit("unreadable object file: "), F.col("slug"))).cast(f"MAP<STRING, {value_ddl}>"),
    )
    return raw.select("slug", F.explode(checked).alias("key", "value"))


def file_stem(path: Column, suffix: str = "") -> Column:
    """File name without folder and ending (``suffix`` goes too)."""
    import re

    name = F.regexp_extract(path, r"([^/]+)$", 1)
    return F.regexp_replace(name, re.escape(suffix) + r"(\.json|\.jsonl|\.csv|\.parquet)?(\.gz)?$", "")


def split_slugs(df: DataFrame, slug: str = "slug") -> tuple[DataFrame, DataFrame]:
    """Rows from well-named files, and the names that were rejected."""
    good = is_slug(F.col(slug))
    return df.filter(good), df.filter(~good).select(slug).distinct()


def read_awards(spark: SparkSession, path: str) -> DataFrame:
    from ..operators.awards import load_awards

    return load_awards(read_csv(spark, path, ["HRCS2022_ID", "AwardTitle", "HC_1", "RA_1", "CodingType"]))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Term table of a lexicon document."""
    return flatten_document(spark.read.schema(schemas.LEXICON_DOCUMENT).option("multiLine", True).option("mode", "FAILFAST").json(path))


def read_table(spark: SparkSession, path: str, ddl: str | None = None) -> DataFrame:
    reader = spark.read.schema(ddl) if ddl else spark.read
    return reader.parquet(path)
