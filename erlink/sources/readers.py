"""Readers of record files, id lists, ground truth and models."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from erlink.sources.scratch import materialize
from erlink.sources.sinks import read_text

RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(n, T.StringType()) for n in ("source1_entity_id", "matched_entity_ids")])


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = RECORD, columns: Iterable[str] | None = None) -> DataFrame:
    """Tab-separated text with a header; only an empty field is null, quotes double inside quotes.

    columns reads a subset; the source prunes the others. Splits of the file are what chunks are elsewhere.
    """
    rows = spark.read.options(sep="\t", header=True, escape='"', nullValue="", enforceSchema=True).schema(schema).csv(path)
    return rows.select(*columns) if columns else rows


def read_parquet(spark: SparkSession, path: str, columns: Iterable[str] | None = None, where: str | None = None) -> DataFrame:
    """Projection and filter reach the scan."""
    rows = spark.read.parquet(path)
    rows = rows.where(where) if where else rows
    return rows.select(*columns) if columns else rows


def first_rows(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows of an order that is spelled out."""
    return rows.orderBy(*order).limit(n)


def only_ids(rows: DataFrame, ids: DataFrame, column: str = "entity_id") -> DataFrame:
    return rows.join(ids.select(column).distinct(), column, "left_semi")


def pool(*sources: DataFrame, country: str | None = None) -> DataFrame:
    """Union of the noisy sources, of one country if asked."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out.where(F.col("country") == country) if country else out


def truth_edges(lists: DataFrame) -> DataFrame:
    """(s1_id, cand_id) of each ground-truth match; singletons have none."""
    ids = F.transform(F.split(F.coalesce("matched_entity_ids", F.lit("")), ","), lambda x: F.trim(x))
    return lists.select(F.col("source1_entity_id").alias("s1_id"), F.explode(ids).alias("cand_id")).where("cand_id <> ''")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One id a line; blank lines are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("entity_id")).where("entity_id <> ''")


def with_ordinal(spark: SparkSession, path: str, schema: T.StructType = RECORD, name: str = "row") -> DataFrame:
    """A TSV's rows with their position in it, from 0, in the order of the files' names and of the lines in them.

    Rows are numbered within their block of the file, which a split bounds; a block's first position is the sum of those
    before it, of which there is one row a block. So neither a global sort nor one task for all rows is needed.
    """
    rows = read_tsv(spark, path, schema).select("*", F.struct("_metadata.file_path", "_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    rows = materialize(rows, "ordinal")  # the ids stay as they are read once
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_block").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("_block").orderBy("_at")) - 1
    numbered = rows.withColumn("_within", within).join(starts, "_block")
    return numbered.select(*schema.names, (F.col("_start") + F.col("_within")).cast("bigint").alias(name))


def read_model(spark: SparkSession, path: str) -> dict:
    """Feature order, scaler, coefficients, intercept and thresholds, from JSON."""
    model = json.loads(read_text(spark, path))
    n = len(model["features"])
    if not len(model["mean"]) == len(model["scale"]) == len(model["coef"]) == n:
        raise ValueError("the model's lists differ in length")
    return model
