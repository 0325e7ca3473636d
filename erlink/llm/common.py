"""Shared pieces of the corpus operators: scratch tables in the cluster's shared folder and Arrow mapping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word, everywhere in this subpackage: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: A broadcast is used only for tables counted to be at most this many bytes; beyond it, a shuffle join.
BROADCAST_BYTES = 16 << 20


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in tests (unset) a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="erlink-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/erlink-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, sort: list[str] | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    (df.sortWithinPartitions(*sort) if sort else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its counted rows stay within BROADCAST_BYTES, else df as it is."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with a function made once per task, so that models load once and batches stay bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            if batch.num_rows:
                yield one(batch)

    return df.mapInArrow(run, schema)


def neutral(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns named c_0, c_1 and so on, which no column of an operator is named, and each one's new name.

    toDF(*docs.columns) names them back. So columns that an operator does not know may have any name.
    """
    names = {c: f"c_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def hash_bucket(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
