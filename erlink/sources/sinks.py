"""Writers: id-list files, compressed Parquet, ordered single files, manifests."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import resource
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def id_lists(s1: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """One row per S1: its candidates' ids, sorted as text and comma-joined; empty when there are none."""
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("cand_id")), ",").alias(name))
    out = s1.select(F.col("entity_id").alias("source1_entity_id")).join(lists, F.col("source1_entity_id") == F.col("s1_id"), "left")
    return out.select("source1_entity_id", F.coalesce(name, F.lit("")).alias(name))


def write_parquet(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Zstandard Parquet; the committer publishes files only when the job has succeeded."""
    writer = rows.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_tsv(rows: DataFrame, path: str, order: str | None = None) -> None:
    """Unquoted tab-separated text with a header in every part file; with order, parts follow it by name."""
    columns = [c for c in rows.columns if c != order]
    ordered = rows.orderBy(order).select(*columns) if order else rows.select(*columns)
    ordered.write.mode("overwrite").options(sep="\t", header=True, quote="", emptyValue="", nullValue="").csv(path)


def _open(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path: any store that Spark reaches, not the driver's disk alone."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def parts_of(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _open(spark, folder)
    return sorted(f.getPath().toString() for f in fs.listStatus(p) if f.getPath().getName().startswith("part-"))


def _digested(spark: SparkSession, out):
    digest = spark._jvm.java.security.MessageDigest.getInstance("SHA-256")
    return digest, spark._jvm.java.security.DigestOutputStream(out, digest)


def _copy(spark: SparkSession, source: str, out, skip: int = 0) -> None:
    """Streams a file inside the JVM, in blocks."""
    fs, p = _open(spark, source)
    stream = fs.open(p)
    try:
        stream.seek(skip)
        spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
    finally:
        stream.close()


def _first_line(spark: SparkSession, path: str) -> bytes:
    fs, p = _open(spark, path)
    stream = fs.open(p)
    try:
        line = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
    finally:
        stream.close()
    return b"" if line is None else (line + "\n").encode()


def publish(spark: SparkSession, temporary: str, target: str) -> None:
    """Renames a finished file over the target; readers see the old file or the new one."""
    fs, p = _open(spark, target)
    fs.delete(p, False)
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(temporary), p):
        raise OSError(f"cannot publish {target}")


def merge_parts(spark: SparkSession, folder: str, target: str) -> str:
    """Joins the part files of an ordered folder, in name order and with one header, publishes the file and returns its SHA-256."""
    parts, temporary = parts_of(spark, folder), f"{target}.tmp"
    fs, p = _open(spark, temporary)
    digest, out = _digested(spark, fs.create(p, True))
    try:
        seen = False
        for part in parts:
            head = _first_line(spark, part)
            _copy(spark, part, out, len(head) if seen else 0)
            seen = seen or bool(head)
    finally:
        out.close()
    publish(spark, temporary, target)
    return bytes(digest.digest()).hex()


def sha256_of(spark: SparkSession, path: str) -> str:
    digest, out = _digested(spark, spark._jvm.java.io.OutputStream.nullOutputStream())
    _copy(spark, path, out)
    return bytes(digest.digest()).hex()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, published at once."""
    fs, p = _open(spark, f"{path}.tmp")
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    publish(spark, f"{path}.tmp", path)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, whole."""
    fs, p = _open(spark, path)
    stream, held = fs.open(p), spark._jvm.java.io.ByteArrayOutputStream()
    try:
        spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, held, 1 << 16, False)
    finally:
        stream.close()
    return bytes(held.toByteArray()).decode()


def fingerprint(spark: SparkSession, *inputs: str) -> dict:
    """Versions, and digests of the engine's code and of the inputs (files, or folders of part files)."""
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = {}
    for folder, _, names in sorted(os.walk(package)):
        for name in sorted(names):
            if name.endswith(".py"):
                path = os.path.join(folder, name)
                with open(path, "rb") as f:
                    code[os.path.relpath(path, package)] = hashlib.sha256(f.read()).hexdigest()
    files = {}
    for path in inputs:
        fs, p = _open(spark, path)
        for part in parts_of(spark, path) if fs.getFileStatus(p).isDirectory() else [path]:
            files[part.rsplit("/", 1)[-1] if part == path else "/".join(part.rsplit("/", 2)[1:])] = sha256_of(spark, part)
    return {"python": platform.python_version(), "spark": spark.version, "code": code, "inputs": files}


def telemetry(spark: SparkSession) -> dict:
    """What the stages of this application have taken so far, and the driver's peak memory."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    rows = [stages.apply(i) for i in range(stages.size())]
    total = lambda f: sum(getattr(r, f)() for r in rows)
    return {
        "stages": len(rows), "tasks": total("numCompleteTasks"), "failed_tasks": total("numFailedTasks"), "run_seconds": total("executorRunTime") / 1e3, "cpu_seconds": total("executorCpuTime") / 1e9,
        "shuffle_bytes": total("shuffleWriteBytes"), "spilled_bytes": total("diskBytesSpilled"), "driver_peak_mb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024,
    }


@contextmanager
def manifest(spark: SparkSession, path: str, **known):
    """A JSON report of a run, written also when it fails; the body may add to the yielded dict."""
    report, began = dict(known), time.time()
    report["status"] = "running"
    try:
        yield report
        if report["status"] == "running":
            report["status"] = "success"
    except BaseException as error:
        report |= {"status": "failure", "error": f"{type(error).__name__}: {error}"[:2000]}
        raise
    finally:
        report["seconds"] = round(time.time() - began, 3)
        report["telemetry"] = telemetry(spark)
        write_text(spark, path, json.dumps(report, indent=2, sort_keys=True))
