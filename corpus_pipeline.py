"""The corpus pipeline: five stages over documents, each a corpus operator whose decisions take effect.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that run() writes as Parquet to the shared folder and
reads again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erlink.llm import bpe, langid, mixing, ngram_join, pii
from erlink.llm.common import materialize, neutral, small, table

TOKENIZER = "byte_bpe_50k.tiktoken"
#: Documents whose best language explains less than this are rejected: mixtures of several, or too little text to tell.
LEAST_SCORE = 0.3

ORACLE_SQL = None  # EM and the learned classifiers have no SQL; tests hold the stages against brute force


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language; those without a letter, or without one prevailing language, go."""
    plain, names = neutral(docs)
    found = langid.identify(plain, langid.fit(docs), names["text"])
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*plain.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that links of the n-gram join connect: the one with the smallest id.

    Of different texts of a group with that id, and of rows that repeat id and text, one stays: the least. A text without
    words is a group of its own. Rows without an id cannot be named as copies; they stay.
    """
    plain, names = neutral(docs)
    key, rest = names["doc_id"], [c for c in plain.columns if c != names["doc_id"]]
    found = ngram_join.join(docs).where("doc_id is not null").select("doc_id", "text_hash", F.coalesce("root", F.encode(F.col("doc_id").cast("string"), "utf-8")).alias("root"))
    found = materialize(found, "pipeline-classes")
    rows = found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    least = found.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("least")).select("least.*").distinct()
    kept = materialize(least.join(rows, ["doc_id", "text_hash"]).select(F.col("doc_id").alias("k"), F.col("text_hash").alias("h"), "n"), "pipeline-kept")
    # The texts are not shuffled but where the list of those kept is too long to broadcast, and where rows repeat id and text.
    marked = plain.withColumn("h", F.xxhash64(F.col(names["text"]).cast("string")))
    ours = marked.join(small(kept, kept.count(), 64), (marked[key] == kept["k"]) & (marked["h"] == kept["h"])).drop(kept["h"])
    once = ours.where("n = 1").select(*plain.columns)
    repeated = ours.where("n > 1").groupBy(key, "h").agg(F.min(F.struct(*rest)).alias("row")).select(key, "row.*").select(*plain.columns)
    return once.unionByName(repeated).unionByName(plain.where(F.col(key).isNull())).toDF(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; n_chars follows."""
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("bigint")).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else masked


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes its words, to the nearest whole number: up to 3 times, or not at all.

    Rows of one id, or without one, are repeated alike: as often as the one that is repeated most.
    """
    plain, names = neutral(docs)
    counts = mixing.mix(docs).where("taken > 0").select("doc_id", F.expr("cast(round(taken / size) as int)").alias("times")).where("times > 0")
    counts = materialize(counts.groupBy("doc_id").agg(F.max("times").alias("times")), "pipeline-times")
    counts = small(counts, counts.count(), 64)
    both = plain.join(counts, plain[names["doc_id"]].eqNullSafe(counts["doc_id"]))
    return both.select(*plain.columns, F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select(*plain.columns).toDF(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids' count and digests of every document."""
    return bpe.encode_digests(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mixture", source_mixture),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
