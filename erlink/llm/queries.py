"""Registered queries of the corpus operators: name -> (spark, sf_dir) -> DataFrame, and DuckDB SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erlink.llm import ann, bpe, html_extract, langid, mixing, ngram_join, pii, quality, url_filter, warc
from erlink.llm.common import materialize, table

TOKENIZER = "byte_bpe_50k.tiktoken"


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).drop("root", "text_hash")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs), keep=["doc_id"])
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "lang_mix")


def op4_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger is written once; two policies and the ablation of the second are read off its bits."""
    entries = materialize(quality.ledger(table(spark, sf_dir, "documents")), "quality-ledger")
    first, policy = quality.POLICIES["v1"], quality.POLICIES["v2"]
    alone = {r["rule"]: r["n_failed_alone"] for r in quality.ablation(entries, policy).collect()}  # a row a rule
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality.fails(quality.Policy("base", quality.BASE)).alias("base_failed"), (~quality.fails(policy)).alias("kept"),
        "fail_bits", (~quality.fails(first)).alias("kept_v1"), quality.only_failed(policy).alias("fails_alone"), *(F.lit(alone.get(r, 0)).cast("bigint").alias(f"n_alone_{r}") for r in policy.rules),
    )


def op7_pii_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op10_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_mix_sources": op2_mix_sources,
    "op3_language_mixture": op3_language_mixture,
    "op4_kmeans_tree": op4_kmeans_tree,
    "op5_wrapper_induction": op5_wrapper_induction,
    "op6_quality_ledger": op6_quality_ledger,
    "op7_pii_weak_labels": op7_pii_weak_labels,
    "op8_warc_index": op8_warc_index,
    "op9_url_filter": op9_url_filter,
    "op10_bpe_tree": op10_bpe_tree,
}

_V2 = quality.POLICIES["v2"]
ORACLES = {
    "op2_mix_sources": mixing.oracle(),
    "op6_quality_ledger": rf"""
with d as (select row_number() over () rid, doc_id, coalesce(text, '') txt from documents),
w as (select rid, doc_id, txt, regexp_extract_all(txt, '[^\x20\x09-\x0D]+') ws from d),
win as (select rid, unnest(range(1, len(ws) - 6)) i, ws from w where len(ws) >= 9),
keyed as (select rid, i, array_to_string(ws[i:i+7], ' ') k from win),
twice as (select rid, i from (select rid, i, count(*) over (partition by rid, k) c from keyed) where c > 1),
covered as (select rid, count(distinct p) n from (select rid, unnest(range(i, i + 8)) p from twice) group by rid),
lines as (select rid, count(*) n_lines, count(*) - count(distinct l) dup from
  (select rid, unnest(string_split(txt, chr(10))) l from d) where regexp_matches(l, '[^\x20\x09-\x0D]') group by rid),
m as (select doc_id, len(ws)::bigint n_words,
  length(regexp_replace(txt, '[\x20\x09-\x0D]', '', 'g'))::bigint word_chars,
  (length(txt) - length(regexp_replace(txt, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
  coalesce(dup, 0)::bigint n_dup_lines, coalesce(covered.n, 0)::bigint n_repeat_words, coalesce(n_lines, 0)::bigint n_lines
  from w left join covered using (rid) left join lines using (rid)),
b as (select *, ({" + ".join(f"(case when {sql} then {quality.bit(name)} else 0 end)" for name, sql in quality.RULES)})::bigint fail_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (fail_bits & {quality.Policy("base", quality.BASE).mask}) <> 0 base_failed, (fail_bits & {_V2.mask}) = 0 kept, fail_bits, (fail_bits & {quality.POLICIES["v1"].mask}) = 0 kept_v1,
  case fail_bits & {_V2.mask} {" ".join(f"when {quality.bit(r)} then '{r}'" for r in _V2.rules)} end fails_alone,
  {", ".join(f"(select count(*) from b where (fail_bits & {_V2.mask}) = {quality.bit(r)})::bigint n_alone_{r}" for r in _V2.rules)} from b""",
    "op8_warc_index": warc.ORACLE,
    "op9_url_filter": url_filter.oracle(),
}
