"""Profiles of fields and ground truth, and forensics of errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from erlink.functions import text as X
from erlink.operators.metrics import n_rows, share


def field_profile(rows: DataFrame, field: str) -> DataFrame:
    """One row: n, missing and unique percentages, duplicates, lengths in characters and tokens of what is there."""
    value, there = F.col(field), F.coalesce(F.col(field), F.lit("")) != ""
    length, tokens = F.when(there, F.length(value)), F.when(there, F.size(X.profile_tokens(value)))
    rows = rows.select(value.alias(field), there.alias("_there"), length.alias("_len"), tokens.alias("_tok"))
    return rows.agg(
        n_rows().alias("n"), F.round(100 * share(~F.col("_there")), 6).alias("missing_pct"), F.count_distinct(F.when(F.col("_there"), F.col(field))).alias("n_unique"),
        F.round(F.avg("_len"), 6).alias("mean_chars"), F.expr("percentile(_len, 0.5)").alias("median_chars"), F.expr("percentile(_len, 0.95)").alias("p95_chars"), F.max("_len").cast("bigint").alias("max_chars"), F.round(F.avg("_tok"), 6).alias("mean_tokens"), F.expr("percentile(_tok, 0.5)").alias("median_tokens"),
    ).withColumn("n_duplicate", (F.col("n") * (100 - F.col("missing_pct")) / 100 - F.col("n_unique")).cast("bigint"))


def top_tokens(rows: DataFrame, field: str, n: int = 30) -> DataFrame:
    counted = rows.select(F.explode(X.profile_tokens(F.col(field))).alias("token")).groupBy("token").agg(n_rows().alias("n"))
    return counted.orderBy(F.desc("n"), "token").limit(n)


def distribution(rows: DataFrame, field: str) -> DataFrame:
    counted = rows.groupBy(field).agg(n_rows().alias("n"))
    return counted.select(field, "n", F.round(100 * F.col("n") / rows.agg(n_rows()).scalar(), 6).alias("pct"))


def summary(rows: DataFrame, field: str, *by: str) -> DataFrame:
    there = F.col(field)
    return rows.groupBy(*by).agg(F.round(F.avg(there), 6).alias("mean"), F.expr(f"percentile({field}, 0.5)").alias("median"), F.expr(f"percentile({field}, 0.1)").alias("p10"), F.expr(f"percentile({field}, 0.9)").alias("p90"), F.round(100 * share(there.isNull()), 6).alias("missing_pct"))


def truth_profile(s1: DataFrame, pool: DataFrame, truth: DataFrame) -> DataFrame:
    """One row about the edges: singletons, matches per matched S1, shares of the sources, ids that no source has."""
    n = s1.select(F.col("entity_id").alias("s1_id")).join(truth.groupBy("s1_id").agg(n_rows().alias("n")), "s1_id", "left").na.fill(0, ["n"])
    row = n.agg(n_rows().alias("n_s1"), F.count_if(F.col("n") == 0).alias("n_singleton"), F.round(F.avg(F.when(F.col("n") > 0, F.col("n"))), 6).alias("mean_matches"), F.max("n").alias("max_matches"))
    edges = truth.agg(n_rows().alias("n_edges"), F.count_if(F.col("cand_id").startswith("S2-")).alias("s2_edges"), F.count_if(F.col("cand_id").startswith("S3-")).alias("s3_edges"), F.count_if(F.col("cand_id") == F.col("s1_id")).alias("self_edges"))
    unknown = truth.join(pool.select(F.col("entity_id").alias("cand_id")), "cand_id", "left_anti").agg(n_rows().alias("unknown_ids"))
    one = lambda rows: rows.withColumn("_k", F.lit(1))
    return one(row).join(one(edges), "_k").join(one(unknown), "_k").drop("_k")


def claimed_twice(truth: DataFrame) -> DataFrame:
    return truth.groupBy("cand_id").agg(F.count_distinct("s1_id").alias("n_s1")).where("n_s1 > 1")


def country_agreement(s1: DataFrame, pool: DataFrame, truth: DataFrame) -> DataFrame:
    rows = truth.join(s1.select(F.col("entity_id").alias("s1_id"), F.col("country").alias("c1")), "s1_id").join(pool.select(F.col("entity_id").alias("cand_id"), F.col("country").alias("c2")), "cand_id")
    return rows.groupBy("c1", "c2").agg(n_rows().alias("n"))


def idf(df: Column, n: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def token_idf(pool: DataFrame, column: str) -> DataFrame:
    """country, token, df, idf over the pool's records."""
    sizes = pool.groupBy("country").agg(n_rows().alias("n"))
    tokens = pool.select("country", F.explode(X.tokens(F.col(column))).alias("token")).groupBy("country", "token").agg(n_rows().alias("df"))
    return tokens.join(sizes, "country").select("country", "token", "df", idf(F.col("df"), F.col("n")).alias("idf"))


def value_frequency(records: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """How many pool records share each wanted (country, value)."""
    return records.join(wanted.select("country", column).distinct(), ["country", column], "left_semi").groupBy("country", column).agg(n_rows().alias("n"))


def pair_rarity(pairs: DataFrame, idfs: DataFrame, column: str) -> DataFrame:
    """Per pair (hydrated with country and column): summed and greatest IDF of shared tokens, IDF-weighted Jaccard, and the same of what differs.

    Tokens that no pool record has count as df 0 is not possible here: the candidate's tokens are pool tokens; an S1's
    unseen tokens have no weight.
    """
    a, b = X.tokens(F.col(f"{column}_1")), X.tokens(F.col(f"{column}_2"))
    rows = pairs.select("s1_id", "cand_id", F.col("country_1").alias("country"), F.explode(F.array_union(a, b)).alias("token"), a.alias("a"), b.alias("b"))
    rows = rows.withColumn("shared", F.array_contains("a", F.col("token")) & F.array_contains("b", F.col("token"))).join(idfs, ["country", "token"])
    s = lambda c: F.when(F.col("shared"), F.col(c))
    d = F.when(~F.col("shared"), F.col("idf"))
    return rows.groupBy("s1_id", "cand_id").agg(
        F.round(F.coalesce(F.sum(s("idf")), F.lit(0.0)), 6).alias("shared_idf_sum"), F.round(F.coalesce(F.max(s("idf")), F.lit(0.0)), 6).alias("shared_idf_max"), F.min(s("df")).alias("shared_min_df"),
        F.round(F.coalesce(F.sum(s("idf")), F.lit(0.0)) / F.sum("idf"), 6).alias("idf_jaccard"), F.round(F.coalesce(F.max(d), F.lit(0.0)), 6).alias("diff_idf_max"),
    )


def number_pattern(a: Column, b: Column, address_1: Column, address_2: Column) -> Column:
    """Class of two sets of number tokens."""
    both, x, y = F.size(F.array_intersect(a, b)), F.size(a), F.size(b)
    return (
        F.when(address_2 == "", "cand_addr_missing").when(address_1 == "", "s1_addr_missing").when((x == 0) & (y == 0), "no_numbers").when((both == x) & (both == y), "equal")
        .when(x == 0, "cand_adds_number").when(y == 0, "cand_drops_number").when(both == x, "cand_superset").when(both == y, "cand_subset").otherwise("differ")
    )


def name_pattern(a: Column, b: Column) -> Column:
    """Class of two sets of core name tokens."""
    more, less = F.size(F.array_except(b, a)), F.size(F.array_except(a, b))
    return F.when((more == 0) & (less == 0), "core_equal").when(less == 0, "cand_adds_token").when(more == 0, "cand_drops_token").otherwise("token_substituted")


def categorized(pairs: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """num_pattern, name_pattern and one category per pair: the first rule that holds; overrides (s1_id, override) win."""
    n1, n2, c1, c2 = X.number_tokens(F.col("address_norm_1")), X.number_tokens(F.col("address_norm_2")), X.core_tokens(F.col("name_norm_1")), X.core_tokens(F.col("name_norm_2"))
    rows = pairs.withColumn("num_pattern", number_pattern(n1, n2, F.col("address_norm_1"), F.col("address_norm_2"))).withColumn("name_pattern", name_pattern(c1, c2)).withColumn("_shared", F.size(F.array_intersect(c1, c2)))
    changed = F.col("num_pattern").isin("differ", "cand_superset", "cand_subset", "cand_adds_number", "cand_drops_number")
    category = F.when(F.col("num_pattern") == "cand_addr_missing", "candidate_address_missing").when(F.col("_shared") == 0, "shared_address").when(changed, "number_changed").when(F.col("name_pattern").isin("cand_adds_token", "token_substituted"), "name_token_changed").otherwise("possible_truth_omission")
    rows = rows.withColumn("category", category).drop("_shared")
    if overrides is None:
        return rows
    return rows.join(overrides, "s1_id", "left").withColumn("category", F.coalesce("override", "category")).drop("override")


def miss_tags(pairs: DataFrame) -> DataFrame:
    """tags: why a true pair may have been missed, as an array."""
    n1, n2, a1, a2 = (F.col(x) for x in ("name_norm_1", "name_norm_2", "address_norm_1", "address_norm_2"))
    t1, t2, u1, u2 = X.tokens(n1), X.tokens(n2), X.tokens(a1), X.tokens(a2)
    union = F.size(F.array_union(t1, t2))
    jaccard = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(t1, t2)) / union)
    found = F.array(
        F.when(jaccard < 0.15, F.lit("alias")), F.when((a1 == "") | (a2 == ""), F.lit("address_missing")), F.when((a1 != "") & (a2 != "") & (F.size(F.array_intersect(u1, u2)) == 0), F.lit("address_unrelated")), F.when((n1 != "") & (n2 != "") & (n1 != n2) & (jaccard >= 0.5), F.lit("name_variation"))
    )
    tags = F.array_compact(found)
    return pairs.withColumn("tags", F.when(F.size(tags) == 0, F.array(F.lit("other"))).otherwise(tags))


def first_per_group(rows: DataFrame, group: str, order: list, n: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
