"""Measures of candidate sets and of predictions. Every average is over all S1, those without candidates included."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from erlink.operators import blocking as B
from erlink.operators import postings_scan as S


def n_rows() -> Column:
    return F.count(F.lit(1))


def share(condition: Column) -> Column:
    return F.avg(condition.cast("int"))


def candidate_counts(s1: DataFrame, pairs: DataFrame) -> DataFrame:
    """entity_id, country, n: the candidates of every S1."""
    counted = pairs.groupBy(F.col("s1_id").alias("entity_id")).agg(n_rows().alias("n"))
    return s1.select("entity_id", "country").join(counted, "entity_id", "left").na.fill(0, ["n"])


def _sizes() -> list[Column]:
    """What candidates are measured by, from n of each S1."""
    return [F.round(F.avg("n"), 6).alias("mean_cand"), F.avg("n").alias("_mean"), *(F.expr(f"percentile(n, {p})").alias(f"{x}_cand") for x, p in (("median", 0.5), ("p95", 0.95), ("p99", 0.99))), F.max("n").alias("max_cand")]


def blocking_recall(s1: DataFrame, pool: DataFrame, truth: DataFrame, pairs: DataFrame) -> DataFrame:
    edges = truth.join(pairs.select("s1_id", "cand_id").withColumn("_hit", F.lit(1)), ["s1_id", "cand_id"], "left")
    return _recall(edges, candidate_counts(s1, pairs), pool)


def channel_recall(s1: DataFrame, pool: DataFrame, truth: DataFrame, channels: tuple[B.Channel, ...]) -> DataFrame:
    """blocking_recall of channels: no pair is made."""
    return config_recall(s1, pool, truth, {"": channels}).drop("config")


def config_recall(s1: DataFrame, pool: DataFrame, truth: DataFrame, configs: Mapping[str, tuple[B.Channel, ...]]) -> DataFrame:
    """blocking_recall of each configuration of channels, with its name as config: no pair is made.

    One pass over the posting lists counts each S1's candidates for all configurations; recall is joined by true edge.
    """
    channels, limits = B.united(configs)
    asked, least, n = B.asked(s1, pool, channels), B.least_overlaps(channels), len(configs)
    none = F.array(*[F.lit(0).cast("bigint")] * n)
    counts = asked.scan("s1_id string, n array<bigint>", S.config_counts(least, limits), "counts").withColumnRenamed("s1_id", "entity_id")
    counts = s1.select("entity_id").join(counts, "entity_id", "left").select(F.posexplode(F.coalesce("n", none)).alias("at", "n"))
    within = lambda c, at: (F.col("channel") == c) & (F.col("df") <= limits[c][at][0]) & (F.col("rank") <= limits[c][at][1])
    inside = [F.max(reduce(Column.__or__, (within(c, at) for c in range(len(channels)))).cast("int")) for at in range(n)]
    hits = asked.found(truth, least).groupBy("s1_id", "cand_id").agg(F.array(*inside).alias("hit"))
    found = truth.join(hits, ["s1_id", "cand_id"], "left").agg(n_rows().alias("true_edges"), F.array(*(F.coalesce(F.sum(F.col("hit")[at]), F.lit(0)) for at in range(n))).alias("found"))
    rows = found.select("true_edges", F.posexplode("found").alias("at", "found_edges")).join(counts.groupBy("at").agg(*_sizes()), "at", "left")
    return _recall_row(rows.crossJoin(F.broadcast(pool.agg(n_rows().alias("n_pool")))), F.element_at(F.array(*map(F.lit, configs)), F.col("at") + 1).alias("config"))


def _recall(edges: DataFrame, counts: DataFrame, pool: DataFrame) -> DataFrame:
    found = edges.agg(n_rows().alias("true_edges"), F.count("_hit").alias("found_edges"))
    sizes = counts.agg(*_sizes())
    n_pool = pool.agg(n_rows().alias("n_pool"))
    # Three one-row tables side by side.
    row = found.select("*", F.lit(1).alias("_k")).join(sizes.select("*", F.lit(1).alias("_k")), "_k").join(n_pool.select("*", F.lit(1).alias("_k")), "_k")
    return _recall_row(row)


def _recall_row(row: DataFrame, *first: Column) -> DataFrame:
    return row.select(*first, "true_edges", "found_edges", F.round(F.col("found_edges") / F.col("true_edges"), 6).alias("recall"), "mean_cand", "median_cand", "p95_cand", "p99_cand", "max_cand", F.round(1 - F.col("_mean") / F.col("n_pool"), 6).alias("reduction"))


def scale_projection(s1: DataFrame, pairs: DataFrame, n_s1: int = 1_732_544, id_bytes: int = 13) -> DataFrame:
    mean = candidate_counts(s1, pairs).agg(F.avg("n").alias("m"))
    return mean.select(F.round(F.col("m") * n_s1, 3).alias("pairs"), F.round(F.col("m") * n_s1 * id_bytes / 1e6, 3).alias("file_mb"))


def size_bucket(n: Column) -> Column:
    return F.when(n == 1, "1").when(n <= 3, "2-3").when(n <= 5, "4-5").otherwise("6+")


def entity_retention(s1: DataFrame, truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per size bucket and country: how many S1 keep all, any or none of their true matches."""
    kept = truth.join(pairs.select("s1_id", "cand_id").withColumn("_hit", F.lit(1)), ["s1_id", "cand_id"], "left").groupBy("s1_id").agg(n_rows().alias("n_true"), F.count("_hit").alias("kept"))
    rows = kept.join(s1.select(F.col("entity_id").alias("s1_id"), "country"), "s1_id")
    all_, any_ = F.col("kept") == F.col("n_true"), F.col("kept") > 0
    return rows.groupBy(size_bucket(F.col("n_true")).alias("bucket"), "country").agg(
        n_rows().alias("n_s1"), F.round(100 * share(all_), 6).alias("pct_all"), F.round(100 * share(any_), 6).alias("pct_any"), F.round(100 * share(~any_), 6).alias("pct_none"), F.round(F.avg(F.when(~all_, F.col("n_true") - F.col("kept"))), 6).alias("missed_per_affected")
    )


def channel_attribution(truth: DataFrame, pairs: DataFrame, names: Sequence[str], addresses: Sequence[str]) -> DataFrame:
    rows = truth.join(pairs, ["s1_id", "cand_id"], "left")
    side = lambda group: F.coalesce(F.greatest(*(F.col(f"from_{c}") for c in group)), F.lit(0)) == 1
    n, a = side(names), side(addresses)
    return rows.agg(F.count_if(n & ~a).alias("name_only"), F.count_if(a & ~n).alias("address_only"), F.count_if(n & a).alias("both_sides"), F.count_if(~n & ~a).alias("neither"))


def exclusive_contribution(truth: DataFrame, pairs: DataFrame, channel: str) -> DataFrame:
    flags = [c for c in pairs.columns if c.startswith("from_")]
    alone = (F.col(f"from_{channel}") == 1) & (sum((F.col(f) for f in flags), F.lit(0)) == 1)
    return truth.join(pairs.where(alone), ["s1_id", "cand_id"], "left_semi").agg(n_rows().alias(f"only_{channel}"))


@dataclass(frozen=True)
class Sweep:
    """A grid of limits (ascending) on df or rank of one channel's tokens, which takes as much as the last of them."""

    name: str
    channel: B.Channel
    limit: str
    grid: tuple[int, ...]


def sweeps(s1: DataFrame, pool: DataFrame, truth: DataFrame, of: Sequence[Sweep]) -> DataFrame:
    """sweep (name), value, n_pairs, recall: what each limit admits. One pass over the posting lists for all sweeps.

    A pair counts from its least value on, so each S1 gives one number per limit, the pairs that first fit it; no pair is
    made. Ranks go by frequency, so the k rarest under a smaller max_df are a prefix. Recall is joined by true edge.
    """
    channels = tuple(s.channel for s in of)
    asked, spark = B.asked(s1, pool, channels), s1.sparkSession
    counts = asked.scan("n array<bigint>", S.first_counts(tuple(((1 if s.limit == "rank" else 2), s.grid) for s in of)), "total")
    n = counts.select(F.posexplode("n").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n"))
    points = spark.createDataFrame([(i, c, s.name, g) for i, (c, s, g) in enumerate((c, s, g) for c, s in enumerate(of) for g in s.grid)], "at int, channel int, sweep string, value int")
    edges = asked.found(truth, B.least_overlaps(channels)).select("channel", F.when(F.col("channel").isin([i for i, s in enumerate(of) if s.limit == "rank"]), F.col("rank")).otherwise(F.col("df")).alias("v"))
    hits = edges.groupBy("channel", "v").agg(n_rows().alias("k"))
    k = points.join(hits, "channel").where("v <= value").groupBy("at").agg(F.sum("k").alias("k"))
    upto = Window.partitionBy("sweep").orderBy("value")
    rows = points.join(n, "at", "left").join(k, "at", "left").na.fill(0, ["n", "k"]).withColumn("n_pairs", F.sum("n").over(upto))
    return rows.select("sweep", "value", "n_pairs", F.round(F.col("k") / truth.agg(n_rows()).scalar(), 6).alias("recall"))


def elbow(sweeps: DataFrame, portion: float = 0.99) -> DataFrame:
    """Per sweep, the least value that reaches portion of the best recall."""
    best = sweeps.withColumn("best", F.max("recall").over(Window.partitionBy("sweep")))
    return best.where(F.col("recall") >= portion * F.col("best")).groupBy("sweep").agg(F.min("value").alias("elbow"))


def candidate_stats(s1: DataFrame, pairs: DataFrame) -> DataFrame:
    return candidate_counts(s1, pairs).groupBy("country").agg(
        F.round(F.avg("n"), 6).alias("mean_cand"), F.expr("percentile(n, 0.5)").alias("p50"), F.expr("percentile(n, 0.9)").alias("p90"), F.expr("percentile(n, 0.99)").alias("p99"), F.max("n").alias("max_cand"), F.round(100 * share(F.col("n") == 0), 6).alias("pct_zero")
    )


def recall_by_country(s1: DataFrame, truth: DataFrame, pairs: DataFrame) -> DataFrame:
    rows = truth.join(s1.select(F.col("entity_id").alias("s1_id"), "country"), "s1_id").join(pairs.withColumn("_hit", F.lit(1)), ["s1_id", "cand_id"], "left")
    return rows.groupBy("country").agg(n_rows().alias("true_edges"), F.round(share(F.col("_hit").isNotNull()), 6).alias("recall"), F.count_if(F.col("from_b1") == 1).alias("by_name"), F.count_if(F.col("from_b5") == 1).alias("by_address"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b).select(F.lit("left").alias("side"), "*").unionByName(b.subtract(a).select(F.lit("right").alias("side"), "*"))


def entity_scores(entities: DataFrame, predicted: DataFrame) -> DataFrame:
    """entities with n_pred, tp, p, r and f: F0.5 per S1. Both empty: 1, 1, 1; only predictions empty: 1, 0, 0; only truth empty: 0, 1, 0.

    entities: s1_id, country, n_true. predicted: s1_id, label of each predicted pair.
    """
    counts = predicted.groupBy("s1_id").agg(n_rows().alias("n_pred"), F.sum("label").alias("tp"))
    rows = entities.join(counts, "s1_id", "left").na.fill(0, ["n_pred", "tp"])
    t, n, k = F.col("n_true"), F.col("n_pred"), F.col("tp")
    p = F.when(n > 0, k / n).otherwise(1.0)
    r = F.when(t > 0, k / t).otherwise(1.0)
    rows = rows.withColumn("p", p).withColumn("r", r)
    f = F.when((t == 0) & (n == 0), 1.0).when((t == 0) | (n == 0) | (k == 0), 0.0).otherwise(1.25 * F.col("p") * F.col("r") / (0.25 * F.col("p") + F.col("r")))
    return rows.withColumn("f", f)


def macro(scores: DataFrame, *by: str) -> DataFrame:
    return scores.groupBy(*by).agg(n_rows().alias("n_s1"), F.round(F.avg("p"), 6).alias("macro_p"), F.round(F.avg("r"), 6).alias("macro_r"), F.round(F.avg("f"), 6).alias("macro_f"))


def full_evaluation(scores: DataFrame, claims: DataFrame) -> DataFrame:
    """One row: macro averages, singletons, empty predictions, multi-match figures and candidates claimed more than once."""
    single, multi, none = F.col("n_true") == 0, F.col("n_true") >= 2, F.col("n_pred") == 0
    row = scores.agg(
        F.round(F.avg("f"), 6).alias("macro_f"), F.round(F.avg("p"), 6).alias("macro_p"), F.round(F.avg("r"), 6).alias("macro_r"),
        F.count_if(single).alias("n_singleton"), F.count_if(single & none).alias("singleton_empty"), F.round(100 * F.avg(F.when(single, (~none).cast("int"))), 6).alias("singleton_fp_pct"),
        F.count_if(~single & none).alias("matched_zero_pred"), F.round(F.avg("n_pred"), 6).alias("avg_pred"), F.round(F.avg(F.when(~single, F.col("f"))), 6).alias("matched_only_f"),
        F.count_if(multi).alias("n_multi"), F.round(F.avg(F.when(multi, F.col("r"))), 6).alias("multi_recall"), F.round(F.avg(F.when(multi, F.col("n_pred"))), 6).alias("multi_avg_pred"), F.count_if(multi & (F.col("n_pred") >= 2)).alias("multi_2plus"),
    )
    return row.select("*", claims.agg(F.count_if(F.col("n_s1") > 1)).scalar().alias("duplicate_claims"))


def claims(predicted: DataFrame) -> DataFrame:
    """cand_id, n_s1: by how many S1 each candidate is predicted."""
    return predicted.groupBy("cand_id").agg(F.count_distinct("s1_id").alias("n_s1"))


def auc(rows: DataFrame, score: str, positive: str, step: float = 0.01) -> DataFrame:
    """Mann-Whitney AUC with average ranks, from counts per distinct score.

    Counts below a score are sums in two levels: over buckets of width step, of which there are few, and within a
    bucket. So no task holds all distinct scores.
    """
    by_score = rows.where(F.col(score).isNotNull()).groupBy(score).agg(F.sum(positive).alias("pos"), F.sum(1 - F.col(positive)).alias("neg")).withColumn("_b", F.floor(F.col(score) / step))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = by_score.groupBy("_b").agg(F.sum("neg").alias("_n")).withColumn("_below", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    order = Window.partitionBy("_b").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranked = by_score.join(buckets, "_b").withColumn("below", F.col("_below") + F.coalesce(F.sum("neg").over(order), F.lit(0)))
    total = ranked.agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("wins"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return total.select("n_pos", "n_neg", F.round(F.col("wins") / (F.col("n_pos") * F.col("n_neg")), 6).alias("auc"))


def bootstrap(deltas: DataFrame, column: str, n: int = 2000, seed: int = 42) -> dict:
    """Paired bootstrap of a mean: resamples of one number per S1, drawn on the driver as multinomial counts of distinct values.

    Deltas of F0.5 take few values, so only their counts are collected; they are rounded to a millionth, which bounds them.
    """
    counted = deltas.groupBy(F.round(column, 6).alias("d")).agg(n_rows().alias("n")).orderBy("d").collect()
    values, weights = np.array([r["d"] for r in counted]), np.array([r["n"] for r in counted])
    size = int(weights.sum())
    draws = np.random.default_rng(seed).multinomial(size, weights / size, n) @ values / size
    low, high = np.percentile(draws, [2.5, 97.5])
    return {"delta": float(weights @ values / size), "low": float(low), "high": float(high), "p_not_better": float((draws <= 0).mean())}


def weighted_mean(reference: DataFrame, other: DataFrame, z: str, value: str, edges: Sequence[float]) -> DataFrame:
    """Mean of value over other, its rows weighted so that their bins of z are spread as the reference's."""
    inner = lambda rows: rows.where((F.col(z) > edges[0]) & (F.col(z) <= edges[-1]))
    bin_of = sum(((F.col(z) > e).cast("int") for e in edges[1:-1]), F.lit(0))
    a = inner(reference).groupBy(bin_of.alias("bin")).agg(n_rows().alias("a"))
    b = inner(other).groupBy(bin_of.alias("bin")).agg(n_rows().alias("b"), F.avg(value).alias("v"))
    joined = b.join(a, "bin")  # bins that one side lacks weigh nothing
    return joined.agg(F.round(F.sum(F.col("a") * F.col("v")) / F.sum("a"), 6).alias("weighted_mean"), F.sum("b").cast("bigint").alias("n_other"))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))
