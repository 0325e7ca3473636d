"""Decision rules over scored pairs (s1_id, cand_id, z, label, ...): which candidates each S1 accepts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from erlink.operators.metrics import n_rows

#: Thresholds of the final rule, and the grid of the sweeps.
T_HIGH, T_LOW = 8.3, 3.0
GRID_FIRST, GRID_STEP, GRID_POINTS = 3.0, 0.1, 131
#: Cut-offs of the counts that describe an S1.
CUTOFFS = (4, 6, 8, 10, 12)


def by_score() -> Window:
    return Window.partitionBy("s1_id").orderBy(F.desc("z"), "cand_id")


def ranked(pairs: DataFrame) -> DataFrame:
    """rank within the S1 (highest z first, then id), z1 and z2: its two highest scores; z2 is -infinity for a lone pair."""
    rows = pairs.withColumn("rank", F.row_number().over(by_score()))
    whole = Window.partitionBy("s1_id")
    second = F.max(F.when(F.col("rank") == 2, F.col("z"))).over(whole)
    return rows.withColumn("z1", F.max("z").over(whole)).withColumn("z2", F.coalesce(second, F.lit(float("-inf"))))


def profiles(pairs: DataFrame) -> DataFrame:
    """One row per S1: top scores, the top pair's attributes, how many pairs reach each cut-off."""
    top = ranked(pairs)
    of_top = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c))).alias(f"top_{c}")
    return top.groupBy("s1_id").agg(
        F.max("z1").alias("z1"), F.max("z2").alias("z2"), (F.max("z1") - F.max("z2")).alias("margin"), n_rows().alias("n_cand"), of_top("name_exact"), of_top("n_channels"), of_top("label"), F.max("addr_missing").alias("addr_missing"), *(F.count_if(F.col("z") >= c).alias(f"n_ge{c}") for c in CUTOFFS)
    )


def gate_features(pairs: DataFrame) -> DataFrame:
    """Features of the singleton gate: scores with -10 for missing ones, counts as log(1 + n)."""
    p = profiles(pairs)
    real = lambda c: F.when(F.col(c) > float("-inf"), F.col(c)).otherwise(-10.0)
    return p.select("s1_id", real("z1").alias("z1"), real("z2").alias("z2"), (real("z1") - real("z2")).alias("margin"), F.log1p("n_cand").alias("log_n_cand"), "top_name_exact", "top_n_channels", "addr_missing", *(F.log1p(f"n_ge{c}").alias(f"log_n_ge{c}") for c in CUTOFFS))


def rule_a(pairs: DataFrame, t: float) -> DataFrame:
    return pairs.where(F.col("z") >= t)


def rule_b1(pairs: DataFrame, t: float, high: float) -> DataFrame:
    """t if a pair with an exact name reaches t, else high."""
    exact = F.max(F.when(F.col("z") >= t, F.col("name_exact"))).over(Window.partitionBy("s1_id"))
    return pairs.withColumn("_exact", exact).where(F.col("z") >= F.when(F.col("_exact") == 1, t).otherwise(high)).drop("_exact")


def rule_b2(pairs: DataFrame, t: float, high: float) -> DataFrame:
    return pairs.where(F.col("z") >= F.when(F.col("addr_missing") == 1, high).otherwise(t))


def rule_b3(pairs: DataFrame, gate: DataFrame, cut: float, t: float, high: float) -> DataFrame:
    """high where the singleton gate's probability (s1_id, gate) is at least cut."""
    return pairs.join(gate, "s1_id").where(F.col("z") >= F.when(F.col("gate") >= cut, high).otherwise(t)).drop("gate")


def rule_c1(pairs: DataFrame, t: float, first: float) -> DataFrame:
    return ranked(pairs).where((F.col("z1") >= first) & (F.col("z") >= t)).drop("rank", "z1", "z2")


def rule_c2(pairs: DataFrame, t: float, first: float, margin: float) -> DataFrame:
    return ranked(pairs).where((F.col("z1") >= first) & (F.col("z1") - F.col("z2") >= margin) & (F.col("z") >= t)).drop("rank", "z1", "z2")


def rule_h1(pairs: DataFrame, t: float, others: float) -> DataFrame:
    """Where the top pair reaches t, the others need only reach others."""
    top = F.max("z").over(Window.partitionBy("s1_id"))
    return pairs.withColumn("_top", top).where((F.col("_top") >= t) & (F.col("z") >= others)).drop("_top")


def rule_h2(pairs: DataFrame, t: float = T_HIGH, low: float = T_LOW) -> DataFrame:
    """All pairs that reach t; an S1 without one takes its top pair if that reaches low and its numbers agree (num_ok)."""
    rows = ranked(pairs)
    recovered = (F.col("z1") < t) & (F.col("rank") == 1) & (F.col("z") >= low) & (F.col("num_ok") == 1)
    return rows.where((F.col("z") >= t) | recovered).drop("rank", "z1", "z2")


def prune(pairs: DataFrame, floor: float = 2.0) -> DataFrame:
    """Pairs no rule can accept go, after the aggregates that needed them are columns."""
    return ranked(pairs).where(F.col("z") >= floor)


def f05(n_true, n_pred, tp):
    p, r = tp / n_pred, tp / n_true
    return F.when((n_true == 0) & (n_pred == 0), 1.0).when((n_true == 0) | (n_pred == 0) | (tp == 0), 0.0).otherwise(1.25 * p * r / (0.25 * p + r))


def sweep(pairs: DataFrame, entities: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """t, sum_f, n_s1 (and by): the sum of F0.5 at every grid threshold in one pass.

    An S1's F changes only at the scores of its own pairs, so each S1 gives one difference per score level; sums of the
    differences over higher thresholds are the curve. Rows grow with the pairs, not with pairs x thresholds.
    """
    level = F.floor((F.col("z") - GRID_FIRST) / GRID_STEP + 1e-9).cast("int")
    levels = pairs.where(F.col("z") >= GRID_FIRST).groupBy("s1_id", F.least(level, F.lit(GRID_POINTS - 1)).alias("i")).agg(n_rows().alias("n"), F.sum("label").alias("k"))
    down = Window.partitionBy("s1_id").orderBy(F.desc("i"))
    rows = levels.join(entities, "s1_id").withColumn("n", F.sum("n").over(down)).withColumn("k", F.sum("k").over(down))
    rows = rows.withColumn("f", f05(F.col("n_true"), F.col("n"), F.col("k")))
    empty = F.when(F.col("n_true") == 0, 1.0).otherwise(0.0)
    rows = rows.withColumn("d", F.col("f") - F.coalesce(F.lag("f").over(down), empty))
    start = entities.groupBy(*by).agg(F.sum(empty).alias("base"), n_rows().alias("n_s1"))
    grid = start.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(GRID_POINTS - 1))))
    steps = grid.join(rows.groupBy(*by, "i").agg(F.sum("d").alias("d")), [*by, "i"], "left")
    higher = Window.partitionBy(*by).orderBy(F.desc("i"))
    curve = steps.withColumn("sum_f", F.col("base") + F.sum(F.coalesce("d", F.lit(0.0))).over(higher))
    return curve.select(*by, F.round(GRID_FIRST + GRID_STEP * F.col("i"), 2).alias("t"), "sum_f", "n_s1")


def best_threshold(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """The threshold of rule A with the highest macro F; of equal ones the lowest."""
    curve = sweep(pairs, entities).select("t", F.round(F.col("sum_f") / F.col("n_s1"), 6).alias("macro_f"))
    return curve.orderBy(F.desc("macro_f"), "t").limit(1)


def best_two_level(pairs: DataFrame, entities: DataFrame, flag: str) -> DataFrame:
    """Rule B2's best (t, t_high): the flag's two groups have curves of their own, so the grid of pairs joins two curves."""
    curves = sweep(pairs, entities, (flag,))
    low = curves.where(f"{flag} = 0").select(F.col("t"), F.col("sum_f").alias("f0"), F.col("n_s1").alias("n0"), F.lit(1).alias("_k"))
    high = curves.where(f"{flag} = 1").select(F.col("t").alias("t_high"), F.col("sum_f").alias("f1"), F.col("n_s1").alias("n1"), F.lit(1).alias("_k"))
    both = low.join(high, "_k").where("t_high >= t")  # grid points squared: fixed
    scored = both.select("t", "t_high", F.round((F.col("f0") + F.col("f1")) / (F.col("n0") + F.col("n1")), 6).alias("macro_f"))
    return scored.orderBy(F.desc("macro_f"), "t", "t_high").limit(1)
