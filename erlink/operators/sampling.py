"""Seeded samples and splits by hashes of ids (the same in every run and engine), and small threshold tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from erlink.operators.decide import T_HIGH, ranked


#: Probabilities of the threshold table.
PROBABILITIES = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99, 0.995, 0.999, 0.9995, 0.9999, 0.99995, 0.99999)


def seeded_sample(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows without replacement: the least hashes of key and seed. A top-n, not a sort of everything."""
    return rows.withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))).orderBy("_h", key).limit(n).drop("_h")


def split(rows: DataFrame, key: str, salt: str, parts: Sequence[tuple[str, int]]) -> DataFrame:
    """part by percent of the key's hash; parts are disjoint and stay so in every run."""
    at = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(salt))), 1, 4), 16, 10).cast("int") % 100
    named, upto = F.lit(parts[-1][0]), sum(p for _, p in parts)
    for name, percent in reversed(parts):
        named = F.when(at < upto, name).otherwise(named)
        upto -= percent
    return rows.withColumn("part", named)


def evenly_spaced(rows: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """Up to n rows of each group, evenly spaced over its order by key, both ends included."""
    order = Window.partitionBy(group).orderBy(key)
    placed = rows.withColumn("_r", F.row_number().over(order) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(group)))
    # Row r is chosen iff some i rounds (half to even) to it: the nearest i decides.
    i = F.round(F.col("_r") * (n - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    near = F.exists(F.array(*(i + d for d in (-1, 0, 1))), lambda x: (x >= 0) & (x <= n - 1) & (F.bround(x * (F.col("_n") - 1) / (n - 1)) == F.col("_r")))
    return placed.where(F.when(F.col("_n") <= 1, True).otherwise(near) | (F.col("_n") <= n)).drop("_r", "_n")


def probability_thresholds(pairs: DataFrame, probabilities: Sequence[float] = PROBABILITIES) -> DataFrame:
    grid = F.explode(F.array(*map(F.lit, probabilities)))
    rows = pairs.select("z", "label", grid.alias("prob"))
    hit = F.col("z") >= F.log(F.col("prob") / (1 - F.col("prob")))
    return rows.groupBy("prob").agg(F.count_if(hit).alias("n_pred"), F.sum(F.when(hit, F.col("label"))).alias("tp"))


def recovery_curve(pairs: DataFrame, lows: Sequence[float], t: float = T_HIGH) -> DataFrame:
    rows = ranked(pairs).withColumn("low", F.explode(F.array(*map(F.lit, lows))))
    hit = (F.col("z") >= t) | ((F.col("z1") < t) & (F.col("rank") == 1) & (F.col("z") >= F.col("low")) & (F.col("num_ok") == 1))
    return rows.groupBy("low").agg(F.count_if(hit).alias("n_pred"), F.coalesce(F.sum(F.when(hit, F.col("label"))), F.lit(0)).alias("tp"))


