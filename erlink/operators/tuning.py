"""Search for decision rules, and what changes between two models. All work on sums per level: tables of the grid's size, whatever the data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from erlink.operators import decide as D
from erlink.operators.metrics import n_rows, share

#: Margins of the top score, cut-offs of the singleton gate, a threshold chosen earlier, bins of top scores and margins.
MARGINS = (0.0, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0, 5.0)
GATE_STEP, GATE_POINTS = 0.05, 19
PRIOR_PROBABILITY = 0.9995
Z_EDGES = (-99, 0, 4, 6, 7, 8, 9, 10, 11, 12, 14, 99)
MARGIN_EDGES = (-1, 0.25, 0.5, 1, 2, 3, 5, 99)
LAST = D.GRID_POINTS - 1


def grid_level(z: Column) -> Column:
    """The last grid threshold that z reaches, as its number; -1: none."""
    return F.coalesce(F.greatest(F.lit(-1), F.least(F.floor((z - D.GRID_FIRST) / D.GRID_STEP + 1e-9), F.lit(LAST))), F.lit(-1)).cast("int")


def levels(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """Per S1, those without pairs too: levels of its top score (top), margin, best exact-name score (exact), gate; and addr_missing. entities: s1_id, n_true, gate."""
    ranked = D.ranked(pairs)
    of = ranked.groupBy("s1_id").agg(F.max("z1").alias("z1"), F.max("z2").alias("z2"), F.max(F.when(F.col("name_exact") == 1, F.col("z"))).alias("ez"), F.max("addr_missing").alias("addr_missing"))
    margin = F.col("z1") - F.col("z2")
    m = sum(((margin >= x - 1e-9).cast("int") for x in MARGINS), F.lit(0)) - 1
    gate = F.least(F.floor(F.col("gate") / GATE_STEP + 1e-9), F.lit(GATE_POINTS)).cast("int") - 1
    rows = entities.join(of, "s1_id", "left")
    return rows.select("s1_id", "n_true", grid_level(F.col("z1")).alias("top"), F.coalesce(m, F.lit(-1)).cast("int").alias("margin"), grid_level(F.col("ez")).alias("exact"), gate.alias("gate"), F.coalesce("addr_missing", F.lit(0)).alias("addr_missing"))


def below(curves: DataFrame, name: str, n: int, *by: tuple[str, int]) -> DataFrame:
    """by, at (-1 .. n - 1), i, s, all: for each grid threshold the sum of F over S1 whose level is at most at, and over all S1. i = LAST + 1: nothing is predicted.

    by: names of further levels from 0 and how many there are.
    """
    grid = curves.sparkSession.range(n + 1).select((F.col("id") - 1).cast("int").alias("at"), F.explode(F.sequence(F.lit(0), F.lit(LAST + 1))).alias("i"))
    for other, size in by:
        grid = grid.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    keys = [other for other, _ in by]
    sums = curves.groupBy(*keys, F.col(name).alias("at"), "i").agg(F.sum("f").alias("f"))
    rows = grid.join(sums, [*keys, "at", "i"], "left").na.fill(0.0, ["f"])
    whole = Window.partitionBy(*keys, "i")
    return rows.select(*keys, "at", "i", F.sum("f").over(whole.orderBy("at")).alias("s"), F.sum("f").over(whole).alias("all"))


def curves_by(pairs: DataFrame, leveled: DataFrame, *by: str) -> DataFrame:
    """by, i, f: sums of F0.5 at every grid threshold per group of S1, and at LAST + 1 those of empty predictions."""
    at = D.sweep(pairs, leveled, by).select(*by, F.round((F.col("t") - D.GRID_FIRST) / D.GRID_STEP).cast("int").alias("i"), F.col("sum_f").alias("f"))
    none = leveled.groupBy(*by).agg(F.sum(F.when(F.col("n_true") == 0, 1.0).otherwise(0.0)).alias("f")).select(*by, F.lit(LAST + 1).alias("i"), "f")
    return at.unionByName(none)


def threshold(i: Column) -> Column:
    """The grid's threshold; infinity beyond it."""
    return F.when(i > LAST, F.lit(float("inf"))).otherwise(F.round(D.GRID_FIRST + D.GRID_STEP * i, 2))


def _best(rows: DataFrame, rule: str, n: int, value: Column, *parameters: Column) -> DataFrame:
    """The first row of the highest value, in the order of the parameters."""
    names = [f"p{k + 1}" for k in range(len(parameters))]
    scored = rows.select(*(p.cast("double").alias(x) for x, p in zip(names, parameters, strict=True)), F.round(value / n, 9).alias("v")).orderBy(F.desc("v"), *names).limit(1)
    none = F.lit(None).cast("double")
    return scored.select(F.lit(rule).alias("rule"), *(F.col(x) if x in names else none.alias(x) for x in ("p1", "p2", "p3")), F.round("v", 6).alias("macro_f"))


def search_rules(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """rule, p1, p2, p3, macro_f: the best parameters of the rules A (t), B1, B2 (t, t_high), B3 (gate, t, t_high), C1 (first, t), C2 (first, margin, t).

    The sums below a level give each rule's value at every point of its grid without going back to the pairs.
    """
    pairs, leveled = pairs.select("s1_id", "cand_id", "z", "label", "name_exact", "addr_missing").persist(), levels(pairs, entities).persist()
    n = leveled.count()
    inside = F.col("i") <= LAST
    try:
        out = []
        # Of a rule with two thresholds, S1 below a level take one and the others the other.
        exact = below(curves_by(pairs, leveled, "exact"), "exact", D.GRID_POINTS).persist()
        out.append(_best(exact.where((F.col("at") == -1) & inside), "A", n, F.col("all"), threshold(F.col("i"))))
        own = exact.where(F.col("i") == F.col("at") + 1).where(inside).select("at", (F.col("all") - F.col("s")).alias("low"), F.col("i").alias("t"))
        both = own.join(exact, "at").where((F.col("i") >= F.col("t")) & inside)
        out.append(_best(both, "B1", n, F.col("low") + F.col("s"), threshold(F.col("t")), threshold(F.col("i"))))

        missing = below(curves_by(pairs, leveled, "addr_missing"), "addr_missing", 2).where(F.col("at") == 0).where(inside)
        low = missing.select("at", F.col("i").alias("t"), F.col("s").alias("low"))
        both = low.join(missing, "at").where(F.col("i") >= F.col("t"))
        out.append(_best(both, "B2", n, F.col("low") + F.col("all") - F.col("s"), threshold(F.col("t")), threshold(F.col("i"))))

        gate = below(curves_by(pairs, leveled, "gate"), "gate", GATE_POINTS).where(F.col("at") < GATE_POINTS - 1)
        low = gate.where(inside).select("at", F.col("i").alias("t"), F.col("s").alias("low"))
        both = low.join(gate, "at").where(F.col("i") >= F.col("t"))
        out.append(_best(both, "B3", n, F.col("low") + F.col("all") - F.col("s"), F.round((F.col("at") + 2) * GATE_STEP, 2), threshold(F.col("t")), threshold(F.col("i"))))

        # Only S1 whose top score and margin reach their levels predict anything; m is the margin that is asked for.
        cells = curves_by(pairs, leveled, "top", "margin").withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(len(MARGINS) - 1))))
        kept = below(cells.where(F.col("margin") >= F.col("m")), "top", D.GRID_POINTS, ("m", len(MARGINS))).persist()
        rest = cells.where((F.col("i") == LAST + 1) & (F.col("margin") < F.col("m"))).groupBy("m").agg(F.sum("f").alias("rest"))
        empty = kept.where(F.col("i") == LAST + 1).select("m", "at", F.col("s").alias("empty")).join(rest, "m", "left").na.fill(0.0, ["rest"])
        rows = kept.where(inside & (F.col("i") <= F.col("at") + 1) & (F.col("at") < LAST)).join(empty, ["m", "at"])
        value, first, t = F.col("all") - F.col("s") + F.col("empty") + F.col("rest"), threshold(F.col("at") + 1), threshold(F.col("i"))
        margin = F.get(F.array(*map(F.lit, MARGINS)), F.col("m"))
        plain = below(curves_by(pairs, leveled, "top"), "top", D.GRID_POINTS).persist()
        none = plain.where(F.col("i") == LAST + 1).select("at", F.col("s").alias("empty"))
        alone = plain.where(inside & (F.col("i") <= F.col("at") + 1) & (F.col("at") < LAST)).join(none, "at")
        out.append(_best(alone, "C1", n, F.col("all") - F.col("s") + F.col("empty"), first, t))
        out.append(_best(rows, "C2", n, value, first, margin, t))
        whole = reduce(DataFrame.unionByName, out)
        return whole.sparkSession.createDataFrame(whole.collect(), whole.schema)  # a row a rule
    finally:
        for kept in (pairs, leveled):
            kept.unpersist()


def recovery_curves(pairs: DataFrame, entities: DataFrame, t: float = D.T_HIGH) -> DataFrame:
    """rule, param, macro_f at every grid threshold up to t: H1 (the threshold of the others where the top pair reaches t) and H2 (that of a lone top pair whose numbers agree)."""
    ranked = D.ranked(pairs)
    empty = F.when(F.col("n_true") == 0, 1.0).otherwise(0.0)
    tops = entities.join(ranked.where("rank = 1").select("s1_id", "z1", F.col("label").alias("top_label"), "num_ok"), "s1_id", "left").withColumn("high", F.coalesce(F.col("z1") >= t - 1e-9, F.lit(False)))
    high = D.sweep(pairs.join(tops.where("high").select("s1_id"), "s1_id", "left_semi"), tops.where("high")).select("t", "sum_f")
    rest = tops.where("not high").agg(F.coalesce(F.sum(empty), F.lit(0.0)))
    n = entities.agg(n_rows())
    h1 = high.where(F.col("t") <= t).select(F.lit("H1").alias("rule"), F.col("t").alias("param"), F.round((F.col("sum_f") + rest.scalar()) / n.scalar(), 6).alias("macro_f"))
    # H2: an S1 below t gains what its top pair alone is worth over an empty prediction.
    alone = F.when((F.col("n_true") == 0) | (F.col("top_label") == 0), 0.0).otherwise(1.25 / (0.25 * F.col("n_true") + 1))
    gain = tops.where("not high and num_ok = 1").select(grid_level(F.col("z1")).alias("i"), (alone - empty).alias("g")).where("i >= 0").groupBy("i").agg(F.sum("g").alias("g"))
    grid = pairs.sparkSession.range(D.GRID_POINTS).select(F.col("id").cast("int").alias("i")).join(gain, "i", "left").na.fill(0.0, ["g"])
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("i"))  # the grid's points
    at_t = high.where(F.col("t") == t).select("sum_f")
    curve = grid.withColumn("g", F.sum("g").over(down)).withColumn("param", threshold(F.col("i"))).where(F.col("param") < t)
    h2 = curve.select(F.lit("H2").alias("rule"), "param", F.round((F.coalesce(at_t.scalar(), F.lit(0.0)) + rest.scalar() + F.col("g")) / n.scalar(), 6).alias("macro_f"))
    return h1.unionByName(h2)


def model_change(pairs: DataFrame, t_a: float, t_b: float, contradicted: Column) -> DataFrame:
    """subset, and of its pairs the false and true ones that scores z_a and z_b predict, removed and added, lost and gained. Subsets: with a contradiction, without, all."""
    a, b, true = F.col("z_a") >= t_a, F.col("z_b") >= t_b, F.col("label") == 1
    subset = F.explode(F.array(F.when(contradicted, "contradiction").otherwise("no_contradiction"), F.lit("all")))
    rows = pairs.select(a.alias("a"), b.alias("b"), true.alias("t"), subset.alias("subset"))
    count = lambda x, name: F.count_if(F.expr(x)).alias(name)
    return rows.groupBy("subset").agg(
        count("a and not t", "fp_a"), count("b and not t", "fp_b"), count("a and t", "tp_a"), count("b and t", "tp_b"),
        count("a and not b and not t", "fp_removed"), count("b and not a and not t", "fp_added"), count("a and not b and t", "tp_lost"), count("b and not a and t", "tp_gained"),
    )


def case_effect(pairs: DataFrame, cases: DataFrame, t_a: float, t_b: float) -> DataFrame:
    """Per category of cases (s1_id, category), all of them false matches: how many each model still predicts, removes and adds."""
    tops = pairs.groupBy("s1_id").agg(F.max("z_a").alias("z_a"), F.max("z_b").alias("z_b"))
    rows = cases.join(tops, "s1_id", "left").select("category", F.coalesce(F.col("z_a") >= t_a, F.lit(False)).alias("a"), F.coalesce(F.col("z_b") >= t_b, F.lit(False)).alias("b"))
    return rows.groupBy("category").agg(n_rows().alias("n_cases"), F.count_if("a").alias("predicted_a"), F.count_if("b").alias("predicted_b"), F.count_if(F.col("a") & ~F.col("b")).alias("removed"), F.count_if(~F.col("a") & F.col("b")).alias("added"))


def cleared_singletons(pairs: DataFrame, entities: DataFrame, t_a: float, t_b: float, contradicted: Column) -> DataFrame:
    """Singletons that model A predicts: how many of their top pairs are contradicted, and how many model B clears among these and the others."""
    order = Window.partitionBy("s1_id").orderBy(F.desc("z_a"), "cand_id")
    rows = pairs.withColumn("_c", contradicted).withColumn("_r", F.row_number().over(order)).withColumn("_b", F.max("z_b").over(Window.partitionBy("s1_id")))
    top = rows.where(F.col("_r") == 1).where(F.col("z_a") >= t_a).join(entities.where("n_true = 0").select("s1_id"), "s1_id", "left_semi")
    cleared = F.col("_b") < t_b
    return top.agg(n_rows().alias("n"), F.count_if("_c").alias("contradicted"), F.count_if(cleared & F.col("_c")).alias("cleared_contradicted"), F.count_if(cleared & ~F.col("_c")).alias("cleared_others"))


def cut(x: Column, edges: Sequence[float]) -> Column:
    """The number of the half-open bin (a, b] that holds x; null outside."""
    inside = (x > edges[0]) & (x <= edges[-1])
    return F.when(inside, sum(((x > e).cast("int") for e in edges[1:-1]), F.lit(0)))


def exploration_bins(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """kind (z1, margin), bin, n_s1, singleton_rate, top_is_true: S1 with a candidate by bins of the top score and of the margin."""
    tops = D.ranked(pairs).where("rank = 1").join(entities, "s1_id")
    kinds = F.explode(F.array(F.struct(F.lit("z1").alias("kind"), cut(F.col("z1"), Z_EDGES).alias("bin")), F.struct(F.lit("margin").alias("kind"), cut(F.col("z1") - F.col("z2"), MARGIN_EDGES).alias("bin"))))
    return tops.select("n_true", "label", kinds.alias("k")).groupBy("k.kind", "k.bin").agg(n_rows().alias("n_s1"), F.round(share(F.col("n_true") == 0), 6).alias("singleton_rate"), F.round(F.avg("label"), 6).alias("top_is_true"))


def reference_thresholds(pairs: DataFrame, entities: DataFrame, probability: float = PRIOR_PROBABILITY) -> DataFrame:
    """kind, t, macro_f: a threshold chosen earlier as a probability (prior), and the best one on these very S1 (optimal), which only sizes the gap."""
    import math

    from erlink.operators import metrics as M

    t = math.log(probability / (1 - probability))
    prior = M.entity_scores(entities, D.rule_a(pairs, t)).agg(F.lit("prior").alias("kind"), F.round(F.lit(t), 6).alias("t"), F.round(F.avg("f"), 6).alias("macro_f"))
    return prior.unionByName(D.best_threshold(pairs, entities).select(F.lit("optimal").alias("kind"), "t", "macro_f"))
