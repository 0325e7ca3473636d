"""Queries: scoring, decisions, windows, evaluation, thresholds, sampling."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from erlink.operators import decide as D
from erlink.operators import metrics as M
from erlink.operators import sampling as S
from erlink.plans.registry import query

RANKED = "ranked as (select *, row_number() over (partition by s1_id order by z desc, cand_id) rk, max(z) over (partition by s1_id) z1 from pairs), tops as (select *, coalesce(max(case when rk = 2 then z end) over (partition by s1_id), '-infinity'::double) z2 from ranked)"
COLS = "s1_id, cand_id, z, label, name_exact, addr_missing, num_ok, n_channels"

RULES = {
    "m05_rule_a": (lambda p: D.rule_a(p, 8.3), "select {c} from pairs where z >= 8.3"),
    "m06_rule_b1": (lambda p: D.rule_b1(p, 6.0, 10.0), "select {c} from (select *, max(case when z >= 6.0 then name_exact end) over (partition by s1_id) e from pairs) where z >= case when e = 1 then 6.0 else 10.0 end"),
    "m07_rule_b2": (lambda p: D.rule_b2(p, 6.0, 10.0), "select {c} from pairs where z >= case when addr_missing = 1 then 10.0 else 6.0 end"),
    "m09_rule_c1": (lambda p: D.rule_c1(p, 5.0, 10.0), "select {c} from ranked where z1 >= 10 and z >= 5"),
    "m09_rule_c2": (lambda p: D.rule_c2(p, 5.0, 8.0, 1.0), "select {c} from tops where z1 >= 8 and z1 - z2 >= 1 and z >= 5"),
    "m10_rule_h1": (lambda p: D.rule_h1(p, 8.3, 6.0), "select {c} from ranked where z1 >= 8.3 and z >= 6"),
    "m11_rule_h2": (lambda p: D.rule_h2(p), "select {c} from ranked where z >= 8.3 or (z1 < 8.3 and rk = 1 and z >= 3 and num_ok = 1)"),
}
for _name, (_rule, _sql) in RULES.items():
    query(_name, f"with {RANKED} {_sql.format(c=COLS)}", "scores")(lambda c, rule=_rule: rule(c.pairs).select(*COLS.split(", ")))

SCORED = f"""{RANKED}, pred as (select {COLS} from ranked where z >= 8.3 or (z1 < 8.3 and rk = 1 and z >= 3 and num_ok = 1)),
cnt as (select e.s1_id, e.country, e.n_true, coalesce(n, 0) n_pred, coalesce(k, 0) tp from entities e left join (select s1_id, count(*) n, sum(label) k from pred group by all) using (s1_id)),
prf as (select *, case when n_pred > 0 then tp / n_pred else 1.0 end p, case when n_true > 0 then tp / n_true else 1.0 end r from cnt),
sc as (select s1_id, country, n_true, n_pred::bigint n_pred, tp::bigint tp, p::double p, r::double r, case when n_true = 0 and n_pred = 0 then 1.0 when n_true = 0 or n_pred = 0 or tp = 0 then 0.0 else 1.25 * p * r / (0.25 * p + r) end::double f from prf)"""


def scores(c):
    return M.entity_scores(c.entities, D.rule_h2(c.pairs))


@query("g01_entity_scores", f"with {SCORED} select s1_id, country, n_true, n_pred, tp, round(p, 6) p, round(r, 6) r, round(f, 6) f from sc", "scores")
def _(c):
    return scores(c).select("s1_id", "country", "n_true", "n_pred", "tp", *(F.round(x, 6).alias(x) for x in "prf"))


@query("g02_macro_averages", f"with {SCORED} select count(*) n_s1, round(avg(p), 6) macro_p, round(avg(r), 6) macro_r, round(avg(f), 6) macro_f from sc", "scores")
def _(c):
    return M.macro(scores(c))


@query("g33_by_country", f"with {SCORED} select country, count(*) n_s1, round(avg(p), 6) macro_p, round(avg(r), 6) macro_r, round(avg(f), 6) macro_f from sc group by country", "scores")
def _(c):
    return M.macro(scores(c), "country")


@query("g03_full_evaluation", f"""with {SCORED} select round(avg(f), 6) macro_f, round(avg(p), 6) macro_p, round(avg(r), 6) macro_r, count(*) filter (n_true = 0) n_singleton, count(*) filter (n_true = 0 and n_pred = 0) singleton_empty,
 round(100 * avg((n_pred > 0)::int) filter (n_true = 0), 6) singleton_fp_pct, count(*) filter (n_true > 0 and n_pred = 0) matched_zero_pred, round(avg(n_pred), 6) avg_pred, round(avg(f) filter (n_true > 0), 6) matched_only_f,
 count(*) filter (n_true >= 2) n_multi, round(avg(r) filter (n_true >= 2), 6) multi_recall, round(avg(n_pred) filter (n_true >= 2), 6) multi_avg_pred, count(*) filter (n_true >= 2 and n_pred >= 2) multi_2plus,
 (select count(*) from (select cand_id from pred group by 1 having count(distinct s1_id) > 1))::bigint duplicate_claims from sc""", "scores")
def _(c):
    return M.full_evaluation(scores(c), M.claims(D.rule_h2(c.pairs)))


@query("g04_duplicate_claims", "select cand_id, count(distinct s1_id) n_s1 from pairs where z >= 8.3 group by cand_id having count(distinct s1_id) > 1", "scores")
def _(c):
    return M.claims(D.rule_a(c.pairs, 8.3)).where("n_s1 > 1")


@query("w01_sorted_within_s1", f"with {RANKED} select s1_id, cand_id, z, rk::int \"rank\" from ranked", "scores")
def _(c):
    return D.ranked(c.pairs).select("s1_id", "cand_id", "z", "rank")


@query("w02_top_scores", f"with {RANKED} select s1_id, z1, z2, z1 - z2 margin from tops where rk = 1", "scores")
def _(c):
    return D.ranked(c.pairs).where("rank = 1").select("s1_id", "z1", "z2", (F.col("z1") - F.col("z2")).alias("margin"))


@query("w03_top_attributes", f"with {RANKED} select s1_id, name_exact top_name_exact, n_channels top_n_channels, label top_label from ranked where rk = 1", "scores")
def _(c):
    return D.profiles(c.pairs).select("s1_id", "top_name_exact", "top_n_channels", "top_label")


@query("w04_counts_above", "select s1_id, count(*) n_cand, " + ", ".join(f"count(*) filter (z >= {x}) n_ge{x}" for x in D.CUTOFFS) + " from pairs group by s1_id", "scores")
def _(c):
    return D.profiles(c.pairs).select("s1_id", "n_cand", *(f"n_ge{x}" for x in D.CUTOFFS))


@query("w06_first_of_group", f"with {RANKED} select s1_id, cand_id, (rk = 1)::int is_top from ranked", "scores")
def _(c):
    return D.ranked(c.pairs).select("s1_id", "cand_id", (F.col("rank") == 1).cast("int").alias("is_top"))


@query("w07_argmax", f"with {RANKED} select s1_id, cand_id, z from ranked where rk = 1", "scores")
def _(c):
    return D.ranked(c.pairs).where("rank = 1").select("s1_id", "cand_id", "z")


@query("w08_average_rank", "select s1_id, cand_id, (rank() over (partition by s1_id order by z) + (count(*) over (partition by s1_id, z) - 1) / 2)::double avg_rank from pairs", "scores")
def _(c):
    r = F.rank().over(Window.partitionBy("s1_id").orderBy("z")) + (F.count(F.lit(1)).over(Window.partitionBy("s1_id", "z")) - 1) / 2
    return c.pairs.select("s1_id", "cand_id", r.cast("double").alias("avg_rank"))


@query("m08_gate_features", f"with {RANKED} select s1_id, any_value(z1) z1, greatest(any_value(z2), -10.0) z2, any_value(z1) - greatest(any_value(z2), -10.0) margin, ln(1 + count(*)) log_n_cand, max(case when rk = 1 then name_exact end) top_name_exact, max(case when rk = 1 then n_channels end) top_n_channels, max(addr_missing) addr_missing, {', '.join(f'ln(1 + count(*) filter (z >= {x})) log_n_ge{x}' for x in D.CUTOFFS)} from tops group by s1_id", "scores")
def _(c):
    return D.gate_features(c.pairs)


@query("m08_rule_b3")
def _(c):
    from erlink.operators import model

    features = D.gate_features(c.pairs).join(c.entities.select("s1_id", (F.col("n_true") == 0).cast("int").alias("label")), "s1_id")
    columns = [x for x in features.columns if x not in ("s1_id", "label")]
    gate = model.scored(features, model.fit(features, columns)).select("s1_id", M.sigmoid(F.col("z")).alias("gate"))
    return D.rule_b3(c.pairs, gate, 0.5, 6.0, 10.0).select("s1_id", "cand_id", "z", "label")


@query("m12_prune", f"with {RANKED} select s1_id, cand_id, z, z1, z2 from tops where z >= 2", "scores")
def _(c):
    return D.prune(c.pairs).select("s1_id", "cand_id", "z", "z1", "z2")


@query("m13_scalar_math", "select s1_id, cand_id, round(1 / (1 + exp(-z)), 9) p, round(ln(0.3 / 0.7), 9) logit_03, round(ln(1 + z), 9) log1p_z, least(z, 5.0) clipped, abs(z - 8.3) distance from pairs", "scores")
def _(c):
    z = F.col("z")
    return c.pairs.select("s1_id", "cand_id", F.round(M.sigmoid(z), 9).alias("p"), F.round(M.logit(F.lit(0.3)), 9).alias("logit_03"), F.round(F.log1p(z), 9).alias("log1p_z"), F.least(z, F.lit(5.0)).alias("clipped"), F.abs(z - 8.3).alias("distance"))


GRID = "grid as (select i, round(3.0 + 0.1 * i, 2)::double t from (select unnest(range(0, 131)) i))"
_F = "case when n_true = 0 and n = 0 then 1.0 when n_true = 0 or n = 0 or k = 0 then 0.0 else 1.25 * (k / n) * (k / n_true) / (0.25 * (k / n) + k / n_true) end"
CURVE = f"""{GRID}, at_t as (select t, s1_id, n_true, country, coalesce(n, 0) n, coalesce(k, 0) k from (select t, s1_id, n_true, country from grid, entities) left join (select t, s1_id, count(*) n, sum(label) k from grid join pairs on z >= t - 1e-9 group by all) using (t, s1_id)),
fs as (select t, s1_id, country, {_F} f from at_t)"""


@query("t01_probability_thresholds", f"with probs as (select unnest([0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99, 0.995, 0.999, 0.9995, 0.9999, 0.99995, 0.99999])::double prob) select prob, count(*) filter (z >= ln(prob / (1 - prob))) n_pred, (sum(label) filter (z >= ln(prob / (1 - prob))))::bigint tp from probs, pairs group by prob", "scores")
def _(c):
    return S.probability_thresholds(c.pairs)


@query("t02_threshold_curve", f"with {CURVE} select t, round(avg(f), 6) macro_f from fs group by t", "scores")
def _(c):
    return D.sweep(c.pairs, c.entities).select("t", F.round(F.col("sum_f") / F.col("n_s1"), 6).alias("macro_f"))


@query("t02_curve_by_country", f"with {CURVE} select country, t, round(avg(f), 6) macro_f from fs group by all", "scores")
def _(c):
    return D.sweep(c.pairs, c.entities, ("country",)).select("country", "t", F.round(F.col("sum_f") / F.col("n_s1"), 6).alias("macro_f"))


@query("g25_auc", "select sum(label)::bigint n_pos, sum(1 - label)::bigint n_neg, round((sum(case when label = 1 then r end) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)), 6) auc from (select label, rank() over (order by z) + (count(*) over (partition by z) - 1) / 2 r from pairs)", "scores")
def _(c):
    return M.auc(c.pairs, "z", "label")


@query("g28_z_matched_mean", "with b as (select *, case when z <= 3 then 0 when z <= 6 then 1 when z <= 9 then 2 else 3 end bin from pairs where z > 0.25 and z <= 12.5), a as (select bin, count(*) a from b where label = 1 group by bin), o as (select bin, count(*) b, avg(name_exact) v from b where label = 0 group by bin) select round(sum(a * v) / sum(a), 6) weighted_mean, sum(b)::bigint n_other from o join a using (bin)", "scores")
def _(c):
    return M.weighted_mean(c.pairs.where("label = 1"), c.pairs.where("label = 0"), "z", "name_exact", (0.25, 3, 6, 9, 12.5))


@query("g27_paired_bootstrap")
def _(c):
    a, b = M.entity_scores(c.entities, D.rule_a(c.pairs, 8.3)), M.entity_scores(c.entities, D.rule_h2(c.pairs))
    deltas = a.select("s1_id", F.col("f").alias("fa")).join(b.select("s1_id", F.col("f").alias("fb")), "s1_id").select((F.col("fb") - F.col("fa")).alias("d"))
    return c.spark.createDataFrame([M.bootstrap(deltas, "d")], "delta double, low double, high double, p_not_better double")


_PAIR = "concat(s1_id, '/', cand_id)"


@query("l04_seeded_sample", "select s1_id from entities order by md5(concat(s1_id, '42')), s1_id limit 500", "scores")
def _(c):
    return S.seeded_sample(c.entities, "s1_id", 500, "42").select("s1_id")


@query("l05_split", "select s1_id, case when ('0x' || substr(md5(concat(s1_id, 'split')), 1, 4))::bigint % 100 < 80 then 'train' else 'val' end part from entities", "scores")
def _(c):
    return S.split(c.entities, "s1_id", "split", (("train", 80), ("val", 20))).select("s1_id", "part")


@query("l06_fit_tune", "select s1_id, case when ('0x' || substr(md5(concat(s1_id, 'tune')), 1, 4))::bigint % 100 < 80 then 'fit' else 'tune' end part from entities where ('0x' || substr(md5(concat(s1_id, 'split')), 1, 4))::bigint % 100 < 80", "scores")
def _(c):
    train = S.split(c.entities, "s1_id", "split", (("train", 80), ("val", 20))).where("part = 'train'").drop("part")
    return S.split(train, "s1_id", "tune", (("fit", 80), ("tune", 20))).select("s1_id", "part")


@query("l07_second_holdout", "with one as (select s1_id from entities order by md5(concat(s1_id, '42')), s1_id limit 500) select s1_id from entities where s1_id not in (select s1_id from one) order by md5(concat(s1_id, '43')), s1_id limit 500", "scores")
def _(c):
    first = S.seeded_sample(c.entities, "s1_id", 500, "42")
    return S.seeded_sample(c.entities.join(first.select("s1_id"), "s1_id", "left_anti"), "s1_id", 500, "43").select("s1_id")


@query("l08_evenly_spaced", "with n as (select s1_id, country, row_number() over (partition by country order by s1_id) - 1 r, count(*) over (partition by country) n from entities) select s1_id, country from n where r in (select case when n > 1 then round_even(i * (n - 1) / 99.0, 0)::bigint else 0 end from (select unnest(range(0, 100)) i))", "scores")
def _(c):
    return S.evenly_spaced(c.entities, "country", "s1_id", 100).select("s1_id", "country")


@query("l09_negative_subsample", f"select s1_id, cand_id from pairs where label = 0 order by md5(concat({_PAIR}, '7')), s1_id, cand_id limit 1000", "scores")
def _(c):
    rows = c.pairs.where("label = 0").withColumn("_id", F.concat_ws("/", "s1_id", "cand_id"))
    return S.seeded_sample(rows, "_id", 1000, "7").select("s1_id", "cand_id")


@query("g31_representativeness", "with s as (select * from entities order by md5(concat(s1_id, '42')), s1_id limit 500), u as (select 'population' part, * from entities union all select 'sample', * from s) select part, count(*) n_s1, round(100 * avg((n_true = 0)::int), 6) singleton_pct, round(avg(n_true), 6) mean_true, quantile_cont(n_true, 0.5)::double median_true from u group by part", "scores")
def _(c):
    both = c.entities.withColumn("part", F.lit("population")).unionByName(S.seeded_sample(c.entities, "s1_id", 500, "42").withColumn("part", F.lit("sample")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n_s1"), F.round(100 * M.share(F.col("n_true") == 0), 6).alias("singleton_pct"), F.round(F.avg("n_true"), 6).alias("mean_true"), F.expr("percentile(n_true, 0.5)").alias("median_true"))
