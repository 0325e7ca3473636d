"""Queries: search for rules, curves, and comparisons of two models over the scored pairs."""

from pyspark.sql import functions as F

from erlink.operators import decide as D
from erlink.operators import tuning as T
from erlink.plans.queries_decide import _F, CURVE, RANKED
from erlink.plans.registry import query

#: A second model of the fixture: number contradictions weigh, exact names help. Thresholds of the two.
Z_B = "z - case when num_ok = 0 then 1.75 else 0 end + case when name_exact = 1 then 0.5 else 0 end"
T_A, T_B = 7.3, 8.3


def entities(c):
    return c.entities.withColumn("gate", F.expr("(s1_id % 20) / 20.0D"))


def two_models(c):
    return c.pairs.withColumn("z_a", F.col("z")).withColumn("z_b", F.expr(Z_B))


#: Levels of each S1 and, for every threshold (131: nothing predicted), its F; then the best of all parameters by brute force over groups.
_LEVEL = "coalesce(greatest(-1, least(floor(({x} - 3.0) / 0.1 + 1e-9), 130)), -1)::int"
_MARGIN = "coalesce((" + " + ".join(f"(z1 - z2 >= {x} - 1e-9)::int" for x in T.MARGINS) + ") - 1, -1)"
SEARCH = f"""{CURVE}, {RANKED}, lv as (select e.s1_id, n_true, {_LEVEL.format(x='z1')} top, {_LEVEL.format(x='ez')} ex, {_MARGIN} mg, coalesce(am, 0) am, least(floor((e.s1_id % 20) / 20.0 / 0.05 + 1e-9), 19)::int - 1 gt
 from entities e left join (select s1_id, any_value(z1) z1, any_value(z2) z2, max(case when name_exact = 1 then z end) ez, max(addr_missing) am from tops group by s1_id) using (s1_id)),
fi as (select s1_id, round((t - 3.0) / 0.1)::int i, f from fs union all select s1_id, 131, (n_true = 0)::int from entities),
fl as materialized (select fi.*, top, ex, mg, am, gt from fi join lv using (s1_id)), n as (select count(*) n from entities),
th as (select i, case when i > 130 then 'inf'::double else round(3.0 + 0.1 * i, 2)::double end t from (select unnest(range(0, 132)) i)),
sx as materialized (select ex l, i, sum(f) f from fl group by all), sa as (select am l, i, sum(f) f from fl group by all), sg as materialized (select gt l, i, sum(f) f from fl group by all), st as materialized (select top l, mg, i, sum(f) f from fl group by all),
ra as (select 'A' rule, t p1, null::double p2, null::double p3, round(sum(f) / any_value(n), 9) v from sx join th using (i), n where i < 131 group by t),
b1 as (select a.i, b.i h, sum(case when l >= a.i and s.i = a.i then f when l < a.i and s.i = b.i then f else 0 end) f from th a join th b on b.i >= a.i and b.i < 131 join sx s on (s.i = a.i and l >= a.i) or (s.i = b.i and l < a.i) group by all),
b2 as (select a.i, b.i h, (select sum(f) from sa where l = 0 and sa.i = a.i) + coalesce((select sum(f) from sa where l = 1 and sa.i = b.i), 0) f from th a join th b on b.i >= a.i and b.i < 131),
gs as (select unnest(range(0, 19)) g), g1 as (select g, sg.i, sum(case when l < g then f else 0 end) lo, sum(case when l >= g then f else 0 end) hi from gs, sg group by all),
b3 as (select a.g, a.i, b.i h, a.lo + b.hi f from g1 a join g1 b on a.g = b.g and b.i >= a.i and a.i < 131),
cm as (select k.i k, m, s.i, sum(case when l >= k.i and mg >= m then f else 0 end) f from (select i from th where i < 131) k, (select unnest(range(0, {len(T.MARGINS)})) m) m, st s group by all),
ce as (select k.i k, m, sum(case when l >= k.i and mg >= m then 0 else f end) e from (select i from th where i < 131) k, (select unnest(range(0, {len(T.MARGINS)})) m) m, st s where s.i = 131 group by all),
c2 as (select k, m, i, f + e f from cm join ce using (k, m) where i <= k),
allr as (select * from ra union all select 'B1', x.t, y.t, null, round(f / n, 9) from b1 join th x using (i) join th y on y.i = h, n union all select 'B2', x.t, y.t, null, round(f / n, 9) from b2 join th x using (i) join th y on y.i = h, n
 union all select 'B3', round((g + 1) * 0.05, 2), x.t, y.t, round(f / n, 9) from b3 join th x using (i) join th y on y.i = h, n
 union all select 'C1', x.t, y.t, null, round(f / n, 9) from (select k, g.i, sum(case when s.i = 131 then case when l < k then f else 0 end else case when l >= k then f else 0 end end) f from (select x.i k, y.i from th x join th y on y.i <= x.i where x.i < 131) g join st s on s.i = g.i or s.i = 131 group by all) q join th x on x.i = q.k join th y on y.i = q.i, n
 union all select 'C2', x.t, list_value({", ".join(map(str, T.MARGINS))})[m + 1]::double, y.t, round(f / n, 9) from c2 join th x on x.i = k join th y on y.i = c2.i, n)"""


@query("t03_rule_search", f"with {SEARCH} select rule, p1, p2, p3, round(v, 6) macro_f from allr qualify row_number() over (partition by rule order by v desc, p1, p2, p3) = 1", "scores")
def _(c):
    return T.search_rules(c.pairs, entities(c))


_H = f"""{RANKED}, tp as (select e.s1_id, n_true, z1, num_ok, label tl, coalesce(z1 >= 8.3 - 1e-9, false) hi from entities e left join (select * from tops where rk = 1) using (s1_id)),
g as (select round(3.0 + 0.1 * i, 2)::double t from (select unnest(range(0, 131)) i)), cnt as (select t, s1_id, count(*) n, sum(label) k from g join pairs on z >= t - 1e-9 group by all)"""


@query("t04_recovery_curves", f"""with {_H} select 'H1' rule, t param, round(avg(case when not hi then (n_true = 0)::int else {_F} end), 6) macro_f from (select g.t, tp.*, coalesce(n, 0) n, coalesce(k, 0) k from g cross join tp left join cnt on cnt.t = g.t and cnt.s1_id = tp.s1_id where g.t <= 8.3) group by t
 union all select 'H2', t, round(avg(case when hi then {_F} when z1 >= t - 1e-9 and num_ok = 1 then case when n_true = 0 or tl = 0 then 0.0 else 1.25 / (0.25 * n_true + 1) end else (n_true = 0)::int end), 6) from (select g.t, tp.*, coalesce(n, 0) n, coalesce(k, 0) k from g cross join tp left join cnt on cnt.t = 8.3 and cnt.s1_id = tp.s1_id where g.t < 8.3) group by t""", "scores")
def _(c):
    return T.recovery_curves(c.pairs, c.entities)


_TWO = f"two as (select *, z z_a, {Z_B} z_b from pairs)"
_WHOLE = "count(*) filter ({0})"
_SIDES = f"(z_a >= {T_A}) a, (z_b >= {T_B}) b"


@query("t06_model_change", f"""with {_TWO}, m as (select {_SIDES}, label, num_ok from two), u as (select case when num_ok = 0 then 'contradiction' else 'no_contradiction' end subset, * from m union all select 'all', * from m)
 select subset, count(*) filter (a and label = 0) fp_a, count(*) filter (b and label = 0) fp_b, count(*) filter (a and label = 1) tp_a, count(*) filter (b and label = 1) tp_b, count(*) filter (a and not b and label = 0) fp_removed, count(*) filter (b and not a and label = 0) fp_added, count(*) filter (a and not b and label = 1) tp_lost, count(*) filter (b and not a and label = 1) tp_gained from u group by subset""", "scores")
def _(c):
    return T.model_change(two_models(c), T_A, T_B, F.col("num_ok") == 0)


def _case(x: str, edges) -> str:
    return f"case when {x} > {edges[0]} and {x} <= {edges[-1]} then " + " + ".join(f"({x} > {e})::int" for e in edges[1:-1]) + " end"


@query("t07_exploration_bins", f"""with {RANKED}, b as (select n_true, label, {_case('z1', T.Z_EDGES)} zb, {_case('(z1 - z2)', T.MARGIN_EDGES)} mb from tops join entities using (s1_id) where rk = 1)
 select kind, bin, count(*) n_s1, round(avg((n_true = 0)::int), 6) singleton_rate, round(avg(label), 6) top_is_true from (select 'z1' kind, zb bin, n_true, label from b union all select 'margin', mb, n_true, label from b) group by all""", "scores")
def _(c):
    return T.exploration_bins(c.pairs, c.entities)


_CASES = f"cases as (select s1_id, o_orderpriority category from (select s1_id, max(z_a) z from two group by 1) join entities using (s1_id) join orders on o_orderkey = s1_id where n_true = 0 and z >= 7)"


@query("t10_case_effect", f"""with {_TWO}, {_CASES}, k as (select category, coalesce(max(z_a) >= {T_A}, false) a, coalesce(max(z_b) >= {T_B}, false) b from cases left join two using (s1_id) group by category, s1_id)
 select category, count(*) n_cases, count(*) filter (a) predicted_a, count(*) filter (b) predicted_b, count(*) filter (a and not b) removed, count(*) filter (b and not a) added from k group by category""", "scores")
def _(c):
    pairs = two_models(c)
    top = pairs.groupBy("s1_id").agg(F.max("z_a").alias("z")).where("z >= 7").join(c.entities.where("n_true = 0"), "s1_id")
    cases = top.join(c.table("orders").selectExpr("cast(o_orderkey as bigint) s1_id", "o_orderpriority category"), "s1_id").select("s1_id", "category")
    return T.case_effect(pairs, cases, T_A, T_B)


@query("t11_cleared_singletons", f"""with {_TWO}, r as (select *, row_number() over (partition by s1_id order by z_a desc, cand_id) rk, max(z_b) over (partition by s1_id) mb from two), t as (select * from r join entities using (s1_id) where rk = 1 and n_true = 0 and z_a >= {T_A})
 select count(*) n, count(*) filter (num_ok = 0) contradicted, count(*) filter (num_ok = 0 and mb < {T_B}) cleared_contradicted, count(*) filter (num_ok = 1 and mb < {T_B}) cleared_others from t""", "scores")
def _(c):
    return T.cleared_singletons(two_models(c), c.entities, T_A, T_B, F.col("num_ok") == 0)


@query("t12_reference_thresholds", f"""with {CURVE}, pr as (select e.s1_id, n_true, coalesce(n, 0) n, coalesce(k, 0) k from entities e left join (select s1_id, count(*) n, sum(label) k from pairs where z >= ln({T.PRIOR_PROBABILITY} / (1 - {T.PRIOR_PROBABILITY})) group by 1) using (s1_id))
 select 'prior' kind, round(ln({T.PRIOR_PROBABILITY} / (1 - {T.PRIOR_PROBABILITY})), 6) t, round(avg({_F}), 6) macro_f from pr union all (select 'optimal', t, round(avg(f), 6) macro_f from fs group by t order by macro_f desc, t limit 1)""", "scores")
def _(c):
    return T.reference_thresholds(c.pairs, c.entities)


@query("t03_two_level_of_flag", f"with {CURVE}, g as (select t, (s1_id % 6 = 0)::int flag, sum(f) s, count(*) n from fs group by all) select a.t t, b.t t_high, round((a.s + b.s) / (a.n + b.n), 6) macro_f from g a join g b on a.flag = 0 and b.flag = 1 and b.t >= a.t order by macro_f desc, 1, 2 limit 1", "scores")
def _(c):
    flagged = c.entities.withColumn("addr_missing", (F.col("s1_id") % 6 == 0).cast("int"))
    return D.best_two_level(c.pairs, flagged, "addr_missing")
