"""Queries: address numbers, pair features, the model, and matching end to end."""

from pyspark.sql import functions as F

from erlink.functions import address as A
from erlink.functions import text as X
from erlink.operators import blocking as B
from erlink.operators import decide as D
from erlink.operators import features as P
from erlink.operators import metrics as M
from erlink.operators import model as L
from erlink.operators import pair_scan as S
from erlink.plans.fixtures import Context, toks
from erlink.plans.queries_blocking import config_ctes
from erlink.plans.registry import query
from erlink.sources.scratch import materialize

#: Own choice: weights of the score that built-in features alone can give, for plans without a trained model.
WEIGHTS = {"name_exact": 2.0, "name_nosuffix_exact": 2.0, "name_token_jaccard": 4.0, "address_token_jaccard": 5.0, "street_number_equal": 2.5, "address_exact": 1.5}
BIAS = -3.0


def records(c: Context, side: str):
    """Normalized records with their transliterated names and address numbers, once per record."""
    raw = c.source("s1") if side == "s1" else c.raw_pool
    norm = c.s1 if side == "s1" else c.pool
    raw = raw.repartition(4 * c.spark.sparkContext.defaultParallelism, "entity_id")  # small files are few tasks, and numbers cost the most of a record
    numbers = A.numbers_of(raw).drop("country")
    translit = raw.select("entity_id", X.clean(X.transliterate(F.coalesce("business_name", F.lit("")))).alias("name_translit"))
    return materialize(norm.join(translit, "entity_id").join(numbers, "entity_id"), "records")


#: The configuration of the match, the features and the models.
CONFIG = "D3"


def base_pairs(c: Context, config: str = CONFIG):
    """Candidates of a configuration with the columns that built-in features need."""
    plain = [x for x in P.RECORD_COLUMNS if x != "name_translit"]
    return B.hydrate(B.candidates(c.s1, c.pool, B.CONFIGS[config]), c.s1, c.pool, (*plain, *P.TOKEN_COLUMNS))


def compared(c: Context, config: str = CONFIG, full: bool = True):
    """A configuration's candidates, to be compared where they are united; full: with similarities and address numbers."""
    channels = B.CONFIGS[config]
    s1, pool = (records(c, "s1"), records(c, "pool")) if full else (c.s1, c.pool)
    return S.Compared(B.asked(c.s1, c.pool, channels), s1, pool, c.truth, tuple(x.name for x in channels), B.least_overlaps(channels), full)


def feature_pairs(c: Context, config: str = CONFIG):
    """All 42 features of a configuration's candidates, with labels."""
    features = (*P.BASE_FEATURES, *P.NUMBER_FEATURES)
    return compared(c, config).scan(f"s1_id string, cand_id string, {S.schema_of(features)}, label int", S.rows_of(features))


def numbers_ok(rows):
    return ((F.col("num_hn_head_equal") == 1) & (F.col("num_hn_head_mismatch") == 0) & (F.col("num_compound_mismatch") == 0) & (F.col("num_token_contradiction") == 0)).cast("int")


def numbers_agree(values):
    """numbers_ok of a batch's arrays."""
    return values["num_hn_head_equal"] & ~values["num_hn_head_mismatch"] & ~values["num_compound_mismatch"] & ~values["num_token_contradiction"]


#: S1s whose pairs give the fit of all pairs its first point.
START_S1 = 2000


def fit_all(scan, half, features: tuple[str, ...]):
    """The logistic model of all pairs whose S1 is in half. The pairs of a few S1s only give the point from which its steps begin."""
    few = half & (F.pmod(F.xxhash64("s1_id", F.lit(1)), F.lit(max(1, scan.asked.n_s1 // START_S1))) == 0)
    first = scan.scan(f"s1_id string, cand_id string, {S.schema_of(features)}, label int", S.rows_of(features), scan.dealt(few))
    start = L.fit(materialize(first, "start-rows"), features)
    dealt = scan.dealt(half).persist()
    try:
        return L.fit_sums(lambda mean, scale, at: scan.scan(S.SUMS, S.sums_of(features, mean, scale, at), dealt).collect(), start)
    finally:
        dealt.unpersist()


def match_query(c: Context):
    """Block, compare, score with a model trained on the even keys' labels, decide with the final rule: one row per accepted pair."""
    scan = compared(c)
    model = fit_all(scan, F.crc32("s1_id") % 2 == 0, tuple(f for f in (*P.BASE_FEATURES, *P.NUMBER_FEATURES) if f != "country_equal"))
    # The rule accepts no pair below its lower threshold, and no such pair changes what it does with the others.
    scored = scan.scan("s1_id string, cand_id string, z double, label int, num_ok int", S.scores_of([model], D.T_LOW, numbers_agree))
    return D.rule_h2(scored).select("s1_id", "cand_id", F.round("z", 4).alias("z"), "label")


def j(a: str, b: str, both: str, prefix: str) -> str:
    union = f"(len({a}) + len({b}) - {both})"
    return f"""(case when {union} = 0 then 1.0 else {both} / {union} end)::double {prefix}_token_jaccard, {both}::int {prefix}_token_overlap_count,
  (case when {union} = 0 then 1.0 when least(len({a}), len({b})) = 0 then 0.0 else {both} / least(len({a}), len({b})) end)::double {prefix}_token_containment"""


#: DuckDB's features of the candidates; the sets a record has once meet in pairs.
FEATURES = f"""{config_ctes(CONFIG)}, hyd as (select cand.*, s.country c1, p.country c2, s.name_norm n1, p.name_norm n2, s.name_no_suffix f1, p.name_no_suffix f2, s.address_norm a1, p.address_norm a2, s.street_number h1, p.street_number h2, s.postal_run p1, p.postal_run p2,
  s.name_norm_tokens nt1, p.name_norm_tokens nt2, s.address_norm_tokens at1, p.address_norm_tokens at2, len(list_intersect(s.name_norm_tokens, p.name_norm_tokens)) nk, len(list_intersect(s.address_norm_tokens, p.address_norm_tokens)) ak, len(list_intersect(s.address_norm_digits, p.address_norm_digits)) dk
  from cand join s1 s on s.entity_id = s1_id join pool p on p.entity_id = cand_id),
feat as (select s1_id, cand_id, (n1 = n2)::int name_exact, (f1 = f2)::int name_nosuffix_exact, {j('nt1', 'nt2', 'nk', 'name')}, abs(length(n1) - length(n2))::int name_len_diff, (a1 = a2 and a1 <> '')::int address_exact, (a1 = '')::int address_missing_s1, (a2 = '')::int address_missing_cand,
  {j('at1', 'at2', 'ak', 'address')}, dk::int address_numeric_token_overlap, (h1 = h2 and h1 <> '')::int street_number_equal, (p1 = p2 and p1 <> '')::int postal_equal, (c1 = c2)::int country_equal, from_b1 + from_b2 + from_b3 + from_b5 + from_b7a n_channels_hit from hyd),
scored as (select *, round({BIAS} + {' + '.join(f'{w} * {f}' for f, w in WEIGHTS.items())}, 9) z from feat)"""

NAMES = ["name_exact", "name_nosuffix_exact", "name_token_jaccard", "name_token_overlap_count", "name_token_containment", "name_len_diff"]
ADDRESSES = ["address_exact", "address_missing_s1", "address_missing_cand", "address_token_jaccard", "address_token_overlap_count", "address_token_containment", "address_numeric_token_overlap", "street_number_equal", "postal_equal"]
ROUNDED = {"name_token_jaccard", "name_token_containment", "address_token_jaccard", "address_token_containment"}


def _picked(names: list[str]) -> str:
    return ", ".join(f"round({n}, 6) {n}" if n in ROUNDED else n for n in names)


def _spark_picked(names: list[str]):
    return [F.round(n, 6).alias(n) if n in ROUNDED else F.col(n) for n in names]


for _name, _columns in (("f01_f05_f10_name_features", NAMES), ("f11_f19_address_features", ADDRESSES), ("f21_f28_channel_features", ["country_equal", "n_channels_hit"])):
    query(_name, f"with {FEATURES} select s1_id, cand_id, {_picked(_columns)} from feat", "er")(lambda c, columns=_columns: P.sql_features(base_pairs(c)).select("s1_id", "cand_id", *_spark_picked(columns)))


def plain_scored(c: Context):
    rows = P.sql_features(base_pairs(c))
    z = F.lit(BIAS)
    for f, w in WEIGHTS.items():
        z = z + w * F.col(f)
    return rows.withColumn("z", F.round(z, 9))


@query("m03_linear_score", f"with {FEATURES} select s1_id, cand_id, round(z, 6) + 0.0 z from scored", "er")
def _(c):
    return plain_scored(c).select("s1_id", "cand_id", (F.round("z", 6) + 0.0).alias("z"))


@query("m01_standardize", f"""with {config_ctes(CONFIG)}, w as (select s1_id, cand_id, len(s.name_norm_tokens) x, len(p.name_norm_tokens) y, len(list_intersect(s.name_norm_tokens, p.name_norm_tokens)) k, abs(length(s.name_norm) - length(p.name_norm))::int name_len_diff
 from cand join s1 s on s.entity_id = s1_id join pool p on p.entity_id = cand_id), feat as (select s1_id, cand_id, (case when x + y = 0 then 1.0 else k / (x + y - k) end)::double name_token_jaccard, name_len_diff from w),
 m as (select avg(name_token_jaccard) a, stddev_pop(name_token_jaccard) b, avg(name_len_diff) c, stddev_pop(name_len_diff) d from feat) select s1_id, cand_id, round((name_token_jaccard - a) / b, 6) name_token_jaccard, round((name_len_diff - c) / d, 6) name_len_diff from feat, m""", "er")
def _(c):
    rows = P.sql_features(base_pairs(c)).select("s1_id", "cand_id", "name_token_jaccard", "name_len_diff")
    names = ["name_token_jaccard", "name_len_diff"]
    return L.standardized(rows, names, *L.moments(rows, names)).select("s1_id", "cand_id", *(F.round(n, 6).alias(n) for n in names))


@query("match_rule_a", f"with {FEATURES} select s1_id, cand_id from scored where z >= 6.0", "er")
def _(c):
    return D.rule_a(plain_scored(c), 6.0).select("s1_id", "cand_id")


@query("match_evaluation", f"""with {FEATURES}, pred as (select s1_id, cand_id, (t.cand_id is not null)::int label from scored left join truth t using (s1_id, cand_id) where z >= 6.0),
 e as (select entity_id s1_id, country, (select count(*) from truth t where t.s1_id = entity_id) n_true from s1), cnt as (select e.*, coalesce(n, 0) n, coalesce(k, 0) k from e left join (select s1_id, count(*) n, sum(label) k from pred group by all) using (s1_id))
 select country, count(*) n_s1, round(avg(case when n > 0 then k / n else 1.0 end), 6) macro_p, round(avg(case when n_true > 0 then k / n_true else 1.0 end), 6) macro_r, round(avg(case when n_true = 0 and n = 0 then 1.0 when n_true = 0 or n = 0 or k = 0 then 0.0 else 1.25 * (k / n) * (k / n_true) / (0.25 * k / n + k / n_true) end), 6) macro_f from cnt group by country""", "er")
def _(c):
    n_true = c.truth.groupBy(F.col("s1_id").alias("entity_id")).agg(F.count(F.lit(1)).alias("n_true"))
    entities = c.s1.select("entity_id", "country").join(n_true, "entity_id", "left").na.fill(0, ["n_true"]).withColumnRenamed("entity_id", "s1_id")
    predicted = B.with_labels(D.rule_a(plain_scored(c), 6.0).select("s1_id", "cand_id"), c.truth)
    return M.macro(M.entity_scores(entities, predicted), "country")


@query("match_end_to_end")
def _(c):
    return match_query(c)


@query("a07_address_numbers", r"""with n as (select entity_id, country, list_transform(regexp_extract_all(business_address, '[0-9]+'), lambda x: case when ltrim(x, '0') = '' then '0' else ltrim(x, '0') end) num, ltrim(regexp_extract(lower(business_address), 'unit ([0-9]+)', 1), '0') unit from raw_pool)
 select entity_id, country, coalesce(num[1], '') primary_house_number, coalesce(num[1], '') house_head, coalesce(num[1], '') house_atoms, '' compound_number, unit unit_number, '' postal_strict, array_to_string(list_transform(list_sort(list_transform(list_distinct(num), lambda x: lpad(x, 9, '0'))), lambda x: case when ltrim(x, '0') = '' then '0' else ltrim(x, '0') end), ' ') number_tokens from n""", "er")
def _(c):
    return A.numbers_of(c.raw_pool)


@query("a05_zero_strip", "select entity_id, regexp_replace(' ' || business_address, '([^0-9])0+([0-9])', '\\1\\2', 'g')[2:] stripped from raw_pool", "er")
def _(c):
    return c.raw_pool.select("entity_id", A.zero_stripped(F.col("business_address")).alias("stripped"))


#: A simple extractor that both engines can say: the first number, the unit after "Unit", all numbers.
SIMPLE = r"""nums as (select entity_id, country, list_transform(regexp_extract_all(business_address, '[0-9]+'), lambda x: case when ltrim(x, '0') = '' then '0' else ltrim(x, '0') end) num, case when regexp_extract(lower(business_address), 'unit ([0-9]+)', 1) = '' then '' else ltrim(regexp_extract(lower(business_address), 'unit ([0-9]+)', 1), '0') end unit from (select * from raw1 union all select * from raw_pool)),
simple as (select entity_id, country, coalesce(num[1], '') head, unit, list_distinct(num) num from nums)"""


def simple_numbers(c: Context):
    raw = c.source("s1").unionByName(c.raw_pool)
    num = F.transform(F.regexp_extract_all(F.col("business_address"), F.lit("[0-9]+"), F.lit(0)), lambda x: F.regexp_replace(x, "^0+(?=.)", ""))
    unit = F.regexp_replace(F.regexp_extract(F.lower("business_address"), "unit ([0-9]+)", 1), "^0+", "")
    rows = raw.select("entity_id", "country", num.alias("num"), unit.alias("unit_number"))
    return rows.select("entity_id", "country", F.coalesce(F.get("num", F.lit(0)), F.lit("")).alias("house_head"), F.lit("").alias("compound_number"), F.lit("").alias("postal_strict"), "unit_number", F.array_join(F.array_distinct("num"), " ").alias("number_tokens")).withColumn("primary_house_number", F.col("house_head"))


@query("a09_field_coverage", f"with {SIMPLE} select country, round(100 * avg((head <> '')::int), 6) house_head, round(100 * avg((unit <> '')::int), 6) unit_number, round(100 * avg((len(num) > 0)::int), 6) number_tokens from simple group by country", "er")
def _(c):
    return A.coverage(simple_numbers(c).select("entity_id", "country", "house_head", "unit_number", "number_tokens"))


@query("f29_f41_number_features", f"""with {SIMPLE}, {config_ctes(CONFIG)}, h as (select s1_id, cand_id, a.head h1, b.head h2, a.unit u1, b.unit u2, a.num x, b.num y, len(list_intersect(a.num, b.num)) k from cand join simple a on a.entity_id = s1_id join simple b on b.entity_id = cand_id)
 select s1_id, cand_id, (h1 <> '' and h2 <> '' and h1 = h2)::int num_hn_head_equal, (h1 <> '' and h2 <> '' and h1 <> h2)::int num_hn_head_mismatch, (u1 <> '' and u2 <> '' and u1 = u2)::int num_unit_equal, (u1 <> '' and u2 <> '' and u1 <> u2)::int num_unit_mismatch,
 round(case when len(x) = 0 or len(y) = 0 then 0.0 else k / (len(x) + len(y) - k) end, 6)::double num_token_jaccard, least(k, 5)::int num_token_overlap, (k < len(x) and k < len(y))::int num_token_contradiction, least(len(x) + len(y) - 2 * k, 5)::int num_token_symdiff from h""", "er")
def _(c):
    n = simple_numbers(c)
    pairs = B.hydrate(B.candidates(c.s1, c.pool, B.CONFIGS[CONFIG]).select("s1_id", "cand_id"), n, n, P.NUMBER_COLUMNS)
    names = ("num_hn_head_equal", "num_hn_head_mismatch", "num_unit_equal", "num_unit_mismatch", "num_token_overlap", "num_token_contradiction", "num_token_symdiff")
    return P.number_features(pairs).select("s1_id", "cand_id", F.round("num_token_jaccard", 6).alias("num_token_jaccard"), *names)


@query("f06_f09_f20_f42_similarities")
def _(c):
    return feature_pairs(c).select("s1_id", "cand_id", *P.BASE_FEATURES, *P.NUMBER_FEATURES, "label")


@query("m02_logistic_fit")
def _(c):
    rows = B.with_labels(P.sql_features(base_pairs(c)), c.truth)
    m = L.fit(rows, list(WEIGHTS))
    return c.spark.createDataFrame([(f, a, s, w, m.intercept) for f, a, s, w in zip(m.features, m.mean, m.scale, m.coef, strict=True)], "feature string, mean double, scale double, coef double, intercept double")


@query("m04_boosted_trees")
def _(c):
    rows = B.with_labels(P.sql_features(base_pairs(c)), c.truth)
    trees, data = L.fit_trees(rows, list(WEIGHTS), rounds=200)
    return trees.transform(data).groupBy("label", F.col("prediction").cast("int").alias("predicted")).agg(F.sum("_n").alias("n"))


@query("t05_ablation")
def _(c):
    """Fit on even keys, tune the threshold there, evaluate on odd keys: with names only, with addresses, with both."""
    scan, half = compared(c, full=False), F.crc32("s1_id") % 2
    columns = [x for x in (*NAMES, *ADDRESSES) if x != "postal_equal"]
    sets = {"names": list(NAMES), "addresses": [x for x in columns if x in ADDRESSES], "both": columns}
    counted = scan.scan(f"{S.schema_of(columns)}, label int, n bigint", S.counts_of(columns), scan.dealt(half == 0))
    counted = L.distinct_rows(counted, columns, times="n")
    models = [L.fit(counted, x, times="_n") for x in sets.values()]
    # No threshold of the grid is below its first, so pairs that no model scores so high are in no result.
    zs = ", ".join(f"z_{k} double" for k in range(len(models)))
    found = materialize(scan.scan(f"s1_id string, cand_id string, {zs}, label int", S.scores_of(models, D.GRID_FIRST)), "ablation-scores")
    n_true = c.truth.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n_true"))
    entities = c.s1.select(F.col("entity_id").alias("s1_id"), "country").join(n_true, "s1_id", "left").na.fill(0, ["n_true"])
    out = []
    for k, name in enumerate(sets):
        scored = found.select("s1_id", "cand_id", F.col(f"z_{k}").alias("z"), "label")
        t = D.best_threshold(scored.where(half == 0), entities.where(half == 0)).first()["t"]
        result = M.macro(M.entity_scores(entities.where(half == 1), D.rule_a(scored.where(half == 1), t))).first()
        out.append((name, t, result["macro_f"]))
    return c.spark.createDataFrame(out, "features string, t double, macro_f double")


@query("t09_frozen_replication")
def _(c):
    """The model and threshold of one half, frozen, on the other half: per-country measures."""
    rows = B.with_labels(P.sql_features(base_pairs(c)), c.truth)
    half = F.crc32("s1_id") % 2
    scored = L.scored(rows.where(half == 1), L.fit(rows.where(half == 0), list(WEIGHTS)))
    n_true = c.truth.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n_true"))
    entities = c.s1.select(F.col("entity_id").alias("s1_id"), "country").join(n_true, "s1_id", "left").na.fill(0, ["n_true"]).where(half == 1)
    return M.macro(M.entity_scores(entities, D.rule_a(scored, 3.0)), "country")
