"""Queries: profiles, ground truth, rarity, forensics, validation."""

from pyspark.sql import functions as F

from erlink.operators import blocking as B
from erlink.operators import metrics as M
from erlink.operators import profile as R
from erlink.plans.fixtures import toks
from erlink.plans.queries_blocking import exact_sql
from erlink.plans.registry import query

_TOK = "len(regexp_extract_all(lower(business_address), '[a-z0-9]+'))"


@query("g13_field_profile", f"with v as (select business_address x, case when business_address <> '' then length(business_address) end l, case when business_address <> '' then {_TOK} end t from raw_pool) select count(*) n, round(100 * avg((x = '')::int), 6) missing_pct, count(distinct nullif(x, '')) n_unique, round(avg(l), 6) mean_chars, quantile_cont(l, 0.5)::double median_chars, quantile_cont(l, 0.95)::double p95_chars, max(l)::bigint max_chars, round(avg(t), 6) mean_tokens, quantile_cont(t, 0.5)::double median_tokens, count(l) - count(distinct nullif(x, '')) n_duplicate from v", "er")
def _(c):
    p = R.field_profile(c.raw_pool, "business_address")
    return p.drop("n_duplicate").withColumn("n_duplicate", F.round(F.col("n") * (100 - F.col("missing_pct")) / 100).cast("bigint") - F.col("n_unique"))


@query("g14_top_tokens", "select token, count(*) n from (select unnest(regexp_extract_all(lower(business_name), '[a-z0-9]+')) token from raw_pool) group by token order by n desc, token limit 30", "er")
def _(c):
    return R.top_tokens(c.raw_pool, "business_name")


@query("g15_country_distribution", "select country, count(*) n, round(100 * count(*) / (select count(*) from raw_pool), 6) pct from raw_pool group by country", "er")
def _(c):
    return R.distribution(c.raw_pool, "country")


@query("g16_code_shares", r"select country, round(avg((regexp_matches(business_address, '[0-9]'))::int), 6) with_number, round(avg((regexp_matches(business_address, '\b\d{5,6}\b'))::int), 6) with_code from raw_pool group by country", "er")
def _(c):
    a = F.col("business_address")
    return c.raw_pool.groupBy("country").agg(F.round(M.share(a.rlike("[0-9]")), 6).alias("with_number"), F.round(M.share(a.rlike(r"\b\d{5,6}\b")), 6).alias("with_code"))


@query("g17_truth_profile", "with n as (select entity_id, (select count(*) from truth where s1_id = entity_id) n from s1) select count(*) n_s1, count(*) filter (n = 0) n_singleton, round(avg(n) filter (n > 0), 6) mean_matches, max(n) max_matches, (select count(*) from truth) n_edges, (select count(*) from truth where cand_id like 'S2-%') s2_edges, (select count(*) from truth where cand_id like 'S3-%') s3_edges, 0::bigint self_edges, (select count(*) from truth where cand_id not in (select entity_id from pool)) unknown_ids from n", "er")
def _(c):
    return R.truth_profile(c.s1, c.pool, c.truth)


@query("g18_claimed_twice", "select cand_id, count(distinct s1_id) n_s1 from truth group by cand_id having count(distinct s1_id) > 1", "er")
def _(c):
    return R.claimed_twice(c.truth)


@query("g19_agreement_rates", f"with h as (select s.name_norm n1, p.name_norm n2, s.address_norm a1, p.address_norm a2, s.country c1, p.country c2, {toks('s.name_norm')} t1, {toks('p.name_norm')} t2 from truth t join s1 s on s.entity_id = t.s1_id join pool p on p.entity_id = t.cand_id), k as (select *, len(list_intersect(t1, t2)) / len(list_distinct(list_concat(t1, t2))) j from h) select round(100 * avg((n1 = n2)::int), 6) exact_name_pct, round(avg(j), 6) mean_jaccard, round(100 * avg((j >= 0.8)::int), 6) jaccard_80_pct, round(100 * avg((a1 = a2)::int), 6) exact_address_pct, round(100 * avg((c1 = c2)::int), 6) country_pct from k", "er")
def _(c):
    from erlink.functions import text as X

    rows = B.hydrate(c.truth, c.s1, c.pool, ("name_norm", "address_norm", "country"))
    a, b = X.tokens(F.col("name_norm_1")), X.tokens(F.col("name_norm_2"))
    rows = rows.withColumn("j", F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
    pct = lambda x: F.round(100 * M.share(x), 6)
    same = lambda x: F.col(f"{x}_1") == F.col(f"{x}_2")
    return rows.agg(pct(same("name_norm")).alias("exact_name_pct"), F.round(F.avg("j"), 6).alias("mean_jaccard"), pct(F.col("j") >= 0.8).alias("jaccard_80_pct"), pct(same("address_norm")).alias("exact_address_pct"), pct(same("country")).alias("country_pct"))


@query("g20_country_agreement", "select s.country c1, p.country c2, count(*) n from truth t join s1 s on s.entity_id = t.s1_id join pool p on p.entity_id = t.cand_id group by all", "er")
def _(c):
    return R.country_agreement(c.s1, c.pool, c.truth)


@query("g21_class_distributions", "select label, round(avg(z), 6) mean, quantile_cont(z, 0.5)::double median, quantile_cont(z, 0.1)::double p10, quantile_cont(z, 0.9)::double p90, 0.0::double missing_pct from pairs group by label", "scores")
def _(c):
    return R.summary(c.pairs, "z", "label")


@query("g22_label_rates", "select feature, value, count(*) n, round(avg(label), 6) label_rate from (select label, 'name_exact' feature, name_exact value from pairs union all select label, 'num_ok', num_ok from pairs union all select label, 'addr_missing', addr_missing from pairs) group by all", "scores")
def _(c):
    long = c.pairs.unpivot(["label"], ["name_exact", "num_ok", "addr_missing"], "feature", "value")
    return long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("label"), 6).alias("label_rate"))


@query("g23_profile_logits", "select name_exact, num_ok, count(*) n, round(avg(1.5 * name_exact + 0.7 * num_ok - 0.2 * addr_missing), 6) mean_logit from pairs group by all", "scores")
def _(c):
    return c.pairs.groupBy("name_exact", "num_ok").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(1.5 * F.col("name_exact") + 0.7 * F.col("num_ok") - 0.2 * F.col("addr_missing")), 6).alias("mean_logit"))


@query("g24_correlation", "select round(corr(z, name_exact), 6) r, round(avg(label) filter (name_exact = 1), 6) p_label_given_exact from pairs", "scores")
def _(c):
    return c.pairs.agg(F.round(F.corr("z", "name_exact"), 6).alias("r"), F.round(F.avg(F.when(F.col("name_exact") == 1, F.col("label"))), 6).alias("p_label_given_exact"))


@query("g26_quantiles", "select quality, round(avg(n_chars), 6) mean, quantile_cont(n_chars, 0.5)::double median, quantile_cont(n_chars, 0.1)::double p10, quantile_cont(n_chars, 0.9)::double p90, round(100 * avg((n_chars is null)::int), 6) missing_pct from labels join documents using (doc_id) group by quality")
def _(c):
    return R.summary(c.table("labels").join(c.table("documents").select("doc_id", "n_chars"), "doc_id"), "n_chars", "quality")


_HYD = "h as (select p.s1_id, p.cand_id, s.country, s.name_norm n1, q.name_norm n2, s.address_norm a1, q.address_norm a2 from e p join s1 s on s.entity_id = p.s1_id join pool q on q.entity_id = p.cand_id)"
_E = f"e as ({exact_sql('name_no_suffix')})"


def _pairs(c):
    return B.hydrate(B.exact_join(c.s1, c.pool, "name_no_suffix"), c.s1, c.pool, ("country", "name_norm", "address_norm"))


_FILL = "(" + ", ".join(repr(t) for t in __import__("erlink.functions.text", fromlist=["x"]).FILLER_TOKENS) + ")"


def _core(x: str) -> str:
    return f"list_filter({toks(x)}, lambda t: t not in {_FILL})"


def _nums(x: str) -> str:
    return rf"list_filter({toks(x)}, lambda t: regexp_matches(t, '\p{{Nd}}') and not regexp_matches(t, '^[1-9]\d{{5}}$'))"


_CASES = f"""{_E}, {_HYD}, m as (select *, {_nums('a1')} x, {_nums('a2')} y, {_core('n1')} c, {_core('n2')} d from h), k as (select *, len(list_intersect(x, y)) kk, len(list_filter(d, lambda t: not list_contains(c, t))) more, len(list_filter(c, lambda t: not list_contains(d, t))) less, len(list_intersect(c, d)) shared from m),
pat as (select *, case when a2 = '' then 'cand_addr_missing' when a1 = '' then 's1_addr_missing' when len(x) = 0 and len(y) = 0 then 'no_numbers' when kk = len(x) and kk = len(y) then 'equal' when len(x) = 0 then 'cand_adds_number' when len(y) = 0 then 'cand_drops_number' when kk = len(x) then 'cand_superset' when kk = len(y) then 'cand_subset' else 'differ' end num_pattern,
 case when more = 0 and less = 0 then 'core_equal' when less = 0 then 'cand_adds_token' when more = 0 then 'cand_drops_token' else 'token_substituted' end name_pattern from k),
cat as (select *, case when num_pattern = 'cand_addr_missing' then 'candidate_address_missing' when shared = 0 then 'shared_address' when num_pattern in ('differ', 'cand_superset', 'cand_subset', 'cand_adds_number', 'cand_drops_number') then 'number_changed' when name_pattern in ('cand_adds_token', 'token_substituted') then 'name_token_changed' else 'possible_truth_omission' end category from pat)"""


@query("x08_x10_categories", f"with {_CASES} select s1_id, cand_id, num_pattern, name_pattern, category from cat", "er")
def _(c):
    return R.categorized(_pairs(c)).select("s1_id", "cand_id", "num_pattern", "name_pattern", "category")


@query("g30_category_by_country", f"with {_CASES} select country, count(*) filter (category = 'number_changed') number_changed, count(*) filter (category = 'possible_truth_omission') possible_truth_omission, count(*) filter (category = 'candidate_address_missing') candidate_address_missing from cat group by country", "er")
def _(c):
    names = ["number_changed", "possible_truth_omission", "candidate_address_missing"]
    return R.categorized(_pairs(c)).groupBy(F.col("country_1").alias("country")).pivot("category", names).count().na.fill(0, names)


@query("x11_added_tokens", f"with {_CASES} select token, count(*) n from (select unnest(list_filter(d, lambda t: not list_contains(c, t))) token from k) group by token order by n desc, token limit 25", "er")
def _(c):
    from erlink.functions import text as X

    added = F.explode(F.array_except(X.core_tokens(F.col("name_norm_2")), X.core_tokens(F.col("name_norm_1"))))
    return _pairs(c).select(added.alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(25)


_T = f"h as (select t.s1_id, t.cand_id, s.name_norm n1, p.name_norm n2, s.address_norm a1, p.address_norm a2, {toks('s.name_norm')} t1, {toks('p.name_norm')} t2, {toks('s.address_norm')} u1, {toks('p.address_norm')} u2 from truth t join s1 s on s.entity_id = t.s1_id join pool p on p.entity_id = t.cand_id), k as (select *, len(list_intersect(t1, t2)) / len(list_distinct(list_concat(t1, t2))) j from h)"


@query("x12_miss_tags", f"with {_T}, g as (select s1_id, cand_id, list_filter([case when j < 0.15 then 'alias' end, case when a1 = '' or a2 = '' then 'address_missing' end, case when a1 <> '' and a2 <> '' and len(list_intersect(u1, u2)) = 0 then 'address_unrelated' end, case when n1 <> '' and n2 <> '' and n1 <> n2 and j >= 0.5 then 'name_variation' end], lambda x: x is not null) tags from k) select s1_id, cand_id, case when len(tags) = 0 then ['other'] else tags end tags from g", "er")
def _(c):
    return R.miss_tags(B.hydrate(c.truth, c.s1, c.pool, ("name_norm", "address_norm"))).select("s1_id", "cand_id", "tags")


_IDF = f"idfs as (select t.country, token, count(*) df, ln((any_value(n) + 1) / (count(*) + 1)) + 1 idf from (select country, entity_id, unnest({toks('name_norm')}) token from pool) t join (select country, count(*) n from pool group by all) using (country) group by t.country, token)"


@query("x04_idf", f"with {_IDF} select country, token, df, round(idf, 6) idf from idfs", "er")
def _(c):
    return R.token_idf(c.pool, "name_norm").select("country", "token", "df", F.round("idf", 6).alias("idf"))


@query("x05_pair_rarity", f"with {_IDF}, {_E}, {_HYD}, w as (select s1_id, cand_id, country, unnest(list_distinct(list_concat({toks('n1')}, {toks('n2')}))) token, {toks('n1')} t1, {toks('n2')} t2 from h), v as (select *, list_contains(t1, token) and list_contains(t2, token) sh from w join idfs using (country, token)) select s1_id, cand_id, round(coalesce(sum(idf) filter (sh), 0), 6)::double shared_idf_sum, round(coalesce(max(idf) filter (sh), 0), 6)::double shared_idf_max, min(df) filter (sh) shared_min_df, round(coalesce(sum(idf) filter (sh), 0) / sum(idf), 6)::double idf_jaccard, round(coalesce(max(idf) filter (not sh), 0), 6)::double diff_idf_max from v group by all", "er")
def _(c):
    return R.pair_rarity(_pairs(c), R.token_idf(c.pool, "name_norm"), "name_norm")


@query("x03_value_frequency", "select country, name_no_suffix, count(*) n from pool where (country, name_no_suffix) in (select (country, name_no_suffix) from s1) group by all", "er")
def _(c):
    return R.value_frequency(c.pool, c.s1, "name_no_suffix")


@query("x06_population_frequency", "select country, name_norm, address_norm, count(*) n from s1 group by all", "er")
def _(c):
    return c.s1.groupBy("country", "name_norm", "address_norm").agg(F.count(F.lit(1)).alias("n"))


@query("x07_claims_of_candidates", f"with {_E} select e.s1_id, e.cand_id, t.s1_id claimed_by from e join truth t on t.cand_id = e.cand_id and t.s1_id <> e.s1_id", "er")
def _(c):
    claimed = c.truth.select("cand_id", F.col("s1_id").alias("claimed_by"))
    return B.exact_join(c.s1, c.pool, "name_no_suffix").join(claimed, "cand_id").where("claimed_by <> s1_id").select("s1_id", "cand_id", "claimed_by")


@query("x01_case_groups", "with r as (select *, row_number() over (partition by s1_id order by z desc, cand_id) rk from pairs join entities using (s1_id)) select s1_id, cand_id, case when rk = 1 and n_true = 0 and z >= 10 then 'C' when rk = 1 and n_true > 0 and label = 0 and z >= 10 then 'D' when label = 1 and z >= 10 then 'A_acc' when label = 1 then 'A' else 'B' end grp from r", "scores")
def _(c):
    from erlink.operators.decide import ranked

    top, high = F.col("rank") == 1, F.col("z") >= 10
    group = F.when(top & (F.col("n_true") == 0) & high, "C").when(top & (F.col("n_true") > 0) & (F.col("label") == 0) & high, "D").when((F.col("label") == 1) & high, "A_acc").when(F.col("label") == 1, "A").otherwise("B")
    return ranked(c.pairs).join(c.entities, "s1_id").select("s1_id", "cand_id", group.alias("grp"))


@query("x02_contributions", "with m as (select avg(z) a, stddev_pop(z) b, avg(num_ok) c, stddev_pop(num_ok) d from pairs) select s1_id, cand_id, round(2.0 * (z - a) / b, 6) from_z, round(-0.5 * (num_ok - c) / d, 6) from_num_ok from pairs, m", "scores")
def _(c):
    from erlink.operators.model import LinearModel, moments

    mean, scale = moments(c.pairs, ["z", "num_ok"])
    m = LinearModel(("z", "num_ok"), mean, scale, (2.0, -0.5), 0.0)
    return c.pairs.select("s1_id", "cand_id", F.round(m.contribution(0), 6).alias("from_z"), F.round(m.contribution(1), 6).alias("from_num_ok"))


@query("x13_case_table", f"with {_CASES} select s1_id, cand_id, country, n1 name_norm_1, n2 name_norm_2, a1 address_norm_1, a2 address_norm_2, category, (select min(t.s1_id) from truth t where t.cand_id = cat.cand_id) claimed_by from cat", "er")
def _(c):
    claims = c.truth.groupBy("cand_id").agg(F.min("s1_id").alias("claimed_by"))
    return R.categorized(_pairs(c)).join(claims, "cand_id", "left").select("s1_id", "cand_id", F.col("country_1").alias("country"), "name_norm_1", "name_norm_2", "address_norm_1", "address_norm_2", "category", "claimed_by")
