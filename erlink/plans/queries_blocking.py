"""Queries: blocking, provenance, and the measures of candidate sets."""

from pyspark.sql import functions as F

from erlink.functions import text as X
from erlink.operators import blocking as B
from erlink.operators import metrics as M
from erlink.plans.fixtures import _duck_norm, _duck_source, toks
from erlink.plans.queries_text import _ngram_sql
from erlink.plans.registry import query


def exact_sql(key: str, max_df: int | None = None) -> str:
    cap = f" and (p.country, p.{key}) in (select (country, {key}) from pool group by country, {key} having count(*) <= {max_df})" if max_df else ""
    return f"select s.entity_id s1_id, p.entity_id cand_id from s1 s join pool p on s.country = p.country and s.{key} = p.{key} and s.{key} <> ''{cap}"


def token_ctes(n: str, tokens: str, max_df: int, k: int, least: int = 1) -> str:
    return f"""{n}_p as (select distinct country, entity_id cand_id, unnest({tokens}) token from pool),
{n}_df as (select country, token, count(*) df from {n}_p group by all having count(*) <= {max_df}),
{n}_q as (select s1_id, country, token, df from (select q.*, df, row_number() over (partition by s1_id order by df, token) rk from
  (select distinct country, entity_id s1_id, unnest({tokens}) token from s1) q join {n}_df using (country, token)) where rk <= {k}),
{n} as (select s1_id, cand_id, count(*) overlap from {n}_q join {n}_p using (country, token) group by all having count(*) >= {least})"""


def config_ctes(name: str) -> str:
    """DuckDB's candidates of a named configuration: s1_id, cand_id and flags, as cand."""
    ctes, parts, channels = [], [], B.CONFIGS[name]
    for c in channels:
        if c.kind == "exact":
            ctes.append(f"{c.name} as ({exact_sql(c.column, c.max_df)})")
        else:
            words = f"(select {_ngram_sql(c.ngram)} from (select replace({c.column}, ' ', '') x))" if c.ngram else f"{c.column}_tokens"
            ctes.append(token_ctes(c.name, words, c.max_df, c.k, c.min_overlap))
        parts.append(f"select s1_id, cand_id, '{c.name}' ch from {c.name}")
    flags = ", ".join(f"max((ch = '{c.name}')::int) from_{c.name}" for c in channels)
    return ",\n".join(ctes) + f",\ncand as (select s1_id, cand_id, {flags} from ({' union all '.join(parts)}) group by all)"


D3 = config_ctes("D3")
FLAGS = ", ".join(f"from_{c.name}" for c in B.CONFIGS["D3"])


def d3(c, config="D3"):
    return B.candidates(c.s1, c.pool, B.CONFIGS[config])


@query("b01_exact_index", "select country, name_norm \"key\", entity_id cand_id from pool where name_norm <> ''", "er")
def _(c):
    return B.exact_index(c.pool, "name_norm")


@query("b02_exact_index_capped", "select country, street_number \"key\", entity_id cand_id from pool where street_number <> '' and (country, street_number) in (select (country, street_number) from pool group by all having count(*) <= 2)", "er")
def _(c):
    return B.exact_index(c.pool, "street_number", 2)


for _name, _key, _cap in (("b03_exact_name", "name_norm", None), ("b03_exact_no_suffix", "name_no_suffix", None), ("b03_postal_run", "postal_run", None), ("b03_street_number", "street_number", None), ("b03_street_number_capped", "street_number", 3)):
    query(_name, exact_sql(_key, _cap), "er")(lambda c, key=_key, cap=_cap: B.exact_join(c.s1, c.pool, key, cap))


@query("b04_document_frequency", f"select country, token, count(*) df from (select distinct country, entity_id, unnest({toks('name_norm')}) token from pool) group by all", "er")
def _(c):
    return B.document_frequency(B.postings(c.pool, X.tokens(F.col("name_norm")), "cand_id"))


@query("b05_postings_in_range", f"with p as (select distinct country, entity_id cand_id, unnest({toks('address_norm')}) token from pool) select p.* from p join (select country, token from p group by all having count(*) between 2 and 20) using (country, token)", "er")
def _(c):
    p = B.postings(c.pool, X.tokens(F.col("address_norm")), "cand_id")
    return p.join(B.document_frequency(p, 2, 20).select("country", "token"), ["country", "token"], "left_semi")


_TOKEN_JOINS = {
    "b06_token_or_name": ("name_norm", 500, 4, 1, 0),
    "b06_token_or_address": ("address_norm", 2000, 6, 1, 0),
    "b07_min_overlap_name": ("name_norm", 500, 6, 2, 0),
    "b07_min_overlap_address": ("address_norm", 2000, 6, 2, 0),
    "b09_rare_address": ("address_norm", 500, 2, 1, 0),
    "b10_ngram3": ("name_norm", 3000, 12, 1, 3),
    "b10_ngram4": ("name_norm", 500, 12, 1, 4),
}
for _name, (_col, _df, _k, _m, _n) in _TOKEN_JOINS.items():
    _words = f"(select {_ngram_sql(_n)} from (select replace({_col}, ' ', '') x))" if _n else toks(_col)
    query(_name, f"with {token_ctes('t', _words, _df, _k, _m)} select s1_id, cand_id, overlap from t", "er")(
        lambda c, col=_col, df=_df, k=_k, m=_m, n=_n: B.dense_token_join(c.s1, c.pool, B.column_ngrams(col, n), df, k, m) if n else B.token_join(c.s1, c.pool, B.column_tokens(col), df, k, m)
    )

#: Names with an accent on one side: only their transliterations share tokens.
_ACCENTED = f"s1 as (select entity_id, country, {toks(_duck_norm('strip_accents(a)'))} tokens from (select *, replace(business_name, 'e', 'é') a from raw1)), pool as (select entity_id, country, {toks(_duck_norm('strip_accents(business_name)'))} tokens from raw_pool)"


@query("b08_translit_tokens", f"with raw1 as ({_duck_source('s1')}), raw_pool as ({_duck_source('s2')} union all {_duck_source('s3')}), {_ACCENTED}, {token_ctes('t', 'tokens', 500, 6)} select s1_id, cand_id, overlap from t")
def _(c):
    translit = lambda rows, name: rows.select("entity_id", "country", X.clean(X.transliterate(name)).alias("name_translit"))
    return B.token_join(translit(c.source("s1"), F.expr("replace(business_name, 'e', 'é')")), translit(c.raw_pool, F.col("business_name")), B.column_tokens("name_translit"), 500, 6)


for _name in B.CONFIGS:
    query(f"b12_config_{_name.lower()}", f"with {config_ctes(_name)} select * from cand", "er")(lambda c, name=_name: B.candidates(c.s1, c.pool, B.CONFIGS[name]))


@query("b11_channel_provenance", f"with {D3} select {FLAGS}, count(*) n from cand group by all", "er")
def _(c):
    flags = [f"from_{x.name}" for x in B.CONFIGS["D3"]]
    return d3(c).groupBy(*flags).agg(F.count(F.lit(1)).alias("n"))


@query("b13_labels", f"with {D3} select cand.*, (t.cand_id is not null)::int label from cand left join truth t using (s1_id, cand_id)", "er")
def _(c):
    return B.with_labels(d3(c), c.truth)


@query("b14_leak_checks", f"with {D3} select count(*) n_pairs, sum((s.country <> p.country)::int)::bigint cross_country, sum((not regexp_matches(cand_id, '^S[23]-'))::int)::bigint bad_prefix, (count(*) - count(distinct (s1_id, cand_id)))::bigint duplicates from cand join s1 s on s.entity_id = s1_id join pool p on p.entity_id = cand_id", "er")
def _(c):
    return B.leak_checks(d3(c), c.s1, c.pool)


@query("b15_hydrated_pairs", f"with {D3} select s1_id, cand_id, s.name_norm name_norm_1, p.name_norm name_norm_2, s.address_norm address_norm_1, p.address_norm address_norm_2 from cand join s1 s on s.entity_id = s1_id join pool p on p.entity_id = cand_id", "er")
def _(c):
    return B.hydrate(d3(c).select("s1_id", "cand_id"), c.s1, c.pool, ("name_norm", "address_norm"))


@query("b16_number_hydration", f"with {D3} select s1_id, cand_id, coalesce(p.postal_run, '') postal_run_2 from cand left join (select * from pool where postal_run <> '') p on p.entity_id = cand_id", "er")
def _(c):
    return B.hydrate_left(d3(c).select("s1_id", "cand_id"), c.pool.where("postal_run <> ''"), "cand_id", "_2", ("postal_run",))


RECALL_SQL = """(select count(*) from truth)::bigint true_edges, (select count(*) from cand join truth using (s1_id, cand_id))::bigint found_edges,
 round((select count(*) from cand join truth using (s1_id, cand_id)) / (select count(*) from truth), 6) recall,
 round(avg(n), 6) mean_cand, quantile_cont(n, 0.5)::double median_cand, quantile_cont(n, 0.95)::double p95_cand, quantile_cont(n, 0.99)::double p99_cand, max(n)::bigint max_cand,
 round(1 - avg(n) / (select count(*) from pool), 6) reduction
 from (select entity_id, count(cand_id) n from s1 left join cand on s1_id = entity_id group by all)"""


@query("g05_blocking_recall", f"with {D3} select {RECALL_SQL}", "er")
def _(c):
    return M.blocking_recall(c.s1, c.pool, c.truth, d3(c))


@query("g06_scale_projection", f"with {D3} select round(avg(n) * 1732544, 3) pairs, round(avg(n) * 1732544 * 13 / 1e6, 3) file_mb from (select entity_id, count(cand_id) n from s1 left join cand on s1_id = entity_id group by all)", "er")
def _(c):
    return M.scale_projection(c.s1, d3(c))


@query("g07_entity_retention", f"""with {D3}, e as (select t.s1_id, count(*) n_true, count(cand.cand_id) kept from truth t left join cand using (s1_id, cand_id) group by all)
select case when n_true = 1 then '1' when n_true <= 3 then '2-3' when n_true <= 5 then '4-5' else '6+' end bucket, country, count(*) n_s1, round(100 * avg((kept = n_true)::int), 6) pct_all, round(100 * avg((kept > 0)::int), 6) pct_any, round(100 * avg((kept = 0)::int), 6) pct_none,
 round(avg(case when kept < n_true then n_true - kept end), 6) missed_per_affected from e join s1 on s1.entity_id = s1_id group by all""", "er")
def _(c):
    return M.entity_retention(c.s1, c.truth, d3(c))


@query("g08_channel_attribution", f"""with {D3} select count(*) filter (nm and not ad) name_only, count(*) filter (ad and not nm) address_only, count(*) filter (nm and ad) both_sides, count(*) filter (not nm and not ad) neither from
 (select coalesce(greatest(from_b1, from_b2, from_b3), 0) = 1 nm, coalesce(greatest(from_b5, from_b7a), 0) = 1 ad from truth left join cand using (s1_id, cand_id))""", "er")
def _(c):
    return M.channel_attribution(c.truth, d3(c), ("b1", "b2", "b3"), ("b5", "b7a"))


@query("g09_exclusive_contribution", f"with {D3} select count(*) only_b5 from truth join cand using (s1_id, cand_id) where from_b5 = 1 and from_b1 + from_b2 + from_b3 + from_b7a = 0", "er")
def _(c):
    return M.exclusive_contribution(c.truth, d3(c), "b5")


#: Grids of the sweeps.
MAX_DFS, TOP_KS, STREET_CAPS, NGRAM_DFS = (500, 1000, 3000, 5000, 10000, 25000), (1, 2, 3, 4, 6, 8), (100, 250, 500, 1000, 2000, 5000), (500, 1000, 2000)
#: name: (column, n-gram or 0, greatest max_df, K, grid, what is limited)
SWEEPS = {
    "name_max_df": ("name_norm", 0, MAX_DFS[-1], 6, MAX_DFS, "df"),
    "name_top_k": ("name_norm", 0, MAX_DFS[0], TOP_KS[-1], TOP_KS, "rank"),
    "address_max_df": ("address_norm", 0, MAX_DFS[-1], 8, MAX_DFS, "df"),
    "ngram4_max_df": ("name_norm", 4, NGRAM_DFS[-1], 12, NGRAM_DFS, "df"),
}


def _sweep_sql(name: str, hits: str, limit: str, grid) -> str:
    return f"""(with {hits}, pr as (select s1_id, cand_id, min({limit}) v from h group by all), hit as (select pr.* from pr join truth using (s1_id, cand_id))
 select '{name}' sweep, g::int "value", (select count(*) from pr where v <= g)::bigint n_pairs, round((select count(*) from hit where v <= g) / (select count(*) from truth), 6) recall from (select unnest({list(grid)}) g))"""


def _token_hits_sql(column: str, n: int, max_df: int, k: int) -> str:
    words = f"(select {_ngram_sql(n)} from (select replace({column}, ' ', '') x))" if n else f"{column}_tokens"
    return f"{token_ctes('t', words, max_df, k)}, rk as (select *, row_number() over (partition by s1_id order by df, token) rank from t_q), h as (select s1_id, cand_id, df, rank from rk join t_p using (country, token))"


SWEEP_SQL = " union all ".join([*(_sweep_sql(x, _token_hits_sql(c, n, d, k), limit, grid) for x, (c, n, d, k, grid, limit) in SWEEPS.items()), _sweep_sql("street_cap", "h as (select s.entity_id s1_id, p.entity_id cand_id, count(*) over (partition by s.entity_id) df from s1 s join pool p on s.country = p.country and s.street_number = p.street_number and s.street_number <> '')", "df", STREET_CAPS)])


def sweeps(c):
    of = [M.Sweep("street_cap", B.Channel("street_cap", "street_number", "exact", STREET_CAPS[-1]), "df", STREET_CAPS)]
    of += [M.Sweep(name, B.Channel(name, column, "token", max_df, k, 1, n), limit, grid) for name, (column, n, max_df, k, grid, limit) in SWEEPS.items()]
    return M.sweeps(c.s1, c.pool, c.truth, of)


@query("g10_sweeps", f"select * from ({SWEEP_SQL})", "er")
def _(c):
    return sweeps(c)


@query("g11_elbow", f"select sweep, min(\"value\")::int elbow from (select *, max(recall) over (partition by sweep) best from ({SWEEP_SQL})) where recall >= 0.99 * best group by sweep", "er")
def _(c):
    return M.elbow(sweeps(c))


def _config_recall(name: str) -> str:
    return f"(with {config_ctes(name)} select '{name}' config, {RECALL_SQL})"


@query("g12_config_comparison", " union all ".join(f"select * from {_config_recall(n)}" for n in B.CONFIGS), "er")
def _(c):
    return M.config_recall(c.s1, c.pool, c.truth, B.CONFIGS)


@query("g29_candidate_stats", f"with {D3} select country, round(avg(n), 6) mean_cand, quantile_cont(n, 0.5)::double p50, quantile_cont(n, 0.9)::double p90, quantile_cont(n, 0.99)::double p99, max(n)::bigint max_cand, round(100 * avg((n = 0)::int), 6) pct_zero from (select country, entity_id, count(cand_id) n from s1 left join cand on s1_id = entity_id group by all) group by country", "er")
def _(c):
    return M.candidate_stats(c.s1, d3(c))


@query("g32_full_population", f"with {D3} select country, count(*) true_edges, round(avg((cand.cand_id is not null)::int), 6) recall, count(*) filter (from_b1 = 1) by_name, count(*) filter (from_b5 = 1) by_address from truth join s1 on s1.entity_id = truth.s1_id left join cand on cand.s1_id = truth.s1_id and cand.cand_id = truth.cand_id group by country", "er")
def _(c):
    return M.recall_by_country(c.s1, c.truth, d3(c))


@query("set_missed_edges", f"with {D3} select s1_id, cand_id from truth except select s1_id, cand_id from cand", "er")
def _(c):
    return c.truth.subtract(d3(c).select("s1_id", "cand_id"))


@query("set_symmetric_difference", f"with a as ({exact_sql('name_norm')}), b as ({exact_sql('name_no_suffix')}) (select 'left' side, * from (select * from a except select * from b)) union all (select 'right', * from (select * from b except select * from a))", "er")
def _(c):
    a, b = B.exact_join(c.s1, c.pool, "name_norm"), B.exact_join(c.s1, c.pool, "name_no_suffix")
    return M.symmetric_difference(a, b)


@query("set_subset_violations", f"with {D3} select count(*) n_outside from (select s1_id, cand_id from truth except select s1_id, cand_id from cand)", "er")
def _(c):
    return c.truth.join(d3(c), ["s1_id", "cand_id"], "left_anti").agg(F.count(F.lit(1)).alias("n_outside"))
