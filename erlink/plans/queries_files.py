"""Queries: files written to the shared folder and read back, and checks of result files that do hold violations."""

from pyspark.sql import functions as F

from erlink.operators import blocking as B
from erlink.operators import model as L
from erlink.operators import sampling as S
from erlink.operators import validate as V
from erlink.plans.fixtures import K, duck, spark_sql
from erlink.plans.queries_blocking import config_ctes
from erlink.plans.queries_match import CONFIG
from erlink.plans.registry import query
from erlink.sources import readers, sinks
from erlink.sources.scratch import scratch_path

_NULLS = "entity_id, business_name, nullif(business_address, '') business_address, country"


def _tsv(c, rows, *columns):
    path = scratch_path(c.spark, "tsv")
    sinks.write_tsv(rows.select(*columns) if columns else rows, path)
    return path


@query("s01_tsv_scan", f"select {_NULLS} from raw_pool", "er")
def _(c):
    return readers.read_tsv(c.spark, _tsv(c, c.raw_pool))


@query("s02_tsv_columns", "select entity_id, country from raw_pool", "er")
def _(c):
    return readers.read_tsv(c.spark, _tsv(c, c.raw_pool), columns=["entity_id", "country"])


@query("s10_id_list", "select entity_id from raw1 where country = 'US'", "er")
def _(c):
    path = scratch_path(c.spark, "ids")
    c.source("s1").where("country = 'US'").select("entity_id").write.text(path)
    return readers.read_ids(c.spark, path)


#: A model of two features, as saved and loaded.
_MODEL = L.LinearModel(("num_ok", "n_channels"), (0.5, 3.5), (0.25, 2.0), (1.5, -0.75), 0.125)


@query("s11_loaded_model", "select s1_id, cand_id, round(0.125 + (num_ok - 0.5) / 0.25 * 1.5 + (n_channels - 3.5) / 2.0 * -0.75, 6) z, z >= 8.3 kept from pairs", "scores")
def _(c):
    path = f"{scratch_path(c.spark, 'model')}.json"
    _MODEL.save(c.spark, path, t=8.3)
    loaded, more = L.LinearModel.load(c.spark, path)
    kept = (F.col("z") >= more["t"]).alias("kept")
    return c.pairs.select("s1_id", "cand_id", kept, F.round(loaded.z(), 6).alias("z"))


_SHUFFLED = "order by md5(entity_id), entity_id"


def _ordered_file(c):
    """Records in an order of their own (a hash's) as a single file: its path and digest."""
    rows = c.source("s1").withColumn("row", F.md5("entity_id"))
    folder = scratch_path(c.spark, "ordered")
    sinks.write_tsv(rows, folder, "row")
    target = f"{folder}.tsv"
    return target, sinks.merge_parts(c.spark, folder, target)


@query("s12_row_ordinal", f"select {_NULLS}, row_number() over ({_SHUFFLED}) - 1 \"row\" from raw1", "er")
def _(c):
    return readers.with_ordinal(c.spark, _ordered_file(c)[0])


@query("k01_zstd_parquet", "select * from raw_pool", "er")
def _(c):
    path = scratch_path(c.spark, "zstd")
    sinks.write_parquet(c.raw_pool, path, ["country"])
    return readers.read_parquet(c.spark, path, ["entity_id", "business_name", "business_address", "country"])


_LINES = "concat_ws(chr(9), entity_id, business_name, business_address, country)"
_HEADER = "concat_ws(chr(9), 'entity_id', 'business_name', 'business_address', 'country')"


@query("k04_ordered_single_file", f"select row_number() over ({_SHUFFLED}) + 1 line_no, {_LINES} line from raw1 union all select 1, {_HEADER}", "er")
def _(c):
    rows = sinks.read_text(c.spark, _ordered_file(c)[0]).split("\n")[:-1]
    return c.spark.createDataFrame([(i + 1, x) for i, x in enumerate(rows)], "line_no bigint, line string")


@query("k07_sha256", f"select sha256({_HEADER} || chr(10) || string_agg({_LINES}, chr(10) {_SHUFFLED}) || chr(10)) written, sha256({_HEADER} || chr(10) || string_agg({_LINES}, chr(10) {_SHUFFLED}) || chr(10)) read_back from raw1", "er")
def _(c):
    path, digest = _ordered_file(c)
    return c.spark.createDataFrame([(digest, sinks.sha256_of(c.spark, path))], "written string, read_back string")


@query("k06_manifest", "select 'success' status, 'France' country, (select count(*) from raw1 where country = 'France')::bigint s1_rows, 'failure' failed_status, 'ValueError: no' error", "er")
def _(c):
    import json

    path = scratch_path(c.spark, "manifest")
    with sinks.manifest(c.spark, f"{path}-a.json", country="France") as report:
        report["s1_rows"] = c.source("s1").where("country = 'France'").count()
    try:
        with sinks.manifest(c.spark, f"{path}-b.json"):
            raise ValueError("no")
    except ValueError:
        pass
    good, bad = (json.loads(sinks.read_text(c.spark, f"{path}-{x}.json")) for x in "ab")
    return c.spark.createDataFrame([(good["status"], good["country"], good["s1_rows"], bad["status"], bad["error"])], "status string, country string, s1_rows bigint, failed_status string, error string")


#: Result files with each violation at some keys, as lines; candidates and predictions.
_OWN = f"concat('S2-', cast({K} as «S»), ',S3-', cast({K} as «S»))"
_S1 = f"concat('S1-', cast({K} as «S»))"
_CAND = f"""(case {K} % 50 when 0 then concat({_S1}, chr(9), 'X-', cast({K} as «S»)) when 1 then concat({_S1}, chr(9), {_OWN}, ',S2-', cast({K} as «S»)) when 2 then concat({_S1}, chr(9), {_S1}) when 3 then concat({_S1}, chr(9), 'S2-99999999')
 when 4 then concat({_S1}, ' ', {_OWN}) when 5 then concat({_S1}, chr(9), ' ') when 6 then concat('S1-x', cast({K} as «S»), chr(9), {_OWN}) when 7 then concat({_S1}, chr(9)) else concat({_S1}, chr(9), {_OWN}) end)"""
_PRED = f"""(case {K} % 50 when 11 then concat({_S1}, chr(9), 'S2-0') when 12 then concat({_S1}, chr(9), {_OWN}, ',S3-', cast({K} as «S»)) when 13 then concat({_S1}, chr(9), 'Q-1') when 14 then concat({_S1}, chr(9), '  ') when 15 then concat({_S1}, chr(9), {_S1})
 when 16 then {_S1} when 17 then concat({_S1}, chr(9)) else concat({_S1}, chr(9), 'S2-', cast({K} as «S»)) end)"""
_PARSED = """cl as (select string_split(line, chr(9)) f from (select {c} line from part)), pl as (select string_split(line, chr(9)) f from (select {p} line from part)),
cp as (select f[1] s1, case when len(f) = 2 then f[2] end raw, len(f) <> 2 bad from cl), pp as (select f[1] s1, case when len(f) = 2 then f[2] end raw, len(f) <> 2 bad from pl),
ci as (select *, case when coalesce(raw, '') = '' then [] else string_split(raw, ',') end ids from cp), pi as (select *, case when coalesce(raw, '') = '' then [] else string_split(raw, ',') end ids from pp)""".format(c=duck(_CAND), p=duck(_PRED))
_BAD = "sum(len(list_filter({0}, lambda x: not regexp_matches(x, '^S[23]-'))))::bigint"


def _parsed(c, sql):
    return V.parse_lists(c.table("part").selectExpr(f"{spark_sql(sql)} value"))


@query("v01_output_violations", f"""with {_PARSED}, j as (select c.s1 a, p.s1 b, coalesce(c.ids, []) c, coalesce(p.ids, []) p, c.raw rc, p.raw rp, c.bad mc, p.bad mp from ci c full join pi p on c.s1 = p.s1)
 select count(*) filter (a is null or b is null) s1_mismatch, {_BAD.format('c')} cand_bad_prefix, {_BAD.format('p')} pred_bad_prefix, sum((len(c) <> len(list_distinct(c)))::int)::bigint cand_dup, sum((len(p) <> len(list_distinct(p)))::int)::bigint pred_dup,
 sum(len(list_filter(list_concat(c, p), lambda x: starts_with(x, 'S1-'))))::bigint self_match, sum(len(list_filter(p, lambda x: not list_contains(c, x))))::bigint pred_not_in_cand, count(*) filter (mc) + count(*) filter (mp) malformed,
 count(*) filter (rc <> '' and trim(rc) = '') + count(*) filter (rp <> '' and trim(rp) = '') empty_not_blank, (select count(*) from (select unnest(ids) i from ci) where i not in (select entity_id from raw_pool))::bigint cand_unknown_id from j""", "er")
def _(c):
    return V.violations(_parsed(c, _CAND), _parsed(c, _PRED), c.raw_pool)


#: Required S1: without every seventh key, with some that no line has.
_NEED = f"select {duck(_S1)} entity_id from part where {duck(K)} % 7 <> 0 union all select concat('S1-n', p_partkey) from part where p_partkey % 90 = 0"


@query("v03_submission_findings", f"""with {_PARSED}, twice as (select * from ci union all select * from ci where regexp_matches(s1, '00$')), ok as (select * from twice where not bad), need as ({_NEED}), i as (select distinct unnest(ids) id from ok)
 select 'malformed_lines' finding, (select count(*) from twice where bad) n union all select 's1_with_repeated_ids', (select count(distinct s1) from ok where len(ids) <> len(list_distinct(ids))) union all select 'ids_of_source_1', (select count(*) from i where starts_with(id, 'S1-'))
 union all select 'ids_without_prefix', (select count(*) from i where not regexp_matches(id, '^S[123]-')) union all select 'missing_s1', (select count(*) from need where entity_id not in (select s1 from ok)) union all select 'foreign_s1', (select count(distinct s1) from ok where s1 not in (select entity_id from need))
 union all select 'repeated_s1', (select count(*) from (select s1 from ok group by s1 having count(*) > 1)) union all select 'unknown_ids', (select count(*) from i where regexp_matches(id, '^S[23]-') and id not in (select entity_id from raw_pool))""", "er")
def _(c):
    lines = c.table("part").selectExpr(f"{spark_sql(_CAND)} value")
    parsed = V.parse_lists(lines.unionByName(lines.where("split(value, chr(9))[0] rlike '00$'")))
    need = c.table("part").where(spark_sql(f"{K} % 7 <> 0")).selectExpr(f"{spark_sql(_S1)} entity_id").unionByName(c.table("part").where("p_partkey % 90 = 0").selectExpr("concat('S1-n', p_partkey) entity_id"))
    return V.findings(parsed, need, c.raw_pool)


#: Result rows whose expected place is sometimes that of a neighbour.
_PLACE = f"({K} + case when {K} % 40 = 0 then -2 when {K} % 33 = 0 then 5 else 0 end)"


@query("v02_v06_row_sequence", f"select count(*) out_of_order from (select x, lag(x) over (partition by country order by k) b from (select {duck(K)} k, {duck(_PLACE)} x, case when p_partkey % 10 < 5 then 'US' when p_partkey % 10 < 8 then 'India' else 'France' end country from part)) where x <= b")
def _(c):
    country = "case when p_partkey % 10 < 5 then 'US' when p_partkey % 10 < 8 then 'India' else 'France' end country"
    return V.out_of_order(c.table("part").selectExpr(f"{spark_sql(K)} k", f"{spark_sql(_PLACE)} x", country), "k", "x", "country")


_NO = "cast(substr({0}, 4) as bigint)"


@query("v07_equivalence", f"with {config_ctes(CONFIG)} select 100::bigint only_stored, (select count(*) from cand where {_NO.format('s1_id')} % 50 = 0)::bigint only_recomputed, (select count(*) from cand where {_NO.format('s1_id')} % 50 <> 0 and {_NO.format('s1_id')} % 7 = 0)::bigint changed", "er")
def _(c):
    """Candidates as stored (some left out, some altered, a hundred made up) against the same computed country by country."""
    key = ["s1_id", "cand_id"]
    no = F.substring("s1_id", 4, 12).cast("bigint")
    path = scratch_path(c.spark, "stored")
    whole = B.candidates(c.s1, c.pool, B.CONFIGS[CONFIG])
    made_up = c.spark.range(100).select(F.concat(F.lit("S1-0"), "id").alias("s1_id"), F.lit("S2-0").alias("cand_id"), *(F.lit(1).alias(x) for x in whole.columns if x not in key))
    altered = whole.where(no % 50 != 0).withColumn("from_b1", F.when(no % 7 == 0, 1 - F.col("from_b1")).otherwise(F.col("from_b1")))
    sinks.write_parquet(altered.unionByName(made_up), path)
    parts = None
    for country in ("US", "India", "France"):
        one = B.candidates(c.s1.where(F.col("country") == country), c.pool.where(F.col("country") == country), B.CONFIGS[CONFIG])
        parts = one if parts is None else parts.unionByName(one)
    return V.differences(readers.read_parquet(c.spark, path), parts, key)


_AT = "('0x' || substr(md5(concat(s1_id, 'split')), 1, 4))::bigint % 100"


@query("set_split_disjoint", f"select count(*) filter (false) n_shared, (select count(*) from entities where {_AT} between 50 and 59)::bigint n_shared_of_overlapping from entities", "scores")
def _(c):
    """Of a split's two parts, and of two parts that do overlap by a tenth."""
    shared = lambda a, b: a.join(b.select("s1_id"), "s1_id", "left_semi").agg(F.count(F.lit(1)))
    parts = S.split(c.entities, "s1_id", "split", (("train", 80), ("val", 20)))
    tenths = S.split(c.entities, "s1_id", "split", (("a", 50), ("both", 10), ("b", 40)))
    disjoint = shared(parts.where("part = 'train'"), parts.where("part = 'val'"))
    over = shared(tenths.where("part in ('a', 'both')"), tenths.where("part in ('both', 'b')"))
    return disjoint.select(F.col(disjoint.columns[0]).alias("n_shared"), over.scalar().alias("n_shared_of_overlapping"))
