"""Business records, ground truth and scored pairs as projections of the driver's tables, in Spark and in DuckDB.

One list of expressions serves both engines; «S» and «DIV» are what their dialects differ in.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erlink.functions import text as X
from erlink.sources.scratch import materialize

K = "cast(p_partkey as bigint)"
_STEM = f"concat(p_name, ' ', lower(p_type), ' ', substr(md5(cast({K} «DIV» 4 as «S»)), 1, 5))"
_SUFFIX = f"(case {K} % 5 when 0 then ' Inc' when 1 then ' LLC' when 2 then ' Pvt. Ltd.' when 3 then ' & Co' else '' end)"
_HOUSE = f"(100 + (37 * {K}) % 8999)"
_REST = f"concat(' ', replace(p_brand, '#', ' '), ' Street, Unit ', cast(p_size as «S»), ', City ', cast({K} % 97 as «S»))"
_COUNTRY = f"(case when {K} % 10 < 5 then 'US' when {K} % 10 < 8 then 'India' else 'France' end)"

#: name -> (filter, entity_id, business_name, business_address, country)
SOURCES = {
    "s1": ("true", f"concat('S1-', cast({K} as «S»))", f"concat({_STEM}, {_SUFFIX})", f"concat(cast({_HOUSE} as «S»), {_REST})", _COUNTRY),
    "s2": (
        f"{K} % 20 <> 0",
        f"concat('S2-', cast({K} as «S»))",
        f"(case {K} % 3 when 0 then replace(concat({_STEM}, {_SUFFIX}), 'o', '0') when 1 then upper({_STEM}) else concat({_STEM}, {_SUFFIX}) end)",
        f"(case when {K} % 29 = 0 then '' when {K} % 11 = 0 then concat(cast({_HOUSE} + 1 as «S»), {_REST}) when {K} % 4 = 0 then concat('00', cast({_HOUSE} as «S»), {_REST}) else upper(concat(cast({_HOUSE} as «S»), {_REST})) end)",
        _COUNTRY,
    ),
    "s3": (
        f"{K} % 2 = 0",
        f"concat('S3-', cast({K} as «S»))",
        f"concat(lower(p_type), ' ', p_name, ' ', substr(md5(cast({K} «DIV» 4 as «S»)), 1, 5), (case when {K} % 5 = 0 then ' Incorporated' else {_SUFFIX} end))",
        f"replace(concat(cast({_HOUSE} as «S»), {_REST}), 'Street', 'St')",
        _COUNTRY,
    ),
}
#: Ground truth: the copies of a key, without those whose house number was moved.
GT = f"{K} % 11 <> 0"

PAIRS = {
    "s1_id": "cast(l_orderkey as bigint)",
    "cand_id": "concat(cast(l_linenumber as «S»), '-', cast(l_partkey as «S»), '-', cast(l_suppkey as «S»))",
    "z": "cast(l_quantity / 4 as double)",
    "label": "(case when l_returnflag = 'A' then 1 else 0 end)",
    "name_exact": "(case when l_tax < 0.02 then 1 else 0 end)",
    "addr_missing": "(case when l_orderkey % 6 = 0 then 1 else 0 end)",
    "num_ok": "(case when l_discount < 0.05 then 1 else 0 end)",
    "n_channels": "cast(l_linenumber as bigint)",
}


def duck(sql: str) -> str:
    return sql.replace("«S»", "varchar").replace("«DIV»", "//")


def spark_sql(sql: str) -> str:
    return sql.replace("«S»", "string").replace("«DIV»", "div")


@dataclass
class Context:
    """The fixtures over one folder of tables, as lazy DataFrames."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def source(self, name: str) -> DataFrame:
        where, *columns = SOURCES[name]
        names = ("entity_id", "business_name", "business_address", "country")
        return self.table("part").where(spark_sql(where)).selectExpr(*(f"{spark_sql(c)} {n}" for c, n in zip(columns, names, strict=True)))

    @cached_property
    def s1(self) -> DataFrame:
        return materialize(normalized(self.source("s1")), "s1")

    @cached_property
    def raw_pool(self) -> DataFrame:
        return self.source("s2").unionByName(self.source("s3"))

    @cached_property
    def pool(self) -> DataFrame:
        return materialize(normalized(self.raw_pool), "pool")

    @cached_property
    def truth_lists(self) -> DataFrame:
        """source1_entity_id and the comma list of its matches, as ground-truth files have it."""
        ids = f"concat_ws(',', case when {K} % 20 <> 0 and {GT} then concat('S2-', cast({K} as string)) end, case when {K} % 2 = 0 and {GT} then concat('S3-', cast({K} as string)) end)"
        return self.table("part").selectExpr(f"concat('S1-', cast({K} as string)) source1_entity_id", f"{ids} matched_entity_ids")

    @cached_property
    def truth(self) -> DataFrame:
        from erlink.sources.readers import truth_edges

        return truth_edges(self.truth_lists)

    @cached_property
    def pairs(self) -> DataFrame:
        return self.table("lineitem").selectExpr(*(f"{spark_sql(sql)} {name}" for name, sql in PAIRS.items()))

    @cached_property
    def entities(self) -> DataFrame:
        """S1 table of the scored pairs, orders without a line included; every seventh misses one true match."""
        found = self.pairs.groupBy("s1_id").agg(F.sum("label").alias("found"))
        orders = self.table("orders").selectExpr("cast(o_orderkey as bigint) s1_id", "o_orderstatus country")
        return orders.join(found, "s1_id", "left").select("s1_id", "country", (F.coalesce("found", F.lit(0)) + F.when(F.col("s1_id") % 7 == 0, 1).otherwise(0)).cast("bigint").alias("n_true"))


def normalized(records: DataFrame) -> DataFrame:
    """The derived strings of records and the token sets of names and addresses, made once per record and written.

    Texts with a character beyond ASCII pass through NFKC.
    """
    records = records.repartition(4 * records.sparkSession.sparkContext.defaultParallelism, "entity_id")  # a small file is one task
    name, address = X.clean(F.col("business_name"), with_nfkc=True), X.clean(F.col("business_address"), with_nfkc=True)
    rows = records.select("entity_id", "country", name.alias("name_norm"), address.alias("address_norm"), X.postal_run(F.col("business_address")).alias("postal_run"))
    tokens = {f"{c}_tokens": X.tokens(F.col(c)) for c in ("name_norm", "address_norm")}
    rows = rows.select("*", X.without_legal_forms(F.col("name_norm")).alias("name_no_suffix"), X.street_number(F.col("address_norm")).alias("street_number"), *(t.alias(n) for n, t in tokens.items()))
    return rows.withColumn("address_norm_digits", F.filter("address_norm_tokens", X.is_digits))


_LEGAL = ", ".join(f"'{t}'" for t in X.LEGAL_SUFFIX_TOKENS)


def _duck_norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(replace(lower(coalesce({x}, '')), '&', ' and '), '[^\p{{L}}\p{{N}}_\p{{M}}\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _duck_source(name: str) -> str:
    where, i, n, a, c = SOURCES[name]
    return f"select {duck(i)} entity_id, {duck(n)} business_name, {duck(a)} business_address, {duck(c)} country from part where {duck(where)}"


def toks(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, ' '), lambda t: t <> ''))"


def _duck_normalized(relation: str) -> str:
    return rf"""select *, list_filter(address_norm_tokens, lambda t: regexp_matches(t, '^\p{{Nd}}+$')) address_norm_digits from (
  select *, {toks('name_norm')} name_norm_tokens, {toks('address_norm')} address_norm_tokens, array_to_string(list_filter(string_split(name_norm, ' '), lambda t: t <> '' and t not in ({_LEGAL})), ' ') name_no_suffix,
  coalesce(list_filter(string_split(address_norm, ' '), lambda t: regexp_matches(t, '^\p{{Nd}}+$'))[1], '') street_number from (
  select entity_id, country, {_duck_norm('business_name')} name_norm, {_duck_norm('business_address')} address_norm,
  coalesce(regexp_extract_all(business_address, '\b\d{{5,6}}\b')[-1], '') postal_run from {relation}))"""


#: Common table expressions of the fixtures, for DuckDB.
ER = f"""raw1 as ({_duck_source('s1')}), raw_pool as ({_duck_source('s2')} union all {_duck_source('s3')}),
s1 as materialized ({_duck_normalized('raw1')}), pool as materialized ({_duck_normalized('raw_pool')}),
truth as (select concat('S1-', p_partkey) s1_id, unnest(list_filter([case when p_partkey % 20 <> 0 then concat('S2-', p_partkey) end, case when p_partkey % 2 = 0 then concat('S3-', p_partkey) end], lambda x: x is not null)) cand_id from part where {GT})"""

SCORES = f"""pairs as (select {", ".join(f"{duck(sql)} {name}" for name, sql in PAIRS.items())} from lineitem),
entities as (select o_orderkey s1_id, o_orderstatus country, (coalesce((select sum(label) from pairs p where p.s1_id = o_orderkey), 0) + case when o_orderkey % 7 = 0 then 1 else 0 end)::bigint n_true from orders)"""
