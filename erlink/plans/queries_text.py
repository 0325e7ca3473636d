"""Queries: scans, normalization, tokens."""

from pyspark.sql import functions as F

from erlink.functions import text as X
from erlink.plans.fixtures import Context, toks
from erlink.plans.registry import query
from erlink.sources import readers, sinks

def _texts(c: Context):
    return c.table("documents").select("doc_id", "text")


@query("s03_id_country", "select entity_id, country from raw_pool", "er")
def _(c):
    return c.raw_pool.select("entity_id", "country")


@query("s04_parquet_projection", "select doc_id, lang from documents")
def _(c):
    return readers.read_parquet(c.spark, f"{c.sf_dir}/documents.parquet", ["doc_id", "lang"])


@query("s05_parquet_pushdown", "select l_orderkey, l_quantity from lineitem where l_returnflag = 'A' and l_quantity >= 45")
def _(c):
    return readers.read_parquet(c.spark, f"{c.sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity"], "l_returnflag = 'A' and l_quantity >= 45")


@query("s06_head_rows", "select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem order by l_orderkey, l_linenumber, l_partkey, l_suppkey limit 100")
def _(c):
    key = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return readers.first_rows(c.table("lineitem").select(*key), 100, *key)


@query("s07_only_needed_ids", "select * from raw_pool where entity_id in (select cand_id from truth)", "er")
def _(c):
    return readers.only_ids(c.raw_pool, c.truth.select(F.col("cand_id").alias("entity_id")))


@query("s08_pool_of_country", "select * from raw_pool where country = 'India'", "er")
def _(c):
    return readers.pool(c.source("s2"), c.source("s3"), country="India")


@query("s09_truth_edges", "select s1_id, cand_id from truth", "er")
def _(c):
    return c.truth


@query("k02_candidate_lists", "select entity_id source1_entity_id, coalesce((select string_agg(distinct p.entity_id, ',' order by p.entity_id) from pool p where p.country = s1.country and p.name_no_suffix = s1.name_no_suffix and p.name_no_suffix <> ''), '') candidate_entity_ids from s1", "er")
def _(c):
    from erlink.operators.blocking import exact_join

    return sinks.id_lists(c.s1, exact_join(c.s1, c.pool, "name_no_suffix"), "candidate_entity_ids")


@query("k03_match_lists", "select entity_id source1_entity_id, coalesce((select string_agg(distinct t.cand_id, ',' order by t.cand_id) from truth t where t.s1_id = entity_id), '') matched_entity_ids from s1", "er")
def _(c):
    return sinks.id_lists(c.s1, c.truth, "matched_entity_ids")


@query("n02_basic_clean", rf"select doc_id, trim(regexp_replace(regexp_replace(replace(lower(text), '&', ' and '), '[^\p{{L}}\p{{N}}_\p{{M}}\s]', ' ', 'g'), '\s+', ' ', 'g')) cleaned from documents")
def _(c):
    return _texts(c).select("doc_id", X.clean(F.col("text"), with_nfkc=True).alias("cleaned"))


#: Compatibility forms that NFC leaves and NFKC replaces, put into texts so that the two differ.
_COMPAT = {"ﬁ": "fi", "①": "1", "Ａ": "A", "㎏": "kg", "½": "1⁄2"}


@query("n01_nfkc", "select doc_id, nfc_normalize(concat(text, ' ', '" + " ".join(_COMPAT.values()) + "')) folded from documents where text is not null")
def _(c):
    put = F.concat(F.col("text"), F.lit(" " + " ".join(_COMPAT)))
    return _texts(c).where("text is not null").select("doc_id", X.nfkc(put).alias("folded"))


@query("n03_transliterate", "select doc_id, replace(strip_accents(text), 'ß', 'ss') ascii_text from documents where text is not null")
def _(c):
    return _texts(c).where("text is not null").select("doc_id", X.transliterate("text").alias("ascii_text"))


@query("n04_strip_legal_forms", "select entity_id, name_no_suffix from s1", "er")
def _(c):
    return c.s1.select("entity_id", "name_no_suffix")


@query("n05_postal_run", "select entity_id, postal_run from pool", "er")
def _(c):
    return c.pool.select("entity_id", "postal_run")


@query("n06_street_number", "select entity_id, street_number from pool", "er")
def _(c):
    return c.pool.select("entity_id", "street_number")


@query("n07_normalized_frame", "select entity_id, country, name_norm, name_no_suffix, address_norm, postal_run, street_number from pool", "er")
def _(c):
    return c.pool.select("entity_id", "country", "name_norm", "name_no_suffix", "address_norm", "postal_run", "street_number")


@query("n08_token_set", f"select entity_id, list_sort({toks('address_norm')}) tokens from s1", "er")
def _(c):
    return c.s1.select("entity_id", F.array_sort(X.tokens(F.col("address_norm"))).alias("tokens"))


def _ngram_sql(n: int) -> str:
    return f"case when length(x) = 0 then []::varchar[] else list_sort(list_distinct(list_transform(range(1, greatest(length(x) - {n - 1}, 1) + 1), lambda i: substr(x, i, {n})))) end"


@query("n09_char_ngrams", f"select entity_id, {_ngram_sql(3)} grams from (select entity_id, replace(name_norm, ' ', '') x from s1)", "er")
def _(c):
    return c.s1.select("entity_id", F.array_sort(X.char_ngrams(F.col("name_norm"), 3)).alias("grams"))


@query("n10_ngram_string", "select entity_id, array_to_string(list_transform(range(1, greatest(length(x) - 3, 1) + 1), lambda i: substr(x, i, 4)), ' ') grams from (select entity_id, replace(name_norm, ' ', '') x from s1)", "er")
def _(c):
    return c.s1.select("entity_id", X.char_ngram_string(F.col("name_norm"), 4).alias("grams"))


@query("n11_digit_tokens", rf"select entity_id, list_sort(list_filter({toks('address_norm')}, lambda t: regexp_matches(t, '^\p{{Nd}}+$'))) digits from pool", "er")
def _(c):
    return c.pool.select("entity_id", F.array_sort(X.digit_tokens(F.col("address_norm"))).alias("digits"))


@query("n12_profile_tokens", f"select doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+'))::bigint n_tokens, coalesce(regexp_extract_all(lower(text), '[a-z0-9]+')[1], '') first_token from documents")
def _(c):
    t = X.profile_tokens(F.col("text"))
    return _texts(c).select("doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.coalesce(F.get(t, F.lit(0)), F.lit("")).alias("first_token"))


@query("n13_plain_name", "select entity_id, trim(regexp_replace(replace(lower(business_name), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) plain from raw_pool", "er")
def _(c):
    return c.raw_pool.select("entity_id", X.plain_name(F.col("business_name")).alias("plain"))


@query("n14_beyond_latin", f"select doc_id, len(list_filter(string_split(text, ''), lambda x: unicode(x) > 591)) > 0 beyond from documents")
def _(c):
    return _texts(c).select("doc_id", X.beyond_latin(F.col("text")).alias("beyond"))


@query("n15_core_tokens", f"select entity_id, list_sort(list_filter({toks('name_norm')}, lambda t: t not in ({', '.join(repr(t) for t in X.FILLER_TOKENS)}))) core from pool", "er")
def _(c):
    return c.pool.select("entity_id", F.array_sort(X.core_tokens(F.col("name_norm"))).alias("core"))


@query("n16_number_tokens", rf"select entity_id, list_sort(list_filter({toks('address_norm')}, lambda t: regexp_matches(t, '\p{{Nd}}') and not regexp_matches(t, '^[1-9]\d{{5}}$'))) numbers from pool", "er")
def _(c):
    return c.pool.select("entity_id", F.array_sort(X.number_tokens(F.col("address_norm"))).alias("numbers"))
