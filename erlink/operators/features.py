"""Pair features: 28 of names, addresses and channels, 14 of address numbers. Built-ins, and one pass through Arrow for similarities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erlink.functions import similarity
from erlink.functions import text as X

RECORD_COLUMNS = ("country", "name_norm", "name_no_suffix", "name_translit", "address_norm", "street_number", "postal_run")
TOKEN_COLUMNS = ("name_norm_tokens", "address_norm_tokens", "address_norm_digits")
NUMBER_COLUMNS = ("primary_house_number", "house_head", "compound_number", "unit_number", "postal_strict", "number_tokens")


def _flag(c: Column) -> Column:
    return c.cast("int")


def set_features(a: Column, b: Column, both: Column, prefix: str) -> dict[str, Column]:
    """Jaccard (1 for two empty sets), overlap, and containment (1 for two empty sets, 0 for one). a, b: sizes of two sets; both: of what they share."""
    union, least = a + b - both, F.least(a, b)
    return {
        f"{prefix}_token_jaccard": F.when(union == 0, 1.0).otherwise(both / union),
        f"{prefix}_token_overlap_count": both,
        f"{prefix}_token_containment": F.when(union == 0, 1.0).when(least == 0, 0.0).otherwise(both / least),
    }


def sql_features(pairs: DataFrame) -> DataFrame:
    """Features that built-ins express. pairs: hydrated with RECORD_COLUMNS and TOKEN_COLUMNS (sets made once per record), and from_ flags."""
    c = F.col
    shared = {"_name": "name_norm_tokens", "_address": "address_norm_tokens", "_digits": "address_norm_digits"}
    rows = pairs.withColumns({k: F.size(F.array_intersect(f"{x}_1", f"{x}_2")) for k, x in shared.items()})
    present = lambda x: (c(f"{x}_1") == c(f"{x}_2")) & (c(f"{x}_1") != "")
    flags = [x for x in pairs.columns if x.startswith("from_")]
    out = {"name_exact": _flag(c("name_norm_1") == c("name_norm_2")), "name_nosuffix_exact": _flag(c("name_no_suffix_1") == c("name_no_suffix_2"))}
    out |= set_features(F.size("name_norm_tokens_1"), F.size("name_norm_tokens_2"), c("_name"), "name")
    out |= {"name_len_diff": F.abs(F.length("name_norm_1") - F.length("name_norm_2")), "address_exact": _flag(present("address_norm")), "address_missing_s1": _flag(c("address_norm_1") == ""), "address_missing_cand": _flag(c("address_norm_2") == "")}
    out |= set_features(F.size("address_norm_tokens_1"), F.size("address_norm_tokens_2"), c("_address"), "address")
    out |= {
        "address_numeric_token_overlap": c("_digits"),
        "street_number_equal": _flag(present("street_number")),
        "postal_equal": _flag(present("postal_run")),
        "country_equal": _flag(c("country_1") == c("country_2")),
        "n_channels_hit": sum((c(x) for x in flags), F.lit(0)),
    }
    return rows.select("*", *(x.alias(n) for n, x in out.items())).drop(*shared)


def similarity_features(pairs: DataFrame) -> DataFrame:
    """The edit similarities, all from one Arrow pass, and the product of name and address."""
    rows = pairs.withColumn("_s", similarity.name_scores("name_norm_1", "name_norm_2"))
    rows = rows.select("*", F.col("_s.ratio").alias("name_fuzz_ratio"), F.col("_s.sort").alias("name_fuzz_token_sort_ratio"), F.col("_s.set").alias("name_fuzz_token_set_ratio"), similarity.indel_ratio("name_translit_1", "name_translit_2").alias("name_translit_fuzz_ratio"), similarity.indel_ratio("address_norm_1", "address_norm_2").alias("address_fuzz_ratio"))
    return rows.withColumn("name_addr_product", F.col("name_fuzz_ratio") * F.col("address_fuzz_ratio")).drop("_s")


def number_features(pairs: DataFrame) -> DataFrame:
    """Agreements and contradictions of address numbers. pairs: hydrated with NUMBER_COLUMNS, "" for missing."""
    c = F.col
    both = lambda x: (c(f"{x}_1") != "") & (c(f"{x}_2") != "")
    same = lambda x: _flag(both(x) & (c(f"{x}_1") == c(f"{x}_2")))
    differ = lambda x: _flag(both(x) & (c(f"{x}_1") != c(f"{x}_2")))
    rows = pairs.withColumns({f"_n{s}": X.tokens(c(f"number_tokens_{s}")) for s in (1, 2)})
    k, a, b = F.size(F.array_intersect("_n1", "_n2")), F.size("_n1"), F.size("_n2")
    out = {
        "num_hn_head_equal": same("house_head"), "num_hn_full_equal": same("primary_house_number"), "num_compound_equal": same("compound_number"), "num_unit_equal": same("unit_number"), "num_postal_equal": same("postal_strict"),
        "num_token_jaccard": F.when((a == 0) | (b == 0), 0.0).otherwise(k / (a + b - k)), "num_token_overlap": F.least(k, F.lit(5)),
        "num_hn_head_mismatch": differ("house_head"), "num_compound_mismatch": differ("compound_number"), "num_unit_mismatch": differ("unit_number"), "num_postal_mismatch": differ("postal_strict"),
        "num_token_contradiction": _flag((k < a) & (k < b)), "num_token_symdiff": F.least(a + b - 2 * k, F.lit(5)),
    }
    return rows.select("*", *(x.alias(n) for n, x in out.items())).drop("_n1", "_n2")


def strong_name_contradiction(pairs: DataFrame, least: float = 0.9) -> DataFrame:
    """num_strongname_contra: the names nearly agree and a number contradicts."""
    contradicted = (F.col("num_hn_head_mismatch") == 1) | (F.col("num_compound_mismatch") == 1) | (F.col("num_token_contradiction") == 1)
    return pairs.withColumn("num_strongname_contra", _flag((F.col("name_fuzz_token_set_ratio") >= least) & contradicted))


#: Order of the stored features.
BASE_FEATURES = (
    "name_exact", "name_nosuffix_exact", "name_token_jaccard", "name_token_overlap_count", "name_token_containment", "name_fuzz_ratio", "name_fuzz_token_sort_ratio", "name_fuzz_token_set_ratio",
    "name_translit_fuzz_ratio", "name_len_diff", "address_exact", "address_missing_s1", "address_missing_cand", "address_token_jaccard", "address_token_overlap_count", "address_token_containment",
    "address_numeric_token_overlap", "street_number_equal", "postal_equal", "address_fuzz_ratio", "country_equal", "name_addr_product", "from_b1", "from_b2", "from_b3", "from_b5", "from_b7a", "n_channels_hit",
)
NUMBER_FEATURES = (
    "num_hn_head_equal", "num_hn_full_equal", "num_compound_equal", "num_unit_equal", "num_postal_equal", "num_token_jaccard", "num_token_overlap",
    "num_hn_head_mismatch", "num_compound_mismatch", "num_unit_mismatch", "num_postal_mismatch", "num_token_contradiction", "num_token_symdiff", "num_strongname_contra",
)


def all_features(pairs: DataFrame) -> DataFrame:
    return strong_name_contradiction(number_features(similarity_features(sql_features(pairs))))
