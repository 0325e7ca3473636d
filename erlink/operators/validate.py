"""Checks of result files as relations: formats, ids, coverage, order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from erlink.operators.metrics import n_rows


def parse_lists(lines: DataFrame) -> DataFrame:
    """From value (a line): s1_id, raw (text after the tab), ids and malformed (not exactly one tab)."""
    parts = F.split("value", "\t", -1)
    rows = lines.withColumn("_p", parts).withColumn("malformed", F.size("_p") != 2)
    raw = F.when(~F.col("malformed"), F.col("_p")[1])
    return rows.select("*", F.col("_p")[0].alias("s1_id"), raw.alias("raw"), F.when(F.coalesce(raw, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(raw, ",")).alias("ids")).drop("_p")


def violations(candidates: DataFrame, predictions: DataFrame, known: DataFrame) -> DataFrame:
    """One row of counters over two parsed files (s1_id, raw, ids, malformed) and the known ids (entity_id)."""
    none = F.array().cast("array<string>")
    left = candidates.select("s1_id", F.col("ids").alias("c"), F.col("raw").alias("rc"), F.col("malformed").alias("mc"))
    right = predictions.select(F.col("s1_id").alias("_s"), F.col("ids").alias("p"), F.col("raw").alias("rp"), F.col("malformed").alias("mp"))
    both = left.join(right, F.col("s1_id") == F.col("_s"), "full_outer").withColumns({x: F.coalesce(x, none) for x in ("c", "p")})
    bad_prefix = lambda x: F.size(F.filter(x, lambda i: ~i.rlike("^S[23]-")))
    repeated = lambda x: (F.size(x) != F.size(F.array_distinct(x))).cast("int")
    own = F.size(F.filter(F.concat("c", "p"), lambda i: i.startswith("S1-")))
    empty = lambda x: F.coalesce(((F.col(x) != "") & (F.trim(x) == "")).cast("int"), F.lit(0))
    outside = F.size(F.filter("p", lambda i: ~F.array_contains("c", i)))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("bigint")
    row = both.agg(
        F.count_if(F.col("s1_id").isNull() | F.col("_s").isNull()).alias("s1_mismatch"), total(bad_prefix("c")).alias("cand_bad_prefix"), total(bad_prefix("p")).alias("pred_bad_prefix"), total(repeated("c")).alias("cand_dup"), total(repeated("p")).alias("pred_dup"),
        total(own).alias("self_match"), total(outside).alias("pred_not_in_cand"), (F.count_if("mc") + F.count_if("mp")).alias("malformed"), total(empty("rc") + empty("rp")).alias("empty_not_blank"),
    )
    unknown = candidates.select(F.explode("ids").alias("entity_id")).join(known.select("entity_id"), "entity_id", "left_anti").agg(n_rows())
    return row.select("*", unknown.scalar().alias("cand_unknown_id"))


def findings(parsed: DataFrame, required: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """finding, n: what is wrong with one parsed file. Counted are lines, S1 or distinct ids, as the finding says; known is opt-in."""
    rows = parsed.where("not malformed")
    ids = rows.select(F.explode("ids").alias("entity_id")).distinct()
    own, odd = F.col("entity_id").startswith("S1-"), ~F.col("entity_id").rlike("^S[123]-")
    cover = coverage(rows.select("s1_id"), required)
    out = [
        parsed.where(F.col("malformed") & (F.trim("value") != "")).agg(F.lit("malformed_lines").alias("finding"), n_rows().alias("n")),
        rows.where(F.size("ids") != F.size(F.array_distinct("ids"))).agg(F.lit("s1_with_repeated_ids").alias("finding"), F.count_distinct("s1_id").alias("n")),
        ids.where(own).agg(F.lit("ids_of_source_1").alias("finding"), n_rows().alias("n")),
        ids.where(odd).agg(F.lit("ids_without_prefix").alias("finding"), n_rows().alias("n")),
        *(cover.select(F.lit(x).alias("finding"), F.col(x).alias("n")) for x in ("missing_s1", "foreign_s1", "repeated_s1")),
    ]
    if known is not None:
        out.append(ids.where(~own & ~odd).join(known.select("entity_id"), "entity_id", "left_anti").agg(F.lit("unknown_ids").alias("finding"), n_rows().alias("n")))
    whole = out[0]
    for one in out[1:]:
        whole = whole.unionByName(one)
    return whole


def differences(stored: DataFrame, recomputed: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: keys that only one side has, and keys of both whose other columns differ (nulls equal)."""
    rest = [c for c in stored.columns if c not in key]
    a = stored.select(*key, F.struct(*rest).alias("_a"))
    b = recomputed.select(*key, F.struct(*rest).alias("_b"))
    both = a.withColumn("_ha", F.lit(1)).join(b.withColumn("_hb", F.lit(1)), list(key), "full_outer")
    return both.agg(F.count_if(F.col("_hb").isNull()).alias("only_stored"), F.count_if(F.col("_ha").isNull()).alias("only_recomputed"), F.count_if(F.col("_ha").isNotNull() & F.col("_hb").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("changed"))


def coverage(result: DataFrame, required: DataFrame) -> DataFrame:
    """Missing, foreign and repeated S1 of a result (s1_id) against the required ones (entity_id)."""
    got = result.groupBy(F.col("s1_id").alias("entity_id")).agg(n_rows().alias("n"))
    rows = got.join(required.select("entity_id", F.lit(1).alias("_r")), "entity_id", "full_outer")
    return rows.agg(F.count_if(F.col("n").isNull()).alias("missing_s1"), F.count_if(F.col("_r").isNull()).alias("foreign_s1"), F.count_if(F.col("n") > 1).alias("repeated_s1"))


def out_of_order(result: DataFrame, position: str, expected: str, group: str) -> DataFrame:
    """Rows whose expected place is not after that of the row before, within a group (a file part, a country)."""
    before = F.lag(expected).over(Window.partitionBy(group).orderBy(position))
    return result.withColumn("_b", before).agg(F.count_if(F.col(expected) <= F.col("_b")).alias("out_of_order"))
