"""Features made where candidates are united: against the joined form, brute force, and what is shuffled."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from erlink.functions import similarity
from erlink.operators import blocking as B
from erlink.operators import features as P
from erlink.operators import model as L
from erlink.operators import pair_scan as S
from erlink.plans import queries_match as Q
from erlink.plans import registry

FEATURES = (*P.BASE_FEATURES, *P.NUMBER_FEATURES)
COLUMNS = (*P.RECORD_COLUMNS, *P.TOKEN_COLUMNS, *P.NUMBER_COLUMNS)
CHANNELS = (B.Channel("b1", "name_norm"), B.Channel("b2", "name_no_suffix"), B.Channel("b3", "name_norm", "token", 500, 4), B.Channel("b5", "address_norm", "token", 500, 4), B.Channel("b7a", "postal_run"))


def records(spark, side, n, draw):
    """Records with long names, many tokens, empty fields, characters beyond ASCII, and an id of two records."""
    words = ["ab", "abc", "über", "żółw", "x", "中文字", "ba", "inc", "and", "𝒳y"]
    rows = []
    for k in range(n):
        size = draw.choice([0, 1, 3, 4, 5, 30, 70]) if k % 7 == 0 else draw.randint(1, 6)
        name = " ".join(draw.choice(words) + (str(draw.randint(0, 40)) if size > 20 else "") for _ in range(size))
        address = " ".join(draw.choice(["1", "22", "333", "road", "st", "7", "oak"]) for _ in range(draw.randint(0, 6)))
        number = lambda: draw.choice(["", "1", "2"])
        rows.append((f"{side}-{k if k != 5 else 4}", "US" if k < n // 2 else "FR", name, name.replace(" inc", ""), name.replace("ü", "u"), address, number(), number(), number(), number(), number(), number(), number(), " ".join(draw.choices("123456789", k=draw.choice([0, 1, 3, 5, 40])))))
    schema = "entity_id string, country string, name_norm string, name_no_suffix string, name_translit string, address_norm string, street_number string, postal_run string, primary_house_number string, house_head string, compound_number string, unit_number string, postal_strict string, number_tokens string"
    from erlink.functions import text as X

    tokens = spark.createDataFrame(rows, schema).select("*", *(X.tokens(F.col(c)).alias(f"{c}_tokens") for c in ("name_norm", "address_norm")))
    return tokens.withColumn("address_norm_digits", F.filter("address_norm_tokens", X.is_digits))


def rounded(rows):
    return sorted((r["s1_id"], r["cand_id"], r["label"], *(round(float(r[f]), 9) for f in FEATURES)) for r in rows)


@pytest.mark.parametrize("part_rows,batch", [(100_000, 1 << 15), (20, 7)])
def test_features_are_those_of_joined_pairs(spark, monkeypatch, part_rows, batch):
    monkeypatch.setattr(S, "PART_ROWS", part_rows)
    monkeypatch.setattr(S, "BATCH", batch)
    draw = random.Random(11)
    s1, pool = records(spark, "S1", 40, draw).localCheckpoint(), records(spark, "S2", 90, draw).localCheckpoint()
    truth = spark.createDataFrame([(f"S1-{k}", f"S2-{j}") for k in range(40) for j in (k, k + 3)] * 2, "s1_id string, cand_id string")
    scan = S.Compared(B.asked(s1, pool, CHANNELS), s1, pool, truth, tuple(c.name for c in CHANNELS), B.least_overlaps(CHANNELS))
    got = scan.scan(f"s1_id string, cand_id string, {S.schema_of(FEATURES)}, label int", S.rows_of(FEATURES))
    want = B.with_labels(P.all_features(B.hydrate(B.candidates(s1, pool, CHANNELS), s1, pool, COLUMNS)), truth).select("s1_id", "cand_id", *FEATURES, "label")
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want.schema]
    got, want = rounded(got.collect()), rounded(want.collect())
    assert len(want) > 400 and got == want
    names = [*FEATURES, "label"]
    counted = scan.scan(f"{S.schema_of(FEATURES)}, label int, n bigint", S.counts_of(FEATURES, 50)).groupBy(*names).agg(F.sum("n").alias("n")).collect()
    assert sum(r.n for r in counted) == len(want)


def test_common_subsequences_are_the_plain_ones():
    draw = random.Random(2)
    make = lambda: ["".join(draw.choices("abcé", k=draw.choice([0, 1, 5, 63, 64, 65, 130, 200]))) for _ in range(30)]
    a, b = make(), make()
    t = S._Texts(b)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(30), np.arange(30)))
    got = S.lcs(S._Texts(a, t.alphabet), i, t, j)
    assert got.tolist() == [similarity.lcs(a[x], b[y]) if a[x] and b[y] else 0 for x, y in zip(i, j)]


def test_pairs_are_not_joined_to_records(spark):
    """Failed before: every pair, with both records, was shuffled to be joined, compared in Python one by one, and joined to its label."""
    plan = registry.QUERIES["f06_f09_f20_f42_similarities"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    above = plan.split("MapInArrow")[0]
    assert "MapInArrow" in plan and "Exchange" not in above and "Join" not in above and "ArrowEvalPython" not in plan


def test_fit_from_sums_is_the_fit(spark):
    """Failed before: the match kept a row for every pair it was fitted on. A poor start gives the same model."""
    features = ("name_token_jaccard", "name_fuzz_ratio", "address_fuzz_ratio", "num_token_overlap", "from_b3", "country_equal")
    c = registry.Context(spark, "/root/testdata/sf0.001")
    scan, half = Q.compared(c), F.crc32("s1_id") % 2 == 0
    rows = Q.feature_pairs(c).where(half)
    want = L.fit(rows, features)
    starts = [want, L.LinearModel(features, (0.3,) * 6, (2.0, 0.5, 1.0, 3.0, 1.0, 1.0), (0.0,) * 6, 0.0)]
    dealt = scan.dealt(half).persist()
    for start in starts:
        got = L.fit_sums(lambda mean, scale, at: scan.scan(S.SUMS, S.sums_of(features, mean, scale, at), dealt).collect(), start)
        assert L.refit_difference(got, want) < 1e-6
    assert L.refit_difference(Q.fit_all(scan, half, features), want) < 1e-6


def test_ablation_and_match_make_no_rows_of_all_pairs(spark, monkeypatch):
    """Failed before: both made a row for every pair, the ablation seven times or out of a cache."""
    monkeypatch.setattr(B, "candidates", None)
    for name in ("t05_ablation", "match_end_to_end"):
        assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("batch,pairs", [(1 << 15, 20_000_000), (7, 40)])
def test_records_dealt_by_token_give_the_same_pairs(spark, monkeypatch, batch, pairs):
    """Failed before: every record went to every block, which grows with the square of the tables."""
    draw = random.Random(11)
    s1, pool = records(spark, "S1", 40, draw).localCheckpoint(), records(spark, "S2", 90, draw).localCheckpoint()
    truth = spark.createDataFrame([(f"S1-{k}", f"S2-{j}") for k in range(40) for j in (k, k + 3)] * 2, "s1_id string, cand_id string")
    channels = (*CHANNELS, B.Channel("two", "address_norm", "token", 500, 6, 2))
    scan = S.Compared(B.asked(s1, pool, channels), s1, pool, truth, tuple(c.name for c in channels), B.least_overlaps(channels))
    features = (*FEATURES, "from_two")
    run = lambda: sorted(map(str, scan.scan(f"s1_id string, cand_id string, {S.schema_of(features)}, label int", S.rows_of(features)).collect()))
    want = run()
    monkeypatch.setattr(S, "BY_TOKEN", 0)
    monkeypatch.setattr(S, "BATCH", batch)
    monkeypatch.setattr(S, "CODE_PAIRS", pairs)
    assert scan.dealt().select("block").distinct().collect() == [(-1,)]
    assert len(want) > 400 and run() == want
