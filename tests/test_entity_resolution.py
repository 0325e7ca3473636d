"""Entity resolution: goldens, properties, and every registered query against its DuckDB SQL on the smallest tables."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from erlink.functions import address, similarity
from erlink.functions import text as X
from erlink.operators import blocking as B
from erlink.operators import decide as D
from erlink.operators import metrics as M
from erlink.operators import model as L
from erlink.plans import registry
from erlink.sources import readers, sinks

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize(
    "text, country, expected",
    [
        ("0042 Elm Street Apt 7", "US", {"primary_house_number": "42", "unit_number": "7", "number_tokens": "7 42"}),
        ("12/0034 Hill Road, Sector 5", "India", {"primary_house_number": "12/34", "house_head": "12", "house_atoms": "12|34", "compound_number": "12/34", "number_tokens": "5 12 34"}),
        ("Plot No 77-A, Ward 3, Pune - 411 004", "India", {"primary_house_number": "77-A", "postal_code": "411004"}),
        ("9 Oak Ave, Austin TX 73301", "US", {"primary_house_number": "9", "postal_code": "73301", "number_tokens": "9"}),
        ("9 Oak Ave, Level 2, FL 13887", "US", {"postal_code": ""}),
        ("88 1/2 Pine Street", "US", {"primary_house_number": "88 1/2", "compound_number": "88 1/2"}),
        ("Survey No 15, Old Village", "India", {"primary_house_number": "15"}),
        ("31 Lake Road, # 4", "US", {"primary_house_number": "31", "unit_number": "4"}),
        ("3rd Cross, 14th Main", "India", {"primary_house_number": "", "number_tokens": ""}),
        (None, "US", {"primary_house_number": "", "number_tokens": ""}),
        ("<NULL>", "France", {"number_tokens": ""}),
        ("10 Rue Haute, 75001 Paris", "France", {"postal_code": "", "primary_house_number": "10"}),
    ],
)
def test_address_numbers(text, country, expected):
    got = address.extract(text, country)
    assert {k: got[k] for k in expected} == expected


def test_similarities():
    assert similarity.ratio("", "") == 1 and similarity.ratio("abc", "") == 0
    assert similarity.ratio("kitten", "sitting") == pytest.approx(2 * 4 / 13)
    assert similarity.token_sort_ratio("b a", "a b") == 1
    assert similarity.token_set_ratio("acme tools", "acme tools ltd") == 1 and similarity.token_set_ratio("", "a") == 0
    assert similarity.token_set_ratio("a b", "a c") == pytest.approx(max(4 / 6, 2 / 4))


def test_text(spark):
    rows = spark.createDataFrame([("Müller & Söhne  GmbH!",), (None,), ("Ltd Pvt",), ("Ａcme",)], "n string")
    got = [r[0] for r in rows.select(X.clean(F.col("n"), with_nfkc=True)).collect()]
    assert got == ["müller and söhne gmbh", "", "ltd pvt", "acme"]
    assert [r[0] for r in rows.select(X.without_legal_forms(X.clean(F.col("n")))).collect()][:3] == ["müller and söhne", "", ""]
    assert X.to_ascii("Élan राम") .isascii() and X.to_ascii("Élan") == "Elan"


def test_files(spark, tmp_path):
    path = str(tmp_path / "s.tsv")
    with open(path, "w", encoding="utf-8") as f:
        f.write('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-2\t"Joe ""X"" Bar"\tNA\tUS\nS1-1\tnull\t\tIndia\n')
    rows = readers.read_tsv(spark, path)
    assert [tuple(r) for r in rows.orderBy("entity_id").collect()] == [("S1-1", "null", None, "India"), ("S1-2", 'Joe "X" Bar', "NA", "US")]
    assert sorted((r.row, r.entity_id) for r in readers.with_ordinal(spark, path).collect()) == [(0, "S1-2"), (1, "S1-1")]
    lists = spark.createDataFrame([(1, "S1-1", ""), (2, "S1-2", "S2-1,S3-1")], "row long, source1_entity_id string, matched_entity_ids string")
    sinks.write_tsv(lists, str(tmp_path / "out"), "row")
    digest = sinks.merge_parts(spark, str(tmp_path / "out"), str(tmp_path / "out.tsv"))
    assert (tmp_path / "out.tsv").read_text() == "source1_entity_id\tmatched_entity_ids\nS1-1\t\nS1-2\tS2-1,S3-1\n" and digest == sinks.sha256_of(spark, str(tmp_path / "out.tsv"))
    with pytest.raises(ValueError), sinks.manifest(spark, str(tmp_path / "m.json"), shard="US"):
        raise ValueError("no")
    assert '"status": "failure"' in (tmp_path / "m.json").read_text()


def test_f05_conventions(spark):
    e = spark.createDataFrame([(1, "US", 0), (2, "US", 0), (3, "US", 2), (4, "US", 2)], "s1_id long, country string, n_true long")
    p = spark.createDataFrame([(2, "c", 0), (4, "a", 1), (4, "b", 0)], "s1_id long, cand_id string, label int")
    got = {r.s1_id: (r.p, r.r, r.f) for r in M.entity_scores(e, p).collect()}
    assert got == {1: (1, 1, 1), 2: (0, 1, 0), 3: (1, 0, 0), 4: (0.5, 0.5, 0.5)}


def test_final_rule(spark):
    rows = [(1, "a", 8.3, 1), (1, "b", 8.2, 1), (2, "a", 3.0, 1), (2, "b", 3.0, 1), (3, "a", 2.9, 1), (4, "a", 5.0, 0)]
    got = D.rule_h2(spark.createDataFrame(rows, "s1_id long, cand_id string, z double, num_ok int"))
    assert sorted((r.s1_id, r.cand_id) for r in got.collect()) == [(1, "a"), (2, "a")]


def test_logistic_fit_is_stationary(spark):
    rows = spark.createDataFrame([(float(i % 7), float((i * i) % 5), int(i % 7 > 3 or i % 11 == 0)) for i in range(300)], "a double, b double, label int")
    m = L.fit(rows, ["a", "b"])
    data = L.balanced(L.scored(rows, m)).withColumn("r", F.col("weight") * (M.sigmoid(F.col("z")) - F.col("label")))
    g = data.agg(F.sum("r"), F.sum(F.col("r") * (F.col("a") - m.mean[0]) / m.scale[0])).first()
    assert math.isclose(g[0], 0, abs_tol=1e-6) and math.isclose(g[1] + m.coef[0], 0, abs_tol=1e-6)


def test_recall_grows_with_max_df_and_k(spark):
    c = registry.Context(spark, SF)
    n = [B.token_join(c.s1, c.pool, B.column_tokens("name_norm"), df, k).count() for df, k in ((5, 2), (20, 2), (20, 4))]
    assert n == sorted(n)


@pytest.mark.parametrize("name", ["b03_exact_no_suffix", "b11_channel_provenance", "g05_blocking_recall", "g07_entity_retention", "f11_f19_address_features", "m11_rule_h2", "g03_full_evaluation", "t02_threshold_curve", "x08_x10_categories", "v01_output_violations"])
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    mine = registry.QUERIES[name](spark, SF)
    theirs = c.execute(registry.ORACLES[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(columns) == sorted(mine.columns)
    norm = lambda rows: sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert norm(mine.select(*columns).collect()) == norm(theirs.fetchall())


def test_document_queries_read_whole_texts(spark, tmp_path):
    rows = [(1, "Ab & c\nd, E\n\nf2"), (2, "plain\nनमस्ते"), (3, ""), (4, "one")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {name: {r.doc_id: tuple(r)[1:] for r in registry.QUERIES[name](spark, str(tmp_path)).collect()} for name in ("n02_basic_clean", "n12_profile_tokens", "n14_beyond_latin")}
    assert got["n02_basic_clean"] == {1: ("ab and c d e f2",), 2: ("plain नमस्ते",), 3: ("",), 4: ("one",)}
    assert got["n12_profile_tokens"] == {1: (5, "ab"), 2: (1, "plain"), 3: (0, ""), 4: (1, "one")}
    assert got["n14_beyond_latin"] == {1: (False,), 2: (True,), 3: (False,), 4: (False,)}


def test_models_run_on_the_production_configuration(spark, monkeypatch):
    from erlink.plans import queries_match as Q

    c = registry.Context(spark, SF)
    production = B.candidates(c.s1, c.pool, B.CONFIGS["D3"]).select("s1_id", "cand_id")
    assert production.count() > B.candidates(c.s1, c.pool, B.CONFIGS["D4"]).count()
    for pairs in (Q.base_pairs(c), Q.feature_pairs(c)):
        got = pairs.select("s1_id", "cand_id")
        assert got.exceptAll(production).count() == production.exceptAll(got).count() == 0

    class Stop(Exception):
        pass

    def rounds_of(rows, features, rounds):
        raise Stop(rounds)

    monkeypatch.setattr(L, "fit_trees", rounds_of)
    with pytest.raises(Stop, match="^200$"):
        registry.QUERIES["m04_boosted_trees"](spark, SF)
