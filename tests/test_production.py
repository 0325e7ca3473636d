"""From files to result files: a saved model, shards and their consolidation, checks of what was written."""

import json

import pytest
from pyspark.sql import functions as F

from erlink import __main__ as cli
from erlink.operators import model as L
from erlink.plans import production as run
from erlink.plans import registry
from erlink.sources import readers, sinks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """TSVs of the fixture's records, normalized folders and a trained model."""
    root = str(tmp_path_factory.mktemp("world"))
    c = registry.Context(spark, SF)
    shuffled = lambda rows: rows.withColumn("_o", F.md5("entity_id"))
    for name, rows in (("s1", c.source("s1")), ("pool", c.raw_pool)):
        sinks.write_tsv(shuffled(rows), f"{root}/{name}.parts", "_o")
        sinks.merge_parts(spark, f"{root}/{name}.parts", f"{root}/{name}.tsv")
        assert cli.main(["normalize", "--records", f"{root}/{name}.tsv", "--out", f"{root}/{name}"]) == 0
    sinks.write_tsv(c.truth_lists, f"{root}/truth")
    assert cli.main(["train", "--s1", f"{root}/s1", "--pool", f"{root}/pool", "--truth", f"{root}/truth", "--out", f"{root}/model.json"]) == 0
    assert cli.main(["infer", "--s1", f"{root}/s1", "--pool", f"{root}/pool", "--model", f"{root}/model.json", "--out", f"{root}/out"]) == 0
    return root


def test_inference_needs_no_truth_and_keeps_the_order(spark, world):
    ids = [x.split("\t")[0] for x in open(f"{world}/s1.tsv").read().splitlines()[1:]]
    for name, column in run.LISTS.items():
        lines = [x.split("\t") for x in open(f"{world}/out/{name}.tsv").read().split("\n")]
        assert lines[0] == ["source1_entity_id", column] and [x[0] for x in lines[1:-1]] == ids and lines[-1] == [""]
    truth = {(r.s1_id, r.cand_id) for r in registry.Context(spark, SF).truth.collect()}
    matches = {(a, b) for a, x in (y.split("\t") for y in open(f"{world}/out/matching_results.tsv").read().splitlines()[1:]) for b in x.split(",") if b}
    assert len(matches & truth) >= 0.9 * len(matches) and len(matches & truth) >= 0.5 * len(truth)  # the rule prefers precision
    stats = json.loads(sinks.read_text(spark, f"{world}/out/stats.json"))
    assert stats["status"] == "success" and stats["file_stats"]["s1_rows"] == len(ids) and stats["telemetry"]["stages"] > 0
    assert stats["sha256"]["matching_results.tsv"] == sinks.sha256_of(spark, f"{world}/out/matching_results.tsv")


def test_refit_is_the_same_model(spark, world):
    a, more = L.LinearModel.load(spark, f"{world}/model.json")
    truth = readers.truth_edges(readers.read_tsv(spark, f"{world}/truth", readers.TRUTH))
    b = run.train(spark, readers.read_parquet(spark, f"{world}/s1"), readers.read_parquet(spark, f"{world}/pool"), truth, f"{world}/again.json")
    assert L.refit_difference(a, b) < 1e-6 and more == {"threshold": 8.3, "low": 3.0}
    other = L.LinearModel(a.features[1:], a.mean[1:], a.scale[1:], a.coef[1:], a.intercept)
    assert L.refit_difference(a, other) == float("inf")


def test_shards_consolidate_to_the_same_files(spark, world):
    shard = ["shard", "--s1", f"{world}/s1", "--pool", f"{world}/pool", "--model", f"{world}/model.json", "--out", f"{world}/shards", "--country"]
    for country in ("US", "India", "France"):
        assert cli.main([*shard, country]) == 0
    with pytest.raises(ValueError):
        cli.main([*shard, "Atlantis"])
    assert json.loads(sinks.read_text(spark, f"{world}/shards/Atlantis/manifest.json"))["status"] == "failure"
    join = ["consolidate", "--s1", f"{world}/s1", "--root", f"{world}/shards", "--out", f"{world}/joined", "--shards"]
    assert cli.main([*join, "US,India"]) == 1  # a country without a shard
    assert cli.main([*join, "US,India,Atlantis"]) == 1
    assert cli.main([*join, "US,India,France"]) == 0
    for name in run.LISTS:
        assert open(f"{world}/joined/{name}.tsv").read() == open(f"{world}/out/{name}.tsv").read()
    path = f"{world}/shards/India/matching_results.tsv"
    text = sinks.read_text(spark, path)
    sinks.write_text(spark, path, text.replace("S2-", "S2-9", 1))
    report = run.consolidate(spark, f"{world}/shards", ["US", "India", "France"], f"{world}/s1", f"{world}/joined")
    assert report == {"status": "aborted", "errors": ["shard India: matching_results has changed"]}
    sinks.write_text(spark, path, text)


def test_shard_checks():
    stats = {"s1_rows": 3, "candidate_pairs": 5, "predicted_pairs": 2}
    good = {**stats, "cross_country": 0, "bad_prefix": 0, "duplicates": 0}
    assert all(run.shard_checks(stats, good, 3).values()) and all(run.shard_checks(stats, good, None).values())
    assert not run.shard_checks(stats, good, 4)["all_s1_processed"]
    for key in good:
        assert sum(not ok for ok in run.shard_checks(stats, {**good, key: 9}, 3).values()) == 1


def test_checker_and_validator(spark, world, tmp_path):
    args = ["--s1", f"{world}/s1", "--pool", f"{world}/pool", "--dir"]
    assert cli.main(["check", *args, f"{world}/out"]) == 0 and cli.main(["validate", *args, f"{world}/out"]) == 0
    good = {name: open(f"{world}/out/{name}.tsv").read() for name in run.LISTS}
    first = good["matching_results"].splitlines()[1].split("\t")[0]

    def altered(cands=lambda t: t, preds=lambda t: t):
        folder = tmp_path / str(len(list(tmp_path.iterdir())))
        folder.mkdir()
        (folder / "candidate_pairs.tsv").write_text(cands(good["candidate_pairs"]))
        (folder / "matching_results.tsv").write_text(preds(good["matching_results"]))
        s1, pool = readers.read_parquet(spark, f"{world}/s1"), readers.read_parquet(spark, f"{world}/pool")
        return run.check_outputs(spark, str(folder), s1, pool), run.validate_submission(spark, str(folder), s1, pool)

    def line(text, new):
        rows = text.split("\n")
        rows[1] = new
        return "\n".join(rows)

    checked, validated = altered(preds=lambda t: line(t, f"{first}\tX-1,{first},S2-77777777,S2-77777777"))
    bad = checked["violations"]
    assert not checked["pass"] and (bad["pred_bad_prefix"], bad["self_match"], bad["pred_dup"], bad["pred_not_in_cand"]) == (2, 1, 1, 4)
    assert validated["errors"]["matching_results"] == {"s1_with_repeated_ids": 1, "ids_of_source_1": 1, "ids_without_prefix": 1, "unknown_ids": 1} and validated["warnings"] == {"predictions_outside_candidates": 4}
    checked, validated = altered(cands=lambda t: line(t, f"{first} S2-1"), preds=lambda t: line(t, f"{first}\t "))
    assert checked["violations"]["malformed"] == 1 and checked["violations"]["empty_not_blank"] == 1 and validated["errors"]["candidate_pairs"] == {"malformed_lines": 1, "missing_s1": 1}
    checked, validated = altered(cands=lambda t: t + "S1-none\t\n" + f"{first}\t\n")
    assert (checked["foreign_s1"], checked["repeated_s1"], checked["out_of_order"] > 0) == (1, 1, True) and validated["errors"]["candidate_pairs"] == {"foreign_s1": 1, "repeated_s1": 1}
    checked, validated = altered(preds=lambda t: t.replace("\t", ",", 1))
    assert not checked["header_ok"] and validated["errors"]["matching_results"] == {"header": "not tab-separated"}


def test_smoke_and_countries(spark, world):
    s1 = readers.read_parquet(spark, f"{world}/s1")
    few = run.pick(s1, ["US", "France"], 5)
    assert {r["country"]: r["count"] for r in few.groupBy("country").count().collect()} == {"US": 5, "France": 5}
    assert cli.main(["infer", "--s1", f"{world}/s1", "--pool", f"{world}/pool", "--model", f"{world}/model.json", "--out", f"{world}/few", "--countries", "US", "--smoke", "4"]) == 0
    full = dict(x.split("\t") for x in open(f"{world}/out/matching_results.tsv").read().splitlines())
    part = [x.split("\t") for x in open(f"{world}/few/matching_results.tsv").read().splitlines()]
    assert len(part) == 5 and all(full[a] == b for a, b in part)
    assert cli.main(["check", "--s1", f"{world}/s1", "--pool", f"{world}/pool", "--dir", f"{world}/few", "--smoke", "4"]) == 0


def test_sql_over_views(spark):
    registry.views(spark, SF)
    assert spark.sql("select count(*) from s1 join truth on s1_id = entity_id").first()[0] == registry.Context(spark, SF).truth.count()


def test_order_of_many_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in (2, 0, 1):
        (tmp_path / "in" / f"f{k}.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "".join(f"S1-{k}{i:03d}\tname {i}\t{i} street\tUS\n" for i in range(200)))
    rows = readers.with_ordinal(spark, str(tmp_path / "in")).orderBy("row").collect()
    assert [(r.row, r.entity_id) for r in rows] == [(k * 200 + i, f"S1-{k}{i:03d}") for k in range(3) for i in range(200)]
    print_of = sinks.fingerprint(spark, str(tmp_path / "in" / "f0.tsv"))
    assert len(print_of["code"]["operators/blocking.py"]) == 64 and list(print_of["inputs"]) == ["f0.tsv"]
