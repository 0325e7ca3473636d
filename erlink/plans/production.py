"""Running the engine over files: normalize, train, infer, shards and their consolidation, checks of the results. Paths are anything Spark reads."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from erlink.functions import address
from erlink.functions import text as X
from erlink.operators import blocking as B
from erlink.operators import decide as D
from erlink.operators import features as P
from erlink.operators import metrics as M
from erlink.operators import model as L
from erlink.operators import sampling as S
from erlink.operators import validate as V
from erlink.plans.fixtures import normalized
from erlink.plans.queries_match import numbers_ok
from erlink.sources import readers, sinks
from erlink.sources.scratch import materialize

CANDIDATES, MATCHES = "candidate_pairs", "matching_results"
LISTS = {CANDIDATES: "candidate_entity_ids", MATCHES: "matched_entity_ids"}
FEATURES = tuple(f for f in (*P.BASE_FEATURES, *P.NUMBER_FEATURES) if f != "country_equal")
_COLUMNS = (*P.RECORD_COLUMNS, *P.TOKEN_COLUMNS, *P.NUMBER_COLUMNS)


def normalize(spark: SparkSession, records: str, out: str) -> None:
    """A TSV's records with their position in it (row), derived strings and address numbers, as Parquet by country."""
    raw = readers.with_ordinal(spark, records).na.fill("", ["business_name", "business_address", "country"])
    translit = raw.select("entity_id", "row", X.clean(X.transliterate("business_name")).alias("name_translit"))
    rows = normalized(raw).join(translit, "entity_id").join(address.numbers_of(raw).drop("country"), "entity_id")
    sinks.write_parquet(rows, out, ["country"])


def scored_pairs(pairs: DataFrame, s1: DataFrame, pool: DataFrame, model: L.LinearModel) -> DataFrame:
    rows = P.all_features(B.hydrate(pairs, s1, pool, _COLUMNS))
    return L.scored(rows, model).withColumn("num_ok", numbers_ok(rows))


def train(spark: SparkSession, s1: DataFrame, pool: DataFrame, truth: DataFrame, out: str, config: str = "D3") -> L.LinearModel:
    """Fits the linear model on the candidates' labels and saves it with the thresholds of the final rule."""
    rows = B.with_labels(P.all_features(B.hydrate(B.candidates(s1, pool, B.CONFIGS[config]), s1, pool, _COLUMNS)), truth)
    model = L.fit(rows.select(*FEATURES, "label"), list(FEATURES))
    model.save(spark, out, threshold=D.T_HIGH, low=D.T_LOW)
    return model


def smoke(s1: DataFrame, n: int) -> DataFrame:
    """n records of every country, evenly spaced over the input's order."""
    return S.evenly_spaced(s1, "country", "row", n)


def infer(spark: SparkSession, s1: DataFrame, pool: DataFrame, model_path: str, config: str = "D3") -> tuple[DataFrame, DataFrame]:
    """Candidates and predictions (s1_id, cand_id) of a saved model; no truth is read. Candidates never leave their country."""
    model, more = L.LinearModel.load(spark, model_path)
    pairs = materialize(B.candidates(s1, pool, B.CONFIGS[config]), "candidates")
    predicted = D.rule_h2(scored_pairs(pairs, s1, pool, model).select("s1_id", "cand_id", "z", "num_ok"), more["threshold"], more["low"])
    return pairs, materialize(predicted.select("s1_id", "cand_id"), "predicted")


def result_lists(s1: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """row, source1_entity_id and the id list, a row for every S1."""
    return sinks.id_lists(s1, pairs, name).join(s1.select(F.col("entity_id").alias("source1_entity_id"), "row"), "source1_entity_id").select("row", "source1_entity_id", name)


def write_single(spark: SparkSession, lists: DataFrame, target: str, with_row: bool = False) -> str:
    """One TSV in the order of row, published at once; its digest."""
    folder = f"{target}.parts"
    rows = lists.withColumn("_order", F.col("row")) if with_row else lists.withColumnRenamed("row", "_order")
    sinks.write_tsv(rows, folder, "_order")
    return sinks.merge_parts(spark, folder, target)


def pick(s1: DataFrame, countries: list[str] | None, smoke_per_country: int) -> DataFrame:
    s1 = s1.where(F.col("country").isin(countries)) if countries else s1
    return smoke(s1, smoke_per_country) if smoke_per_country else s1


def file_stats(lists: dict[str, DataFrame]) -> dict:
    """Counts over the written lists, as consolidation will read them."""
    n = lambda name: F.when(F.col(name) == "", 0).otherwise(F.size(F.split(name, ",")))
    c = lists[CANDIDATES].select(n(LISTS[CANDIDATES]).alias("n"))
    m = lists[MATCHES].select(n(LISTS[MATCHES]).alias("n"))
    row = c.agg(F.count(F.lit(1)).alias("s1_rows"), F.sum("n").alias("candidate_pairs"), F.avg("n").alias("mean_candidates"), F.expr("percentile(n, 0.5)").alias("median"), F.expr("percentile(n, 0.99)").alias("p99"), F.max("n").alias("max"), F.count_if(F.col("n") == 0).alias("zero_candidate_s1")).first().asDict()
    return row | m.agg(F.sum("n").alias("predicted_pairs"), F.count_if(F.col("n") == 0).alias("s1_zero_pred"), F.count_if(F.col("n") == 1).alias("s1_one_pred"), F.count_if(F.col("n") > 1).alias("s1_multi_pred")).first().asDict()


def run_inference(spark: SparkSession, s1_path: str, pool_path: str, model_path: str, out: str, countries: list[str] | None = None, smoke_per_country: int = 0, config: str = "D3") -> dict:
    """candidate_pairs.tsv and matching_results.tsv in the order of the input, and stats.json."""
    s1, pool = pick(readers.read_parquet(spark, s1_path), countries, smoke_per_country), readers.read_parquet(spark, pool_path)
    with sinks.manifest(spark, f"{out}/stats.json", countries=countries, smoke_per_country=smoke_per_country) as report:
        pairs, predicted = infer(spark, s1, pool, model_path, config)
        lists = {CANDIDATES: result_lists(s1, pairs, LISTS[CANDIDATES]), MATCHES: result_lists(s1, predicted, LISTS[MATCHES])}
        report["sha256"] = {f"{name}.tsv": write_single(spark, rows, f"{out}/{name}.tsv") for name, rows in lists.items()}
        report["file_stats"] = file_stats(lists)
        report["candidates_by_country"] = [r.asDict() for r in M.candidate_stats(s1, pairs).collect()]  # a row a country
    return report


_SHARD = {name: f"test_source1_row bigint, source1_entity_id string, {column} string" for name, column in LISTS.items()}


def read_shard(spark: SparkSession, path: str, name: str) -> DataFrame:
    rows = spark.read.options(sep="\t", header=True, quote="", emptyValue="").schema(_SHARD[name]).csv(path)
    return rows.na.fill("", [LISTS[name]])


def shard_checks(stats: dict, processed: dict, expected_s1: int | None) -> dict[str, bool]:
    """Whether the files say what was processed, and nothing leaked, lost its prefix or came twice."""
    checks = {f"{k}_equal": stats[k] == processed[k] for k in ("s1_rows", "candidate_pairs", "predicted_pairs")}
    checks |= {"no_country_leak": processed["cross_country"] == 0, "no_bad_prefix": processed["bad_prefix"] == 0, "no_duplicates": processed["duplicates"] == 0}
    return checks if expected_s1 is None else checks | {"all_s1_processed": stats["s1_rows"] == expected_s1}


def run_shard(spark: SparkSession, s1_path: str, pool_path: str, model_path: str, country: str, out_root: str, smoke_per_country: int = 0, config: str = "D3") -> dict:
    """One country: its two files, with the row of each S1, and a manifest with checks, digests and the environment."""
    every = readers.read_parquet(spark, s1_path)
    by_country = {r["country"]: r["count"] for r in every.groupBy("country").count().collect()}
    out = f"{out_root}/{country}"
    with sinks.manifest(spark, f"{out}/manifest.json", country=country, smoke_per_country=smoke_per_country, s1_by_country=by_country) as report:
        if country not in by_country:
            raise ValueError(f"no S1 record of country {country!r}")
        report["environment"] = sinks.fingerprint(spark, model_path)
        s1, pool = pick(every, [country], smoke_per_country), readers.read_parquet(spark, pool_path)
        pairs, predicted = infer(spark, s1, pool.where(F.col("country") == country), model_path, config)
        leaks = B.leak_checks(pairs, s1, pool).first().asDict()
        processed = {"s1_rows": s1.count(), "candidate_pairs": leaks.pop("n_pairs"), "predicted_pairs": predicted.count(), **leaks}
        lists = {CANDIDATES: result_lists(s1, pairs, LISTS[CANDIDATES]), MATCHES: result_lists(s1, predicted, LISTS[MATCHES])}
        report["sha256"] = {}
        for name, rows in lists.items():
            report["sha256"][name] = write_single(spark, rows.withColumnRenamed("row", "test_source1_row").withColumn("row", F.col("test_source1_row")).select("test_source1_row", "source1_entity_id", LISTS[name], "row"), f"{out}/{name}.tsv")
        report["file_stats"] = file_stats({name: read_shard(spark, f"{out}/{name}.tsv", name) for name in lists})
        report["checks"] = shard_checks(report["file_stats"], processed, None if smoke_per_country else by_country[country])
        report["status"] = "success" if all(report["checks"].values()) else "failed_checks"
    return report


def before_consolidation(spark: SparkSession, manifests: dict[str, dict], root: str, s1_by_country: dict[str, int], smoke_run: bool) -> list[str]:
    """What forbids joining the shards: a failed shard, a changed file, another environment, a country missing or incomplete."""
    errors, first = [], next(iter(manifests.values()))
    for code, m in manifests.items():
        if m["status"] != "success":
            errors.append(f"shard {code}: status {m['status']}")
            continue
        errors += [f"shard {code}: {name} has changed" for name, digest in m["sha256"].items() if sinks.sha256_of(spark, f"{root}/{code}/{name}.tsv") != digest]
        if bool(m["smoke_per_country"]) != smoke_run:
            errors.append(f"shard {code}: smoke is {m['smoke_per_country']}")
        if m["environment"] != first.get("environment"):
            errors.append(f"shard {code}: another environment")
        if not smoke_run and m["file_stats"]["s1_rows"] != s1_by_country.get(m["country"]):
            errors.append(f"shard {code}: {m['file_stats']['s1_rows']} S1, not {s1_by_country.get(m['country'])}")
    if not smoke_run and (missing := set(s1_by_country) - {m.get("country") for m in manifests.values()}):
        errors.append(f"countries without a shard: {sorted(missing)}")
    return errors


def consolidate(spark: SparkSession, root: str, shards: list[str], s1_path: str, out: str, smoke_run: bool = False) -> dict:
    """Joins the shards' files in the order of the input into the two result files, if everything agrees."""
    manifests = {code: json.loads(sinks.read_text(spark, f"{root}/{code}/manifest.json")) for code in shards}
    s1 = readers.read_parquet(spark, s1_path).select("entity_id", "country", "row")
    by_country = {r["country"]: r["count"] for r in s1.groupBy("country").count().collect()}
    if errors := before_consolidation(spark, manifests, root, by_country, smoke_run):
        return {"status": "aborted", "errors": errors}
    merged = {}
    for name in LISTS:
        parts = None
        for code in shards:
            one = read_shard(spark, f"{root}/{code}/{name}.tsv", name).withColumn("shard", F.lit(code))
            parts = one if parts is None else parts.unionByName(one)
        merged[name] = parts.withColumnRenamed("test_source1_row", "row")
    both = merged[CANDIDATES].join(merged[MATCHES].select("row", F.col("source1_entity_id").alias("_id"), F.col("shard").alias("_s")), "row", "full_outer").join(s1.select("row", "entity_id"), "row", "left")
    same = F.col("source1_entity_id").eqNullSafe(F.col("_id")) & F.col("shard").eqNullSafe(F.col("_s")) & F.col("source1_entity_id").eqNullSafe(F.col("entity_id"))
    seen = both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~same).alias("differ"), F.count_distinct("row").alias("distinct")).first()
    stats = {code: file_stats({n: merged[n].where(F.col("shard") == code) for n in LISTS}) for code in shards}
    wrong = [f"shard {code}: counts differ from its manifest" for code in shards if stats[code] != manifests[code]["file_stats"]]
    if seen["differ"] or seen["distinct"] != seen["rows"] or not smoke_run and seen["rows"] != s1.count():
        wrong.append(f"rows {seen['rows']}, of them {seen['differ']} that differ in id or shard")
    if wrong:
        return {"status": "failed", "errors": wrong}
    digests = {f"{name}.tsv": write_single(spark, merged[name].select("row", "source1_entity_id", LISTS[name]), f"{out}/{name}.tsv") for name in LISTS}
    return {"status": "success", "rows": seen["rows"], "sha256": digests}


def _lines(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """The header of a result file and its other lines, parsed."""
    header = spark.read.text(path).limit(1).collect()
    first = header[0]["value"] if header else ""
    return first, V.parse_lists(spark.read.text(path).where(F.col("value") != first))


def check_outputs(spark: SparkSession, folder: str, s1: DataFrame, pool: DataFrame, smoke_run: bool = False) -> dict:
    """Violations of the two result files, their headers, coverage and order."""
    heads, parsed = {}, {}
    for name in LISTS:
        heads[name], parsed[name] = _lines(spark, f"{folder}/{name}.tsv")
    bad = V.violations(parsed[CANDIDATES], parsed[MATCHES], pool).first().asDict()
    result = {"header_ok": all(heads[n] == f"source1_entity_id\t{LISTS[n]}" for n in LISTS), "violations": bad}
    placed = parsed[CANDIDATES].withColumn("at", F.monotonically_increasing_id()).join(s1.select(F.col("entity_id").alias("s1_id"), "row"), "s1_id")
    # Within the parts of the file, and from part to part.
    placed = placed.withColumn("part", F.expr("shiftright(at, 33)"))
    parts = placed.groupBy("part").agg(F.min_by("row", "at").alias("first"), F.max_by("row", "at").alias("last")).withColumn("_all", F.lit(1))
    before = F.lag("last").over(Window.partitionBy("_all").orderBy("part"))  # a row a part
    borders = parts.withColumn("_b", before).agg(F.count_if(F.col("first") <= F.col("_b"))).first()[0]
    result["out_of_order"] = V.out_of_order(placed, "at", "row", "part").first()[0] + borders
    cover = V.coverage(parsed[CANDIDATES].select("s1_id"), s1).first().asDict()
    if smoke_run:
        cover.pop("missing_s1")
    result |= cover
    result["pass"] = result["header_ok"] and not any(bad.values()) and not result["out_of_order"] and not any(cover.values())
    return result


def validate_submission(spark: SparkSession, folder: str, s1: DataFrame, pool: DataFrame | None = None) -> dict:
    """Errors of the two files by finding, and as a warning the predictions that are no candidates."""
    errors, parsed = {}, {}
    for name, column in LISTS.items():
        head, parsed[name] = _lines(spark, f"{folder}/{name}.tsv")
        names = [x.strip().lower() for x in head.split("\t")]
        if names != ["source1_entity_id", column]:
            errors[name] = {"header": "not tab-separated" if "\t" not in head and "," in head else head}
            continue
        found = {r["finding"]: r["n"] for r in V.findings(parsed[name], s1, pool).collect() if r["n"]}
        if found:
            errors[name] = found
    outside = V.violations(parsed[CANDIDATES], parsed[MATCHES], s1.limit(0)).first()["pred_not_in_cand"]
    return {"ok": not errors, "errors": errors, "warnings": {"predictions_outside_candidates": outside} if outside else {}}
