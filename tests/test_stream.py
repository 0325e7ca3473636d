from erlink.operators import blocking as B
from erlink.plans.fixtures import Context
from erlink.streaming.match_stream import match_stream

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    c = Context(spark, SF)
    c.s1.repartition(3).write.parquet(str(tmp_path / "s1"))
    records = spark.readStream.schema(c.s1.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s1"))
    match_stream(records, lambda rows: B.exact_join(rows, c.pool, "name_no_suffix"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("s1_id", "cand_id")
    want = B.exact_join(c.s1, c.pool, "name_no_suffix")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
