"""Candidates by scans of posting lists: brute force, and that no shared token becomes a row."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from erlink.operators import blocking as B
from erlink.operators import postings_scan as S


def tables(spark):
    draw = random.Random(5)
    make = lambda side, n: [(f"{side}-{i}", draw.choice(["US", "FR", None]), " ".join(draw.choices("abcdefgh", k=draw.randint(0, 5)))) for i in range(n)]
    columns = "entity_id string, country string, name string"
    pool = make("P", 120)
    pool += [(pool[3][0], "US", "a b h")]  # an id of two records
    s1 = make("S", 40)
    return s1, pool, spark.createDataFrame(s1, columns), spark.createDataFrame(pool, columns)


def shared(s1, pool, max_df, k):
    """(s1, candidate): how many of the S1's k rarest tokens it has."""
    held = {}
    for i, country, name in pool:
        for t in set(name.split()) if country else ():
            held.setdefault((country, t), []).append(i)
    out = Counter()
    for i, country, name in s1:
        own = sorted((len(held[country, t]), t) for t in set(name.split()) if country and len(held.get((country, t), [])) in range(1, max_df + 1))[:k]
        out.update((i, c) for _, t in own for c in set(held[country, t]))
    return out


@pytest.mark.parametrize("max_df,k,least", [(1000, 8, 1), (22, 2, 1), (1000, 5, 2)])
def test_token_join_is_brute_force(spark, max_df, k, least):
    s1, pool, a, b = tables(spark)
    got = B.dense_token_join(a, b, B.column_tokens("name"), max_df, k, least)
    assert Counter({(r.s1_id, r.cand_id): r.overlap for r in got.collect()}) == {p: n for p, n in shared(s1, pool, max_df, k).items() if n >= least}
    assert got.count() == got.select("s1_id", "cand_id").distinct().count()


def test_channels_are_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "LIST_ROWS", 7)
    monkeypatch.setattr(S, "BATCH_PAIRS", 50)
    s1, pool, a, b = tables(spark)
    got = B.candidates(a, b, (B.Channel("x", "name", "token", 1000, 5, 2), B.Channel("y", "name"), B.Channel("z", "name", "token", 22, 2)))
    x, z = {p for p, n in shared(s1, pool, 1000, 5).items() if n > 1}, set(shared(s1, pool, 22, 2))
    y = {(i, j) for i, c, n in s1 for j, d, m in pool if c and c == d and n == m and n}
    assert {(r.s1_id, r.cand_id): (r.from_x, r.from_y, r.from_z) for r in got.collect()} == {p: (int(p in x), int(p in y), int(p in z)) for p in x | y | z}


def test_shared_tokens_are_not_shuffled(spark):
    """Failed before: every shared token was a row, shuffled and aggregated by pair."""
    _, _, a, b = tables(spark)
    plan = B.candidates(a, b, (B.Channel("z", "name", "token", 1000, 5),)).groupBy().agg(F.count(F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    assert "cand_id" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)


def test_sweeps_count_without_pairs():
    """Failed before: sweeps had no such count, and made a row for every shared token."""
    import numpy as np

    draw, marks = random.Random(3), np.zeros(50, np.int64)
    lists = [np.array(sorted(draw.sample(range(50), n))) for n in (3, 9, 20, 40)]
    tags = np.array([(0, r + 1, len(x)) for r, x in enumerate(lists)])
    _, got = S.first_counts(((2, (5, 9, 30)), (1, (1,))))(lists, tags, marks)
    upto = [len(set().union(*(x.tolist() for x in lists if len(x) <= g))) for g in (5, 9, 30)]
    assert np.cumsum(got[:3]).tolist() == upto and got[3] == 0 and not marks.any()


def test_channel_recall_makes_no_pairs(spark, monkeypatch):
    """Failed before: the comparison of configurations made every pair and shuffled it twice."""
    from erlink.operators import metrics as M

    _, _, a, b = tables(spark)
    channels = (B.Channel("x", "name", "token", 1000, 5, 2), B.Channel("y", "name"))
    truth = spark.createDataFrame([(f"S-{i}", f"P-{j}") for i in range(40) for j in (i, i + 40, 3)], "s1_id string, cand_id string").distinct()
    want = M.blocking_recall(a, b, truth, B.candidates(a, b, channels)).first()
    monkeypatch.setattr(B, "candidates", None)
    assert M.channel_recall(a, b, truth, channels).first() == want and want.found_edges > 0


def test_configurations_share_one_scan(spark, monkeypatch):
    """Failed before: each configuration had a scan and a plan of its own, seven in one, which took the driver's memory."""
    from erlink.operators import metrics as M

    _, _, a, b = tables(spark)
    token = lambda name, *more: B.Channel(name, "name", "token", *more)
    configs = {
        "p": (token("x", 1000, 5, 2), B.Channel("y", "name")), "q": (token("z", 22, 4), B.Channel("y", "name", "exact", 1)), "r": (token("z", 1000, 2),),
        "s": (token("x", 30, 5, 2), token("n", 40, 3, 1, 2)), "t": (token("z", 1, 1),),
    }
    truth = spark.createDataFrame([(f"S-{i}", f"P-{j}") for i in range(40) for j in (i, i + 40, 3, 3)], "s1_id string, cand_id string")
    want = {name: M.blocking_recall(a, b, truth, B.candidates(a, b, channels)).first() for name, channels in configs.items()}
    assert len({r.mean_cand for r in want.values()}) == 5 and len(B.united(B.CONFIGS)[0]) == 7
    scans, scan = [], S.Asked.scan
    monkeypatch.setattr(S.Asked, "scan", lambda *x: scans.append(1) or scan(*x))
    got = M.config_recall(a, b, truth, configs)
    assert got.columns == ["config", *want["p"].__fields__] and len(scans) == 1
    assert {r.config: tuple(r)[1:] for r in got.collect()} == {name: tuple(r) for name, r in want.items()}


def test_postings_are_not_broadcast(spark):
    """Failed before: with Spark's own limit the pool's postings, guessed by the size of their files, were broadcast through the driver."""
    _, _, a, b = tables(spark)
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").removesuffix("b")) >= 10 << 20
    sized = [spark.range(200).selectExpr("'P-' || id entity_id", "'US' country", "'a b' name")] * 2  # as files: a size is known
    for x, y in ((a, b), sized):
        plan = B.token_join(x, y, B.column_tokens("name"), 1000, 5)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
