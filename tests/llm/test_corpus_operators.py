"""Corpus operators against brute force, with nulls, empty tables, repeated rows, long texts and clashing extra columns."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from erlink.llm import ann, bpe, html_extract, langid, mixing, ngram_join, pii, quality, url_filter, warc

WORDS = [f"w{i}" for i in range(400)]
DOC = "doc_id long, text string, lang string, source string, size string, taken string, node string, host string"


def docs_of(spark, texts, lang=None):
    rows = [(i, t, lang[i] if lang else "en", f"s{i % 3}" if i % 7 else None, "x", "y", "z", "h") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC).repartition(4)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = prose(rng, 120)
    near = []
    for k in range(40):  # a group of near copies
        w = base.split()
        w[rng.randrange(len(w))] = f"x{k}"
        near.append(" ".join(w))
    return [None, "", "  \n\t", "one", "one", "a b c d", *near, base, base, base.replace(" ", "\n"), prose(rng, 60), prose(rng, 30_000), *(prose(rng, 80) for _ in range(20))]


def shingles(t):
    w = (t or "").encode().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_ngram_join_equals_brute_force(spark, texts, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)  # several blocks a bucket
    got = {r.doc_id: r for r in ngram_join.join(docs_of(spark, texts)).collect()}
    sets, n = [shingles(t) for t in texts], len(texts)
    links = {i: {j for j in range(n) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in range(n)}
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert (got[i].n_links, got[i].class_id) == (len(links[i]), min(seen)), texts[i]


def test_ngram_join_of_rows_without_or_with_equal_ids(spark, texts, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 4000)  # blocks by bytes
    base = texts[6]
    other = base.rsplit(" ", 1)[0] + " end"
    rows = [(None, base, "a"), (None, base, "b"), (5, other, "c"), (5, "quite another text of seven words here", "d"), (7, "quite another text of seven words here", "e"), (9, "alone and by itself", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = sorted(((str(r.doc_id), r.class_id, r.n_links, r.rep_id) for r in ngram_join.join(df).collect()), key=str)
    assert got == sorted([("None", 5, 2, None), ("None", 5, 2, None), ("5", 5, 2, 5), ("5", 5, 1, 5), ("7", 5, 1, 5), ("9", 9, 0, 9)], key=str)

    import corpus_pipeline

    docs = df.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    left = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted((str(r.doc_id), r.text) for r in left) == sorted([("None", base), ("None", base), ("5", other), ("5", "quite another text of seven words here"), ("9", "alone and by itself")])


def test_bayes_bound():
    need = ngram_join.needed_matches()
    assert need[96] < 0.8 * 96 and list(need[1:]) == sorted(need[1:]) and need[24] > 0


def test_empty_documents(spark):
    empty = docs_of(spark, ["x"]).where("false")
    assert ngram_join.join(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert pii.detect(empty).count() == 0
    assert quality.ledger(empty).count() == 0
    assert langid.identify(empty, langid.fit(empty), keep=["doc_id"]).count() == 0


def test_mix(spark, texts):
    docs = docs_of(spark, texts)
    rows = mixing.mix(docs).collect()
    again = sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    assert sorted(map(tuple, rows)) == again and len(rows) == len(texts)
    sizes = {i: len((t or "").encode().split()) for i, t in enumerate(texts)}
    assert all(r["size"] == sizes[r["doc_id"]] and r["taken"] <= 3 * r["size"] for r in rows)
    by = collections.defaultdict(lambda: [0, 0, 0])
    for r in rows:
        by[r["target"]][0] += r["taken"]
        by[r["target"]][1] += r["size"]
        assert r["target"] <= 3 * r["source_size"] + 1e-6
    assert all(abs(taken - target) <= 0.02 * target + 5 for target, (taken, _, _) in by.items())


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 1000, 5], [0, 0, 7], [100, 1, 1, 1, 50, 2]])
def test_targets_equal_reshared_targets(spark, sizes):
    rows = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    w = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    target, full, total = [0.0] * len(sizes), set(), sum(sizes)
    while True:
        rest, open_ = total - sum(3 * sizes[i] for i in full), [i for i in range(len(sizes)) if i not in full]
        target = [3 * s for s in sizes]
        for i in open_:
            target[i] = rest * w[i] / sum(w[k] for k in open_)
        over = {i for i in open_ if target[i] > 3 * sizes[i]}
        if not over:
            break
        full |= over
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(target)


def test_language_mixture(spark):
    rng = random.Random(1)
    langs = {"aa": "ba be bo mi mo lu la".split(), "bb": "stra ktu prx gnz vlk".split()}
    say = lambda k, n: " ".join("".join(rng.choice(langs[k]) for _ in range(3)) for _ in range(n))
    kinds = [rng.choice("ab") * 2 for _ in range(200)]
    a, b = say("aa", 90), say("bb", 30)
    docs = docs_of(spark, [say(k, 30) for k in kinds] + [None, "12 34 !", f"{a} {b}"], [*kinds, "aa", "aa", None])
    got = {r.doc_id: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert all(got[i].lang_pred == k and got[i].score > 0.9 for i, k in enumerate(kinds))
    assert (got[200].lang_pred, got[200].score) == (got[201].lang_pred, got[201].score) == ("und", 0.0)
    share = dict(x.split(":") for x in got[202].lang_mix.split(","))
    letters = len(a.replace(" ", "")) / len((a + b).replace(" ", ""))  # a trigram for each letter
    assert got[202].lang_pred == "aa" and abs(float(share["aa"]) - letters) < 0.1


def test_mix_of_equal_rows_and_rows_without_an_id(spark):
    rows = [(None, "a b c", "s")] * 40 + [(None, None, None)] * 5 + [(7, "a b", "s")] * 30 + [(7, "a b c d", "t")] * 3 + [(8, "x " * 500, "t"), (None, "y z", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copies", F.lit(1)).withColumn("h", F.lit("z")).repartition(3)
    got = mixing.mix(df).collect()
    assert collections.Counter((r.doc_id, r["size"]) for r in got) == collections.Counter((i, len((t or "").split())) for i, t, _ in rows)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(5)).collect()), key=str)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    by = collections.defaultdict(int)
    for r in got:
        by[r.source_size, r.target] += r.taken
    assert all(abs(taken - target) <= 0.02 * target + 5 for (_, target), taken in by.items())


def brute_mixture(model, text):
    """The best penalised likelihood over all sets of languages, each by plain EM run for long."""
    import itertools
    import math

    c = collections.Counter(langid.grams(text).tolist())
    n = sum(c.values())
    price, best = langid.LOG_PENALTY * math.log(n + 1) + langid.GRAM_PENALTY * n, (-math.inf, None)
    for size in range(1, len(model.langs) + 1):
        for chosen in itertools.combinations(range(len(model.langs)), size):
            pi = [1 / size] * size
            for _ in range(300):
                new = [0.0] * size
                for g, k in c.items():
                    w = [p * model.p[i, g] for p, i in zip(pi, chosen)]
                    for j in range(size):
                        new[j] += k * w[j] / sum(w)
                pi = [x / n for x in new]
            ll = sum(k * math.log(sum(p * model.p[i, g] for p, i in zip(pi, chosen))) for g, k in c.items()) - price * (size - 1)
            best = max(best, (ll, dict(zip(chosen, pi))), key=lambda x: x[0])
    return best


def test_language_sets_equal_brute_force():
    rng = random.Random(12)
    parts = {"aa": "ba be bo mi mo lu la ne".split(), "bb": "stra ktu prx gnz vlk mo".split(), "cc": "oui eau aux eux ien la".split()}
    say = lambda k, n: " ".join("".join(rng.choice(parts[k]) for _ in range(3)) for _ in range(n))
    counts = np.zeros((3, langid.BUCKETS))
    for i, k in enumerate(parts):
        np.add.at(counts[i], langid.grams(say(k, 3000)), 1)
    model = langid.MixtureModel(list(parts), counts)
    for _ in range(25):
        text = " ".join(say(k, rng.choice([0, 0, 4, 30])) for k in rng.sample(list(parts), 3)) or say("aa", 2)
        if not len(langid.grams(text)):
            continue
        lang, score, mix = model.predict(text)
        _, share = brute_mixture(model, text)
        assert {x.split(":")[0] for x in mix.split(",")} == {model.langs[i] for i in share}, text
        assert lang == model.langs[max(share, key=share.get)] and all(abs(float(x.split(":")[1]) - share[model.langs.index(x.split(":")[0])]) < 0.02 for x in mix.split(","))
        assert 0 <= score <= 1


def test_labels_beyond_the_bound_are_not_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGS", 2)
    rows = [(i, f"{'la mi ' if i % 3 else 'stra ktu '}word{i}", ["aa", "bb", "cc"][0 if i % 3 else 1] if i % 10 else "cc", "x", 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_mix string, score double")
    model = langid.fit(df)
    assert model.langs == ["aa", "bb"]
    got = langid.identify(df.withColumn("text", F.when(F.col("doc_id") > 0, F.repeat("text", 3000)).otherwise(F.col("text"))), model, keep=["doc_id"]).collect()
    assert len(got) == 200 and {r.lang_pred for r in got} == {"aa", "bb"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs, langid.fit(docs)).where(langid.held_out(F.col("doc_id")))
    assert rows.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def brute_quality(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    marked = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(marked)


def test_quality_measures_and_ablation(spark, texts):
    rng = random.Random(2)
    more = ["".join(rng.choice(["a ", "b ", "a b a b a b a b ", "é", "\n", "\x1c", " ", "|", "a a a\n"]) for _ in range(60)) for _ in range(300)]
    entries = quality.ledger(docs_of(spark, texts + more))
    for r in entries.collect():
        assert tuple(r[m] for m in quality.MEASURES[:5]) == brute_quality((texts + more)[r.doc_id])
    policy = quality.POLICIES["v2"]
    kept = {v: quality.apply_policy(entries, p).where("kept").count() for v, p in quality.POLICIES.items()}
    assert kept["v2"] <= kept["v1"]
    for r in quality.ablation(entries, policy).collect():
        less = quality.Policy("less", tuple(x for x in policy.rules if x != r["rule"]))
        assert quality.apply_policy(entries, less).where("kept").count() == kept["v2"] + r["n_failed_alone"]


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or (all(int(x) <= 255 for x in v.split(".")) if kind == "ip" else 10 <= len(d) <= 15)


def test_personal_data(spark):
    rng = random.Random(3)
    parts = ["a", "b1", "@", ".", "com", "+1 ", "(", ")", "-", " ", "4716744394561980", "10.2.3.4", "255", "256", "é", "😀", "x@y.zz", "%", "0", "4111 1111 1111 1111", "\n", "(at)", "00001.2.3.4", "+1 (667) 555-4827"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(600)] + [None, "", "1 " * 20_000 + "a.b." * 20_000 + "x@y.z", "Call +1 (667) 555-4827 4716744394561980 now"]
    got = {r.doc_id: r for r in pii.detect(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        found = sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, t or "") if holds(kind, m.group()))
        listed = ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in found)
        assert [got[i][f"n_{kind}"] for kind in BASE] == [sum(x[1] == k for x in found) for k in range(4)], t
        assert got[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert not listed or set(listed.split(",")) <= set(got[i].spans.split(","))
    masked = {r.doc_id: r.text for r in pii.mask(docs_of(spark, ["write to bob@mail.com or 10.0.0.1 .", None, "clean text"])).collect()}
    assert masked == {0: "write to <EMAIL> or <IP> .", 1: None, 2: "clean text"}


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(400, 16)), np.repeat(rng.normal(size=(1, 16)), 120, 0)])  # many equal vectors
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(len(x))] + [(9001, None, 0), (9002, [0.0] * 16, 0), (9003, [float("nan")] * 16, 0), (9004, [1.0], 0), (9005, [None] * 16, 0)]
    got = collections.defaultdict(list)
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, len(x), 20))
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        s = x @ x[q]
        assert np.allclose([f[2] for f in found], s[[f[1] for f in found]], atol=1e-12)
        s[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(len(x)), -s))[:20]) & {f[1] for f in found})
    assert hits >= 0.9 * 20 * len(got)
    few = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert ann.search(few, F.col("vec_id") == 0).count() == 4
    assert ann.search(few.where("false"), F.col("vec_id") == 0).count() == 0


def test_tree_visits_leaves_by_their_centroids():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 12))
    tree = ann.KMeansTree(x)
    assert 200 < tree.n_leaves <= len(x) / 4 and set(tree.file(x)) <= set(range(tree.n_leaves))
    q = rng.normal(size=(20, 12))
    near = q @ tree.centres[tree.leaf_nodes].T
    for i, row in enumerate(tree.queues(q)):
        order = list(tree.visits(row))
        assert sorted(order) == list(range(tree.n_leaves)) and all(near[i, a] >= near[i, b] - 1e-9 for a, b in zip(order, order[1:]))
    assert list(ann.bins_of(np.array([3, 3, 5, 9, 1, 1]), 6)) == [0, 0, 1, 2, 3, 3]


def test_clustered_vectors_take_few_visits(spark, monkeypatch):
    monkeypatch.setattr(ann, "INDEX_BLOCK", 500)  # many bins, and bins of several blocks
    monkeypatch.setattr(ann, "QUERY_BLOCK", 40)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 24))[rng.integers(0, 60, 6000)] + 0.25 * rng.normal(size=(6000, 24))
    rows = [(i, v, "a", "b", 1, 2) for i, v in enumerate(x.tolist())]
    rows += rows[20:21]  # a query row again: it counts once, and is its own
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, leaf string, rank string, score int, v int").repartition(5)
    report, got = {}, collections.defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 20 == 0, report=report).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert report["scanned"] < 0.2 and report["leaves"] > 50 and report["bins"] > 5 and set(got) == set(range(0, 6000, 20))
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in {f[1] for f in found} and len({f[1] for f in found}) == 20
        s = x @ x[q]
        assert np.allclose([f[2] for f in found], s[[f[1] for f in found]])
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20].tolist()) & {f[1] for f in found})
    assert hits >= 0.9 * 20 * len(got)


def test_warc_round_trip(spark):
    pages = [(1, "http://a\r\nX: y", "same"), (2, None, "same"), (3, "u", None), (4, "v", ""), (5, "w", "é" * 50_000), (6, "x", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    index = warc.write(df)
    back = {r.page_id: r for r in warc.read(index).collect()}
    assert bytes(back[5].payload) == ("é" * 50_000).encode() and back[2].payload is None and back[1].url == "http://a%0D%0AX: y"
    assert {r.page_id for r in warc.read(index.where("page_id in (5, 6)")).collect()} == {5, 6}
    got = {r.page_id: r for r in warc.round_trip(df).collect()}
    assert [(got[i].record_type, got[i].refers_to) for i in (1, 2, 3, 4, 5, 6)] == [("response", None), ("revisit", 1), ("response", None), ("revisit", 3), ("response", None), ("revisit", 1)]
    assert all(got[i].payload_digest == warc.digest32((h or "").encode()) and got[i].payload_bytes == len((h or "").encode()) for i, _, h in pages)
    assert warc.round_trip(df.where("false")).count() == 0


def test_warc_ranges_keep_gap_and_size(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(warc, "RANGE_BYTES", 5000)
    monkeypatch.setattr(warc, "GAP_BYTES", 300)
    pages = spark.createDataFrame([(i, f"u{i}", "".join(rng.choice("abcdef") for _ in range(rng.randint(0, 1500))), "f", 1, 2) for i in range(120)], "page_id long, url string, html string, file string, offset int, length int").repartition(3)
    index = warc.write(pages).where("page_id % 5 <> 0 or page_id % 3 = 0")
    want, got = sorted((r.file, r.offset, r.length) for r in index.collect()), []
    spans = [(r.file, r.start, r.stop, r.members) for r in warc.ranges(index).collect()]
    for file, start, stop, members in spans:
        at = [(m.offset, m.length) for m in members]
        assert at == sorted(at) and start == at[0][0] and stop == max(o + n for o, n in at) and stop - start <= 5000 + max(n for _, n in at)
        assert all(b - (a + n) <= 300 for (a, n), (b, _) in zip(at, at[1:]))
        got += [(file, o, n) for o, n in at]
    assert sorted(got) == want and 3 < len(spans) < len(want)
    assert {r.page_id: bytes(r.payload).decode() for r in warc.read(index).collect()} == {r.page_id: r.html for r in pages.join(index, "page_id").select("page_id", pages["html"]).collect()}


def test_warc_repeated_ids_and_clashing_columns(spark):
    rows = [(1, "u", "same", "x", "y"), (1, "u", "same", "x", "y"), (2, "u", "same", "x", "y"), (None, "u", "same", "x", "y"), (None, None, "alone", "x", "y"), (7, "u", "é" * 300_000, "x", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, sha string, record_type string")
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.round_trip(df).collect()), key=str)
    of = lambda i, kind, ref, text: (i, kind, ref, len(text.encode()), warc.digest32(text.encode()))
    assert got == sorted([of(1, "response", None, "same"), of(1, "response", None, "same"), of(2, "revisit", 1, "same"), of(0, "revisit", 1, "same"), of(0, "response", None, "alone"), of(7, "response", None, "é" * 300_000)], key=str)
    assert all(r.payload is None and (r.payload_bytes, r.payload_digest) == (4, warc.digest32(b"same")) for r in warc.read(warc.write(df).where("record_type = 'revisit'")).collect())


def test_quality_query_reads_policies_off_the_ledger(spark, tmp_path):
    from erlink.llm import queries

    rows = [(1, "word " * 40, "s"), (2, None, "s"), (3, "# " * 30 + "x y z", "s"), (3, "# " * 30 + "x y z", "s"), (4, " ".join(f"w{i}" for i in range(30)), "s"), (5, " ".join(f"w{i}#" for i in range(30)), "s")]
    spark.createDataFrame(rows, "doc_id long, text string, kept string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op6_quality_ledger(spark, str(tmp_path)).collect()
    assert len(got) == 6 and all(r.kept == (r.fail_bits == 0) and r.kept_v1 == (not r.base_failed) for r in got)
    for rule in quality.POLICIES["v2"].rules:
        alone = [r for r in got if r.fail_bits == quality.bit(rule)]
        assert all(r.fails_alone == rule for r in alone) and {r[f"n_alone_{rule}"] for r in got} == {len(alone)}
    assert {r.doc_id for r in got if r.kept} == {4} and any(r.fails_alone == "symbols" for r in got)


def test_url_filter(spark):
    cases = {
        "http://A.ORG/x": ("a.org", "/x", "org/", "allow"), "http://a.example.org/es/1": ("a.example.org", "/es/1", "example.org/es/", "block"), "http://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://xorg": ("xorg", "", None, "allow"), "http://org?q": ("org", "", None, "allow"), "https://www.cheap-pills.example.net/en": ("www.cheap-pills.example.net", "/en", None, "block"), "https://a.net/shop/cart?x": ("a.net", "/shop/cart", None, "block"),
        "https://a.net/cartoon": ("a.net", "/cartoon", None, "allow"), None: ("", "", None, "allow"), "nothing": ("", "", None, "allow"), "http://b.com/de/x": ("b.com", "/de/x", "com/de/", "block"),
    }
    rows = [(i, u) for i, u in enumerate(cases)]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert {u: tuple(r)[1:] for (_, u), r in zip(rows, sorted(got), strict=True)} == cases


def judged_by_all(filters, url):
    """The verdict by trying every rule."""
    low = url.translate(url_filter._LOWER)
    fits = {f.verdict for f in url_filter.parse_list(filters) if re.search(f.regex(), low)}
    return "allow" if "allow" in fits or not fits else "block"


def test_url_index_equals_all_patterns():
    index, rng = url_filter.RuleIndex(), random.Random(3)
    parts = ["casino", "my", "888", "big", "cheap-pills", "cheap", "spam-farm", "adserver", "ads", "doubleclick.net", "login", "cart", "wp-admin", "help", "zip", "7z", "é", "a", "-", ".", "/", "?", "#", ":", "\n", "LOGIN"]
    urls = ["https://bigcasino.net/", "http://888casino.net/x", "http://mycasino.com/x", *(f"{rng.choice(['http', 'x'])}://{''.join(rng.choice(parts) for _ in range(rng.randint(1, 8)))}" for _ in range(3_000))]
    found = [index.method(u) for u in urls]
    assert found == [judged_by_all(url_filter.FILTERS, u) for u in urls] and found[:3] == ["block"] * 3 and 100 < found.count("block") < len(urls) - 100
    assert len(url_filter.FILTERS) > 150 and len(index.always) == len(url_filter.SPAM_WORDS)


def test_url_index_of_random_rules_equals_all_rules():
    rng = random.Random(9)
    bits = ["ab", "b", "c1", "1", ".", "-", "/", "*", "^", "?", "="]
    for _ in range(150):
        filters = []
        while len(filters) < rng.randint(1, 12):
            body = "".join(rng.choice(bits) for _ in range(rng.randint(1, 6)))
            line = rng.choice(["", "", "@@"]) + rng.choice(["", "|", "||"]) + body + rng.choice(["", "|"])
            if not (body[0] == body[-1] == "/" and len(body) > 2):
                filters.append(line)
        index = url_filter.RuleIndex((), filters)
        for _ in range(40):
            url = "h://" + "".join(rng.choice(["ab", "b", "c1", "1", "B", ".", "-", "/", "?", "=", "_", "\n", "é"]) for _ in range(rng.randint(0, 10)))
            assert index.method(url) == judged_by_all(filters, url), (filters, url)


def test_filter_syntax():
    of = url_filter.parse_filter
    assert of("! note") is None and of("") is None and of("[Adblock Plus]") is None
    assert (of("||a.b^").tokens, of("ab").tokens, of("-ab-").tokens, of("-ab*cd|").tokens, of("|x://ab").tokens, of(r"/ab+/").tokens) == ({"a", "b"}, set(), {"ab"}, set(), {"x"}, set())
    assert of("@@||a.b^").verdict == "allow"
    for line, fits, fails in (
        ("||b.c^", ["http://b.c", "http://a.b.c/", "http://b.c:80"], ["http://ab.c/", "http://b.cd", "http://x.y/b.c/"]), (".zip|", ["http://a/b.zip"], ["http://a/b.zip\n", "http://a/b.zip/"]), ("|http://a*z", ["http://a\nz"], ["xhttp://az"]),
    ):
        assert all(re.search(of(line).regex(), u) for u in fits) and not any(re.search(of(line).regex(), u) for u in fails), line
    with pytest.raises(ValueError):
        of("||a.b^$third-party")


def test_url_filter_long_urls_repeated_ids_and_clashing_columns(spark):
    long = "http://a.net/" + "x/" * 100_000 + "login"
    rows = [(1, long, "a", "b", "c"), (1, long, "a", "b", "c"), (1, "http://a.net/", "a", "b", "c"), (None, "http://mycasino.com/x", "a", "b", "c")]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string, rule string, verdict string")).collect()
    assert sorted((r.page_id or 0, r.verdict, len(r.path)) for r in got) == [(0, "block", 2), (1, "allow", 1), (1, "block", len(long) - 12), (1, "block", len(long) - 12)]


def test_bpe_tree(spark, monkeypatch):
    tokenizers = pytest.importorskip("public_tokenizers")
    codec = bpe.TreeBpe(bpe.read_ranks(tokenizers.path("byte_bpe_50k.tiktoken")), tokenizers.PATTERN)
    monkeypatch.setattr(bpe, "LEAF", 16)
    rng = random.Random(1)
    parts = ["a", "b", "'", "re", "'ll", " ", "  ", "\n", "\r\n", "1", "23", "é", "ß", "!", "$$", "　", "\x1c", "日本", "\t", "\xa0", "the "]
    for _ in range(1500):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 200)))
        assert codec.encode(s) == codec.leaf.encode_ordinary(s), repr(s)
        assert codec.decode(codec.encode(s)) == s.encode()
    for _ in range(300):  # pieces alone, by the library and by merge()
        piece = "".join(rng.choice("abcdeést日") for _ in range(rng.randint(1, 60)))
        assert codec.merge(piece.encode()) == codec.leaf._encode_single_piece(piece)
    monkeypatch.setattr(bpe, "LEAF", 2048)
    for s in ("a" * 100_000, "x" + " " * 300_000 + "y", "abc" * 40_000 + " \n" + "é" * 70_000, "\n" * 70_000 + "the end", "ab1" * 30_000):
        ids = [i for m in codec.pieces.finditer(s) for i in codec.leaf._encode_single_piece(m.group())]
        assert codec.encode(s) == ids and codec.decode(ids) == s.encode()
    path, rows = tokenizers.path("byte_bpe_50k.tiktoken"), [None, "", "hello there world", "x" * 5000, "x" * 5000]
    wide = docs_of(spark, rows).withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(1))
    wide = wide.unionByName(wide)  # repeated ids
    coded = bpe.encode(wide, path, tokenizers.PATTERN)
    assert sorted((r.doc_id, r.ids) for r in coded.collect()) == sorted((i, codec.leaf.encode_ordinary(t or "")) for i, t in [*enumerate(rows)] * 2)
    assert sorted((r.doc_id, bytes(r.content).decode()) for r in bpe.decode(coded, path, tokenizers.PATTERN).collect()) == sorted((i, t or "") for i, t in [*enumerate(rows)] * 2)
    assert bpe.encode_digests(wide, path, tokenizers.PATTERN).count() == 10 and bpe.encode(wide.where("false"), path, tokenizers.PATTERN).count() == 0
    got = {r.doc_id: r for r in bpe.encode_digests(docs_of(spark, [None, "hello there world"]), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN).collect()}
    assert got[0].n_tokens == 0 and got[0].ids_sha256 == got[0].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[1].decoded_sha256 == hashlib.sha256(b"hello there world").hexdigest()


def test_pipeline_stages(spark, texts):
    import corpus_pipeline as p

    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts + ["mail bob@mail.com please dear friend of mine"])], "doc_id long, text string, lang string, source string, n_chars long")
    out = p.language(spark, docs, "")
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {i for i, t in enumerate(texts) if t and re.search("[a-z]", t)} | {len(texts)}
    once = p.near_duplicates(spark, out, "")
    assert once.count() == len({r.class_id for r in ngram_join.join(out).collect()})
    masked = p.personal_data(spark, once, "")
    assert masked.columns == docs.columns and masked.where("text like 'mail <EMAIL> please%' and n_chars = length(text)").count() == 1
    mixed = p.source_mixture(spark, masked, "")
    taken = {r["doc_id"]: r["taken"] / r["size"] for r in mixing.mix(masked).collect() if r["size"]}
    assert collections.Counter(r.doc_id for r in mixed.select("doc_id").collect()) == {d: int(x + 0.5) for d, x in taken.items() if int(x + 0.5)}
    assert p.tokens(spark, mixed, "").count() == mixed.count()


CLASHES = ("lang_pred", "score", "lang_mix", "m0", "p0", "_txt", "_found", "_proposals", "_base", "_more", "_spans", "row", "times", "copy", "class_id", "size", "taken", "target", "h", "node", "a.b")


def test_pipeline_keeps_columns_of_any_name_and_rows_without_an_id(spark, texts):
    import corpus_pipeline as p

    docs = docs_of(spark, texts).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    docs = docs.unionByName(docs.where("doc_id between 7 and 9").withColumn("doc_id", F.lit(None).cast("long")))
    wide = docs.select("*", *(F.concat(F.lit(f"{c}:"), F.col("doc_id")).alias(c) for c in CLASHES))
    for name, stage in p.STAGES[:-1]:
        bare, out = stage(spark, docs, ""), stage(spark, wide, "")
        assert out.columns == wide.columns and out.count() == bare.count(), name
        assert collections.Counter(map(tuple, out.select(*bare.columns).collect())) == collections.Counter(map(tuple, bare.collect())), name
        assert all(r[c] == (None if r.doc_id is None else f"{c}:{r.doc_id}") for r in out.collect() for c in CLASHES), name
        if name != "source_mixture":
            assert out.where("doc_id is null").count() == 3, name


@pytest.mark.parametrize("keep", ["none", "all_null"])
def test_every_operator_takes_empty_tables_and_rows_of_nulls(spark, keep):
    import public_tokenizers

    docs = spark.createDataFrame([(None, None, None, None, None)] * 2, "doc_id long, text string, lang string, source string, n_chars long")
    pages = spark.createDataFrame([(None, None, None)] * 2, "page_id long, url string, html string")
    if keep == "none":
        docs, pages = docs.where("false"), pages.where("false")
    n = 0 if keep == "none" else 2
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for name, got in {
        "join": ngram_join.join(docs), "mix": mixing.mix(docs), "langid": langid.identify(docs, langid.fit(docs)), "quality": quality.ledger(docs), "pii": pii.detect(docs), "mask": pii.mask(docs),
        "bpe": bpe.encode_digests(docs, path, public_tokenizers.PATTERN), "html": html_extract.extract(pages), "warc": warc.round_trip(pages), "urls": url_filter.filter_urls(pages),
    }.items():
        assert got.count() == n, name
