"""Similarity join of documents on word n-grams, with Bayesian candidate pruning.

1. Texts of equal words are one class (copies are never expanded into pairs); each class has the set of its 5-word
   shingles and a MinHash signature of N_HASH values.
2. Candidates are classes that share a band of ROWS values in one of BANDS: a pair at the threshold 0.8 is missed with
   probability (1 - 0.8**3)**20 < 6e-7. A bucket whose members all lie in one larger bucket adds no pair and is dropped.
3. In a bucket, pairs compare STEP MinHash values at a time. After each step a pair is dropped if the posterior
   probability that its similarity reaches the threshold (uniform prior) is below TOLERANCE.
4. The Jaccard similarity of the rest is computed exactly from the shingles (64-bit hashes of the words).
Large buckets are cut in blocks, of about BLOCK rows and BLOCK_BYTES of shingles at most, and every two blocks are a
group, so no task holds a bucket. Step 3 ships signatures alone and returns, for each row that has a surviving partner
in its group, a bit for each of them; only the shingles of such rows are made and shipped for step 4. Groups return link
counts and a forest of their links, never the pairs; connected components join the forests.
"""

from __future__ import annotations

from collections.abc import Callable
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from erlink.llm.common import map_batches, materialize, small

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 3
N_HASH, STEP = 96, 24
TOLERANCE = 1e-6
BLOCK, BLOCK_BYTES = 512, 32 << 20
#: Shingles hashed at once, and words remembered by a task.
CHUNK, VOCABULARY = 8192, 1 << 20

_RNG = np.random.default_rng(20)
_A = _RNG.integers(1, 1 << 63, N_HASH, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, N_HASH, np.uint64)


def needed_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """For n compared values: the fewest matches m at which P(similarity >= threshold | m of n) >= tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail is P(Binomial(n + 1, threshold) <= m).
    """
    out = np.zeros(N_HASH + 1, np.int32)
    for n in range(1, N_HASH + 1):
        tail = 0.0
        for m in range(n + 1):
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                out[n] = m
                break
    return out


class Shingler:
    def __init__(self):
        self.words: dict[bytes, int] = {}

    def shingles(self, text: str | None) -> tuple[bytes | None, np.ndarray]:
        """The class of a text (None: no words) and its distinct shingle hashes, sorted. Under 5 words: one shingle."""
        words = (text or "").encode().split()
        if not words:
            return None, np.empty(0, np.uint64)
        known = self.words
        if len(known) > VOCABULARY:
            known.clear()
        h = np.empty(len(words), np.uint64)
        for i, w in enumerate(words):
            x = known.get(w)
            if x is None:
                x = known[w] = xxhash.xxh3_64_intdigest(w)
            h[i] = x
        n = max(1, len(words) - SHINGLE + 1)
        mixed = h[:n].copy()
        for k in range(1, min(SHINGLE, len(words))):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k : n + k]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        return xxhash.xxh3_128_digest(b" ".join(words)), np.unique(mixed)


def signature(shingles: np.ndarray) -> np.ndarray:
    best = np.full(N_HASH, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(shingles), CHUNK):
        best = np.minimum(best, (shingles[None, lo : lo + CHUNK] * _A[:, None] + _B[:, None]).min(1))
    return (best >> np.uint64(32)).astype("<u4")


def surviving(a: np.ndarray, b: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Pairs (rows of a x rows of b) that Bayesian pruning leaves, as a boolean matrix."""
    matches = np.zeros((len(a), len(b)), np.uint8)
    alive = np.ones(matches.shape, bool)
    for lo in range(0, N_HASH, STEP):
        part = alive.sum()
        if part * 8 < alive.size:  # few are left: compare those alone
            i, j = np.nonzero(alive)
            got = matches[i, j] + (a[i, lo : lo + STEP] == b[j, lo : lo + STEP]).sum(1)
            matches[i, j] = got
            alive[i, j] = got >= need[lo + STEP]
        else:
            for k in range(lo, lo + STEP):
                matches += a[:, k, None] == b[None, :, k]
            alive &= matches >= need[lo + STEP]
    return alive


def exact_links(left: list[np.ndarray], right: list[np.ndarray], alive: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """The alive pairs whose exact Jaccard similarity reaches the threshold."""
    out = np.zeros_like(alive)
    i, j = np.nonzero(alive)
    if len(i) <= 64:
        for p, q in zip(i, j, strict=True):
            x, y = left[p], right[q]
            at = np.searchsorted(x, y)
            both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
            out[p, q] = both >= threshold * (len(x) + len(y) - both)
        return out
    used_l, used_r = np.unique(i), np.unique(j)
    shared = np.intersect1d(np.concatenate([left[p] for p in used_l]), np.concatenate([right[q] for q in used_r]))
    width = -(-max(1, len(shared)) // 64)

    def packed(sets: list[np.ndarray], used: np.ndarray) -> np.ndarray:
        bits = np.zeros((len(used), width * 64), bool)
        for r, p in enumerate(used):
            at = np.searchsorted(shared, sets[p])
            at = at[(at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == sets[p])] if len(shared) else at[:0]
            bits[r, at] = True
        return np.packbits(bits, axis=1).view(np.uint64)

    lo_step = max(1, (64 << 20) // (width * 64))  # rows packed at once: bounded memory for long texts
    size_r = np.array([len(right[q]) for q in used_r])
    for r0 in range(0, len(used_r), lo_step):
        rows_r = used_r[r0 : r0 + lo_step]
        bits_r = packed(right, rows_r)
        for l0 in range(0, len(used_l), lo_step):
            rows_l = used_l[l0 : l0 + lo_step]
            for p, bits in zip(rows_l, packed(left, rows_l), strict=True):
                pick = np.flatnonzero(alive[p, rows_r])
                both = np.bitwise_count(bits_r[pick] & bits).sum(1).astype(np.int64)
                out[p, rows_r[pick]] = both >= threshold * (len(left[p]) + size_r[r0 + pick] - both)
    return out


def sides(rows: list[dict]) -> tuple[list[dict], list[dict]]:
    """The rows of the group's two blocks, ordered by node; twice the same if it is a block with itself."""
    bi, bj = rows[0]["bi"], rows[0]["bj"]
    rows = sorted(rows, key=lambda r: r["node"])
    a = [r for r in rows if r["own"] == bi]
    return a, a if bi == bj else [r for r in rows if r["own"] == bj]


def prune_group(rows: list[dict], need: np.ndarray) -> list[tuple[int, bytes, bytes]]:
    """own, node and partners of each row of a group that has a surviving partner.

    partners are the bits of the other block's surviving rows, in order of their nodes.
    """
    a, b = sides(rows)
    if not a or not b or a is b and len(a) < 2:
        return []
    sig = lambda xs: np.stack([np.frombuffer(x["sig"], "<u4") for x in xs])
    alive = surviving(sig(a), sig(b), need)
    if a is b:
        alive = np.triu(alive, 1)
    # A pair counts in the least of the kept buckets that it shares.
    bucket = rows[0]["bucket"]
    earlier = sorted({x for r in rows for x in r["buckets"] if x < bucket})
    if earlier and alive.any():
        member = lambda xs: np.array([[x in s for x in earlier] for s in (set(r["buckets"]) for r in xs)], np.float32)
        alive &= (member(a) @ member(b).T) == 0
    if a is b:
        alive |= alive.T
    left, right = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
    bits = lambda m: [x.tobytes() for x in np.packbits(m, axis=1)]
    out = [(a[i]["own"], a[i]["node"], x) for i, x in zip(left, bits(alive[np.ix_(left, right)]), strict=True)]
    return out if a is b else out + [(b[j]["own"], b[j]["node"], x) for j, x in zip(right, bits(alive[np.ix_(left, right)].T), strict=True)]


def verify_group(rows: list[dict]) -> list[tuple[bytes, int, bytes]]:
    """Links among the surviving pairs of a group: node, links found, root of its tree."""
    a, b = sides(rows)
    alive = np.stack([np.unpackbits(np.frombuffer(r["partners"], np.uint8), count=len(b)).astype(bool) for r in a])
    if a is b:
        alive = np.triu(alive, 1)
    sets = lambda xs: [np.frombuffer(x["shingles"], np.uint64) for x in xs]
    links = exact_links(sets(a), sets(b), alive)
    if not links.any():
        return []
    copies = lambda xs: np.array([r["copies"] for r in xs], np.int64)
    nodes = [r["node"] for r in a] + ([] if a is b else [r["node"] for r in b])
    count = np.zeros(len(nodes), np.int64)
    off = 0 if a is b else len(a)
    count[: len(a)] += links @ copies(b)
    count[off : off + len(b)] += links.T @ copies(a)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for p in np.flatnonzero(links.any(1)):
        r = root(int(p))
        for q in np.flatnonzero(links[p]):
            s = root(int(q) + off)
            if s != r:
                parent[s] = r
    least: dict[int, bytes] = {}
    for x in np.flatnonzero(count):
        r = root(int(x))
        least[r] = min(least.get(r, nodes[x]), nodes[x])
    return [(nodes[x], int(count[x]), least[root(int(x))]) for x in np.flatnonzero(count)]


def map_groups(dealt: DataFrame, one: Callable[[list[dict]], list[tuple]], schema: str, keep: bool) -> DataFrame:
    """one() over the rows of each group (bucket, bi, bj). keep: its rows follow the group's key.

    Ranges of the key, not its hash, go to tasks: ranges are cut by counts of rows, so that groups of many rows do not
    meet by chance. A task holds a group at a time.
    """
    rows = dealt.repartitionByRange("bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj")
    fields = T._parse_datatype_string(("bucket bigint, bi int, bj int, " if keep else "") + schema)
    kinds = to_arrow_schema(fields)

    def run(batches):
        key, held = None, []

        def done():
            found = [(*key, *x) for x in one(held)] if keep else one(held)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], f.type) for i, f in enumerate(kinds)], kinds.names)

        for batch in batches:
            for row in batch.to_pylist():
                k = row["bucket"], row["bi"], row["bj"]
                if k != key:
                    if len(held) > 1:
                        yield done()
                    key, held = k, []
                held.append(row)
        if len(held) > 1:
            yield done()

    return rows.mapInArrow(run, fields)


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each connected component of the edges (u, v); alternating large and small stars.

    Each round is a table of the shared folder. Rounds end when the edges no longer change; only a count and a checksum
    of them reach the driver.
    """

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())

    def star(e: DataFrame, large: bool) -> DataFrame:
        # Neighbours: all of a node for the large star, the smaller ones for the small star.
        around = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        both = around.join(least, "u")
        out = both.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else both.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    now = materialize(edges.where("u <> v").select("u", "v").distinct(), "join-edges")
    last = state(now)
    while last[0]:
        now = materialize(star(star(now, True), False), "join-edges")
        new = state(now)
        if new == last:
            break
        last = new
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, n_links, rep_id, root, text_hash for every row of docs.

    rep_id is the smallest id with the same words; class_id the smallest id of its connected component of links;
    n_links the number of other documents at a Jaccard similarity of 0.8 or more, copies included; root names the
    component (null for a text without words), text_hash the exact text. Texts of under five
    words have one shingle, of all their words. Null, empty and blank texts have none: each is a class of its own
    without links. Very long texts are compared whole. Repeated rows are copies of each other, and so are rows without an
    id; what has no id at all is null in rep_id and class_id. An empty table gives none; other columns are not read, so
    they may have any name.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))

    def sign():
        shingler = Shingler()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            nodes, sigs, sizes = [], [], []
            for text in batch.column(1):
                node, s = shingler.shingles(text.as_py())
                nodes.append(node)
                sigs.append(None if node is None else signature(s).tobytes())
                sizes.append(len(s))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(nodes, pa.binary()), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int32())], ["doc_id", "text_hash", "node", "sig", "size"])

        return one

    signed = materialize(map_batches(rows, sign, "doc_id bigint, text_hash bigint, node binary, sig binary, size int"), "join-signatures")
    classes = signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep_id"), F.count(F.lit(1)).alias("copies"), F.min("sig").alias("sig"), F.min("size").alias("size"))
    classes = materialize(classes, "join-classes")

    # Band buckets of the classes.
    bands = F.array(*(F.xxhash64(F.lit(b), F.substring("sig", 4 * ROWS * b + 1, 4 * ROWS)) for b in range(BANDS)))
    filed = materialize(classes.select("node", "size", F.explode(bands).alias("bucket")), "join-bands")
    sized = filed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")).where("n > 1")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("size") * 8 / BLOCK_BYTES)).cast("int")
    sized = sized.groupBy("n", "size", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "n", blocks.alias("blocks"))  # equal sets once
    members = materialize(filed.select("node", "bucket").join(sized, "bucket"), "join-members")
    largest = members.groupBy("node").agg(F.max(F.struct("n", "bucket")).alias("top"))
    spread = members.join(largest, "node").groupBy("bucket").agg(F.min("top.bucket").alias("low"), F.max("top.bucket").alias("high"))
    members = members.join(spread.where("low <> high or low = bucket").select("bucket"), "bucket")

    # A row a class: its kept buckets, BANDS at most; then the groups of their blocks, and pruning by signatures.
    lists = members.groupBy("node").agg(F.sort_array(F.collect_list("bucket")).alias("buckets"), F.collect_list(F.struct("bucket", "blocks")).alias("in"))
    placed = lists.join(classes.select("node", "sig"), "node").select("node", "buckets", "sig", F.explode("in").alias("in")).select("node", "buckets", "sig", "in.*")
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", "node", "buckets", "sig")
    need = needed_matches()
    alive = materialize(map_groups(dealt, lambda held: prune_group(held, need), "own int, node binary, partners binary", True), "join-survivors")

    # Shingles of the classes that have a surviving pair, from the texts.
    wanted = materialize(alive.select("node").distinct().join(classes.select("node", "rep_id", "copies"), "node"), "join-candidates")
    n_wanted = wanted.count()
    ids = small(wanted.select(F.col("rep_id").alias("rep")).distinct(), n_wanted, 64)
    texts = rows.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")

    def shingle():
        shingler = Shingler()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [shingler.shingles(t.as_py()) for t in batch.column(1)]
            return pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.binary()), pa.array([s.tobytes() for _, s in found], pa.binary())], ["node", "shingles"])

        return one

    bodies = map_batches(texts, shingle, "node binary, shingles binary").where("node is not null")
    bodies = materialize(bodies.join(small(wanted.select("node", "copies"), n_wanted, 128), "node").dropDuplicates(["node"]), "join-bodies")
    found = map_groups(alive.join(bodies, "node"), verify_group, "node binary, links bigint, root binary", False)
    found = materialize(found, "join-links")

    # A node's least root stands for it; only the roots, of which a group has few, are joined to components.
    linked = materialize(found.groupBy("node").agg(F.sum("links").alias("links"), F.min("root").alias("root")), "join-linked")
    edges = found.select("node", F.col("root").alias("u")).join(linked.select("node", F.col("root").alias("v")), "node").select("u", "v").distinct()
    whole = materialize(components(edges).select(F.col("node").alias("root"), F.col("root").alias("top")), "join-components")
    linked = linked.join(small(whole, whole.count(), 128), "root", "left").select("node", "links", F.coalesce("top", "root").alias("root"))
    tied = materialize(classes.select("node", "rep_id", "copies").join(linked, "node", "left"), "join-tied")
    heads = materialize(tied.where("root is not null").groupBy("root").agg(F.min("rep_id").alias("head")), "join-heads")
    tied = tied.join(small(heads, heads.count(), 128), "root", "left")
    alone_id = F.when(F.col("root").isNull(), F.col("rep_id")).otherwise(F.col("head"))
    by_node = tied.select("node", alone_id.alias("class_id"), "rep_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    full = signed.where("node is not null").select("doc_id", "text_hash", "node").join(by_node, "node")
    alone = signed.where("node is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.col("doc_id").alias("rep_id"), F.lit(None).cast("binary").alias("root"), "text_hash")
    return full.select(*alone.columns).unionByName(alone)
