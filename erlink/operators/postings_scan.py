"""The union of an S1's posting lists, S1 by S1, without a row for every shared token.

S1s are dealt into blocks of a country. A block gets the posting lists that its S1s ask for, once each, and unites them in
NumPy: no shared token is shuffled, sorted or written, and a pair appears once, when it is complete.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from erlink.sources.scratch import materialize

#: S1s of a block, which share the posting lists sent to it; rows of a posting list in one row; pairs of a batch.
BLOCK_ROWS, LIST_ROWS, BATCH_PAIRS = 50_000, 1 << 16, 1 << 18
_KEYS = ("channel", "country", "token")


@dataclass(frozen=True)
class Asked:
    """ids: country, no, cand_id. have: code, df, no. probe: country, s1_id, channel, code, df, rank (0 without a ranking)."""

    ids: DataFrame
    have: DataFrame
    probe: DataFrame
    n_s1: int

    def found(self, truth: DataFrame, least: tuple[int, ...]) -> DataFrame:
        """s1_id, cand_id, channel, overlap, df and rank (both the least) of the true edges that a channel finds: joined by edge, so linear in them."""
        edges = truth.select("s1_id", "cand_id").distinct().join(self.probe, "s1_id").join(self.ids.select("cand_id", "no"), "cand_id")
        shared = edges.join(self.have.select("code", "no").distinct(), ["code", "no"]).groupBy("s1_id", "cand_id", "channel")
        rows = shared.agg(F.count_distinct("code").alias("overlap"), F.min("df").alias("df"), F.min("rank").alias("rank"))
        return rows.where(F.col("overlap") >= F.element_at(F.array(*map(F.lit, least)), F.col("channel") + 1))

    def scan(self, schema: str, unite: Callable, mode: str = "pairs") -> DataFrame:
        """unite(lists, tags, marks) -> (candidates, values) of an S1. mode pairs: a row per candidate; counts: values alone, an array per S1; total: sums of them.

        lists: its posting lists, rarest first within a channel; tags: channel, rank and df of each; marks: zeros, to be left so.
        """
        spark = self.probe.sparkSession
        blocks = max(spark.sparkContext.defaultParallelism, math.ceil(self.n_s1 / BLOCK_ROWS))
        probe = self.probe.withColumn("block", F.pmod(F.xxhash64("s1_id"), F.lit(blocks)).cast("int"))
        tag = F.struct("channel", "rank", "code", "df")
        asks = probe.groupBy("country", "block", "s1_id").agg(F.array_sort(F.collect_set(tag)).alias("asks"))
        lists = self.have.withColumn("part", F.pmod("no", F.ceil(F.col("df") / LIST_ROWS))).groupBy("code", "part").agg(F.collect_set("no").alias("nos"))
        sent = probe.select("country", "block", "code").distinct().join(lists, "code")
        ids = self.ids.withColumn("part", F.pmod("no", F.lit(64))).groupBy("country", "part").agg(F.collect_list(F.struct("no", "cand_id")).alias("c"))
        ids = probe.select("country", "block").distinct().join(ids, "country")
        none_l, none_s, none_a = F.lit(None).cast("array<bigint>"), F.lit(None).cast("array<string>"), F.lit(None).cast("array<bigint>")
        rows = ids.select("country", "block", F.lit(0).alias("side"), F.lit(0).cast("bigint").alias("code"), F.col("c.no").alias("nos"), F.col("c.cand_id").alias("names"), F.lit("").alias("s1_id"), none_a.alias("channels"), none_a.alias("dfs"), none_a.alias("ranks"))
        rows = rows.unionByName(sent.select("country", "block", F.lit(1).alias("side"), "code", "nos", none_s.alias("names"), F.lit("").alias("s1_id"), none_a.alias("channels"), none_a.alias("dfs"), none_a.alias("ranks")))
        a = lambda x: F.col(f"asks.{x}").cast("array<bigint>")
        rows = rows.unionByName(asks.select("country", "block", F.lit(2).alias("side"), F.lit(0).cast("bigint").alias("code"), a("code").alias("nos"), none_s.alias("names"), "s1_id", a("channel").alias("channels"), a("df").alias("dfs"), a("rank").alias("ranks")))
        dealt = rows.repartition(4 * blocks, "country", "block").sortWithinPartitions("country", "block", "side")
        return dealt.mapInArrow(_scanner(unite, mode), schema)


def shuffled(rows: DataFrame) -> DataFrame:
    """rows, never broadcast in a join: Spark guesses the size of exploded tokens from that of their files, many times too small, and a broadcast goes through the driver."""
    return rows.hint("merge")


def ask(s1: DataFrame, pool: DataFrame, tokens: Callable[[DataFrame], list], channels: list[tuple[int | None, int]]) -> Asked:
    """What each S1 asks for. tokens(records): each channel's tokens; channels: (greatest df or None, k or 0 for all) of each.

    Tokens of a record, counts and ranks are made once and written; a token is a number from then on.
    """

    def listed(records, side):
        each = F.array(*(F.struct(F.lit(i).alias("channel"), t.alias("tokens")) for i, t in enumerate(tokens(records))))
        return materialize(records.where("country is not null").select("country", "entity_id", each.alias("each"), F.monotonically_increasing_id().alias("no")), side)

    pool_rows, s1_rows = listed(pool, "pool-tokens"), listed(s1, "s1-tokens")
    opened = lambda rows, *more: rows.select("country", *more, F.explode("each").alias("_c")).select("country", *more, "_c.channel", F.explode(F.array_distinct("_c.tokens")).alias("token")).where("token <> ''")
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("channel") + 1)
    have, want = opened(pool_rows, "no"), opened(s1_rows.withColumnRenamed("entity_id", "s1_id"), "s1_id").distinct()
    limit, k = of([c[0] or (1 << 62) for c in channels]), of([c[1] for c in channels])
    df = have.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("df")).where(F.col("df") <= limit)
    keys = materialize(df.join(shuffled(want.select(*_KEYS).distinct()), list(_KEYS), "left_semi").withColumn("code", F.monotonically_increasing_id()), "token-codes")
    order = Window.partitionBy("channel", "s1_id").orderBy("df", "token")
    coded = want.join(shuffled(keys), list(_KEYS)).withColumn("rank", F.when(k > 0, F.row_number().over(order)).otherwise(0)).where(F.col("rank") <= k)
    probe = materialize(coded.select("country", "s1_id", "channel", "code", "df", "rank"), "asked")
    codes = probe.select("code").distinct()
    held = materialize(have.join(shuffled(keys), list(_KEYS)).join(codes, "code", "left_semi").select("code", "df", "no"), "postings")
    return Asked(pool_rows.select("country", "no", F.col("entity_id").alias("cand_id")), held, probe, s1_rows.count())


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Consecutive rows of equal (country, block, side)."""
    side, block = batch.column(2).to_numpy(), batch.column(1).to_numpy()
    country = batch.column(0).dictionary_encode().indices.to_numpy()
    cut = np.flatnonzero((side[1:] != side[:-1]) | (block[1:] != block[:-1]) | (country[1:] != country[:-1])) + 1
    for lo, hi in zip([0, *cut], [*cut, batch.num_rows], strict=True):
        yield (batch.column(0)[int(lo)].as_py(), int(block[lo]), int(side[lo])), batch.slice(int(lo), int(hi - lo))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and where each list begins and ends among them."""
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64))])
    return column.flatten().to_numpy(zero_copy_only=False), ends


class _Block:
    """Posting lists of a block as positions in its candidates."""

    def __init__(self):
        self.nos, self.names, self.codes, self.values = [], [], [], []

    def close(self) -> None:
        nos, names = np.concatenate(self.nos), pa.concat_arrays(self.names)
        order = np.argsort(nos)
        coded = names.take(pa.array(order)).dictionary_encode()
        self.ids, at, nos = coded.dictionary, coded.indices.to_numpy().astype(np.int32), nos[order]
        repeated = len(self.ids) < len(nos)  # an id of several records is one candidate
        self.lists: dict[int, np.ndarray] = {}
        for code, value in zip(self.codes, self.values, strict=True):
            found = at[np.searchsorted(nos, value)]
            self.lists[code] = np.concatenate([self.lists[code], found]) if code in self.lists else found
        if repeated:
            self.lists = {c: np.unique(v) for c, v in self.lists.items()}
        self.marks = np.zeros(len(self.ids), np.int64)
        self.nos = self.names = self.codes = self.values = None


def _scanner(unite: Callable, mode: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, s1, cands, values, n = None, None, [], [], [], 0

        def out():
            if mode == "total":
                return pa.RecordBatch.from_arrays([pa.array([np.sum(values, axis=0).tolist()], pa.list_(pa.int64()))], ["n"])
            if mode == "counts":
                return pa.RecordBatch.from_arrays([pa.array(s1, pa.string()), pa.array(values, pa.list_(pa.int64()))], ["s1_id", "n"])
            times = np.repeat(np.arange(len(s1)), [len(c) for c in cands])
            ids = block.ids.take(pa.array(np.concatenate(cands)))
            return pa.RecordBatch.from_arrays([pa.array(s1, pa.string()).take(pa.array(times)), ids, pa.array(np.concatenate(values))], ["s1_id", "cand_id", "value"])

        for batch in batches:
            for (country, number, side), rows in _runs(batch):
                if (country, number) != now:
                    if s1:
                        yield out()
                    now, block, s1, cands, values, n = (country, number), _Block(), [], [], [], 0
                flat, ends = _flat(rows.column(4))
                if side == 0:
                    block.nos.append(flat)
                    block.names.append(rows.column(5).flatten())
                elif side == 1:
                    block.codes.extend(rows.column(3).to_pylist())
                    block.values.extend(flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))
                else:
                    if block.nos is not None:
                        block.close()
                    tags = np.column_stack([_flat(rows.column(i))[0] for i in (7, 9, 8)])  # channel, rank, df
                    for i, name in enumerate(rows.column(6).to_pylist()):
                        a, b = ends[i], ends[i + 1]
                        found, value = unite([block.lists[c] for c in flat[a:b].tolist()], tags[a:b], block.marks)
                        s1.append(name)
                        cands.append(found)
                        values.append(value)
                        n += len(found) if mode == "pairs" else 20
                        if n >= BATCH_PAIRS:
                            yield out()
                            s1, cands, values, n = [], [], [], 0
        if s1:
            yield out()

    return run


def overlaps(least: int) -> Callable:
    """How many lists hold a candidate, of those that at least so many hold."""

    def unite(lists, tags, marks):
        new = []
        for x in lists:
            seen = marks[x]
            marks[x] = seen + 1
            new.append(x[seen == 0])
        found = np.concatenate(new)
        value = marks[found]
        marks[found] = 0
        return (found, value) if least < 2 else (found[value >= least], value[value >= least])

    return unite


def channel_bits(least: tuple[int, ...]) -> Callable:
    """A bit for each channel that finds a candidate: at least so many of its lists hold it."""
    one = [overlaps(x) for x in least]

    def unite(lists, tags, marks):
        channel, parts = tags[:, 0], []
        for i in np.unique(channel):
            own = [x for x, c in zip(lists, channel, strict=True) if c == i]
            parts.append((1 << int(i), own[0] if len(own) == 1 and least[i] < 2 else one[i](own, None, marks)[0]))
        new = []
        for bit, x in parts:
            seen = marks[x]
            marks[x] = seen | bit
            new.append(x[seen == 0])
        found = np.concatenate(new)
        value = marks[found]
        marks[found] = 0
        return found, value

    return unite


def config_counts(least: tuple[int, ...], limits: tuple[tuple[tuple[int, int], ...], ...]) -> Callable:
    """How many candidates each of several configurations has, from one union. limits: of each channel, each configuration's greatest df and rank (-1: none)."""
    df, rank = (np.array([[own[k] for own in channel] for channel in limits], np.int64) for k in (0, 1))
    n = df.shape[1]
    bit = 1 << np.arange(n, dtype=np.int64)
    has = np.arange(1 << n)[:, None] >> np.arange(n) & 1
    repeated = [i for i, x in enumerate(least) if x > 1]
    one = {i: overlaps(least[i]) for i in repeated}

    def unite(lists, tags, marks):
        channel = tags[:, 0]
        masks = ((tags[:, 2:] <= df[channel]) & (tags[:, 1:2] <= rank[channel])) @ bit
        parts = [(x, m) for x, m, c in zip(lists, masks, channel, strict=True) if c not in one]
        for i in repeated:
            own = np.flatnonzero(channel == i)
            if len(own):
                parts.append((one[i]([lists[k] for k in own], None, marks)[0], masks[own[0]]))
        new = []
        for x, mask in parts:
            seen = marks[x]
            marks[x] = seen | mask
            new.append(x[seen == 0])
        found = np.concatenate(new)
        value = marks[found]
        marks[found] = 0
        return (), np.bincount(value, minlength=1 << n) @ has

    return unite


def first_counts(sweeps: tuple[tuple[int, tuple[int, ...]], ...]) -> Callable:
    """(column of tags: 1 rank, 2 df; grid) of each channel: for each limit of the grid, the candidates whose least value first fits it."""

    def unite(lists, tags, marks):
        out = []
        for channel, (column, grid) in enumerate(sweeps):
            counts, seen = [0] * len(grid), []
            own = np.flatnonzero(tags[:, 0] == channel)
            bins = np.searchsorted(grid, tags[own, column])
            for i in np.argsort(bins, kind="stable"):
                if bins[i] < len(grid):
                    x = lists[own[i]]
                    x = x[marks[x] == 0] if seen else x
                    marks[x] = 1
                    seen.append(x)
                    counts[bins[i]] += len(x)
            for x in seen:
                marks[x] = 0
            out += counts
        return (), out

    return unite
