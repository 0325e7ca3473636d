"""Candidate pairs: equi-joins on exact keys and rare-token joins, always within a country, with provenance.

Document frequencies prune tokens before anything is joined; the pool is never indexed on a driver.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from erlink.functions import text as X
from erlink.operators import postings_scan as S


def exact_index(pool: DataFrame, key: str, max_df: int | None = None) -> DataFrame:
    """(country, key, cand_id) of non-empty keys; with max_df, without keys of more records."""
    rows = pool.where(F.col(key) != "").select("country", F.col(key).alias("key"), F.col("entity_id").alias("cand_id"))
    if max_df is None:
        return rows
    few = rows.groupBy("country", "key").count().where(F.col("count") <= max_df).select("country", "key")
    return rows.join(few, ["country", "key"], "left_semi")


def exact_join(s1: DataFrame, pool: DataFrame, key: str, max_df: int | None = None) -> DataFrame:
    """Pairs with equal non-empty keys in the same country."""
    left = s1.where(F.col(key) != "").select("country", F.col(key).alias("key"), F.col("entity_id").alias("s1_id"))
    return left.join(exact_index(pool, key, max_df), ["country", "key"]).select("s1_id", "cand_id")


def postings(records: DataFrame, tokens: Column, id_name: str) -> DataFrame:
    """(country, token, id): each distinct token of a record once."""
    return records.select("country", F.explode(F.array_distinct(tokens)).alias("token"), F.col("entity_id").alias(id_name)).where("token <> ''")


def document_frequency(pool_postings: DataFrame, min_df: int = 1, max_df: int | None = None) -> DataFrame:
    df = pool_postings.groupBy("country", "token").agg(F.count(F.lit(1)).alias("df"))
    return df.where((F.col("df") >= min_df) & (F.col("df") <= max_df) if max_df else F.col("df") >= min_df)


def rarest_tokens(s1_postings: DataFrame, df: DataFrame, k: int) -> DataFrame:
    """The k rarest tokens of each S1 that the pruned df table holds; equal frequencies by token."""
    order = Window.partitionBy("s1_id").orderBy("df", "token")
    return s1_postings.join(S.shuffled(df), ["country", "token"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def token_join(s1: DataFrame, pool: DataFrame, tokens: Callable[[], Column], max_df: int, k: int, min_overlap: int = 1) -> DataFrame:
    """Pairs that share at least min_overlap of the S1's k rarest tokens; overlap is how many."""
    have = postings(pool, tokens(), "cand_id")
    asked = rarest_tokens(postings(s1, tokens(), "s1_id"), document_frequency(have, max_df=max_df), k)
    shared = asked.select("country", "token", "s1_id").join(S.shuffled(have), ["country", "token"]).groupBy("s1_id", "cand_id").agg(F.count(F.lit(1)).alias("overlap"))
    return shared.where(F.col("overlap") >= min_overlap) if min_overlap > 1 else shared


def dense_token_join(s1: DataFrame, pool: DataFrame, tokens: Callable[[], Column], max_df: int, k: int, min_overlap: int = 1) -> DataFrame:
    """Pairs that share at least min_overlap of the S1's k rarest tokens; overlap is how many. As token_join, for tokens with many shared rows."""
    rows = S.ask(s1, pool, lambda _: [tokens()], [(max_df, k)]).scan("s1_id string, cand_id string, value bigint", S.overlaps(min_overlap))
    return rows.withColumnRenamed("value", "overlap")


def column_tokens(name: str) -> Callable[[], Column]:
    return lambda: X.tokens(F.col(name))


def column_ngrams(name: str, n: int) -> Callable[[], Column]:
    return lambda: X.char_ngrams(F.col(name), n)


@dataclass(frozen=True)
class Channel:
    """kind exact: key and max_df. kind token: column, max_df, k, min_overlap; ngram > 0 uses its character n-grams."""

    name: str
    column: str
    kind: str = "exact"
    max_df: int | None = None
    k: int = 0
    min_overlap: int = 1
    ngram: int = 0

    def tokens(self, columns: Collection[str]) -> Column:
        """The channel's tokens of a record: its words (from <column>_tokens where that is there), its n-grams, or the one exact key."""
        if self.kind == "exact":
            return F.array(F.col(self.column))
        if self.ngram:
            return X.char_ngrams(F.col(self.column), self.ngram)
        ready = f"{self.column}_tokens"
        return F.col(ready) if ready in columns else X.tokens(F.col(self.column))

    def pairs(self, s1: DataFrame, pool: DataFrame) -> DataFrame:
        return candidates(s1, pool, (self,)).select("s1_id", "cand_id")


_EXACT = (Channel("b1", "name_norm"), Channel("b2", "name_no_suffix"))
_POSTAL = Channel("b7a", "postal_run")


def _config(b3: tuple[int, int], b5: tuple[int, int], *more: Channel) -> tuple[Channel, ...]:
    return (*_EXACT, Channel("b3", "name_norm", "token", *b3), Channel("b5", "address_norm", "token", *b5), _POSTAL, *more)


_STREET = Channel("b7b", "street_number", "exact", 5000)

#: Named sets of channels: (max_df, K) of the name and address token channels, and what comes on top. Fixed values.
CONFIGS = {
    "A": _config((500, 4), (500, 4)),
    "B": _config((1000, 4), (1000, 6), _STREET),
    "C": _config((3000, 4), (3000, 6), _STREET, Channel("b8", "name_norm", "token", 500, 12, 1, 4)),
    "D1": _config((500, 4), (1000, 6)),
    "D2": _config((1000, 4), (500, 4)),
    "D3": _config((500, 4), (2000, 6)),
    "D4": _config((2000, 4), (500, 4)),
}


def asked(s1: DataFrame, pool: DataFrame, channels: tuple[Channel, ...]) -> S.Asked:
    """The tokens and keys that each S1 asks for in each channel: one count of frequencies and one ranking for all channels.

    An exact key is a token of its channel without a rank. Of a token channel count the k rarest tokens of each S1 among
    those of at most max_df records; equal frequencies by token.
    """
    return S.ask(s1, pool, lambda records: [c.tokens(records.columns) for c in channels], [(c.max_df, c.k if c.kind == "token" else 0) for c in channels])


def least_overlaps(channels: tuple[Channel, ...]) -> tuple[int, ...]:
    return tuple(c.min_overlap for c in channels)


def united(configs: Mapping[str, tuple[Channel, ...]]) -> tuple[tuple[Channel, ...], tuple[tuple[tuple[int, int], ...], ...]]:
    """Channels that hold those of all configurations, and each one's greatest df and rank in each configuration (-1 where it has none).

    Channels that differ in max_df and k alone become one with the greatest of both: ranks go by frequency, so the tokens
    of the smaller are those of the larger within its limits. With a least overlap above 1, a channel is by itself.
    """
    groups: dict[tuple, list[Channel | None]] = {}
    for at, channels in enumerate(configs.values()):
        for c in channels:
            own = (c.max_df, c.k) if c.min_overlap > 1 else ()
            groups.setdefault((c.column, c.kind, c.ngram, c.min_overlap, *own), [None] * len(configs))[at] = c
    found, limits, none = [], [], 1 << 62
    for row in groups.values():
        of = [(-1, -1) if c is None else (c.max_df or none, c.k if c.kind == "token" else 0) for c in row]
        df = max(d for d, _ in of)
        found.append(replace(next(c for c in row if c), max_df=None if df == none else df, k=max(k for _, k in of)))
        limits.append(tuple(of))
    return tuple(found), tuple(limits)


def candidates(s1: DataFrame, pool: DataFrame, channels: tuple[Channel, ...]) -> DataFrame:
    """Union of the channels' pairs, once each, with a from_ flag (0 or 1) for every channel.

    The flags travel as the bits of one number. A pair is complete when it appears: nothing is shuffled for a shared token.
    """
    bits = asked(s1, pool, channels).scan("s1_id string, cand_id string, value bigint", S.channel_bits(least_overlaps(channels)))
    return bits.select("s1_id", "cand_id", *(F.shiftright("value", i).bitwiseAND(F.lit(1)).cast("int").alias(f"from_{c.name}") for i, c in enumerate(channels)))


def with_labels(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """label: 1 if the pair is a true edge."""
    marked = truth.select("s1_id", "cand_id").distinct().withColumn("_true", F.lit(1))
    return pairs.join(marked, ["s1_id", "cand_id"], "left").withColumn("label", F.coalesce("_true", F.lit(0))).drop("_true")


def hydrate(pairs: DataFrame, s1: DataFrame, pool: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The pairs with both records' columns as <column>_1 and <column>_2; each pair is joined once, after the union."""
    left = s1.select(F.col("entity_id").alias("s1_id"), *(F.col(c).alias(f"{c}_1") for c in columns))
    right = pool.select(F.col("entity_id").alias("cand_id"), *(F.col(c).alias(f"{c}_2") for c in columns))
    return pairs.join(left, "s1_id").join(right, "cand_id")


def hydrate_left(pairs: DataFrame, numbers: DataFrame, id_column: str, suffix: str, columns: tuple[str, ...]) -> DataFrame:
    """Left join of derived strings; what is missing becomes an empty string."""
    side = numbers.select(F.col("entity_id").alias(id_column), *(F.col(c).alias(f"{c}{suffix}") for c in columns))
    return pairs.join(side, id_column, "left").na.fill("", [f"{c}{suffix}" for c in columns])


def leak_checks(pairs: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """Pairs across countries, candidates with a bad prefix, repeated pairs."""
    both = hydrate(pairs.select("s1_id", "cand_id"), s1, pool, ("country",))
    leaks = both.agg(F.count(F.lit(1)).alias("n_pairs"), F.coalesce(F.sum(F.when(F.col("country_1") != F.col("country_2"), 1).otherwise(0)), F.lit(0)).alias("cross_country"), F.coalesce(F.sum(F.when(~F.col("cand_id").rlike("^S[23]-"), 1).otherwise(0)), F.lit(0)).alias("bad_prefix"))
    repeats = pairs.groupBy("s1_id", "cand_id").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))
    return leaks.select("*", repeats.scalar().alias("duplicates"))
