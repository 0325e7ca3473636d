"""Quality rules as a bitmask ledger.

One pass over the whole texts evaluates every rule once and stores its measurements and one failure bit per rule. A
policy is a versioned mask over those bits: applying one, changing one, or asking what each rule alone removes
(ablation) are bitwise operations and sums over the ledger and never read a text again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erlink.llm.common import map_batches

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

#: Rules in the order of their bits, as SQL over the measurements; true: the text fails.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 16 * n_words"),
)
BASE = ("few_words", "repeated_windows")

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def bit(name: str) -> int:
    return 1 << [n for n, _ in RULES].index(name)


@dataclass(frozen=True)
class Policy:
    """A text is kept if it fails none of the rules."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(map(bit, self.rules))


POLICIES = {
    "v1": Policy("v1", BASE),
    "v2": Policy("v2", tuple(n for n, _ in RULES)),
}


def repeat_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of word ids found twice or more in the text."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    mixed = ids[:n].astype(np.uint64)
    for k in range(1, window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[k : n + k].astype(np.uint64)
    mixed.sort()
    if not (mixed[1:] == mixed[:-1]).any():  # equal windows mix equally
        return 0
    # Window identity without hash collisions: ranks of pairs, doubled up to the window's length (a power of two).
    rank, span = ids, 1
    while span < window:
        pair = rank[:-span].astype(np.int64) * (len(ids) + 1) + rank[span:]
        rank, span = np.unique(pair, return_inverse=True)[1], span * 2
    twice = np.bincount(rank)[rank] > 1
    if not twice.any():
        return 0
    edges = np.zeros(len(ids) + 1, np.int32)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of one text. bytes.split() splits at exactly the ASCII white space of WORD."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode()
    words = raw.split()
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    repeated = repeat_words(ids) if len(index) <= len(words) - WINDOW else 0
    seen, dup, lines = set(), 0, 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    chars = len(text) - (len(raw) - len(raw.translate(None, SPACES)))
    return len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), dup, repeated, lines


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, MEASURES (bigint) and fail_bits for every row of docs; the texts are read here only, without a shuffle.

    A null text has no words, as an empty one: it fails few_words. Very long texts are read whole. Repeated rows and ids
    each give a row, an empty table none; other columns are not read, so they may have any name.
    """

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = zip(*(measure(t.as_py()) for t in batch.column(1)), strict=True)
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *MEASURES])

        return one

    measured = map_batches(docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"cast(`{text_col}` as string) text"), make, "doc_id bigint, " + ", ".join(f"{m} bigint" for m in MEASURES))
    bits = " | ".join(f"(case when {sql} then {bit(name)}L else 0L end)" for name, sql in RULES)
    return measured.withColumn("fail_bits", F.expr(bits))


def fails(policy: Policy) -> Column:
    """Whether an entry fails any rule of the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) != 0


def only_failed(policy: Policy) -> Column:
    """The rule of the policy that alone an entry fails, without which it would be kept; else null."""
    failed, found = F.col("fail_bits").bitwiseAND(F.lit(policy.mask)), F.lit(None).cast("string")
    for r in policy.rules:
        found = F.when(failed == bit(r), F.lit(r)).otherwise(found)
    return found


def apply_policy(entries: DataFrame, policy: Policy) -> DataFrame:
    """entries with policy (its version) and kept."""
    return entries.withColumn("policy", F.lit(policy.version)).withColumn("kept", ~fails(policy))


def ablation(entries: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents that fail it, and those that fail it alone and so come back without it."""
    failed = F.col("fail_bits").bitwiseAND(F.lit(policy.mask))
    counts = entries.groupBy(failed.alias("bits")).agg(F.count(F.lit(1)).alias("n"))  # 2 to the number of rules at most
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).cast("bigint").alias("bit")) for r in policy.rules)))
    return counts.select("bits", "n", rules.alias("r")).groupBy("r.rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
    )
