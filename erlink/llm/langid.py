"""Language identification by multilingual mixture inference.

A document is a mixture of languages; each of its letter trigrams comes from one of them. Expectation-maximisation
estimates the document's proportions from the trigram likelihoods of the languages, and the language set is the one
whose likelihood, less a penalty for each further language, is greatest. The prediction is the largest share of that set.

The likelihoods are learned from a sample of labelled rows with a documented bound (MAX_ROWS per language, in
expectation; by a hash of the id, so reruns agree). Every row is predicted from its whole text.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from erlink.llm.common import map_batches

BUCKETS = 1 << 16
MAX_ROWS = 4000
#: Of more labels than this the most frequent are learned (of equally frequent ones the smaller): a bound of the model, which is broadcast.
MAX_LANGS = 128
SMOOTHING = 0.05
EM_STEPS = 15
#: A further language must raise the log-likelihood by LOG_PENALTY * ln(n) + GRAM_PENALTY * n for n trigrams.
LOG_PENALTY = 2.0
GRAM_PENALTY = 0.01
#: Overlapping trigrams share letters: this many count as one independent observation in the score.
OVERLAP = 3.0
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """Code point -> lower-cased letter, or a space for what is no letter."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            table[c] = ord(ch.lower()[0])
    return table


def grams(text: str) -> np.ndarray:
    """Hashed letter trigrams of a text in order; words are padded with one space."""
    codes = _fold()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    codes = np.concatenate(([32], codes, [32])).astype(np.uint32)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    codes = codes[keep]
    if len(codes) < 3:
        return np.empty(0, np.uint16)
    mixed = codes[:-2] * np.uint32(0x9E3779B1) ^ codes[1:-1] * np.uint32(0x85EBCA6B) ^ codes[2:] * np.uint32(0xC2B2AE35)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    mixed ^= mixed >> np.uint32(13)
    return (mixed & np.uint32(BUCKETS - 1)).astype(np.uint16)[codes[1:-1] != 32]


class MixtureModel:
    def __init__(self, langs: list[str], counts: np.ndarray):
        """counts: languages x BUCKETS."""
        self.langs = langs
        background = counts.sum(0) + 1.0
        smooth = SMOOTHING * BUCKETS * background / background.sum()
        self.p = (counts + smooth) / (counts.sum(1, keepdims=True) + SMOOTHING * BUCKETS) if langs else counts
        self.log_p = np.log(self.p)

    def _em(self, p: np.ndarray, c: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, float]:
        n = c.sum()
        for _ in range(EM_STEPS):
            new = pi * (p @ (c / (pi @ p))) / n
            done = np.abs(new - pi).max() < 1e-3
            pi = new
            if done:
                break
        return pi, float(c @ np.log(pi @ p))

    def predict(self, text: str | None) -> tuple[str, float, str]:
        """Language, score, and the chosen set with its proportions."""
        g = grams(text) if text and self.langs else ()
        if not len(g):
            return UNKNOWN, 0.0, ""
        g, c = np.unique(g, return_counts=True)
        c = c.astype(float)
        n = c.sum()
        single = self.log_p[:, g] @ c
        best = int(single.argmax())
        top, share, gain = best, {best: 1.0}, 0.0
        if len(self.langs) > 1:
            price = LOG_PENALTY * np.log(n + 1) + GRAM_PENALTY * n
            p = self.p[:, g]
            pi, _ = self._em(p, c, np.full(len(self.langs), 1 / len(self.langs)))
            order = np.argsort(-pi, kind="stable")
            for k in range(2, int((pi > 0.01).sum()) + 1):
                chosen = order[:k]
                part, ll = self._em(p[chosen], c, pi[chosen] / pi[chosen].sum())
                if ll - price * (k - 1) - single[best] > gain:
                    gain = ll - price * (k - 1) - single[best]
                    share = dict(zip(map(int, chosen), part, strict=True))
                    top = max(share, key=lambda i: (share[i], -i))
        post = np.exp((single - single.max()) / OVERLAP)
        sure = float(post[best] / post.sum()) if len(share) == 1 else 1.0
        listed = sorted(share.items(), key=lambda x: (-x[1], x[0]))
        return self.langs[top], min(1.0, float(share[top]) * sure), ",".join(f"{self.langs[i]}:{w:.3f}" for i, w in listed)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS) -> MixtureModel:
    """Learns from the labelled rows that are not held out: about max_rows of each language at most, of MAX_LANGS languages.

    Null labels, ids and texts teach nothing; without any label the model knows no language. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()}
    if not sizes:
        return MixtureModel([], np.zeros((0, BUCKETS)))
    whole, part = 1_000_000, F.lit(0)
    for lang, n in sizes.items():
        part = F.when(F.col("lang") == lang, min(whole, max(1, whole * max_rows // n))).otherwise(part)
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(whole)) < part).select("lang", "text")  # part is 0 for a label that is not learned

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if text := text.as_py():
                    sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    np.add.at(sums[lang], grams(text), 1)
        for lang, x in sums.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(x[at], pa.int64())], ["lang", "gram", "n"])

    counted = sample.mapInArrow(count, "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(sizes)
    out = np.zeros((len(langs), BUCKETS))
    if counted.num_rows:  # BUCKETS rows for each language at most
        at = {x: i for i, x in enumerate(langs)}
        out[[at[x] for x in counted.column(0).to_pylist()], counted.column(1).to_numpy()] = counted.column(2).to_numpy()
    return MixtureModel(langs, out)


def identify(docs: DataFrame, model: MixtureModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (all, if None), then lang_pred, score and lang_mix, from the text alone; no shuffle.

    Null texts and texts without a letter give "und", score 0 and an empty mix, and so do all without a learned language.
    Languages of equal likelihood: the smaller code. Very long texts are read whole. Repeated rows each give a row, an
    empty table none. A kept column may not have the name of a new one: it is replaced; other columns may have any name.
    """
    new = ("lang_pred", "score", "lang_mix")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.p.astype(np.float32)))  # MAX_LANGS x 256 KB at most

    def make():
        m = MixtureModel.__new__(MixtureModel)
        m.langs, m.p = shared.value[0], shared.value[1].astype(float)
        m.log_p = np.log(m.p)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [m.predict(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            lang, score, mix = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(mix, pa.string())], [*keep, *new])

        return one

    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text_col).cast("string").alias("__text"))
    kinds = (T.StringType(), T.DoubleType(), T.StringType())
    return map_batches(rows, make, T.StructType([*rows.schema.fields[:-1], *map(T.StructField, new, kinds)]))
