"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is cut in halves down to leaves; each leaf is encoded alone, and neighbours are joined by encoding anew a window
around their border. The window grows until both its ends are *sure borders*: a position whose left character is not
white space and whose right one is a space or newline. No alternative of the pattern matches across such a position and
none looks further back, so every lexing has a piece border there, and the tokens outside the window are those of the
whole text. The join is associative: any tree gives the ids of the whole text.
Decoding concatenates the byte strings of the ids up the same kind of tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from erlink.llm.common import map_batches

#: Characters in a leaf, and in the first window on each side of a border.
LEAF = 2048
WINDOW = 32
#: Pieces whose ids a task remembers.
REMEMBERED = 1 << 16

#: White space as the library's matcher defines it.
SPACES = r"\t-\r \x85\xa0  -     　"


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class TreeBpe:
    """Encoder and decoder over the content of a rank file."""

    def __init__(self, ranks: bytes, pattern: str):
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.ranks, self.known = table, {}
        self.leaf = tiktoken.Encoding("tree", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.bytes_of = [b""] * (max(table.values()) + 1)
        for token, rank in table.items():
            self.bytes_of[rank] = token
        self.width = [len(x) for x in self.bytes_of]
        self.names = [str(i) for i in range(len(self.bytes_of))]
        self.pieces = regex.compile(pattern.replace(r"[^\s", f"[^{SPACES}").replace(r"\s", f"[{SPACES}]").replace(r"\S", f"[^{SPACES}]"))

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: of all neighbours those of the lowest rank are joined first, the leftmost of equal ones. n log n."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        n, rank = len(piece), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the token that starts at i; 0: none starts there
        queue = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, stop = heapq.heappop(queue)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue  # one of the two has been joined meanwhile
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := rank(piece[i : end[stop]])) is not None:
                    heapq.heappush(queue, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := rank(piece[p:stop])) is not None:
                heapq.heappush(queue, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode_window(self, text: str) -> list[int]:
        """Ids of a window, piece by piece. The library's matcher has a bounded stack, and a window may be an unbroken run of any length."""
        out: list[int] = []
        for m in self.pieces.finditer(text):
            piece = m.group()
            ids = self.known.get(piece)
            if ids is None:
                ids = self.merge(piece.encode())
                if len(piece) <= WINDOW:
                    if len(self.known) >= REMEMBERED:
                        self.known.clear()
                    self.known[piece] = ids
            out += ids
        return out

    def encode(self, text: str, lo: int = 0, hi: int | None = None) -> list[int]:
        hi = len(text) if hi is None else hi
        if hi - lo <= LEAF:
            return self.leaf.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return self.join(text, lo, mid, hi, self.encode(text, lo, mid), self.encode(text, mid, hi))

    def join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """Ids of text[lo:hi] from those of text[lo:mid] and text[mid:hi]."""
        a = self._border(text, mid, lo, -1)
        b = self._border(text, mid, hi, 1)
        keep, rest = len(left), len(text[a:mid].encode())
        while rest > 0:
            keep -= 1
            rest -= self.width[left[keep]]
        skip, more = 0, len(text[mid:b].encode())
        while more > 0:
            more -= self.width[right[skip]]
            skip += 1
        if rest or more:
            raise AssertionError("a window's end is no token border")
        del left[keep:]
        left += self.encode_window(text[a:b])
        left += right[skip:]
        return left

    @staticmethod
    def _border(text: str, mid: int, end: int, step: int) -> int:
        """The sure border next to mid on one side, sought in growing windows; the text's end if there is none."""
        reach, at = WINDOW, mid
        while at != end:
            stop = max(end, mid - reach) if step < 0 else min(end, mid + reach)
            lo, hi = (stop, at) if step < 0 else (at, stop)
            while True:
                p = max(text.rfind(" ", lo, hi), text.rfind("\n", lo, hi)) if step < 0 else min((x for x in (text.find(" ", lo, hi), text.find("\n", lo, hi)) if x >= 0), default=-1)
                if p < 0:
                    break
                # Both neighbours must lie in the half that is kept.
                if (p > end if step < 0 else p > mid) and not text[p - 1].isspace():
                    return p
                lo, hi = (lo, p) if step < 0 else (p + 1, hi)
            at, reach = stop, reach * 4
        return end

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ids, concatenated up the tree."""
        if len(ids) <= LEAF:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@lru_cache(maxsize=4)
def _codec(ranks: bytes, pattern: str) -> TreeBpe:
    return TreeBpe(ranks, pattern)


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256. The ids are decoded again for the last.

    Only the two named columns are read, so other columns may have any name. A null text counts as empty: 0 tokens and
    the digest of no bytes. Very long texts, unbroken runs too, are encoded whole. Repeated rows and ids each give their
    row; an empty table gives none.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))  # a vocabulary file: a few MB at most

    def make():
        codec = _codec(ranks.value, pattern)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, ids_sha, decoded_sha = [], [], []
            for text in batch.column(1):
                ids = codec.encode(text.as_py() or "")
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(codec.names.__getitem__, ids)).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return one

    return map_batches(docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"cast(`{text_col}` as string) text"), make, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: the token ids of every whole text. Nulls count as empty texts."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def make():
        codec = _codec(ranks.value, pattern)
        return lambda batch: pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.encode(t.as_py() or "") for t in batch.column(1)], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_batches(docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"cast(`{text_col}` as string) text"), make, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, content binary: the bytes of each id list; null lists give no bytes."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def make():
        codec = _codec(ranks.value, pattern)
        return lambda batch: pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.decode(x.as_py() or []) for x in batch.column(1)], pa.binary())], ["doc_id", "content"])

    return map_batches(encoded.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"cast(`{ids_col}` as array<int>) ids"), make, "doc_id bigint, content binary")
