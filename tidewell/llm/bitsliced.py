"""Exact top-k search by inner product over a bit-sliced index.

Components become integers, floor(64 x).  A block of vectors is kept as
bitmaps: one for each binary place of each attribute, a bit for each row.  For
a query the bitmaps of an attribute are added at the places where the query's
component has a one; carry-save adders sum all bitmaps of one place at once,
and what remains are the slices of the score.  Negative components add the
complement, which shifts all scores of the block by a known amount.  The best
rows are chosen from the most significant slice downward: a slice either fills
the result or narrows the rows still tied.  Rows tied to the end are resolved
by the smaller id.

Vectors that are null or hold a null or non-finite component take no part,
neither do rows without an id; a query only meets vectors of its own length.
An empty vector scores 0.  A row is never its own result; another row with the
query's id is one like any other.  Repeated query rows are answered each.  An
empty table gives no row; other columns are ignored.  Scores must fit 64 bits:
a vector whose squared length in integers reaches 2**62 stops the job with an
error, as an overflow of ANSI SQL does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import tiles

STEPS = 64
_LIMIT = 2.0**62


def _integers(table: pa.Table) -> np.ndarray:
    flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    size = table.column("size")[0].as_py()
    return flat.astype(np.int64).reshape(table.num_rows, size)


class BitSlices:
    """The index of one block: rows sorted by id, each attribute as bitmaps of its binary places."""

    def __init__(self, ids: np.ndarray, marks: np.ndarray, values: np.ndarray):
        order = np.lexsort((marks, ids))
        self.ids, self.marks, self.values = ids[order], marks[order], values[order]
        self.n = len(ids)
        self.words = -(-self.n // 64)
        self.all = self._bitmap(np.ones(self.n, dtype=bool))
        self.least = self.values.min(axis=0) if self.values.size else np.zeros(values.shape[1], dtype=np.int64)
        raised = (self.values - self.least).astype(np.uint64)
        self.bits = int(raised.max(initial=0)).bit_length()
        places = [(raised >> np.uint64(b)) & np.uint64(1) for b in range(self.bits)]
        # [attribute, place, word]
        self.slices = np.stack([self._bitmaps(p.T.astype(bool)) for p in places], axis=1) if places else None

    def _bitmap(self, flags: np.ndarray) -> np.ndarray:
        return self._bitmaps(flags[None, :])[0]

    def _bitmaps(self, flags: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(flags), self.words * 64), dtype=bool)
        padded[:, : self.n] = flags
        return np.packbits(padded, axis=1, bitorder="little").view("<u8")

    def score_slices(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """The bitmaps of the score's places, lowest first, and what is to be added to the score."""
        shift = int(query @ self.least)
        if self.slices is None:
            return [], shift
        size = np.abs(query)
        negative = query < 0
        shift -= int(size[negative].sum()) * ((1 << self.bits) - 1)
        flipped = self.slices ^ np.where(negative, ~np.uint64(0), np.uint64(0))[:, None, None]
        at_place: dict[int, list[np.ndarray]] = {}
        for w in range(int(size.max(initial=0)).bit_length()):
            used = np.flatnonzero((size >> w) & 1)
            for b in range(self.bits) if len(used) else ():
                at_place.setdefault(w + b, []).append(flipped[used, b])
        out, place, carried = [], 0, None
        while at_place or carried is not None:
            stack = at_place.pop(place, []) + ([carried] if carried is not None else [])
            x = np.concatenate(stack) if stack else np.zeros((1, self.words), dtype=np.uint64)
            carries = []
            while len(x) > 1:
                if len(x) == 2:
                    carries.append((x[0] & x[1])[None, :])
                    x = (x[0] ^ x[1])[None, :]
                    break
                m = len(x) // 3 * 3
                a, b, c = x[0:m:3], x[1:m:3], x[2:m:3]
                half = a ^ b
                carries.append((a & b) | (half & c))
                x = np.concatenate((half ^ c, x[m:]))
            out.append(x[0])
            carried = np.concatenate(carries) if carries else None
            place += 1
        return out, shift

    def top(self, query: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but the one marked ``own``."""
        slices, _ = self.score_slices(query)
        tied = self.all & ~self._bitmap(self.marks == own)
        chosen = np.zeros(self.words, dtype=np.uint64)
        count = 0
        for one in reversed(slices):
            more = tied & one
            n = int(np.bitwise_count(more).sum())
            if count + n > k:
                tied = more
            else:
                chosen, count = chosen | more, count + n
                tied &= ~one
                if count == k:
                    break
        rows = self._rows(chosen)
        if count < k:
            rows = np.concatenate((rows, self._rows(tied)[: k - count]))
        return self.ids[rows], self.values[rows] @ query

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def best_of_tile(k: int):
    """The function that finds the k best of one pair of blocks."""

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        parts: list[tuple] = []
        if left.num_rows and right.num_rows:
            index = BitSlices(right.column("id").to_numpy(), right.column("row").to_numpy(), _integers(right))
            marks, ids = left.column("row").to_numpy(), left.column("id").to_numpy()
            for i, query in enumerate(_integers(left)):
                found, scores = index.top(query, k, marks[i])
                parts.append((np.full(len(found), ids[i]), np.full(len(found), marks[i]), found, scores))
        columns = [np.concatenate(p) for p in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 4
        names = ["query_id", "query_row", "vec_id", "score"]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)

    return tile


def top_products(
    table: DataFrame, is_query, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for each row that meets ``is_query`` (a condition on id)."""
    rows = tiles.vectors(table, id_column, vector_column, zero=True)
    whole = F.transform("v", lambda x: F.floor(x.cast("double") * STEPS))
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double") * STEPS * STEPS)
    fits = F.when(length < _LIMIT, whole).otherwise(
        F.raise_error(F.lit("a vector is too long for scores of 64 bits")).cast("array<bigint>")
    )
    rows = rows.withColumn("v", fits)
    return tiles.search(rows.where(is_query), rows, best_of_tile(k), k, "long")
