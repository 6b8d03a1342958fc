"""Byte-pair encoding and decoding with a given vocabulary.

A word's symbols form a doubly linked list; the ranks of adjacent pairs lie in
a priority queue.  The lowest rank (leftmost on ties) is merged, the pairs with
the new neighbours are added, and entries whose pair has changed meanwhile are
skipped.  Words are split, normalised and marked at their end as the vocabulary
file says.  Decoding joins the strings of the vocabulary.

Null texts count as empty and have no tokens; texts of any length are encoded
whole; repeated rows give repeated results; other columns are ignored.  What is
a letter or number is decided by the ``regex`` package's Unicode version, which
knows some characters of Unicode 17 and later that older splitters do not.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidewell.llm.common import bounded, named
from tidewell.llm.vocabulary import byte_characters, load

#: Words whose ids a worker remembers; it forgets all when there are more.  Speed only.
REMEMBERED = 400_000


class Words(dict):
    """The ids of each word seen lately, as little-endian 32-bit integers."""

    def __init__(self, vocabulary: dict[str, int], merges: list, end: str):
        super().__init__()
        self.ids = vocabulary
        self.end = end
        self.characters = byte_characters()
        self.merges = {}
        for rank, pair in enumerate(merges):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocabulary[left], vocabulary[right]] = (rank, vocabulary[left + right])

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self.encode(word)
        self[word] = packed = struct.pack(f"<{len(ids)}I", *ids)
        return packed

    def encode(self, word: str) -> list[int]:
        symbols = [self.characters[b] for b in word.encode("utf-8")]
        symbols[-1] += self.end
        ids = [self.ids[s] for s in symbols]
        n, merges = len(ids), self.merges
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []
        for i in range(n - 1):
            if found := merges.get((ids[i], ids[i + 1])):
                queue.append((found[0], i, found[1]))
        heapq.heapify(queue)
        while queue:
            rank, i, merged = heapq.heappop(queue)
            j = after[i]
            if ids[i] < 0 or j >= n or merges.get((ids[i], ids[j]), (-1,))[0] != rank:
                continue  # stale
            ids[i], ids[j], after[i] = merged, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if found := merges.get((merged, ids[after[i]])):
                    heapq.heappush(queue, (found[0], i, found[1]))
            if before[i] >= 0 and (found := merges.get((ids[before[i]], merged))):
                heapq.heappush(queue, (found[0], before[i], found[1]))
        return [x for x in ids if x >= 0]


class Codec:
    """Encodes and decodes whole texts with one vocabulary file of words with a mark at their end."""

    def __init__(self, path: str):
        file = load(path)
        model = file["model"]
        self.words = Words(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        split = file["pre_tokenizer"]["pretokenizers"][0]
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special = {t["content"]: struct.pack("<I", t["id"]) for t in file["added_tokens"]}
        self.parts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.tokens = {i: t for t, i in model["vocab"].items()} | {t["id"]: t["content"] for t in file["added_tokens"]}

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        if self.parts and any(s in text for s in self.special):
            return b"".join(self.special.get(p) or self._plain(p) for p in self.parts.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        # Lower case goes by single characters: a capital sigma gets the same letter at any place.
        lower = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return b"".join(map(self.words.__getitem__, self.pattern.findall(lower)))

    def decode(self, ids: bytes) -> str:
        """The vocabulary's strings, with a space between, as of a file that names no decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def encode(documents: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, ids (little-endian 32-bit integers as binary) and the decoded text of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in bounded(batches, "text"):
            ids = [tool.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(map(tool.decode, ids), pa.string())],
                ["doc_id", "ids", "decoded"],
            )

    rows = named(documents, doc_id=id_column, text=text_column)
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, ids binary, decoded string")


def digests(documents: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes each document and returns the digests of both, formed where the texts are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in bounded(batches, "text"):
            ids = [tool.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([sha(x) for x in ids]),
                    pa.array([sha(tool.decode(x).encode("utf-8")) for x in ids]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = named(documents, doc_id="doc_id", text="text")
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
