"""Benchmark decontamination: token windows of test items are looked for in the training texts.

Words are runs of ASCII letters and digits and of anything beyond ASCII, with
A-Z in lower case.  A window is ``WINDOW`` consecutive words of an item; an
item with fewer words is one window.  A word of a document is hit if it lies
inside an occurrence of any window.

Scan.  The windows' 64-bit hashes form a hash set that every task holds.  A
document's windows are hashed by prefix sums, looked up many at once, and each
candidate is verified on its words, so a clash of hashes cannot be reported.
The scan is one pass over the documents without a shuffle.

Size.  The set is broadcast only if the items' texts have at most
``broadcast_bytes`` bytes, which is measured first.  Beyond, tasks hold a bit
table of fixed size (``BITS``), what passes it is joined with the windows by
shuffle on hash and words, and the hits come back by row.  Both ways give the
same rows.

Rows.  Null and empty texts have no words and no hits.  Texts of any length
are read whole; each row is answered, also one without an id or with a repeated
one.  A repeated item id counts once; an item without an id makes hits but is
not listed.  No items, or items without words, hit nothing.  Further columns
are kept, and ours give way to columns of the same name (``_`` is appended).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import common
from tidewell.session import work_folder

WINDOW = 10
BROADCAST_BYTES = 4 << 20
BITS = 27

_U = np.uint64
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
ANNOTATIONS = ["n_words", "n_hit", "items", "spans"]
_FOUND = "array<struct<h:long,start:long,n:long,words:string>>"
_SPANS = "array<struct<start:long,end:long>>"


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n + 1, base, dtype=np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


class Words:
    """The words of many texts: bytes in lower case, starts, ends, and the first word of each text."""

    def __init__(self, column: pa.Array):
        data, self.offsets = common.column_bytes(column)
        self.data = common._LOWER[data]
        self.starts, self.ends, self.first = common.find_words(self.data, self.offsets, common.APART)

    def hasher(self):
        """A function of n that gives the hash of the n words from each word on, as far as the words reach."""
        words = common.hash_words(self.data, self.starts, self.ends)
        sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * _powers(_BASE, len(words))[:-1], out=sums[1:])
        back = _powers(_INVERSE, len(words))

        def windows(n: int) -> np.ndarray:
            count = max(0, len(words) - n + 1)
            return common.mix((sums[n:] - sums[:count]) * back[:count] + _U(n)) if count else words[:0]

        return windows

    def inside(self, n: int) -> np.ndarray:
        """Whether the n words from each word on belong to one text."""
        count = max(0, len(self.starts) - n + 1)
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        return text[:count] == text[n - 1 :][:count] if count else np.zeros(0, dtype=bool)

    def joined(self, at: int, n: int) -> bytes:
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[at : at + n], self.ends[at : at + n], strict=True))


def _same_words(a: Words, at_a: np.ndarray, b: Words, at_b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether n words of a from at_a on are those of b from at_b on, for many windows at once."""
    if not len(n):
        return np.zeros(0, dtype=bool)
    window = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)
    left, right = at_a[window] + step, at_b[window] + step
    # A word often occurs in several windows: compare each pair of places once.
    pairs, back = np.unique(np.stack([left, right]), axis=1, return_inverse=True)
    from_a, from_b = a.starts[pairs[0]], b.starts[pairs[1]]
    size = a.ends[pairs[0]] - from_a
    equal = size == b.ends[pairs[1]] - from_b
    size = np.where(equal, size, 1)
    begin = np.cumsum(size) - size
    byte = np.arange(int(size.sum())) - np.repeat(begin, size)
    same = a.data[np.repeat(from_a, size) + byte] == b.data[np.repeat(from_b, size) + byte]
    equal &= np.logical_and.reduceat(same, begin)
    differing = np.zeros(len(n), dtype=np.int64)
    np.add.at(differing, window, ~equal[back.reshape(-1)])
    return differing == 0


def _item_windows(words: Words, size: int) -> Iterator[tuple[int, int, int]]:
    """Text, first word and length of each window of each text."""
    for t in range(len(words.first) - 1):
        first, n = int(words.first[t]), int(words.first[t + 1] - words.first[t])
        if n:
            for at in range(max(1, n - size + 1)):
                yield t, first + at, min(n, size)


@dataclass
class Index:
    """The hash set of all windows, small enough to be broadcast, and what verifies and names a hit."""

    words: Words
    bits: np.ndarray  # bit table of the hashes
    hashes: np.ndarray  # sorted; one entry per window with different words
    at: np.ndarray
    n: np.ndarray
    first_item: np.ndarray  # items of window w: item[first_item[w]:first_item[w + 1]]
    item: np.ndarray
    names: pa.Array  # sorted as strings

    @property
    def lengths(self) -> list[int]:
        return np.unique(self.n).tolist()


def build_index(ids: Sequence[str | None], texts: Sequence[str | None], size: int = WINDOW) -> Index:
    words = Words(pa.array(texts, pa.string()))
    hasher = words.hasher()
    names = sorted({i for i in ids if i is not None}, key=lambda s: s.encode())
    number = {name: k for k, name in enumerate(names)}
    windows: dict[bytes, int] = {}
    at, length, members = [], [], []
    for t, first, n in _item_windows(words, size):
        w = windows.setdefault(words.joined(first, n), len(windows))
        if w == len(at):
            at.append(first)
            length.append(n)
            members.append(set())
        if ids[t] is not None:
            members[w].add(number[ids[t]])
    hashes = np.empty(len(at), dtype=np.uint64)
    starts, lengths = np.array(at, dtype=np.int64), np.array(length, dtype=np.int64)
    for n in set(length):
        hashes[lengths == n] = hasher(n)[starts[lengths == n]]
    order = np.argsort(hashes, kind="stable")
    items = [sorted(members[w]) for w in order]
    return Index(
        words,
        _bit_table(hashes),
        hashes[order],
        starts[order],
        lengths[order],
        np.concatenate(([0], np.cumsum([len(m) for m in items], dtype=np.int64))).astype(np.int64),
        np.array([i for m in items for i in m], dtype=np.int64),
        pa.array(names, pa.string()),
    )


def _bit_table(hashes: np.ndarray) -> np.ndarray:
    """One byte per slot, at least sixteen slots per hash: most lookups end here."""
    table = np.zeros(1 << max(10, int(16 * len(hashes)).bit_length()), dtype=bool)
    table[(hashes & _U(len(table) - 1)).astype(np.int64)] = True
    return table


def _lookup(words: Words, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Verified hits: first word and window of each."""
    hasher = words.hasher()
    found, which = [], []
    for n in index.lengths:
        h = hasher(n)
        slot = (h & _U(len(index.bits) - 1)).astype(np.int64)
        place = np.flatnonzero(index.bits[slot] & words.inside(n))
        low = np.searchsorted(index.hashes, h[place], side="left")
        high = np.searchsorted(index.hashes, h[place], side="right")
        # Several windows only where hashes clash.
        count = high - low
        place = np.repeat(place, count)
        window = np.repeat(low, count) + np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count)
        fits = index.n[window] == n
        place, window = place[fits], window[fits]
        same = _same_words(words, place, index.words, index.at[window], index.n[window])
        found.append(place[same])
        which.append(window[same])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *found]), np.concatenate([none, *which])


def _covered(words: Words, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether each word lies in a hit."""
    change = np.zeros(len(words.starts) + 1, dtype=np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + n, -1)
    return np.cumsum(change)[:-1] > 0


def _lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values)


def _spans(words: Words, hit: np.ndarray) -> pa.Array:
    """Runs of hit words of each text, in code points."""
    texts = len(words.first) - 1
    text = np.repeat(np.arange(texts), np.diff(words.first))
    before = np.zeros(len(hit), dtype=bool)
    before[1:] = hit[:-1] & (text[1:] == text[:-1])
    after = np.zeros(len(hit), dtype=bool)
    after[:-1] = hit[1:] & (text[1:] == text[:-1])
    begin, end = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after)
    points = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80))) if len(begin) else np.zeros(1, dtype=np.int64)
    base = points[words.offsets[text[begin]]]
    values = pa.StructArray.from_arrays(
        [pa.array(points[words.starts[begin]] - base, pa.int64()), pa.array(points[words.ends[end]] - base, pa.int64())],
        names=["start", "end"],
    )
    return _lists(np.bincount(text[begin], minlength=texts), values)


def _per_text(words: Words, flags: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[words.first[1:]] - total[words.first[:-1]]


def _scan(index):
    """Rows with their annotations, by the broadcast index."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Index = index.value
        for batch in common.bounded(batches, "text"):
            words = Words(batch.column("text"))
            texts = batch.num_rows
            at, window = _lookup(words, known)
            hit = _covered(words, at, known.n[window])
            text = np.searchsorted(words.first, at, side="right") - 1
            # Each window of a text once, then each item of a text once.
            windows = np.unique(text * (len(known.n) + 1) + window)
            text, window = np.divmod(windows, len(known.n) + 1)
            count = known.first_item[window + 1] - known.first_item[window]
            place = np.repeat(known.first_item[window], count) + np.arange(int(count.sum()))
            place -= np.repeat(np.cumsum(count) - count, count)
            items = np.unique(np.repeat(text, count) * (len(known.names) + 1) + known.item[place])
            text, item = np.divmod(items, len(known.names) + 1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("kept"),
                    pa.array(np.diff(words.first), pa.int64()),
                    pa.array(_per_text(words, hit), pa.int64()),
                    _lists(np.bincount(text, minlength=texts), known.names.take(pa.array(item))),
                    _spans(words, hit),
                ],
                names=["kept", *ANNOTATIONS],
            )

    return scan


def _windows(size: int):
    """Hash, length, words and item of each window."""

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.bounded(batches, "text"):
            words = Words(batch.column("text"))
            found = np.array(list(_item_windows(words, size)), dtype=np.int64).reshape(-1, 3)
            hasher, h = words.hasher(), np.zeros(len(found), dtype=np.uint64)
            for n in np.unique(found[:, 2]):
                h[found[:, 2] == n] = hasher(int(n))[found[found[:, 2] == n, 1]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h.view(np.int64)),
                    pa.array(found[:, 2]),
                    pa.array([words.joined(at, n).decode() for _, at, n in found], pa.string()),
                    batch.column("item").take(pa.array(found[:, 0])),
                ],
                names=["h", "n", "words", "item"],
            )

    return windows


def _candidates(table, lengths: list[int]):
    """Rows with the windows that pass the bit table, not yet verified."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: np.ndarray = table.value
        for batch in common.bounded(batches, "text"):
            words = Words(batch.column("text"))
            hasher = words.hasher()
            none = np.zeros(0, dtype=np.int64)
            at, length, hashes = [none], [none], [none.view(np.uint64)]
            for n in lengths:
                h = hasher(n)
                slot = h & _U((1 << BITS) - 1)
                set_ = (bits[(slot >> _U(6)).astype(np.int64)] >> (slot & _U(63))) & _U(1)
                place = np.flatnonzero((set_ == 1) & words.inside(n))
                at.append(place)
                length.append(np.full(len(place), n, dtype=np.int64))
                hashes.append(h[place])
            place, n, h = (np.concatenate(x) for x in (at, length, hashes))
            text = np.searchsorted(words.first, place, side="right") - 1
            order = np.argsort(text, kind="stable")
            place, n, h, text = place[order], n[order], h[order], text[order]
            found = pa.StructArray.from_arrays(
                [
                    pa.array(h.view(np.int64)),
                    pa.array(place - words.first[text]),
                    pa.array(n),
                    pa.array([words.joined(a, k).decode() for a, k in zip(place, n, strict=True)], pa.string()),
                ],
                names=["h", "start", "n", "words"],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("kept"),
                    batch.column("row"),
                    batch.column("text"),
                    pa.array(np.diff(words.first), pa.int64()),
                    _lists(np.bincount(text, minlength=batch.num_rows), found),
                ],
                names=["kept", "row", "text", "n_words", "found"],
            )

    return scan


def _annotate_hits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_hit and spans from the verified hits of each row."""
    for batch in common.bounded(batches, "text"):
        words = Words(batch.column("text"))
        hits = batch.column("hits")
        flat = hits.flatten()
        count = pc.fill_null(pc.list_value_length(hits), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = flat.field("start").to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(words.first[:-1], count)
        hit = _covered(words, at, flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("kept"),
                batch.column("n_words"),
                pa.array(_per_text(words, hit), pa.int64()),
                batch.column("items"),
                _spans(words, hit),
            ],
            names=["kept", *ANNOTATIONS],
        )


def _by_shuffle(rows: DataFrame, items: DataFrame, size: int, schema: str) -> DataFrame:
    """The same annotations when the windows are too many to broadcast."""
    spark = rows.sparkSession
    folder = work_folder(spark, "decontamination")
    windows = common.stored(
        items.mapInArrow(_windows(size), "h long, n long, words string, item string").distinct(), f"{folder}/windows"
    )
    slot = F.col("h").bitwiseAND((1 << BITS) - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))
    # At most 2^(BITS - 6) rows, whatever the number of windows.
    table = windows.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(1 << (BITS - 6), dtype=np.uint64)
    bits[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())
    kept = rows.schema["kept"].dataType.simpleString()
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    held = spark.sparkContext.broadcast(bits)
    # The row numbers are written down once; nothing after this line numbers rows anew.
    scanned = common.stored(
        numbered.mapInArrow(
            _candidates(held, lengths), f"kept {kept}, row long, text string, n_words long, found {_FOUND}"
        ),
        f"{folder}/rows",
    )
    asked = scanned.select("row", F.explode("found").alias("f")).select("row", "f.*")
    hits = asked.join(windows.select("h", "words").distinct(), ["h", "words"], "left_semi")
    hits = common.stored(hits, f"{folder}/hits")
    hit_lists = hits.groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("hits"))
    listed = hits.select("row", "h", "words").distinct().join(windows.where("item is not null"), ["h", "words"])
    item_lists = listed.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    joined = scanned.drop("found").join(hit_lists, "row", "left").join(item_lists, "row", "left")
    none = F.array().cast("array<string>")
    whole = joined.select("kept", "text", "n_words", F.coalesce("items", none).alias("items"), "hits")
    return whole.mapInArrow(_annotate_hits, schema)


def annotate(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: Sequence[str] | None = None,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The kept columns (all, if not given), n_words, n_hit, items (sorted ids as text) and spans (code points) of each row."""
    keep = list(docs.columns if keep is None else keep)
    items = common.named(benchmark, item=F.col(item_column).cast("string"), text=item_text)
    # The text is wrapped in a struct with the kept columns under their own names, so that none clashes with ours.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.col(text_column).alias("text"))
    kept = rows.schema["kept"].dataType.simpleString()
    schema = f"kept {kept}, n_words long, n_hit long, items array<string>, spans {_SPANS}"
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= broadcast_bytes:
        listed = items.toArrow()
        index = build_index(listed.column("item").to_pylist(), listed.column("text").to_pylist(), size)
        found = rows.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(index)), schema)
    else:
        found = _by_shuffle(rows, items, size, schema)
    taken = list(keep)
    for name in ANNOTATIONS:
        taken.append(common.free(name, taken))
    renamed = [F.col(a).alias(b) for a, b in zip(ANNOTATIONS, taken[len(keep) :], strict=True)]
    return found.select(*[F.col(f"kept.`{c}`") for c in keep], *renamed)


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            if spans:
                edges = [0, *[x for s in spans for x in (s["start"], s["end"])], len(text)]
                text = "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(out, pa.string())], names=["kept", "text"])


def without_spans(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", **options) -> DataFrame:
    """The documents, columns as they are, with the hit words and what lies between them cut from the texts."""
    found = annotate(docs, benchmark, text_column=text_column, **options)
    names, spans = docs.columns, found.columns[-1]
    rows = found.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("kept"), F.col(text_column).alias("text"), F.col(spans).alias("spans")
    )
    cut = rows.mapInArrow(_cut, f"kept {rows.schema['kept'].dataType.simpleString()}, text string")
    same = [F.col("text").alias(c) if c == text_column else F.col(f"kept.`{c}`") for c in names]
    return cut.select(*same)


def without_documents(docs: DataFrame, benchmark: DataFrame, share: float = 0.0, **options) -> DataFrame:
    """The documents of whose words more than ``share`` are hit go; the others stay as they are."""
    found = annotate(docs, benchmark, **options)
    n_words, n_hit = found.columns[-4], found.columns[-3]
    return found.where(F.col(n_hit) <= F.col(n_words) * share).select(*[F.col(f"`{c}`") for c in docs.columns])


def digests(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts and a digest of the items of each row of ``annotate``."""
    n_words, n_hit, items = found.columns[-4:-1]
    return found.select(
        id_column,
        F.col(n_words).alias("n_words"),
        F.col(n_hit).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.col(n_hit) > 0).alias("contaminated"),
    )
