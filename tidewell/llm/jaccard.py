"""Exact join of documents by the Jaccard similarity of their word shingles, as classes of linked documents.

Documents with equal shingle sets are one class.  Shingles have one order for
all: rare ones first.  A link at similarity t leaves a set of n at most
n - ceil(t n) shingles that the other lacks, so linked sets share one of their
first n - ceil(t n) + 1 shingles.  Each of these is a region of the metric
space around a document, and a set enters all of them: this is the window in
which its neighbours' regions can lie.  With a neighbour that is not smaller a
set even shares one of its first n - ceil(2 t n / (1 + t)) + 1 shingles, its near
regions.  So only pairs of which the smaller set is near are compared in a
region, and a region without a near member holds no link: letters of one form,
whose common shingles come late in the order, meet nowhere.

* Every region has a pivot among its members.  Members of other components are
  compared with it, which joins a group of near copies in as many comparisons
  as it has members.  Regions whose members are then all in one component are
  done; large ones get further pivots as long as that closes many of them.
* In what remains only members of different components are compared: small
  regions by a join, large ones in blocks of bounded size on both sides.  There the
  members outside a region's largest component meet the others, near ones all
  blocks of near and other members, the others only the blocks of near ones, and
  all of them only blocks of sets whose size allows a link.  Of the pairs of two
  components only the closest few leave a block; if they are not linked and
  others remain, the next round takes more of them.
* A comparison first uses the triangle inequality: a set's parity sketch is a
  point of a Hamming space in which a step of one shingle moves one bit, so the
  distance of two sketches is at most the size of the sets' difference.  What
  remains is decided on the whole sets.

Shingles are kept as 64-bit hashes.  Frequent shingles come last in the order;
the list of them is bounded and only affects the speed, as any order is exact.

Null and empty texts have no shingles and link with nothing.  A row without an
id joins no other, but is counted; rows that repeat an id and text form one
class.  Empty tables give no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import BROADCAST_ROWS, bounded, document_words, mix, most, named, shingle_hashes, small, stored
from tidewell.llm.graphs import with_links
from tidewell.session import work_folder

#: Similarity in percent from which on two sets are linked.
PERCENT = 75
#: Shingles that come last in the order: about so many at most, if so many sets of one text in ``SAMPLE`` have them.
FREQUENT = 1 << 20
OFTEN = 2
SAMPLE = 4
#: Members of frequent shingles' regions are dealt to so many parts when regions are formed.
SALTS = 64
#: Members up to which a region's pairs are formed by a join, and of a block otherwise.
LEAF = 32
BLOCK = 512
#: Large regions get another pivot while that leaves at most this share of their members open.
CLOSING = 0.7

_U = np.uint64
_CLASS = _U(0x9E3779B97F4A7C15)


def shingle_set(words: np.ndarray) -> np.ndarray:
    return np.unique(shingle_hashes(words))


def class_of(shingles: np.ndarray) -> int:
    """A 64-bit hash of a set."""
    return int(mix(mix(shingles ^ _CLASS).sum(keepdims=True) + _U(len(shingles)))[0].astype(np.int64))


def first_ones(n: int, percent: int = PERCENT) -> int:
    """How many shingles of a set of n are its first ones."""
    return n - -(-percent * n // 100) + 1


def near_ones(n: int, percent: int = PERCENT) -> int:
    """How many shingles of a set of n it shares one of with any linked set that is not smaller."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def sketch(shingles: np.ndarray) -> bytes:
    """The parities of how many shingles fall into each of 4n or more places, a power of two."""
    size = 1 << max(6, int(4 * len(shingles) - 1).bit_length())
    place = (mix(shingles) & _U(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=size) & 1).astype(bool), bitorder="little").tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """A sketch in ``size`` bytes, at most its own: places that are equal but for high bits fall together."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, dtype=np.uint8).reshape(-1, size), axis=0)


def may_link(n: int, m: int, percent: int = PERCENT) -> int:
    """The largest difference of linked sets of n and m shingles; -1 if their sizes alone exclude a link."""
    if 100 * min(n, m) < percent * max(n, m):
        return -1
    return n + m - 2 * -(-percent * (n + m) // (100 + percent))


def close(n: int, bits: bytes, m: int, other: bytes) -> bool:
    """Whether sizes and sketches allow a link."""
    most = may_link(n, m)
    if most < 0:
        return False
    size = min(len(bits), len(other))
    return int(np.bitwise_count(folded(bits, size) ^ folded(other, size)).sum()) <= most


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def profiles(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n (shingles), class and sketch of each document; class and sketch are null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            sets = [shingle_set(w) for w in document_words(batch.column("text"))]
            columns = [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()),
                pa.array([sketch(s) if len(s) else None for s in sets], pa.binary()),
            ]
            yield pa.record_batch([batch.column("doc_id"), *columns], ["doc_id", "n", "class", "sketch"])

    rows = named(documents, doc_id=id_column, text=text_column)
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n long, class long, sketch binary")


Sets = list[tuple[int, np.ndarray]]


def _from_sets(texts: DataFrame, each: Callable[[Sets], pa.RecordBatch], schema: str) -> DataFrame:
    """Applies ``each`` to the (class, set) of the texts of rows with an id, to each class once in a task.

    So a text with many copies counts once in a task, without a join with the list of classes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in bounded(batches, "text"):
            sets: Sets = []
            for words in document_words(batch.column("text")):
                found = shingle_set(words)
                if len(found) and (c := class_of(found)) not in seen:
                    seen.add(c)
                    sets.append((c, found))
            yield each(sets)

    return texts.where("doc_id is not null").select("text").mapInArrow(run, schema)


def _frequent(texts: DataFrame, folder: str) -> np.ndarray:
    """Frequent shingles, rarest first: those of several of the sets of one text in ``SAMPLE``.

    They only order the shingles; any order is exact.
    """

    def each(sets: Sets) -> pa.RecordBatch:
        shingle, n = np.unique(np.concatenate([*[s for _, s in sets], np.zeros(0, np.uint64)]), return_counts=True)
        return pa.record_batch([pa.array(shingle.view(np.int64)), pa.array(n)], ["shingle", "n"])

    some = texts.where(F.pmod(F.xxhash64("text", F.lit(SAMPLE)), F.lit(SAMPLE)) == 0)
    counted = _from_sets(some, each, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    counted = stored(counted.where(F.col("n") >= OFTEN), f"{folder}/counted")
    found = most(counted, "n", FREQUENT).select("shingle", F.col("n").cast("int")).toArrow()
    shingle, n = found.column("shingle").to_numpy().view(np.uint64), found.column("n").to_numpy()
    return shingle[np.lexsort((shingle, n))]


def _entries(texts: DataFrame, known: Broadcast) -> DataFrame:
    """shingle, class, n, near and often (whether the shingle is frequent) of each set's first shingles.

    ``known``: the frequent shingles sorted, and the rank of each.
    """

    def each(sets: Sets) -> pa.RecordBatch:
        shingles, rank = known.value
        out, classes, sizes, near, often = [], [], [], [], []
        for c, s in sets:
            if len(shingles):
                at = np.minimum(np.searchsorted(shingles, s), len(shingles) - 1)
                last = shingles[at] == s
                # Rare ones by their hash (the set is sorted), then frequent ones by their count.
                s = np.concatenate((s[~last], s[last][np.argsort(rank[at[last]])]))
                rare = int((~last).sum())
            else:
                rare = len(s)
            p = first_ones(len(s))
            out.append(s[:p])
            near.append(np.arange(p) < near_ones(len(s)))
            often.append(np.arange(p) >= rare)
            classes.append(np.full(p, c, dtype=np.int64))
            sizes.append(np.full(p, len(s), dtype=np.int64))
        join = lambda x, kind: np.concatenate([*x, np.zeros(0, kind)])
        return pa.record_batch(
            [
                pa.array(join(out, np.uint64).view(np.int64)),
                pa.array(join(classes, np.int64)),
                pa.array(join(sizes, np.int64)),
                pa.array(join(near, bool)),
                pa.array(join(often, bool)),
            ],
            ["shingle", "class", "n", "near", "often"],
        )

    return _from_sets(texts, each, "shingle long, class long, n long, near boolean, often boolean")


def _regions(entries: DataFrame, folder: str) -> DataFrame:
    """The entries whose shingle has another one, and a near one."""
    salt = F.when(F.col("often"), F.pmod(F.xxhash64("class"), F.lit(SALTS))).otherwise(0)
    dealt = entries.withColumn("salt", salt)
    together = Window.partitionBy("shingle", "salt")
    counted = dealt.withColumn("count", F.count(F.lit(1)).over(together)).withColumn("any", F.max("near").over(together))
    found = counted.where(F.col("often") | ((F.col("count") > 1) & F.col("any"))).drop("salt", "count", "any")
    found = stored(found.distinct(), f"{folder}/entries")
    # The parts of a frequent shingle's region do not know of each other: its near members are looked for here.
    with_near = found.where(F.col("often") & F.col("near")).select("shingle").distinct()
    with_near = small(stored(with_near, f"{folder}/near"))
    often = found.where("often").join(with_near, "shingle", "left_semi")
    return found.where(~F.col("often")).unionByName(often).drop("often")


class _Judge:
    """Compares pairs (a, b) of classes and returns the linked ones."""

    def __init__(self, texts: DataFrame, classes: DataFrame, folder: str):
        self.texts, self.classes, self.folder, self.calls = texts, classes, folder, 0
        self.compared: list[DataFrame] = []

    def close_pairs(self, pairs: DataFrame) -> DataFrame:
        """The pairs that sizes and sketches allow."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = zip(*[batch.column(c).to_pylist() for c in ("n_a", "sketch_a", "n_b", "sketch_b")], strict=True)
                kept = pa.array([close(*row) for row in rows], pa.bool_())
                yield batch.select(["a", "b"]).filter(kept)

        a, b = (
            self.classes.select(F.col("class").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
            for x in "ab"
        )
        sized = pairs.join(a.select("a", "n_a"), "a").join(b.select("b", "n_b"), "b")
        fits = 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")
        both = sized.where(fits).select("a", "b").join(a, "a").join(b, "b")
        return both.mapInArrow(run, "a long, b long")

    def new(self, pairs: DataFrame) -> DataFrame:
        """The pairs that have not been compared."""
        for done in self.compared:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        return pairs

    def links(self, close_pairs: DataFrame) -> DataFrame | None:
        """The linked pairs; None if there is no pair to compare."""
        self.calls += 1
        at = f"{self.folder}/links-{self.calls}"
        pairs = stored(close_pairs, f"{at}-close")
        n = pairs.count()
        if not n:
            return None
        self.compared.append(pairs)
        involved = pairs.select(F.col("a").alias("class")).unionAll(pairs.select(F.col("b").alias("class"))).distinct()
        # At most two classes for each pair, and as many documents.
        held = F.broadcast if 2 * n <= BROADCAST_ROWS else lambda frame: frame
        involved = held(involved)
        documents = held(self.classes.join(involved, "class").select("doc_id"))

        def each(sets: Sets) -> pa.RecordBatch:
            return pa.record_batch(
                [pa.array([c for c, _ in sets], pa.int64()), pa.array([s.tobytes() for _, s in sets], pa.binary())],
                ["class", "shingles"],
            )

        chosen = self.texts.join(documents, "doc_id", "left_semi")
        found = _from_sets(chosen, each, "class long, shingles binary").join(involved, "class", "left_semi")
        sets = stored(found.dropDuplicates(["class"]), f"{at}-sets")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            as_set = lambda x: np.frombuffer(x, dtype=np.uint64)
            for batch in batches:
                rows = zip(batch.column("s_a").to_pylist(), batch.column("s_b").to_pylist(), strict=True)
                kept = pa.array([linked(as_set(x), as_set(y)) for x, y in rows], pa.bool_())
                yield batch.select(["a", "b"]).filter(kept)

        a, b = (sets.select(F.col("class").alias(x), F.col("shingles").alias(f"s_{x}")) for x in "ab")
        return stored(pairs.join(a, "a").join(b, "b").mapInArrow(run, "a long, b long"), f"{at}-linked")


def _placed(regions: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows with the component of their class; without a link it is its own."""
    if labels is None:
        return regions.withColumn("component", F.col("class"))
    at = labels.select(F.col("node").alias("class"), "component")
    return regions.join(at, "class", "left").withColumn("component", F.coalesce("component", "class"))


def _open_regions(placed: DataFrame, turn: int) -> DataFrame:
    """shingle, members and pivot (class, component) of the regions that hold several components."""
    order = F.xxhash64("class", F.lit(turn))
    grouped = placed.groupBy("shingle").agg(
        F.count(F.lit(1)).alias("members"),
        F.max_by(F.struct("class", "component"), F.struct("near", order)).alias("pivot"),
        F.min("component").alias("x"),
        F.max("component").alias("y"),
    )
    return grouped.where("x <> y").drop("x", "y")


def _with_pivot(members: DataFrame) -> DataFrame:
    pairs = members.where(F.col("component") != F.col("pivot.component"))
    pivot = F.col("pivot.class")
    return pairs.select(F.least("class", pivot).alias("a"), F.greatest("class", pivot).alias("b")).distinct()


def _smaller_is_near(near_a, n_a, near_b, n_b):
    """Whether the smaller of two sets (either, if they are equal) is near; for columns and for arrays."""
    return (near_a & (n_a <= n_b)) | (near_b & (n_b <= n_a))


def _leaf_pairs(members: DataFrame) -> DataFrame:
    """Pairs of different components in small regions."""
    inner = members.where(F.col("members") <= LEAF)
    a, b = (
        inner.select("shingle", *[F.col(c).alias(f"{c}_{x}") for c in ("class", "component", "near", "n")]) for x in "ab"
    )
    fits = _smaller_is_near(F.col("near_a"), F.col("n_a"), F.col("near_b"), F.col("n_b"))
    fits &= 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")
    pairs = a.join(b, "shingle").where((F.col("class_a") < F.col("class_b")) & (F.col("component_a") != F.col("component_b")))
    return pairs.where(fits).select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct()


def _dealt(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of large regions by pair of blocks (shingle, right, left), at most about ``BLOCK`` of each side.

    The right side is every member, near and other ones in blocks of their own for each class of sizes.  The left side
    is every member outside the region's largest component, in blocks too.
    """
    large = members.where(F.col("members") > LEAF).select("shingle", "class", "component", "n", "near")
    counts = large.groupBy("shingle", "component").count()
    main = counts.groupBy("shingle").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
    # Linked sets are in the same class of sizes or in neighbouring ones.
    sized = F.floor(F.log(F.col("n").cast("double")) / -float(np.log(PERCENT / 100)) + 1e-9).cast("int")
    rows = large.join(main, "shingle").withColumn("sized", sized)
    # One row for each region, class of sizes and kind of member.
    own = rows.groupBy("shingle", "sized", "near").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    minor = rows.where(F.col("component") != F.col("main"))
    few = minor.groupBy("shingle", "sized", "near").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("lefts"))
    there = few.select("shingle", "lefts", F.col("sized").alias("left_size"), F.col("near").alias("left_near"))
    grid = own.join(there, "shingle").where(
        (F.abs(F.col("sized") - F.col("left_size")) <= 1) & (F.col("near") | F.col("left_near"))
    )
    place = lambda n: F.pmod(F.xxhash64("class"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ["shingle", "sized", "near", "left_size", "left_near"]
    right = rows.join(grid, ["shingle", "sized", "near"]).withColumn("right", place(F.col("blocks"))).withColumn("left", every("lefts"))
    from_left = minor.withColumnsRenamed({"sized": "left_size", "near": "left_near"}).join(grid, ["shingle", "left_size", "left_near"])
    left = from_left.withColumn("left", place(F.col("lefts"))).withColumn("right", every("blocks"))
    block = F.concat_ws("/", *[F.col(c).cast("string") for c in [*key[1:], "right", "left"]]).alias("block")
    both = right.select("shingle", block, "class", "component", "n", "near", F.lit(False).alias("minor")).unionByName(
        left.select("shingle", block, "class", "component", "n", F.col("left_near").alias("near"), F.lit(True).alias("minor"))
    )
    return both.join(classes.select("class", "sketch"), "class")


def _block_pairs(members: DataFrame, classes: DataFrame, most_pairs: int) -> DataFrame:
    """Close pairs (a, b) of different components in large regions, one pair of blocks at a time.

    Of each two components the ``most_pairs`` closest; ``rest`` says that there are more.
    """
    rows = _dealt(members, classes)

    def run(table: pa.Table) -> pa.Table:
        c, comp, n = (table.column(k).to_numpy() for k in ("class", "component", "n"))
        nearby = table.column("near").to_numpy(zero_copy_only=False).astype(bool)
        bits = table.column("sketch").to_pylist()
        width = np.fromiter(map(len, bits), dtype=np.int64, count=len(bits))
        minor = table.column("minor").to_numpy(zero_copy_only=False).astype(bool)
        left, right = np.flatnonzero(minor), np.flatnonzero(~minor)
        right = right[np.argsort(n[right], kind="stable")]
        groups = {int(w): right[width[right] == w] for w in np.unique(width[right])}
        folds: dict[tuple[int, int], np.ndarray] = {}

        def matrix(w: int, size: int) -> np.ndarray:
            if (w, size) not in folds:
                folds[w, size] = np.stack([folded(bits[y], size) for y in groups[w]]).view(np.uint64)
            return folds[w, size]

        found: list[np.ndarray] = [np.zeros((3, 0), dtype=np.int64)]
        for x in left:
            low, high = -(-PERCENT * n[x] // 100), 100 * n[x] // PERCENT
            for w, group in groups.items():
                a, b = np.searchsorted(n[group], low, "left"), np.searchsorted(n[group], high, "right")
                if a < b:
                    size = min(w, int(width[x]))
                    apart = matrix(w, size)[a:b] ^ folded(bits[x], size).view(np.uint64)
                    distance = np.bitwise_count(apart).sum(axis=1, dtype=np.int64)
                    total = n[x] + n[group[a:b]]
                    near = distance <= total - 2 * -(-PERCENT * total // (100 + PERCENT))
                    near &= comp[group[a:b]] != comp[x]
                    near &= _smaller_is_near(nearby[x], n[x], nearby[group[a:b]], n[group[a:b]])
                    if near.any():
                        y = group[a:b][near]
                        found.append(np.stack((np.full(len(y), x), y, distance[near])))
        x, y, distance = np.concatenate(found, axis=1)
        one, two = np.minimum(comp[x], comp[y]), np.maximum(comp[x], comp[y])
        order = np.lexsort((distance, two, one))
        x, y, one, two = x[order], y[order], one[order], two[order]
        opens = np.flatnonzero(np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))) if len(x) else x
        size = np.diff(np.append(opens, len(x)))
        rank = np.arange(len(x)) - np.repeat(opens, size)
        kept = rank < most_pairs
        a, b = np.minimum(c[x], c[y])[kept], np.maximum(c[x], c[y])[kept]
        rest = np.repeat(size > most_pairs, size)[kept]
        shingle = np.full(len(a), table.column("shingle")[0].as_py() if table.num_rows else 0)
        return pa.table([pa.array(v) for v in (shingle, a, b, rest)], names=["shingle", "a", "b", "rest"])

    return rows.groupBy("shingle", "block").applyInArrow(run, "shingle long, a long, b long, rest boolean")


def link_components(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest id reachable by links, its own included) of each document."""
    spark = documents.sparkSession
    folder = work_folder(spark, "jaccard")
    texts = named(documents, doc_id=id_column, text=text_column)
    rows = stored(profiles(texts), f"{folder}/profiles")
    present = rows.where(F.col("class").isNotNull() & F.col("doc_id").isNotNull())
    classes = present.groupBy("class").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")
    )
    classes = stored(classes, f"{folder}/classes")
    frequent = _frequent(texts, folder)
    order = np.argsort(frequent)
    # At most about ``FREQUENT`` pairs of numbers.
    known = spark.sparkContext.broadcast((frequent[order], order.astype(np.int32)))
    del frequent, order
    regions = _regions(_entries(texts, known), folder)
    # What is read from here on is stored; the driver keeps no copy either.
    known.destroy()
    judge = _Judge(texts, classes, folder)
    labels, left, turn = None, float("inf"), 0

    def opened(entries: DataFrame) -> DataFrame:
        placed = _placed(entries, labels)
        pivots = stored(_open_regions(placed, turn), f"{folder}/pivots-{turn}")
        return stored(placed.join(pivots, "shingle"), f"{folder}/open-{turn}")

    while True:
        turn += 1
        members = opened(regions)
        large = members
        if turn > 1:
            large = members.where(F.col("members") > LEAF)
            before, left = left, large.count()
            if left == 0 or left > CLOSING * before:
                break
        linked_pairs = judge.links(judge.close_pairs(_with_pivot(large)))
        if linked_pairs is not None:
            labels = with_links(labels, linked_pairs)
    most_pairs = 2
    while most_pairs:
        blocks = stored(_block_pairs(members, classes, most_pairs), f"{folder}/blocks-{turn}")
        pairs = blocks.select("a", "b").distinct()
        if most_pairs == 2:
            pairs = pairs.unionAll(judge.close_pairs(judge.new(_leaf_pairs(members)))).distinct()
        linked_pairs = judge.links(judge.new(pairs))
        if linked_pairs is not None:
            labels = with_links(labels, linked_pairs)
        more = blocks.where("rest").select("shingle").distinct()
        most_pairs = 0 if more.isEmpty() else 64 * most_pairs
        if most_pairs:
            turn += 1
            members = opened(regions.join(more, "shingle", "left_semi"))
    joined = _placed(classes.select("class", "doc_id"), labels)
    smallest = joined.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named_classes = stored(joined.join(smallest, "component").select("class", "component_id"), f"{folder}/named")
    result = rows.select("doc_id", "n", "class").join(named_classes, "class", "left")
    return result.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(documents: DataFrame) -> DataFrame:
    """The documents without those that belong to the group of a smaller id; all columns stay.

    Rows without an id stay; rows that repeat an id stay or go together.
    """
    spark = documents.sparkSession
    found = link_components(documents).where("doc_id <> component_id").select(F.col("doc_id").alias("gone"))
    gone = stored(found.distinct(), work_folder(spark, "jaccard-gone"))
    return documents.join(small(gone), documents["doc_id"] == gone["gone"], "left_anti")
