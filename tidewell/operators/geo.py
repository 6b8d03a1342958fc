"""IP range lookup.

A range condition alone plans as a nested-loop join, and bucketing the
addresses still compares every address of a crowded bucket with every range in
it.  Here the ranges are turned into an index once per load.  Their bounds cut
the address space into stretches with one winner each, and the stretches are
laid out in blocks of at most ``CAP`` stretches:

* ``widths`` says for each of the 65,536 stretches of 2^16 addresses how wide
  its blocks are.  It is small at every size and is always broadcast.
* ``blocks`` has one row per block, with the starts and winners of its
  stretches side by side in plain columns.

An address finds its block by one equality join and its stretch by at most
``CAP`` - 1 comparisons in generated code: no row is multiplied, none is lost,
and the rows are shuffled once, if the blocks are not broadcast.

Overlapping ranges: the narrowest wins, then the lowest start, then the lowest
geoname_id.  Bounds are closed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions.network import IPV4_MAX
from tidewell.operators.upserts import one_per_key
from tidewell.session import work_folder

LEVELS = 32
#: Rows that no block can answer are spread over so many join keys.
SPREAD = 4096

LOCATION_FIELDS = [
    "continent_name",
    "country_code",
    "country_name",
    "state_code",
    "state",
    "sub_div_2",
    "city",
    "state_custom",
    "state_code_custom",
    "district_custom",
]


#: Stretches in a block, at most.
CAP = 8
PART_BITS = 16


@dataclass(frozen=True)
class GeoIndex:
    """Width of the blocks of each part, the blocks with their stretches, and one row per known place."""

    widths: DataFrame
    blocks: DataFrame
    places: DataFrame


def _shifted(value: Column, level: Column) -> Column:
    return F.call_function("shiftright", value, level)


def _key(value: Column, level: Column) -> Column:
    """One number for a block: the level above the 33 bits of the block."""
    return level.cast("bigint") * F.lit(2**33) + _shifted(value, level)


def _cut(stretches: DataFrame) -> DataFrame:
    """``start``, ``last`` and other columns -> one row per aligned block, at most 64 per stretch.

    At each level the whole blocks inside a stretch run from ``low`` to
    ``high``; the ones that no block of the next level covers are an odd
    ``low`` and the block before an odd ``high``.
    """
    others = [c for c in stretches.columns if c not in ("start", "last")]
    size = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("level"))
    level = F.col("level")
    none = F.lit(None).cast("bigint")
    edges = F.array(
        F.when(F.col("low") % 2 == 1, F.col("low")).otherwise(none),
        F.when(F.col("high") % 2 == 1, F.col("high") - 1).otherwise(none),
    )
    return (
        stretches.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
        .withColumns({"low": _shifted(F.col("start") + size - 1, level), "high": _shifted(F.col("last") + 1, level)})
        .filter("low < high")
        .withColumn("block", F.explode(edges))
        .filter("block is not null")
        .select((level.cast("bigint") * F.lit(2**33) + F.col("block")).alias("key"), "level", *others)
    )


def _clipped(ranges: DataFrame) -> DataFrame:
    first, last = F.col("network_start_integer").cast("bigint"), F.col("network_last_integer").cast("bigint")
    return ranges.select(
        F.greatest(first, F.lit(0)).alias("start"),
        F.least(last, F.lit(IPV4_MAX)).alias("last"),
        F.struct((last - first).alias("width"), first.alias("first"), F.col("geoname_id").alias("geoname_id")).alias(
            "best"
        ),
    ).filter("start <= last")


def _segments(ranges: DataFrame) -> DataFrame:
    """The address space as disjoint stretches, each with the range that wins on it, null where there is none.

    The winner is constant between two neighbouring bounds, so it is looked up
    for the bounds only: a bound lies in a range exactly when it lies in one
    of the range's blocks.  Neighbours are found within each of 256 equal
    parts of the space, whose own starts are added as bounds.
    """
    clipped = _clipped(ranges)
    covered = _cut(clipped).groupBy("key", "level").agg(F.min("best").alias("best"))
    levels = F.sequence(F.lit(0), F.lit(LEVELS))
    parts = ranges.sparkSession.range(256).select(F.shiftleft("id", 24).alias("point"))
    bounds = (
        clipped.select(F.explode(F.array(F.col("start"), F.col("last") + 1)).alias("point"))
        .filter(F.col("point") <= IPV4_MAX)
        .unionByName(parts)
        .distinct()
    )
    won = (
        bounds.withColumn("level", F.explode(levels))
        .withColumn("key", _key(F.col("point"), F.col("level")))
        .join(covered.select("key", "best"), "key", "left")
        .groupBy("point")
        .agg(F.min("best").alias("best"))
    )
    part = F.shiftright("point", 24)
    following = F.lead("point").over(Window.partitionBy(part).orderBy("point"))
    end_of_part = F.shiftleft(part + 1, 24)
    return won.select(
        F.col("point").alias("start"),
        (F.coalesce(following, end_of_part) - 1).alias("last"),
        F.col("best.geoname_id").alias("geoname_id"),
        F.col("best").isNotNull().alias("in_range"),
    )


def _parts(segments: DataFrame) -> DataFrame:
    """Stretches cut at the ends of parts: ``part, low, high`` (places in the part) and the winner."""
    part = F.col("part")
    base = F.call_function("shiftleft", part, F.lit(PART_BITS))
    return (
        segments.withColumn("part", F.explode(F.sequence(_shifted(F.col("start"), F.lit(PART_BITS)), _shifted(F.col("last"), F.lit(PART_BITS)))))
        .select(
            "part",
            F.greatest(F.col("start") - base, F.lit(0)).cast("int").alias("low"),
            F.least(F.col("last") - base, F.lit(2**PART_BITS - 1)).cast("int").alias("high"),
            F.col("geoname_id").cast("int").alias("geoname_id"),
            "in_range",
        )
    )


def _widths(pieces: DataFrame) -> DataFrame:
    """Per part with any range the largest width (as a power of two) with at most ``CAP`` stretches in each block."""
    at = F.explode(F.sequence(F.lit(0), F.lit(PART_BITS)))
    levels = pieces.select("part", "low", "in_range", at.alias("width"))
    block = F.call_function("shiftright", F.col("low"), F.col("width"))
    inside = F.call_function("shiftleft", block, F.col("width")) < F.col("low")
    # A block holds the stretch that reaches into it, and those that start behind its first address.
    crowded = levels.groupBy("part", "width", block.alias("block")).agg(
        F.count_if(inside).alias("starts"), F.max("in_range").alias("any")
    )
    fitting = crowded.groupBy("part", "width").agg(F.max("starts").alias("starts"), F.max("any").alias("any"))
    return (
        fitting.where((F.col("starts") < CAP) & F.col("any"))
        .groupBy("part")
        .agg(F.max("width").cast("int").alias("width"))
    )


def _block_key(part: Column, place: Column, width: Column) -> Column:
    return part * F.lit(2**PART_BITS) + F.call_function("shiftright", place, width)


def _laid_out(pieces: DataFrame, widths: DataFrame) -> DataFrame:
    """One row per block: start and winner of each of its stretches, null beyond the last."""
    width = F.col("width")
    ends = [F.call_function("shiftright", F.col(c), width) for c in ("low", "high")]
    base = F.call_function("shiftleft", F.col("block"), width)
    stretch = F.struct(F.greatest(F.col("low"), base).alias("start"), "geoname_id", "in_range")
    grouped = (
        pieces.join(F.broadcast(widths), "part")
        .withColumn("block", F.explode(F.sequence(*ends)))
        .groupBy((F.col("part") * F.lit(2**PART_BITS) + F.col("block")).alias("key"))
        .agg(F.array_sort(F.collect_list(stretch)).alias("stretches"))  # at most CAP
        .where(F.exists("stretches", lambda s: s["in_range"]))
    )
    columns = [F.col("key")]
    for i in range(CAP):
        one = F.get("stretches", F.lit(i))
        columns += [one["start"].alias(f"start{i}"), one["geoname_id"].alias(f"geoname{i}"), one["in_range"].alias(f"in_range{i}")]
    return grouped.select(*columns)


def build_index(ranges: DataFrame, locations: DataFrame, folder: str | None = None) -> GeoIndex:
    """Prepares the lookup; run once per load of the reference tables.

    The index is written to ``folder``, or to a new working folder, so that it
    is built once and a lost executor can read it again.  Of repeated places
    the last counts.
    """
    spark = ranges.sparkSession
    folder = folder or work_folder(spark, "geo-index")

    def kept(frame: DataFrame, name: str) -> DataFrame:
        frame.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(frame.schema).parquet(f"{folder}/{name}")

    pieces = kept(_parts(_segments(ranges)), "pieces")
    widths = kept(_widths(pieces).coalesce(1), "widths")
    blocks = kept(_laid_out(pieces, widths), "blocks")
    places = one_per_key(locations, ["geoname_id"]).select("geoname_id", *LOCATION_FIELDS)
    return GeoIndex(widths=widths, blocks=blocks, places=kept(places, "places"))


def load_index(spark: SparkSession, folder: str) -> GeoIndex:
    """The index that ``build_index`` has written to a folder."""
    widths, blocks, places = (spark.read.parquet(f"{folder}/{name}") for name in ("widths", "blocks", "places"))
    return GeoIndex(widths=widths, blocks=blocks, places=places)


def _stretch(place: Column) -> list[Column]:
    """geoname_id and in_range of the last stretch of a block that starts at or before a place."""
    found = []
    for name in ("geoname", "in_range"):
        value = F
        for i in reversed(range(CAP)):
            value = value.when(F.col(f"start{i}") <= place, F.col(f"{name}{i}"))
        found.append(value)
    return found


def resolve_addresses(rows: DataFrame, index: GeoIndex, ip: str = "ip_int", spread: list[str] | None = None) -> DataFrame:
    """Adds ``geoname_id`` and ``in_range`` of the range of each address, and ``has_address``.

    The widths are at most 65,536 rows of two numbers and are broadcast; which
    side of the join with the blocks is broadcast is left to Spark's
    statistics.  Rows without an address, or in a part without any range, are
    spread over many keys by a hash of the ``spread`` columns; a hot address is
    a skewed key that adaptive execution splits.
    """
    part = F.call_function("shiftright", F.col(ip), F.lit(PART_BITS)).cast("bigint")
    place = F.col(ip).bitwiseAND(F.lit(2**PART_BITS - 1)).cast("int")
    widths = index.widths.select(F.col("part").alias("_part"), F.col("width").alias("_width"))
    away = -1 - F.pmod(F.xxhash64(*(spread or rows.columns)), F.lit(SPREAD))
    keyed = (
        rows.withColumns({"_part": part, "_place": place})
        .join(F.broadcast(widths), "_part", "left")
        .withColumn("_key", F.coalesce(_block_key(F.col("_part"), F.col("_place"), F.col("_width")), away))
    )
    geoname, in_range = _stretch(F.col("_place"))
    found = {
        "geoname_id": geoname,
        "in_range": F.coalesce(in_range, F.lit(False)),
        "has_address": F.coalesce(F.col(ip).between(0, IPV4_MAX), F.lit(False)),
    }
    joined = keyed.join(index.blocks.withColumnRenamed("key", "_key"), "_key", "left")
    return joined.select(*rows.columns, *[value.alias(name) for name, value in found.items()])


def locate(rows: DataFrame, index: GeoIndex, ip: str = "ip_int", spread: list[str] | None = None) -> DataFrame:
    """Adds the location of an address to each row; nothing is dropped.

    Unknown addresses and ranges without a location get ``geoname_id`` 0 and
    empty fields.
    """
    places = index.places.select("geoname_id", *LOCATION_FIELDS, F.lit(True).alias("_known"))
    known = F.col("_known").isNotNull()
    return (
        resolve_addresses(rows, index, ip, spread)
        .join(places, "geoname_id", "left")
        .withColumns(
            {
                **{name: F.when(known, F.col(name)).otherwise("") for name in LOCATION_FIELDS},
                "geoname_id": F.when(known, F.col("geoname_id")).otherwise(0),
                "resolved": known & (F.coalesce(F.col("state"), F.lit("")) != ""),
            }
        )
        .drop("_known")
    )
