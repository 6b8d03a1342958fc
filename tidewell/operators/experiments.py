"""Experiment assignment and the experiment registry.

Scoring.  A lookup gives up to three fields; a document is a candidate when
any of them is equal.  Its score is the sum of the inverse document
frequencies of the equal fields, plus a product: ``query_weight`` when all
given fields are equal, times the weight of every field the document lacks.

Planning.  Joining lookups with documents field by field forms every pair that
shares a value, which explodes when a value is common.  Instead each document
is entered under every non-empty subset of its own fields (at most 7 keys) and
only the best document per key is kept: with the equal fields fixed, the rest
of the score depends on the document alone.  A lookup then reads at most 7
unique keys.  An entry may belong to a document that is equal in more fields
than its key says; that document then also sits under the larger key with a
higher score, so taking the maximum over the keys is exact as long as
``query_weight`` is at least 1.

With a smaller weight a document that is equal in all given fields scores less
under its whole key than a smaller key says.  The guarded index therefore has an
entry per key and set of given fields, with two documents: the best one, and
the best one whose other given fields differ from those of the first.  A lookup
takes the first unless it is equal in all given fields, and then the second, so
no entry ever speaks for a document that is equal throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import hashing
from tidewell.functions.texts import is_blank, same_text
from tidewell.operators.upserts import first_by_key
from tidewell.session import work_folder

FIELDS = ("userId", "deviceId", "url")
SUBSETS = range(1, 2 ** len(FIELDS))

# Score weights and the lifetime of a remembered miss in seconds.
FIELD_WEIGHTS = {"userId": 3.0, "deviceId": 3.0, "url": 3.0}
QUERY_WEIGHT = 9.0
MISS_SECONDS = 86400

DOCUMENT = ["name", "startDate", "endDate", "key", "expType"]
SCORE_DIGITS = 6

# Documents whose guarded entries one task forms: a document has up to 19.
DEALT = 20_000

# Lookups without any field are spread over so many join keys.
SPREAD = 4096

# -- resolvers -----------------------------------------------------------------

Resolver = Callable[[], Column]


def modulus_gate() -> Column:
    """User id first, then device id, else false."""
    return (
        F.when(~is_blank(F.col("userId")), hashing.in_modulus(F.col("userId"), F.col("userIdMod")))
        .when(~is_blank(F.col("deviceId")), hashing.in_modulus(F.col("deviceId"), F.col("deviceIdMod")))
        .otherwise(F.lit(False))
    )


RESOLVERS: dict[str, Resolver] = {"modulus": modulus_gate}


def register_resolver(kind: str, gate: Resolver) -> None:
    """Adds a gate for an experiment type: a function giving a boolean Column over document columns."""
    RESOLVERS[kind] = gate


def gate(resolvers: Mapping[str, Resolver] | None = None) -> Column:
    """The gate of each document by its type; an unknown type passes."""
    chain = F
    for kind, resolver in (resolvers if resolvers is not None else RESOLVERS).items():
        chain = chain.when(F.col("expType") == kind, resolver())
    return F.lit(True) if chain is F else chain.otherwise(F.lit(True))


# -- matching ------------------------------------------------------------------


def _key(subset: int) -> Column:
    """Text key of a row for a subset of the fields, null when it lacks one of them.

    Lengths go before the values, so no two rows of values share a key.
    """
    used = [F.col(field) for bit, field in enumerate(FIELDS) if subset >> bit & 1]
    parts = [part for value in used for part in (F.length(value).cast("string"), F.lit(":"), value)]
    return F.concat(F.lit(f"{subset}/"), *parts)


def _keys() -> Column:
    """Array of (subset, key) for every non-empty subset of the fields a row has."""
    entries = [F.struct(F.lit(subset).alias("subset"), _key(subset).alias("key")) for subset in SUBSETS]
    return F.filter(F.array(*entries), lambda entry: entry["key"].isNotNull())


def _given() -> Column:
    """The subset of the fields a row has."""
    given = F.lit(0)
    for bit, field in enumerate(FIELDS):
        given = given + F.when(F.col(field).isNotNull(), 1 << bit).otherwise(0)
    return given


def _weighed(documents: DataFrame, weights: Mapping[str, float], resolvers: Mapping[str, Resolver] | None) -> DataFrame:
    """Documents with the product of the weights they lack and the rarity of each of their values."""
    lacking = F.lit(1.0)
    for field, weight in weights.items():
        lacking = lacking * F.when(F.col(field).isNull(), F.lit(float(weight))).otherwise(1.0)
    totals = documents.agg(*[F.count(field).cast("double").alias(field) for field in FIELDS]).first()
    rows = documents.withColumns({"passes": gate(resolvers), "lacking": lacking})
    for field in FIELDS:
        n = F.col("n")
        rarity = F.log(1.0 + (F.lit(totals[field]) - n + 0.5) / (n + 0.5))
        counts = documents.where(F.col(field).isNotNull()).groupBy(field).agg(F.count(F.lit(1)).alias("n"))
        rows = rows.join(counts.select(field, rarity.alias(f"idf_{field}")), field, "left")
    return rows


def _texts() -> Column:
    """Array of (subset, key, text) for every non-empty subset of the fields a row has; text sums the rarities."""
    entries = []
    for subset in SUBSETS:
        text = F.lit(0.0)
        for bit, field in enumerate(FIELDS):
            if subset >> bit & 1:
                text = text + F.col(f"idf_{field}")
        entries.append(F.struct(F.lit(subset).alias("subset"), _key(subset).alias("key"), text.alias("text")))
    return F.filter(F.array(*entries), lambda entry: entry["key"].isNotNull())


def _rest(subset: Column, given: Column) -> Column:
    """The values of the given fields that a subset lacks, null for the others."""
    left = [
        F.when((given.bitwiseAND(1 << bit) != 0) & (subset.bitwiseAND(1 << bit) == 0), F.col(field)).alias(field)
        for bit, field in enumerate(FIELDS)
    ]
    return F.struct(*left)


def index_entries(
    documents: DataFrame,
    weights: Mapping[str, float] = FIELD_WEIGHTS,
    resolvers: Mapping[str, Resolver] | None = None,
    guarded: bool = False,
) -> DataFrame:
    """``key, subset, text, best``: the score of the equal fields and the best document per key.

    ``guarded``: per key and set of given fields (``given``), with the best document's other
    given values (``rest``) and the best document among those that differ there (``second``).
    """
    ranked = F.struct(
        (-F.col("lacking")).alias("rank"), "id", "lacking", "passes", F.struct(*DOCUMENT).alias("document")
    )
    entered = _weighed(documents, weights, resolvers).withColumn("best", ranked)
    if not guarded:
        entries = entered.select("best", F.explode(_texts()).alias("entry")).select("best", "entry.*")
        return entries.groupBy("key", "subset").agg(F.max("text").alias("text"), F.min("best").alias("best"))
    # A few files of narrow rows become many wide entries: tasks follow the number of documents, not of files.
    parts = max(1, -(-documents.count() // DEALT))
    entered = entered.repartition(parts) if parts > 1 else entered
    entries = entered.select("best", *FIELDS, F.explode(_texts()).alias("entry")).select("best", *FIELDS, "entry.*")
    given = entries.withColumn("given", F.explode(F.array(*[F.lit(g) for g in SUBSETS])))
    given = given.where(F.col("given").bitwiseAND(F.col("subset")) == F.col("subset"))
    rest = given.withColumn("rest", _rest(F.col("subset"), F.col("given")))
    per_rest = rest.groupBy("key", "subset", "given", "rest").agg(F.max("text").alias("text"), F.min("best").alias("best"))
    place = F.row_number().over(Window.partitionBy("key", "given").orderBy("best"))
    first_two = per_rest.withColumn("place", place).where("place <= 2")
    first, second = F.col("place") == 1, F.col("place") == 2
    return first_two.groupBy("key", "subset", "given").agg(
        F.max("text").alias("text"),
        F.min(F.when(first, F.col("best"))).alias("best"),
        F.max(F.when(first, F.col("rest"))).alias("rest"),
        F.min(F.when(second, F.col("best"))).alias("second"),
    )


def build_index(
    documents: DataFrame,
    weights: Mapping[str, float] = FIELD_WEIGHTS,
    resolvers: Mapping[str, Resolver] | None = None,
    guarded: bool = False,
) -> DataFrame:
    """Prepares matching; run once per load of the documents.  ``guarded``: for query weights below 1.

    The entries are written to the working folder, so that they are formed once.
    """
    spark = documents.sparkSession
    folder = work_folder(spark, "experiment-index")
    entries = index_entries(documents, weights, resolvers, guarded)
    entries.write.parquet(folder)
    return spark.read.schema(entries.schema).parquet(folder)


def _found(winner: str) -> list[Column]:
    return [
        F.col(f"{winner}.id").alias("experiment_id"),
        (-F.col(f"{winner}.rank")).alias("score"),
        F.col(f"{winner}.passes").alias("passes"),
        F.col(f"{winner}.document").alias("document"),
    ]


def _whole_key() -> Column:
    """The key of all fields a row has, null when it has none."""
    by_size = sorted(SUBSETS, key=lambda subset: -subset.bit_count())
    return F.coalesce(*[_key(subset) for subset in by_size])


def match(lookups: DataFrame, entries: DataFrame, query_weight: float = QUERY_WEIGHT) -> DataFrame:
    """Adds the best experiment of every lookup: ``experiment_id, score, passes, document``, null when none.

    Ties go to the lowest experiment id.  A lookup without any field has none.
    A ``query_weight`` below 1 needs a guarded index.

    Each distinct set of given fields is matched once: it reads at most 7
    entries, each of which is scored on its own, and the best is kept by an
    aggregate that combines before the shuffle.  The lookups are joined with the
    answer; a hot set of fields is one row until then, and rows that repeat an
    id, or have none, need no care.
    """
    if query_weight <= 0:
        raise ValueError("query_weight must be positive")
    guarded = "given" in entries.columns
    if query_weight < 1 and not guarded:
        raise ValueError("a query_weight below 1 needs an index built with guarded=True")
    columns = lookups.columns
    nothing = F.concat(F.lit("-"), F.pmod(F.xxhash64(*columns), F.lit(SPREAD)).cast("string"))
    keyed = lookups.withColumn("_asked", F.coalesce(_whole_key(), nothing))
    asked = lookups.select(*FIELDS).distinct().withColumn("_asked", _whole_key()).filter("_asked is not null")
    probes = asked.select("_asked", *FIELDS, _given().alias("_given"), F.explode(_keys()).alias("entry"))
    probes = probes.select("_asked", *FIELDS, "_given", "entry.key")
    if guarded:
        found = probes.withColumnRenamed("_given", "given").join(entries, ["key", "given"]).withColumnRenamed("given", "_given")
        whole = (F.col("_given") != F.col("subset")) & F.col("rest").eqNullSafe(_rest(F.col("subset"), F.col("_given")))
        best = F.when(whole, F.col("second")).otherwise(F.col("best"))
    else:
        found, best = probes.join(entries, "key"), F.col("best")
    factor = F.when(F.col("_given") == F.col("subset"), F.lit(float(query_weight))).otherwise(1.0)
    score = F.round(F.col("text") + F.col("_best.lacking") * factor, SCORE_DIGITS)
    candidate = F.struct((-score).alias("rank"), *[F.col(f"_best.{c}") for c in ("id", "passes", "document")])
    scored = found.withColumn("_best", best).where("_best is not null").select("_asked", candidate.alias("_winner"))
    winners = scored.groupBy("_asked").agg(F.min("_winner").alias("_winner")).select("_asked", *_found("_winner"))
    return keyed.join(winners, "_asked", "left").drop("_asked")


def assign(matched: DataFrame) -> DataFrame:
    """Applies the gate: ``assigned`` and the actions that are answered, ``[]`` when there are none."""
    assigned = F.col("experiment_id").isNotNull() & F.coalesce("passes", F.lit(False))
    action = F.struct(
        F.lit("experiment").alias("type"),
        F.struct(
            F.lit("experiment").alias("title"),
            F.col("experiment_id").alias("experimentId"),
            F.col("document.name").alias("experimentName"),
            F.col("document.key").alias("key"),
            F.col("document.startDate").alias("startDate"),
            F.col("document.endDate").alias("endDate"),
        ).alias("data"),
    )
    actions = F.when(assigned, F.to_json(F.array(action))).otherwise("[]")
    return matched.withColumns({"assigned": assigned, "actions": actions})


# -- registry ------------------------------------------------------------------

# State and messages of a submitted experiment.
SUBMITTED = "SUBMITTED"
SUBMITTED_MESSAGE = "Experiment successfully submitted"
UPDATED_BY = "Experiment_CREATE_API"
EXISTS_MESSAGE = "ExperimentId already exists."
NO_EXPERIMENT = "no experiment available with the given experimentid"


def merge_experiments(registry: DataFrame, requests: DataFrame, as_of: Column) -> DataFrame:
    """The registry after valid create requests, with ``action`` per row.

    New ids are inserted, failed ones submitted again, others answered with an
    error and left alone.  ``requests``: ``seq, exp_id, exp_name,
    exp_description, created_by, criteria, exp_data``.
    """
    written = ["exp_name", "exp_description", "created_by", "criteria", "exp_data"]
    incoming = first_by_key(requests.select("exp_id", "seq", *written), ["exp_id"], ["seq"]).select(
        "exp_id", *[F.col(n).alias(f"new_{n}") for n in written], F.lit(True).alias("incoming")
    )
    joined = registry.withColumn("stored", F.lit(True)).join(incoming, "exp_id", "full_outer")
    is_new = F.col("stored").isNull()
    again = F.col("incoming").isNotNull() & same_text(F.col("status"), F.lit("FAILED"))
    taken = is_new | again
    fresh = {
        **{n: F.col(f"new_{n}") for n in written},
        "updated_by": F.lit(UPDATED_BY),
        "status": F.lit(SUBMITTED),
        "status_message": F.lit(SUBMITTED_MESSAGE),
        "created_on": as_of.cast("timestamp"),
        "updated_on": as_of.cast("timestamp"),
        "stats": F.lit(""),
    }
    values = {
        name: F.when(taken, fresh[name]).otherwise(F.col(name)) if name in fresh else F.col(name)
        for name in registry.columns
    }
    action = (
        F.when(is_new, "inserted")
        .when(again, "resubmitted")
        .when(F.col("incoming").isNotNull(), EXISTS_MESSAGE)
        .otherwise("kept")
    )
    return joined.select(*[value.alias(name) for name, value in values.items()], action.alias("action"))


def read_experiments(registry: DataFrame, asked: DataFrame) -> DataFrame:
    """Experiments by id: every row of ``asked`` with ``response_code``, ``message`` and the answer as JSON."""
    answers = experiment_answers(registry)
    known = answers.select("exp_id", F.to_json(F.struct(*answers.columns)).alias("experiment"))
    joined = asked.join(known, "exp_id", "left")
    message = F.when(F.col("experiment").isNull(), NO_EXPERIMENT)
    return joined.select(*asked.columns, F.lit("OK").alias("response_code"), message.alias("message"), "experiment")


def experiment_answers(registry: DataFrame) -> DataFrame:
    """Registry rows as answered: counts only for active and failed experiments."""
    shown = F.upper("status").isin("ACTIVE", "FAILED") & ~is_blank(F.col("stats"))
    stats = F.when(shown, F.to_json(F.from_json("stats", "map<string,bigint>"))).otherwise("{}")
    return registry.select(
        "exp_id",
        F.col("exp_name").alias("name"),
        "created_by",
        F.col("exp_description").alias("description"),
        "criteria",
        F.col("exp_data").alias("data"),
        stats.alias("stats"),
        F.unix_millis("updated_on").alias("last_updated"),
        F.unix_millis("created_on").alias("submitted"),
        "status",
        F.col("status_message").alias("status_msg"),
    )
