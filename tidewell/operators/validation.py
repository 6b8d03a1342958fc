"""Validation rules of the requests.

Each function returns a Column: null (or an empty map) means valid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import dates, texts
from tidewell.operators.rules import all_failures, failure, first_failure
from tidewell.operators.upserts import one_per_key

# Limits of the file windows.
MAX_DAYS = 10
PUBLIC_MAX_DAYS = 30
PUBLIC_MAX_MONTHS = 2

# Filters that a request search must use at least one of.
SEARCH_FILTERS = ["dataset", "requestedDate", "status", "channel"]
NO_FILTERS = "Filters are empty"
OTHER_FILTERS = "Unsupported filters"

# Messages of the window rules.
WINDOW_IN_FUTURE = "'to' should be LESSER OR EQUAL TO today's date.."
AVAILABLE_NOT_A_DATE = "availableFrom is not a date"
WINDOW_NOT_A_DATE = "Please give 'from' & 'to' as dates in the format yyyy-MM-dd"
WINDOW_NEGATIVE = "Date range should not be -ve. Please check your 'from' & 'to'"
WINDOW_TOO_LONG = "Date range should be < {} days"
WINDOW_TOO_OLD = "Date range cannot be older than {} months"

# Messages of the experiment rules by field.
NO_REQUEST = "Request should not be empty"
EXPERIMENT_ID = ("request.expid", "Experiment Id should not be  empty")
EXPERIMENT_NAME = ("request.name", "Experiment Name should not be  empty")
EXPERIMENT_CREATOR = ("request.createdBy", "Created By should not be empty")
EXPERIMENT_CRITERIA = ("request.createdBy", "Criteria should not be empty")
CRITERIA_FILTERS = ("request.filters", "Criteria Filters should not be empty")
CRITERIA_TYPE = ("request.type", "Criteria Type should not be empty")
EXPERIMENT_DATA = ("request.data", "Experiment Data should not be empty")
END_MISSING = ("data.endDate", "Experiment End_Date should not be empty")
END_PAST = ("data.endDate", "End_Date should be greater than today's date.")
START_MISSING = ("data.startDate", "Experiment Start_Date should not be empty")
START_PAST = ("data.startDate", "Start_Date should be greater than or equal to today's date..")
START_AFTER_END = ("data.startDate", "Date range should not be -ve. Please check your start_date & end_date")

# Messages of the report rules by field; the parts of the config in the order they are tested.
REPORT_ID = ("request.reportId", "Report Id should not be  empty")
REPORT_DESCRIPTION = ("request.description", "Report Description should not empty")
REPORT_CREATOR = ("request.createdBy", "Created By should not be empty")
REPORT_CONFIG = ("request.config", "Config should not be empty")
CONFIG_PARTS = {
    "reportConfig": "Report Config  should not be empty",
    "store": "Config Store should not be empty",
    "container": "Config Container should not be empty",
    "key": "Config Key should not be empty",
}

# Messages of the client-log rules.
LOG_PART_MISSING = "property: {} is missing!"
LOG_VALUE_BLANK = "property: {} is null or empty!"
LOG_LINE_BAD = "property: logs, mandatory fields are missing or type mismatch!"


def missing_field(**fields: Column) -> Column:
    """``<name> is empty`` for the first field that is absent; an empty text is not absent."""
    return first_failure([(value.isNull(), f"{name} is empty") for name, value in fields.items()])


def submit_failure(tag: Column, dataset: Column, dataset_config: Column) -> Column:
    return missing_field(tag=tag, dataset=dataset, datasetConfig=dataset_config)


def dataset_failure(
    dataset: Column,
    dataset_type: Column,
    version: Column,
    visibility: Column,
    authorized_roles: Column,
    available_from: Column | None = None,
) -> Column:
    """The first absent field, or a start that is given but no ``yyyy-MM-dd`` date."""
    absent = missing_field(
        dataset=dataset,
        datasetType=dataset_type,
        version=version,
        visibility=visibility,
        authorizedRoles=authorized_roles,
    )
    if available_from is None:
        return absent
    bad = available_from.isNotNull() & F.try_to_timestamp(available_from, F.lit("yyyy-MM-dd")).isNull()
    return F.coalesce(absent, F.when(bad, AVAILABLE_NOT_A_DATE))


def _days(start: Column, end: Column) -> Column:
    """Days between two ``yyyy-MM-dd`` texts, null when one of them is not a date."""
    pattern = F.lit("yyyy-MM-dd")
    return F.datediff(F.try_to_timestamp(end, pattern), F.try_to_timestamp(start, pattern))


def window_failure(
    start: Column,
    end: Column,
    as_of: Column,
    public: Column,
    max_days: int = MAX_DAYS,
    public_max_days: int = PUBLIC_MAX_DAYS,
    public_max_months: int = PUBLIC_MAX_MONTHS,
) -> Column:
    """Rules of a file window given as ``yyyy-MM-dd`` texts; a span equal to the limit passes, another text fails."""
    span = _days(start, end)
    pattern = F.lit("yyyy-MM-dd")
    unreadable = F.lit(False)
    for text in (start, end):
        unreadable = unreadable | (text.isNotNull() & F.try_to_timestamp(text, pattern).isNull())
    today, oldest = (
        dates.period_of(dates.day_text(day)) for day in (as_of, F.add_months(as_of, -public_max_months))
    )
    limit = F.when(public, public_max_days).otherwise(max_days)
    too_long = F.when(public, WINDOW_TOO_LONG.format(public_max_days)).otherwise(WINDOW_TOO_LONG.format(max_days))
    return first_failure(
        [
            (unreadable, WINDOW_NOT_A_DATE),
            (dates.period_of(end) > today, WINDOW_IN_FUTURE),
            (span < 0, WINDOW_NEGATIVE),
            (span > limit, too_long),
            (public & (dates.period_of(start) < oldest), WINDOW_TOO_OLD.format(public_max_months)),
        ]
    )


def experiment_failures(
    exp_id: Column,
    name: Column,
    created_by: Column,
    criteria: Column,
    data: Column,
    as_of: Column,
    missing: Column | None = None,
) -> Column:
    """Every failed rule of an experiment request as a map.

    Missing criteria is reported under the field of the creator and overwrites
    that message.  The start date is looked at only when the end date is good.
    """
    present = F.lit(True) if missing is None else ~missing
    today = dates.period_of(dates.day_text(as_of))
    end, start = (F.coalesce(F.get_json_object(data, path), F.lit("")) for path in ("$.endDate", "$.startDate"))
    has_criteria, has_data = present & criteria.isNotNull(), present & data.isNotNull()
    has_filters = texts.has_key(criteria, "filters")
    end_past, start_past = (dates.period_of(day) < today for day in (end, start))
    end_good = has_data & (end != "") & ~end_past
    start_good = end_good & (start != "") & ~start_past
    return all_failures(
        [
            ("request", ~present, NO_REQUEST),
            failure(EXPERIMENT_ID, present & exp_id.isNull()),
            failure(EXPERIMENT_NAME, present & name.isNull()),
            failure(EXPERIMENT_CREATOR, present & created_by.isNull()),
            failure(EXPERIMENT_CRITERIA, present & criteria.isNull()),
            failure(CRITERIA_FILTERS, has_criteria & ~has_filters),
            failure(CRITERIA_TYPE, has_criteria & has_filters & ~texts.has_key(criteria, "type")),
            failure(EXPERIMENT_DATA, present & data.isNull()),
            failure(END_MISSING, has_data & (end == "")),
            failure(END_PAST, has_data & (end != "") & end_past),
            failure(START_MISSING, end_good & (start == "")),
            failure(START_PAST, end_good & (start != "") & start_past),
            failure(START_AFTER_END, start_good & (_days(start, end) < 0)),
        ]
    )


def _missing_parts(config: Column) -> Column:
    """The names of the report parts that a config lacks, in their order."""
    keys = F.coalesce(F.json_object_keys(config), F.array().cast("array<string>"))
    return F.array_except(F.array(*[F.lit(key) for key in CONFIG_PARTS]), keys)


def report_complete(report_id: Column, description: Column, created_by: Column, config: Column) -> Column:
    """Whether ``report_failures`` finds nothing, for filters: the config is parsed once and no message is formed."""
    given = report_id.isNotNull() & description.isNotNull() & created_by.isNotNull() & config.isNotNull()
    return given & (F.size(_missing_parts(config)) == 0)


def report_failures(
    report_id: Column, description: Column, created_by: Column, config: Column, missing: Column | None = None
) -> Column:
    """Every failed rule of a report request as a map; of the config parts only the first that is missing."""
    present = F.lit(True) if missing is None else ~missing
    fields = [
        ("request", ~present, NO_REQUEST),
        failure(REPORT_ID, present & report_id.isNull()),
        failure(REPORT_DESCRIPTION, present & description.isNull()),
        failure(REPORT_CREATOR, present & created_by.isNull()),
        failure(REPORT_CONFIG, present & config.isNull()),
    ]
    messages = F.create_map(*[F.lit(x) for pair in CONFIG_PARTS.items() for x in pair])
    # One entry or none: the config is parsed once, whatever the number of parts.
    first = F.slice(F.when(present & config.isNotNull(), _missing_parts(config)).otherwise(F.array().cast("array<string>")), 1, 1)
    entries = F.transform(
        first, lambda key: F.struct(F.concat(F.lit(f"{REPORT_CONFIG[0]}."), key).alias("key"), messages[key].alias("value"))
    )
    return F.map_concat(all_failures(fields), F.map_from_entries(entries))


def client_log_failure(request: Column) -> Column:
    """First failed rule of a typed client-log request."""
    context, pdata, logs = request["context"], request["pdata"], request["logs"]
    parts = {"request": request, "context": context, "pdata": pdata, "logs": logs}
    values = {"context.did": context["did"], **{f"pdata.{name}": pdata[name] for name in ("id", "pid", "ver")}}
    bad_line = F.exists(logs, lambda line: texts.is_blank(line["log"]) | (F.coalesce(line["ts"], F.lit(0)) == 0))
    return first_failure(
        [
            *[(part.isNull(), LOG_PART_MISSING.format(name)) for name, part in parts.items()],
            *[(texts.is_blank(value), LOG_VALUE_BLANK.format(name)) for name, value in values.items()],
            (bad_line, LOG_LINE_BAD),
        ]
    )


# Type names of JSON schemas for the leading word of a variant's type.
_JSON_TYPES = {
    "STRING": "string",
    "BOOLEAN": "boolean",
    "BIGINT": "integer",
    "DECIMAL": "number",
    "DOUBLE": "number",
    "ARRAY": "array",
    "OBJECT": "object",
    "VOID": "null",
}

_NODE = "struct<required: array<string>, properties: map<string, string>>"
#: Schemas nested deeper than this are refused.
MAX_DEPTH = 64


def _no_texts() -> Column:
    return F.array().cast("array<string>")


def _segment(name: Column) -> Column:
    """The part of a variant path that names a property."""
    quote = F.when(F.contains(name, F.lit('"')), F.lit("'")).otherwise(F.lit('"'))
    return F.concat(F.lit("["), quote, name, quote, F.lit("]"))


def _types(node: Column) -> Column:
    """The allowed type names of a property: one name or a list of names; null when it declares none."""
    declared = F.get_json_object(node, "$.type")
    return F.when(declared.startswith("["), F.from_json(declared, "array<string>")).when(declared.isNotNull(), F.array(declared))


def compile_rules(rules: DataFrame) -> DataFrame:
    """``dataset_sub_id, rules``: the object rules of each dataset's JSON schema, outer objects first.

    A rule is the path of an object, its required properties, and the allowed
    types of its properties.  A schema is taken apart level by level, so rules
    may nest to any depth, and it is done once per dataset, not per request.  Of
    repeated rules of a ``dataset_sub_id`` the last counts.
    """
    loaded = [c for c in ("loaded",) if c in rules.columns]
    unique = one_per_key(rules.select("dataset_sub_id", "validation_json", *loaded), ["dataset_sub_id"])
    level = unique.where("validation_json is not null").select(
        "dataset_sub_id", F.array().cast("array<int>").alias("place"), F.lit("$").alias("path"), F.col("validation_json").alias("node")
    )
    done = None
    for depth in range(MAX_DEPTH + 1):
        parsed = level.withColumn("n", F.from_json("node", _NODE))
        entries = F.coalesce(F.map_entries("n.properties"), F.array().cast("array<struct<key: string, value: string>>"))
        properties = F.filter(
            F.transform(entries, lambda e: F.struct(e["key"].alias("name"), _types(e["value"]).alias("types"))),
            lambda p: p["types"].isNotNull(),
        )
        found = parsed.select(
            "dataset_sub_id",
            F.struct(
                F.lit(depth).alias("depth"),
                "place",
                "path",
                F.coalesce("n.required", _no_texts()).alias("required"),
                properties.alias("properties"),
            ).alias("rule"),
        )
        done = found if done is None else done.unionByName(found)
        inner = F.col("e.value")
        nested = F.get_json_object(inner, "$.properties").isNotNull() | F.get_json_object(inner, "$.required").isNotNull()
        level = (
            parsed.select("dataset_sub_id", "place", "path", F.posexplode(entries).alias("at", "e"))
            .where(nested)
            .select(
                "dataset_sub_id",
                F.array_append("place", F.col("at")).alias("place"),
                F.concat("path", _segment(F.col("e.key"))).alias("path"),
                inner.alias("node"),
            )
        )
        if level.isEmpty():
            break
    else:
        raise ValueError(f"a schema nests deeper than {MAX_DEPTH} levels")
    return done.groupBy("dataset_sub_id").agg(F.array_sort(F.collect_list("rule")).alias("rules"))


def _json_type(value: Column) -> Column:
    """The JSON type of a variant, null when there is none."""
    names = F.create_map(*[F.lit(x) for pair in _JSON_TYPES.items() for x in pair])
    return names[F.regexp_extract(F.schema_of_variant(value), "^([A-Z]+)", 1)]


def _object_failure(found: Column, rule: Column) -> Column:
    """Message of the first missing property, else of the first wrong type of one object, null when there is none."""
    missing = F.filter(rule["required"], lambda name: found[name].isNull())
    no_property = F.transform(
        F.array(missing),
        lambda m: F.when(
            F.size(m) > 0,
            F.concat(F.lit('Request object has missing required properties (["'), F.array_join(m, '","'), F.lit('"])')),
        ),
    )[0]
    typed = F.transform(
        rule["properties"], lambda p: F.struct(_json_type(found[p["name"]]).alias("found"), p["types"].alias("types"))
    )
    wrong = F.filter(
        typed,
        lambda t: t["found"].isNotNull()
        & ~F.array_contains(t["types"], t["found"])
        & ~(F.array_contains(t["types"], "number") & (t["found"] == "integer")),
    )
    no_type = F.transform(
        F.slice(wrong, 1, 1),
        lambda t: F.concat(
            F.lit("Request instance type ("),
            t["found"],
            F.lit(') does not match any allowed primitive type (allowed: ["'),
            F.array_join(t["types"], '","'),
            F.lit('"])'),
        ),
    )
    return F.coalesce(no_property, F.get(no_type, F.lit(0)))


def schema_failure(body: Column, rules: Column) -> Column:
    """First violation of compiled rules by a body (a variant), null when there is none.

    Objects are checked from the outside in.  A body that is no object lacks
    all that is required; a property that is no object has no rules inside.
    """

    def of(rule: Column) -> Column:
        none = F.create_map().cast("map<string,variant>")
        found = F.try_variant_get(body, rule["path"], "map<string,variant>")
        found = F.when(rule["path"] == "$", F.coalesce(found, none)).otherwise(found)
        # Bound once: a lambda repeats what it names twice.
        return F.transform(F.array(found), lambda m: F.when(m.isNotNull(), _object_failure(m, rule)))[0]

    messages = F.filter(F.transform(rules, of), lambda message: message.isNotNull())
    return F.get(messages, F.lit(0))


def check_submissions(requests: DataFrame, rules: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``failure``: by the dataset's JSON schema when it has one, else by the fixed rules.

    ``rules`` are rows with ``validation_json``, or the output of
    ``compile_rules``.  A body is parsed once; one that is no JSON has no parts.
    """
    compiled = rules if "rules" in rules.columns else compile_rules(rules)
    compiled = compiled.select("dataset_sub_id", F.col("rules").alias("_rules"))
    joined = requests.join(compiled, "dataset_sub_id", "left").withColumn("_parsed", F.try_parse_json(body))
    named = [F.try_variant_get(F.col("_parsed"), f"$.{name}", "string") for name in ("tag", "dataset", "datasetConfig")]
    by_schema = schema_failure(F.col("_parsed"), F.col("_rules"))
    failure_ = F.when(F.col("_rules").isNull(), submit_failure(*named)).otherwise(by_schema)
    return joined.withColumn("failure", failure_).drop("_rules", "_parsed")


def search_filters_failure(filters: Column, supported: list[str] | None = None) -> Column:
    """What ``check_search_filters`` finds wrong with the filters of a search given as a JSON object, null when nothing."""
    keys = F.coalesce(F.json_object_keys(filters), _no_texts())
    known = F.array(*[F.lit(name) for name in supported or SEARCH_FILTERS])
    found = F.transform(
        F.array(keys), lambda k: first_failure([(F.size(k) == 0, NO_FILTERS), (~F.arrays_overlap(k, known), OTHER_FILTERS)])
    )
    return found[0]


def check_search_filters(filters: dict | None, supported: list[str] | None = None) -> None:
    """Argument check of a request search."""
    if not filters:
        raise ValueError(NO_FILTERS)
    if not set(supported or SEARCH_FILTERS) & set(filters):
        raise ValueError(OTHER_FILTERS)
