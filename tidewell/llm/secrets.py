"""Secret scan: a random forest removes false positives among candidate strings.

Candidates are long runs of key characters with a digit and values assigned to
a name such as password or token.  Splitting a text at its candidates gives
what stands before and after each.  A forest judges a candidate by its length,
changes between kinds of characters, coverage by dictionary words, whether it
is part of a path, and its neighbouring words.  All of it is column functions
and Spark's own forest.

The forest learns from labelled findings (value, before, after, label).  No
table of such findings is given, so ``labelled_findings`` builds them by rule:
keys of known shapes and assigned random strings against hashes, ids, numbers,
paths, dates, placeholders and words.

Null and empty texts have no candidates; long texts are scanned whole; repeated
rows are scanned each; a null id stays null; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import BROADCAST_ROWS, free, named, stored
from tidewell.session import work_folder

#: A candidate is a secret if the forest's probability reaches this.
THRESHOLD = 0.5
#: Labelled findings that are built by rule.
FINDINGS = 6_000
MASK = "[SECRET]"

_NAMES = "password|passwd|pwd|passphrase|secret|token|api_?key|apikey|access_?key|private_?key|auth_?key"
_RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]{0,60}[0-9])[A-Za-z0-9+/_-]{12,}={0,2}"
# The first two conditions follow from the third and are cheap to test.
_ASSIGNED = rf"(?<=[:=\s\"'])(?<=[:=]\s{{0,2}}[\"']?)(?<=(?i:{_NAMES})[\"']?\s{{0,2}}[:=]\s{{0,2}}[\"']?)[^\s\"':=]{{6,}}"
CANDIDATE = rf"{_RUN}|{_ASSIGNED}"
#: Every text with a candidate has one of these.
_SIGN = "[0-9:=]"

# Frequent words of prose and of configuration.
_WORDS = (
    "about access account address admin after again all also and any app application archive array author back base "
    "been before bin block body book build but can change class client code com comment config configuration content "
    "copy count create current data date day default delete demo description device digest dir document domain down "
    "edit email end entry error event example false field file first folder font for form format forms from function "
    "get group has have header help here home host house html http image import index info input int item key label "
    "lang last lib library like line link list local login long mail main make media menu message method model module "
    "more name net new next node none not note now null number object off one only open option order org other out "
    "output package page param parent part password path people place placeholder plugin point port position post "
    "price print private product profile project public python query read record release remove report request "
    "reset resource result root run sample save schema script search section select server service session set setting "
    "share show site size some source start state static status step store string style subject sum support system "
    "table tag template test text than that the their them then there these thing this time title token tool top total "
    "type update upload url use user usr value var version very view was water way web week well were what when where "
    "which will with word work world write year yes you your"
)
DICTIONARY = "(" + "|".join(sorted((w for w in _WORDS.split() if len(w) > 2), key=lambda w: (-len(w), w))) + ")"
_SECRET_NEAR = rf"({_NAMES}|bearer|credential|authorization|aws_)\W{{0,6}}$"
_HARMLESS_NEAR = (
    r"(commit|sha1|sha256|sha512|md5|hash|checksum|digest|etag|uuid|guid|\bid|isbn|order|invoice|phone|tel|card|version|"
    r"build|revision|page|date|sample|example|test|http|www|href|src|file|path|image)\W{0,6}$"
)
_PLACEHOLDER = r"(example|sample|placeholder|changeme|change-me|change_me|your[-_]|my[-_]|xxxx|1234567|dummy|redacted|\*{4}|<|\$\{)"
_VENDOR = r"^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36}|^(sk|pk|rk)_(live|test)_|^xox[abprs]-|^AIza[A-Za-z0-9_-]{35}$|^eyJ"

FEATURES = [
    "size", "changes", "digits", "uppers", "lowers", "signs", "distinct", "coverage", "hex", "decimal", "hash_size",
    "uuid", "dated", "vendor", "path", "assigned", "quoted", "secret_near", "harmless_near", "placeholder",
]


def features(found: DataFrame) -> DataFrame:
    """Adds the features of each candidate, from value, before and after."""
    v, size = F.col("value"), F.length("value")
    left = F.lower(F.right("before", F.lit(40)))
    count = lambda kind: size - F.length(F.regexp_replace(v, f"[{kind}]", ""))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    runs = F.regexp_replace(F.regexp_replace(shape, "[^aA0]", "-"), r"(.)\1+", "$1")
    columns = {
        "size": F.least(size, F.lit(200)),
        "changes": (F.length(runs) - 1) / size,
        "digits": count("0-9") / size,
        "uppers": count("A-Z") / size,
        "lowers": count("a-z") / size,
        "signs": count("^A-Za-z0-9") / size,
        "distinct": F.size(F.array_distinct(F.split(F.left(v, F.lit(64)), ""))) / F.least(size, F.lit(64)),
        "coverage": 1 - F.length(F.regexp_replace(F.lower(v), DICTIONARY, "")) / size,
        "hex": v.rlike("^([0-9a-f]+|[0-9A-F]+)$"),
        "decimal": v.rlike("^[0-9]+$"),
        "hash_size": v.rlike("^[0-9a-fA-F]+$") & size.isin(32, 40, 64, 128),
        "uuid": v.rlike("(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"),
        "dated": v.rlike(r"(19|20)\d\d[-_/]?(0[1-9]|1[0-2])[-_/]?([0-2]\d|3[01])"),
        "vendor": v.rlike(_VENDOR),
        "path": v.rlike("^/|/.*/|^[a-z_]+/[a-z_]+") | left.rlike(r"(://|www\.|\.|/)\S{0,40}$"),
        "assigned": left.rlike(r"[:=]\s*[\"']?$"),
        "quoted": left.rlike("[\"']$") & F.col("after").rlike("^[\"']"),
        "secret_near": left.rlike(_SECRET_NEAR),
        "harmless_near": left.rlike(_HARMLESS_NEAR),
        "placeholder": F.lower(v).rlike(_PLACEHOLDER),
    }
    return found.withColumns({name: F.coalesce(c.cast("double"), F.lit(0.0)) for name, c in columns.items()})


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """value, before, after and label (1: a secret), built by rule; the same in every run."""
    i = F.col("i")
    hexes = F.sha2(F.concat(F.lit("finding"), i.cast("string")), 512)
    letters = F.regexp_replace(F.base64(F.unhex(hexes)), "[+/=]", "x")
    word = lambda k: F.element_at(
        F.lit([w for w in _WORDS.split() if len(w) > 3]), (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(150)) + 1).cast("int")
    )
    pick = lambda *of: F.element_at(F.array(*map(F.lit, of)), (F.pmod(F.xxhash64(i), F.lit(len(of))) + 1).cast("int"))
    cut = lambda text, a, b: F.left(text, (F.pmod(F.xxhash64(i, F.lit(9)), F.lit(b - a + 1)) + a).cast("int"))
    prose = F.concat(word(1), F.lit(" "), word(2), F.lit(" "))
    names = pick("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "auth_key")
    assign = F.concat(names, pick("=", ": ", ' = "', "='", ": \"", "="))
    dashed = F.regexp_replace(F.left(hexes, F.lit(32)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    number = F.regexp_replace(hexes, "[a-f]", "")
    kinds: list[tuple[Column, Column, int]] = [
        (F.concat(F.lit("AKIA"), F.upper(F.left(letters, F.lit(16)))), prose, 1),
        (F.concat(F.lit("AKIA"), F.upper(F.left(letters, F.lit(16)))), F.lit("aws_access_key_id = "), 1),
        (cut(hexes, 12, 40), F.concat(prose, assign), 1),
        (F.left(hexes, F.lit(40)), F.concat(prose, assign), 1),
        (cut(letters, 10, 48), F.concat(prose, assign), 1),
        (F.concat(pick("ghp_", "gho_", "ghs_"), F.left(letters, F.lit(36))), prose, 1),
        (F.concat(pick("sk_live_", "rk_live_", "xoxb-", "xoxp-"), cut(letters, 24, 40)), prose, 1),
        (cut(letters, 30, 60), F.concat(prose, F.lit("Authorization: Bearer ")), 1),
        (dashed, F.concat(prose, pick("", "id ", "uuid: ", "request ")), 0),
        (F.left(hexes, F.lit(40)), F.concat(prose, pick("commit ", "sha1:", "revision ", "hash ", "")), 0),
        (F.left(hexes, F.lit(64)), F.concat(prose, pick("sha256:", "digest ", "checksum: ", "etag ", "")), 0),
        (cut(number, 12, 20), F.concat(prose, pick("", "card ", "order ", "phone ", "invoice: ")), 0),
        (F.concat(word(3), F.lit("-"), word(4), F.lit("-"), cut(number, 1, 6)), prose, 0),
        (F.concat(F.lit("/usr/lib/"), word(3), F.lit("/"), word(4), cut(number, 1, 3)), prose, 0),
        (F.concat(word(3), F.lit("/"), word(4), F.lit("/"), cut(number, 2, 8)), F.concat(prose, F.lit("https://www.")), 0),
        (pick("your-password-here1", "example12345678", "xxxxxxxxxxxx1", "changeme123456", "dummy_value_1234567"), assign, 0),
        (F.concat(F.lit("20"), F.left(number, F.lit(2)), F.lit("-01-2"), F.left(number, F.lit(1)), F.lit("-12-30")), prose, 0),
        (F.concat(word(3), word(4), word(5), cut(number, 1, 5)), prose, 0),
    ]
    kind = F.pmod(i, F.lit(len(kinds)))
    case = lambda j: F.coalesce(*[F.when(kind == k, F.lit(row[j]) if j == 2 else row[j]) for k, row in enumerate(kinds)])
    rows = spark.range(n).select(F.col("id").alias("i")).select(
        case(0).alias("value"), case(1).alias("before"), case(2).cast("double").alias("label")
    )
    quote = F.when(F.col("before").rlike("[\"']$"), F.right("before", F.lit(1))).otherwise(" ")
    return rows.withColumn("after", quote)


def train(findings: DataFrame) -> PipelineModel:
    """The forest, from value, before, after and label (0 or 1)."""
    known = features(findings.where(F.col("label").isin(0, 1) & (F.length("value") > 0)))
    forest = RandomForestClassifier(numTrees=30, maxDepth=8, seed=7, featureSubsetStrategy="0.5")
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(known)


def candidates(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, nth (from 1), value, before and after of each candidate."""
    rows = named(documents, doc_id=id_column, text=text_column)
    rows = rows.where(F.col("text").rlike(_SIGN) & F.col("text").rlike(CANDIDATE))
    split = rows.select(
        "doc_id",
        F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("values"),
        F.split("text", CANDIDATE, -1).alias("parts"),
    )
    ends = F.transform("parts", lambda p: F.struct(F.right(p, F.lit(80)).alias("before"), F.left(p, F.lit(40)).alias("after")))
    zipped = split.select("doc_id", "values", ends.alias("parts")).select(
        "doc_id",
        F.posexplode(F.arrays_zip("values", "parts", F.slice("parts", 2, F.size("values") + 1).alias("next"))).alias("n", "x"),
    )
    return zipped.where(F.col("x.values").isNotNull()).select(
        "doc_id",
        (F.col("n") + 1).alias("nth"),
        F.col("x.values").alias("value"),
        F.col("x.parts.before").alias("before"),
        F.col("x.next.after").alias("after"),
    )


def scan(documents: DataFrame, model: PipelineModel, threshold: float = THRESHOLD) -> DataFrame:
    """The candidates with probability and is_secret."""
    judged = model.transform(features(candidates(documents)))
    chance = F.element_at(vector_to_array("probability"), 2)
    columns = ["doc_id", "nth", "value", "before", "after"]
    return judged.select(*columns, chance.alias("probability"), (chance >= threshold).alias("is_secret"))


def redact(documents: DataFrame, model: PipelineModel, mask: str = MASK) -> DataFrame:
    """The documents with every secret in their text replaced; rows and columns stay, n_chars is counted anew."""
    spark = documents.sparkSession
    found = scan(documents, model).where("is_secret").select("doc_id", "value").distinct()
    by_document = found.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.length("value")).alias("n"), "value"))).alias("secrets")
    )
    doc, values = free("secret_doc", documents.columns), free("secrets", documents.columns)
    found = by_document.withColumnsRenamed({"doc_id": doc, "secrets": values})
    found = stored(found, work_folder(spark, "secrets"))
    size = found.agg(F.count(F.lit(1)), F.sum(F.aggregate(values, F.lit(0), lambda s, x: s - x["n"]))).first()
    if size[0] <= BROADCAST_ROWS // 10 and (size[1] or 0) <= 16 << 20:
        found = F.broadcast(found)
    joined = documents.join(found, documents["doc_id"].eqNullSafe(found[doc]), "left")
    clean = F.aggregate(values, F.col("text"), lambda t, x: F.replace(t, x["value"], F.lit(mask)))
    joined = joined.withColumn("text", F.coalesce(clean, F.col("text")))
    if "n_chars" in documents.columns:
        counted = F.when(F.col(values).isNull(), F.col("n_chars")).otherwise(F.char_length("text"))
        joined = joined.withColumn("n_chars", counted.cast(documents.schema["n_chars"].dataType))
    return joined.select(*documents.columns)
