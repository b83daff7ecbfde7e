"""From raw record text to flat vulnerability rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixweave import schemas
from fixweave.frames import computed
from fixweave.functions.urls import OTHER_KIND, REFERENCE_KINDS, reference_kind, url_is_malformed

# ---- fixed values: defaults and messages -----------------------------------
UNKNOWN = "UNKNOWN"
NO_TITLE = "No title available"
NO_DESCRIPTION_VALUE = "Description not available"
NO_DESCRIPTION = "Description not collected"
REJECTED = "REJECTED"
REQUIRED_FIELDS = ["dataType", "dataVersion", "cveMetadata", "containers"]
NOT_A_DICTIONARY = "CVE data must be a dictionary"
MISSING_FIELD = "Missing top-level field: "
BAD_ID = "Invalid CVE ID format"
MISSING_CNA = "Missing containers.cna section"
VALID = "Validation passed"

# Stands for references of the wrong type; no URL reader takes it.
UNREADABLE = "http://["

_JSON_OPTIONS = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": schemas.CORRUPT,
    "allowSingleQuotes": "false",
}
# Text that Python's float() takes.
_FLOAT = r"(?iU)\A\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf(?:inity)?)\s*\z"


# ---- parsing ----------------------------------------------------------------
def _framed(value: Column) -> Column:
    """Strict parse of a text as the one element of an array.

    A parser stops at the end of the first value, so text after a record would go
    unseen. Inside the frame it is a second element, an error, or it keeps the end
    mark from being read.
    """
    return F.from_json(_in_frame(value), schemas.FRAMED, _JSON_OPTIONS)


def _in_frame(value: Column) -> Column:
    return F.concat(F.lit(schemas.FRAME_HEAD), value, F.lit(schemas.FRAME_TAIL))


def _failed_status(value: Column, record: Column) -> Column:
    """Status of a text that the strict parse refused, by a second look at it."""
    is_object = _is_object(value)
    # Text after the first value parses as JSON all the same; as an array it is not one element, or ends the frame.
    ended = F.from_json(_in_frame(value), "fixweave_end boolean")["fixweave_end"]
    alone = (F.json_array_length(F.concat(F.lit("["), value, F.lit("]"))) == 1) & ended
    alone = F.coalesce(alone, F.lit(False))
    return (
        F.when(is_object & ~alone, "not_json")
        .when(is_object & record[schemas.CORRUPT].isNull(), "ok")
        .when(F.try_parse_json(value).isNull(), "not_json")
        .when(is_object, "bad_structure")
        .otherwise("not_object")
    )


def _is_object(value: Column) -> Column:
    text = F.trim(F.translate(value, "\t\r\n", "   "))
    return text.startswith("{") & text.endswith("}")


def _reread(value: Column) -> Column:
    """The record of a text with a field of the wrong type, if that field is not part of its row.

    Products are read by no step that stores rows: a list of the wrong type is
    none. References are read after the row was stored: if they are no list of
    objects, they become one address that cannot be parsed, so the row stays,
    its links are lost, and the record counts as skipped.
    """
    loose = F.from_json(value, schemas.LOOSE_RECORD, _JSON_OPTIONS)

    def items(text: Column) -> Column:
        """Elements as JSON texts; NULL if the text is no list of objects."""
        held = F.from_json(text, "array<string>")
        objects = F.forall(held, lambda e: F.coalesce(e.startswith("{"), F.lit(False)))
        return F.when(text.startswith("[") & objects, held)

    affected, references = _cna(loose)["affected"], _cna(loose)["references"]
    products_ = F.transform(items(affected), lambda e: F.struct(F.get_json_object(e, "$.product").alias("product")))
    urls = F.transform(items(references), lambda e: F.struct(F.get_json_object(e, "$.url").alias("url")))
    unreadable = F.array(F.struct(F.lit(UNREADABLE).alias("url")))
    # An empty text or object has no elements either.
    urls = F.when(~references.isin("", "{}"), F.coalesce(urls, unreadable))
    return loose.withField("containers.cna.affected", products_).withField("containers.cna.references", urls)


def parse_records(raw: DataFrame, value: str = "value") -> DataFrame:
    """Add ``record`` (the nested struct) and ``status`` to rows of record text.

    Status is ok / bad_encoding / not_json / not_object / bad_structure;
    ``bad_structure`` is a JSON object in which a field that the record's row is
    made of has the wrong type. A good record is parsed once. Only texts that
    the strict parse refuses are looked at again.
    """
    text = F.col(value)
    strict = computed(raw, {"_framed": _framed(text)})
    framed = F.col("_framed")
    whole = (
        framed[schemas.CORRUPT].isNull() & F.coalesce(framed["fixweave_end"], F.lit(False))
        & (F.size(framed["records"]) == 1) & F.get(framed["records"], 0).isNotNull() & _is_object(text)
    )
    first = F.get(framed["records"], 0)
    plain = F.struct(*[first[f.name].alias(f.name) for f in schemas.RECORD.fields if f.name != schemas.CORRUPT], F.lit(None).cast("string").alias(schemas.CORRUPT))
    good = F.coalesce(whole, F.lit(False))
    parsed = computed(strict.withColumn("_good", good), {"record": F.when(F.col("_good"), plain).otherwise(_reread(text))})
    status = F.when(~F.is_valid_utf8(text), "bad_encoding").when(F.col("_good"), "ok")
    return parsed.withColumn("status", status.otherwise(_failed_status(text, F.col("record")))).drop("_framed", "_good")


def good_records(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("status") == "ok")


def bad_records(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("status") != "ok")


# ---- single fields ------------------------------------------------------------
def _cna(record: Column) -> Column:
    return record["containers"]["cna"]


def cve_id(record: Column) -> Column:
    return F.coalesce(record["cveMetadata"]["cveId"], F.lit(UNKNOWN))


def state(record: Column) -> Column:
    return F.coalesce(record["cveMetadata"]["state"], F.lit(UNKNOWN))


def published(record: Column) -> Column:
    return record["cveMetadata"]["datePublished"]


def title(record: Column) -> Column:
    """Title, else the value of the first description in any language."""
    first = F.get(_cna(record)["descriptions"], 0)["value"]
    return F.coalesce(F.nullif(_cna(record)["title"], F.lit("")), first, F.lit(NO_TITLE))


def products(record: Column) -> Column:
    """Product names in their order, repeats kept."""
    names = F.transform(_cna(record)["affected"], lambda a: a["product"])
    return F.coalesce(F.filter(names, lambda name: name != ""), F.array().cast("array<string>"))


def description(record: Column, lang: str = "en") -> Column:
    """Value of the first description written in ``lang``."""
    matching = F.filter(_cna(record)["descriptions"], lambda d: d["lang"] == lang)
    return F.when(
        F.size(matching) > 0, F.coalesce(F.get(matching, 0)["value"], F.lit(NO_DESCRIPTION_VALUE))
    ).otherwise(NO_DESCRIPTION)


def cwe_ids(record: Column) -> Column:
    """Distinct weakness ids, sorted so that the result does not depend on hash order."""
    lists = F.transform(_cna(record)["problemTypes"], lambda p: p["descriptions"])
    all_ids = F.transform(
        F.filter(
            F.flatten(F.filter(lists, lambda d: d.isNotNull())),
            lambda d: (d["type"] == "CWE") & (d["cweId"] != ""),
        ),
        lambda d: d["cweId"],
    )
    return F.coalesce(F.array_sort(F.array_distinct(all_ids)), F.array().cast("array<string>"))


def cwe_join(ids: Column) -> Column:
    return F.nullif(F.array_join(ids, ","), F.lit(""))


def best_cvss(record: Column) -> Column:
    """Struct with score, severity, vector and version of the highest CVSS version.

    The first metric wins among equal versions, hence the two leading fields:
    the version as a number and the negated position, by which the maximum is
    taken. NULL if no metric qualifies.
    """
    entries = F.flatten(
        F.transform(F.filter(_cna(record)["metrics"], lambda m: m.isNotNull()), lambda m: F.map_entries(m))
    )
    vectors = F.transform(
        F.filter(entries, lambda e: e["key"].startswith("cvssV") & F.ltrim(e["value"]).startswith("{")),
        lambda e: F.from_json(e["value"], schemas.CVSS, {"allowSingleQuotes": "false"}),
    )
    ranked = F.transform(
        vectors,
        lambda v, i: F.struct(
            F.when(v["version"].rlike(_FLOAT), v["version"].try_cast("double")).alias("number"),
            (-i).alias("earlier"),
            v["baseScore"].try_cast("double").alias("score"),
            v["baseSeverity"].alias("severity"),
            v["vectorString"].alias("vector"),
            v["version"].alias("version"),
        ),
    )
    return F.array_max(F.filter(ranked, lambda r: r["number"] > 0))


def reference_urls(record: Column) -> Column:
    """Non-empty reference URLs; none at all when one of them cannot be parsed.

    One unparsable URL makes the reader give up on the record's references
    after its row was stored, so the row stays and the links are lost.
    """
    urls = F.filter(F.transform(_cna(record)["references"], lambda r: r["url"]), lambda u: u != "")
    return F.when(~has_malformed_url(record), urls).otherwise(F.array().cast("array<string>"))


def has_malformed_url(record: Column) -> Column:
    """Whether the reader gives up on the references: an unparsable URL, or an element that is null."""
    def unreadable(r: Column) -> Column:
        url = F.coalesce(r["url"], F.lit(""))
        return r.isNull() | ((url.contains("[") | url.contains("]")) & url_is_malformed(url))

    return F.coalesce(F.exists(_cna(record)["references"], unreadable), F.lit(False))


def group_references(record: Column) -> Column:
    """struct with one URL array per reference kind."""
    urls = F.transform(
        reference_urls(record), lambda u: F.struct(u.alias("url"), reference_kind(u).alias("kind"))
    )

    def of_kind(kind: str) -> Column:
        picked = F.transform(F.filter(urls, lambda u: u["kind"] == kind), lambda u: u["url"])
        return F.coalesce(picked, F.array().cast("array<string>")).alias(kind)

    return F.struct(*[of_kind(kind) for kind in [*REFERENCE_KINDS.values(), OTHER_KIND]])


def validate(value: Column, record: Column) -> Column:
    """struct<valid, reason> of the ordered checks on one record text."""
    fields = F.json_object_keys(value)
    containers = F.json_object_keys(F.get_json_object(value, "$.containers"))
    reason = F.when(fields.isNull(), F.lit(NOT_A_DICTIONARY))
    for name in REQUIRED_FIELDS:
        reason = reason.when(~F.array_contains(fields, name), MISSING_FIELD + name)
    id_ok = F.coalesce(record["cveMetadata"]["cveId"].rlike(r"(?U)\ACVE-\d{4}-\d{4,7}\n?\z"), F.lit(False))
    cna_ok = F.coalesce(F.array_contains(containers, "cna"), F.lit(False))
    reason = reason.when(~id_ok, BAD_ID).when(~cna_ok, MISSING_CNA).otherwise(VALID)
    return F.struct((reason == VALID).alias("valid"), reason.alias("reason"))


def variant_value(document: Column, path: str, default: str | None = None, data_type: str = "string") -> Column:
    """Value at a path of a parsed document; ``default`` when a step is missing, NULL when it is JSON null."""
    def typed(found: Column) -> Column:
        value = F.coalesce(F.try_variant_get(found, "$", data_type), F.lit(default).cast(data_type))
        return F.when(F.coalesce(F.is_variant_null(found), F.lit(False)), F.lit(None).cast(data_type)).otherwise(value)

    return F.get(F.transform(F.array(F.try_variant_get(document, path, "variant")), typed), 0)


def nested_get(value: Column, path: str, default: str | None = None, data_type: str = "string") -> Column:
    """Value at a JSON path of a text; for several paths use ``nested_values``, which parses once."""
    return variant_value(F.try_parse_json(value), path, default, data_type)


def nested_values(raw: DataFrame, paths: dict[str, tuple], value: str = "value") -> DataFrame:
    """Add a column per entry (path, default, type) of ``paths``; each text is parsed once for all of them."""
    parsed = computed(raw, {"_document": F.try_parse_json(F.col(value))})
    return parsed.select(*raw.columns, *[variant_value(F.col("_document"), *rule).alias(name) for name, rule in paths.items()])


# ---- tables -------------------------------------------------------------------
def flatten_cve(parsed: DataFrame, *carry: str) -> DataFrame:
    """One flat row per parsed record; ``carry`` names further columns to keep."""
    record = F.col("record")
    return (
        parsed.select(
            *carry,
            cve_id(record).alias("cve_id"),
            title(record).alias("title"),
            published(record).alias("published"),
            best_cvss(record).alias("_cvss"),
            cwe_join(cwe_ids(record)).alias("cwe"),
            state(record).alias("state"),
        )
        .select(
            *carry, "cve_id", "title", "published",
            F.col("_cvss.severity").alias("severity"), F.col("_cvss.score").alias("cvss_score"),
            "cwe", "state",
        )
    )


def drop_rejected(parsed: DataFrame) -> DataFrame:
    """Keep records whose state is not exactly REJECTED."""
    return parsed.where(state(F.col("record")) != REJECTED)


def limit_processed(accepted: DataFrame, n: int, *order: str) -> DataFrame:
    """First ``n`` accepted rows in source order."""
    return accepted.orderBy(*order).limit(n)


def outcome(parsed: DataFrame) -> DataFrame:
    """Add ``outcome``: processed, rejected, skipped (an error midway) or unread."""
    record = F.col("record")
    return parsed.withColumn(
        "outcome",
        F.when(F.col("status") == "bad_structure", "skipped")
        .when(F.col("status") != "ok", "unread")
        .when(state(record) == REJECTED, "rejected")
        .when(has_malformed_url(record), "skipped")
        .otherwise("processed"),
    )


OUTCOMES = ["processed", "rejected", "skipped", "unread"]


def outcome_counts() -> dict[str, Column]:
    """Aggregates over an ``outcome`` column, one per outcome."""
    return {name: F.count_if(F.col("outcome") == name) for name in OUTCOMES}


def ingest_counters(tagged: DataFrame) -> DataFrame:
    """One row of run counters from an ``outcome`` column, in one pass."""
    return tagged.agg(*[column.alias(name) for name, column in outcome_counts().items()])
