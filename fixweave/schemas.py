"""Schemas of the stored tables, of the landed inputs and of the nested record."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "double": T.DoubleType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "boolean": T.BooleanType(),
}


def _table(columns: str) -> T.StructType:
    """Schema of a flat table from ``name type, name type, ...``; needs no session."""
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# ---- stored tables -------------------------------------------------------
CVE = _table(
    "cve_id string, title string, published string, severity string, cvss_score double, cwe string, state string"
)
CVE_COMMIT = _table(
    "cve_id string, repo_url string, commit_sha string, commit_url string, method string, confidence double"
)
COMMITS = _table(
    "repo_url string, sha string, commit_url string, commit_date string, message string, author string"
)
PATCH = _table(
    "patch_id string, repo_url string, commit_sha string, file_path string, language string, added_lines int, "
    "removed_lines int, hunk_count int, diff_text string, before_code string, after_code string"
)
FUNCTIONS = _table(
    "function_id string, repo_url string, commit_sha string, file_path string, method_name string, "
    "patched_start_line int, patched_end_line int, vuln_start_line int, vuln_end_line int, "
    "vuln_function string, patch_function string"
)
SYNC_STATE = _table("source_name string, release_tag string, synced_at string")

TABLES = {
    "cve": CVE,
    "cve_commit": CVE_COMMIT,
    "commits": COMMITS,
    "patch": PATCH,
    "functions": FUNCTIONS,
    "sync_state": SYNC_STATE,
}

# Key columns per table; ``functions`` has none but its surrogate.
KEYS = {
    "cve": ["cve_id"],
    "cve_commit": ["cve_id", "repo_url", "commit_sha"],
    "commits": ["repo_url", "sha"],
    "patch": ["repo_url", "commit_sha", "file_path"],
    "functions": ["function_id"],
    "sync_state": ["source_name"],
}


@dataclass(frozen=True)
class Layout:
    """How a stored table lies in its folders.

    Rows of ``year_of``, an ISO text, lie in a folder per year. Tables that are
    ``merged`` are bucketed by their key, others are cut into key ranges of the
    ``sort`` columns, by which the rows of every file are ordered.
    """

    sort: tuple[str, ...]
    year_of: str | None = None
    merged: bool = True


LAYOUTS = {
    "cve": Layout(("severity", "published"), year_of="published"),
    "cve_commit": Layout(("cve_id",)),
    "commits": Layout(("commit_date",), year_of="commit_date"),
    "patch": Layout(("repo_url", "commit_sha", "file_path")),
    "functions": Layout(("repo_url", "commit_sha", "file_path"), merged=False),
    "sync_state": Layout(("source_name",)),
}

# ---- landed inputs -------------------------------------------------------
COMMIT_RAW = _table(
    "repo_url string, commit_sha string, full_sha string, message string, author string, commit_date string, "
    "error string"
)
FILE_CHANGE = _table(
    "repo_url string, commit_sha string, file_ord bigint, old_path string, new_path string, change_type string, "
    "diff string, source_before string, source_after string"
)
METHOD_SPAN = _table(
    "repo_url string, commit_sha string, file_ord bigint, side string, ord int, name string, start_line bigint, "
    "end_line bigint"
)
FETCH_LOG = _table("seq bigint, repo_url string, phase string, ok boolean, message string")

# ---- the nested record; only the paths that are read ----------------------
# A metric is a map because its keys are not known; its values stay JSON text.
CORRUPT = "_corrupt_record"
_STRING = T.StringType()
RECORD = _struct(
    dataType=_STRING,
    dataVersion=_STRING,
    cveMetadata=_struct(cveId=_STRING, state=_STRING, datePublished=_STRING),
    containers=_struct(
        cna=_struct(
            title=_STRING,
            descriptions=T.ArrayType(_struct(lang=_STRING, value=_STRING)),
            affected=T.ArrayType(_struct(product=_STRING)),
            problemTypes=T.ArrayType(_struct(descriptions=T.ArrayType(_struct(type=_STRING, cweId=_STRING)))),
            metrics=T.ArrayType(T.MapType(_STRING, _STRING)),
            references=T.ArrayType(_struct(url=_STRING)),
        )
    ),
    _corrupt_record=_STRING,
)


# A record text as the only element of an array, and a mark that must still follow it.
FRAME_HEAD, FRAME_TAIL = '{"records":[', '],"fixweave_end":true}'
FRAMED = _struct(
    records=T.ArrayType(T.StructType([f for f in RECORD.fields if f.name != CORRUPT])),
    fixweave_end=T.BooleanType(),
    _corrupt_record=_STRING,
)


def _loose() -> T.StructType:
    """The record with its product and reference lists as JSON text, whatever their type is."""
    kinds = {"affected": _STRING, "references": _STRING}
    cna = RECORD["containers"].dataType["cna"].dataType
    loose = _struct(**{f.name: kinds.get(f.name, f.dataType) for f in cna.fields})
    return _struct(**{f.name: _struct(cna=loose) if f.name == "containers" else f.dataType for f in RECORD.fields})


LOOSE_RECORD = _loose()
CVSS = _table("version string, baseScore string, baseSeverity string, vectorString string")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast and order the columns of ``df`` to ``schema``; a missing column becomes NULL."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
