"""Scans of vulnerability record dumps: folders, line files and zip archives."""

from __future__ import annotations

import io
import sys
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The archive reader is sent along with its tasks, so that workers need no copy
# of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# ---- fixed values: which archive entries are records
RECORD_FOLDER = "cves/"
RECORD_PREFIX = "CVE-"
RECORD_SUFFIX = ".json"
ARCHIVE_SUFFIX = ".zip"

_ENTRY_SCHEMA = "archive string, entry_ord bigint, entry string, raw binary"
_BATCH_BYTES = 16 * 1024 * 1024


def accept_entry(entry: Column) -> Column:
    """True for record files: under cves/, named CVE-*, ending in .json.

    Folder and ending are compared in lower case, the name prefix as it is;
    back-slashes count as slashes.
    """
    plain = F.translate(entry, "\\", "/")
    lowered = F.lower(plain)
    return (
        lowered.endswith(RECORD_SUFFIX)
        & lowered.startswith(RECORD_FOLDER)
        & F.substring_index(plain, "/", -1).startswith(RECORD_PREFIX)
    )


def scan_entries(entries: DataFrame, entry: str = "entry") -> DataFrame:
    """Keep the record files of a table of entries."""
    return entries.where(accept_entry(F.col(entry)))


def scan_cve_json(spark: SparkSession, root: str) -> DataFrame:
    """Records of an extracted folder, one file each: entry, value.

    The name filter reads file metadata only; no text is decoded for the rest.
    Very many small files are slow to list: prefer line files at scale.
    """
    bare_root = root.split("://", 1)[-1].removeprefix("file:").rstrip("/")
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*[jJ][sS][oO][nN]")
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    entry = F.regexp_replace(path, rf"\A.*?\Q{bare_root}\E/+", "")
    return scan_entries(files.select(entry.alias("entry"), "value"))


def scan_cve_lines(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON line files, one per line: value. Splittable, hence the scan for scale."""
    return spark.read.text(path)


def _is_record(name: str) -> bool:
    lowered = name.lower()
    base = name.rsplit("/", 1)[-1]
    return lowered.endswith(RECORD_SUFFIX) and lowered.startswith(RECORD_FOLDER) and base.startswith(RECORD_PREFIX)


def _record_entries(content: bytes, nested: bool = False) -> Iterator[tuple[str, bytes]]:
    """Record entries of one archive, and of the archives directly inside it."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for info in archive.infolist():
            name = info.filename.replace("\\", "/")
            if name.lower().endswith(ARCHIVE_SUFFIX):
                if not nested:
                    yield from _record_entries(archive.read(info), nested=True)
            elif _is_record(name):
                yield name, archive.read(info)


def _expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["archive", "entry_ord", "entry", "raw"]
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            rows, size = [], 0
            for number, (name, raw) in enumerate(_record_entries(content)):
                rows.append((path, number, name, raw))
                size += len(raw)
                if size >= _BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)


def expand_archives(archives: DataFrame) -> DataFrame:
    """Record entries of zip archives given as rows (path, content).

    Entries leave the task in small batches. The text stays undecoded bytes in
    Python; whether it is valid UTF-8 is checked in the JVM by ``parse_records``.
    """
    opened = archives.select("path", "content").mapInPandas(_expand, _ENTRY_SCHEMA)
    return opened.select("archive", "entry_ord", "entry", F.col("raw").cast("string").alias("value"))


def scan_cve_archives(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Records inside zip archives: archive, entry_ord, entry, value.

    Archives are opened in parallel, one archive by one task. ``partitions``
    spreads the entries of few large archives over the cluster for what follows.
    """
    archives = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    entries = expand_archives(archives.where(F.lower("path").endswith(ARCHIVE_SUFFIX)))
    return entries.repartition(partitions) if partitions else entries


def scan_pairs(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """Code pairs for training: vuln_function, patch_function.

    Parquet tables are read by name; CSV files have two columns and no header.
    """
    if file_format == "csv":
        return spark.read.csv(
            path, schema="vuln_function string, patch_function string", header=False, multiLine=True, escape='"'
        )
    return spark.read.format(file_format).load(path).select("vuln_function", "patch_function")
