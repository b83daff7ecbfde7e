"""Landing of record folders: very many small files become few line files, each of them once.

Small files are slow to open and to list. They are listed by tasks, a level of folders
at a time and a folder by one task, which reads no contents; what is found is stored,
compared with what has landed, and copied slice by slice: every slice is one job that
appends line files, and its files are opened by the tasks. The driver holds a few numbers
for each slice and no names. A landed line keeps the entry name, the time and the length
of its file as listed. A run that died is started again: what its finished slices
brought is found among the landed lines. A file that changed later lands again, as a
later row of the same entry. Texts that are not valid UTF-8 keep their bytes.

As in Spark's own scans, empty files are left out, and so are files and folders whose
names start with a dot or an underscore. Stores other than this machine's folders are
listed by pyarrow, which holds one folder's entries at a time.
"""

from __future__ import annotations

import math
import os
import sys
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixweave.frames import large
from fixweave.session import staged, staged_with_counts
from fixweave.sources.records import accept_entry

# The tasks' functions are sent along with them, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Files of one slice at most, and bytes of a line file about.
SLICE_FILES, FILE_BYTES = 20_000, 128 << 20
# Names and bytes of texts that leave a task together.
_NAMES_TOGETHER, _BYTES_TOGETHER = 10_000, 16 << 20

_LANDED = "entry string, modified timestamp, length bigint, value string, bytes string"
_FOUND = "name string, is_folder boolean, modified bigint, length bigint"
_READ = "entry string, modified timestamp, length bigint, raw binary"


def _is_hidden(name: str, is_folder: bool) -> bool:
    """Whether Spark's scans leave out a file or folder of this name."""
    if is_folder and name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _storage(root: str) -> tuple[fs.FileSystem, str, bool]:
    """The file system of a folder, the folder in it, and whether it is this machine's."""
    if root.startswith(("/", "file:")):
        return fs.LocalFileSystem(), "/" + root.removeprefix("file:").strip("/"), True
    system, base = fs.FileSystem.from_uri(root)
    return system, base.rstrip("/"), False


def _entries_of(root: str) -> Callable[[str], Iterator[tuple[str, bool, int, int]]]:
    """Entries of a folder below the root: name below the root, whether it is a folder, milliseconds of its change, length."""
    system, base, local = _storage(root)

    def of_machine(folder: str) -> Iterator[tuple[str, bool, int, int]]:
        try:
            found = os.scandir(f"{base}/{folder}")
        except FileNotFoundError:
            if folder:
                return
            raise
        with found:
            for entry in found:
                try:
                    entry.name.encode()
                    state = entry.stat()
                    yield entry.name, entry.is_dir(), state.st_mtime_ns // 1_000_000, state.st_size
                except (FileNotFoundError, UnicodeEncodeError):
                    # Gone since, a link to nothing, or a name that is no text.
                    continue

    def of_store(folder: str) -> Iterator[tuple[str, bool, int, int]]:
        for info in system.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"))):
            yield info.base_name, info.type == fs.FileType.Directory, (info.mtime_ns or 0) // 1_000_000, info.size or 0

    def entries(folder: str) -> Iterator[tuple[str, bool, int, int]]:
        for name, *rest in (of_machine if local else of_store)(folder):
            yield (f"{folder}/{name}" if folder else name, *rest)

    return entries


def _list(root: str):
    """Folders, and files that may be records, of the folders of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, kinds, held = _entries_of(root), [pa.string(), pa.bool_(), pa.int64(), pa.int64()], []

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], ["name", "is_folder", "modified", "length"])

        for batch in batches:
            for folder in batch.column("name").to_pylist():
                for name, is_folder, modified, length in entries(folder):
                    if _is_hidden(name[len(folder) + bool(folder):], is_folder) or not (is_folder or (length and name[-4:].lower() == "json")):
                        continue
                    held.append((name, is_folder, modified, length))
                    if len(held) >= _NAMES_TOGETHER:
                        yield packed()
                        held = []
        if held:
            yield packed()

    return run


def list_records(spark: SparkSession, root: str) -> DataFrame:
    """Record files below a folder: path, entry, modified, length. No contents are read.

    Folders are listed level by level, each by one task, and what is found is stored.
    """
    levels, folders, n = [], spark.createDataFrame([("",)], "name string"), 1
    while n:
        dealt = folders.repartition(min(n, 4 * spark.sparkContext.defaultParallelism))
        found, counts = staged_with_counts(dealt.mapInArrow(_list(root), _FOUND), "listed", folders=F.count_if("is_folder"))
        levels.append(found.where(~F.col("is_folder")))
        folders, n = found.where("is_folder").select("name"), counts["folders"]
    files = reduce(DataFrame.unionAll, levels)
    path = F.concat(F.lit(root.rstrip("/") + "/"), "name")
    named = files.select(path.alias("path"), F.col("name").alias("entry"), F.timestamp_millis("modified").alias("modified"), "length")
    return named.where(accept_entry(F.col("entry")))


def _read(root: str):
    """Contents of the files of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base, local = _storage(root)

        def content(entry: str) -> bytes:
            if local:
                with open(f"{base}/{entry}", "rb") as file:
                    return file.read()
            with system.open_input_stream(f"{base}/{entry}") as file:
                return file.read()

        for batch in batches:
            low, texts, size = 0, [], 0
            for at, entry in enumerate(batch.column("entry").to_pylist(), 1):
                texts.append(content(entry))
                size += len(texts[-1])
                if size >= _BYTES_TOGETHER or at == batch.num_rows:
                    part = batch.slice(low, at - low)
                    columns = [part.column(name) for name in ("entry", "modified", "length")]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.binary())], ["entry", "modified", "length", "raw"])
                    low, texts, size = at, [], 0

    return run


def scan_landed(spark: SparkSession, target: str) -> DataFrame:
    """Landed records: entry, modified, length, value. Splittable; of equal entries the later ``modified`` is newer."""
    lines = spark.read.schema(_LANDED).json(target)
    return lines.select("entry", "modified", "length", F.coalesce("value", F.unbase64("bytes").cast("string")).alias("value"))


def _landed(spark: SparkSession, target: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _LANDED)
    return scan_landed(spark, target)


def land_records(
    spark: SparkSession, root: str, target: str, slice_files: int = SLICE_FILES, file_bytes: int = FILE_BYTES
) -> int:
    """Copy the record files below ``root`` that have not landed yet to line files; returns how many."""
    known = ["entry", "modified", "length"]
    missing = list_records(spark, root).select(*known).join(large(_landed(spark, target).select(*known)), known, "left_anti")
    todo, counts = staged_with_counts(missing, "to-land", total=F.count("*"))
    slices = math.ceil(counts["total"] / slice_files)
    # Dealt out by a hash: a slice holds about its share of files, of the bytes too.
    placed = todo.withColumn("slice", F.pmod(F.xxhash64("entry"), F.lit(max(1, slices))))
    if slices > 1:
        # Sorted, so that a slice opens the files and row groups of its own rows.
        placed = staged(placed.sort("slice"), "slices")
    for number, size in sorted(map(tuple, placed.groupBy("slice").agg(F.sum("length")).collect())):
        files = max(1, math.ceil(size / file_bytes))
        part = placed.where(F.col("slice") == number).select(*known).repartition(files)
        texts = part.mapInArrow(_read(root), _READ).select(*known, F.col("raw").cast("string").alias("value"))
        valid = F.is_valid_utf8("value")
        lines = texts.select(
            *known, F.when(valid, F.col("value")).alias("value"),
            F.when(~valid, F.base64(F.col("value").cast("binary"))).alias("bytes"),
        )
        lines.write.mode("append").json(target)
    return counts["total"]
