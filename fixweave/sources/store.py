"""Stored tables as versioned parquet folders.

A run writes new folders and then one manifest row per table in a single
append, so readers see either all of the run or nothing of it. Nothing that may
still be read is overwritten, and a run that died leaves only unused folders.
A version is a list of folders, called parts: rows with new keys are added as
one more part, and of a table that a batch meets, only the parts that hold a
replaced key are copied. A stream's batch is noted in the same append, so a
batch that comes again is known. One writer at a time is assumed.

Tables that are merged are bucketed by their key: the join with a batch leaves
the stored rows where they are. Tables that are read by date lie in a folder
per year, and the rows of a file are sorted, so a range reads a share of the
files (``schemas.LAYOUTS``).
"""

from __future__ import annotations

import hashlib
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixweave import schemas
from fixweave.operators.merge import filled, last_rows, last_values, merge_overwrite, overwritten
from fixweave.session import staged

# Tables whose rows are replaced as a whole by a later row.
OVERWRITTEN = ["cve", "sync_state"]
BUCKETS = 8

_MANIFEST = (
    "table string, version bigint, parts array<string>, buckets int, published_at string, "
    "stream string, batch_id bigint, counts map<string,bigint>"
)
# Manifest rows of this name are batches of a stream.
_LEDGER = "_batch"
# Folder of rows without a year at the head of their date.
NO_YEAR = "none"


def year_of(date: Column) -> Column:
    return F.when(date.rlike(r"\A[0-9]{4}"), F.substring(date, 1, 4)).otherwise(NO_YEAR)


class TableStore:
    """The six stored tables under one root folder; ``buckets`` is the number of files a merge is spread over."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets
        self._known: dict[str, set[str]] = {}

    def _exists(self, folder: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    # ---- manifest ------------------------------------------------------------
    def _manifest(self) -> DataFrame | None:
        folder = f"{self.root}/_manifest"
        return self.spark.read.schema(_MANIFEST).parquet(folder) if self._exists(folder) else None

    def _current(self) -> dict[str, tuple[int, list[str], int]]:
        """Version, parts and buckets per table; a handful of rows by construction."""
        manifest = self._manifest()
        if manifest is None:
            return {}
        tables = manifest.where(F.col("table") != _LEDGER)
        latest = tables.groupBy("table").agg(F.max(F.struct("version", "parts", "buckets")).alias("latest"))
        return {r["table"]: tuple(r["latest"]) for r in latest.collect()}

    def batches(self) -> DataFrame:
        """One row per stored batch of a stream: stream, batch_id, counts."""
        manifest = self._manifest()
        if manifest is None:
            manifest = self.spark.createDataFrame([], _MANIFEST)
        return manifest.where(F.col("table") == _LEDGER).select("stream", "batch_id", "counts")

    def has_batch(self, stream: str, batch_id: int) -> bool:
        """Whether a batch was published before; looks up one row."""
        return self.batches().where((F.col("stream") == stream) & (F.col("batch_id") == batch_id)).head() is not None

    # ---- reading -------------------------------------------------------------
    def _folders(self, table: str, parts: list[str]) -> DataFrame:
        fields = ["part", "year"] if schemas.LAYOUTS[table].year_of else ["part"]
        schema = T.StructType([*schemas.TABLES[table].fields, *[T.StructField(f, T.StringType()) for f in fields]])
        base = f"{self.root}/{table}"
        return self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/part={p}" for p in parts])

    def read(self, table: str, first: str | None = None, last: str | None = None) -> DataFrame:
        """Current rows of a table, none if it was never written.

        With ``first`` or ``last``, rows whose date lies in this range of ISO
        texts, both ends included; folders of other years are not opened.
        """
        schema, date = schemas.TABLES[table], schemas.LAYOUTS[table].year_of
        _, parts, _ = self._current().get(table, (0, [], 0))
        rows = self._folders(table, parts) if parts else self.spark.createDataFrame([], schema)
        if first is not None or last is not None:
            if date is None:
                raise ValueError(f"{table} is not laid out by a date")
            for bound, inside in ((first, Column.__ge__), (last, Column.__le__)):
                if bound is not None:
                    rows = rows.where(inside(F.col(date), bound))
                    if parts:
                        rows = rows.where((F.col("year") == NO_YEAR) | inside(F.col("year"), bound[:4]))
        return rows.select(*schema.names)

    def _bucketed(self, table: str, buckets: int) -> str:
        """Catalog name through which the folders of a table are read and written by bucket.

        The catalog entry is a view of the folders for this session; what is
        stored is told by the manifest alone.
        """
        location, layout = f"{self.root}/{table}", schemas.LAYOUTS[table]
        name = "fixweave_" + hashlib.sha256(f"{location}|{buckets}".encode()).hexdigest()[:24]
        if not self.spark.catalog.tableExists(name):
            folders = ["part", "year"] if layout.year_of else ["part"]
            columns = [f"{f.name} {f.dataType.simpleString()}" for f in schemas.TABLES[table].fields]
            columns += [f"{f} string" for f in folders]
            place = location.replace("'", "\\'")
            self.spark.sql(
                f"CREATE TABLE {name} ({', '.join(columns)}) USING parquet PARTITIONED BY ({', '.join(folders)}) "
                f"CLUSTERED BY ({', '.join(schemas.KEYS[table])}) SORTED BY ({', '.join(layout.sort)}) "
                f"INTO {buckets} BUCKETS LOCATION '{place}'"
            )
            self._known[name] = set()
        return name

    def stored(self, table: str) -> DataFrame | None:
        """Current rows of a merged table with their ``part``, read by bucket; None if there are none."""
        _, parts, buckets = self._current().get(table, (0, [], 0))
        if not parts:
            return None
        name = self._bucketed(table, buckets)
        known = self._known.setdefault(name, set())
        if not known.issuperset(parts):
            self.spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
            known.update(parts)
        return self.spark.table(name).where(F.col("part").isin(parts)).select("part", *schemas.TABLES[table].names)

    # ---- writing -------------------------------------------------------------
    def _write(self, table: str, df: DataFrame, part: str, buckets: int, in_buckets: bool) -> None:
        layout = schemas.LAYOUTS[table]
        rows = schemas.conform(df, schemas.TABLES[table])
        if not layout.merged:
            ordered = rows.repartitionByRange(*layout.sort).sortWithinPartitions(*layout.sort)
            ordered.write.parquet(f"{self.root}/{table}/part={part}")
            return
        if not in_buckets:
            rows = rows.repartition(buckets, *schemas.KEYS[table])
        rows = rows.withColumn("part", F.lit(part))
        if layout.year_of:
            rows = rows.withColumn("year", year_of(F.col(layout.year_of)))
        rows.write.insertInto(self._bucketed(table, buckets))

    def publish(
        self, tables: dict[str, DataFrame], added: dict[str, DataFrame] | None = None,
        batch: tuple[str, int, dict[str, int]] | None = None,
    ) -> None:
        """Make new contents of ``tables``, and rows ``added`` to others, current together.

        ``batch`` notes a batch of a stream: its stream, number and counts.
        """
        current = self._current()
        whole = {name: (df, []) for name, df in tables.items()}
        extra = {name: (df, current.get(name, (0, [], 0))[1]) for name, df in (added or {}).items()}
        self._publish({**whole, **extra}, current, batch)

    def _publish(self, changes, current, batch=None, in_buckets: tuple[str, ...] = ()) -> None:
        """Append one manifest row per changed table: new rows and the parts that stay beside them."""
        rows, now = [], datetime.now(timezone.utc).isoformat()
        for name, (df, kept) in changes.items():
            version, _, stored_buckets = current.get(name, (0, [], 0))
            buckets = stored_buckets if kept else self.buckets
            part = f"v{version + 1}-{uuid.uuid4().hex[:8]}"
            self._write(name, df, part, buckets, name in in_buckets)
            # A part without rows has no folder.
            parts = [*kept, part] if self._exists(f"{self.root}/{name}/part={part}") else kept
            rows.append((name, version + 1, parts, buckets, now, None, None, None))
        if batch:
            rows.append((_LEDGER, None, None, None, now, *batch))
        manifest = self.spark.createDataFrame(rows, _MANIFEST).coalesce(1)
        manifest.write.mode("append").parquet(f"{self.root}/_manifest")

    def compact(self, table: str) -> None:
        """Copy a table of many parts into one, with this store's number of buckets."""
        self.publish({table: self.read(table)})

    def upsert(
        self, batches: dict[str, tuple[DataFrame, Column]], added: dict[str, DataFrame] | None = None,
        batch: tuple[str, int, dict[str, int]] | None = None,
    ) -> None:
        """Merge batches, given with their arrival order, and publish them together.

        Records and sync states are overwritten, all else is merged column by
        column. A batch is reduced to one row per key and stored first; which
        parts it meets is then a scan of key columns only. These parts are
        merged into a new one, all others are left where they are.
        """
        current = self._current()
        changes, in_buckets = {}, []
        for name, (rows, order) in batches.items():
            keys, whole = schemas.KEYS[name], name in OVERWRITTEN
            reduced = last_rows(rows, keys, order) if whole else last_values(rows, keys, order)
            reduced = staged(schemas.conform(reduced, schemas.TABLES[name]), f"batch-{name}")
            stored, parts = self.stored(name), current.get(name, (0, [], 0))[1]
            met: list[str] = []
            if stored is not None:
                same = stored.select("part", *keys).join(reduced.select(*keys), keys, "left_semi")
                met = [r["part"] for r in same.select("part").distinct().collect()]
            if met:
                old = stored.where(F.col("part").isin(met)).drop("part")
                changes[name] = ((overwritten if whole else filled)(old, reduced, keys), [p for p in parts if p not in met])
                # The join leaves rows in the buckets that they were read by.
                if changes[name][1] or current[name][2] == self.buckets:
                    in_buckets.append(name)
            else:
                changes[name] = (reduced, parts)
        for name, df in (added or {}).items():
            changes[name] = (df, current.get(name, (0, [], 0))[1])
        self._publish(changes, current, batch, tuple(in_buckets))


def sync_decision(releases: DataFrame, sync_state: DataFrame, force: bool = False) -> DataFrame:
    """Per source: the new tag, the stored tag, and whether a run is needed."""
    stored = sync_state.select("source_name", F.col("release_tag").alias("stored_tag"))
    same = F.coalesce(F.col("stored_tag") == F.col("release_tag"), F.lit(False))
    return releases.join(stored, "source_name", "left").select(
        "source_name", "release_tag", "stored_tag", (F.lit(force) | ~same).alias("run")
    )


def should_run(sync_state: DataFrame, source_name: str, release_tag: str, force: bool = False) -> bool:
    """Whether a release is still to be processed; looks up one row."""
    stored = sync_state.where(F.col("source_name") == source_name).select("release_tag").head()
    return force or stored is None or stored["release_tag"] != release_tag


def upsert_sync_state(sync_state: DataFrame, updates: DataFrame) -> DataFrame:
    """One row per source; the last update by ``synced_at`` replaces the stored row."""
    return merge_overwrite(sync_state, updates, ["source_name"], F.col("synced_at"))
