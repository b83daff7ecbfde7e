"""Upserts on tables without a MERGE statement.

``existing`` holds at most one row per key. A batch may hold many; it is first
reduced to one row per key by a map-side aggregation, so a key that fills a
third of the batch costs one row per task. One full outer join of both then
reads the stored rows once. Stored tables are bucketed by their key
(``sources.store``), so only the batch is exchanged and the stored rows, with
their large texts, stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _columns_but(df: DataFrame, keys: list[str]) -> list[str]:
    return [name for name in df.columns if name not in keys]


def last_rows(batch: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Per key the whole row that comes last in ``order``."""
    values = _columns_but(batch, keys)
    latest = batch.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("row"))
    return latest.select(*keys, *[F.col(f"row.{name}").alias(name) for name in values])


def last_values(batch: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Per key and column the last value that is not NULL."""
    values = _columns_but(batch, keys)
    return batch.groupBy(*keys).agg(
        *[F.max_by(name, F.when(F.col(name).isNotNull(), order)).alias(name) for name in values]
    )


def _matched(existing: DataFrame, newest: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows ``e`` and rows ``n`` of the reduced batch side by side; NULL keys meet none."""
    on = [F.col(f"e.{key}") == F.col(f"n.{key}") for key in keys]
    return existing.alias("e").join(newest.withColumn("_new", F.lit(True)).alias("n"), on, "full_outer")


def overwritten(existing: DataFrame, newest: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows, replaced or joined by the rows of a batch with one row per key."""
    return _matched(existing, newest, keys).select(
        *[F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"e.{c}")).alias(c) for c in existing.columns]
    )


def filled(existing: DataFrame, newest: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows whose columns take the values of a batch with one row per key, where it has any."""
    return _matched(existing, newest, keys).select(
        *[F.coalesce(f"n.{c}", f"e.{c}").alias(c) for c in existing.columns]
    )


def merge_overwrite(existing: DataFrame, batch: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last batch row replaces the stored row as a whole, NULLs included."""
    return overwritten(existing, last_rows(batch, keys, order), keys)


def merge_coalesce(existing: DataFrame, batch: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Column by column the last value that is not NULL wins; stored values fill the holes."""
    return filled(existing, last_values(batch, keys, order), keys)


def with_row_id(rows: DataFrame, name: str, parts: list[str]) -> DataFrame:
    """Add a surrogate id that is a hash of ``parts``, equal on every run."""
    text = F.concat_ws("#", *[F.coalesce(F.col(part).cast("string"), F.lit("")) for part in parts])
    return rows.withColumn(name, F.substring(F.sha2(text, 256), 1, 16))


FUNCTION_ID_PARTS = [
    "repo_url", "commit_sha", "file_path", "method_name",
    "vuln_start_line", "vuln_end_line", "patched_start_line", "patched_end_line",
]


def append_functions(
    existing: DataFrame, batch: DataFrame, extra_parts: list[str] | None = None, dedupe: bool = False
) -> DataFrame:
    """Plain insert of function rows, with a hash id in place of a counter.

    Rows without a repo_url are not accepted (see ``rejected_functions``). The
    same function reached through two links is stored twice unless ``dedupe``;
    ``extra_parts`` names columns that tell such copies apart in the id.
    """
    parts = FUNCTION_ID_PARTS + (extra_parts or [])
    accepted = with_row_id(batch.where(F.col("repo_url") != ""), "function_id", parts)
    if dedupe:
        # Equal ids mean equal place and equal text, so any survivor will do.
        accepted = accepted.dropDuplicates(["function_id"]).join(
            existing.select("function_id"), "function_id", "left_anti"
        )
    return existing.unionByName(accepted.select(*existing.columns))


def rejected_functions(batch: DataFrame) -> DataFrame:
    """Function rows that may not be stored because they name no repository."""
    return batch.where(F.coalesce(F.col("repo_url"), F.lit("")) == "")
