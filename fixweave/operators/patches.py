"""File-level patch rows from changed files; everything here is row-local."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixweave.functions import diffs
from fixweave.functions.paths import detect_language, first_path, skip_file
from fixweave.functions.pytext import line_total, raw_lines


def drop_skipped_files(files: DataFrame) -> DataFrame:
    """Keep files that pass the path filter under both path choices."""
    old, new = F.col("old_path"), F.col("new_path")
    return files.where(~skip_file(first_path(old, new))).where(~skip_file(first_path(new, old)))


def file_change_rows(files: DataFrame, *carry: str) -> DataFrame:
    """Chosen path (new before old) and diff text, for files kept at extraction; ``carry`` names columns to keep."""
    old, new = F.col("old_path"), F.col("new_path")
    change_type = F.col("change_type") if "change_type" in files.columns else F.lit(None).cast("string")
    return files.where(~skip_file(first_path(old, new))).select(
        "repo_url", "commit_sha", "file_ord", *carry,
        first_path(new, old).alias("file_path"),
        F.coalesce(change_type, F.lit("unknown")).alias("change_type"),
        F.coalesce("diff", F.lit("")).alias("diff"),
    )


def diff_lines(files: DataFrame, *keys: str, diff: str = "diff") -> DataFrame:
    """Long form of diffs: one row per line with its number, kind and text.

    ``content`` is the line without its sign, for added and removed lines only.
    """
    staged = files.select(*keys, raw_lines(F.col(diff)).alias("lines"))
    return (
        staged.select(*keys, line_total(F.col("lines")).alias("total"), F.posexplode("lines").alias("line_no", "line"))
        .where(F.col("line_no") < F.col("total"))
        .select(*keys, "line_no", diffs.line_kind(F.col("line")).alias("kind"), "line")
        .withColumn("content", F.when(F.col("kind").isin("added", "removed"), F.expr("substring(line, 2)")))
    )


def patch_stats(files: DataFrame, diff: str = "diff") -> DataFrame:
    """Add added, removed, changed and hunk counts of the diff."""
    text = F.col(diff)
    counted = files.withColumns(
        {
            "added_lines": diffs.added_lines(text),
            "removed_lines": diffs.removed_lines(text),
            "hunk_count": diffs.hunk_count(text),
        }
    )
    return counted.withColumn("changed_lines", F.col("added_lines") + F.col("removed_lines"))


def patch_text(files: DataFrame, diff: str = "diff") -> DataFrame:
    """Add the changed lines as diff_text, before_code and after_code."""
    text = F.col(diff)
    return files.withColumns(
        {
            "diff_text": diffs.diff_only(text),
            "before_code": diffs.before_code(text),
            "after_code": diffs.after_code(text),
        }
    )


def build_patches(files: DataFrame, *carry: str) -> DataFrame:
    """Patch rows: both path filters, language, counts and changed lines."""
    kept = file_change_rows(files, *carry).where(~skip_file(F.col("file_path")))
    tagged = kept.withColumn("language", detect_language(F.col("file_path")))
    return patch_text(patch_stats(tagged)).select(
        "repo_url", "commit_sha", "file_ord", *carry, "file_path", "language",
        "added_lines", "removed_lines", "changed_lines", "hunk_count",
        "diff_text", "before_code", "after_code",
    )
