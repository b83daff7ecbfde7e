"""Outcomes of commit fetches, read from landed tables instead of from git."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixweave.functions.urls import detect_platform

# ---- fixed values: reasons, and phrases that mean a repository is closed to us
INACCESSIBLE = "repo_inaccessible"
NOT_FOUND = "commit_not_found"
FETCH_FAILED = "commit_fetch_failed"
UNSUPPORTED = "unsupported_platform"
FETCH_PHRASES = [
    "could not read username", "authentication failed", "repository not found", "terminal prompts disabled",
]
LAX_FETCH_PHRASES = [*FETCH_PHRASES, "project not found", "access denied"]
ACCESS_PHRASES = [
    "could not read username", "authentication failed", "repository not found", "fatal: could not",
    "terminal prompts disabled", "support for password authentication was removed", "project not found",
    "access denied", "not enough permissions",
]


def has_phrase(message: Column, phrases: list[str]) -> Column:
    return F.coalesce(F.lower(message).rlike("|".join(phrases)), F.lit(False))


def fetch_reason(message: Column, lax: bool = False) -> Column:
    """Skip reason of an error raised while a commit was fetched."""
    closed = has_phrase(message, LAX_FETCH_PHRASES if lax else FETCH_PHRASES)
    return F.when(closed, INACCESSIBLE).otherwise(FETCH_FAILED)


def classify_fetch(log: DataFrame, lax: bool = False) -> DataFrame:
    """Add ``skip_reason`` (NULL when ok) and ``is_private`` to fetch log rows.

    A failed access check always makes the repository inaccessible; its message
    only tells whether it is closed to us (``is_private``) or out of reach.
    """
    is_access = F.col("phase") == "access"
    reason = F.when(is_access, F.lit(INACCESSIBLE)).otherwise(fetch_reason(F.col("message"), lax))
    if lax:
        reason = F.when(detect_platform(F.col("repo_url")).isNull(), UNSUPPORTED).otherwise(reason)
        failed = ~F.col("ok") | detect_platform(F.col("repo_url")).isNull()
    else:
        failed = ~F.col("ok")
    private = F.when(is_access, has_phrase(F.col("message"), ACCESS_PHRASES)).otherwise(
        has_phrase(F.col("message"), LAX_FETCH_PHRASES if lax else FETCH_PHRASES)
    )
    return log.withColumn("skip_reason", F.when(failed, reason)).withColumn(
        "is_private", F.coalesce(failed & private, F.lit(False))
    )


def repo_access_table(log: DataFrame) -> DataFrame:
    """One access result per repository: the first check of the log, as a run reuses it."""
    checks = log.where(F.col("phase") == "access")
    first = checks.groupBy("repo_url").agg(F.min(F.struct("seq", "ok", "message")).alias("check"))
    return first.select("repo_url", F.col("check.ok").alias("accessible"), F.col("check.message").alias("message"))


def with_access(backlog: DataFrame, access: DataFrame) -> DataFrame:
    """Backlog rows with the access result of their repository, NULL if never checked."""
    return backlog.join(access.select("repo_url", "accessible"), "repo_url", "left")


def sha_exact(fetched: DataFrame) -> DataFrame:
    """Keep fetched commits whose full hash is the hash that was asked for."""
    return fetched.where(F.col("full_sha") == F.col("commit_sha"))


def commit_outcome(fetched: DataFrame) -> DataFrame:
    """Add ``skip_reason`` to landed commits; NULL means the commit is usable.

    Rows that went through ``with_access`` fail with their repository.
    """
    reason = (
        F.when(F.col("error").isNotNull(), fetch_reason(F.col("error")))
        .when(F.coalesce(F.col("full_sha") == F.col("commit_sha"), F.lit(False)), F.lit(None).cast("string"))
        .otherwise(NOT_FOUND)
    )
    if "accessible" in fetched.columns:
        reason = F.when(F.col("accessible") == F.lit(False), INACCESSIBLE).otherwise(reason)
    return fetched.withColumn("skip_reason", reason)


def enrich_counts() -> dict[str, Column]:
    """Aggregates over an ``skip_reason`` column: commits found, saved and failed."""
    failed = F.col("skip_reason").isNotNull()
    return {"commits_found": F.count("*"), "commits_saved": F.count_if(~failed), "commits_failed": F.count_if(failed)}


def enrich_counters(outcomes: DataFrame, patches: DataFrame) -> DataFrame:
    """One row: commits found, saved and failed, and patches saved."""
    zero = F.lit(0).cast("bigint")
    found = outcomes.agg(*[column.alias(name) for name, column in enrich_counts().items()])
    saved = patches.agg(F.count("*").alias("patches_saved"))
    both = found.withColumn("patches_saved", zero).unionByName(saved.select(*[zero.alias(c) for c in found.columns], "patches_saved"))
    return both.agg(*[F.sum(name).alias(name) for name in both.columns])
