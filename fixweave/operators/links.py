"""Commit links of vulnerability records, and the commits still to be fetched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixweave.frames import computed
from fixweave.functions.urls import parse_commit_url, reference_kind
from fixweave.operators.records import cve_id, reference_urls

# ---- fixed values: how a link was found and how sure it is
METHOD = "reference_url"
CONFIDENCE = 1.0


def reference_rows(parsed: DataFrame, *carry: str) -> DataFrame:
    """Long form of the references: one row per URL with its kind and position."""
    record = F.col("record")
    return (
        parsed.select(*carry, cve_id(record).alias("cve_id"), F.posexplode(reference_urls(record)).alias("ref_ord", "url"))
        .withColumn("kind", reference_kind(F.col("url")))
    )


def commit_references(parsed: DataFrame, *carry: str) -> DataFrame:
    """Links to commits on known hosts: cve_id, repo_url, commit_sha, commit_url, platform."""
    commits = reference_rows(parsed, *carry).where(F.col("kind") == "commit")
    return (
        computed(commits, {"link": parse_commit_url(F.col("url"))})
        .where(F.col("link").isNotNull())
        .select(
            *carry, "cve_id", "ref_ord",
            F.col("link.repo_url").alias("repo_url"),
            F.col("link.commit_hash").alias("commit_sha"),
            F.col("url").alias("commit_url"),
            F.col("link.platform").alias("platform"),
        )
    )


def link_rows(references: DataFrame) -> DataFrame:
    """Rows of the link table, before they are merged."""
    return references.withColumn("method", F.lit(METHOD)).withColumn("confidence", F.lit(CONFIDENCE))


def backlog(
    links: DataFrame,
    commits: DataFrame,
    limit: int | None = None,
    seed: int = 0,
    unique_commit: bool = False,
) -> DataFrame:
    """Linked commits that are not stored yet: repo_url, commit_sha, commit_url.

    Links are made distinct first, so that a commit with very many links is
    reduced before anything is shuffled by commit. With ``limit`` the rows are
    drawn in an order that is random with respect to their content but
    repeatable. ``unique_commit`` keeps one URL per commit; without it a commit
    that is linked under two URLs appears twice.
    """
    keys = ["repo_url", "commit_sha"]
    if unique_commit:
        wanted = links.groupBy(*keys).agg(F.min("commit_url").alias("commit_url"))
    else:
        wanted = links.select(*keys, "commit_url").distinct()
    stored = commits.select("repo_url", F.col("sha").alias("commit_sha"))
    missing = wanted.join(stored, keys, "left_anti")
    if limit is None:
        return missing
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), *keys, "commit_url"))
    return missing.orderBy(draw, *keys, "commit_url").limit(limit)
