"""The reads the stored tables are laid out for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cve_by_published(cve: DataFrame, first: str, last: str) -> DataFrame:
    """Records published in a range of ISO texts, both ends included."""
    return cve.where(F.col("published").between(first, last))


def cve_by_severity(cve: DataFrame, severity: str) -> DataFrame:
    return cve.where(F.col("severity") == severity)


def severity_counts(cve: DataFrame) -> DataFrame:
    return cve.groupBy("severity").agg(F.count("*").alias("n"))


def cve_commit_lookup(cve: DataFrame, links: DataFrame, commits: DataFrame) -> DataFrame:
    """Records with their stored fix commits; filter on either side as needed.

    Filters given by the caller reach all three scans, since every join is on a key. Links
    meet their commits first: where records share an id, the rows that this makes are not
    shuffled once more.
    """
    named = commits.select(
        "repo_url", F.col("sha").alias("commit_sha"), "commit_date", "author", "message"
    )
    linked = links.join(named, ["repo_url", "commit_sha"])
    found = cve.join(linked, "cve_id")
    own = [name for name in (*cve.columns, *links.columns) if name not in ("cve_id", "repo_url", "commit_sha")]
    return found.select("repo_url", "commit_sha", "cve_id", *own, "commit_date", "author", "message")


def commits_by_date(commits: DataFrame, first: str, last: str) -> DataFrame:
    """Commits dated in a range of ISO texts, both ends included."""
    return commits.where(F.col("commit_date").between(first, last))


def patches_of_commit(patches: DataFrame, repo_url: str, commit_sha: str) -> DataFrame:
    return patches.where((F.col("repo_url") == repo_url) & (F.col("commit_sha") == commit_sha))


def patches_of_commits(patches: DataFrame, commits: DataFrame) -> DataFrame:
    """Patch rows of a table of commits, with the commit's date and author."""
    named = commits.select("repo_url", F.col("sha").alias("commit_sha"), "commit_date", "author")
    return patches.join(named, ["repo_url", "commit_sha"])


def functions_of_commit(functions: DataFrame, repo_url: str, commit_sha: str) -> DataFrame:
    """Function pairs of one commit; stored tables are cut into ranges of these columns."""
    return functions.where((F.col("repo_url") == repo_url) & (F.col("commit_sha") == commit_sha))


def functions_of_commits(functions: DataFrame, commits: DataFrame) -> DataFrame:
    """Function pairs of a table of commits, with the commit's date and author."""
    named = commits.select("repo_url", F.col("sha").alias("commit_sha"), "commit_date", "author")
    return functions.join(named, ["repo_url", "commit_sha"])


def language_counts(patches: DataFrame) -> DataFrame:
    """Files and changed lines per language."""
    return patches.groupBy("language").agg(
        F.count("*").alias("files"),
        F.sum("added_lines").alias("added_lines"),
        F.sum("removed_lines").alias("removed_lines"),
    )
