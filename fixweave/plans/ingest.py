"""Batch ingest of one record release into the stored tables."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixweave import schemas
from fixweave.operators.links import commit_references, link_rows
from fixweave.operators.records import (
    OUTCOMES, best_cvss, drop_rejected, flatten_cve, good_records, ingest_counters, limit_processed, outcome,
    outcome_counts, parse_records,
)
from fixweave.plans.enrich import Landed, enrich_commits
from fixweave.session import staged, staged_with_counts
from fixweave.sources.store import TableStore, should_run

# ---- fixed value: name under which the record list is tracked
SOURCE_NAME = "official_cvelist"


def record_batches(accepted: DataFrame, order: list[str]) -> dict[str, tuple[DataFrame, Column]]:
    """Rows for the record and link tables from parsed, accepted records, with their arrival order."""
    return {
        "cve": (flatten_cve(accepted, *order), F.struct(*order)),
        "cve_commit": (link_rows(commit_references(accepted, *order)), F.struct(*order, "ref_ord")),
    }


def ingest_release(
    store: TableStore,
    raw: DataFrame,
    release_tag: str,
    order: list[str],
    source_name: str = SOURCE_NAME,
    limit: int | None = None,
    force: bool = False,
    landed: Landed | None = None,
) -> DataFrame | None:
    """Process record texts (column ``value``) of a release; returns the run counters.

    ``order`` names the columns that give the source order. Returns None when the
    release was processed before, unless ``force``. With ``limit`` reading stops
    after that many processed records (rejected and skipped ones do not count), and the release still counts as done.
    With ``landed`` commit data the stored backlog is enriched as well; the release
    counts as done only after that. Counters are taken along by the jobs that
    write: outcomes of records, and commits and patches saved.
    """
    if not should_run(store.read("sync_state"), source_name, release_tag, force):
        return None
    # Parsed once, read by both sinks.
    parsed = outcome(parse_records(raw)).select(*order, "record", "status", "outcome")
    parsed, counts = staged_with_counts(parsed, "parsed", **outcome_counts())
    accepted = drop_rejected(good_records(parsed))
    if limit is not None and counts["processed"] >= limit:
        first = staged(limit_processed(accepted.where("outcome = 'processed'").select(*order), limit, *order), "limit")
        at = first.agg(F.max(F.struct(*order)).alias("at")).head()["at"]
        if at is None:
            parsed, accepted = parsed.limit(0), accepted.limit(0)
        else:
            read = F.struct(*order) <= F.struct(*[F.lit(at[c]).alias(c) for c in order])
            parsed, accepted = parsed.where(read), accepted.where(read)
        # Records after the last one that was read are not counted.
        counts = ingest_counters(parsed).head().asDict()
    store.upsert(record_batches(accepted, order))
    saved = {"commits": 0, "patches": 0}
    if landed is not None:
        run = enrich_commits(store, *landed)
        saved = {"commits": run.counts["commits_saved"], "patches": run.counts["patches_saved"]}
    now = datetime.now(timezone.utc).isoformat()
    update = raw.sparkSession.createDataFrame([(source_name, release_tag, now)], schemas.SYNC_STATE)
    store.upsert({"sync_state": (update, F.col("synced_at"))})
    return raw.sparkSession.createDataFrame([{**counts, **saved}], ", ".join(f"{c} bigint" for c in [*OUTCOMES, *saved]))


def open_fixes(parsed: DataFrame, commits: DataFrame) -> DataFrame:
    """Fix commits of non-rejected records that are not fetched yet, by platform and severity.

    The severity travels with the links, so a record is parsed once and the
    record table is not joined to its own links.
    """
    accepted = drop_rejected(good_records(parsed)).withColumn("severity", best_cvss(F.col("record"))["severity"])
    links = commit_references(accepted, "severity").select(
        "cve_id", "repo_url", "commit_sha", "platform", F.coalesce("severity", F.lit("NONE")).alias("severity")
    )
    stored = commits.select("repo_url", F.col("sha").alias("commit_sha"))
    missing = links.distinct().join(stored, ["repo_url", "commit_sha"], "left_anti")
    return missing.groupBy("platform", "severity").agg(F.count("*").alias("open_links"))
