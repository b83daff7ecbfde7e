"""Batch enrichment: from the backlog and landed commit data to stored rows."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixweave import schemas
from fixweave.operators.fetch import commit_outcome, enrich_counts, repo_access_table, sha_exact, with_access
from fixweave.operators.links import backlog
from fixweave.operators.merge import append_functions, with_row_id
from fixweave.operators.methods import (
    COMMIT_KEYS, dedup_functions, function_counters, functions_of_blocks, meaningful_pairs, pair_blocks,
)
from fixweave.operators.patches import build_patches
from fixweave.session import staged, staged_with_counts
from fixweave.sources.store import TableStore

# What is wrong with a landed text, as told in the errors of a commit.
BAD_DIFF = "diff is not valid UTF-8"
BAD_SOURCE = "source is not valid UTF-8"


class Landed(NamedTuple):
    """Landed tables of fetched commits; the log of fetches may be left out."""

    fetched: DataFrame
    files: DataFrame
    spans: DataFrame
    log: DataFrame | None = None


@dataclass
class Enriched:
    """New rows of one enrichment run, before they are merged, and its counters.

    ``errors`` has a row per commit that was stored without its patches, or
    without the functions of some of its files.
    """

    outcomes: DataFrame
    commits: DataFrame
    patches: DataFrame
    functions: DataFrame
    function_stats: DataFrame
    errors: DataFrame
    counts: dict[str, int]

    def counters(self) -> DataFrame:
        """One row: commits found, saved and failed, and patches saved."""
        schema = ", ".join(f"{name} bigint" for name in self.counts)
        return self.outcomes.sparkSession.createDataFrame([tuple(self.counts.values())], schema)


def enrich(
    wanted: DataFrame, fetched: DataFrame, files: DataFrame, spans: DataFrame, log: DataFrame | None = None
) -> Enriched:
    """Rows for the commits of a backlog from the landed tables.

    Failed commits are not stored and so stay in the backlog. With a fetch
    ``log``, commits of repositories whose access check failed are failed too.
    A commit listed under two URLs yields its function rows twice (see ``backlog``).

    A commit whose landed texts are broken is stored all the same: one bad diff
    costs it its patch rows, a bad source text the functions of that file.
    """
    asked = wanted.join(fetched, COMMIT_KEYS, "left")
    if log is not None:
        asked = with_access(asked, repo_access_table(log))
    outcomes, counts = staged_with_counts(commit_outcome(asked), "outcomes", **enrich_counts())
    usable = sha_exact(outcomes.where(F.col("skip_reason").isNull()))
    commits = usable.select(
        "repo_url", F.col("commit_sha").alias("sha"), "commit_url",
        F.coalesce("commit_date", F.lit("")).alias("commit_date"), "message",
        F.coalesce("author", F.lit("unknown")).alias("author"),
    )
    urls = usable.select(*COMMIT_KEYS, "commit_url")
    times = urls.groupBy(*COMMIT_KEYS).agg(F.count("*").alias("_times"))

    # File texts are not joined here: patches need the diff only, and functions
    # pick up the texts once their spans are chosen.
    narrow_files = files.drop("source_before", "source_after").join(times, COMMIT_KEYS)
    bad_diff = F.coalesce(~F.is_valid_utf8("diff"), F.lit(False))
    patches = build_patches(narrow_files.withColumn("bad_diff", bad_diff), "bad_diff", "_times")
    patches = with_row_id(patches, "patch_id", schemas.KEYS["patch"])
    saving = {"patches_saved": F.sum("_times"), "bad": F.count_if("bad_diff")}
    patches, saved = staged_with_counts(patches, "patches", **saving)
    diff_errors = patches.where("bad_diff").select(*COMMIT_KEYS, F.lit(BAD_DIFF).alias("patch_error")).distinct()
    if saved["bad"]:
        patches, saved = staged_with_counts(patches.join(diff_errors, COMMIT_KEYS, "left_anti"), "patches", **saving)

    todo_spans = spans.join(times, COMMIT_KEYS, "left_semi")
    blocks = staged(pair_blocks(files, todo_spans), "blocks")
    pairs = staged(functions_of_blocks(blocks), "pairs")
    functions = dedup_functions(meaningful_pairs(pairs)).join(urls, COMMIT_KEYS)
    source_errors = blocks.where("not readable").select(*COMMIT_KEYS, F.lit(BAD_SOURCE).alias("function_error")).distinct()
    return Enriched(
        outcomes, commits, patches.drop("bad_diff", "_times"), functions, function_counters(pairs),
        diff_errors.join(source_errors, COMMIT_KEYS, "full"), {**counts, "patches_saved": saved["patches_saved"]},
    )


def enrich_commits(
    store: TableStore,
    fetched: DataFrame,
    files: DataFrame,
    spans: DataFrame,
    log: DataFrame | None = None,
    limit: int | None = None,
    unique_commit: bool = False,
) -> Enriched:
    """Run the enrichment of the stored backlog and publish the new rows.

    A backlog holds commits without stored rows, so all of them are additions
    and the stored tables are not copied.
    """
    wanted = staged(backlog(store.read("cve_commit"), store.read("commits"), limit, unique_commit=unique_commit), "backlog")
    run = enrich(wanted, fetched, files, spans, log)
    empty = store.read("functions").limit(0)
    store.upsert(
        {"commits": (run.commits, F.col("commit_url")), "patch": (run.patches, F.col("file_ord"))},
        added={"functions": append_functions(empty, run.functions, ["commit_url"])},
    )
    return run
