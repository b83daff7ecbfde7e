"""Constraints a relational store would enforce, as queries; and cascades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: rules of the stored tables
NOT_NULL = {
    "cve_commit": ["cve_id", "repo_url", "commit_sha"],
    "commits": ["repo_url", "sha"],
    "patch": ["repo_url", "commit_sha", "file_path"],
    "functions": ["repo_url", "commit_sha"],
}
UNIQUE = {
    "cve": [["cve_id"]],
    "cve_commit": [["cve_id", "repo_url", "commit_sha"]],
    "commits": [["repo_url", "sha"], ["commit_url"]],
    "patch": [["repo_url", "commit_sha", "file_path"]],
}
FOREIGN = [
    ("cve_commit", ["cve_id"], "cve", ["cve_id"]),
    ("patch", ["repo_url", "commit_sha"], "commits", ["repo_url", "sha"]),
    ("functions", ["repo_url", "commit_sha"], "commits", ["repo_url", "sha"]),
]


def _all_known(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def _probe(check: str, table: str, columns: list[str], key: list[str], used: int, asked: Column) -> Column:
    """One probe of a row, NULL where the rule does not ask about it. ``used`` is 0 where the row only proves a key."""
    return F.when(
        asked,
        F.struct(
            F.lit(check).alias("check"), F.lit(table).alias("table"), F.lit(",".join(columns)).alias("columns"),
            F.array(*[F.col(c).cast("string") for c in key]).alias("key"), F.lit(used).cast("bigint").alias("used"),
        ),
    )


def _probes(table: str, tables: dict[str, DataFrame]) -> list[Column]:
    """What the rules want to know of a row of ``table``."""
    out = []
    if table in NOT_NULL:
        out.append(_probe("not_null", table, NOT_NULL[table], NOT_NULL[table], 1, ~_all_known(NOT_NULL[table])))
    for columns in UNIQUE.get(table, []):
        out.append(_probe("unique", table, columns, columns, 1, _all_known(columns)))
    for child, columns, parent, parent_columns in FOREIGN:
        if child in tables and parent in tables:
            if table == child:
                out.append(_probe("foreign_key", child, columns, columns, 1, _all_known(columns)))
            if table == parent:
                out.append(_probe("foreign_key", child, columns, parent_columns, 0, _all_known(parent_columns)))
    if table == "functions":
        out.append(_probe("empty_repo_url", table, ["repo_url"], ["repo_url"], 1, F.col("repo_url") == ""))
    return out


def integrity_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """Violations as rows: check, table, columns, key, n; only given tables are checked.

    Every table is read once: its rows are turned into one probe per rule, and
    all probes meet in one aggregation by rule and key. Probes are counted before
    they are exchanged, so one key with very many rows is cheap, and no table is
    joined to another.
    """
    asked = [
        df.select(F.explode(F.filter(F.array(*probes), lambda p: p.isNotNull())).alias("p")).select("p.*")
        for name, df in tables.items() if (probes := _probes(name, tables))
    ]
    rule = ["check", "table", "columns"]
    found = reduce(DataFrame.unionByName, asked).groupBy(*rule, "key").agg(
        F.sum("used").alias("n"), F.count_if(F.col("used") == 0).alias("proofs")
    )
    broken = (
        F.when(F.col("check") == "unique", F.col("n") > 1)
        .when(F.col("check") == "foreign_key", (F.col("n") > 0) & (F.col("proofs") == 0))
        .otherwise(F.lit(True))
    )
    key = F.array_join("key", "|", "<null>")
    return found.where(broken).select(*rule, key.alias("key"), "n")


def cascade_delete(tables: dict[str, DataFrame], table: str, doomed: DataFrame) -> dict[str, DataFrame]:
    """Tables without the rows of ``doomed`` keys and without what hangs on them.

    ``table`` is cve (key cve_id) or commits (key repo_url, sha).
    """
    parent_keys = {"cve": ["cve_id"], "commits": ["repo_url", "sha"]}[table]
    keys = doomed.select(*parent_keys)
    result = dict(tables)
    result[table] = tables[table].join(keys, parent_keys, "left_anti").select(*tables[table].columns)
    for child, columns, parent, _ in FOREIGN:
        if parent == table and child in tables:
            renamed = keys.select(*[F.col(p).alias(c) for p, c in zip(parent_keys, columns)])
            result[child] = tables[child].join(renamed, columns, "left_anti").select(*tables[child].columns)
    return result


def cascade_update(tables: dict[str, DataFrame], table: str, renames: DataFrame) -> dict[str, DataFrame]:
    """Rewrite keys in ``table`` and in the dependents that follow an update.

    ``renames`` has the key columns with the prefixes ``old_`` and ``new_``, one
    row per old key. Function rows do not follow a changed commit key.
    """
    parent_keys = {"cve": ["cve_id"], "commits": ["repo_url", "sha"]}[table]
    follows = {"cve": [("cve_commit", ["cve_id"])], "commits": [("patch", ["repo_url", "commit_sha"])]}[table]
    result = dict(tables)
    for name, columns in [(table, parent_keys), *follows]:
        if name not in tables:
            continue
        mapping = renames.select(
            *[F.col(f"old_{p}").alias(c) for p, c in zip(parent_keys, columns)],
            *[F.col(f"new_{p}").alias(f"_new_{c}") for p, c in zip(parent_keys, columns)],
        )
        rewritten = [
            F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in tables[name].columns
        ]
        result[name] = tables[name].join(mapping, columns, "left").select(*rewritten)
    return result
