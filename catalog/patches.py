"""Queries of the file side: path filter, diffs, patch rows, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sqltext as S
from catalog.fixtures import fixture, store
from catalog.registry import query
from fixweave.functions import paths
from fixweave.operators import lookups, patches as P

FILES = ["fx_file_change"]
_BIGINTS = ["added_lines", "removed_lines", "changed_lines", "hunk_count"]


def files(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_file_change")


def long_counts(df):
    return df.withColumns({c: F.col(c).cast("bigint") for c in _BIGINTS if c in df.columns})


_OLD_NEW, _NEW_OLD = S.choose("old_path", "new_path"), S.choose("new_path", "old_path")


@query(
    f"SELECT file_ord, {S.skip('old_path')} AS skip_old, {S.skip('new_path')} AS skip_new FROM fx_file_change", FILES
)
def skip_file(spark, sf_dir):
    return files(spark, sf_dir).select(
        "file_ord", paths.skip_file(F.col("old_path")).alias("skip_old"), paths.skip_file(F.col("new_path")).alias("skip_new")
    )


@query(
    f"SELECT repo_url, commit_sha, file_ord, old_path, new_path FROM (SELECT *, {_OLD_NEW} AS a, {_NEW_OLD} AS b FROM fx_file_change) WHERE NOT {S.skip('a')} AND NOT {S.skip('b')}",
    FILES,
)
def skip_file_old_new(spark, sf_dir):
    return P.drop_skipped_files(files(spark, sf_dir)).select("repo_url", "commit_sha", "file_ord", "old_path", "new_path")


_EXTENSIONS = {}
for _ext, _lang in paths.LANGUAGES.items():
    _EXTENSIONS.setdefault(_lang, []).append(f"'{_ext}'")


def language_sql(path: str) -> str:
    ext = rf"lower(regexp_extract(regexp_extract({path}, '[^/]*$'), '^.+(\.[^.]+)$', 1))"
    cases = " ".join(f"WHEN {ext} IN ({', '.join(exts)}) THEN '{lang}'" for lang, exts in _EXTENSIONS.items())
    return f"CASE {cases} ELSE 'unknown' END"


_LINES = f"""l AS (SELECT file_ord, unnest(ls) AS line, unnest(range(CAST(len(ls) AS BIGINT))) AS line_no FROM (SELECT file_ord, {S.lines('diff')} AS ls FROM fx_file_change WHERE diff <> '')),
t AS (SELECT *, CASE WHEN starts_with(line, '@@') THEN 'hunk' WHEN regexp_matches(line, '^(diff --git|index |--- |\\+\\+\\+ |new file mode|deleted file mode|similarity index|rename from|rename to)') THEN 'meta'
 WHEN line LIKE '+%' AND line NOT LIKE '+++%' THEN 'added' WHEN line LIKE '-%' AND line NOT LIKE '---%' THEN 'removed' ELSE 'context' END AS kind, substr(line, 2) AS content FROM l)"""
_STATS = f"""{_LINES},
s AS (SELECT file_ord, count(*) FILTER (WHERE kind = 'added') AS added_lines, count(*) FILTER (WHERE kind = 'removed') AS removed_lines, count(*) FILTER (WHERE kind IN ('added', 'removed')) AS changed_lines, count(*) FILTER (WHERE kind = 'hunk') AS hunk_count,
 string_agg(content, chr(10) ORDER BY line_no) FILTER (WHERE kind = 'removed') AS before_code, string_agg(content, chr(10) ORDER BY line_no) FILTER (WHERE kind = 'added') AS after_code,
 string_agg(CASE kind WHEN 'added' THEN '+ ' ELSE '- ' END || content, chr(10) ORDER BY line_no) FILTER (WHERE kind IN ('added', 'removed')) AS diff_text FROM t GROUP BY file_ord)"""
_COUNTS = "coalesce(added_lines, 0) AS added_lines, coalesce(removed_lines, 0) AS removed_lines, coalesce(changed_lines, 0) AS changed_lines, coalesce(hunk_count, 0) AS hunk_count"
_TEXTS = "coalesce(before_code, '') AS before_code, coalesce(after_code, '') AS after_code, coalesce(diff_text, '') AS diff_text"


@query(
    f"{_LINES}\nSELECT file_ord, line_no, kind, line, CASE WHEN kind IN ('added', 'removed') THEN content END AS content FROM t", FILES
)
def diff_lines(spark, sf_dir):
    lines = P.diff_lines(files(spark, sf_dir), "file_ord")
    return lines.withColumn("line_no", F.col("line_no").cast("bigint"))


@query(f"{_STATS}\nSELECT f.file_ord, {_COUNTS} FROM fx_file_change f LEFT JOIN s USING (file_ord)", FILES)
def patch_stats(spark, sf_dir):
    return long_counts(P.patch_stats(files(spark, sf_dir))).select("file_ord", *_BIGINTS)


@query(f"{_STATS}\nSELECT f.file_ord, {_TEXTS} FROM fx_file_change f LEFT JOIN s USING (file_ord)", FILES)
def patch_text(spark, sf_dir):
    return P.patch_text(files(spark, sf_dir)).select("file_ord", "before_code", "after_code", "diff_text")


@query(
    f"SELECT file_ord, {language_sql('p')} AS language FROM (SELECT file_ord, {_NEW_OLD} AS p FROM fx_file_change)", FILES
)
def detect_language(spark, sf_dir):
    path = paths.first_path(F.col("new_path"), F.col("old_path"))
    return files(spark, sf_dir).select("file_ord", paths.detect_language(path).alias("language"))


_KEPT = f"kept AS (SELECT * FROM (SELECT *, {_OLD_NEW} AS a, {_NEW_OLD} AS file_path FROM fx_file_change) WHERE NOT {S.skip('a')})"


@query(
    f"{_KEPT}\nSELECT repo_url, commit_sha, file_ord, file_path, coalesce(change_type, 'unknown') AS change_type, coalesce(diff, '') AS diff FROM kept",
    FILES,
)
def file_change_rows(spark, sf_dir):
    return P.file_change_rows(files(spark, sf_dir))


PATCHES = f"""{_STATS},
{_KEPT},
p AS (SELECT repo_url, commit_sha, file_ord, file_path, {language_sql('file_path')} AS language, {_COUNTS}, {_TEXTS} FROM kept LEFT JOIN s USING (file_ord) WHERE NOT {S.skip('file_path')})"""


@query(f"{PATCHES}\nSELECT * FROM p", FILES)
def build_patches(spark, sf_dir):
    return long_counts(P.build_patches(files(spark, sf_dir)))


# ---- lookups ------------------------------------------------------------------------
@query("SELECT * FROM fx_cve WHERE published BETWEEN '1996-01-01' AND '1997-12-31T23:59:59.999Z'", ["fx_cve"])
def cve_by_published(spark, sf_dir):
    first, last = "1996-01-01", "1997-12-31T23:59:59.999Z"
    return lookups.cve_by_published(store(spark, sf_dir).read("cve", first, last), first, last)


@query("SELECT * FROM fx_cve WHERE severity = 'CRITICAL'", ["fx_cve"])
def cve_by_severity(spark, sf_dir):
    return lookups.cve_by_severity(store(spark, sf_dir).read("cve"), "CRITICAL")


@query("SELECT severity, count(*) AS n FROM fx_cve GROUP BY severity", ["fx_cve"])
def severity_counts(spark, sf_dir):
    return lookups.severity_counts(fixture(spark, sf_dir, "fx_cve"))


@query(
    "SELECT v.*, l.repo_url, l.commit_sha, l.commit_url, l.method, l.confidence, c.commit_date, c.author, c.message FROM fx_cve v JOIN fx_cve_commit l USING (cve_id) JOIN fx_commits c ON c.repo_url = l.repo_url AND c.sha = l.commit_sha",
    ["fx_cve", "fx_cve_commit", "fx_commits"],
)
def cve_commit_lookup(spark, sf_dir):
    tables = [fixture(spark, sf_dir, name) for name in ("fx_cve", "fx_cve_commit", "fx_commits")]
    return lookups.cve_commit_lookup(*tables)


@query("SELECT * FROM fx_commits WHERE commit_date BETWEEN '2003-01-01' AND '2010-12-31'", ["fx_commits"])
def commits_by_date(spark, sf_dir):
    first, last = "2003-01-01", "2010-12-31"
    return lookups.commits_by_date(store(spark, sf_dir).read("commits", first, last), first, last)


@query(
    f"{PATCHES}\nSELECT p.*, c.commit_date, c.author FROM p JOIN fx_commits c ON c.repo_url = p.repo_url AND c.sha = p.commit_sha",
    ["fx_file_change", "fx_commits"],
)
def patches_of_commit(spark, sf_dir):
    patches = long_counts(P.build_patches(files(spark, sf_dir)))
    return lookups.patches_of_commits(patches, fixture(spark, sf_dir, "fx_commits"))


@query(
    """SELECT md5(CAST(f.file_ord AS VARCHAR)) AS function_id, f.repo_url, f.commit_sha, coalesce(f.new_path, f.old_path) AS file_path, 'f' || (f.file_ord % 7) AS method_name, f.diff AS vuln_function, c.commit_date, c.author
 FROM fx_file_change f JOIN fx_commits c ON c.repo_url = f.repo_url AND c.sha = f.commit_sha""",
    ["fx_file_change", "fx_commits"],
)
def functions_of_commit(spark, sf_dir):
    """Stored functions of every commit that is stored."""
    kept = store(spark, sf_dir)
    found = lookups.functions_of_commits(kept.read("functions"), kept.read("commits"))
    return found.select("function_id", "repo_url", "commit_sha", "file_path", "method_name", "vuln_function", "commit_date", "author")


@query(
    f"{PATCHES}\nSELECT language, count(*) AS files, CAST(sum(added_lines) AS BIGINT) AS added_lines, CAST(sum(removed_lines) AS BIGINT) AS removed_lines FROM p GROUP BY language",
    FILES,
)
def language_counts(spark, sf_dir):
    return lookups.language_counts(P.build_patches(files(spark, sf_dir)))
