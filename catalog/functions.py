"""Queries of the function side: names, spans, code blocks, pairing, fetches, merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import sqltext as S
from catalog import patches as file_side
from catalog.fixtures import base, bucketed, fixture
from catalog.registry import query
from fixweave.functions import code as C
from fixweave.functions.pytext import raw_lines, line_total
from fixweave.operators import audit, fetch, merge, methods, pairing
from fixweave.operators import patches as P
from fixweave.plans.enrich import enrich
from fixweave.plans import enrich as enrich_plan
from fixweave.session import scratch_folder
from fixweave.sources.store import TableStore

PAIR = ["fx_function_pair"]
SPAN = ["fx_method_span"]
BLOCK = ["fx_code_block"]

# ---- names and spans ---------------------------------------------------------------
_NAMES = """SELECT doc_id, CASE doc_id % 12 WHEN 0 THEN '(anonymous)' WHEN 1 THEN ' Anonymous ' WHEN 2 THEN '<anonymous>' WHEN 3 THEN 'UNKNOWN' WHEN 4 THEN '' WHEN 5 THEN '  ' WHEN 6 THEN '+'
 WHEN 7 THEN 'a1b2' WHEN 8 THEN 'operator==' WHEN 9 THEN CAST(NULL AS STRING) WHEN 10 THEN 'f' || CAST(doc_id AS STRING) ELSE source || '::' || lang END AS name FROM documents"""


@query(
    f"SELECT doc_id, name, coalesce(trim(name) <> '' AND lower(trim(name)) NOT IN ({S.PLACEHOLDERS}) AND regexp_matches(name, '[a-zA-Z][a-zA-Z]'), false) AS valid FROM ({_NAMES})"
)
def valid_method_name(spark, sf_dir):
    base(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return spark.sql(_NAMES).withColumn("valid", C.valid_method_name(F.col("name")))


@query("SELECT *, coalesce(start_line > 0 AND end_line >= start_line, false) AS valid FROM fx_method_span", SPAN)
def valid_line_range(spark, sf_dir):
    spans = fixture(spark, sf_dir, "fx_method_span")
    return spans.withColumn("valid", C.valid_line_range(F.col("start_line"), F.col("end_line")))


# The sides are made first, so that no plan can join all spans with each other.
_HALVES = "cs AS MATERIALIZED (SELECT * FROM fx_method_span WHERE side = 'changed'),\nbs AS MATERIALIZED (SELECT * FROM fx_method_span WHERE side = 'before')"
_SIDES = "FROM cs c JOIN bs b ON c.file_ord = b.file_ord AND c.ord = b.ord"
_BOUNDS = ("c.start_line", "c.end_line", "b.start_line", "b.end_line")


def _aligned(spark, sf_dir):
    spans = fixture(spark, sf_dir, "fx_method_span")
    changed = spans.where("side = 'changed'").alias("c")
    return changed.join(spans.where("side = 'before'").alias("b"), ["file_ord", "ord"])


@query(f"{_HALVES}\nSELECT c.file_ord, c.ord, CAST({S.overlap(*_BOUNDS)} AS BIGINT) AS line_overlap {_SIDES}", SPAN)
def line_overlap(spark, sf_dir):
    return _aligned(spark, sf_dir).select("file_ord", "ord", C.line_overlap(*[F.col(b) for b in _BOUNDS]).alias("line_overlap"))


@query(f"{_HALVES}\nSELECT c.file_ord, c.ord, CAST({S.distance(*_BOUNDS)} AS BIGINT) AS line_distance {_SIDES}", SPAN)
def line_distance(spark, sf_dir):
    return _aligned(spark, sf_dir).select("file_ord", "ord", C.line_distance(*[F.col(b) for b in _BOUNDS]).alias("line_distance"))


# ---- code text ------------------------------------------------------------------------
def _cut(source: str, start: str, end: str, view: str, keep: str) -> str:
    """CTEs that cut a block, drop its left-over and blank lines, and name it ``code``."""
    return f"""l0 AS (SELECT {keep}, {start} AS a, {end} AS b, {S.lines(source)} AS ls FROM {view} WHERE {source} <> ''),
l1 AS (SELECT *, CASE WHEN a > 0 AND b >= a AND a <= len(ls) THEN ls[a:least(b, len(ls))] END AS part FROM l0),
l2 AS (SELECT *, CASE WHEN part[-1] = '' THEN part[1:len(part) - 1] ELSE part END AS p2 FROM l1 WHERE part IS NOT NULL),
l3 AS (SELECT *, {S.tail_from('p2', f"NOT regexp_matches(x, '{S.JUNK}')")} AS p3 FROM l2),
l4 AS (SELECT *, {S.tail_from('p3', f"regexp_matches(x, '{S.NOT_WS}')")} AS p4 FROM l3),
cut AS (SELECT *, nullif(array_to_string(p4, chr(10)), '') AS code FROM l4)"""


@query(
    f"{_cut('source', 'start_line', 'end_line', 'fx_code_block', 'doc_id')}\nSELECT f.doc_id, c.code FROM fx_code_block f LEFT JOIN cut c USING (doc_id)",
    BLOCK,
)
def code_block(spark, sf_dir):
    staged_lines = fixture(spark, sf_dir, "fx_code_block").withColumn("lines", raw_lines(F.col("source")))
    return staged_lines.select("doc_id", C.code_block(F.col("lines"), F.col("start_line"), F.col("end_line")).alias("code"))


@query(
    f"""l2 AS (SELECT doc_id, {S.lines('block')} AS p2 FROM fx_code_block),
l3 AS (SELECT *, {S.tail_from('p2', f"NOT regexp_matches(x, '{S.JUNK}')")} AS p3 FROM l2)
SELECT doc_id, array_to_string({S.tail_from('p3', f"regexp_matches(x, '{S.NOT_WS}')")}, chr(10)) AS code FROM l3""",
    BLOCK,
)
def clean_code(spark, sf_dir):
    lines = fixture(spark, sf_dir, "fx_code_block").withColumn("lines", raw_lines(F.col("block")))
    # The whole block as one span: line breaks become plain line feeds.
    whole = F.array_join(F.slice("lines", 1, line_total(F.col("lines"))), "\n")
    return lines.select("doc_id", C.clean_code(F.concat(whole, F.lit("\n"))).alias("code"))


@query(
    f"""s AS (SELECT doc_id, list_filter({S.lines('block')}, lambda x: regexp_matches(x, '{S.NOT_WS}'))[1] AS line FROM fx_code_block)
SELECT doc_id, coalesce(NOT regexp_matches(regexp_replace(line, '^{S.WS}+', ''), '{S.BLOCK_START}'), false) AS ok FROM s""",
    BLOCK,
)
def looks_like_function(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_code_block").select("doc_id", C.looks_like_function(F.col("block")).alias("ok"))


@query("SELECT ord FROM fx_function_pair WHERE vuln_function IS NOT NULL AND patch_function IS NOT NULL", PAIR)
def complete_pair(spark, sf_dir):
    return methods.complete_pairs(fixture(spark, sf_dir, "fx_function_pair")).select("ord")


_REASON = S.reason("vuln_function", "patch_function")


@query(f"SELECT ord, {_REASON} AS reason FROM fx_function_pair", PAIR)
def meaningful_change(spark, sf_dir):
    return methods.tag_change(fixture(spark, sf_dir, "fx_function_pair")).select("ord", "reason")


# ---- pairing --------------------------------------------------------------------------
def _ranked(other: str, prefix: str, exact: bool) -> str:
    bounds = (f"o.start_line", f"o.end_line", "c.start_line", "c.end_line")
    first = "CASE WHEN o.start_line IS NOT DISTINCT FROM c.start_line AND o.end_line IS NOT DISTINCT FROM c.end_line THEN 0 ELSE 1 END, " if exact else ""
    return (
        f"{prefix} AS (SELECT c.file_ord, c.ord, c.name, c.start_line, c.end_line, o.ord AS {prefix}_ord, o.start_line AS {prefix}_start, o.end_line AS {prefix}_end"
        f" FROM fx_method_span c JOIN fx_method_span o ON o.file_ord = c.file_ord AND o.name = c.name AND o.side = '{other}' WHERE c.side = 'changed'"
        f" QUALIFY row_number() OVER (PARTITION BY c.file_ord, c.ord ORDER BY {first}{S.overlap(*bounds)} DESC, {S.distance(*bounds)}, o.ord) = 1)"
    )


_BEFORE, _AFTER = _ranked("before", "before", False), _ranked("after", "after", True)


def _spans(spark, sf_dir, side):
    return fixture(spark, sf_dir, "fx_method_span").where(F.col("side") == side).drop("side")


def _before(spark, sf_dir, **kw):
    return pairing.pair_before(_spans(spark, sf_dir, "changed"), _spans(spark, sf_dir, "before"), ["file_ord"], **kw)


def _after(spark, sf_dir, **kw):
    return pairing.pair_after(_spans(spark, sf_dir, "changed"), _spans(spark, sf_dir, "after"), ["file_ord"], **kw)


@query(f"{_BEFORE}\nSELECT * FROM before", SPAN)
def pair_before(spark, sf_dir):
    return _before(spark, sf_dir)


@query(f"{_AFTER}\nSELECT * FROM after", SPAN)
def pair_after(spark, sf_dir):
    return _after(spark, sf_dir)


@query(f"{_BEFORE}\nSELECT * FROM before", SPAN)
def pair_before_wide(spark, sf_dir):
    """The search for wide name groups, used for all groups; these tables hold none that it cuts into blocks."""
    return _before(spark, sf_dir, wide_from=0)


@query(f"{_AFTER}\nSELECT * FROM after", SPAN)
def pair_after_wide(spark, sf_dir):
    return _after(spark, sf_dir, wide_from=0)


_MATCH_BOUNDS = ("before_start", "before_end", "after_start", "after_end")
_BOTH = f"""{_BEFORE},
{_AFTER},
both_sides AS (SELECT b.*, after_ord, after_start, after_end FROM before b JOIN after a USING (file_ord, ord))"""


@query(
    f"{_BOTH}\nSELECT * FROM both_sides WHERE trim(name) <> '' AND ({S.overlap(*_MATCH_BOUNDS)} > 0 OR {S.distance(*_MATCH_BOUNDS)} <= 15)",
    SPAN,
)
def pair_match(spark, sf_dir):
    spans = fixture(spark, sf_dir, "fx_method_span")
    return pairing.pair_match(pairing.pair_sides(_spans(spark, sf_dir, "changed"), spans, ["file_ord"]))


@query(
    "SELECT s.file_ord, s.side, s.ord, f.source_before, f.source_after FROM fx_source_span s JOIN fx_source_file f USING (repo_url, commit_sha, file_ord)",
    ["fx_source_span", "fx_source_file"],
)
def attach_source(spark, sf_dir):
    spans = fixture(spark, sf_dir, "fx_source_span")
    sourced = methods.attach_source(spans, fixture(spark, sf_dir, "fx_source_file"))
    return sourced.select("file_ord", "side", "ord", "source_before", "source_after")


@query(
    """p AS (SELECT c.file_ord, 'f' || (c.file_ord % 3) AS file_path, c.name AS method_name, b.start_line AS vuln_start_line, b.end_line AS vuln_end_line, c.start_line AS patched_start_line, c.end_line AS patched_end_line, c.ord
 FROM fx_method_span c JOIN fx_method_span b ON c.file_ord = b.file_ord AND c.ord = b.ord AND c.side = 'changed' AND b.side = 'before')
SELECT 'r' || (file_ord % 50) AS repo_url, 's' || (file_ord % 50) AS commit_sha, file_path, method_name, vuln_start_line, vuln_end_line, patched_start_line, patched_end_line,
 arg_min(file_ord, file_ord * 100 + ord) AS file_ord, arg_min(ord, file_ord * 100 + ord) AS ord FROM p GROUP BY 1, 2, 3, 4, 5, 6, 7, 8""",
    SPAN,
)
def dedup_spans(spark, sf_dir):
    # Many files share a path, so that spans repeat inside a commit.
    rows = _aligned(spark, sf_dir).select(
        F.expr("'r' || (file_ord % 50)").alias("repo_url"), F.expr("'s' || (file_ord % 50)").alias("commit_sha"),
        F.expr("'f' || (file_ord % 3)").alias("file_path"), F.col("c.name").alias("method_name"), "file_ord", "ord",
        F.col("b.start_line").alias("vuln_start_line"), F.col("b.end_line").alias("vuln_end_line"),
        F.col("c.start_line").alias("patched_start_line"), F.col("c.end_line").alias("patched_end_line"),
    )
    return methods.dedup_spans(rows)


@query(
    """e AS (SELECT *, coalesce(length(vuln_function) = length(patch_function), false) AS eq FROM fx_function_pair),
 n AS (SELECT *, count(*) FILTER (WHERE eq) OVER (PARTITION BY file_path) AS k FROM e)
SELECT ord, file_path FROM n WHERE NOT (eq AND k > 10)""",
    PAIR,
)
def drop_bulk_refactor(spark, sf_dir):
    pairs = fixture(spark, sf_dir, "fx_function_pair")
    return methods.drop_bulk_refactor(pairs, ["file_path"]).select("ord", "file_path")


_KEYED = ["commit_id", "file_path", "method_name", "vuln_start_line"]


@query(
    f"SELECT ord, commit_id, file_path, method_name, vuln_start_line, patch_function FROM fx_function_pair WHERE vuln_function IS NOT NULL AND patch_function IS NOT NULL AND {_REASON} IS NULL"
    " QUALIFY row_number() OVER (PARTITION BY commit_id, file_path, method_name, vuln_start_line ORDER BY ord) = 1",
    PAIR,
)
def dedup_functions(spark, sf_dir):
    pairs = methods.meaningful_pairs(methods.complete_pairs(fixture(spark, sf_dir, "fx_function_pair")))
    return methods.dedup_functions(pairs, _KEYED, ("ord",)).select("ord", *_KEYED, "patch_function")


@query(
    f"""t AS (SELECT *, {_REASON} IS NULL AS fine FROM fx_function_pair WHERE vuln_function IS NOT NULL AND patch_function IS NOT NULL),
 k AS (SELECT *, row_number() OVER (PARTITION BY fine, commit_id, file_path, method_name, vuln_start_line ORDER BY ord) AS rn FROM t)
SELECT commit_id, count(*) FILTER (WHERE fine AND rn = 1) AS saved, count(*) FILTER (WHERE NOT fine) AS skipped_whitespace, count(*) FILTER (WHERE fine AND rn > 1) AS skipped_duplicate FROM k GROUP BY commit_id""",
    PAIR,
)
def function_counters(spark, sf_dir):
    return methods.function_counters(fixture(spark, sf_dir, "fx_function_pair"), ["commit_id"], _KEYED)


# ---- whole function pairing ----------------------------------------------------------
_KEY = "repo_url, commit_sha, file_ord"


def _span_rank(other: str, exact: bool) -> str:
    bounds = ("o.start_line", "o.end_line", "c.start_line", "c.end_line")
    first = "CASE WHEN o.start_line IS NOT DISTINCT FROM c.start_line AND o.end_line IS NOT DISTINCT FROM c.end_line THEN 0 ELSE 1 END, " if exact else ""
    return (
        f"{other}_best AS (SELECT c.repo_url, c.commit_sha, c.file_ord, c.ord, c.name, o.start_line AS {other}_start, o.end_line AS {other}_end"
        f" FROM fx_source_span c JOIN fx_source_span o USING ({_KEY}, name) WHERE c.side = 'changed' AND o.side = '{other}'"
        f" QUALIFY row_number() OVER (PARTITION BY {_KEY}, c.ord ORDER BY {first}{S.overlap(*bounds)} DESC, {S.distance(*bounds)}, o.ord) = 1)"
    )


def _block_cte(name: str, source: str, start: str, end: str) -> str:
    steps = _cut(source, start, end, "firsts", f"{_KEY}, ord")
    for step in ("l0", "l1", "l2", "l3", "l4", "cut"):
        steps = steps.replace(f"{step} AS", f"{name}_{step} AS").replace(f"FROM {step}", f"FROM {name}_{step}")
    return steps


def _starts_well(code: str) -> str:
    line = f"list_filter({S.lines(code)}, lambda x: regexp_matches(x, '{S.NOT_WS}'))[1]"
    return f"NOT regexp_matches(regexp_replace({line}, '^{S.WS}+', ''), '{S.BLOCK_START}')"


STRICT = f"""{_span_rank('before', False)},
{_span_rank('after', True)},
chosen AS (SELECT {_KEY}, b.ord, trim(b.name) AS method_name, before_start, before_end, after_start, after_end, {S.choose('f.old_path', 'f.new_path')} AS file_path, source_before, source_after
 FROM before_best b JOIN after_best a USING ({_KEY}, ord) JOIN fx_source_file f USING ({_KEY})
 WHERE source_before <> '' AND source_after <> '' AND NOT {S.skip(S.choose('f.old_path', 'f.new_path'))}
 AND ({S.overlap(*_MATCH_BOUNDS)} > 0 OR {S.distance(*_MATCH_BOUNDS)} <= 15) AND lower(trim(b.name)) NOT IN ({S.PLACEHOLDERS}) AND regexp_matches(b.name, '[a-zA-Z][a-zA-Z]')
 AND before_start > 0 AND before_end >= before_start AND after_start > 0 AND after_end >= after_start),
firsts AS (SELECT * FROM chosen QUALIFY row_number() OVER (PARTITION BY repo_url, commit_sha, file_path, method_name, before_start, before_end, after_start, after_end ORDER BY file_ord, ord) = 1),
{_block_cte('v', 'source_before', 'before_start', 'before_end')},
{_block_cte('p', 'source_after', 'after_start', 'after_end')},
codes AS (SELECT f.repo_url, f.commit_sha, f.file_ord, f.ord, f.file_path, f.method_name, before_start AS vuln_start_line, before_end AS vuln_end_line, after_start AS patched_start_line, after_end AS patched_end_line, v.code AS vuln_function, p.code AS patch_function
 FROM firsts f JOIN v_cut v USING ({_KEY}, ord) JOIN p_cut p USING ({_KEY}, ord) WHERE v.code IS NOT NULL AND p.code IS NOT NULL AND {_starts_well('v.code')} AND {_starts_well('p.code')}),
strict AS (SELECT * EXCLUDE (k) FROM (SELECT *, count(*) FILTER (WHERE length(vuln_function) = length(patch_function)) OVER (PARTITION BY repo_url, commit_sha) AS k FROM codes) WHERE NOT (length(vuln_function) = length(patch_function) AND k > 10))"""
SOURCES = ["fx_source_span", "fx_source_file"]


@query(f"{STRICT}\nSELECT * FROM strict", SOURCES)
def pair_functions(spark, sf_dir):
    return methods.pair_functions(fixture(spark, sf_dir, "fx_source_file"), fixture(spark, sf_dir, "fx_source_span"))


@query(
    f"""c AS (SELECT s.*, {S.choose('old_path', 'new_path')} AS file_path, source_before, source_after FROM fx_source_span s JOIN fx_source_file USING ({_KEY}) WHERE side = 'changed' AND source_before <> ''),
b AS (SELECT * FROM fx_source_span WHERE side = 'before' QUALIFY row_number() OVER (PARTITION BY {_KEY}, name ORDER BY ord) = 1),
a AS (SELECT c.repo_url, c.commit_sha, c.file_ord, c.ord, o.start_line, o.end_line FROM c JOIN fx_source_span o USING ({_KEY}, name) WHERE o.side = 'after'
  QUALIFY row_number() OVER (PARTITION BY {_KEY}, c.ord ORDER BY CASE WHEN o.start_line IS NOT DISTINCT FROM c.start_line AND o.end_line IS NOT DISTINCT FROM c.end_line THEN 0 ELSE 1 END, o.ord) = 1),
p AS (SELECT c.repo_url, c.commit_sha, c.file_ord, c.ord, c.file_path, c.name AS method_name, b.start_line AS vuln_start_line, b.end_line AS vuln_end_line,
  CASE WHEN a.ord IS NULL THEN c.start_line ELSE a.start_line END AS patched_start_line, CASE WHEN a.ord IS NULL THEN c.end_line ELSE a.end_line END AS patched_end_line, source_before, source_after
  FROM c LEFT JOIN b USING ({_KEY}, name) LEFT JOIN a ON a.repo_url = c.repo_url AND a.commit_sha = c.commit_sha AND a.file_ord = c.file_ord AND a.ord = c.ord
  QUALIFY row_number() OVER (PARTITION BY c.repo_url, c.commit_sha, c.file_path, c.name, vuln_start_line, vuln_end_line, patched_start_line, patched_end_line ORDER BY c.file_ord, c.ord) = 1),
x AS (SELECT * EXCLUDE (source_before, source_after, vl, pl),
  CASE WHEN source_before <> '' AND vuln_start_line > 0 AND vuln_end_line >= vuln_start_line AND vuln_start_line <= len(vl) THEN array_to_string(vl[vuln_start_line:least(vuln_end_line, len(vl))], chr(10)) END AS vf,
  CASE WHEN source_after <> '' AND patched_start_line > 0 AND patched_end_line >= patched_start_line AND patched_start_line <= len(pl) THEN array_to_string(pl[patched_start_line:least(patched_end_line, len(pl))], chr(10)) END AS pf
  FROM (SELECT *, {S.lines('source_before')} AS vl, {S.lines('source_after')} AS pl FROM p)),
y AS (SELECT * EXCLUDE (vf, pf), CASE WHEN regexp_matches(vf, '{S.NOT_WS}') THEN vf END AS vuln_function, CASE WHEN regexp_matches(pf, '{S.NOT_WS}') THEN pf END AS patch_function FROM x)
SELECT *, 'github' AS platform FROM y WHERE vuln_function IS NOT NULL OR patch_function IS NOT NULL""",
    SOURCES,
)
def pair_functions_lax(spark, sf_dir):
    return methods.pair_functions_lax(fixture(spark, sf_dir, "fx_source_file"), fixture(spark, sf_dir, "fx_source_span"))


# ---- fetches -----------------------------------------------------------------------------
@query("SELECT * FROM fx_commit_raw WHERE full_sha = commit_sha", ["fx_commit_raw"])
def sha_exact(spark, sf_dir):
    return fetch.sha_exact(fixture(spark, sf_dir, "fx_commit_raw"))


def _phrases(listed: list[str]) -> str:
    return " OR ".join(f"contains(lower(message), '{p}')" for p in listed)


def _classified(lax: bool) -> str:
    fetch_hit = _phrases(fetch.LAX_FETCH_PHRASES if lax else fetch.FETCH_PHRASES)
    access_hit = _phrases(fetch.ACCESS_PHRASES)
    host = "NOT contains(repo_url, 'github.com')" if lax else "false"
    return f"""SELECT *, CASE WHEN {host} THEN 'unsupported_platform' WHEN ok THEN NULL WHEN phase = 'access' OR ({fetch_hit}) THEN 'repo_inaccessible' ELSE 'commit_fetch_failed' END AS skip_reason,
 ({host} OR NOT ok) AND CASE WHEN phase = 'access' THEN ({access_hit}) ELSE ({fetch_hit}) END AS is_private FROM fx_fetch_log"""


@query(_classified(False), ["fx_fetch_log"])
def classify_fetch(spark, sf_dir):
    return fetch.classify_fetch(fixture(spark, sf_dir, "fx_fetch_log"))


@query(_classified(True), ["fx_fetch_log"])
def classify_fetch_lax(spark, sf_dir):
    return fetch.classify_fetch(fixture(spark, sf_dir, "fx_fetch_log"), lax=True)


_ACCESS = "acc AS (SELECT repo_url, arg_min(ok, seq) AS accessible, arg_min(message, seq) AS message FROM fx_fetch_log WHERE phase = 'access' GROUP BY repo_url)"


@query(f"{_ACCESS}\nSELECT f.seq, f.repo_url, a.accessible, a.message FROM fx_fetch_log f LEFT JOIN acc a USING (repo_url)", ["fx_fetch_log"])
def repo_access_table(spark, sf_dir):
    log = fixture(spark, sf_dir, "fx_fetch_log")
    return log.select("seq", "repo_url").join(fetch.repo_access_table(log), "repo_url", "left")


_OUTCOME = "CASE WHEN contains(lower(error), 'repository not found') THEN 'repo_inaccessible' WHEN error IS NOT NULL THEN 'commit_fetch_failed' WHEN full_sha = commit_sha THEN NULL ELSE 'commit_not_found' END"


@query(
    f"{file_side.PATCHES}\nSELECT count(*) AS commits_found, count(*) FILTER (WHERE r IS NULL) AS commits_saved, count(r) AS commits_failed, (SELECT count(*) FROM p) AS patches_saved FROM (SELECT {_OUTCOME} AS r FROM fx_commit_raw)",
    ["fx_commit_raw", "fx_file_change"],
)
def enrich_counters(spark, sf_dir):
    outcomes = fetch.commit_outcome(fixture(spark, sf_dir, "fx_commit_raw"))
    return fetch.enrich_counters(outcomes, P.build_patches(fixture(spark, sf_dir, "fx_file_change")))


# ---- the whole enrichment job: every commit is linked under one or two URLs -----------------
_LINKED = f"SELECT DISTINCT 'CVE-1' AS cve_id, repo_url, commit_sha, 'u/' || commit_sha || CASE WHEN file_ord % 2 = 0 THEN '#d' ELSE '' END AS commit_url FROM fx_source_file"
_ENRICHED = f"""{STRICT},
w AS (SELECT DISTINCT repo_url, commit_sha, commit_url FROM ({_LINKED})),
real AS (SELECT * FROM strict WHERE {_REASON} IS NULL QUALIFY row_number() OVER (PARTITION BY repo_url, commit_sha, file_path, method_name, vuln_start_line ORDER BY file_ord, ord) = 1)"""


def _landed(spark, sf_dir):
    files, spans = (fixture(spark, sf_dir, name) for name in ("fx_source_file", "fx_source_span"))
    wanted = files.selectExpr(
        "repo_url", "commit_sha", "'u/' || commit_sha || CASE WHEN file_ord % 2 = 0 THEN '#d' ELSE '' END AS commit_url"
    ).distinct()
    fetched = files.select("repo_url", "commit_sha").distinct().selectExpr(
        "repo_url", "commit_sha", "commit_sha AS full_sha", "'m' AS message", "CAST(NULL AS STRING) AS author",
        "'2024-01-01' AS commit_date", "CAST(NULL AS STRING) AS error",
    )
    return wanted, fetched, files, spans


@query(
    f"{_ENRICHED}\nSELECT r.repo_url, r.commit_sha, w.commit_url, file_path, method_name, vuln_start_line, patched_start_line, vuln_function, patch_function FROM real r JOIN w USING (repo_url, commit_sha)",
    SOURCES,
)
def enrich_commits(spark, sf_dir):
    run = enrich(*_landed(spark, sf_dir))
    return run.functions.select(
        "repo_url", "commit_sha", "commit_url", "file_path", "method_name", "vuln_start_line", "patched_start_line",
        "vuln_function", "patch_function",
    )


_EXT = "CASE WHEN {p} LIKE '%.c' THEN 'c' WHEN {p} LIKE '%.py' THEN 'python' ELSE 'unknown' END"


# Commits whose hash starts with a digit are landed twice.
_AGAIN = "commit_sha < 'a'"


@query(
    f"""k AS (SELECT repo_url, commit_sha, file_ord, {S.lines('diff')} AS ls, {S.choose('old_path', 'new_path')} AS a, {S.choose('new_path', 'old_path')} AS b FROM fx_source_file)
SELECT repo_url, commit_sha, b AS file_path, {_EXT.format(p='b')} AS language, CAST(len(list_filter(ls, lambda x: x LIKE '+%' AND x NOT LIKE '+++%')) + CASE WHEN {_AGAIN} THEN 1 ELSE 0 END AS INTEGER) AS added_lines,
 CAST(len(list_filter(ls, lambda x: x LIKE '-%' AND x NOT LIKE '---%')) AS INTEGER) AS removed_lines FROM k WHERE NOT {S.skip('a')} AND NOT {S.skip('b')} QUALIFY row_number() OVER (PARTITION BY repo_url, commit_sha, b ORDER BY file_ord DESC) = 1""",
    ["fx_source_file"],
)
def enrich_stored_patches(spark, sf_dir):
    """The enrichment job on a store, then some commits landed again: one more added line, no language.

    Stored patches take the new counts and keep the language that the second landing lacks.
    """
    store = TableStore(spark, scratch_folder(spark, "enrich"), buckets=4)
    wanted, fetched, files, spans = _landed(spark, sf_dir)
    store.publish({"cve_commit": wanted.withColumn("cve_id", F.lit("CVE-1"))})
    enrich_plan.enrich_commits(store, fetched, files, spans)
    longer = files.where(_AGAIN).withColumn("diff", F.expr("diff || chr(10) || '+more'"))
    again = P.build_patches(longer).withColumn("language", F.lit(None).cast("string"))
    store.upsert({"patch": (again, F.col("file_ord"))})
    return store.read("patch").select("repo_url", "commit_sha", "file_path", "language", "added_lines", "removed_lines")


# A diff of a commit in eleven is broken; repositories r2 and r5 are closed to us.
_POISONED = "file_ord = 3 AND substr(commit_sha, 1, 1) IN ('1', 'b')"


@query(
    f"""{STRICT},
w AS (SELECT DISTINCT repo_url, commit_sha, commit_url FROM ({_LINKED}) WHERE repo_url NOT LIKE '%/r2' AND repo_url NOT LIKE '%/r5'),
bad AS (SELECT DISTINCT repo_url, commit_sha FROM fx_source_file WHERE {_POISONED} AND NOT {S.skip(S.choose('old_path', 'new_path'))} AND NOT {S.skip(S.choose('new_path', 'old_path'))}),
k AS (SELECT repo_url, commit_sha, {S.choose('old_path', 'new_path')} AS a, {S.choose('new_path', 'old_path')} AS b FROM fx_source_file),
n AS (SELECT repo_url, commit_sha, count(DISTINCT b) AS patches FROM k WHERE NOT {S.skip('a')} AND NOT {S.skip('b')} AND (repo_url, commit_sha) NOT IN (SELECT (repo_url, commit_sha) FROM bad) GROUP BY 1, 2),
real AS (SELECT * FROM strict WHERE {_REASON} IS NULL QUALIFY row_number() OVER (PARTITION BY repo_url, commit_sha, file_path, method_name, vuln_start_line ORDER BY file_ord, ord) = 1),
f AS (SELECT r.repo_url, r.commit_sha, count(*) AS functions FROM real r JOIN w USING (repo_url, commit_sha) GROUP BY 1, 2)
SELECT c.repo_url, c.commit_sha, coalesce(patches, 0) AS patches, coalesce(functions, 0) AS functions, CASE WHEN bad.commit_sha IS NOT NULL THEN 'diff is not valid UTF-8' END AS patch_error
FROM (SELECT DISTINCT repo_url, commit_sha FROM w) c LEFT JOIN n USING (repo_url, commit_sha) LEFT JOIN f USING (repo_url, commit_sha) LEFT JOIN bad USING (repo_url, commit_sha)""",
    SOURCES,
)
def enrich_isolated(spark, sf_dir):
    """Broken diffs and closed repositories among the landed data: all other rows are stored."""
    store = TableStore(spark, scratch_folder(spark, "enrich"), buckets=4)
    wanted, fetched, files, spans = _landed(spark, sf_dir)
    files = files.withColumn("diff", F.when(F.expr(_POISONED), F.expr("CAST(unhex('2B61C30A') AS STRING)")).otherwise(F.col("diff")))
    repos = files.select("repo_url").distinct()
    log = repos.selectExpr(
        "1L AS seq", "repo_url", "'access' AS phase", "repo_url NOT LIKE '%/r2' AND repo_url NOT LIKE '%/r5' AS ok", "'' AS message"
    )
    store.publish({"cve_commit": wanted.withColumn("cve_id", F.lit("CVE-1"))})
    errors = enrich_plan.enrich_commits(store, fetched, files, spans, log).errors
    place = ["repo_url", "commit_sha"]
    counted = store.read("commits").select("repo_url", F.col("sha").alias("commit_sha"))
    for name in ("patch", "functions"):
        column = "patches" if name == "patch" else name
        counted = counted.join(store.read(name).groupBy(*place).agg(F.count("*").alias(column)), place, "left")
    return counted.join(errors, place, "left").select(
        *place, F.coalesce("patches", F.lit(0)).alias("patches"), F.coalesce("functions", F.lit(0)).alias("functions"), "patch_error"
    )


# ---- merges --------------------------------------------------------------------------------
UPSERT = ["fx_upsert"]


def _upsert(spark, sf_dir):
    stored = bucketed(spark, sf_dir, "fx_upsert", "ord = -1", ["k"]).select("k", "c1", "c2")
    return stored, fixture(spark, sf_dir, "fx_upsert").where("ord >= 0")


@query("SELECT k, c1, c2 FROM fx_upsert QUALIFY row_number() OVER (PARTITION BY k ORDER BY ord DESC) = 1", UPSERT)
def merge_overwrite(spark, sf_dir):
    existing, batch = _upsert(spark, sf_dir)
    return merge.merge_overwrite(existing, batch, ["k"], F.col("ord"))


@query(
    "SELECT k, arg_max(c1, ord) FILTER (WHERE c1 IS NOT NULL) AS c1, arg_max(c2, ord) FILTER (WHERE c2 IS NOT NULL) AS c2 FROM fx_upsert GROUP BY k",
    UPSERT,
)
def merge_coalesce(spark, sf_dir):
    existing, batch = _upsert(spark, sf_dir)
    return merge.merge_coalesce(existing, batch, ["k"], F.col("ord"))


_FUNCTION_ID = "substr(sha256(concat_ws('#', repo_url, commit_sha, file_path, method_name, coalesce(CAST(vuln_start_line AS VARCHAR), ''), CAST(vuln_end_line AS VARCHAR), CAST(patched_start_line AS VARCHAR), CAST(patched_end_line AS VARCHAR), CAST(ord AS VARCHAR))), 1, 16)"
_FUNCTION_ROWS = "rows_ AS (SELECT CASE WHEN commit_id % 3 = 0 THEN '' ELSE 'repo' || commit_id END AS repo_url, 'sha' || commit_id AS commit_sha, * FROM fx_function_pair)"


@query(
    f"{_FUNCTION_ROWS}\nSELECT {_FUNCTION_ID} AS function_id, repo_url, commit_sha, file_path, method_name, vuln_function FROM rows_ WHERE repo_url <> ''",
    PAIR,
)
def append_functions(spark, sf_dir):
    rows = fixture(spark, sf_dir, "fx_function_pair").selectExpr(
        "CASE WHEN commit_id % 3 = 0 THEN '' ELSE 'repo' || commit_id END AS repo_url", "'sha' || commit_id AS commit_sha", "*"
    )
    columns = ["function_id", "repo_url", "commit_sha", "file_path", "method_name", "vuln_function"]
    empty = spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
    return merge.append_functions(empty, rows, ["ord"])


# ---- audit and cascades -------------------------------------------------------------------
AUDITED = ["fx_cve", "fx_cve_commit", "fx_commits", "fx_file_change"]
_NAMELESS = "CASE WHEN file_ord % 50 = 0 THEN '' WHEN file_ord % 49 = 0 THEN CAST(NULL AS STRING) ELSE repo_url END"
_PATCH_KEYS = "pk AS (SELECT repo_url, commit_sha, coalesce(new_path, old_path) AS file_path FROM fx_file_change)"


def _audit_tables(spark, sf_dir):
    files = fixture(spark, sf_dir, "fx_file_change")
    return {
        "cve": fixture(spark, sf_dir, "fx_cve"),
        "cve_commit": fixture(spark, sf_dir, "fx_cve_commit").withColumn("cve_id", F.expr("replace(cve_id, '7', '8')")),
        "commits": fixture(spark, sf_dir, "fx_commits").withColumn("commit_url", F.expr("substr(commit_url, 1, 23)")),
        "patch": files.selectExpr("repo_url", "commit_sha", "coalesce(new_path, old_path) AS file_path"),
        "functions": files.selectExpr(f"{_NAMELESS} AS repo_url", "commit_sha"),
    }


@query(
    f"""{_PATCH_KEYS},
fk AS (SELECT {_NAMELESS} AS repo_url, commit_sha FROM fx_file_change),
cc AS (SELECT * REPLACE (replace(cve_id, '7', '8') AS cve_id) FROM fx_cve_commit),
co AS (SELECT * REPLACE (substr(commit_url, 1, 23) AS commit_url) FROM fx_commits)
SELECT 'not_null' AS "check", 'patch' AS "table", 'repo_url,commit_sha,file_path' AS columns, repo_url || '|' || commit_sha || '|<null>' AS key, count(*) AS n FROM pk WHERE file_path IS NULL GROUP BY ALL
UNION ALL SELECT 'unique', 'cve_commit', 'cve_id,repo_url,commit_sha', cve_id || '|' || repo_url || '|' || commit_sha, count(*) FROM cc GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'unique', 'commits', 'commit_url', commit_url, count(*) FROM co GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'unique', 'patch', 'repo_url,commit_sha,file_path', repo_url || '|' || commit_sha || '|' || file_path, count(*) FROM pk WHERE file_path IS NOT NULL GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'foreign_key', 'cve_commit', 'cve_id', cve_id, count(*) FROM cc WHERE cve_id NOT IN (SELECT cve_id FROM fx_cve) GROUP BY ALL
UNION ALL SELECT 'foreign_key', 'patch', 'repo_url,commit_sha', repo_url || '|' || commit_sha, count(*) FROM pk WHERE (repo_url, commit_sha) NOT IN (SELECT (repo_url, sha) FROM fx_commits) GROUP BY ALL
UNION ALL SELECT 'not_null', 'functions', 'repo_url,commit_sha', '<null>|' || commit_sha, count(*) FROM fk WHERE repo_url IS NULL GROUP BY ALL
UNION ALL SELECT 'foreign_key', 'functions', 'repo_url,commit_sha', repo_url || '|' || commit_sha, count(*) FROM fk WHERE repo_url IS NOT NULL AND (repo_url, commit_sha) NOT IN (SELECT (repo_url, sha) FROM fx_commits) GROUP BY ALL
UNION ALL SELECT 'empty_repo_url', 'functions', 'repo_url', '', count(*) FROM fk WHERE repo_url = '' HAVING count(*) > 0""",
    AUDITED,
)
def integrity_audit(spark, sf_dir):
    return audit.integrity_audit(_audit_tables(spark, sf_dir))


@query(
    f"""d AS (SELECT repo_url, sha FROM fx_commits WHERE message = 'fix BUILDING'),
cc AS (SELECT * REPLACE (replace(cve_id, '7', '8') AS cve_id) FROM fx_cve_commit),
dv AS (SELECT cve_id FROM fx_cve WHERE severity = 'HIGH')
SELECT 'commits' AS "table", count(*) AS n, count(DISTINCT repo_url || sha) AS keys FROM fx_commits WHERE message <> 'fix BUILDING'
UNION ALL SELECT 'patch', count(*), count(DISTINCT repo_url || commit_sha) FROM fx_file_change WHERE (repo_url, commit_sha) NOT IN (SELECT (repo_url, sha) FROM d)
UNION ALL SELECT 'functions', count(*), count(DISTINCT repo_url || commit_sha) FROM (SELECT {_NAMELESS} AS repo_url, commit_sha FROM fx_file_change) f WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.repo_url = f.repo_url AND d.sha = f.commit_sha)
UNION ALL SELECT 'cve', count(*), count(DISTINCT cve_id) FROM fx_cve WHERE severity IS DISTINCT FROM 'HIGH'
UNION ALL SELECT 'cve_commit', count(*), count(DISTINCT repo_url || commit_sha) FROM cc WHERE cve_id NOT IN (SELECT cve_id FROM dv)""",
    AUDITED,
)
def cascade_delete(spark, sf_dir):
    """Commits go with their patches and functions, then records with their links."""
    tables = _audit_tables(spark, sf_dir)
    left = audit.cascade_delete(tables, "commits", tables["commits"].where("message = 'fix BUILDING'"))
    left = audit.cascade_delete(left, "cve", tables["cve"].where("severity = 'HIGH'"))
    keys = {"commits": "repo_url || sha", "cve": "cve_id"}
    counts = [
        df.agg(F.count("*").alias("n"), F.expr(f"count(DISTINCT {keys.get(name, 'repo_url || commit_sha')})").alias("keys"))
        .select(F.lit(name).alias("table"), "n", "keys")
        for name, df in left.items()
    ]
    return reduce(DataFrame.unionByName, counts)


@query(
    """r AS (SELECT cve_id AS old_id, 'CVE-1999-' || substr(cve_id, 10) AS new_id FROM fx_cve WHERE severity = 'HIGH')
SELECT coalesce(new_id, l.cve_id) AS cve_id, repo_url, commit_sha, commit_url, method, confidence FROM fx_cve_commit l LEFT JOIN r ON l.cve_id = r.old_id""",
    ["fx_cve", "fx_cve_commit"],
)
def cascade_update(spark, sf_dir):
    cve = fixture(spark, sf_dir, "fx_cve")
    renames = cve.where("severity = 'HIGH'").selectExpr("cve_id AS old_cve_id", "'CVE-1999-' || substr(cve_id, 10) AS new_cve_id")
    tables = {"cve": cve, "cve_commit": fixture(spark, sf_dir, "fx_cve_commit")}
    return audit.cascade_update(tables, "cve", renames)["cve_commit"]
