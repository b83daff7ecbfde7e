"""Pieces of SQL shared by the DuckDB answers."""

from __future__ import annotations

from fixweave.functions import code, paths

# RE2 classes for Python's whitespace and line breaks.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WS = WS.replace("[", "[^", 1)
BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
NOT_WORD = r"[^\p{L}\p{N}_]"


def lines(text: str) -> str:
    """List of the lines of a text expression."""
    parts = f"string_split_regex({text}, '{BREAK}')"
    return f"CASE WHEN {parts}[-1] = '' THEN {parts}[1:len({parts}) - 1] ELSE {parts} END"


def word(*names: str) -> str:
    """RE2 pattern for whole words."""
    return f"(?:^|{NOT_WORD})(?:{'|'.join(names)})(?:{NOT_WORD}|$)"


# Parsed records: valid JSON objects whose containers are an object.
RECORDS = """j AS (
 SELECT ord, entry, value, v FROM (SELECT *, TRY_CAST(value AS JSON) AS v FROM fx_cve_raw)
 WHERE v IS NOT NULL AND json_type(v) = 'OBJECT' AND coalesce(json_type(v, '$.containers'), 'OBJECT') = 'OBJECT')"""

STATE = "coalesce(v->>'$.cveMetadata.state', 'UNKNOWN')"
CVE_ID = "coalesce(v->>'$.cveMetadata.cveId', 'UNKNOWN')"
TITLE = (
    "coalesce(nullif(v->>'$.containers.cna.title', ''), v->>'$.containers.cna.descriptions[0].value',"
    " 'No title available')"
)

CVSS = """m AS (SELECT ord, unnest(CAST(v->'$.containers.cna.metrics' AS JSON[])) AS metric, unnest(range(CAST(json_array_length(v, '$.containers.cna.metrics') AS BIGINT))) AS pos FROM j),
k AS (SELECT ord, pos, metric, unnest(json_keys(metric)) AS key, unnest(range(CAST(len(json_keys(metric)) AS BIGINT))) AS kpos FROM m),
c AS (SELECT ord, pos, kpos, TRY_CAST(json_extract_string(metric, '$.' || key || '.version') AS DOUBLE) AS num, json_extract_string(metric, '$.' || key || '.version') AS version,
  TRY_CAST(json_extract_string(metric, '$.' || key || '.baseScore') AS DOUBLE) AS score, json_extract_string(metric, '$.' || key || '.baseSeverity') AS severity, json_extract_string(metric, '$.' || key || '.vectorString') AS vector
  FROM k WHERE starts_with(key, 'cvssV') AND json_type(metric, '$.' || key) = 'OBJECT'),
best AS (SELECT * FROM c WHERE num > 0 QUALIFY row_number() OVER (PARTITION BY ord ORDER BY num DESC, pos, kpos) = 1)"""

CWE = """w AS (SELECT ord, string_agg(DISTINCT d->>'cweId', ',' ORDER BY d->>'cweId') AS cwe FROM (
  SELECT ord, unnest(CAST(p->'$.descriptions' AS JSON[])) AS d FROM (SELECT ord, unnest(CAST(v->'$.containers.cna.problemTypes' AS JSON[])) AS p FROM j))
  WHERE d->>'type' = 'CWE' AND d->>'cweId' <> '' GROUP BY ord)"""

REFERENCES = f"""u AS (SELECT ord, state, cve_id, pos, r->>'url' AS url FROM (
  SELECT ord, {STATE} AS state, {CVE_ID} AS cve_id, unnest(CAST(v->'$.containers.cna.references' AS JSON[])) AS r, unnest(range(CAST(json_array_length(v, '$.containers.cna.references') AS BIGINT))) AS pos FROM j)
  WHERE r->>'url' <> ''),
kinds AS (SELECT *, CASE WHEN p LIKE '%/commit/%' THEN 'commit' WHEN p LIKE '%/pull/%' THEN 'pull' WHEN p LIKE '%/security/advisories/%' THEN 'security-advisories' ELSE 'other' END AS kind
  FROM (SELECT *, lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)) AS p FROM u))"""

# ---- fixed value: pattern of a commit link
_LINK = r"https?://(github\.com|gitlab\.com|bitbucket\.org)/([^/\s]+)/([^/\s]+?)(?:\.git)?(?:/-)?/(?:commit|commits)/([0-9a-fA-F]{7,40})"


def link_columns(url: str) -> str:
    """repo_url, commit_hash and platform of a URL expression, hash '' for no match."""
    cut = f"split_part(split_part({url}, '?', 1), '#', 1)"
    part = [f"regexp_extract({cut}, '{_LINK}', {i}, 'i')" for i in range(5)]
    return (
        f"'https://' || lower({part[1]}) || '/' || {part[2]} || '/' || {part[3]} AS repo_url, {part[4]} AS commit_hash, "
        f"CASE lower({part[1]}) WHEN 'github.com' THEN 'github' WHEN 'gitlab.com' THEN 'gitlab' WHEN 'bitbucket.org' THEN 'bitbucket' END AS platform"
    )


LINKS = f"{REFERENCES},\nlinks AS (SELECT * FROM (SELECT *, {link_columns('url')} FROM kinds WHERE kind = 'commit') WHERE commit_hash <> '')"

def listed(values: list[str]) -> str:
    """The values of a fixed list as SQL texts."""
    return ",".join(f"'{value}'" for value in values)


SKIP_NAMES, SKIP_EXT, SKIP_DIRS = listed(paths.SKIPPED_NAMES), listed(paths.SKIPPED_EXTENSIONS), listed(paths.SKIPPED_FOLDERS)
PLACEHOLDERS = listed(code.PLACEHOLDER_NAMES)


def skip(path: str) -> str:
    """Boolean expression: the path filter, by lists of path parts."""
    parts = f"list_filter(string_split(lower(replace({path}, chr(92), '/')), '/'), lambda x: x <> '' AND x <> '.')"
    name = f"coalesce({parts}[-1], '')"
    ext = rf"regexp_extract({name}, '^.+(\.[^.]+)$', 1)"
    stem = f"left({name}, length({name}) - length({ext}))"
    return (
        f"(coalesce({path}, '') = '' OR {name} IN ({SKIP_NAMES}) OR {ext} IN ({SKIP_EXT}) OR contains({name}, '.min.')"
        f" OR list_has_any({parts}, [{SKIP_DIRS}]) OR starts_with({stem}, 'test_') OR ends_with({stem}, '_test'))"
    )


def choose(first: str, second: str) -> str:
    return f"coalesce(nullif({first}, ''), nullif({second}, ''), 'unknown')"


OVERLAP = "CASE WHEN {a} IS NULL OR {b} IS NULL OR {c} IS NULL OR {d} IS NULL THEN 0 ELSE greatest(0, least({b}, {d}) - greatest({a}, {c}) + 1) END"
DISTANCE = (
    "CASE WHEN {a} IS NULL OR {b} IS NULL OR {c} IS NULL OR {d} IS NULL THEN 1000000000"
    " WHEN least({b}, {d}) - greatest({a}, {c}) + 1 > 0 THEN 0 WHEN {b} < {c} THEN {c} - {b} WHEN {d} < {a} THEN {a} - {d} ELSE 1000000000 END"
)


def overlap(a: str, b: str, c: str, d: str) -> str:
    return OVERLAP.format(a=a, b=b, c=c, d=d)


def distance(a: str, b: str, c: str, d: str) -> str:
    return DISTANCE.format(a=a, b=b, c=c, d=d)


# ---- fixed values: left-over lines, and starts of control-flow blocks
JUNK = rf"^{WS}*(?:\}}(?:;|{WS})*|%{{3,}}|#{WS}*(?:endif|else|if)(?:{NOT_WORD}.*)?|[/*]+{WS}*)$"
BLOCK_START = (
    rf"^\}}?{WS}*(?:catch{WS}*\(|else{WS}*[\{{:]|else{WS}+if{WS}*\(|elif{WS}|except(?:{NOT_WORD}|$)|finally{WS}*[\{{:]|case{WS}+.+:|default{WS}*:)"
)


def tail_from(items: str, condition: str) -> str:
    """Sub-list from the first item ``x`` that fulfils a condition; empty if none does."""
    place = f"list_position(list_transform({items}, lambda x: {condition}), true)"
    return f"CASE WHEN coalesce({place}, 0) = 0 THEN CAST([] AS VARCHAR[]) ELSE {items}[{place}:] END"


def no_space(text: str) -> str:
    return f"regexp_replace({text}, '{WS}+', '', 'g')"


def no_comments(text: str) -> str:
    once = rf"regexp_replace({text}, '(?s)/\*.*?\*/', '', 'g')"
    return rf"regexp_replace(regexp_replace({once}, '//[^\n]*', '', 'g'), '#[^\n]*', '', 'g')"


def reason(vuln: str, patch: str) -> str:
    return (
        f"CASE WHEN coalesce({vuln}, '') = '' OR coalesce({patch}, '') = '' THEN 'missing'"
        f" WHEN {no_space(vuln)} = {no_space(patch)} THEN 'whitespace'"
        f" WHEN {no_space(no_comments(vuln))} = {no_space(no_comments(patch))} THEN 'comment' END"
    )
