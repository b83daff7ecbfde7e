"""URL rules: reference kinds, hosts, and commit links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fixweave.functions.pytext import SPACE_CHARS

# ---- fixed values: host name -> platform, in the order in which they are tried
PLATFORMS = {"github.com": "github", "gitlab.com": "gitlab", "bitbucket.org": "bitbucket"}

# ---- fixed values: text in the URL path -> reference kind, first hit wins
REFERENCE_KINDS = {
    "/commit/": "commit",
    "/pull/": "pull",
    "/security/advisories/": "security-advisories",
}
OTHER_KIND = "other"

# ---- fixed values: schemes whose last path segment may carry ";parameters"
_PARAM_SCHEMES = [
    "", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps",
    "sip", "sips", "mms", "sftp", "tel",
]

_SCHEME = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?"
_NETLOC = r"(?://([^/?#]*))?"

# ---- fixed value: pattern of a commit link. An owner may start anywhere in the text; a hash longer than 40 digits is cut.
_COMMIT_LINK = (
    rf"(?iU)https?://(github\.com|gitlab\.com|bitbucket\.org)/([^/{SPACE_CHARS}]+)/([^/{SPACE_CHARS}]+)"
    r"(?:/-)?/(?:commit|commits)/([0-9a-fA-F]{7,40})"
)


def _plain(url: Column) -> Column:
    """Drop what URL parsers ignore: leading controls and blanks, tabs, line ends."""
    return F.regexp_replace(F.translate(url, "\t\r\n", ""), r"\A[\x00-\x20]+", "")


def url_path(url: Column) -> Column:
    """Path of a URL, without query, fragment and last-segment parameters."""
    text = _plain(url)
    path = F.regexp_extract(text, _SCHEME + _NETLOC + "([^?#]*)", 3)
    scheme = F.lower(F.regexp_extract(text, _SCHEME, 1))
    return F.when(
        text.contains(";") & scheme.isin(_PARAM_SCHEMES), F.regexp_replace(path, r";[^/]*\z", "")
    ).otherwise(path)


def _is_ipv6(host: Column) -> Column:
    """Whether a text is an IPv6 address; a zone may follow, and the last two groups may be an IPv4 address."""
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    plain = F.regexp_replace(F.regexp_replace(host, r"%[^%]+\z", ""), rf":{octet}(?:\.{octet}){{3}}\z", ":0:0")
    groups = r"[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4})"
    shortened = plain.rlike(rf"\A(?:{groups}{{0,6}})?::(?:{groups}{{0,6}})?\z")
    told = F.size(F.filter(F.split(plain, ":"), lambda part: part != ""))
    return plain.rlike(rf"\A{groups}{{7}}\z") | (shortened & (told <= 7))


def url_is_malformed(url: Column) -> Column:
    """True when the host part has square brackets that do not pair, or that hold no address."""
    netloc = F.regexp_extract(_plain(url), _SCHEME + _NETLOC, 2)
    inside = F.regexp_extract(netloc, r"\[([^\]]*)", 1)
    address = _is_ipv6(inside) | inside.rlike(r"(?s)\Av[0-9a-fA-F]+\..+\z")
    paired = netloc.contains("[") & netloc.contains("]")
    return (netloc.contains("[") != netloc.contains("]")) | (paired & ~address)


def reference_kind(url: Column) -> Column:
    """commit / pull / security-advisories / other, by the lower-cased path.

    The path is taken apart only for URLs that hold the text somewhere.
    """
    text, path = F.lower(_plain(url)), F.lower(url_path(url))
    kind = F.lit(OTHER_KIND)
    for needle, name in reversed(REFERENCE_KINDS.items()):
        kind = F.when(text.contains(needle) & path.contains(needle), name).otherwise(kind)
    return kind


def detect_platform(url: Column) -> Column:
    """Platform whose host occurs in the URL, NULL if none does."""
    lowered = F.lower(url)
    return F.coalesce(*[F.when(lowered.contains(host), name) for host, name in PLATFORMS.items()])


def parse_commit_url(url: Column) -> Column:
    """struct<repo_url, commit_hash, platform> of a commit link, NULL if it is none.

    A Markdown link is unwrapped to what stands between its last ``(`` and the
    next ``)``; query and fragment are cut before the link is matched.
    """
    wrapped = url.contains("(") & url.contains(")")
    inner = F.substring_index(F.substring_index(url, "(", -1), ")", 1)
    target = F.substring_index(F.substring_index(F.when(wrapped, inner).otherwise(url), "?", 1), "#", 1)

    host = F.lower(F.regexp_extract(target, _COMMIT_LINK, 1))
    owner = F.regexp_extract(target, _COMMIT_LINK, 2)
    repo = F.regexp_replace(F.regexp_extract(target, _COMMIT_LINK, 3), r"\.git\z", "")
    commit = F.regexp_extract(target, _COMMIT_LINK, 4)
    return F.when(
        commit != "",
        F.struct(
            F.concat(F.lit("https://"), host, F.lit("/"), owner, F.lit("/"), repo).alias("repo_url"),
            commit.alias("commit_hash"),
            detect_platform(host).alias("platform"),
        ),
    )


def commit_key(repo_url: Column, commit_sha: Column) -> Column:
    """Short stable key of a commit: first 16 hex digits of SHA-256 over ``repo#sha``."""
    return F.substring(F.sha2(F.concat(repo_url, F.lit("#"), commit_sha), 256), 1, 16)
