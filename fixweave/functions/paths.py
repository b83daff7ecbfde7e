"""Path rules: which changed files are source code, and in which language."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: file names, extensions and folders that are not source code
SKIPPED_NAMES = [
    "readme", "readme.md", "readme.rst", "readme.txt",
    "changelog", "changelog.md", "changelog.rst", "changelog.txt",
    "license", "license.md", "license.txt",
    "copying", "code_of_conduct.md", "contributing.md", "security.md", "release-notes.md",
]
SKIPPED_EXTENSIONS = [
    ".md", ".rst", ".txt", ".adoc",
    ".json", ".yml", ".yaml", ".toml", ".ini", ".cfg",
    ".log", ".csv",
    ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".pdf",
]
SKIPPED_FOLDERS = [
    "docs", "doc", ".github", ".vscode", ".idea",
    "examples", "example",
    "test", "tests", "__tests__", "testing", "tester", "spec", "specs",
    "benchmark", "benchmarks",
    "dist", "build", "out", "target",
    "node_modules", "vendor", "grammars", "generated",
]

# ---- fixed values: file extension -> language tag
LANGUAGES = {
    ".py": "python", ".pyi": "python",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript",
    ".java": "java", ".kt": "kotlin", ".scala": "scala",
    ".c": "c", ".h": "c",
    ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hh": "cpp", ".hxx": "cpp",
    ".cs": "csharp", ".go": "go",
    ".rb": "ruby", ".erb": "ruby",
    ".php": "php", ".ctp": "php",
    ".rs": "rust", ".swift": "swift",
    ".m": "objectivec", ".mm": "objectivec",
    ".pl": "perl", ".pm": "perl", ".t": "perl",
    ".sh": "bash", ".bash": "bash", ".zsh": "bash", ".ps1": "powershell",
    ".sql": "sql", ".yml": "yaml", ".yaml": "yaml", ".json": "json", ".xml": "xml",
    ".html": "html", ".htm": "html",
    ".css": "css", ".scss": "scss", ".sass": "scss", ".less": "less",
}

# A dot that is neither the first nor the last character of the name.
_SUFFIX = r"(?s)^.+(\.[^.]+)\z"


def file_name(path: Column) -> Column:
    """Last path part; trailing ``/`` and ``/.`` do not count."""
    return F.substring_index(F.regexp_replace(path, r"(?:/+\.?)+\z", ""), "/", -1)


def suffix(name: Column) -> Column:
    """Extension with its dot, ``''`` if none (``.bashrc`` and ``foo.`` have none)."""
    return F.regexp_extract(name, _SUFFIX, 1)


def _any_of(words: list[str]) -> str:
    return "(?:" + "|".join(word.replace(".", r"\.") for word in words) + ")"


# One pattern over the lower-cased path, so that the path is evaluated once per
# row: empty, or a skipped last part, or a skipped part anywhere.
_LAST_PART = "|".join(
    [
        _any_of(SKIPPED_NAMES),
        r"[^/]+" + _any_of(SKIPPED_EXTENSIONS),
        r"[^/]*\.min\.[^/]*",
        r"test_[^/]*",
        r"[^/]*_test(?:\.[^/.]+)?",
    ]
)
_SKIPPED_PATH = (
    rf"\A\z|(?:\A|/)(?:{_LAST_PART})(?:/+\.?)*\z"
    rf"|(?:\A|/){_any_of(SKIPPED_FOLDERS)}(?:/|\z)"
)


def skip_file(path: Column) -> Column:
    """True for files that carry no code worth keeping; NULL and empty are skipped."""
    return F.coalesce(F.lower(F.translate(path, "\\", "/")).rlike(_SKIPPED_PATH), F.lit(True))


def detect_language(path: Column) -> Column:
    """Language tag of a file path, ``unknown`` when the extension is not known."""
    table = F.create_map(*[F.lit(item) for item in chain.from_iterable(LANGUAGES.items())])
    found = F.try_element_at(table, F.lower(suffix(file_name(path))))
    return F.coalesce(found, F.lit("unknown"))


def first_path(*paths: Column) -> Column:
    """First path that is neither NULL nor empty, else ``unknown``."""
    return F.coalesce(*[F.nullif(path, F.lit("")) for path in paths], F.lit("unknown"))
