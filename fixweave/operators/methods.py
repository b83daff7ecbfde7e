"""Function-level pairs: from method spans and file sources to code pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixweave.frames import computed, large, pruned
from fixweave.functions.code import (
    block_text, change_reason, clean_block, looks_like_function, valid_method_name,
)
from fixweave.functions.paths import first_path, skip_file
from fixweave.functions.pytext import not_blank, raw_lines, strip
from fixweave.functions.urls import detect_platform
from fixweave.operators.pairing import (
    FILE_KEYS, WIDE_FROM, distinct_spans, pair_match, pair_sides, valid_pairs,
)
from fixweave.session import staged

COMMIT_KEYS = ["repo_url", "commit_sha"]
PAIR_LINES = ["vuln_start_line", "vuln_end_line", "patched_start_line", "patched_end_line"]
SPAN_KEYS = [*COMMIT_KEYS, "file_path", "method_name", *PAIR_LINES]
# ---- fixed value: more equal-length pairs than this in a commit are a bulk edit
BULK_THRESHOLD = 10
# Spans that are cut from one split of a file text.
SPANS_PER_CHUNK = 1000


def _side(spans: DataFrame, side: str) -> DataFrame:
    return spans.where(F.col("side") == side).select(*FILE_KEYS, "ord", "name", "start_line", "end_line")


def _has_text(column: str) -> Column:
    return F.coalesce(F.col(column) != "", F.lit(False))


def dedup_spans(pairs: DataFrame) -> DataFrame:
    """One row per file path, name and four line numbers of a commit: the first.

    A plain map-side aggregation on narrow columns.
    """
    first = pairs.groupBy(*SPAN_KEYS).agg(F.min(F.struct("file_ord", "ord")).alias("_first"))
    return first.select(*SPAN_KEYS, "_first.file_ord", "_first.ord")


def _spans_by_file(pairs: DataFrame) -> DataFrame:
    """First span pair per file, and whether other files of the commit have it too.

    Only files with a text count when repeats across files are dropped, and that
    is known once the texts are read. Such repeats are rare, so they are marked
    here, on narrow rows, and dealt with after the cut.
    """
    per_file = pairs.groupBy("file_ord", *SPAN_KEYS).agg(F.min("ord").alias("ord"))
    several = per_file.groupBy(*SPAN_KEYS).agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    same = [F.col(f"p.{key}").eqNullSafe(F.col(f"s.{key}")) for key in SPAN_KEYS]
    marked = per_file.alias("p").join(large(several).alias("s"), same, "left")
    return marked.select("p.*", F.col("s._n").isNotNull().alias("shared"))


def _first_files(blocks: DataFrame) -> DataFrame:
    """Of span pairs shared by files of a commit keep the first; the others pass as they are."""
    rank = F.row_number().over(Window.partitionBy(*SPAN_KEYS).orderBy("file_ord"))
    first = blocks.where(F.col("shared")).withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")
    return blocks.where(~F.col("shared")).unionByName(first).drop("shared")


def attach_source(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """Bring the two file texts to the chosen spans, by file key.

    Called once, after all choices on narrow rows are made, so the texts meet
    one join only, and only those of files that a span asks for. ``pairs`` is
    read twice: hand over a stored table.
    """
    texts = pruned(files.select(*FILE_KEYS, "source_before", "source_after"), FILE_KEYS, pairs)
    return pairs.join(large(texts), FILE_KEYS)


def _chunked(pairs: DataFrame, per_chunk: int) -> DataFrame:
    """Spans of a file gathered in lists of about ``per_chunk``.

    Files with more spans are found by a map-side count; their spans are dealt
    out by a hash, so no task sorts or holds a whole file.
    """
    wide = pairs.groupBy(*FILE_KEYS).agg(F.count("*").alias("_n")).where(F.col("_n") > per_chunk)
    fields = [name for name in pairs.columns if name not in FILE_KEYS]
    chunks = F.coalesce(F.ceil(F.col("_n") / per_chunk), F.lit(1))
    place = pairs.join(wide, FILE_KEYS, "left").withColumn("_chunk", F.pmod(F.xxhash64("ord", *PAIR_LINES), chunks))
    return place.groupBy(*FILE_KEYS, "_chunk").agg(F.collect_list(F.struct(*fields)).alias("_spans"))


def cut_blocks(pairs: DataFrame, files: DataFrame, per_chunk: int = SPANS_PER_CHUNK) -> DataFrame:
    """Add ``vuln_text`` and ``patch_text``, the raw lines of both spans,
    ``has_before`` and ``has_after``, whether the file has these texts, and
    ``readable``, whether they are valid UTF-8.

    A file with many functions is not copied and split once per function: the
    spans of a file meet its text in chunks, and each chunk cuts all of its
    blocks from one split.
    """
    fields = [name for name in pairs.columns if name not in FILE_KEYS]
    chunks = staged(_chunked(pairs, per_chunk), "chunks")
    split = computed(
        attach_source(chunks, files),
        {"_before": raw_lines(F.col("source_before")), "_after": raw_lines(F.col("source_after"))},
    )

    def cut(span: Column) -> Column:
        return F.struct(
            *[span[name].alias(name) for name in fields],
            block_text(F.col("_before"), span["vuln_start_line"], span["vuln_end_line"]).alias("vuln_text"),
            block_text(F.col("_after"), span["patched_start_line"], span["patched_end_line"]).alias("patch_text"),
        )

    return split.select(
        *FILE_KEYS,
        _has_text("source_before").alias("has_before"),
        _has_text("source_after").alias("has_after"),
        F.coalesce(F.is_valid_utf8("source_before") & F.is_valid_utf8("source_after"), F.lit(True)).alias("readable"),
        F.inline(F.transform("_spans", cut)),
    )


def clean_blocks(blocks: DataFrame) -> DataFrame:
    """Cut texts to cleaned ``vuln_function`` and ``patch_function``."""
    cleaned = {
        "vuln_function": clean_block(F.col("vuln_text")),
        "patch_function": clean_block(F.col("patch_text")),
    }
    return computed(blocks, cleaned).drop("vuln_text", "patch_text")


def _is_whole() -> Column:
    return (
        F.col("vuln_function").isNotNull() & F.col("patch_function").isNotNull()
        & looks_like_function(F.col("vuln_function")) & looks_like_function(F.col("patch_function"))
    )


def whole_functions(pairs: DataFrame) -> DataFrame:
    """Both sides present, and neither opens like a control-flow block."""
    return pairs.where(_is_whole())


def complete_pairs(pairs: DataFrame) -> DataFrame:
    """Both sides present."""
    return pairs.where(F.col("vuln_function").isNotNull() & F.col("patch_function").isNotNull())


def _equal_length() -> Column:
    return F.coalesce(F.length("vuln_function") == F.length("patch_function"), F.lit(False))


def _bulk(tagged: DataFrame, keys: list[str], threshold: int) -> DataFrame:
    """Commits with more than ``threshold`` pairs of equal length."""
    return tagged.where("equal_length").groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > threshold)


def _drop_bulk(tagged: DataFrame, bulk: DataFrame, keys: list[str]) -> DataFrame:
    marks = bulk.select(*keys, F.lit(True).alias("_bulk"), F.lit(True).alias("equal_length"))
    return tagged.join(marks, [*keys, "equal_length"], "left").where(F.col("_bulk").isNull()).select(*tagged.columns)


def drop_bulk_refactor(pairs: DataFrame, keys: list[str] = COMMIT_KEYS, threshold: int = BULK_THRESHOLD) -> DataFrame:
    """In commits with more than ``threshold`` equal-length pairs, drop these pairs.

    The commits are found by a map-side count and removed by an anti-join, so a
    single huge commit is never gathered in one task. ``pairs`` is read twice:
    hand over a stored table when it is costly to make.
    """
    tagged = pairs.withColumn("equal_length", _equal_length())
    return _drop_bulk(tagged, _bulk(tagged, keys, threshold), keys).select(*pairs.columns)


def pair_blocks(files: DataFrame, spans: DataFrame, wide_from: int = WIDE_FROM) -> DataFrame:
    """Cleaned blocks of the changed functions before and after, strict rules.

    ``files`` and ``spans`` follow the FILE_CHANGE and METHOD_SPAN schemas. The
    changed methods are stored in between, since they are read twice.
    """
    old, new = F.col("old_path"), F.col("new_path")
    # Paths only: the file texts are read once, when all spans are chosen.
    usable = files.where(~skip_file(first_path(old, new))).select(
        *FILE_KEYS, first_path(old, new).alias("file_path")
    )
    named = spans.where(valid_method_name(F.col("name")))
    # Equal changed spans lead to equal pairs, of which only the first is kept.
    changed = staged(distinct_spans(_side(named, "changed"), FILE_KEYS).join(large(usable), FILE_KEYS), "changed")
    paired = pair_sides(changed, named.select(*FILE_KEYS, "side", "ord", "name", "start_line", "end_line"), wide_from=wide_from)
    chosen = valid_pairs(pair_match(paired)).select(
        *FILE_KEYS, "ord", "file_path", strip(F.col("name")).alias("method_name"),
        F.col("before_start").alias("vuln_start_line"), F.col("before_end").alias("vuln_end_line"),
        F.col("after_start").alias("patched_start_line"), F.col("after_end").alias("patched_end_line"),
    )
    chosen = staged(chosen, "chosen")
    blocks = cut_blocks(_spans_by_file(chosen), files).where("has_before AND has_after").drop("has_before", "has_after")
    cleaned = clean_blocks(blocks)
    return cleaned.withColumns({"whole": _is_whole(), "equal_length": _equal_length()})


def functions_of_blocks(blocks: DataFrame) -> DataFrame:
    """Function pairs of a stored table of blocks; unreadable files have none.

    What is needed of the texts was noted with the blocks, so the bulk edits are
    found on narrow rows.
    """
    def usable(columns: list[str]) -> DataFrame:
        first = _first_files(blocks.where("readable").select(*columns))
        return first.where("whole")

    narrow = usable([*SPAN_KEYS, "file_ord", "ord", "shared", "whole", "equal_length"])
    kept = _drop_bulk(usable(blocks.columns), _bulk(narrow, COMMIT_KEYS, BULK_THRESHOLD), COMMIT_KEYS)
    return kept.drop("readable", "whole", "equal_length")


def pair_functions(files: DataFrame, spans: DataFrame, wide_from: int = WIDE_FROM) -> DataFrame:
    """Vulnerable and patched versions of changed functions, strict rules."""
    return functions_of_blocks(staged(pair_blocks(files, spans, wide_from), "blocks"))


def pair_functions_lax(files: DataFrame, spans: DataFrame) -> DataFrame:
    """The older, laxer rules: first namesake before; same span, first namesake
    or the changed method itself after; one-sided pairs are kept; nothing is
    skipped or cleaned."""
    usable = files.select(*FILE_KEYS, first_path(F.col("old_path"), F.col("new_path")).alias("file_path"))
    group = [*FILE_KEYS, "name"]
    by_name = ["ord", "start_line", "end_line"]

    def first_of(side: str) -> DataFrame:
        return _side(spans, side).groupBy(*group).agg(F.min(F.struct(*by_name)).alias(side))

    def on(other: str) -> list[Column]:
        return [F.col(f"c.{k}") == F.col(f"{other}.{k}") for k in FILE_KEYS] + [
            F.col("c.name").eqNullSafe(F.col(f"{other}.name"))
        ]

    changed = distinct_spans(_side(spans, "changed"), FILE_KEYS).join(large(usable), FILE_KEYS)
    exact = distinct_spans(_side(spans, "after"), FILE_KEYS)
    same_span = F.col("c.start_line").eqNullSafe(F.col("x.start_line")) & F.col("c.end_line").eqNullSafe(
        F.col("x.end_line")
    )

    paired = (
        changed.alias("c")
        .join(large(first_of("before")).alias("b"), on("b"), "left")
        .join(large(exact).alias("x"), [*on("x"), same_span], "left")
        .join(large(first_of("after")).alias("a"), on("a"), "left")
    )
    is_exact = F.col("x.ord").isNotNull()

    def after(name: str) -> Column:
        return (
            F.when(is_exact, F.col(f"x.{name}"))
            .when(F.col("a.after").isNotNull(), F.col(f"a.after.{name}"))
            .otherwise(F.col(f"c.{name}"))
        )

    chosen = paired.select(
        *[F.col(f"c.{k}") for k in FILE_KEYS], "c.ord", "c.file_path", F.col("c.name").alias("method_name"),
        F.col("b.before.start_line").alias("vuln_start_line"), F.col("b.before.end_line").alias("vuln_end_line"),
        after("start_line").alias("patched_start_line"), after("end_line").alias("patched_end_line"),
    )
    def plain(text: str) -> Column:
        return F.when(not_blank(F.col(text)), F.col(text))

    blocks = cut_blocks(_spans_by_file(chosen), files).where("has_before").drop("has_before", "has_after", "readable")
    cut = _first_files(staged(blocks, "blocks")).withColumns(
        {
            "vuln_function": plain("vuln_text"),
            "patch_function": plain("patch_text"),
            "platform": detect_platform(F.col("repo_url")),
        }
    )
    return cut.where(F.col("vuln_function").isNotNull() | F.col("patch_function").isNotNull()).drop(
        "vuln_text", "patch_text"
    )


def tag_change(pairs: DataFrame) -> DataFrame:
    """Add ``reason``: why a pair is no real change, NULL if it is one."""
    return pairs.withColumn("reason", change_reason(F.col("vuln_function"), F.col("patch_function")))


def meaningful_pairs(pairs: DataFrame) -> DataFrame:
    """Drop pairs that differ in blanks or comments only."""
    return tag_change(pairs).where(F.col("reason").isNull()).drop("reason")


DEDUP_KEYS = [*COMMIT_KEYS, "file_path", "method_name", "vuln_start_line"]


def dedup_functions(
    pairs: DataFrame, keys: list[str] = DEDUP_KEYS, order: tuple[str, ...] = ("file_ord", "ord")
) -> DataFrame:
    """First pair per file, method and vulnerable start line of a commit.

    The rank filter is applied on both sides of the shuffle by the planner, so
    each task sends one row per key, whatever the size of the group.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return pairs.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") == 1).drop("_rank")


def function_counters(
    pairs: DataFrame, commit: list[str] = COMMIT_KEYS, keys: list[str] = DEDUP_KEYS
) -> DataFrame:
    """Per commit: saved, whitespace-filtered and duplicate function pairs.

    Two map-side aggregations, first by duplicate key, then by commit; no rank
    over a whole commit is needed to count what a rank would drop.
    """
    tagged = tag_change(complete_pairs(pairs))
    real = F.col("reason").isNull()
    per_key = tagged.groupBy(*keys, real.alias("_real")).agg(F.count("*").alias("_n"))
    return per_key.groupBy(*commit).agg(
        F.count_if(F.col("_real")).alias("saved"),
        F.coalesce(F.sum(F.when(~F.col("_real"), F.col("_n"))), F.lit(0)).alias("skipped_whitespace"),
        F.coalesce(F.sum(F.when(F.col("_real"), F.col("_n") - 1)), F.lit(0)).alias("skipped_duplicate"),
    )
