"""Training rows from function pairs: labels, features and a stratified split."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fixweave.functions.features import FEATURES, feature
from fixweave.functions.pytext import not_blank
from fixweave.session import staged

# ---- fixed values: labels of the two sides, and the seed and share of the split
VULNERABLE = 1
PATCHED = 0
SEED = 42
TEST_SHARE = "0.2"


def drop_empty_pairs(pairs: DataFrame) -> DataFrame:
    """Drop rows in which both sides are NULL."""
    return pairs.dropna(how="all", subset=["vuln_function", "patch_function"])


def label_pairs(pairs: DataFrame, *carry: str) -> DataFrame:
    """Two labelled rows per pair, made in one pass: (vulnerable, 1) and (patched, 0)."""
    both = F.array(
        F.struct(F.col("vuln_function").alias("code"), F.lit(VULNERABLE).alias("label")),
        F.struct(F.col("patch_function").alias("code"), F.lit(PATCHED).alias("label")),
    )
    return pairs.select(*carry, F.inline(both))


def drop_blank_code(rows: DataFrame) -> DataFrame:
    """Drop rows whose code is NULL or blank."""
    return rows.where(not_blank(F.col("code")))


def build_features(rows: DataFrame, code: str = "code") -> DataFrame:
    """Add the nine feature columns."""
    return rows.withColumns({name: feature(name, F.col(code)) for name in FEATURES})


def _label_quotas(counts: DataFrame, label: str, test_share: str) -> DataFrame:
    """Test rows per label from rows (label, n): the total is fixed first and shared out by largest remainder.

    Works on one row per label, so the windows without partition are tiny.
    """
    everything = Window.partitionBy()
    counts = counts.withColumn("total", F.sum("n").over(everything))
    share = F.lit(Decimal(test_share))
    counts = counts.withColumn("train_total", F.col("total") - F.ceil(F.col("total") * share))
    counts = counts.withColumn("floor", F.expr("n * train_total div total")).withColumn(
        "rest", F.expr("(n * train_total) % total")
    )
    by_rest = Window.partitionBy().orderBy(F.desc("rest"), label)
    missing = F.col("train_total") - F.sum("floor").over(everything)
    train = F.col("floor") + F.when(F.row_number().over(by_rest) <= missing, 1).otherwise(0)
    return counts.select(label, (F.col("n") - train).alias("take"))


def _cut(histogram: DataFrame, wanted: DataFrame, label: str) -> DataFrame:
    """Per label the bucket in which the first ``take`` rows end, and how many of its rows they take."""
    upto = Window.partitionBy(label).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = histogram.withColumn("_upto", F.sum("_n").over(upto)).join(wanted, label)
    last = reached.where((F.col("_upto") >= F.col("take")) & (F.col("_upto") - F.col("_n") < F.col("take")))
    return last.select(label, "_bucket", (F.col("take") - F.col("_upto") + F.col("_n")).alias("take"))


# Hex digits of the digest by which rows are counted, at each of two levels.
_DIGITS = 3


def split_thresholds(
    rows: DataFrame, label: str, key: list[str], test_share: str = TEST_SHARE, seed: int = SEED
) -> DataFrame:
    """Per label the last row of its test share in digest order, as (digest, key).

    Two scans of ``label`` and ``key``: the first counts rows per head of the
    digest, the second keeps the rows of the one head in which a label's share
    ends. These, a 4096th of the label, are counted by the next digits, and the
    threshold is picked among the few rows that agree in these as well.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    hashed = rows.where(F.col(label).isNotNull()).select(label, F.struct(digest.alias("digest"), *key).alias("_at"))

    def histogram(df: DataFrame, place: int) -> DataFrame:
        bucket = F.substring("_at.digest", 1 + place * _DIGITS, _DIGITS).alias("_bucket")
        return df.groupBy(label, bucket).agg(F.count("*").alias("_n"))

    def inside(df: DataFrame, cut: DataFrame, place: int) -> DataFrame:
        bucket = F.substring("_at.digest", 1 + place * _DIGITS, _DIGITS)
        return df.withColumn("_bucket", bucket).join(cut, [label, "_bucket"]).drop("_bucket")

    coarse = histogram(hashed, 0)
    quotas = _label_quotas(coarse.groupBy(label).agg(F.sum("_n").alias("n")), label, test_share)
    # One row per label: a table of known, small size, so its joins need no exchange of rows.
    cut = staged(_cut(coarse, quotas.where("take > 0"), label), "split-cut")
    rest = staged(inside(hashed, cut, 0), "split-rest")
    finer = _cut(histogram(rest.drop("take"), 1), cut.select(label, "take"), label)
    few = inside(rest.drop("take"), finer, 1)
    ordered = few.groupBy(label).agg(F.max("take").alias("take"), F.sort_array(F.collect_list("_at")).alias("at"))
    return staged(ordered.select(label, F.get("at", (F.col("take") - 1).cast("int")).alias("_last")), "split-thresholds")


def stratified_split(
    rows: DataFrame, label: str, key: list[str], test_share: str = TEST_SHARE, seed: int = SEED
) -> DataFrame:
    """Add ``is_test``: an exact and repeatable share of every label.

    Rows are taken in the order of a seeded hash of ``key``, which must tell
    rows of a label apart. A label may hold half of all rows, so none is sorted:
    the last row of each share is found first (``split_thresholds``), and every
    row is compared with it where it lies. Rows without a label are no test rows.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    last = split_thresholds(rows, label, key, test_share, seed)
    placed = rows.withColumn("_at", F.struct(digest.alias("digest"), *key)).join(last, label, "left")
    return placed.select(*rows.columns, F.coalesce(F.col("_at") <= F.col("_last"), F.lit(False)).alias("is_test"))


def dataset_summary(rows: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """One row: number of rows and the feature list."""
    return rows.agg(F.count("*").alias("rows"), F.lit(",".join(features)).alias("features"))
