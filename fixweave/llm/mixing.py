"""Mixing sources to target weights along a time-varying curriculum.

Sources share a budget of words by weight, but none more than a multiple of its
size; what it cannot use is shared again. The weight of a source changes linearly
over training time t in [0, 1]: ``w(t) = w * (1 + slope * (2 t - 1))``, which keeps
the mean. The integral of its weight is the source's cumulative demand, and a
document that follows p of its source's words stands at the time when the demand
reaches p. Documents of a source are taken in a fixed pseudo-random order, again
and again until its target is reached, the last one in part if need be.

Running sums are taken in two levels, over hash buckets of a source and inside a
bucket, so a source with most of the rows is never in one task. Only one row per
source meets in the windows that rank the sources.

Null texts have no words. A null source is a source, the last one. Documents
without words take nothing and have no position. Rows that repeat an id are
documents of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixweave.session import staged

WEIGHTS = (3, 1, 2)
# Change of a source's weight over the run, repeating like the weights.
SLOPES = (-0.5, 0.0, 0.5)
SHARE, CAP = 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
# Hexadecimal digits of the order key that make a bucket.
_DIGITS = 3


def _repeating(values: tuple, rank: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.col(rank) - 1, F.lit(len(values))) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Sources with their word count, weight and target; ``sizes`` has source and size.

    With the sources in order of cap / weight, giving their cap to the first k and
    sharing the rest by weight gives a level for each k; the largest level is the
    one at which resharing ends.
    """
    found = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = found.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", _repeating(weights, "rank").cast("long"))
    limit = (F.col("source_size") * cap).alias("limit")
    order = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    everyone = Window.partitionBy(F.lit(1))
    levels = ranked.select("*", limit).withColumn(
        "level", (F.sum("source_size").over(everyone) * F.lit(share) - before) / rest
    )
    return levels.withColumn("level", F.max("level").over(everyone)).select(
        "source", "rank", "weight", "source_size",
        F.least(F.col("limit").cast("double"), F.col("level") * F.col("weight")).alias("target"),
    )


def mix_plan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple = WEIGHTS, slopes: tuple = SLOPES, share: float = SHARE, cap: int = CAP,
) -> DataFrame:
    """Per row: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken`` and ``passes``.

    ``passes`` lists the times the document is taken: its ``words`` and training
    ``position`` in words from the start.
    """
    sized = staged(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.coalesce(F.md5(F.col(id_col).cast("string")), F.lit("")).alias("key"),
        ), "sizes",
    )
    targets = staged(source_targets(sized, weights, share, cap), "targets")
    bucket = F.substring("key", 1, _DIGITS)
    sums = sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("held"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("bucket", bucket).withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    placed = placed.withColumn("start", F.col("start") + F.col("ahead")).drop("s", "b", "ahead", "bucket", "key")
    about = targets.select(
        F.col("source").alias("s"), "source_size", "target", _repeating(slopes, "rank").cast("double").alias("slope"),
        F.sum("target").over(Window.partitionBy(F.lit(1))).alias("total"),
    )
    placed = placed.join(about, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # One entry for each pass over the source that the target reaches.
    quota = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(quota / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("int")

    def one(number: Column) -> Column:
        before = number * F.col("source_size") + F.col("start")
        words = F.greatest(F.lit(0), F.least(F.col("size"), quota - before)).cast("long")
        return F.struct(words.alias("words"), (demand_time(F.try_divide(before, F.col("target")), F.col("slope")) * F.col("total")).alias("position"))

    passes = F.filter(F.transform(F.sequence(F.lit(0), whole), one), lambda p: p["words"] > 0)
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce(passes, F.array()).alias("passes")
    ).withColumn("taken", F.aggregate("passes", F.lit(0).cast("long"), lambda acc, p: acc + p["words"]))


def demand_time(part: Column, slope: Column) -> Column:
    """Time at which a source's cumulative demand reaches the given part of its words.

    The demand is ``slope * t**2 + (1 - slope) * t``; this form of the root also
    holds for a slope of zero.
    """
    linear = F.lit(1.0) - slope
    return F.lit(2.0) * part / (linear + F.sqrt(linear * linear + F.lit(4.0) * slope * part))


def training_order(plan: DataFrame) -> DataFrame:
    """Documents of a plan range-sorted by their first training position, those not taken last."""
    first = F.coalesce(F.get("passes", F.lit(0))["position"], F.lit(float("inf")))
    placed = staged(plan.withColumn("first_position", first), "positions")
    return placed.repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position", "doc_id")
