"""Distributed building blocks: size-bounded row filters and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixweave.session import staged

# Bits of the broadcast membership bitmap: 2**17 rows of one long, at most 2 MB whatever the input.
BITMAP_BITS = 23


def _slot(column: Column) -> tuple[Column, Column]:
    place = F.pmod(F.xxhash64(column), F.lit(1 << BITMAP_BITS))
    return (place / 64).cast("long"), (place % 64).cast("int")


def _marked(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``df`` with ``_maybe``: whether a row's key may be among ``keys``, by a broadcast bitmap of fixed size."""
    word, bit = _slot(F.col(keys.columns[0]))
    bits = keys.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_bit"))
    bits = bits.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    word, bit = _slot(F.col(key))
    held = df.withColumn("_word", word).join(F.broadcast(bits), "_word", "left")
    hit = F.call_function("shiftrightunsigned", F.col("_bits"), bit).bitwiseAND(F.lit(1).cast("long")) == 1
    return held.withColumn("_maybe", F.col(key).isNotNull() & F.coalesce(hit, F.lit(False))).drop("_word", "_bits")


def pruned(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key may be among the ``wanted`` keys.

    Most rows that an exact join would drop thus never reach its shuffle. The
    bitmap only lets too much through: the exact join still has to follow. Null
    keys are dropped.
    """
    return _marked(df, key, wanted).where("_maybe").select(*df.columns)


def without(df: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key is not in the stored table ``dropped``; rows with a null key stay.

    Only rows that the bitmap cannot clear are shuffled for the exact join.
    """
    marked = _marked(df, key, dropped)
    ids = dropped.select(F.col(dropped.columns[0]).alias("_id"))
    unsure = marked.where("_maybe").join(ids, F.col(key) == F.col("_id"), "left_anti")
    return marked.where("not _maybe").select(*df.columns).unionByName(unsure.select(*df.columns))


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Node and smallest reachable node for all but the smallest nodes: ``(node, root)``.

    ``edges`` has two columns. Alternates large and small stars until nothing
    changes; every round is a written table, so a lost executor costs one round
    at most. Nothing but a count and a checksum reaches the driver.
    """
    a, b = edges.columns
    current = staged(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    seen = _checksum(current)
    while seen[0]:
        current = staged(_stars(current), "stars")
        now = _checksum(current)
        if now == seen:
            break
        seen = now
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _checksum(edges: DataFrame) -> tuple:
    mixed = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), mixed).first())
