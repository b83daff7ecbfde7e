"""Small DataFrame helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add costly columns that are evaluated once per row.

    A filter on an ordinary derived column is pushed below it by copying the
    expression into the filter, so a parsed document or a cut text would be made
    again for every use in every filter. The columns are therefore emitted by a
    one-row generator, which filters do not pass.
    """
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def large(df: DataFrame) -> DataFrame:
    """Mark ``df`` as a join side that is never broadcast, nor the side it meets.

    The planner takes a stored table for as large as its files. Columns that repeat
    from row to row are packed a hundredfold there, so that millions of rows look
    small enough to be broadcast, by way of the driver.
    """
    return df.hint("merge")


# Slots of the broadcast membership bitmap per wanted key, and its bounds in bits: 8 KB to 256 KB.
_SLOTS_PER_KEY, _LEAST_BITS, _MOST_BITS = 8, 16, 21


def pruned(df: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """Rows of ``df`` whose keys may be among those of the stored table ``wanted``.

    Rows that a join on ``keys`` would drop are left out before its shuffle, so
    wide rows move only where they are needed. The keys are held as a bitmap of
    hashed slots; its size follows the number of rows up to a fixed bound, so it may
    always be broadcast. Beyond the bound it prunes less. A few rows pass that no
    key asks for: the join still has to follow. Rows with a NULL key are left out.
    """
    n = wanted.count()
    bits = min(_MOST_BITS, max(_LEAST_BITS, (n * _SLOTS_PER_KEY).bit_length()))
    slot = F.pmod(F.xxhash64(*keys), F.lit(1 << bits))
    word, bit = F.shiftright(slot, 6), (slot % 64).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    marks = wanted.select(word.alias("_word"), one.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    marked = df.withColumn("_word", word).join(F.broadcast(marks), "_word")
    hit = F.call_function("shiftrightunsigned", F.col("_bits"), bit).bitwiseAND(F.lit(1).cast("bigint")) == 1
    known = [F.col(key).isNotNull() for key in keys]
    return marked.where(reduce(lambda a, b: a & b, known, hit)).select(*df.columns)
