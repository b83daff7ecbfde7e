"""Exact duplicates by counting quotient filters and a comparison of bytes.

Texts are equal when they agree after all ASCII white space is deleted. Each
partition puts the 64-bit fingerprints of its texts into counting quotient
filters: the high bits of a fingerprint (the quotient) name a run, the low bits
(the remainder) are kept sorted inside it with a counter, so a filter loses
nothing and filters merge by merging their sorted remainders. Blocks of quotients
are shuffled and merged; only fingerprints counted more than once are suspects.
Texts of suspects are compared byte by byte: they are grouped by their bytes, with
repeats folded before the shuffle, so a huge group of copies moves a few texts per
partition.

Of equal texts the row with the most code points in its original text stays, then
the one with the smallest id; a null id comes last, and of rows that repeat an id
one stays. Null counts as the empty text, and all empty texts are equal.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixweave.llm.arrow import Output, Shared, rows, texts
from fixweave.session import staged

SPACE = b" \t\n\r\x0b\x0c"
QUOTIENT_BITS = 24
# Fingerprints of one filter before it is cut into blocks, and of one merged block on average.
FILTERED, BLOCK = 2_000_000, 400_000
# Bits of the broadcast bitmap of suspects: 1 MB whatever the input.
SUSPECT_BITS = 23
# Bytes of texts folded together before the shuffle.
FOLDED_BYTES = 16 << 20

_DIGEST = "row long, doc_id long, points long, sha binary, fp long"
_RUNS = "block int, quotients binary, lengths binary, remainders binary, counts binary"


def normalised(text: bytes | None) -> bytes:
    return text.translate(None, SPACE) if text else b""


class CountingQuotientFilter:
    """Multiset of 64-bit fingerprints as runs of sorted remainders with counters."""

    def __init__(self, quotients: np.ndarray, lengths: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.quotients, self.lengths, self.remainders, self.counts = quotients, lengths, remainders, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray) -> CountingQuotientFilter:
        order = np.argsort(fingerprints, kind="stable")
        ordered, counts = fingerprints[order], counts[order]
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.empty(0, np.int64)
        ordered, counts = ordered[first], np.add.reduceat(counts, first) if len(first) else counts
        quotient = (ordered >> np.uint64(64 - QUOTIENT_BITS)).astype(np.uint32)
        start = np.flatnonzero(np.r_[True, quotient[1:] != quotient[:-1]]) if len(quotient) else np.empty(0, np.int64)
        lengths = np.diff(np.r_[start, len(quotient)]).astype(np.uint32)
        low = ordered & np.uint64((1 << (64 - QUOTIENT_BITS)) - 1)
        return cls(quotient[start], lengths, low, counts.astype(np.uint64))

    @classmethod
    def merged(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """The filter of all their fingerprints; stable sorting merges the sorted runs."""
        return cls.of(np.concatenate([f.fingerprints() for f in filters]), np.concatenate([f.counts for f in filters]))

    def fingerprints(self) -> np.ndarray:
        high = np.repeat(self.quotients.astype(np.uint64), self.lengths)
        return high << np.uint64(64 - QUOTIENT_BITS) | self.remainders

    def repeated(self) -> np.ndarray:
        return self.fingerprints()[self.counts > 1]

    def blocks(self, blocks: int):
        """The filter cut by quotient into ``blocks`` ranges."""
        of = (self.quotients.astype(np.uint64) * np.uint64(blocks) >> np.uint64(QUOTIENT_BITS)).astype(np.int64)
        ends = np.cumsum(self.lengths, dtype=np.int64)
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else []
        for begin, end in zip(starts, [*starts[1:], len(of)]):
            low, high = (ends[begin - 1] if begin else 0), ends[end - 1]
            yield int(of[begin]), [
                self.quotients[begin:end].tobytes(), self.lengths[begin:end].tobytes(),
                self.remainders[low:high].tobytes(), self.counts[low:high].tobytes(),
            ]

    @classmethod
    def read(cls, quotients: bytes, lengths: bytes, remainders: bytes, counts: bytes) -> CountingQuotientFilter:
        return cls(
            np.frombuffer(quotients, np.uint32), np.frombuffer(lengths, np.uint32),
            np.frombuffer(remainders, np.uint64), np.frombuffer(counts, np.uint64),
        )


def _digests(batches):
    """Rows without a key of their own are numbered."""
    out = Output(_DIGEST)
    number = TaskContext.get().partitionId() << 40
    for row, doc_id, text in rows(batches, "row", "doc_id", "text"):
        sha = hashlib.sha256(normalised(text)).digest()
        points = len(text.decode("utf-8", "replace")) if text else 0
        yield from out.add(number if row is None else row, doc_id, points, sha, int.from_bytes(sha[:8], "little", signed=True))
        number += 1
    yield from out.flush()


def _filters(blocks: int):
    def cut(held: list[np.ndarray]):
        fingerprints = np.concatenate(held).view(np.uint64)
        return CountingQuotientFilter.of(fingerprints, np.ones(len(fingerprints), np.uint64)).blocks(blocks)

    def run(batches):
        out, held, waiting = Output(_RUNS, 64), [], 0
        for batch in batches:
            held.append(batch.column("fp").to_numpy())
            waiting += batch.num_rows
            if waiting >= FILTERED:
                for block, parts in cut(held):
                    yield from out.add(block, *parts)
                held, waiting = [], 0
        if waiting:
            for block, parts in cut(held):
                yield from out.add(block, *parts)
        yield from out.flush()

    return run


def _merge(batches):
    """Rows come sorted by block."""
    out, at, held = Output("fp long", 50_000), None, []

    def repeated():
        return CountingQuotientFilter.merged(held).repeated().view(np.int64).tolist() if held else []

    for block, *parts in rows(batches, "block", "quotients", "lengths", "remainders", "counts"):
        if block != at:
            for fp in repeated():
                yield from out.add(fp)
            at, held = block, []
        held.append(CountingQuotientFilter.read(*parts))
    for fp in repeated():
        yield from out.add(fp)
    yield from out.flush()


def repeated_fingerprints(digests: DataFrame, n_rows: int) -> DataFrame:
    """Fingerprints that more than one row of ``digests`` (fp) has."""
    blocks = max(1, min(1 << QUOTIENT_BITS, -(-n_rows // BLOCK)))
    runs = digests.select("fp").mapInArrow(_filters(blocks), _RUNS)
    return runs.repartition(blocks, "block").sortWithinPartitions("block").mapInArrow(_merge, "fp long")


def _suspects(fingerprints: DataFrame) -> np.ndarray:
    slot = F.col("fp").bitwiseAND(F.lit((1 << SUSPECT_BITS) - 1).cast("long"))
    bits = fingerprints.select((slot / 64).cast("long").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int")).alias("bit"))
    found = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (SUSPECT_BITS - 6), np.uint64)
    bitmap[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return bitmap


def _same_bytes(bitmap):
    """Normalised texts of suspects with the rows that have them, repeats folded."""

    def run(batches):
        out, bits = Output("sha binary, body binary, size long", 200), bitmap.value
        held: dict[bytes, int] = {}
        waiting = 0
        for (text,) in rows(batches, "text"):
            body = normalised(text)
            slot = int.from_bytes(hashlib.sha256(body).digest()[:8], "little") & ((1 << SUSPECT_BITS) - 1)
            if not int(bits[slot >> 6]) >> (slot & 63) & 1:
                continue
            waiting += len(body) if body not in held else 0
            held[body] = held.get(body, 0) + 1
            if waiting >= FOLDED_BYTES:
                for body, size in held.items():
                    yield from out.add(hashlib.sha256(body).digest(), body, size)
                held, waiting = {}, 0
        for body, size in held.items():
            yield from out.add(hashlib.sha256(body).digest(), body, size)
        yield from out.flush()

    return run


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` for every row; see the module text.

    ``row_col`` names a column of distinct longs that tells rows apart; it is returned, too.
    """
    row = F.col(row_col).cast("long") if row_col else F.lit(None).cast("long")
    spark, plain = docs.sparkSession, texts(docs, id_col, text_col, row=row)
    digests = staged(plain.mapInArrow(_digests, _DIGEST), "digests")
    suspects = staged(repeated_fingerprints(digests, digests.count()), "suspects")
    bitmap = Shared(spark, _suspects(suspects))
    bodies = plain.select("text").mapInArrow(_same_bytes(bitmap), "sha binary, body binary, size long")
    # The grouping key is the bytes themselves; a digest with two bodies would stop the job.
    bodies = bodies.groupBy("sha", "body").agg(F.sum("size").alias("size"))
    groups = bodies.groupBy("sha").agg(F.max("size").alias("size"), F.count("*").alias("bodies")).where("size > 1")
    groups = groups.where(
        F.when(F.col("bodies") > 1, F.raise_error(F.lit("two texts have one SHA-256 digest")).cast("boolean")).otherwise(True)
    ).select("sha", "size")
    rank = F.struct("points", (-F.col("doc_id")).alias("low_id"), (-F.col("row")).alias("low_row"))
    best = digests.join(groups, "sha").groupBy("sha").agg(F.max(rank).alias("best"), F.first("size").alias("size"))
    best = best.select("sha", "size", (-F.col("best.low_id")).alias("keep_id"), (-F.col("best.low_row")).alias("keep_row"))
    alone = F.col("size").isNull()
    return digests.join(best, "sha", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        *([F.col("row").alias(row_col)] if row_col else []),
    )
