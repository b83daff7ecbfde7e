"""Near-duplicate join on word shingles with a token-group matrix.

A document is the set of its distinct word shingles. Two documents link when the
Jaccard similarity of their sets is at least a threshold. The join is exact and
never forms the pairs of a group of copies:

1. Documents with equal sets are one class; one document stands for it.
2. Classes that share minhash values with a leader are compared with that leader
   alone. What links becomes one group, connected through its leader.
3. Groups are the columns of the token-group matrix. A class queries the groups of
   others: shingles are ordered by how common they are (then by hash), and a link
   implies that the rare ends of the query and of a member share some part, so the
   ends, merged per group, bound the overlap and give the (query, group) candidates.
4. A candidate group is laid out in blocks of members. The block's token union
   bounds the overlap of the query with any member; only blocks whose bound
   reaches the threshold are opened, and members compared one by one.
5. Connected components of the links found.

Only the (shingle, class) entries of rare ends are shuffled, as sorted blobs.
Shingles that only one class has leave at the first step. The order table is the
one broadcast, of at most ``ORDERED`` entries; any table gives the same links.

Results for odd input: a null or wordless text has no shingles and links with
nothing; a text of fewer words than a shingle is one shingle; rows that repeat an
id are one node and keep one row each; a null id gets the class's smallest id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixweave.llm.arrow import Output, Shared, arrow_schema, rows, texts
from fixweave.llm.scale import components, pruned
from fixweave.session import staged

WORDS = 5
# Similarity threshold as a fraction of integers.
NUM, DEN = 4, 5
# Entries of the order table: the most common shingles, 9 bytes each on the wire.
ORDERED = 1 << 20
# Shingles counted together; those met twice among them are proposed for the order table.
COUNTED = 3_000_000
# Entries of a blob batch before it is cut by bucket, and bytes of a bucket.
ENTRIES, BUCKET_BYTES = 800_000, 12 << 20
# Queries above the first size must share one more shingle of the rare end for each so
# many. Opening small sets is cheap, so for them longer ends would not pay.
ALONE, SHARED = 200, 20
# Members of a block of the matrix, and queries of one cell.
MEMBERS, QUERIES = 64, 1024

_SEEDS = np.random.default_rng(20240601).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MINS = 4


class _WordHashes(dict):
    """Hashes of the words met so far; forgets all of them when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


class Shingler:
    """Sorted distinct 64-bit shingle hashes of a text."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.hashes = _WordHashes()

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else []
        n = len(words)
        if not n:
            return np.empty(0, np.uint64)
        hashed = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, n)
        width = min(n, self.words)
        count = n - width + 1
        mixed = np.full(count, _SEEDS[width], np.uint64)
        for at in range(width):
            mixed += hashed[at:at + count] * _SEEDS[at]
            mixed ^= mixed >> np.uint64(29)
        mixed *= _MIX
        mixed ^= mixed >> np.uint64(32)
        mixed.sort()
        return distinct(mixed)


def distinct(ordered: np.ndarray) -> np.ndarray:
    if len(ordered) < 2:
        return ordered
    keep = np.empty(len(ordered), bool)
    keep[0] = True
    np.not_equal(ordered[1:], ordered[:-1], out=keep[1:])
    return ordered[keep]


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _minhashes(tokens: np.ndarray) -> list[int]:
    return [int(signed((tokens * seed).min()[None])[0]) for seed in _SEEDS[-_MINS:]]


# ---- one row per document, and the common shingles -----------------------------------
_PROFILE = "doc_id long, n long, digest binary, owner long, mins array<long>, tokens array<long>, counts array<long>"


def _counted(arrays: list[np.ndarray]) -> tuple[list[int], list[int]]:
    held = np.concatenate(arrays)
    held.sort()
    tokens, more = np.unique(held[1:][held[1:] == held[:-1]], return_counts=True)
    return signed(tokens).tolist(), (more + 1).tolist()


def _profile(words: int):
    def run(batches):
        shingle, out = Shingler(words), Output(_PROFILE)
        pending, waiting, seen = [], 0, set()
        for doc_id, text in rows(batches, "doc_id", "text"):
            tokens = shingle(text)
            if not len(tokens):
                yield from out.add(doc_id, 0, None, None, None, None, None)
                continue
            digest = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
            yield from out.add(doc_id, len(tokens), digest, _owner(digest), _minhashes(tokens), None, None)
            if digest not in seen:
                seen.add(digest)
                pending.append(tokens)
                waiting += len(tokens)
            if waiting >= COUNTED:
                yield from out.add(None, None, None, None, None, *_counted(pending))
                pending, waiting, seen = [], 0, set()
        if pending:
            yield from out.add(None, None, None, None, None, *_counted(pending))
        yield from out.flush()

    return run


class ShingleOrder:
    """Position of a shingle: rare ones first by hash, common ones after by how common they are."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        order = np.argsort(tokens)
        self.tokens = tokens[order]
        self.levels = np.log2(np.maximum(counts[order], 1)).astype(np.uint8)

    def first(self, tokens: np.ndarray, length: int) -> np.ndarray:
        if not len(self.tokens):
            return tokens[:length]
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        level = np.where(self.tokens[at] == tokens, self.levels[at], 0).astype(np.uint8)
        return tokens[np.argsort(level, kind="stable")[:length]]


def _order_table(profile: DataFrame) -> ShingleOrder:
    proposed = profile.where("tokens is not null").select(F.explode(F.arrays_zip("tokens", "counts")).alias("t"))
    summed = proposed.groupBy(F.col("t.tokens").alias("token")).agg(F.sum("t.counts").alias("count"))
    # Bounded by ORDERED; the tie rule makes reruns agree.
    top = summed.orderBy(F.desc("count"), "token").limit(ORDERED).toArrow()
    return ShingleOrder(
        top.column("token").to_numpy().view(np.uint64).copy(), top.column("count").to_numpy().copy()
    )


# ---- entries of rare ends ---------------------------------------------------------------
_BLOB = "bucket int, tokens binary, owners binary"
_ENTRY = "token long, owner long, stored boolean"


def needed(size: int) -> int:
    """Shingles of its rare end that a query of this size must share with a group."""
    return 1 + max(0, size - ALONE) // SHARED


def _ends(size: int) -> tuple[int, int]:
    """Lengths of the rare end of a query and of a stored (not larger) set.

    Sets that share m shingles share c of the first ``size - m + c`` in any order;
    c grows with the query, which has at most DEN / NUM times the stored size.
    """
    query = size - -(-NUM * size // DEN) + needed(size)
    stored = size - -(-2 * NUM * size // (NUM + DEN)) + needed(DEN * size // NUM)
    return min(size, query), min(size, stored)


def _owner(digest: bytes) -> int:
    """Class key of 62 bits; two classes with one key only cause needless candidates."""
    return int.from_bytes(digest[:8], "little") >> 2


def _entries(words: int, order, buckets: int):
    def cut(tokens: list[np.ndarray], owners: list[np.ndarray]) -> Iterator[tuple]:
        token, owner = np.concatenate(tokens), np.concatenate(owners)
        bucket = ((token >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
        by = np.argsort(bucket, kind="stable")
        token, owner, bucket = token[by], owner[by], bucket[by]
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        for start, end in zip(starts, [*starts[1:], len(bucket)]):
            yield int(bucket[start]), token[start:end].tobytes(), owner[start:end].tobytes()

    def run(batches):
        shingle, out = Shingler(words), Output(_BLOB, 64)
        table = order.value
        tokens, owners, waiting, seen = [], [], 0, set()
        for (text,) in rows(batches, "text"):
            held = shingle(text)
            if not len(held):
                continue
            owner = _owner(hashlib.blake2b(held.tobytes(), digest_size=16).digest())
            if owner in seen:
                continue
            seen.add(owner)
            query, stored = _ends(len(held))
            end = table.first(held, query)
            tokens.append(end)
            owners.append((np.arange(query) < stored).astype(np.int64) + owner * 2)
            waiting += query
            if waiting >= ENTRIES:
                for row in cut(tokens, owners):
                    yield from out.add(*row)
                tokens, owners, waiting, seen = [], [], 0, set()
        if tokens:
            for row in cut(tokens, owners):
                yield from out.add(*row)
        yield from out.flush()

    return run


def _shared(batches):
    """Entries of shingles that more than one class has; rows come sorted by bucket."""
    schema = arrow_schema(_ENTRY)
    bucket, tokens, owners = None, [], []
    for b, t, o in rows(batches, "bucket", "tokens", "owners"):
        if b != bucket and tokens:
            yield _shared_of(tokens, owners, schema)
            tokens, owners = [], []
        bucket = b
        tokens.append(t)
        owners.append(o)
    if tokens:
        yield _shared_of(tokens, owners, schema)


def _shared_of(tokens: list[bytes], owners: list[bytes], schema: pa.Schema) -> pa.RecordBatch:
    token = np.frombuffer(b"".join(tokens), np.uint64)
    owner = np.frombuffer(b"".join(owners), np.int64)
    # First the shingles met more than once, then the repeats of a class among them.
    by = np.argsort(token)
    token, owner = token[by], owner[by]
    same = token[1:] == token[:-1]
    kept = np.r_[same, False] | np.r_[False, same]
    token, owner = token[kept], owner[kept]
    by = np.lexsort((owner, token))
    token, owner = token[by], owner[by]
    if len(token):
        new = np.r_[True, (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])]
        token, owner = token[new], owner[new]
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        sizes = np.diff(np.r_[starts, len(token)])
        stored = np.add.reduceat(owner & 1, starts)
        kept = np.repeat((sizes > 1) & (stored > 0), sizes)
        token, owner = token[kept], owner[kept]
    return pa.RecordBatch.from_arrays(
        [pa.array(signed(token)), pa.array(owner >> 1), pa.array((owner & 1).astype(bool))], schema=schema
    )


# ---- opening groups ------------------------------------------------------------------------
class GroupBlock:
    """A column of the token-group matrix: the members' sets and their union."""

    def __init__(self, members: list[tuple[int, np.ndarray]]):
        self.members = members
        self.union = members[0][1] if len(members) == 1 else np.unique(np.concatenate([m for _, m in members]))

    def partner(self, query: np.ndarray) -> int | None:
        """A member that links with the query, if there is one."""
        if overlap(query, self.union) * DEN < NUM * len(query):
            return None
        for member, tokens in self.members:
            low, high = sorted((len(query), len(tokens)))
            if low * DEN >= NUM * high and overlap(query, tokens) * (NUM + DEN) >= NUM * (low + high):
                return member
        return None


def overlap(left: np.ndarray, right: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays without repeats."""
    if len(left) > len(right):
        left, right = right, left
    if not len(left):
        return 0
    at = np.minimum(np.searchsorted(right, left), len(right) - 1)
    return int(np.count_nonzero(right[at] == left))


def _open(words: int):
    def run(batches):
        shingle, out = Shingler(words), Output("query long, member long")
        cell, members, block = None, [], None
        for grp, part, slot, role, node, text in rows(batches, "grp", "part", "slot", "role", "node", "text"):
            if cell != (grp, part, slot):
                cell, members, block = (grp, part, slot), [], None
            if role == 0:
                members.append((node, shingle(text)))
                continue
            if block is None and members:
                block = GroupBlock(members)
            found = block.partner(shingle(text)) if block else None
            if found is not None and found != node:
                yield from out.add(node, found)
        yield from out.flush()

    return run


def open_groups(docs: DataFrame, candidates: DataFrame, members: DataFrame, words: int = WORDS) -> DataFrame:
    """Links ``(query, member)``, at most one for each candidate and block.

    ``candidates`` (query, grp) and ``members`` (grp, node) name documents of
    ``docs`` (doc_id, text). Blocks hold about ``MEMBERS`` members; queries are
    streamed past a block, ``QUERIES`` to a cell, so no group meets in one task.
    """
    spread = candidates.groupBy("grp").agg(F.ceil(F.count("*") / QUERIES).alias("slots"))
    sizes = members.join(spread, "grp", "left_semi").groupBy("grp").agg(F.ceil(F.count("*") / MEMBERS).alias("parts"))
    shape = staged(spread.join(sizes, "grp"), "shape")
    hashed = F.xxhash64("node")
    queries = (
        candidates.withColumnRenamed("query", "node").join(shape, "grp")
        .select("grp", "node", F.lit(1).alias("role"), F.pmod(F.xxhash64("node", "grp"), "slots").alias("slot"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    )
    stored = (
        members.join(shape, "grp")
        .select("grp", "node", F.lit(0).alias("role"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot"), F.pmod(hashed, "parts").alias("part"))
    )
    placed = staged(queries.unionByName(stored), "cells")
    found = pruned(docs, "doc_id", placed.select("node")).withColumnRenamed("doc_id", "node")
    cells = (
        placed.join(found, "node")
        .repartition("grp", "part", "slot")
        .sortWithinPartitions("grp", "part", "slot", "role", "node")
        .select("grp", "part", "slot", "role", "node", "text")
    )
    return cells.mapInArrow(_open(words), "query long, member long")


# ---- the join --------------------------------------------------------------------------------
def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` for every row; see the module text."""
    plain = texts(docs, id_col, text_col)
    spark = docs.sparkSession
    profile = staged(plain.mapInArrow(_profile(words), _PROFILE), "profile")
    described = profile.where("n is not null")
    order = Shared(spark, _order_table(profile))
    size = described.agg(F.sum("n")).first()[0] or 0

    classes = staged(
        described.where("n > 0").groupBy("digest", "owner").agg(
            F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("mins").alias("mins")
        ), "classes",
    )
    # Entries of 16 bytes; a query's end is about a quarter of its set.
    buckets = max(1, -(-16 * (size // 4 + described.count()) // BUCKET_BYTES))
    entries = (
        plain.select("text").mapInArrow(_entries(words, order, buckets), _BLOB)
        .repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_shared, _ENTRY)
    )
    stars = staged(open_groups(plain, _leaders(classes), _self_groups(classes), words), "stars")
    roots = components(stars)
    grouped = staged(
        classes.select("rep", "owner", "n").where("rep is not null")
        .join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        .select("rep", "owner", "n", F.coalesce("root", "rep").alias("grp")), "grouped",
    )
    queries = _candidates(staged(entries, "entries"), grouped)
    members = grouped.select("grp", F.col("rep").alias("node"))
    links = open_groups(plain, staged(queries, "candidates"), members, words)
    # Groups are connected already, so the links found join groups.
    of = grouped.select(F.col("rep").alias("member"), "grp").distinct()
    ties = links.join(of, "member").select("query", F.col("grp").alias("b"))
    ties = ties.join(of.withColumnRenamed("member", "query"), "query").select(F.col("grp").alias("a"), "b")
    final = components(ties).withColumnsRenamed({"node": "grp", "root": "last"})
    found = grouped.join(final, "grp", "left").select("rep", F.coalesce("last", "grp").alias("component_id")).distinct()
    labels = classes.select("digest", "rep").join(found, "rep", "left").select("digest", "component_id")
    return described.join(labels, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def _leaders(classes: DataFrame) -> DataFrame:
    """Classes with the smallest class that shares at least two minhash values with them."""
    each = classes.where("rep is not null").select("rep", F.posexplode("mins").alias("at", "value"))
    leader = each.groupBy("at", "value").agg(F.min("rep").alias("grp"), F.count("*").alias("held")).where("held > 1")
    pairs = each.join(leader.drop("held"), ["at", "value"]).where("rep <> grp").groupBy("rep", "grp").count()
    return staged(pairs.where("count > 1").select(F.col("rep").alias("query"), "grp"), "leaders")


def _self_groups(classes: DataFrame) -> DataFrame:
    return classes.where("rep is not null").select(F.col("rep").alias("grp"), F.col("rep").alias("node"))


def _candidates(entries: DataFrame, grouped: DataFrame) -> DataFrame:
    """Distinct (query, grp) whose rare ends share enough and whose sizes allow a link."""
    held = entries.join(grouped, "owner")
    stored = held.where("stored").groupBy("token", "grp").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    query = held.select("token", "rep", "n", F.col("grp").alias("own")).distinct()
    met = query.join(stored, "token").where(
        (F.col("grp") != F.col("own")) & (F.col("low") <= F.col("n")) & (F.col("high") * DEN >= F.col("n") * NUM)
    )
    shared = met.groupBy("rep", "grp", "n").agg(F.count("*").alias("shared"))
    return shared.where(F.col("shared") > F.floor(F.greatest(F.lit(0), F.col("n") - ALONE) / SHARED)).select(F.col("rep").alias("query"), "grp").distinct()
