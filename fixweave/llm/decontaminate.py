"""Benchmark passages in documents, found by multi-pattern search over words.

The patterns are the windows of ten consecutive words of every benchmark item; an
item of fewer words is one pattern. A Wu-Manber table for each pattern length
holds, for every block of two words inside a pattern, how far the search may jump;
words and blocks that no pattern has jump almost a whole window. Where the jump is
zero, the block's bucket gives the patterns that end in it, told apart by their
first block, and a direct comparison confirms the occurrence.

The benchmark reaches the tasks in blocks of about ``BLOCK_BYTES`` of text, one at a
time: what a pass found is stored with the texts, and its block is given back before the
next one is read. A benchmark of any size is searched in as many passes.

Null or wordless documents have no words and no hits; null or wordless items have
no patterns; items that repeat a text all count; an item with a null id hits words
but is not among the ids.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixweave.llm.arrow import Output, Shared, rows, texts
from fixweave.session import staged

WINDOW = 10
# Bytes of benchmark text that are turned into one broadcast table.
BLOCK_BYTES = 16 << 20

# Digits, letters and everything outside ASCII stay, A-Z become a-z, all else is a gap.
_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def letters_and_digits(text: bytes | None) -> list[bytes]:
    return text.translate(_WORDS).split() if text else []


class WuManber:
    """Occurrences of patterns of one length over word numbers."""

    def __init__(self, length: int):
        self.length = length
        self.block = min(2, length)
        self.jump: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, list[tuple]]] = defaultdict(lambda: defaultdict(list))

    def add(self, pattern: tuple[int, ...]) -> None:
        for end in range(self.block, self.length + 1):
            block = pattern[end - self.block:end]
            self.jump[block] = min(self.jump.get(block, self.length), self.length - end)
        self.buckets[pattern[-self.block:]][pattern[:self.block]].append(pattern)

    def find(self, words: list[int]):
        """Pattern and first position of every occurrence."""
        length, block, end = self.length, self.block, self.length
        far, jump = length - block + 1, self.jump
        while end <= len(words):
            tail = tuple(words[end - block:end])
            step = jump.get(tail, far)
            if step:
                end += step
                continue
            start = end - length
            for pattern in self.buckets[tail].get(tuple(words[start:start + block]), ()):
                if tuple(words[start:end]) == pattern:
                    yield pattern, start
            end += 1


class Passages:
    """Searches a text for the passages of some benchmark items."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        self.items: dict[tuple, set[str]] = defaultdict(set)
        self.tables: dict[int, WuManber] = {}
        for item_id, text in items:
            words = [self.numbers.setdefault(w, len(self.numbers)) for w in letters_and_digits(text)]
            length = min(window, len(words))
            for start in range(len(words) - length + 1 if length else 0):
                pattern = tuple(words[start:start + length])
                if pattern not in self.items:
                    self.tables.setdefault(length, WuManber(length)).add(pattern)
                found = self.items[pattern]
                if item_id is not None:
                    found.add(item_id)
        for table in self.tables.values():
            table.buckets = {tail: dict(heads) for tail, heads in table.buckets.items()}
        self.items = dict(self.items)

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges that are hit, and the items hit."""
        get = self.numbers.get
        numbers = [get(w, -1) for w in words]
        ranges, items = [], set()
        for length, table in self.tables.items():
            for pattern, start in table.find(numbers):
                ranges.append((start, start + length))
                items |= self.items[pattern]
        return ranges, items


_FOUND = "doc_id long, n_words long, starts array<long>, ends array<long>, item_ids array<string>"
_CARRIED = _FOUND + ", text binary"


def _pass(passages, schema: str):
    """One pass; ranges and items of earlier passes are carried along, with the text if one more follows."""

    def run(batches):
        out, search = Output(schema, 200), passages.value.search
        for doc_id, text, starts, ends, item_ids in rows(batches, "doc_id", "text", "starts", "ends", "item_ids"):
            words = letters_and_digits(text)
            ranges, items = search(words)
            ranges = _joined([*zip(starts, ends), *ranges])
            row = (doc_id, len(words), [a for a, _ in ranges], [b for _, b in ranges], sorted(items.union(item_ids)))
            yield from out.add(*row, text) if schema is _CARRIED else out.add(*row)
        yield from out.flush()

    return run


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching ranges as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
) -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, hit word ranges ``starts``/``ends`` and ``item_ids`` found, as texts."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(item_text_col).cast("binary").alias("text")).where("text is not null")
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    none = F.array().cast("array<long>")
    df = texts(docs, id_col, text_col, starts=none, ends=none, item_ids=F.array().cast("array<string>"))
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).collect()
        passages = Shared(spark, Passages([(r["id"], bytes(r["text"])) for r in part], window))
        if block == blocks - 1:
            return df.mapInArrow(_pass(passages, _FOUND), _FOUND)
        df = staged(df.mapInArrow(_pass(passages, _CARRIED), _CARRIED), "searched")
        passages.close()
