"""Periodic runs in the words of a text: stretches that repeat a shorter stretch at least four times.

At each dyadic scale the words are cut into blocks of ``2**k`` words. A block's squared
differences to every stretch of its following window are sums of two sums of squares
and a correlation; an exact integer number-theoretic transform gives the correlations
of many blocks at once. Where the sum is zero, the block occurs again, and the distance
seeds a run: it is extended word by word to both sides, which also confirms the zero
(the sums are kept modulo a prime). A run of period q and at least 4 q words holds a
whole block of every scale up to q together with its copy q words later, so distances
of ``2**k`` to ``2**(k+1) - 1`` words are asked for at scale k and no run is missed.

Two kinds of block are not transformed because their answer is known: blocks with a
word that does not come again within the window, and blocks whose whole window lies in
a run of at most half their length (their zeros are the multiples of its period).

A null or empty text has no words and no runs. Rows that repeat an id are searched one
by one. Work is one pass over the rows, without a shuffle; a task holds a few texts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixweave.llm.arrow import Output, rows, texts

# Copies that a run holds at least, and its least words.
COPIES, SHORTEST = 4, 6
# Numbers that are transformed at a time.
BATCH = 1 << 18

# ---- fixed values: a prime of 119 * 2**23 + 1 and a generator of its units
PRIME, GENERATOR = 998_244_353, 3


class NumberTransform:
    """Transforms modulo the prime along rows whose length is a power of two."""

    def __init__(self):
        self.known: dict[tuple[int, bool], np.ndarray] = {}

    def powers(self, half: int, inverse: bool) -> np.ndarray:
        """The first ``half`` powers of a root of unity of order ``2 * half``."""
        found = self.known.get((half, inverse))
        if found is None:
            root = pow(GENERATOR, (PRIME - 1) // (2 * half), PRIME)
            root = pow(root, PRIME - 2, PRIME) if inverse else root
            found, filled = np.ones(half, np.uint64), 1
            while filled < half:
                found[filled:2 * filled] = found[:filled] * pow(root, filled, PRIME) % PRIME
                filled *= 2
            self.known[half, inverse] = found
        return found

    def forward(self, values: np.ndarray) -> np.ndarray:
        """Natural order in, bit-reversed order out."""
        count, size = values.shape
        half = size // 2
        while half:
            parts = values.reshape(count, -1, 2, half)
            a, b = parts[:, :, 0], parts[:, :, 1]
            values = np.stack(((a + b) % PRIME, (a + PRIME - b) * self.powers(half, False) % PRIME), 2)
            half //= 2
        return values.reshape(count, size)

    def backward(self, values: np.ndarray) -> np.ndarray:
        """Bit-reversed order in, natural order out."""
        count, size = values.shape
        half = 1
        while half < size:
            parts = values.reshape(count, -1, 2, half)
            a, b = parts[:, :, 0], parts[:, :, 1] * self.powers(half, True) % PRIME
            values = np.stack(((a + b) % PRIME, (a + PRIME - b) % PRIME), 2)
            half *= 2
        return values.reshape(count, size) * pow(size, PRIME - 2, PRIME) % PRIME


class RunFinder:
    """All runs of a sequence of word numbers."""

    def __init__(self, copies: int = COPIES, shortest: int = SHORTEST):
        if copies < 3:
            raise ValueError("a block and its copy surely lie in a run of three copies or more only")
        self.copies, self.shortest = copies, shortest
        self.transform = NumberTransform()

    def find(self, numbers: np.ndarray) -> list[tuple[int, int, int]]:
        """Start, length and smallest period of every run, by start and period."""
        n = len(numbers)
        if n < self.shortest:
            return []
        order = np.argsort(numbers, kind="stable")
        again = np.full(n, n, np.int64)
        same = numbers[order[1:]] == numbers[order[:-1]]
        again[order[:-1][same]] = (order[1:] - order[:-1])[same]
        # For each word: the far end and the period of the farthest run that it lies in.
        reach, period = np.zeros(n, np.int64), np.ones(n, np.int64)
        padded = squares = None
        runs: set[tuple[int, int, int]] = set()
        block = 1
        while block * self.copies <= n:
            whole = n // block * block
            starts = np.flatnonzero(again[:whole].reshape(-1, block).max(1) < 2 * block) * block
            starts = starts[starts + 2 * block <= n]
            if len(starts) and runs:
                inside = (reach[starts] >= starts + 3 * block) & (2 * period[starts] <= block)
                starts = starts[~inside]
            if len(starts):
                if padded is None:
                    padded = np.concatenate((numbers, np.zeros(2 * n, np.int64))).astype(np.uint64)
                    squares = np.concatenate(([0], np.cumsum(padded * padded % PRIME))).astype(np.uint64)
                self._scale(numbers, padded, squares, starts, block, reach, period, runs)
            block *= 2
        return sorted(runs)

    def _scale(self, numbers, padded, squares, starts, block, reach, period, runs) -> None:
        n = len(numbers)
        step = max(1, BATCH // (2 * block))
        for at in range(0, len(starts), step):
            part = starts[at:at + step]
            zero = self._zeros(padded, squares, part, block)
            seeds, shift = np.nonzero(zero)
            begin, distance = part[seeds], block + shift
            open_ = begin + distance + block <= n
            known = (reach[begin] >= begin + distance + block) & (distance % period[begin] == 0)
            for start, gap in zip(begin[open_ & ~known].tolist(), distance[open_ & ~known].tolist()):
                if reach[start] >= start + gap + block and gap % period[start] == 0:
                    continue
                found = self._extended(numbers, start, block, gap)
                if found:
                    runs.add(found)
                    left, length, gap = found
                    farther = reach[left:left + length] < left + length
                    reach[left:left + length][farther] = left + length
                    period[left:left + length][farther] = gap

    def _zeros(self, padded: np.ndarray, squares: np.ndarray, starts: np.ndarray, block: int) -> np.ndarray:
        """Per block and distance from ``block`` on: whether the squared differences sum to zero."""
        size = 2 * block
        own = padded[starts[:, None] + np.arange(block)]
        turned = np.zeros((len(starts), size), np.uint64)
        turned[:, 0] = own[:, 0]
        turned[:, :block:-1] = own[:, 1:]
        window = np.zeros((len(starts), size), np.uint64)
        window[:, :size - 1] = padded[starts[:, None] + block + np.arange(size - 1)]
        both = self.transform.forward(turned) * self.transform.forward(window) % PRIME
        cross = self.transform.backward(both)[:, :block]
        other = starts[:, None] + block + np.arange(block)
        total = (squares[starts + block] - squares[starts])[:, None] + squares[other + block] - squares[other]
        return total % PRIME == 2 * cross % PRIME

    def _extended(self, numbers: np.ndarray, start: int, block: int, gap: int) -> tuple[int, int, int] | None:
        """The run around a seed, if it is long enough and has no smaller period."""
        n = len(numbers)
        if not np.array_equal(numbers[start:start + block], numbers[start + gap:start + gap + block]):
            return None
        right, width = start + block, 64
        while right + gap < n:
            stop = min(right + width, n - gap)
            differ = numbers[right:stop] != numbers[right + gap:stop + gap]
            if differ.any():
                right += int(differ.argmax())
                break
            right, width = stop, 2 * width
        left, width = start, 64
        while left > 0:
            low = max(0, left - width)
            differ = numbers[low:left] != numbers[low + gap:left + gap]
            if differ.any():
                left -= int(differ[::-1].argmax())
                break
            left, width = low, 2 * width
        length = right + gap - left
        if length < max(self.shortest, self.copies * gap):
            return None
        for part in _prime_factors(gap):
            inner = gap // part
            if np.array_equal(numbers[left:left + gap], numbers[left + inner:left + inner + gap]):
                return None
        return left, length, gap


def _prime_factors(number: int) -> list[int]:
    out, factor = [], 2
    while factor * factor <= number:
        if number % factor == 0:
            out.append(factor)
            while number % factor == 0:
                number //= factor
        factor += 1
    return out + [number] if number > 1 else out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by a space."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period:start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept).tolist()])


_SCHEMA = "doc_id long, n_words long, starts array<long>, lengths array<long>, periods array<long>, collapsed binary"


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", copies: int = COPIES, shortest: int = SHORTEST
) -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, all runs (``starts``, ``lengths``, ``periods``) and the ``collapsed`` text."""

    def run(batches):
        out, finder = Output(_SCHEMA, 200), RunFinder(copies, shortest)
        for doc_id, text in rows(batches, "doc_id", "text"):
            words = text.split() if text else []
            known: dict[bytes, int] = {}
            numbers = np.fromiter([known.setdefault(w, len(known)) for w in words], np.int64, len(words))
            # Where no word comes twice there is nothing to find.
            runs = finder.find(numbers) if len(known) < len(words) else []
            columns = [list(c) for c in zip(*runs)] or [[], [], []]
            yield from out.add(doc_id, len(words), *columns, collapsed(words, runs))
        yield from out.flush()

    return texts(docs, id_col, text_col).mapInArrow(run, _SCHEMA)


def with_planted_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text``, where the tail of about one text in ten repeats its own first words.

    With h the CRC of the id's digits and g = h div 10, texts of n > 0 words with h mod 10 = 0
    repeat, from word a = g mod n on, the p = 1 + (n - a) div (3 + g mod 8) words there. Null
    ids and null texts stay as they are.
    """
    mark = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    df = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
        (mark / 10).cast("long").alias("_g"), F.when(mark % 10 == 0, words).alias("_words"),
    )
    g, n = F.col("_g"), F.size("_words")
    first = g % F.nullif(n, F.lit(0))
    width = 1 + F.floor((n - first) / (3 + g % 8))
    return df.select("doc_id", F.when(n > 0, _repeated(F.col("_words"), first, width)).otherwise(F.col("text")).alias("text"))


def _repeated(words: Column, first: Column, width: Column) -> Column:
    """Words before ``first``, then the ``width`` words from there over and over up to the same length."""
    rest = F.size(words) - first
    cycle = F.slice(words, (first + 1).cast("int"), width.cast("int"))
    again = F.flatten(F.array_repeat(cycle, F.ceil(rest / width).cast("int")))
    return F.array_join(F.concat(F.slice(words, F.lit(1), first.cast("int")), F.slice(again, F.lit(1), rest.cast("int"))), " ")
