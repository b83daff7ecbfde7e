"""Token counts by a linear longest-match automaton.

Greedy word-piece splitting takes the longest vocabulary entry that starts a word,
then the longest continuation, and so on. The automaton is a trie of the vocabulary
with a second root for continuations. A node's failure link says where the walk goes
on when no child fits: past the pieces that greedy splitting would have emitted by
then, whose number is stored with the link. Each symbol is looked at once, and only
the number of pieces is kept. Symbols are bytes, so pieces may end inside a character.

Words are the stretches without ASCII white space. An entry with the mark of a space
starts words; where no longer one fits, the mark alone is the first piece. A word that
cannot be split is one unknown token; a vocabulary that has the mark and all single
bytes leaves none. Words met before are looked up in a memory of bounded size. Null
texts have no words. Rows that repeat an id are counted one by one.
"""

from __future__ import annotations

import json
from collections import Counter, deque

from pyspark.sql import DataFrame

from fixweave.llm.arrow import Shared, map_rows, texts

_REMEMBERED = 200_000
# What entries that start a word begin with.
MARK = b" "


class LongestMatch:
    """Number of pieces per word, for initial pieces and continuations given as texts or bytes."""

    def __init__(self, initial: set, continuing: set):
        # Node 0 starts a word, node 1 a continuation.
        self.next: list[dict] = [{}, {}]
        self.fail: list[int] = [-1, -1]
        self.popped: list[int] = [0, 0]
        whole = [False, False]
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in pieces:
                at = root
                for char in piece:
                    if char not in self.next[at]:
                        self.next[at][char] = len(self.next)
                        self.next.append({})
                        self.fail.append(-1)
                        self.popped.append(0)
                        whole.append(False)
                    at = self.next[at][char]
                whole[at] |= bool(piece)
        queue = deque([0, 1])
        while queue:
            parent = queue.popleft()
            for char, node in self.next[parent].items():
                if whole[node]:
                    self.fail[node], self.popped[node] = 1, 1
                else:
                    at, count = self.fail[parent], self.popped[parent]
                    while at >= 0 and char not in self.next[at]:
                        count += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[node], self.popped[node] = self.next[at][char], count
                queue.append(node)
        self.seen: dict[bytes, int] = {}

    def split(self, word) -> int:
        """Number of pieces; 0 if the word cannot be split."""
        next_, fail, popped = self.next, self.fail, self.popped
        at = count = 0
        for char in word:
            while char not in next_[at]:
                if fail[at] < 0:
                    return 0
                count += popped[at]
                at = fail[at]
            at = next_[at][char]
        # What is left must be emitted to the end: the walk ends at the continuation root.
        while at > 1:
            if fail[at] < 0:
                return 0
            count += popped[at]
            at = fail[at]
        return count if at == 1 else 0

    def pieces(self, word: bytes) -> int:
        """Number of pieces of a word and the mark before it."""
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) >= _REMEMBERED:
                self.seen.clear()
            self.seen[word] = found = self.split(MARK + word)
        return found


def vocabulary(path: str) -> tuple[set[bytes], set[bytes]]:
    """Initial and continuing pieces of a byte-level vocabulary file: all its entries, as bytes.

    The file's entries that begin with the mark of a space start words, the others
    go on inside words.
    """
    with open(path, encoding="utf-8") as file:
        entries = json.load(file)["model"]["vocab"]
    # Byte-level files write printable bytes as themselves and the others from code point 256 on.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    pieces = {bytes(byte_of[c] for c in entry) for entry in entries if all(c in byte_of for c in entry)}
    initial = {p for p in pieces if p.startswith(MARK)}
    return initial, pieces - initial


def token_counts(docs: DataFrame, pieces: tuple[set[bytes], set[bytes]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_tokens`` and ``n_unknown`` of every row.

    ``pieces`` come from a vocabulary file, whose size does not depend on the data.
    """
    automaton = Shared(docs.sparkSession, LongestMatch(*pieces))

    def one(doc_id, text):
        words = Counter(text.split()) if text else {}
        count = automaton.value.pieces
        tokens = unknown = total = 0
        for word, times in words.items():
            found = count(word)
            tokens += times * (found or 1)
            unknown += 0 if found else times
            total += times
        return doc_id, total, tokens, unknown

    return map_rows(texts(docs, id_col, text_col), ["doc_id", "text"], one, "doc_id long, n_words long, n_tokens long, n_unknown long")
