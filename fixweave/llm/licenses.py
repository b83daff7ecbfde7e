"""Licence texts in documents, by a generalised suffix automaton over words.

The automaton holds every run of words of every template. Streaming a document
through it gives matching statistics: for each word the longest run ending there
that some template has. Runs that cannot be made longer and have at least
``SHORTEST`` words are placed in the templates that have them, and chained where
document and template go on in the same order with small gaps. A chain that covers
enough of its template, or one of the fixed phrases, is a span of its licence. Where
chains overlap, the one that covers most of its template stays, then the one of more
words; licences that differ in a word or two are told apart so.

MIT, BSD and ISC licences have a template for each paragraph, so any part is found. Of
licences of many pages only the notices and openings are templates.

Words outside all templates reset the automaton, so only stretches of template
words are streamed. Null texts are empty: no words, no labels, score 0. Rows that
repeat an id are scanned one by one.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import defaultdict

from pyspark.sql import DataFrame

from fixweave.llm.arrow import Shared, map_rows, texts
from fixweave.llm.decontaminate import letters_and_digits

# Phrases of the base rule and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

_NOTICE = "this {} is free software you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation either version {} of the license or at your option any later version"
_ONLY = "you can redistribute it and or modify it under the terms of the gnu {} version {} as published by the free software foundation"
_GNU = [
    ("gpl-1", "general public license", "1"), ("gpl-2", "general public license", "2"), ("gpl-3", "general public license", "3"),
    ("lgpl-2", "library general public license", "2"), ("lgpl-2.1", "lesser general public license", "2 1"),
    ("lgpl-3", "lesser general public license", "3"), ("agpl-3", "affero general public license", "3"),
]

# Short licences by paragraph, openings and notices of the others.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("apache-2", "licensed under the apache license version 2 0"),
    *[(label, _NOTICE.format(what, name, version)) for label, name, version in _GNU for what in ("program", "library")],
    *[(label, _ONLY.format(name, version)) for label, name, version in _GNU],
    *[(label, f"licensed under the gnu {name} version {version}") for label, name, version in _GNU],
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd", "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption"),
    ("bsd", "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("isc", "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nd", "licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("cc-by-nc-sa", "licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    ("cc-by-nc-nd", "licensed under a creative commons attribution noncommercial noderivatives 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
]

# Shortest run that counts, largest gap inside a chain, and the part of a template that makes a span.
SHORTEST, GAP, COVERED = 3, 8, 0.8


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences; every state knows where its runs end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for number, sequence in enumerate(sequences):
            last = 0
            for end, word in enumerate(sequence, 1):
                last = self._extend(last, word)
                self.ends[last].add((number, end))
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.link) - 1

    def _split(self, parent: int, word: int) -> int:
        """The state after ``word`` whose longest run is one longer than the parent's."""
        target = self.next[parent][word]
        if self.length[target] == self.length[parent] + 1:
            return target
        copy = self._state(self.length[parent] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while parent >= 0 and self.next[parent].get(word) == target:
            self.next[parent][word] = copy
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        made = self._state(self.length[last] + 1, 0, {})
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = made
            at = self.link[at]
        if at >= 0:
            self.link[made] = self._split(at, word)
        return made

    def statistics(self, words: list[int]):
        """For each word, the state and length of the longest run that ends with it."""
        state = length = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            yield state, length


class LicenseScanner:
    def __init__(self, templates=tuple(TEMPLATES), phrases=PHRASES):
        self.numbers: dict[bytes, int] = {}
        self.labels = [label for label, _ in templates]
        sequences = [self._numbered(text) for _, text in templates]
        self.sizes = [len(s) for s in sequences]
        self.phrases = {tuple(self._numbered(p)): label for p, label in phrases.items()}
        self.automaton = SuffixAutomaton(sequences)
        self.shortest = min([SHORTEST, *map(len, self.phrases)])

    def _numbered(self, text: str) -> list[int]:
        return [self.numbers.setdefault(w, len(self.numbers)) for w in letters_and_digits(text.encode())]

    def stretches(self, words: list[bytes]):
        """Position and numbers of each stretch of template words that is long enough."""
        get = self.numbers.get
        numbers = [get(w, -1) for w in words]
        marks = bytes(n < 0 for n in numbers)
        for run in _RUN.finditer(marks):
            if run.end() - run.start() >= self.shortest:
                yield run.start(), numbers[run.start():run.end()]

    def runs(self, at: int, numbers: list[int]):
        """Runs that cannot be made longer: (template, start there, start in the text, length)."""
        automaton, before = self.automaton, (0, 0)
        for end, (state, length) in enumerate([*automaton.statistics(numbers), (0, 0)]):
            if length <= before[1] and before[1] >= SHORTEST:
                size = before[1]
                for template, stop in automaton.ends[before[0]]:
                    yield template, stop - size, at + end - size, size
            before = (state, length)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[str, int, int, float]]]:
        """Phrase places, and template spans as (label, first word, end, covered part)."""
        places, by_template = [], defaultdict(list)
        for at, numbers in self.stretches(words):
            for phrase, label in self.phrases.items():
                size = len(phrase)
                places += [(at + i, label) for i in range(len(numbers) - size + 1) if tuple(numbers[i:i + size]) == phrase]
            for template, start, text_start, size in self.runs(at, numbers):
                by_template[template].append((text_start, start, size))
        spans = []
        for template, found in by_template.items():
            size = self.sizes[template]
            spans += [(c / size, c, a, b, self.labels[template]) for a, b, c in _chains(sorted(found)) if c / size >= COVERED]
        return places, [(label, a, b, part) for part, _, a, b, label in _best(spans)]


def _best(spans: list[tuple[float, int, int, int, str]]) -> list[tuple[float, int, int, int, str]]:
    """Spans (part, words covered, first word, end, label) that overlap no better one that stays."""
    kept, starts = [], []
    for span in sorted(set(spans), reverse=True):
        at = bisect(starts, span[2])
        near = [*kept[max(0, at - 1):at], *kept[at:at + 1]]
        if all(k[3] <= span[2] or span[3] <= k[2] for k in near):
            kept.insert(at, span)
            starts.insert(at, span[2])
    return kept


_RUN = re.compile(b"\x00+")


def _chains(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Best chain ends: (first word, end, words covered); only near predecessors are looked at."""
    open_, out = [], []
    for text_start, start, size in found:
        still = [c for c in open_ if text_start - c[1] <= GAP]
        out += [c for c in open_ if text_start - c[1] > GAP]
        best = (text_start, text_start + size, size, start + size)
        for first, end, covered, stop in still:
            # An overlap in the text or the template counts once.
            over = max(0, end - text_start, stop - start)
            if over < size and start + size > stop and covered + size - over > best[2]:
                best = (first, text_start + size, covered + size - over, start + size)
        open_ = [*still, best]
    return [(first, end, covered) for first, end, covered, _ in [*out, *open_]]


_SCANNED = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "span_labels array<string>, span_starts array<long>, span_ends array<long>"
)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=tuple(TEMPLATES), phrases=PHRASES) -> DataFrame:
    """Base places, labels and covered template spans (in words) of every row."""
    scanner = Shared(docs.sparkSession, LicenseScanner(templates, phrases))

    def one(doc_id, text):
        words = letters_and_digits(text)
        places, spans = scanner.value.scan(words)
        spans = sorted({(a, b, label, c) for label, a, b, c in spans})
        base = sorted({label for _, label in places})
        starts = [at for at, _ in places]
        score = 1.0 if base else max([c for *_, c in spans], default=0.0)
        return (
            doc_id, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base),
            ",".join(sorted({*base, *[s[2] for s in spans]})), min(1.0, score),
            [s[2] for s in spans], [s[0] for s in spans], [s[1] for s in spans],
        )

    return map_rows(texts(docs, id_col, text_col), ["doc_id", "text"], one, _SCANNED)
