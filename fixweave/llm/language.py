"""Language identification: known words first, shorter and shorter character n-grams for the others.

The model holds, for words and for character n-grams of one to five characters
(of words with a mark at both ends), the log frequency per language. A text's
score of a language is its log prior plus one vote per word: a known word votes
with its own log frequencies, an unseen one with the mean of its longest n-grams
that are known, falling back from five characters to one.

Votes are kept sparse: what a language without the feature gets is the same for all
features, so a vote names only the languages that have it.

The model is fitted on a bounded sample of labelled rows, counted by Spark: ``sample``
documents on average, shared out evenly to all labels, and ``PER_LABEL`` of each at least.
Every label is learnt, and each keeps its own most frequent words and n-grams, so the
broadcast grows with the labels but not with the rows. Prediction reads whole texts.

A null text or one without a letter is ``und`` with score 0; so is every text when
there was nothing to learn from. Ties go to the smaller language code. Labels that
are null teach nothing. Rows that repeat an id are predicted one by one.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixweave.llm.arrow import Output, Shared, rows

# Documents to fit on, entries of each table, longest n-gram; documents and entries that every label gets.
SAMPLE, FEATURES, LONGEST, PER_LABEL, LEAST_FEATURES = 3_000, 100_000, 5, 100, 2_000
# Votes of words that a task remembers.
REMEMBERED = 50_000
# Words of a text that count as independent evidence when the score is made.
EVIDENCE = 20
UNDETERMINED = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(word: str, size: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[at:at + size] for at in range(len(marked) - size + 1)]


def held_out(id_col: str, remainder: int = 0) -> Column:
    """Rows that are kept from learning; null ids are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == remainder, F.lit(True))


Vote = tuple[tuple[int, float], ...]


class LanguageModel:
    def __init__(self, priors: dict[str, int], words: list[tuple], grams_: list[tuple]):
        """``words`` and ``grams_`` are (language, feature, count)."""
        self.languages = sorted(priors)
        self.prior = np.log(np.array([priors[x] for x in self.languages], float) / max(1, sum(priors.values())))
        # What a word of either table gives to languages that lack it, and what more to the others.
        self.word_base, self.words = self._table(words)
        self.gram_base, self.grams = self._table(grams_)

    def _table(self, counted: list[tuple]) -> tuple[np.ndarray, dict[str, Vote]]:
        column = {x: i for i, x in enumerate(self.languages)}
        total, votes = np.zeros(len(column)), {}
        for language, feature, count in counted:
            total[column[language]] += count
            votes.setdefault(feature, []).append((column[language], math.log((count + 0.5) / 0.5)))
        return np.log(0.5 / (total + 0.5 * (len(votes) + 1))), {f: tuple(v) for f, v in votes.items()}

    def vote(self, word: str) -> tuple[bool, Vote]:
        """Whether the word is known, and its votes beyond the base of its table."""
        known = self.words.get(word)
        if known is not None:
            return True, known
        for size in range(min(LONGEST, len(word) + 2), 0, -1):
            found = [v for v in map(self.grams.get, grams(word, size)) if v is not None]
            if found:
                total: dict[int, float] = {}
                for entries in found:
                    for language, weight in entries:
                        total[language] = total.get(language, 0.0) + weight
                return False, tuple((language, weight / len(found)) for language, weight in total.items())
        return False, ()

    def predict(self, text: str | None, seen: dict[str, tuple[bool, Vote]]) -> tuple[str, float]:
        """Language and score; ``seen`` remembers the votes of words between texts."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        words = words_of(text)
        more, n_known = [0.0] * len(self.languages), 0
        for word, times in Counter(words).items():
            found = seen.get(word)
            if found is None:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen[word] = found = self.vote(word)
            known, entries = found
            if known:
                n_known += times
            for language, weight in entries:
                more[language] += weight * times
        total = np.array(more) + n_known * self.word_base + (len(words) - n_known) * self.gram_base
        logs = self.prior + total * (min(EVIDENCE, len(words)) / max(1, len(words)))
        best = int(np.argmax(self.prior + total))
        return self.languages[best], float(1 / np.exp(logs - logs[best]).sum())


def _features(batches):
    """Counts of words and n-grams per language, summed in each task before the shuffle."""
    out, counted = Output("lang string, gram boolean, feature string, count long", 20_000), Counter()

    def flush():
        for (language, gram, feature), count in counted.items():
            yield from out.add(language, gram, feature, count)
        counted.clear()

    words = Counter()
    for language, text in rows(batches, "lang", "text"):
        words.update((language, word) for word in words_of(text))
        if len(words) > 20_000:
            _add_grams(words, counted)
            yield from flush()
    _add_grams(words, counted)
    yield from flush()
    yield from out.flush()


def _add_grams(words: Counter, counted: Counter) -> None:
    """Moves the word counts, with those of their n-grams, over to ``counted``."""
    for (language, word), times in words.items():
        counted[language, False, word] += times
        for size in range(1, LONGEST + 1):
            for gram in grams(word, size):
                counted[language, True, gram] += times
    words.clear()


def fit(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE) -> LanguageModel:
    """Model from a bounded sample of the rows for which ``learn`` holds."""
    labelled = docs.select(
        learn.alias("learn"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"),
        (F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("draw"),
    ).where("learn and lang is not null and text is not null")
    counts = labelled.groupBy("lang").count().collect()
    if not counts:
        return LanguageModel({}, [], [])
    share = max(sample / len(counts), PER_LABEL)
    rates = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, share / r["count"])) for r in counts], "lang string, rate double")
    # One row per label.
    chosen = labelled.join(F.broadcast(rates), "lang").where("draw < rate").select("lang", "text")
    features = chosen.mapInArrow(_features, "lang string, gram boolean, feature string, count long")
    features = features.groupBy("lang", "gram", "feature").agg(F.sum("count").alias("count"))
    ranked = Window.partitionBy("lang", "gram").orderBy(F.desc("count"), "feature")
    kept = max(LEAST_FEATURES, FEATURES // len(counts))
    top = features.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= kept)
    tables: dict[bool, list] = {False: [], True: []}
    for language, gram, feature, count in top.select("lang", "gram", "feature", "count").collect():
        tables[gram].append((language, feature, count))
    return LanguageModel({r["lang"]: r["count"] for r in counts}, sorted(tables[False]), sorted(tables[True]))


def identify(
    docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample: int = SAMPLE, keep: tuple[str, ...] = (),
) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` (0 to 1) per row, and the columns named in ``keep``."""
    model = Shared(docs.sparkSession, fit(docs, learn, id_col, text_col, lang_col, sample))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *keep)
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString().replace('bigint', 'long')}" for c in keep)

    schema = "doc_id long, lang_pred string, score double" + (f", {kinds}" if keep else "")

    def run(batches):
        out, predict, seen = Output(schema), model.value.predict, {}
        for doc_id, text, *kept in rows(batches, "doc_id", "text", *keep):
            yield from out.add(doc_id, *predict(text, seen), *kept)
        yield from out.flush()

    return narrow.mapInArrow(run, schema)
