"""Toxicity by weak supervision: many voters, a model of their errors, a linear classifier.

*Voters* read a text and say toxic (1), clean (0) or nothing (2). Some are fixed: short
lists of abusive words per language, and patterns (shouting, runs of exclamation marks,
masked words, a second person next to abuse). The others are lexicons mined from labelled
texts: words, word beginnings and word endings whose presence, or frequent presence
(``MANY`` times), tells toxic from clean texts by a likelihood ratio test that allows for
the number of features tried. They are dealt out to several lexicons, so that the voters
can be held against each other.

The *label model* is generative: a hidden class, and votes that depend on it and on at most
one other vote each. Expectation maximisation fits it to the votes of all texts that may be
learnt from, with the class of labelled texts given; it starts from the labelled texts
alone. The conditional mutual information of each two votes gives a forest of the strongest
correlations, so voters that echo each other are not counted twice. Spark holds votes as
counted patterns and sums the expected counts; the driver sees a few numbers per pair.

The *classifier* is a logistic regression on the mined features, trained on the posterior
labels of a bounded sample (``ROWS`` texts), labelled or not. A feature counts with the
logarithm of its frequency over that of the text's length, so one word tells in a long text.

Bounds that are parameters: labels mined from (``LABELLED`` ids), features (``FEATURES``), ``ROWS``.
Votes and scores cover every text. Held-out rows, rows with a null id and null texts teach
nothing. Several labels of an id count as their mean. A null or wordless text gets the score
of a text without features. Rows that repeat an id are scored one by one. Without any label
the fixed voters teach alone; without any text the score is the smoothed prior.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixweave.llm.arrow import Output, Shared, record_batch, rows
from fixweave.session import staged

# Labelled ids that are mined, features kept, texts that the classifier is trained on.
LABELLED, FEATURES, ROWS = 30_000, 2_048, 12_000
# Times that a feature stands in a text to count as frequent; lexicons per kind; entries of a kind.
MANY, LEXICONS, ENTRIES = 3, 4, 400
# Steps of expectation maximisation at most, and the change of an accuracy that ends them.
STEPS, SETTLED = 20, 0.001
# Conditional mutual information, in nats, from which two votes are correlated.
CORRELATED = 0.005
TOXIC, CLEAN, SILENT = 1, 0, 2

_WORD = re.compile(r"[^\W\d_]+")
_PATTERNS = [
    re.compile(r"[!?]*!{2,}[!?]*"),
    re.compile(r"\b[a-z]{1,3}[*@$#]{1,4}[a-z]{0,3}\b", re.IGNORECASE),
]

LISTS = {
    "en": "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown bastard bitch damn fuck fucking shit asshole retard",
    "de": "idiot trottel arschloch schlampe wichser hurensohn scheisse scheiße dummkopf missgeburt abschaum drecksack vollidiot",
    "fr": "connard connasse salope imbécile abruti crétin merde putain enculé ordure débile minable",
    "es": "idiota imbécil estúpido estúpida gilipollas puta mierda cabrón pendejo basura maldito escoria",
}
_SECOND = re.compile(r"\b(you|your|du|dich|tu|vous|eres|tú)\W+(?:\w+\W+){0,3}?(" + "|".join(sorted({w for x in LISTS.values() for w in x.split()})) + r")\b", re.IGNORECASE)


def features_of(word: str) -> list[str]:
    """The word, its beginnings of 3 to 6 letters and its endings of 3 to 5."""
    out = [word]
    out += [word[:size] + "-" for size in range(3, min(7, len(word)))]
    out += ["-" + word[-size:] for size in range(3, min(6, len(word)))]
    return out


def _words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


# ---- mining -----------------------------------------------------------------------
_STATS = "feature string, any1 long, any0 long, many1 long, many0 long"


def _mined(batches):
    """Per feature: toxic and clean texts that hold it, and that hold it many times."""
    out, known, stats = Output(_STATS, 20_000), {}, defaultdict(lambda: [0, 0, 0, 0])

    def flush():
        for feature, counted in stats.items():
            yield from out.add(feature, *counted)
        stats.clear()

    for text, toxic in rows(batches, "text", "toxic"):
        held: Counter = Counter()
        for word, times in Counter(_words(text)).items():
            found = known.get(word)
            if found is None:
                if len(known) >= 100_000:
                    known.clear()
                found = known[word] = features_of(word)
            for feature in found:
                held[feature] += times
        at = 0 if toxic else 1
        for feature, times in held.items():
            counted = stats[feature]
            counted[at] += 1
            if times >= MANY:
                counted[at + 2] += 1
        if len(stats) > 200_000:
            yield from flush()
    yield from flush()
    yield from out.flush()


def _ratio(toxic: Column, clean: Column, n1: int, n0: int) -> Column:
    """Log likelihood ratio of a feature against independence from the label."""

    def part(seen, expected):
        return F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(0.0)

    share = (toxic + clean) / F.lit(float(n1 + n0))
    return part(toxic, share * n1) + part(clean, share * n0) + part(n1 - toxic, (1 - share) * n1) + part(n0 - clean, (1 - share) * n0)


def mined_features(labelled: DataFrame, limit: int) -> tuple[list[dict], float]:
    """The features that tell most, with their ratios and sides, and the ratio that chance gives the best of so many."""
    total = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = total.get(True, 0), total.get(False, 0)
    if not n1 or not n0:
        return [], 0.0
    stats = labelled.select("text", "toxic").mapInArrow(_mined, _STATS).groupBy("feature")
    stats = stats.agg(*[F.sum(c).alias(c) for c in ("any1", "any0", "many1", "many0")]).where("any1 + any0 >= 3")
    stats = staged(stats, "features")
    scored = stats.select(
        "feature", _ratio(F.col("any1"), F.col("any0"), n1, n0).alias("any"), _ratio(F.col("many1"), F.col("many0"), n1, n0).alias("many"),
        *[((F.col(f"{c}1") / n1) > 9 * (F.col(f"{c}0") / n0)).alias(f"{c}_toxic") for c in ("any", "many")],
    )
    best = scored.orderBy(F.greatest("any", "many").desc(), "feature").limit(limit).collect()
    return [r.asDict() for r in best], float(np.log(max(1, 2 * stats.count())))


# ---- voters -----------------------------------------------------------------------
class Voters:
    """Votes on a text, and the frequencies of the features in it."""

    def __init__(self, mined: list[dict], chance: float):
        lists = {word for words in LISTS.values() for word in words.split()}
        self.names = [f"list_{name}" for name in LISTS] + ["exclaims", "masked", "shouts", "second_person"]
        self.features = sorted(lists | {r["feature"] for r in mined})
        self.place = {f: i for i, f in enumerate(self.features)}
        self.listed = {w: i for i, words in enumerate(LISTS.values()) for w in words.split()}
        # Entry of a lexicon: feature number -> (voter, least times).
        self.entries: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.first_mined = len(self.names)
        for least, rule in ((1, "any"), (MANY, "many")):
            for affix in (False, True):
                telling = [r for r in mined if r[f"{rule}_toxic"] and r[rule] > chance and ("-" in r["feature"]) == affix]
                telling = sorted(telling, key=lambda r: (-r[rule], r["feature"]))[:ENTRIES]
                lexicons = min(LEXICONS, len(telling))
                for rank, r in enumerate(telling):
                    self.entries[self.place[r["feature"]]].append((len(self.names) + rank % lexicons, least))
                self.names += [f"{rule}_{'affix' if affix else 'word'}_{i}" for i in range(lexicons)]
        self.entries = dict(self.entries)
        self.known: dict[str, tuple[int, ...]] = {}

    def counts(self, words: list[str]) -> dict[int, int]:
        """How often each feature stands in the text."""
        out: dict[int, int] = {}
        known, place = self.known, self.place
        for word in words:
            found = known.get(word)
            if found is None:
                if len(known) >= 100_000:
                    known.clear()
                found = known[word] = tuple(place[f] for f in features_of(word) if f in place)
            for feature in found:
                out[feature] = out.get(feature, 0) + 1
        return out

    def votes(self, text: str | None, words: list[str], counts: dict[int, int]) -> str:
        """One digit per voter."""
        out = [SILENT] * len(self.names)
        if words:
            out[self.first_mined:] = [CLEAN] * (len(out) - self.first_mined)
            abused = False
            for word, voter in self.listed.items():
                if counts.get(self.place[word]):
                    out[voter], abused = TOXIC, True
            for at, pattern in enumerate(_PATTERNS, len(LISTS)):
                if pattern.search(text):
                    out[at] = TOXIC
            capitals = sum(map(str.isupper, text))
            if capitals > 20 and 2 * capitals > sum(map(len, words)):
                out[len(LISTS) + 2] = TOXIC
            if abused and _SECOND.search(text):
                out[len(LISTS) + 3] = TOXIC
            for feature, times in counts.items():
                for voter, least in self.entries.get(feature, ()):
                    if times >= least:
                        out[voter] = TOXIC
        return "".join(map(str, out))


# ---- label model ------------------------------------------------------------------
class LabelModel:
    """Hidden class, and per voter the odds of each vote given the class and one other vote."""

    def __init__(self, voters: int, prior: float):
        self.prior = prior
        self.parent = [-1] * voters
        # (voter, class, vote of the parent, vote)
        start = np.array([[0.9, 0.05, 0.05], [0.5, 0.45, 0.05]])
        self.odds = np.repeat(np.repeat(start[None, :, None], voters, 0), 3, 2)
        self.accuracy = np.full(voters, np.nan)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of toxic for each row of votes."""
        logs = np.tile(np.log([1 - self.prior, self.prior]), (len(votes), 1))
        for j, parent in enumerate(self.parent):
            given = votes[:, parent] if parent >= 0 else np.zeros(len(votes), np.int64)
            logs += np.log(self.odds[j][:, given, votes[:, j]]).T
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -60, 60)))

    def pairs(self) -> list[tuple[int, int]]:
        return [(j if p < 0 else p, j) for j, p in enumerate(self.parent)]

    def learn(self, expected: dict[tuple[int, int], np.ndarray]) -> None:
        """Odds from expected counts (class, vote of the parent, vote) of each voter and its parent."""
        total = None
        for j, (parent, _) in enumerate(self.pairs()):
            counts = expected[parent, j]
            own = counts.sum(1)
            total = own.sum(1)
            if parent == j:
                table = np.repeat(((own + 0.1) / (own + 0.1).sum(1, keepdims=True))[:, None], 3, 1)
            else:
                # Rare votes of the parent lean on what the voter does without it.
                base = (own + 0.1) / (own + 0.1).sum(1, keepdims=True)
                table = counts + 2 * base[:, None]
                table = table / table.sum(2, keepdims=True)
            self.odds[j] = table
            spoken = own[:, :2].sum()
            self.accuracy[j] = (own[0, 0] + own[1, 1]) / spoken if spoken else np.nan
        if total is not None:
            self.prior = float((total[1] + 1) / (total.sum() + 20))

    def connect(self, expected: dict[tuple[int, int], np.ndarray]) -> None:
        """The forest of the strongest correlations that the class does not explain."""
        strength = sorted(((_conditional_information(c), i, j) for (i, j), c in expected.items() if i != j), reverse=True)
        group = list(range(len(self.parent)))
        linked = defaultdict(list)

        def find(i):
            while group[i] != i:
                i = group[i]
            return i

        for value, i, j in strength:
            if value >= CORRELATED and find(i) != find(j):
                group[find(i)] = find(j)
                linked[i].append(j)
                linked[j].append(i)
        seen: set[int] = set()
        for root in range(len(self.parent)):
            todo = [] if root in seen else [(root, -1)]
            while todo:
                at, above = todo.pop()
                seen.add(at)
                self.parent[at] = above
                todo += [(j, at) for j in linked[at] if j not in seen]


def _conditional_information(counts: np.ndarray) -> float:
    joint = counts / max(counts.sum(), 1e-300)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = joint * joint.sum((1, 2), keepdims=True) / (joint.sum(2, keepdims=True) * joint.sum(1, keepdims=True))
        return float(np.where(joint > 0, joint * np.log(ratio), 0).sum())


def _digits(patterns: list[str]) -> np.ndarray:
    return np.frombuffer("".join(patterns).encode(), np.uint8).reshape(len(patterns), -1).astype(np.int64) - 48


_EXPECTED = "cell int, value double"


def _expected(patterns: DataFrame, model: LabelModel, pairs: list[tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
    """Expected counts (class, first vote, second vote) of each pair, summed over all patterns."""

    def run(batches):
        total = np.zeros((len(pairs), 2, 9))
        for batch in batches:
            if batch.num_rows:
                votes = _digits(batch.column("pattern").to_pylist())
                given = batch.column("toxic").to_numpy(zero_copy_only=False)
                weight = batch.column("n").to_numpy(zero_copy_only=False).astype(float)
                toxic = np.where(given == SILENT, model.posterior(votes), given)
                for at, (i, j) in enumerate(pairs):
                    joint = 3 * votes[:, i] + votes[:, j]
                    total[at, 0] += np.bincount(joint, weight * (1 - toxic), 9)
                    total[at, 1] += np.bincount(joint, weight * toxic, 9)
        cells = np.flatnonzero(total)
        yield record_batch(_EXPECTED, cells, total.reshape(-1)[cells])

    flat = np.zeros(len(pairs) * 18)
    for cell, value in patterns.mapInArrow(run, _EXPECTED).groupBy("cell").agg(F.sum("value").alias("value")).collect():
        flat[cell] = value
    return dict(zip(pairs, flat.reshape(-1, 2, 3, 3)))


def fit_label_model(patterns: DataFrame, voters: int, prior: float, steps: int = STEPS) -> LabelModel:
    """``patterns``: counted rows (pattern, toxic, n), where toxic is 2 for texts without a label."""
    model = LabelModel(voters, prior)
    labelled = _expected(patterns.where(F.col("toxic") != SILENT), model, model.pairs())
    if all(c.sum((1, 2)).all() for c in labelled.values()):
        # Start from the labelled texts, with the given prior.
        model.learn(labelled)
        model.prior = prior
    everything = [(i, j) for i in range(voters) for j in range(voters) if i <= j]
    expected = _expected(patterns, model, everything)
    model.learn(expected)
    model.connect(expected)
    # Parents may come after their children in the list of pairs.
    expected |= {(j, i): c.transpose(0, 2, 1) for (i, j), c in list(expected.items())}
    model.learn(expected)
    for _ in range(steps - 1):
        before = model.accuracy.copy()
        model.learn(_expected(patterns, model, model.pairs()))
        if not np.nanmax(np.abs(model.accuracy - before), initial=0.0) > SETTLED:
            break
    return model


# ---- classifier -------------------------------------------------------------------
class Classifier:
    """Logistic regression on compressed feature frequencies."""

    def __init__(self, features: int, prior: float):
        self.weights, self.bias = np.zeros(features), float(np.log(prior / (1 - prior)))

    @staticmethod
    def values(counts: dict[int, int], n_words: int) -> tuple[np.ndarray, np.ndarray]:
        ids = np.fromiter(counts.keys(), np.int32, len(counts))
        times = np.fromiter(counts.values(), np.float32, len(counts))
        return ids, np.log1p(times) / np.float32(np.log1p(max(1, n_words)))

    def fit(self, ids: list[np.ndarray], values: list[np.ndarray], toxic: np.ndarray, steps: int = 200, ridge: float = 1e-4) -> None:
        """Accelerated descent, each feature in its own scale."""
        n = len(ids)
        row = np.repeat(np.arange(n), [len(i) for i in ids])
        column, value = np.concatenate(ids), np.concatenate(values).astype(float)
        size = len(self.weights)
        spread = np.sqrt(np.bincount(column, value**2, size) / n) + 1e-3
        value = value / spread[column]
        norms = np.bincount(row, value**2, n) + 1
        rate = 4 / np.mean(norms) * 2
        weights, bias = np.zeros(size), self.bias
        ahead, ahead_bias, before, before_bias = weights, bias, weights, bias
        for step in range(1, steps + 1):
            score = np.bincount(row, value * ahead[column], n) + ahead_bias
            miss = (1 / (1 + np.exp(-np.clip(score, -60, 60))) - toxic) / n
            weights = ahead - rate * (np.bincount(column, value * miss[row], size) + ridge * ahead)
            bias = ahead_bias - rate * miss.sum()
            # Start anew where momentum leads uphill.
            if (ahead - weights) @ (weights - before) > 0:
                ahead, ahead_bias = weights, bias
            else:
                momentum = step / (step + 3)
                ahead, ahead_bias = weights + momentum * (weights - before), bias + momentum * (bias - before_bias)
            before, before_bias = weights, bias
        self.weights, self.bias = weights / spread, float(bias)

    def score(self, counts: dict[int, int], n_words: int) -> float:
        total = self.bias
        if counts:
            ids, values = self.values(counts, n_words)
            total += float(self.weights[ids] @ values)
        return float(1 / (1 + np.exp(-max(-60.0, min(60.0, total)))))


class ToxicityModel:
    """Voters, their errors and the classifier that was trained on them."""

    def __init__(self, voters: Voters, label_model: LabelModel, classifier: Classifier):
        self.voters, self.label_model, self.classifier = voters, label_model, classifier

    def score(self, text: str | None) -> float:
        words = _words(text)
        return self.classifier.score(self.voters.counts(words), len(words))

    def report(self) -> list[dict]:
        """Per voter: its estimated accuracy where it speaks, and the voter that it depends on."""
        names, model = self.voters.names, self.label_model
        return [
            {"voter": n, "accuracy": float(a), "depends_on": names[p] if p >= 0 else None}
            for n, a, p in zip(names, model.accuracy, model.parent)
        ]


def _patterns(voters: Shared):
    def run(batches):
        out, counted, held = Output("pattern string, toxic int, n long", 5_000), Counter(), voters.value
        for text, toxic in rows(batches, "text", "toxic"):
            words = _words(text)
            pattern = held.votes(text, words, held.counts(words))
            counted[pattern, SILENT if toxic is None else int(toxic)] += 1
            if len(counted) > 100_000:
                for (pattern, label), n in counted.items():
                    yield from out.add(pattern, label, n)
                counted.clear()
        for (pattern, label), n in counted.items():
            yield from out.add(pattern, label, n)
        yield from out.flush()

    return run


def _training_rows(voters: Shared, model: LabelModel):
    def run(batches):
        out, held = Output("draw long, ids binary, frequencies binary, toxic double", 500), voters.value
        for text, toxic, draw in rows(batches, "text", "toxic", "draw"):
            words = _words(text)
            counts = held.counts(words)
            if toxic is None:
                toxic = model.posterior(_digits([held.votes(text, words, counts)]))[0]
            ids, values = Classifier.values(counts, len(words))
            yield from out.add(draw, ids.tobytes(), values.tobytes(), float(toxic))
        yield from out.flush()

    return run


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
    label_id_col: str = "doc_id", label_col: str = "toxic", labelled: int = LABELLED, features: int = FEATURES, sample: int = ROWS,
) -> ToxicityModel:
    """Model from the rows of ``docs`` for which ``learn``, a condition on the id column, holds."""
    spark = docs.sparkSession
    known = labels.select(F.col(label_id_col).cast("long").alias(id_col), F.col(label_col).alias("_toxic"))
    known = known.where(learn & F.col(id_col).isNotNull() & F.col("_toxic").isNotNull())
    known = known.groupBy(F.col(id_col).alias("_id")).agg((F.avg("_toxic") >= 0.5).alias("toxic"))
    known = staged(known.orderBy(F.xxhash64("_id"), "_id").limit(labelled), "labels")
    texts = docs.where(learn & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    texts = texts.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))
    # At most ``labelled`` rows of two columns.
    some = F.broadcast(known)
    mined, chance = mined_features(texts.join(some, "_id").select("text", "toxic"), features)
    voters = Voters(mined, chance)
    held = Shared(spark, voters)
    counted = texts.join(some, "_id", "left").select("text", "toxic").mapInArrow(_patterns(held), "pattern string, toxic int, n long")
    patterns = staged(counted.groupBy("pattern", "toxic").agg(F.sum("n").alias("n")), "votes")
    by_label = {r["toxic"]: r["n"] for r in patterns.groupBy("toxic").agg(F.sum("n").alias("n")).collect()}
    n1, n0 = by_label.get(TOXIC, 0), by_label.get(CLEAN, 0)
    prior = (n1 + 1) / (n1 + n0 + 20)
    model = fit_label_model(patterns, len(voters.names), prior)

    classifier, total = Classifier(len(voters.features), model.prior), sum(by_label.values())
    draw = F.shiftrightunsigned(F.xxhash64("_id", "text", F.lit(11)), 1)
    drawn = texts.join(some, "_id", "left").withColumn("draw", draw)
    # Twice the share, so that the limit below is filled; the limit is the bound.
    drawn = drawn.where(F.col("draw") <= F.lit((2**63 - 1) * min(2 * sample, total) // max(1, total)))
    chosen = drawn.select("text", "toxic", "draw").mapInArrow(_training_rows(held, model), "draw long, ids binary, frequencies binary, toxic double")
    chosen = chosen.orderBy("draw", "ids", "frequencies").limit(sample).collect()
    if chosen:
        classifier.fit(
            [np.frombuffer(r["ids"], np.int32) for r in chosen], [np.frombuffer(r["frequencies"], np.float32) for r in chosen],
            np.array([r["toxic"] for r in chosen]),
        )
    return ToxicityModel(voters, model, classifier)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``score`` (0 to 1, higher: more likely toxic) and ``predicted`` per row."""
    held = Shared(docs.sparkSession, model)

    def run(batches):
        out, score = Output("doc_id long, score double, predicted int"), held.value.score
        for doc_id, text in rows(batches, "doc_id", "text"):
            found = score(text)
            yield from out.add(doc_id, found, int(found >= 0.5))
        yield from out.flush()

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, score double, predicted int")
