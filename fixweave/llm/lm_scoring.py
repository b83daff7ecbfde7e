"""Language-model scores: causal self-attention over subword ids, and a word-count baseline.

**Model.** Texts are lower-cased (A-Z) and cut into words; words become ids of a
public byte-level vocabulary, which spells any word, plus one end of text. The
probability of the next id is a mixture of three: what the two ids before it say, what
the last one says, both from exact counts with absolute discounts, and what a class of
ids says, which a causal self-attention layer over the last ids predicts by a dense
softmax. The same layer sets the shares of the mixture. Each part sums
to one over the vocabulary, hence so does the mixture.

**Counts.** All words, pairs and triples of ids of the training part are counted and
looked up by shuffles of dictionaries: tasks number the words of some megabytes of text,
send each bucket of word hashes, pairs and triples its part, and get the corpus counts
back; texts travel as word numbers. No pair or triple is left out, and no task holds more
than those of its batch or bucket. Classes are clusters of frequent ids by the ids they follow.

**Training.** All windows of all training rows are learnt from once, by one rule for
every size: each batch goes over its windows from the same start, and the results are
averaged by shuffles of slices, a row of a table weighed by how often a batch used it.
More input means more batches and not larger ones.

**Windows.** Long texts are scored in windows of ``WINDOW`` ids of which the last
``STRIDE`` are scored, so each id is scored once, with at least ``WINDOW - STRIDE``
ids before it. The layer is asked at every scored place: each id has a state of its own,
which sees all ids of the window before it. Windows of many texts are stacked and masked.

**Baseline.** The counts of words are those of all texts of the training part.

Null texts are empty: one token, the end. Null ids are held out. Rows that repeat an
id are scored one by one. Without training rows c and N are 0 and all ids are as likely.
"""

from __future__ import annotations

import base64
import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixweave.llm.arrow import Output, Shared, record_batch, rows, small_batches, texts
from fixweave.session import staged

WINDOW, STRIDE = 48, 32
# Scored places for a state: each has its own.
BLOCK = 1
SIZE, OUT = 16, 16
# Windows of a training step and of a stack that is scored, windows that are shuffled together, and ids that one task learns from.
BATCH, STRETCH, PART = 64, 12_800, 2_000_000
# Different pairs and triples of ids that ``train`` takes, what is taken off their counts, and ids that are counted together.
GRAMS, DISCOUNT, COUNTED = 1 << 19, 0.75, 2_000_000
# Clusters of frequent ids, ids that are clustered, and classes of all others.
CLUSTERS, CLUSTERED, AHEAD, RARE = 48, 4096, 512, 16
# Parameters that training touches by row, and rows of them that are averaged together.
BY_ROW, AVERAGED = ("embed",), 65_536
# Bytes of a batch of texts, and bytes of text for a bucket of word hashes and for one of pairs or triples.
NUMBERED, BUCKET_BYTES, GRAM_BYTES = 12_000_000, 32 << 20, 32 << 20
# Ids scored together.
STACKED = 8_000

_END_HASH = xxhash.xxh3_64_intdigest(b" ")


class Subwords:
    """Ids of words in a public vocabulary of byte pairs."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.size = max(ranks.values()) + 2
        self.end = self.size - 1
        # A word goes with the space before it. Joining is slow in very long words: these go in stretches.
        pattern = r" [^ ]{0,255}|[^ ]{1,256}"
        self.encode = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        # A space stands at the start of a word only.
        self.starts = np.zeros(self.size, bool)
        self.starts[[rank for piece, rank in ranks.items() if piece[:1] == b" "]] = True

    def __call__(self, words: list[bytes]) -> np.ndarray:
        text = b" ".join([b"", *words]).decode("utf-8", "replace")
        return np.array([*self.encode(text), self.end], np.int32)

    def spelled(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some words, one word after the other, and the number of ids of each."""
        ids = self(words)[:-1]
        return ids, np.diff(np.r_[np.flatnonzero(self.starts[ids]), len(ids)])


class Counts:
    """Probabilities of an id from exact counts: alone, after the last id, after the last two."""

    def __init__(self, single: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], triples: tuple[np.ndarray, np.ndarray], types: tuple[np.ndarray, np.ndarray] | None = None):
        """Counts of ids; keys (ids as digits of 16 bits) and counts of pairs and triples, in any order.

        Where only some pairs and triples are given, ``types`` tells how many different
        ones there are after each id and after each pair.
        """
        size = len(single)
        self.end, self.follows = size - 1, single.astype(np.float64)
        self.alone = ((single + 0.05) / (single.sum() + 0.05 * size)).astype(np.float64)
        order = np.argsort(pairs[0])
        self.pair, self.pair_count = pairs[0][order], pairs[1][order].astype(np.float64)
        if types is None:
            held = np.bincount(self.pair >> 16, np.maximum(self.pair_count - DISCOUNT, 0), size)
        else:
            held = self.follows - DISCOUNT * types[0]
        self.left = np.where(self.follows > 0, 1 - held / np.maximum(self.follows, 1), 1.0)
        after = None if types is None else types[1][order]
        # Triples by the place of their first two ids among the pairs.
        at, hit = self._find(self.pair, triples[0] >> 16)
        key, count = (at[hit] << 16) | (triples[0][hit] & 0xFFFF), triples[1][hit].astype(np.float64)
        order = np.argsort(key)
        self.triple, self.triple_count = key[order], count[order]
        if after is None:
            held = np.bincount(self.triple >> 16, np.maximum(self.triple_count - DISCOUNT, 0), len(self.pair))
        else:
            held = self.pair_count - DISCOUNT * after
        self.pair_left = 1 - held / np.maximum(self.pair_count, 1)

    @classmethod
    def of_batch(cls, single: np.ndarray, types: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], triples: tuple[np.ndarray, np.ndarray], after: np.ndarray) -> Counts:
        """Counts of sorted pairs and triples, the triples' first two ids given by the place of that pair; ``after`` are the different ones after each pair."""
        none = np.zeros(0, np.int64)
        made = cls(single, (none, none), (none, none), (types, none))
        made.pair, made.pair_count = pairs[0], pairs[1].astype(np.float64)
        made.triple, made.triple_count = triples[0], triples[1].astype(np.float64)
        made.pair_left = 1 - (made.pair_count - DISCOUNT * after) / np.maximum(made.pair_count, 1)
        return made

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def terms(self, ids: np.ndarray, first: np.ndarray, counted: bool = False) -> np.ndarray:
        """Per id its probability after one and after two ids; ``first`` marks the starts of texts.

        Where the texts were ``counted`` themselves, each id is taken out of the
        counts again, or training would trust them more than new texts allow.
        """
        own = 1 if counted else 0
        ids = ids.astype(np.int64)
        before = np.r_[self.end, ids[:-1]]
        before[first] = self.end
        at, hit = self._find(self.pair, (before << 16) | ids)
        one = self.left[before] * self.alone[ids]
        one[hit] += np.maximum(self.pair_count[at[hit]] - own - DISCOUNT, 0) / np.maximum(self.follows[before[hit]] - own, 1)
        # The pair that ends at the last id; a text's first id has none before it.
        context = np.r_[-1, np.where(hit, at, -1)[:-1]]
        context[first] = -1
        known = np.flatnonzero(context >= 0)
        # A context that only this text has tells nothing.
        known = known[self.pair_count[context[known]] > own]
        two, context = one.copy(), context[known]
        two[known] *= self.pair_left[context]
        at, hit = self._find(self.triple, (context << 16) | ids[known])
        two[known[hit]] += np.maximum(self.triple_count[at[hit]] - own - DISCOUNT, 0) / np.maximum(self.pair_count[context[hit]] - own, 1)
        return np.stack((one, two), 1).astype(np.float32)

    def tables(self, last: np.ndarray, counted: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """``terms`` of all pairs and of all triples, each computed once; ``last`` are the places of the triples' last pairs."""
        own, before, context = 1 if counted else 0, self.pair >> 16, self.triple >> 16
        one = self.left[before] * self.alone[self.pair & 0xFFFF]
        one += np.maximum(self.pair_count - own - DISCOUNT, 0) / np.maximum(self.follows[before] - own, 1)
        two, n = one[last], self.pair_count[context]
        more = two * self.pair_left[context]
        more += np.maximum(self.triple_count - own - DISCOUNT, 0) / np.maximum(n - own, 1)
        np.copyto(two, more, where=n > own)
        return one.astype(np.float32), two.astype(np.float32)


def id_classes(counts: Counts, clusters: int = CLUSTERS, clustered: int = CLUSTERED, rare: int = RARE, seed: int = 5) -> np.ndarray:
    """Class of every id: frequent ids clustered by the ids they follow, the others by how frequent they are."""
    size, rng = len(counts.alone), np.random.default_rng(seed)
    order = np.argsort(-counts.alone, kind="stable")
    top, classes = order[:clustered], np.zeros(size, np.int64)
    rest = order[clustered:]
    classes[rest] = clusters + np.minimum(rare - 1, np.cumsum(counts.alone[rest]) / max(1e-12, counts.alone[rest].sum()) * rare).astype(np.int64)
    place = np.full(size, -1)
    place[top] = np.arange(len(top))
    ahead, own = place[counts.pair >> 16], place[counts.pair & 0xFFFF]
    kept = (own >= 0) & (ahead >= 0) & (ahead < AHEAD)
    profile = np.zeros((len(top), AHEAD))
    profile[own[kept], ahead[kept]] = np.sqrt(counts.pair_count[kept])
    profile /= np.maximum(np.linalg.norm(profile, axis=1, keepdims=True), 1e-9)
    # The profiles' strongest directions, by a sketch of their range.
    sketch = np.linalg.qr(profile @ rng.standard_normal((AHEAD, 48)))[0]
    vectors = profile @ np.linalg.svd(sketch.T @ profile, full_matrices=False)[2][:32].T
    centres = vectors[:: max(1, len(top) // clusters)][:clusters].copy()
    near = np.zeros(len(top), np.int64)
    for _ in range(12):
        near = (centres @ vectors.T - (centres**2).sum(1)[:, None] / 2).argmax(0)
        total = np.zeros_like(centres)
        np.add.at(total, near, vectors)
        members = np.bincount(near, minlength=len(centres))
        centres[members > 0] = total[members > 0] / members[members > 0, None]
    classes[top] = near
    return np.unique(classes, return_inverse=True)[1]


class Attention:
    """One causal self-attention layer with learnt places; mixes count terms with a class of ids for the last ids of windows."""

    def __init__(self, counts: Counts, seed: int = 3):
        rng, vocabulary = np.random.default_rng(seed), len(counts.alone)

        def weights(*shape, scale=1.0):
            return (scale * rng.standard_normal(shape) / np.sqrt(shape[-2] if len(shape) > 1 else 1)).astype(np.float32)

        self.classes, self.start = id_classes(counts), vocabulary
        mass = np.bincount(self.classes, counts.alone)
        # Probability of an id inside its class.
        self.inside = (counts.alone / mass[self.classes]).astype(np.float32)
        self.p = {
            "embed": weights(vocabulary + 1, SIZE, scale=np.sqrt(vocabulary) * 0.5), "place": weights(WINDOW, SIZE, scale=np.sqrt(WINDOW) * 0.5),
            "q": weights(SIZE, SIZE), "k": weights(SIZE, SIZE), "v": weights(SIZE, OUT), "skip": weights(SIZE, OUT),
            "class": np.zeros((OUT, len(mass)), np.float32), "class_bias": np.log(mass).astype(np.float32),
            "share": np.zeros((OUT, 3), np.float32), "share_bias": np.array([0.0, 1.0, -1.5], np.float32),
        }
        # A scored place sees the inputs up to its own.
        self.mask = (np.arange(WINDOW) <= np.arange(WINDOW - STRIDE, WINDOW, BLOCK)[:, None]).astype(np.float32)

    def hidden(self, inputs: np.ndarray) -> np.ndarray:
        """States (window, scored place, OUT); ``inputs`` are the ids before each place, -1 where there is none."""
        return np.repeat(self.states(inputs), BLOCK, 1)

    def states(self, inputs: np.ndarray, keep: bool = False):
        """States (window, scored place, OUT), of all scored places."""
        p, lead = self.p, WINDOW - STRIDE
        none = inputs < 0
        used = np.where(none, self.start, inputs)
        x = p["embed"].take(used, 0)
        x += p["place"]
        near = x[:, lead::BLOCK]
        xs, (n, many, size) = near.reshape(-1, SIZE), near.shape
        # Queries' and keys' weights are one matrix, applied on the queries' side.
        r = (xs @ _pairing(p)).reshape(n, many, size)
        e = r @ x.transpose(0, 2, 1)
        # The place before a text's first id stays visible, as the start, and each place to itself.
        hide = none.copy()
        hide[:, :-1] &= none[:, 1:]
        hide[:, -1] = False
        some = np.flatnonzero(hide.any(1))
        seen = np.where(hide[some][:, None], np.float32(0), self.mask)
        seen[:, np.arange(many), np.arange(lead, WINDOW, BLOCK)] = 1
        # Exponentials within bounds need no common factor taken off.
        if not -60 < e.min(initial=0) <= e.max(initial=0) < 60:
            open_ = np.repeat(self.mask[None] > 0, n, 0)
            open_[some] = seen > 0
            e -= np.where(open_, e, -np.inf).max(2, keepdims=True)
            np.minimum(e, 0, out=e)
        np.exp(e, out=e)
        e *= self.mask
        e[some] *= seen
        scale = 1 / e.reshape(-1, WINDOW).dot(np.ones((WINDOW, 1), x.dtype))
        y = (e @ x).reshape(-1, size)
        y *= scale
        h = np.tanh(y @ p["v"] + xs @ p["skip"]).reshape(n, many, OUT)
        return (h, (near, x, xs, r, e, scale, y, used)) if keep else h

    def mixture(self, h: np.ndarray, ids: np.ndarray, terms: np.ndarray):
        """Exponentials of classes and shares of each id's state and what makes both sum to one, the three shared probabilities (part, id), and the place of each id's class among the exponentials."""
        p, classes = self.p, len(self.p["class_bias"])
        e = h @ np.concatenate((p["class"], p["share"]), 1)
        e += np.concatenate((p["class_bias"], p["share_bias"]))
        if not -60 < e.min(initial=0) <= e.max(initial=0) < 60:
            for part in (e[:, :classes], e[:, classes:]):
                part -= part.max(1, keepdims=True)
        np.exp(e, out=e)
        # Sums of the classes and of the shares.
        apart = np.zeros((e.shape[1], 2), e.dtype)
        apart[:classes, 0] = apart[classes:, 1] = 1
        scale = 1 / (e @ apart)
        parts = (e[:, classes:] * scale[:, 1:]).T.copy()
        parts[:2] *= terms.T
        place = np.arange(0, e.size, e.shape[1])
        place += self.classes.take(ids)
        parts[2] *= e.take(place) * scale[:, 0] * self.inside.take(ids)
        return e, scale, parts, place

    def logs(self, h: np.ndarray, ids: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Natural logs of the probability of each id, given its state and count terms."""
        return np.log(self.mixture(h, ids, terms)[2].sum(0, dtype=np.float64))

    def step(self, inputs: np.ndarray, targets: np.ndarray, terms: np.ndarray):
        """Gradients of the mean loss over the targets that are not -1: whole ones, and (rows, uses, gradient) of ``BY_ROW`` where states see them."""
        p, lead, classes = self.p, WINDOW - STRIDE, len(self.p["class_bias"])
        h, (_, x, xs, r, e, scale, y, used) = self.states(inputs, keep=True)
        (n, many, size), flat, valid = r.shape, h.reshape(-1, OUT), np.flatnonzero(targets.ravel() >= 0)
        whole = len(valid) == targets.size
        ids, own = targets.ravel().take(valid), flat if whole else flat.take(valid, 0)
        d, parts_scale, owed, place = self.mixture(own, ids, terms.reshape(-1, 2).take(valid, 0))
        owed /= owed[0] + owed[1] + owed[2]
        mean = h.dtype.type(1 / max(1, len(ids)))
        # Exponentials become gradients of what they are of.
        d_share = (d[:, classes:] * parts_scale[:, 1:] - owed.T) * mean
        owed[2] *= mean
        d *= (owed[2] * parts_scale[:, 0])[:, None]
        d.ravel()[place] -= owed[2]
        d[:, classes:] = d_share
        out_weights, out_bias = own.T @ d, np.ones(len(d), d.dtype) @ d
        out = {"class": out_weights[:, :classes], "share": out_weights[:, classes:], "class_bias": out_bias[:classes], "share_bias": out_bias[classes:]}
        du_own = (d @ np.concatenate((p["class"], p["share"]), 1).T) * (1 - own * own)
        du = du_own
        if not whole:
            du = np.zeros_like(flat)
            du[valid] = du_own
        dy = du @ p["v"].T
        dy *= scale
        ds = dy.reshape(r.shape) @ x.transpose(0, 2, 1)
        ds -= np.einsum("ij,ij->i", dy, y).reshape(n, many, 1)
        ds *= e
        dr = (ds @ x).reshape(-1, size)
        factor = h.dtype.type(SIZE**-0.5)
        d_pairing = (xs.T @ dr) * factor
        out |= {"skip": xs.T @ du, "v": y.T @ du, "q": d_pairing @ p["k"], "k": d_pairing.T @ p["q"]}
        dx = e.transpose(0, 2, 1) @ dy.reshape(r.shape)
        dx += ds.transpose(0, 2, 1) @ r
        dx[:, lead::BLOCK] += (dr @ _pairing(p).T + du @ p["skip"].T).reshape(r.shape)
        out["place"] = dx.sum(0)
        return out, {"embed": _by_row(used.ravel(), dx.reshape(-1, size))}

    def fit(self, stream, steps: int, rate: float = 0.2, seed: int = 4) -> dict[str, np.ndarray]:
        """Adagrad over all windows of a stream of (inputs, targets, terms); how often each row of ``BY_ROW`` was used.

        Windows are shuffled within some hundred batches, the rate falls over ``steps`` steps.
        """
        rng, number = np.random.default_rng(seed), 0
        square = {k: np.full_like(self.p[k], 1e-6) for k in BY_ROW}
        used = {k: np.zeros(len(self.p[k])) for k in BY_ROW}
        # All other parameters are one vector, of which each is a view.
        others = [k for k in self.p if k not in BY_ROW]
        flat = np.concatenate([self.p[k].ravel() for k in others])
        for name, part in zip(others, np.split(flat, np.cumsum([self.p[k].size for k in others])[:-1])):
            self.p[name] = part.reshape(self.p[name].shape)
        squares = np.full_like(flat, 1e-6)
        for held in _held(stream, STRETCH):
            order, inputs = rng.permutation(len(held[0])), held[0].ravel()
            used["embed"] += np.bincount(np.where(inputs < 0, self.start, inputs), minlength=len(used["embed"]))
            for low in range(0, len(order), BATCH):
                chosen = order[low:low + BATCH]
                grads, rows_ = self.step(*[part.take(chosen, 0) for part in held])
                pace = rate * (1 - 0.9 * min(1.0, number / max(1, steps)))
                number += 1
                d = np.concatenate([grads[k].ravel() for k in others])
                squares += d * d
                flat -= pace * d / np.sqrt(squares)
                for name, (touched, _, d) in rows_.items():
                    own = square[name].take(touched, 0) + d * d
                    square[name][touched] = own
                    self.p[name][touched] = self.p[name].take(touched, 0) - pace * d / np.sqrt(own)
        return used


def _pairing(p: dict[str, np.ndarray]) -> np.ndarray:
    """Weights of queries and keys as one matrix, with the scale of scores."""
    return (p["q"] @ p["k"].T) * p["q"].dtype.type(SIZE**-0.5)


def _by_row(places: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places that occur, how often, and the sums of their values."""
    # Short numbers are sorted by their digits.
    order = np.argsort(places.astype(np.min_scalar_type(places.max(initial=0))), kind="stable")
    places = places.take(order)
    new = np.ones(len(places), bool)
    np.not_equal(places[1:], places[:-1], out=new[1:])
    starts = np.flatnonzero(new)
    uses = np.diff(starts, append=len(places))
    return places.take(starts), uses, np.add.reduceat(values.take(order, 0), starts, 0)


def _held(stream, most: int):
    """Windows of a stream joined to stretches of about ``most``."""
    held, waiting = [], 0
    for pair in stream:
        held.append(pair)
        waiting += len(pair[0])
        if waiting >= most:
            yield tuple(map(np.concatenate, zip(*held)))
            held, waiting = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def windows(ids: np.ndarray, lengths: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and targets of the windows of one text, or of some that stand one after the other; every id is a target once, in order."""
    lead, lengths = WINDOW - STRIDE, np.array([len(ids)]) if lengths is None else lengths
    ends, count = np.cumsum(lengths), -(-lengths // STRIDE)
    first, number = np.repeat(ends - lengths, count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    # Inputs end one place before targets.
    at = (first + number * STRIDE)[:, None] + np.arange(-lead - 1, STRIDE)
    # Places out of a text are those of a -1 after all of them.
    at[(at < first[:, None]) | (at >= np.repeat(ends, count)[:, None])] = len(ids)
    near = np.append(ids, np.int32(-1))[at]
    return near[:, :WINDOW], near[:, lead + 1:]


def windowed(texts_: list[np.ndarray], counts: Counts, counted: bool = False) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Inputs, targets and count terms of the windows of some texts."""
    lengths = np.array([len(ids) for ids in texts_])
    ends = np.cumsum(lengths)
    terms = counts.terms(np.concatenate(texts_), ends - lengths, counted)
    return [with_terms(ids, lengths[k:k + 1], part) for k, (ids, part) in enumerate(zip(texts_, np.split(terms, ends[:-1])))]


def with_terms(ids: np.ndarray, lengths: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets and count terms of the windows of some texts, which stand one after the other."""
    inputs, targets = windows(ids, lengths)
    padded = np.ones((*targets.shape, 2), np.float32)
    padded[targets >= 0] = terms
    return inputs, targets, padded


def _stretches(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of consecutive sizes; each ends as soon as it has ``most``."""
    ends, low, done = np.cumsum(sizes), 0, 0
    while low < len(sizes):
        high = min(len(sizes), int(np.searchsorted(ends, done + most)) + 1)
        yield low, high
        low, done = high, ends[high - 1]


def _some(stream, ids_together: int = STACKED):
    """Lists of texts, given as ids, that have some thousand ids together."""
    held, waiting = [], 0
    for ids in stream:
        held.append(ids)
        waiting += len(ids)
        if waiting >= ids_together:
            yield held
            held, waiting = [], 0
    if held:
        yield held


class Scorer:
    def __init__(self, counts: Counts, model: Attention):
        self.counts, self.model = counts, model

    def scores(self, texts_: list[np.ndarray]) -> list[float]:
        """log10 probability of each text, given as ids."""
        out = []
        for some in _some(texts_):
            ids, lengths = np.concatenate(some), np.array([len(t) for t in some])
            out += self.scores_of(ids, lengths, self.counts.terms(ids, np.cumsum(lengths) - lengths)).tolist()
        return out

    def scores_of(self, ids: np.ndarray, lengths: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """log10 probability of each of some texts, whose ids and count terms stand one after the other."""
        inputs, targets = windows(ids, lengths)
        owner, out, low_id = np.repeat(np.arange(len(lengths)), lengths), np.zeros(len(lengths)), 0
        for low in range(0, len(inputs), BATCH):
            stack = slice(low, low + BATCH)
            # Targets are the ids in their order.
            at = np.flatnonzero(targets[stack].ravel() >= 0)
            part = slice(low_id, low_id + len(at))
            low_id = part.stop
            h = self.model.states(inputs[stack]).reshape(-1, OUT).take(at, 0)
            out += np.bincount(owner[part], self.model.logs(h, ids[part], terms[part]), len(out))
        return out / np.log(10)


def grams(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the pairs that end at each id of some texts, the ids two before, and the places that have a triple."""
    ends = np.cumsum(lengths)
    first, one = ends - lengths, np.zeros(len(ids), np.int64)
    one[1:] = ids[:-1]
    # A text starts after an end; its first id has nothing before that.
    one[first] = ids[ends - 1]
    two, inner = np.zeros(len(ids), np.int64), np.ones(len(ids), bool)
    two[1:], inner[first] = one[:-1], False
    one <<= 16
    one |= ids
    return one, two, inner


_GRAMS = "size int, key long, n long"


def _gram_counts(batches):
    """How often ids, pairs and triples occur in the texts of a task."""
    for some in _some((np.frombuffer(ids, np.int32) for (ids,) in rows(batches, "ids")), COUNTED):
        ids = np.concatenate(some).astype(np.int64)
        pairs, two, inner = grams(ids, np.array([len(t) for t in some]))
        for size, keys in ((1, ids), (2, pairs), (3, (two << 32 | pairs)[inner])):
            key, n = np.unique(keys, return_counts=True)
            for low in range(0, len(key), 200_000):
                part = key[low:low + 200_000]
                yield record_batch(_GRAMS, np.full(len(part), size), part, n[low:low + 200_000])


def gram_counts(ids: DataFrame, vocabulary: int, held: int = GRAMS) -> Counts:
    """Exact counts over all rows of a small table; more than ``held`` different pairs or triples are an error."""
    counted = staged(ids.select("ids").mapInArrow(_gram_counts, _GRAMS).groupBy("size", "key").agg(F.sum("n").alias("n")), "grams")

    def all_of(size: int) -> tuple[np.ndarray, np.ndarray]:
        of_size = counted.where(F.col("size") == size).select("key", "n")
        if size > 1 and of_size.count() > held:
            raise ValueError(f"more than {held} different pairs or triples: use score_texts")
        table = of_size.toArrow()
        return table.column("key").to_numpy().copy(), table.column("n").to_numpy().copy()

    key, n = all_of(1)
    single = np.zeros(vocabulary, np.int64)
    single[key] = n
    return Counts(single, all_of(2), all_of(3))


_SLICES = "name string, low int, total binary, weight binary"


def _fitted(start, opened):
    """What a task learns from all its parts: changes of the parameters times their weights, in slices of rows.

    ``opened`` gives a stream of windows and the number of steps of each part from the task's batches.
    """

    def run(batches):
        # The shared model stays as it is for other tasks of the worker.
        first, total, weight = start.value, {}, {}
        for stream, steps in opened(batches):
            model = copy.copy(first)
            model.p = {name: p.copy() for name, p in first.p.items()}
            used = model.fit(stream, steps)
            all_uses = used["embed"].sum()
            for name, p in model.p.items():
                uses = used.get(name, np.full(len(p), all_uses))
                change = (p - first.p[name]).astype(np.float64).reshape(len(p), -1) * uses[:, None]
                total[name], weight[name] = total.get(name, 0) + change, weight.get(name, 0) + uses
        out = Output(_SLICES, 20)
        for name, changes in total.items():
            for low in range(0, len(changes), AVERAGED):
                part = slice(low, low + AVERAGED)
                yield from out.add(name, low, changes[part].tobytes(), weight[name][part].tobytes())
        yield from out.flush()

    return run


def _summed(batches):
    """Sums of equal slices; rows come sorted by name and place."""
    out, at, total, weight = Output(_SLICES, 20), None, None, None
    for name, low, changes, weights in rows(batches, "name", "low", "total", "weight"):
        if (name, low) != at:
            if at:
                yield from out.add(*at, total.tobytes(), weight.tobytes())
            at, total, weight = (name, low), 0.0, 0.0
        total, weight = total + np.frombuffer(changes), weight + np.frombuffer(weights)
    if at:
        yield from out.add(*at, total.tobytes(), weight.tobytes())
    yield from out.flush()


def fit_in_parts(parts: DataFrame, model: Attention, opened) -> None:
    """Trains ``model`` on all parts in the tasks of ``parts`` and averages what they learn."""
    start = Shared(parts.sparkSession, model)
    slices = parts.mapInArrow(_fitted(start, opened), _SLICES)
    slices = slices.repartition("name", "low").sortWithinPartitions("name", "low").mapInArrow(_summed, _SLICES)
    for row in slices.toLocalIterator():
        weight = np.frombuffer(row["weight"])
        mean = np.frombuffer(row["total"]).reshape(len(weight), -1) / np.maximum(weight, 1)[:, None]
        part = model.p[row["name"]][row["low"]:row["low"] + len(weight)]
        part += mean.reshape(part.shape).astype(np.float32)
    start.close()


def train(ids: DataFrame, vocabulary: int) -> Scorer:
    """Scorer that holds all counts of a small stored table with a column ``ids`` (int32 ids as bytes, the end last)."""
    counts = gram_counts(ids, vocabulary)
    model, total = Attention(counts), int(counts.follows.sum())
    if total:
        tasks = -(-total // PART)
        steps, told = total // tasks // (BATCH * STRIDE), Shared(ids.sparkSession, counts)

        def opened(batches):
            texts_ = (np.frombuffer(ids, np.int32) for (ids,) in rows(batches, "ids"))
            yield (part for some in _some(texts_) for part in windowed(some, told.value, True)), steps

        fit_in_parts(ids.select("ids").repartition(tasks), model, opened)
        told.close()
    return Scorer(counts, model)


# ---- batches of texts, and the corpus counts of their words, pairs and triples ----------
_BATCH = "batch long, docs binary, nulls binary, held binary, lengths binary, words binary, hashes binary, buckets binary, learnt binary, spelled binary, spans binary"
_ASKED = "batch long, kind int, bucket int, keys binary, counts binary"
_ANSWER = "batch long, kind int, bucket int, counts binary, types binary, total long, distinct long"
# Kinds of rows: a batch itself, words, pairs, triples, how many pairs start with an id, frequent pairs.
TEXTS, WORDS, PAIRS, TRIPLES, TYPES, FREQUENT = range(6)


def _pack(values: np.ndarray) -> bytes:
    """Numbers as bytes, equal bytes of all numbers together, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def _unpack(packed: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(pa.decompress(packed[8:], size, codec="zstd", asbytes=True) if size else b"", np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _give_back() -> None:
    """What is free goes back to the machine, as at the end of ``rows``."""
    for _ in rows([]):
        pass


def _one_by_one(batches, *names: str) -> Iterator[tuple]:
    """Rows of the named columns; large ones are turned into Python objects one at a time."""
    for batch in batches:
        for at in range(batch.num_rows):
            yield tuple(batch.column(name)[at].as_py() for name in names)
        _give_back()


def held_out(column: Column) -> Column:
    """Remainder 1 of the CRC-32 of the id as text; null ids are held out."""
    return F.coalesce(F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(5)) == 1, F.lit(True))


def _as_bytes(texts_: pa.LargeStringArray) -> list[bytes]:
    """Texts without nulls as bytes, cut out of the column's own."""
    _, ends, held = texts_.buffers()
    ends = np.frombuffer(ends, np.int64, len(texts_) + 1, 8 * texts_.offset).tolist() if len(texts_) else [0]
    whole = memoryview(held or b"")
    return [bytes(whole[low:high]) for low, high in zip(ends, ends[1:])]


def _words(texts_: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Different lower-cased words; all words of all texts as numbers from 1, each text followed by a 0; lengths with that."""
    # Whole columns at once; bytes beyond ASCII stay as they are, be they UTF-8 or not.
    plain = pa.array(texts_, pa.large_binary()).view(pa.large_string())
    parts = pc.ascii_split_whitespace(pc.ascii_lower(plain))
    coded = parts.flatten().dictionary_encode()
    found = _as_bytes(coded.dictionary)
    numbers = coded.indices.to_numpy().astype(np.uint32) + np.uint32(1)
    owner = np.repeat(np.arange(len(texts_)), parts.value_lengths().to_numpy())
    if b"" in found:
        # Before a text's first word and after its last.
        empty = found.index(b"")
        del found[empty]
        kept = numbers != empty + 1
        numbers, owner = numbers[kept], owner[kept]
        numbers[numbers > empty] -= 1
    lengths = np.bincount(owner, minlength=len(texts_)) + 1
    words = np.zeros(len(numbers) + len(texts_), np.uint32)
    words[np.arange(len(numbers)) + owner] = numbers
    return found, words, lengths


def _number(path: str, buckets: int):
    """Texts in batches of some megabytes: their words as numbers, and each word's hash, spelling and use in training."""

    def run(batches):
        out, base, subwords = Output(_BATCH, 1), TaskContext.get().partitionId() << 32, Subwords(path)
        docs, held, texts_, waiting, batch = [], [], [], 0, 0

        def packed():
            kept_out, (found, words, lengths) = np.array(held, bool), _words(texts_)
            learnt = np.bincount(words[~np.repeat(kept_out, lengths)], minlength=len(found) + 1).astype(np.uint32)
            # The end is numbered as a space, which is no word.
            hashes = np.array([xxhash.xxh3_64_intdigest(word) for word in (b" ", *found)], np.uint64)
            spelled, spans = subwords.spelled(found)
            spelled, spans = np.r_[subwords.end, spelled].astype(np.uint16), np.r_[1, spans].astype(np.uint32)
            ids, nulls = np.array([i or 0 for i in docs], np.int64), np.array([i is None for i in docs], np.uint8)
            columns = (ids, nulls, kept_out.astype(np.uint8), lengths.astype(np.uint32), words, hashes, _bucket(hashes, buckets).astype(np.uint32), learnt, spelled, spans)
            yield from out.add(base + batch, *map(_pack, columns))

        for doc_id, text, kept_out in rows(batches, "doc_id", "text", "held_out"):
            docs.append(doc_id)
            held.append(kept_out)
            texts_.append(text or b"")
            # Short texts count as well.
            waiting += len(texts_[-1]) + 8
            if waiting >= NUMBERED:
                yield from packed()
                docs, held, texts_, waiting, batch = [], [], [], 0, batch + 1
        if docs:
            yield from packed()

    return run


_TEXTS = ("docs", "nulls", "held", "lengths", "words", "buckets", "spelled", "spans")


class Batch:
    """Texts of a batch: their words by number and their subword ids."""

    def __init__(self, docs, nulls, held, lengths, words, buckets, spelled, spans):
        self.docs = [None if null else int(i) for i, null in zip(_unpack(docs, np.int64), _unpack(nulls, np.uint8))]
        self.held, self.words, self.buckets = _unpack(held, np.uint8) > 0, _unpack(words, np.uint32), _unpack(buckets, np.uint32)
        self.lengths = _unpack(lengths, np.uint32).astype(np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        spans, spelled = _unpack(spans, np.uint32).astype(np.int64), _unpack(spelled, np.uint16)
        count = spans[self.words]
        ends = np.cumsum(count)
        start = (np.cumsum(spans) - spans)[self.words] - (ends - count)
        # Ids of a word stand together in its spelling.
        place = np.repeat(start, count)
        place += np.arange(ends[-1])
        self.ids = spelled[place].astype(np.int32)
        self.id_lengths = np.add.reduceat(count, self.first)
        # Per id, whether its text is learnt from.
        self.learnt = np.repeat(~self.held, self.id_lengths)



def _placed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, sorted, and the place of each key among them; ``keys`` are not kept."""
    digits = len(keys).bit_length()
    if len(keys) and int(keys.max()).bit_length() + digits < 64:
        # Sorting keys with their places is faster than finding an order.
        keys <<= digits
        keys |= np.arange(len(keys))
        keys.sort()
        order = keys & (1 << digits) - 1
        keys >>= digits
    else:
        order = np.argsort(keys)
        keys = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    number = np.cumsum(new, dtype=np.int32)
    number -= 1
    places = np.empty(len(keys), np.int32)
    places[order] = number
    return keys[new], places


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    mixed = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    return (mixed * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _by_bucket(dealt: np.ndarray, buckets: int) -> np.ndarray:
    """Order by bucket that leaves each bucket's keys as they stand."""
    # Short numbers are sorted by their digits, in linear time.
    return np.argsort(dealt.astype(np.min_scalar_type(buckets)), kind="stable")


def _asks(words: int, many: int):
    """Words, pairs and triples of each batch and their counts in its training texts, by bucket.

    Triples go by their first two ids, so that a bucket knows how many follow each pair.
    """

    def run(batches):
        out = Output(_ASKED, 200)

        def ask(batch, kind, low, keys, dealt, counts, buckets):
            order = _by_bucket(dealt, buckets)
            starts = np.r_[0, np.cumsum(np.bincount(dealt, minlength=buckets))]
            for bucket in np.flatnonzero(np.diff(starts)):
                part = order[starts[bucket]:starts[bucket + 1]]
                yield from out.add(batch, kind, low + int(bucket), _pack(np.diff(keys[part], prepend=keys.dtype.type(0))), _pack(counts[part]))

        def all_of(batch, hashes, learnt, *columns):
            some = Batch(*columns)
            yield from ask(batch, WORDS, 0, _unpack(hashes, np.uint64), some.buckets, _unpack(learnt, np.uint32), words)
            pairs, two, inner = grams(some.ids, some.id_lengths)
            # The last bit tells whether a place is learnt from.
            pairs <<= 1
            pairs |= some.learnt
            two <<= 33
            two |= pairs
            two = two[inner]
            del some, inner
            for kind, low, keys in ((PAIRS, words, pairs), (TRIPLES, words + many, two)):
                if not len(keys):
                    continue
                keys.sort()
                starts = np.flatnonzero(np.r_[True, keys[1:] >> 1 != keys[:-1] >> 1])
                found, counts = keys[starts] >> 1, np.add.reduceat(keys & 1, starts).astype(np.uint32)
                yield from ask(batch, kind, low, found, _bucket(found >> 16 if kind == TRIPLES else found, many), counts, many)

        # What a batch takes ends with its own call.
        for row in _one_by_one(batches, "batch", "hashes", "learnt", *_TEXTS):
            yield from all_of(*row)
        yield from out.flush()

    return run


def _answers(frequent: np.ndarray):
    """Corpus counts for the keys of each batch; rows come sorted by bucket.

    With triples go the numbers of different ones after each of their pairs. ``frequent``
    is 1 for ids before and 2 for ids after which frequent pairs are told of, or their sum.
    """

    def run(batches):
        out, at, held, types = Output(_ANSWER, 100), None, [], np.zeros(len(frequent), np.int64)

        def answer():
            kind, bucket = at
            blocks = [np.cumsum(_unpack(keys, np.uint64)) for _, keys, _ in held]
            keys, counts = np.concatenate(blocks), np.concatenate([_unpack(c, np.uint32) for *_, c in held]).astype(np.int64)
            order = np.argsort(keys)
            first = np.flatnonzero(np.r_[True, np.diff(keys[order]) != 0])
            unique, summed = keys[order][first], np.add.reduceat(counts[order], first)
            back = np.empty(len(keys), np.int64)
            back[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(keys)]))
            low, total, distinct = 0, int(summed.sum()), int((summed > 0).sum())
            if kind == TRIPLES:
                context = unique >> np.uint64(16)
                starts = np.r_[True, np.diff(context) != 0]
                after = np.add.reduceat((summed > 0).astype(np.int64), np.flatnonzero(starts))[np.cumsum(starts) - 1]
            if kind == PAIRS:
                learnt = summed > 0
                pair, n = unique[learnt].astype(np.int64), summed[learnt]
                types[:] += np.bincount(pair >> 16, minlength=len(types))
                told = (frequent[pair >> 16] & 1 > 0) & (frequent[pair & 0xFFFF] & 2 > 0)
                yield from out.add(None, FREQUENT, bucket, pair[told].tobytes(), n[told].tobytes(), 0, 0)
            for (batch, *_), block in zip(held, blocks):
                places = back[low:low + len(block)]
                low += len(block)
                own = b""
                if kind == TRIPLES:
                    context = block >> np.uint64(16)
                    own = _pack(after[places[np.r_[True, context[1:] != context[:-1]]]])
                yield from out.add(batch, kind, bucket, _pack(summed[places]), own, total, distinct)
                total, distinct = 0, 0

        for batch, kind, bucket, keys, counts in rows(batches, "batch", "kind", "bucket", "keys", "counts"):
            if (kind, bucket) != at and held:
                yield from answer()
                held = []
            at = kind, bucket
            held.append((batch, keys, counts))
        if held:
            yield from answer()
        key = np.flatnonzero(types)
        if len(key):
            yield from out.add(None, TYPES, None, key.tobytes(), types[key].tobytes(), 0, 0)
        yield from out.flush()

    return run


_ADDED = "key int, n long"


def _id_counts(size: int):
    """How often the training texts of a task have each id."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for learnt, spelled, spans in _one_by_one(batches, "learnt", "spelled", "spans"):
            times = np.repeat(_unpack(learnt, np.uint32), _unpack(spans, np.uint32))
            total += np.bincount(_unpack(spelled, np.uint16), times, size).astype(np.int64)
        key = np.flatnonzero(total)
        yield record_batch(_ADDED, key, total[key])

    return run


def _type_counts(batches):
    for key, n in rows(batches, "counts", "types"):
        yield record_batch(_ADDED, np.frombuffer(key, np.int64), np.frombuffer(n, np.int64))


def _summed_by_id(table: DataFrame, run, size: int) -> np.ndarray:
    """Sums by id, of which there are no more than the vocabulary has."""
    added = table.mapInArrow(run, _ADDED).groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[added.column("key").to_numpy()] = added.column("n").to_numpy()
    return out


class Told:
    """A batch with the answers to it: corpus counts of its words, and exact ones of all its pairs and triples."""

    def __init__(self, columns, answers: dict[int, list[tuple[bytes, bytes]]], words: int, many: int, single: np.ndarray, types: np.ndarray):
        self.batch, self.answers = batch, _ = Batch(*columns), answers
        self.word_counts = self._answered(WORDS, _by_bucket(batch.buckets, words))
        keys, _, inner = grams(batch.ids, batch.id_lengths)
        pairs, at = _placed(keys)
        # A triple as the place of its first pair and its last id.
        before = at[:-1][inner[1:]].astype(np.int64)
        before <<= 16
        before |= batch.ids[inner]
        third = np.zeros(len(at), np.int32)
        del keys
        triples, third[inner] = _placed(before)
        del before
        self.places, self.last = (at, third), np.empty(len(triples), np.int32)
        self.last[third[inner]] = at[inner]
        # Triples go by the buckets of their first pairs, and those without any next are not asked for.
        context = triples >> 16
        new = np.r_[True, context[1:] != context[:-1]][:len(context)]
        asked, after = context[new], np.zeros(len(pairs), np.int64)
        dealt = _bucket(pairs[asked], many)
        after[asked[_by_bucket(dealt, many)]] = np.concatenate([np.zeros(0, np.int64), *[_unpack(t, np.int64) for _, t in answers[TRIPLES]]])
        counted = self._answered(PAIRS, _by_bucket(_bucket(pairs, many), many)), self._answered(TRIPLES, _by_bucket(np.repeat(dealt, np.diff(np.r_[np.flatnonzero(new), len(new)])), many))
        self.counts = Counts.of_batch(single, types, (pairs, counted[0]), (triples, counted[1]), after)

    def _answered(self, kind: int, order: np.ndarray) -> np.ndarray:
        out = np.empty(len(order), np.int64)
        out[order] = np.concatenate([np.zeros(0, np.int64), *[_unpack(counts, np.int64) for counts, _ in self.answers[kind]]])
        return out

    def some(self, learnt: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, lengths and count terms of some texts at a time: some thousand ids of all texts, or stretches of windows of those that are learnt from."""
        batch, (one, two) = self.batch, self.counts.tables(self.last, learnt)
        ids, lengths, (at, third) = batch.ids, batch.id_lengths, self.places
        if learnt:
            ids, lengths, at, third = ids[batch.learnt], lengths[~batch.held], at[batch.learnt], third[batch.learnt]
        ends = np.cumsum(lengths)
        for low, high in _stretches(-(-lengths // STRIDE), STRETCH) if learnt else _stretches(lengths, STACKED):
            first = ends[low:high] - lengths[low:high]
            part = slice(first[0], ends[high - 1])
            terms = np.stack((one[at[part]], two[third[part]]), 1)
            # A text's first id has no two ids before it.
            terms[first - first[0], 1] = terms[first - first[0], 0]
            yield ids[part], lengths[low:high], terms


def _told(words: int, many: int, shared: Shared):
    """Batches with their answers; rows come sorted by batch, kind and bucket. One is to be let go before the next."""

    def opened(batches) -> Iterator[Told]:
        (single, types), columns, answers = shared.value, None, {}
        for kind, counts, after, *texts_ in _one_by_one(batches, "kind", "counts", "types", *_TEXTS):
            if kind == TEXTS:
                if columns:
                    yield Told(columns, answers, words, many, single, types)
                    _give_back()
                columns, answers = texts_, {WORDS: [], PAIRS: [], TRIPLES: []}
            else:
                answers[kind].append((counts, after))
        if columns:
            yield Told(columns, answers, words, many, single, types)
            # The worker lives on.
            del columns, answers
            _give_back()

    return opened


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(shared: Shared, opened, total: int, distinct: int):
    """Model and baseline scores of all texts."""

    def run(batches):
        whole, out = total + 0.5 * (distinct + 1), Output(_SCORED)
        for told in opened(batches):
            batch, counts = told.batch, told.word_counts
            logs = np.log10((counts + 0.5) / whole)
            base = np.add.reduceat(logs[batch.words], batch.first)
            known = np.add.reduceat((counts > 0).astype(np.int64)[batch.words], batch.first)
            scorer = Scorer(told.counts, shared.value)
            scores = np.concatenate([scorer.scores_of(*some) for some in told.some()])
            for doc_id, kept_out, n, k, b, score in zip(batch.docs, batch.held.tolist(), batch.lengths.tolist(), known.tolist(), base.tolist(), scores.tolist()):
                yield from out.add(doc_id, kept_out, n, k, total, b, score)
            del told, batch, counts, scorer
        yield from out.flush()

    return run


def score_texts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", learn_not: Column | None = None) -> DataFrame:
    """Model and baseline scores of every row; ``learn_not`` says which rows are held out."""
    with small_batches(docs.sparkSession):
        return _score_texts(docs, vocabulary, id_col, text_col, learn_not)


def _score_texts(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, learn_not: Column | None) -> DataFrame:
    apart = held_out(F.col(id_col)) if learn_not is None else learn_not
    parts, opened, model, known, (total, distinct) = counted(texts(docs, id_col, text_col, held_out=apart), vocabulary)
    if total:

        def learnt(batches):
            for told in opened(batches):
                yield (with_terms(*some) for some in told.some(learnt=True)), int(told.batch.learnt.sum()) // (BATCH * STRIDE)
                del told

        fit_in_parts(parts, model, learnt)
    shared = Shared(docs.sparkSession, model)
    found = staged(parts.mapInArrow(_scored(shared, opened, total, distinct), _SCORED), "scored")
    shared.close()
    known.close()
    return found


def counted(plain: DataFrame, vocabulary: str):
    """Batches with their answers, what opens them in tasks, a model before training, what is shared for that, and word totals."""
    spark, size = plain.sparkSession, Subwords(vocabulary).size
    text_bytes = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    words, many = 1 + text_bytes // BUCKET_BYTES, 1 + text_bytes // GRAM_BYTES
    numbered = staged(plain.mapInArrow(_number(vocabulary, words), _BATCH), "numbered")
    single = _summed_by_id(numbered.select("learnt", "spelled", "spans"), _id_counts(size), size)
    # Pairs of these ids tell the classes; there are at most AHEAD times CLUSTERED.
    order, frequent = np.argsort(-single, kind="stable"), np.zeros(size, np.uint8)
    frequent[order[:CLUSTERED]] |= 2
    frequent[order[:AHEAD]] |= 1
    asked = numbered.mapInArrow(_asks(words, many), _ASKED).repartition(words + 2 * many, "bucket").sortWithinPartitions("bucket")
    answers = staged(asked.mapInArrow(_answers(frequent), _ANSWER), "answers")
    types = _summed_by_id(answers.where(F.col("kind") == TYPES).select("counts", "types"), _type_counts, size)
    of_words = answers.where(F.col("kind") == WORDS).agg(F.sum("total"), F.sum("distinct")).first()
    pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for row in answers.where(F.col("kind") == FREQUENT).select("counts", "types").toLocalIterator():
        pairs.append((np.frombuffer(row[0], np.int64), np.frombuffer(row[1], np.int64)))
    key, n = map(np.concatenate, zip(*pairs))
    none = np.zeros(0, np.int64)
    model = Attention(Counts(single, (key, n), (none, none), (types, np.zeros(len(key)))))
    of_batches = answers.where(F.col("batch").isNotNull()).select("batch", "kind", "bucket", "counts", "types")
    both = numbered.select("batch", *_TEXTS).withColumn("kind", F.lit(TEXTS)).unionByName(of_batches, allowMissingColumns=True)
    parts = both.repartition(1 + numbered.select("batch").count() // 3, "batch").sortWithinPartitions("batch", "kind", "bucket")
    known = Shared(spark, (single, types))
    return parts, _told(words, many, known), model, known, tuple(int(value or 0) for value in of_words)
