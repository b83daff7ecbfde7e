"""Personal data: base rules, and spans added by a character BiLSTM with CRF transitions.

The base rules find e-mail addresses, IP addresses, card and phone numbers. They
also label the spans on which the network is trained, in numpy on the driver, from
at most ``TRAINED`` windows drawn by hash.

Texts are cut into overlapping windows. Every kind of span needs a digit or an at
sign, and the decoder accepts no span without one, so windows without either are
known to be empty and are not run through the network. The CRF decodes each window;
spans at a window's inner edge are left to the neighbour that sees them whole, and
all decoded spans of a text are reconciled by the heaviest set that does not
overlap. Added spans need a high confidence and never overlap base ones.

Offsets are code points, ends exclusive. A null text is empty and has no spans. Rows
that repeat an id are scanned one by one. Without windows to learn from nothing is
added.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixweave.llm.arrow import Output, Shared, rows

KINDS = ("email", "ip", "card", "phone")
WIDTH, STRIDE = 96, 48
TRAINED, EPOCHS, BATCH = 1_200, 5, 64
CONFIDENT = 0.95
# Windows run through the network together.
TOGETHER = 256

# ---- base rules --------------------------------------------------------------------
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that could start inside a run of digits also starts at the run, so runs are entered once.
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_NO_DIGIT = re.compile(r"[^0-9]")


def emails(text: str):
    """Leftmost matches, walking from at sign to at sign so that long words cost nothing."""
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            floor = domain.end()
        else:
            # What stands before this sign can be part of no later address.
            floor = at + 1
        at = text.find("@", max(at + 1, floor))


def luhn(digits: str) -> bool:
    total = 0
    for place, char in enumerate(reversed(digits)):
        value = int(char) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in the order of kinds, then places."""
    if not _TRIGGER.search(text):
        return []
    found = [(0, *span) for span in emails(text)]
    found += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_octet, m.groups()))]
    for match in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", match.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *match.span()))
    for match in _PHONE.finditer(text):
        if 9 <= len(_NO_DIGIT.sub("", match.group())) <= 15:
            found.append((3, *match.span()))
    return found


# ---- windows ---------------------------------------------------------------------------
_SIGNS = "@.-_+%() \n\t:/,;'\"#=|"


def classes(text: str) -> np.ndarray:
    """Character classes: padding 0, digit, small, capital, other letter, other; then single signs."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return _CLASS[np.minimum(codes, 128)]


def _class_table() -> np.ndarray:
    table = np.full(129, 5, np.int64)
    table[48:58], table[97:123], table[65:91], table[128] = 1, 2, 3, 4
    for number, sign in enumerate(_SIGNS):
        table[ord(sign)] = 6 + number
    return table


_CLASS = _class_table()
N_CLASSES = 6 + len(_SIGNS)
# Tags: 0 outside, then begin and inside of each kind.
N_TAGS = 1 + 2 * len(KINDS)


def window_starts(text: str) -> list[int]:
    """Starts of all windows with a digit or an at sign."""
    cells = {m.start() // STRIDE for m in _TRIGGER.finditer(text)}
    return sorted({c * STRIDE for cell in cells for c in (cell - 1, cell) if c >= 0} )


def tags(spans: list[tuple[int, int, int]], start: int) -> np.ndarray | None:
    """Tags of a window; None if a span crosses its edge or two overlap."""
    out = np.zeros(WIDTH, np.int64)
    for kind, low, high in spans:
        if high <= start or low >= start + WIDTH:
            continue
        if low < start or high > start + WIDTH or out[low - start:high - start].any():
            return None
        out[low - start:high - start] = 2 + 2 * kind
        out[low - start] = 1 + 2 * kind
    return out


def _padded(text: str, start: int) -> np.ndarray:
    out = np.zeros(WIDTH, np.int64)
    part = classes(text[start:start + WIDTH])
    out[:len(part)] = part
    return out


# ---- the network ---------------------------------------------------------------------------
def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _allowed() -> np.ndarray:
    """Transitions: inside follows begin or inside of its own kind only."""
    allowed = np.ones((N_TAGS, N_TAGS), bool)
    for kind in range(len(KINDS)):
        allowed[:, 2 + 2 * kind] = False
        allowed[[1 + 2 * kind, 2 + 2 * kind], 2 + 2 * kind] = True
    return allowed


class Tagger:
    """Bidirectional LSTM over character classes with a linear-chain CRF on top."""

    def __init__(self, embedded: int = 12, hidden: int = 16, seed: int = 5):
        rng = np.random.default_rng(seed)

        def weights(*shape):
            return (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)

        self.hidden = hidden
        self.p = {
            "embed": weights(N_CLASSES, embedded) * 3, "wx": weights(2, embedded, 4 * hidden), "wh": weights(2, hidden, 4 * hidden),
            "b": np.zeros((2, 1, 4 * hidden), np.float32), "wo": weights(2 * hidden, N_TAGS), "bo": np.zeros(N_TAGS, np.float32),
            "move": np.zeros((N_TAGS, N_TAGS), np.float32), "first": np.zeros(N_TAGS, np.float32),
        }
        self.p["b"][:, :, hidden:2 * hidden] = 1
        self.mask = np.where(_allowed(), 0, -1e4).astype(np.float32)
        self.first_mask = np.where([k >= 2 and k % 2 == 0 for k in range(N_TAGS)], -1e4, 0).astype(np.float32)

    def forward(self, ids: np.ndarray, keep: bool = False):
        """Emissions (batch, place, tag); both directions run in one loop."""
        p, size, hidden = self.p, len(ids), self.hidden
        x = p["embed"][ids]
        both = np.stack([x, x[:, ::-1]])
        z_x = (both.reshape(2, size * WIDTH, -1) @ p["wx"]).reshape(2, size, WIDTH, -1) + p["b"][:, :, None]
        h = c = np.zeros((2, size, hidden), np.float32)
        hs = np.empty((2, size, WIDTH, hidden), np.float32)
        kept = []
        for t in range(WIDTH):
            z = z_x[:, :, t] + h @ p["wh"]
            gates = _sigmoid(z[..., :3 * hidden])
            i, f, o = gates[..., :hidden], gates[..., hidden:2 * hidden], gates[..., 2 * hidden:]
            g = np.tanh(z[..., 3 * hidden:])
            before, c = c, f * c + i * g
            squashed = np.tanh(c)
            if keep:
                kept.append((h, before, i, f, o, g, squashed))
            h = o * squashed
            hs[:, :, t] = h
        joined = np.concatenate([hs[0], hs[1][:, ::-1]], axis=2)
        return joined @ p["wo"] + p["bo"], (both, kept, joined)

    def _chain(self, emissions: np.ndarray):
        """Scaled forward and backward messages, and their factors."""
        move, e = np.exp(self.p["move"] + self.mask), np.exp(emissions - emissions.max(2, keepdims=True))
        size = len(e)
        alpha, beta = np.empty_like(e), np.empty_like(e)
        at = np.exp(self.p["first"] + self.first_mask) * e[:, 0]
        scale = np.empty((size, WIDTH), np.float32)
        for t in range(WIDTH):
            if t:
                at = (at @ move) * e[:, t]
            scale[:, t] = at.sum(1)
            at = at / scale[:, t, None]
            alpha[:, t] = at
        back = np.ones((size, N_TAGS), np.float32)
        beta[:, -1] = back
        for t in range(WIDTH - 1, 0, -1):
            back = (e[:, t] * back) @ move.T / scale[:, t, None]
            beta[:, t - 1] = back
        return alpha, beta, scale, e, move

    def marginals(self, emissions: np.ndarray) -> np.ndarray:
        alpha, beta, *_ = self._chain(emissions)
        found = alpha * beta
        return found / found.sum(2, keepdims=True)

    def gradients(self, ids: np.ndarray, gold: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log-likelihood of the gold tags."""
        p, hidden, size = self.p, self.hidden, len(ids)
        emissions, (both, kept, joined) = self.forward(ids, keep=True)
        alpha, beta, scale, e, move = self._chain(emissions)
        marginal = alpha * beta
        marginal /= marginal.sum(2, keepdims=True)
        rows_, places = np.arange(size)[:, None], np.arange(WIDTH)
        d_emit = marginal.copy()
        d_emit[rows_, places, gold] -= 1
        d_emit /= size
        right = e[:, 1:] * beta[:, 1:] / scale[:, 1:, None]
        pairs = np.einsum("bti,btj->ij", alpha[:, :-1], right) * move
        d_move = pairs.copy()
        np.add.at(d_move, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), -1)
        first = marginal[:, 0].sum(0)
        np.add.at(first, gold[:, 0], -1)
        out = {
            "move": d_move / size * _allowed(), "first": first / size, "bo": d_emit.sum((0, 1)),
            "wo": joined.reshape(-1, 2 * hidden).T @ d_emit.reshape(-1, N_TAGS),
        }
        d_joined = d_emit @ p["wo"].T
        d_hs = np.stack([d_joined[..., :hidden], d_joined[:, ::-1, hidden:]])
        d_z = np.empty((2, size, WIDTH, 4 * hidden), np.float32)
        d_h = d_c = np.zeros((2, size, hidden), np.float32)
        d_wh = np.zeros_like(p["wh"])
        for t in range(WIDTH - 1, -1, -1):
            h, before, i, f, o, g, squashed = kept[t]
            d_h = d_h + d_hs[:, :, t]
            d_c = d_c + d_h * o * (1 - squashed * squashed)
            d = d_z[:, :, t]
            d[..., :hidden] = d_c * g * i * (1 - i)
            d[..., hidden:2 * hidden] = d_c * before * f * (1 - f)
            d[..., 2 * hidden:3 * hidden] = d_h * squashed * o * (1 - o)
            d[..., 3 * hidden:] = d_c * i * (1 - g * g)
            d_wh += h.transpose(0, 2, 1) @ d
            d_h = d @ p["wh"].transpose(0, 2, 1)
            d_c = d_c * f
        flat = d_z.reshape(2, size * WIDTH, -1)
        d_both = (flat @ p["wx"].transpose(0, 2, 1)).reshape(2, size, WIDTH, -1)
        d_x = d_both[0] + d_both[1][:, ::-1]
        out |= {"wh": d_wh, "wx": both.reshape(2, size * WIDTH, -1).transpose(0, 2, 1) @ flat, "b": d_z.sum((1, 2))[:, None]}
        out["embed"] = np.zeros_like(p["embed"])
        np.add.at(out["embed"], ids.ravel(), d_x.reshape(-1, d_x.shape[-1]))
        return out

    def fit(self, ids: np.ndarray, gold: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02, seed: int = 9) -> Tagger:
        rng, step = np.random.default_rng(seed), 0
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        for epoch in range(epochs):
            order = rng.permutation(len(ids))
            for start in range(0, len(ids), BATCH):
                step += 1
                chosen = order[start:start + BATCH]
                for k, d in self.gradients(ids[chosen], gold[chosen]).items():
                    d = np.clip(d, -1, 1)
                    mean[k] = 0.9 * mean[k] + 0.1 * d
                    square[k] = 0.99 * square[k] + 0.01 * d * d
                    self.p[k] -= (rate / (1 + epoch) * mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags by Viterbi, and the probability of each of them."""
        emissions, _ = self.forward(ids)
        move, size = self.p["move"] + self.mask, len(ids)
        score = emissions[:, 0] + self.p["first"] + self.first_mask
        back = np.empty((size, WIDTH, N_TAGS), np.int8)
        for t in range(1, WIDTH):
            ways = score[:, :, None] + move
            back[:, t] = ways.argmax(1)
            score = ways.max(1) + emissions[:, t]
        best = np.empty((size, WIDTH), np.int64)
        best[:, -1] = score.argmax(1)
        for t in range(WIDTH - 1, 0, -1):
            best[:, t - 1] = back[np.arange(size), t, best[:, t]]
        sure = np.take_along_axis(self.marginals(emissions), best[..., None], 2)[..., 0]
        return best, sure


def decoded_spans(best: np.ndarray, sure: np.ndarray, start: int, length: int) -> list[tuple[int, int, int, float]]:
    """(kind, start, end, confidence) of one window; none that an inner edge may cut."""
    out, at = [], 0
    stop = min(WIDTH, length - start)
    while at < stop:
        tag = best[at]
        if tag % 2 == 0:
            at += 1
            continue
        end = at + 1
        while end < stop and best[end] == tag + 1:
            end += 1
        if (at > 0 or start == 0) and (end < stop or start + end == length):
            out.append((int(tag - 1) // 2, start + at, start + end, float(sure[at:end].min())))
        at = end
    return out


def reconciled(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """The heaviest set of spans that do not overlap; weight is confidence times length."""
    best: dict[tuple[int, int, int], float] = {}
    for kind, low, high, sure in spans:
        best[kind, low, high] = max(sure, best.get((kind, low, high), 0.0))
    ordered = sorted(((high, low, kind, sure) for (kind, low, high), sure in best.items()))
    ends, weight, chosen = [h for h, *_ in ordered], [0.0], [None]
    for number, (high, low, kind, sure) in enumerate(ordered):
        before = bisect.bisect_right(ends, low, 0, number)
        taken = weight[before] + sure * (high - low)
        weight.append(max(weight[-1], taken))
        chosen.append(before if taken > weight[-2] else None)
    out, at = [], len(ordered)
    while at:
        if chosen[at] is None:
            at -= 1
            continue
        high, low, kind, sure = ordered[at - 1]
        out.append((kind, low, high, sure))
        at = chosen[at]
    return out[::-1]


# ---- in Spark ----------------------------------------------------------------------------------
_WINDOW = "draw long, ids binary, gold binary"


def _training_windows(batches):
    out = Output(_WINDOW)
    for (text,) in rows(batches, "text"):
        spans = base_spans(text)
        for start in window_starts(text):
            gold = tags(spans, start)
            if gold is not None:
                ids = _padded(text, start).astype(np.uint8).tobytes()
                mark = hashlib.blake2b(ids, digest_size=8).digest()
                yield from out.add(int.from_bytes(mark, "little", signed=True), ids, gold.astype(np.uint8).tobytes())
    yield from out.flush()


def fit(texts_: DataFrame, windows: int = TRAINED) -> Tagger | None:
    """Tagger trained on at most ``windows`` different labelled windows; reruns draw the same ones."""
    drawn = texts_.where(F.col("text").rlike("[0-9@]")).select("text").mapInArrow(_training_windows, _WINDOW)
    picked = drawn.groupBy("draw").agg(F.min("ids").alias("ids"), F.min("gold").alias("gold")).orderBy("draw").limit(windows).collect()
    if not picked:
        return None
    ids = np.stack([np.frombuffer(r["ids"], np.uint8) for r in picked]).astype(np.int64)
    gold = np.stack([np.frombuffer(r["gold"], np.uint8) for r in picked]).astype(np.int64)
    return Tagger().fit(ids, gold)


_FOUND = "doc_id long, kinds array<int>, starts array<long>, ends array<long>, base array<boolean>"


def added_spans(texts_: list[str], base: list[list[tuple[int, int, int]]], tagger: Tagger) -> list[list[tuple[int, int, int]]]:
    """Spans that the tagger adds to the base spans of some texts."""
    at = [(number, start) for number, text in enumerate(texts_) for start in window_starts(text)]
    decoded: list[list] = [[] for _ in texts_]
    for low in range(0, len(at), TOGETHER):
        part = at[low:low + TOGETHER]
        best, sure = tagger.decode(np.stack([_padded(texts_[n], s) for n, s in part]))
        for (number, start), tags_, sures in zip(part, best, sure):
            if tags_.any():
                decoded[number] += decoded_spans(tags_, sures, start, len(texts_[number]))
    out = []
    for number, spans in enumerate(decoded):
        text, taken = texts_[number], base[number]
        out.append([
            (kind, low, high) for kind, low, high, sure in reconciled(spans)
            if sure >= CONFIDENT and _TRIGGER.search(text, low, high) and not any(low < b and a < high for _, a, b in taken)
        ])
    return out


def _scan(model):
    def run(batches):
        out, tagger, held = Output(_FOUND), model.value, []

        def flush():
            base = [base_spans(text) for _, text in held]
            more = added_spans([t for _, t in held], base, tagger) if tagger else [[] for _ in held]
            for (doc_id, _), own, extra in zip(held, base, more):
                spans = sorted([(*s, True) for s in own] + [(*s, False) for s in extra])
                yield from out.add(doc_id, *([s[i] for s in spans] for i in range(4)))
            held.clear()

        for doc_id, text in rows(batches, "doc_id", "text"):
            if not text or not _TRIGGER.search(text):
                yield from out.add(doc_id, [], [], [], [])
                continue
            held.append((doc_id, text))
            if len(held) >= 200:
                yield from flush()
        yield from flush()
        yield from out.flush()

    return run


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id`` and its spans as arrays ``kinds`` (place in ``KINDS``), ``starts``, ``ends``, ``base``."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = Shared(docs.sparkSession, fit(plain))
    return plain.mapInArrow(_scan(model), _FOUND)
