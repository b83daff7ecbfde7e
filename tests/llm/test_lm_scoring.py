"""Language-model scores: normalisation, counts and gradients by hand, the query's columns by brute force."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from fixweave.llm import lm_scoring as lm
from fixweave.llm.queries import RANKS

SCHEMA = "doc_id long, text string, score string, ids int"


def texts_of(rng, count=40, vocabulary=12):
    """Texts as ids below ``vocabulary - 1``, with the end last."""
    return [np.array([rng.randrange(vocabulary - 1) % rng.randint(2, vocabulary) for _ in range(rng.choice([0, 1, 2, 30]))] + [vocabulary - 1], np.int32) for _ in range(count)]


def counts_of(texts, vocabulary=12, held=lm.GRAMS):
    single, pairs, triples = Counter(), Counter(), Counter()
    for text in texts:
        ids = [vocabulary - 1, *text.tolist()]
        single.update(ids[1:])
        pairs.update(a << 16 | b for a, b in zip(ids, ids[1:]))
        triples.update(a << 32 | b << 16 | c for a, b, c in zip(ids, ids[1:], ids[2:]))

    def most(counted):
        kept = counted.most_common(held)
        return np.array([k for k, _ in kept], np.int64), np.array([n for _, n in kept], np.int64)

    return lm.Counts(np.array([single[i] for i in range(vocabulary)]), most(pairs), most(triples))


@pytest.mark.parametrize("held", [lm.GRAMS, 25, 0])
def test_every_part_sums_to_one(held):
    rng = random.Random(1)
    counts = counts_of(texts_of(rng), held=held)
    model = lm.Attention(counts)
    model.p = {k: (v + np.random.default_rng(2).normal(size=v.shape) * 0.3).astype(np.float32) for k, v in model.p.items()}
    for context in ([], [3], [3, 1], [0, 0, 2], [10, 10]):
        texts = [np.array([*context, i], np.int32) for i in range(12)]
        ends = np.cumsum([len(t) for t in texts]) - 1
        terms = counts.terms(np.concatenate(texts), ends - len(context))[ends]
        assert np.allclose(terms.sum(0), 1, atol=1e-5)
        parts = [lm.windowed([t], counts)[0] for t in texts]
        total = 0.0
        for (inputs, _, _), text, term in zip(parts, texts, terms):
            h = model.hidden(inputs)[0, len(context)][None]
            total += math.exp(model.logs(h, text[-1:], term[None])[0])
        assert total == pytest.approx(1, abs=1e-4)


def test_counts_after_one_and_two_ids():
    texts = [np.array(t, np.int32) for t in ([0, 1, 0, 1, 2, 11], [0, 1, 1, 11], [11])]
    counts = counts_of(texts)
    single = np.array([3, 4, 1] + [0] * 8 + [3])
    alone = (single + 0.05) / (single.sum() + 0.05 * 12)

    def after_one(before, x):
        pairs = Counter((a, b) for t in texts for a, b in zip([11, *t.tolist()], t.tolist()))
        n = sum(c for (a, _), c in pairs.items() if a == before)
        kept = sum(c - 0.75 for (a, _), c in pairs.items() if a == before)
        return max(pairs[before, x] - 0.75, 0) / n + (1 - kept / n) * alone[x]

    found = counts.terms(np.array([0, 1, 0], np.int32), np.array([0]))
    assert found[:, 0] == pytest.approx([after_one(11, 0), after_one(0, 1), after_one(1, 0)])
    # After 0 1: once 0, once 2, once 1; after (end) 0: 1 both times.
    third = (1 - 0.75) / 3 + 3 * 0.75 / 3 * after_one(1, 0)
    second = (2 - 0.75) / 2 + 0.75 / 2 * after_one(0, 1)
    assert found[:, 1] == pytest.approx([after_one(11, 0), second, third])
    # Out of its own counts, a text that is alone with its pairs knows them no more.
    lone = counts_of([np.array([5, 6, 7, 11], np.int32)] + texts)
    assert lone.terms(np.array([5, 6, 7, 11]), np.array([0]), counted=True)[2, 1] < lone.terms(np.array([5, 6, 7, 11]), np.array([0]))[2, 1] / 3


def test_windows_score_each_id_once():
    for length in (1, 31, 32, 33, 64, 65, 300):
        inputs, targets = lm.windows(np.arange(length, dtype=np.int32))
        flat = targets.ravel()
        assert flat[flat >= 0].tolist() == list(range(length))
        valid = targets >= 0
        assert (inputs[:, lm.WINDOW - lm.STRIDE:][valid] == targets[valid] - 1).all()


def test_windows_of_many_texts_are_those_of_each():
    texts = texts_of(random.Random(10), 30) + [np.arange(n, dtype=np.int32) for n in (31, 32, 33, 64, 200)]
    ids, lengths = np.concatenate(texts), np.array([len(t) for t in texts])
    terms = np.random.default_rng(11).random((len(ids), 2)).astype(np.float32)
    inputs, targets, padded = lm.with_terms(ids, lengths, terms)
    alone = [lm.windows(t) for t in texts]
    assert (inputs == np.concatenate([a for a, _ in alone])).all() and (targets == np.concatenate([b for _, b in alone])).all()
    valid = targets >= 0
    assert (targets[valid] == ids).all() and (padded[valid] == terms).all() and (padded[~valid] == 1).all()


def test_states_compute_only_what_they_see():
    rng = random.Random(12)
    texts = texts_of(rng, 10) + [np.array([rng.randrange(11) for _ in range(100)] + [11], np.int32)]
    counts = counts_of(texts)
    model, noise = lm.Attention(counts), np.random.default_rng(13)
    p = model.p = {k: v + noise.normal(size=v.shape) * 0.3 for k, v in model.p.items()}
    inputs, targets, terms = map(np.concatenate, zip(*lm.windowed(texts, counts)))
    found, kept = model.states(inputs, keep=True)
    # Neither embeddings nor gradients are made for places that every state is blind to.
    assert kept[0].shape[1] < lm.WINDOW and lm.WINDOW - lm.STRIDE < kept[0].shape[1]
    touched = model.step(inputs[-1:], targets[-1:], terms[-1:])[1]["embed"][0]
    assert set(touched.tolist()) <= set(inputs[-1, :kept[0].shape[1]].tolist()) | {model.start}
    for window, states in zip(inputs, found):
        for block, state in enumerate(states):
            at = lm.WINDOW - lm.STRIDE + block * lm.BLOCK
            x = p["embed"][np.where(window < 0, model.start, window)] + p["place"]
            open_ = [j for j in range(at + 1) if window[j] >= 0 or j == at or window[j + 1] >= 0]
            weights = np.array([math.exp((x[at] @ p["q"]) @ (x[j] @ p["k"]) / lm.SIZE**0.5) for j in open_])
            y = (weights / weights.sum()) @ (x[open_] @ p["v"])
            assert state == pytest.approx(np.tanh(y + x[at] @ p["skip"]), abs=1e-5)


@pytest.mark.parametrize("scale", [0.3, 30.0])
def test_every_scored_place_has_a_state_of_its_own(scale):
    rng = random.Random(16)
    texts = texts_of(rng, 6) + [np.array([rng.randrange(11) for _ in range(100)] + [11], np.int32)]
    counts = counts_of(texts)
    model, noise = lm.Attention(counts), np.random.default_rng(17)
    # Weights so large that exponentials would overflow are met as well.
    p = model.p = {k: v + noise.normal(size=v.shape) * scale for k, v in model.p.items()}
    inputs, targets, terms = map(np.concatenate, zip(*lm.windowed(texts, counts)))
    found, lead = model.states(inputs), lm.WINDOW - lm.STRIDE
    assert found.shape == (len(inputs), lm.STRIDE, lm.OUT) and (model.hidden(inputs) == found).all()
    for window, states, valid in zip(inputs, found, targets >= 0):
        x = p["embed"][np.where(window < 0, model.start, window)] + p["place"]
        for place in np.flatnonzero(valid):
            at = lead + place
            open_ = [j for j in range(at + 1) if window[j] >= 0 or j == at or window[j + 1] >= 0]
            scores = (x[open_] @ p["k"]) @ (x[at] @ p["q"]) / lm.SIZE**0.5
            weights = np.exp(scores - scores.max())
            y = (weights / weights.sum()) @ (x[open_] @ p["v"])
            assert states[place] == pytest.approx(np.tanh(y + x[at] @ p["skip"]), abs=1e-5)
    # Another id changes what is said at its own place and after it, and nothing before it.
    full = np.flatnonzero((targets >= 0).all(1))[0]
    for place in (0, 1, 15, lm.STRIDE - 1):
        changed = inputs[full:full + 1].copy()
        changed[0, lead + place] = (changed[0, lead + place] + 1) % 11
        differs = np.abs(model.states(changed)[0] - found[full]).max(1) > 1e-9
        assert differs[place] and not differs[:place].any()
    assert np.isfinite(model.logs(found[targets >= 0], targets[targets >= 0], terms[targets >= 0])).all()


@pytest.mark.parametrize("counted", [False, True])
def test_tables_hold_the_terms_of_each_id(counted):
    texts = texts_of(random.Random(14), 60)
    counts, ids = counts_of(texts), np.concatenate(texts).astype(np.int64)
    lengths = np.array([len(t) for t in texts])
    pairs, _, inner = lm.grams(ids, lengths)
    at = np.searchsorted(counts.pair, pairs)
    third = np.searchsorted(counts.triple, at[:-1][inner[1:]] << 16 | ids[inner])
    last = np.zeros(len(counts.triple), np.int64)
    last[third] = at[inner]
    one, two = counts.tables(last, counted)
    expected = counts.terms(ids, np.cumsum(lengths) - lengths, counted)
    assert (one[at] == expected[:, 0]).all() and (two[third] == expected[inner, 1]).all() and (one[at[~inner]] == expected[~inner, 1]).all()


def test_memory_is_given_back_once_for_many_rows(monkeypatch):
    calls = []
    given = lm.rows
    monkeypatch.setattr(lm, "rows", lambda *args: calls.append(1) or given(*args))
    batch = lm.pa.RecordBatch.from_pydict({"n": list(range(500)), "text": [b"x", None] * 250})
    assert list(lm._one_by_one([batch], "text", "n")) == [(None if i % 2 else b"x", i) for i in range(500)]
    assert len(calls) <= 2


def test_placed_keys():
    rng = np.random.default_rng(15)
    for high, count in ((5, 0), (5, 1), (40, 300), (1 << 62, 300)):
        keys = rng.integers(0, high, count)
        keys = np.r_[keys, keys[: count // 2]]
        distinct, places = lm._placed(keys.copy())
        assert (distinct == np.unique(keys)).all() and (distinct[places] == keys).all()


def test_gradients_by_differences():
    rng = random.Random(3)
    texts = texts_of(rng, 12) + [np.array([rng.randrange(11) for _ in range(90)] + [11], np.int32)]
    counts = counts_of(texts)
    model, noise = lm.Attention(counts), np.random.default_rng(4)
    model.p = {k: (v + noise.normal(size=v.shape) * 0.2).astype(np.float64) for k, v in model.p.items()}
    inputs, targets, terms = map(np.concatenate, zip(*lm.windowed(texts, counts)))

    def loss():
        h = model.hidden(inputs).reshape(-1, lm.OUT)
        valid = targets.ravel() >= 0
        return -model.logs(h[valid], targets.ravel()[valid], terms.reshape(-1, 2)[valid]).mean()

    whole, rows = model.step(inputs, targets, terms)
    touched, _, values = rows["embed"]
    whole["embed"] = np.zeros_like(model.p["embed"])
    whole["embed"][touched] = values
    for name, gradient in whole.items():
        for _ in range(6):
            at = tuple(noise.integers(0, n) for n in model.p[name].shape)
            kept, step = model.p[name][at], 1e-3
            model.p[name][at] = kept + step
            up = loss()
            model.p[name][at] = kept - step
            down = loss()
            model.p[name][at] = kept
            assert gradient[at] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=3e-5), name


def test_stacked_texts_score_as_alone():
    rng = random.Random(5)
    texts = texts_of(rng, 60) + [np.array([rng.randrange(11) for _ in range(9_000)] + [11], np.int32)]
    scorer = lm.Scorer(counts_of(texts), lm.Attention(counts_of(texts)))
    assert scorer.scores(texts) == pytest.approx([scorer.scores([t])[0] for t in texts], rel=1e-4)


def ids_table(spark, rows):
    subwords = lm.Subwords(RANKS)
    ids = [(bytearray(subwords((text or "").encode().lower().split()).tobytes()),) for _, text in rows]
    return spark.createDataFrame(spark.sparkContext.parallelize(ids, 4), "ids binary")


def test_scoring_learns_from_all_rows(spark, monkeypatch):
    monkeypatch.setattr(lm, "PART", 12_000)
    monkeypatch.setattr(lm, "COUNTED", 5_000)
    kinds = ("red blue red blue", "up down up down")
    rows = [(i, kinds[i >= 1_000]) for i in range(2_000)] + [(2_000, "up down " * 3_000), (2_001, None)]
    subwords = lm.Subwords(RANKS)
    scorer = lm.train(ids_table(spark, rows), subwords.size)
    held = [subwords((text or "").encode().split()) for _, text in rows]
    assert scorer.counts.follows.sum() == sum(map(len, held)) and scorer.counts.follows[subwords.end] == len(rows)
    assert scorer.counts.pair_count.sum() == sum(map(len, held))
    assert scorer.counts.triple_count.sum() == sum(len(t) - 1 for t in held)
    seen, mixed = (scorer.scores([subwords(w * 20) for w in pair]) for pair in (([b"red", b"blue"], [b"up", b"down"]), ([b"red", b"down"], [b"up", b"blue"])))
    assert min(seen) > max(mixed) + 5


def made_rows(count=160):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 7))) for _ in range(50)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 60])))) for i in range(count)]
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (None, "null id"), (1003, "Same ROW twice")]
    return rows + [(1003, "Same ROW twice"), (1004, "long words " * 8_000), (1005, "\u00e9t\u00e9 \u4e2d\u6587 x" * 3)]


def held(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 1


def base_scores(rows):
    """Per row: held out, tokens, known tokens, training tokens, and the sum of logarithms."""
    counts = Counter()
    for doc_id, text in rows:
        if not held(doc_id):
            counts.update([*(text or "").encode().lower().split(), b" "])
    n, v = sum(counts.values()), len(counts)
    out = []
    for doc_id, text in rows:
        tokens = [*(text or "").encode().lower().split(), b" "]
        score = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        out.append((doc_id, held(doc_id), len(tokens), sum(counts[t] > 0 for t in tokens), n, score))
    return out


def check_scores(spark, rows):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA).repartition(3)
    found = lm.score_texts(df, RANKS).collect()
    key = lambda r: (str(r[0]), r[2], r[3], round(r[5], 6))
    plain = sorted([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in found], key=key)
    expected = sorted(base_scores(rows), key=key)
    assert [p[:5] for p in plain] == [e[:5] for e in expected]
    assert [p[5] for p in plain] == pytest.approx([e[5] for e in expected], rel=1e-9)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)
    return found


def test_score_texts_by_brute_force(spark):
    found = check_scores(spark, made_rows())
    same = [r["score"] for r in found if r["doc_id"] == 1003]
    assert same[0] == pytest.approx(same[1])
    per_token = [sum(r[c] for r in found if r["held_out"]) / sum(r["n_tokens"] for r in found if r["held_out"]) for c in ("score", "base_score")]
    assert per_token[0] > -6


def test_score_texts_without_training_rows(spark):
    check_scores(spark, [(i, t) for i, t in made_rows(60) if held(i)])
    assert lm.score_texts(spark.createDataFrame([], SCHEMA), RANKS).collect() == []


def test_batches_get_exact_counts_of_all_pairs_and_triples(spark, monkeypatch):
    # Many batches and buckets, and texts that only held-out rows have.
    for name, value in (("NUMBERED", 800), ("BUCKET_BYTES", 900), ("GRAM_BYTES", 700)):
        monkeypatch.setattr(lm, name, value)
    rows, subwords = made_rows(60), lm.Subwords(RANKS)
    rows = [r for r in rows if r[0] != 1004]
    pairs, triples = Counter(), Counter()
    for doc_id, text in rows:
        if not held(doc_id):
            ids = [subwords.end, *subwords((text or "").encode().lower().split()).tolist()]
            pairs.update(a << 16 | b for a, b in zip(ids, ids[1:]))
            triples.update(a << 32 | b << 16 | c for a, b, c in zip(ids, ids[1:], ids[2:]))
    after_one, after_two = Counter(p >> 16 for p in pairs), Counter(t >> 16 for t in triples)
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA).repartition(3)
    plain = lm.texts(df, held_out=lm.held_out(lm.F.col("doc_id")))
    parts, opened, _, known, _ = lm.counted(plain, RANKS)
    discount = lm.DISCOUNT

    def told(batches):
        for batch in opened(batches):
            c = batch.counts
            left = np.round((1 - c.pair_left) * c.pair_count, 6)
            yield lm.record_batch("kind int, key long, n long, after double", np.full(len(c.pair), 2), c.pair, c.pair_count.astype(int), c.pair_count - left)
            whole = c.pair[c.triple >> 16] << 16 | c.triple & 0xFFFF
            yield lm.record_batch("kind int, key long, n long, after double", np.full(len(whole), 3), whole, c.triple_count.astype(int), np.zeros(len(whole)))

    found = parts.mapInArrow(told, "kind int, key long, n long, after double").collect()
    assert parts.where("kind = 0").count() > 5
    assert {r["key"] for r in found if r["kind"] == 2} >= set(pairs) and {r["key"] for r in found if r["kind"] == 3} >= set(triples)
    for r in found:
        assert r["n"] == (pairs if r["kind"] == 2 else triples)[r["key"]]
        if r["kind"] == 2 and r["n"]:
            assert r["after"] == pytest.approx(discount * after_two[r["key"]], abs=1e-4)
    types = known.value[1]
    assert {i: n for i, n in enumerate(types.tolist()) if n} == dict(after_one)
    known.close()
    check_scores(spark, rows)


def test_no_cap_on_pairs_and_triples(spark):
    # More than 2 ** 19 triples, all of them three times: none may be forgotten.
    rng = random.Random(8)
    made = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(4_000)) for _ in range(40)]
    df = spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(made * 3)], SCHEMA).repartition(4)
    found = lm.score_texts(df, RANKS, learn_not=lm.F.lit(False)).collect()
    subwords = lm.Subwords(RANKS)
    ids = 3 * sum(len(subwords(t.encode().split())) for t in made)
    assert ids / 3 > 1 << 19 and sum(r["score"] for r in found) / ids > -1.5


def test_small_tables_are_whole_or_refused(spark):
    with pytest.raises(ValueError, match="score_texts"):
        lm.gram_counts(ids_table(spark, made_rows(20)), lm.Subwords(RANKS).size, held=10)


def test_words_of_odd_texts():
    rng = random.Random(9)
    pieces = [b"A", b"b", b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r", b"\x1c", b"\x00", b"\x85", b"\xff", "\u00e9".encode(), "\u00c9\u00a0".encode(), b"  "]
    for _ in range(200):
        some = [b"".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 6))]
        found, words, lengths = lm._words(some)
        expected = [[*text.lower().split(), None] for text in some]
        assert [[None, *found][w] for w in words] == [w for text in expected for w in text]
        assert lengths.tolist() == list(map(len, expected)) and len(set(found)) == len(found)
    subwords = lm.Subwords(RANKS)
    odd = [b"hello", "\u4e2d\u6587".encode(), b"x" * 700, b"\xff\xfe", b"_", "\u00a0".encode()]
    ids, spans = subwords.spelled(odd)
    assert [part.tolist() for part in np.split(ids, np.cumsum(spans)[:-1])] == [subwords([word])[:-1].tolist() for word in odd]
