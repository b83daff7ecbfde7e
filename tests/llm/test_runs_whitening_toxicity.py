"""Periodic runs, whitening and toxicity against brute force, planted cases and odd rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest

from fixweave.llm.periodic import GENERATOR, PRIME, NumberTransform, RunFinder, periodic_runs, with_planted_repeats
from fixweave.llm.queries import runs_digest
from fixweave.llm.toxicity import LabelModel, fit_label_model, fit_toxicity, score_toxicity
from fixweave.llm.whitening import solved, triangular_factors, whiten

DOCS = "doc_id long, text string, starts string, collapsed int, score double"


# ---- periodic runs ----------------------------------------------------------------
def runs_by_definition(words):
    found = []
    for q in range(1, len(words) // 4 + 1):
        at = 0
        while at + q < len(words):
            end = at
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            length = end + q - at
            part = words[at:at + length]
            if end > at and length >= max(6, 4 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                found.append((at, length, q))
            at = end + 1
    return sorted(found)


def repetitive(rng):
    words = [f"w{rng.randrange(rng.choice([1, 2, 3, 30]))}" for _ in range(rng.choice([1, 5, 6, 9, 40, 150]))]
    for _ in range(rng.randrange(4)):
        at = rng.randrange(len(words))
        width = 1 + rng.randrange(max(1, (len(words) - at) // 3))
        for i in range(at, min(len(words), at + rng.randrange(1, 7 * width + 2))):
            words[i] = words[at + (i - at) % width]
    return words


def test_runs_equal_their_definition():
    rng, finder = random.Random(5), RunFinder()
    for _ in range(1500):
        words = repetitive(rng)
        known = {}
        numbers = np.array([known.setdefault(w, len(known)) for w in words])
        assert finder.find(numbers) == runs_by_definition(words), words


def test_long_runs_of_large_periods():
    rng = np.random.default_rng(2)
    root = rng.integers(0, 9000, 5000)
    numbers = np.concatenate((rng.integers(9000, 9900, 77), np.tile(root, 5), [9999], np.full(30_000, 3), np.tile([1, 2], 900)))
    assert RunFinder().find(numbers) == [(77, 25_000, 5000), (25_078, 30_000, 1), (55_078, 1800, 2)]


def test_transform_multiplies_polynomials():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, PRIME, (2, 3, 8), dtype=np.uint64)
    pair = NumberTransform()
    cyclic = pair.backward(pair.forward(a) * pair.forward(b) % PRIME)
    for row in range(3):
        for k in range(8):
            assert cyclic[row, k] == sum(int(a[row, i]) * int(b[row, (k - i) % 8]) for i in range(8)) % PRIME
    assert pow(GENERATOR, (PRIME - 1) // 2, PRIME) == PRIME - 1


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_run_digests(spark):
    rng = random.Random(8)
    rows = [(i, " \t".join(repetitive(rng))) for i in range(300)]
    rows += [(None, "a a a a a a a"), (400, None), (401, ""), (402, " \n "), (403, "ab " * 50_000), (5, "x x x x x x")] + [(404, "one two")] * 2
    rows += [(i, " ".join(f"v{k}" for k in range(i % 90))) for i in range(1000, 1150)]
    df = spark.createDataFrame([(i, t, "clash", 1, 0.5) for i, t in rows], DOCS).repartition(3)
    found = sorted(map(tuple, runs_digest(periodic_runs(with_planted_repeats(df))).collect()), key=str)
    expected = []
    for doc_id, text in rows:
        words = planted(doc_id, (text or "").split())
        runs = [(0, len(words), 1)] if len(set(words)) == 1 and len(words) >= 6 else runs_by_definition(words)
        dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        milli = None if not runs else 1000 * best[1] // best[2]
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)]
        expected.append((doc_id, len(runs), *best, milli, *digests))
    assert found == sorted(expected, key=str)
    assert runs_digest(periodic_runs(with_planted_repeats(df.limit(0)))).collect() == []


# ---- whitening --------------------------------------------------------------------
def whitened_by_definition(rows, components=4):
    """Per row: deviation and coordinates, from the covariance of the distinct whole vectors."""
    whole = {i: tuple(math.floor(256 * c) for c in v) for i, v in rows.items()}
    fit = np.array(sorted(set(whole.values())), float)
    n, total = len(fit), [sum(int(c) for c in column) for column in fit.T]
    centred = fit - np.array([s / n for s in total])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    kept = [k for k in range(min(components, len(values))) if values[k] > 1e-10 * values[0]]
    return n, {
        i: (sum((n * c - s) ** 2 for c, s in zip(x, total)), [float((np.array(x) - np.array([s / n for s in total])) @ axes[:, k] / math.sqrt(values[k])) for k in kept])
        for i, x in whole.items()
    }, [values[k] / values.sum() for k in kept]


def check_whitened(found, rows):
    n, expected, shares = whitened_by_definition(rows)
    assert len(found) == len(rows) * len(shares)
    sign = {}
    for r in sorted(found, key=lambda r: -abs(r["whitened"])):
        deviation, coordinates = expected[r["vec_id"]]
        wanted = coordinates[r["component"] - 1]
        s = sign.setdefault(r["component"], 1 if wanted * r["whitened"] >= 0 else -1)
        assert r["n"] == n and r["deviation"] == deviation
        assert r["whitened"] == pytest.approx(s * wanted, abs=1e-9)
        assert r["explained"] == pytest.approx(shares[r["component"] - 1], rel=1e-9)
        assert r["identity_error"] < 1e-10


VECTORS = "vec_id long, embedding array<float>, n string, x int"


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(4)
    base = (rng.normal(size=(400, 12)) * np.linspace(0.05, 1.5, 12) + 3).astype(np.float32)
    rows = {i: [float(c) for c in v] for i, v in enumerate(base)}
    rows |= {1000 + i: rows[7] for i in range(300)}
    odd = [(2000, None), (2001, [None] + rows[0][1:]), (2002, [float("nan")] + rows[0][1:]), (2003, [float("inf")] + rows[0][1:]), (2004, rows[0][:3]), (2005, [])]
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in [*rows.items(), *odd]], VECTORS).repartition(5)
    check_whitened(whiten(df).collect(), rows)


def test_whitening_of_dependent_columns(spark):
    rng = np.random.default_rng(6)
    flat = rng.normal(size=(200, 2)).astype(np.float32)
    rows = {i: [float(a), float(b), float(a), 7.0, 0.0, 0.0] for i, (a, b) in enumerate(flat)}
    df = spark.createDataFrame([(i, v, None, None) for i, v in rows.items()], VECTORS)
    found = whiten(df).collect()
    assert {r["component"] for r in found} == {1, 2}
    check_whitened(found, rows)


def test_whitening_without_spread(spark):
    one = spark.createDataFrame([(i, [1.0, 2.0], None, None) for i in range(3)], VECTORS)
    for df in (one, one.limit(0), one.where("vec_id = 0"), spark.createDataFrame([(1, [], None, None)], VECTORS)):
        found = whiten(df)
        assert found.columns[:3] == ["vec_id", "component", "n"] and found.collect() == []


def test_whitening_of_huge_entries_and_null_ids(spark):
    rows = [(None, [1e30, 0.0], None, None), (2, [0.0, 1.0], None, None), (2, [0.0, 1.0], None, None), (3, [5.0, 2.0], None, None)]
    found = whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert {r["vec_id"] for r in found} == {None, 2, 3} and {r["n"] for r in found} == {3}
    assert all(r["deviation"] is None for r in found)


def test_triangular_factors_of_an_ill_conditioned_matrix():
    rng = np.random.default_rng(7)
    left, right = np.linalg.qr(rng.normal(size=(3000, 8)))[0], np.linalg.qr(rng.normal(size=(8, 8)))[0]
    matrix = left * np.logspace(0, -11, 8) @ right.T

    def gram(factors):
        rows = matrix
        for factor in factors:
            rows = solved(rows, factor)
        return rows.T @ rows

    factors = triangular_factors(gram, 3000, 8)
    whole = np.eye(8)
    for factor in factors:
        whole = factor @ whole
    assert np.allclose(np.linalg.svd(whole)[1], np.logspace(0, -11, 8), rtol=1e-4)
    assert len(factors) >= 3


# ---- toxicity ---------------------------------------------------------------------
def simulated_votes(count, rng):
    """Votes of seven voters, the last of which mostly repeats the one before."""
    toxic = rng.random(count) < 0.2
    right = [0.95, 0.9, 0.85, 0.8, 0.7, 0.75]
    votes = np.array([np.where(rng.random(count) < r, toxic, ~toxic) for r in right])
    votes = np.vstack((votes, np.where(rng.random(count) < 0.9, votes[5], rng.random(count) < 0.5)))
    votes = np.where(rng.random(votes.shape) < 0.1, 2, votes)
    return toxic, votes.T


def test_label_model_finds_accuracies_and_correlations(spark):
    toxic, votes = simulated_votes(20_000, np.random.default_rng(9))
    rows = [("".join(map(str, v)), int(t) if i % 5 == 0 else 2, 1) for i, (t, v) in enumerate(zip(toxic, votes.astype(int)))]
    df = spark.createDataFrame(rows, "pattern string, toxic int, n long").groupBy("pattern", "toxic").agg({"n": "sum"})
    model = fit_label_model(df.toDF("pattern", "toxic", "n"), 7, 0.2)
    assert model.accuracy[:6] == pytest.approx([0.95, 0.9, 0.85, 0.8, 0.7, 0.75], abs=0.03)
    assert {frozenset((j, p)) for j, p in enumerate(model.parent) if p >= 0} == {frozenset((5, 6))}
    assert model.prior == pytest.approx(0.2, abs=0.02)
    assert ((model.posterior(votes.astype(int)) > 0.5) == toxic).mean() > 0.95


def test_posterior_is_the_product_of_the_odds():
    rng = np.random.default_rng(10)
    model = LabelModel(3, 0.3)
    model.parent = [-1, 0, 1]
    model.odds = rng.dirichlet([1, 1, 1], (3, 2, 3))
    for votes in itertools.product(range(3), repeat=3):
        weight = [0.7, 0.3]
        for y in (0, 1):
            for j, p in enumerate(model.parent):
                weight[y] *= model.odds[j, y, votes[p] if p >= 0 else 0, votes[j]]
        assert model.posterior(np.array([votes]))[0] == pytest.approx(weight[1] / sum(weight))


def abusive_rows(count=1200, seed=11):
    """Clean words of two languages; toxic texts hold abuse, or many words with one beginning."""
    rng = random.Random(seed)
    clean = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(400)]
    rude = ["zorkel", "quaxik", "vumble"]
    out = []
    for i in range(count):
        words, toxic = [rng.choice(clean) for _ in range(rng.randint(20, 200))], int(i % 7 == 0)
        if toxic and i % 2:
            words[::9] = [rng.choice(rude) for _ in words[::9]]
        elif toxic:
            words[::4] = ["krazz" + w for w in words[::4]]
        elif i % 50 == 1:
            words[3] = "krazz" + words[3]
        out.append((i, " ".join(words), toxic))
    return out


def test_toxicity_of_held_out_texts(spark):
    from pyspark.sql import functions as F

    rows = abusive_rows()
    docs = [(i, t, "clash", 0, None) for i, t, _ in rows]
    docs += [(None, "zorkel quaxik", None, 0, None), (9000, None, None, 0, None), (9001, "", None, 0, None), (9002, "zorkel vumble " * 30_000, None, 0, None)]
    docs += [(9003, "same row", None, 0, None)] * 2
    df = spark.createDataFrame(docs, DOCS).repartition(4)
    labels = [(i, toxic, "clash") for i, _, toxic in rows if i % 3 != 1] + [(0, 1, "x"), (None, 1, "x"), (77, None, "x"), (12_345, 1, "x")]
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0
    model = fit_toxicity(df, marks, learn)
    found = score_toxicity(df, model).collect()
    assert len(found) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    held = [(r["predicted"], rows[r["doc_id"]][2]) for r in found if r["doc_id"] is not None and r["doc_id"] < 9000 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum(p == t for p, t in held) / len(held) > 0.98
    assert [r["predicted"] for r in found if r["doc_id"] == 9002] == [1]
    empty = {r["score"] for r in found if r["doc_id"] in (9000, 9001)}
    assert len(empty) == 1 and empty.pop() < 0.5
    speaking = [v for v in model.report() if v["voter"].startswith("any_")]
    assert speaking and all(v["accuracy"] > 0.7 for v in speaking)


def test_toxicity_without_labels_or_texts(spark):
    from pyspark.sql import functions as F

    clean = [(i, f"fine words {i} here and there", None, 0, None) for i in range(80)]
    rude = [(100 + i, f"you idiot and moron, stupid loser {i}", None, 0, None) for i in range(20)]
    df = spark.createDataFrame(clean + rude, DOCS)
    marks = spark.createDataFrame([], "doc_id long, toxic int")
    found = score_toxicity(df, fit_toxicity(df, marks, F.lit(True))).collect()
    assert min(r["score"] for r in found if r["doc_id"] >= 100) > max(r["score"] for r in found if r["doc_id"] < 100)
    nothing = df.limit(0)
    assert score_toxicity(nothing, fit_toxicity(nothing, marks, F.lit(True))).collect() == []
    assert all(0 < r["score"] < 0.5 for r in score_toxicity(df, fit_toxicity(nothing, marks, F.lit(True))).collect())
