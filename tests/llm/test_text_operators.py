"""Text operators against brute-force versions, on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixweave.llm import chat, language, licenses, pii, wordpiece
from fixweave.llm.decontaminate import benchmark_hits
from fixweave.llm.exact_dedup import CountingQuotientFilter, exact_duplicates
from fixweave.llm.language import identify
from fixweave.llm.mixing import mix_plan, training_order
from fixweave.llm.ngram_join import ngram_components
from fixweave.llm.queries import RANKS, VOCABULARY, hits_digest
from fixweave.llm.scale import components, without

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, size string"


def vocabulary(count=40, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(count)]


def sample_rows():
    """Copies, near copies, nulls, empty and long texts, repeated rows and ids of null."""
    rng, words = random.Random(7), vocabulary()
    out = []
    for number in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 12, 60, 120]))]
        out.append((number * 3, " ".join(base), "en", f"s{number % 4}"))
        if number % 3 == 0:
            changed = list(base)
            changed[rng.randrange(len(changed))] = "other"
            out.append((number * 3 + 1, "\n".join(changed).upper(), "de", None))
    out += [(900, None, None, None), (901, "", "en", "s1"), (902, " \t\n", "fr", "s1"), (None, "null id here", "en", "s0")]
    out += [(903, "same row twice", "en", "s0")] * 2
    out.append((904, "long " * 30_000, "en", "s2"))
    return [(*row, len(row[1] or ""), "clash", "clash") for row in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sample_rows(), SCHEMA).repartition(3).cache()


def words_of(text):
    return (text or "").encode().lower().split()


def test_components_are_exact(docs):
    sets = {}
    for doc_id, text, *_ in sample_rows():
        words = words_of(text)
        width = min(5, len(words))
        sets[doc_id] = {tuple(words[i:i + width]) for i in range(len(words) - width + 1)} if words else set()
    parent = {i: i for i in sets if i is not None}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(parent), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    found = ngram_components(docs).collect()
    assert len(found) == len(sample_rows())
    for row in found:
        assert row["n_shingles"] == len(sets[row["doc_id"]])
        assert row["component_id"] == (None if row["doc_id"] is None else find(row["doc_id"]))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 51), (7, 7)], "a long, b long")
    assert {(r["node"], r["root"]) for r in components(edges).collect()} == {(i, 1) for i in range(2, 41)} | {(51, 50)}


def test_without_keeps_null_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id long, v string")
    kept = without(df, "id", spark.createDataFrame([(2,)], "x long"))
    assert sorted(r["v"] for r in kept.collect()) == ["a", "c"]


def test_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    parts = [rng.choice(pool, 300) for _ in range(4)]
    merged = CountingQuotientFilter.merged([CountingQuotientFilter.of(p, np.ones(300, np.uint64)) for p in parts])
    counted = Counter(np.concatenate(parts).tolist())
    assert dict(zip(merged.fingerprints().tolist(), merged.counts.tolist())) == counted
    assert set(merged.repeated().tolist()) == {k for k, v in counted.items() if v > 1}


def test_exact_duplicates(docs):
    groups = {}
    for doc_id, text, *_ in sample_rows():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id))
    found = exact_duplicates(docs).collect()
    assert len(found) == len(sample_rows())
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for row in found:
        group = by_sha[row["text_sha256"]]
        assert (row["group_size"], row["keep_id"]) == (len(group), min(group)[2])
    assert Counter(r["text_sha256"] for r in found if r["kept"]) == Counter(dict.fromkeys(by_sha, 1))


def test_benchmark_hits(spark, docs):
    texts = [r[1] for r in sample_rows() if r[1] and len(r[1].split()) > 40]
    items = [(1, " ".join(texts[0].split()[5:25])), (2, texts[1]), (10, "same row"), (11, "same row"), (3, None), (4, ""), (None, "null id")]
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

    def split(text):
        return re.findall(pattern, (text or "").lower())

    found = {}
    for row in hits_digest(benchmark_hits(docs, spark.createDataFrame(items, "item_id long, text string"))).collect():
        found.setdefault(row["doc_id"], row)
    for doc_id, text, *_ in sample_rows():
        if doc_id == 904:
            continue
        words, hit, ids = split(text), set(), set()
        for item_id, item in items:
            item = split(item)
            size = min(10, len(item))
            for at in range(len(item) - size + 1 if size else 0):
                for start in range(len(words) - size + 1):
                    if words[start:start + size] == item[at:at + size]:
                        hit |= set(range(start, start + size))
                        ids |= {str(item_id)} - {"None"}
        row = found[doc_id]
        sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        assert (row["n_words"], row["n_hit"], row["n_items"], row["items_sha256"]) == (len(words), len(hit), len(ids), sha)


def test_mixing_reaches_its_targets(docs):
    rows = training_order(mix_plan(docs)).collect()
    assert len(rows) == len(sample_rows())
    total, by_source = sum(r["size"] for r in rows), {}
    for row in rows:
        assert 0 <= row["taken"] <= 2 * row["size"]
        by_source.setdefault(row["source"], []).append(row)
    for source_rows in by_source.values():
        target = source_rows[0]["target"]
        assert target <= 2 * source_rows[0]["source_size"]
        assert sum(r["taken"] for r in source_rows) == math.floor(target)
    assert abs(sum(v[0]["target"] for v in by_source.values()) - 1.5 * total) < 1e-6 * total
    places = [r["first_position"] for r in rows if r["taken"]]
    assert places == sorted(places)


def test_mixing_of_sources_without_words(spark):
    schema = "doc_id long, text string, source string"
    empty = [(1, None, "a"), (2, " \n", "a"), (3, "", None)]
    found = {r["doc_id"]: r for r in training_order(mix_plan(spark.createDataFrame([*empty, (4, "x y z", "b")], schema))).collect()}
    assert {i: (r["size"], r["taken"], r["target"]) for i, r in found.items()} == {1: (0, 0, 0.0), 2: (0, 0, 0.0), 3: (0, 0, 0.0), 4: (3, 4, 4.5)}
    found = training_order(mix_plan(spark.createDataFrame(empty, schema))).collect()
    assert [(r["taken"], r["passes"]) for r in found] == [(0, [])] * 3


def test_language_accuracy_and_undetermined(spark):
    rng = random.Random(3)
    kinds = {"xx": vocabulary(60, 11), "yy": [w[::-1] + "z" for w in vocabulary(60, 12)]}
    rows = [(i, " ".join(rng.choice(kinds[lang]) for _ in range(20)), lang) for i in range(120) for lang in [rng.choice(["xx", "yy"])]]
    odd = [(1000, None, "xx"), (1001, "12 34 !", "yy"), (1002, "abz", None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in identify(df, F.col("doc_id") % 5 != 0).collect()}
    assert all(found[i]["lang_pred"] == lang for i, _, lang in rows if i % 5 == 0)
    assert found[1000]["lang_pred"] == found[1001]["lang_pred"] == "und"
    assert found[1002]["lang_pred"] in kinds and 0 <= found[1002]["score"] <= 1
    assert identify(df.where("false"), F.lit(True)).count() == 0


def test_every_label_is_learnt(spark):
    """230 labels, of which one holds most rows, with a word of its own each."""
    own = ["q" + "".join(chr(97 + int(d)) for d in f"{i:03d}") for i in range(230)]
    rows = [(i, f"common {own[i % 230]} {own[i % 230]} {own[i % 230]}", f"l{i % 230:03d}") for i in range(690)]
    rows += [(10_000 + i, "plain words here", "big") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["lang_pred"] for r in identify(df, F.col("doc_id") % 3 != 0).collect()}
    assert all(found[i] == lang for i, _, lang in rows)


def test_sparse_votes_equal_dense_ones():
    rng = random.Random(12)
    features = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    words = {(rng.choice("xyz"), rng.choice(features)): rng.randint(1, 9) for _ in range(50)}
    some = {(rng.choice("xyz"), g): rng.randint(1, 9) for w in features[:30] for g in language.grams(w, rng.randint(1, 3))}
    priors = {"x": 5, "y": 3, "z": 2}
    model = language.LanguageModel(priors, [(*k, n) for k, n in words.items()], [(*k, n) for k, n in some.items()])

    def dense(table, feature):
        names = {f for _, f in table}
        total = {a: sum(n for (b, _), n in table.items() if b == a) + 0.5 * (len(names) + 1) for a in "xyz"}
        return np.array([math.log((table.get((a, feature), 0) + 0.5) / total[a]) for a in "xyz"])

    def vote(word):
        if any(w == word for _, w in words):
            return dense(words, word)
        for size in range(min(5, len(word) + 2), 0, -1):
            held = [g for g in language.grams(word, size) if any(f == g for _, f in some)]
            if held:
                return np.mean([dense(some, g) for g in held], 0)
        return dense(some, None)

    for _ in range(60):
        text = [rng.choice(features + ["zzz", "cabbage"]) for _ in range(rng.randint(1, 30))]
        total = sum(vote(w) for w in text)
        logs = np.log(np.array([0.5, 0.3, 0.2]))
        found, score = model.predict(" ".join(text), {})
        assert found == "xyz"[int(np.argmax(logs + total))]
        scaled = logs + total * min(20, len(text)) / len(text)
        assert score == pytest.approx(1 / np.exp(scaled - scaled["xyz".index(found)]).sum())


EMAILS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"


def test_base_spans_follow_the_patterns():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice("a1@.-+ 9 4(") for _ in range(rng.randint(0, 40)))
        expected = [(0, *m.span()) for m in re.finditer(EMAILS, text)]
        expected += [
            (1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m.group().split("."))
        ]
        assert [s for s in pii.base_spans(text) if s[0] < 2] == expected
    assert pii.base_spans("card 4111 1111-1111 1111, call +1 (555) 123-4567") == [(2, 5, 24), (3, 31, 48)]
    assert pii.base_spans("1" * 200_000 + "a" * 200_000) == []


def test_tagger_learns_and_reconciles():
    rng, texts = random.Random(2), []
    for _ in range(150):
        before = " ".join(vocabulary(4, rng.random()))
        texts.append(f"{before} user{rng.randint(1, 99)}@mail.example.org and more text here")
    spans = [pii.base_spans(t) for t in texts]
    windows = [(pii._padded(t, 0), pii.tags(s, 0)) for t, s in zip(texts, spans)]
    windows = [w for w in windows if w[1] is not None]
    tagger = pii.Tagger().fit(np.stack([a for a, _ in windows]), np.stack([b for _, b in windows]), epochs=30)
    best, _ = tagger.decode(np.stack([a for a, _ in windows[:40]]))
    assert (best == np.stack([b for _, b in windows[:40]])).mean() > 0.97
    assert pii.reconciled([(0, 0, 5, 0.9), (1, 4, 20, 0.9), (2, 20, 25, 0.5)]) == [(1, 4, 20, 0.9), (2, 20, 25, 0.5)]


def test_longest_match_counts():
    rng = random.Random(4)
    initial = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(12)}
    continuing = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(8)}
    automaton = wordpiece.LongestMatch(initial, continuing)

    def greedy(word):
        at = count = 0
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if word[at:e] in (continuing if at else initial)), None)
            if end is None:
                return 0
            at, count = end, count + 1
        return count

    for _ in range(2000):
        word = "".join(rng.choice("abc" if rng.random() < 0.1 else "ab") for _ in range(rng.randint(1, 12)))
        assert automaton.split(word) == greedy(word), word


def test_every_word_has_its_pieces(spark):
    words = ["the", "été", "d\u2019été", "\u4f60\u597d\u4e16\u754c", "\u3053\u3093\u306b\u3061\u306f", "\u043f\u0440\u0438\u0432\u0435\u0442", "\U0001f984x", "\u0153uvre"]
    initial, continuing = pieces = wordpiece.vocabulary(VOCABULARY)

    def greedy(word):
        at, count, text = 0, 0, b" " + word.encode()
        while at < len(text):
            at = next(e for e in range(len(text), at, -1) if text[at:e] in (continuing if at else initial))
            count += 1
        return count

    df = spark.createDataFrame([(1, " ".join(words)), (2, None), *[(3 + i, w) for i, w in enumerate(words)]], "doc_id long, text string")
    found = {r["doc_id"]: (r["n_words"], r["n_tokens"], r["n_unknown"]) for r in wordpiece.token_counts(df, pieces).collect()}
    assert found == {1: (len(words), sum(map(greedy, words)), 0), 2: (0, 0, 0)} | {3 + i: (1, greedy(w), 0) for i, w in enumerate(words)}
    assert all(bytes([b]) in initial | continuing for b in range(256))


def test_license_phrases_and_templates(spark):
    rows = [
        (1, "x Released under the MIT License. y under the mit license"), (2, None), (3, "licensed under the GNU General Public License, version 3"),
        (4, "under the license of the software"), (5, "the terms of CC BY-NC apply"),
    ]
    found = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (found[1]["n_base"], found[1]["first_word"], found[1]["last_word"], found[1]["base_labels"]) == (2, 2, 7, "mit")
    assert (found[2]["n_words"], found[2]["labels"], found[2]["score"]) == (0, "", 0.0)
    assert (found[3]["n_base"], found[3]["labels"]) == (0, "gpl-3")
    assert (found[4]["labels"], found[5]["base_labels"]) == ("", "cc-by-nc")


def test_licenses_that_differ_little():
    scanner = licenses.LicenseScanner()

    def labels(text):
        return {label for label, *_ in scanner.scan(licenses.letters_and_digits(text.encode()))[1]}

    notice = (
        "x This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the "
        "Free Software Foundation, either version {} of the License, or (at your option) any later version. y"
    )
    names = {"gpl": "General Public License", "lgpl": "Lesser General Public License", "agpl": "Affero General Public License"}
    for kind, version in [("gpl", "2"), ("gpl", "3"), ("lgpl", "2.1"), ("lgpl", "3"), ("agpl", "3")]:
        assert labels(notice.format(names[kind], version)) == {f"{kind}-{version}"}
        assert labels(f"licensed under the GNU {names[kind]}, version {version}") == {f"{kind}-{version}"}
    assert labels(notice.format(names["gpl"], "2") + " z" * 20 + notice.format(names["agpl"], "3")) == {"gpl-2", "agpl-3"}
    assert labels("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.") == {"mit"}
    assert labels("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.") == {"isc"}
    assert labels("2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.") == {"bsd"}


def test_matching_statistics():
    rng = random.Random(6)
    sequences = [[rng.randint(0, 3) for _ in range(12)] for _ in range(3)]
    automaton = licenses.SuffixAutomaton(sequences)
    runs = {tuple(s[a:b]) for s in sequences for a in range(12) for b in range(a + 1, 13)}
    text = [rng.randint(0, 4) for _ in range(200)]
    for end, (_, length) in enumerate(automaton.statistics(text), 1):
        assert length == max(n for n in range(0, min(13, end + 1)) if not n or tuple(text[end - n:end]) in runs)


@pytest.mark.parametrize("text", ["", "\\", "### </turn>", "#### \\</turn>\n### a:\n", "\\### Assistant: </turn> ok", "é" * 5])
def test_escape_is_reversible(text):
    for escaped in (chat.escape(text), chat.escape_role(text)):
        assert chat.unescape(escaped) == text
        assert "</turn>" not in escaped and "### " not in escaped


def test_conversations_round_trip(spark):
    rows = [
        (1, 1, "assistant", "a\\b </turn>"), (1, 0, "user", "### hi"), (None, None, None, None), (2, 0, "odd:\nrole", ""),
        (3, 0, "assistant", "x" * 200_000), (3, 1, "assistant", "y"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))
    found = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    assert found[1]["turns_sha256"] == sha("user\n### hi\nassistant\na\\b </turn>\n") and found[1]["loss_sha256"] == sha("a\\b </turn>")
    assert (found[None]["n_turns"], found[None]["loss_chars"]) == (1, 0)
    assert found[2]["turns_sha256"] == sha("odd:\nrole\n\n")
    assert found[3]["loss_chars"] == 200_001


def test_templates_fold_and_refuse():
    assert chat.fold(chat.parse("{% if 'a' == 'a' %}x{{ 'y' | upper }}{% else %}{{ z }}{% endif %}")) == ("const", "xY")
    render = chat.compile_template("{% for m in ms %}{% if m.a and not m.b %}{% generation %}{{ m.a + '!' }}{% endgeneration %}{% endif %}{% endfor %}")
    assert chat.joined(render({"ms": [{"a": "q", "b": ""}, {"a": "", "b": ""}]})) == ("q!", "q!")
    for bad in ("{{ x.__class__.y }}", "{{ f(1) }}", "{% for a in b %}", "{{ 'a' | eval }}", "{% endif %}"):
        with pytest.raises(chat.TemplateError):
            chat.parse(bad)
    with pytest.raises(chat.TemplateError):
        list(chat.compile_template("{{ x.__class__ }}")({"x": "text"}))


@pytest.mark.parametrize("source", [
    "{% endgeneration %}", "a{% endif %}", "{% endfor %}", "{% if 'a' %}1{% else %}2{% else %}3{% endif %}", "{{ 'a' == 'b' }}", "{{ not 'a' }}",
    "{{ 'a' == 'b' or 'c' }}", "{% generation %}x", "{% if 'a' %}{% endgeneration %}{% endif %}",
])
def test_templates_that_cannot_be_read(source):
    with pytest.raises(chat.TemplateError):
        chat.parse(source)
