"""The classifiers' parts against plain reckoning: automata, windows, interactions, the sample."""

import random

import numpy as np
from quire.llm import quality, toxicity
from quire.llm.common import labelled


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_the_automata_accept_what_is_within_reach():
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    terms = {word(rng.randint(2, 13)): rng.choice([0.25, 0.5, 1.0]) for _ in range(30)}
    stems = {word(rng.randint(4, 6)): rng.choice([0.3, 0.9]) for _ in range(4)}
    lexicon = toxicity.Lexicon(terms, stems)
    limit = lambda w: 0 if len(w) < toxicity.FUZZY else 1 if len(w) < 2 * toxicity.FUZZY else 2
    tokens = [word(rng.randint(0, 16)) for _ in range(3000)]
    for w in list(terms) * 20:
        at = rng.randint(0, len(w))
        tokens.append(w[:at] + rng.choice(["", "a", "d"]) + w[at + rng.randint(0, 2) :])
    for token in tokens:
        near = [(weight * 0.5**d, d) for w, weight in terms.items() if (d := levenshtein(token, w)) <= limit(w)]
        stem = max((weight for s, weight in stems.items() if token.startswith(s)), default=0.0)
        best = max(near, default=None)
        wanted = (stem, 0) if stem and (best is None or stem >= best[0]) else best
        assert lexicon.match(token) == wanted, token


def plain_features(model, text):
    """Sums over hits, each with its window looked at anew."""
    lexicon = toxicity.Lexicon(model.terms, model.stems)
    chunks = text.split()
    strip = lambda w: w.strip(toxicity._strip).lower()
    hits = {i: h for i, c in enumerate(chunks) if (h := lexicon.match(strip(c)))}
    marks = lambda words: sum(c in '"«»“”„' for c in " ".join(words))
    exact = near = total = strongest = quoted = 0.0
    for i, (weight, edits) in hits.items():
        window = range(max(0, i - toxicity.REACH), min(len(chunks), i + toxicity.REACH + 1))
        company = sum(k in hits for k in window) - 1
        inside = (marks([chunks[i]]) > 0 or marks(chunks[window.start : i]) % 2 == 1) and marks(chunks[i : window.stop]) > 0
        told = any(strip(w) in toxicity.REPORTING for w in chunks[max(0, i - 3) : i])
        factor = 0.3 if inside and told else 0.5 if inside or told else 1.0
        score = weight * factor * (1 + 0.25 * min(company, 4))
        quoted, total, strongest = quoted + weight * (1 - factor), total + score, max(strongest, score)
        near, exact = (near + weight * factor, exact) if edits else (near, exact + weight * factor)
    return [np.log1p(exact), np.log1p(near), strongest, np.log1p(total), 10 * total / (len(chunks) + 10) if hits else 0.0, np.log1p(quoted), 1.0]


def test_windows_tell_quotation_from_abuse():
    rng = random.Random(4)
    model = toxicity.Model(dict.fromkeys(toxicity.SEED, 0.8), {"brax": 0.6}, toxicity.DEFAULT)
    words = ["idiot", "moron", "stupld", "braxton", "said", '"idiot"', '"', "you", "the", "word", "a", "calls", "«trash»", "x,", "Worthles"]
    for _ in range(300):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))
        assert np.allclose(model.features(text), plain_features(model, text)), text
    abuse, quote = model.score(["you idiot you moron", 'she said "idiot" and they wrote "moron"'])
    assert abuse > quote


def test_the_machine_equals_a_sum_over_pairs():
    rng = np.random.default_rng(3)
    texts = ["", "one", "Some words, and some words more.\n" * 3, "ONLY CAPS 123 " * 20, "é ü ß"]
    sample = quality.features(texts)
    machine = quality.train(*sample, np.asarray([0.0, 1.0, 1.0, 0.0, 1.0]), epochs=2)
    machine.pairs[:] = rng.normal(0, 0.3, machine.pairs.shape)
    machine.linear[:] = rng.normal(0, 0.3, machine.linear.shape)
    index, value, first = machine.vectors(*sample)
    got = machine.raw(index, value, first)
    for d, (a, b) in enumerate(zip(first, [*first[1:], len(index)], strict=True)):
        i, v = index[a:b], value[a:b]
        wanted = machine.bias + sum(machine.linear[p] * x for p, x in zip(i, v, strict=True))
        for p in range(len(i)):
            for q in range(p + 1, len(i)):
                wanted += machine.pairs[i[p]] @ machine.pairs[i[q]] * v[p] * v[q]
        assert np.isclose(got[d], wanted)


def test_a_labelled_id_gives_one_row(spark):
    docs = spark.createDataFrame([(1, f"text {i}", 0) for i in range(50)] + [(2, "two", 0), (2, "two", 0), (3, None, 0), (None, "x", 0)], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (4, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    got = labelled(spark, docs, labels, "toxic", 4, 9, 100).collect()
    assert sorted((r.doc_id, r.label) for r in got) == [(1, 1), (2, 0), (3, 1)] and [r.text for r in got if r.doc_id == 3] == [""]
    assert labelled(spark, docs, labels, "toxic", 4, 9, 2).count() <= 2
