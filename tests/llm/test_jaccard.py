"""The Jaccard join against all pairs by brute force."""

import random
import re

import pytest

from quire.llm import jaccard


def brute(rows):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if sets[i] and d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'c' as class", "1 as n", "2 as root")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df).collect()), key=str)
    assert got == brute(rows)


def made(seed, docs, words, vocabulary=40):
    """Texts of random sizes, edited copies of each other, with shared passages."""
    rng = random.Random(seed)
    passage = " ".join(rng.choice("abcdefghij") * 2 for _ in range(40))
    texts = []
    for _ in range(docs):
        if texts and rng.random() < 0.7:
            w = rng.choice(texts).split()
            for _ in range(rng.randint(0, 3)):
                if w:
                    w[rng.randrange(len(w))] = f"e{rng.randint(0, 5)}"
            if rng.random() < 0.3:
                w += [f"t{rng.randint(0, 9)}" for _ in range(rng.randint(1, 4))]
        else:
            w = [f"w{rng.randint(0, vocabulary)}" for _ in range(rng.randint(1, words))]
        if rng.random() < 0.15:
            w += passage.split()
        texts.append(" ".join(w))
    return [(1000 - i, t) for i, t in enumerate(texts)]


def test_nulls_empties_repeats_ties(spark):
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "One"), (8, "one"), (9, "a b c d"), (10, "A  b\tc\nd"), (11, "a b c d e"), (12, "a b c d e f"), (None, "q r s t u v"), (13, "q r s t u v"), (None, "only null ids here ok"), (8, "one")]
    check(spark, rows)
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed):
    check(spark, made(seed, 150, 40 if seed else 12, 40 if seed else 3))


def test_frequent_elements_and_blocks(spark, monkeypatch):
    """With every element frequent and tiny blocks the heavy path does all the work."""
    monkeypatch.setattr(jaccard, "SAMPLE", 1)
    monkeypatch.setattr(jaccard, "OFTEN", 2)
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    check(spark, made(7, 120, 30))


def test_light_sets(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "boundary", lambda elements: 30)
    check(spark, made(11, 150, 45, 6))


def test_long_text_and_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(spark, rows + [(5000, "x " * 30000 + "y"), (5001, "x " * 30000 + "y z")])


def test_pairs_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SAMPLE", 1)
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    rows = made(13, 120, 40) + [(1, None), (2, "")]
    sets = {}
    for d, text in rows:
        words = (text or "").split()
        sets[d] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
    wanted = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    members, found = jaccard.pairs(spark.createDataFrame(rows, "doc_id long, text string"))
    of = {}
    for r in members.collect():
        of.setdefault(r["class"], []).append(r.doc_id)
    linked = {(min(x, y), max(x, y)) for r in found.collect() for x in of[r.a] for y in of[r.b]}
    linked |= {(x, y) for ids in of.values() for x in ids for y in ids if x < y}
    assert linked == wanted and len(found.collect()) == len({(r.a, r.b) for r in found.collect()})
