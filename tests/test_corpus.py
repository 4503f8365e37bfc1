"""Near-duplicate families against all pairs."""

import random

from pyspark.sql import functions as F
from quire.operators import corpus as C


def texts() -> dict[int, str | None]:
    rng = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    out, ids = {}, iter(rng.sample(range(10000), 400))
    for _ in range(12):
        base = [rng.choice(words) for _ in range(200)]
        out[next(ids)] = " ".join(base)
        out[next(ids)] = "  ".join(base).upper()
        # A chain: each is near its neighbours, the last is not near the first.
        for k in range(6):
            base = [*base[:-8], *(rng.choice(words) for _ in range(8))] if k % 2 else [*(rng.choice(words) for _ in range(8)), *base[8:]]
            out[next(ids)] = " ".join(base)
            # Alike, but not at 0.8: a word in twenty is another.
            out[next(ids)] = " ".join(rng.choice(words) if i % 20 == k else w for i, w in enumerate(base))
    return out | {next(ids): "a b", next(ids): "A  b", next(ids): "a b c", next(ids): None, next(ids): None}


def families(rows: dict[int, str | None]) -> dict[int, int]:
    sets = {}
    for i, t in rows.items():
        w = None if t is None else t.lower().split()
        sets[i] = w and ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)})
    root = {i: i for i in rows}

    def top(i):
        return i if root[i] == i else top(root[i])

    for i in rows:
        for j in rows:
            if i < j and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return {i: top(i) for i in rows}


def test_families_are_components_of_verified_pairs(spark):
    rows = texts()
    want = families(rows)
    sizes = [list(want.values()).count(f) for f in want.values()]
    assert max(sizes) > 5 and min(sizes) == 1
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert {r.doc_id: r.family for r in C.near_families(docs).collect()} == want
    got = C.near_duplicate_families(docs).collect()
    assert {r.doc_id: r.family for r in got} == {i: f for i, f in want.items() if list(want.values()).count(f) > 1}
    assert all(1 <= r.shared_bands <= 8 for r in got)


def test_split_keeps_near_copies_together(spark, tmp_path):
    from quire.plans import QUERIES

    rows = texts()
    spark.createDataFrame(list(rows.items()), "doc_id long, text string").withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["family_split"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.family for r in got} == families(rows)
    splits = {}
    for r in got:
        assert splits.setdefault(r.family, r.split) == r.split
