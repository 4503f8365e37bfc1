"""One-to-one matching of blocks of a page, by geometry. Both kinds are greedy, so they are sequential within a page."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.pages import by_page

_BOX = ["x", "y", "width", "height"]
#: Pairs of a page that are held at once: beyond, the second side is looked at by bands of y.
PAIRS = 1 << 16


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of every box of a with every box of b; columns x, y, width, height."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = (v[:, :, None] if v is a else v[:, None, :] for v in (a, b))
    common = np.maximum(0, np.minimum(ax + aw, bx + bw) - np.maximum(ax, bx)) * np.maximum(0, np.minimum(ay + ah, by + bh) - np.maximum(ay, by))
    union = aw * ah + bw * bh - common
    return np.where(union > 0, common / np.where(union > 0, union, 1), 0.0)


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the pairs of a page that meet, by place in a, and their intersection over union."""
    if a.shape[1] * b.shape[1] <= PAIRS:
        scores = _scores(a, b)
        i, j = np.nonzero(scores > 0)
        return i, j, scores[i, j]
    order = np.argsort(b[1], kind="stable")
    top, reach = b[1][order], float(b[3].max(initial=0))
    rows, others, found = [], [], []
    for i in range(a.shape[1]):
        some = order[np.searchsorted(top, a[1, i] - reach, "left") : np.searchsorted(top, a[1, i] + a[3, i], "right")]
        scores = _scores(a[:, i : i + 1], b[:, some])[0]
        meet = np.flatnonzero(scores > 0)
        rows.append(np.full(len(meet), i))
        others.append(some[meet])
        found.append(scores[meet])
    return np.concatenate(rows), np.concatenate(others), np.concatenate(found)


def _matched(a: DataFrame, b: DataFrame, pick: Callable, schema: str) -> DataFrame:
    """Both sides of a page meet in one task, the first side first, in reading order."""
    side = lambda df, n: df.select("doc_id", F.lit(n).alias("side"), "ord", "reading_order", "block_type", *[F.col(c).cast("double").alias(c) for c in _BOX])

    def work(page: dict[str, np.ndarray]) -> list[tuple]:
        first = int((page["side"] == 0).sum())
        if not first or first == len(page["side"]):
            return []
        boxes = np.stack([page[c] for c in _BOX])
        ords, doc_id = page["ord"].tolist(), page["doc_id"][0]
        doc_id = None if doc_id != doc_id else int(doc_id)
        found = pick(*overlaps(boxes[:, :first], boxes[:, first:]), page["block_type"][:first], page["block_type"][first:])
        return [(doc_id, ords[i], ords[first + j], s) for i, j, s in found]

    return by_page(side(a, 0).unionAll(side(b, 1)), ["doc_id"], ["side", "reading_order", "ord"], work, schema)


def truth_to_hypothesis(truth: DataFrame, hyp: DataFrame, least: float = 0.05) -> DataFrame:
    """doc_id, ord, hyp_ord, iou: pairs of a page by descending overlap down to `least`, each block once; ties in reading order."""

    def pick(i, j, s, *_) -> list[tuple[int, int, float]]:
        used_a, used_b, out = set(), set(), []
        order = np.lexsort((j, i, -s))
        for p, q, score in zip(i[order].tolist(), j[order].tolist(), s[order].tolist(), strict=True):
            if score < least:
                break
            if p not in used_a and q not in used_b:
                used_a.add(p)
                used_b.add(q)
                out.append((p, q, score))
        return out

    return _matched(truth, hyp, pick, "doc_id long, ord long, hyp_ord long, iou double")


def primary_to_verifier(primary: DataFrame, verifier: DataFrame, least: float = 0.2, same_type: float = 0.05) -> DataFrame:
    """doc_id, ord, verifier_ord, score: each primary block in reading order takes the best verifier block still free, the first of equals."""

    def pick(i, j, s, mine, theirs) -> list[tuple[int, int, float]]:
        s = s + same_type * (mine[i] == theirs[j])
        used, out, done = set(), [], None
        # The best pair of each block comes first; a block that has its pair, or whose best free one is too weak, is done.
        order = np.lexsort((j, -s, i))
        for p, q, score in zip(i[order].tolist(), j[order].tolist(), s[order].tolist(), strict=True):
            if p != done and q not in used:
                done = p
                if score >= least:
                    used.add(q)
                    out.append((p, q, score))
        return out

    return _matched(primary, verifier, pick, "doc_id long, ord long, verifier_ord long, score double")


def verifier_only(verifier: DataFrame, matches: DataFrame) -> DataFrame:
    """Verifier blocks with text that no primary block took."""
    taken = matches.select("doc_id", F.col("verifier_ord").alias("ord"))
    return verifier.where(F.trim("literal") != "").join(taken, ["doc_id", "ord"], "left_anti")
