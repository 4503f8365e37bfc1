"""Quality classifier: a factorisation machine over hashed words and structure statistics.

A document is a sparse vector: the shares of its words in hash buckets, and one-hot quantile bins of structure statistics and
size. The machine adds low-rank interactions of all pairs to a linear score; the identity
    sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)
makes that linear in the number of non-zeros. It is fitted in one task, on a sample of at most ROWS labelled rows (the bound is
a parameter), one a document; scoring is one pass over all rows without a shuffle. Language, source and ids are never inputs.

Defined results: null and empty texts have no words and the statistics of an empty text, and get the score of that vector.
Without labels of both classes the score is the share of label 1 (0.5 without any). Repeated rows each get their row. Texts of
any length are read whole. An empty table yields no rows. Columns of any other name may be there.
"""

from __future__ import annotations

import dataclasses
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import bounded, fold, labelled, slices
from quire.llm.shingles import NOT_WORD, SPACE, mix, word_hashes

BUCKETS = 1 << 14
RANK = 8
BINS = 10
ROWS = 8000
FOLDS, LEFT_OUT = 3, 1
THRESHOLD = 0.5

_CLASSES = np.zeros((7, 256))
_CLASSES[0, 65:91] = 1
_CLASSES[1, 48:58] = 1
_CLASSES[2, SPACE] = 1
_CLASSES[3, 10] = 1
_CLASSES[4, NOT_WORD & ~SPACE] = 1
_CLASSES[5, [ord(c) for c in ".,;:?"]] = 1
_CLASSES[6, 128:] = 1
STATISTICS = 16


def features(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each text the buckets of its distinct words, their shares, and a row of statistics."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    hashes, first = word_hashes(raw, NOT_WORD)
    buckets, shares, rows = [], [], np.zeros((len(raw), STATISTICS))
    for i, (data, a, b) in enumerate(zip(raw, first[:-1].tolist(), first[1:].tolist(), strict=True)):
        own = hashes[a:b]
        words, counts = np.unique(own, return_counts=True)
        places, inverse = np.unique((words % np.uint64(BUCKETS)).astype(np.int64), return_inverse=True)
        n = max(len(own), 1)
        buckets.append(places)
        shares.append(np.bincount(inverse, counts, minlength=len(places)) / n if len(places) else np.zeros(0))
        size = max(len(data), 1)
        per = _CLASSES @ np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
        lines = data.split(b"\n")
        pairs = mix(own[:-1]) ^ own[1:]
        rows[i] = [
            np.log1p(len(data)),
            np.log1p(len(own)),
            *(per[:7] / size),
            (per[4] - per[5]) / n,
            (size - per[2] - per[4]) / n,
            len(words) / n,
            counts.max(initial=0) / n,
            1 - len(set(lines)) / len(lines),
            1 - len(np.unique(pairs)) / max(len(pairs), 1) if len(pairs) else 0.0,
            np.log1p(size / len(lines)),
        ]
    return buckets, shares, rows


@dataclasses.dataclass
class Machine:
    """edges: quantiles of each statistic; linear and pairs: weights of the word buckets, then of the bins; prior: for want of labels."""

    edges: np.ndarray
    bias: float
    linear: np.ndarray
    pairs: np.ndarray

    def vectors(self, buckets: list[np.ndarray], shares: list[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indices and values of all non-zeros, and where each document's begin."""
        return _vectors(self.edges, buckets, shares, rows)

    def raw(self, index: np.ndarray, value: np.ndarray, first: np.ndarray) -> np.ndarray:
        each = self.pairs[index] * value[:, None]
        sums = np.add.reduceat(each, first, axis=0)
        squares = np.add.reduceat((each**2).sum(axis=1), first)
        return self.bias + np.add.reduceat(self.linear[index] * value, first) + 0.5 * ((sums**2).sum(axis=1) - squares)

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*self.vectors(*features(texts))), -30, 30)))


def _vectors(edges, buckets, shares, rows):
    bins = np.stack([np.searchsorted(edges[j], rows[:, j], side="right") + BUCKETS + j * BINS for j in range(STATISTICS)], axis=1)
    index = np.concatenate([np.concatenate([b, s]) for b, s in zip(buckets, bins, strict=True)])
    # Words weigh as much as a few statistics, whatever the length of the text.
    value = np.concatenate([np.concatenate([2.0 * np.sqrt(v), np.full(STATISTICS, 0.5)]) for v in shares])
    first = np.concatenate([[0], np.cumsum([len(b) + STATISTICS for b in buckets])[:-1]]).astype(np.int64)
    return index.astype(np.int64), value, first


def train(buckets: list[np.ndarray], shares: list[np.ndarray], rows: np.ndarray, labels: np.ndarray, epochs: int = 12, seed: int = 7) -> Machine:
    """Fits by AdaGrad on the logistic loss, in batches."""
    size = BUCKETS + STATISTICS * BINS
    rate = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))
    rng = np.random.default_rng(seed)
    edges = np.quantile(rows, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if len(rows) else np.zeros((STATISTICS, BINS - 1))
    own = Machine(edges, float(np.log(rate / (1 - rate))), np.zeros(size), rng.normal(0, 0.05, (size, RANK)))
    if len(set(labels.tolist())) < 2:
        own.pairs[:] = 0
        return own
    index, value, first = _vectors(edges, buckets, shares, rows)
    ends = np.append(first[1:], len(index))
    seen_linear, seen_pairs = np.full(size, 1e-3), np.full((size, RANK), 1e-3)
    for _ in range(epochs):
        for some in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // 64)):
            at = np.concatenate([np.arange(first[d], ends[d]) for d in some])
            i, v = index[at], value[at]
            lengths = ends[some] - first[some]
            begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            each = own.pairs[i] * v[:, None]
            sums = np.add.reduceat(each, begins, axis=0)
            raw = own.bias + np.add.reduceat(own.linear[i] * v, begins) + 0.5 * ((sums**2).sum(axis=1) - np.add.reduceat((each**2).sum(axis=1), begins))
            error = np.repeat((1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[some]) / len(some), lengths)
            places, inverse = np.unique(i, return_inverse=True)
            step = np.bincount(inverse, error * v) + 1e-5 * own.linear[places]
            part = (error * v)[:, None] * (np.repeat(sums, lengths, axis=0) - each)
            deep = np.stack([np.bincount(inverse, part[:, f]) for f in range(RANK)], axis=1) + 1e-5 * own.pairs[places]
            seen_linear[places] += step**2
            seen_pairs[places] += deep**2
            own.linear[places] -= 0.15 * step / np.sqrt(seen_linear[places])
            own.pairs[places] -= 0.05 * deep / np.sqrt(seen_pairs[places])
            own.bias -= 0.05 * float(error[begins].sum())
    return own


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, left_out: int = LEFT_OUT, rows: int = ROWS) -> Machine:
    """A machine for the labels outside the fold left out, fitted in one task on at most `rows` documents; the driver gets its weights alone."""
    kinds = {"label": pa.int32(), "buckets": pa.list_(pa.int32()), "shares": pa.list_(pa.float32()), "stats": pa.list_(pa.float64())}

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            buckets, shares, stats = features(batch.column("text").to_pylist())
            found = [[b.astype(np.int32) for b in buckets], [s.astype(np.float32) for s in shares], list(stats)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *(pa.array(x, t) for x, t in zip(found, list(kinds.values())[1:], strict=True))], ["doc_id", *kinds])

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = fitted(pa.Table.from_batches(batches, pa.schema(kinds)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((own.edges, own.bias, own.linear, own.pairs))], pa.binary())], ["machine"])

    def fitted(got: pa.Table) -> Machine:
        # Views of the Arrow buffers, not Python numbers.
        label, ints, reals, stats = (got.column(c).combine_chunks() if got.num_rows else pa.array([], t) for c, t in kinds.items())
        ends = np.cumsum(ints.value_lengths().to_numpy(zero_copy_only=False))[:-1] if len(ints) else []
        parts = lambda x: np.split(x.flatten().to_numpy(zero_copy_only=False), ends) if len(x) else []
        return train(parts(ints), parts(reals), stats.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS), label.to_numpy(zero_copy_only=False).astype(np.float64))

    sample = labelled(spark, docs, labels, label, folds, left_out, rows).select("doc_id", "label", "text")
    told = sample.mapInArrow(described, "doc_id long, label int, buckets array<int>, shares array<float>, stats array<double>")
    # `rows` bounds what meets in the one task.
    got = told.repartition(1).sortWithinPartitions("doc_id").select(*kinds).mapInArrow(trained, "machine binary").toArrow()
    return Machine(*pickle.loads(got.column("machine")[0].as_py())) if got.num_rows else fitted(pa.table({c: pa.array([], t) for c, t in kinds.items()}))


def score(docs: DataFrame, machine: Machine, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (doc_id unless told otherwise) and score, of every row."""
    keep = keep or ["doc_id"]
    frame = bounded(docs).select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            found = machine.score(batch.column("__text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64())], [*keep, "score"])

    return frame.mapInArrow(run, f"{schema}, score double")


def accepted(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier accepts, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = machine.score([t or "" for t in batch.column("text").to_pylist()]) >= threshold
            if keep.any():
                yield batch.filter(pa.array(keep))

    return bounded(docs).mapInArrow(run, docs.schema)


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, learned outside the held-out fold."""
    scored = score(docs, fit(spark, docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == LEFT_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
