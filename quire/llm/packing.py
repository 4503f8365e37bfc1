"""Packing token sequences into windows by non-negative least squares.

Every document is encoded, closed with an end id and cut into pieces of at most a window; whole windows are sequences of their
own. For the pieces left the shallow length combinations that fill a window exactly (one to three length classes) are
enumerated, and non-negative least squares finds how often to repeat each so that the histogram of lengths is met. The repeat
counts are rounded down, then up as long as pieces last; the few pieces that remain are packed greedily, and cut where that
closes a window. What then stays in an open window is cut into sequences of powers of two, which take no padding.

Packing runs over blocks of a bounded number of tokens within a task, as rows stream by. Each block solves its own histogram:
no shuffle, no state on the driver, memory bounded by a block and one document, and a task that is run again yields the same
rows. Padding so does not depend on the number of tasks or blocks.

Defined results: null or empty text: the end id alone. Repeated rows and null ids are packed like any others. Texts of any
length are cut whole. An empty table yields no rows. Columns of any other name may be there.
"""

from __future__ import annotations

import array
import functools
import os
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bpe import byte_chars, unknown
from quire.llm.common import bounded, slices

WINDOW = 2048
#: Width of a length class. A window of three pieces wastes less than three times this.
WIDTH = 16
#: Tokens in a block, about; 4 bytes each are held.
BLOCK = 4 << 20
#: The split of byte-level vocabularies, a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Texts longer than this are left to the tokenizers library, whose pattern matcher has no limit on backtracking.
LONG = 200_000


class Encoder:
    """Ids of texts as little-endian 32-bit integers, as the tokenizers library gives them for a byte-level vocabulary.

    The ranks of the file drive tiktoken's merge loop, which gives the same ids in a quarter of the time. Texts with special
    tokens written out, with characters that Unicode's tables here do not know, and very long texts go to the library itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.no_truncation()
        self.own.no_padding()
        self.special = [t.content for t in self.own.get_added_tokens_decoder().values()]
        byte = {c: b for b, c in enumerate(byte_chars())}
        ranks = {bytes(byte[c] for c in token): i for token, i in self.own.get_vocab(with_added_tokens=False).items() if token not in self.special}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def one(self, text: str) -> bytes:
        if len(text) > LONG or any(s in text for s in self.special) or unknown(text):
            ids = self.own.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast(text)
        return np.asarray(ids, dtype="<u4").tobytes() if sys.byteorder == "big" else array.array("I", ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        return [*map(self.one, texts)]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@functools.lru_cache(maxsize=4)
def combinations(classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The multisets of one to three length classes that add up to a window of `classes`, as rows of three with 0 for none, and as a matrix of counts."""
    rows = [(classes, 0, 0)]
    for a in range(1, classes // 2 + 1):
        rows.append((classes - a, a, 0))
    for a in range(1, classes // 3 + 1):
        rows += [(classes - a - b, b, a) for b in range(a, (classes - a) // 2 + 1)]
    found = np.asarray(rows)
    counts = np.zeros((classes + 1, len(rows)))
    for column in found.T:
        np.add.at(counts, (column, np.arange(len(rows))), 1)
    return found, counts[1:]


def nnls(matrix: np.ndarray, target: np.ndarray, steps: int = 600) -> np.ndarray:
    """x >= 0 that minimises |matrix x - target|, by active sets over the normal equations."""
    x = np.zeros(matrix.shape[1])
    active: list[int] = []
    for _ in range(steps):
        rest = target - matrix[:, active] @ x[active] if active else target
        gain = matrix.T @ rest
        gain[active] = 0
        best = int(gain.argmax())
        if gain[best] <= 1e-7 * max(1.0, target.max(initial=0)):
            break
        active.append(best)
        while active:
            part = matrix[:, active]
            solved = np.linalg.solve(part.T @ part + 1e-9 * np.eye(len(active)), part.T @ target)
            if solved.min() > 1e-10:
                x[active] = solved
                break
            now = x[active]
            falling = solved <= 1e-10
            step = float(np.min(now[falling] / np.maximum(now[falling] - solved[falling], 1e-12)))
            now += min(max(step, 0.0), 1.0) * (solved - now)
            kept = [(i, v) for i, v, f in zip(active, now, falling, strict=True) if not (f and v <= 1e-9)]
            if len(kept) == len(active):
                drop = int(np.where(falling, now, np.inf).argmin())
                kept = [k for j, k in enumerate(kept) if j != drop]
            x[active] = 0
            active = [i for i, _ in kept]
            x[active] = [v for _, v in kept]
    return x


def plan(lengths: np.ndarray, window: int = WINDOW, width: int = WIDTH) -> list[list[tuple[int, int, int]]]:
    """Sequences of (piece, start within the piece, length) that hold every piece of 1 to `window` tokens once."""
    classes = window // width
    sequences: list[list[tuple[int, int, int]]] = []
    of = -(-np.asarray(lengths, dtype=np.int64) // width)
    order = np.argsort(-lengths, kind="stable")
    queues: list[list[int]] = [[] for _ in range(classes + 1)]
    for i in order:
        queues[of[i]].append(int(i))
    left = np.asarray([len(q) for q in queues[1:]], dtype=np.int64)
    if left.sum():
        combos, counts = combinations(classes)
        x = nnls(counts, left.astype(float))
        used = np.flatnonzero(x > 0)
        whole = np.floor(x[used] + 1e-9).astype(np.int64)
        rounds = sorted(zip(used, whole, strict=True), key=lambda u: -u[1]) + [(s, 1) for s in used[np.argsort(-(x[used] - whole), kind="stable")]]
        for s, times in rounds:
            need = counts[:, s].astype(np.int64)
            where = np.flatnonzero(need)
            times = int(min(times, (left[where] // need[where]).min()))
            left[where] -= times * need[where]
            for _ in range(times):
                sequences.append([(i := queues[c].pop(), 0, int(lengths[i])) for c in combos[s] if c])
    # What rounding left over: the largest first, each into the open window; it is cut where the window ends.
    rest = sorted((i for q in queues for i in q), key=lambda i: (-lengths[i], i))
    opened: list[tuple[int, int, int]] = []
    room = window
    for i in rest:
        begin, n = 0, int(lengths[i])
        while n:
            take = min(n, room)
            opened.append((i, begin, take))
            begin, n, room = begin + take, n - take, room - take
            if not room:
                sequences.append(opened)
                opened, room = [], window
    # The last open window is cut at powers of two, which need no padding.
    left, room = window - room, 0
    for i, begin, n in opened:
        while n:
            if not room:
                room = 1 << (left.bit_length() - 1)
                sequences.append([])
            take = min(n, room)
            sequences[-1].append((i, begin, take))
            begin, n, room, left = begin + take, n - take, room - take, left - take
    return sequences


def _block(docs: list[tuple[int | None, bytes]], first: int, window: int) -> tuple[pa.RecordBatch, int]:
    """The rows of a block of documents, and the next sequence's number."""
    rows: list[tuple] = []
    tails: list[tuple[int, int]] = []
    for d, (doc_id, ids) in enumerate(docs):
        n = len(ids) // 4
        for begin in range(0, n - n % window, window):
            rows.append((doc_id, begin, window, zlib.crc32(ids[4 * begin : 4 * (begin + window)]), n, first, 0))
            first += 1
        if n % window:
            tails.append((d, n - n % window))
    lengths = np.asarray([len(docs[d][1]) // 4 - begin for d, begin in tails], dtype=np.int64)
    for sequence in plan(lengths, window):
        offset = 0
        for piece, begin, length in sequence:
            d, start = tails[piece]
            doc_id, ids = docs[d]
            start += begin
            rows.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, first, offset))
            offset += length
        first += 1
    columns = list(zip(*rows, strict=True)) or [()] * 7
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names), first


def pack(docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    path: a vocabulary file of the tokenizers library that every executor has; window: a multiple of WIDTH.
    sequence_id is the task's number and a count within it, so that it is unique over the whole result.
    """
    if window % WIDTH:
        raise ValueError(f"the window must be a multiple of {WIDTH}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 36
        block: list[tuple[int | None, bytes]] = []
        held = 0
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), own.encode(texts), strict=True):
                block.append((doc_id, ids + end))
                held += len(ids) // 4 + 1
                if held >= BLOCK:
                    out, number = _block(block, number, window)
                    block, held = [], 0
                    yield out
        if block:
            yield _block(block, number, window)[0]

    return bounded(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
