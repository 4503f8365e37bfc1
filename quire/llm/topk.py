"""Exact top-k search by columnar branch and bound.

Vectors become integers, floor(1024 x). Candidates lie in vertical layout, dimension by dimension. A query's scores build up
block by block of dimensions, its heaviest first; after each block only those candidates survive whose partial score plus
the product of the remaining norms (no remaining inner product is larger, by Cauchy and Schwarz) can still reach the k-th best
score, and the survivors are compacted. The first few candidates of a task are scored in full to have a bound.

Queries are a stated set. They go to the tasks in chunks of at most CHUNK vectors, which bounds what is broadcast; candidates
are never moved. Each task keeps k rows a query and chunk, merged by a window. Beyond one chunk, each chunk's result is written to
the shared folder and its broadcast destroyed before the next, so that the driver holds one chunk and a plan one scan, however many
queries there are. A chunk's scan costs little beside its products: thousands for each component read.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part. Rows with the query's own id
are not its candidates; repeated rows of another id are each a candidate, and rank side by side. Of several vectors with one
query id the least counts as the query. A candidate of another length than the query's is none.
Ranks are exact whatever the size of the components; a score beyond 64 bits is written as the greatest (or least) 64-bit
integer. Components whose scaled value leaves double precision's range count as not finite. Null ids take no part. With fewer
than k candidates all are returned. Columns of any other name may be there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.storage import new_path

SCALE = 1024
K = 10
#: Queries in a chunk: 4096 vectors of 64 components take 2 MB.
CHUNK = 4096
#: Dimensions in a block; candidates scored in full for a first bound, and in a vertical tile.
BLOCK = 8
FIRST = 256
TILE = 16384
#: Sums of products below this are exact in double precision.
EXACT = float(1 << 52)


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and the scaled vector of the rows that take part."""
    v = F.col("embedding")
    whole = F.size(v) > 0
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) == float("inf")))
    # From 2**53 on every double is whole, and would leave floor()'s 64 bits.
    scaled = lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)
    return vectors.where(F.col("vec_id").isNotNull() & whole & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: scaled(x.cast("double") * scale)).alias("v"))


def best(ids: np.ndarray, columns: np.ndarray, norms: np.ndarray, query_id: int, query: np.ndarray, k: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of at most k candidates whose score is at least `bound`, best first, ties to the smaller id.

    columns: the candidates' components, a row a dimension; norms: by row, the norm of all dimensions.
    """
    order = np.argsort(-np.abs(query), kind="stable")
    weights = query[order]
    alive = np.flatnonzero(ids != query_id)
    partial = np.zeros(len(alive))
    spent = np.zeros(len(alive))
    total = norms[alive] ** 2
    rest = np.append(np.cumsum((weights**2)[::-1])[::-1], 0.0)
    for begin in range(0, len(order), BLOCK):
        dims = order[begin : begin + BLOCK]
        part = columns[dims][:, alive] if len(alive) < columns.shape[1] else columns[dims]
        partial = partial + query[dims] @ part
        spent = spent + (part * part).sum(axis=0)
        if np.isfinite(bound):
            # A little is added for rounding of the norms.
            reach = partial + np.sqrt(np.maximum(total - spent, 0.0) * rest[min(begin + BLOCK, len(order))]) * (1 + 1e-9) + 1e-6
            keep = reach >= bound
            if keep.sum() < 0.8 * len(keep):
                alive, partial, spent, total = alive[keep], partial[keep], spent[keep], total[keep]
                if not len(alive):
                    break
    if np.isfinite(bound):
        keep = partial >= bound
        alive, partial = alive[keep], partial[keep]
    if len(alive) > 4 * k:
        least = np.partition(partial, len(partial) - k)[len(partial) - k]
        alive, partial = alive[partial >= least], partial[partial >= least]
    chosen = np.lexsort((ids[alive], -partial))[:k]
    return ids[alive[chosen]], partial[chosen]


def whole(ids: np.ndarray, columns: np.ndarray, query_id: int, query: np.ndarray, k: int, most: float) -> tuple[np.ndarray, np.ndarray]:
    """The same for scores beyond double precision's integers: all of them, in integers of 64 bits or, from 2**62 on, of any size."""
    alive = np.flatnonzero(ids != query_id)
    if most < 2.0**62:
        scores = query.astype(np.int64) @ columns[:, alive].astype(np.int64)
        chosen = np.lexsort((ids[alive], -scores))[:k]
    else:
        exact = lambda a: np.frompyfunc(int, 1, 1)(a)
        scores = exact(query) @ exact(columns[:, alive]) if len(alive) else np.zeros(0, dtype=object)
        chosen = np.asarray(sorted(range(len(alive)), key=lambda i: (-scores[i], ids[alive[i]]))[:k], dtype=np.int64)
    return ids[alive[chosen]], scores[chosen]


def _merged(have: tuple[np.ndarray, np.ndarray] | None, new: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best k of two lists."""
    if have is None:
        return new
    kinds = (have[1].dtype, new[1].dtype)
    if object in kinds:
        ids, scores = np.concatenate([have[0], new[0]]), np.concatenate([[int(s) for s in have[1]], [int(s) for s in new[1]]]).astype(object)
        chosen = np.asarray(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], dtype=np.int64)
        return ids[chosen], scores[chosen]
    wide = np.int64 if np.int64 in kinds else np.float64
    ids, scores = np.concatenate([have[0], new[0]]), np.concatenate([have[1].astype(wide), new[1].astype(wide)])
    chosen = np.lexsort((ids, -scores))[:k]
    return ids[chosen], scores[chosen]


LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _written(score: int) -> tuple[int, str]:
    """The score within 64 bits, and for one beyond them a text that sorts as it does among those."""
    if LEAST < score < MOST:
        return int(score), ""
    digits = str(abs(int(score)))
    if score > 0:
        return MOST, f"{len(digits):06d}{digits}"
    return LEAST, f"{999999 - len(digits):06d}" + digits.translate(str.maketrans("0123456789", "9876543210"))


def search(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of `queries` the k rows of `vectors` with the greatest inner product."""
    spark = vectors.sparkSession
    asked = integers(queries, scale).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    rows = ((r.query_id, r.v) for r in asked.toLocalIterator())
    chunk = list(islice(rows, CHUNK))
    after = list(islice(rows, CHUNK))
    if not after:
        return _ranked(_chunk(vectors, spark.sparkContext.broadcast(_by_length(chunk)), scale, k), k)
    folder = new_path(spark)
    number = 0
    while chunk:
        sent = spark.sparkContext.broadcast(_by_length(chunk))
        part = _ranked(_chunk(vectors, sent, scale, k), k)
        part.write.parquet(f"{folder}/chunk={number}")
        sent.destroy()
        number += 1
        chunk, after = after, list(islice(rows, CHUNK))
    return spark.read.schema(part.schema).parquet(folder).select(part.columns)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k of all tasks, for each query."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_length(chunk: list) -> dict[int, list]:
    """The queries of a chunk by the length of their vectors."""
    found: dict[int, list] = {}
    for q, v in sorted(chunk):
        found.setdefault(len(v), []).append((q, np.asarray(v, dtype=np.float64)))
    return found


def _chunk(vectors: DataFrame, sent: Broadcast, scale: int, k: int) -> DataFrame:
    """The best k of each task for the queries of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            lists = batch.column("v")
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            all_ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            for n, asked in sent.value.items():
                rows = np.flatnonzero(lengths == n)
                for start in range(0, len(rows), TILE):
                    some = rows[start : start + TILE]
                    ids = all_ids[some]
                    columns = np.ascontiguousarray(values[begins[some][:, None] + np.arange(n)].T)
                    norms = np.sqrt((columns**2).sum(axis=0))
                    for q, query in asked:
                        have = kept.get(q)
                        most = float(norms.max(initial=0) * np.sqrt((query**2).sum()))
                        if not most < EXACT:
                            kept[q] = _merged(have, whole(ids, columns, q, query, k, most), k)
                            continue
                        bound = -np.inf if have is None or len(have[0]) < k else float(have[1][-1])
                        if bound == -np.inf and len(ids) > 2 * FIRST:
                            first = best(ids[:FIRST], columns[:, :FIRST], norms[:FIRST], q, query, k, -np.inf)
                            bound = first[1][-1] if len(first[1]) == k else -np.inf
                        new = best(ids, columns, norms, q, query, k, bound)
                        kept[q] = _merged(have, new, k)
        if kept:
            ids = np.concatenate([i for i, _ in kept.values()])
            scores = [_written(x) for _, s in kept.values() for x in (s.tolist() if s.dtype == object else s.astype(np.int64).tolist())]
            asked_ids = np.repeat(list(kept), [len(i) for i, _ in kept.values()])
            yield pa.RecordBatch.from_arrays([pa.array(asked_ids, pa.int64()), pa.array(ids, pa.int64()), pa.array([x for x, _ in scores], pa.int64()), pa.array([t for _, t in scores], pa.string())], ["query_id", "vec_id", "score", "beyond"])

    return integers(vectors, scale).mapInArrow(run, "query_id long, vec_id long, score long, beyond string")
