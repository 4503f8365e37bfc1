"""Document fingerprints: bottom-k sketches of shingle hashes.

A fingerprint holds the K least distinct hashes of a text's five-word shingles (all of them, if there are fewer). Sketches of
parts merge to the sketch of the whole, and estimate resemblance, containment and the number of distinct shingles.

The query's neighbours ("the next document, descending doc_id") come from one shuffle: bounds of runs of about ROWS rows are
quantiles of a sample of (id, hash of the text), which decides how rows are dealt and nothing else; each run's first document is
also sent to the run before it, so that no order over all rows is needed in one place, however the ids lie.

Defined results: null text counts as empty; its fingerprint is empty, alike to another empty one (1.0) and unlike all others
(0.0). Rows with one doc_id follow each other by the hash of their text; null ids come last. A table of one row has itself as
next. An empty table yields no rows. Texts of any length are read whole. Columns of any other name may be there.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quire.llm.common import bounded, slices
from quire.llm.shingles import shingle_hashes

#: Hashes in a fingerprint: a resemblance of 0.5 is met within 0.044, one standard deviation.
K = 128
#: Bits of a hash that are kept; two of a text's n shingles meet by chance n**2 / 2**49 times.
BITS = 48
#: Rows in a run, about; runs at most, which bounds what the driver gets (16 bytes each, and SAMPLE times that for the sample).
ROWS = 1000
RUNS = 1 << 16
SAMPLE = 16
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def sketches(texts: list[str], k: int = K) -> list[np.ndarray]:
    """The sketch of each text: ascending 48-bit integers."""
    return [np.unique(h[: 2 * k] >> np.uint64(64 - BITS))[:k] for h in shingle_hashes([t.encode("utf-8", "surrogatepass") for t in texts])]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of two parts together."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimates the number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * float(1 << BITS) / float(a[k - 1] + np.uint64(1))


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimates the Jaccard similarity; exact if the union is no larger than a sketch."""
    if not len(a) and not len(b):
        return 1.0
    least = merge(a, b, k)
    # Below the last hash of the union's sketch both sketches are whole.
    return float(np.isin(least, a, assume_unique=True).__and__(np.isin(least, b, assume_unique=True)).sum()) / len(least)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimates which share of a's shingles b has; 1.0 for an empty a."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def written(a: np.ndarray) -> str:
    """The sketch as text: base64 of 6 bytes a hash."""
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BITS // 8 :].tobytes()).decode()


def read(text: str) -> np.ndarray:
    """The sketch that written() gave."""
    raw = np.frombuffer(base64.b64decode(text), dtype=np.uint8).reshape(-1, BITS // 8)
    return np.pad(raw, ((0, 0), (8 - BITS // 8, 0))).reshape(-1).view(">u8").astype(np.uint64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every text; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = sketches([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(written, found), pa.string())], ["doc_id", "fingerprint"])

    return bounded(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


def _runs(docs: DataFrame) -> DataFrame:
    """docs (with place and hash, which order them) with `run`, the number of the run of rows that each belongs to."""
    rows = docs.count()
    runs = min(RUNS, -(-rows // ROWS))
    if runs < 2:
        return docs.withColumn("run", F.lit(0))
    keys = docs.select("place", "hash")
    sample = keys.sample(min(1.0, SAMPLE * runs / rows), seed=1).toArrow()
    kind = np.dtype([("place", "<i8"), ("hash", "<i8")])
    points = np.empty(sample.num_rows, dtype=kind)
    points["place"], points["hash"] = sample.column("place").to_numpy(), sample.column("hash").to_numpy()
    points = points[np.lexsort((points["hash"], points["place"]))]
    bounds = docs.sparkSession.sparkContext.broadcast(points[np.arange(1, runs) * len(points) // runs])

    @pandas_udf("int")
    def run_of(places: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        # By place first; the hash parts only what stands at the place of a bound.
        parted = bounds.value["place"]
        for place, hashed in places:
            place, hashed = place.to_numpy(), hashed.to_numpy()
            low, high = np.searchsorted(parted, place, "left"), np.searchsorted(parted, place, "right")
            for i in np.flatnonzero(low < high):
                low[i] += np.searchsorted(bounds.value["hash"][low[i] : high[i]], hashed[i], "right")
            yield pd.Series(low.astype(np.int32))

    return docs.withColumn("run", run_of("place", "hash"))


def edited(docs: DataFrame) -> DataFrame:
    """SCHEMA for every row: the text's fingerprint, that of its edited text, and likeness to the edited and to the next text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # The complement turns the order of ids round without leaving 64 bits.
    docs = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit((1 << 63) - 1)).alias("place"), F.xxhash64(text).alias("hash"))
    numbered = _runs(docs)
    firsts = sorted((r.run, r.first.place, r.first.hash) for r in numbered.groupBy("run").agg(F.min(F.struct("place", "hash")).alias("first")).collect())
    # A row a run: the first of its rows goes to the run before as well, that of the first run to the last.
    ghosts = docs.sparkSession.createDataFrame([(run, place, hashed, firsts[i - 1][0]) for i, (run, place, hashed) in enumerate(firsts)], "run int, place long, hash long, also int")
    own, other = F.struct(F.col("run").alias("run"), F.lit(0).alias("ghost")), F.struct(F.col("also").alias("run"), F.lit(1).alias("ghost"))
    copies = F.when(F.col("also").isNull(), F.array(own)).otherwise(F.array(own, other))
    placed = numbered.join(F.broadcast(ghosts), ["run", "place", "hash"], "left").select("doc_id", "text", "place", "hash", F.explode(copies).alias("copy"))
    placed = placed.select("doc_id", "text", "place", "hash", "copy.run", "copy.ghost").repartition("run").sortWithinPartitions("run", "ghost", "place", "hash", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        held: tuple | None = None  # the row before, which waits for its next; a run ends with its ghosts
        for batch in slices(batches):
            ghosts, ids, texts = (batch.column(c).to_pylist() for c in ("ghost", "doc_id", "text"))
            rows = ([held] if held else []) + list(zip(ghosts, ids, texts, sketches(texts), strict=True))
            held = rows[-1]
            pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[0]]
            changed = [a[2][: len(a[2]) - len(a[2]) // 2] + b[2][: len(a[2]) // 2] for a, b in pairs]
            out = [(a[1], len(a[2]), hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest(), written(a[3]), written(s), resemblance(a[3], s), resemblance(a[3], b[3])) for (a, b), c, s in zip(pairs, changed, sketches(changed), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names)

    return placed.select("ghost", "doc_id", "text").mapInArrow(run, SCHEMA)
