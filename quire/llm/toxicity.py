"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows that tell abuse from quotation.

The lexicon is a short fixed list, joined by the terms and stems that the labels give: those that documents labelled toxic use
far more often than the others. All stand in one trie. The Levenshtein automata of its terms
run over the trie at once: a state is a set of trie nodes with the edits spent, made deterministic as tokens ask for it, so
that a token costs a table lookup per character until nothing is within reach. Short terms allow no edit, those from FUZZY
characters one, from twice that two. A stem accepts any continuation.

Each hit is weighed by its window: neighbours that are hits as well raise it; quotation marks around it, verbs of saying and
words about words before it lower it. A small logistic model, fitted on at most ROWS labelled rows (a documented bound) outside
the held-out fold, turns the sums into a score. Language, source and ids are never inputs.

Defined results: null and empty texts have no hits. Without labels fixed weights hold. Repeated rows each get their row. Texts and
words of any length are read whole. An empty table yields no rows. Columns of any other name may be there.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import bounded, fold, labelled, slices, stored

ROWS = 8000
FOLDS, LEFT_OUT = 4, 2
THRESHOLD = 0.3
#: Words on either side that make a hit's window.
REACH = 8
#: Terms from this length on may differ by an edit, from twice this by two.
FUZZY = 5
STEMS = range(4, 9)
#: Share of the toxic documents that a learned term or stem must be in.
SUPPORT = 0.01
#: Distinct tokens that a worker remembers.
TABLE = 150_000

#: Insults that are taken for toxic without any label.
SEED = "bastard clown cretin degenerate disgusting dumbass filthy fool freak idiot imbecile loser moron parasite pathetic retard scum slut stupid trash vermin whore worthless".split()
#: Words before a quoted or discussed term.
REPORTING = frozenset("said says called calls calling wrote writes word term slur insult quote quoted quotes phrase named dit mot sagte wort dijo palabra".split())

_strip = "\"'`.,;:!?()[]{}<>|*#$%&-_/\\~=+«»“”„‘’…"
_quotes = re.compile("[\"«»“”„]")
#: Digits and signs written for letters.
_SIGNS = str.maketrans("013457@$", "oieastas")


class State:
    """A state of the intersection: a set of (trie node, edits so far), made deterministic as tokens ask for it."""

    __slots__ = ("after", "found", "places", "stem")

    def __init__(self, places: frozenset, nodes: list):
        self.places, self.after = places, {}
        #: The best (weight, edits) of the terms that end here, and the weight of a stem that ends here without an edit.
        self.found = max(((nodes[n][1] * 0.5**e, e) for n, e in places if nodes[n][1] and e <= nodes[n][4]), default=None)
        self.stem = max((nodes[n][2] for n, e in places if nodes[n][2] and not e), default=0.0)


class Lexicon:
    """A trie of terms and stems, and the walk of a token's characters through its intersection with the Levenshtein automata."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float]):
        #: A node: children, weight of the term that ends there, of the stem, edits allowed below it, and for that term.
        self.nodes: list[list] = [[{}, 0.0, 0.0, 0, 0]]
        for word, weight in terms.items():
            limit = 0 if len(word) < FUZZY else 1 if len(word) < 2 * FUZZY else 2
            path = self._put(word, limit)
            self.nodes[path[-1]][1] = weight
            self.nodes[path[-1]][4] = limit
        for word, weight in stems.items():
            self.nodes[self._put(word, 0)[-1]][2] = weight
        self.states: dict[frozenset, State] = {}
        self.start = self._state({(0, 0)})

    def _put(self, word: str, limit: int) -> list[int]:
        path = [0]
        for c in word:
            children = self.nodes[path[-1]][0]
            if c not in children:
                children[c] = len(self.nodes)
                self.nodes.append([{}, 0.0, 0.0, 0, 0])
            path.append(children[c])
        for n in path:
            self.nodes[n][3] = max(self.nodes[n][3], limit)
        return path

    def _state(self, places: set) -> State | None:
        """With what can be reached by leaving out characters of a term."""
        wanted, reached = list(places), set()
        while wanted:
            n, e = place = wanted.pop()
            if place in reached:
                continue
            reached.add(place)
            wanted += [(k, e + 1) for k in self.nodes[n][0].values() if e < self.nodes[k][3]]
        # Of one node only the least edits matter.
        least: dict[int, int] = {}
        for n, e in reached:
            least[n] = min(e, least.get(n, 9))
        key = frozenset(least.items())
        if not key:
            return None
        if key not in self.states:
            self.states[key] = State(key, self.nodes)
        return self.states[key]

    def _step(self, state: State, c: str) -> State | None:
        places = set()
        for n, e in state.places:
            children = self.nodes[n][0]
            if e < self.nodes[n][3]:
                places.add((n, e + 1))  # a character too many
            for x, k in children.items():
                if x == c:
                    places.add((k, e))
                elif e < self.nodes[k][3]:
                    places.add((k, e + 1))
        found = state.after[c] = self._state(places)
        return found

    def match(self, token: str) -> tuple[float, int] | None:
        """The best (weight, edits) of the terms within reach of the token and the stems that begin it; None if there is none."""
        state, stem = self.start, 0.0
        for c in token:
            after = state.after
            state = after[c] if c in after else self._step(state, c)
            if state is None:
                break
            if state.stem > stem:
                stem = state.stem
        found = state.found if state is not None else None
        if stem and (found is None or stem >= found[0]):
            return stem, 0
        return found


FEATURES = 7


@dataclasses.dataclass
class Model:
    """terms, stems: the lexicon with weights from 0 to 1; weights: of the features, the last for 1."""

    terms: dict[str, float]
    stems: dict[str, float]
    weights: list[float]

    def __post_init__(self):
        self._lexicon: Lexicon | None = None
        self._table: dict[str, tuple[float, int] | None] = {}

    def __getstate__(self):
        return {"terms": self.terms, "stems": self.stems, "weights": self.weights, "_lexicon": None, "_table": {}}

    def _missed(self, chunk: str) -> tuple[float, int] | None:
        if self._lexicon is None:
            self._lexicon = Lexicon(self.terms, self.stems)
        token = chunk.strip(_strip).lower()
        found = self._lexicon.match(token)
        if found is None and not token.isalpha():
            # Letters between signs, and signs for letters.
            plain = "".join([c for c in token.translate(_SIGNS) if c.isalpha()])
            if plain != token and len(plain) >= 4:
                found = self._lexicon.match(plain)
        if len(chunk) <= 48:
            if len(self._table) >= TABLE:
                self._table.clear()
            self._table[chunk] = found
        return found

    def features(self, text: str) -> list[float]:
        """Sums over hits: exact, misspelled, abuse in the strongest window, all abuse, share of words, quoted, 1."""
        chunks = text.split()
        get, missed = self._table.get, self._missed
        found = [h if (h := get(c, 0)) != 0 else missed(c) for c in chunks]
        at = [i for i, h in enumerate(found) if h]
        if not at:
            return [0.0] * (FEATURES - 1) + [1.0]
        exact = near = total = strongest = quoted = 0.0
        for place, i in enumerate(at):
            weight, edits = found[i]
            begin, end = max(0, i - REACH), min(len(chunks), i + REACH + 1)
            company = 0
            for step in (-1, 1):
                k = place + step
                while 0 <= k < len(at) and begin <= at[k] < end:
                    company += 1
                    k += step
            before = " ".join(chunks[begin:i])
            own = chunks[i]
            inside = (bool(_quotes.search(own)) or len(_quotes.findall(before)) % 2 == 1) and bool(_quotes.search(" ".join(chunks[i:end])))
            reported = any(w.strip(_strip).lower() in REPORTING for w in chunks[max(0, i - 3) : i])
            factor = 0.3 if inside and reported else 0.5 if inside or reported else 1.0
            quoted += weight * (1 - factor)
            score = weight * factor * (1 + 0.25 * min(company, 4))
            total += score
            strongest = max(strongest, score)
            if edits:
                near += weight * factor
            else:
                exact += weight * factor
        return [np.log1p(exact), np.log1p(near), strongest, np.log1p(total), 10 * total / (len(chunks) + 10), np.log1p(quoted), 1.0]

    def score(self, texts: list[str]) -> np.ndarray:
        rows = np.asarray([self.features(t) for t in texts], dtype=float).reshape(-1, FEATURES)
        return 1 / (1 + np.exp(-np.clip(rows @ np.asarray(self.weights), -30, 30)))


def lexicon(sample: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Terms and stems of the labelled sample that toxic documents use far beyond their share.

    Documents with the same least hash of a word count as one, since copies of a document say no more than it. What is found is
    bounded by the sample: a term is in SUPPORT of its toxic documents at least.
    """
    chunks = F.array_distinct(F.split(F.lower("text"), "\\s+"))
    worded = sample.select("label", chunks.alias("w")).select("label", "w", F.array_min(F.transform("w", lambda c: F.xxhash64(c))).alias("own"))
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.when(F.length("word") >= n, F.substring("word", 1, n)).alias("word")) for n in STEMS], F.struct(F.lit(0).alias("n"), F.col("word").alias("word"))))
    docs = worded.select("own", "label").distinct().agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).first()
    if not docs.n or not docs.toxic or docs.toxic == docs.n:
        return {}, {}
    # Words stripped of the signs around them, as the matcher strips them. What repeats in a document is merged before the counts.
    counted = (
        worded.select("own", "label", F.explode("w").alias("chunk"))
        .select("own", "label", F.regexp_replace("chunk", "^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$", "").alias("word"))
        .where("length(word) >= 2")
        .select("own", "label", parts.alias("s"))
        .select("own", "label", "s.n", "s.word")
        .where("word is not null")
        .distinct()
        .groupBy("n", "word")
        .agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    )
    rest, own = float(docs.n - docs.toxic), float(docs.toxic)
    # Odds against the share of toxic documents, with half a clean document added.
    odds = (F.col("toxic") / own) / ((F.col("clean") + 0.5) / rest)
    found = counted.where((F.col("toxic") >= max(4.0, SUPPORT * own)) & (odds >= 10.0) & (F.col("toxic") > F.col("clean")))
    rows = found.select("n", "word", (F.col("toxic") / (F.col("toxic") + 2 * F.col("clean") + 1.0)).alias("weight")).collect()
    stems: dict[str, float] = {}
    for r in sorted((r for r in rows if r.n), key=lambda r: (r.n, r.word)):
        if not any(r.word[:n] in stems for n in STEMS if n < r.n):
            stems[r.word] = r.weight
    return {r.word: r.weight for r in sorted(rows, key=lambda r: r.word) if r.n == 0 and not any(r.word[:n] in stems for n in STEMS if len(r.word) > n)}, stems


def train(rows: np.ndarray, labels: np.ndarray, rounds: int = 400) -> list[float]:
    """Logistic regression by damped Newton steps, with a light penalty."""
    weights = np.zeros(FEATURES)
    penalty = np.diag([0.5] * (FEATURES - 1) + [1e-3])
    for _ in range(min(rounds, 60)):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        slope = rows.T @ (p - labels) + penalty @ weights
        bend = rows.T @ (rows * (p * (1 - p))[:, None]) + penalty + 1e-6 * np.eye(FEATURES)
        step = np.linalg.solve(bend, slope)
        weights -= step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return weights.tolist()


#: For want of labels of both kinds.
DEFAULT = [0.8, 0.4, 1.5, 0.5, 1.0, -0.3, -3.0]


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, left_out: int = LEFT_OUT, rows: int = ROWS) -> Model:
    """The lexicon and the weights, from at most `rows` labelled rows outside the fold left out, which are stored for that."""
    sample = stored(labelled(spark, docs, labels, label, folds, left_out, rows).select("doc_id", "label", "text"))
    terms, stems = lexicon(sample)
    model = Model(dict.fromkeys(SEED, 0.8) | terms, stems, DEFAULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([model.features(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    got = sample.mapInArrow(run, "doc_id long, label int, x array<double>").toArrow().sort_by([("doc_id", "ascending")])
    y = np.asarray(got.column("label").to_pylist(), dtype=float)
    if len(set(y.tolist())) > 1:
        model.weights = train(np.asarray(got.column("x").to_pylist(), dtype=float).reshape(-1, FEATURES), y)
    return model


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (doc_id unless told otherwise) and score, of every row; one pass without a shuffle."""
    keep = keep or ["doc_id"]
    frame = bounded(docs).select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.score(batch.column("__text").to_pylist()), pa.float64())], [*keep, "score"])

    return frame.mapInArrow(run, f"{schema}, score double")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are not toxic, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = model.score([t or "" for t in batch.column("text").to_pylist()]) < threshold
            if keep.any():
                yield batch.filter(pa.array(keep))

    return bounded(docs).mapInArrow(run, docs.schema)


def detect(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, learned outside the held-out fold."""
    scored = score(docs, fit(spark, docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == LEFT_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
