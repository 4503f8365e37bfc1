"""Byte-pair encoding and decoding by forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no vocabulary token can never be spanned by a token, whatever the merges do.
Between such bytes a cut is certain: merges on one side never look at the other. So a text is cut at white space, at the
pre-tokenizer's boundaries and at such pairs; the fragments are encoded independently, each distinct one once while it stays
in the table of a worker, and their ids concatenated. Ids and decoded text equal those of the whole text.

Defined results: null or empty text: no ids, empty decoded text, hashes of the empty text. Texts of any length are encoded
whole, in memory in proportion to the text. Repeated rows each get their row. Special tokens written out in a text are encoded
as such, which is what the library does unless it is told otherwise.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bounded, slices

#: Entries of a worker's table of distinct chunks, which has a young and an old half: what is asked for again moves to the young one.
TABLE = 250_000
#: A chunk longer than this is encoded but not remembered.
LONG = 64
#: Unicode's White_Space, which is also what \s of the tokenizer's patterns means.
SPACES = "\t-\r \x85\xa0" + chr(0x1680) + chr(0x2000) + "-" + chr(0x200A) + "".join(map(chr, (0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_chunks = re.compile(f"[^{SPACES}]+").findall
_odd = re.compile("[\x1c-\x1f]").search
_NONE = 1 << 62
_SIGNS = frozenset(".,;:!?|")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


_unassigned = regex.compile(r"\p{Cn}").search


def unknown(text: str) -> bool:
    """Whether the text has characters that Unicode's tables here do not know, while the library's may."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
        return False
    except UnicodeEncodeError:
        return _unassigned(text) is not None or any(unicodedata.category(c) == "Cn" for c in set(text))


class Codec:
    """A word-level BPE vocabulary with word ends, read from the tokenizers library's JSON."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.library = path, None
        model = spec["model"]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None or spec["post_processor"] is not None:
            raise ValueError(f"{path}: not a word-level lower-case vocabulary")
        self.end = model["end_of_word_suffix"]
        vocab = model["vocab"]
        self.tokens = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        chars = byte_chars()
        self.inner = [vocab[c] for c in chars]
        self.last = [vocab[c + self.end] for c in chars]
        #: (left id, right id) -> rank << 32 | merged id
        self.merges = {(vocab[a], vocab[b]): rank << 32 | vocab[a + b] for rank, (a, b) in enumerate(model["merges"])}
        self.written = [str(i) for i in range(max(self.tokens) + 1)]
        self.byte = {c: b for b, c in enumerate(chars)}
        self.joined = self._pairs(vocab, self.byte)
        self.fragments: dict[tuple[int, ...], list[int]] = {}
        self.table: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}

    def _pairs(self, vocab: dict[str, int], byte: dict[str, int]) -> set[tuple[int, int]]:
        """The pairs of byte symbols that stand side by side inside some token; any other pair is a forced boundary."""
        found = set()
        for token in vocab:
            whole = token.endswith(self.end) and len(token) > len(self.end)
            body = token[: -len(self.end)] if whole else token
            if any(c not in byte for c in body):
                continue
            ids = [self.inner[byte[c]] for c in body]
            if whole:
                ids[-1] = self.last[byte[body[-1]]]
            found.update(zip(ids, ids[1:], strict=False))
        return found

    def _merge(self, ids: list[int]) -> list[int]:
        """The merges of one fragment: always the pair of the lowest rank, from the left."""
        if len(ids) > 48:
            return self._merge_long(ids)
        get, ids = self.merges.get, [*ids]
        ranks = [get(p, _NONE) for p in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            i = ranks.index(best)
            ids[i] = best & 0xFFFFFFFF
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), _NONE)
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap of candidate pairs over a linked list: n log n steps for fragments of any length."""
        n, get = len(ids), self.merges.get
        ids, after, before = [*ids], [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, _ = m & 0xFFFFFFFF, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if m := get((new, ids[k])):
                    heapq.heappush(heap, (m, i, new, ids[k]))
            h = before[i]
            if h >= 0 and (m := get((ids[h], new))):
                heapq.heappush(heap, (m, h, ids[h], new))
        return [x for x in ids if x >= 0]

    def word(self, word: str) -> list[int]:
        """The ids of one pre-token."""
        data = word.encode("utf-8", "surrogatepass")
        inner = self.inner
        ids = [inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        joined, fragments, begin, out = self.joined, self.fragments, 0, []
        for i, pair in enumerate(zip(ids, ids[1:], strict=False), 1):
            if pair not in joined:
                out += self.fragment(ids[begin:i], fragments)
                begin = i
        out += self.fragment(ids[begin:], fragments)
        return out

    def fragment(self, ids: list[int], fragments: dict) -> list[int]:
        if len(ids) == 1:
            return ids
        key = tuple(ids)
        found = fragments.get(key)
        if found is None:
            found = self._merge(ids)
            if len(key) <= LONG:
                if len(fragments) >= TABLE // 2:
                    fragments.clear()
                fragments[key] = found
        return found

    def chunk(self, chunk: str) -> list[int]:
        """The ids of a stretch without white space."""
        if unknown(chunk):
            return self._split_by_library(chunk)
        text = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        # Letters alone, or with one sign at the end, need no pattern.
        if text.isalpha():
            return self.word(text)
        if text[-1] in _SIGNS and text[:-1].isalpha():
            return self.word(text[:-1]) + self.word(text[-1])
        return [i for w in self.words(text) for i in self.word(w)]

    def _split_by_library(self, chunk: str) -> list[int]:
        """The same, with the library's normal form and words: its tables may know letters that those here do not."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))
        return [i for w, _ in words for i in self.word(bytes(self.byte[c] for c in w).decode("utf-8", "surrogatepass"))]

    def decode(self, ids: list[int]) -> str:
        """As the library does without a decoder: the tokens joined by one space."""
        return " ".join([self.tokens[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.specials.split(text) if "<|" in text else (text,):
            if part in self.special:
                out.append(self.special[part])
            else:
                for c in _chunks(part):
                    out += self.chunk(c)
        return out

    def _missed(self, chunk: str) -> tuple[str, str]:
        found = self.older.get(chunk)
        if found is None:
            ids = self.chunk(chunk)
            found = (" ".join([self.written[i] for i in ids]), self.decode(ids))
            if len(chunk) > LONG:
                return found
        if len(self.table) >= TABLE:
            self.older, self.table = self.table, {}
        self.table[chunk] = found
        return found

    def round_trip(self, text: str) -> tuple[str, str]:
        """The decimal ids joined by one space, and the decoded text."""
        if "<|" in text and self.specials.search(text):
            ids = self.encode(text)
            return " ".join(map(str, ids)), self.decode(ids)
        chunks = _chunks(text) if _odd(text) else text.split()
        missed = self._missed
        found = []
        for at in range(0, len(chunks), 4096):
            get = self.table.get  # a full table is replaced
            found += [get(c) or missed(c) for c in chunks[at : at + 4096]]
        ids, tokens = zip(*found, strict=False) if found else ((), ())
        return " ".join(filter(None, ids)), " ".join(filter(None, tokens))


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One table a worker: workers are used again by later tasks."""
    return Codec(path)


def digests(path: str):
    """The function over Arrow batches of (doc_id, text) that yields n_tokens and the two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        sha = hashlib.sha256
        for batch in slices(batches):
            counts, ids_sha, decoded_sha = [], [], []
            for text in batch.column("text").to_pylist():
                ids, decoded = own.round_trip(text or "")
                counts.append(ids.count(" ") + 1 if ids else 0)
                ids_sha.append(sha(ids.encode()).hexdigest())
                decoded_sha.append(sha(decoded.encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text; no shuffle. path: a vocabulary file that every executor has."""
    return bounded(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string: the operator's own output."""

    def run(batches):
        own = codec(path)
        for batch in slices(batches):
            ids = [own.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(map(own.decode, ids), pa.string())], ["doc_id", "ids", "decoded"])

    return bounded(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
