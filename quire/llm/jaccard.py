"""N-gram Jaccard join: exact, size-aware, heavy and light.

A document is the set of its distinct five-word shingles (as 64-bit hashes); two link when 100 |A n B| >= 80 |A u B|. Equal sets
form a class; everything below works on classes. All elements are ordered, those known to be frequent last. Two sets that link
share an element among the first n - ceil(4n/5) + 1 of either, and l elements among the first n - ceil(4n/5) + l.

* Light sets enumerate all pairs of elements of their prefix for l = 2: rare keys, but many for large sets.
* Heavy sets stand in the inverted lists of the elements of their prefix for l = 1, and the lists are scanned.
* The boundary is the size up to which enumerating costs less than scanning, reckoned from measured list lengths. Sets of up to
  5/4 of it do both, so that no pair across it is missed.

A candidate must pass bounds on sizes and places, and is taken from the first list of each run of lists that its two sets share.
Those left are told apart by parity bits of the hashes, which bound the difference of two sets from below, and then verified on
whole texts, which are sent in groups around the more wanted set of a pair.

Large groups of near copies would make all pairs of a list candidates. So in long
lists links to one set are found first, that with the fewest elements of its own; lists are then scanned only between different components, because what is connected
already needs no further link. Lists of frequent elements that hold several components are scanned in blocks of bounded size.

Frequent elements are told from a sample of one class in SAMPLE, and at most HOT of them are broadcast. That only changes the order,
never the result.

Defined results: null text counts as empty. Empty documents have no shingles and are linked with nothing, not even each other; the
component of a row is then its own id. Repeated rows and texts share a class. Null ids are never the least; a component of null ids
alone has a null id. An empty table yields no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bounded, discard, slices, stored
from quire.llm.shingles import mix, shingle_hashes

#: Least elements of a set by which the lengths of lists are reckoned.
LEAST = 4
#: From so many sets on a list has a hub.
CROWD = 16
#: One class in so many is counted to tell frequent elements; an element is frequent if OFTEN of them have it.
SAMPLE = 64
OFTEN = 4
#: Frequent elements that are broadcast at most: 8 MB.
HOT = 1 << 20
#: Parts that the list of a frequent element is dealt to.
PARTS = 64
#: Rows of a block of a frequent element's list, and spokes around one copy of a hub.
BLOCK = 512
#: The greatest boundary that is considered.
WIDEST = 64
_U = np.uint64


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _class(hashes: np.ndarray) -> int:
    """A class's number: a hash of its sorted set."""
    with np.errstate(over="ignore"):
        places = np.arange(1, len(hashes) + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)
        folded = np.bitwise_xor.reduce(mix(hashes ^ mix(places))) if len(hashes) else _U(0)
    return int(mix(np.asarray([folded ^ _U(len(hashes))], dtype=np.uint64)).view(np.int64)[0])


def _bits(hashes: np.ndarray) -> bytes:
    """For each residue of the hashes whether an odd number of elements has it. Two sets differ in at least as many elements as their bits."""
    size = 1 << min(16, max(6, (len(hashes) - 1).bit_length()))
    odd = np.bincount((hashes & _U(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _may_link(a: bytes, b: bytes, elements: int) -> bool:
    """False if the bits of two sets, of so many elements together, differ too much for a link. The longer are folded to the shorter."""
    while len(a) != len(b):
        if len(a) < len(b):
            a, b = b, a
        half = len(a) // 2
        a = (int.from_bytes(a[:half], "big") ^ int.from_bytes(a[half:], "big")).to_bytes(half, "big")
    return 9 * (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() <= elements


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the text), n, class, least (the class's LEAST least elements), bits, sample (all elements, of one class in SAMPLE)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_hashes([t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()])
            classes = [_class(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("key"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(classes, pa.int64()),
                    pa.array([s[:LEAST].view(np.int64) for s in sets], pa.list_(pa.int64())),
                    pa.array(map(_bits, sets), pa.binary()),
                    pa.array([s.view(np.int64) if c % SAMPLE == 0 else None for s, c in zip(sets, classes, strict=True)], pa.list_(pa.int64())),
                ],
                ["doc_id", "key", "n", "class", "least", "bits", "sample"],
            )

    return _texts(docs).mapInArrow(run, "doc_id long, key long, n long, class long, least array<long>, bits binary, sample array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"))


def boundary(elements: DataFrame, widest: int = WIDEST) -> int:
    """The greatest size up to which enumerating pairs costs less than scanning lists. elements: n and element, a row for each least element."""
    small = elements.where(F.col("n") <= widest).groupBy("element", "n").agg(F.count("*").alias("rows"))
    lists = elements.groupBy("element").agg(F.count("*").alias("length")).where("length > 1")
    # A list's rows are each compared with the others of the list.
    lengths = small.join(lists, "element", "left").groupBy("n").agg((F.sum(F.col("rows") * F.coalesce("length", F.lit(1))) / F.sum("rows")).alias("mean"))
    mean = {r.n: r["mean"] for r in lengths.collect()}  # at most `widest` rows
    best = 0
    for n in range(2, widest + 1):
        subsets = (n // 5 + 2) * (n // 5 + 1) // 2
        if subsets > (n // 5 + 1) * mean.get(n, 1.0):
            break
        best = n
    return best


def postings(docs: DataFrame, hot: np.ndarray, light: int) -> DataFrame:
    """element, class, place (size << 32 | place in the order), before (the element before it), part, usual (the set's elements that are not frequent) of each set's keys. hot: sorted frequent elements.

    The lists of frequent elements are dealt to PARTS parts, numbered from 1; the part of all others is 0.
    """
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = sent.value
        seen: set[int] = set()  # classes that this task has had: 8 bytes a document
        for batch in slices(batches):
            keys, classes, places, before, parts, rest = [], [], [], [], [], []
            for s in shingle_hashes([t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]):
                n = len(s)
                if not n or (own := _class(s)) in seen:
                    continue
                seen.add(own)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    late = frequent[at] == s
                    usual = int(n - late.sum())
                    if usual < n:
                        s = np.concatenate([s[~late], s[late]])
                else:
                    usual = n
                spare = n - -(-4 * n // 5)
                had = len(keys)
                if n > light:
                    prefix = s[: spare + 1]
                    keys.append(prefix)
                    places.append(np.arange(len(prefix), dtype=np.int64) | (n << 32))
                    before.append(np.concatenate([[_U(own & ((1 << 64) - 1))], prefix[:-1]]))
                    parts.append(np.where(np.arange(len(prefix)) < usual, 0, 1 + own % PARTS).astype(np.int32))
                    classes.append(np.full(len(prefix), own, dtype=np.int64))
                if 2 <= n <= light * 5 // 4:
                    i, j = np.triu_indices(min(spare + 2, n), 1)
                    with np.errstate(over="ignore"):
                        pair = mix(s[i] * _U(0xD6E8FEB86659FD93) + mix(s[j]))
                    keys.append(pair)
                    places.append(np.full(len(pair), n << 32, dtype=np.int64))
                    before.append(np.full(len(pair), own & ((1 << 64) - 1), dtype=np.uint64))
                    parts.append(np.zeros(len(pair), dtype=np.int32))
                    classes.append(np.full(len(pair), own, dtype=np.int64))
                rest += [np.full(len(k), usual, dtype=np.int32) for k in keys[had:]]
            if keys:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(keys)), pa.array(np.concatenate(classes), pa.int64()), pa.array(np.concatenate(places), pa.int64()), _signed(np.concatenate(before)), pa.array(np.concatenate(parts), pa.int32()), pa.array(np.concatenate(rest), pa.int32())], ["element", "class", "place", "before", "part", "usual"])

    return _texts(docs).select("text").mapInArrow(run, "element long, class long, place long, before long, part int, usual int")


def _pairs(element: np.ndarray, own: np.ndarray, place: np.ndarray, before: np.ndarray, root: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The candidates of whole lists, sorted by element and place: between different components (root), and across the two sides only."""
    n, at = place >> 32, place & 0xFFFFFFFF
    new = np.flatnonzero(np.concatenate([[True], element[1:] != element[:-1]]))
    ends = np.repeat(np.append(new[1:], len(element)), np.diff(np.append(new, len(element))))
    rows = np.arange(len(element))
    left, right = [], []
    k = 0
    while len(rows):
        k += 1
        rows = rows[rows + k < ends[rows]]
        # Sizes ascend along a list: once the next is too large, all are.
        other = rows + k
        near = 5 * n[rows] >= 4 * n[other]
        rows, other = rows[near], other[near]
        need = -(-4 * (n[rows] + n[other]) // 9)
        keep = (np.minimum(n[rows] - at[rows], n[other] - at[other]) >= need) & (before[rows] != before[other]) & (root[rows] != root[other]) & (side[rows] != side[other])
        left.append(own[rows[keep]])
        right.append(own[other[keep]])
    a, b = np.concatenate(left or [own[:0]]), np.concatenate(right or [own[:0]])
    return np.minimum(a, b), np.maximum(a, b)


def _whole(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[np.ndarray]]:
    """The columns of sorted batches, cut so that rows with one value of the first column are never parted."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        if held is not None:
            now = [np.concatenate([x, y]) for x, y in zip(held, now, strict=True)]
        # The last list may go on in the next batch.
        other = np.flatnonzero(now[0] != now[0][-1])
        last = int(other[-1]) + 1 if len(other) else 0
        if last:
            yield [x[:last] for x in now]
        held = [x[last:] for x in now]
    if held is not None:
        yield held


def _shared(lists: DataFrame) -> DataFrame:
    """The lists' rows without those of a class that stands in its list alone, and each once. Parts of frequent elements' lists stay whole."""
    columns = ["element", "class", "place", "before", "part", "usual"]

    def thinned(element, own, place, before, part, usual) -> pa.RecordBatch | None:
        # A class comes twice if two tasks had copies of its text.
        new = np.concatenate([[True], (element[1:] != element[:-1]) | (part[1:] != part[:-1]) | (own[1:] != own[:-1])])
        element, own, place, before, part, usual = (x[new] for x in (element, own, place, before, part, usual))
        same = element[1:] == element[:-1]
        keep = np.concatenate([[False], same]) | np.concatenate([same, [False]]) | (part > 0)
        if keep.any():
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (element, own, place, before, part, usual)], columns)
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now in _whole(batches, columns):
            out = thinned(*now)
            if out is not None:
                yield out

    return lists.repartition("element", "part").sortWithinPartitions("element", "part", "class").mapInArrow(run, "element long, class long, place long, before long, part int, usual int")


def _scan(lists: DataFrame, by: str) -> DataFrame:
    """Candidates (a, b) of lists that are whole in a task; `by` tells the list, and its rows follow each other by size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now in _whole(batches, [by, "class", "place", "before", "root", "side"]):
            a, b = _pairs(*now)
            if len(a):
                found = np.unique(np.stack([a, b], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0], pa.int64()), pa.array(found[:, 1], pa.int64())], ["a", "b"])

    return lists.select(by, "class", "place", "before", "root", "side").repartition(by).sortWithinPartitions(by, "place", "class").mapInArrow(run, "a long, b long")


def _wanted(keys: DataFrame, rows: int) -> np.ndarray:
    """A Bloom filter of the keys (one hash) of at most 2**26 bits, as an array of words. The driver gets no key, only words."""
    bits = 1 << min(26, max(20, int(16 * max(rows, 1)).bit_length()))
    words = keys.select(F.pmod("key", F.lit(bits)).alias("bit")).select(F.floor(F.col("bit") / 64).alias("word"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("v")).groupBy("word").agg(F.bit_or("v").alias("v"))
    got = words.toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[got.column("word").to_numpy()] = got.column("v").to_numpy()
    return out


def verify(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets link. classes: class and key of a text.

    A pair is told to the class that is in more pairs, its hub. The hub's text goes to every BLOCK of its spokes; texts of other
    classes than those asked for stay where they are, but for chance hits of a Bloom filter.
    """
    pairs = stored(pairs.select("a", "b").where("a <> b").distinct())
    degree = pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("degree"))
    of = lambda c: degree.select(F.col("class").alias(c), F.col("degree").alias(f"d{c}"))
    starred = pairs.join(of("a"), "a").join(of("b"), "b").select(F.when(F.col("da") >= F.col("db"), F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(F.col("da") >= F.col("db"), F.col("b")).otherwise(F.col("a")).alias("spoke"), F.greatest("da", "db").alias("degree"))
    salted = starred.select("hub", "spoke", F.pmod(F.xxhash64("spoke"), F.ceil(F.col("degree") / BLOCK)).cast("int").alias("salt"))
    asked = stored(salted.select("hub", "salt", F.lit(0).alias("role"), F.col("hub").alias("class")).distinct().unionAll(salted.select("hub", "salt", F.lit(1).alias("role"), F.col("spoke").alias("class"))).join(classes.select("class", "key"), "class"))
    bloom = docs.sparkSession.sparkContext.broadcast(_wanted(asked, asked.count()))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = bloom.value, set()
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            bit = keys % (64 * len(words))
            rows = []
            for i in np.flatnonzero((words[bit // 64] >> (bit % 64)) & 1).tolist():
                if (k := int(keys[i])) not in seen:
                    seen.add(k)
                    rows.append(i)
            if rows:
                yield batch.take(pa.array(rows))

    texts = _texts(docs).select("key", "text").mapInArrow(passed, "key long, text string")
    dealt = asked.join(texts, "key").select("hub", "salt", "role", "class", "text").repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for batch in slices(batches):
            found: list[tuple[int, int]] = []
            sets = shingle_hashes([t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()])
            for h, role, c, s in zip(batch.column("hub").to_pylist(), batch.column("role").to_pylist(), batch.column("class").to_pylist(), sets, strict=True):
                if _class(s) != c:
                    continue  # another text with the same key
                if role == 0:
                    hub, own = h, s
                elif h == hub:
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    if 9 * both >= 4 * (len(own) + len(s)):
                        found.append((min(h, c), max(h, c)))
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(compared, "a long, b long")


def _near_enough(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose bits do not rule a link out."""
    of = lambda c: classes.select(F.col("class").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("bitsa", "bitsb", "na", "nb")), strict=True)
            keep = pa.array([_may_link(a, b, na + nb) for a, b, na, nb in rows], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    return pairs.join(of("a"), "a").join(of("b"), "b").where("5 * least(na, nb) >= 4 * greatest(na, nb)").select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """class and root (the least class of its component) of every class that has a link, by alternating large and small stars."""
    edges = stored(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct())
    # Number of edges, and two hashes of 64 bits over all of them: equal marks are equal edges.
    mark = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.xxhash64("lo", "hi", F.lit(1)).cast("decimal(20,0)"))).first())
    was = mark(edges)
    while was[0]:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(least, "hi")
        small = moved.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionAll(moved.select("hi", F.col("m").alias("lo"))).distinct()
        before, edges = edges, stored(small)
        discard(before)
        now = mark(edges)
        if now == was:
            break
        was = now
    return edges.select(F.col("hi").alias("class"), F.col("lo").alias("root")).unionAll(edges.select(F.col("lo").alias("class"), F.col("lo").alias("root")).distinct())


def _lists(docs: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """Classes (class, n, key, least, bits), the rows of lists that classes share, and whether some lists are of frequent elements."""
    full = known.where("n > 0")
    classes = stored(full.groupBy("class").agg(F.first("n").alias("n"), F.min("key").alias("key"), F.first("least").alias("least"), F.first("bits").alias("bits")))
    elements = classes.select("class", "n", F.explode("least").alias("element"))
    counted = known.where("sample is not null").select("class", "sample").dropDuplicates(["class"]).select(F.explode("sample").alias("element")).groupBy("element").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    hot_rows = counted.orderBy(F.desc("n"), "element").limit(HOT).select("element")
    hot = np.sort(hot_rows.toArrow().column("element").to_numpy().view(np.uint64))
    return classes, stored(_shared(postings(docs, hot, boundary(elements)))), len(hot) > 0


def _candidates(rooted: DataFrame, frequent: bool) -> DataFrame:
    """Candidates (a, b) of all lists between classes of different roots. rooted: rows of lists with `root`."""
    found = _scan(rooted.where("part = 0").withColumn("side", F.col("class")), "element")
    if frequent:
        often = stored(rooted.where("part > 0").drop("part"))
        mixed = often.groupBy("element").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("rows")).where("x <> y").select("element", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))
        block = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
        spread = often.join(mixed, "element").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        crossed = spread.select(F.xxhash64("element", F.least("block", "other"), F.greatest("block", "other")).alias("list"), "class", "place", "before", "root", F.when(F.col("block") == F.col("other"), F.col("class")).otherwise(F.col("block").cast("long")).alias("side"))
        found = found.unionAll(_scan(crossed, "list"))
    return found.distinct()


def pairs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links: doc_id and class of every row with shingles, and every pair a < b of classes whose sets link.

    Copies share a class and are linked with each other besides. Unlike links() this leaves out no pair because it is connected
    already, so that a group of many different near copies costs, and yields, the square of its classes.
    """
    known = stored(profiles(docs))
    classes, shared, frequent = _lists(docs, known)
    found = _candidates(shared.withColumn("root", F.col("class")), frequent)
    return known.where("n > 0").select("doc_id", "class"), verify(docs, classes, _near_enough(found, classes))


def links(docs: DataFrame, known: DataFrame) -> DataFrame:
    """The component roots (class, root) of all classes with a link. known: stored profiles."""
    classes, shared, frequent = _lists(docs, known)
    # First links: in long lists to the set with the fewest elements of its own, which what was copied from it is nearest to.
    size = F.shiftright("place", 32)
    hubs = shared.groupBy("element").agg(F.min(F.struct("usual", size.alias("n"), "class")).alias("hub"), F.count("*").alias("rows")).where(F.col("rows") >= CROWD).select("element", "hub.class", "hub.n").toDF("element", "hub", "hub_n")
    near = shared.join(hubs, "element").where((F.col("class") != F.col("hub")) & (5 * F.least(size, "hub_n") >= 4 * F.greatest(size, "hub_n")))
    near = near.select(F.least("class", "hub").alias("a"), F.greatest("class", "hub").alias("b")).distinct()
    first = stored(verify(docs, classes, _near_enough(near, classes)))
    roots = stored(components(first))

    # What is connected already needs no further link.
    rooted = shared.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    found = _candidates(rooted, frequent)
    second = verify(docs, classes, _near_enough(found, classes))
    return components(roots.where("class <> root").select(F.col("class").alias("a"), F.col("root").alias("b")).unionAll(second))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    known = stored(profiles(docs))
    roots = links(docs, known)
    least = known.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    grouped = least.join(roots, "class", "left").select("class", "least", F.coalesce("root", "class").alias("root"))
    component = grouped.join(grouped.where("least is not null").groupBy("root").agg(F.min("least").alias("component_id")), "root", "left").select("class", "component_id")
    rows = known.select("doc_id", "n", F.when(F.col("n") > 0, F.col("class")).alias("class"))
    return rows.join(component, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def survivors(docs: DataFrame) -> DataFrame:
    """docs with one row of each group: that of the least id (then of the least hash of the text). Empty documents are no group and stay.

    Rows that are alone in their group pass where they are, told by a Bloom filter of the others; only those others, and chance
    hits, are shuffled with their texts.
    """
    known = stored(profiles(docs))
    roots = links(docs, known)
    last = (1 << 63) - 1
    rows = known.where("n > 0").join(roots, "class", "left").select(F.coalesce("doc_id", F.lit(last)).alias("__d"), F.col("key").alias("__k"), F.coalesce("root", "class").alias("group"))
    rows = stored(rows)
    groups = rows.groupBy("group").agg(F.min(F.struct("__d", "__k")).alias("kept"), F.count("*").alias("rows")).where("rows > 1")
    doubtful = stored(rows.join(groups, "group").select("__d", "__k", (F.struct("__d", "__k") == F.col("kept")).alias("kept")))
    bloom = docs.sparkSession.sparkContext.broadcast(_wanted(doubtful.select(F.col("__k").alias("key")), doubtful.count()))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # The table's own columns stand in a struct, whatever their names.
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(last)).alias("__d"), F.xxhash64(text).alias("__k"))

    def split(hit: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = bloom.value
            for batch in batches:
                bit = batch.column("__k").to_numpy(zero_copy_only=False) % (64 * len(words))
                keep = (((words[bit // 64] >> (bit % 64)) & 1) == 1) == hit
                if keep.any():
                    yield batch.filter(pa.array(keep))

        return marked.mapInArrow(run, marked.schema)

    judged = split(True).join(doubtful.groupBy("__d", "__k").agg(F.max("kept").alias("__kept"), F.count("*").alias("__times")), ["__d", "__k"], "left")
    stays = judged.where("__kept is null or __kept")
    repeated = F.coalesce("__times", F.lit(1)) > 1
    once = stays.where(repeated).dropDuplicates(["__d", "__k"]) if doubtful.where("kept").groupBy("__d", "__k").count().where("count > 1").limit(1).count() else None
    out = split(False).select("row").unionAll((stays.where(~repeated) if once is not None else stays).select("row"))
    return (out if once is None else out.unionAll(once.select("row"))).select("row.*")
