"""Corpus hygiene: duplicate families, splits by family, leakage, admission, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.sources.storage import discard, stored


def normal_hash(text: Column) -> Column:
    """Hash of the text with white space squeezed and ASCII letters lower-cased."""
    folded = F.translate(T.squeezed(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.sha2(folded.cast("binary"), 256)


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """Hashes that several documents share: first id, number of copies."""
    return docs.select("doc_id", normal_hash(F.col("text")).alias("hash")).groupBy("hash").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")).where("copies > 1")


def families(docs: DataFrame) -> DataFrame:
    """doc_id, family (the least id with the same normalised text). One row of each hash is joined back, so a hot hash is split by the optimizer."""
    keyed = docs.select("doc_id", "lang", normal_hash(F.col("text")).alias("hash"))
    return keyed.join(keyed.groupBy("hash").agg(F.min("doc_id").alias("family")), "hash").select("doc_id", "lang", "family")


def split_of(family: Column, seed: int = 17) -> Column:
    """train, dev or test in the proportion 70:15:15, the same for a whole family."""
    bucket = F.pmod(F.crc32(F.concat(family.cast("string"), F.lit(f":{seed}")).cast("binary")), F.lit(100))
    return F.when(bucket < 70, "train").when(bucket < 85, "dev").otherwise("test")


def _shingled(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, s (the sorted set of hashed word shingles; shorter texts are one shingle), class (a hash of the set). Without null texts."""
    # The words are a column of their own: inside the lambda they would be split anew for every shingle.
    worded = docs.where("text is not null").select("doc_id", T.tokens(F.lower("text")).alias("t"))
    tokens = F.col("t")
    shingles = F.when(F.size(tokens) >= words, F.transform(F.sequence(F.lit(0), F.size(tokens) - words), lambda i: F.xxhash64(F.array_join(F.slice(tokens, i + 1, words), " ")))).otherwise(F.array(F.xxhash64(F.array_join(tokens, " "))))
    sets = worded.select("doc_id", F.sort_array(F.array_distinct(shingles)).alias("s"))
    return sets.select("doc_id", "s", F.xxhash64("s").alias("class"))


def _alike(docs: DataFrame, classes: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets have a Jaccard similarity of at least 0.8, told by the whole sets."""
    pairs = stored(pairs)
    asked = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(classes.select("class", F.col("rep").alias("doc_id")), "class")
    sets = stored(_shingled(docs.join(asked.select("doc_id").distinct(), "doc_id"), words).join(asked, ["class", "doc_id"]).dropDuplicates(["class"]).select("class", "s"))
    of = lambda c: sets.select(F.col("class").alias(c), F.col("s").alias(f"s{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return both.where(9 * F.size(F.array_intersect("sa", "sb")) >= 4 * (F.size("sa") + F.size("sb"))).select("a", "b")


def _components(links: DataFrame) -> DataFrame:
    """class and root (the least class of its component) of every class that has a link, by alternating large and small stars."""
    edges = stored(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct())
    # Number of edges, and two hashes of 64 bits over all of them: equal marks are equal edges.
    mark = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.xxhash64("lo", "hi", F.lit(1)).cast("decimal(20,0)"))).first())
    was = mark(edges)
    while was[0]:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        moved = large.join(large.groupBy("hi").agg(F.min("lo").alias("m")), "hi")
        before, edges = edges, stored(moved.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionAll(moved.select("hi", F.col("m").alias("lo"))).distinct())
        discard(before)
        now = mark(edges)
        if now == was:
            break
        was = now
    return edges.select(F.col("hi").alias("class"), F.col("lo").alias("root")).unionAll(edges.select(F.col("lo").alias("class"), F.col("lo").alias("root")).distinct())


def _near(docs: DataFrame, bands: int, rows: int, words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """doc_id and class of every document; class and root of classes with a link; band, key and class of bands that classes share.

    MinHash bands give the candidates, whole sets of shingles decide. A band's classes are first held against one of them; after
    that only classes of a band that are not connected yet are held against each other, each pair once.
    """
    hashed = _shingled(docs, words)
    least = [F.array_min(F.transform("s", _remixed(k))) for k in range(bands * rows)]
    keyed = hashed.select("doc_id", "class", F.size("s").alias("n"), F.array(*least).alias("m"))
    known = stored(keyed.select("doc_id", "class", "n", F.array(*[F.xxhash64(*[F.col("m")[b * rows + i] for i in range(rows)]) for b in range(bands)]).alias("keys")))
    classes = stored(known.groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys")))
    banded = classes.select("class", "n", F.posexplode("keys").alias("band", "key"))
    hubs = banded.groupBy("band", "key").agg(F.min(F.struct(F.xxhash64("class", "band").alias("h"), F.col("class").alias("hub"), F.col("n").alias("hub_n"))).alias("hub"), F.count("*").alias("c")).where("c > 1")
    shared = stored(banded.join(hubs.select("band", "key", "hub.hub", "hub.hub_n"), ["band", "key"]))
    first = stored(shared.where("class <> hub and 5 * least(n, hub_n) >= 4 * greatest(n, hub_n)").select(F.least("class", "hub").alias("a"), F.greatest("class", "hub").alias("b")).distinct())
    linked = stored(_alike(docs, classes, first, words))
    roots = _components(linked)
    rooted = shared.join(roots, "class", "left").select("band", "key", "class", "n", F.coalesce("root", "class").alias("root"))
    mixed = rooted.groupBy("band", "key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("band", "key")
    open_ = stored(rooted.join(mixed, ["band", "key"]))
    other = open_.select("band", "key", F.col("class").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"))
    crossed = open_.withColumnRenamed("class", "a").join(other, ["band", "key"]).where("a < b and root <> rb and 5 * least(n, nb) >= 4 * greatest(n, nb)")
    second = _alike(docs, classes, crossed.select("a", "b").distinct().join(first, ["a", "b"], "left_anti"), words)
    return known.select("doc_id", "class"), stored(_components(linked.unionAll(second))), shared.select("band", "key", "class")


def near_families(docs: DataFrame, bands: int = 8, rows: int = 2, words: int = 5) -> DataFrame:
    """doc_id and family of every document: the least id of the documents that a chain of near copies connects, else its own."""
    known, roots, _ = _near(docs, bands, rows, words)
    out = _with_family(known, roots).select("doc_id", "family")
    return out.unionByName(docs.where("text is null").select("doc_id", F.col("doc_id").alias("family")))


def _with_family(known: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, class, family, documents (of the family). A family's rows are merged by class before they meet."""
    least = known.groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    found = least.join(least.groupBy("root").agg(F.min("least").alias("family"), F.sum("n").alias("documents")), "root").select("class", "family", "documents")
    return known.join(found, "class")


def near_duplicate_families(docs: DataFrame, bands: int = 8, rows: int = 2, words: int = 5) -> DataFrame:
    """doc_id, family and shared_bands of documents that are not alone in their family: in so many bands another of the family has the same key.

    Families are the connected components of documents whose sets of word shingles have a Jaccard similarity of at least 0.8.
    """
    known, roots, shared = _near(docs, bands, rows, words)
    found = stored(_with_family(known, roots).where("documents > 1"))
    copies = found.groupBy("class", "family").agg(F.count("*").alias("n"))
    held = shared.join(copies, "class")
    together = held.groupBy("band", "key", "family").agg(F.count("*").alias("classes")).where("classes > 1")
    counted = held.join(together, ["band", "key", "family"]).groupBy("class").agg(F.count("*").alias("bands"))
    # Copies share all bands.
    per = copies.join(counted, "class", "left").select("class", F.when(F.col("n") > 1, bands).otherwise(F.coalesce("bands", F.lit(0))).cast("long").alias("shared_bands"))
    return found.join(per, "class").select("doc_id", "family", "shared_bands")


def _remixed(k: int):
    return lambda h: F.xxhash64(h, F.lit(k))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id of documents that hold a benchmark item's text whole.

    Both sides meet in the item's second to seventh word, or as many as it has between its first and its last - these two may be
    glued to what stands around them - so that no document is held against every item; containment follows. An item of one or two
    words has no word inside: it is found where its words are words of the text. Items without any word are in no document.
    Hashes of windows alone are shuffled; texts come back for the pairs that met.
    """
    most = 6
    flat = lambda c: F.filter(F.split(F.regexp_replace(c, "\n", " "), " "), lambda w: w != "")
    inner = F.when(F.size("w") > 2, F.least(F.size("w") - 2, F.lit(most))).otherwise(F.size("w"))
    item = stored(benchmark.select("item_id", F.col("text").alias("item"), flat("text").alias("w")).where("size(w) > 0").withColumn("words", inner))
    keys = item.select("item_id", "words", F.xxhash64("words", F.array_join(F.slice("w", F.when(F.size("w") > 2, 2).otherwise(1), F.col("words")), " ")).alias("h"))
    # Only lengths that some item has are cut from the documents: at most `most`.
    lengths = sorted(r.words for r in keys.select("words").distinct().collect())
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.size("t") - n + 1), lambda i: F.xxhash64(F.lit(n), F.array_join(F.slice("t", i, n), " ")))
    none = F.expr("cast(array() as array<bigint>)")
    told = docs.where("text is not null").select("doc_id", flat("text").alias("t"))
    windows = told.select("doc_id", F.explode(F.array_distinct(F.concat(none, *[F.when(F.size("t") >= n, cut(n)).otherwise(none) for n in lengths]))).alias("h"))
    # The items' keys are bounded by the benchmark, whose size is checked before they are broadcast.
    side = F.broadcast(keys) if item.count() <= 100_000 else keys
    met = windows.join(side, "h").select("doc_id", "item_id").distinct()
    texts = met.join(docs.select("doc_id", "text"), "doc_id").join(item.select("item_id", "item"), "item_id")
    return texts.where(F.contains("text", "item")).select("doc_id", "item_id").distinct()


def quota_sample(rows: DataFrame, strata: list[str], key: str, quota: int) -> DataFrame:
    """At most `quota` rows of each stratum, by an order that depends on the key alone. The limit is the feature."""
    order = F.crc32(F.col(key).cast("string").cast("binary"))
    return rows.withColumn("pick", F.row_number().over(Window.partitionBy(*strata).orderBy(order, key))).where(F.col("pick") <= quota)
