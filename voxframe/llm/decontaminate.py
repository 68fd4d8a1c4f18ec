"""Benchmark decontamination by SimHash windows, in DataFrame functions only.

Texts become words (see ``licenses.words_line``) and 5-word shingles; an item or
window of fewer words is one shingle.  Windows have the lengths of items.  A window that
holds no shingle of any item of its length has similarity 0 with all of them, so windows
are placed where a shingle of the text is one of an item's, shifted by the shingle's place
in the item.  That is a prefilter of places alone: which item a place came from is
forgotten, and the index has to find it.

Windows and items get SimHash fingerprints of their weighted shingles (the weight is the
multiplicity), BLOCKS blocks of BLOCK_BITS bits.  Multi-index: fingerprints within RADIUS
of each other cannot differ in more than ``ALLOWED[i]`` bits in every block i, since the
bits that this would take, sum(ALLOWED) + BLOCKS, are more than RADIUS.  Items are listed
under every variant of each block with at most that many bits flipped; a window looks its
own blocks up under its length and so meets every item of its length within RADIUS.  Of
random pairs of fingerprints ``random_share()``, about 4 %, meet.  What the true Hamming
distance keeps is verified by weighted shingle similarity, the sum of the lesser over the
sum of the larger counts, compared in integers.

At similarity 0.8 the distance is 21.8 bits in the mean with a deviation of 4.3, so RADIUS
32 keeps more than 99 % of windows at the very threshold, and all but a few in 10^6 from
0.9 on; a passage has several windows.

Texts with windows are cut into stretches of STRETCH words, each with the words that its
last window needs, so that no row holds the windows of a whole long text.

Cases: null and empty texts have no windows; items without words match nothing; a
window is clipped at the text's ends; repeated rows and repeated items give one row
a (doc_id, item_id); ties go to the first window; a null doc_id is kept as an id of
its own; texts of any length are read whole; empty tables give no rows; extra columns are
ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.session import plain_unions

from .common import broadcast_if_small, fresh, materialize
from .licenses import _let, words_line

WORDS = 5
PERCENT = 80
#: 144 bits; a pair within RADIUS = sum(ALLOWED) + BLOCKS - 1 agrees so far in some block.
BLOCKS, BLOCK_BITS = 8, 18
ALLOWED = (4, 3, 3, 3, 3, 3, 3, 3)
RADIUS = sum(ALLOWED) + BLOCKS - 1
#: Blocks whose bits are drawn from one 64-bit hash of a shingle.
BLOCKS_A_HASH = 64 // BLOCK_BITS
#: Words of a stretch of text whose windows are made together.
STRETCH = 2048


def _hashes(text: Column) -> Column:
    """Hashes of a text's words; empty without words."""
    line = F.trim(words_line(text))
    return F.when(line == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(line, " "), lambda w: F.xxhash64(w)))


def _chain(a: Column, b: Column, shift: int) -> Column:
    return F.zip_with(a, F.slice(b, F.lit(shift + 1), F.greatest(F.size(b), F.lit(1))), lambda x, y: F.xxhash64(x, y))


def _shingles(words: Column, k: int) -> Column:
    """Hashes of the k-word shingles, in order; empty if there are fewer words."""

    def cut(grams: Column, n: Column) -> Column:
        return F.slice(grams, F.lit(1), F.greatest(n - (k - 1), F.lit(0)))

    def of(h: Column) -> Column:
        if k == 1:
            return h
        if k == 2:
            return cut(_chain(h, h, 1), F.size(h))
        if k == 3:
            return cut(_chain(_chain(h, h, 1), h, 2), F.size(h))
        four = _let(_chain(h, h, 1), lambda two: _chain(two, two, 2))
        return cut(four if k == 4 else _chain(four, h, 4), F.size(h))

    return _let(words, of)


def fingerprint(shingles: Column) -> Column:
    """SimHash as an array of BLOCKS ints of BLOCK_BITS bits; a bit is set if the weights' sum is above 0.

    The hashes are given once for each group of blocks that draws its bits from them.
    """

    def bit(hashes: Column, at: Column) -> Column:
        return F.aggregate(hashes, F.lit(0), lambda n, x: n + F.when(F.getbit(x, at) == 1, 1).otherwise(-1))

    def block(hashes: Column, j: int) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(BLOCK_BITS - 1)), F.lit(0), lambda v, b: v * 2 + F.when(bit(hashes, b + j * BLOCK_BITS) > 0, 1).otherwise(0))

    def group(g: int) -> Column:
        hashes = shingles if g == 0 else F.transform(shingles, lambda x: F.xxhash64(x, F.lit(g)))
        return _let(hashes, lambda h: F.array(*[block(h, j) for j in range(min(BLOCKS_A_HASH, BLOCKS - g * BLOCKS_A_HASH))]))

    return F.concat(*[group(g) for g in range(-(-BLOCKS // BLOCKS_A_HASH))])


def _variants(most: int) -> list[int]:
    """Masks of a block with at most ``most`` bits."""
    return sorted(sum(1 << b for b in bits) for n in range(most + 1) for bits in combinations(range(BLOCK_BITS), n))


def random_share() -> float:
    """Share of pairs of random fingerprints that meet in the index."""
    apart = 1.0
    for most in ALLOWED:
        apart *= 1 - len(_variants(most)) / 2**BLOCK_BITS
    return 1 - apart


def listed(items: DataFrame) -> DataFrame:
    """(length, block, value, item_id): every variant under which an item is found."""
    spark = items.sparkSession
    masks = None
    for most in sorted(set(ALLOWED)):  # 18-bit masks, made by Spark
        bits = spark.range(1 << BLOCK_BITS).where(F.bit_count("id") <= most)
        own = bits.select(F.col("id").cast("int").alias("mask"), F.explode(F.array(*[F.lit(i) for i, a in enumerate(ALLOWED) if a == most])).alias("block"))
        masks = own if masks is None else masks.unionByName(own)
    blocks = items.select(F.col("n_words").alias("length"), "item_id", F.posexplode("item_print").alias("block", "v"))
    return blocks.join(masks, "block").select("length", "block", F.col("v").bitwiseXOR(F.col("mask")).alias("value"), "item_id")


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def _shared(a: Column, b: Column) -> Column:
    """Sum over distinct shingles of the lesser count in the two arrays."""
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))


def items_of(benchmark: DataFrame, words: int = WORDS) -> DataFrame:
    """(item_id, n_words, k, item_shingles, item_print) of the items that have words."""
    rows = benchmark.select("item_id", _hashes(F.col("text").cast("string")).alias("w")).where(F.size("w") > 0)
    rows = rows.select("item_id", F.size("w").alias("n_words"), F.least(F.size("w"), F.lit(words)).alias("k"), "w")
    by_k = reduce(lambda c, k: c.when(F.col("k") == k, _shingles(F.col("w"), k)), range(1, words), F.when(F.col("k") == words, _shingles(F.col("w"), words)))
    rows = rows.withColumn("item_shingles", by_k).drop("w")
    return rows.withColumn("item_print", fingerprint(F.col("item_shingles")))


def find(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, start, n_words, hamming, similarity): the best window of each pair that verifies."""
    if not 1 <= words <= 5:
        raise ValueError("shingles have one to five words")
    plain_unions(docs.sparkSession)
    items = materialize(items_of(benchmark, words), "items")
    anchors = items.select("item_id", "k", "n_words", F.posexplode("item_shingles").alias("q", "shingle")).distinct()
    anchors = materialize(anchors, "anchors")
    kinds = sorted(r["k"] for r in anchors.select("k").distinct().collect())  # at most five values
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if not kinds:
        kinds = [words]
    # where windows stand
    hashed = rows.select("doc_id", _hashes(F.col("text")).alias("w"))
    places = reduce(DataFrame.unionByName, (hashed.select("doc_id", F.lit(k).alias("k"), F.posexplode(_shingles(F.col("w"), k)).alias("p", "shingle")) for k in kinds))
    windows = places.join(broadcast_if_small(anchors), ["k", "shingle"]).select("doc_id", "k", "n_words", (F.col("p") - F.col("q")).alias("start")).distinct()
    windows = windows.withColumn("part", F.floor(F.greatest(F.col("start"), F.lit(0)) / STRETCH).cast("int"))
    spots = materialize(windows.groupBy("doc_id", "part").agg(F.collect_list(F.struct("k", "n_words", "start")).alias("spots")), "spots")
    # their shingles and fingerprints, stretch by stretch
    longest = items.agg(F.coalesce(F.max("n_words"), F.lit(0))).first()[0]
    with_spots = materialize(spots.groupBy(F.col("doc_id").alias("_doc")).agg(F.array_sort(F.collect_list("part")).alias("parts")), "spotted")
    near = rows.join(broadcast_if_small(with_spots), F.col("doc_id").eqNullSafe(F.col("_doc"))).select("doc_id", "parts", _hashes(F.col("text")).alias("w"))
    cuts = F.transform("parts", lambda i: F.struct(i.alias("part"), F.slice("w", i * STRETCH + 1, F.lit(STRETCH + longest)).alias("w")))
    near = near.select("doc_id", F.explode(cuts).alias("s")).select("doc_id", "s.*").distinct()
    near = near.join(spots.withColumnsRenamed({"doc_id": "_doc", "part": "_part"}), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("part") == F.col("_part")))
    by_k = F.array(*[_shingles(F.col("w"), k) for k in range(1, words + 1)])
    near = near.select("doc_id", "part", "spots", by_k.alias("grams")).select("doc_id", "part", "grams", F.explode("spots").alias("s")).select("doc_id", "part", "grams", "s.*")
    first = F.greatest(F.col("start"), F.lit(0))
    length = F.col("start") + F.col("n_words") - F.col("k") + 1 - first
    cut = near.where(length > 0).select("doc_id", "n_words", first.alias("start"), F.slice(F.get("grams", F.col("k") - 1), first - F.col("part") * STRETCH + 1, length).alias("shingles")).where(F.size("shingles") > 0)
    window = F.xxhash64("doc_id", "n_words", "start", "shingles").alias("window")
    prints = materialize(cut.distinct().withColumn("print", fingerprint(F.col("shingles"))).withColumn("window", window), "prints")
    # multi-index: blocks of windows against all near variants of the blocks of items of that length
    asked = prints.select("window", F.col("n_words").alias("length"), F.posexplode("print").alias("block", "value")).distinct()
    pairs = asked.join(materialize(listed(items), "index"), ["length", "block", "value"]).select("window", "item_id").distinct()
    found = prints.join(pairs, "window")
    texts = items.select(F.col("item_id").alias("_item"), "item_shingles", "item_print")
    found = found.join(broadcast_if_small(texts), F.col("item_id").eqNullSafe(F.col("_item"))).withColumn("hamming", hamming(F.col("print"), F.col("item_print"))).where(F.col("hamming") <= RADIUS)
    lesser = _shared(F.col("shingles"), F.col("item_shingles"))
    found = found.withColumn("_lesser", lesser).withColumn("_larger", F.size("shingles") + F.size("item_shingles") - F.col("_lesser"))
    found = found.where(F.col("_lesser") * 100 >= F.col("_larger") * percent).withColumn("similarity", F.col("_lesser") / F.col("_larger"))
    best = F.struct(F.col("similarity"), (-F.col("start")).alias("before"), F.col("n_words"), F.col("hamming"))
    best = found.groupBy("doc_id", "item_id").agg(F.max(best).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.before")).cast("long").alias("start"), F.col("b.n_words").cast("long").alias("n_words"), F.col("b.hamming").cast("long").alias("hamming"), "b.similarity")


def clean(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents that no item is found in."""
    (leak,) = fresh(docs, "_leak")
    leaks = find(docs, benchmark, words, percent).select(F.col("doc_id").alias(leak)).distinct()
    return docs.join(broadcast_if_small(materialize(leaks, "leaks")), F.col("doc_id").eqNullSafe(F.col(leak)), "left_anti")
