"""Frequent phrases and how strongly their words belong together, level by level (PCY and DHP).

A pass over the texts counts phrases of one length exactly and, of the phrases one
word longer, only hash buckets.  A phrase is counted exactly in the next pass if both
its shorter parts were found frequent and its bucket holds enough; both tests are
bitmaps of fixed size, the only thing that is broadcast, and can only let too much
through.  Exact counts follow for what they let through, so no result depends on a hash.

    pass n   positions whose (n-1)-word parts and whose bucket are frequent
               -> exact counts by (lang, phrase), summed in the task before the shuffle
               -> bucket counts of n+1 words, at neighbouring positions that passed

The first pass writes the texts down as blocks, each with its own words and their numbers,
so that later passes neither cut nor look up words again.

A task reports each of its phrases once, so a pass makes as many rows as tasks times
phrases.  Passes over the blocks therefore go in about one task a core, however many parts
the table has, and a task hands its counts on early only where it holds too many distinct
phrases; words that none of them has are forgotten first.

Bucket counts leave a task as slices of bytes that stop at 255 (or as whole numbers for
a larger threshold) and are summed slice by slice as a stream.  What a task holds is
bounded: its words by bytes, its phrases by rows, its buckets by their number.

Scores: each cut of a phrase into two parts gives floor(1000 * a * n / (l * r)), in exact
decimals; the lowest cut counts.  A phrase goes if a longer candidate that holds it occurs
as often: counts can only fall with length, so looking one word further is enough.

Cases: null and empty texts have no words; a null language is ``und``; words of a language
whose texts have none give no rows; repeated rows count each; ties go to the smallest cut,
and ranks by score, count and phrase in byte order; texts of any length are read whole;
other columns, of whatever name, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, broadcast_if_small, materialize, tidy

#: Most words of a phrase, least occurrences of a candidate, phrases reported of a language.
LONGEST, LEAST, TOP = 5, 100, 2000
#: log2 of the hash buckets of a pass, at least and at most (256 MB of a task), and of the bits that hold the frequent
#: phrases of the pass before.  Buckets that hold LEAST or more on the average let most phrases through to the exact
#: counts, so there are so many that it is a quarter, with a word in WORD_BYTES of text; results stay the same.
BUCKET_BITS, MOST_BUCKET_BITS, FREQUENT_BITS = 24, 26, 24
WORD_BYTES = 6
SLICES = 256
#: Phrases (of which half may be distinct) and bytes of distinct words that a task holds.
HELD_ROWS, HELD_BYTES = 1_000_000, 48 << 20
#: Most parts of the table that one task of a pass over the blocks takes.
TASK_PARTS = 32
#: Parts that a language's candidates are ranked in first.
RANK_PARTS = 16
ROWS = "kind int, slice int, bytes binary, words binary, lang string, phrase string, n long"
BUCKETS, PHRASES, TOTAL, BLOCK = 0, 1, 2, 3

#: Stands between pieces; no byte of UTF-8.
_EDGE = b"\xff"
_BYTES = bytes(0xFF if c in b".,;:!?\n\x0b\x0c\r" else 0x20 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


class _Words(dict):
    """Word -> number, 0 being the edge of a piece; ``hashes`` follows."""

    def __init__(self):
        import numpy as np

        self.words, self.size, self._new = [_EDGE], 0, [0]
        self._hashes = np.zeros(0, "uint64")
        self[_EDGE] = 0

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = number = len(self.words)
        self.words.append(word)
        self._new.append(xxhash.xxh3_64_intdigest(word))
        self.size += len(word) + 150
        return number

    @property
    def hashes(self):
        import numpy as np

        if self._new:
            self._hashes = np.concatenate([self._hashes, np.array(self._new, "uint64")])
            self._new = []
        return self._hashes


def _lang_seed(lang: str):
    import numpy as np
    import xxhash

    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))


def _longer(grams, words):
    """Hashes of phrases after one more word each; the first words come in with the language's seed."""
    import numpy as np

    h = (grams * np.uint64(0x9E3779B97F4A7C15)) ^ words
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _holds(bits, hashes, log2: int):
    """Which hashes' bits are set."""
    import numpy as np

    at = hashes >> np.uint64(64 - log2)
    return (bits[(at >> np.uint64(3)).astype("int64")] >> (np.uint8(7) - (at & np.uint64(7)).astype("uint8"))) & 1 == 1


def _row(kind: int, **columns):
    """Rows of one kind; what it does not have is null."""
    import pandas as pd

    return pd.DataFrame(dict.fromkeys(("slice", "bytes", "words", "lang", "phrase")) | {"kind": kind, "n": 0} | columns)


def _distinct(keys, columns):
    """(order, first places in it) of equal rows: by hash, and by the rows themselves should two share one."""
    import numpy as np

    order = np.argsort(keys, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    same = ~new[1:]
    if any((c[order[1:]][same] != c[order[:-1]][same]).any() for c in columns):
        order = np.lexsort(tuple(columns))
        new[1:] = reduce(np.logical_or, [c[order[1:]] != c[order[:-1]] for c in columns])
    return order, np.flatnonzero(new)


class _Counts:
    """Exact counts of the phrases of one task, kept as columns (hash, language, words, count)."""

    def __init__(self, n: int):
        self.n, self.blocks, self.rows = n, [], 0

    def add(self, keys, columns, counts=None) -> None:
        import numpy as np

        if not len(keys):
            return
        order, first = _distinct(keys, columns)
        made = np.diff(np.append(first, len(order))) if counts is None else np.add.reduceat(counts[order], first)
        at = order[first]
        self.blocks.append((keys[at], [c[at] for c in columns], made.astype("int64")))
        self.rows += len(at)

    def only_words(self, words: _Words) -> _Words:
        """The words of what is counted alone, numbered anew."""
        import numpy as np

        self.merge()
        used = np.unique(np.concatenate([c for _, columns, _ in self.blocks for c in columns[1:]] or [np.zeros(0, "int32")]))
        out = _Words()
        for i in used.tolist():
            out[words.words[i]]  # noqa: B018  numbered from 1 in this order
        self.blocks = [(keys, [columns[0], *((np.searchsorted(used, c) + 1).astype("int32") for c in columns[1:])], made) for keys, columns, made in self.blocks]
        return out

    def merge(self) -> None:
        import numpy as np

        blocks, self.blocks, self.rows = self.blocks, [], 0
        if blocks:
            self.add(np.concatenate([b[0] for b in blocks]), [np.concatenate([b[1][i] for b in blocks]) for i in range(self.n + 1)], np.concatenate([b[2] for b in blocks]))


def _pass(n: int, longest: int, least: int, logs: tuple[int, int], frequent, wanted):
    """A task's step of pass ``n``; ``frequent`` and ``wanted`` are broadcast bitmaps, none in pass 1."""

    def run(batches):
        import numpy as np

        frequent_log, bucket_log = logs[1], logs[0]
        before = np.frombuffer(frequent.value, "uint8") if n > 1 else None
        bucket = np.frombuffer(wanted.value, "uint8") if n > 1 else None
        buckets = np.zeros(1 << bucket_log, "uint32") if n < longest else None
        words, counts, langs, totals = _Words(), _Counts(n), {}, {}

        def phrases():
            counts.merge()
            names = list(langs)
            for _, columns, made in counts.blocks:
                lang, ids = columns[0].tolist(), list(zip(*[c.tolist() for c in columns[1:]], strict=True))
                for a in range(0, len(made), 50_000):
                    text = [b" ".join([words.words[i] for i in row]).decode() for row in ids[a : a + 50_000]]
                    yield _row(PHRASES, lang=[names[x] for x in lang[a : a + 50_000]], phrase=text, n=made[a : a + 50_000])
            counts.blocks, counts.rows = [], 0

        def cut(texts):
            split = _EDGE.join([t.translate(_BYTES) for t in texts]).replace(_EDGE, b" \xff ").split()
            return np.fromiter(map(words.__getitem__, split), "int32", len(split))

        def block(lang, ids):
            """The numbers once more, of the block's own words."""
            seen = np.bincount(ids) > 0
            own = (np.cumsum(seen) - 1).astype("int32")[ids]
            return _row(BLOCK, lang=[lang], words=[b" ".join([words.words[i] for i in np.flatnonzero(seen).tolist()])], bytes=[own.tobytes()])

        def reread(names, own):
            names = names.split(b" ")
            return np.fromiter(map(words.__getitem__, names), "int32", len(names))[np.frombuffer(own, "int32")]

        def read(lang, ids):
            if not len(ids):
                return
            own, hashes = langs.setdefault(lang, len(langs)), words.hashes[ids]
            live, gram = ids != 0, _longer(np.full(len(ids), _lang_seed(lang)), hashes)
            totals[lang] = totals.get(lang, 0) + int(live.sum())
            for k in range(2, n + 1):  # live: the phrases of k words that may be counted
                if len(live) < 2:
                    return
                if k == n:
                    live = live & _holds(before, gram, frequent_log)
                live = live[:-1] & live[1:]
                gram = _longer(gram[:-1], hashes[k - 1 :])
            if n > 1:
                live[live] = _holds(bucket, gram[live], bucket_log)
            at = np.flatnonzero(live)
            if n == 1:
                seen = np.bincount(ids, minlength=1)
                seen[0] = 0
                kinds = np.flatnonzero(seen)
                keys = _longer(np.full(len(kinds), _lang_seed(lang)), words.hashes[kinds])
                counts.add(keys, [np.full(len(kinds), own, "int32"), kinds.astype("int32")], seen[kinds])
            else:
                counts.add(gram[at], [np.full(len(at), own, "int32"), *(ids[at + i] for i in range(n))])
            if buckets is not None:
                at = at[:-1][np.diff(at) == 1]
                np.add.at(buckets, (_longer(gram[at], hashes[at + n]) >> np.uint64(64 - bucket_log)).astype("int64"), 1)

        for pdf in batches:
            if n == 1:
                for lang, texts in pdf.groupby("lang")["text"]:
                    ids = cut(texts.tolist())
                    if ids.any():
                        yield block(lang, ids)
                        read(lang, ids)
            else:
                for lang, names, own in zip(pdf["lang"], pdf["words"], pdf["bytes"], strict=True):
                    read(lang, reread(names, own))
            if counts.rows > HELD_ROWS:
                counts.merge()
                if counts.rows > HELD_ROWS // 2:
                    yield from phrases()
            if words.size > HELD_BYTES:
                if n > 1:
                    words = counts.only_words(words)
                if words.size > HELD_BYTES // 2:
                    yield from phrases()
                    words = _Words()
        yield from phrases()
        if totals and n == 1:
            yield _row(TOTAL, lang=list(totals), n=list(totals.values()))
        if buckets is not None:
            held = buckets.reshape(SLICES, -1)
            some = np.flatnonzero(held.any(axis=1))
            for a in range(0, len(some), 16):
                part = some[a : a + 16]
                yield _row(BUCKETS, slice=part, bytes=[(np.minimum(held[i], 255).astype("uint8") if least <= 255 else held[i]).tobytes() for i in part])

    return run


def _full_buckets(log2: int, least: int):
    """A task's step: of the slices' summed counts, one bit for each bucket that holds ``least``."""

    def run(batches):
        import numpy as np
        import pandas as pd

        sums: dict = {}
        for pdf in batches:
            for i, data in zip(pdf["slice"], pdf["bytes"], strict=True):
                if i not in sums:
                    sums[i] = np.zeros((1 << log2) // SLICES, "uint32")
                sums[i] += np.frombuffer(data, "uint8" if least <= 255 else "uint32")
        if sums:
            yield pd.DataFrame({"slice": list(sums), "bytes": [np.packbits(s >= least).tobytes() for s in sums.values()]})

    return run


def _frequent_bits(log2: int):
    """A task's step: the bits of its phrases' hashes, in slices."""

    def run(batches):
        import numpy as np
        import pandas as pd
        import xxhash

        bits = np.zeros(1 << log2, bool)
        for pdf in batches:
            for lang, phrase in zip(pdf["lang"], pdf["phrase"], strict=True):
                gram = np.full(1, _lang_seed(lang))
                for word in phrase.encode().split(b" "):
                    gram = _longer(gram, np.array([xxhash.xxh3_64_intdigest(word)], "uint64"))
                bits[int(gram[0]) >> (64 - log2)] = True
        held = np.packbits(bits).reshape(SLICES, -1)
        some = np.flatnonzero(held.any(axis=1))
        if len(some):
            yield pd.DataFrame({"slice": some, "bytes": [held[i].tobytes() for i in some]})

    return run


def _any_bits(batches):
    """A task's step: slices of one place, one over the other."""
    import numpy as np
    import pandas as pd

    bits: dict = {}
    for pdf in batches:
        for i, data in zip(pdf["slice"], pdf["bytes"], strict=True):
            own = np.frombuffer(data, "uint8")
            bits[i] = own | bits[i] if i in bits else own
    if bits:
        yield pd.DataFrame({"slice": list(bits), "bytes": [b.tobytes() for b in bits.values()]})


def _bitmap(slices: DataFrame, log2: int, reduce_step):
    """A broadcast bitmap of 2**log2 bits; at most SLICES rows of fixed size reach the driver."""
    width = (1 << log2) // 8 // SLICES
    whole = bytearray(width * SLICES)
    for row in slices.repartition("slice").mapInPandas(tidy(reduce_step), "slice int, bytes binary").collect():
        whole[row.slice * width : (row.slice + 1) * width] = row.bytes
    return slices.sparkSession.sparkContext.broadcast(bytes(whole))


def bucket_bits_for(size: int, least: int = LEAST) -> int:
    """log2 of the buckets for so many bytes of text."""
    wanted = 4 * size // (WORD_BYTES * max(1, least))
    return min(MOST_BUCKET_BITS, max(BUCKET_BITS, wanted.bit_length()))


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bucket_bits: int | None = None, frequent_bits: int = FREQUENT_BITS) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, n) of all phrases with ``least`` occurrences, (lang, n) of all words)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    if bucket_bits is None:
        bucket_bits = bucket_bits_for(texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0, least)
        if bucket_bits > BUCKET_BITS:  # fewer tasks by as much as their tables are larger
            texts = texts.coalesce(max(4 * spark.sparkContext.defaultParallelism, texts.rdd.getNumPartitions() >> (bucket_bits - BUCKET_BITS)))
    found, frequent, wanted = [], None, None
    for n in range(1, longest + 1):
        if n > 1:
            texts = texts.coalesce(max(spark.sparkContext.defaultParallelism, texts.rdd.getNumPartitions() // TASK_PARTS))
        rows = materialize(texts.mapInPandas(tidy(_pass(n, longest, least, (bucket_bits, frequent_bits), frequent, wanted)), ROWS), "phrases")
        if n == 1:
            texts = rows.where(F.col("kind") == BLOCK).select("lang", "words", "bytes")
            totals = materialize(rows.where(F.col("kind") == TOTAL).groupBy("lang").agg(F.sum("n").alias("n")), "words")
        same = rows.where(F.col("kind") == PHRASES).groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        found.append(materialize(same.select("lang", "phrase", F.lit(n).alias("words"), "n"), "frequent"))
        if n < longest:
            wanted = _bitmap(rows.where(F.col("kind") == BUCKETS).select("slice", "bytes"), bucket_bits, _full_buckets(bucket_bits, least))
            marks = found[-1].mapInPandas(tidy(_frequent_bits(frequent_bits)), "slice int, bytes binary")
            frequent = _bitmap(marks, frequent_bits, _any_bits)
    return spark.read.schema(found[0].schema).parquet(*[f._scratch for f in found]), totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, **bits) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two words and more."""
    counted, totals = frequent_phrases(docs, least, longest, **bits)
    split = F.split("phrase", " ")
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    phrases = counted.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), split.alias("w"))
    cuts = phrases.select("lang", "phrase", "words", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    of = lambda part, count: counted.select("lang", F.col("phrase").alias(part), F.col("n").alias(count))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]).join(broadcast_if_small(totals), "lang")
    whole = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    cuts = cuts.withColumn("above", F.lit(1000).cast("decimal(4,0)") * whole("a", 17) * whole("n", 17)).withColumn("below", whole("l", 18) * whole("r", 18))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(F.expr("above div below").alias("score"), "k", "l", "r", "a", "n")).alias("cut"))

    # a candidate inside one that is a word longer and as frequent
    longer = phrases.where("words > 2").select("lang", F.col("a").alias("over"), F.explode(F.array(part(F.lit(1), F.col("words") - 1), part(F.lit(2), F.col("words") - 1))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where("over IS NULL OR over < cut.a").select("lang", "phrase", "cut.*")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", *[F.col(c).cast("long").alias(c) if c != "phrase" else F.col(c) for c in ("rank", "phrase", "a", "l", "r", "n", "score")])
