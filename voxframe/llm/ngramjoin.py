"""N-gram Jaccard join in size-banded tiles.

A document is its set of distinct 3-word shingles (64-bit hashes).  Sizes fall into
bands; a tile is a band and the next, so that every pair that can link lies in the
tile of its smaller member.  In a tile, hashing cuts the shingle space into one part
more than the largest symmetric difference that a linked pair can have; so a linked
pair agrees wholly on at least one part, and documents meet by (tile, part, sum of
the part's hashes).

1. Documents with one set are one node, which is emitted once a task.
2. Nodes that meet form runs; runs with the same members are kept once, and one over
   BLOCK nodes is dealt in chunks.  Signatures that very many nodes share are found by a
   look at one node in 64 and are dealt by node, not by signature, so that none of them
   fills a task; a signature that the look misses takes the common way, to the same result.
3. In a chunk, hashed parity bitmaps are compared: the bits in which two bitmaps
   differ bound the symmetric difference from below, so the overlap from above.  A
   search over the pairs that the bound lets pass compares a node only with those not
   reached yet, so a family of near copies takes about one step a node; a spanning
   forest is handed on, never all pairs.
4. Chunks of one run then meet by rounds (``connect``): first one node of each tree, in
   fewer and fewer chunks, then the nodes outside the run's largest tree against the rest.
   So a family that hangs together is sent once, and only what is not connected is sent
   to other chunks: rows handed on are N * (1 + R / BLOCK) for R nodes outside.
5. Components of these forests are clusters, outside of which no link exists.  In each
   cluster (in chunks of bounded bytes, which meet in the same rounds) pairs that pass the
   bound and are not yet connected are settled by exact intersection of sorted arrays.
6. Components of the exact links are the result.

A set's identity has 128 bits: should two sets share the 64 that name a node, the later
one is named anew.  No cap on partners or candidates.

Cases: null and empty texts, and texts without words, have no shingles and link with
nothing; with fewer words than n the whole sequence is the one shingle; repeated rows
are one node; a null doc_id keeps its row, and is its component only if alone (texts are
found again by doc_id and digest, so null ids do not multiply); an
empty table gives no rows; extra columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, broadcast_if_small, claim, components, discard, ids_of, keyed_texts, longs, materialize, tidy
from .tokens import _Pieces

N = 3
#: Links need PART * |both| >= WHOLE-th share of the union: 100 i >= 90 u.
SHARE = 90
BLOCK = 4096
BLOCK_BYTES = 48 << 20
LEAST_BITS, MOST_BITS = 64, 8192
#: One node in LOOK is looked at for signatures of BLOCK nodes or more.
LOOK = 64


@lru_cache(maxsize=64)
def edges(share: int, top: int = 1 << 40) -> tuple[int, ...]:
    """First sizes of the bands: a partner's size is in the same band or the next."""
    out = [1]
    while out[-1] < top:
        out.append(out[-1] * 100 // share + 1)
    return tuple(out)


def band_of(n: int, share: int) -> int:
    from bisect import bisect_right

    return bisect_right(edges(share), n) - 1


def most_apart(a: int, b: int, share: int) -> int:
    """Largest symmetric difference of linked sets of sizes a and b."""
    return (a + b) * (100 - share) // (100 + share)


def parts_of(tile: int, share: int) -> int:
    """Parts of a tile: its smaller member is of the lower band."""
    low = edges(share)[tile + 1] - 1
    return most_apart(low, low * 100 // share, share) + 1


def bits_of(tile: int, share: int) -> int:
    bits = LEAST_BITS
    while bits < MOST_BITS and bits < edges(share)[tile + 1]:
        bits *= 2
    return bits


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of the cache of word hashes in a worker.
WORD_BYTES = 24 << 20
_words: _Pieces | None = None
#: Signatures and rows in a batch that leaves a worker.
OUT_KEYS, OUT_ROWS = 100_000, 1000


def _forget() -> None:
    global _words
    _words = None


def shingles(text: str | None, n: int = N):
    """Sorted distinct hashes of a text's n-word shingles; words lower-cased A-Z, cut at ASCII white space."""
    import numpy as np
    import xxhash

    global _words
    if _words is None:
        _words = _Pieces(xxhash.xxh3_64_intdigest, WORD_BYTES)
        claim("words", _forget)
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "uint64")
    h = np.fromiter(map(_words.__getitem__, words), "uint64", len(words))
    if len(h) < n:
        h = np.concatenate((h, np.full(n - len(h), len(h), "uint64")))
    x = np.zeros(len(h) - n + 1, "uint64")
    for i in range(n):
        x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i] + np.uint64(i + 1))
    return np.unique(x)


def parity(x, bits: int):
    """Bitmap of the parities of hash cells, as bytes."""
    import numpy as np

    return np.packbits(np.bincount((_mix(x + np.uint64(77)) % np.uint64(bits)).astype("int64"), minlength=bits).astype("uint8") & 1)


def signatures(x, tile: int, share: int):
    """Signed keys of the tile's parts; the lowest bit tells the tile's parity."""
    import numpy as np

    k = parts_of(tile, share)
    if tile < 0 or k < 2:
        return np.zeros(0, "int64")
    sums = np.zeros(k, "uint64")
    np.add.at(sums, (_mix(x + np.uint64(5)) % np.uint64(k)).astype("int64"), _mix(x + np.uint64(9)))
    keys = _mix(_mix(sums + np.arange(k, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(tile))
    return ((keys & ~np.uint64(1)) | np.uint64(tile & 1)).view("int64")


def _one(x, plus: int) -> int:
    """Signed 64-bit hash of a multiset of hashes."""
    import numpy as np

    h = int(_mix(_mix(x).sum(dtype="uint64", keepdims=True) + np.uint64(plus))[0])
    return h - (h >> 63 << 64)


#: Flips bits of hashes for the second half of an identity.
FLIP = 0x5851F42D4C957F2D


def _node(x) -> tuple[int, int]:
    """A set's name and the other half of its identity."""
    return _one(x, len(x)), _one(x ^ x.dtype.type(FLIP), len(x) + 1)


_READ = "doc_id long, mark long, n_shingles long, node long, other long, keys array<long>, even binary, odd binary"


def _read(n: int, share: int):
    def read(batches):
        import numpy as np

        seen: set[tuple[int, int]] = set()
        rows: list[tuple] = []
        held = 0

        def frame():
            nonlocal rows, held
            out = pd.DataFrame(rows, columns=["doc_id", "mark", "n_shingles", "node", "other", "keys", "even", "odd"], dtype=object)
            rows, held = [], 0
            return out.assign(**{c: longs(out[c].tolist()) for c in ("doc_id", "node", "other")})

        for pdf in batches:
            for doc, mark, text in zip(ids_of(pdf), pdf["mark"].tolist(), pdf["text"], strict=True):
                x = shingles(text, n)
                if not len(x):
                    rows.append((doc, mark, 0, None, None, None, None, None))
                    continue
                node = _node(x)
                if node in seen:
                    rows.append((doc, mark, len(x), *node, None, None, None))
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(node)
                band = band_of(len(x), share)
                keys = np.concatenate([signatures(x, band - 1, share) if band else np.zeros(0, "int64"), signatures(x, band, share)])
                maps = {t & 1: parity(x, bits_of(t, share)).tobytes() for t in (band - 1, band) if t >= 0}
                rows.append((doc, mark, len(x), *node, keys, maps.get(0), maps.get(1)))
                held += len(keys)
                if held > OUT_KEYS or len(rows) >= OUT_ROWS:
                    yield frame()
        if rows:
            yield frame()

    return read


def _runs(batches):
    """(run, node, chunk, odd) from (key, node) in key order: keys with two nodes or more."""
    import numpy as np

    sent: set[int] = set()
    key, nodes, chunk, n = None, [], 0, 0

    def close():
        nonlocal nodes, chunk
        own = np.array(nodes, "int64")
        if chunk or len(own) > 1:
            if chunk:
                run = key
            else:
                run = _one(own.view("uint64"), key & 1)
                if run in sent:
                    return None
                if len(sent) > 100_000:
                    sent.clear()
                sent.add(run)
            return pd.DataFrame({"run": run, "node": own, "chunk": chunk, "odd": bool(key & 1)})
        return None

    out, held = [], 0
    for pdf in batches:
        ks, vs = pdf["key"].to_numpy("int64"), pdf["node"].to_numpy("int64")
        if not len(ks):
            continue
        fresh = np.concatenate(([True], (ks[1:] != ks[:-1]) | (vs[1:] != vs[:-1])))
        ks, vs = ks[fresh], vs[fresh]
        cuts = np.flatnonzero(np.concatenate(([True], ks[1:] != ks[:-1])))
        sizes = np.diff(np.append(cuts, len(ks)))
        for i in [0, *(np.flatnonzero(sizes[1:-1] > 1) + 1).tolist(), *([len(cuts) - 1] if len(cuts) > 1 else [])]:
            k, own = int(ks[cuts[i]]), vs[cuts[i] : cuts[i] + sizes[i]].tolist()
            if k != key:
                if key is not None and (df := close()) is not None:
                    out.append(df)
                    held += len(df)
                key, nodes, chunk = k, [], 0
            if nodes and own and nodes[-1] == own[0]:
                own = own[1:]
            nodes += own
            while len(nodes) > BLOCK:  # a full chunk of a large run
                out.append(pd.DataFrame({"run": key, "node": np.array(nodes[:BLOCK], "int64"), "chunk": chunk, "odd": bool(key & 1)}))
                held += BLOCK
                nodes, chunk = nodes[BLOCK:], chunk + 1
        if held > 20_000:
            yield pd.concat(out)
            out, held = [], 0
    if key is not None and (df := close()) is not None:
        out.append(df)
    if out:
        yield pd.concat(out)


def forest(sizes, maps, side, share: int, verify=None):
    """Index pairs of a spanning forest of the pairs that the bitmap bound lets pass.

    ``side`` is None to compare all, or a mask: only pairs across it are compared.
    ``verify(i, j)`` settles a pair exactly.  Each node in turn is compared with the nodes
    that no tree has reached yet, so every pair is compared or already connected.
    """
    import numpy as np

    rest, words = np.arange(len(sizes)), np.ascontiguousarray(maps).view("uint64")
    bits, size, across = words, sizes, side
    out = []
    while len(rest):
        queue, rest, bits, size = [int(rest[0])], rest[1:], bits[1:], size[1:]
        across = None if side is None else across[1:]
        while queue and len(rest):
            i = queue.pop()
            apart = np.bitwise_count(bits ^ words[i]).sum(1, dtype="int64")
            ok = (apart * (100 + share) <= (size + sizes[i]) * (100 - share)) & (np.minimum(size, sizes[i]) * 100 >= np.maximum(size, sizes[i]) * share)
            if side is not None:
                ok &= across != side[i]
            at = np.flatnonzero(ok)
            if verify is not None:
                at = np.array([k for k in at[np.argsort(apart[at], kind="stable")].tolist() if verify(i, int(rest[k]))], "int64")
            if len(at):
                near = rest[at].tolist()
                out += [(i, j) for j in near]
                queue += near
                left = np.ones(len(rest), bool)
                left[at] = False
                rest, bits, size = rest[left], bits[left], size[left]
                across = None if side is None else across[left]
    return out


def _groups(batches, keys: list[str]):
    """Frames of equal keys from batches in key order."""
    held = None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        ids = pdf[keys].ne(pdf[keys].shift()).any(axis=1).cumsum().to_numpy()
        last = ids[-1]
        cut = int((ids != last).sum())
        if cut:
            for _, group in pdf.iloc[:cut].groupby(ids[:cut], sort=False):
                yield group
        held = pdf.iloc[cut:]
    if held is not None and len(held):
        yield held


def _bounded(share: int):
    def run(batches):
        import numpy as np

        out = []
        for g in _groups(batches, ["run", "i", "j"]):
            g = g.drop_duplicates("node")
            odd = bool(g["odd"].iloc[0])
            i, j = int(g["i"].iloc[0]), int(g["j"].iloc[0])
            maps = g["odd_map" if odd else "even_map"].tolist()
            sizes, nodes = g["n_shingles"].to_numpy("int64"), g["node"].to_numpy("int64")
            width = len(maps[0])
            fine = np.array([len(x) == width for x in maps])  # a hash clash between tiles
            maps = np.stack([np.frombuffer(x, "uint8") for x, f in zip(maps, fine, strict=True) if f])
            side = None if i == j else (g["chunk"].to_numpy()[fine] == i)
            nodes = nodes[fine]
            out += [(nodes[a], nodes[b]) for a, b in forest(sizes[fine], maps, side, share)]
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=["a", "b"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["a", "b"])

    return run


def _sets(n: int):
    def read(batches):
        for pdf in batches:
            rows = []
            for text, node, other, run, blocks in zip(pdf["text"], pdf["node"], pdf["other"], pdf["run"], pdf["blocks"], strict=True):
                x = shingles(text, n)
                if len(x) and _node(x)[1] == other:  # not another text of this doc_id with an equal digest
                    own = x.tobytes()
                    rows += [(run, b["i"], b["j"], b["chunk"], node, own) for b in blocks]
            yield pd.DataFrame(rows, columns=["run", "i", "j", "chunk", "node", "shingles"])

    return read


def _exact(share: int):
    def run(batches):
        import numpy as np

        out = []
        for g in _groups(batches, ["run", "i", "j"]):
            g = g.drop_duplicates("node")
            sets = [np.frombuffer(x, "uint64") for x in g["shingles"]]
            sizes, nodes = np.array([len(x) for x in sets], "int64"), g["node"].to_numpy("int64")
            bits = LEAST_BITS
            while bits < MOST_BITS and bits < 2 * int(np.median(sizes)):
                bits *= 2
            maps = np.stack([parity(x, bits) for x in sets])
            side = None if g["i"].iloc[0] == g["j"].iloc[0] else (g["chunk"] == g["i"]).to_numpy()

            def linked(a: int, b: int, sets=sets, sizes=sizes) -> bool:
                x, y = sets[a], sets[b]
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                return 100 * both >= share * int(sizes[a] + sizes[b] - both)

            out += [(nodes[a], nodes[b]) for a, b in forest(sizes, maps, side, share, linked)]
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=["a", "b"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["a", "b"])

    return run


def connect(members: DataFrame, meet, step, first: DataFrame | None = None) -> DataFrame:
    """(node, component) of what ``step`` links in each run of ``members`` (run, node, chunk, chunks).

    ``meet`` takes (run, i, j, node, chunk): nodes of one (run, i, j) are compared in one
    task, all with all if i = j, else those of chunk i with those of chunk j.  ``first`` is
    what it gives for each chunk by itself.
    """
    if first is None:
        first = meet(members.select("run", F.col("chunk").alias("i"), F.col("chunk").alias("j"), "node", "chunk"))
    found = components(first, step)
    large = members.where("chunks > 1").select("run", "node", "chunk")
    if not large.limit(1).count():
        return found

    def joined(blocks: DataFrame) -> DataFrame:
        """The components so far, with what the blocks add."""
        more = materialize(meet(blocks).mapInPandas(tidy(step), "a long, b long"), "ngram-links")
        stars = found.select(F.col("component").alias("a"), F.col("node").alias("b"))
        out = components(stars.unionByName(more))
        discard(found, more)
        return out

    named = lambda: large.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = None
    while True:  # one node of each tree of a run
        heads = named().groupBy("run", "component").agg(F.min("node").alias("node"))
        sizes = heads.groupBy("run").agg(F.count("*").alias("n")).where("n > 1")
        heads = materialize(heads.join(sizes, "run").select("run", "node", F.pmod(F.xxhash64("node", "run"), F.ceil(F.col("n") / BLOCK)).cast("int").alias("chunk")), "ngram-heads")
        n = heads.count()
        if not n or (least is not None and 2 * n > least):
            break
        least = n
        found = joined(heads.select("run", F.col("chunk").alias("i"), F.col("chunk").alias("j"), "node", "chunk"))
        discard(heads)
    discard(heads)
    if not n:
        return found
    # nodes outside the largest tree of their run: against each other, and against that tree
    whole = materialize(named(), "ngram-rest")
    trees = whole.groupBy("run", "component").agg(F.count("*").alias("n"))
    most = trees.groupBy("run").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("all"))
    most = most.select("run", F.col("most.component").alias("largest"), F.col("all") - F.col("most.n")).toDF("run", "largest", "outside").where("outside > 0")
    rest = whole.join(broadcast_if_small(materialize(most, "ngram-rest")), "run").withColumn("parts", F.ceil(F.col("outside") / BLOCK).cast("int"))
    out, part = F.col("component") != F.col("largest"), F.pmod(F.xxhash64("node", "run"), F.col("parts")).cast("int")
    last = rest.groupBy("run").agg(F.max("chunk").alias("last"))
    rest = rest.join(last, "run").withColumn("part", part)
    block = lambda i, j, chunk: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), chunk.cast("int").alias("chunk"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    own = -1 - F.col("part")
    inside = F.transform(every, lambda x: block(F.least(-1 - x, own), F.greatest(-1 - x, own), own))  # parts are numbered from -1 down
    across = F.transform(F.sequence(F.lit(0), F.col("last")), lambda x: block(x, own, own))
    tree = F.transform(every, lambda x: block(F.col("chunk"), -1 - x, F.col("chunk")))
    blocks = rest.select("run", "node", F.explode(F.when(out, F.concat(inside, across)).otherwise(tree)).alias("b")).select("run", "b.i", "b.j", "node", "b.chunk")
    found = joined(blocks)
    discard(whole)
    return found


def _hot_runs(read: DataFrame, keyed: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(keyed without signatures of very many nodes, the runs of those): dealt by node, one of equal runs kept."""
    look = read.where(F.pmod(F.xxhash64("node"), F.lit(LOOK)) == 0).select("node", "keys").dropDuplicates(["node"])
    seen = look.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * LOOK >= BLOCK)
    seen = materialize(seen.select("key"), "ngram-hot")
    if not seen.limit(1).count():
        discard(seen)
        return keyed, None
    rows = materialize(keyed.join(broadcast_if_small(seen), "key").distinct(), "ngram-hot")
    sums = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"))
    kept = sums.groupBy("n", "s", F.col("key").bitwiseAND(F.lit(1)).alias("odd")).agg(F.min("key").alias("key"))
    chunk = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK)).cast("int")
    hot = rows.join(broadcast_if_small(kept.select("key", "n", "odd")), "key").select(F.col("key").alias("run"), "node", chunk.alias("chunk"), (F.col("odd") == 1).alias("odd"))
    return keyed.join(broadcast_if_small(seen), "key", "left_anti"), hot


def join(docs: DataFrame, n: int = N, share: int = SHARE) -> DataFrame:
    """(doc_id, n_shingles, component_id); 100 * |both| >= share * |union| links two documents."""
    spark = docs.sparkSession
    bounded_batches(spark)
    mark = F.xxhash64(F.col("text").cast("string"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), mark.alias("mark"))
    read = materialize(keyed_texts(docs, mark=mark).mapInPandas(tidy(_read(n, share)), _READ), "ngram-sets")
    heads = read.where("node is not null").groupBy("node", "other").agg(F.min(F.struct("doc_id", "mark")).alias("head"), F.min("doc_id").alias("least"), F.min("n_shingles").alias("n_shingles"))
    heads = materialize(heads, "ngram-nodes")
    # a name that two sets share is kept by the lesser
    twice = materialize(heads.groupBy("node").agg(F.min("other").alias("_keeps"), F.count("*").alias("_n")).where("_n > 1").drop("_n"), "ngram-twice")
    if twice.limit(1).count():
        name = F.when(F.col("other") != F.col("_keeps"), F.xxhash64("node", "other")).otherwise(F.col("node"))
        renamed = lambda df: df.join(broadcast_if_small(twice), "node", "left").withColumn("node", name).drop("_keeps")
        read, heads = renamed(read), renamed(heads)
    # the runs of nodes that agree on a part
    some = read.where("keys is not null")
    keyed, hot = _hot_runs(some, some.select(F.explode("keys").alias("key"), "node"))
    runs = keyed.repartition("key").sortWithinPartitions("key", "node").mapInPandas(tidy(_runs), "run long, node long, chunk int, odd boolean").distinct()
    runs = materialize(runs if hot is None else runs.unionByName(hot), "ngram-runs")
    info = some.select("node", "n_shingles", F.col("even").alias("even_map"), F.col("odd").alias("odd_map")).dropDuplicates(["node"])
    large = materialize(runs.where("chunk > 0").groupBy("run").agg((F.max("chunk") + 1).alias("chunks"), F.max("odd").alias("odd")), "ngram-large")

    def maps(blocks: DataFrame) -> DataFrame:
        return blocks.join(info, "node").repartition("run", "i", "j").sortWithinPartitions("run", "i", "j", "node")

    def with_odd(blocks: DataFrame) -> DataFrame:
        """After the first round all runs are large."""
        return maps(blocks.join(broadcast_if_small(large.select("run", "odd")), "run"))

    small = runs.join(broadcast_if_small(large.select("run", "chunks")), "run", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    first = maps(small.select("run", F.col("chunk").alias("i"), F.col("chunk").alias("j"), "node", "chunk", "odd"))
    maybe = connect(small, with_odd, _bounded(share), first)
    discard(runs)
    # exact links inside the clusters
    near = materialize(heads.join(maybe, "node"), "ngram-clusters")
    discard(maybe)
    held = near.groupBy("component").agg(F.count("*").alias("_n"), F.sum("n_shingles").alias("_s"))
    held = held.withColumn("chunks", F.greatest(F.ceil(F.col("_n") / BLOCK), F.ceil(F.col("_s") * 8 / BLOCK_BYTES), F.lit(1)).cast("int"))
    todo = near.join(held.select("component", "chunks"), "component").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    todo = materialize(todo.select("head", "node", "other", F.col("component").alias("run"), "chunk", "chunks"), "ngram-todo")

    def sets(blocks: DataFrame) -> DataFrame:
        """The shingles of each block's nodes, made anew from the text of one row of each."""
        at = blocks.groupBy("run", "node").agg(F.collect_list(F.struct("i", "j", "chunk")).alias("blocks"))  # a node's own few blocks
        at = at.join(todo.select("run", "node", "other", "head"), ["run", "node"]).select("run", "node", "other", "blocks", F.col("head.doc_id").alias("_head"), F.col("head.mark").alias("_mark"))
        texts = rows.join(broadcast_if_small(materialize(at, "ngram-blocks")), F.col("doc_id").eqNullSafe(F.col("_head")) & (F.col("mark") == F.col("_mark")))
        made = texts.mapInPandas(tidy(_sets(n)), "run long, i int, j int, chunk int, node long, shingles binary")
        return made.repartition("run", "i", "j").sortWithinPartitions("run", "i", "j", "node")

    linked = connect(todo.select("run", "node", "chunk", "chunks"), sets, _exact(share))
    discard(near)
    # the least doc_id of each component
    classes = heads.join(linked, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "component").select("node", "component_id")
    return read.select("doc_id", "n_shingles", "node").join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
