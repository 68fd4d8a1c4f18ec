"""Line dedup, n-gram joins and decontamination against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from voxframe.llm import decontaminate, linededup, ngramjoin
from voxframe.llm.common import components, offsets
from voxframe.llm.linededup import Cuckoo


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(200)]
    some = [(1000 + rng.randint(0, 150), 1000 + rng.randint(0, 150)) for _ in range(120)]
    links = [*chain, *some, (7, 7), (5000, 4000), (4000, 5000)]
    parent = {x: x for e in links for x in e}
    for a, b in links:
        x, y = find(parent, a), find(parent, b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(parent, x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_offsets(spark):
    df = spark.createDataFrame([(i, i * 3 % 7) for i in range(100)], "k long, v long").repartition(4)
    got = {r.k: r.at for r in offsets(df, ["k"], "v", "at", buckets=5).collect()}
    assert got == {i: sum(j * 3 % 7 for j in range(i)) for i in range(100)}


# ---- lines ----


def brute_lines(rows, least=40, docs=5):
    space = " \t\n\x0b\x0c\r"
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(space))
    held = {}
    for doc, text in rows:
        for key in {low(x) for x in (text or "").split("\n")}:
            if len(key) >= least:
                held.setdefault(key, []).append(doc)
    rank = lambda d: -1 if d is None else d
    last = {k: max(v, key=rank) for k, v in held.items() if len(v) >= docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if last.get(low(x), doc) == doc]
        out.append((doc, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


@pytest.mark.parametrize("keys", [1, 100])
def test_lines_on_odd_rows(spark, monkeypatch, odd, none, keys):
    monkeypatch.setattr(linededup, "SHARD_KEYS", keys)
    out = linededup.dedup(odd)
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()), key=repr) == brute_lines(rows_of(odd))
    assert {"source", "_doc", "_guess", "lang_pred"} <= set(out.columns) and out.where("_doc = 'clash'").count() > 0
    assert linededup.dedup(none).count() == 0


def state_of(state):
    counts = {(r.hi, r.lo): (r.refs, r.last_doc) for r in state.counts.collect()}
    tables = {r["shard"]: Cuckoo.load(bytes(r["filter"])) for r in state.filters.collect()}
    return counts, {k for k in counts if (k[0] >> 32) % state.shards in tables and k in tables[(k[0] >> 32) % state.shards]}


def test_insert_and_delete_are_reversible(spark):
    line = [f"line number {i} with enough characters to count" for i in range(30)]
    rng = random.Random(1)
    rows = [(d, "\n".join(rng.sample(line, 8))) for d in range(40)]
    make = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    first = linededup.build(make(rows[:20]))
    grown = linededup.insert(first, make(rows[20:]))
    whole = linededup.build(make(rows))
    assert state_of(grown) == state_of(whole)
    assert sorted(rows_of(linededup.apply(make(rows), grown))) == sorted((d, t) for d, t, _, _ in brute_lines(rows))
    back = linededup.delete(grown, make(rows[20:]).select("doc_id"))
    assert state_of(back) == state_of(first)
    losing = {k for k, v in state_of(first)[0].items() if v[0] >= 5}
    assert losing <= state_of(back)[1]


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = [tuple(x) for x in rng.integers(-(2**63), 2**63 - 1, (5000, 2)).tolist()]
    made = Cuckoo.load(Cuckoo.of(keys).dump())
    assert all(k in made for k in keys)
    other = [tuple(x) for x in rng.integers(-(2**63), 2**63 - 1, (5000, 2)).tolist()]
    assert sum(k in made for k in other) < 25
    assert all(made.delete(*k) for k in keys[:2500])
    assert all(k in made for k in keys[2500:])
    for some in (keys, other):
        hi, lo = np.array(some, "int64").T
        assert made.among(np.ascontiguousarray(hi), np.ascontiguousarray(lo)).tolist() == [k in made for k in some]
    assert sum(k in made for k in keys[:2500]) < 25


def test_filters_decide_before_counts(spark, monkeypatch):
    """Lines whose shard's filter does not hold them never meet the counts, and a hot line is dealt over salts."""
    rows = [(d, "the very same line of every single document here\nown line number %d with enough characters in it" % d) for d in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    state = linededup.build(docs)
    gone = linededup.losing_lines(state.postings, state).collect()
    assert len(gone) == 299 and {r.doc_id for r in gone} == set(range(299)) and len({(r.hi, r.lo) for r in gone}) == 1
    bare = linededup.State(state.postings, state.counts, state.filters.limit(0), state.shards)
    assert linededup.losing_lines(state.postings, bare).count() == 0


# ---- joins ----


def sets_of(rows, n):
    out = []
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        out.append((doc, frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    return out


def brute_join(rows, n=3, share=90):
    s = sets_of(rows, n)
    parent = list(range(len(s)))
    for i, (_, a) in enumerate(s):
        for j in range(i):
            b = s[j][1]
            if a and b and 100 * len(a & b) >= share * len(a | b):
                x, y = find(parent, i), find(parent, j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (doc, _) in enumerate(s):
        if doc is not None:
            k = find(parent, i)
            least[k] = min(least.get(k, doc), doc)
    return sorted(((doc, len(x), least.get(find(parent, i), doc)) for i, (doc, x) in enumerate(s)), key=repr)


def near_copies(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 3)))
    rows = []
    for base in range(6):
        text = [word() for _ in range(rng.choice([1, 2, 4, 12, 40, 150]))]
        for _ in range(n // 6):
            new = list(text)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                new[rng.randrange(len(new))] = word()
            rows.append((len(rows), " ".join(new) + (" extra" if rng.random() < 0.1 else "")))
    return rows


@pytest.mark.parametrize("n,share", [(3, 90), (5, 80)])
def test_join_equals_all_pairs(spark, monkeypatch, n, share):
    rows = near_copies(n)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, ngramjoin.join(docs, n, share).collect()), key=repr)
    assert got == brute_join(rows, n, share)


def test_bands_and_parts_lose_no_pair():
    for share in (80, 90, 95):
        edge = ngramjoin.edges(share)
        for a in range(1, 400):
            for b in range(a, a * 100 // share + 1):
                ta, tb = ngramjoin.band_of(a, share), ngramjoin.band_of(b, share)
                assert tb - ta in (0, 1)
                assert edge[ta] <= a < edge[ta + 1]
                assert ngramjoin.most_apart(a, b, share) < ngramjoin.parts_of(ta, share) or a == b == 0


def test_large_runs_in_blocks_give_the_same(spark, monkeypatch):
    """Runs and clusters cut into chunks: blocks of pairs of chunks cover all pairs."""
    import pandas as pd

    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(50):
        new = list(base)
        new[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(new)))
    want = brute_join(rows)
    monkeypatch.setattr(ngramjoin, "BLOCK", 7)
    keyed = pd.DataFrame([(1, d) for d in range(25)] + [(3, 1), (3, 2), (5, 9)], columns=["key", "node"])
    runs = pd.concat(ngramjoin._runs([keyed.iloc[:11], keyed.iloc[11:]]))
    big = runs[runs.run == 1]
    assert sorted(big.node) == list(range(25)) and big.chunk.max() == 3 and big.groupby("chunk").size().max() <= 7
    assert set(runs[runs.run != 1].node) == {1, 2}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngramjoin.join(docs).collect()), key=repr) == want


def test_hot_signatures_give_the_same(spark, monkeypatch):
    """Signatures of many nodes, dealt by node: chunks by hash, equal runs once."""
    monkeypatch.setattr(ngramjoin, "LOOK", 1)
    monkeypatch.setattr(ngramjoin, "BLOCK", 5)
    rows = near_copies(11, 90)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, ngramjoin.join(docs).collect()), key=repr) == brute_join(rows)


def test_forest_connects_what_all_pairs_connect():
    rng = np.random.default_rng(8)
    for side in (None, "some"):
        base = [np.unique(rng.integers(0, 2**63, 60).astype("uint64")) for _ in range(4)]
        sets = [np.unique(np.concatenate((rng.choice(base[i % 4], 58, replace=False), rng.integers(0, 2**63, 1).astype("uint64")))) for i in range(40)]
        sizes, maps = np.array([len(x) for x in sets]), np.stack([ngramjoin.parity(x, 256) for x in sets])
        mask = None if side is None else rng.random(40) < 0.5
        parent, other = list(range(40)), list(range(40))
        for i in range(40):
            for j in range(i):
                apart = int(np.bitwise_count(maps[i] ^ maps[j]).sum())
                if 190 * apart <= 10 * (sizes[i] + sizes[j]) and (mask is None or mask[i] != mask[j]) and min(sizes[i], sizes[j]) * 100 >= max(sizes[i], sizes[j]) * 90:
                    parent[find(parent, i)] = find(parent, j)
        pairs = ngramjoin.forest(sizes, maps, mask, 90)
        for i, j in pairs:
            other[find(other, i)] = find(other, j)
        same = lambda p: {frozenset(i for i in range(40) if find(p, i) == r) for r in {find(p, i) for i in range(40)}}
        assert same(parent) == same(other) and len(pairs) == 40 - len(same(parent))


def test_join_on_odd_rows(spark, odd, none):
    got = sorted(map(tuple, ngramjoin.join(odd).collect()), key=repr)
    assert got == brute_join(rows_of(odd))
    assert ngramjoin.join(none).count() == 0


def test_bitmap_bound_is_a_bound():
    rng = np.random.default_rng(3)
    for bits in (64, 512):
        for _ in range(100):
            x = np.unique(rng.integers(0, 2**63, 80).astype("uint64"))
            y = np.unique(np.concatenate((x[: rng.integers(0, 80)], rng.integers(0, 2**63, 20).astype("uint64"))))
            apart = int(np.bitwise_count(np.bitwise_xor(ngramjoin.parity(x, bits), ngramjoin.parity(y, bits))).sum())
            assert apart <= len(np.setxor1d(x, y))


# ---- benchmark ----


def grams(words, k=5):
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [tuple(words)]


def brute_leaks(docs, items):
    out = set()
    for doc, text in docs:
        w = (text or "").lower().split()
        for item, passage in items:
            p = (passage or "").lower().split()
            if not p:
                continue
            k, a = min(5, len(p)), Counter(grams(p))
            for s in range(-len(p) + 1, len(w)):
                window = w[max(0, s) : s + len(p)]
                b = Counter(tuple(window[i : i + k]) for i in range(len(window) - k + 1))
                if b and 100 * sum((a & b).values()) >= 80 * sum((a | b).values()):
                    out.add((doc, item))
                    break
    return out


def test_leaks_equal_all_windows(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 5, 9, 30, 60])))) for i in range(25)] + [(25, None), (26, "...")]
    docs = []
    for d in range(120):
        w = [word() for _ in range(rng.randint(0, 40))]
        if d % 2:
            p = items[rng.randrange(25)][1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                p[rng.randrange(len(p))] = word()
            if rng.random() < 0.3:
                p = p[: max(1, len(p) - 2)]
            at = rng.randint(0, len(w))
            w[at:at] = p
        docs.append((d, " ".join(w).title()))
    make = lambda rows, k: spark.createDataFrame(rows, f"{k} long, text string")
    got = decontaminate.find(make(docs, "doc_id").repartition(3), make(items, "item_id")).collect()
    want = brute_leaks(docs, items)
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert len(got) == len(pairs) and pairs == want and len(want) > 20
    assert all(0.8 <= r.similarity <= 1 and r.hamming <= decontaminate.RADIUS for r in got)


def test_leaks_on_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "hola mundo"), (1, "hola mundo"), (2, ""), (3, None), (None, "null id text here")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in decontaminate.find(odd, items).collect()), key=repr)
    assert got == sorted([(5, 1), (None, None)], key=repr)
    left = decontaminate.clean(odd, items)
    assert left.columns == odd.columns and left.count() == odd.count() - 3
    assert decontaminate.find(none, items).count() == 0
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find(odd, empty).count() == 0 and decontaminate.clean(odd, empty).count() == odd.count()


def test_unrelated_pairs_never_meet_and_near_ones_do(spark):
    """Recall over passages from 0.8 up with words changed, put in and left out; the index alone says which item."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(40))) for i in range(60)]
    docs = []
    for d in range(240):
        p = items[d % 60][1].split()
        for _ in range(rng.choice([0, 1, 1])):
            at = rng.randrange(len(p))
            p[at : at + rng.choice([0, 1])] = [word()] if rng.random() < 0.7 else []
        docs.append((d, " ".join([word() for _ in range(20)] + p + [word() for _ in range(20)])))
    make = lambda rows, k: spark.createDataFrame(rows, f"{k} long, text string")
    pairs = {(r.doc_id, r.item_id) for r in decontaminate.find(make(docs, "doc_id").repartition(3), make(items, "item_id")).collect()}
    want = brute_leaks(docs, items)
    assert pairs <= want and len(want) > 100 and len(pairs) >= 0.99 * len(want), (len(pairs), len(want))


def test_every_pair_within_the_radius_meets_in_the_index(spark):
    """Fingerprints RADIUS bits apart, as unevenly as can be or at random, against the listed variants."""
    rng = random.Random(5)
    bits = decontaminate.BLOCK_BITS
    prints, windows = [], []
    for i in range(60):
        own = [rng.randrange(1 << bits) for _ in range(decontaminate.BLOCKS)]
        other = list(own)
        flips = rng.sample(range(decontaminate.BLOCKS * bits), decontaminate.RADIUS)
        if i % 2:  # one more than allowed in as many blocks as that takes
            flips = [k * bits + x for k, most in enumerate(decontaminate.ALLOWED) for x in rng.sample(range(bits), most + 1)]
            flips = rng.sample(flips, decontaminate.RADIUS)
        for f in flips:
            other[f // bits] ^= 1 << f % bits
        prints.append((i, 20, own))
        windows.append((i, 20, other))
    items = spark.createDataFrame(prints, "item_id long, n_words int, item_print array<int>")
    asked = spark.createDataFrame(windows, "window long, length int, p array<int>").selectExpr("window", "length", "posexplode(p) AS (block, value)")
    met = {(r.window, r.item_id) for r in asked.join(decontaminate.listed(items), ["length", "block", "value"]).collect()}
    assert {(i, i) for i in range(60)} <= met
    others = sum(a != b for a, b in met) / (60 * 59)
    assert decontaminate.random_share() < 0.05 and abs(others - decontaminate.random_share()) < 0.015
    assert all(len(decontaminate._variants(n)) == sum(__import__("math").comb(bits, k) for k in range(n + 1)) for n in (0, 1, 3))


def test_long_texts_are_cut_into_stretches(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "STRETCH", 16)
    rng = random.Random(3)
    items = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(30))) for i in range(12)]
    docs = [(d, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randint(0, 90))) + " " + items[d % 12][1] + " x y " + items[d % 5][1]) for d in range(40)] + [(40, "the same " * 500), (None, items[3][1])]
    items.append((12, "the same " * 20))
    make = lambda rows, k: spark.createDataFrame(rows, f"{k} long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(make(docs, "doc_id").repartition(3), make(items, "item_id")).collect()}
    assert got == brute_leaks(docs, items) and (40, 12) in got and (None, 3) in got


def test_rounds_hand_on_rows_linear_in_a_family(spark, monkeypatch):
    """One run of N nodes that hang together, and one of which some do not."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(ngramjoin, "BLOCK", 50)
    sent = []

    def meet(blocks):
        rows = ngramjoin.materialize(blocks, "test")
        sent.append(rows.count())
        return rows.repartition("run", "i", "j").sortWithinPartitions("run", "i", "j", "node")

    def step(batches):  # nodes of one remainder by 1000 are linked
        import pandas as pd

        for g in ngramjoin._groups(batches, ["run", "i", "j"]):
            first, links = {}, []
            side = None if g["i"].iloc[0] == g["j"].iloc[0] else g["chunk"] == g["i"]
            for node, left in zip(g["node"].tolist(), ([None] * len(g) if side is None else side.tolist()), strict=True):
                for other, of in first.get(node % 1000, []):
                    if of is None or of != left:
                        links.append((other, node))
                first.setdefault(node % 1000, []).append((node, left))
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    def run(nodes):
        rows = spark.createDataFrame([(7, n, i // 50, -(-len(nodes) // 50)) for i, n in enumerate(nodes)], "run long, node long, chunk int, chunks int")
        sent.clear()
        found = {r.node: r.component for r in ngramjoin.connect(rows, meet, step).collect()}
        kinds = {}
        for n in nodes:
            kinds.setdefault(n % 1000, set()).add(found.get(n, n))
        return sum(sent), kinds

    for n in (1000, 4000):
        rows, kinds = run([1000 * i + 1 for i in range(n)])
        assert rows <= 1.1 * n and kinds == {1: {1}}
    rows, kinds = run([1000 * i + (1 if i % 10 else i % 7) for i in range(1000)])
    assert all(len(k) == 1 for k in kinds.values()) and rows <= 1000 * (1.2 + 3) + 100 * 30


def test_many_null_ids_do_not_multiply(spark, monkeypatch):
    rows = near_copies(21, 300)
    made = spark.sparkContext.accumulator(0)
    sets = ngramjoin._sets

    def counted(n):
        step = sets(n)

        def run(batches):
            for pdf in step(batches):
                made.add(len(pdf))
                yield pdf

        return run

    monkeypatch.setattr(ngramjoin, "_sets", counted)
    with_ids = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ngramjoin.join(with_ids).collect()
    plain = made.value
    sizes = [r.n_shingles for r in ngramjoin.join(with_ids.withColumn("doc_id", with_ids.doc_id.cast("long") * None)).collect()]
    assert len(sizes) == len(rows) and made.value - plain <= 2 * plain


def test_sets_that_share_a_name_stay_apart(spark, monkeypatch):
    """All names are one: the other halves of the identities keep the sets apart."""
    node = ngramjoin._node
    rows = near_copies(5, 60)
    want = brute_join(rows)
    monkeypatch.setattr(ngramjoin, "_node", lambda x: (node(x)[0] & 7, node(x)[1]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, ngramjoin.join(docs).collect()), key=repr) == want
