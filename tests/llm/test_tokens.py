"""Token ids, packing, shards and piece counts against the library and brute force."""

import io
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxframe.llm import packing, sstable, wordpiece
from voxframe.llm.tokens import Codec, _Pieces


@pytest.fixture(scope="module")
def own(bpe):
    return Codec(bpe, most=20_000)


def library(codec, text):
    return codec.tok.encode(text, add_special_tokens=False).ids


TEXTS = ["", " ", "\n", "a\nb", "a  b", " a", "a ", "don't", "x<|endoftext|>y", "tab\tx", "é ü ñandú", "日本 語", "12 a1b2 ,.", "a\r\nb", "nb sp", "ends\n", "'s 've", "🎉 ok", "ǅ ß", "\x00 \x1f"]


def test_ids_equal_the_library(own):
    for t in TEXTS:
        assert np.frombuffer(own.encode(t), own.dtype).tolist() == library(own, t), t


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.sampled_from("ab 's,.\n1é\tß-"), st.characters(codec="utf-8")), max_size=40))
def test_ids_equal_the_library_on_any_text(own, text):
    assert np.frombuffer(own.encode(text), own.dtype).tolist() == library(own, text)


def test_cache_is_bounded():
    made = _Pieces(len, 4000)
    for i in range(1000):
        assert made[str(i)] == len(str(i))
        assert sum(200 + 2 * len(k) for k in [*made, *made.old]) <= 4000
    assert made["x" * 5000] == 5000 and "x" * 5000 not in made


def test_prompts_are_first_lines(own):
    for t in [*TEXTS, "one two\nthree", "one  two\nthree\n", "\n\n", "tab\t\nx"]:
        ids, prompt = own.encode_from(t)
        first, cut, _ = t.partition("\n")
        assert ids == own.encode(t)
        assert prompt == (min(len(library(own, first)) + 1, len(library(own, t))) if cut else 0), t


def packed(limits, sizes, **kw):
    packer, done = packing.Packer(*limits, **kw), []
    for k, (n, loss) in sizes.items():
        done += packer.add(k, n, loss)
    return done + packer.finish()


@pytest.mark.parametrize("limits", [(64, 256, 64), (64, 3, 64), (64, 8, 20), (64, 4, 40)])
def test_packing_keeps_limits_and_every_token(limits):
    rng = random.Random(7)
    sizes = {}
    for k in range(600):
        n = rng.choice([1, rng.randint(1, 63), 64, rng.randint(1, 500)])
        cuts = sorted(rng.randint(0, n) for _ in range(4))
        sizes[k] = (n, packing.Loss([(cuts[0], cuts[1]), (cuts[2], cuts[3])]))
    done = packed(limits, sizes, pool=40, min_cut=4)
    at = {k: [] for k in sizes}
    for pieces in done:
        total = sum(p[2] for p in pieces)
        assert 0 < total <= limits[0] and len(pieces) <= limits[1] and sum(p[3] for p in pieces) <= limits[2]
        assert total & (total - 1) == 0 or limits[0] - total <= packing.SLACK
        for k, start, n, loss in pieces:
            assert loss == sizes[k][1].within(start, start + n)
            at[k].append((start, n))
    for k, (n, _) in sizes.items():
        assert [s for s, _ in sorted(at[k])] == [sum(x[1] for x in sorted(at[k])[:i]) for i in range(len(at[k]))]
        assert sum(x[1] for x in at[k]) == n


def first_fit(limits, sizes):
    """Whole pieces into the first sequence that has room in every dimension: how many sequences there are."""
    bins = []
    for n, loss in sizes.values():
        own = loss.within(0, n)
        spot = next((b for b in bins if b[0] + n <= limits[0] and b[1] < limits[1] and b[2] + own <= limits[2]), None)
        if spot is None:
            bins.append(spot := [0, 0, 0])
        spot[0], spot[1], spot[2] = spot[0] + n, spot[1] + 1, spot[2] + own
    return bins


def test_every_limit_closes_sequences_and_the_heuristic_beats_first_fit():
    rng = random.Random(5)
    limits = (256, 6, 160)
    sizes = {}
    for k in range(800):
        n = rng.choice([rng.randint(4, 40), rng.randint(60, 250)])
        sizes[k] = (n, packing.Loss([(rng.randint(0, n) if rng.random() < 0.5 else 0, n)]))
    sizes = {k: (n, x) for k, (n, x) in sizes.items() if x.within(0, n) <= limits[2]}
    done = packed(limits, sizes, pool=200)
    totals = [(sum(p[2] for p in s), len(s), sum(p[3] for p in s)) for s in done]
    assert all(any(t[d] == limits[d] for t in totals) for d in range(3))
    padding = sum(0 if n & (n - 1) == 0 else limits[0] - n for n, _, _ in totals)
    bins = first_fit(limits, sizes)
    rest = sum(0 if b[0] & (b[0] - 1) == 0 else limits[0] - b[0] for b in bins)
    assert padding < rest / 5


def test_conversations_bear_loss_in_assistant_turns(spark, none, bpe, own):
    rows = [(c, t, r, f"turn {t} of {c}: " + "words " * (5 * t)) for c in range(12) for t, r in enumerate(("system", "user", "assistant", "user", "assistant"))]
    rows += [(99, 0, None, None), (99, 0, "assistant", ""), (None, 1, "assistant", "no id"), (3, 7, "assistant", "long " * 4000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, length string").repartition(3)
    got = packing.pack_conversations(df, bpe).toPandas()
    want, loss = {}, {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or "")):
        ids = library(own, text or "") + [1]
        want[c] = want.get(c, []) + ids
        loss[c] = loss.get(c, 0) + (len(ids) if role == "assistant" else 0)
    got["doc"] = got["doc_id"].fillna(-1).astype(int)
    for c, ids in want.items():
        own_rows = got[got["doc"] == (-1 if c is None else c)].sort_values("start")
        assert own_rows.length.sum() == len(ids) and own_rows.loss_tokens.sum() == loss[c]
        for r in own_rows.itertuples():
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    sums = got.groupby("sequence_id").agg({"length": "sum", "loss_tokens": "sum", "doc_id": "size"})
    assert (sums.length <= 2048).all() and (sums.loss_tokens <= 1536).all() and (sums.doc_id <= packing.SEGMENTS).all()
    assert packing.pack_conversations(df.limit(0), bpe).count() == 0


def test_pack_documents(spark, odd, none, bpe, own):
    got = packing.pack_documents(odd, bpe).toPandas()
    want = {(-1 if r.doc_id is None else r.doc_id): library(own, r.text or "") + [1] for r in odd.collect()}
    got["doc"] = got["doc_id"].fillna(-1).astype(int)
    for doc, rows in got.groupby("doc"):
        ids = want[doc]
        assert set(rows.doc_tokens) == {len(ids)}
        for r in rows.itertuples():
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        assert rows.length.sum() == len(ids) * (2 if doc in (5, 9) else 1)
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows.offset.tolist() == [0, *rows.length.cumsum().tolist()[:-1]]
    padding = (got.groupby("sequence_id").padded_to.first() - got.groupby("sequence_id").sequence_tokens.first()).sum()
    assert padding < 0.02 * got.length.sum()
    assert packing.pack_documents(none, bpe).count() == 0


class Buffer(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_shard_file_round_trip():
    rng = random.Random(3)
    ids = sorted(rng.sample(range(-(10**6), 10**6), 500))
    keys = [sstable.key_of(None, 0), *[sstable.key_of(i, r) for i in ids for r in range(rng.choice([1, 1, 3]))]]
    values = {k: rng.randbytes(rng.choice([0, 2, 400])) for k in keys}
    out = Buffer()
    w = sstable.Writer(out, 2, block_bytes=2000)
    for k in keys:
        w.add(k, values[k])
    w.close()
    r = sstable.Reader(out)
    assert list(r.scan()) == list(values.items()) and len(r.blocks) > 5
    assert all(r.get(k) == v for k, v in values.items())
    missing = [sstable.key_of(i) for i in range(10**6, 10**6 + 2000)]
    assert all(r.get(k) is None for k in missing)
    assert sum(map(r.may_contain, missing)) < 60
    assert [sstable.doc_of(sstable.key_of(i)) for i in (None, -1, 0, 2**62)] == [None, -1, 0, 2**62]
    with pytest.raises(ValueError):
        sstable.Reader(Buffer(out.getvalue()[:-1] + b"x"))


def test_empty_shard():
    out = Buffer()
    sstable.Writer(out, 2).close()
    r = sstable.Reader(out)
    assert list(r.scan()) == [] and r.get(sstable.key_of(1)) is None


def test_shards(spark, odd, none, bpe, own):
    manifest = sstable.write_shards(odd, bpe, shard_bytes=4000)
    assert manifest.count() > 1  # shards roll over by size
    got = sstable.shard_digests(manifest).toPandas().sort_values("start")
    rows = sorted(odd.collect(), key=lambda r: (-1 if r.doc_id is None else r.doc_id))
    at = 0
    for r, g in zip(rows, got.itertuples(), strict=True):
        ids = library(own, r.text or "") + [0]
        assert (g.start, g.n_tokens, g.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    asked = spark.createDataFrame([(5,), (7,), (999,)], "doc_id long")
    found = sstable.lookup(manifest, asked).collect()
    assert sorted(r.doc_id for r in found) == [5, 5, 7]
    assert all(r.ids == library(own, "hola mundo") + [0] for r in found if r.doc_id == 5)
    assert sstable.shard_digests(sstable.write_shards(none, bpe)).count() == 0
    assert sstable.lookup(sstable.write_shards(none, bpe), asked).count() == 0


def test_lookup_in_many_shards(spark, bpe, own):
    """Repeats of a doc_id over several shards, keys between shards, below the first and above the last, null keys."""
    long = lambda n: " ".join(f"w{n * i}" for i in range(5000))  # noqa: E731  blocks have 128 KB
    rows = [(d * 3, long(d + 1)) for d in range(60)] + [(30, long(i + 100)) for i in range(25)] + [(None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    manifest = sstable.write_shards(docs, bpe, shard_bytes=100)
    assert manifest.count() > 10
    asked = [-5, 0, 1, 29, 30, 31, 90, 177, 178, 999, None, 30]
    found = sstable.lookup(manifest, spark.createDataFrame([(k,) for k in asked], "doc_id long").repartition(3)).collect()
    want = sorted((d, tuple(library(own, t) + [0])) for d, t in rows if d in set(asked) - {None})
    assert sorted((r.doc_id, tuple(r.ids)) for r in found) == want


def greedy(word, pieces, longest=None):
    n = at = 0
    longest = longest or max(map(len, pieces))
    while at < len(word):
        step = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in pieces), None)
        if step is None:
            return 1
        at, n = at + step, n + 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=5).map(lambda b: bytes(97 + x % 3 for x in b)), min_size=1, max_size=12), st.lists(st.sampled_from([97, 98, 99]), max_size=25).map(bytes))
def test_automaton_equals_greedy_matching(pieces, word):
    assert wordpiece.Automaton(pieces).count(word) == greedy(word, set(pieces))


def test_piece_counts(spark, odd, none, bpe):
    pieces = set(wordpiece.byte_pieces(bpe))
    longest = max(map(len, pieces))
    got = {(r.doc_id, r.n_words, r.n_pieces) for r in wordpiece.count_pieces(odd, bpe).collect()}
    want = set()
    for r in odd.collect():
        words = (r.text or "").split()
        want.add((r.doc_id, len(words), sum(greedy(b" " + w.encode(), pieces, longest) for w in words)))
    assert got == want
    assert wordpiece.count_pieces(none, bpe).count() == 0


def test_writers_hold_sixteen_bytes_a_key():
    out = io.BytesIO()
    writer = sstable.Writer(out, 2)
    for i in range(200_000):
        writer.add(sstable.key_of(i), b"\x00\x00")
    assert len(writer.hashes) * writer.hashes.itemsize == 16 * 200_000 and not hasattr(writer, "keys")
    writer.close()
    reader = sstable.Reader(_Source(out.getvalue()))
    assert all(reader.may_contain(sstable.key_of(i)) for i in range(0, 200_000, 997))
    assert sum(reader.may_contain(sstable.key_of(i)) for i in range(10**6, 10**6 + 2000)) < 60
    assert reader.get(sstable.key_of(777)) == b"\x00\x00" and reader.get(sstable.key_of(10**7)) is None


class _Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_shards_close_at_so_many_entries(spark, bpe):
    docs = spark.range(2500).selectExpr("id AS doc_id", "cast(null as string) AS text").coalesce(1)
    made = sstable.write_shards(docs, bpe, shard_entries=400)
    assert max(r.n_docs for r in made.collect()) == 400 and sum(r.n_docs for r in made.collect()) == 2500
    found = sstable.lookup(made, spark.range(0, 5000, 3).withColumnRenamed("id", "doc_id"))
    assert sorted((r.doc_id, list(r.ids)) for r in found.collect()) == [(i, [0]) for i in range(0, 2500, 3)]


def test_long_documents_let_go_of_placed_ids():
    """What waits of 40 documents of 300,000 tokens each is bounded by the pool, not by the documents."""
    limits, size = (2048, 24, 1920), 2048 * 2
    packer, held, most = packing.Packer(*limits), {}, 0
    rng, given, taken = random.Random(1), {}, {}

    def place(sequences):
        for pieces in sequences:
            for key, start, length, _ in pieces:
                taken.setdefault(key, {})[start] = held[key].take(start * 2, length * 2)

    for key in range(40):
        n = 300_000 + rng.randrange(4000)
        given[key] = np.arange(n, dtype="<u4").astype("<u2").tobytes()
        held[key] = packing.Parts(given[key], size)
        place(packer.add(key, n, packing.Loss([(rng.randrange(200), n)])))
        most = max(most, sum(len(p) for h in held.values() for p in h.parts.values()))
    place(packer.finish())
    assert most <= packing.POOL * 2 * size
    assert all(b"".join(taken[k][s] for s in sorted(taken[k])) == given[k] for k in given)
    assert not any(h.parts for h in held.values())


def test_keys_asked_in_order_read_a_block_once():
    class Counted(io.BytesIO):
        reads = 0

        def size(self):
            return len(self.getbuffer())

        def read(self, n=-1):
            self.reads += 1
            return super().read(n)

    out = Counted()
    writer = sstable.Writer(out, 2, block_bytes=1000)
    for i in range(500):
        writer.add(sstable.key_of(i), bytes([i % 251] * 20))
    writer.close()
    reader = sstable.Reader(out)
    before = out.reads
    for i in range(500):
        assert reader.first_repeat(i) == 0 and reader.get(sstable.key_of(i)) == bytes([i % 251] * 20)
    assert len(reader.blocks) > 5 and out.reads - before <= len(reader.blocks) + 1
