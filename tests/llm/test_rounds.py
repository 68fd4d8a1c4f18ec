"""Genetic packing, periodic runs and phrase mining against brute force and literal forms."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import pairwise
from types import SimpleNamespace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxframe.llm import collocations, genetic, periodic, queries
from voxframe.llm.tokens import WordCodec

SF = "/root/testdata/sf0.001"


# periodic runs


def literal_runs(words, min_words=24, times=3):
    least = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(min_words, times * q):
                least.setdefault((i, n), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in least.items())


def literal_kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def planted(rng, n):
    words = [rng.choice("abcdefgh") for _ in range(n)]
    for _ in range(rng.randint(0, 4)):
        a, p = rng.randrange(n), rng.randint(1, max(1, n // 5))
        b = min(n, a + rng.randint(p, 5 * p + 20))
        for i in range(a + p, b):
            words[i] = words[i - p]
    return words


def test_runs_equal_the_definition():
    rng = random.Random(1)
    docs = [planted(rng, rng.randint(1, 400)) for _ in range(150)] + [[], ["a"], ["a"] * 24, ["a"] * 23, list("ab") * 12, list("abcdefgh") * 3, list("abcdefghi") * 3, list("abcdefghi") * 3 + ["a"]]
    for words, runs in zip(docs, periodic.runs_of(docs), strict=True):
        assert runs == literal_runs(words), words
        assert periodic.collapsed(words, runs) == literal_kept(words, runs)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=90), max_size=4), st.integers(2, 12), st.integers(2, 4))
def test_runs_of_other_limits(docs, least, times):
    for words, runs in zip(docs, periodic.runs_of(docs, least, times), strict=True):
        want = literal_runs(words, least, times)
        if times == 2:  # a stretch may have two periods that do not divide each other
            want = [r for r in want if not any(r != o and o[:2] == r[:2] and o[2] < r[2] for o in want)]
        assert runs == want


def test_overlap_is_the_least_of_all_periods():
    assert periodic.overlap() == 16 == min(max(24, 3 * q) - q for q in range(1, 200))
    for least, times in [(2, 2), (12, 4), (24, 2), (7, 3), (100, 3)]:
        assert periodic.overlap(least, times) == min(max(least, times * q) - q for q in range(1, 300))


def test_mask_lets_every_run_through_and_little_else():
    rng = random.Random(3)
    plain = [str(rng.randrange(1000)) for _ in range(5000)]
    words = plain[:2000] + list("xyz") * 20 + plain[2000:]
    hashes = np.array([hash(w) for w in words], "int64").view("uint64")
    live = periodic.masked(hashes, np.array([len(words)]), periodic.overlap())
    assert live[2000:2060].all() and live.sum() < 80


def test_one_word_and_fibonacci_words_of_any_length():
    a, b = ["a"], ["a", "b"]
    while len(b) < 20_000:
        a, b = b, b + a
    (one, fib) = periodic.runs_of([["x"] * 100_000, b])
    assert one == [(0, 100_000, 1)]
    assert fib and all(n >= max(24, 3 * q) for _, n, q in fib)
    assert [r for r in fib if r[0] + r[1] <= 900] == [r for r in literal_runs(b[:1200]) if r[0] + r[1] <= 900]


def test_best_run_is_exact():
    assert periodic.best_of([]) is None
    assert periodic.best_of([(0, 30, 10), (5, 31, 10), (9, 62, 20)]) == (5, 31, 10)
    big = 10**17
    assert periodic.best_of([(0, 3 * big, big), (1, 3 * big + 1, big)]) == (1, 3 * big + 1, big)


@given(st.text(alphabet="ab \t\n\x0b\x0c\r\x1c\x1f\x85\xa0   　", max_size=30))
def test_words_split_at_six_characters_only(text):
    assert periodic.words_of(text) == [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]


def test_periodic_runs_of_odd_rows(spark, odd, none):
    assert periodic.periodic_runs(none).count() == 0
    rows = odd.select("doc_id", "text").collect()
    out = periodic.periodic_runs(odd).collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in rows)
    empty = hashlib.sha256(b"").hexdigest()
    for r in out:
        assert (r.n_runs, r.start, r.exponent_milli, r.runs_sha256) == (0, None, None, empty)
    kept = Counter(hashlib.sha256(" ".join(periodic.words_of(r.text)).encode()).hexdigest() for r in rows)
    assert Counter(r.collapsed_sha256 for r in out) == kept


def test_op12_equals_a_literal_form(spark):
    for r, text in [(r, r.text) for r in queries.op12_periodic_runs(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect()]:
        words = text.split()
        h = zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and words:
            a = h // 10 % len(words)
            p = 1 + (len(words) - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = literal_runs(words)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2])) if runs else (None,) * 3
        assert (r.n_runs, r.start, r["length"], r.period) == (len(runs), *best)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(literal_kept(words, runs)).encode()).hexdigest()


# phrase mining


def literal_phrases(docs, least, longest, top):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = lang or "und"
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else "\n" if c in ".,;:!?\n\x0b\x0c\r" else c for c in text or "")
        for piece in text.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    held = {p for p, a in f.items() if len(p[1]) > 1 and a >= least}
    inside = {(lang, w[i : i + k]) for lang, w in held for k in range(2, len(w)) for i in range(len(w) - k + 1) if f[lang, w[i : i + k]] <= f[lang, w]}
    out = []
    for lang in n:
        rows = []
        for p in held:
            if p[0] == lang and p not in inside:
                a, w = f[p], p[1]
                score, _, l, r = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
                rows.append((-score, -a, " ".join(w).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def test_collocations_equal_the_definition(spark):
    bits = 11, 11  # so few that most of what passes is infrequent
    rng = random.Random(5)
    words = ["a", "B", "c", "d", "é", "日本", "x\x1cy", "\xa0", "e.f"]
    docs = []
    for i in range(300):
        text = "".join(rng.choice(words[: rng.randint(2, 9)]) + rng.choice([" ", " ", " ", "\t", "  ", ", ", "\n", ". "]) for _ in range(rng.randint(0, 60)))
        docs.append((rng.choice(["en", "en", "de", None, "und"]), rng.choice([text, text, text, None, ""]), i))
    df = spark.createDataFrame([(b, None if i % 9 == 0 else i, a, "clash", 1) for a, b, i in docs], "text string, doc_id long, lang string, phrase string, n long").repartition(5)
    got = collocations.collocations(df, least=12, longest=5, top=25, bucket_bits=bits[0], frequent_bits=bits[1])
    want = literal_phrases([(a, b) for a, b, _ in docs], 12, 5, 25)
    assert len(want) > 40 and any(len(x[2].split(" ")) > 2 for x in want)
    assert sorted(map(tuple, got.collect())) == want


def test_scores_beyond_64_bits(spark, monkeypatch):
    counted = spark.createDataFrame([("en", "a", 1, 10**14), ("en", "b", 1, 10**14 + 1), ("en", "a b", 2, 10**13 + 7)], "lang string, phrase string, words int, n long")
    totals = spark.createDataFrame([("en", 10**16 + 3)], "lang string, n long")
    monkeypatch.setattr(collocations, "frequent_phrases", lambda *a, **k: (counted, totals))
    (row,) = collocations.collocations(None).collect()
    assert row.score == 1000 * (10**13 + 7) * (10**16 + 3) // (10**14 * (10**14 + 1))


def test_counts_of_a_task_are_handed_on_in_parts(spark, monkeypatch):
    docs = [("en", f"w{i % 40} x{i % 7} y z{i % 3}") for i in range(600)]
    texts = __import__("pandas").DataFrame({"lang": [a for a, _ in docs], "text": [b.encode() for _, b in docs]})
    monkeypatch.setattr(collocations, "HELD_BYTES", 2000)
    found = Counter()
    for pdf in collocations._pass(1, 3, 5, (11, 11), None, None)(iter([texts[:200], texts[200:400], texts[400:]])):
        for kind, phrase, n in zip(pdf["kind"], pdf["phrase"], pdf["n"], strict=True):
            if kind == collocations.PHRASES:
                found[phrase] += n
    assert found == Counter(w for _, t in docs for w in t.split())


def bits_of(phrases, log2):
    """A broadcast bitmap that holds these phrases."""
    pdf = __import__("pandas").DataFrame({"lang": "en", "phrase": phrases})
    out = bytearray((1 << log2) // 8)
    for step in collocations._frequent_bits(log2)(iter([pdf])):
        for i, data in zip(step["slice"], step["bytes"], strict=True):
            out[i * len(data) : (i + 1) * len(data)] = data
    return SimpleNamespace(value=bytes(out))


def test_a_task_reports_a_phrase_once(monkeypatch):
    """Rare words fill what a task may hold many times over, and counts wait for their merging; neither hands phrases on twice."""
    texts = [" ".join(f"r{i}x{j} a b c" for j in range(30)) for i in range(60)]
    pdf = __import__("pandas").DataFrame({"lang": "en", "text": [t.encode() for t in texts]})
    blocks = __import__("pandas").concat([b[b["kind"] == collocations.BLOCK] for i in range(0, 60, 5) for b in collocations._pass(1, 2, 5, (11, 11), None, None)(iter([pdf[i : i + 5]]))])
    monkeypatch.setattr(collocations, "HELD_BYTES", 20_000)
    monkeypatch.setattr(collocations, "HELD_ROWS", 8)
    frequent, every = bits_of(["a", "b", "c"], 16), SimpleNamespace(value=b"\xff" * (1 << 13))
    rows = [r for out in collocations._pass(2, 2, 5, (16, 16), frequent, every)(iter([blocks[i : i + 1] for i in range(len(blocks))])) for r in out.itertuples() if r.kind == collocations.PHRASES]
    assert sorted((r.phrase, r.n) for r in rows) == [("a b", 1800), ("b c", 1800)]


def test_rows_of_a_pass_do_not_grow_with_the_parts_of_the_table(spark, monkeypatch):
    made, write = [], collocations.materialize
    monkeypatch.setattr(collocations, "materialize", lambda df, tag, **k: (made.append(write(df, tag, **k)), made[-1])[1])
    df = spark.createDataFrame([("en", "the same few words again")] * 320, "lang string, text string").repartition(40)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "3000")
    try:
        counted, _ = collocations.frequent_phrases(df, 100, 3, 11, 11)
        passes = [t for t in made if "kind" in t.columns]
        assert {(r.phrase, r.n) for r in counted.where("words > 1").collect()} == {(p, 320) for p in ("the same", "same few", "few words", "words again", "the same few", "same few words", "few words again")}
        assert passes[0].where("kind = 1").count() >= 5 * 20  # the first pass has a task for each of many parts
        for rows, phrases in zip(passes[1:], (4, 3), strict=True):
            assert rows.where("kind = 1").count() <= phrases * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_buckets_grow_with_the_texts(spark, monkeypatch):
    """Else all of a large table's buckets are full, and each phrase of frequent words is counted exactly."""
    for size in (0, 10**8, 10**9, 5 * 10**9, 10**10):
        assert size / collocations.WORD_BYTES / 2 ** collocations.bucket_bits_for(size) <= collocations.LEAST / 4
    assert collocations.bucket_bits_for(0) == collocations.bucket_bits_for(10**9) == 24 and collocations.bucket_bits_for(10**12) == 26
    rng = random.Random(8)
    docs = [("en", " ".join(["often so"] * 2 + [f"w{rng.randrange(60)}" for _ in range(60)])) for _ in range(400)]
    df, want = spark.createDataFrame(docs, "lang string, text string").repartition(3), literal_phrases(docs, 30, 3, 2000)
    made, write = [], collocations.materialize
    monkeypatch.setattr(collocations, "materialize", lambda df, tag, **k: (made.append(write(df, tag, **k)), made[-1])[1])
    monkeypatch.setattr(collocations, "BUCKET_BITS", 8)
    assert sorted(map(tuple, collocations.collocations(df, 30, 3).collect())) == want and len(want) > 1
    passing = [t for t in made if "kind" in t.columns][1].where("kind = 1").select("phrase").distinct().count()
    assert passing < 1000  # of some 3600 pairs


def test_collocations_of_empty_tables(spark, none, odd):
    assert collocations.collocations(none).count() == 0
    assert collocations.collocations(odd, least=10**6).count() == 0


# genetic packing


@pytest.fixture(scope="module")
def words():
    return str(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))


TEXTS = ["", " ", "\n", "Don't STOP", "a  b", "é Ü ñandú İstanbul", "日本 語", "12 a1b2 ,.", "a\r\nb\tc", "x<|endoftext|>y", "é ́x", "\x00 \x1f\x1c", "🎉 ok", "ǅ ß ΑΣ", "a b"]


def test_word_ids_equal_the_library(words):
    own = WordCodec(words, most=20_000)
    for t in TEXTS:
        assert np.frombuffer(own.encode(t), own.dtype).tolist() == own.tok.encode(t, add_special_tokens=False).ids, t

    @settings(max_examples=300, deadline=None)
    @given(text=st.text(alphabet=st.one_of(st.sampled_from("aB 's,.\n1É\tß-́İ"), st.characters(codec="utf-8")), max_size=40))
    def same(text):
        assert np.frombuffer(own.encode(text), own.dtype).tolist() == own.tok.encode(text, add_special_tokens=False).ids

    same()


def check_packing(rows, texts, path, room):
    """Every id once, only long documents cut, sequences gapless and within their room; how many there are, and the least."""
    tok = WordCodec(path).tok
    pieces, total = {}, 0
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(texts)
    for doc, own in pieces.items():
        ids, at = tok.encode(texts[doc] or "", add_special_tokens=False).ids + [1], 0
        total += len(ids)
        for i, r in enumerate(sorted(own, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (i, at)
            part = np.array(ids[at : at + r["length"]], "<u4")
            assert r.ids_crc32 == zlib.crc32(part.tobytes()) and len(part) == r["length"]
            at += r["length"]
        assert at == len(ids) and all(r["length"] == room for r in sorted(own, key=lambda r: r.piece)[:-1])
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r["length"]))
    for held in bins.values():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in pairwise(held)) and sum(n for _, n in held) <= room
    return len(bins), -(-total // room)


def test_op11_packs_all_documents(spark, words):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    used, least = check_packing(queries.op11_genetic_packing(spark, SF).collect(), texts, words, 4096)
    assert used == least


def test_rounds_leave_one_open_sequence(spark, words):
    rng = random.Random(2)
    texts = {i: "word " * (rng.randint(1, 90) if i % 11 else 300) for i in range(1500)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    used, least = check_packing(genetic.pack_whole(docs, words, room=128, group=100).collect(), texts, words, 128)
    assert least <= used <= least * 1.04


def test_packing_of_odd_rows(spark, odd, none, words):
    assert genetic.pack_whole(none, words).count() == 0
    out = genetic.pack_whole(odd, words).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in odd.collect()}
    lone = [r for r in out if r["length"] == 1]
    assert len(lone) == 3 and all(r.ids_crc32 == zlib.crc32(b"\x01\0\0\0") for r in lone)


def test_evolution_finds_packings_that_best_fit_misses():
    for seed in range(4):
        rng = np.random.default_rng(seed)
        sizes = rng.integers(20, 101, 500)
        seeds = [genetic.seed_packing(sizes, 150, rng, 0.05 * i) for i in range(6)]
        best = genetic.evolve(sizes, 150, seeds, rng, 24)[0]
        assert (np.bincount(best.of, weights=sizes) == best.fill).all() and best.fill.max() <= 150
        assert -(-int(sizes.sum()) // 150) <= len(best.fill) < len(seeds[0].fill)


def test_crossover_keeps_every_piece_and_whole_bins():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 900, 400)
    a, b = genetic.seed_packing(sizes, 1000, rng, 0.3), genetic.seed_packing(sizes, 1000, rng, 0.3)
    child = genetic.crossover(sizes, 1000, a, b, rng)
    assert (np.bincount(child.of, weights=sizes, minlength=len(child.fill)) == child.fill).all() and child.fill.max() <= 1000
