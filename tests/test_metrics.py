import itertools
import random

import numpy as np
import pytest

from voxframe.operators import cluster, metrics
from voxframe.operators.cluster import agglomerate, diarize
from voxframe.operators.metrics import best_assignment, edit_counts


def table_counts(ref, hyp):
    best = {}
    for i in range(len(ref) + 1):
        for j in range(len(hyp) + 1):
            if i == 0 or j == 0:
                best[i, j] = (i + j, 0, i, j)
                continue
            miss = ref[i - 1] != hyp[j - 1]
            c, s, d, n = best[i - 1, j - 1]
            options = [(c + miss, s + miss, d, n)]
            c, s, d, n = best[i - 1, j]
            options.append((c + 1, s, d + 1, n))
            c, s, d, n = best[i, j - 1]
            options.append((c + 1, s, d, n + 1))
            best[i, j] = min(options, key=lambda o: o[0])
    return best[len(ref), len(hyp)][1:]


def test_edit_counts_equal_the_full_table():
    rng = random.Random(1)
    for _ in range(400):
        ref, hyp = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        assert edit_counts(ref, hyp) == table_counts(ref, hyp)


def test_pairs_compared_together_give_the_same(monkeypatch):
    rng = random.Random(2)
    pairs = [tuple([rng.choice("abcd") for _ in range(rng.randint(0, 30))] for _ in range(2)) for _ in range(200)]
    want = [table_counts(r, h) for r, h in pairs]
    for cells in (1, 50, 1 << 16):
        monkeypatch.setattr(metrics, "CELLS", cells)
        assert metrics.edit_counts_of(pairs) == want


@pytest.mark.parametrize("ref,hyp,want", [("hola que tal", "hola que tal a b c d e f g h", (8 / 3, 0, 0, 8)), ("a b", "", (1.0, 0, 2, 0)), ("", "a", (float("inf"), 0, 0, 1)), ("", "", (0.0, 0, 0, 0)), ("a b c", "a x c", (1 / 3, 1, 0, 0))])
def test_word_errors(spark, ref, hyp, want):
    df = spark.createDataFrame([(ref.split(), hyp.split())], "r array<string>, h array<string>")
    w = df.select(metrics.word_errors("r", "h").alias("w")).first().w
    assert (w.wer, w["sub"], w["del"], w["ins"]) == want


def test_micro_average_is_not_a_mean(spark):
    df = spark.createDataFrame([("k", ["a"], ["b"]), ("k", ["x"] * 100, ["x"] * 99 + ["y"])], "k string, r array<string>, h array<string>")
    assert metrics.micro_wer(df.select("k", metrics.word_errors("r", "h").alias("wer")), ["k"]).first().wer == 2 / 101


TURNS = "item_id string, speaker string, start_sec double, end_sec double"


def error(spark, ref, hyp, collar=0.0, **kw):
    side = lambda rows: spark.createDataFrame([("x", *r) for r in rows], TURNS)
    return metrics.der(side(ref), side(hyp), ["item_id"], collar, **kw).first()


def test_der_cases(spark):
    d = error(spark, [("A", 0.0, 10.0), ("B", 5.0, 10.0)], [("X", 0.0, 10.0)])
    assert (d.ref_sec, d.missed_sec, round(d.der, 9)) == (15.0, 5.0, round(1 / 3, 9))
    ref = [("A", 0.0, 10.0), ("B", 10.0, 20.0)]
    assert error(spark, ref, [("X", 0.0, 10.0), ("Y", 10.0, 20.0)]).der == 0
    assert error(spark, ref, [("X", 0.0, 15.0), ("Y", 15.0, 20.0)]).der == 0.25
    late = lambda s: [("X", 0.0, 10.0 + s), ("Y", 10.0 + s, 20.0)]
    assert error(spark, ref, late(0.1), 0.25).der == 0
    assert error(spark, ref, late(5.0), 0.25).der > 0.2  # the control
    many = [(str(i), float(i), i + 1.0) for i in range(9)]
    assert error(spark, many, ref).measurable is False


def brute_der(ref, hyp):
    end = max(round(t[2] * 100) for t in ref + hyp)
    at = lambda turns, i: {s for s, a, b in turns if round(a * 100) <= i < round(b * 100)}
    frames = [(at(ref, i), at(hyp, i)) for i in range(end)]
    rs, hs = sorted({t[0] for t in ref}), sorted({t[0] for t in hyp})
    total, best = sum(len(r) for r, _ in frames), None
    for pick in itertools.permutations([*hs, *[None] * len(rs)], len(rs)):
        m = dict(zip(rs, pick, strict=True))
        wrong = sum(max(len(r), len(h)) - sum(m[s] in h for s in r) for r, h in frames)
        best = wrong if best is None else min(best, wrong)
    return best / total


def test_der_equals_exhaustive_search(spark):
    rng = random.Random(2)
    turns = lambda names: [(rng.choice(names), a := round(rng.uniform(0, 8), 2), round(a + rng.uniform(0.2, 3), 2)) for _ in range(6)]
    for _ in range(4):
        ref, hyp = turns("ABC"), turns("XYZ")
        assert abs(error(spark, ref, hyp).der - brute_der(ref, hyp)) < 1e-9


def test_assignment_equals_permutations():
    rng = random.Random(4)
    for _ in range(50):
        w = {(r, h): rng.randint(0, 9) for r in "abcd" for h in "wxyz"}
        assert best_assignment(w)[0] == max(sum(w[r, h] for r, h in zip("abcd", p, strict=True)) for p in itertools.permutations("wxyz"))


def literal_clusters(vectors, threshold, most):
    import numpy as np

    x = np.asarray(vectors, float)
    sim = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    groups = [[i] for i in range(len(x))]
    while len(groups) > 1:
        pairs = [(np.mean([sim[i, j] for i in a for j in b]), p, q) for p, a in enumerate(groups) for q, b in enumerate(groups) if p < q]
        top = max(pairs, key=lambda t: (t[0], -t[1], -t[2]))
        if top[0] < threshold and len(groups) <= most:
            break
        joined = groups[top[1]] + groups[top[2]]
        groups = [g for k, g in enumerate(groups) if k not in top[1:]] + [joined]
    return sorted(sorted(g) for g in groups)


def test_clusters_equal_a_literal_search():
    import numpy as np

    rng = np.random.default_rng(6)
    for _ in range(20):
        x = rng.normal(size=(rng.integers(1, 14), 5)).astype("float32")
        assert agglomerate(x, 0.4, 6) == literal_clusters(x, 0.4, 6)
    axis = np.eye(3)[[0, 0, 0, 1, 1, 2]]
    assert agglomerate(axis, 0.5) == [[0, 1, 2], [3, 4], [5]]
    assert agglomerate(axis[:0], 0.5) == []


def test_diarize(spark):
    rows = [("m", 0, 0.0, 2.0, [1.0, 0.0]), ("m", 1, 2.0, 2.2, [0.0, 0.0]), ("m", 2, 3.0, 5.0, [0.0, 1.0]), ("m", 3, 6.0, 8.0, [1.0, 0.1]), ("s", 0, 0.0, 0.1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "k string, idx int, start_sec double, end_sec double, embedding array<float>")
    got = {(r.k, r.idx): r.speaker for r in diarize(df, ["k"]).collect()}
    assert got == {("m", 0): "0", ("m", 1): "1", ("m", 2): "1", ("m", 3): "0", ("s", 0): "0"}


def test_plateau(spark):
    rows = [(t, d) for t, ds in {0.3: (0.2, 0.22), 0.4: (0.05, 0.054), 0.5: (0.052, 0.054), 0.6: (0.07, None)}.items() for d in ds]
    p = metrics.sweep_plateau(spark.createDataFrame(rows, "threshold double, der double")).first()
    assert (p.low, p.high, p.centre) == (0.4, 0.5, 0.45)


def test_cosine_pairs_of_a_key_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(23, 4)).round(3)
    df = spark.createDataFrame([("k" if i < 20 else "m", i, x[i].tolist()) for i in range(23)], "k string, vec_id int, embedding array<float>")
    monkeypatch.setattr(metrics, "BLOCK", 6)
    got = {(r.a_vec_id, r.b_vec_id): r.cosine for r in metrics.cosine_pairs(df, ["k"]).collect()}
    pairs = [(i, j) for i in range(23) for j in range(i + 1, 23) if (i < 20) == (j < 20)]
    assert sorted(got) == pairs
    y = x.astype("float32").astype("float64")
    assert all(abs(got[i, j] - y[i] @ y[j] / np.linalg.norm(y[i]) / np.linalg.norm(y[j])) < 1e-12 for i, j in pairs)


def literal_groups(vectors, threshold, most=None):
    """Average linkage by all pairs of all groups, in the order of a list."""
    unit = [v / n if (n := np.sqrt((v * v).sum())) else v * 0 for v in np.asarray(vectors, "float64")]
    groups = [[i] for i in range(len(unit))]
    most = len(groups) if most is None else most
    while len(groups) > 1:
        best = (-np.inf, 0, 0)
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                mean = round(float(sum(unit[a] @ unit[b] for a in groups[i] for b in groups[j])) / (len(groups[i]) * len(groups[j])), 12)
                if mean > best[0]:
                    best = (mean, i, j)
        if best[0] < threshold and len(groups) <= most:
            break
        _, i, j = best
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [groups[i] + groups[j]]
    return sorted((sorted(g) for g in groups), key=lambda g: g[0])


def test_groups_equal_the_definition_with_ties():
    rng = np.random.default_rng(3)
    for case in range(300):
        n = int(rng.integers(1, 14))
        if case % 3 == 0:  # along axes: most means tie
            x = np.eye(4)[rng.integers(0, 4, n)] * rng.integers(0, 3, (n, 1))
        elif case % 3 == 1:  # repeated vectors
            x = rng.normal(size=(4, 3))[rng.integers(0, 4, n)]
        else:
            x = rng.normal(size=(n, 5))
        x = x.astype("float32")
        threshold, most = float(rng.choice([-2, 0.0, 0.4, 0.8, 1.0])), [None, 1, 3][int(rng.integers(0, 3))]
        assert cluster.agglomerate(x, threshold, most) == literal_groups(x, threshold, most), (case, threshold, most)


def test_groups_of_many_vectors_take_memory_linear_in_them(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(cluster, "ROWS", 64)

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    of = rng.integers(0, 12, 3000)
    x = (centres[of] + 0.05 * rng.normal(size=(3000, 16))).astype("float32")
    tracemalloc.start()
    groups = cluster.agglomerate(x, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(groups) == 12 and all(len({int(of[i]) for i in g}) == 1 for g in groups)
    assert peak < 3000 * 3000 * 8 / 4  # a quarter of one matrix


def test_assignment_of_any_size():
    from itertools import permutations

    rng = np.random.default_rng(5)
    for _ in range(200):
        n, m = int(rng.integers(1, 6)), int(rng.integers(1, 6))
        w = {(f"r{i}", f"h{j}"): int(rng.integers(0, 6)) for i in range(n) for j in range(m)}
        refs, hyps = [f"r{i}" for i in range(n)], [f"h{j}" for j in range(m)]
        small, large = (refs, hyps) if n <= m else (hyps, refs)
        brute = max(sum(w[(a, b) if n <= m else (b, a)] for a, b in zip(small, p, strict=True)) for p in permutations(large, len(small)))
        for total, pairs in (metrics.best_assignment(w), metrics._augmenting(w, refs, hyps)):
            assert total == brute == sum(w[p] for p in pairs.items()) and len(set(pairs.values())) == len(pairs)
    w = {(f"r{i:03d}", f"h{j:03d}"): int(x) for (i, j), x in np.ndenumerate(rng.integers(0, 50, (200, 200)))}
    order = rng.permutation(200)
    for i in range(200):
        w[f"r{i:03d}", f"h{order[i]:03d}"] = 1000 + i
    total, pairs = metrics.best_assignment(w)
    assert total == sum(1000 + i for i in range(200)) and all(pairs[f"r{i:03d}"] == f"h{order[i]:03d}" for i in range(200))


def test_der_of_two_hundred_labels_is_exact(spark):
    """Labels past one word of a mask, two speaking at a time, each named anew."""
    ref = [("a", f"s{i:03d}", float(i), i + 1.5) for i in range(200)]
    hyp = [("a", f"t{(i * 7) % 200:03d}", float(i), i + 1.5) for i in range(200)]
    rows = lambda x: spark.createDataFrame(x, "item string, speaker string, start_sec double, end_sec double")
    parts = metrics.der_parts(rows(ref), rows(hyp), ["item"], 0.0, 200)
    assert parts.where("size(ref) <> n_ref OR size(hyp) <> n_hyp").count() == 0 and parts.where("n_ref = 2").count() == 199
    assert metrics.der_parts(rows(ref), rows(hyp), ["item"]).where("n_ref > 0 AND ref IS NOT NULL").count() == 0  # never a part of a set
    (out,) = metrics.der(rows(ref), rows(hyp), ["item"], 0.0, 200).collect()
    assert out.measurable and out.der == 0.0 and len(out.mapping) == 200
    (out,) = metrics.der(rows(ref), rows(hyp[:150] + [("a", "other", 150.0, 201.0)]), ["item"], 0.0, 200).collect()
    assert out.measurable and out.ref_sec == 300.0 and abs(out.missed_sec + out.confusion_sec + out.false_sec - (49.5 + 51.0 - 1.5 + 0.0)) < 60
    (out,) = metrics.der(rows(ref), rows(hyp), ["item"]).collect()
    assert not out.measurable and out.der is None


def test_long_pairs_in_a_band_equal_the_whole_table(monkeypatch):
    rng = random.Random(7)
    for case in range(120):
        ref = [rng.choice("abcd"[: 1 + case % 4]) for _ in range(rng.randint(1, 60))]
        hyp = [rng.choice("abcd") if rng.random() < 0.2 else w for w in ref if rng.random() < 0.85] or ["a"]
        at = rng.randrange(len(hyp) + 1)
        hyp[at:at] = [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
        want = metrics._diagonals([(ref, hyp)])[0]
        assert metrics._banded(ref, hyp) == want
        ids = {w: i for i, w in enumerate("abcd")}
        a, b = np.array([ids[w] for w in ref], "int32"), np.array([ids[w] for w in hyp], "int32")[::-1].copy()
        for width in range(1, 40, 3):  # too narrow a band is told, any other gives the same
            found = metrics._band(a, b, len(ref), len(hyp), width)
            assert (found is None) == (sum(want) > width) and (found is None or found == (sum(want), want[0]))


def test_very_long_pairs_take_seconds():
    rng = random.Random(2)
    ref = [str(rng.randrange(5000)) for _ in range(60_000)]
    hyp = [w if rng.random() > 0.005 else "other" for w in ref if rng.random() > 0.003]
    s, d, i = metrics.edit_counts(ref, hyp)
    assert len(ref) - d + i == len(hyp) and 100 < s < 500 and 100 < d < 300


def test_contained_texts_equal_contains_of_each_pair(spark):
    from pyspark.sql import functions as F

    from voxframe.operators import corpus

    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abñ ") for _ in range(rng.randint(0, n)))
    texts = [(rng.choice([1, 2, 3, None, 9]), rng.choice([word(3), word(6), None, "ab"])) for _ in range(300)]
    refs = [(1, word(200)), (2, word(60)), (2, word(80)), (3, None), (None, "ab"), (7, "ab")]
    t, r = spark.createDataFrame(texts, "k long, text string").repartition(4), spark.createDataFrame(refs, "k long, reference string")
    met = t.join(r, "k").groupBy("k").agg(F.count_if(F.contains("reference", "text")).alias("inside"), F.count("*").alias("n"))
    want = sorted(map(tuple, met.collect()))
    assert sorted((x.k, x.inside, x.n) for x in corpus.contained_share(t, r, ["k"]).collect()) == want and len(want) == 3
    none = spark.createDataFrame([(1, None), (1, None)], "k long, text string")
    assert [tuple(x) for x in corpus.contained_share(none, r, ["k"]).collect()] == [(1, 0, 2, False)]
    assert corpus.contained_share(t.where("false"), r, ["k"]).count() == 0


def test_der_sweep_holds_numbers_alone_in_tasks_of_bounded_turns(spark, monkeypatch):
    """What the sweep sorts is numbers beside the keys, without the item's labels, in as many parts as the turns need."""
    rows = [(i % 7, "abc"[i % 3], i * 1.0, i + 1.5) for i in range(60)]
    ref = spark.createDataFrame(rows, "item int, speaker string, start_sec double, end_sec double")
    whole = sorted(map(tuple, metrics.der_sums(ref, ref, ["item"], 0.25).collect()))
    plan = metrics.der_sums(ref, ref, ["item"], 0.25)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "first(" not in plan
    monkeypatch.setattr(metrics, "TASK_TURNS", 10)
    points = metrics._der_points(ref, ref, ["item"], 0.25, 62)
    assert points.rdd.getNumPartitions() == 12
    assert sorted(map(tuple, metrics.der_sums(ref, ref, ["item"], 0.25).collect())) == whole
    assert whole == sorted(map(tuple, metrics.der_totals(metrics.der_parts(ref, ref, ["item"], 0.25), ["item"]).collect()))


def test_der_parts_keep_null_keys_and_labels(spark):
    ref = spark.createDataFrame([(None, "a", 0.0, 2.0), (None, None, 1.0, 3.0), (1, "b", 0.0, 1.0)], "item int, speaker string, start_sec double, end_sec double")
    got = {(r["item"], r.f0, r.f1, tuple(r.ref), tuple(r.hyp), r.n_ref, r.n_hyp) for r in metrics.der_parts(ref, ref, ["item"]).collect()}
    at = metrics.FRAMES_PER_SEC
    assert got == {(None, 0, at, ("a",), ("a",), 1, 1), (None, at, 2 * at, ("a",), ("a",), 2, 2), (None, 2 * at, 3 * at, (), (), 1, 1), (1, 0, at, ("b",), ("b",), 1, 1)}
