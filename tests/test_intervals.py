import random

from pyspark.sql import functions as F

from voxframe.operators import intervals


def literal_segments(probs, dur, thr=0.5, silence=200, speech=250, pad=100, win=32):
    raw, start = [], None
    for i, p in enumerate([*probs, None]):
        on = p is not None and p > thr
        if on and start is None:
            start = i
        if not on and start is not None:
            raw.append([start * win / 1000, dur if p is None else i * win / 1000])
            start = None
    merged = []
    for s in raw:
        if merged and (s[0] - merged[-1][1]) * 1000 < silence:
            merged[-1][1] = s[1]
        else:
            merged.append(s)
    kept = [s for s in merged if (s[1] - s[0]) * 1000 >= speech]
    out = []
    for i, (a, b) in enumerate(kept):
        low = (kept[i - 1][1] + a) / 2 if i else 0
        high = (b + kept[i + 1][0]) / 2 if i + 1 < len(kept) else dur
        out.append((max(low, a - pad / 1000), min(high, b + pad / 1000)))
    return out


def test_segments_equal_a_literal_fold(spark):
    rng, rows, want = random.Random(3), [], {}
    for k in range(30):
        n, probs, on = rng.randint(1, 120), [], False
        for _ in range(n):
            on = on if rng.random() < 0.85 else not on
            probs.append(0.95 if on else rng.choice([0.02, 0.5]))
        rows += [(str(k), i, p, n * 0.032) for i, p in enumerate(probs)]
        want[str(k)] = literal_segments(probs, n * 0.032)
    got = {}
    for r in intervals.to_segments(spark.createDataFrame(rows, "signal_id string, w int, p double, duration_sec double"), ["signal_id"]).orderBy("signal_id", "idx").collect():
        got.setdefault(r.signal_id, []).append((r.start_sec, r.end_sec))
    assert {k: [(round(a, 9), round(b, 9)) for a, b in v] for k, v in want.items() if v} == {k: [(round(a, 9), round(b, 9)) for a, b in v] for k, v in got.items()}


def test_merge_comes_before_the_length_filter(spark):
    pattern = ([0.95] * 5 + [0.02] * 3) * 3
    df = spark.createDataFrame([("a", i, p, len(pattern) * 0.032) for i, p in enumerate(pattern)], "signal_id string, w int, p double, duration_sec double")
    assert intervals.to_segments(df, ["signal_id"]).count() == 1
    assert intervals.to_segments(df, ["signal_id"], min_silence_ms=50).count() == 0  # the control


def blocks_of(spark, spans, most):
    df = spark.createDataFrame([("a", i, float(s), float(e)) for i, (s, e) in enumerate(spans)], "k string, idx int, start_sec double, end_sec double")
    return [(r.start_sec, r.end_sec, len(r.segments)) for r in intervals.to_blocks(df, ["k"], most).orderBy("block_id").collect()]


def test_blocks(spark):
    assert blocks_of(spark, [(0, 10), (11, 20), (21, 30), (31, 40)], 28.0) == [(0, 20, 2), (21, 40, 2)]
    assert blocks_of(spark, [(0, 5), (6, 66), (67, 70)], 28.0) == [(0, 5, 1), (6, 66, 1), (67, 70, 1)]
    assert blocks_of(spark, [(0, 28)], 28.0) == [(0, 28, 1)]


def test_nearest_takes_the_earlier_on_ties(spark):
    rows = [("a", 0, 0.0, "A"), ("a", 1, 5.0, None), ("a", 2, 10.0, "B"), ("a", 3, 11.0, None), ("b", 0, 0.0, None)]
    df = spark.createDataFrame(rows, "k string, idx int, t double, label string")
    got = {(r.k, r.idx): r.label for r in intervals.nearest_label(df, ["k"], "t", "label").collect()}
    assert got == {("a", 0): "A", ("a", 1): "A", ("a", 2): "B", ("a", 3): "B", ("b", 0): "0"}


def test_overlap_join_equals_all_pairs(spark):
    rng = random.Random(5)
    spans = lambda n: [("k", i, a := rng.uniform(0, 500), a + rng.uniform(0.1, 90)) for i in range(n)]
    a, b = spans(40), spans(40)
    left = spark.createDataFrame(a, "k string, i int, start_sec double, end_sec double")
    right = spark.createDataFrame(b, "k string, j int, r_start double, r_end double")
    got = sorted((r.i, r.j) for r in intervals.overlap_join(left, right, ["k"]).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[2] < y[3] and y[2] < x[3])


def test_point_in_interval_is_half_open(spark):
    points = spark.createDataFrame([("k", x) for x in (0.0, 9.99, 10.0, 25.0)], "k string, t double")
    spans = spark.createDataFrame([("k", 0, 0.0, 10.0), ("k", 1, 10.0, 20.0)], "k string, idx int, start_sec double, end_sec double")
    got = {r.t: r.active_idx for r in intervals.at_point(points, spans, ["k"], "t").collect()}
    assert got == {0.0: 0, 9.99: 0, 10.0: 1, 25.0: -1}


def test_decode_windows(spark):
    n = lambda d: len(spark.range(1).select(intervals.decode_windows(F.lit(float(d))).alias("x")).first().x)
    assert [n(10), n(30), n(31), n(50), n(51)] == [1, 1, 2, 2, 3]


def test_stretches_equal_windows(spark, monkeypatch):
    """One key of many rows, small ones, a null key; stretches of a few rows or seconds."""
    import random

    from voxframe.operators import scans

    monkeypatch.setattr(scans, "STRETCH_ROWS", 7)
    monkeypatch.setattr(scans, "STRETCH_SEC", 0.5)
    rng = random.Random(6)
    probs = [(k, w, rng.random(), n * 0.032) for k, n in (("big", 400), ("one", 1), (None, 30), ("few", 9)) for w in range(n)]
    probs = [(k, w, (0.9 if w % 40 < 25 else 0.1) if p < 0.97 else 1 - p, d) for k, w, p, d in probs]
    df = spark.createDataFrame(probs, "k string, w long, p double, duration_sec double").repartition(5)
    same = lambda a, b: sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
    plain, cut = (intervals.to_segments(df, ["k"], stretched=s) for s in (False, True))
    assert plain.count() > 8 and same(plain, cut)
    rows = [(k, i, float(rng.randrange(200)) / 10, rng.choice([None, None, "x", "y"])) for k, n in (("big", 200), (None, 20), ("none", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, idx long, t double, label string")
    assert same(*(intervals.nearest_label(df, ["k"], "t", "label", stretched=s) for s in (False, True)))
    rows = [(k, i, rng.random() * 30, 500.0) for k in ("big", None) for i in range(150)]
    df = spark.createDataFrame(rows, "k string, seq long, t double, duration_sec double")
    assert same(*(intervals.monotone_progress(df, ["k"], stretched=s) for s in (False, True)))


def test_stretches_are_read_by_many_tasks(spark):
    from voxframe.operators import scans

    rows = spark.range(400_000).selectExpr("0 AS k", "id AS w", "cast(id % 3 AS double) AS x")
    out = scans.scanned(rows, ["k"], ["w"], scans.by_number("w"), total=("sum", F.col("x")), before=("prev", F.col("w")))
    assert out.where("w > 0 AND before <> w - 1 OR w = 0 AND before IS NOT NULL").count() == 0
    assert out.agg(F.max("total")).first()[0] == sum(i % 3 for i in range(400_000))
    assert rows.select(scans.by_number("w").alias("s")).distinct().count() == 7


def test_intervals_of_any_length_meet_once(spark):
    """Against all pairs; lengths from nothing to months, and rows that do not grow with the length."""
    import random

    rng = random.Random(8)

    def some(n):
        out = []
        for i in range(n):
            start = rng.uniform(-50, 4000)
            out.append((rng.choice("ab"), i, start, start + rng.choice([0.0, 0.3, 5.0, 16.0, 17.0, 300.0, 1e7])))
        return out

    left, right = some(70), some(60)
    a = spark.createDataFrame(left, "k string, idx int, start_sec double, end_sec double")
    b = spark.createDataFrame(right, "k string, r_idx int, r_start double, r_end double")
    got = sorted((r.idx, r.r_idx, r.overlap_sec) for r in intervals.overlap_join(a, b, ["k"]).collect())
    want = sorted((i, j, min(e, f) - max(s, t)) for k, i, s, e in left for m, j, t, f in right if k == m and s < f and t < e)
    assert got == want and len(want) > 200
    held = a.withColumn("_class", intervals._class("start_sec", "end_sec"))
    rows = intervals._bucketed(held, "start_sec", "end_sec", intervals._classes(held))
    assert rows.groupBy("idx", "_m").count().agg(F.max("count")).first()[0] <= 2
    points = spark.createDataFrame([(k, i, t) for i, (k, t) in enumerate([("a", 10.0), ("b", 9e6), ("c", 1.0), ("a", -60.0), (None, 5.0), ("a", None)])], "k string, n int, t double")
    got = {r.n: r.active_idx for r in intervals.at_point(points, a, ["k"], "t").collect()}
    first = lambda k, t: min((i for m, i, s, e in left if k == m and t is not None and s <= t < e), default=-1)
    assert got == {i: first(k, t) for i, (k, t) in enumerate([("a", 10.0), ("b", 9e6), ("c", 1.0), ("a", -60.0), (None, 5.0), ("a", None)])}
    assert intervals.at_point(points, a.where("false"), ["k"], "t").where("active_idx = -1").count() == 6
