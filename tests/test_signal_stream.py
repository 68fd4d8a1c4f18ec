import hashlib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.sources import readers
from voxframe.operators import bench, recurrent, signal
from voxframe.streaming import stateful, streams


def tone(hz, rate, sec=1.0):
    return np.sin(2 * np.pi * hz * np.arange(int(rate * sec)) / rate)


def test_resampling_keeps_low_and_stops_high_tones():
    level = lambda x: float(np.sqrt((x[200:-200] ** 2).mean()))
    low, high = signal.resample_clip(tone(440, 48000), 48000, 16000), signal.resample_clip(tone(11000, 48000), 48000, 16000)
    assert len(low) == 16000 and abs(level(low) - 0.7071) < 0.01 and level(high) < 0.01
    assert len(signal.resample_clip(tone(440, 44100), 44100, 16000)) == 16000
    with pytest.raises(ValueError):
        signal.resample_clip(tone(440, 8000), 8000, 16000)


def test_mix_has_the_ratio_asked_for():
    s, n = tone(300, 16000) * 0.1, signal.room_noise(4000, level=0.5)
    out = signal.mix(s, n, 10.0)
    noise = out - s
    assert abs(20 * np.log10(np.sqrt((s**2).mean()) / np.sqrt((noise**2).mean())) - 10) < 0.1
    assert np.abs(signal.mix(tone(1, 100) * 2, n, 0.0)).max() <= 0.99 + 1e-9


def test_babble_draws_its_layers():
    rate, pool = 100, [np.full(100, float(i)) for i in range(60)]
    draws = iter([0.0, 0.5, 0.99, 0.0, 0.5, 0.99])
    out = signal.babble(pool, 300, draws, rate)
    assert len(out) == 300
    want = np.zeros(300)
    for k, first in enumerate([0, 10, 19, 0, 10, 19]):  # one of 60 - 40 places
        layer = np.concatenate([np.concatenate((pool[first + i], np.zeros(5))) for i in range(3)])
        want += [layer[(i + k * len(layer) // 6) % len(layer)] for i in range(300)]
    assert np.allclose(out, want / 6)
    assert not signal.babble([np.ones(10)], 50, iter([0.1] * 6), rate).any()  # all too short


def test_room_noise_equals_its_recurrence():
    state, want = 7, []
    for _ in range(1000):
        state = (state * 1664525 + 1013904223) % 2**32
        want.append((state / 2**32 * 2 - 1) * 0.01)
    assert np.allclose(signal.room_noise(1000, 7), want) and len(signal.room_noise(0)) == 0


def test_wav_round_trip(spark, tmp_path):
    x = tone(440, 8000, 0.1).astype("float32")
    rate, channels, back = readers.parse_wav(readers.write_wav(x, 8000))
    assert (rate, channels, len(back)) == (8000, 1, len(x)) and np.abs(back - x).max() < 1e-4
    (tmp_path / "a.wav").write_bytes(readers.write_wav([2.0, -2.0, 0.0], 16000))
    (tmp_path / "b.wav").write_bytes(b"nope")
    rows = {r.path.rsplit("/", 1)[-1]: r for r in readers.wav(spark, str(tmp_path / "*.wav")).collect()}
    assert rows["a.wav"].samples[0] > 0.999 and rows["a.wav"].error is None
    assert rows["b.wav"].sha256 == hashlib.sha256(b"nope").hexdigest()
    assert rows["b.wav"].samples is None and rows["b.wav"].error


def test_index_readers(spark, tmp_path):
    (tmp_path / "i.tsv").write_text(" a \tx\ty \r\n\nb\tz\n")
    (tmp_path / "i.csv").write_text('1, s1, "hola, mundo"\nonly, two\n3, , no id\n4, s4, ""\n5,s5,"a" b\n')
    assert sorted(map(tuple, readers.tsv_index(spark, str(tmp_path / "i.tsv")).collect())) == [("a", "x\ty"), ("b", "z")]
    assert sorted(map(tuple, readers.csv_index(spark, str(tmp_path / "i.csv")).collect())) == [("s1", "hola, mundo"), ("s5", 'a" b')]
    agents = spark.createDataFrame([("Mozilla Chrome/1 Edg/2",), ("Chrome/1 Safari/2",), ("Firefox/3",), ("x",)], "a string")
    assert [r[0] for r in agents.select(readers.browser_of(F.col("a"))).collect()] == ["edge", "chrome", "firefox", "otro"]


def test_levels(spark):
    df = spark.createDataFrame([("a", i, 1.0 if 16 <= i < 32 else 0.01) for i in range(41)], "k string, i int, x double")
    e = signal.energy_per_second(df, ["k"], 16)
    assert {r.sec: r.n for r in e.collect()} == {0: 16, 1: 16, 2: 9}
    assert signal.burst_pattern(e, ["k"], ((1.0, 2.0),)).first().pattern_ok is True
    assert signal.burst_pattern(e, ["k"], ((0.0, 1.0),)).first().pattern_ok is False  # the control
    assert signal.frames(df, ["k"], 16).count() == 2
    t = signal.trim_edges(df, ["k"], 0.5).first()
    assert (t.first_i, t.last_i) == (16, 31)


def test_stream_segments_equal_batch(spark, tmp_path):
    probs = ([0.95] * 12 + [0.02] * 10) * 3
    rows = [("a", i, p) for i, p in enumerate(probs)]
    src, out = tmp_path / "src", tmp_path / "out"
    for k in range(0, len(rows), 20):  # arrives in pieces that cut segments
        spark.createDataFrame(rows[k : k + 20], "k string, w int, p double").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("k string, w int, p double").option("maxFilesPerTrigger", 1).parquet(str(src))
    q = streams.write_batches(streams.segments(stream, "k"), str(out), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = sorted((r.start_sec, r.end_sec) for r in spark.read.parquet(str(out)).collect()) if out.exists() else []
    want = [(i * 22 * 0.032, (i * 22 + 12) * 0.032) for i in range(2)]  # the last one is still open
    assert [(round(a, 6), round(b, 6)) for a, b in got] == [(round(a, 6), round(b, 6)) for a, b in want]


def test_stream_windows(spark, tmp_path):
    spark.sql("select 'u' k, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,n*20) ts, 1D value from (select explode(sequence(0, 9)) n)").coalesce(1).write.parquet(str(tmp_path / "s"))
    schema = "k string, ts timestamp, value double"
    src = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "s"))
    for name, df in (("e", streams.energy(src(), "k")), ("s", streams.sliding(src(), "k")), ("g", streams.sessions(src(), "k"))):
        q = df.writeStream.format("memory").queryName(f"q_{name}").outputMode("complete" if name != "g" else "append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("q_e").first().rms == 1.0
    assert spark.table("q_s").count() == 20  # every event is in two windows


def test_isolated_model_slot(spark):
    df = spark.createDataFrame([("a",), (" ",), ("bad",)], "t string")

    def call(x):
        if x == "bad":
            raise ValueError("no")
        return x.upper()

    got = [(r.result.value, r.result.status, r.result.error) for r in streams.isolated(df, call, "t").collect()]
    assert got == [("A", "ok", None), (" ", "skipped", None), (None, "error", "no")]

    def slow(x):
        time.sleep(3 if x == "a" else 0)
        return [0.5, float(len(x))]

    late = [(r.result.value, r.result.status) for r in streams.isolated(df.coalesce(1), slow, "t", kind="array<float>", seconds=0.5).collect()]
    assert late == [(None, "timeout"), (None, "skipped"), ([0.5, 3.0], "ok")]


def test_blocks_are_sent_in_order(spark, tmp_path):
    for k, rows in enumerate([[(7, 2, "c"), (7, 0, "a")], [(8, 1, "y")], [(7, 1, "b"), (7, 0, "again"), (8, 0, "x")], [(7, 5, "early")]]):
        spark.createDataFrame(rows, "k long, block_index long, payload string").coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
        time.sleep(0.02)
    stream = spark.readStream.schema("k long, block_index long, payload string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src"))
    out = stateful.in_order(stream, "k")
    assert dict(out.dtypes)["k"] == "bigint"
    q = streams.write_batches(out, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    sent = lambda k: [(r.block_index, r.payload) for r in sorted((r for r in rows if r.k == k), key=lambda r: (r.batch_id, r.block_index))]
    assert sent(7) == [(0, "a"), (1, "b"), (2, "c")] and sent(8) == [(0, "x"), (1, "y")]


def smoother():
    """A linear model of two leaking sums."""

    def smooth(state, x):
        new = [0.9 * state[0] + 0.1 * x[0], 0.5 * state[1] + x[0]]
        return new, new[0] + 0.01 * new[1]

    return smooth


def started(stream, path, cp, mode="append", then=None):
    q = streams.write_batches(stream, str(path), str(cp), mode=mode, then=then)
    assert q.awaitTermination(180)
    return q


def test_recurrent_stream_equals_the_batch_fold(spark, tmp_path):
    """Windows shuffled over batches, some twice, one never; a restart in between."""
    import random
    from datetime import datetime, timedelta

    rng, start = random.Random(4), datetime(2024, 1, 1)
    rows = [(k, w, start + timedelta(seconds=w), rng.random()) for k in (1, 2, 3) for w in range(40) if (k, w) != (2, 7)]
    rows.sort(key=lambda r: (r[1] + rng.random() * 6, r[0]))  # out of order by up to six windows
    rows += [rows[5], rows[50]]
    schema = "k long, w long, ts timestamp, x double"

    def put(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
        time.sleep(0.02)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src"))
        started(stateful.recurrent(stream, "k", smoother(), [0.0, 0.0], late="5 seconds"), tmp_path / "out", tmp_path / "cp")

    for i in range(0, 60, 30):
        put(rows[i : i + 30])
    run()
    first = spark.read.parquet(str(tmp_path / "out")).count()
    assert 0 < first < 60
    for i in range(60, len(rows), 35):
        put(rows[i : i + 35])
    put([(9, 0, start + timedelta(hours=1), 0.5)])  # moves the watermark past all that waits
    put([(9, 1, start + timedelta(hours=2), 0.5)])
    run()
    got = sorted((r.k, r.w, r.score) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = recurrent.recurrent_scores(spark.createDataFrame([*rows, (9, 0, start, 0.5), (9, 1, start, 0.5)], schema), ["k"], smoother(), [0.0, 0.0])
    want = sorted((r.k, r.w, r.score) for r in batch.collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] and len(got) == 119 + 2
    assert np.allclose([g[2] for g in got], [w[2] for w in want])


def test_recurrent_scores_of_odd_rows(spark):
    rows = [(None, 1, [1.0]), (None, 0, [2.0]), ("a", 0, None), ("a", 0, [5.0]), ("a", 3, [1.0, 2.0])]
    df = spark.createDataFrame(rows[:2] + rows[3:], "k string, w int, x array<double>")
    out = recurrent.recurrent_scores(df, ["k"], lambda s, x: ([s[0] + sum(x)], s[0] + len(x)), [0.0])
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(None, 0, 1.0), (None, 1, 3.0), ("a", 0, 1.0), ("a", 3, 7.0)], key=repr)
    none = spark.createDataFrame(rows[2:3], "k string, w int, x array<double>")
    assert [r.score for r in recurrent.recurrent_scores(none, ["k"], lambda s, x: (s, len(x)), [0.0]).collect()] == [0.0]
    assert recurrent.recurrent_scores(df.where("false"), ["k"], smoother(), [0.0, 0.0]).count() == 0


def test_running_estimate_stream_equals_the_batch_form(spark, tmp_path):
    schema = "run string, seq long, kind string, elapsed_sec double, processed_sec double, duration_sec double, learned double, median double"
    rows = []
    for run, learned in (("a", None), ("b", 0.7), ("c", 0.0)):
        rows += [(run, 0, "start", 0.0, None, 600.0, learned, 0.5), (run, 1, "calibrate", 21.0, 30.0 if run != "c" else 20.0, 600.0, learned, 0.5), (run, 2, "block", 40.0, 60.0, 600.0, learned, 0.5)]
        rows += [(run, 3, "refine", 45.0, 30.0, 600.0, learned, 0.5), (run, 4, "refine", 80.0, 120.0, 600.0, learned, 0.5), (run, 5, "refine", 0.0, 120.0, 600.0, learned, 0.5), (run, 6, "block", 300.0, 700.0, 600.0, learned, 0.5)]
    src = tmp_path / "src"
    told = []

    saved = lambda batch: spark.read.parquet(str(tmp_path / "out")).where(f"batch_id = {batch}")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
        tell = lambda save: stateful.told(save, lambda batch, row: told.append((batch, row["run"], row["last"])), "run", "seq", saved)
        started(stateful.running_estimate(stream, "run", "seq"), tmp_path / "out", tmp_path / "cp", "update", tell)

    for part in ([r for r in rows if r[1] < 3], [r for r in rows if r[1] == 3]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
        time.sleep(0.02)
    run()
    spark.createDataFrame([r for r in rows if r[1] in (2, 4, 5, 6)][::-1], schema).coalesce(1).write.mode("append").parquet(str(src))
    run()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch_id").collect()
    want = bench.running_estimate(spark.createDataFrame(rows, schema), ["run"], "seq").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)
    assert {(r, n) for _, r, n in told} == {(r, n) for r in "abc" for n in (2, 3, 6)}


def test_late_calls_do_not_hold_a_worker(spark):
    df = spark.createDataFrame([("a",), ("b",)], "t string").coalesce(1)

    def stuck(x):
        time.sleep(60 if x == "a" else 0)
        return x

    begun = time.monotonic()
    assert [r.result.status for r in streams.isolated(df, stuck, "t", seconds=0.3).collect()] == ["timeout", "ok"]
    assert time.monotonic() - begun < 30


def test_blocks_are_resampled_as_the_whole(spark):
    rng = np.random.default_rng(3)
    size, rows, whole = 500, [], {}
    for k, (rate, n) in enumerate([(48000, 5321), (44100, 4999), (44100, 1001), (22050, 500), (48000, 40), (16000, 1200), (44100, 1502), (32000, 0)]):
        x = rng.normal(size=n).astype("float32")
        whole[k] = signal.resample_clip(x, rate, 16000)
        rows += [(k, b, rate, x[b * size : (b + 1) * size].tolist()) for b in range(max(1, -(-n // size)))]
    out = signal.resample_blocks(spark.createDataFrame(rows, "k int, block long, rate int, samples array<float>").repartition(5), ["k"], 16000, size)
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.k, r.block)):
        assert r.rate == 16000
        got.setdefault(r.k, []).extend(r.samples)
    for k, x in whole.items():
        assert len(got[k]) == len(x) and np.allclose(got[k], x, atol=1e-6), k
    with pytest.raises(ValueError):
        signal.resample_blocks(out, ["k"], 8000, 50)


def test_long_wav_files_are_read_in_ranges(spark, tmp_path):
    from voxframe.sources import wavsource

    x = (np.sin(np.arange(50_000) / 30) * 0.5).astype("float32")
    (tmp_path / "a.wav").write_bytes(readers.write_wav(x, 16000))
    (tmp_path / "b.wav").write_bytes(b"nope")
    (tmp_path / "c.wav").write_bytes(readers.write_wav([], 16000))
    (tmp_path / "d.txt").write_text("x")
    spark.dataSource.register(wavsource.WavBlocks)
    for path in (str(tmp_path), f"file://{tmp_path}"):
        df = spark.read.format("wavblocks").option("block", 4096).option("blocks_a_task", 3).load(path)
        assert df.rdd.getNumPartitions() == 5 + 1
        rows = df.collect()
        good = sorted((r for r in rows if r.error is None), key=lambda r: r.block)
        assert [r.start for r in good] == [4096 * i for i in range(13)] and {(r.rate, r.channels) for r in good} == {(16000, 1)}
        assert np.allclose(np.concatenate([r.samples for r in good]), readers.parse_wav((tmp_path / "a.wav").read_bytes())[2])
        assert [(r.path.endswith("b.wav"), r.error) for r in rows if r.error] == [(True, "not a WAV file")]
    made = signal.resample_blocks(df.where("error IS NULL"), ["path"], 8000, 4096)
    assert made.selectExpr("sum(size(samples))").first()[0] == 25_000


def test_batches_that_fail_are_halved(spark):
    calls = spark.sparkContext.accumulator(0)

    def call(values):
        calls.add(1)
        if "bad" in values:
            raise ValueError("no")
        return [v.upper() for v in values]

    values = [f"v{i}" for i in range(40)] + ["bad", None, " "] + [f"w{i}" for i in range(20)]
    df = spark.createDataFrame([(v,) for v in values], "t string").coalesce(1)
    got = [(r.t, r.result.value, r.result.status, r.result.error) for r in streams.isolated_batches(df, call, "t", size=16).collect()]
    want = [(v, None, "error", "no") if v == "bad" else (v, v, "skipped", None) if v is None or v == " " else (v, v.upper(), "ok", None) for v in values]
    assert got == want and calls.value <= 5 + 2 * 5
    short = streams.isolated_batches(df, lambda values: values[:-1], "t").collect()
    assert {r.result.status for r in short if r.t and r.t.strip()} == {"error"}


def test_table_functions_give_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "no"), (3, None), (4, "none")], "k int, t string")

    def call(t):
        if t == "no":
            raise ValueError("refused")
        return [] if t == "none" else t.split()

    got = sorted((r.k, r.value, r.status, r.error) for r in streams.isolated_rows(df, call, "t", "string").collect() if r.value)
    assert got == [(1, "a", "ok", None), (1, "b", "ok", None)]
    rest = sorted((r.k, r.status, r.error) for r in streams.isolated_rows(df, call, "t", "string").collect() if not r.value)
    assert rest == [(2, "error", "refused"), (3, "skipped", None), (4, "ok", None)]


def test_queues_resume_their_first_item_only(spark):
    rows = [("q", 0, "a", "half"), ("q", 1, "b", "half"), ("q", 2, "broken", None), ("q", 3, "fails", None), ("q", 4, "c", None), ("one", 0, "a", "half"), (None, 0, "broken", None), (None, 1, "a", None)]
    df = spark.createDataFrame(rows, "queue string, idx int, name string, half string")

    def prepare(name):
        if name == "broken":
            raise ValueError("cannot be decoded")
        return name

    def transcribe(name, half):
        if half is not None and name != "a":
            raise ValueError("resumed another's run")
        return name != "fails"

    got = {(r.queue, r.idx): (r.state, r.error) for r in streams.run_queue(df, ["queue"], "idx", prepare, transcribe, "name", "half").collect()}
    assert got == {("q", 0): ("listo", None), ("q", 1): ("listo", None), ("q", 2): ("error", "cannot be decoded"), ("q", 3): ("error", None), ("q", 4): ("listo", None), ("one", 0): (None, None), (None, 0): ("error", "cannot be decoded"), (None, 1): ("listo", None)}
