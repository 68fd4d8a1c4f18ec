import re
import zipfile

import pytest
from pyspark.sql import functions as F

from voxframe.operators import bench, corpus, cues, store
from voxframe.sources import readers, sinks, versions

TIMED = "k string, idx int, start_sec double, end_sec double, text string, speaker string"


def timed(spark, *rows):
    return spark.createDataFrame([("a", i, float(s), float(e), t, p) for i, (s, e, t, p) in enumerate(rows)], TIMED)


def align(spark, spans, said):
    df = spark.createDataFrame([([(float(a), float(b)) for a, b in spans], said)], "s array<struct<start_sec:double,end_sec:double>>, t string")
    return df.select(cues.align_block_text(F.col("s"), F.col("t")).alias("x")).first().x


def test_alignment(spark):
    two = [(0, 1), (2, 5)]
    assert align(spark, [], "a b") == []
    assert align(spark, two, "  ") == ["", ""]
    assert align(spark, two[:1], " hola mundo ") == ["hola mundo"]
    assert align(spark, two, "Uno. Dos tres.") == ["Uno.", "Dos tres."]
    assert align(spark, two, "a b c d") == ["a", "b c d"]
    assert align(spark, [(0, 1), (1, 100), (100, 101)], "a b") == ["a", "b", ""]
    assert align(spark, [(1, 1), (2, 2)], "a b c") == ["a", "b c"]  # no duration at all
    out = align(spark, [(0, 3), (4, 5), (6, 12)], " ".join(f"w{i}" for i in range(37)))
    assert " ".join(x for x in out if x).split() == [f"w{i}" for i in range(37)]


def wrapped(spark, text, width):
    return spark.createDataFrame([(text,)], "t string").select(cues.wrap(F.col("t"), width).alias("x")).first().x


def test_wrap(spark):
    assert wrapped(spark, "aaa bbb ccc", 7) == ["aaa bbb", "ccc"]
    assert wrapped(spark, "a" * 50 + " b", 10) == ["a" * 50, "b"]
    assert wrapped(spark, " ", 10) == []
    df = spark.createDataFrame([("iii mmm i",)], "t string")
    assert df.select(cues.wrap_by_measure(F.col("t"), 4.0, {"i": 0.5, "m": 1.0, " ": 0.5}).alias("x")).first().x == ["iii", "mmm i"]


def test_pages(spark):
    page = lambda h, u, f=None: spark.createDataFrame([([float(x) for x in h],)], "h array<double>").select(cues.page_of(F.col("h"), u, f).alias("x")).first().x
    assert page([300, 40], 200.0) == [0, 1]
    assert page([50, 60, 70], 100.0, 50.0) == [0, 1, 2]
    assert page([50, 50, 50], 100.0) == [0, 0, 1]
    assert page([], 100.0) == []


def test_cues(spark):
    long = " ".join(["palabra"] * 30)
    out = cues.to_cues(timed(spark, (0, 0.3, "corto", "A"), (0.5, 9, long, "A"), (10, 11, " ", "B")), ["k"]).orderBy("cue").collect()
    assert [r.cue for r in out] == list(range(1, len(out) + 1))
    assert out[0].end_sec == 0.5  # stretched up to the next start
    assert sum(len(x.split()) for r in out for x in r.lines) + sum(r.dropped_words for r in out) == 31
    assert all(a.end_sec <= b.start_sec + 1e-9 for a, b in zip(out, out[1:], strict=False))
    lost = cues.to_cues(timed(spark, (0, 6, "a" * 30 + " " + "b" * 20 + " " + "c" * 30, None)), ["k"]).first()
    assert lost.dropped_words == 1 and len(lost.lines) == 2


def test_exports(spark):
    t = timed(spark, (0, 1.5, 'di "algo", <ya>', "Ana"), (2, 3, "si", "Ana"), (4, 5, "", "Ana"), (6, 7, "no", None))
    body = sinks.to_csv(t, ["k"]).first().body
    assert body.startswith("﻿start_sec,end_sec,start,end,speaker,text\r\n") and body.endswith("\r\n")
    assert body.split("\r\n")[1] == '0.000,1.500,00:00:00.000,00:00:01.500,Ana,"di ""algo"", <ya>"'
    assert len(body.split("\r\n")) == 5
    c = cues.to_cues(t, ["k"])
    srt = sinks.to_srt(c, ["k"]).first().body
    blocks = srt.strip().split("\r\n\r\n")
    assert [b.split("\r\n")[0] for b in blocks] == ["1", "2", "3"]
    assert all(re.fullmatch(r"\d\d:\d\d:\d\d,\d{3} --> \d\d:\d\d:\d\d,\d{3}", b.split("\r\n")[1]) for b in blocks)
    assert blocks[0].split("\r\n")[2] == 'Ana: di "algo", <ya>' and blocks[2].split("\r\n")[2] == "no"
    vtt = sinks.to_vtt(c, ["k"]).first().body
    assert vtt.startswith("WEBVTT\n\n00:00:00.000 --> 00:00:01.500\n<v Ana>di \"algo\", &lt;ya&gt;\n\n")
    assert sinks.to_text(t, ["k"]).first().body == 'Ana: di "algo", <ya>\nsi\nno'


def test_zip(spark, tmp_path):
    s = spark.createDataFrame([("z", "a", 0, "uno.mp3"), ("z", "b", 1, "UNO.wav"), ("y", "c", 0, "x"), (None, "a", 0, "n")], "arc string, k string, idx int, name string")
    texts = spark.createDataFrame([("a", "ta"), ("b", "tb")], "k string, body string")
    at = str(tmp_path / "zips")
    for path in (at, f"file://{at}"):  # written again, the same files
        made = {r.arc: r for r in sinks.zip_sessions(s, texts, texts, "arc", "k", path).collect()}
        assert {k: r.n_files for k, r in made.items()} == {"z": 4, "y": 2, None: 2}
        with zipfile.ZipFile(made["z"].path.removeprefix("file://")) as z:
            assert z.namelist() == ["uno.txt", "uno.srt", "UNO (2).txt", "UNO (2).srt"] and z.read("UNO (2).srt") == b"tb"
        with zipfile.ZipFile(made["y"].path.removeprefix("file://")) as z:
            assert z.read("x.txt") == b""
        assert len(list((tmp_path / "zips").iterdir())) == 3


RESULT = "model string, status string, infer_ms double, rtf double, load_ms double, mem_peak_mb double, sub int, del int, ins int, ref_words int, seq int"


def test_summary(spark):
    rows = [("m", "ok", 4000.0, 4.0, None, 0.0, 1, 0, 0, 1, 0), ("m", "ok", 100000.0, 1.0, 7.0, 5.0, 1, 0, 0, 100, 1), ("m", "error", None, None, None, None, None, None, None, None, 2), ("e", "skipped", None, None, None, None, None, None, None, None, 0), ("e", "error", None, None, None, None, None, None, None, None, 1)]
    got = {r.model: r for r in bench.summarize(spark.createDataFrame(rows, RESULT), ["model"]).collect()}
    assert abs(got["m"].rtf - 104 / 101) < 1e-12 and abs(got["m"].wer - 2 / 101) < 1e-12
    assert (got["m"].n, got["m"].load_ms, got["m"].peak_mb) == (2, 7.0, 5.0)
    assert (got["e"].status, got["e"].n, got["e"].wer) == ("error", 2, None)


def test_pending_repeats_errors(spark):
    m = spark.createDataFrame([("a",), ("b",), ("c",)], "item string")
    done = spark.createDataFrame([("a", "ok"), ("b", "error"), ("c", "skipped")], "item string, status string")
    assert [r.item for r in bench.pending(m, done, ["item"]).collect()] == ["b"]


def test_store(spark):
    rows = spark.createDataFrame([("s", 0, "x", "A", False), ("s", 1, "y", "B", False)], "session_id string, idx int, text string, speaker string, edited boolean")
    edit = spark.createDataFrame([("s", 1, "z", None)], "session_id string, idx int, text string, speaker string")
    got = sorted(map(tuple, store.merge_edits(rows, edit, ["session_id", "idx"], ["text", "speaker"]).collect()))
    assert got == [("s", 0, "x", "A", False), ("s", 1, "z", "B", True)]
    chunks = spark.createDataFrame([("f", b, [(float(b), b + 1.0, f"t{b}")]) for b in (2, 0, 1, 3)], "file_key string, block_index int, segments array<struct<start_sec:double,end_sec:double,text:string>>")
    runs = spark.createDataFrame([("f", 3)], "file_key string, done_blocks int")
    assert [s.text for s in store.resume_prefix(runs, chunks).first().segments] == ["t0", "t1", "t2"]
    import pytest

    with pytest.raises(Exception, match="differ in length"):
        store.zip_strict(rows.select("session_id", "idx"), rows.where("idx = 0").select("session_id", "idx", "speaker"), ["session_id"]).collect()


def test_manifest_rules(spark):
    fields = "id string, url string, reference string, sha256 string, durationSec double, lang string, level string, split string, condition string, speakers int, snrDb double"
    good = ("a", "u", "r", "0" * 64, 1.0, "es", None, None, "clean", None, None)
    bad = ("a", "", " ", "xyz", 0.0, "fr", "Q", "other", "multi", 1, None)
    got = [r.problem for r in corpus.violations(spark.createDataFrame([good, bad], fields), "id", corpus.manifest_rules(), "reference").collect()]
    assert len(got) == 9 and "id repeated" in got


def mulberry(seed, n):
    import numpy as np

    out, a = [], np.uint32(seed)
    with np.errstate(over="ignore"):
        for _ in range(n):
            a = a + np.uint32(0x6D2B79F5)
            t = (a ^ (a >> np.uint32(15))) * (np.uint32(1) | a)
            t = (t + (t ^ (t >> np.uint32(7))) * (np.uint32(61) | t)) ^ t
            out.append(int(t ^ (t >> np.uint32(14))) / 4294967296)
    return out


def test_seeded_generator():
    for seed in (0, 1, 42, 20260823, 2**32 - 1):
        draw = corpus.seeded(seed)
        assert [next(draw) for _ in range(50)] == mulberry(seed, 50)


def test_turns():
    clips = {"B": [("b1", 3.0), ("b2", 2.0)], "A": [("a1", 2.0), ("a2", 0.4), ("a3", 1.0)]}
    plan = corpus.turns(clips, 60, iter([0.2, 0.7, 0.5, 0.1]))
    assert plan == [("B", "b1", 0.0, 3.0), ("A", "a1", 2.75, 4.75), ("B", "b2", 4.5, 6.5), ("A", "a3", 6.25, 7.25)]  # a2 is too short, and used up
    assert [x[1] for x in corpus.turns(clips, 4, iter([0.0, 0.0, 0.0]))] == ["b1", "a1"]
    draws = iter([0.0] * 3)
    assert [x[1] for x in corpus.turns({"A": [("a1", 1.0)], "B": [("b1", 1.0), ("b2", 1.0)]}, 60, draws)] == ["a1", "b1", "b2"]
    assert next(draws, None) is None  # no draw for a speaker who has none left
    assert corpus.turns({}, 10, iter([])) == []


def test_take_until_counts_the_gap(spark):
    df = spark.createDataFrame([("s", i, 1.0) for i in range(10)] + [("s", 10, 0.3)], "k string, i int, duration_sec double")
    assert corpus.take_until(df, ["k"], "i", 5.0).count() == 4
    assert corpus.take_until(df, ["k"], "i", 5.0, gap=0.0).count() == 5


def test_resumed_equals_uninterrupted(spark):
    """Blocks of 8 s every 10 s, in one run and in two, with a chunk that a broken run left behind."""
    block = lambda f, b, tag: (f, b, [(b * 10.0, b * 10.0 + 3.0), (b * 10.0 + 4.0, b * 10.0 + 8.0)], f"{tag} block {b} said")
    schema = "file_key string, block_index int, spans array<struct<start_sec:double,end_sec:double>>, text string"

    def done(rows):
        df = spark.createDataFrame(rows, schema).withColumn("texts", cues.align_block_text(F.col("spans"), F.col("text")))
        return df.select("file_key", "block_index", F.zip_with("spans", "texts", lambda s, t: F.struct(s["start_sec"].alias("start_sec"), s["end_sec"].alias("end_sec"), t.alias("text"))).alias("segments"), F.lit(7.0).alias("speech_sec"), "text")

    whole = done([block("f", b, "x") for b in range(6)])
    first = done([block("f", b, "x") for b in range(3)] + [block("f", 3, "stale")])
    rest = done([block("f", b, "x") for b in range(3, 6)])
    no_runs = spark.createDataFrame([], "file_key string, done_blocks int")
    runs = spark.createDataFrame([("f", 3)], "file_key string, done_blocks int")
    a, b = store.resumed(no_runs, first, whole).first(), store.resumed(runs, first, rest).first()
    assert a == b and len(a.segments) == 12 and a.speech_sec == 42.0 and a.text.startswith("x block 0 said x block 1")
    assert store.resumed(runs, first, whole).first() == a  # what is done is not taken again


def test_store_projections(spark):
    s = spark.createDataFrame([("s", "n", "video/mp4", [(0, 0.0, 1.0, "a", None, True), (1, 1.0, 0.5, "b c", "A", None)]), ("t", "m", None, [])], "session_id string, name string, mime string, segments array<struct<idx:int,start_sec:double,end_sec:double,text:string,speaker:string,edited:boolean>>")
    got = {r.session_id: r for r in store.opened(s).collect()}
    assert got["s"].segments[0].asDict() == {"start_sec": 0.0, "end_sec": 1.0, "text": "a", "speaker": None}
    assert (got["s"].media_kind, got["s"].edited_initially, got["t"].media_kind, got["t"].edited_initially) == ("video", [0], "audio", [])
    rows = s.select("session_id", F.explode("segments").alias("x")).select("session_id", "x.*")
    t = store.editor_totals(rows, ["session_id"]).first()
    assert (t.n_words, t.speech_sec) == (3, 1.0)
    saved = spark.createDataFrame([(True,), (False,), (None,)], "x boolean")
    assert [r[0] for r in saved.select(store.save_notice(F.col("x"), "both", "text")).collect()] == ["both", "text", None]
    assert store.stored_bytes(spark.createDataFrame([(5,), (None,)], "audio_bytes long")).first().bytes == 5
    log = spark.createDataFrame([("a", i) for i in range(300)], "k string, i int")
    assert store.log_tail(log, ["k"], ["i"]).agg(F.min("i"), F.count("*")).first()[:] == (99, 201)
    twice = spark.createDataFrame([("s", 1, "old", "A", 1), ("s", 1, "new", None, 2)], "session_id string, idx int, text string, speaker string, v int")
    base = spark.createDataFrame([("s", 1, "x", "B", False)], "session_id string, idx int, text string, speaker string, edited boolean")
    assert store.merge_edits(base, twice, ["session_id", "idx"], ["text", "speaker"], version="v").collect()[0][:] == ("s", 1, "new", "B", True)


def test_manifest_headers(spark):
    item = "struct<id:string,url:string,lang:string,durationSec:double,condition:string,reference:string,sha256:string,level:string,split:string,snrDb:double,speakers:int>"
    good = ("a", "u", "es", 1.0, "clean", "r", "0" * 64, None, None, None, None)
    df = spark.createDataFrame([("x", None, []), ("y", "1", [good, good, (None, *good[1:])])], f"path string, version string, items array<{item}>")
    got = sorted((r.path, r.item, r.problem) for r in corpus.manifest_problems(df).where("path = 'y'").collect())
    assert got == [("y", 1, "id repeated"), ("y", 2, "id missing")]
    assert {r.problem for r in corpus.manifest_problems(df).where("path = 'x'").collect()} == {"version missing", "no items"}


def test_run_store_and_report(spark):
    fields = "run_id string, seq int, model string, backend string, item_id string, status string, infer_ms double, rtf double, load_ms double, mem_peak_mb double, sub int, del int, ins int, ref_words int, error string"
    rows = [("r", 1, "m", "wasm", "i2", "error", None, None, None, None, None, None, None, None, "boom | bang"), ("r", 0, "m", "wasm", "i1", "ok", 500.0, 0.5, 2000.0, 120.4, 1, 0, 0, 10, None), ("q", 0, "n", "webgpu", "i1", "timeout", None, None, None, None, None, None, None, None, "late")]
    results = spark.createDataFrame(rows, fields)
    heads = spark.createDataFrame([("r", "dev"), ("z", "dev")], "run_id string, device string")
    loaded = {r.run_id: [x.seq for x in r.results] for r in readers.load_run(heads, results).collect()}
    assert loaded == {"r": [0, 1], "z": []} and readers.load_run(heads, results, "z").count() == 1
    models = spark.createDataFrame([("m", "MIT", 0), ("n", "Apache", 1)], "model string, license string, place int")
    body = sinks.report("r", "2026", {"Browser": "x", "Memory": None}, results.where("run_id = 'r'"), models, choice="m")
    assert "| m | — | **0.50** · 10.0 % | MIT |" in body and "| n | — | — | Apache |" in body
    assert "| m | wasm | 1 | 0.50 | 10.0 % | 0 | 120 MB | 2.0 s |" in body
    assert "## Failures" in body and "boom \\| bang" in body and "| Memory | — |" in body
    whole = sinks.report("q", "2026", {}, results.where("run_id = 'q'"), models)
    assert "⏱ >5×" in whole and "| n | webgpu | 1 | ⏱ >5× | — |" in whole
    import pytest

    with pytest.raises(ValueError):
        sinks.markdown_table(spark.range(20), limit=10)


def test_saves_are_whole_or_not_seen(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "s")
    head = lambda *ks, n: spark.createDataFrame([(k, n) for k in ks], "k string, n int")
    body = lambda k, n: spark.createDataFrame([(k, i) for i in range(n)], "k string, idx int")

    def seen(as_of=None):
        h, r = versions.load(spark, at, "k", as_of)
        counts = {x.k: x["count"] for x in r.groupBy("k").count().collect()}
        return {x.k: (x.n, counts.get(x.k, 0)) for x in h.collect()}

    assert versions.version(spark, at) == 0
    assert versions.save(head("a", "b", n=1), body("a", 2).union(body("b", 5)), at, "k") == 1
    commit = versions._commit
    # a re-save that stops between its writes and its commit, and one in the commit itself
    monkeypatch.setattr(versions, "_commit", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError):
        versions.save(head("a", n=2), body("a", 9), at, "k")
    assert seen() == {"a": (1, 2), "b": (1, 5)}
    monkeypatch.setattr(versions, "_commit", lambda spark, path, token, n: commit(spark, path, "", n))
    versions.save(head("a", n=3), body("a", 7), at, "k")
    monkeypatch.setattr(versions, "_commit", commit)
    assert seen() == {"a": (1, 2), "b": (1, 5)}
    # a whole one; a header without rows; the old state by its number
    assert versions.save(head("a", n=4), body("a", 3), at, "k", base=1) == 3
    versions.save(head("c", n=1), body("a", 0), at, "k")
    assert seen() == {"a": (4, 3), "b": (1, 5), "c": (1, 0)} and seen(1) == {"a": (1, 2), "b": (1, 5)}
    # two that read the same state: other keys go in, the same key is refused
    with pytest.raises(versions.Conflict):
        versions.save(head("a", n=5), body("a", 1), at, "k", base=1)
    assert versions.save(head("b", n=6), body("b", 1), at, "k", base=1) == 5
    # two that take one number: the second takes the next
    taken = []
    monkeypatch.setattr(versions, "version", lambda *a: 4 + len(taken) if not taken.append(1) else 0)
    assert versions.save(head("d", n=1), body("d", 1), at, "k") == 6
    monkeypatch.undo()
    before = seen()
    assert versions.vacuum(spark, at, "k", 4) == 1 and seen() == before == {"a": (4, 3), "b": (6, 1), "c": (1, 0), "d": (1, 1)}
    rows = body("a", 2)
    import json

    assert json.loads(sinks.to_json(rows, ["k"], "idx").first().body) == [{"idx": 0}, {"idx": 1}]


def test_csv_keeps_exact_times_and_trims_all_space(spark):
    t = timed(spark, (1.0005, 0.0625, " \t\u00a0x\u2003", None), (1, 2, "\t\u00a0", None))
    assert sinks.to_csv(t, ["k"]).first().body.split("\r\n")[1:] == ["1.000,0.063,00:00:01.000,00:00:00.063,,x", ""]


def test_quantiles_by_brackets(spark, monkeypatch):
    import random

    import numpy as np

    rng = random.Random(3)
    data = {"a": [rng.gauss(0, 1) for _ in range(6000)], "b": [5.0] * 3000 + [rng.random() for _ in range(4000)], "c": [1.0], None: [2.0, 4.0]}
    df = spark.createDataFrame([(k, x) for k, xs in data.items() for x in xs] + [("a", None)], "k string, x double").repartition(5)
    monkeypatch.setattr(bench, "SKETCH", 500)
    got = {r.k: r for r in bench.spread(df, ["k"], "x").collect()}
    for k, xs in data.items():
        assert (got[k].n, got[k].single) == (len(xs), len(xs) < 2)
        assert np.allclose([got[k].median, got[k].p10, got[k].p90], np.quantile(xs, [0.5, 0.1, 0.9]))
    assert bench.spread(df.limit(0), ["k"], "x").count() == 0


def test_running_estimates(spark):
    rows = [("r", 0, "start", 0.0, 0.0), ("r", 1, "calibrate", 9.0, 26.0), ("r", 2, "calibrate", 15.0, 30.0), ("r", 3, "refine", 20.0, 30.0), ("r", 4, "refine", 30.0, 100.0)]
    df = spark.createDataFrame([(*r, 300.0, None, 0.4) for r in rows], "k string, i int, kind string, elapsed_sec double, processed_sec double, duration_sec double, learned double, median double")
    got = [(r.rtf, r.source, round(r.remaining_sec, 6), r.warmup) for r in bench.running_estimate(df, ["k"], "i").orderBy("i").collect()]
    assert got[:4] == [(0.4, "tabla", 120.0, None), (0.4, "tabla", 109.6, None), (0.5, "calibrado", 135.0, None), (0.5, "calibrado", 135.0, None)]
    assert got[4][:3] == (0.3, "refinado", 60.0) and abs(got[4][3] - 15 / 9) < 1e-9
    known = bench.running_estimate(df.withColumn("learned", F.lit(0.9)).where("i = 0"), ["k"], "i").first()
    assert (known.rtf, known.source) == (0.9, "aprendido")


def test_rename_does_not_multiply(spark):
    sessions = spark.createDataFrame([("a", "old"), ("b", "kept")], "session_id string, name string")
    names = spark.createDataFrame([("a", "x"), ("a", " y "), ("a", ""), ("b", " ")], "session_id string, name string")
    assert sorted(map(tuple, store.rename(sessions, names).select("session_id", "name").collect())) == [("a", "y"), ("b", "kept")]


def test_catalogues_are_measured_in_rows_and_bytes(spark):
    from voxframe.session import catalogue

    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    df = spark.range(100).withColumn("t", F.repeat(F.lit("x"), 1000))
    assert hinted(catalogue(df)) and not hinted(catalogue(df, rows=99)) and not hinted(catalogue(df, size=50_000))


def test_manifest_items_are_judged_as_rows(spark):
    """No text goes with an item to the repeated ids, and no manifest is gathered."""
    fields = "path string, item int, id string, url string, lang string, durationSec double, condition string, reference string, sha256 string, level string, split string, snrDb double, speakers int"
    good = ("x", 0, "a", "u", "es", 1.0, "multi", "text", "0" * 64, "A", "principal", None, 2)
    rows = [good, (*good[:1], 1, *good[2:]), (*good[:1], 2, "b", *good[3:7], "", *good[8:]), ("y", 0, None, *good[3:])]
    heads = spark.createDataFrame([("x", "1", 3), ("y", None, 1), ("z", "1", 0)], "path string, version string, n_items int")
    found = corpus.item_problems(heads, spark.createDataFrame(rows, fields))
    assert sorted(found.collect(), key=str) == sorted([("x", 1, "id repeated"), ("x", 2, "reference empty"), ("y", 0, "id missing"), ("y", None, "version missing"), ("z", None, "no items")], key=str)


def test_manifest_rules_gather_no_texts(spark, tmp_path):
    from voxframe.plans.queries import manifest_rules

    spark.createDataFrame([(1, "hello", "en", "src1", 5)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert "collect_list" not in manifest_rules(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
