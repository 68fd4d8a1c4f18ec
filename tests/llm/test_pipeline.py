"""The pipeline's stages on planted rows and on odd rows."""

import random
import zlib

corpus_pipeline = __import__("pytest").importorskip("corpus_pipeline")


def planted():
    rng = random.Random(8)
    stems = {"en": ["the", "house", "garden", "window", "brother", "with"], "es": ["la", "casa", "jardín", "ventana", "hermano", "con"]}
    word = lambda k: rng.choice(stems[k]) + rng.choice(["", "s", "er", "ing"]) + rng.choice(["", "a", "o"])
    text = lambda k, n: " ".join(word(k) for _ in range(n))
    item, line = text("en", 30), "the same line that many documents of this corpus repeat"
    rows = [(i, text("en" if i % 2 else "es", 60), "en" if i % 2 else "es") for i in range(30)]
    rows += [(30, rows[0][1], "es"), (31, rows[1][1] + " more", "en")]  # copies
    rows += [(32, text("en", 20) + " " + item + " " + text("en", 20), "en"), (33, "12 ... 34", "en"), (34, None, "en"), (35, "", "es")]
    rows += [(40 + i, f"{text('en', 40)}\n{line}", "en") for i in range(6)]
    return rows, item, line


def written(spark, tmp_path):
    rows, item, line = planted()
    docs = spark.createDataFrame([(i, t, k, "s", len(t or ""), 1) for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long, _copy int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return docs, rows, item, line


def test_run_equals_brute_force(spark, tmp_path, bpe):
    """Each stage by a literal form of its rule, one after the other, against what run() packs."""
    import numpy as np
    from test_links import brute_join, brute_leaks, brute_lines
    from test_scans import literal_vector
    from tokenizers import Tokenizer

    from voxframe.llm import hyperlang, packing

    _, rows, item, _ = written(spark, tmp_path)
    enc, unit = hyperlang.Encoder(), lambda v: v / (np.linalg.norm(v) or 1)
    own = {d: unit(literal_vector(t or "", hyperlang.DIM, enc._letter)) for d, t, _ in rows}
    protos = [unit(sum(own[d] for d, t, k in rows if k == lang and t is not None)) for lang in ("en", "es")]
    now = [(d, t) for d, t, _ in rows if any(map(str.isalpha, t or "")) and max(own[d] @ p for p in protos) >= corpus_pipeline.MIN_SCORE]
    now = [(d, t) for d, t, _, _ in brute_lines(now)]
    least = {d: c for d, _, c in brute_join(now, corpus_pipeline.WORDS, corpus_pipeline.PERCENT)}
    now = [(d, t) for d, t in now if least[d] == d]
    leaks = {d for d, _ in brute_leaks(now, [(1, item)])}
    now = {d: t for d, t in now if d not in leaks}
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(got["doc_id"]) == set(now) and len(now) > 30
    tok = Tokenizer.from_file(bpe)
    for doc, pieces in got.sort_values("start").groupby("doc_id"):
        ids = tok.encode(now[doc], add_special_tokens=False).ids + [1]
        assert pieces.length.sum() == len(ids) and set(pieces.doc_tokens) == {len(ids)}
        for r in pieces.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    sums = got.groupby("sequence_id").agg({"length": "sum", "loss_tokens": "sum", "doc_id": "size", "padded_to": "first"})
    assert (sums.length <= packing.SEQUENCE).all() and (sums.loss_tokens <= packing.LOSS).all() and (sums.doc_id <= packing.SEGMENTS).all()
    assert (sums.padded_to - sums.length).sum() <= 0.02 * sums.length.sum()


def test_stages_on_planted_rows(spark, tmp_path):
    docs, _, _, line = written(spark, tmp_path)
    now, left = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        new = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert new.columns == docs.columns
        out = str(tmp_path / name)
        new.write.parquet(out)
        now = spark.read.parquet(out)
        left[name] = sorted({r.doc_id for r in now.select("doc_id").collect()})
    clean = [*range(30), *range(40, 46)]
    assert left["language_id"] == sorted([*clean, 30, 31, 32])
    kept = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "line_dedup")).collect()}
    assert [d for d in range(40, 46) if line in kept[d]] == [45]
    assert left["near_copies"] == sorted([*clean, 32])
    assert left["decontamination"] == clean and left["packing"] == clean
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted({r.doc_id for r in whole.select("doc_id").collect()}) == clean


def test_stages_on_odd_rows(spark, odd, none, tmp_path):
    spark.createDataFrame([(1, "hola mundo")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, str(tmp_path))
            n = out.count()
            assert name == "packing" or (out.columns == rows.columns and n <= rows.count())
