"""Text functions on cases with known answers, and controls."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxframe.functions import text
from voxframe.functions.text import digits

NUMBERS = [
    ("mil novecientos ochenta y cuatro", "1984"),
    ("cinco y seis", "5 y 6"),
    ("cinco y agua", "5 y agua"),
    ("treinta y cuatro", "34"),
    ("three hundred and forty", "340"),
    ("two thousand twenty four", "2024"),
    ("uno dos tres", "6"),
    ("hundred", "100"),
    ("y cinco", "y 5"),
    ("constructor", "constructor"),
    ("cien mil", "100000"),
    ("", ""),
]


@pytest.mark.parametrize("said,expected", NUMBERS)
def test_number_words(said, expected):
    assert " ".join(digits(said.split(" "))) == expected


@given(st.lists(st.sampled_from(["uno", "mil", "hundred", "y", "and", "cien", "treinta", "casa", "x"]), max_size=12))
def test_number_words_lose_no_other_word(tokens):
    out = digits(tokens)
    plain = lambda ws: [w for w in ws if w in ("casa", "x")]
    assert plain(out) == plain(tokens)
    assert bool(out) == bool(tokens)


NORMALIZED = [
    ("¿Qué tal, AMIGO?", "es", "que tal amigo"),
    ("El año pasado", "es", "el año pasado"),
    ("ex-presidente", "es", "ex presidente"),
    ("I don't know it's Tom", "en", "i do not know it is tom"),
    ("I don't", "es", "i dont"),
    ("pingüino  ", "es", "pinguino"),
    ("can't won't they're", "en", "cannot will not they are"),
    ("a b", "es", "a b"),
    (None, "es", ""),
    ("¡!", "es", ""),
    ("Treinta y cuatro años", "es", "34 años"),
]


def test_normalize(spark):
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang, _) in enumerate(NORMALIZED)], "i int, t string, lang string")
    got = dict(df.select("i", text.normalize(F.col("t"), F.col("lang"))).collect())
    assert [got[i] for i in range(len(NORMALIZED))] == [e for _, _, e in NORMALIZED]


def test_normalize_is_idempotent(spark):
    df = spark.createDataFrame([(t, lang) for t, lang, _ in NORMALIZED if t], "t string, lang string")
    once = df.select("lang", text.normalize(F.col("t"), F.col("lang")).alias("n"))
    for r in once.select("n", text.normalize(F.col("n"), F.col("lang")).alias("m")).collect():
        assert r.n == r.m


def test_contractions_are_looked_for_by_their_letters():
    from voxframe.constants import CONTRACTIONS

    for pattern, _ in CONTRACTIONS:
        need = text._literal_of(pattern)
        assert "'" in need and need in pattern and len(need) > 1


def one(spark, col, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(col(*[F.col(c) for c in df.columns]).alias("x")).first().x


def test_small_text_functions(spark):
    assert one(spark, text.sentences, "Hola. Qué tal? bien. 3.14 no") == ["Hola.", "Qué tal? bien. 3.14 no"]
    assert one(spark, text.sentences, "  ") == []
    assert one(spark, text.escape_csv, 'a "b", c') == '"a ""b"", c"'
    assert one(spark, text.escape_csv, "plain") == "plain"
    assert one(spark, text.escape_markup, "<a & b>") == "&lt;a &amp; b&gt;"
    assert one(spark, text.safe_name, "reunión: equipo/ventas*.mp3") == "reunión-equipo-ventas"
    assert one(spark, text.safe_name, "///.mp3") == "transcripcion"
    assert one(spark, lambda c: text.speaker_id(c), "arf_001_22.wav") == "arf_001"
    assert one(spark, lambda c: text.default_speaker_name(c), "1") == "Hablante 2"
    assert one(spark, lambda c: text.default_speaker_name(c), "Ana") == "Ana"
    assert one(spark, lambda c: text.slug(c), "Run A/B 2") == "run-a-b-2"
    assert one(spark, text.pdf_safe, "a→b 日 €") == "a->b ? €"
    assert one(spark, text.pdf_safe, "5\u2032 6\u2033 \u22123\u00a0x\ny\u2009z \U0001f600") == "5' 6\" -3\u00a0x?y z ?"
    assert one(spark, text.dtype_label, "fp16", "fp16") == "enc:fp16/dec:fp16"
    assert one(spark, text.report_filename, "Mi PC/2", "r1") == "resultados-mi-pc-2-r1.md"
    assert one(spark, text.report_filename, None, "r1") == "resultados-equipo-r1.md"
    assert one(spark, text.language_pair, "es", "en") == "es-en" and one(spark, text.language_pair, "es", "es") is None
    assert one(spark, text.language_pair, None, "en") is None and one(spark, text.language_pair, "fr", "en") is None
    assert one(spark, text.is_video, "video/mp4") is True and one(spark, text.is_video, None) is False
    assert one(spark, text.strip_diacritics, "ñandú Ḃ ở") == "ñandu B o"
    assert one(spark, lambda c: text.phrase({"a": "b"}, c), "a") == "b"
    assert one(spark, lambda c: text.phrase({"a": "b"}, c), "z") == "z"


def test_texts_are_read_in_few_passes(spark):
    """Rules 1 to 5 stand once in the plan."""
    df = spark.createDataFrame([("a", "en")], "t string, lang string")
    plan = lambda c: df.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    base = plan(text.normalize_base(F.col("t"), F.col("lang")))
    full = plan(text.normalize(F.col("t"), F.col("lang")))
    assert full.count("lower(") == base.count("lower(") == 1


def test_normalize_base_is_two_patterns(spark):
    df = spark.createDataFrame([("a", "en")], "t string, lang string")
    plan = df.select(text.normalize_base(F.col("t"), F.lit("es")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 2


def test_dashes_space_and_marks_collapse_as_one(spark):
    cases = {"a - b": "a b", "a-–_/b": "a b", "--a . - b--": "a b", "a \n b": "a b", "é ́ x": "e x", "É—ñ": "e ñ", "x . y": "x y", "a b": "a b", "-": "", "ﬁ ½": "ﬁ ½", "Ǆ Ǻ": "ǆ a"}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = dict(df.select("t", text.normalize_base(F.col("t"), F.lit("es"))).collect())
    assert got == cases


@pytest.mark.parametrize("case", [None, "", " ", " \n", "a", " a  b\t", "a b﻿c d", "¿Qué? – sí…", "日本 語", "\U0001f600 x\U0001f600", "\u000b1\u000b"])
def test_word_count_is_the_number_of_words(spark, case):
    df = spark.createDataFrame([(case,)], "t string")
    assert df.select(text.word_count(F.col("t")) == F.size(text.words(F.col("t")))).first()[0]


def test_counting_words_makes_no_array_by_a_lambda(spark):
    df = spark.createDataFrame([("a",)], "t string")
    assert "lambda" not in df.select(text.word_count(F.col("t")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
