from pyspark.sql import functions as F

from voxframe.functions import arrays, timefmt


def value(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_times(spark):
    v = lambda c: value(spark, c)
    assert v(timefmt.format_time(F.lit(3661.5))) == "01:01:01,500"
    assert v(timefmt.format_time(F.lit(59.9996))) == "00:00:60,000"
    assert v(timefmt.format_time(F.lit(59.9996), ".", strict=True)) == "00:01:00.000"
    assert v(timefmt.format_time(F.lit(-3.0), ".")) == "00:00:00.000"
    assert v(timefmt.format_time(F.lit(360000.0), ".")) == "100:00:00.000"
    assert v(timefmt.format_clock(F.lit(3725.0))) == "1:02:05"
    assert v(timefmt.format_clock(F.lit(65.0))) == "1:05"
    assert v(timefmt.percent(F.lit(0.1234))) == "12.3 %"
    assert v(timefmt.percent(F.lit(None).cast("double"))) == "—"
    assert v(timefmt.percent(F.lit(float("inf")))) == "∞"
    for sec, es, en in ((1, "1 segundos", "1 seconds"), (60, "1 minuto", "1 minute"), (65, "1 minuto y 5 s", "1 minute 5s"), (59.6, "1 minuto", "1 minute"), (3600, "1 hora", "1 hour"), (7500, "2 horas y 5 min", "2 hours 5min")):
        assert (v(timefmt.human_duration(F.lit(float(sec)), "es")), v(timefmt.human_duration(F.lit(float(sec)), "en"))) == (es, en)
    for low, high, es, en in ((10, 20, "entre 10 y 20 segundos", "between 10 and 20 seconds"), (1, 1.2, "1 segundo", "1 second"), (75, 80, "alrededor de 1 minuto", "about 1 minute"), (125, 130, "alrededor de 2 minutos", "about 2 minutes"), (20, 300, "entre 1 y 5 minutos", "between 1 and 5 minutes"), (1000, 8000, "entre 1 y 2 horas", "between 1 and 2 hours")):
        assert (v(timefmt.human_range(F.lit(float(low)), F.lit(float(high)), "es")), v(timefmt.human_range(F.lit(float(low)), F.lit(float(high)), "en"))) == (es, en)
    for n, es, en in ((999, "999 B", "999 B"), (1536, "2 KB", "2 KB"), (1_048_000, "1.023 KB", "1,023 KB"), (55_000_000, "52,5 MB", "52.5 MB"), (3 * 1024**3, "3,0 GB", "3.0 GB"), (1500 * 1024**3, "1.500,0 GB", "1,500.0 GB")):
        assert (v(timefmt.human_bytes(F.lit(n), "es")), v(timefmt.human_bytes(F.lit(n), "en"))) == (es, en)
    assert v(timefmt.fits_budget(F.lit(0.0), F.lit(1.0), F.lit(None).cast("double"))) is True
    assert v(timefmt.fits_budget(F.lit(0.0), F.lit(1.0), F.lit(1000.0))) is False
    assert v(timefmt.progress_percent(F.lit(3.0), F.lit(2.0))) == 100.0
    assert v(timefmt.progress_percent(F.lit(3.0), F.lit(0.0))) is None
    assert [v(timefmt.rtf_band(F.lit(x))) for x in (0.39, 0.4, 0.8, 0.81)] == ["good", "usable", "usable", "slow"]
    assert v(timefmt.micros("timestamp'2024-01-01 00:00:00.000001'")) == 1704067200000001


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_arrays(spark):
    v = lambda c: value(spark, c)
    assert v(arrays.cosine(arr(1, 0), arr(1, 0))) == 1.0
    assert v(arrays.cosine(arr(0, 0), arr(1, 0))) == 0.0
    assert v(arrays.median_of(arr(3, 1, 2))) == 2.0
    assert v(arrays.median_of(arr(4, 1, 2, 3))) == 2.5
    assert v(arrays.median_of(F.array().cast("array<double>"))) is None
    assert v(arrays.quantile_of(arr(1, 2, 3, 4, 5), 0.1)) == 1.4
    assert v(arrays.append_last(arr(1, 2, 3, 4, 5), F.lit(6.0), 5)) == [2, 3, 4, 5, 6]
    assert v(arrays.append_last(arr(1), F.lit(6.0), 5)) == [1, 6]
    assert v(arrays.rms(arr(3, 4))) == (12.5) ** 0.5
    assert v(arrays.slice_samples(arr(0, 1, 2, 3), F.lit(0.5), F.lit(9.0), 2)) == [1, 2, 3]
    assert v(arrays.slice_rounded(arr(0, 1, 2, 3), F.lit(0.6), F.lit(1.4), 2)) == [1, 2]
    assert v(arrays.coverage(F.array(F.lit("a"), F.lit("a"), F.lit("b")), F.array(F.lit("a")))) == 2 / 3
    assert v(arrays.labels_of(F.expr("array(array(0, 2), array(1))"), F.lit(4))) == ["0", "1", "0", ""]
    assert v(arrays.limit_peak(arr(2, -1))) == [0.99, -0.495]
    assert v(arrays.clip_percent(arr(1, 0, 0, 0))) == 25.0
    assert v(arrays.equal_components(arr(1, 2), arr(1, 3))) == 1


def test_fixed_places_round_the_exact_value(spark):
    from decimal import ROUND_HALF_UP, Decimal

    xs = [1.0005, 0.0625, 0.1875, 2.5, 0.125, 1.005, 59.9996, 0.0, 1e-9, 123456.0005, 16.0625, 1234567.4375, 0.5, 1.5, 0.25, 0.35]
    df = spark.createDataFrame([(x,) for x in [*xs, *(-x for x in xs if x)]], "x double")
    for places in (0, 1, 2, 3):
        for r in df.select("x", timefmt.to_fixed(F.col("x"), places).alias("t")).collect():
            want = str(Decimal(abs(r.x)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))
            assert r.t == ("-" if r.x < 0 else "") + want, (r.x, places)


def test_estimates_in_words(spark):
    v = lambda c: value(spark, c)
    cases = ((10, "menos de un minuto"), (60, "alrededor de un minuto"), (150, "alrededor de 3 minutos"), (3600, "alrededor de 1 h"), (5400, "alrededor de 1 h 30 min"))
    for sec, want in cases:
        assert v(timefmt.describe_estimate(F.lit(float(sec)), F.lit("aprendido"))) == want
        assert v(timefmt.describe_estimate(F.lit(float(sec)), F.lit("tabla"))) == want + " (estimación aproximada)"
    rough = v(timefmt.rough_estimate(F.lit(100.0), arr(0.5, 0.1, 0.3)))
    assert (round(rough.seconds, 9), round(rough.low, 9), round(rough.high, 9), rough.single) == (30.0, 14.0, 46.0, False)
    assert v(timefmt.rough_estimate(F.lit(10.0), arr(0.5))).single is True
    shown = lambda learned, samples, sec=2000.0: tuple(v(timefmt.shown_estimate(F.lit(sec), F.lit(learned).cast("double"), samples, "en")))
    assert shown(0.5, arr(1, 2)) == ("16 minutes 40s", True)
    assert shown(None, arr(0.1)) == ("3 minutes 20s", True)
    assert shown(None, arr(0.1, 0.3), 100.0) == ("between 12 and 28 seconds", False)


def test_clips_follow_each_other(spark):
    df = spark.createDataFrame([("a", 2, [3.0]), ("a", 1, [1.0, 2.0]), ("b", 1, [])], "k string, i int, samples array<float>")
    assert {r.k: r.samples for r in arrays.concat_clips(df, ["k"], "i").collect()} == {"a": [1.0, 2.0, 3.0], "b": []}
