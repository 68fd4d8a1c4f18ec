"""The bench: planning of a run matrix, summaries, distributions and learned speed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxframe.constants import CALIBRATION_SEC, CALIBRATION_SHARE, LEARNED_MAX_RTF, LEARNED_MIN_SPEECH_SEC, LEARNED_SAMPLES
from voxframe.session import catalogue


def should_run(coverage: Column, lang: Column) -> Column:
    """A model of English alone runs on English items alone."""
    return ~((F.coalesce(coverage, F.lit("")) == "en") & (lang != "en"))


def in_levels(level: Column, levels: list[str]) -> Column:
    return level.isNull() | level.isin(*levels)


def run_matrix(models: DataFrame, backends: DataFrame, items: DataFrame) -> DataFrame:
    """All models by backends by items, which is what a run does; the first two are catalogues of few rows."""
    return items.crossJoin(catalogue(models.crossJoin(backends)))


def pending(matrix: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What has no row of status ok or skipped yet; errors and timeouts run again."""
    return matrix.join(done.where(F.col("status").isin("ok", "skipped")).select(*keys).distinct(), keys, "left_anti")


def evidence_of(runs: DataFrame, evidence: DataFrame) -> DataFrame:
    """verdict of (model, backend, encoder, decoder) in a measured table: its first match, else 'unverified'."""
    on = ["model", "backend", "encoder", "decoder"]
    order = W.partitionBy(*on).orderBy("seq")
    first = evidence.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(*on, "wer", "verdict")
    return runs.join(first, on, "left").withColumn("verdict", F.coalesce("verdict", F.lit("unverified")))


def guarded(runs: DataFrame) -> DataFrame:
    """``allowed``: false for measured broken or unusable combinations."""
    return runs.withColumn("allowed", ~F.col("verdict").isin("broken", "unusable"))


def model_key(hf_id: Column) -> Column:
    return F.element_at(F.split(hf_id, "/"), -1)


def pick_profile(profiles: DataFrame, limits: DataFrame, keys: list[str]) -> DataFrame:
    """First profile by ``rank`` whose needs (need_bytes, need_gpu) a device (keys, max_bytes, gpu) meets."""
    fits = limits.join(catalogue(profiles), (F.col("need_bytes") <= F.col("max_bytes")) & (~F.col("need_gpu") | F.col("gpu")))
    best = fits.groupBy(*keys).agg(F.min_by("profile", "rank").alias("profile"))
    return limits.join(best, keys, "left")


def summarize(results: DataFrame, keys: list[str]) -> DataFrame:
    """A cell of a report: rate weighted by duration over ok rows, peak, first load, and the status.

    Rows have status, infer_ms, rtf, mem_peak_mb, load_ms, sub, del, ins, ref_words, seq.
    Without an ok row the status is timeout, error, skipped or missing, in that order.
    """
    ok = F.col("status") == "ok"
    usable = ok & (F.coalesce("infer_ms", F.lit(0.0)) != 0) & (F.coalesce("rtf", F.lit(0.0)) != 0)
    errors = F.coalesce(F.col("sub") + F.col("del") + F.col("ins"), F.lit(0))
    sums = results.groupBy(*keys).agg(
        F.count_if(ok).alias("n_ok"),
        F.count("*").alias("n_all"),
        F.bool_or(F.col("status") == "timeout").alias("_t"),
        F.bool_or(F.col("status") == "error").alias("_e"),
        F.bool_or(F.col("status") == "skipped").alias("_s"),
        F.sum(F.when(ok, F.coalesce("infer_ms", F.lit(0.0)))).alias("_infer"),
        F.sum(F.when(usable, F.try_divide("infer_ms", "rtf"))).alias("_audio"),
        F.sum(F.when(ok, errors)).alias("_err"),
        F.sum(F.when(ok, F.coalesce("ins", F.lit(0)))).alias("insertions"),
        F.sum(F.when(ok, F.coalesce("ref_words", F.lit(0)))).alias("_ref"),
        F.max(F.when(ok, F.col("mem_peak_mb"))).alias("_peak"),
        F.min_by("load_ms", F.when(ok & F.col("load_ms").isNotNull(), F.col("seq"))).alias("load_ms"),
    )
    status = F.when(F.col("n_ok") > 0, "ok").when(F.col("_t"), "timeout").when(F.col("_e"), "error").when(F.col("_s"), "skipped").otherwise("missing")
    wer = F.when(F.col("_ref") > 0, F.try_divide("_err", "_ref")).when(F.col("_err") > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
    some = F.col("n_ok") > 0
    return sums.select(
        *keys,
        status.alias("status"),
        F.when(some, F.col("n_ok")).otherwise(F.col("n_all")).alias("n"),
        F.when(F.col("_audio") > 0, F.try_divide("_infer", "_audio")).alias("rtf"),
        F.when(some, wer).alias("wer"),
        F.when(some, F.col("insertions")).alias("insertions"),
        F.when(F.col("_peak") > 0, F.col("_peak")).alias("peak_mb"),
        F.when(some, F.col("load_ms")).alias("load_ms"),
    )


def report_matrix(catalogue: DataFrame, cells: DataFrame, row: str, column: str, columns: list, value: str) -> DataFrame:
    """Rows by columns, rows of the catalogue that never ran included."""
    pivot = cells.groupBy(row).pivot(column, columns).agg(F.first(value))
    return catalogue.select(row).distinct().join(pivot, row, "left")


def failures(results: DataFrame) -> DataFrame:
    return results.where(F.col("status").isin("error", "timeout"))


#: Accuracy of the sketch that brackets a quantile: a bracket holds some 1 / 2,500 of a key's rows.
SKETCH = 20_000


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles (name -> share) of each key, and ``n``.

    A sketch of bounded rank error brackets each quantile; what lies below a bracket is only
    counted, and of what lies inside distinct values and their counts are collected, so no
    task holds a key's values, nor the copies of one value.  AQE broadcasts the brackets if
    they are small.
    """
    rows = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"))
    names, slack = list(shares), 4.0 / SKETCH
    edges = [min(max(p + s, 0.0), 1.0) for p in shares.values() for s in (-slack, slack)]
    few = F.count("*") * slack < 2  # then the bracket is everything: at most 10,000 rows
    ends = rows.groupBy(*keys).agg(F.percentile_approx("_x", F.array(*[F.lit(e) for e in edges]), F.lit(SKETCH)).alias("_e"), F.min("_x").alias("_low"), F.max("_x").alias("_high"), few.alias("_few"))
    ends = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.when(F.col("_few"), F.col("_high" if j % 2 else "_low")).otherwise(F.get("_e", F.lit(j))).alias(f"_e{j}") for j in range(len(edges))])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    sides = rows.join(ends, on) if keys else rows.crossJoin(F.broadcast(ends))  # without keys one row
    below = sides.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(F.col("_x") < F.col(f"_e{2 * i}")).alias(f"_b{i}") for i in range(len(names))])
    inside = F.array_compact(F.array(*[F.when(F.col("_x").between(F.col(f"_e{2 * i}"), F.col(f"_e{2 * i + 1}")), F.lit(i)) for i in range(len(names))]))
    held = sides.select(*keys, "_x", F.explode(inside).alias("_i")).groupBy(*keys, "_i", "_x").agg(F.count("*").alias("c"))
    lists = held.groupBy(*keys).agg(*[F.array_sort(F.collect_list(F.when(F.col("_i") == i, F.struct(F.col("_x").alias("x"), "c")))).alias(f"_v{i}") for i in range(len(names))])
    lists = lists.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[f"_v{i}" for i in range(len(names))])
    both = below.join(lists, on) if keys else below.crossJoin(F.broadcast(lists))

    def at(i: int, rank: Column) -> Column:
        start = F.struct(F.col(f"_b{i}").alias("n"), F.lit(None).cast("double").alias("x"))
        return F.aggregate(f"_v{i}", start, lambda a, v: F.struct((a["n"] + v["c"]).alias("n"), F.when(a["x"].isNull() & (a["n"] + v["c"] > rank), v["x"]).otherwise(a["x"]).alias("x")))["x"]

    def quantile(i: int, p: float) -> Column:
        place = (F.col("n") - 1) * F.lit(p)
        return at(i, F.floor(place)) + (at(i, F.ceil(place)) - at(i, F.floor(place))) * (place - F.floor(place))

    return both.select(*keys, *[quantile(i, p).alias(name) for i, (name, p) in enumerate(shares.items())], "n")


def spread(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median and the p10 to p90 range, interpolated; a single sample is its own range."""
    return quantiles(rows, keys, value, {"median": 0.5, "p10": 0.1, "p90": 0.9}).withColumn("single", F.col("n") < 2)


def range_coverage(held: DataFrame, ranges: DataFrame, keys: list[str], value: str) -> DataFrame:
    met = held.join(ranges.select(*keys, "p10", "p90"), keys)
    return met.groupBy(*keys).agg(F.count_if(F.col(value).between(F.col("p10"), F.col("p90"))).alias("inside"), F.count("*").alias("n"))


def sane_rtf(rtf: Column, speech_sec: Column) -> Column:
    finite = rtf.isNotNull() & ~F.isnan(rtf) & (F.abs(rtf) < float("inf"))
    return F.coalesce(finite & (rtf > 0) & (rtf <= LEARNED_MAX_RTF) & (speech_sec >= LEARNED_MIN_SPEECH_SEC), F.lit(False))


def last_n(rows: DataFrame, keys: list[str], order: list[str], n: int = LEARNED_SAMPLES) -> DataFrame:
    """The last n rows of each key; a ranked window, of which Spark keeps n per task."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def learned_median(rows: DataFrame, keys: list[str], order: list[str], value: str, n: int = LEARNED_SAMPLES) -> DataFrame:
    return last_n(rows, keys, order, n).groupBy(*keys).agg(F.median(value).alias("median"), F.count("*").alias("n"))


def estimate(learned: Column, measured: Column, low: Column, high: Column) -> Column:
    """(rate, low, high, source): learned, else one measurement, else the table's range."""
    none = F.lit(None).cast("double")
    return (
        F.when(learned.isNotNull(), F.struct(learned.alias("rate"), none.alias("low"), none.alias("high"), F.lit("aprendido").alias("source")))
        .when(measured.isNotNull(), F.struct(measured.alias("rate"), none.alias("low"), none.alias("high"), F.lit("calibrado").alias("source")))
        .otherwise(F.struct(((low + high) / 2).alias("rate"), low.alias("low"), high.alias("high"), F.lit("tabla").alias("source")))
    )


def drift(rows: DataFrame, keys: list[str], x: str, err: str) -> DataFrame:
    """Median error, OLS slope times the span, and means of the first and last third."""
    w = W.partitionBy(*keys)
    ranked = rows.withColumn("_i", F.row_number().over(w.orderBy(x, err))).withColumn("_n", F.count("*").over(w))
    third = F.floor(F.col("_n") / 3)
    span = F.max(x) - F.min(x)
    return ranked.groupBy(*keys).agg(
        F.median(err).alias("median_error"),
        (F.when(span > 0, F.regr_slope(err, x)).otherwise(F.lit(0.0)) * span).alias("drift"),
        F.avg(F.when(F.col("_i") <= third, F.col(err))).alias("first_third"),
        F.avg(F.when(F.col("_i") > F.col("_n") - third, F.col(err))).alias("last_third"),
        F.count("*").alias("n"),
    )


def matrix_hours(items: DataFrame, level: str, combinations: int) -> DataFrame:
    return items.where(F.col("level") == level).agg((F.coalesce(F.sum("duration_sec"), F.lit(0.0)) / 3600 * combinations).alias("hours"))


def describe_corpus(items: DataFrame) -> DataFrame:
    return items.groupBy("lang").agg(F.count("*").alias("items"), (F.sum("duration_sec") / 60).alias("minutes"))


def detail_rows(catalogue_: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """A report's detail: only the pairs of the catalogue that have results."""
    return catalogue_.join(cells, keys)


def modes(devices: DataFrame, profiles: DataFrame, keys: list[str], fast: str, balanced: str, no_gpu: str, no_room: str) -> DataFrame:
    """Three rows a device (keys, max_bytes, gpu, reason), always in this order: rapido, equilibrado, preciso.

    The first two have fixed profiles.  The third is the first GPU profile by ``rank`` that
    fits the device's buffer (a limit of 0 or null is none); without one, ``why`` says so.
    """
    limit = F.coalesce("max_bytes", F.lit(0))
    on = F.col("need_gpu") & ((limit <= 0) | (F.col("need_bytes") <= limit))
    fits = devices.where("gpu").join(catalogue(profiles), on).groupBy(*keys).agg(F.min_by("profile", "rank").alias("_best"))
    rows = devices.join(fits, keys, "left")
    why = F.when(F.col("_best").isNull(), F.when(F.coalesce("gpu", F.lit(False)), F.lit(no_room)).otherwise(F.coalesce("reason", F.lit(no_gpu))))
    none = F.lit(None).cast("string")
    row = lambda n, mode, profile, reason: F.struct(F.lit(n).alias("place"), F.lit(mode).alias("mode"), profile.alias("profile"), reason.alias("why"))
    three = F.array(row(0, "rapido", F.lit(fast), none), row(1, "equilibrado", F.lit(balanced), none), row(2, "preciso", F.col("_best"), why))
    return rows.select(*keys, F.explode(three).alias("_m")).select(*keys, "_m.*")


def running_estimate(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rate, source and what is left after each event of a run.

    Events have ``kind`` (start, calibrate, refine or any other), elapsed_sec, processed_sec,
    duration_sec, learned and median: the rate is the table's median, or the learned one if
    that is above 0; a calibration counts if it covers nine tenths of a window, a refinement
    beyond one window.  ``warmup`` compares the first window with the steady rate.
    """
    so_far = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rate = F.try_divide("elapsed_sec", "processed_sec")
    first = (F.col("kind") == "calibrate") & (F.col("processed_sec") >= CALIBRATION_SEC * CALIBRATION_SHARE)
    later = (F.col("kind") == "refine") & (F.col("processed_sec") > CALIBRATION_SEC) & (F.col("elapsed_sec") > 0)
    known = F.when(first, F.struct(rate.alias("rtf"), F.lit("calibrado").alias("source"))).when(later, F.struct(rate.alias("rtf"), F.lit("refinado").alias("source")))
    learned = F.col("learned") > 0
    start = F.struct(F.when(learned, F.col("learned")).otherwise(F.col("median")).alias("rtf"), F.when(learned, F.lit("aprendido")).otherwise(F.lit("tabla")).alias("source"))
    rows = events.withColumn("_k", F.coalesce(F.last(known, ignorenulls=True).over(so_far), start)).withColumn("_w", F.last(F.when(first, F.col("elapsed_sec")), ignorenulls=True).over(so_far))
    rtf, done = F.col("_k.rtf"), F.coalesce("processed_sec", F.lit(0.0))
    steady = rtf * CALIBRATION_SEC
    return rows.select(
        *events.columns,
        rtf.alias("rtf"),
        F.col("_k.source").alias("source"),
        (F.greatest(F.lit(0.0), F.col("duration_sec") - done) * rtf).alias("remaining_sec"),
        (F.col("duration_sec") * rtf).alias("total_sec"),
        F.when((F.col("_k.source") == "refinado") & (steady > 0), F.try_divide(F.col("_w"), steady)).alias("warmup"),
    )
