"""Ordered intervals: islands, merging, padding, packing, and interval joins.

Scans are by entity; where one entity may have more rows than a task should take, with
``stretched`` they go by stretches of its rows (``scans``), to the same result.  Interval joins go by (keys, size class, time
bucket): a bucket is as wide as the longer interval of a pair, so that an interval of any
length lies in two buckets at most for each class that it can meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.constants import CHUNK_SEC, JUMP_SEC, MAX_BLOCK_SEC, MIN_SILENCE_MS, MIN_SPEECH_MS, PAD_MS, VAD_THRESHOLD, WINDOW_MS
from voxframe.operators.scans import by_number, by_time, scanned


def raw_segments(probs: DataFrame, keys: list[str], threshold: float = VAD_THRESHOLD, window_ms: float = WINDOW_MS, stretched: bool = False) -> DataFrame:
    """keys, start_sec, end_sec of the runs of windows with p above the threshold.

    ``probs`` has keys, w (0, 1, ...), p and duration_sec; a run still open at the last
    window ends with the duration.
    """
    speech = F.coalesce(F.col("p") > threshold, F.lit(False))
    rows = scanned(probs.withColumn("_s", speech), keys, ["w"], by_number("w") if stretched else None, _before=("prev", F.col("_s")), _next=("next", F.col("w"))).where("_s")
    start = ~F.coalesce("_before", F.lit(False))
    rows = scanned(rows, keys, ["w"], by_number("w") if stretched else None, _g=("sum", F.when(start, 1).otherwise(0)))
    runs = rows.groupBy(*keys, "_g").agg(F.min("w").alias("a"), F.max("w").alias("b"), F.max(F.col("_next").isNull()).alias("open"), F.max("duration_sec").alias("duration_sec"))
    end = F.when(F.col("open"), F.col("duration_sec")).otherwise((F.col("b") + 1) * window_ms / 1000)
    return runs.select(*keys, (F.col("a") * window_ms / 1000).alias("start_sec"), end.alias("end_sec"), "duration_sec")


def merge_close(segments: DataFrame, keys: list[str], gap_ms: float = MIN_SILENCE_MS, carry: tuple[str, ...] = (), stretched: bool = False) -> DataFrame:
    """Disjoint sorted intervals with a gap below ``gap_ms`` become one."""
    rows = scanned(segments, keys, ["start_sec"], by_time("start_sec") if stretched else None, _before=("prev", F.col("end_sec")))
    apart = F.coalesce((F.col("start_sec") - F.col("_before")) * 1000 >= gap_ms, F.lit(True))
    rows = scanned(rows, keys, ["start_sec"], by_time("start_sec") if stretched else None, _g=("sum", F.when(apart, 1).otherwise(0)))
    return rows.groupBy(*keys, "_g").agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), *[F.max(c).alias(c) for c in carry]).drop("_g")


def pad(segments: DataFrame, keys: list[str], pad_ms: float = PAD_MS, stretched: bool = False) -> DataFrame:
    """Wider by ``pad_ms`` on both sides, up to the middle between unpadded neighbours, 0 and the duration."""
    p = pad_ms / 1000
    rows = scanned(segments, keys, ["start_sec"], by_time("start_sec") if stretched else None, _before=("prev", F.col("end_sec")), _after=("next", F.col("start_sec")), _n=("sum", F.lit(1)))
    low = F.coalesce((F.col("_before") + F.col("start_sec")) / 2, F.lit(0.0))
    high = F.coalesce((F.col("end_sec") + F.col("_after")) / 2, F.col("duration_sec"))
    return rows.select(*keys, (F.col("_n") - 1).cast("int").alias("idx"), F.greatest(low, F.col("start_sec") - p).alias("start_sec"), F.least(high, F.col("end_sec") + p).alias("end_sec"))


def to_segments(probs: DataFrame, keys: list[str], threshold: float = VAD_THRESHOLD, min_silence_ms: float = MIN_SILENCE_MS, min_speech_ms: float = MIN_SPEECH_MS, pad_ms: float = PAD_MS, window_ms: float = WINDOW_MS, stretched: bool = False) -> DataFrame:
    """Score series to padded segments: islands, then merging, then the length filter, then padding."""
    merged = merge_close(raw_segments(probs, keys, threshold, window_ms, stretched), keys, min_silence_ms, ("duration_sec",), stretched)
    long = merged.where((F.col("end_sec") - F.col("start_sec")) * 1000 >= min_speech_ms)
    return pad(long, keys, pad_ms, stretched)


def to_blocks(segments: DataFrame, keys: list[str], max_sec: float = MAX_BLOCK_SEC) -> DataFrame:
    """Greedy bins of consecutive segments no longer than ``max_sec``; an oversize segment is a bin alone.

    Where a bin begins depends on the one before it, so a key is one sequence; it goes
    through its task as sorted batches, of which only the open bin's start is carried on.
    """
    import pandas as pd

    rows = segments.select(*keys, F.to_json(F.struct(*keys)).alias("_key"), "idx", "start_sec", "end_sec")
    schema = T.StructType([*rows.select(*keys).schema.fields, T.StructField("block_id", T.IntegerType()), *rows.select("idx", "start_sec", "end_sec").schema.fields])

    def run(batches):
        key = opened = None
        n = -1
        for pdf in batches:
            ids = []
            for k, start, end in zip(pdf["_key"].tolist(), pdf["start_sec"].tolist(), pdf["end_sec"].tolist(), strict=True):
                if k != key:
                    key, opened, n = k, None, -1
                if opened is None or end - opened > max_sec:
                    n, opened = n + 1, start
                if end - start > max_sec:
                    opened = None  # alone
                ids.append(n)
            yield pd.DataFrame(pdf.drop(columns="_key")).assign(block_id=ids)

    marked = rows.repartition(*keys).sortWithinPartitions(*keys, "idx", "start_sec", "end_sec").mapInPandas(run, schema)
    return marked.groupBy(*keys, "block_id").agg(
        F.array_sort(F.collect_list(F.struct("start_sec", "end_sec"))).alias("segments"),
        F.min("start_sec").alias("start_sec"),
        F.max_by("end_sec", "idx").alias("end_sec"),
        F.sum(F.col("end_sec") - F.col("start_sec")).alias("speech_sec"),
    )


def total_speech(segments: DataFrame, keys: list[str]) -> DataFrame:
    return segments.groupBy(*keys).agg(F.sum(F.col("end_sec") - F.col("start_sec")).alias("speech_sec"), F.count("*").alias("n_segments"))


def decode_windows(duration: Column, chunk: float = CHUNK_SEC, jump: float = JUMP_SEC) -> Column:
    """Starts of overlapping decode windows over a duration."""
    n = F.when(duration <= chunk, F.lit(1)).otherwise(F.ceil((duration - chunk) / jump).cast("int") + 1)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * F.lit(jump))


def monotone_progress(rows: DataFrame, keys: list[str], jump: float = JUMP_SEC, stretched: bool = False) -> DataFrame:
    """Times that restart in each decode window (keys, seq, t, duration_sec) as one rising ``at_sec``."""
    rows = scanned(rows, keys, ["seq"], by_number("seq") if stretched else None, _t=("prev", F.col("t")))
    rows = scanned(rows, keys, ["seq"], by_number("seq") if stretched else None, _w=("sum", F.when(F.col("t") < F.col("_t"), 1).otherwise(0)))
    at = F.least(F.col("_w") * jump + F.col("t"), F.col("duration_sec"))
    return scanned(rows, keys, ["seq"], by_number("seq") if stretched else None, at_sec=("max", at)).drop("_t", "_w")


#: log2 of the seconds of the narrowest bucket, and of the widest.
LEAST_CLASS, MOST_CLASS = 4, 40


def _class(start: str, end: str) -> Column:
    """log2 of the width of buckets of which an interval lies in two at most."""
    length = F.greatest(F.col(end) - F.col(start), F.lit(1.0))
    return F.greatest(F.lit(LEAST_CLASS), F.least(F.lit(MOST_CLASS), F.ceil(F.log2(length)).cast("int")))


def _classes(df: DataFrame) -> list[int]:
    """The classes that a side has: a few dozen numbers at most."""
    return sorted(r[0] for r in df.select("_class").where("_class IS NOT NULL").distinct().collect())


def _bucketed(df: DataFrame, start: str, end: str, others: list[int]) -> DataFrame:
    """A row for each bucket of an interval, of its own class and of each wider one that the other side has."""
    wider = F.array_distinct(F.transform(F.array(*[F.lit(c) for c in others]), lambda c: F.greatest(c, F.col("_class"))))
    rows = df.withColumn("_m", F.explode(wider))
    width = F.pow(F.lit(2.0), F.col("_m"))
    first = F.floor(F.col(start) / width)
    return rows.withColumn("_bucket", F.explode(F.sequence(first, F.greatest(first, F.ceil(F.col(end) / width) - 1))))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs with left.(start_sec, end_sec) and right.(r_start, r_end) overlapping, and ``overlap_sec``.

    A pair meets in the wider of its two classes only, and there in one bucket, that of the
    later start.
    """
    left, right = left.withColumn("_class", _class("start_sec", "end_sec")), right.withColumn("_class", _class("r_start", "r_end"))
    a = _bucketed(left, "start_sec", "end_sec", _classes(right)).withColumnRenamed("_class", "_a")
    b = _bucketed(right, "r_start", "r_end", _classes(left)).withColumnRenamed("_class", "_b")
    met = a.join(b, [*keys, "_m", "_bucket"]).where((F.col("start_sec") < F.col("r_end")) & (F.col("r_start") < F.col("end_sec")))
    once = (F.greatest("_a", "_b") == F.col("_m")) & (F.floor(F.greatest("start_sec", "r_start") / F.pow(F.lit(2.0), F.col("_m"))) == F.col("_bucket"))
    return met.where(once).withColumn("overlap_sec", F.least("end_sec", "r_end") - F.greatest("start_sec", "r_start")).drop("_bucket", "_m", "_a", "_b")


def best_overlap(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, least_sec: float = 0.5) -> DataFrame:
    """For each left interval the right one of largest overlap above ``least_sec``; ties to the smaller id."""
    met = overlap_join(left, right, keys).where(F.col("overlap_sec") > least_sec)
    order = W.partitionBy(*keys, left_id).orderBy(F.desc("overlap_sec"), right_id)
    return met.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def at_point(points: DataFrame, intervals: DataFrame, keys: list[str], t: str) -> DataFrame:
    """Index of the first interval [start, end) that holds each point; -1 for none."""
    held = intervals.select(*keys, "idx", "start_sec", "end_sec").withColumn("_class", _class("start_sec", "end_sec"))
    classes = _classes(held) or [LEAST_CLASS]
    s = _bucketed(held, "start_sec", "end_sec", [LEAST_CLASS]).drop("_class")
    p = points.withColumn("_p", F.monotonically_increasing_id()).withColumn("_m", F.explode(F.array(*[F.lit(c) for c in classes])))
    p = p.withColumn("_bucket", F.floor(F.col(t) / F.pow(F.lit(2.0), F.col("_m"))))
    met = p.join(s, [*keys, "_m", "_bucket"], "left")
    inside = F.when((F.col(t) >= F.col("start_sec")) & (F.col(t) < F.col("end_sec")), F.col("idx"))
    return met.groupBy("_p").agg(*[F.first(c).alias(c) for c in points.columns], F.coalesce(F.min(inside), F.lit(-1)).alias("active_idx")).drop("_p")


def nearest_label(rows: DataFrame, keys: list[str], time: str, label: str, order_by: str = "idx", stretched: bool = False) -> DataFrame:
    """Null labels take that of the nearest labelled row by ``time``; ties go to the earlier row.

    Rows are in order of time and ``order_by``.  Keys without any label get '0'.
    """
    known = F.when(F.col(label).isNotNull(), F.struct(F.col(time).alias("t"), F.col(label).alias("v")))
    rows = scanned(rows.withColumn("_k", known), keys, [time, order_by], by_time(time) if stretched else None, _b=("last", F.col("_k")), _a=("first", F.col("_k")))
    # rows at one instant: the first labelled row of that instant wins
    same = F.first("_k", ignorenulls=True).over(W.partitionBy(*keys, "_bt").orderBy(time, order_by).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    rows = rows.withColumn("_bt", F.col("_b.t")).withColumn("_first", same)
    early = F.when(F.col("_b").isNotNull(), F.coalesce("_first.v", "_b.v"))
    near_back = F.col("_a").isNull() | (F.col(time) - F.col("_b.t") <= F.col("_a.t") - F.col(time))
    filled = F.coalesce(F.col(label), F.when(F.col("_b").isNotNull() & near_back, early), F.col("_a.v"), F.lit("0"))
    return rows.withColumn(label, filled).drop("_k", "_b", "_a", "_bt", "_first")


def speech_regions(frames: DataFrame, keys: list[str], share: float = 0.05, gap: int = 10, least: int = 5) -> DataFrame:
    """Runs of 20 ms frames (keys, w, rms) at ``share`` of the peak or more: merged over gaps below ``gap`` frames, at least ``least`` long."""
    whole, order = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("w")
    rows = frames.withColumn("_on", F.col("rms") >= F.max("rms").over(whole) * share).where("_on")
    rows = rows.withColumn("_g", F.sum(F.when(F.coalesce(F.col("w") - F.lag("w").over(order) - 1 >= gap, F.lit(True)), 1).otherwise(0)).over(order))
    return rows.groupBy(*keys, "_g").agg(F.min("w").alias("first_w"), (F.max("w") + 1).alias("end_w")).where(F.col("end_w") - F.col("first_w") >= least).drop("_g")
