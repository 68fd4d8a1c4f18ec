"""Signal operators: long-form measures in the JVM, filters and mixes as Arrow kernels, one clip a row."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxframe.constants import BURSTS, ENERGY_RATIO, WINDOW_SAMPLES

TAPS = 81


def lowpass(cutoff: float, rate: float, taps: int = TAPS):
    """Hamming-windowed sinc with unit gain at zero."""
    import numpy as np

    k = np.arange(taps) - (taps - 1) / 2
    h = 2 * cutoff / rate * np.sinc(2 * cutoff / rate * k) * np.hamming(taps)
    return h / h.sum()


def resample_clip(x, rate: int, target: int):
    """Filter at 0.45 of the target rate, then decimate, or interpolate where the ratio is not whole."""
    import numpy as np

    x = np.asarray(x, "float64")
    if rate == target:
        return x
    if rate < target:
        raise ValueError(f"no way up from {rate} to {target}")
    smooth = np.convolve(x, lowpass(0.45 * target, rate))[TAPS // 2 : TAPS // 2 + len(x)] if len(x) else x
    at = np.arange(int(len(x) * target // rate)) * (rate / target)
    if rate % target == 0:
        return smooth[at.astype(int)]
    low = np.floor(at).astype(int)
    far = np.append(smooth, 0.0)
    return far[low] * (1 - (at - low)) + far[low + 1] * (at - low)


def resample(clips: DataFrame, target: int, rate: str = "rate", samples: str = "samples") -> DataFrame:
    @F.pandas_udf("array<float>")
    def run(rates: pd.Series, xs: pd.Series) -> pd.Series:
        return pd.Series([resample_clip(x, int(r), target).astype("float32") for r, x in zip(rates, xs, strict=True)])

    return clips.withColumn(samples, run(rate, samples)).withColumn(rate, F.lit(target))


def resample_blocks(blocks: DataFrame, keys: list[str], target: int, size: int, block: str = "block", rate: str = "rate", samples: str = "samples") -> DataFrame:
    """``resample`` of signals that come as blocks 0, 1, ... of ``size`` samples, the last of any length.

    A block is filtered with what the filter and the step between samples need of its
    neighbours, which meets it by (keys, block), and the places of new samples are counted from
    the signal's beginning; so the blocks of one long signal are made by many tasks and their
    samples, one after the other, are those of the whole signal.
    """
    halo = TAPS // 2 + 1
    if size < 2 * halo:
        raise ValueError(f"a block has {2 * halo} samples or more")
    held, n = F.coalesce(samples, F.array().cast("array<float>")), F.size(samples)
    edge = lambda move, part: blocks.select(*[F.col(k).alias(f"_k{i}{move}") for i, k in enumerate(keys)], (F.col(block) + move).alias(f"_b{move}"), part)
    behind = edge(1, F.slice(held, F.greatest(n - halo + 1, F.lit(1)), F.lit(halo)).alias("_left"))
    ahead = edge(-1, F.struct(F.slice(held, F.lit(1), F.lit(halo)).alias("head"), n.alias("n")).alias("_right"))
    own = lambda move: [*[F.col(k).eqNullSafe(F.col(f"_k{i}{move}")) for i, k in enumerate(keys)], F.col(block) == F.col(f"_b{move}")]
    rows = blocks.join(behind, own(1), "left").join(ahead, own(-1), "left")

    @F.pandas_udf("array<float>")
    def run(index: pd.Series, rates: pd.Series, xs: pd.Series, left: pd.Series, right: pd.Series, after: pd.Series) -> pd.Series:
        import numpy as np

        out = []
        for i, r, x, before, behind, more in zip(index, rates, xs, left, right, after, strict=True):
            a = np.asarray(before if before is not None else [], "float64")
            c = np.asarray(behind if behind is not None else [], "float64")
            x = np.asarray(x, "float64")
            start, n = int(i) * size, len(x)
            if r == target:
                out.append(x.astype("float32"))
                continue
            if r < target:
                raise ValueError(f"no way up from {r} to {target}")
            end = None if more == more and more is not None and more >= size else start + n + (0 if more is None or more != more else int(more))
            whole = np.concatenate([a, x, c])
            smooth = np.convolve(whole, lowpass(0.45 * target, int(r)))[TAPS // 2 : TAPS // 2 + len(whole)] if len(whole) else whole
            first = -(-start * target // int(r))  # places at * r / target from this block on
            last = -(-(start + n) * target // int(r))
            if end is not None:  # the signal's end is known here
                last = min(last, end * target // int(r))
            at = np.arange(first, last) * (int(r) / target)
            low = np.floor(at).astype("int64") - start + len(a)
            if int(r) % target == 0:
                out.append(smooth[low].astype("float32"))
                continue
            far = np.append(smooth, 0.0)
            part = at - np.floor(at)
            out.append((far[low] * (1 - part) + far[low + 1] * part).astype("float32"))
        return pd.Series(out)

    made = run(F.col(block), F.col(rate), held, F.col("_left"), F.col("_right.head"), F.col("_right.n").cast("double"))
    return rows.select(*[made.alias(c) if c == samples else F.lit(target).alias(c) if c == rate else F.col(c) for c in blocks.columns])


def mix(signal, noise, snr_db: float):
    """Noise looped under a signal at a signal-to-noise ratio, scaled down only if it would clip."""
    import numpy as np

    s, n = np.asarray(signal, "float64"), np.asarray(noise, "float64")
    level = lambda v: float(np.sqrt((v * v).mean())) if len(v) else 0.0
    out = s + np.resize(n, len(s)) * (level(s) / 10 ** (snr_db / 20) / (level(n) or 1e-12))
    top = np.abs(out).max(initial=0.0)
    return out * (0.99 / top) if top > 0.99 else out


def mix_at_snr(pairs: DataFrame, snr_db: float, signal: str = "samples", noise: str = "noise") -> DataFrame:
    @F.pandas_udf("array<float>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([mix(x, y, snr_db).astype("float32") for x, y in zip(a, b, strict=True)])

    return pairs.withColumn(signal, run(signal, noise))


def babble(pool: list[list], n: int, draw, rate: int = 16_000, layers: int = 6, window: int = 40, gap: float = 0.05):
    """Murmur of a driver-side pool of clips: layers of consecutive clips from drawn places, each with its own phase, averaged."""
    import numpy as np

    still, least = np.zeros(int(gap * rate + 0.5)), rate * 0.5
    out = np.zeros(n)
    for k in range(layers):
        first = int(next(draw) * max(1, len(pool) - window))
        own, held = [], 0.0
        for clip in pool[first : first + window]:
            if held >= n / rate:
                break
            if len(clip) >= least:
                own += [np.asarray(clip, "float64"), still]
                held += len(clip) / rate + gap
        if own:
            layer = np.concatenate(own)
            out += np.resize(np.roll(layer, -(k * len(layer) // layers)), n)
    return out / layers


def room_noise(n: int, seed: int = 1, level: float = 0.01):
    """Linear-congruential noise: state = state * 1664525 + 1013904223 modulo 2^32.

    States k steps apart obey a rule of the same form, so known ones double with each step.
    """
    import numpy as np

    mask = 0xFFFFFFFF
    states = np.array([seed & mask], "uint64")
    times, plus = 1664525, 1013904223
    while len(states) <= n:
        states = np.concatenate((states, (states * np.uint64(times) + np.uint64(plus)) & np.uint64(mask)))
        times, plus = times * times & mask, (plus * times + plus) & mask
    return (states[1 : n + 1] / 0x100000000 * 2 - 1) * level


def frames(samples: DataFrame, keys: list[str], n: int = WINDOW_SAMPLES) -> DataFrame:
    """Whole frames of n samples of the long form (keys, i, x): rms of each; the tail is dropped."""
    rows = samples.groupBy(*keys, F.floor(F.col("i") / n).cast("int").alias("w")).agg(F.count("*").alias("_n"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))
    return rows.where(F.col("_n") == n).drop("_n")


def energy_per_second(samples: DataFrame, keys: list[str], rate: int) -> DataFrame:
    """RMS of each second, the last partial one by its own count."""
    return samples.groupBy(*keys, F.floor(F.col("i") / rate).cast("int").alias("sec")).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.count("*").alias("n"))


def burst_pattern(energy: DataFrame, keys: list[str], bursts=BURSTS, ratio: float = ENERGY_RATIO) -> DataFrame:
    """Do the seconds wholly in bursts stand out?  Seconds partly in one do not count; an empty side fails."""
    sec = F.col("sec").cast("double")
    inside = outside = None
    for a, b in bursts:
        i, o = (sec >= a) & (sec + 1 <= b), (sec + 1 <= a) | (sec >= b)
        inside, outside = (i, o) if inside is None else (inside | i, outside & o)
    sums = energy.groupBy(*keys).agg(F.min(F.when(inside, F.col("rms"))).alias("low_in"), F.max(F.when(outside, F.col("rms"))).alias("high_out"))
    return sums.withColumn("pattern_ok", F.coalesce(F.col("low_in") > ratio * F.col("high_out"), F.lit(False)))


def background(frames_: DataFrame, keys: list[str], share: float = 0.1) -> DataFrame:
    """Level of the quiet part: the upper middle of the lowest tenth of frame levels."""
    w = W.partitionBy(*keys)
    rows = frames_.withColumn("_r", F.row_number().over(w.orderBy("rms", "w"))).withColumn("_k", F.greatest(F.floor(F.count("*").over(w) * share), F.lit(1)))
    return rows.where(F.col("_r") == F.floor(F.col("_k") / 2) + 1).select(*keys, F.col("rms").alias("background"))


def noisy_vs_clean(levels: DataFrame, lang: str = "lang", ratio: float = 5.0) -> DataFrame:
    side = lambda c: F.avg(F.when(F.col("condition") == c, F.col("background")))
    sums = levels.groupBy(lang).agg(side("noisy").alias("noisy"), side("clean").alias("clean"))
    return sums.withColumn("ratio", F.col("noisy") / F.greatest(F.col("clean"), F.lit(1e-9))).withColumn("ok", F.col("ratio") > ratio)


def trim_edges(samples: DataFrame, keys: list[str], share: float = 0.02) -> DataFrame:
    """First and last sample at ``share`` of the peak."""
    top = F.max(F.abs("x")).over(W.partitionBy(*keys))
    loud = samples.withColumn("_top", top).where(F.abs("x") >= share * F.col("_top"))
    return loud.groupBy(*keys).agg(F.min("i").alias("first_i"), F.max("i").alias("last_i"))
