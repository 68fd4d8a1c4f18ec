"""Vectors, sample slices and small collections, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(a: Column) -> Column:
    return a.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where a norm is 0."""
    return cosine_of(dot(a, b), F.sqrt(dot(a, a)), F.sqrt(dot(b, b)))


def cosine_of(product: Column, norm_a: Column, norm_b: Column) -> Column:
    return F.when((norm_a == 0) | (norm_b == 0), F.lit(0.0)).otherwise(F.try_divide(product, norm_a * norm_b))


def rms(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.sqrt(F.try_divide(dot(a, a), F.size(a)))).otherwise(F.lit(0.0))


def peak(a: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(_doubles(a), lambda x: F.abs(x))), F.lit(0.0))


def clip_percent(a: Column, level: float = 0.999) -> Column:
    return F.when(F.size(a) > 0, F.size(F.filter(a, lambda x: F.abs(x) >= level)) * 100.0 / F.size(a)).otherwise(F.lit(0.0))


def limit_peak(a: Column, top: float = 0.99) -> Column:
    """Scale down to ``top`` where the peak is above it."""
    scaled = lambda p: F.when(p > top, F.transform(_doubles(a), lambda x: x * top / p)).otherwise(_doubles(a))
    return F.get(F.transform(F.array(peak(a)), scaled), F.lit(0))


def concat_clips(rows, keys: list[str], order: str, samples: str = "samples"):
    """The clips of each key one after another, by ``order``: one array a key."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, samples))), lambda r: r[samples])
    return rows.groupBy(*keys).agg(F.flatten(parts).alias(samples))


def slice_samples(a: Column, start_sec: Column, end_sec: Column, rate: int = 16_000) -> Column:
    """Samples from floor(start) to ceil(end), inside the signal."""
    low = F.greatest(F.floor(start_sec * rate), F.lit(0)).cast("int")
    high = F.least(F.ceil(end_sec * rate), F.size(a).cast("long")).cast("int")
    return F.slice(a, low + 1, F.greatest(high - low, F.lit(0)))


def slice_rounded(a: Column, start_sec: Column, end_sec: Column, rate: int = 16_000) -> Column:
    """Samples from round(start) to round(end), as embeddings take them."""
    low = F.greatest(F.floor(start_sec * rate + 0.5), F.lit(0)).cast("int")
    high = F.least(F.floor(end_sec * rate + 0.5), F.size(a).cast("long")).cast("int")
    return F.slice(a, low + 1, F.greatest(high - low, F.lit(0)))


def first_seconds(a: Column, seconds: float, rate: int = 16_000) -> Column:
    return F.slice(a, 1, int(seconds * rate))


def silence(seconds: Column, rate: int = 16_000) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), F.floor(seconds * rate + 0.5).cast("int"))


def equal_components(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda t: t))


def coverage(reference: Column, said: Column) -> Column:
    """Share of the reference's tokens, repeats counted, that were said; 0 for none."""
    return F.when(F.size(reference) > 0, F.size(F.filter(reference, lambda w: F.array_contains(said, w))) * 1.0 / F.size(reference)).otherwise(F.lit(0.0))


def surplus(reference: Column, said: Column) -> Column:
    return F.filter(said, lambda w: ~F.array_contains(reference, w))


def append_last(items: Column, item: Column, keep: int) -> Column:
    """The list with the item at its end, cut to the last ``keep``."""
    grown = F.concat(F.coalesce(items, F.array().cast("array<double>")), F.array(item))
    return F.slice(grown, F.greatest(F.size(grown) - keep, F.lit(0)) + 1, F.lit(keep))


def tolerant_json(col: Column, schema: str) -> Column:
    """Parsed JSON, null where it is broken."""
    return F.from_json(col, schema, {"mode": "PERMISSIVE"})


def median_of(items: Column) -> Column:
    """Middle value, mean of the middle two; null for none."""
    s, n = F.array_sort(items), F.size(items)
    at = lambda i: F.get(s, i.cast("int"))
    return F.when(n > 0, F.when(n % 2 == 1, at((n - 1) / 2)).otherwise((at(n / 2 - 1) + at(n / 2)) / 2.0))


def quantile_of(items: Column, p: float) -> Column:
    """Linear interpolation at (n - 1) p."""
    s, n = F.array_sort(items), F.size(items)
    place = (n - 1) * p
    low = F.get(s, F.floor(place).cast("int"))
    high = F.get(s, F.ceil(place).cast("int"))
    return F.when(n > 0, low + (high - low) * (place - F.floor(place)))


def labels_of(groups: Column, n: Column) -> Column:
    """Label of each element 0..n-1 from groups of element numbers; '' where it has none."""
    def label(i: Column) -> Column:
        found = F.filter(F.transform(groups, lambda g, k: F.when(F.array_contains(g, i), k.cast("string"))), lambda s: s.isNotNull())
        return F.coalesce(F.get(found, F.lit(0)), F.lit(""))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n.cast("int") - 1), label)).otherwise(F.array().cast("array<string>"))


def flatten_segments(blocks: Column) -> Column:
    return F.flatten(F.transform(blocks, lambda b: b["segments"]))


def edited_indexes(segments: Column) -> Column:
    return F.transform(F.filter(segments, lambda s: s["edited"]), lambda s: s["idx"])
