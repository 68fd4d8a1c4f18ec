"""Running values over keys' ordered rows, also of one key with more rows than a task should take.

Without stretches these are windows by key.  With them, a key's rows are cut into stretches
of their order.  Each stretch is scanned by itself, in windows by (keys, stretch); what a row
needs of the stretches before or behind it is in one summary row for each of them, and only
summaries meet by key.  The join back finds the rows where the windows left them, so rows
are shuffled once; they are checkpointed before, as they are read twice and scans follow
each other.

Frames that reach the end are taken in reversed order, since Spark makes such frames anew
for every row.  Keys may be null: they meet as equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxframe.session import cut

#: Rows of a numbered sequence, and seconds of a timeline, that one task scans.
STRETCH_ROWS, STRETCH_SEC = 1 << 16, 3600.0


def by_number(column: str) -> Column:
    return F.floor(F.col(column) / STRETCH_ROWS)


def by_time(column: str) -> Column:
    return F.floor(F.col(column) / STRETCH_SEC)


def scanned(rows: DataFrame, keys: list[str], order: list[str], stretch: Column | None, **wanted: tuple[str, Column]) -> DataFrame:
    """``rows`` with a column for each of ``wanted``, in ``order`` within ``keys``.

    ``stretch``, if there is one, must not fall with the order.

    sum     the sum up to this row
    max     the largest up to this row
    prev    the value of the row before, null for the first
    next    the value of the row behind, null for the last
    last    the last value that is not null, up to this row
    first   the first value that is not null, from this row on
    """
    own = rows if stretch is None else rows.withColumn("_stretch", stretch)
    for name, (_, value) in wanted.items():
        own = own.withColumn(f"_of_{name}", value)
    own = own if stretch is None else cut(own)
    parts = keys if stretch is None else [*keys, "_stretch"]
    up, down = W.partitionBy(*parts).orderBy(*order), W.partitionBy(*parts).orderBy(*[F.col(c).desc() for c in order])
    so_far = lambda w: w.rowsBetween(W.unboundedPreceding, 0)
    place = F.struct(*order)
    held = lambda c: F.struct(F.col(c).alias("v"))  # a null value is a value of prev and next
    local, summary = [], []
    for name, (kind, _) in wanted.items():
        c, s = f"_of_{name}", f"_sum_{name}"
        local.append({
            "sum": lambda c: F.sum(c).over(so_far(up)),
            "max": lambda c: F.max(c).over(so_far(up)),
            "prev": lambda c: F.lag(held(c)).over(up),
            "next": lambda c: F.lag(held(c)).over(down),
            "last": lambda c: F.last(c, ignorenulls=True).over(so_far(up)),
            "first": lambda c: F.last(c, ignorenulls=True).over(so_far(down)),
        }[kind](c).alias(f"_at_{name}"))
        known = F.when(F.col(c).isNotNull(), place)
        summary.append({
            "sum": lambda c: F.sum(c), "max": lambda c: F.max(c), "prev": lambda c: F.max_by(held(c), place), "next": lambda c: F.min_by(held(c), place),
            "last": lambda c, known=known: F.max_by(F.col(c), known), "first": lambda c, known=known: F.min_by(F.col(c), known),
        }[kind](c).alias(s))
    if stretch is None:
        alone = lambda name, kind: F.col(f"_at_{name}")["v"] if kind in ("prev", "next") else F.col(f"_at_{name}")
        return own.select("*", *local).select(*rows.columns, *[alone(name, kind).alias(name) for name, (kind, _) in wanted.items()])
    before = W.partitionBy(*keys).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)
    behind = W.partitionBy(*keys).orderBy(F.col("_stretch").desc()).rowsBetween(W.unboundedPreceding, -1)
    carried = own.groupBy(*keys, "_stretch").agg(*summary)
    carry = lambda kind, s: {"sum": F.sum(s).over(before), "max": F.max(s).over(before)}.get(kind, F.last(s, ignorenulls=True).over(before if kind in ("prev", "last") else behind))
    carried = carried.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_stretch").alias("_of_stretch"), *[carry(kind, f"_sum_{name}").alias(f"_in_{name}") for name, (kind, _) in wanted.items()])
    own = own.select("*", *local)
    met = own.join(carried, [*[F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.col("_stretch").eqNullSafe(F.col("_of_stretch"))])
    out = []
    for name, (kind, _) in wanted.items():
        here, into = F.col(f"_at_{name}"), F.col(f"_in_{name}")
        if kind == "sum":
            value = F.when(here.isNull(), into).otherwise(here + F.coalesce(into, F.lit(0)))
        elif kind == "max":
            value = F.greatest(here, into)
        else:
            value = F.coalesce(here, into)
            value = value["v"] if kind in ("prev", "next") else value
        out.append(value.alias(name))
    return met.select(*rows.columns, *out)
