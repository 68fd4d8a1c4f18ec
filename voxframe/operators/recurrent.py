"""A model whose state goes from window to window, in batch; ``streaming.stateful`` has the stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (state, features of a window) -> (state, score)
Slot = Callable[[list[float], list[float]], tuple[list[float], float]]


def features(windows: DataFrame, value: str) -> Column:
    """A window's features as an array, whether the column is one or a number."""
    c = F.col(value)
    return (c if isinstance(windows.schema[value].dataType, T.ArrayType) else F.array(c)).cast("array<double>")


def recurrent_scores(windows: DataFrame, keys: list[str], slot: Slot, initial: list[float], order: str = "w", value: str = "x") -> DataFrame:
    """(keys, w, score): the slot's score of each window, in order of ``w`` from the initial state.

    A key's windows are one sequence by nature, so they go through one task, but as sorted
    batches: the task holds a batch and the state.  Windows that repeat a number are taken
    once; null features are an empty list.
    """
    rows = windows.select(*keys, F.col(order).cast("long").alias("w"), F.coalesce(features(windows, value), F.array().cast("array<double>")).alias("x"))
    schema = T.StructType([*rows.select(*keys, "w").schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches):
        import pandas as pd

        key = state = last = None
        for pdf in batches:
            scores, keep = [], []
            for k, w, x in zip(pdf["_key"].tolist(), pdf["w"].tolist(), pdf["x"], strict=True):
                if k != key:
                    key, state, last = k, [float(v) for v in initial], None
                keep.append(w != last)
                if w != last:
                    state, score = slot(state, x.tolist())
                    scores.append(float(score))
                    last = w
            yield pd.DataFrame(pdf.loc[keep, [*keys, "w"]]).assign(score=scores)

    keyed = rows.withColumn("_key", F.to_json(F.struct(*keys)))
    return keyed.repartition(*keys).sortWithinPartitions(*keys, "w").mapInPandas(run, schema)
