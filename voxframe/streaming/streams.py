"""Structured Streaming forms of the windowed and stateful operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voxframe.constants import MIN_SILENCE_MS, VAD_THRESHOLD, WINDOW_MS


def energy(events: DataFrame, key: str, ts: str = "ts", value: str = "value", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """RMS of tumbling event-time windows; rows later than the watermark are left out."""
    w = events.withWatermark(ts, late).groupBy(key, F.window(ts, width)).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.count("*").alias("n"))
    return w.select(key, F.col("window.start").alias("start"), "rms", "n")


def sliding(events: DataFrame, key: str, ts: str = "ts", width: str = "30 seconds", step: str = "20 seconds", late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark(ts, late).groupBy(key, F.window(ts, width, step)).agg(F.count("*").alias("n"))
    return w.select(key, F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Gap-merged sessions; an event exactly ``gap`` after the last opens a new one."""
    w = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("n"))
    return w.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def segments(probs: DataFrame, key: str, threshold: float = VAD_THRESHOLD, gap_ms: float = MIN_SILENCE_MS, window_ms: float = WINDOW_MS) -> DataFrame:
    """Merged segments of score windows (key, w, p) that come in order within a key.

    State is the open segment: (start window, end window).  A segment is sent when a gap
    closes it, or when nothing has come for an hour.
    """
    schema = T.StructType([probs.schema[key], T.StructField("start_sec", T.DoubleType()), T.StructField("end_sec", T.DoubleType())])

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import numpy as np

        start, end = state.get if state.exists else (-1, -1)
        out: list[tuple] = []

        def close() -> None:
            if start >= 0:
                out.append((k[0], start * window_ms / 1000, end * window_ms / 1000))

        if state.hasTimedOut:
            close()
            state.remove()
        else:
            for pdf in batches:
                w = np.sort(pdf.loc[pdf["p"] > threshold, "w"].to_numpy("int64"))
                if not len(w):
                    continue
                apart = np.diff(np.concatenate(([end - 1], w))) - 1  # silent windows before each
                fresh = np.flatnonzero(apart * window_ms >= gap_ms) if start >= 0 else np.concatenate(([0], np.flatnonzero(apart[1:] * window_ms >= gap_ms) + 1))
                for i in fresh.tolist():
                    end = int(w[i - 1]) + 1 if i else end
                    close()
                    start = int(w[i])
                end = int(w[-1]) + 1
            state.update((int(start), int(end)))
            state.setTimeoutDuration(3_600_000)
        yield pd.DataFrame(out, columns=[key, "start_sec", "end_sec"])

    return probs.groupBy(key).applyInPandasWithState(step, schema, "start long, end long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def write_batches(df: DataFrame, path: str, checkpoint: str, key: str = "batch_id", then: Callable[[Callable], Callable] | None = None, mode: str = "append") -> Any:
    """Idempotent sink: a batch's rows replace the partition of its number, so a repeated batch adds nothing.

    ``then`` may wrap the step that saves a batch, as ``stateful.told`` does.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn(key, F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)

    return df.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).foreachBatch(then(save) if then else save).trigger(availableNow=True).start()


def isolated(rows: DataFrame, call: Callable[[Any], Any], column: str, into: str = "result", kind: str = "string", seconds: float | None = None) -> DataFrame:
    """A model slot: ``call`` on each row's value; its failure becomes the row's status and error, not the job's.

    ``kind`` is the type that the model gives: ``string`` for texts and translations,
    ``array<float>`` for embeddings.  Null values and blank texts are passed over with status
    'skipped'; a call that takes longer than ``seconds`` has status 'timeout' and is left
    behind in a daemon thread, which nothing waits for.
    """
    import queue
    import threading

    def timed(x: Any) -> tuple:
        """(finished, value, failure) of a call within ``seconds``."""
        given: queue.SimpleQueue = queue.SimpleQueue()

        def work() -> None:
            try:
                given.put((True, call(x), None))
            except BaseException as e:  # noqa: BLE001  handed to the row
                given.put((True, None, e))

        threading.Thread(target=work, daemon=True).start()
        try:
            return given.get(timeout=seconds)
        except queue.Empty:
            return False, None, None

    @F.pandas_udf(f"struct<value:{kind},status:string,error:string>")
    def run(col: pd.Series) -> pd.DataFrame:
        out = []
        for x in col:
            if x is None or (isinstance(x, str) and not x.strip()):
                out.append((x if kind == "string" else None, "skipped", None))
                continue
            try:
                finished, value, failure = timed(x) if seconds else (True, call(x), None)
                if failure is not None:
                    raise failure
                out.append((value, "ok", None) if finished else (None, "timeout", f"more than {seconds} s"))
            except Exception as e:  # noqa: BLE001  any failure is this row's own
                out.append((None, "error", str(e)))
        return pd.DataFrame(out, columns=["value", "status", "error"])

    return rows.withColumn(into, run(F.col(column)))


def isolated_batches(rows: DataFrame, call: Callable[[list], list], column: str, into: str = "result", kind: str = "string", size: int = 32) -> DataFrame:
    """A model slot for models that take many values at once: ``call`` gets up to ``size`` values and gives as many.

    A batch that fails is halved till the values that fail stand alone, so each failure is one
    row's own and costs a few calls more; null values and blank texts are passed over as in
    ``isolated``.
    """

    @F.pandas_udf(f"struct<value:{kind},status:string,error:string>")
    def run(col: pd.Series) -> pd.DataFrame:
        values = list(col)
        out: list = [None] * len(values)
        todo = []
        for i, x in enumerate(values):
            if x is None or (isinstance(x, str) and not x.strip()):
                out[i] = (x if kind == "string" else None, "skipped", None)
            else:
                todo.append(i)
        parts = [todo[i : i + size] for i in range(0, len(todo), size)][::-1]
        while parts:
            part = parts.pop()
            try:
                given = list(call([values[i] for i in part]))
                if len(given) != len(part):
                    raise ValueError(f"{len(given)} results of {len(part)} values")
                for i, value in zip(part, given, strict=True):
                    out[i] = (value, "ok", None)
            except Exception as e:  # noqa: BLE001  any failure is a row's own
                if len(part) == 1:
                    out[part[0]] = (None, "error", str(e))
                else:
                    parts += [part[len(part) // 2 :], part[: len(part) // 2]]
        return pd.DataFrame(out, columns=["value", "status", "error"])

    return rows.withColumn(into, run(F.col(column)))


def isolated_rows(rows: DataFrame, call: Callable[[Any], list], column: str, kind: str, seconds: float | None = None) -> DataFrame:
    """A table function's slot: ``call`` gives any number of values of ``kind`` for a row, each of which becomes a row.

    A row without values, passed over or failed stays as one row with a null ``value``, its status and error.
    """
    held = isolated(rows, call, column, "_r", f"array<{kind}>", seconds)
    some = F.when(F.size("_r.value") > 0, F.col("_r.value"))
    return held.select(*rows.columns, F.posexplode_outer(some).alias("value_idx", "value"), F.col("_r.status").alias("status"), F.col("_r.error").alias("error"))


def run_queue(items: DataFrame, keys: list[str], order: str, prepare: Callable[[Any], Any], transcribe: Callable[[Any, Any], bool], value: str, resume: str) -> DataFrame:
    """``state`` and ``error`` of each item of a queue: prepared, then transcribed, each by itself.

    Only a queue's first item is resumed, with the row's ``resume``: a run left half-way belongs
    to that file, and blocks of it must not begin another.  An item that fails has state
    'error' and stops none behind it; a controlled failure (False) has no error text; a queue of
    one item is run without states.
    """
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    rows = items.withColumn("_n", F.count("*").over(W.partitionBy(*keys))).withColumn("_resume", F.when(place == 1, F.col(resume)))

    @F.pandas_udf("struct<state:string,error:string>")
    def run(values: pd.Series, resumes: pd.Series) -> pd.DataFrame:
        out = []
        for x, half in zip(values, resumes, strict=True):
            try:
                out.append(("listo" if transcribe(prepare(x), half) else "error", None))
            except Exception as e:  # noqa: BLE001  any failure is this item's own
                out.append(("error", str(e)))
        return pd.DataFrame(out, columns=["state", "error"])

    many = F.col("_n") > 1
    done = rows.withColumn("_r", run(F.col(value), F.col("_resume")))
    return done.select(*items.columns, F.when(many, F.col("_r.state")).alias("state"), F.when(many, F.col("_r.error")).alias("error"))
