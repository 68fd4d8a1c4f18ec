"""Operators whose state outlives a batch: typed state of a key in the state store, with timers and expiry.

The state store must be able to hold maps beside values, so ``state_store`` asks for the
RocksDB provider where the session has not chosen one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from voxframe.constants import CALIBRATION_SEC, CALIBRATION_SHARE
from voxframe.operators.recurrent import Slot, features
from voxframe.session import prefer


def state_store(spark: SparkSession) -> None:
    prefer(spark, "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _InOrder(StatefulProcessor):
    """What comes early waits in a map, one entry a number; nothing else of the key is rewritten."""

    def __init__(self, names: tuple[str, str, str]):
        self.names = names

    def init(self, handle: Any) -> None:
        self.following = handle.getValueState("following", "n long")
        self.waiting = handle.getMapState("waiting", "i long", "payload string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        _, index, payload = self.names
        following = self.following.get()[0] if self.following.exists() else 0
        out: list[tuple] = []
        for pdf in rows:
            fresh = {}
            for i, x in zip(pdf[index].tolist(), pdf[payload].tolist(), strict=True):
                if i >= following:
                    fresh.setdefault(int(i), x)
            for i in sorted(fresh):
                if i > following:
                    if not self.waiting.containsKey((i,)):
                        self.waiting.updateValue((i,), (fresh[i],))
                elif i == following:
                    out.append((key[0], i, fresh[i]))
                    following += 1
                    while self.waiting.containsKey((following,)):
                        out.append((key[0], following, self.waiting.getValue((following,))[0]))
                        self.waiting.removeKey((following,))
                        following += 1
        self.following.update((following,))
        yield pd.DataFrame(out, columns=list(self.names))

    def close(self) -> None:
        pass


def in_order(blocks: DataFrame, key: str, index: str = "block_index", payload: str = "payload") -> DataFrame:
    """Blocks of a key, sent in order of their number from 0: one that comes early waits for those before it.

    A block that comes again, sent or waiting, is left out.
    """
    state_store(blocks.sparkSession)
    schema = T.StructType([blocks.schema[key], T.StructField(index, T.LongType()), T.StructField(payload, T.StringType())])
    return blocks.select(key, F.col(index).cast("long").alias(index), F.col(payload).cast("string").alias(payload)).groupBy(key).transformWithStateInPandas(_InOrder((key, index, payload)), schema, "Append", "None")


class _Recurrent(StatefulProcessor):
    def __init__(self, key: str, slot: Slot, initial: list[float], patience_ms: int):
        self.key, self.slot, self.initial, self.patience = key, slot, initial, patience_ms

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "following long, timer long, state array<double>")
        self.waiting = handle.getMapState("waiting", "w long", "x array<double>, at long")

    def _load(self) -> None:
        self.next, self.timer, self.state = self.progress.get() if self.progress.exists() else (0, -1, self.initial)
        self.state, self.out, self.least = list(self.state), [], 0

    def _step(self, w: int, x: Any) -> None:
        self.state, score = self.slot(self.state, list(x))
        self.out.append((w, float(score)))
        self.next = w + 1

    def _drain(self) -> None:
        while self.waiting.containsKey((self.next,)):
            w = self.next
            self._step(w, self.waiting.getValue((w,))[0])
            self.waiting.removeKey((w,))

    def _save(self, key: Any) -> pd.DataFrame:
        """Keep one timer, for the earliest window that waits."""
        first = min((k[0] for k in self.waiting.keys()), default=None)
        at = -1 if first is None else max(self.least, int(self.waiting.getValue((first,))[1]) + self.patience)
        if at != self.timer:
            if self.timer >= 0:
                self.handle.deleteTimer(self.timer)
            if at >= 0:
                self.handle.registerTimer(at)
        self.progress.update((self.next, at, [float(x) for x in self.state]))
        return pd.DataFrame({self.key: [key[0]] * len(self.out), "w": [w for w, _ in self.out], "score": [s for _, s in self.out]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        self._load()
        for pdf in rows:
            pdf = pdf[pdf["w"] >= self.next].drop_duplicates("w").sort_values("w")
            for w, x, at in zip(pdf["w"].tolist(), pdf["x"], pdf["at"].tolist(), strict=True):
                if w == self.next:
                    self._step(w, x)
                    self._drain()
                elif w > self.next and not self.waiting.containsKey((w,)):
                    self.waiting.updateValue((w,), ([float(v) for v in x], int(at)))
        yield self._save(key)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """The watermark has passed: windows before the first that waits will not come."""
        self._load()
        self.timer, self.least = -1, expiredTimerInfo.getExpiryTimeInMs() + 1  # this one is taken away afterwards
        first = min((k[0] for k in self.waiting.keys()), default=None)
        if first is not None:
            self.next = first
            self._drain()
        yield self._save(key)

    def close(self) -> None:
        pass


def recurrent(windows: DataFrame, key: str, slot: Slot, initial: list[float], order: str = "w", time: str = "ts", value: str = "x", late: str = "10 minutes", patience_ms: int = 0) -> DataFrame:
    """(key, w, score): a model whose state goes from each window of a key to the next, on a stream.

    ``slot(state, features) -> (state, score)`` is called for the windows 0, 1, ... in order,
    however they come: one that comes early waits in the state store, one that comes again is
    left out.  A window that has not come when the watermark, ``late`` behind, passes the
    first waiting window's time and ``patience_ms`` is passed over, the state going on
    unchanged.  State is the vector and what waits; both survive a restart.
    """
    state_store(windows.sparkSession)
    schema = T.StructType([windows.schema[key], T.StructField("w", T.LongType()), T.StructField("score", T.DoubleType())])
    at = F.unix_millis(F.col(time).cast("timestamp")).alias("at")
    rows = windows.withWatermark(time, late).select(key, F.col(order).cast("long").alias("w"), features(windows, value).alias("x"), at, F.col(time).alias("_time"))
    return rows.groupBy(key).transformWithStateInPandas(_Recurrent(key, slot, [float(x) for x in initial], patience_ms), schema, "Append", "EventTime")


class _Estimate(StatefulProcessor):
    def __init__(self, columns: list[str], order: str, expiry_ms: int | None):
        self.columns, self.order, self.expiry = columns, order, expiry_ms

    def init(self, handle: Any) -> None:
        expiry = {"ttlDurationMs": self.expiry} if self.expiry else {}
        self.known = handle.getValueState("known", "seen long, rtf double, source string, warm double", **expiry)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        none = lambda x: None if x is None or x != x else x
        seen, rtf, source, warm = self.known.get() if self.known.exists() else (None, None, None, None)
        rows = pd.concat(list(rows)).sort_values(self.order, kind="stable")  # one run's events of one batch
        out = []
        for r in rows.to_dict("records"):
            if seen is not None and r[self.order] <= seen:
                continue
            seen = int(r[self.order])
            elapsed, processed, learned, median, duration = (none(r[c]) for c in ("elapsed_sec", "processed_sec", "learned", "median", "duration_sec"))
            rate = elapsed / processed if elapsed is not None and processed else None
            if r["kind"] == "calibrate" and processed is not None and processed >= CALIBRATION_SEC * CALIBRATION_SHARE:
                rtf, source, warm = rate, "calibrado", elapsed
            elif r["kind"] == "refine" and processed is not None and processed > CALIBRATION_SEC and elapsed is not None and elapsed > 0:
                rtf, source = rate, "refinado"
            own, of = (rtf, source) if source else ((learned, "aprendido") if learned is not None and learned > 0 else (median, "tabla"))
            remaining = None if own is None or duration is None else max(0.0, duration - (processed or 0.0)) * own
            steady = own * CALIBRATION_SEC if own is not None else 0.0
            out.append((*(r[c] for c in self.columns), own, of, remaining, None if own is None or duration is None else duration * own, warm / steady if of == "refinado" and steady > 0 and warm is not None else None))
        if seen is not None:
            self.known.update((seen, rtf, source, warm))
        yield pd.DataFrame(out, columns=[*self.columns, "rtf", "source", "remaining_sec", "total_sec", "warmup"])

    def close(self) -> None:
        pass


def running_estimate(events: DataFrame, key: str, order: str, expiry_ms: int | None = None) -> DataFrame:
    """``bench.running_estimate`` of a stream: each event of a run with the estimate after it.

    State of a run is its rate, where that is from, the first window's time and the last event
    seen; events of a batch are taken in ``order``, one not after the last seen is left out.  With
    ``expiry_ms``, a run that nothing has come of for so long is forgotten and begins anew; such a
    query runs until it is stopped, as time alone can then change its state.
    """
    state_store(events.sparkSession)
    doubles = ["rtf", "remaining_sec", "total_sec", "warmup"]
    kinds = {c: T.DoubleType() for c in doubles} | {"source": T.StringType()}
    schema = T.StructType([*events.schema.fields, *[T.StructField(c, kinds[c]) for c in ("rtf", "source", "remaining_sec", "total_sec", "warmup")]])
    return events.groupBy(key).transformWithStateInPandas(_Estimate(events.columns, order, expiry_ms), schema, "Update", "ProcessingTime" if expiry_ms else "None")


def told(save: Callable[[DataFrame, int], None], tell: Callable[[int, dict], None], key: str, index: str, saved: Callable[[int], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A sink's step that tells how far each key has come, once its batch is saved and not before.

    ``saved(batch_id)`` reads the batch back from the sink, so what is told is what is there, and
    the batch is made once.  ``tell`` gets the batch's number and the last ``index`` of each
    key; a batch that is saved again is told again.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        save(batch, batch_id)
        for row in saved(batch_id).groupBy(key).agg(F.max(index).alias("last"), F.count("*").alias("n")).toLocalIterator():
            tell(batch_id, row.asDict())

    return step
