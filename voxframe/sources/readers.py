"""Sources: manifests, timelines, index files, WAV clips and keyed tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe import schema
from voxframe.functions.text import trim_space


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Items of a corpus manifest, one row each, with the manifest's version and seed."""
    whole = spark.read.schema(schema.MANIFEST).json(path, multiLine=True)
    return whole.select("version", "seed", F.posexplode("items").alias("item_no", "item")).select("version", "seed", "item_no", "item.*")


def timeline(spark: SparkSession, path: str) -> DataFrame:
    """Speaker turns of a timeline file: item_id, speaker, start_sec, end_sec."""
    whole = spark.read.schema(schema.TIMELINE).json(path, multiLine=True)
    items = whole.select(F.explode("items").alias("i")).select(F.col("i.id").alias("item_id"), F.explode("i.turns").alias("t"))
    return items.select("item_id", F.col("t.speaker").alias("speaker"), F.col("t.startSec").alias("start_sec"), F.col("t.endSec").alias("end_sec"))


def tsv_index(spark: SparkSession, path: str) -> DataFrame:
    """id, text of non-empty lines cut at the first tab, both trimmed: later tabs belong to the text."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).where("value <> ''").select(trim_space(F.get(parts, F.lit(0))).alias("id"), trim_space(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("text"))


def csv_index(spark: SparkSession, path: str) -> DataFrame:
    """id, text of lines (prompt, id, text) cut at the first two commas; one pair of outer quotes goes.

    Lines with fewer commas, and those without an id or a text, are left out.
    """
    parts = F.split("value", ",", 3)
    rows = spark.read.text(path).where(F.size(parts) == 3)
    rows = rows.select(trim_space(parts[1]).alias("id"), F.regexp_replace(trim_space(parts[2]), '^"|"$', "").alias("text"))
    return rows.where("id <> '' and text <> ''")


def parse_wav(data: bytes) -> tuple[int, int, list]:
    """(rate, channels, mono samples) of a 16-bit PCM file; chunks are walked, channels averaged."""
    import struct

    import numpy as np

    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, layout, body = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            layout = struct.unpack_from("<HHIIHH", data, at + 8)
        elif name == b"data":
            body = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if layout is None or body is None:
        raise ValueError("a WAV file without format or data")
    kind, channels, rate, _, _, bits = layout
    if kind != 1 or bits != 16:
        raise ValueError("only 16-bit PCM is read")
    whole = np.frombuffer(body[: len(body) // (2 * channels) * 2 * channels], "<i2").reshape(-1, channels)
    return rate, channels, (whole.mean(1) / 32768).astype("float32")


def write_wav(samples, rate: int) -> bytes:
    """Mono 16-bit PCM; samples are clamped to [-1, 1], halves round up."""
    import struct

    import numpy as np

    x = np.floor(np.clip(np.asarray(samples, "float64"), -1, 1) * 32767 + 0.5).astype("<i2").tobytes()
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(x), b"WAVE", b"fmt ", 16, 1, 1, rate, rate * 2, 2, 16, b"data", len(x)) + x


def wav(spark: SparkSession, path: str) -> DataFrame:
    """path, rate, channels, samples, sha256, error of WAV files; a broken file has an error, not a failed job."""
    files = spark.read.format("binaryFile").load(path)

    def read(batches):
        import hashlib

        for pdf in batches:
            rows = []
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                digest = hashlib.sha256(data).hexdigest()
                try:
                    rows.append((name, *parse_wav(bytes(data)), digest, None))
                except ValueError as e:
                    rows.append((name, None, None, None, digest, str(e)))
            yield pd.DataFrame(rows, columns=["path", "rate", "channels", "samples", "sha256", "error"])

    return files.select("path", "content").mapInPandas(read, "path string, rate int, channels int, samples array<float>, sha256 string, error string")


def load_run(runs: DataFrame, results: DataFrame, run_id: str | None = None) -> DataFrame:
    """Headers of bench runs with their results in order of ``seq``; a run without results has none."""
    some = (lambda df: df) if run_id is None else (lambda df: df.where(F.col("run_id") == run_id))
    rest = [c for c in results.columns if c not in ("run_id", "seq")]
    rows = some(results).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("seq", *rest))).alias("results"))
    return some(runs).join(rows, "run_id", "left").withColumn("results", F.coalesce("results", F.array().cast(rows.schema["results"].dataType)))


def keyed(spark: SparkSession, path: str, **keys) -> DataFrame:
    """Rows of a table with the given key values; the filter reaches the scan."""
    df = spark.read.parquet(path)
    for k, v in keys.items():
        df = df.where(F.col(k) == v)
    return df


def learned_memory(col: Column) -> Column:
    """Profile to last rates from a JSON text; broken or missing text is an empty map."""
    return F.coalesce(F.from_json(col, schema.LEARNED), F.from_json(F.lit("{}"), schema.LEARNED))


def browser_of(agent: Column) -> Column:
    """Browser bucket of a user agent; order matters, as later names appear in earlier browsers."""
    return F.when(agent.rlike("(?i)edg/"), "edge").when(agent.rlike("(?i)firefox/"), "firefox").when(agent.rlike("(?i)(chrome|chromium)/"), "chrome").when(agent.rlike("(?i)safari/"), "safari").otherwise("otro")
