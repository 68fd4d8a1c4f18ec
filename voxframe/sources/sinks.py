"""Sinks: one text a key, assembled in the JVM from ordered rows; files one a key.

Assembling collects one key's rows, a session, and never a table.
"""

from __future__ import annotations

import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.functions.text import escape_csv, escape_markup, safe_name, trim_space
from voxframe.functions.timefmt import fixed, format_time, percent, to_fixed
from voxframe.operators.cues import shown_speaker
from voxframe.operators.store import unique_names

#: Byte order mark and header of the table format.
BOM = "﻿"
CSV_HEADER = ("start_sec", "end_sec", "start", "end", "speaker", "text")


def _join(rows: DataFrame, keys: list[str], order: str, line: Column, between: str) -> DataFrame:
    ordered = rows.select(*keys, F.struct(F.col(order).alias("o"), line.alias("s")).alias("_r"))
    return ordered.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_r")), lambda r: r["s"]), between).alias("body"))


def seconds(x: Column) -> Column:
    """Three decimals of the exact binary value, exact halves up."""
    return to_fixed(x, 3)


def to_csv(timed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, body: CRLF lines after a mark and a fixed header; rows without text are left out."""
    rows = timed.withColumn("text", trim_space(F.coalesce("text", F.lit("")))).where("text <> ''")
    s, e = F.col("start_sec"), F.col("end_sec")
    line = F.concat_ws(",", seconds(s), seconds(e), format_time(s, "."), format_time(e, "."), escape_csv(F.coalesce("speaker", F.lit(""))), escape_csv(F.col("text")))
    out = _join(rows, keys, "idx", line, "\r\n")
    return out.withColumn("body", F.concat(F.lit(BOM + ",".join(CSV_HEADER) + "\r\n"), "body", F.lit("\r\n")))


def to_srt(cues: DataFrame, keys: list[str]) -> DataFrame:
    """Numbered cues with comma milliseconds and CRLF; the speaker goes before the first line."""
    first = F.when(F.coalesce("speaker", F.lit("")) != "", F.concat("speaker", F.lit(": "))).otherwise("")
    lines = F.when(F.size("lines") > 0, F.concat(first, F.array_join("lines", "\r\n"))).otherwise(F.rtrim(first))
    head = F.concat(F.col("cue").cast("string"), F.lit("\r\n"), format_time(F.col("start_sec"), ","), F.lit(" --> "), format_time(F.col("end_sec"), ","), F.lit("\r\n"))
    out = _join(cues, keys, "cue", F.concat(head, lines), "\r\n\r\n")
    return out.withColumn("body", F.concat("body", F.lit("\r\n")))


def to_vtt(cues: DataFrame, keys: list[str]) -> DataFrame:
    """Cues with dot milliseconds and LF after a header; the speaker is a voice tag."""
    safe = F.array_join(F.transform("lines", escape_markup), "\n")
    voice = F.when(F.coalesce("speaker", F.lit("")) != "", F.concat(F.lit("<v "), escape_markup(F.col("speaker")), F.lit(">"))).otherwise("")
    line = F.concat(format_time(F.col("start_sec"), "."), F.lit(" --> "), format_time(F.col("end_sec"), "."), F.lit("\n"), voice, safe)
    out = _join(cues, keys, "cue", line, "\n\n")
    return out.withColumn("body", F.concat(F.lit("WEBVTT\n\n"), "body", F.lit("\n")))


def to_text(timed: DataFrame, keys: list[str]) -> DataFrame:
    """A line a row, with the speaker where it changes."""
    rows = shown_speaker(timed, keys)
    line = F.when(F.col("shown").isNotNull(), F.concat("shown", F.lit(": "), "text")).otherwise(F.col("text"))
    return _join(rows, keys, "idx", line, "\n")


def zip_sessions(sessions: DataFrame, texts: DataFrame, srts: DataFrame, archive: str, key: str, path: str) -> DataFrame:
    """Write a zip of a text and a subtitle file for each session of an archive's key; (archive, path, n_files, n_bytes).

    ``sessions`` has archive, key, idx, name; names are made safe and unique.  Entries come in
    order and go straight to the file, so a task holds one batch of them; a file has its name
    only when it is whole, and a task that fails leaves none.
    """
    named = unique_names(sessions.withColumn("_safe", safe_name(F.col("name"))), [archive], "_safe")
    rows = named.select(archive, key, "idx", "unique_name").join(texts.select(key, F.col("body").alias("txt")), key, "left").join(srts.select(key, F.col("body").alias("srt")), key, "left")
    digest = F.sha2(F.to_json(F.struct(archive)), 256).alias("_file")
    rows = rows.select(archive, digest, "idx", "unique_name", "txt", "srt")
    kind = dict(sessions.dtypes)[archive]

    def pack(batches):
        import uuid

        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        system.create_dir(root, recursive=True)
        name = part = stream = made = own = None

        def close():
            nonlocal made
            made.close()
            stream.close()
            final = f"{root}/{name}.zip"
            system.move(part, final)
            made = None
            return pd.DataFrame({archive: [own], "path": [f"{path.rstrip('/')}/{name}.zip"], "n_files": [n], "n_bytes": [system.get_file_info(final).size]})

        try:
            for pdf in batches:
                for r, of in zip(pdf.itertuples(index=False), pdf[archive], strict=True):
                    if r[1] != name:
                        if made is not None:
                            yield close()
                        name, own, n = r[1], of, 0
                        part = f"{root}/.{name}-{uuid.uuid4().hex}"
                        stream = system.open_output_stream(part)
                        made = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED, compresslevel=6)
                    made.writestr(f"{r[3]}.txt", r[4] or "")
                    made.writestr(f"{r[3]}.srt", r[5] or "")
                    n += 2
            if made is not None:
                yield close()
        except BaseException:
            if made is not None:
                stream.close()
                system.delete_file(part)
            raise

    return rows.repartition("_file").sortWithinPartitions("_file", "idx", "unique_name").mapInPandas(pack, f"{archive} {kind}, path string, n_files long, n_bytes long")


def append(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    rows.write.mode("append").partitionBy(*(partition_by or [])).parquet(path)


def replace_keys(rows: DataFrame, path: str, partition_by: list[str]) -> None:
    """Overwrite the partitions that ``rows`` has: running it twice leaves the same table."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def to_json(rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """keys, body: a pretty JSON object of each key's row, or, with an order, an array of its rows."""
    rest = F.struct(*[c for c in rows.columns if c not in keys])
    if order is None:
        return rows.select(*keys, F.to_json(rest, {"pretty": "true"}).alias("body"))
    listed = rows.select(*keys, F.struct(F.col(order).alias("o"), rest.alias("r")).alias("_r")).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("_r")), lambda x: x["r"]).alias("_l"))
    return listed.select(*keys, F.to_json("_l", {"pretty": "true"}).alias("body"))


#: Rows of a report's table that a driver renders; more is no report but a table to write.
REPORT_ROWS = 10_000


def markdown_table(df: DataFrame, names: list[str] | None = None, limit: int = REPORT_ROWS) -> str:
    """A report's table, whole; more than ``limit`` rows are refused, not cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report's table has at most {limit} rows")
    head = names or df.columns
    out = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    return "\n".join(out + ["| " + " | ".join("—" if x is None else str(x).replace("|", "\\|").replace("\n", " ") for x in r) + " |" for r in rows]) + "\n"


def cell_text(limit: str = "5") -> Column:
    """A cell of the matrix from ``summarize``: rate and error rate, or what happened instead."""
    good = F.concat(F.lit("**"), fixed(F.col("rtf"), 2), F.lit("** · "), percent(F.col("wer")))
    return F.when(F.col("status") == "ok", good).when(F.col("status") == "timeout", F.lit(f"⏱ >{limit}×")).when(F.col("status") == "error", F.lit("✕ error")).when(F.col("status") == "skipped", F.lit("n/a")).otherwise(F.lit("—"))


def report(run_id: str, started_at: str, device: dict[str, object], results: DataFrame, models: DataFrame, sources: DataFrame | None = None, backends: tuple[str, ...] = ("webgpu", "wasm"), choice: str | None = None) -> str:
    """The run's report in Markdown: device, corpus, matrix, detail, failures and decision.

    ``results`` are one run's rows, ``models`` the catalogue (model, license, place).  All sums
    run in Spark; the driver gets a table's cells.
    """
    from voxframe.operators.bench import failures, summarize

    cells = summarize(results, ["model", "backend"])
    known = models.select("model", "license", "place")
    matrix = known.join(cells.select("model", "backend", cell_text().alias("cell")).groupBy("model").pivot("backend", list(backends)).agg(F.first("cell")), "model", "left")
    matrix = matrix.orderBy("place").select("model", *[F.coalesce(b, F.lit("—")).alias(b) for b in backends], "license")
    ok = F.col("status") == "ok"
    spot = F.array_position(F.array(*[F.lit(b) for b in backends]), F.col("backend"))
    detail = known.join(cells, "model").orderBy("place", spot).select(
        "model", "backend", "n", F.when(ok, fixed(F.col("rtf"), 2)).otherwise(cell_text()).alias("rtf"), F.when(ok, percent(F.col("wer"))), F.when(ok, F.col("insertions")),
        F.when(ok, F.concat(fixed(F.col("peak_mb"), 0), F.lit(" MB"))), F.when(ok, F.concat(fixed(F.col("load_ms") / 1000, 1), F.lit(" s"))),
    )
    failed = failures(results).orderBy("seq").select("model", "backend", "item_id", "status", F.coalesce("error", F.lit("")))
    parts = [f"# Results of run `{run_id}`\n\nStarted {started_at}.\n", "## Device\n\n| | |\n|---|---|\n" + "".join(f"| {k} | {'—' if v is None else v} |\n" for k, v in device.items())]
    if sources is not None:
        parts.append("## Corpus\n\n" + markdown_table(sources.select("name", "url", "license"), ["Source", "Address", "License"]))
    parts.append("## Matrix\n\nEach cell: **rate** · word error rate; a rate below 1 is faster than real time.\n\n" + markdown_table(matrix, ["Model", *[b.upper() for b in backends], "License"]))
    parts.append("## Detail\n\n" + markdown_table(detail, ["Model", "Backend", "n", "Rate", "WER", "Insertions", "Peak", "Load"]))
    parts.append("Rates are weighted by duration and leave loading out; insertions are invented words; peaks are sampled, and leave graphics memory out.\n")
    if failed.limit(1).count():
        parts.append("## Failures\n\n" + markdown_table(failed, ["Model", "Backend", "Item", "Status", "Reason"]))
    parts.append(f"## Decision\n\nDefault model: {choice or '_(open)_'}\n")
    return "\n".join(parts)
