"""Keyed tables: sessions, segments, runs and their chunks, as append, merge and prune.

A write is a new version of a key's rows; the latest wins on reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxframe.constants import KEPT_RUNS
from voxframe.functions.text import is_video, trim_space, word_count


def merge_edits(rows: DataFrame, edits: DataFrame, keys: list[str], replace: list[str], keep_null: tuple[str, ...] = ("speaker",), mark: str | None = "edited", version: str | None = None) -> DataFrame:
    """Point updates: ``replace`` columns take the edit's values, those in ``keep_null`` only where it has one.

    Of several edits of a key the one of the largest ``version`` counts, without a version
    column the largest by its values; rows are never multiplied.
    """
    values = F.struct(*[F.col(c).alias(f"_{c}") for c in replace])
    one = F.max_by(values, version) if version else F.max(values)
    new = edits.groupBy(*keys).agg(one.alias("_e")).select(*keys, "_e.*", F.lit(True).alias("_hit"))
    joined = rows.join(new, keys, "left")
    hit = F.coalesce("_hit", F.lit(False))
    out = []
    for c in rows.columns:
        if c in replace:
            value = F.coalesce(f"_{c}", c) if c in keep_null else F.col(f"_{c}")
            out.append(F.when(hit, value).otherwise(F.col(c)).alias(c))
        elif c == mark:
            out.append((F.coalesce(F.col(c), F.lit(False)) | hit).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest version of each key, by an aggregate that combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(*keys, "_r.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def rename(sessions: DataFrame, names: DataFrame) -> DataFrame:
    """New names by session_id; a blank one is refused and changes nothing, and of several the largest counts."""
    good = names.select("session_id", trim_space(F.col("name")).alias("_name")).where("_name <> ''").groupBy("session_id").agg(F.max("_name").alias("_name"))
    return sessions.join(good, "session_id", "left").withColumn("name", F.coalesce("_name", "name")).drop("_name")


def relabel(rows: DataFrame, old: str, new: str) -> DataFrame:
    """One speaker's label in bulk; taking another's label merges the two."""
    return rows.withColumn("speaker", F.when(F.col("speaker") == old, F.lit(new)).otherwise(F.col("speaker")))


def release_audio(sessions: DataFrame, ids: DataFrame) -> DataFrame:
    gone = ids.select("session_id", F.lit(True).alias("_gone")).distinct()
    return sessions.join(gone, "session_id", "left").withColumn("has_audio", F.col("has_audio") & ~F.coalesce("_gone", F.lit(False))).drop("_gone")


def newest(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """A top-n report: a heap in each task and one merge, no full sort."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(n)


def prune(runs: DataFrame, keys: list[str], order: list[str], keep: int = KEPT_RUNS) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): the newest ``keep`` runs of each key stay."""
    ranked = runs.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])))
    return ranked.where(F.col("_n") <= keep).drop("_n"), ranked.where(F.col("_n") > keep).drop("_n")


def resume_prefix(runs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Segments of the finished blocks of each run (file_key, done_blocks), in order; later chunks are ignored."""
    done = chunks.join(runs.select("file_key", "done_blocks"), "file_key").where(F.col("block_index") < F.col("done_blocks"))
    return done.groupBy("file_key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block_index", "segments"))), lambda x: x["segments"])).alias("segments"))


def resumed(runs: DataFrame, chunks: DataFrame, new: DataFrame) -> DataFrame:
    """(file_key, segments, text, speech_sec) of resumed runs: finished blocks from storage, the others from ``new``.

    ``chunks`` and ``new`` have file_key, block_index, segments, speech_sec, text.  Blocks that
    storage has are not taken again from ``new``; both together, in order of blocks, are what
    one uninterrupted run gives.
    """
    done = runs.select("file_key", "done_blocks")
    columns = ["file_key", "block_index", "segments", "speech_sec", "text"]
    first = chunks.join(done, "file_key").where(F.col("block_index") < F.col("done_blocks")).select(*columns)
    rest = new.join(done, "file_key", "left").where(F.col("block_index") >= F.coalesce("done_blocks", F.lit(0))).select(*columns)
    block = F.struct("block_index", "segments", "speech_sec", F.coalesce("text", F.lit("")).alias("text"))
    whole = first.unionByName(rest).groupBy("file_key").agg(F.array_sort(F.collect_list(block)).alias("_b"))
    return whole.select(
        "file_key",
        F.flatten(F.transform("_b", lambda x: x["segments"])).alias("segments"),
        F.array_join(F.filter(F.transform("_b", lambda x: x["text"]), lambda t: t != ""), " ").alias("text"),
        F.aggregate("_b", F.lit(0.0), lambda n, x: n + x["speech_sec"]).alias("speech_sec"),
    )


def stored_bytes(sessions: DataFrame, column: str = "audio_bytes") -> DataFrame:
    return sessions.agg(F.coalesce(F.sum(F.coalesce(column, F.lit(0))), F.lit(0)).cast("long").alias("bytes"))


def editor_totals(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Words of the texts, and seconds of speech in which an interval that runs backwards counts as 0."""
    length = F.greatest(F.lit(0.0), F.col("end_sec") - F.col("start_sec"))
    return segments.groupBy(*keys).agg(F.sum(word_count(F.col("text"))).alias("n_words"), F.sum(length).alias("speech_sec"))


#: What an editor gets of a stored segment; keys, numbers and marks stay in storage.
EDITOR_FIELDS = ("start_sec", "end_sec", "text", "speaker")


def editor_segments(segments: Column) -> Column:
    """An array of stored segments without the fields that are storage's own."""
    return F.transform(segments, lambda x: F.struct(*[x[f].alias(f) for f in EDITOR_FIELDS]))


def opened(sessions: DataFrame) -> DataFrame:
    """Stored sessions (session_id, name, segments, mime, ...) as an editor opens them."""
    edited = F.transform(F.filter("segments", lambda x: F.coalesce(x["edited"], F.lit(False))), lambda x: x["idx"])
    kind = F.when(is_video(F.col("mime")), F.lit("video")).otherwise(F.lit("audio"))
    return sessions.select("session_id", "name", editor_segments(F.col("segments")).alias("segments"), kind.alias("media_kind"), edited.alias("edited_initially"))


def save_notice(audio_stored: Column, with_audio: str, without_audio: str) -> Column:
    """What to say of a save: nothing at all where nothing was saved (null)."""
    return F.when(audio_stored, F.lit(with_audio)).when(~audio_stored, F.lit(without_audio))


def log_tail(log: DataFrame, keys: list[str], order: list[str], n: int = 200) -> DataFrame:
    """The last ``n`` entries of each log and the one that has just come: n + 1 rows of a key, no more."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n + 1).drop("_n")


def with_sizes(sessions: DataFrame, sizes: DataFrame) -> DataFrame:
    return sessions.join(sizes, "session_id", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0).cast("long")))


def zip_strict(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join row by row on (keys, idx); a row without its counterpart is an error."""
    marked = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), [*keys, "idx"], "full")
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return marked.withColumn("_ok", F.when(both, F.lit(1)).otherwise(F.raise_error(F.lit("the two sides differ in length")).cast("int"))).where("_ok = 1").drop("_l", "_r", "_ok")


def queue_counts(items: DataFrame, keys: list[str]) -> DataFrame:
    return items.groupBy(*keys).agg(F.count_if(F.col("estado") == "listo").alias("listos"), F.count_if(F.col("estado") == "error").alias("errores"), F.count("*").alias("total"))


def worth_saving(segments: DataFrame, keys: list[str]) -> DataFrame:
    return segments.groupBy(*keys).agg(F.bool_or(trim_space(F.coalesce("text", F.lit(""))) != "").alias("worth_saving"))


def unique_names(rows: DataFrame, keys: list[str], base: str, order: str = "idx") -> DataFrame:
    """``unique_name``: repeats of a name, whatever its case, get ' (2)', ' (3)' ..."""
    n = F.row_number().over(W.partitionBy(*keys, F.lower(base)).orderBy(order))
    return rows.withColumn("_n", n).withColumn("unique_name", F.when(F.col("_n") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit(" ("), F.col("_n").cast("string"), F.lit(")")))).drop("_n")
