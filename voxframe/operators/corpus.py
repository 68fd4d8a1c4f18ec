"""Corpus building and audit: validation, quality rules, sampling and splits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.constants import CORPUS_GAP_SEC, CORPUS_OVERLAP_SEC
from voxframe.functions.text import trim_space, word_count


def violations(rows: DataFrame, key: str, rules: list[tuple[str, Column]], order: str | None = None) -> DataFrame:
    """(key, problem): every rule that holds for a row; a repeated key is a problem from its second row on."""
    n = F.row_number().over(W.partitionBy(key).orderBy(order or key))
    marked = rows.withColumn("_dup", F.col(key).isNotNull() & (n > 1))
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(text)) for text, bad in rules], F.when(F.col("_dup"), F.lit("id repeated"))))
    return marked.select(key, F.explode(found).alias("problem"))


def manifest_rules() -> list[tuple[str, Column]]:
    c = F.col
    blank = lambda x: x.isNull() | (trim_space(x) == "")
    return [
        ("id missing", blank(c("id"))),
        ("url missing", blank(c("url"))),
        ("reference empty", blank(c("reference"))),
        ("sha256 missing or malformed", c("sha256").isNull() | ~c("sha256").rlike("^[0-9a-f]{64}$")),
        ("durationSec not above 0", ~F.coalesce(c("durationSec") > 0, F.lit(False))),
        ("lang neither es nor en", ~F.coalesce(c("lang").isin("es", "en"), F.lit(False))),
        ("level not A, B or V", c("level").isNotNull() & ~c("level").isin("A", "B", "V")),
        ("split unknown", c("split").isNotNull() & ~c("split").isin("principal", "validacion")),
        ("multi with fewer than two speakers", (c("condition") == "multi") & (F.coalesce(c("speakers"), F.lit(0)) < 2)),
        ("noisy without snrDb", (c("condition") == "noisy") & c("snrDb").isNull()),
    ]


def manifest_problems(manifests: DataFrame, key: str = "path") -> DataFrame:
    """(key, item, problem) of whole manifests (key, version, items): those of the header, with a null item, then the items'."""
    heads = manifests.select(key, "version", F.coalesce(F.size("items"), F.lit(0)).alias("n_items"))
    return item_problems(heads, manifests.select(key, F.posexplode("items").alias("item", "i")).select(key, "item", "i.*"), key)


def item_problems(heads: DataFrame, items: DataFrame, key: str = "path", order: str = "item") -> DataFrame:
    """``manifest_problems`` of headers (key, version, n_items) and of items as rows (key, ``order``, an item's columns).

    The rules are judged where an item is read: to the repeated ids, a manifest's rows of one id
    side by side, only the problems' names go with it, never its text.
    """
    header = F.array_compact(F.array(F.when(F.coalesce("version", F.lit("")) == "", F.lit("version missing")), F.when(F.col("n_items") < 1, F.lit("no items"))))
    head = heads.select(key, F.lit(None).cast(items.schema[order].dataType).alias(order), F.explode(header).alias("problem"))
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(text)) for text, bad in manifest_rules()]))
    rows = items.select(key, order, "id", found.alias("_found"))
    n = F.row_number().over(W.partitionBy(key, "id").orderBy(order))
    again = F.when(F.col("id").isNotNull() & (F.col("id") != "") & (n > 1), F.array(F.lit("id repeated"))).otherwise(F.array().cast("array<string>"))
    marked = rows.select(key, order, F.concat("_found", again).alias("_found"))
    return head.unionByName(marked.select(key, order, F.explode("_found").alias("problem")))


def density_ok(reference: Column, seconds: Column, low: float = 1.0, high: float = 4.5) -> Column:
    """Do a reference's words a second of audio lie inside the band of read speech (ends excluded)?"""
    return rate_inside(word_count(reference), seconds, low, high)


def rate_inside(n_words: Column, seconds: Column, low: float = 1.0, high: float = 4.5) -> Column:
    """``density_ok`` of words that are counted already."""
    rate = F.try_divide(n_words, seconds)
    return F.coalesce((rate > low) & (rate < high), F.lit(False))


def speech_bands(items: DataFrame, low: float = 0.5, high: float = 0.98, least: float = 0.6, most: float = 1.8) -> DataFrame:
    """Of items (speech_sec, duration_sec, n_segments, expected): speech's share, segments by those expected, and whether both are inside their bands."""
    share, ratio = F.try_divide("speech_sec", "duration_sec"), F.try_divide("n_segments", "expected")
    inside = lambda x, a, b: F.coalesce((x > a) & (x < b), F.lit(False))
    return items.withColumn("speech_share", share).withColumn("segment_ratio", ratio).withColumn("share_ok", inside(F.col("speech_share"), low, high)).withColumn("segments_ok", inside(F.col("segment_ratio"), least, most))


def reference_bands(items: DataFrame, n_words: str = "n_words", seconds: str = "duration_sec", least: int = 50, low: float = 0.5, high: float = 6.0) -> DataFrame:
    """Has a normalized reference enough words for a stable error rate, and a plausible number a second?"""
    rate = F.try_divide(n_words, seconds)
    return items.withColumn("words_per_sec", rate).withColumn("enough", F.col(n_words) > least).withColumn("rate_ok", F.coalesce((rate > low) & (rate < high), F.lit(False)))


def quality(items: DataFrame) -> DataFrame:
    """Data-quality rules of measured items, one row an item and rule, ``ok`` or not."""
    c = F.col
    rules = {
        "hash": c("sha256") == c("measured_sha256"),
        "rate": c("rate") == 16000,
        "mono": c("channels") == 1,
        "duration": F.abs(c("duration_sec") - c("measured_sec")) < 0.05,
        "level": c("rms") > 0.005,
        "clipping": c("clip_percent") < 0.1,
        "reference": F.length(trim_space(c("reference"))) > 20,
        "density": (c("words_per_sec") > 1.0) & (c("words_per_sec") < 4.5),
    }
    wide = items.select("id", *[F.coalesce(v, F.lit(False)).alias(k) for k, v in rules.items()])
    return wide.unpivot("id", list(rules), "rule", "ok")


def changed_hashes(old: DataFrame, new: DataFrame) -> DataFrame:
    b = new.select("id", F.col("sha256").alias("new_sha256"))
    return old.select("id", "sha256").join(b, "id").where("sha256 <> new_sha256")


def existing(index: DataFrame, files: DataFrame) -> DataFrame:
    """Index rows with text whose file exists."""
    return index.where(trim_space(F.col("text")) != "").join(files.select("name"), "name", "left_semi")


def contained_share(texts: DataFrame, references: DataFrame, keys: list[str]) -> DataFrame:
    """Share of a key's texts that its reference contains, and whether it is 80 % or more.

    A key's distinct texts are one automaton, and its reference is read once, however many texts
    there are.  An empty text is in every reference, a null one in none; several references
    of a key count each with all texts; a key without texts or without reference gives no row.
    """
    some = F.lit(True)
    for k in keys:
        some = some & F.col(k).isNotNull()
    counted = texts.where(some).groupBy(*keys, F.col("text").cast("string").alias("text")).agg(F.count("*").alias("times"))
    held = references.where(some).select(*keys, F.col("reference").cast("string").alias("reference"))
    schema = T.StructType([*counted.select(*keys).schema.fields, T.StructField("inside", T.LongType()), T.StructField("n", T.LongType())])

    def run(key: tuple, own: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        import ahocorasick

        if not len(own) or not len(refs):
            return pd.DataFrame(columns=[*keys, "inside", "n"])
        times = {t: int(n) for t, n in zip(own["text"], own["times"], strict=True) if t}
        empty = int(own.loc[own["text"] == "", "times"].sum())
        machine = ahocorasick.Automaton()
        for t in times:
            machine.add_word(t, t)
        machine.make_automaton()
        inside = 0
        for reference in refs["reference"]:
            if reference is not None:
                found = {t for _, t in machine.iter(reference)} if times else set()
                inside += empty + sum(times[t] for t in found)
        return pd.DataFrame([[*key, inside, int(own["times"].sum()) * len(refs)]], columns=[*keys, "inside", "n"])

    sums = counted.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(run, schema)
    return sums.withColumn("ok", F.col("inside") * 100 >= F.col("n") * 80)


def take_until(pool: DataFrame, keys: list[str], order: str, seconds: float, least: float = 0.5, gap: float = CORPUS_GAP_SEC) -> DataFrame:
    """Clips in order till they and the gap behind each reach the target; clips shorter than ``least`` are passed over."""
    rows = pool.where(F.col("duration_sec") >= least)
    before = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    held = F.coalesce(F.sum("duration_sec").over(before), F.lit(0.0)) + F.count("*").over(before) * gap
    return rows.withColumn("_before", held).where(F.col("_before") < seconds).drop("_before")


def pick_diverse(speakers: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """One of each group a round, in order of groups, n in all."""
    turn = F.row_number().over(W.partitionBy(group).orderBy(order))
    return speakers.withColumn("_turn", turn).orderBy("_turn", group).limit(n).drop("_turn")


def disjoint_bins(rows: DataFrame, keys: list[str], order: str, size: str, target: float) -> DataFrame:
    """``bin``: consecutive rows by running size; no row is in two."""
    before = F.coalesce(F.sum(size).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return rows.withColumn("bin", F.floor(before / target).cast("int"))


def clips_by_speaker(clips: DataFrame) -> DataFrame:
    return clips.groupBy("speaker").agg(F.array_sort(F.collect_list("clip_id")).alias("clips"))


def seeded(seed: int):
    """The 32-bit seeded generator of corpus builds, as a Python iterator of numbers in [0, 1)."""
    word = 0xFFFFFFFF
    state = seed & word
    while True:
        state = state + 0x6D2B79F5 & word
        x = (state ^ state >> 15) * (state | 1) & word
        x ^= x + ((x ^ x >> 7) * (x | 61) & word) & word
        yield (x ^ x >> 14) / 2**32


def turns(clips: dict[str, list[tuple[str, float]]], seconds: float, draw, overlap: float = CORPUS_OVERLAP_SEC, least: float = 0.5) -> list[tuple[str, str, float, float]]:
    """A dialogue plan (speaker, clip, start, end) over a driver-side catalogue of clips.

    Speakers take turns in the order given; a turn is one clip, or two for a draw of a half
    or more, and a speaker without clips is passed over without a draw.  Turns go on till
    the clips reach the target.  Clips shorter than ``least`` are used up unplaced; every
    clip starts ``overlap`` before the end of the one before.
    """
    at, held, placed, idle = dict.fromkeys(clips, 0), 0.0, [], 0
    order = list(clips)
    turn = 0
    while held < seconds and idle < len(order):
        speaker = order[turn % len(order)]
        turn += 1
        if at[speaker] >= len(clips[speaker]):
            idle += 1
            continue
        idle = 0
        own = clips[speaker][at[speaker] : at[speaker] + 1 + (next(draw) >= 0.5)]
        at[speaker] += len(own)
        for clip, length in own:
            if length >= least:
                placed.append((speaker, clip, length))
                held += length
    out, start = [], 0.0
    for speaker, clip, length in placed:
        out.append((speaker, clip, start, start + length))
        start += length - overlap
    return out
