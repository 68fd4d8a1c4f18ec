"""Timed text: alignment to intervals, subtitle cues, wrapping, pages and speaker order.

Folds run over one row's words or one entity's rows, inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxframe.constants import MAX_CHARS_PER_LINE, MAX_CUE_SEC, MAX_LINES, MIN_CUE_SEC, READING_CHARS_PER_SEC
from voxframe.functions.text import sentences, trim_space, words
from voxframe.functions.timefmt import format_time, half_up


def wrap(text: Column, width: int = MAX_CHARS_PER_LINE) -> Column:
    """Lines of whole words, at most ``width`` characters unless one word is longer."""
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("lines"), F.lit("").alias("line"))

    def step(a: Column, w: Column) -> Column:
        longer = F.concat(a["line"], F.lit(" "), w)
        return (
            F.when(a["line"] == "", F.struct(a["lines"].alias("lines"), w.alias("line")))
            .when(F.length(longer) <= width, F.struct(a["lines"].alias("lines"), longer.alias("line")))
            .otherwise(F.struct(F.concat(a["lines"], F.array(a["line"])).alias("lines"), w.alias("line")))
        )

    return F.aggregate(words(text), start, step, lambda a: F.when(a["line"] == "", a["lines"]).otherwise(F.concat(a["lines"], F.array(a["line"]))))


def wrap_by_measure(text: Column, width: float, widths: dict[str, float], other: float = 1.0) -> Column:
    """As ``wrap``, where a line's width is the sum of its characters' widths."""
    table = F.create_map(*[F.lit(x) for pair in widths.items() for x in pair]) if widths else F.create_map().cast("map<string,double>")
    measure = lambda s: F.aggregate(F.split(s, ""), F.lit(0.0), lambda n, c: n + F.when(c == "", 0.0).otherwise(F.coalesce(F.try_element_at(table, c), F.lit(other))))
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))

    def step(a: Column, w: Column) -> Column:
        longer = F.when(a["line"] == "", w).otherwise(F.concat(a["line"], F.lit(" "), w))
        fits = (a["line"] == "") | (measure(longer) <= width)
        return F.when(fits, F.struct(a["lines"].alias("lines"), longer.alias("line"))).otherwise(F.struct(F.concat(a["lines"], F.array(a["line"])).alias("lines"), w.alias("line")))

    return F.aggregate(words(text), start, step, lambda a: F.when(a["line"] == "", a["lines"]).otherwise(F.concat(a["lines"], F.array(a["line"]))))


def page_of(heights: Column, usable: float, first: float | None = None) -> Column:
    """Page number (from 0) of each row height; an over-tall row has a page and no page is empty."""
    first = usable if first is None else first
    start = F.struct(F.lit(0).alias("page"), F.lit(0.0).alias("filled"), F.lit(0).alias("rows"), F.array().cast("array<int>").alias("pages"))

    def step(a: Column, h: Column) -> Column:
        room = F.when(a["page"] == 0, F.lit(float(first))).otherwise(F.lit(float(usable)))
        turn = (a["filled"] + h > room) & (a["rows"] > 0)
        page = a["page"] + F.when(turn, 1).otherwise(0)
        return F.struct(page.alias("page"), F.when(turn, h.cast("double")).otherwise(a["filled"] + h).alias("filled"), F.when(turn, F.lit(1)).otherwise(a["rows"] + 1).alias("rows"), F.concat(a["pages"], F.array(page)).alias("pages"))

    return F.aggregate(heights, start, step, lambda a: a["pages"])


def align_block_text(segments: Column, text: Column) -> Column:
    """Texts of a block's segments, an array in their order.

    One segment takes all; as many sentences as segments go one to each; else words go by
    the share of duration, at least one each while there are any, the last taking the rest.
    A block without duration has shares of 0.
    """
    whole = trim_space(F.coalesce(text, F.lit("")))
    n, said, w = F.size(segments), sentences(whole), words(whole)
    total = F.aggregate(segments, F.lit(0.0), lambda s, x: s + (x["end_sec"] - x["start_sec"]))
    shares = F.transform(segments, lambda s: F.coalesce(half_up(F.try_divide(F.size(w) * (s["end_sec"] - s["start_sec"]), total)), F.lit(0)).cast("int"))
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("i"), F.array().cast("array<string>").alias("texts"))

    def step(a: Column, share: Column) -> Column:
        left = F.size(w) - a["used"]
        take = F.when(a["i"] == n - 1, left).otherwise(F.greatest(F.least(F.lit(1), left), share))
        text = F.array_join(F.slice(w, a["used"] + 1, F.greatest(take, F.lit(0))), " ")
        return F.struct((a["used"] + F.greatest(take, F.lit(0))).alias("used"), (a["i"] + 1).alias("i"), F.concat(a["texts"], F.array(text)).alias("texts"))

    split = F.aggregate(shares, start, step, lambda a: a["texts"])
    return (
        F.when(n == 0, F.array().cast("array<string>"))
        .when(whole == "", F.transform(segments, lambda s: F.lit("")))
        .when(n == 1, F.array(whole))
        .when(F.size(said) == n, said)
        .otherwise(split)
    )


def cue_parts(timed: DataFrame, keys: list[str]) -> DataFrame:
    """Timed rows (keys, idx, start_sec, end_sec, text, speaker) cut into parts that fit a subtitle.

    The number of parts is the largest that size, reading speed or duration asks for; parts
    have equally many words and time in proportion to their characters, the last one ending
    with its row.
    """
    text = trim_space(F.coalesce(F.col("text"), F.lit("")))
    rows = timed.withColumn("text", text).where("text <> ''").withColumn("_dur", F.greatest(F.lit(0.0), F.col("end_sec") - F.col("start_sec")))
    size = F.length("text")
    n = F.greatest(F.lit(1), F.ceil(size / (MAX_CHARS_PER_LINE * MAX_LINES)), F.ceil(size / (READING_CHARS_PER_SEC * F.greatest("_dur", F.lit(0.1)))), F.ceil(F.col("_dur") / MAX_CUE_SEC)).cast("int")
    rows = rows.withColumn("_n", n).withColumn("_w", words(F.col("text")))
    each = F.ceil(F.size("_w") / F.col("_n")).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size("_w") / each).cast("int") - 1), lambda i: F.array_join(F.slice(F.col("_w"), i * each + 1, each), " "))
    rows = rows.withColumn("_parts", F.when(F.col("_n") == 1, F.array("text")).otherwise(cut))
    rows = rows.select(*keys, "idx", "start_sec", "end_sec", "speaker", "_dur", F.posexplode_outer("_parts").alias("part", "text"))  # there is always a part; outer keeps a filter on the parts' number from being inferred, which would cut the text anew for each part
    order = W.partitionBy(*keys, "idx").orderBy("part")
    chars = F.length("text").cast("double")
    total = F.sum(chars).over(W.partitionBy(*keys, "idx"))
    before = F.coalesce(F.sum(chars).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    start = F.col("start_sec") + F.col("_dur") * before / total
    last = F.lead("part").over(order).isNull()
    end = F.when(last, F.col("end_sec")).otherwise(F.col("start_sec") + F.col("_dur") * (before + chars) / total)
    return rows.select(*keys, "idx", "part", start.alias("start_sec"), end.alias("end_sec"), "text", "speaker")


def to_cues(timed: DataFrame, keys: list[str], min_sec: float = MIN_CUE_SEC, width: int = MAX_CHARS_PER_LINE, most_lines: int = MAX_LINES) -> DataFrame:
    """(keys, cue, start_sec, end_sec, lines, speaker, dropped_words).

    Short cues are stretched up to the next start.  Lines beyond ``most_lines`` are cut off,
    which ``dropped_words`` counts.
    """
    parts = cue_parts(timed, keys)
    order = W.partitionBy(*keys).orderBy("idx", "part")
    short = F.col("end_sec") - F.col("start_sec") < min_sec
    longer = F.least(F.col("start_sec") + min_sec, F.coalesce(F.lead("start_sec").over(order), F.lit(float("inf"))))
    rows = parts.select(*keys, F.row_number().over(order).alias("cue"), "start_sec", F.when(short, longer).otherwise(F.col("end_sec")).alias("end_sec"), wrap(F.col("text"), width).alias("_l"), "speaker")
    kept = F.slice("_l", 1, most_lines)
    lost = F.slice("_l", most_lines + 1, F.greatest(F.size("_l"), F.lit(1)))
    return rows.select(*keys, "cue", "start_sec", "end_sec", kept.alias("lines"), "speaker", F.aggregate(lost, F.lit(0), lambda n, s: n + F.size(words(s))).alias("dropped_words"))


def shown_speaker(timed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with text, and ``shown``: the speaker where it differs from the row before; a null resets."""
    rows = timed.withColumn("text", trim_space(F.coalesce(F.col("text"), F.lit("")))).where("text <> ''")
    before = F.lag("speaker").over(W.partitionBy(*keys).orderBy("idx"))
    return rows.withColumn("shown", F.when(F.col("speaker").isNotNull() & (F.col("speaker") != "") & ~F.col("speaker").eqNullSafe(before), F.col("speaker")))


def appearance(timed: DataFrame, keys: list[str], slots: int = 5) -> DataFrame:
    """Speakers in order of first appearance (from 0), with a colour slot."""
    first = timed.where("speaker is not null").groupBy(*keys, "speaker").agg(F.min("idx").alias("first_idx"))
    place = F.row_number().over(W.partitionBy(*keys).orderBy("first_idx")) - 1
    return first.withColumn("place", place).withColumn("slot", F.pmod("place", F.lit(slots)))


def document_rows(timed: DataFrame, keys: list[str]) -> DataFrame:
    """The row model of documents: HH:MM:SS, text, and the speaker on change."""
    rows = shown_speaker(timed, keys)
    return rows.select(*keys, "idx", F.substring(format_time(F.col("start_sec"), "."), 1, 8).alias("time"), "text", F.col("shown").alias("speaker"))
