"""Word error rate, diarization error rate, coverage and label gaps."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.constants import COVERAGE_SPEECH_SEC, FRAMES_PER_SEC, MAX_LABELS, MIN_WORDS_PER_SPEECH_SEC
from voxframe.session import plain_unions

WER = T.StructType([T.StructField("wer", T.DoubleType()), *[T.StructField(n, T.IntegerType()) for n in ("sub", "del", "ins", "ref_words", "hyp_words")]])


#: Cells of one diagonal that pairs are compared in together.
CELLS = 1 << 16
#: Cells of a table beyond which a pair is compared in a band.
BAND_CELLS = 1 << 22


def edit_counts(ref: list[str], hyp: list[str]) -> tuple[int, int, int]:
    """(substitutions, deletions, insertions); ties take the diagonal, then deletion, then insertion."""
    return edit_counts_of([(ref, hyp)])[0]


def edit_counts_of(pairs: list[tuple[list[str], list[str]]]) -> list[tuple[int, int, int]]:
    """``edit_counts`` of many pairs: those of like length are compared together."""
    out: list = [None] * len(pairs)
    todo = []
    for k, (ref, hyp) in enumerate(pairs):
        if not ref or not hyp:
            out[k] = (0, len(ref), len(hyp))
        elif len(ref) * len(hyp) > BAND_CELLS:
            out[k] = _banded(ref, hyp)
        else:
            todo.append((len(ref), len(hyp), k))
    todo.sort()
    while todo:
        size, group = todo[-1][0] + 1, []  # from the longest down
        while todo and (len(group) + 1) * size <= max(CELLS, size) and (not group or todo[-1][0] * 2 >= size):
            group.append(todo.pop()[2])
        for k, counts in zip(group, _diagonals([pairs[k] for k in group]), strict=True):
            out[k] = counts
    return out


def _diagonals(pairs: list) -> list[tuple[int, int, int]]:
    """Counts of pairs of like length, padded to the longest.

    Cells of an anti-diagonal do not depend on each other, so each is one vector step for
    all pairs; a pair's result stands at its own last cell, which padding does not reach.
    A cell holds (cost, sub): at (i, j) deletions less insertions are i - j.
    """
    import numpy as np

    ns, ms = np.array([len(r) for r, _ in pairs]), np.array([len(h) for _, h in pairs])
    n, m, rows = int(ns.max()), int(ms.max()), len(pairs)
    a, b = np.full((rows, n), -1), np.full((rows, m), -2)
    for k, (ref, hyp) in enumerate(pairs):
        ids: dict[str, int] = {}
        a[k, : len(ref)] = [ids.setdefault(w, len(ids)) for w in ref]
        b[k, : len(hyp)] = [ids.setdefault(w, len(ids)) for w in hyp]
    b = b[:, ::-1]
    # by i: the two diagonals before, costs and substitutions
    shape = (rows, n + 1)
    cost2, sub2, cost1, sub1 = (np.zeros(shape, "int32") for _ in range(4))
    cost1[:, :2] = 1
    last, total, subs = ns + ms, np.zeros(rows, int), np.zeros(rows, int)
    for d in range(2, n + m + 1):
        cost, sub = np.zeros(shape, "int32"), np.zeros(shape, "int32")
        low, high = max(1, d - m), min(n, d - 1)
        if d <= m:
            cost[:, 0] = d
        if d <= n:
            cost[:, d] = d
        if low <= high:
            i = slice(low, high + 1)
            before = slice(low - 1, high)
            miss = (a[:, before] != b[:, m - d + low : m - d + high + 1]).astype("int32")
            diag, gone, more = cost2[:, before] + miss, cost1[:, before] + 1, cost1[:, i] + 1
            best = np.minimum(diag, np.minimum(gone, more))
            cost[:, i] = best
            sub[:, i] = np.where(diag == best, sub2[:, before] + miss, np.where(gone == best, sub1[:, before], sub1[:, i]))
        for k in np.flatnonzero(last == d):
            total[k], subs[k] = cost[k, ns[k]], sub[k, ns[k]]
        cost2, sub2, cost1, sub1 = cost1, sub1, cost, sub
    dels = (total - subs + ns - ms) // 2
    return [(int(s), int(x), int(t - s - x)) for s, x, t in zip(subs, dels, total, strict=True)]


def _banded(ref: list[str], hyp: list[str]) -> tuple[int, int, int]:
    """Counts of one long pair, in memory linear in the band and time in its width and the length.

    A pair of distance d or less has its whole path at most d off the diagonal, and no cell
    further off ties with one on it; so the band is doubled until the distance fits in it.
    Equal ends are on the path, as ties take the diagonal.
    """
    import numpy as np

    n, m = len(ref), len(hyp)
    while n and m and ref[n - 1] == hyp[m - 1]:
        n, m = n - 1, m - 1
    if not n or not m:
        return 0, n, m
    ids: dict[str, int] = {}
    a = np.array([ids.setdefault(w, len(ids)) for w in ref[:n]], "int32")
    b = np.array([ids.setdefault(w, len(ids)) for w in hyp[:m]], "int32")[::-1].copy()
    width = max(64, abs(n - m), max(n, m) // 64)
    while True:
        found = _band(a, b, n, m, width)
        if found is not None:
            total, subs = found
            dels = (total - subs + n - m) // 2
            return subs, dels, total - subs - dels
        width *= 2


def _band(a, b, n: int, m: int, width: int) -> tuple[int, int] | None:
    """(distance, substitutions) from the cells at most ``width`` off the diagonal; None if it may be larger.

    A cell is one number: cost, then the step's place among ties, then substitutions.
    """
    import numpy as np

    one, step, far = 1 << 34, 1 << 32, 1 << 60
    clear = ~(3 << 32)
    before2 = before1 = np.array([0], "int64")  # diagonals i + j = d - 2 and d - 1, by i
    low2, low1 = 0, 0
    for d in range(1, n + m + 1):
        low, high = max(0, d - m, (d - width + 1) // 2), min(n, d, (d + width) // 2)
        if low > high:
            return None
        now = np.full(high - low + 1, far, "int64")
        # a word of the reference left out: (i - 1, j)
        s, e = max(low, low1 + 1), min(high, low1 + len(before1))
        if s <= e:
            now[s - low : e - low + 1] = before1[s - 1 - low1 : e - low1] + (one + step)
        # a word of the hypothesis put in: (i, j - 1)
        s, e = max(low, low1), min(high, low1 + len(before1) - 1, d - 1)
        if s <= e:
            at = now[s - low : e - low + 1]
            np.minimum(at, before1[s - low1 : e + 1 - low1] + (one + 2 * step), out=at)
        # both: (i - 1, j - 1)
        s, e = max(low, low2 + 1, 1), min(high, low2 + len(before2), d - 1)
        if d > 1 and s <= e:
            at = now[s - low : e - low + 1]
            miss = a[s - 1 : e] != b[m - d + s : m - d + e + 1]
            np.minimum(at, before2[s - 1 - low2 : e - low2] + miss * (one + 1), out=at)
        now &= clear
        before2, low2, before1, low1 = before1, low1, now, low
    total, subs = int(before1[n - low1] >> 34), int(before1[n - low1] & (step - 1))
    return (total, subs) if total <= width else None


@F.pandas_udf(WER)
def word_errors(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """Edit distance of two word arrays with its breakdown; null arrays are empty."""
    words = lambda x: list(x) if x is not None else []
    pairs = [(words(r), words(h)) for r, h in zip(ref, hyp, strict=True)]
    out = []
    for (r, h), (s, d, i) in zip(pairs, edit_counts_of(pairs), strict=True):
        out.append(((s + d + i) / len(r) if r else (float("inf") if h else 0.0), s, d, i, len(r), len(h)))
    return pd.DataFrame(out, columns=["wer", "sub", "del", "ins", "ref_words", "hyp_words"])


def round_trips(rows: DataFrame, keys: list[str], original: str, there: str, back_wer: str) -> tuple[DataFrame, DataFrame]:
    """(summary, worst first) of translated sentences: mean rate of the way back, and how much longer they get."""
    ratio = F.length(there) / F.greatest(F.lit(1), F.length(original))
    rows = rows.withColumn("length_ratio", ratio)
    summary = rows.groupBy(*keys).agg(F.avg(back_wer).alias("mean_wer"), F.avg("length_ratio").alias("mean_ratio"), F.count("*").alias("n"))
    return summary, rows.orderBy(F.desc(F.coalesce(back_wer, F.lit(0.0))), original)


def micro_wer(rows: DataFrame, keys: list[str], col: str = "wer") -> DataFrame:
    """Counts added up, then divided: never a mean of rates."""
    sums = rows.groupBy(*keys).agg(*[F.sum(f"{col}.{n}").cast("long").alias(n) for n in ("sub", "del", "ins", "ref_words", "hyp_words")], F.count("*").alias("n"))
    return sums.withColumn("wer", error_rate(F.col("sub") + F.col("del") + F.col("ins"), F.col("ref_words")))


def error_rate(errors: Column, words: Column) -> Column:
    return F.when(words > 0, F.try_divide(errors, words)).when(errors > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))


def macro_wer(rows: DataFrame, keys: list[str], col: str = "wer") -> DataFrame:
    """Mean of the rates of sentences, for round trips."""
    return rows.groupBy(*keys).agg(F.avg(f"{col}.wer").alias("mean_wer"), F.max(f"{col}.wer").alias("worst_wer"), F.count("*").alias("n"))


def coverage(timed: DataFrame, keys: list[str], word_count: str = "n_words", speech: str = "speech_sec") -> DataFrame:
    """Words per speech second, empty segments, and whether an omission is likely."""
    sums = timed.groupBy(*keys).agg(F.sum(word_count).alias("total_words"), F.sum(speech).alias("speech_sec"), F.count_if(F.col(word_count) == 0).alias("empty_segments"))
    wps = F.when(F.col("speech_sec") > 0, F.try_divide("total_words", "speech_sec")).otherwise(F.lit(0.0))
    return sums.withColumn("words_per_speech_sec", wps).withColumn("suspicious", (F.col("speech_sec") > COVERAGE_SPEECH_SEC) & (F.col("words_per_speech_sec") < MIN_WORDS_PER_SPEECH_SEC))


# ---- diarization error ----


def _frames(turns: DataFrame, keys: list[str]) -> DataFrame:
    f = lambda c: F.floor(F.col(c).cast("double") * FRAMES_PER_SEC + 0.5).cast("long")
    return turns.select(*keys, "speaker", F.greatest(f("start_sec"), F.lit(0)).alias("a"), f("end_sec").alias("b")).where("a < b")


#: Labels that one word of a mask holds.
MASK_LABELS = 62
#: Turns of both sides that a task takes, about; those of one item stay together.
TASK_TURNS = 1 << 17


def _sides(reference: DataFrame, hypothesis: DataFrame, keys: list[str]) -> DataFrame:
    plain_unions(reference.sparkSession)
    return _frames(reference, keys).withColumn("_s", F.lit(0)).unionByName(_frames(hypothesis, keys).withColumn("_s", F.lit(1)))


def _masks(labels: int) -> list[str]:
    return [f"{s}_m{k}" for k in range(max(1, -(-labels // MASK_LABELS))) for s in "rh"]


def _der_points(reference: DataFrame, hypothesis: DataFrame, keys: list[str], collar_sec: float, labels: int) -> DataFrame:
    """(keys, f0, f1, n_ref, n_hyp, forgiven) and masks by a label's place among its side's sorted labels.

    All rows are numbers beside the keys, and only a turn's own two edges are made of it: names and an
    item's end for each edge would be most of what the sorts hold.
    """
    item, own = W.partitionBy(*keys), W.partitionBy(*keys, "_s").orderBy(F.asc_nulls_last("speaker"))
    # a given number: by the bytes of turns, before they grow to edges and points, Spark would make fewer and larger ones
    n = max(reference.sparkSession.sparkContext.defaultParallelism, -(-(reference.count() + hypothesis.count()) // TASK_TURNS))
    rows = _sides(reference, hypothesis, keys).repartition(n, *keys).withColumn("_end", F.max("b").over(item))
    rows = rows.withColumn("_i", F.when(F.col("speaker").isNull(), -1).otherwise(F.dense_rank().over(own) - 1)).withColumn("_first", F.row_number().over(own) == 1)
    # where each label begins and ends, its own overlapping turns being one
    edge = lambda f, d: F.struct(f.cast("long").alias("f"), F.lit(d).alias("d"))
    turn, ends = F.array(edge(F.col("a"), 1), edge(F.col("b"), -1)), F.array(edge(F.lit(0), 0), edge(F.col("_end"), 0))
    steps = rows.select(*keys, "_s", "_i", "_end", F.explode(F.when(F.col("_first"), F.concat(turn, ends)).otherwise(turn)).alias("_e")).groupBy(*keys, "_s", "_i", F.col("_e.f").alias("f"))
    steps = steps.agg(F.sum("_e.d").alias("d"), F.max("_end").alias("_end"))
    run = F.sum("d").over(W.partitionBy(*keys, "_s", "_i").orderBy("f"))
    steps = steps.withColumn("_run", run).withColumn("c", F.when((F.col("_run") > 0) & (F.col("_run") == F.col("d")), 1).when((F.col("_run") == 0) & (F.col("d") < 0), -1).otherwise(0))
    bit = F.expr(f"shiftleft(1L, _i % {MASK_LABELS})") * F.col("c")
    side = lambda m: F.sum(F.when((F.col("_s") == "rh".index(m[0])) & (F.col("_i") >= 0) & (F.floor(F.col("_i") / MASK_LABELS) == int(m[3:])), bit).otherwise(F.lit(0).cast("long"))).alias(m)
    count = lambda c, k: F.sum(F.when(F.col("_s") == k, F.col("c")).otherwise(0)).alias(c)
    masks = _masks(labels)
    sums = (*masks, "rc", "hc")
    points = steps.groupBy(*keys, "f").agg(*[side(m) for m in masks], count("rc", 0), count("hc", 1), F.max("_end").alias("_end"))
    radius = int(collar_sec * FRAMES_PER_SEC + 0.5)
    if radius > 0:
        at = lambda f, c, moved: F.struct(f.alias("f"), F.lit(c).alias("k"), *[(F.col(x) if moved else F.lit(0).cast("long")).alias(x) for x in sums])
        turned = [F.col(m) != 0 for m in masks if m[0] == "r"]
        changed = reduce(lambda x, y: x | y, turned) & (F.col("f") > 0) & (F.col("f") < F.col("_end"))
        around = F.array(at(F.greatest(F.col("f") - radius, F.lit(0).cast("long")), 1, False), at(F.least(F.col("f") + radius, F.col("_end")), -1, False))
        here = F.array(at(F.col("f"), 0, True))
        points = points.select(*keys, F.explode(F.when(changed, F.concat(here, around)).otherwise(here)).alias("_e")).groupBy(*keys, F.col("_e.f").alias("f"))
        points = points.agg(*[F.sum(f"_e.{x}").alias(x) for x in (*sums, "k")])
    else:
        points = points.withColumn("k", F.lit(0))
    order = item.orderBy("f")
    points = points.select(*keys, F.col("f").alias("f0"), F.lead("f").over(order).alias("f1"), *[F.sum(x).over(order).alias(x) for x in (*sums, "k")]).where("f1 is not null")
    return points.select(*keys, "f0", "f1", *masks, F.col("rc").alias("n_ref"), F.col("hc").alias("n_hyp"), (F.col("k") > 0).alias("forgiven"))


def der_parts(reference: DataFrame, hypothesis: DataFrame, keys: list[str], collar_sec: float = 0.0, labels: int = MASK_LABELS) -> DataFrame:
    """(keys, f0, f1, ref and hyp sets, n_ref, n_hyp) of an item's elementary intervals; those in the collar are ``forgiven``.

    One sweep over an item's boundaries: a label that begins or ends adds its bit to, or takes
    it from, a running mask of as many words as ``labels`` of a side need; the labels' names,
    a row an item, meet the intervals last.
    An item with more labels on a side has null for that side's sets; the numbers stay right.
    """
    points, masks = _der_points(reference, hypothesis, keys, collar_sec, labels), _masks(labels)
    name = lambda k: F.array_sort(F.collect_set(F.when(F.col("_s") == k, F.col("speaker"))))
    names = _sides(reference, hypothesis, keys).groupBy(*keys).agg(name(0).alias("_r"), name(1).alias("_h"))
    same = reduce(lambda x, y: x & y, [F.col(f"p.{k}").eqNullSafe(F.col(f"q.{k}")) for k in keys])
    points = points.alias("p").join(names.alias("q"), same).select("p.*", "_r", "_h")

    def held(side: str) -> Column:
        """The labels whose bits are set; null where there are more labels than ``labels``."""
        own = F.col(f"_{side}")
        word = [F.col(m) for m in masks if m[0] == side]
        mask = word[0] if len(word) == 1 else F.array(*word)
        bit = lambda i: F.getbit(mask if len(word) == 1 else F.get(mask, F.floor(i / MASK_LABELS).cast("int")), i % MASK_LABELS) == 1
        named = F.filter(F.transform(own, lambda n, i: F.when(bit(i), n)), lambda n: n.isNotNull())
        return F.when(F.size(own) <= len(word) * MASK_LABELS, named)

    return points.select(*keys, "f0", "f1", held("r").alias("ref"), held("h").alias("hyp"), "n_ref", "n_hyp", "forgiven")


def der_sums(reference: DataFrame, hypothesis: DataFrame, keys: list[str], collar_sec: float = 0.0) -> DataFrame:
    """``der_totals`` of turns, without the labels' names."""
    return der_totals(_der_points(reference, hypothesis, keys, collar_sec, MASK_LABELS), keys)


def der_totals(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Frame sums that no assignment of labels changes."""
    n, r, h = F.col("f1") - F.col("f0"), F.col("n_ref"), F.col("n_hyp")
    kept = ~F.col("forgiven")
    total = lambda x, c: F.sum(F.when(c, x * n).otherwise(0)).cast("long")
    return parts.groupBy(*keys).agg(
        total(r, kept).alias("ref_frames"),
        total(r, ~kept).alias("collar_frames"),
        total(F.greatest(r - h, F.lit(0)), kept).alias("missed_frames"),
        total(F.greatest(h - r, F.lit(0)), kept).alias("false_frames"),
        total(F.least(r, h), kept).alias("both_frames"),
    )


#: Labels of the smaller side up to which the assignment is found by subsets.
SUBSETS = 8


def best_assignment(weights: dict[tuple[str, str], int]) -> tuple[int, dict[str, str]]:
    """Largest total weight of one-to-one pairs (ref, hyp)."""
    refs, hyps = sorted({r for r, _ in weights}), sorted({h for _, h in weights})
    if len(hyps) > SUBSETS:
        return _augmenting(weights, refs, hyps)
    # by subsets of the hyp labels
    best: dict[int, tuple[int, tuple]] = {0: (0, ())}
    for r in refs:
        new = dict(best)
        for used, (total, pairs) in best.items():
            for j, h in enumerate(hyps):
                w = weights.get((r, h), 0)
                if w and not used >> j & 1 and total + w > new.get(used | 1 << j, (-1, ()))[0]:
                    new[used | 1 << j] = (total + w, (*pairs, (r, h)))
        best = new
    total, pairs = max(best.values(), key=lambda x: x[0])
    return total, dict(pairs)


def _augmenting(weights: dict[tuple[str, str], int], refs: list[str], hyps: list[str]) -> tuple[int, dict[str, str]]:
    """The same for any number of labels: each label in turn takes its shortest augmenting path.

    Potentials keep reduced costs at or above zero, in whole numbers, so the result is exact;
    time is cubic in the labels.  A pair of weight 0 is no pair.
    """
    import numpy as np

    rows, columns = (refs, hyps) if len(refs) <= len(hyps) else (hyps, refs)
    turned = rows is hyps
    place = {c: j for j, c in enumerate(columns)}
    at = {r: i for i, r in enumerate(rows)}
    cost = np.zeros((len(rows), len(columns) + 1), "int64")  # column 0 is where a path begins
    for (r, h), w in weights.items():
        i, j = (at[h], place[r]) if turned else (at[r], place[h])
        cost[i, j + 1] = -w
    far = np.iinfo("int64").max // 4
    u, v = np.zeros(len(rows), "int64"), np.zeros(len(columns) + 1, "int64")
    holder = np.full(len(columns) + 1, -1)
    for i in range(len(rows)):
        holder[0], column = i, 0
        least, came, seen = np.full(len(columns) + 1, far), np.zeros(len(columns) + 1, int), np.zeros(len(columns) + 1, bool)
        while holder[column] >= 0:
            seen[column] = True
            row = holder[column]
            reduced = cost[row] - u[row] - v
            nearer = ~seen & (reduced < least)
            least[nearer], came[nearer] = reduced[nearer], column
            open_ = np.where(seen, far, least)
            open_[0] = far
            column_next = int(open_.argmin())
            delta = least[column_next]
            u[holder[seen]] += delta
            v[seen] -= delta
            least[~seen] -= delta
            column = column_next
        while column:
            holder[column] = holder[came[column]]
            column = came[column]
        holder[0] = -1
    pairs = {}
    for j, i in enumerate(holder[1:].tolist()):
        if i >= 0 and cost[i, j + 1]:
            r, h = (columns[j], rows[i]) if turned else (rows[i], columns[j])
            pairs[r] = h
    return sum(weights[r, h] for r, h in pairs.items()), pairs


def der(reference: DataFrame, hypothesis: DataFrame, keys: list[str], collar_sec: float = 0.0, max_labels: int = MAX_LABELS) -> DataFrame:
    """der, missed_sec, false_sec, confusion_sec, ref_sec, collar_sec, mapping, measurable.

    Items with more labels on a side than ``max_labels`` are not measurable and get nulls.
    """
    parts = der_parts(reference, hypothesis, keys, collar_sec, max(max_labels, MASK_LABELS))  # beyond, nothing is measured
    totals = der_totals(_der_points(reference, hypothesis, keys, collar_sec, max(max_labels, MASK_LABELS)), keys)
    pairs = parts.where("not forgiven").select(*keys, F.explode("ref").alias("r"), "hyp", (F.col("f1") - F.col("f0")).alias("n")).select(*keys, "r", F.explode("hyp").alias("h"), "n")
    cooc = pairs.groupBy(*keys, "r", "h").agg(F.sum("n").alias("n"))
    named = reference.select(*keys, F.col("speaker").alias("r"), F.lit(None).cast("string").alias("h")).unionByName(hypothesis.select(*keys, F.lit(None).cast("string").alias("r"), F.col("speaker").alias("h")))
    sizes = named.groupBy(*keys).agg(F.count_distinct("r").alias("n_ref"), F.count_distinct("h").alias("n_hyp"))
    small = sizes.where((F.col("n_ref") <= max_labels) & (F.col("n_hyp") <= max_labels)).select(*keys)
    schema = cooc.select(*keys).schema

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        total, mapping = best_assignment({(r, h): int(n) for r, h, n in zip(pdf["r"], pdf["h"], pdf["n"], strict=True)})
        return pd.DataFrame([[*[pdf[k].iloc[0] for k in keys], total, mapping]], columns=[*keys, "correct", "mapping"])

    chosen = cooc.join(small, keys, "left_semi").groupBy(*keys).applyInPandas(assign, T.StructType([*schema.fields, T.StructField("correct", T.LongType()), T.StructField("mapping", T.MapType(T.StringType(), T.StringType()))]))
    out = totals.join(sizes, keys).join(chosen, keys, "left")
    ok = (F.col("n_ref") <= max_labels) & (F.col("n_hyp") <= max_labels)
    wrong = F.col("both_frames") - F.coalesce("correct", F.lit(0))
    sec = lambda c: F.when(ok, c / float(FRAMES_PER_SEC))
    out = out.select(*keys, ok.alias("measurable"), sec(F.col("missed_frames")).alias("missed_sec"), sec(F.col("false_frames")).alias("false_sec"), sec(wrong).alias("confusion_sec"), sec(F.col("ref_frames")).alias("ref_sec"), sec(F.col("collar_frames")).alias("collar_sec"), F.when(ok, F.coalesce("mapping", F.create_map().cast("map<string,string>"))).alias("mapping"))
    return out.withColumn("der", F.when(F.col("measurable"), error_rate(F.col("missed_sec") + F.col("false_sec") + F.col("confusion_sec"), F.col("ref_sec"))))


def der_single_label(reference: DataFrame, hypothesis: DataFrame, keys: list[str], collar_sec: float = 0.0) -> DataFrame:
    """The control: all speech of the hypothesis given to one label."""
    return der(reference, hypothesis.withColumn("speaker", F.lit("single")), keys, collar_sec)


def sweep_plateau(sweep: DataFrame, value: str = "der", threshold: str = "threshold", slack: float = 0.005) -> DataFrame:
    """Mean error of each threshold over all items (none if an item is unmeasurable), and the middle of the best plateau."""
    means = sweep.groupBy(threshold).agg(F.when(F.count(value) == F.count("*"), F.avg(value)).alias("mean"))
    best = means.agg(F.min("mean").alias("best"))
    near = means.crossJoin(F.broadcast(best)).where(F.col("mean") <= F.col("best") + slack)  # `best` is one row
    return near.agg(F.min("best").alias("best"), F.min(threshold).alias("low"), F.max(threshold).alias("high"), F.round((F.min(threshold) + F.max(threshold)) / 2, 3).alias("centre"))


def label_gap(vectors: DataFrame, keys: list[str], vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding") -> DataFrame:
    """Mean cosine within labels less that between, the least within and the largest between."""
    pairs = cosine_pairs(vectors, keys, vec_id, embedding, (label,))
    same = F.col("a_" + label) == F.col("b_" + label)
    c = F.col("cosine")
    out = pairs.groupBy(*keys).agg(F.avg(F.when(same, c)).alias("within"), F.avg(F.when(~same, c)).alias("between"), F.min(F.when(same, c)).alias("min_within"), F.max(F.when(~same, c)).alias("max_between"), F.count("*").alias("n_pairs"))
    return out.withColumn("gap", F.col("within") - F.col("between"))


def shuffled_labels(vectors: DataFrame, keys: list[str], vec_id: str = "vec_id", label: str = "label") -> DataFrame:
    """The control of ``label_gap``: each key's labels dealt anew, in an order drawn from the ids' digests."""
    by = W.partitionBy(*keys)
    ranked = vectors.withColumn("_i", F.row_number().over(by.orderBy(vec_id))).withColumn("_j", F.row_number().over(by.orderBy(F.md5(F.col(vec_id).cast("string")), vec_id)))
    dealt = ranked.select(*keys, F.col("_j").alias("_i"), F.col(label).alias("_l"))
    return ranked.drop("_j").join(dealt, [*keys, "_i"]).withColumn(label, F.col("_l")).drop("_i", "_l")


#: Vectors of a key that meet in one task.
BLOCK = 512


def cosine_pairs(vectors: DataFrame, keys: list[str], vec_id: str = "vec_id", embedding: str = "embedding", carry: tuple[str, ...] = ()) -> DataFrame:
    """Cosine of all pairs of one key's vectors; norms are computed once a vector, before the join.

    A key of many vectors is cut into blocks, and each pair of blocks is a group of its own,
    so that the pairs of a large key are made by many tasks.
    """
    from voxframe.functions.arrays import cosine_of, dot

    v = vectors.select(*keys, vec_id, *carry, F.col(embedding).cast("array<double>").alias("_v")).withColumn("_n", F.sqrt(dot(F.col("_v"), F.col("_v"))))
    v = v.withColumn("_k", F.ceil(F.count("*").over(W.partitionBy(*keys)) / BLOCK)).withColumn("_c", F.pmod(F.xxhash64(vec_id), F.col("_k")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1))

    def side(p: str, own: str, other: str) -> DataFrame:
        return v.select(*keys, F.col("_c").alias(own), every.alias(other), *[F.col(c).alias(f"{p}_{c}") for c in (vec_id, *carry)], F.col("_v").alias(f"{p}_v"), F.col("_n").alias(f"{p}_n"))

    met = side("a", "_i", "_j").join(side("b", "_j", "_i"), [*keys, "_i", "_j"]).where(F.col(f"a_{vec_id}") < F.col(f"b_{vec_id}"))
    return met.select(*keys, *[f"{p}_{c}" for p in "ab" for c in (vec_id, *carry)], cosine_of(dot(F.col("a_v"), F.col("b_v")), F.col("a_n"), F.col("b_n")).alias("cosine"))
