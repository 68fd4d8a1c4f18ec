"""License scan by ordered signature rules, in DataFrame functions only.

A text becomes its words, lower-cased (A-Z) and joined by single spaces.  Texts
with none of a few stems are not scanned; for the others a keyword gates each
rule's pattern, and patterns that pass give intervals of characters.  A detection
is dropped if an interval of the same or a stronger priority contains it; of equal
intervals of one priority the first rule stays.  Intervals that merely overlap stay.

Containment is decided by running maxima over the detections in order of start
(ends descending), so a text with many detections takes time in proportion.

Cases: null and empty texts and texts without words have 0 words, no places, empty
labels and score 0; a null doc_id is kept; repeated rows count each; texts of any length
are scanned whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import STEMS, rules

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose places are counted, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
BASE_SCORE = 0.8
PRIORITIES = 4
_CHUNK = 256
_RULE = "struct<id:int,label:string,priority:int,confidence:double,pattern:string>"
_GROUPS = f"array<struct<keyword:string,rules:array<{_RULE}>>>"
_SPAN = "array<struct<start:int,end:int,priority:int,id:int,label:string,confidence:double>>"


def words_line(text: Column) -> Column:
    """' w1 w2 ... wn ' for n words, ' ' + ' ' for none.

    ``lower`` equals lower-casing A-Z for what follows: it turns no other letter into an
    ASCII one but these two, which are set aside first, and all else stays a word letter.
    """
    lower = F.lower(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ķ")), F.lit("İ"), F.lit("į")))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, SEPARATORS, " ")), F.lit(" "))


def _spaces(s: Column) -> Column:
    return F.octet_length(s) - F.octet_length(F.replace(s, F.lit(" "), F.lit("")))


def _contains(s: Column, literal) -> Column:
    return F.contains(s, F.lit(literal) if isinstance(literal, str) else literal)


def places(line: Column, phrase: str) -> tuple[Column, Column, Column]:
    """(count, first, last) of the phrase's places in a words line; places are word numbers."""
    spaced = f" {phrase} "
    here = _contains(line, spaced)
    before_last = F.length(line) - F.instr(F.reverse(line), spaced[::-1]) + 2 - len(spaced)
    return (
        F.when(here, F.regexp_count(line, F.lit(f" {phrase}(?= )"))).otherwise(0).cast("long"),
        F.when(here, (_spaces(F.substring(line, F.lit(1), F.instr(line, spaced))) - 1).cast("long")),
        F.when(here, (_spaces(F.substring(line, F.lit(1), before_last)) - 1).cast("long")),
    )


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: lambda bodies are computed anew for each element."""
    return F.transform(F.array(value), body)[0]


def _scan(values: Column, zero: Column, step) -> Column:
    """Running fold of an array of ints, in chunks so that appending stays cheap."""

    def chunked(whole: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.floor((F.size(whole) - 1) / _CHUNK).cast("int"), F.lit(0)))
        return F.transform(starts, lambda c: F.slice(whole, c * _CHUNK + 1, _CHUNK))

    none = F.array().cast("array<int>")

    def inner(total: Column, chunk: Column) -> Column:
        return F.aggregate(chunk, F.struct(total.alias("t"), none.alias("out")), lambda a, x: _let(step(a["t"], x), lambda t: F.struct(t.alias("t"), F.concat(a["out"], F.array(t)).alias("out"))))

    folded = F.aggregate(
        _let(values, chunked),
        F.struct(zero.alias("t"), F.array().cast("array<array<int>>").alias("out")),
        lambda a, chunk: _let(inner(a["t"], chunk), lambda r: F.struct(r["t"].alias("t"), F.concat(a["out"], F.array(r["out"])).alias("out"))),
    )
    return F.flatten(folded["out"])


def detect(line: Column) -> Column:
    """All detections of a words line as an array of spans, in order of rules."""
    groups: dict[str, list] = {}
    for r in rules():
        groups.setdefault(r["keyword"], []).append({k: r[k] for k in ("id", "label", "priority", "confidence", "pattern")})
    table = F.from_json(F.lit(json.dumps([{"keyword": k, "rules": v} for k, v in groups.items()])), _GROUPS)
    gated = F.flatten(F.transform(F.filter(table, lambda g: _contains(line, g["keyword"])), lambda g: g["rules"]))
    hit = F.filter(gated, lambda r: F.regexp_like(line, r["pattern"]))

    def spans(r: Column) -> Column:
        gaps = F.transform(F.split(line, r["pattern"]), lambda x: F.length(x))
        sizes = F.transform(F.regexp_extract_all(line, r["pattern"], F.lit(0)), lambda x: F.length(x))

        def placed(n: Column) -> Column:
            steps = F.zip_with(gaps, n, lambda g, m: g + F.coalesce(m, F.lit(0)))
            return F.filter(F.zip_with(_scan(steps, F.lit(0), lambda t, x: t + x), n, lambda e, m: F.struct((e - m).alias("start"), e.alias("end"), r["priority"].alias("priority"), r["id"].alias("id"), r["label"].alias("label"), r["confidence"].alias("confidence"))), lambda d: d["start"].isNotNull())

        return _let(sizes, placed)

    return F.flatten(F.transform(hit, spans)).cast(_SPAN)


def suppress(found: Column) -> Column:
    """Detections that no interval of the same or a stronger priority contains."""
    fields = ("priority", "id", "label", "confidence")
    order = F.array_sort(F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("stop"), *[d[f].alias(f) for f in fields])))

    def top(ordered: Column, p: int) -> Column:
        """The largest end before each detection, of priorities up to p."""
        return F.concat(F.array(F.lit(-1)), _scan(F.transform(ordered, lambda d: F.when(d["priority"] <= p, -d["stop"]).otherwise(-1)), F.lit(-1), lambda t, x: F.greatest(t, x)))

    def marked(ordered: Column) -> Column:
        rows = F.transform(ordered, lambda d: F.struct(d.alias("d"), F.lit(-1).alias("top")))
        for p in range(1, PRIORITIES + 1):
            rows = _pick(rows, top(ordered, p), p)
        return rows

    kept = F.filter(_let(order, marked), lambda r: r["top"] < -r["d"]["stop"])
    return F.transform(kept, lambda r: F.struct(r["d"]["start"].alias("start"), (-r["d"]["stop"]).alias("end"), *[r["d"][f].alias(f) for f in fields])).cast(_SPAN)


def _pick(rows: Column, tops: Column, p: int) -> Column:
    """Rows with the running maximum of their own priority; ``tops`` is one longer than rows."""
    both = F.zip_with(rows, tops, lambda r, t: F.struct(r["d"].alias("d"), F.when(r["d"]["priority"] == p, t).otherwise(r["top"]).alias("top")))
    return F.filter(both, lambda r: r["d"].isNotNull())


def scan(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, n_words, n_base, first_word, last_word, base_labels, labels, score, detections (kept spans)."""
    line = F.col("_line")
    rows = docs.select(*keys, words_line(F.col(text).cast("string")).alias("_line"))
    some = reduce(Column.__or__, (_contains(line, s) for s in STEMS))
    empty = F.array().cast(_SPAN)
    rows = rows.withColumn("_found", F.when(some, detect(line)).otherwise(empty))
    rows = rows.withColumn("detections", F.when(F.size("_found") > 0, suppress(F.col("_found"))).otherwise(empty))
    at = [places(line, phrase) for phrase, _ in BASE]
    base = F.array_compact(F.array(*[F.when(_contains(line, f" {phrase} "), F.lit(label)) for phrase, label in BASE]))
    least = (lambda *c: F.least(*c)) if len(at) > 1 else (lambda c: c)
    most = (lambda *c: F.greatest(*c)) if len(at) > 1 else (lambda c: c)
    rows = rows.select(
        *keys,
        F.when(line == "  ", F.lit(0)).otherwise(_spaces(line) - 1).cast("long").alias("n_words"),
        reduce(Column.__add__, (n for n, _, _ in at)).alias("n_base"),
        least(*(x for _, x, _ in at)).alias("first_word"),
        most(*(x for _, _, x in at)).alias("last_word"),
        base.alias("_base"),
        "detections",
    )
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    score = F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)), F.when(F.size("_base") > 0, F.lit(BASE_SCORE)).otherwise(F.lit(0.0)))
    return rows.select(*keys, "n_words", "n_base", "first_word", "last_word", joined(F.col("_base")).alias("base_labels"), joined(F.concat("_base", F.transform("detections", lambda d: d["label"]))).alias("labels"), score.alias("score"), "detections")
