"""Time and number formatting, estimates and small arithmetic, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxframe.constants import ITEM_TIMEOUT_RTF, ITEM_TIMEOUT_SEC, LONG_FILE_SEC, QUOTA_TIGHT, RESERVE_BYTES, RESERVE_SHARE, RTF_GOOD, RTF_USABLE


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp's wall clock, in any session time zone."""
    i = f"(cast({ts} as timestamp_ntz) - timestamp_ntz'1970-01-01 00:00:00')"
    return F.expr(f"extract(DAYS FROM {i}) * 86400000000L + extract(HOURS FROM {i}) * 3600000000L + extract(MINUTES FROM {i}) * 60000000L + cast(extract(SECONDS FROM {i}) * 1000000 as bigint)")


def half_up(x: Column) -> Column:
    """Rounding to the next integer, halves up."""
    return F.floor(x + F.lit(0.5))


def _two(x: Column) -> Column:
    s = x.cast("string")
    return F.when(F.length(s) >= 2, s).otherwise(F.concat(F.lit("0"), s))


def format_time(sec: Column, separator: str = ",", strict: bool = False) -> Column:
    """HH:MM:SS and milliseconds; below 0 counts as 0.

    By default a rounded-up thousandth carries into seconds alone, so 59.9996 shows as
    :60; ``strict`` carries on into minutes and hours.
    """
    t = F.greatest(sec.cast("double"), F.lit(0.0))
    if strict:
        ms_all = half_up(t * 1000)
        whole, ms = F.floor(ms_all / 1000), F.pmod(ms_all, F.lit(1000))
        h, m, s = F.floor(whole / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60), F.pmod(whole, F.lit(60))
    else:
        raw = half_up((t - F.floor(t)) * 1000)
        over = raw == 1000
        ms = F.when(over, F.lit(0)).otherwise(raw)
        h, m = F.floor(t / 3600), F.floor(F.pmod(t, F.lit(3600.0)) / 60)
        s = F.floor(F.pmod(t, F.lit(60.0))) + F.when(over, F.lit(1)).otherwise(F.lit(0))
    return F.concat(_two(h), F.lit(":"), _two(m), F.lit(":"), _two(s), F.lit(separator), F.lpad(ms.cast("string"), 3, "0"))


def format_clock(sec: Column) -> Column:
    """h:mm:ss, or m:ss below an hour."""
    t = F.floor(F.greatest(sec.cast("double"), F.lit(0.0)))
    h, m, s = F.floor(t / 3600), F.floor(F.pmod(t, F.lit(3600)) / 60), F.pmod(t, F.lit(60))
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), _two(m), F.lit(":"), _two(s))).otherwise(F.concat(m.cast("string"), F.lit(":"), _two(s)))


def to_fixed(x: Column, places: int) -> Column:
    """Decimal text of the exact binary value; an exact half goes away from zero.

    The formatter rounds exact halves to even, and those are the odd multiples of
    1 / 2 ** (places + 1): they are rounded by arithmetic, which is exact for them.
    """
    v = F.abs(x.cast("double"))
    pattern = "0" + ("." + "0" * places if places else "")
    half = v * float(2 ** (places + 1))
    tie = (half < float(1 << 52)) & (F.floor(half) == half) & (F.pmod(F.floor(half), F.lit(2)) == 1)
    up = (F.floor(v * float(10**places) + 0.5) / float(10**places)).cast(f"decimal(38,{places})").cast("string")
    text = F.when(tie, up).otherwise(F.call_function("format_number", v, F.lit(pattern)))
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), text)


def fixed(x: Column, places: int) -> Column:
    """Decimal text as ``to_fixed``; infinite is ∞, null a dash."""
    return F.when(x.isNull() | F.isnan(x), F.lit("—")).when(F.abs(x) == float("inf"), F.lit("∞")).otherwise(to_fixed(x, places))


def percent(x: Column) -> Column:
    return F.when(x.isNull() | (F.abs(x) == float("inf")), fixed(x, 1)).otherwise(F.concat(fixed(x * 100, 1), F.lit(" %")))


def grouped(x: Column, places: int, lang: str = "es") -> Column:
    """``to_fixed`` with marks between thousands: 1.234,5 in Spanish, 1,234.5 in English."""
    text = to_fixed(x, places)
    thousands, point = {"es": (".", ","), "en": (",", ".")}[lang]
    whole = F.regexp_replace(F.substring_index(text, ".", 1), "(?<=[0-9])(?=([0-9]{3})+$)", thousands)
    return F.concat(whole, F.lit(point), F.substring_index(text, ".", -1)) if places else whole


def human_bytes(n: Column, lang: str = "es") -> Column:
    """B, KB, MB, GB by 1024: whole numbers below MB, one decimal from there on."""
    x = n.cast("double")
    return (
        F.when(x < 1024, F.concat(grouped(x, 0, lang), F.lit(" B")))
        .when(x < 1024**2, F.concat(grouped(x / 1024, 0, lang), F.lit(" KB")))
        .when(x < 1024**3, F.concat(grouped(x / 1024**2, 1, lang), F.lit(" MB")))
        .otherwise(F.concat(grouped(x / 1024**3, 1, lang), F.lit(" GB")))
    )


#: (singular, plural) of seconds, minutes and hours.
_UNITS = {"es": (("segundo", "segundos"), ("minuto", "minutos"), ("hora", "horas")), "en": (("second", "seconds"), ("minute", "minutes"), ("hour", "hours"))}


def _counted(n: Column, unit: int, lang: str) -> Column:
    one, many = _UNITS[lang][unit]
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, F.lit(one)).otherwise(F.lit(many)))


def human_duration(sec: Column, lang: str = "es") -> Column:
    """Whole seconds below a minute, then minutes and seconds, then hours and minutes; a rest of 0 is left out."""
    s = half_up(sec.cast("double"))
    m, rest = F.floor(s / 60), F.pmod(s, F.lit(60))
    h, minutes = F.floor(m / 60), F.pmod(m, F.lit(60))
    between = {"es": " y ", "en": " "}[lang]
    tail = lambda n, unit: F.when(n == 0, F.lit("")).otherwise(F.concat(F.lit(between), n.cast("string"), F.lit({"es": " ", "en": ""}[lang] + unit)))
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit(" " + _UNITS[lang][0][1])))
        .when(m < 60, F.concat(_counted(m, 1, lang), tail(rest, "s")))
        .otherwise(F.concat(_counted(h, 2, lang), tail(minutes, "min")))
    )


def human_range(low: Column, high: Column, lang: str = "es") -> Column:
    """Both ends in the unit of the upper one; ends that round alike give one number."""
    between, and_, about = {"es": ("entre ", " y ", "alrededor de "), "en": ("between ", " and ", "about ")}[lang]

    def said(a: Column, b: Column, unit: int, same: str) -> Column:
        return F.when(a == b, F.concat(F.lit(same), _counted(a, unit, lang))).otherwise(F.concat(F.lit(between), a.cast("string"), F.lit(and_), _counted(b, unit, lang)))

    def coarse(unit: int, size: int) -> Column:
        a = F.greatest(F.lit(1), half_up(low / size))
        return said(a, F.greatest(a, half_up(high / size)), unit, about)

    return F.when(high < 60, said(half_up(low), half_up(high), 0, "")).when(high < 3600, coarse(1, 60)).otherwise(coarse(2, 3600))


def estimate_bucket(sec: Column) -> Column:
    return F.when(sec < 45, F.lit("seconds")).when(sec < 90, F.lit("minute")).when(sec < 3600, F.lit("minutes")).otherwise(F.lit("hours"))


def describe_estimate(remaining_sec: Column, source: Column) -> Column:
    """The wait in plain words (Spanish); an estimate borrowed from a table says that it is approximate."""
    s = half_up(remaining_sec)
    h, m = F.floor(s / 3600), half_up(F.pmod(s, F.lit(3600)) / 60)
    text = (
        F.when(s < 45, F.lit("menos de un minuto"))
        .when(s < 90, F.lit("alrededor de un minuto"))
        .when(s < 3600, F.concat(F.lit("alrededor de "), half_up(s / 60).cast("string"), F.lit(" minutos")))
        .otherwise(F.concat(F.lit("alrededor de "), h.cast("string"), F.lit(" h"), F.when(m == 0, F.lit("")).otherwise(F.concat(F.lit(" "), m.cast("string"), F.lit(" min")))))
    )
    return F.when(source == "tabla", F.concat(text, F.lit(" (estimación aproximada)"))).otherwise(text)


def rough_estimate(audio_sec: Column, samples: Column) -> Column:
    """(seconds, low, high, single) of a file by a profile's measured rates: median, and 10th to 90th percentile."""
    from voxframe.functions.arrays import median_of, quantile_of

    single = F.size(samples) < 2
    at = lambda p: F.when(single, F.get(samples, F.lit(0))).otherwise(quantile_of(samples, p))
    return F.struct((audio_sec * median_of(samples)).alias("seconds"), (audio_sec * at(0.1)).alias("low"), (audio_sec * at(0.9)).alias("high"), single.alias("single"))


def shown_estimate(audio_sec: Column, learned: Column, samples: Column, lang: str = "es") -> Column:
    """(text, long_file): by the device's own rate if there is one, else by the table, as a range if it has one."""
    rough = rough_estimate(audio_sec, samples)
    text = F.when(learned.isNotNull(), human_duration(audio_sec * learned, lang)).when(rough["single"], human_duration(rough["seconds"], lang)).otherwise(human_range(rough["low"], rough["high"], lang))
    return F.struct(text.alias("text"), (audio_sec > LONG_FILE_SEC).alias("long_file"))


def remaining(audio_sec: Column, rtf: Column, elapsed: Column) -> Column:
    return F.greatest(F.lit(0.0), audio_sec * rtf - elapsed)


def progress_percent(done: Column, total: Column) -> Column:
    """At most 100; null where the total is unknown or not positive."""
    return F.when(total > 0, F.least(F.lit(100.0), F.try_divide(done * 100.0, total)))


def item_timeout(duration_sec: Column) -> Column:
    return F.greatest(F.lit(ITEM_TIMEOUT_SEC), duration_sec * ITEM_TIMEOUT_RTF)


def rtf_band(rtf: Column) -> Column:
    return F.when(rtf < RTF_GOOD, F.lit("good")).when(rtf <= RTF_USABLE, F.lit("usable")).otherwise(F.lit("slow"))


def fits_budget(used: Column, more: Column, quota: Column) -> Column:
    """Used, new and reserved bytes within the quota; an unknown quota fits."""
    return F.coalesce(used + more + F.greatest(F.lit(float(RESERVE_BYTES)), quota * RESERVE_SHARE) <= quota, F.lit(True))


def quota_tight(used: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(used, total) > QUOTA_TIGHT, F.lit(False))


def slowdown(base: Column, other: Column) -> Column:
    return F.when(base > 0, F.try_divide(other, base))
