"""Text functions: Column to Column, JVM-side but for number words."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from voxframe.constants import CONTRACTIONS, FORBIDDEN_IN_NAMES, HUNDRED_WORDS, HUNDREDS, JOINERS, LANGUAGE_PAIRS, PDF_SUBSTITUTES, THOUSAND_WORDS, UNITS, WESTERN

#: Unicode white space, as trimming and splitting see it.
SPACE = r"[\s\u000b\u0085   -     　﻿]"


def trim_space(col: Column) -> Column:
    return F.regexp_replace(col, rf"^{SPACE}+|{SPACE}+$", "")


def collapse_space(col: Column) -> Column:
    return trim_space(F.regexp_replace(col, rf"{SPACE}+", " "))


def words(col: Column) -> Column:
    """Words by white space; no words for null or blank."""
    return F.filter(F.split(collapse_space(F.coalesce(col, F.lit(""))), " "), lambda w: w != "")


def word_count(col: Column) -> Column:
    """How many ``words`` there are, in one pass; plain characters are told first."""
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(rf"[!-~[^{SPACE[1:-1]}]]+"))


def _bare_letters() -> tuple[str, str]:
    """Single characters whose decomposition is a base and marks U+0300 to U+036F, and the bases; not ñ."""
    have, give = [], []
    for code in range(0xC0, 0x10000):
        c = chr(code)
        if 0xAC00 <= code < 0xD800 or 0xD800 <= code < 0xE000:  # syllables have no marks; surrogates are no characters
            continue
        full = unicodedata.normalize("NFD", c)
        if c in "ñÑ" or len(full) < 2 or not all("̀" <= m <= "ͯ" for m in full[1:]):
            continue
        have.append(c)
        give.append(full[0])
    return "".join(have), "".join(give)


_MARKED, _BARE = _bare_letters()


def strip_diacritics(col: Column) -> Column:
    """Letters without their marks; ñ is a letter of its own."""
    return F.regexp_replace(F.translate(col, _MARKED, _BARE), "[̀-ͯ]", "")


def _once(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _literal_of(pattern: str) -> str:
    """The letters that a contraction's pattern needs: its longest plain run around the apostrophe."""
    at = pattern.index("'")
    low = high = at
    while low and (pattern[low - 1].isalpha()):
        low -= 1
    while high + 1 < len(pattern) and pattern[high + 1].isalpha():
        high += 1
    return pattern[low : high + 1]


def expand_contractions(col: Column) -> Column:
    """Each pattern in order, looked for only where its letters stand."""

    def gated(pattern: str, full: str):
        return lambda c: F.when(F.contains(c, F.lit(_literal_of(pattern))), F.regexp_replace(c, pattern, full)).otherwise(c)

    for pattern, full in CONTRACTIONS:
        col = _once(col, gated(pattern, full))
    return col


#: Characters that come to stand for a space, and all others that rules 1 to 5 drop; what texts mostly hold is told first.
_BETWEEN = f"[{SPACE[1:-1]}\\-–—/_]"
_DROPPED = rf"[^a-z\x20-\x20\p{{L}}\p{{N}}{_BETWEEN[1:-1]}]+"


def normalize_base(text: Column, lang: Column) -> Column:
    """Rules 1 to 5: lower case, contractions (en), punctuation, diacritics, white space.

    Each pass over a text costs, so dashes and white space are collapsed together, a lone space
    is passed over, and letters are made bare only where one is not ASCII.  Marks of their own
    are gone with the punctuation.
    """
    low = _once(F.lower(F.coalesce(text, F.lit(""))), lambda c: F.when((lang == "en") & F.contains(c, F.lit("'")), expand_contractions(c)).otherwise(c))
    kept = F.regexp_replace(low, _DROPPED, "")
    bare = _once(kept, lambda c: F.when(F.octet_length(c) == F.length(c), c).otherwise(F.translate(c, _MARKED, _BARE)))
    return F.trim(F.regexp_replace(bare, rf"(?:\x20(?={_BETWEEN})|[{_BETWEEN}&&[^\x20]]){_BETWEEN}*", " "))


_NUMERIC = {**UNITS, **HUNDREDS, **dict.fromkeys((*HUNDRED_WORDS, *THOUSAND_WORDS), -1)}


def digits(tokens: list[str]) -> list[str]:
    """Runs of number words as one number each.

    A joiner links tens and a unit (in a larger number as well), or whole hundreds and a
    rest; elsewhere it ends the run.  Adjacent numbers add up.
    """
    out: list[str] = []
    done = 0  # tokens that are in ``out``
    for start in [i for i, token in enumerate(tokens) if token in _NUMERIC]:
        if start < done:
            continue
        out += tokens[done:start]
        total = rest = 0
        done = start
        while done < len(tokens):
            token = tokens[done]
            if token in JOINERS:
                after = tokens[done + 1] if done + 1 < len(tokens) else None
                tens = rest % 100
                links = tens in range(30, 91, 10) and UNITS.get(after, 0) in range(1, 10)
                if not links and not (rest >= 100 and tens == 0 and after in _NUMERIC):
                    break
            elif token not in _NUMERIC:
                break
            elif token in THOUSAND_WORDS:
                total, rest = total + (rest or 1) * 1000, 0
            elif token in HUNDRED_WORDS:
                rest = (rest or 1) * 100
            else:
                rest += _NUMERIC[token]
            done += 1
        out.append(str(total + rest))
    return out + tokens[done:]


def _in_digits(text: str | None) -> str | None:
    return None if text is None else " ".join(digits(text.split(" ")))


@F.pandas_udf(StringType())
def _digits(col: pd.Series) -> pd.Series:
    return col.map(_in_digits)


def normalize(text: Column, lang: Column) -> Column:
    """Rules 1 to 6.  Rules 1 to 5 stand once in the plan, as what the Python step reads."""
    return _digits(normalize_base(text, lang))


def normalized_words(text: Column, lang: Column) -> Column:
    return F.filter(F.split(normalize(text, lang), " "), lambda w: w != "")


def sentences(col: Column) -> Column:
    """Cut after a terminator where white space and an opener or a capital follow."""
    trimmed = trim_space(F.coalesce(col, F.lit("")))
    parts = F.split(trimmed, rf"(?<=[.!?…]){SPACE}+(?=[¿¡\"'(\p{{Lu}}])")
    return F.filter(F.transform(parts, trim_space), lambda s: s != "")


def escape_csv(col: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(col, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(F.regexp_like(col, F.lit('[",\r\n]')), quoted).otherwise(col)


def escape_markup(col: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        col = F.replace(col, F.lit(raw), F.lit(safe))
    return col


def safe_name(col: Column, fallback: str = "transcripcion") -> Column:
    """A file name without extension and forbidden characters, at most 80 long."""
    name = F.regexp_replace(F.coalesce(col, F.lit("")), r"\.[^.]+$", "")
    name = F.regexp_replace(F.regexp_replace(name, FORBIDDEN_IN_NAMES, "-"), rf"{SPACE}+", " ")
    name = F.regexp_replace(name, r"[-\s]*-[-\s]*", "-")
    name = F.regexp_replace(name, r"^[-\s]+|[-\s]+$", "")
    return F.coalesce(F.nullif(trim_space(F.substring(name, F.lit(1), F.lit(80))), F.lit("")), F.lit(fallback))


def pdf_safe(col: Column) -> Column:
    """What a Western single-byte font can draw: a few signs have equivalents, all else becomes '?'."""
    for sign, plain in PDF_SUBSTITUTES:
        col = F.regexp_replace(col, sign, plain)
    return F.regexp_replace(col, rf"[^\x20-\x7e\xa0-\xff{WESTERN}]", "?")


def ellipsis(col: Column, width: int) -> Column:
    """At most ``width`` characters, the last an ellipsis where text is cut."""
    return F.when(F.length(col) > width, F.concat(F.rtrim(F.substring(col, F.lit(1), F.lit(width - 1))), F.lit("…"))).otherwise(col)


def speaker_id(clip: Column, fallback: str = "x") -> Column:
    return F.coalesce(F.nullif(F.substring_index(clip, "_", 2), F.lit("")), F.lit(fallback))


def file_key(name: Column, size: Column, mtime: Column) -> Column:
    return F.concat_ws("|", name, size.cast("string"), mtime.cast("string"))


def run_key(model: Column, backend: Column, item: Column) -> Column:
    return F.concat_ws("|", model, backend, item)


def dtype_label(encoder: Column, decoder: Column) -> Column:
    return F.concat(F.lit("enc:"), encoder, F.lit("/dec:"), decoder)


def slug(col: Column) -> Column:
    return F.lower(F.regexp_replace(col, "(?i)[^a-z0-9]+", "-"))


def report_filename(label: Column, run_id: Column) -> Column:
    """A report's file name, with the device's label so that runs do not overwrite each other."""
    return F.concat(F.lit("resultados-"), F.coalesce(slug(label), F.lit("equipo")), F.lit("-"), run_id, F.lit(".md"))


def default_speaker_name(label: Column, template: str = "Hablante {}") -> Column:
    """A numeric label n becomes the template with n + 1, another stays; blank counts as 0."""
    head, tail = template.split("{}")
    number = F.when(F.trim(label) == "", F.lit(0.0)).otherwise(label.try_cast("double"))
    return F.when(number.isNotNull(), F.concat(F.lit(head), (number + 1).cast("long").cast("string"), F.lit(tail))).otherwise(label)


def sha256_hex(col: Column) -> Column:
    return F.sha2(col, 256)


def session_id() -> Column:
    """A new random identifier; not for tests."""
    return F.expr("uuid()")


def is_lang(col: Column, known: tuple[str, ...] = ("es", "en")) -> Column:
    return F.coalesce(col.isin(*known), F.lit(False))


def phrase(entries: dict[str, str], key: Column) -> Column:
    """Dictionary lookup; the key itself where an entry is missing."""
    table = F.create_map(*[F.lit(x) for pair in entries.items() for x in pair]) if entries else F.create_map().cast("map<string,string>")
    return F.coalesce(F.try_element_at(table, key), key)


def language_pair(source: Column, target: Column, pairs: tuple[str, ...] = LANGUAGE_PAIRS) -> Column:
    """The translation direction, null where source and target agree, the source is unknown or no pair fits."""
    key = F.concat_ws("-", source, target)
    return F.when(source.isNotNull() & (source != "") & (source != target) & key.isin(*pairs), key)


def is_video(mime: Column) -> Column:
    """Is the declared type a video's?  An unknown type is not."""
    return F.coalesce(F.startswith(mime, F.lit("video/")), F.lit(False))
