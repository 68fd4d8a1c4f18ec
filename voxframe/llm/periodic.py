"""Runs of words that repeat with a period, found whole and collapsed to one period.

A run is a stretch of words with smallest period q and length >= max(MIN_WORDS, TIMES * q)
that no neighbouring word extends.  Its words and themselves q words further on agree in
at least MIN_WORDS - q or (TIMES - 1) * q places, never fewer than ``overlap()``; so every
word of a run lies in a k-gram of that length which occurs again in the document.  Words
outside such k-grams are masked by a hash of all k-grams, which can only let too many
through, and what survives is cut into segments, each holding its runs whole.

Main and Lorentz: a run inside a range either crosses its middle or lies in a half.  One
that crosses is found from how far the words beside the middle agree, forwards and
backwards, with those q places away.  All ranges of a level and all their q are taken at
once; agreement comes from numbered substrings of lengths 1, 2, 4, ..., which are exact.
Of the periods that a stretch has, the least is its period.

Documents are independent, so nothing is shuffled.

Cases: null and empty texts and texts of white space have no words and no runs; a null
doc_id is kept, and where a caller changes words by doc_id is unchanged; repeated rows give
a row each; ties between runs go to the smallest start, then the smallest period; texts of
any length are taken whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from .common import bounded_batches, ids_of, keyed_texts, longs, tidy

#: A run's least words and least repetitions.
MIN_WORDS, TIMES = 24, 3
#: Words whose surviving segments are searched together; a longer text is searched by itself.
CHUNK = 1 << 19
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: White space of str.split() besides these six.
_OTHER = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    return _WORD.findall(text) if _OTHER.search(text) else text.split()


def overlap(min_words: int = MIN_WORDS, times: int = TIMES) -> int:
    """Places in which any run agrees with itself a period further on, at the least."""
    turn = min_words // times  # up to here min_words decides, then the repetitions
    return max(1, min([min_words - q for q in range(1, turn + 1)] + [(times - 1) * (turn + 1)]))


def _grams(hashes, k: int):
    """A hash of each k-gram; equal k-grams have equal hashes."""
    import numpy as np

    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    out, width = mixed, 1
    parts = []  # grams of 1, 2, 4, ... words
    while width * 2 <= k:
        parts.append((out, width))
        out = out[:-width] * np.uint64(0xD6E8FEB86659FD93) + out[width:]
        out ^= out >> np.uint64(29)
        width *= 2
    at = width
    while at < k:  # the last words, overlapping what is there
        out = out[: len(out) - (min(width, k - at))] * np.uint64(0xC2B2AE3D27D4EB4F) + out[min(width, k - at) :]
        at += min(width, k - at)
    return out


def masked(hashes, lengths, k: int):
    """Which words lie in a k-gram that occurs twice in their document; documents stand one after the other."""
    import numpy as np

    n = len(hashes)
    out = np.zeros(n, bool)
    if n < k:
        return out
    grams = _grams(hashes, k)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    inside = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
    keys = grams[inside] ^ (doc[inside].astype("uint64") * np.uint64(0xA0761D6478BD642F))
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(inside), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, "int32")
    at = inside[twice]
    edge[at] += 1
    edge[at + k] -= 1
    return np.cumsum(edge[:-1]) > 0


class _Names:
    """Numbers of the substrings of lengths 1, 2, 4, ... of a sequence: equal numbers, equal substrings."""

    def __init__(self, words, longest: int):
        import numpy as np

        self.n = len(words)
        self.levels = [np.unique(words, return_inverse=True)[1].astype("int32")]
        width = 1
        while width * 2 <= longest:
            last = self.levels[-1]
            pairs = last[:-width].astype("int64") * (int(last.max()) + 1) + last[width:]
            self.levels.append(np.unique(pairs, return_inverse=True)[1].astype("int32"))
            width *= 2

    def forwards(self, a, b):
        """How many words agree from places ``a`` and ``b`` on."""
        import numpy as np

        done = np.zeros(len(a), "int64")
        for j in reversed(range(len(self.levels))):
            names, width = self.levels[j], 1 << j
            while True:  # more than once only at the highest level
                x, y = a + done, b + done
                ok = (x < len(names)) & (y < len(names))
                ok[ok] = names[x[ok]] == names[y[ok]]
                done[ok] += width
                if j + 1 < len(self.levels) or not ok.any():
                    break
        return done

    def backwards(self, a, b):
        """How many words agree before places ``a`` and ``b``."""
        import numpy as np

        done = np.zeros(len(a), "int64")
        for j in reversed(range(len(self.levels))):
            names, width = self.levels[j], 1 << j
            while True:
                x, y = a - done - width, b - done - width
                ok = (x >= 0) & (y >= 0)
                ok[ok] = names[x[ok]] == names[y[ok]]
                done[ok] += width
                if j + 1 < len(self.levels) or not ok.any():
                    break
        return done


def _ranges(starts, lengths):
    """The numbers of all ranges [start, start + length), one after the other, and whose they are."""
    import numpy as np

    own = np.repeat(np.arange(len(starts)), lengths)
    before = np.cumsum(lengths) - lengths
    return starts[own] + np.arange(len(own)) - before[own], own


def repetitions(words, bounds, min_words: int = MIN_WORDS, times: int = TIMES):
    """All runs (start, end, period) of segments [a, b) of numbered words; ``words`` differ beyond each segment's end."""
    import numpy as np

    empty = np.zeros((0, 3), "int64")
    lo, hi = bounds[:, 0], bounds[:, 1]
    keep = hi - lo >= min_words
    lo, hi = lo[keep], hi[keep]
    if not len(lo):
        return empty
    names = _Names(words, int((hi - lo).max()))
    # of at least 2h agreeing words around the middle, h stand on one side of it
    half = max(1, overlap(min_words, times) // 2)
    level = half.bit_length() - 1
    short, h = names.levels[min(level, len(names.levels) - 1)], 1 << min(level, len(names.levels) - 1)

    def same(x, y):
        ok = (x >= 0) & (y >= 0) & (x < len(short)) & (y < len(short))
        ok[ok] = short[x[ok]] == short[y[ok]]
        return ok

    found = []
    while len(lo):
        mid = (lo + hi) // 2
        most = (hi - lo) // times
        q, own = _ranges(np.ones(len(lo), "int64"), most)
        m = mid[own]
        for x in (m, m - q):  # the words from x on against those q further on
            ok = (x >= lo[own]) & (x + q <= hi[own])
            ok &= same(x, x + q) | same(x - h, x + q - h)
            a, p = x[ok], q[ok]
            if len(a):
                start, end = a - names.backwards(a, a + p), a + p + names.forwards(a, a + p)
                long = end - start >= np.maximum(min_words, times * p)
                found.append(np.unique(np.stack([start[long], end[long], p[long]], 1), axis=0))
        lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])
        keep = hi - lo >= min_words
        lo, hi = lo[keep], hi[keep]
    if not found:
        return empty
    runs = np.unique(np.concatenate(found), axis=0)
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[first]


def runs_of(docs: list[list[str]], min_words: int = MIN_WORDS, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each document's words, by start and period."""
    import numpy as np

    out: list[list] = [[] for _ in docs]
    lengths = np.array([len(w) for w in docs], "int64")
    total = int(lengths.sum())
    hashes = np.fromiter((hash(w) for words in docs for w in words), "int64", total).view("uint64")
    live = np.concatenate([[False], masked(hashes, lengths, overlap(min_words, times)), [False]])
    offset = np.cumsum(lengths) - lengths
    # neighbouring documents' segments are kept apart
    edges = np.union1d(np.flatnonzero(live[1:] != live[:-1]), offset[1:] if len(docs) > 1 else [])
    edges = edges[edges <= total].astype("int64")
    cut = np.unique(np.concatenate([edges, [0, total]]))
    a, b = cut[:-1], cut[1:]
    keep = (b - a >= min_words) & live[1:][np.minimum(a, max(total - 1, 0))] if total else np.zeros(0, bool)
    a, b = a[keep], b[keep]
    doc_of = np.searchsorted(offset, a, "right") - 1
    i = 0
    while i < len(a):
        j, size = i, 0
        while j < len(a) and (j == i or size + b[j] - a[j] <= CHUNK):
            size += int(b[j] - a[j])
            j += 1
        number: dict[str, int] = {}
        seq, bounds = [], []
        for s, e, d in zip(a[i:j].tolist(), b[i:j].tolist(), doc_of[i:j].tolist(), strict=True):
            bounds.append((len(seq), len(seq) + e - s))
            o = int(offset[d])
            seq += [number.setdefault(w, len(number)) for w in docs[d][s - o : e - o]]
            seq.append(-len(bounds))
        at = np.array(bounds, "int64")
        for start, end, period in repetitions(np.array(seq, "int64"), at, min_words, times).tolist():
            k = i + int(np.searchsorted(at[:, 0], start, "right")) - 1
            d = int(doc_of[k])
            out[d].append((int(a[k] - offset[d]) + start - int(at[k - i, 0]), end - start, period))
        i = j
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def best_of(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, exactly; ties go to the smallest start, then period."""
    best = None
    for run in runs:  # by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words without those that stand in a run after its first period."""
    out, at = [], 0
    for start, length, period in sorted((s + q, n - q, q) for s, n, q in runs):
        if start + length > at:
            out += words[at : max(at, start)]
            at = max(at, start + length)
    return out + words[at:]


def periodic_runs(docs: DataFrame, change: Callable[[int, list[str]], list[str]] | None = None, min_words: int = MIN_WORDS, times: int = TIMES) -> DataFrame:
    """Each document's runs and collapsed text as digests; see SCHEMA.

    ``change`` may give other words for a document with a doc_id before its runs are sought.
    """
    bounded_batches(docs.sparkSession)

    def step(batches):
        import pandas as pd

        for pdf in batches:
            ids = ids_of(pdf)
            texts = [words_of(t) for t in pdf["text"]]
            if change:
                texts = [w if d is None else change(d, w) for d, w in zip(ids, texts, strict=True)]
            rows = []
            for doc, words, runs in zip(ids, texts, runs_of(texts, min_words, times), strict=True):
                best = best_of(runs)
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                kept = " ".join(collapsed(words, runs))
                rows.append((doc, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            for i, c in enumerate(("doc_id", "n_runs", "start", "length", "period", "exponent_milli")):
                out[c] = longs([row[i] for row in rows])
            yield out

    return keyed_texts(docs).mapInPandas(tidy(step), SCHEMA)
