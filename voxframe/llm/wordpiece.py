"""Greedy longest-match piece counts by a linear automaton.

The vocabulary's trie carries, for each node, a failure link and the number of
pieces that are popped on the way: when no child fits, the count grows by the
node's popped pieces and matching goes on at the link.  A word is read once, byte
by byte, and no piece is ever built.  A word that cannot be cut into pieces
counts as one unknown piece.  Counts of frequent words are kept in a bounded cache.

Words are maximal runs without Unicode white space; each is matched with the
vocabulary's word-start mark before it.  Null and empty texts have 0 words and 0
pieces; a null doc_id is kept; repeated rows count each; extra columns are ignored; an empty table gives
no rows; a word of any length takes time linear in it.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame

from .common import bounded_batches, claim, ids_of, keyed_texts, longs, tidy
from .tokens import CACHE_BYTES, _byte_letters, _Pieces


class Automaton:
    def __init__(self, pieces):
        child: list[dict[int, int]] = [{}]
        token = [False]
        for piece in pieces:
            at = 0
            for b in piece:
                nxt = child[at].get(b)
                if nxt is None:
                    nxt = child[at][b] = len(child)
                    child.append({})
                    token.append(False)
                at = nxt
            if at:
                token[at] = True
        fail: list[int] = [-1] * len(child)
        pops = [0] * len(child)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for b, v in child[u].items():
                queue.append(v)
                if token[v]:
                    fail[v], pops[v] = 0, 1
                    continue
                z, n = fail[u], pops[u]
                while z >= 0 and b not in child[z]:
                    n += pops[z]
                    z = fail[z]
                if z >= 0:
                    fail[v], pops[v] = child[z][b], n
        self.child, self.fail, self.pops = child, fail, pops

    def count(self, word: bytes) -> int:
        child, fail, pops = self.child, self.fail, self.pops
        u = n = 0
        for b in word:
            while (v := child[u].get(b)) is None:
                if fail[u] < 0:
                    return 1
                n += pops[u]
                u = fail[u]
            u = v
        while u:
            if fail[u] < 0:
                return 1
            n += pops[u]
            u = fail[u]
        return n


def byte_pieces(path: str) -> list[bytes]:
    """The pieces of a byte-level vocabulary file as bytes; a leading space marks a word's start."""
    import json

    with open(path) as f:
        model = json.load(f)["model"]
    back = {c: b for b, c in enumerate(_byte_letters())}
    return [bytes(back[c] for c in piece) for piece in model["vocab"] if all(c in back for c in piece)]


_open: dict[str, _Pieces] = {}


def counter(path: str) -> _Pieces:
    claim("pieces", _open.clear)
    if path not in _open:
        automaton = Automaton(byte_pieces(path))
        _open[path] = _Pieces(lambda w: automaton.count(b" " + w.encode("utf-8", "surrogatepass")), CACHE_BYTES)
    return _open[path]


def _count(path: str):
    def count(batches):
        import pandas as pd

        counts = counter(path).__getitem__
        for pdf in batches:
            words = [(x or "").split() for x in pdf["text"]]
            yield pd.DataFrame({"doc_id": longs(ids_of(pdf)), "n_words": [len(w) for w in words], "n_pieces": [sum(map(counts, w)) for w in words]})

    return count


def count_pieces(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_words, n_pieces) for the vocabulary file at the path ``vocabulary``."""
    bounded_batches(docs.sparkSession)
    return keyed_texts(docs).mapInPandas(tidy(_count(vocabulary)), "doc_id long, n_words long, n_pieces long")
