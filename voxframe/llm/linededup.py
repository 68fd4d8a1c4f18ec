"""Reversible line deduplication: sharded cuckoo filters over exact reference-count tables.

A line's key is the line without white space (space, tab to carriage return) at its
ends, A-Z lower-cased.  Keys of ``min_chars`` code points or more are counted by a
128-bit digest, once a document.  A key of ``min_docs`` documents or more loses all
its lines but those of the largest doc_id that holds it.

State is three tables in the shared folder: ``postings`` (hi, lo, doc_id), exact
``counts`` (hi, lo, refs, last_doc), and a cuckoo filter for each shard of digests,
which holds the digests that lose lines.  ``insert`` and ``delete`` change counts by
the documents given and put into, or take out of, the filters the digests that
cross the threshold; so deleting what was inserted gives the state from before.

Lines are routed by shard, at every size alike: the digests of a shard's lines meet its
filter first, and what passes is settled by the shard's exact counts, which came with
it.  Lines of a shard are dealt over several tasks by a salt of their document, each
with a copy of the shard's filter and counts, so that a line of very many documents
fills no task.  Each document then gets the digests that it loses: by broadcast where
these are small (checked in rows and bytes), else by a join on doc_id.

Cases: null and empty texts are one empty line, and null stays null in ``text``;
each row is a document, so rows with an equal doc_id count each, and all that have
the largest doc_id keep their lines; a null doc_id is the smallest; an empty table
gives no rows; other columns are kept; lines of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, broadcast_if_small, discard, fresh, ids_of, keyed_texts, longs, materialize, tidy

MIN_CHARS = 40
MIN_DOCS = 5
#: Losing digests of a shard; its filter and counts are held by a task.
SHARD_KEYS = 16_384
#: Tasks that a shard's lines are dealt to: as many as there are shuffle partitions for it, within these.
LEAST_SALTS, MOST_SALTS = 8, 64
SLOTS = 4
_SPACE = b" \t\n\x0b\x0c\r"
_SPACES = " \t\n\x0b\x0c\r"


def digest_of(line: str, min_chars: int) -> tuple[int, int] | None:
    """Signed (hi, lo) of a line's key, None if the key is too short."""
    import xxhash

    key = line.strip(_SPACES)
    if len(key) < min_chars:
        return None
    h = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass").lower())
    hi, lo = h >> 64, h & ((1 << 64) - 1)
    return hi - (hi >> 63 << 64), lo - (lo >> 63 << 64)


class Cuckoo:
    """Buckets of four 16-bit fingerprints; 0 is an empty slot."""

    def __init__(self, table=None, buckets: int = 1024):
        import numpy as np

        self.table = np.zeros((buckets, SLOTS), "uint16") if table is None else table

    @classmethod
    def of(cls, keys) -> Cuckoo:
        """A filter of the (hi, lo) pairs, at most about 84 % full."""
        buckets = 64
        while buckets * SLOTS * 0.84 < len(keys):
            buckets *= 2
        while True:
            made = cls(buckets=buckets)
            if all(made.insert(h, low) for h, low in keys):
                return made
            buckets *= 2

    @classmethod
    def load(cls, data: bytes) -> Cuckoo:
        import numpy as np

        return cls(np.frombuffer(data, "<u2").reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    @staticmethod
    def _print(lo: int) -> int:
        return (lo & 0xFFFF) or 1

    def _other(self, at: int, mark: int) -> int:
        return (at ^ (mark * 0x5BD1E995)) & (len(self.table) - 1)

    def _places(self, hi: int, lo: int) -> tuple[int, int, int]:
        mark = self._print(lo)
        at = (hi & 0xFFFFFFFF) & (len(self.table) - 1)
        return mark, at, self._other(at, mark)

    def insert(self, hi: int, lo: int) -> bool:
        mark, a, b = self._places(hi, lo)
        for at in (a, b):
            free = (self.table[at] == 0).nonzero()[0]
            if len(free):
                self.table[at, free[0]] = mark
                return True
        at = b
        for kick in range(500):
            slot = (kick * 7 + mark) % SLOTS
            mark, self.table[at, slot] = int(self.table[at, slot]), mark
            at = self._other(at, mark)
            free = (self.table[at] == 0).nonzero()[0]
            if len(free):
                self.table[at, free[0]] = mark
                return True
        return False

    def delete(self, hi: int, lo: int) -> bool:
        """Take out a key that was put in."""
        mark, a, b = self._places(hi, lo)
        for at in (a, b):
            here = (self.table[at] == mark).nonzero()[0]
            if len(here):
                self.table[at, here[0]] = 0
                return True
        return False

    def among(self, hi, lo):
        """Mask of the digests (arrays of signed 64-bit halves) that may be held."""
        import numpy as np

        mark = lo.view("uint64") & np.uint64(0xFFFF)
        mark[mark == 0] = 1
        last = np.uint64(len(self.table) - 1)
        a = hi.view("uint64") & np.uint64(0xFFFFFFFF) & last
        b = (a ^ (mark * np.uint64(0x5BD1E995))) & last
        mark = mark.astype("uint16")[:, None]
        return (self.table[a] == mark).any(1) | (self.table[b] == mark).any(1)

    def __contains__(self, key: tuple[int, int]) -> bool:
        mark, a, b = self._places(*key)
        return bool((self.table[a] == mark).any() or (self.table[b] == mark).any())


@dataclass
class State:
    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS


def postings(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, hi, lo), each key once a row of ``docs``."""
    bounded_batches(docs.sparkSession)

    def read(batches):
        import numpy as np

        for pdf in batches:
            docs_, pairs = [], []
            for doc, text in zip(ids_of(pdf), pdf["text"], strict=True):
                own = {digest_of(line, min_chars) for line in (text or "").split("\n") if len(line) >= min_chars} - {None}
                docs_ += [doc] * len(own)
                pairs += own
            both = np.array(pairs, "int64").reshape(-1, 2)
            yield pd.DataFrame({"doc_id": longs(docs_), "hi": both[:, 0], "lo": both[:, 1]})

    return keyed_texts(docs).mapInPandas(tidy(read), "doc_id long, hi long, lo long")


def count_table(rows: DataFrame) -> DataFrame:
    return rows.groupBy("hi", "lo").agg(F.count("*").alias("refs"), F.max("doc_id").alias("last_doc"))


def _shard(n: int):
    return F.pmod(F.shiftright("hi", 32), F.lit(n)).alias("shard")


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    made = Cuckoo.of(list(zip(pdf["hi"].tolist(), pdf["lo"].tolist(), strict=True)))
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "filter": [made.dump()]})


def filters_of(losing: DataFrame, shards: int) -> DataFrame:
    """(shard, filter): a shard has about SHARD_KEYS keys, as ``shards`` follows their number."""
    return losing.select(_shard(shards), "hi", "lo").groupBy("shard").applyInPandas(_build, "shard long, filter binary")


def build(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, incremental: bool = True) -> State:
    """The state of a first load.  Without ``incremental``, counts of losing keys alone are stored."""
    rows = materialize(postings(docs, min_chars), "postings")
    if incremental:
        counts = materialize(count_table(rows), "counts")
    else:
        counts = materialize(count_table(rows).where(F.col("refs") >= min_docs), "counts")
    losing = counts.where(F.col("refs") >= min_docs)
    shards = max(1, -(-losing.count() // SHARD_KEYS))
    return State(rows, counts, materialize(filters_of(losing, shards), "filters"), shards, min_chars, min_docs)


def _change(state: State, crossing: DataFrame) -> DataFrame:
    """Filters after putting in (sign 1) or taking out (sign -1) the crossing digests."""

    def change(held: pd.DataFrame, todo: pd.DataFrame) -> pd.DataFrame:
        shard = int((held if len(held) else todo)["shard"].iloc[0])
        now = Cuckoo.load(held["filter"].iloc[0]) if len(held) else Cuckoo(buckets=64)
        for h, low in todo.loc[todo["sign"] < 0, ["hi", "lo"]].to_numpy().tolist():
            now.delete(h, low)
        full = not all([now.insert(h, low) for h, low in todo.loc[todo["sign"] > 0, ["hi", "lo"]].to_numpy().tolist()])
        return pd.DataFrame({"shard": [shard], "filter": [None if full else now.dump()]})

    return state.filters.groupBy("shard").cogroup(crossing.select(_shard(state.shards), "hi", "lo", "sign").groupBy("shard")).applyInPandas(change, "shard long, filter binary")


def _after(state: State, rows: DataFrame, counts: DataFrame, crossing: DataFrame) -> State:
    filters = materialize(_change(state, crossing), "filters")
    if filters.where("filter is null").limit(1).count():  # a shard overflowed: all shards are built anew, wider
        losing = counts.where(F.col("refs") >= state.min_docs)
        shards = max(1, -(-losing.count() // SHARD_KEYS))
        return State(rows, counts, materialize(filters_of(losing, shards), "filters"), shards, state.min_chars, state.min_docs)
    return State(rows, counts, filters, state.shards, state.min_chars, state.min_docs)


def _crossing(before: DataFrame, after: DataFrame, min_docs: int) -> DataFrame:
    both = before.select("hi", "lo", F.col("refs").alias("was")).join(after.select("hi", "lo", F.col("refs").alias("now")), ["hi", "lo"], "full")
    was, now = F.coalesce("was", F.lit(0)) >= min_docs, F.coalesce("now", F.lit(0)) >= min_docs
    return both.where(was != now).select("hi", "lo", F.when(now, 1).otherwise(-1).alias("sign"))


def insert(state: State, docs: DataFrame) -> State:
    new = materialize(postings(docs, state.min_chars), "postings")
    rows = state.postings.unionByName(new)
    counts = materialize(state.counts.unionByName(count_table(new)).groupBy("hi", "lo").agg(F.sum("refs").alias("refs"), F.max("last_doc").alias("last_doc")), "counts")
    return _after(state, rows, counts, _crossing(state.counts, counts, state.min_docs))


def delete(state: State, ids: DataFrame) -> State:
    """Forget all documents whose doc_id is in ``ids``; only their digests are counted anew."""
    ids = ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    gone = state.postings.join(ids, "doc_id", "left_semi").select("hi", "lo").distinct()
    rows = materialize(state.postings.join(ids, "doc_id", "left_anti"), "postings")
    anew = count_table(rows.join(gone, ["hi", "lo"], "left_semi"))
    counts = materialize(state.counts.join(gone, ["hi", "lo"], "left_anti").unionByName(anew), "counts")
    return _after(state, rows, counts, _crossing(state.counts, counts, state.min_docs))


_LINES = "struct<text:string,n_lines:long,n_dropped:long,kept_sha256:string>"


def _kept(text: str | None, loses) -> tuple:
    """(text, n_lines, n_dropped, kept_sha256); ``loses`` says whether a line goes."""
    import hashlib

    lines = (text or "").split("\n")
    kept = [x for x in lines if not loses(x)]
    joined = "\n".join(kept)
    return (None if text is None else joined, len(lines), len(lines) - len(kept), hashlib.sha256(joined.encode("utf-8", "surrogatepass")).hexdigest())


def _probe(batches):
    """The losing lines (doc_id, no_id, hi, lo) of rows in order of (shard, salt, kind): filter, counts, lines."""
    import numpy as np

    filter_, last, now = None, {}, None
    for pdf in batches:
        place = pdf["shard"].to_numpy("int64") * (MOST_SALTS + 1) + pdf["salt"].to_numpy("int64")
        kind = pdf["kind"].to_numpy("int64")
        cuts = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (kind[1:] != kind[:-1]))))
        for low, high in zip(cuts, [*cuts[1:], len(pdf)], strict=True):
            if place[low] != now:
                filter_, last, now = None, {}, place[low]
            own = pdf.iloc[low:high]
            if kind[low] == 0:
                filter_ = Cuckoo.load(bytes(own["filter"].iloc[0]))
            elif kind[low] == 1:
                last.update(zip(zip(own["hi"].tolist(), own["lo"].tolist(), strict=True), ids_of(own), strict=True))
            elif filter_ is not None:  # else the shard has no losing line
                own = own[filter_.among(own["hi"].to_numpy("int64"), own["lo"].to_numpy("int64"))]
                keys = zip(own["hi"].tolist(), own["lo"].tolist(), strict=True)
                yield own.loc[[k in last and last[k] != doc for k, doc in zip(keys, ids_of(own), strict=True)], ["doc_id", "no_id", "hi", "lo"]]


def losing_lines(lines: DataFrame, state: State) -> DataFrame:
    """(doc_id, no_id, hi, lo) of the ``lines`` (as ``postings`` gives them) that go."""
    salts = min(max(LEAST_SALTS, -(-int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")) // state.shards)), MOST_SALTS)
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    doc = lambda c: [F.coalesce(F.col(c), F.lit(0).cast("long")).alias("doc_id"), F.col(c).isNull().alias("no_id")]
    none, zero = F.lit(None).cast("binary").alias("filter"), F.lit(0).cast("long")
    filters = state.filters.select("shard", every, F.lit(0).alias("kind"), zero.alias("hi"), zero.alias("lo"), zero.alias("doc_id"), F.lit(False).alias("no_id"), "filter")
    counts = state.counts.where(F.col("refs") >= state.min_docs).select(_shard(state.shards), every, F.lit(1).alias("kind"), "hi", "lo", *doc("last_doc"), none)
    asked = lines.select(_shard(state.shards), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"), F.lit(2).alias("kind"), "hi", "lo", *doc("doc_id"), none)
    whole = filters.unionByName(counts).unionByName(asked).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    return whole.mapInPandas(tidy(_probe), "doc_id long, no_id boolean, hi long, lo long")


def apply(docs: DataFrame, state: State, lines: DataFrame | None = None) -> DataFrame:
    """Columns of ``docs`` with ``text`` deduplicated, and n_lines, n_dropped, kept_sha256.

    Columns of ``docs`` that have one of the last three names give way.
    """
    (made,) = fresh(docs, "_lines")
    names = ["n_lines", "n_dropped", "kept_sha256"]
    out = with_kept(docs, state, made, lines)
    columns = [F.col(f"{made}.text").alias(c) if c == "text" else F.col(c) for c in docs.columns if c.lower() not in names]
    return out.select(*columns, *[f"{made}.{n}" for n in names])


def with_kept(docs: DataFrame, state: State, made: str, lines: DataFrame | None = None) -> DataFrame:
    """All columns of ``docs`` and ``made``, a struct of text, n_lines, n_dropped, kept_sha256.

    ``lines`` are the postings of ``docs``, where the caller has them already.
    """
    spark, min_chars = docs.sparkSession, state.min_chars
    bounded_batches(spark)
    names = ["text", "n_lines", "n_dropped", "kept_sha256"]
    own_id, own_gone = fresh(docs, "_doc", "_gone")

    @F.pandas_udf(_LINES)
    def keep(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, gone in batches:
            out = []
            for x, g in zip(text, gone, strict=True):
                lost = {(int(r["hi"]), int(r["lo"])) for r in g} if g is not None else set()
                out.append(_kept(x if isinstance(x, str) else None, lambda line, lost=lost: bool(lost) and len(line) >= min_chars and digest_of(line, min_chars) in lost))
            yield pd.DataFrame(out, columns=names)

    hits = losing_lines(postings(docs, min_chars) if lines is None else lines, state)
    gone = hits.distinct().groupBy("doc_id", "no_id").agg(F.collect_list(F.struct("hi", "lo")).alias(own_gone))
    gone = materialize(gone.select(F.when(~F.col("no_id"), F.col("doc_id")).alias(own_id), own_gone), "gone")
    met = docs.join(broadcast_if_small(gone), F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)), "left")
    return met.withColumn(made, keep(F.col("text").cast("string"), F.col(own_gone))).drop(own_id, own_gone)


def with_deduped(docs: DataFrame, made: str, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``with_kept`` by the state of ``docs`` alone, whose postings are read once."""
    state = build(docs, min_chars, min_docs, incremental=False)
    out = with_kept(docs, state, made, state.postings)
    discard(state.postings, state.counts, state.filters)
    return out


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One-shot deduplication of a table of documents."""
    state = build(docs, min_chars, min_docs, incremental=False)
    out = apply(docs, state, state.postings)
    discard(state.postings, state.counts, state.filters)
    return out
