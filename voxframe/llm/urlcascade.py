"""Exact URL membership by cascades of Bloom filters, in DataFrame functions only.

The key universe (every distinct key of the corpus) is cut by hash into shards of about
KEYS_PER_SHARD keys, and each shard has a cascade of its own.  Level 1 encodes the
shard's listed keys; level 2 the other keys that pass level 1; level 3 the listed keys
that pass level 2; and so on until no key passes wrongly.  The first level that a key
fails decides: odd levels hold listed keys, even ones unlisted keys, and a key that
passes every level is on the side of the last.  Over its universe the answer is exact.

Filters are arrays of 64-bit words, put together on the executors, a shard a row.  If
all together are within ``literal_bytes`` (checked) they become a constant of the plan,
and a lookup is arithmetic on it, without a join; beyond it rows meet the filters of
their shard (never the keys) in a join, whose skewed partitions Spark can split.

Cases: null urls and urls without ``://`` have an empty host and path, and the empty
key; a null page_id and repeated rows keep their rows; an empty list answers no for
every key; listed keys outside the universe change nothing; an empty table gives no
rows; columns of ``pages`` other than page_id and url are ignored, whatever their names;
keys are distinct before they are counted, so hot hosts cost one key; urls of any length
are read whole.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.session import plain_unions

from .common import discard, materialize

BITS_PER_KEY = 10
PROBES = 4
KEYS_PER_SHARD = 4096
LITERAL_BYTES = 4 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(col: Column) -> Column:
    return F.translate(col, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") == 0, F.lit("")).otherwise(lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)))


def path_of(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") == 0, F.lit("")).otherwise(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def key_of(url: Column) -> Column:
    """Host and path of a url, without scheme, query and fragment."""
    return F.concat(host_of(url), path_of(url))


def _passes(key: Column, level: int, words: Column) -> Column:
    """Are all of the key's bits set in the level's words?"""
    bits = F.greatest(F.size(words), F.lit(1)).cast("long") * 64

    def held(probe: int) -> Column:
        at = F.pmod(F.xxhash64(F.lit(level), F.lit(probe), key), bits)
        return F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1

    return reduce(Column.__and__, map(held, range(PROBES)))


@dataclass
class Cascade:
    """``filters`` has (shard, levels) for each shard with a listed key; ``size`` is the bytes of all words."""

    filters: DataFrame
    shards: int
    depth: int
    size: int

    def shard_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(0), key), F.lit(self.shards).cast("long")).cast("int")

    def answer(self, key: Column, levels: Column) -> Column:
        """Is the key listed, by its shard's levels?  Exact for keys of the universe."""
        out = F.lit(self.depth % 2 == 1)
        for i in range(self.depth, 0, -1):
            words = F.get(levels, F.lit(i - 1))
            out = F.when(words.isNull(), F.lit(i % 2 == 0)).when(F.coalesce(_passes(key, i, words), F.lit(False)), out).otherwise(F.lit(i % 2 == 0))
        return F.when(levels.isNull(), F.lit(False)).otherwise(out)

    def mark(self, rows: DataFrame, key: str, listed: str, literal_bytes: int = LITERAL_BYTES) -> DataFrame:
        """``rows`` and the boolean column ``listed`` for the column ``key``."""
        shard = self.shard_of(F.col(key))
        if self.size <= literal_bytes:
            table: list = [None] * self.shards
            for r in self.filters.select("shard", F.to_json("levels").alias("levels")).collect():  # at most `literal_bytes` of filters
                table[r["shard"]] = r["levels"]
            held = F.from_json(F.lit("[" + ",".join(x or "null" for x in table) + "]"), "array<array<array<bigint>>>")
            return rows.withColumn(listed, self.answer(F.col(key), F.get(held, shard)))
        names = ("_shard", "_levels")
        filters = self.filters.select(F.col("shard").alias(names[0]), F.col("levels").alias(names[1]))
        met = rows.withColumn(names[0], shard).join(filters, names[0], "left")
        return met.withColumn(listed, self.answer(F.col(key), F.col(names[1]))).drop(*names)


def _filters(keys: DataFrame, level: int) -> DataFrame:
    """(shard, words) of the level's keys (shard, key)."""
    need = F.ceil(F.col("n") * BITS_PER_KEY / 64)
    counts = keys.groupBy("shard").agg(F.count("*").alias("n")).select("shard", need.alias("n_words"))
    at = F.array(*[F.pmod(F.xxhash64(F.lit(level), F.lit(p), "key"), F.col("n_words") * 64) for p in range(PROBES)])
    bits = keys.join(counts, "shard").select("shard", F.explode(at).alias("at"))
    one = F.expr("shiftleft(1L, cast(at & 63L as int))")
    zero = counts.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_words") - 1)).alias("word"), F.lit(0).cast("long").alias("v"))
    words = bits.select("shard", F.shiftright("at", 6).alias("word"), one.alias("v")).unionByName(zero).groupBy("shard", "word").agg(F.bit_or("v").alias("v"))
    return words.groupBy("shard").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "v"))), lambda w: w["v"]).alias("words"))


def build(universe: DataFrame, listed: DataFrame) -> Cascade:
    """A cascade over the distinct keys (column ``key``) of ``universe``; ``listed`` has those to answer yes for."""
    plain_unions(universe.sparkSession)
    marks = listed.select("key").where("key is not null").distinct().withColumn("listed", F.lit(True))
    keys = universe.select("key").where("key is not null").distinct().join(marks, "key", "left")
    keys = materialize(keys.withColumn("listed", F.coalesce("listed", F.lit(False))), "keys")
    cascade = Cascade(keys, max(1, -(-keys.count() // KEYS_PER_SHARD)), 0, 0)
    sharded = keys.withColumn("shard", cascade.shard_of(F.col("key")))
    left = {True: sharded.where("listed").select("key", "shard"), False: sharded.where("not listed").select("key", "shard")}
    side, levels, spent = True, [], []
    while True:
        level = len(levels) + 1
        own = materialize(_filters(left[side], level), "filters")
        size = own.agg(F.sum(F.size("words"))).first()[0]
        if not size:
            discard(own)
            break
        levels.append(own)
        cascade.size += 8 * size
        wrong = left[not side].join(own, "shard").where(_passes(F.col("key"), level, F.col("words"))).select("key", "shard")
        left[not side] = materialize(wrong, "wrong")
        spent.append(left[not side])
        side = not side
    cascade.depth = len(levels)
    if levels:
        rows = reduce(DataFrame.unionByName, (f.withColumn("level", F.lit(i)) for i, f in enumerate(levels)))
        whole = rows.groupBy("shard").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "words"))), lambda x: x["words"]).alias("levels"))
    else:
        whole = keys.limit(0).select(F.lit(0).alias("shard"), F.array(F.array(F.lit(0).cast("long"))).alias("levels"))
    cascade.filters = materialize(whole, "cascade")
    discard(keys, *levels, *spent)
    return cascade


#: (host, path, verdict) of the query's rules.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    name = verdict = F.lit(None).cast("string")
    for h, p, what in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, literal_bytes: int = LITERAL_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict, listed; without a rule, listed urls are blocked.

    ``listed`` has the column ``key``: host and path as ``key_of`` gives them.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("key", F.concat("host", "path"))
    marked = build(rows, listed).mark(rows, "key", "listed", literal_bytes)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_list = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return marked.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_list).alias("verdict"), "listed")
