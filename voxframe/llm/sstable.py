"""Sorted-string-table shards of token ids, keyed by document identifier.

File layout (integers are little-endian, varints are 7 bits a byte, low first)::

    block*   zstd of: entry*, restart offset u32 *, restart count u32
    index    zstd of: (length of last key varint, last key, offset varint, size varint)*
    bloom    bits of all keys, double hashing
    footer   48 bytes: index offset/size, bloom offset/size u64, entries u64, id width u16,
             bloom probes u16, magic 4 bytes

    entry    shared key bytes varint, other key bytes varint, value bytes varint, key, value

Keys are the 8 bytes of doc_id with the sign bit flipped, big-endian (byte order
is numeric order), then a 4-byte repeat number: rows with an equal doc_id all stay.
A null doc_id takes the key of 8 zero bytes' predecessor, the empty prefix, and so
comes first.  Files are written under unique names and count only once their
manifest row is returned, so a repeated or lost task leaves no half shard behind.

Cases: null text and empty text are a document of the end id alone; ties in
doc_id are numbered in order of their text's hash; an empty table gives no shard
and no rows; extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, broadcast_if_small, ids_of, keyed_texts, longs, materialize, offsets, scratch, tidy

MAGIC = b"VXS1"
FOOTER = struct.Struct("<QQQQQHH4s")
BLOCK_BYTES = 128 << 10
RESTART = 16
#: A shard is closed at either bound.
SHARD_BYTES, SHARD_ENTRIES = 256 << 20, 1 << 20
BLOOM_BITS, BLOOM_PROBES = 10, 7


def key_of(doc_id: int | None, repeat: int = 0) -> bytes:
    return (b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))) + struct.pack(">I", repeat)


def doc_of(key: bytes) -> int | None:
    return None if len(key) == 4 else struct.unpack(">Q", key[:8])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _halves(key: bytes) -> tuple[int, int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    return h >> 64, h & ((1 << 64) - 1) | 1


def _probes(key: bytes, bits: int, probes: int) -> Iterator[int]:
    a, b = _halves(key)
    return ((a + i * b) % bits for i in range(probes))


def _bloom(halves: array, bits: int, probes: int) -> bytes:
    """The filter of keys whose hashes' halves are given one after the other, some keys at a time."""
    import numpy as np

    out = np.zeros(-(-bits // 8), "uint8")
    pairs = np.frombuffer(halves, "uint64").reshape(-1, 2)
    for i in range(0, len(pairs), 1 << 16):
        a, b = pairs[i : i + (1 << 16)].T % np.uint64(bits)  # so that no sum passes 64 bits
        for k in range(probes):
            at = (a + np.uint64(k) * b) % np.uint64(bits)
            np.bitwise_or.at(out, (at >> np.uint64(3)).astype("int64"), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype("uint8")))
    return out.tobytes()


class Writer:
    """Entries come in ascending key order; memory is one block, the index and 16 bytes for each key's hash."""

    def __init__(self, out, width: int, block_bytes: int = BLOCK_BYTES):
        import zstandard

        self.out, self.width, self.block_bytes = out, width, block_bytes
        self.zip = zstandard.ZstdCompressor(level=1)
        self.at = self.n = self.held = 0
        self.hashes = array("Q")
        self.index = bytearray()
        self.last = b""
        self._new_block()

    def _new_block(self) -> None:
        self.block, self.restarts, self.held, self.count = [], [], 0, 0

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.count % RESTART:
            shared = next((i for i, (x, y) in enumerate(zip(key, self.last, strict=False)) if x != y), min(len(key), len(self.last)))
        else:
            self.restarts.append(self.held)
        for part in (_varint(shared), _varint(len(key) - shared), _varint(len(value)), key[shared:], value):
            self.block.append(part)
            self.held += len(part)
        self.hashes.extend(_halves(key))
        self.last, self.count, self.n = key, self.count + 1, self.n + 1
        if self.held >= self.block_bytes:
            self._flush()

    def _put(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def _flush(self) -> None:
        if self.count:
            tail = struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
            at, size = self._put(self.zip.compress(b"".join(self.block) + tail))
            self.index += _varint(len(self.last)) + self.last + _varint(at) + _varint(size)
            self._new_block()

    def close(self) -> int:
        self._flush()
        index = self._put(self.zip.compress(bytes(self.index)))
        bits = max(64, BLOOM_BITS * self.n)
        bloom_at = self._put(struct.pack("<Q", bits) + _bloom(self.hashes, bits, BLOOM_PROBES))
        self._put(FOOTER.pack(*index, *bloom_at, self.n, self.width, BLOOM_PROBES, MAGIC))
        return self.at


class Reader:
    """Random and ordered access; ``source`` has size(), and read_at(n, offset) or seek and read."""

    def __init__(self, source):
        import zstandard

        self.source, self.unzip = source, zstandard.ZstdDecompressor()
        *places, self.n, self.width, self.hashes, magic = FOOTER.unpack(self._at(source.size() - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a sorted-string-table shard")
        index = self.unzip.decompress(self._at(*places[:2]), max_output_size=1 << 31)
        self.last_keys: list[bytes] = []
        self.blocks: list[tuple[int, int]] = []
        at = 0
        while at < len(index):
            n, at = _read_varint(index, at)
            self.last_keys.append(index[at : at + n])
            start, at = _read_varint(index, at + n)
            size, at = _read_varint(index, at)
            self.blocks.append((start, size))
        bloom = self._at(*places[2:4])
        self.bits, self.bloom = struct.unpack("<Q", bloom[:8])[0], bloom[8:]
        self._open: tuple[int, tuple] = (-1, ())
        self._first: bytes | None = None

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def _block(self, i: int) -> tuple[bytes, list[int], int]:
        """A block's bytes, restarts and end; the last one stays open, as keys that are asked in order share blocks."""
        if self._open[0] == i:
            return self._open[1]
        raw = self.unzip.decompress(self._at(*self.blocks[i]), max_output_size=1 << 31)
        (count,) = struct.unpack("<I", raw[-4:])
        end = len(raw) - 4 - 4 * count
        self._open = (i, (raw, list(struct.unpack(f"<{count}I", raw[end:-4])), end))
        return self._open[1]

    @staticmethod
    def _entries(raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            shared, at = _read_varint(raw, at)
            other, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + other]
            at += other
            yield key, raw[at : at + size]
            at += size

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.blocks)):
            raw, _, end = self._block(i)
            yield from self._entries(raw, 0, end)

    def may_contain(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits, self.hashes))

    def get(self, key: bytes) -> bytes | None:
        """Bloom filter, then binary search over blocks, then over a block's restarts."""
        if not self.may_contain(key):
            return None
        i = bisect_left(self.last_keys, key)
        if i == len(self.blocks):
            return None
        raw, restarts, end = self._block(i)
        low, high = 0, len(restarts) - 1
        while low < high:
            mid = (low + high + 1) // 2
            if next(self._entries(raw, restarts[mid], end))[0] <= key:
                low = mid
            else:
                high = mid - 1
        for found, value in self._entries(raw, restarts[low], end):
            if found >= key:
                return value if found == key else None
        return None

    def first_repeat(self, doc_id: int) -> int:
        """The repeat number that a shard's entries of ``doc_id`` begin with; 0 unless the shard begins inside them."""
        if self._first is None:
            raw, _, end = self._block(0) if self.blocks else (b"", [], 0)
            self._first = next(self._entries(raw, 0, end), (b"",))[0]
        return struct.unpack(">I", self._first[-4:])[0] if self._first and doc_of(self._first) == doc_id else 0


def _writer(tokenizer: str, end_id: int, folder: str, shard_bytes: int, shard_entries: int):
    def write(batches):
        import os

        from pyarrow import fs as pfs
        from pyspark import TaskContext

        from .tokens import codec

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        enc = codec(tokenizer)
        end = int(end_id).to_bytes(enc.width, "little")
        fs, base = pfs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        seq, out, last, repeat = 0, None, (), 0
        for pdf in batches:
            rows = []
            for doc, text in zip(ids_of(pdf), pdf["text"], strict=True):
                repeat = repeat + 1 if last == (doc,) else 0
                last = (doc,)
                if out is None:
                    name = f"{part:07d}-{seq:04d}-{uuid.uuid4().hex}.sst"
                    stream = fs.open_output_stream(f"{base}/{name}")
                    out, tokens, first = Writer(stream, enc.width), 0, (doc, repeat)
                ids = enc.encode(text or "") + end
                tokens += len(ids) // enc.width
                out.add(key_of(doc, repeat), ids)
                if out.at >= shard_bytes or out.n >= shard_entries:
                    n, size = out.n, out.close()
                    stream.close()
                    rows.append((f"{folder}/{name}", part, seq, *first, n, tokens, size))
                    out, seq = None, seq + 1
            if rows:
                yield _manifest(rows)
        if out is not None:
            n, size = out.n, out.close()
            stream.close()
            yield _manifest([(f"{folder}/{name}", part, seq, *first, n, tokens, size)])

    return write


def _manifest(rows: list[tuple]):
    import pandas as pd

    out = pd.DataFrame(rows, columns=_COLUMNS, dtype=object)
    return out.assign(first_doc=longs(out["first_doc"].tolist()))


_COLUMNS = ["path", "part", "seq", "first_doc", "first_repeat", "n_docs", "n_tokens", "n_bytes"]
_MANIFEST = "path string, part long, seq long, first_doc long, first_repeat long, n_docs long, n_tokens long, n_bytes long"


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 0, shard_bytes: int = SHARD_BYTES, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """Encode (doc_id, text), write shards in ascending doc_id order, return their manifest.

    The manifest has a row for each shard and ``start``, the ids of all documents before it.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = scratch(spark, "sst")
    rows = keyed_texts(docs).withColumn("some_id", ~F.col("no_id"))  # null ids come first
    ranged = rows.repartitionByRange("some_id", "doc_id").sortWithinPartitions("some_id", "doc_id", F.xxhash64("text"), "text")
    manifest = materialize(ranged.mapInPandas(tidy(_writer(tokenizer, end_id, folder, shard_bytes, shard_entries)), _MANIFEST), "sst-manifest")
    return materialize(offsets(manifest, ["part", "seq"], "n_tokens", "start", buckets=64), "sst-manifest")


def _documents(rows: list[tuple]):
    import pandas as pd

    docs, *rest = zip(*rows, strict=True)
    return pd.DataFrame({"doc_id": longs(docs)} | dict(zip(("start", "n_tokens", "width", "ids"), map(list, rest), strict=True)))


def _read(batches):
    import pyarrow.fs as pfs

    for pdf in batches:
        for path, start in zip(pdf["path"], pdf["start"], strict=True):
            fs, name = pfs.FileSystem.from_uri(path)
            with fs.open_input_file(name) as source:
                reader = Reader(source)
                rows, at, held = [], int(start), 0
                for key, value in reader.scan():
                    n = len(value) // reader.width
                    rows.append((doc_of(key), at, n, reader.width, value))
                    at, held = at + n, held + len(value)
                    if held > 8 << 20:
                        yield _documents(rows)
                        rows, held = [], 0
                if rows:
                    yield _documents(rows)


def _digests(batches):
    """The same scan, reduced to a digest of each document's ids before it leaves the worker."""
    import numpy as np

    for pdf in _read(batches):
        crc = [zlib.crc32(np.frombuffer(v, f"<u{w}").astype("<u4").tobytes()) for v, w in zip(pdf["ids"], pdf["width"], strict=True)]
        yield pdf[["doc_id", "start", "n_tokens"]].assign(ids_crc32=np.array(crc, "int64"))


def _spread(manifest: DataFrame) -> DataFrame:
    """One shard a task, as far as that is possible."""
    return manifest.select("path", "start").repartition(max(1, manifest.count()))


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, width, ids) of all documents, read back from the files."""
    return _spread(manifest).mapInPandas(_read, "doc_id long, start long, n_tokens long, width int, ids binary")


def shard_digests(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, read back from the files."""
    return _spread(manifest).mapInPandas(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _shards_of(manifest: DataFrame, asked: DataFrame) -> DataFrame:
    """(path, doc_id): the shards that can hold each asked document.

    These are the last shard that begins below it, and all that begin with it (repeats of a
    doc_id may go over several).  Keys and shard beginnings are range-partitioned together;
    what a partition's first keys need of the partitions before is one row a partition.
    """
    from pyspark.sql import Window as W

    shard = F.struct("part", "seq", "path")
    bounds = manifest.select(F.coalesce("first_doc", F.lit(-(1 << 63))).alias("at"), F.lit(1).alias("kind"), shard.alias("shard"))
    both = asked.select(F.col("doc_id").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(bounds.schema["shard"].dataType).alias("shard")).unionByName(bounds)
    ranged = materialize(both.repartitionByRange("at").withColumn("_p", F.spark_partition_id()), "sst-keys")
    below = W.partitionBy("_p").orderBy("at", "kind", "shard").rowsBetween(W.unboundedPreceding, W.currentRow)  # a key stands before shards that begin with it
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    carried = ranged.groupBy("_p").agg(F.max("shard").alias("_last")).select("_p", F.max("_last").over(before).alias("_carry"))
    keys = ranged.withColumn("shard", F.last("shard", ignorenulls=True).over(below)).where("kind = 0")
    last = keys.join(broadcast_if_small(carried), "_p", "left").select(F.coalesce("shard", "_carry")["path"].alias("path"), F.col("at").alias("doc_id")).where("path is not null")
    same = asked.join(bounds, F.col("doc_id") == F.col("at")).select(F.col("shard.path").alias("path"), "doc_id")
    return last.unionByName(same).distinct()


def lookup(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """Ids of asked documents (column doc_id): Bloom filter, then binary search in the shards that can hold each.

    A key that no shard holds gives no row; null keys are not asked.
    """
    asked = keys.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    hits = _shards_of(manifest, asked)

    def find(batches):
        import numpy as np
        import pandas as pd
        import pyarrow.fs as pfs

        path = source = reader = None
        rows, held = [], 0
        for pdf in batches:
            for at, doc in zip(pdf["path"], pdf["doc_id"].tolist(), strict=True):
                if at != path:  # one shard is open at a time
                    if source is not None:
                        source.close()
                    fs, name = pfs.FileSystem.from_uri(at)
                    path, source = at, fs.open_input_file(name)
                    reader = Reader(source)
                repeat = reader.first_repeat(doc)
                while (value := reader.get(key_of(doc, repeat))) is not None:
                    rows.append((doc, np.frombuffer(value, f"<u{reader.width}").astype("int32")))
                    held += len(value)
                    repeat += 1
                    if held > 8 << 20:
                        yield pd.DataFrame(rows, columns=["doc_id", "ids"])
                        rows, held = [], 0
        if source is not None:
            source.close()
        if rows:
            yield pd.DataFrame(rows, columns=["doc_id", "ids"])

    return hits.repartition("path").sortWithinPartitions("path", "doc_id").mapInPandas(tidy(find), "doc_id long, ids array<int>")
