"""Shared plumbing of the training-data operators: tables, shared storage, components.

Nothing here collects rows that grow with the input.  Intermediate results that
must be cut from their lineage are written as Parquet to the folder named by
``spark.checkpoint.dir``, which every executor and the driver can reach.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.session import plain_unions, prefer

#: Rows and bytes that may be broadcast; a row costs some 50 bytes more as a hashed relation.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20
#: Bytes of one Arrow batch handed to a Python worker.
ARROW_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like those given that no column of ``df`` has, in any case of letters."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out


def keyed_texts(docs: DataFrame, **more: Column) -> DataFrame:
    """(doc_id, no_id, text) and ``more`` for Python workers: a long column with nulls would reach them as doubles."""
    extra = [c.alias(name) for name, c in more.items()]
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), F.col("text").cast("string").alias("text"), *extra)


def ids_of(pdf) -> list[int | None]:
    """The doc_id of each row of a batch of ``keyed_texts``."""
    return [None if none else doc for doc, none in zip(pdf["doc_id"].tolist(), pdf["no_id"].tolist(), strict=True)]


def longs(values):
    """A nullable column of whole numbers, never by way of doubles."""
    import numpy as np
    import pandas as pd

    none = np.array([v is None for v in values], bool)
    return pd.arrays.IntegerArray(np.array([0 if v is None else v for v in values], "int64"), none)


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes, so that a run of very long texts fits a worker."""
    plain_unions(spark)
    prefer(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


_held: dict[str, object] = {}


def give_back() -> None:
    """Hand freed pages of this Python worker back to the system."""
    import ctypes
    import gc

    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def claim(name: str, release) -> None:
    """Called in a Python worker by the operator that is about to fill its cache.

    Workers outlive stages; what other operators keep in this one is released first, so
    that caches of successive stages do not add up.
    """
    others = [k for k in _held if k != name]
    for k in others:
        _held.pop(k)()
    _held[name] = release
    if others:
        give_back()


def tidy(step: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``step`` of a task, after which the worker gives freed pages back and waits for the next task small."""

    def run(batches):
        yield from step(batches)
        give_back()

    return run


def shrink_heaps(spark: SparkSession) -> None:
    """Let the executors' JVMs collect their garbage and hand unused heap back, before a stage of a long pipeline.

    A heap that an earlier stage has grown stays grown, beside the Python workers that a
    later stage needs.  One short task a core calls the collector; none of it is needed for
    right results.
    """
    n = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as a URI.  Where none is set, a local one, which only a local master may have."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jdir.get() if jdir.isDefined() else None
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="voxframe-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/") if "://" in found or not found.startswith("/") else "file://" + found.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder; what is still there when the driver ends is removed then."""
    context = spark.sparkContext
    root = f"{shared_dir(spark)}/voxframe/{context.applicationId}"
    if getattr(context, "_voxframe_root", None) != root:
        _path(spark, root)[0].deleteOnExit(_path(spark, root)[1])
        context._voxframe_root, context._voxframe_made = root, []
    path = f"{root}/{tag}-{uuid.uuid4().hex}"
    context._voxframe_made.append(path)
    return path


def _path(spark: SparkSession, path: str):
    """(file system, path) of the driver's Hadoop client."""
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), made


def materialize(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write to the shared folder and read back: later reads survive lost executors."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove the files of materialized tables that nothing will read again."""
    for df in frames:
        fs, path = _path(df.sparkSession, df._scratch)
        fs.delete(path, True)


def settle(spark: SparkSession, make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """The table that ``make`` gives, materialized; all other scratch tables made on the way are removed."""
    scratch_made = lambda: getattr(spark.sparkContext, "_voxframe_made", [])
    before = len(scratch_made())
    out = materialize(make(), tag)
    for path in scratch_made()[before:]:
        if path != out._scratch:
            fs, at = _path(spark, path)
            fs.delete(at, True)
    return out


def _width(value: Column, kind: T.DataType) -> Column:
    """About the bytes that a value takes as a row's part."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
            return F.coalesce(F.aggregate(value, F.lit(0).cast("long"), lambda n, x: n + _width(x, inner)), F.lit(0).cast("long")) + 24
        return F.greatest(F.size(value), F.lit(0)).cast("long") * 8 + 24
    if isinstance(kind, T.StructType):
        out = F.lit(16).cast("long")
        for f in kind.fields:
            out = out + _width(value[f.name], f.dataType)
        return out
    return F.lit(8).cast("long")


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Are all rows together within both bounds?  ``df`` is read once, so it should be a materialized table."""
    width = F.lit(48).cast("long")
    for f in df.schema.fields:
        width = width + _width(F.col(f"`{f.name}`"), f.dataType)
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return n <= rows and total <= size


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint behind a count of rows and bytes; a larger side keeps Catalyst's shuffled join."""
    return F.broadcast(df) if is_small(df, rows, size) else df


def offsets(df: DataFrame, order: list[str], value: str, name: str, buckets: int = 256) -> DataFrame:
    """Running sum of ``value`` before each row in ``order``, without a one-task window over all rows.

    Rows get a range bucket; sums run within buckets and over the bucket totals.
    """
    from pyspark.sql import Window as W

    ranged = df.repartitionByRange(buckets, *order).withColumn("_b", F.spark_partition_id())
    ranged = materialize(ranged, "offsets")
    inner = W.partitionBy("_b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy("_b").agg(F.sum(value).alias("_t"))
    base = totals.select("_b", F.coalesce(F.sum("_t").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return (
        ranged.withColumn("_run", F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .join(F.broadcast(base), "_b")  # one row for each of `buckets` buckets
        .withColumn(name, (F.col("_run") + F.col("_base")).cast("long"))
        .drop("_b", "_run", "_base")
    )


def _union_find(pairs):
    """Spanning stars (node, root) of one batch stream of links, roots being the least node."""
    import numpy as np
    import pandas as pd

    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    for pdf in pairs:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) >= 500_000:  # bounded: hand the forest on and start anew
            nodes = list(parent)
            yield pd.DataFrame({"a": np.array([find(n) for n in nodes], "int64"), "b": np.array(nodes, "int64")})
            parent.clear()
    nodes = list(parent)
    yield pd.DataFrame({"a": np.array([find(n) for n in nodes], "int64"), "b": np.array(nodes, "int64")})


def components(rows: DataFrame, links: Callable[[Iterator], Iterator] | None = None) -> DataFrame:
    """(node, component) of the undirected graph with edges (a, b); component is the least node.

    ``rows`` are the edges, or what ``links`` makes edges of, a step in the same Python
    worker.  Edges are first thinned to a forest inside each partition (bounded memory),
    then least labels spread by alternating large-star and small-star steps, which need
    about log(diameter) rounds; rounds go on until nothing changes.  Each round is written
    to the shared folder and the one before it removed.  A graph without links gives no rows.
    """
    spark = rows.sparkSession
    plain_unions(spark)
    thin = tidy(lambda batches: _union_find(links(batches) if links else batches))
    if links is None:
        rows = rows.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    edges = materialize(rows.mapInPandas(thin, "a long, b long").where("a <> b").distinct(), "cc")
    last = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: every neighbour above a node moves to the node's least neighbour
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
        # small star: every neighbour below a node, and the node, move to the least of them
        low = large.where("a < b").distinct()
        near = low.groupBy("b").agg(F.min("a").alias("m"))
        small = low.join(near, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("b"))
        new = materialize(small.where("x <> b").select(F.col("x").alias("a"), "b").distinct(), "cc")
        discard(edges)
        edges = new
        now = tuple(edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    stars = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
    out = stars.union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
    out._scratch = edges._scratch
    return out
