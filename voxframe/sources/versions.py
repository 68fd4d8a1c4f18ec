"""Saves of a header and rows that are whole or not seen, also when a key is saved again.

Each save writes its header and rows to folders of its own, which nothing changes later:

    header/save=<token>/   rows/save=<token>/   commits/<number>

and counts once the file of the next number, holding its token, is there.  That file is
made in one step that fails if it exists, so two saves cannot take one number.  A key is read
from the save of largest number that has it: a save that broke off has no number, and the
key's old header stays with its old rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.session import catalogue


class Conflict(RuntimeError):
    """Another save has taken a key since the caller read it."""


def _path(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), made


def version(spark: SparkSession, path: str) -> int:
    """The number of the last save; 0 before the first."""
    fs, at = _path(spark, f"{path}/commits")
    if not fs.exists(at):
        return 0
    return max((int(f.getPath().getName()) for f in fs.listStatus(at) if f.getPath().getName().isdigit()), default=0)


def _commit(spark: SparkSession, path: str, token: str, number: int) -> bool:
    """Take the number for a save; False if another has it."""
    fs, at = _path(spark, f"{path}/commits/{number:012d}")
    try:
        out = fs.create(at, False)
    except Exception as e:
        if fs.exists(at):
            return False
        raise e
    out.write(bytearray(token.encode()))
    out.close()
    return True


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(number, save) of the saves that count; one whose file is empty broke off in its last step."""
    text = spark.read.text(f"{path}/commits")
    return text.select(F.regexp_extract(F.input_file_name(), "([0-9]+)$", 1).cast("long").alias("number"), F.col("value").alias("save")).where("save <> ''")


def _known(spark: SparkSession, path: str, part: str, schema=None) -> DataFrame:
    """The part's rows of saves that count, with their numbers."""
    rows = spark.read.option("basePath", f"{path}/{part}").option("mergeSchema", "true").parquet(f"{path}/{part}")
    return rows.withColumn("save", F.col("save").cast("string")).join(catalogue(commits(spark, path)), "save")


def save(header: DataFrame, rows: DataFrame, path: str, key: str, base: int | None = None) -> int:
    """Save all keys of ``header`` with their rows at once; returns the save's number.

    With ``base``, the number that the caller read, a key that a later save has taken is a
    Conflict and nothing is saved; without, the last save of a key counts.  A key without a
    header is not read; rows of other keys than the header's are not either.
    """
    spark, token = header.sparkSession, f"s{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/rows/save={token}")
    header.write.parquet(f"{path}/header/save={token}")
    while True:
        last = version(spark, path)
        if base is not None and last > base:
            own = spark.read.parquet(f"{path}/header/save={token}").select(key).distinct()
            since = _known(spark, path, "header").where(F.col("number") > base).select(key).distinct()
            taken = own.join(since, key, "left_semi").limit(1).collect()
            if taken:
                raise Conflict(f"{taken[0][0]} was saved after {base}")
        if _commit(spark, path, token, last + 1):
            return last + 1


def load(spark: SparkSession, path: str, key: str, as_of: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(header, rows) of each key by its last save, up to number ``as_of``."""
    head = _known(spark, path, "header")
    if as_of is not None:
        head = head.where(F.col("number") <= as_of)
    newest = head.groupBy(key).agg(F.max("number").alias("number"))
    held = head.join(newest, [key, "number"])
    rows = _known(spark, path, "rows").join(newest, [key, "number"], "left_semi")
    return held.drop("save", "number"), rows.drop("save", "number")


def vacuum(spark: SparkSession, path: str, key: str, before: int) -> int:
    """Remove the folders of saves below number ``before`` that hold no key's last version; how many."""
    head = _known(spark, path, "header")
    needed = head.groupBy(key).agg(F.max_by("save", "number").alias("save")).select("save").distinct()
    old = commits(spark, path).where(F.col("number") < before).join(needed, "save", "left_anti")
    gone = 0
    for row in old.toLocalIterator():
        for part in (f"rows/save={row.save}", f"header/save={row.save}", f"commits/{row.number:012d}"):
            fs, at = _path(spark, f"{path}/{part}")
            fs.delete(at, True)
        gone += 1
    return gone
