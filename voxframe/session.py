"""Session settings that results depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def prefer(spark: SparkSession, key: str, value: str) -> None:
    """Set what the session does not set itself; a setting of the caller's stays."""
    if key not in spark.conf.getAll:
        spark.conf.set(key, value)


def plain_unions(spark: SparkSession) -> None:
    """Let no exchange be left out above a union.

    Spark 4.1 takes a union of equally partitioned inputs as partitioned alike, and with
    adaptive execution their partitions can be coalesced differently; joins on top then
    miss rows.  The setting is unknown to earlier versions, which do not have the rule.
    """
    prefer(spark, "spark.sql.unionOutputPartitioning", "false")


#: Rows and bytes of a catalogue that may be broadcast.
CATALOGUE_ROWS, CATALOGUE_BYTES = 100_000, 16 << 20


def catalogue(df: DataFrame, rows: int = CATALOGUE_ROWS, size: int = CATALOGUE_BYTES) -> DataFrame:
    """A broadcast hint for a table of few rows and bytes, both of which are checked; a larger one keeps Spark's own choice of join."""
    text = F.length(F.to_json(F.struct(*df.columns)))  # about a row's bytes
    n, total = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(text), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= size else df


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed: cut from its lineage, in the folder that driver and executors share.

    Where the session names none, a local master gets a temporary one; a cluster must name it.
    """
    import tempfile

    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not found and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="voxframe-checkpoint-"))
    return df.checkpoint()
