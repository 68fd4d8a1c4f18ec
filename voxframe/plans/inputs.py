"""Mappings of the driver's tables onto the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxframe.functions.text import words
from voxframe.functions.timefmt import micros


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events in order are 32 ms score windows, value / 100 the score."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    n = F.count("*").over(W.partitionBy("user_id"))
    return table(spark, sf_dir, "events").select("user_id", (F.row_number().over(order) - 1).alias("w"), (F.col("value") / 100).alias("p"), (n * 32 / 1000).alias("duration_sec"))


def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, idx, t (seconds since the user's first event), event_type, value."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    t = (micros("ts") - F.min(micros("ts")).over(W.partitionBy("user_id"))) / 1000000
    return table(spark, sf_dir, "events").select("user_id", (F.row_number().over(order) - 1).alias("idx"), t.alias("t"), "event_type", "value")


def event_turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turns (reference, hypothesis) of a user's events: one a second, 1.3 s long; the hypothesis is 0.1 s late and takes large values for one speaker."""
    e = event_times(spark, sf_dir)
    ref = e.select("user_id", F.col("event_type").alias("speaker"), F.col("idx").cast("double").alias("start_sec"), (F.col("idx") + 1.3).alias("end_sec"))
    speaker = F.when(F.col("value") > 80, F.lit("s0")).otherwise(F.col("event_type"))
    hyp = e.select("user_id", speaker.alias("speaker"), (F.col("idx") + 0.1).alias("start_sec"), (F.col("idx") + 1.4).alias("end_sec"))
    return ref, hyp


def timed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as timed text: a turn starts every 4 s and lasts 1/30 s a character."""
    c = table(spark, sf_dir, "conversations")
    start = F.col("turn") * 4.0
    return c.select("conv_id", F.col("turn").alias("idx"), start.alias("start_sec"), (start + F.length(F.coalesce("text", F.lit(""))) / 30).alias("end_sec"), "text", F.col("role").alias("speaker"))


def next_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, lower-cased words of a turn (ref) and of the next one (hyp)."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", words(F.lower("text")).alias("ref"))
    both = c.withColumn("hyp", F.lead("ref").over(W.partitionBy("conv_id").orderBy("turn"))).where("hyp is not null")
    return both.repartition(spark.sparkContext.defaultParallelism, "conv_id", "turn")  # few bytes, but much work a row


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with the meeting they belong to: forty in order of vec_id."""
    return table(spark, sf_dir, "embeddings").withColumn("meeting", F.floor(F.col("vec_id") / 40))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as run results: flags are models, statuses backends, the order's status the outcome."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    x = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "error").otherwise("timeout")
    q = F.col("l_quantity").cast("int")
    return x.select(
        F.concat("l_returnflag", F.lit("/"), F.pmod("l_suppkey", F.lit(7)).cast("string")).alias("model"),
        F.col("l_linestatus").alias("backend"),
        status.alias("status"),
        F.col("l_extendedprice").alias("infer_ms"),
        (F.col("l_discount") + 0.1).alias("rtf"),
        F.when(F.col("l_tax") > 0.02, F.col("l_tax") * 1000).alias("load_ms"),
        F.when(F.col("l_tax") > 0.04, F.col("l_quantity")).alias("mem_peak_mb"),
        F.pmod(q, F.lit(5)).alias("sub"),
        F.pmod(q, F.lit(3)).alias("del"),
        F.pmod(q, F.lit(7)).alias("ins"),
        q.alias("ref_words"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )
