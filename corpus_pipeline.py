"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next one's docs.  All but the last return
the columns of ``docs``.  Rows with a null doc_id, null or empty texts, repeated
rows and extra columns pass through every stage by the rules of its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.llm import decontaminate, hyperlang, linededup, ngramjoin, packing
from voxframe.llm.common import broadcast_if_small, fresh, materialize, settle, shrink_heaps
from voxframe.llm.queries import tokenizer

#: Cosine under which a text is in none of the known languages; unrelated texts have about 0.03.
MIN_SCORE = 0.05
#: Near copies: words of a shingle, and percent of similarity.
WORDS, PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or unlike every language go; null texts go with them."""
    shrink_heaps(spark)
    (made,) = fresh(docs, "_guess")
    guessed = hyperlang.with_guess(docs, hyperlang.fit(docs), made)
    return guessed.where((F.col(f"{made}.lang_pred") != "und") & (F.col(f"{made}.score") >= MIN_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat in five documents stay in the last of them; n_chars follows the text."""
    shrink_heaps(spark)
    (made,) = fresh(docs, "_lines")
    out = linededup.with_deduped(docs, made)
    text = F.col(f"{made}.text")
    new = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays."""
    shrink_heaps(spark)
    groups = ngramjoin.join(docs, n=WORDS, share=PERCENT)
    (copy,) = fresh(docs, "_copy")
    rest = materialize(groups.where("component_id <> doc_id").select(F.col("doc_id").alias(copy)).distinct(), "copies")
    return docs.join(broadcast_if_small(rest), F.col("doc_id") == F.col(copy), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    shrink_heaps(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents, placed in sequences."""
    shrink_heaps(spark)
    return packing.pack_documents(docs, tokenizer())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_copies", near_copies), ("decontamination", decontamination), ("packing", pack)]

#: Language vectors, Jaccard components, SimHash and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(spark, lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
