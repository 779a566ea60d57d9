"""From raw documents to a training mix: language ID, exact dedup, near dedup, benchmark decontamination, mixing.

STAGES are (name, function) pairs. A function takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs; all but the last return the columns of documents, the last a row per document with how many
words the mix takes of it. run() can also write the mixed text itself. Nothing below catches errors of what it imports.

Edge cases. Null texts and texts without letters go at the first stage; null ids, languages and sources stay (a null source is a source of
its own). Of rows that repeat, one stays. An empty table gives an empty result. Further columns pass through all stages but the last,
which reads id, text and source only, so their names may clash with the results'. Very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellarium.llm.common import materialise
from cellarium.llm.decontamination import decontaminate
from cellarium.llm.exact_dedup import exact_dedup
from cellarium.llm.language_id import predictor, train_on_documents
from cellarium.llm.mixing import mix, mix_text
from cellarium.llm.near_dedup import near_dedup

#: Texts of which a smaller share of n-grams is of the predicted language are rejected, as are those without letters.
LEAST_SCORE = 0.2


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = predictor(spark, train_on_documents(docs))(docs["text"])
    return docs.filter((found["lang"] != "und") & (found["score"] >= LEAST_SCORE))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


STAGES = [("language_id", languages), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", benchmarks), ("mixing", mixture)]

#: SQL can express neither trained language filters nor sampled near duplicates; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, mixed: str | None = None) -> DataFrame:
    """The last stage's rows. mixed: a folder for the mix's text by shard and slot, as Parquet; its draws are those of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    if mixed is not None:
        mix_text(docs).write.parquet(mixed)
    return STAGES[-1][1](spark, docs, sf_dir)
