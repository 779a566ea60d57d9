"""Exact dedup with a heavy-hitter split (operator 8).

The digest of every normalised text is computed once and written as a narrow table. A Misra-Gries
summary (DataFrame.stat.freqItems) over that table names every digest that more than `support` of the rows
have, and at most 1/support digests in all. Their winners are verified by an exact partial aggregation and
broadcast: at most 1/support rows of under 100 bytes, whatever the size of the corpus. Rows with
such a digest are settled on the map side; no other digest has more than support * rows, so the rest goes
through an ordinary shuffle on the digest without a hot key. Only ids and digests are shuffled; texts move once, and only
where rows are to be dropped (`exact_dedup`) of which there are too many to broadcast.

Edge cases. A null text equals an empty one. A null doc_id loses against any other. Rows that repeat an id
and a text tie; exactly one of them stays. An empty table gives an empty result. Columns of the input with the
names of the results give way to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, drop_rows, materialise, text_of

#: Share of the rows from which a digest must count as frequent; 1/SUPPORT rows at most are broadcast.
SUPPORT = 1 / 1024


def digest(text_col: str) -> Column:
    return F.unhex(F.sha2(F.regexp_replace(text_of(text_col), WS, " "), 256))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per row of docs: doc_id, digest, keep_id, group_size, kept."""
    rows = materialise(docs.select(F.col(id_col).alias("doc_id"), digest(text_col).alias("digest"), F.monotonically_increasing_id().alias("row_id")), "digests")
    place = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row_id")
    # as text: the summary tells binary values apart by identity, not by content
    frequent = rows.select(F.hex("digest").alias("d")).stat.freqItems(["d"], support).select(F.explode("d_freqItems").alias("d")).select(F.unhex("d").alias("digest"))
    frequent = materialise(frequent, "frequent")
    winners = materialise(rows.join(F.broadcast(frequent), "digest").groupBy("digest").agg(F.min(place).alias("winner"), F.count(F.lit(1)).alias("group_size")), "winners")
    settled = rows.join(F.broadcast(winners), "digest").select(
        "doc_id", "digest", F.col("winner.doc_id").alias("keep_id"), "group_size", (F.col("row_id") == F.col("winner.row_id")).alias("kept")
    )
    by = Window.partitionBy("digest")
    rest = (
        rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
        .select("doc_id", "digest", "row_id", F.min(place).over(by).alias("winner"), F.count(F.lit(1)).over(by).alias("group_size"))
        .select("doc_id", "digest", F.col("winner.doc_id").alias("keep_id"), "group_size", (F.col("row_id") == F.col("winner.row_id")).alias("kept"))
    )
    return settled.unionByName(rest)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of docs that stay, with docs' columns."""
    return drop_rows(docs, duplicate_groups(docs, id_col, text_col, support).select("doc_id", "digest", "kept"), id_col, digest(text_col))


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return duplicate_groups(docs).select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP8_SQL = r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY h ORDER BY doc_id) = 1 AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
WINDOW g AS (PARTITION BY h)
"""
