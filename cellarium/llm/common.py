"""What the operators share: the shared folder, tables written there, and small column helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space as the contracts define it: space and U+0009 to U+000D.
WS = r"[\x20\x09-\x0D]+"
NOT_WS = r"[^\x20\x09-\x0D]+"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset (tests on one machine) a temporary folder is made once per application."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="cellarium-")
    return _own[app]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, lost executors only cost a re-read, and what is used several times is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that `materialise` wrote and no plan reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Within it, jobs hand Python workers at most so many rows at a time: texts may be long, and a worker holds a batch twice."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str) -> Column:
    """Null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def with_columns(docs: DataFrame, new: dict[str, Column]) -> list[Column]:
    """docs' columns followed by new ones; a column of docs that has a new one's name gives way to it."""
    names = {n.lower() for n in new}
    return [F.col(f"`{c}`") for c in docs.columns if c.lower() not in names] + [c.alias(n) for n, c in new.items()]


#: A table of at most so many narrow rows (some tens of bytes each) may be broadcast.
SMALL_ROWS = 100_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df, marked for broadcast only if a count shows that it has at most `rows` rows. df should be a written table."""
    return F.broadcast(df) if df.count() <= rows else df


def drop_rows(docs: DataFrame, verdicts: DataFrame, id_col: str, digest: Column) -> DataFrame:
    """docs without the rows that verdicts (doc_id, digest, kept; a row per row of docs) rejects, found by id and digest. Where the rejected are few by a count, they are broadcast and no text moves; otherwise they build the hash tables of one shuffle, and texts are not sorted. Of rows that repeat an id and a digest, and of which one stays, any one stays."""
    verdicts = materialise(verdicts.groupBy("doc_id", "digest").agg(F.max("kept").alias("some"), F.min("kept").alias("all")).filter("not all"), "rejected")
    count = verdicts.count()
    rows = docs.select(*with_columns(docs, {"__digest": digest}))
    own = [F.col(f"`{c}`") for c in docs.columns]

    def met(lost: DataFrame, how: str) -> DataFrame:
        lost = lost.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__of"))
        lost = F.broadcast(lost) if count <= SMALL_ROWS else lost.hint("shuffle_hash")
        return rows.join(lost, rows[f"`{id_col}`"].eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__of")), how)

    out = met(verdicts, "left_anti").select(*own)
    repeated = verdicts.filter("some")
    if repeated.limit(1).count():
        first = Window.partitionBy(f"`{id_col}`", "__digest").orderBy("__digest")
        again = met(repeated, "left_semi").withColumn("__n", F.row_number().over(first)).filter("__n = 1")
        out = out.unionByName(again.select(*own))
    return out


def permuted(x: Column, n: Column, *key: Column, rounds: int = 32) -> Column:
    """A pseudorandom permutation of 0 .. n-1 at x (the swap-or-not shuffle of Hoang, Morris and Rogaway): each round pairs x with k - x modulo n, and a hashed bit of the pair's larger member says whether they swap."""
    n = F.greatest(n, F.lit(1))

    def step(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r), n) - at, n)
        return F.when(F.xxhash64(*key, r, F.greatest(at, other), F.lit("swap")).bitwiseAND(F.lit(1)) == 1, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), x.cast("long"), step)
