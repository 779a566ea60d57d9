"""Token counts as delta-maintained rollups (operator 9).

Totals by source, language and tokenizer version are never recounted: every batch of changes becomes signed
sums (an insert adds, a delete subtracts, a revision adds the difference), and totals are the sums over all committed
batches. A batch's sums are written to a folder of their own, which nobody reads until a marker named by the batch's id is created
(`create` without overwriting, which one of several writers wins) and names that folder. A batch that is sent again finds its marker
and changes nothing. A marker that isn't whole belongs to a writer that still writes it or died: sending that batch raises an error, never
passes for done, until the marker is whole or `recover` has cleared it. This needs a file system on
which creating a file without overwriting is atomic, as on HDFS; a marker is renamed only once its batch is folded.

Compaction takes the list of markers once, sums exactly these, and writes the sums under the marker of the next generation, which
lists what it folds; then it moves folded markers to a folder of their own, where their names stay taken and nobody reads them, and deletes the data of what the generation before it folded.
So totals read the markers since the last compaction, however many batches there were. A batch committed meanwhile is in no list and stays as it is; of two compactions of one generation one wins, and the other's sums are
dropped. A compaction that dies before it moves markers loses nothing: its list says what it folds, and the next one moves them.

Changes carry the counts (new ones and, for deletes and revisions, those that go), so a batch costs what it holds and
the store holds a row per group and batch. Hot groups cost nothing: sums are made before the shuffle.

Edge cases. Null sources, languages and texts are groups and values of their own (a null text has 0 tokens, the group is kept
apart from the empty string). An empty batch commits and adds nothing. Groups whose documents and tokens are all 0 are
not in the totals. Repeated rows count each. Very long texts are counted whole. Further columns of documents and changes are not read, so their
names may clash with anything.
"""

from __future__ import annotations

import base64
import time
import uuid
from collections.abc import Iterator
from functools import cache

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_WS, materialise, shared_dir, text_of

KEYS = ("source", "lang", "tokenizer")
#: Seconds that a writer waits for the whole marker of another writer of the same batch.
PATIENCE = 10.0
TOKENIZERS = "/opt/tokenizers"
# fixed value: the pattern by which the vocabularies' texts were cut
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding(path.rsplit("/", 1)[-1], pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def bpe_tokens(path: str):
    """A pandas UDF: text -> number of byte-level BPE tokens. path: a vocabulary of ranks, read on each executor."""

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoder(path).encode_ordinary
        for batch in texts:
            yield pd.Series([len(encode(x)) if x else 0 for x in batch], dtype="int64")

    return count


class Rollup:
    """Totals in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        for folder in ("markers", "folded", "data"):
            self._fs.mkdirs(self._path(f"{self.path}/{folder}"))

    def _marker(self, batch: str) -> str:
        return "b-" + base64.urlsafe_b64encode(batch.encode()).decode().rstrip("=")

    def _is(self, folder: str, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/{folder}/{name}"))

    def _read(self, name: str, folder: str = "markers") -> list[str] | None:
        """Lines of a marker without its last, which says that it is whole; None if it isn't there or isn't whole."""
        at = self._path(f"{self.path}/{folder}/{name}")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        lines = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
        stream.close()
        return lines[:-1] if lines[-1] == "end" else None

    def listing(self) -> dict[str, list[str]]:
        """Whole markers that no compaction has folded: name -> its folder and, for compactions, what it folds. Reads what was committed since the last compaction, and that."""
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/markers")))
        folded: set[str] = set()
        newest = max((n for n in names if n.startswith("c-") and self._read(n) is not None), default=None)
        if newest is not None:
            folded.update(self._read(newest)[1:])
        whole = {n: lines for n in names if not n.startswith(".") and n not in folded and not self._is("folded", n) and (lines := self._read(n)) is not None}
        return {n: lines for n, lines in whole.items() if not n.startswith("c-") or n == newest}

    def batches(self) -> list[str]:
        """Folders whose sums make the totals."""
        return [f"{self.path}/data/{lines[0]}" for lines in self.listing().values()]

    def committed(self, batch: str) -> bool:
        name = self._marker(batch)
        return self._is("folded", name) or self._read(name) is not None

    def recover(self, batch: str) -> bool:
        """Clear the marker of a batch whose writer died while it wrote it. Only to be called when that writer is known to be gone."""
        name = self._marker(batch)
        return not self.committed(batch) and self._fs.delete(self._path(f"{self.path}/markers/{name}"), False)

    def _there(self, name: str) -> bool:
        """Whether a marker is there and whole. One that isn't gets PATIENCE seconds to become so; then this raises."""
        until = time.monotonic() + PATIENCE
        while not self._is("folded", name) and self._read(name) is None:
            if not self._is("markers", name):
                return False
            if time.monotonic() > until:
                raise RuntimeError(f"the marker {name} is not whole: its writer is writing it still, or died, and then recover() clears it")
            time.sleep(0.1)
        return True

    def _put(self, sums: DataFrame, name: str, folds: list[str] | None = None) -> bool:
        data = uuid.uuid4().hex
        sums.write.parquet(f"{self.path}/data/{data}")
        try:
            out = self._fs.create(self._path(f"{self.path}/markers/{name}"), False)
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName() and not self._is("markers", name):
                raise
            self._fs.delete(self._path(f"{self.path}/data/{data}"), True)
            if not self._there(name):
                raise RuntimeError(f"the marker {name} was cleared while this batch waited for it; send it again") from e
            return False
        out.write(bytearray("\n".join([data, *(folds or []), "end"]).encode()))
        out.close()
        if self._is("folded", name):  # committed and folded by others since the look at its marker; listings pass this one over
            self._fs.delete(self._path(f"{self.path}/markers/{name}"), False)
            self._fs.delete(self._path(f"{self.path}/data/{data}"), True)
            return False
        return True

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of changes: op (insert, delete, revise), source, lang, tokenizer, tokens (new; null for deletes) and old_tokens (null for inserts). False if the batch is committed already; then nothing is read. Raises if its marker is there but not whole."""
        if self._there(self._marker(batch)):
            return False
        sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0)
        sign = F.coalesce(sign, F.raise_error(F.concat(F.lit("unknown op "), F.coalesce(F.col("op"), F.lit("null")))).cast("int"))
        delta = F.when(F.col("op") == "delete", -F.coalesce("old_tokens", F.lit(0))).otherwise(F.coalesce("tokens", F.lit(0)) - F.when(F.col("op") == "revise", F.coalesce("old_tokens", F.lit(0))).otherwise(0))
        signed = changes.select(*KEYS, sign.cast("long").alias("documents"), delta.cast("long").alias("tokens"))
        return self._put(signed.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")), self._marker(batch))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents, tokens."""
        return self._sums(self.batches())

    def _sums(self, folders: list[str]) -> DataFrame:
        schema = "source string, lang string, tokenizer string, documents long, tokens long"
        rows = self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        sums = rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.filter("documents <> 0 or tokens <> 0")

    def compact(self) -> bool:
        """Fold what is committed now into one. The markers stay as names that are taken. False if another compaction of the same state was first, or there is nothing to fold."""
        listed = self.listing()
        last = max((n for n in listed if n.startswith("c-")), default=None)
        before = listed[last][1:] if last is not None else []
        self._shelve(before)
        if len(listed) < 2:
            return False
        generation = 1 + (int(last[2:]) if last is not None else 0)
        if not self._put(self._sums([f"{self.path}/data/{x[0]}" for x in listed.values()]).coalesce(1), f"c-{generation:012d}", list(listed)):
            return False
        self._shelve(list(listed))
        for name in before:  # a generation old: whoever listed them has read them
            lines = self._read(name, "folded")
            if lines:
                self._fs.delete(self._path(f"{self.path}/data/{lines[0]}"), True)
        return True

    def _shelve(self, names: list[str]) -> None:
        for name in names:
            if self._is("markers", name) and not self._is("folded", name):
                self._fs.rename(self._path(f"{self.path}/markers/{name}"), self._path(f"{self.path}/folded/{name}"))


def counted(docs: DataFrame, tokenizers: str = TOKENIZERS, text_col: str = "text") -> DataFrame:
    """A row per document and tokenizer version: doc_id, source, lang, tokenizer, tokens. words-1 counts runs of other than white space; byte-bpe-50k-1 counts byte-level BPE tokens."""
    bpe = bpe_tokens(f"{tokenizers}/byte_bpe_50k.tiktoken")(F.col(text_col))
    each = docs.select("doc_id", "source", "lang", F.regexp_count(text_of(text_col), F.lit(NOT_WS)).cast("long").alias("w"), bpe.alias("b"))
    pairs = F.array(F.struct(F.lit("words-1").alias("tokenizer"), F.col("w").alias("tokens")), F.struct(F.lit("byte-bpe-50k-1").alias("tokenizer"), F.col("b").alias("tokens")))
    return each.select("doc_id", "source", "lang", F.explode(pairs).alias("t")).select("doc_id", "source", "lang", "t.*")


def op9(spark, sf_dir: str) -> DataFrame:
    """Every document is inserted under two tokenizer versions. Then those labelled toxic are deleted, and the words-1 count of those labelled of low quality is revised to 0. The first batch is sent twice."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    counts = materialise(counted(read("documents")), "counts")
    labels = read("labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    store = Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    loaded = counts.select(F.lit("insert").alias("op"), *KEYS, "tokens", F.lit(None).cast("long").alias("old_tokens"))
    store.commit("load", loaded)
    labelled = counts.join(labels, "doc_id")
    store.commit("toxic", labelled.filter("toxic = 1").select(F.lit("delete").alias("op"), *KEYS, F.lit(None).cast("long").alias("tokens"), F.col("tokens").alias("old_tokens")))
    store.commit("quality", labelled.filter("coalesce(toxic, 0) <> 1 and quality = 0 and tokenizer = 'words-1'").select(F.lit("revise").alias("op"), *KEYS, F.lit(0).cast("long").alias("tokens"), F.col("tokens").alias("old_tokens")))
    store.commit("load", loaded)
    store.compact()
    return store.totals()
