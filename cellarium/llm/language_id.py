"""Language ID by language-bitmask n-gram filters (operator 3).

Texts become lower-case letters with one space between words; their character 3- and 4-grams are hashed. A
bit-sliced Bloom filter is a table of `CELLS` cells with one bit per language: the AND of a gram's
three cells is the mask of all languages that contain the gram. The bits of a text's masks are counted per
language, and counts are corrected for the filter's false positives: with f the share of grams that a
language's slice would accept by chance, (count - f * grams) / (1 - f). The largest corrected count
decides (ties: the language with more training documents), and its share of the grams is the score.

A language contains a gram if the gram's rate in its training texts is at least `RATIO` times the highest rate in
any language. The model is learned from a bounded sample of labelled documents: about `per_language` documents of each
language, chosen by a hash of the id, whole texts, counted on the executors. At most `max_grams` grams (the
most frequent; those seen once in the sample tell nothing and are left out) reach the driver, so what is broadcast is fixed: CELLS * 8 bytes per 64 languages.

Edge cases. A null text or one without letters gives und and score 0. If nothing was learned, everything is und. A text
whose grams no language contains gets the language with most training documents and score 0. A null doc_id
is not held out. Very long texts are read whole, in slices that overlap by a gram. Repeated rows get the same result each. Columns named
lang_pred or score in the input give way to the results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import materialise, with_columns

CELLS = 1 << 20
RATIO = 0.5
SIZES = (3, 4)
#: Characters that are looked at together, to bound memory.
SLICE = 1 << 19


@cache
def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, or a space."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        if (c := chr(i)).isalpha():
            out[i] = ord(c.lower()[0])
    return out


def _codes(text: str) -> np.ndarray:
    """Letters of a text with single spaces between words and around it; empty if there are none."""
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    blank = codes == 32
    if blank.all():
        return codes[:0]
    codes = codes[~(blank & np.concatenate(([True], blank[:-1])))]
    return np.concatenate(([32], codes, [32])) if codes[-1] != 32 else np.concatenate(([32], codes))


def _hashes(codes: np.ndarray, n: int) -> np.ndarray:
    h = np.full(len(codes) - n + 1, n, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x100000001B3) + codes[i : len(codes) - n + 1 + i].astype(np.uint64)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices of about SLICE characters: the hashes of all grams, and the number of the text each is from. No gram spans two texts."""
    held: list[tuple[int, np.ndarray]] = []
    n = 0

    def out() -> tuple[np.ndarray, np.ndarray]:
        codes, of = np.concatenate([c for _, c in held]), np.concatenate([np.full(len(c), i, np.int32) for i, c in held])
        h, o = [], []
        for k in SIZES:
            if len(codes) >= k:
                same = of[: len(of) - k + 1] == of[k - 1 :]
                h.append(_hashes(codes, k)[same])
                o.append(of[: len(of) - k + 1][same])
        return (np.concatenate(h), np.concatenate(o)) if h else (np.zeros(0, np.uint64), np.zeros(0, np.int32))

    for i, text in enumerate(texts):
        codes = _codes(text)
        if len(codes) > SLICE:  # a slice starts with what the last gram of the one before began with; 3-grams there are seen once
            for a in range(0, len(codes), SLICE):
                h, o = [], []
                for k in SIZES:
                    part = codes[a : a + SLICE + k - 1]
                    if len(part) >= k:
                        h.append(_hashes(part, k))
                        o.append(np.full(len(part) - k + 1, i, np.int32))
                if h:
                    yield np.concatenate(h), np.concatenate(o)
            continue
        held.append((i, codes))
        n += len(codes)
        if n > SLICE:
            yield out()
            held, n = [], 0
    if held:
        yield out()


def _cells(h: np.ndarray) -> tuple[np.ndarray, ...]:
    m = np.uint64(CELLS - 1)
    return (h & m).astype(np.int64), ((h >> np.uint64(20)) & m).astype(np.int64), ((h >> np.uint64(40)) & m).astype(np.int64)


class Model:
    """langs: by falling number of training documents. table: CELLS x words of 64 languages."""

    def __init__(self, langs: list[str], grams: np.ndarray, lang_of: np.ndarray):
        self.langs = langs
        self.table = np.zeros((CELLS, max(1, -(-len(langs) // 64))), np.uint64)
        for cell in _cells(grams.view(np.uint64)):
            np.bitwise_or.at(self.table, (cell, lang_of // 64), np.uint64(1) << (lang_of % 64).astype(np.uint64))
        self.chance = np.array([((self.table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() ** 3 for i in range(len(langs))])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        counts, total = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for h, of in _grams([x or "" for x in texts]):
            a, b, c = _cells(h)
            masks = self.table[a] & self.table[b] & self.table[c]
            total += np.bincount(of, minlength=len(texts))
            for i in range(len(self.langs)):
                hit = ((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).astype(bool)
                counts[:, i] += np.bincount(of[hit], minlength=len(texts))
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        true = np.maximum(0, counts - self.chance * total[:, None]) / (1 - self.chance)
        best = true.argmax(1)
        score = np.minimum(1, true[np.arange(len(texts)), best] / np.maximum(total, 1))
        return [self.langs[i] if n else "und" for i, n in zip(best, total)], [float(s) if n else 0.0 for s, n in zip(score, total)]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            for h, _ in _grams([x for x in texts if x]):
                grams, n = np.unique(h, return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": grams.view(np.int64), "n": n})


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 2000, max_grams: int = 400_000) -> Model:
    """A model of labelled's languages; rows without a language, a text or an id are passed over."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    docs = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(docs, key=lambda x: (-docs[x], x))
    if not langs:
        return Model([], np.zeros(0, np.int64), np.zeros(0, np.int64))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_language / docs[k]))])
    sample = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30)).select("lang", "text")
    counts = materialise(sample.mapInPandas(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    total = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    rate = F.col("n") / F.element_at(F.create_map(*[F.lit(x) for k, v in (total or {langs[0]: 1}).items() for x in (k, float(v))]), F.col("lang"))
    # a gram has at most as many rows as there are languages
    by_gram = counts.filter("n > 1").withColumn("rate", rate).groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("lang", "rate")).alias("in"))
    kept = by_gram.orderBy(F.desc("top"), "gram").limit(max_grams).select("gram", F.transform(F.filter("in", lambda x: x["rate"] >= RATIO * F.col("top")), lambda x: x["lang"]).alias("langs"))
    got = kept.select("gram", F.explode("langs").alias("lang")).toPandas()
    return Model(langs, got["gram"].to_numpy(np.int64), got["lang"].map({k: i for i, k in enumerate(langs)}).to_numpy(np.int64))


def predictor(spark, model: Model):
    """A pandas UDF: text -> struct(lang, score)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(StructType([StructField("lang", StringType()), StructField("score", DoubleType())]))
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            lang, score = shared.value.predict([x if isinstance(x, str) else None for x in batch])
            yield pd.DataFrame({"lang": lang, "score": score})

    return predict


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    found = predictor(docs.sparkSession, model)(F.col(text_col))
    return docs.select(*with_columns(docs, {"lang_pred": found["lang"], "score": found["score"]}))


def train_on_documents(docs: DataFrame) -> Model:
    return train(docs.filter(~held_out("doc_id")))


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs.select("doc_id", "text"), train_on_documents(docs))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
