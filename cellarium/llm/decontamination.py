"""Benchmark decontamination by spaced-seed hashing (operator 4).

Benchmark items and documents become lower-case words. A fixed mask names the word positions that a seed looks
at and those that it ignores; the seeds of all items under all masks form a sorted table that every
document's seeds are joined with. A hit gives an item and a diagonal, on which the two texts are compared word by word: the
longest stretch in which at least `identity` of the words match is the overlap. It counts if it has at least `min_words` matches, or `identity` of an item too
short for that (at least `least` words).

A benchmark of up to `block_words` words (an item counts as one more, 16 letters as one at least) is one block: its table is broadcast, and documents are scanned in place. A
larger one, of any size, is joined by a shuffle (`_joined`): the seeds of its items are a written table; a Bloom filter over them, of fixed
size, is broadcast; one scan of the documents gives the seeds that pass the filter, which meet the table by hash. A text's seeds
spread over all hashes, so long texts and copies are no hot key; a seed that many items have (a common phrase) is joined by
adaptive execution in parts. Only documents with a hit and their items move, to be compared by the same code as a block's. Both ways give the same rows.

Edge cases. A null or empty text has no overlap; null or empty items, and items of under `least` words, match
nothing (`unchecked` lists them). Items that are equal are reported each. Very long texts are compared whole. Rows that repeat are reported each, as often
as they repeat. Columns of the input beside id and text are not read, so their names may clash with the results'.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import drop_rows, materialise, small_batches, text_of
from .tokens import SeedIndex, Vocabulary, seed_hashes, words

#: 1: the word counts, 0: it is ignored. Substitutions at every fifth word, the densest that the default identity lets through, leave a seed of each of them in items of over SHORT words.
MASKS = ("11111", "1111011", "1101101", "110010011")
#: Items of up to so many words have masks of their own besides, for the overlaps that leave no seed of those.
SHORT = 10
HIT = ArrayType(StructType([StructField(n, IntegerType()) for n in ("item", "doc_start", "item_start", "n_words", "n_matched")]))


def best_stretch(match: np.ndarray, identity: float) -> tuple[int, int]:
    """Start and end of the longest stretch with at least that share of matches, without mismatches at its ends."""
    sums = np.concatenate(([0.0], np.cumsum(np.where(match, 1 - identity, -identity)))) + np.arange(len(match) + 1) * 1e-12
    low, high = np.minimum.accumulate(sums), np.maximum.accumulate(sums[::-1])[::-1]
    i = j = at = 0
    length = -1
    while i < len(sums) and j < len(sums):
        if low[i] <= high[j]:
            if j - i > length:
                length, at = j - i, i
            j += 1
        else:
            i += 1
    start = int(np.argmin(sums[: at + 1]))
    end = len(sums) - 1 - int(np.argmax((sums >= sums[start])[::-1]))
    inside = np.flatnonzero(match[start:end])
    return (start + int(inside[0]), start + int(inside[-1]) + 1) if len(inside) else (0, 0)


def short_masks(n: int, need: int, identity: float) -> set[tuple[int, ...]]:
    """The patterns of matches, from match to match, of overlaps of at most n words that count, without those that hold another."""
    out: list[set[int]] = []
    for k in range(need, n + 1):
        for width in range(k, n + 1):
            ends = {0, width - 1}
            if k < identity * width - 1e-9 or k < len(ends):
                continue
            for inner in combinations(range(1, width - 1), k - len(ends)):
                mask = ends.union(inner)
                if not any({x + at for x in held} <= mask for held in out for at in range(width - max(held))):
                    out.append(mask)
    return {tuple(sorted(m)) for m in out}


_FIXED = [tuple(i for i, c in enumerate(m) if c == "1") for m in MASKS]


def needed(n: int, min_words: int, least: int, identity: float) -> int:
    """Matches that an overlap with an item of n words has at least."""
    return max(least, min(min_words, int(np.ceil(identity * n))))


@cache
def masks_of(n: int, min_words: int, least: int, identity: float) -> tuple[tuple[int, ...], ...]:
    """Masks of items of n words: the fixed ones and, for short items, those of all overlaps that count."""
    if n < least:
        return ()
    own = short_masks(n, needed(n, min_words, least, identity), identity) if n <= SHORT else set()
    return tuple(sorted({*_FIXED, *own}))


class Block:
    """The seeds of some benchmark items."""

    def __init__(self, texts: list[str | None], min_words: int, least: int, identity: float):
        self.identity = identity
        items = [words(t or "") for t in texts]
        self.vocabulary = Vocabulary(items)
        self.items = [self.vocabulary.of(w) for w in items]
        self.need = [needed(len(w), min_words, least, identity) for w in items]
        masks = [masks_of(len(w), min_words, least, identity) for w in items]
        self.index = []
        for mask in sorted({m for ms in masks for m in ms}):
            found = [(i, *seed_hashes(ids, mask)) for i, ids in enumerate(self.items) if mask in masks[i]]
            if found:
                self.index.append((mask, SeedIndex(np.concatenate([h for _, _, h in found]), np.concatenate([np.full(len(at), i) for i, at, _ in found]), np.concatenate([at for _, at, _ in found]))))

    def overlaps(self, text: str | None) -> list[dict]:
        """The longest overlap with each item that has one."""
        ids = self.vocabulary.of(words(text or ""))
        diagonals: set[tuple[int, int]] = set()
        for mask, index in self.index:
            at, item, there = index.hits(*seed_hashes(ids, mask))
            diagonals.update(zip(item.tolist(), (at - there).tolist()))
        best: dict[int, dict] = {}
        for i, d in sorted(diagonals):
            found = compare(self.items[i], ids, d, self.identity)
            if found["n_matched"] >= self.need[i] and found["n_matched"] > best.get(i, {"n_matched": 0})["n_matched"]:
                best[i] = {"item": i, **found}
        return list(best.values())


def compare(item: np.ndarray, doc: np.ndarray, d: int, identity: float) -> dict:
    """The overlap of an item and a document on a diagonal (document minus item position)."""
    a, b = max(0, -d), min(len(item), len(doc) - d)
    match = item[a:b] == doc[a + d : b + d]
    start, end = best_stretch(match, identity)
    return {"doc_start": a + d + start, "item_start": a + start, "n_words": end - start, "n_matched": int(match[start:end].sum())}


def _scanned(docs: DataFrame, items: list, text_col: str, settings: tuple) -> Column:
    """Hits of one block."""
    shared = docs.sparkSession.sparkContext.broadcast(Block([t for _, t in items], *settings))

    @F.pandas_udf(HIT)
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([shared.value.overlaps(x) for x in batch])

    return scan(F.col(text_col))


# --- benchmarks of more than a block -------------------------------------------------------------------------------

#: Bits of the Bloom filter, and the pieces that it is summed in.
BITS, _PIECES = 1 << 27, 64


def _word_ids(text: str | None) -> np.ndarray:
    """Ids of words that need no vocabulary: hashes above 0."""
    return np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) >> 1 | 1 for w in words(text or "")], np.int64)


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(BITS - 1)).astype(np.int64), (h >> np.uint64(32) & np.uint64(BITS - 1)).astype(np.int64)


def _item_seeds(settings: tuple):
    def seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item, text in zip(batch["item"], batch["text"]):
                ids = _word_ids(text)
                for mask in masks_of(len(ids), *settings):
                    at, h = seed_hashes(ids, mask)
                    yield pd.DataFrame({"h": h.view(np.int64), "item": item, "there": at.astype(np.int32)})

    return seeds


def _bloom(seeds: DataFrame) -> np.ndarray:
    """Packed bits of all seeds' hashes: each task sends the pieces of its own filter, which are united piece by piece."""

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(BITS, bool)
        for batch in batches:
            for at in _bits(batch["h"].to_numpy(np.int64).view(np.uint64)):
                bits[at] = True
        for k, piece in enumerate(np.packbits(bits).reshape(_PIECES, -1)):
            if piece.any():
                yield pd.DataFrame({"piece": [k], "bits": [piece.tobytes()]})

    def unite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, bits in zip(batch["piece"], batch["bits"]):
                held[k] = held.get(k, 0) | np.frombuffer(bits, np.uint8)
        for k, bits in held.items():
            yield pd.DataFrame({"piece": [k], "bits": [bits.tobytes()]})

    out = np.zeros((_PIECES, BITS // 8 // _PIECES), np.uint8)
    for r in seeds.select("h").mapInPandas(own, "piece int, bits binary").repartition(_PIECES, "piece").mapInPandas(unite, "piece int, bits binary").collect():
        out[r["piece"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def _joined(rows: DataFrame, items: DataFrame, settings: tuple) -> DataFrame:
    """item and overlap for each written row (row, text) of documents with one. items: item, text."""
    spark, identity = rows.sparkSession, settings[2]
    seeds = materialise(items.mapInPandas(_item_seeds(settings), "h long, item long, there int"), "seeds")
    bloom = spark.sparkContext.broadcast(_bloom(seeds))
    every = sorted({m for n in range(settings[1], SHORT + 1) for m in masks_of(n, *settings)} | set(_FIXED))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = bloom.value
        for batch in batches:
            for row, text in zip(batch["row"], batch["text"]):
                ids = _word_ids(text)
                for mask in every:
                    at, h = seed_hashes(ids, mask)
                    ok = np.ones(len(h), bool)
                    for b in _bits(h):
                        ok &= (bits[b >> 3] >> (7 - (b & 7)) & 1).astype(bool)
                    if ok.any():
                        yield pd.DataFrame({"row": row, "h": h[ok].view(np.int64), "at": at[ok].astype(np.int32)})

    with small_batches(spark):
        asked = materialise(rows.select("row", "text").mapInPandas(look, "row long, h long, at int"), "asked")
    hits = asked.join(seeds, "h").select("row", "item", (F.col("at") - F.col("there")).alias("d")).distinct()
    hits = materialise(hits, "hits")
    docs = rows.select("row", "text").join(hits.select("row").distinct(), "row", "left_semi")
    pairs = hits.join(docs, "row").join(items.withColumnRenamed("text", "item_text"), "item")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, item, d, text, item_text in zip(batch["row"], batch["item"], batch["d"], batch["text"], batch["item_text"]):
                known = _word_ids(item_text)
                found = compare(known, _word_ids(text), int(d), identity)
                if found["n_matched"] >= needed(len(known), *settings):
                    out.append({"row": row, "item": item, **found})
            if out:
                yield pd.DataFrame(out)

    with small_batches(spark):
        met = materialise(pairs.mapInPandas(verify, "row long, item long, doc_start int, item_start int, n_words int, n_matched int"), "overlaps")
    # as in a block, the most matches, then the least diagonal
    rank = F.struct(F.col("n_matched"), (F.col("item_start") - F.col("doc_start")).alias("d"), "doc_start", "item_start", "n_words")
    return met.groupBy("row", "item").agg(F.max(rank).alias("hit")).select("row", "item", "hit.doc_start", "hit.item_start", "hit.n_words", "hit.n_matched")


_OUT = ("doc_start", "item_start", "n_words", "n_matched")


def _large(benchmark: DataFrame, item_text: str, block_words: int) -> bool:
    """Whether a benchmark is more than one block. Every item counts as a word more, and 16 letters as a word at least, so a block's rows and letters are bounded as well."""
    text = text_of(item_text)
    return (benchmark.agg(F.sum(F.greatest(F.regexp_count(text, F.lit(r"(?U)\w+")), F.length(text) / 16) + 1)).first()[0] or 0) > block_words


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", min_words: int = 13, least: int = 5, identity: float = 0.8, block_words: int = 1_000_000
) -> DataFrame:
    """A row for each document and item that overlap: doc_id, item_id, doc_start and item_start (in words), n_words, n_matched."""
    spark, settings = docs.sparkSession, (min_words, least, identity)
    kind = {f.name: f.dataType for f in benchmark.schema}[item_id]
    if _large(benchmark, item_text, block_words):
        items = materialise(benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), text_of(item_text).alias("text")), "items")
        rows = materialise(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")), "rows")
        found = _joined(rows, items.select("item", "text"), settings)
        return found.join(rows.select("row", "doc_id"), "row").join(items.select("item", "item_id"), "item").select("doc_id", "item_id", *_OUT)
    items = benchmark.select(F.col(item_id), F.col(item_text)).collect()  # at most block_words words
    found = docs.select(F.col(id_col).alias("doc_id"), F.explode(_scanned(docs, items, text_col, settings)).alias("hit"))
    numbered = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(items)], StructType([StructField("item", IntegerType()), StructField("item_id", kind)]))
    return found.select("doc_id", "hit.*").join(F.broadcast(numbered), "item").select("doc_id", "item_id", *_OUT)


def unchecked(benchmark: DataFrame, item_text: str = "text", least: int = 5) -> DataFrame:
    """The items that are too short to be looked for."""
    n = F.udf(lambda t: len(words(t or "")), "int")
    return benchmark.filter(n(F.col(item_text)) < least)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", min_words: int = 13, least: int = 5, identity: float = 0.8, block_words: int = 1_000_000
) -> DataFrame:
    """The rows of docs that overlap with no item. With one block a filter, without a shuffle."""
    settings = (min_words, least, identity)
    if not _large(benchmark, item_text, block_words):
        return docs.filter(F.size(_scanned(docs, benchmark.select(F.col(item_id), F.col(item_text)).collect(), text_col, settings)) == 0)
    text = F.xxhash64(text_of(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("digest"), text_of(text_col).alias("text"))
    # equal texts of one id have one fate
    rows = materialise(rows.dropDuplicates(["doc_id", "digest"]).withColumn("row", F.monotonically_increasing_id()), "rows")
    items = materialise(benchmark.select(F.monotonically_increasing_id().alias("item"), text_of(item_text).alias("text")), "items")
    lost = _joined(rows, items, settings).select("row").distinct()
    return drop_rows(docs, rows.join(lost, "row", "left_semi").select("doc_id", "digest", F.lit(False).alias("kept")), id_col, text)


def op4(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
