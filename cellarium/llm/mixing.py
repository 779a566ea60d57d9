"""Mixing sources to target weights (operator 2).

Packing. Each source's documents, in a hashed order, form one stream of words, cut into blocks of `block` words
(the last block may be shorter). Where a document starts in its stream comes from a prefix sum in two
steps: about sqrt(documents) hashed buckets per source, sums of the buckets, then rows within a bucket. So
a source with a third of all rows is never one task.

Targets. Sources in code point order (null last) weigh 5, 2, 1, repeating; `share` times all words are split by
weight. A target stops at `most` times its source's words, and the excess is shared again by weight until
none is above: each round needs only two sums over the table of sources.

Draws. A target is a number of slots, each for one block; the mix has as many slots as all sources together, in shards of
`shard_slots`. Every slot draws its source by a seeded hash, in proportion to the sources' slots: each shard's source counts are a
multinomial draw. Over all shards such draws miss the targets of small sources by their own noise, and could take a document
more than `most` times, so they are corrected: a source drawn too often gives up the slots beyond its number (last
in an order of shards hashed for each source), and these go, shard by shard, to the sources that were drawn too seldom. In the table of
counts (shard, source, n) that is left, every source has exactly its slots, and a shard differs from its draw only by
its part of the correction. The table gives each shard a range of its sources' slots, and everything below comes from it.

Slots. Slot j of a source takes, in pass j div n over the source's n blocks, the block at a pseudorandom permutation of
j mod n (a short last block closes each pass). The last slot of a source takes as many words of its block as the target still wants.
Blocks and slots are joined by source and block index, which spreads a hot source.

All hashes are seeded, so reruns agree. Edge cases. A null text has no words; documents without words are
returned and nothing is taken from them; null is a source of its own; rows that repeat are separate documents. Very long texts reach over many
blocks. An empty table gives an empty result. Only id, text and source of the input are read, so other columns may clash with results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_WS, materialise, permuted, small, text_of

#: Slots, or draws, per task.
PER_TASK = 1 << 18
#: Parts of equal length that all slots are cut into to look up which source a draw hits.
CELLS = 1 << 14


def _ranked(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """df with __rank and __before: the number of rows before a row in a total order, and the sum of value over them. Range partitions are summed first, then rows in each."""
    spark = df.sparkSession
    n = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() / 1000)))
    df = materialise(df.withColumn("__value", value).repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), name)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = df.groupBy("__part").agg(F.count(F.lit(1)).alias("rows"), F.sum("__value").alias("sum"))
    parts = parts.select("__part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("r0"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("v0"))
    own = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = df.join(F.broadcast(parts), "__part")  # one row for each of at most n partitions
    rank, total = F.col("r0") + F.coalesce(F.count(F.lit(1)).over(own), F.lit(0)), F.col("v0") + F.coalesce(F.sum("__value").over(own), F.lit(0))
    return ranked.withColumns({"__rank": rank, "__before": total}).drop("__part", "__value", "r0", "v0")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """A written row per document: __row, doc_id, __key (its source), size and, if kept, its text."""
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit(""))
    size = F.regexp_count(text_of(text_col), F.lit(NOT_WS)).cast("long")
    text = {"text": text_of(text_col)}
    return materialise(docs.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col).alias("doc_id"), key.alias("__key"), size.alias("size"), *[text[k].alias("__" + k) for k in keep]), "sizes")


def packed(rows: DataFrame) -> DataFrame:
    """A row per row of `sized`: __row, doc_id, __key, size, and where it starts in its source's stream."""
    rows = rows.select("__row", "doc_id", "__key", "size")
    buckets = max(1, math.isqrt(rows.count()))
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets)))
    sums = rows.groupBy("__key", "__bucket").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("__key").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__key", "__bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__base"))
    own = Window.partitionBy("__key", "__bucket").orderBy("doc_id", "size", "__row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.coalesce(F.sum("size").over(own), F.lit(0)))
    return materialise(rows.join(sums, ["__key", "__bucket"]).select("__row", "doc_id", "__key", "size", (F.col("__base") + F.col("__in")).alias("start")), "packed")


def source_targets(rows: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """A row per source: __key, source_size, weight, target."""
    sources = rows.groupBy("__key").agg(F.sum("size").alias("source_size"))
    sources = _ranked(sources, [F.col("__key") == "", F.col("__key")], F.lit(0), "sources").drop("__before")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__rank") % len(weights)).cast("int") + 1)
    sources = materialise(sources.select("__key", "source_size", weight.alias("weight")), "weights")
    cap, level, last = F.col("source_size") * most, 0.0, -1.0
    budget = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    while level > last:  # the level rises until no further source is above its cap
        full = cap <= F.col("weight") * level if level else F.lit(False)
        held, open_weight = sources.agg(F.sum(F.when(full, cap).otherwise(0)), F.sum(F.when(~full, F.col("weight")))).first()
        last, level = level, max(level, (budget - held) / open_weight) if open_weight else level
    return sources.withColumn("target", F.least(cap.cast("double"), F.col("weight") * level))


def draws(sources: DataFrame, total: int, shard_slots: int, seed: int) -> DataFrame:
    """shard, __key, n: how many slots of each shard drew each source. sources: __key, slots and __before, their running sum; total: of all slots."""
    width = max(1, -(-total // CELLS))
    end = F.col("__before") + F.col("slots")
    # the sources' intervals of slots by the cells that they reach into: at most CELLS rows and two for each source
    cells = sources.filter("slots > 0").select(F.col("__key"), F.col("__before").alias("low"), end.alias("high"), F.explode(F.sequence(F.expr(f"__before div {width}"), F.expr(f"(__before + slots - 1) div {width}"))).alias("cell"))
    cells = materialise(cells, "cells")
    each = sources.sparkSession.range(0, total, 1, max(1, -(-total // PER_TASK))).select(F.expr(f"id div {shard_slots}").alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id", F.lit("draw")), F.lit(total)).alias("at"))
    met = each.withColumn("cell", F.expr(f"at div {width}")).join(small(cells), "cell").filter((F.col("at") >= F.col("low")) & (F.col("at") < F.col("high")))
    return met.groupBy("shard", "__key").agg(F.count(F.lit(1)).alias("n"))


def _summed(df: DataFrame, keys: list[str], order: list[Column], value: str, buckets: int, spread: Column, name: str) -> DataFrame:
    """df with name: the sum of value over a key's rows before a row, ordered by bucket (spread modulo buckets) and order. In two steps, so no task holds all rows of a key."""
    df = df.withColumn("__bucket", F.pmod(spread, F.lit(buckets)))
    sums = df.groupBy(*keys, "__bucket").agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "__bucket", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"))
    own = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(own), F.lit(0))).join(sums, [*keys, "__bucket"]).withColumn(name, F.col(name) + F.col("__base")).drop("__bucket", "__base")


def shard_counts(drawn: DataFrame, sources: DataFrame, total: int, shard_slots: int, seed: int) -> DataFrame:
    """shard, __key, n (slots of a source in a shard) and first (the source's slots in earlier ranges): the draws, corrected so that every source has exactly its slots."""
    buckets = max(1, math.isqrt(-(-total // shard_slots)))
    drawn = materialise(drawn, "draws").join(small(sources.select("__key", "slots")), "__key")
    ranged = _summed(drawn, ["__key"], ["shard"], "n", buckets, F.xxhash64(F.lit(seed), "__key", "shard"), "first")
    ranged = materialise(ranged.withColumn("kept", F.greatest(F.lit(0), F.least("n", F.col("slots") - F.col("first")))), "trimmed")
    # what sources give up, by shard, and what others lack: two cuts of one line, laid over each other
    free = ranged.groupBy("shard").agg(F.sum(F.col("n") - F.col("kept")).alias("free")).filter("free > 0")
    have = ranged.groupBy("__key").agg(F.sum("kept").alias("have"))
    lack = sources.filter("slots > 0").join(have, "__key", "left").select("__key", F.coalesce("have", F.lit(0)).alias("have"), (F.col("slots") - F.coalesce("have", F.lit(0))).alias("lack")).filter("lack > 0")
    free = materialise(_ranked(free, [F.col("shard")], F.col("free"), "free").select("shard", F.col("__before").alias("a"), (F.col("__before") + F.col("free")).alias("b")), "free-slots")
    lack = materialise(_ranked(lack, [F.col("__key")], F.col("lack"), "lack").select("__key", "have", F.col("__before").alias("c"), (F.col("__before") + F.col("lack")).alias("d")), "lacking")
    width = max(1, (free.agg(F.max("b")).first()[0] or 0) // CELLS)
    cut = lambda low, high: F.explode(F.sequence(F.expr(f"{low} div {width}"), F.expr(f"({high} - 1) div {width}")))
    over = free.withColumn("cell", cut("a", "b")).join(lack.withColumn("cell", cut("c", "d")), "cell").filter("a < d and c < b")
    # an overlap that reaches over several cells counts in its first
    over = over.withColumns({"low": F.greatest("a", "c"), "high": F.least("b", "d")}).filter(f"low div {width} = cell")
    given = over.select("shard", "__key", (F.col("high") - F.col("low")).alias("n"), (F.col("have") + F.col("low") - F.col("c")).alias("first"))
    return ranged.filter("kept > 0").select("shard", "__key", F.col("kept").alias("n"), "first").unionByName(given)


def slots(sources: DataFrame, block: int, shard_slots: int, seed: int) -> DataFrame:
    """A written row per block that the mix takes: __key, index (of the block), take (its words), shard and slot."""
    size, words = F.col("source_size"), F.round("target").cast("long")
    sources = sources.filter("source_size > 0").withColumns({"blocks": F.ceil(size / block), "words": words})
    sources = sources.withColumn("slots", F.expr("words div source_size * blocks") + F.ceil((F.col("words") % size) / block))
    sources = materialise(_ranked(sources, [F.col("__key")], F.col("slots"), "slots"), "slots-by-source")
    total = sources.agg(F.sum("slots")).first()[0] or 0
    counts = materialise(shard_counts(draws(sources, total, shard_slots, seed), sources, total, shard_slots, seed), "shard-counts")
    by_shard = Window.partitionBy("shard").orderBy("__key", "first").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"__at": F.coalesce(F.sum("n").over(by_shard), F.lit(0)), "__all": F.sum("n").over(Window.partitionBy("shard"))})
    # a row is at most a shard's slots; the number of tasks is given, or few bytes would make one task of them
    each = counts.repartition(max(1, -(-total // PER_TASK), min(64, -(-total // 1024))), "shard", "__key", "first").withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    each = each.join(small(sources.select("__key", "source_size", "blocks", "words")), "__key").withColumn("j", F.col("first") + F.col("__i"))
    each = each.withColumns({"pass": F.expr("j div blocks"), "rank": F.expr("j % blocks")})
    last = F.col("rank") == F.col("blocks") - 1
    index = F.when(last, F.col("rank")).otherwise(permuted(F.col("rank"), F.col("blocks") - 1, F.lit(seed), F.col("__key"), F.col("pass")))
    left = F.col("words") - F.col("pass") * size - F.col("rank") * block
    place = permuted(F.col("__at") + F.col("__i"), F.col("__all"), F.lit(seed), F.col("shard"), rounds=12)
    each = each.withColumns({"index": index, "slot": place})
    return materialise(each.select("__key", "index", F.least(F.lit(block), size - F.col("index") * block, left).alias("take"), "shard", "slot"), "slots")


def pieces(rows: DataFrame, block: int) -> DataFrame:
    """A row per document and block that it reaches into: index, offset (in the block), from (word of the document) and n. A document without words has one row with a null index."""
    first, last = F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")
    rows = rows.withColumn("index", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    begin, end = F.greatest(F.col("start"), F.col("index") * block), F.least(F.col("start") + F.col("size"), (F.col("index") + 1) * block)
    return rows.withColumns({"offset": begin - F.col("index") * block, "from": begin - F.col("start"), "n": end - begin})


def _placed(rows: DataFrame, weights: tuple[int, ...], share: float, most: int, block: int, shard_slots: int, seed: int) -> DataFrame:
    """A row per document and slot that takes words of it (at least one row per document): its columns, from, n, shard, slot, at (the first word's place in the slot)."""
    rows = packed(rows)
    sources = materialise(source_targets(rows, weights, share, most), "targets")
    drawn = slots(sources, block, shard_slots, seed)
    rows = rows.join(small(sources.select("__key", "source_size", "target")), "__key")
    met = pieces(rows, block).join(drawn, ["__key", "index"], "left")
    words = F.when(F.col("take") > F.col("offset"), F.least(F.col("n"), F.col("take") - F.col("offset"))).otherwise(0)
    return met.withColumns({"n": words, "at": F.col("offset")})


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, block: int = 1024, shard_slots: int = 4096, seed: int = 1
) -> DataFrame:
    """A row per document: doc_id, size, source_size, target (of its source), taken (words the mix takes, repeats counted)."""
    met = _placed(sized(docs, id_col, text_col, source_col), weights, share, most, block, shard_slots, seed)
    return met.groupBy("__row", "doc_id", "size", "source_size", "target").agg(F.sum("n").alias("taken")).drop("__row")


def mix_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, block: int = 1024, shard_slots: int = 4096, seed: int = 1
) -> DataFrame:
    """The rows of `mix` and the mixed text itself, with source and mixed: an array of (shard, slot, at, text), the words that each slot takes of the document, joined by one space. A shard's text is that of its pieces in the order of slot and at. Texts move once."""
    rows = sized(docs, id_col, text_col, source_col, ("text",))
    met = _placed(rows, weights, share, most, block, shard_slots, seed)
    piece = F.when(F.col("n") > 0, F.struct("shard", "slot", "at", F.col("from").alias("from"), "n"))
    met = met.groupBy("__row", "doc_id", "__key", "size", "source_size", "target").agg(F.sum("n").alias("taken"), F.collect_list(piece).alias("__pieces"))
    texts = rows.select("__row", F.col("__text"))
    both = texts.join(met.hint("shuffle_hash"), "__row").withColumn("__words", F.regexp_extract_all("__text", F.lit(f"({NOT_WS})"), F.lit(1)))
    mixed = F.transform(F.sort_array("__pieces"), lambda p: F.struct(p["shard"].alias("shard"), p["slot"].alias("slot"), p["at"].alias("at"), F.array_join(F.slice(F.col("__words"), (p["from"] + 1).cast("int"), p["n"].cast("int")), " ").alias("text")))
    return both.select("doc_id", F.when(F.col("__key") != "", F.expr("substring(__key, 2)")).alias("source"), "size", "source_size", "target", "taken", mixed.alias("mixed"))


def mix_text(docs: DataFrame, **settings) -> DataFrame:
    """The mix by slots: shard, slot, source, n_words, text, doc_ids. settings: those of `mix_documents`."""
    each = mix_documents(docs, **settings).select("doc_id", "source", F.explode("mixed").alias("m"))
    whole = each.groupBy("m.shard", "m.slot").agg(F.first("source").alias("source"), F.sort_array(F.collect_list(F.struct("m.at", "m.text", "doc_id"))).alias("p"))
    text = F.array_join("p.text", " ")
    return whole.select("shard", "slot", "source", F.size(F.split(text, " ")).cast("long").alias("n_words"), text.alias("text"), F.col("p.doc_id").alias("doc_ids"))


def op2(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
