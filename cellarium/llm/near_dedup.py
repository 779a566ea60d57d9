"""Near-duplicate documents by improved consistent weighted sampling (operator 7).

Texts become lower-case words and shingles of five (a shorter text is one shingle). A shingle weighs its count in
the text times its IDF. The signature has BANDS * ROWS samples; texts that agree in all samples of a band share a bucket. At a
similarity of 0.8, a pair shares one of the 12 buckets of 3 with a probability of 0.9998.

IDF. How many documents hold a shingle is estimated for all documents by a count-min sketch of fixed size, less the sketch's mean
(its noise): 4 MB whatever the corpus. A shingle in under `RARE` of the documents weighs 1. For the frequent ones a second pass counts
again, without the documents of which frequent shingles (repeats counted) are more than half: these are copies of frequent texts (a group of
copies may hold a third of all rows), and a group must not lower the weight of what its own members share. What is left are
passages that documents of different content share, and from RARE to all documents their weight falls with log-frequency from 1
to FLOOR, which is above 0 only so that every text has some weight.

Sampling. The variates of a shingle come from a table of 2^15 rows by the shingle's hash; the sample is the shingle's
whole hash and its quantised weight. For weight 1 the quantised weight is 0 and the score is a constant of the table.

Links. Documents with the same shingles and counts are one text. In a bucket, the most central text leads: that whose
buckets hold most texts, in a group of near copies the original or what is closest to it. The others are verified against
it by their exact weighted Jaccard similarity, never all pairs; ROUNDS more leaders follow, each the most central of the texts
that no leader is similar to. Two exact bounds spare comparisons: total weights that differ by more than the threshold, and
distances from the first leader that do (1 - similarity is a metric). What these links join is a class for now, and only links between
classes are still sought, exactly: a text is open in a bucket if it is not of the first leader's class.
Buckets of up to SMALL texts compare their open texts with all of other classes. In larger ones `_items` writes every text as its difference from
the leader (what it lacks and what it adds), and `_bounded` joins texts on rare shared items: a pair can only be similar if
it shares more of its differences than a bound, so items that no other text has, and texts with too little to
share, drop out, and the rest need only meet on rare items before which enough is left (prefix and positional filtering). No link
between texts that share a bucket is lost, up to those within what other links join.

Classes are connected components. Everything is in tables in the shared folder; texts move once (those that share a bucket),
then only those of pairs. Edge cases. Texts without words (null, empty) are each a class of their own. Repeated rows fall into one class,
of which exactly one row stays: that with the smallest doc_id (null last). Very long texts are read whole. Empty tables give empty results.
Columns of the input beside id and text are not read, so their names may clash with the results'.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_rows, materialise, small_batches, text_of
from .graph import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 12, 3
#: Leaders per bucket after the first, see above.
ROUNDS = 1
#: Texts of a bucket up to which open texts are compared with all of it.
SMALL = 8
#: Texts farther than FAR from a leader are written as a whole, those up to FAR + 1 - threshold as their differences, those between in both ways: so similar texts always meet in one of them.
FAR = 0.4
RARE, FLOOR = 1e-2, 0.01
SKETCH = 1 << 18
_U = np.uint64
_ODD = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


@cache
def _word_letters() -> np.ndarray:
    """Whether a code point stands in words, as in tokens.WORD."""
    return np.array([(c := chr(i)).isalnum() or c == "_" for i in range(0x110000)])


#: Odd, so it has an inverse modulo 2^64. PART: code points that are looked at together, up to the end of a word.
_BASE, PART = _ODD[0], 1 << 16


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse."""
    base = int(_BASE)
    return tuple(np.cumprod(np.concatenate(([_U(1)], np.full((1 << bits) - 1, x, _U))), dtype=_U) for x in (base, pow(base, -1, 1 << 64)))


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's lower-case words in their order. A word's is the sum of its code points times powers of _BASE, taken from running sums over the text."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _word_letters()[codes]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    out, k = [np.zeros(0, _U)], 0
    while k < len(starts):
        first = starts[k]
        j = max(k + 1, int(np.searchsorted(ends, first + PART, "right")))
        a, b, part = starts[k:j] - first, ends[k:j] - first, codes[first : ends[j - 1]].astype(_U) + _U(1)
        power, inverse = _powers(max(12, len(part).bit_length()))
        sums = np.concatenate(([_U(0)], np.cumsum(part * power[: len(part)], dtype=_U)))
        out.append(_mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(_U) * _ODD[3]))
        k = j
    return np.concatenate(out)


def occurrences(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Hashes of a text's shingles in their order, repeats included."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, _U)
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * _ODD[i % 5]
        out ^= out >> _U(29)
    return _mix(out)


def shingles(text: str | None, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of a text's shingles, and how often each occurs."""
    return np.unique(occurrences(text, size), return_counts=True)


def _estimate(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.minimum(table[0][(h & _U(SKETCH - 1)).astype(np.int64)], table[1][((h >> _U(20)) & _U(SKETCH - 1)).astype(np.int64)])


class Frequent:
    """Which shingles at least RARE of the documents, and two of them, hold. counts: two rows of SKETCH counters."""

    def __init__(self, counts: np.ndarray, documents: int):
        self.documents, self.least = max(1, documents), max(1.0, RARE * documents)
        self.table = counts - counts.mean(1, keepdims=True) >= max(1.5, self.least)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        return _estimate(self.table, h)


class Idf:
    """counts: of frequent shingles, in documents that are no copies of frequent texts."""

    def __init__(self, frequent: Frequent, counts: np.ndarray):
        self.frequent, self.table = frequent, counts.astype(np.float32)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out, at = np.ones(len(h)), np.flatnonzero(self.frequent(h))
        if len(at):
            held, n = np.maximum(_estimate(self.table, h[at]), self.frequent.least), self.frequent.documents
            out[at] = np.clip(np.log(n / held) / np.log(n / self.frequent.least), FLOOR, 1) if n > 1 else 1
        return out


def weights(text: str | None, idf: Idf, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    h, n = shingles(text, size)
    return h, n * idf(h)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    same = a[0][at] == b[0]
    both = float(np.minimum(a[1][at[same]], b[1][same]).sum())
    return both / (float(a[1].sum() + b[1].sum()) - both)


#: Rows of the table of variates, a power of two.
VARIATES = 1 << 15


@cache
def _variates(samples: int) -> tuple[np.ndarray, ...]:
    g, shape = np.random.Generator(np.random.PCG64(20240229)), (VARIATES, samples)
    r, c = g.standard_gamma(2, shape, np.float32), g.standard_gamma(2, shape, np.float32)
    beta = g.random(shape, np.float32)
    np.log(c, out=c)
    return r, c, beta, c + r * beta - r


def band_keys(h: np.ndarray, w: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One key per band, of a text with at least one shingle."""
    r, log_c, beta, at_one = _variates(bands * rows)
    every = np.arange(bands * rows)
    least, sample = np.full(bands * rows, np.inf, np.float32), np.zeros(bands * rows, _U)
    for k in range(0, len(h), 1 << 14):
        hs, ws = h[k : k + (1 << 14)], w[k : k + (1 << 14)]
        row = (hs >> _U(40) & _U(VARIATES - 1)).astype(np.int64)
        score, other = at_one[row], np.flatnonzero(ws != 1)
        level = None
        if len(other):
            ro, bo = r[row[other]], beta[row[other]]
            level = np.floor(np.log(ws[other]).astype(np.float32)[:, None] / ro + bo)
            score[other] = log_c[row[other]] - ro * (level - bo) - ro
        best = score.argmin(0)
        value = score[best, every]
        got = hs[best]
        if level is not None:
            at = np.full(len(hs), -1)
            at[other] = np.arange(len(other))
            own = at[best]
            got = np.where(own >= 0, got ^ _mix(level[np.maximum(own, 0), every].astype(np.int64).astype(_U)), got)
        less = value < least
        least[less], sample[less] = value[less], got[less]
    key = np.arange(1, bands + 1).astype(_U) * _ODD[0]
    for i in range(rows):
        key = _mix((key ^ sample[i::rows]) * _ODD[1 + i % 4])
    return key.view(np.int64)


# --- passes over the texts -----------------------------------------------------------------------------------------

_CHUNKS = 64


def _sketcher(frequent):
    """Sketches of a task's documents: of all shingles or, with frequent, of those in documents that are no copies of frequent texts."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, n, held, size = np.zeros((2, SKETCH), np.int64), 0, [], 0

        def add() -> None:
            h = np.concatenate(held)
            counts[0] += np.bincount((h & _U(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
            counts[1] += np.bincount(((h >> _U(20)) & _U(SKETCH - 1)).astype(np.int64), minlength=SKETCH)

        for batch in batches:
            for text in batch["text"]:
                h = occurrences(text)
                n += len(h) > 0
                if frequent is not None:
                    often = h[frequent.value(h)]
                    h = often if 2 * len(often) <= len(h) else often[:0]
                h = np.unique(h)
                held.append(h)
                size += len(h)
                if size > 1 << 19:
                    add()
                    held, size = [], 0
        if held:
            add()
        if n:
            parts = counts.reshape(2 * _CHUNKS, -1)
            yield pd.DataFrame({"chunk": range(2 * _CHUNKS), "counts": [x.tobytes() for x in parts], "n": n})

    return sketch


def _sum(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[int, list] = {}
    for batch in batches:
        for chunk, counts, n in zip(batch["chunk"], batch["counts"], batch["n"]):
            own = held.setdefault(int(chunk), [np.zeros(2 * SKETCH // (2 * _CHUNKS), np.int64), 0])
            own[0] += np.frombuffer(counts, np.int64)
            own[1] += int(n)
    if held:
        yield pd.DataFrame({"chunk": list(held), "counts": [v[0].tobytes() for v in held.values()], "n": [v[1] for v in held.values()]})


def _counted(docs: DataFrame, text_col: str, frequent=None) -> tuple[np.ndarray, int]:
    """Each task sends one sketch; sums are by chunk of the sketch, in a stream."""
    schema = "chunk int, counts binary, n long"
    parts = docs.select(F.col(text_col).alias("text")).mapInPandas(_sketcher(frequent), schema)
    counts, n = np.zeros((2 * _CHUNKS, SKETCH // _CHUNKS), np.int64), 0
    with small_batches(docs.sparkSession):
        rows = parts.repartition(2 * _CHUNKS, "chunk").mapInPandas(_sum, schema).collect()
    for row in rows:
        counts[row["chunk"]], n = np.frombuffer(bytes(row["counts"]), np.int64), row["n"]
    return counts.reshape(2, SKETCH), n


def corpus_idf(docs: DataFrame, text_col: str = "text") -> Idf:
    """Over all documents, in two passes."""
    frequent = Frequent(*_counted(docs, text_col))
    counts, _ = _counted(docs, text_col, docs.sparkSession.sparkContext.broadcast(frequent))
    return Idf(frequent, counts)


def _signer(idf):
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            content, bands, size = [], [], []
            for text in batch["text"]:
                h, n = shingles(text)
                if len(h):
                    content.append(xxhash.xxh3_128_digest(h.tobytes() + n.tobytes()))
                    w = n * idf.value(h)
                    bands.append(band_keys(h, w))
                    size.append(float(w.sum()))
                else:
                    content.append(None)
                    bands.append(None)
                    size.append(0.0)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "row_id": batch["row_id"], "text_id": batch["text_id"], "node": content, "bands": bands, "size": size})

    return sign


class _Weights(dict):
    """Of the texts seen last."""

    def __init__(self, idf):
        self.idf = idf

    def of(self, node, text: str) -> tuple[np.ndarray, np.ndarray]:
        node = bytes(node)
        if node not in self:
            if len(self) > 64:
                self.clear()
            self[node] = weights(text, self.idf)
        return self[node]


def _verifier(idf):
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = _Weights(idf.value)
        for batch in batches:
            out = [weighted_jaccard(seen.of(a, x), seen.of(b, y)) for a, b, x, y in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"])]
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "similarity": out})

    return verify


def differences(v: tuple[np.ndarray, np.ndarray], base: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Items and amounts by which v differs from base, and the weights that v lacks and adds in all. What it lacks and what it adds of one shingle are different items."""
    h = np.union1d(v[0], base[0])
    more = np.zeros(len(h))
    more[np.searchsorted(h, v[0])] += v[1]
    more[np.searchsorted(h, base[0])] -= base[1]
    at = np.abs(more) > 1e-9
    h, more = h[at], more[at]
    return np.where(more > 0, h, _mix(h ^ _ODD[4])), np.abs(more), float(-more[more < 0].sum()), float(more[more > 0].sum())


def _items(idf, threshold: float):
    """Per text and leader: the text's items, and by what they bound similarity.

    With a = t / (1 + t), lacks m and adds e against a leader of weight w, texts u and v are similar if and only if they share
    at least cost(u) + cost(v) - (1 - 2a) w of their differences, where cost = (1 - a) m + a e. An open text u is not similar to the leader,
    that is over(u) = cost(u) - (1 - 2a) w > 0. Without a leader (w = 0), a similar text also shares at least own = t times the text's own weight.
    """
    a, reach = threshold / (1 + threshold), 1 - threshold

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, none = _Weights(idf.value), (np.zeros(0, _U), np.zeros(0))
        for batch in batches:
            held, n = [], 0
            for node, class_, leader, open_, text, led in zip(batch["node"], batch["class"], batch["leader"], batch["open"], batch["text"], batch["text_l"]):
                v, base = seen.of(node, text), seen.of(leader, led)
                far, own = 1 - weighted_jaccard(v, base), xxhash.xxh3_64_intdigest(bytes(leader)) >> 1
                found = []
                if far <= FAR + reach + 1e-9:
                    h, x, lacks, adds = differences(v, base)
                    cost = (1 - a) * lacks + a * adds
                    found.append((own, h, x, cost, cost - (1 - 2 * a) * float(base[1].sum()), 0.0))
                if far > FAR - 1e-9:
                    h, x, _, adds = differences(v, none)
                    found.append((own ^ 1, h, x, a * adds, a * adds, threshold * adds))
                for group, h, x, cost, over, least in found:
                    held.append(pd.DataFrame({"group": group, "node": node, "class": class_, "item": h.view(np.int64), "amount": x, "cost": cost, "over": over, "own": least, "open": bool(open_)}))
                    n += len(h)
                if n > 1 << 17:
                    yield pd.concat(held)
                    held, n = [], 0
            if held:
                yield pd.concat(held)

    return write


# --- links ---------------------------------------------------------------------------------------------------------


def _bounded(items: DataFrame) -> DataFrame:
    """Pairs (x, y) of an open text and another of its group and not of its class that can share enough by the bounds of `_items`; see above.

    Items that only one class of the group has are passed over: no such pair shares them.
    All texts have their items in one order, the most frequent first, and `upto` adds the amounts up to an item. At the rarest item
    of a pair, neither has more in common with the other than its own `upto`: a match counts only if both are enough.
    """
    often = items.groupBy("group", "item").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("c"), F.max("class").alias("d")).filter("c <> d").drop("c", "d")
    order = Window.partitionBy("group", "node").orderBy(F.desc("n"), "item").rowsBetween(Window.unboundedPreceding, 0)
    shared = items.join(often, ["group", "item"]).withColumn("upto", F.sum("amount").over(order) + 1e-6)
    shared = materialise(shared.filter((F.col("upto") >= F.greatest("cost", "own")) | (F.col("open") & (F.col("upto") >= F.greatest("over", "own")))).drop("amount", "n"), "shared-items")
    x = shared.filter(F.col("open") & (F.col("upto") >= F.greatest("over", "own"))).select("group", "item", F.col("node").alias("x"), F.col("class").alias("class_x"), "over", F.col("upto").alias("upto_x"))
    y = shared.filter(F.col("upto") >= F.greatest("cost", "own")).select(F.col("group").alias("g"), F.col("item").alias("i"), F.col("node").alias("y"), F.col("class").alias("class_y"), "cost", F.col("upto").alias("upto_y"))
    enough = F.least("upto_x", "upto_y") >= F.col("over") + F.col("cost")
    return x.join(y, (F.col("group") == F.col("g")) & (F.col("item") == F.col("i")) & (F.col("class_x") != F.col("class_y")) & enough).select("x", "y").distinct()


def _links(members: DataFrame, texts: DataFrame, idf, threshold: float, rounds: int) -> DataFrame | None:
    """Classes of the texts in members(key, node, size, popular), as (node, label) of those that have a link."""

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        if done is not None:
            pairs = pairs.join(done.select("a", "b"), ["a", "b"], "left_anti")
        both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        with small_batches(both.sparkSession):
            return materialise(both.mapInPandas(_verifier(idf), "a binary, b binary, similarity double"), "pairs")

    def alike(x: str, y: str):
        """Whether the sizes of two texts allow similarity."""
        return F.least(x, y) >= (threshold - 1e-9) * F.greatest(x, y)

    done, reach = None, 1 - threshold + 1e-9
    first = materialise(members.groupBy("key").agg(F.max(F.struct("popular", "node", "size")).alias("f"), F.count(F.lit(1)).alias("n")), "leaders")
    met = members.join(first, "key").withColumns({"leader": F.col("f.node"), "a": F.least("node", "f.node"), "b": F.greatest("node", "f.node")})
    done = verified(met.filter((F.col("node") != F.col("leader")) & alike("size", "f.size")).select(F.col("node").alias("x"), F.col("leader").alias("y")))
    # the distance from the first leader (null: over reach) tells which pairs can be similar at all
    far = F.when(F.col("node") == F.col("leader"), 0.0).otherwise(1 - F.col("similarity"))
    met = met.join(done, ["a", "b"], "left").select("key", "n", "leader", "node", "size", "popular", far.alias("far"))
    left = materialise(met.withColumn("settled", F.coalesce(F.col("far") <= reach, F.lit(False))), "met")
    for _ in range(rounds):
        who = F.when(~F.col("settled"), F.struct("popular", "node", "far", "size"))
        leader = materialise(left.filter("n > 2").groupBy("key").agg(F.max(who).alias("l")).filter("l is not null"), "leaders")
        near = left.join(leader, "key", "left")
        may = (F.col("node") != F.col("l.node")) & alike("size", "l.size") & F.coalesce(F.abs(F.col("far") - F.col("l.far")) <= reach, F.lit(True))
        near = near.withColumns({"may": may, "a": F.least("node", "l.node"), "b": F.greatest("node", "l.node")})
        done = materialise(done.union(verified(near.filter("may").select(F.col("node").alias("x"), F.col("l.node").alias("y")))), "done")
        now = near.join(done, ["a", "b"], "left")
        settled = F.col("settled") | F.coalesce((F.col("node") == F.col("l.node")) | (F.col("similarity") >= threshold), F.lit(False))
        left = materialise(now.select("key", "n", "leader", "node", "size", "far", "popular", settled.alias("settled")), "met")
    # what links so far make one class needs no more links; a text that is not of its first leader's class is open
    linked = done.filter(F.col("similarity") >= threshold)
    label = components(linked) if linked.limit(1).count() else linked.select(F.col("a").alias("node"), F.col("a").alias("label"))
    own = F.coalesce("label", "node")
    left = left.filter("n > 2").select("key", "n", "leader", "node", "size", "far").join(label, "node", "left").withColumn("class", own).drop("label")
    left = left.join(label.withColumnRenamed("node", "leader"), "leader", "left").withColumn("open", F.col("class") != F.coalesce("label", "leader")).drop("label")
    left = materialise(left, "classed")
    few = left.filter(F.col("n") <= SMALL)
    x, y = few.filter("open").select("key", F.struct("node", "size", "far", "class").alias("x")), few.select("key", F.struct("node", "size", "far", "class").alias("y"))
    may = (F.col("x.class") != F.col("y.class")) & alike("x.size", "y.size") & F.coalesce(F.abs(F.col("x.far") - F.col("y.far")) <= reach, F.lit(True))
    pairs = x.join(y, "key").filter(may).select(F.col("x.node").alias("x"), F.col("y.node").alias("y"))
    many = materialise(left.filter((F.col("n") > SMALL) & (F.col("node") != F.col("leader"))).select("leader", "node", "class", "open").distinct(), "led")
    opened = materialise(many.groupBy("leader").agg(F.min("class").alias("c"), F.max("class").alias("d")).filter("c <> d").select("leader"), "open-leaders")
    if opened.limit(1).count():
        led = many.join(opened, "leader").join(texts.select("node", "text"), "node").join(texts.select(F.col("node").alias("leader"), F.col("text").alias("text_l")), "leader")
        with small_batches(led.sparkSession):
            written = led.mapInPandas(_items(idf, threshold), "group long, node binary, class binary, item long, amount double, cost double, over double, own double, open boolean")
            written = materialise(written, "items")
        pairs = pairs.union(_bounded(written))
    done = done.union(verified(pairs))
    edges = done.filter(F.col("similarity") >= threshold)
    return components(edges) if edges.limit(1).count() else None


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of docs: doc_id, text_id (a hash of the text), class_id (the smallest doc_id in its class), class_size and kept."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row_id"), F.xxhash64(text_of(text_col)).alias("text_id"), text_of(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    idf = spark.sparkContext.broadcast(corpus_idf(docs, text_col))
    with small_batches(spark):
        signed = materialise(rows.mapInPandas(_signer(idf), f"doc_id {kind}, row_id long, text_id long, node binary, bands array<long>, size double"), "signed")
    place = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row_id", "text_id")
    nodes = materialise(signed.filter("node is not null").groupBy("node").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("size").alias("size")), "nodes")
    keyed = materialise(nodes.select("node", "size", F.explode("bands").alias("key")), "keys")
    shared = materialise(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared")
    buckets = materialise(keyed.join(shared, "key"), "buckets")
    members = materialise(buckets.join(materialise(buckets.groupBy("node").agg(F.sum("n").alias("popular")), "popular"), "node").select("key", "node", "size", "popular"), "members")
    label = None
    if members.limit(1).count():
        wanted = members.select("node").distinct().join(nodes.select("node", "first"), "node").select("node", F.col("first.doc_id").alias("d"), F.col("first.text_id").alias("t"))
        source = rows.select(F.col("doc_id").alias("d"), F.col("text_id").alias("t"), "text")
        texts = wanted.hint("shuffle_hash").join(source, wanted["d"].eqNullSafe(source["d"]) & (wanted["t"] == source["t"])).select("node", "text")
        texts = materialise(texts.dropDuplicates(["node"]), "texts")  # rows may repeat
        label = _links(members, texts, idf, threshold, rounds)
    classes = nodes.select("node", "first", "copies")
    classes = classes.withColumn("label", F.col("node")) if label is None else classes.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = materialise(classes, "classes")
    whole = materialise(classes.groupBy("label").agg(F.min("first").alias("winner"), F.sum("copies").alias("class_size")), "whole")
    by_node = materialise(classes.join(whole, "label").select("node", "winner", "class_size"), "by-node")
    narrow = signed.select("doc_id", "row_id", "text_id", "node")
    met = narrow.filter("node is not null").join(by_node, "node").select("doc_id", "text_id", F.col("winner.doc_id").alias("class_id"), "class_size", (F.col("row_id") == F.col("winner.row_id")).alias("kept"))
    alone = narrow.filter("node is null").select("doc_id", "text_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return met.unionByName(alone)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that stay: one of each class, with docs' columns."""
    found = near_duplicates(docs, id_col, text_col, threshold)
    return drop_rows(docs, found.select("doc_id", F.col("text_id").alias("digest"), "kept"), id_col, F.xxhash64(text_of(text_col)))


def op7(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "class_size", "kept")
