r"""Centroid clustering with Drake's adaptive bounds (operator 13).

Exact k-means on integer vectors: each component x becomes floor(scale * x), centroids are the componentwise floors of
means, distances are squared Euclidean, so every number is an integer and every run gives the same rows.

Every vector carries its cluster, an upper bound on the distance to that centroid, lower bounds on the distances to its
`b` next nearest centroids and one lower bound for all the rest. When centroids move, bounds give way by how far they moved (the last
one by the farthest move). A vector whose upper bound is below all its lower bounds keeps its cluster without any
distance being computed. Otherwise the own distance is made exact, then those to the listed centroids whose bounds
don't exceed it; only if the rest can't be ruled out are all centroids scanned again. A tie is never certified by a bound, so it always ends in
exact distances, where the smaller number wins. Bounds are rounded away from certainty. b starts at a quarter of k and shrinks to what the last round
needed, an eighth of k at least.

One pass over the vectors per round: tasks read vectors and bounds, write them back with the new cluster, and put the sums of
each Arrow batch by cluster beside them, so the next centroids cost a read of one column of at most k rows per batch. Nothing is
shuffled but these sums, hot clusters cost nothing, and the driver holds k centroids. Each round's table ends lineage; the one
before it is deleted then.

Edge cases. Vectors that are null, have another number of components, or a component that is null, NaN or infinite, are left
out. Fewer vectors than k: as many clusters as vectors; none: an empty result. Vectors that repeat an id each count and each get
a row; where they tie for a starting place, the one with the smaller components (in order) has it. Vectors with a null id get rows but start no
cluster unless there are no others left, the smaller components first. A component beyond 2^27 after scaling raises an error,
as its squared distances would not fit 63 bits. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, materialise

#: Largest component whose squared distances fit 63 bits, and largest for which float64 products are exact.
LIMIT, EXACT = 1 << 27, 1 << 22
_SLACK = 1e-12

_SUMS = "sums array<struct<cluster:int,n:long,distance:long,s:array<long>>>, used int, scans long"
_STATE = f"id long, x binary, cluster int, upper double, near binary, low binary, rest double, distance long, {_SUMS}"


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of c, exact."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)
    return np.stack([((x - y) ** 2).sum(1) for y in c], 1)


def _paired(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of each row of x to the same row of c."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def _above(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64)) * (1 + _SLACK)


def _below(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64)) * (1 - _SLACK)


@dataclass
class Bounds:
    """What is known of a batch of vectors: near and low have b columns, nearest first when they were made."""

    cluster: np.ndarray
    upper: np.ndarray
    near: np.ndarray
    low: np.ndarray
    rest: np.ndarray

    @staticmethod
    def scanned(x: np.ndarray, centers: np.ndarray, b: int) -> Bounds:
        d = _squared(x, centers)
        order = np.argsort(d, 1, kind="stable")[:, : b + 2]  # stable: of equal distances the smaller number
        at = np.take_along_axis(d, order, 1)
        rest = _below(at[:, b + 1]) if len(centers) > b + 1 else np.full(len(x), np.inf)
        return Bounds(order[:, 0].astype(np.int32), _above(at[:, 0]), order[:, 1 : b + 1].astype(np.int32), _below(at[:, 1 : b + 1]), rest)

    def trimmed(self, b: int) -> Bounds:
        """With b lower bounds; what is left out goes into that of the rest."""
        if b >= self.near.shape[1]:
            return self
        order = np.argsort(self.low, 1, kind="stable")
        near, low = np.take_along_axis(self.near, order, 1), np.take_along_axis(self.low, order, 1)
        return Bounds(self.cluster, self.upper, near[:, :b], low[:, :b], np.minimum(self.rest, low[:, b:].min(1)))

    def after(self, moves: np.ndarray) -> Bounds:
        """Bounds once each centroid has moved so far at most."""
        most = moves.max(initial=0.0)
        return Bounds(
            self.cluster, (self.upper + moves[self.cluster]) * (1 + _SLACK), self.near, self.low - moves[self.near] - _SLACK * (np.abs(self.low) + moves[self.near]), self.rest - most - _SLACK * (np.abs(np.where(np.isinf(self.rest), 0, self.rest)) + most)
        )

    def settled(self, x: np.ndarray, centers: np.ndarray) -> tuple[Bounds, int, int]:
        """Bounds with the exactly nearest centroid as cluster; how many listed centroids had to be looked at for one vector at most, and how many vectors were scanned against all."""
        out = Bounds(self.cluster.copy(), self.upper.copy(), self.near.copy(), self.low.copy(), self.rest.copy())
        least = np.minimum(out.low.min(1, initial=np.inf), out.rest)
        open_ = np.flatnonzero(~(out.upper < least))
        if not len(open_):
            return out, 0, 0
        out.upper[open_] = _above(_paired(x[open_], centers[out.cluster[open_]]))
        open_ = open_[~(out.upper[open_] < least[open_])]
        scan = open_[~(out.upper[open_] < out.rest[open_])]
        open_ = open_[out.upper[open_] < out.rest[open_]]
        used = 0
        if len(open_):
            # only listed centroids can be nearer; those whose bounds rule them out are not looked at
            mine, near, low = out.cluster[open_], out.near[open_], out.low[open_]
            look = ~(out.upper[open_][:, None] < low)
            used = int(look.sum(1).max())
            own = _paired(x[open_], centers[mine])
            d = np.full(near.shape, np.iinfo(np.int64).max)
            r, c = np.nonzero(look)
            d[r, c] = _paired(x[open_][r], centers[near[r, c]])
            low = np.where(look, _below(np.where(look, d, 0)), low)
            best = d.min(1)
            first = np.where(d == best[:, None], near, len(centers)).min(1)
            moves = (best < own) | ((best == own) & (first < mine))
            r = np.flatnonzero(moves)
            c = np.argmax(near[r] == first[r][:, None], 1)
            near[r, c], low[r, c] = mine[r], _below(own[r])
            out.cluster[open_], out.near[open_], out.low[open_] = np.where(moves, first, mine), near, low
            out.upper[open_] = _above(np.where(moves, best, own))
        if len(scan):
            new = Bounds.scanned(x[scan], centers, out.near.shape[1])
            out.cluster[scan], out.upper[scan], out.near[scan], out.low[scan], out.rest[scan] = new.cluster, new.upper, new.near, new.low, new.rest
        return out, used, len(scan)


def _integers(vectors: pa.Array, dim: int, scale: int) -> np.ndarray:
    x = np.floor(np.asarray(vectors.flatten()).astype(np.float64).reshape(-1, dim) * scale)
    if np.abs(x).max(initial=0) > LIMIT:
        raise ValueError(f"a component is beyond {LIMIT} after scaling by {scale}; squared distances would not fit 63 bits")
    return x.astype(np.int64)


def _packed(rows: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in rows]


def _unpacked(column: pa.Array, kind: str) -> np.ndarray:
    """Rows of equal width from a binary column."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as they were written: of 16 bits where they fit, else of 32."""
    rows = column.to_pylist()
    out = np.empty((len(rows), dim), np.int64)
    wide = np.array([len(r) == 4 * dim for r in rows])
    for mask, kind in ((~wide, "<i2"), (wide, "<i4")):
        at = np.flatnonzero(mask)
        if len(at):
            out[at] = np.frombuffer(b"".join(rows[i] for i in at), kind).reshape(len(at), dim)
    return out


def _down32(low: np.ndarray) -> np.ndarray:
    """As 32-bit floats, none larger than before."""
    out = low.astype("<f4")
    return np.where(out > low, np.nextafter(out, np.float32(-np.inf)), out).astype("<f4")


def _pass(rows: DataFrame, schema: str, dim: int, scale: int, centers: np.ndarray, b: int, moves: np.ndarray | None) -> DataFrame:
    """One assignment of all vectors. moves: None for the first, which scans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            if moves is None:
                x, used, scans = _integers(batch.column("v"), dim, scale), 0, batch.num_rows
                known = Bounds.scanned(x, centers, b)
            else:
                x = _vectors(batch.column("x"), dim)
                known = Bounds(np.asarray(batch.column("cluster")), np.asarray(batch.column("upper")), _unpacked(batch.column("near"), "<i4"), _unpacked(batch.column("low"), "<f4").astype(np.float64), np.asarray(batch.column("rest")))
                known, used, scans = known.trimmed(b).after(moves).settled(x, centers)
            distance = _paired(x, centers[known.cluster])
            sums = [{"cluster": int(c), "n": int(m.sum()), "distance": int(distance[m].sum()), "s": x[m].sum(0)} for c in np.unique(known.cluster) for m in [known.cluster == c]]
            n = batch.num_rows
            small = np.abs(x).max(initial=0) < 1 << 15
            columns = {
                "id": batch.column("id"), "x": _packed(x.astype("<i2" if small else "<i4")), "cluster": known.cluster.astype(np.int32), "upper": known.upper, "near": _packed(known.near.astype("<i4")), "low": _packed(_down32(known.low)), "rest": known.rest,
                "distance": distance, "sums": [sums] + [None] * (n - 1), "used": [used] + [None] * (n - 1), "scans": [scans] + [None] * (n - 1),
            }
            yield pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in kinds], schema=kinds)

    kinds = pa.schema([("id", pa.int64()), ("x", pa.binary()), ("cluster", pa.int32()), ("upper", pa.float64()), ("near", pa.binary()), ("low", pa.binary()), ("rest", pa.float64()), ("distance", pa.int64()),
                       ("sums", pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("distance", pa.int64()), ("s", pa.list_(pa.int64()))]))), ("used", pa.int32()), ("scans", pa.int64())])
    return rows.mapInArrow(run, schema)


@dataclass(frozen=True)
class Clusters:
    #: id, cluster, distance (squared).
    rows: DataFrame
    #: Components of the centroids, and the distances summed over each cluster.
    centers: list[list[int]]
    inertia: list[int]
    #: Vectors scanned against all centroids, by round.
    scans: list[int]


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dim: int = 64, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> Clusters:
    """Start from the k vectors with the smallest sha256 of `seed:id`, move centroids `rounds` times, then assign once more."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.filter((F.size(v) == dim) & finite).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.orderBy(hashed.asc_nulls_last(), "v").limit(k).collect()
    k = len(first)
    if not k:
        return Clusters(rows.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), [], [], [])
    centers = _integers(pa.array([r["v"] for r in first]), dim, scale)
    most, least = min(k - 1, -(-k // 4)), min(k - 1, -(-k // 8))
    b, moves, scans, state = most, None, [], None
    for at in range(rounds + 1):
        old, state = state, materialise(_pass(rows if state is None else state, _STATE, dim, scale, centers, b, moves), f"round-{at}")
        if old is not None:
            dropped(old)
        each = state.filter("sums is not null").select(F.explode("sums").alias("t")).groupBy("t.cluster")
        sums = {r["cluster"]: r for r in each.agg(F.sum("t.n").alias("n"), F.sum("t.distance").alias("distance"), *[F.sum(F.col("t.s")[i]).alias(f"s{i}") for i in range(dim)]).collect()}
        work = state.agg(F.max("used").alias("used"), F.sum("scans").alias("scans")).first()
        scans.append(work["scans"])
        if at == rounds:
            break
        new = [[sums[c][f"s{i}"] // sums[c]["n"] for i in range(dim)] if c in sums else centers[c].tolist() for c in range(k)]
        new = np.array(new, np.int64)
        moves, centers = _above(_paired(new, centers)), new
        if at:  # the first pass scans all; what later ones needed says how many bounds are worth keeping
            b = min(b, max(least, work["used"]))
    inertia = [int(sums[c]["distance"]) if c in sums else 0 for c in range(k)]
    return Clusters(state.select("id", "cluster", "distance"), centers.tolist(), inertia, scans)


def op13(spark, sf_dir: str) -> DataFrame:
    found = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centers]
    per = spark.createDataFrame([(c, i, sum(found.inertia), d) for c, (i, d) in enumerate(zip(found.inertia, digests))], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # a row per centroid: k at most
    return found.rows.join(F.broadcast(per), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 40, rounds: int = 5, dim: int = 64) -> str:
    steps = [
        f"kept AS (SELECT vec_id, embedding, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0)",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, embedding) - 1 AS INTEGER) AS c, x AS y FROM (SELECT *, sha256('2:' || CAST(vec_id AS VARCHAR)) AS h FROM kept ORDER BY h NULLS LAST, embedding LIMIT {k}))",
        "v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, x FROM kept)",
    ]
    for i in range(rounds + 1):
        far = "CAST(list_sum(list_transform(list_zip(v.x, c.y), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := {far}, c := c)) AS m FROM v CROSS JOIN c{i} c GROUP BY r)")
        if i < rounds:
            mean = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
            each = f"SELECT m.c AS c, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM a{i} JOIN v USING (r) CROSS JOIN (SELECT range AS i FROM range(1, {dim + 1})) GROUP BY ALL"
            steps.append(f"n{i} AS MATERIALIZED (SELECT c, list({mean} ORDER BY i) AS y FROM ({each}) GROUP BY c)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.y, o.y) AS y FROM c{i} o LEFT JOIN n{i} n ON o.c = n.c)")
    last = f"SELECT v.vec_id, m.c AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.y, ',')) AS centroid_sha256 FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c ON c.c = m.c"
    return f"WITH {', '.join(steps)} {last}"


OP13_SQL = _sql()
