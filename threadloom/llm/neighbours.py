"""Nearest vectors by randomly rotated one-bit codes.

Vectors are taken relative to a centre, turned by a random rotation and kept as one sign bit per
coordinate. The inner product of a query with a vector is estimated from the bits and two scalars of
the vector, its length and the agreement of its code with itself, and the estimate comes with an
error bound. Blocks of codes stream past a group of queries, which keep their best vectors so far.
Those whose upper bound reaches the k-th best known are chosen and ranked by their inner products.

Every query meets every block of codes: one task lets a shard of the blocks stream past a group of
queries. Groups are as large as a task may hold, since each costs one copy of all blocks, and more
tasks than groups and shards are made by more shards, since each costs a copy of the queries only.
Of equal vectors in one block, the ``k + 1`` of least id are
kept, since no other can be in a result. The centre is the mean of a sample of
:data:`SAMPLE_VALUES` numbers at most; every vector is coded. The inner products returned are summed
in the order of coordinates.

Defined results: vectors that are null, zero, of another length than most, or hold null or
non-finite numbers take no part, nor do rows without an id. Rows that repeat are candidates each.
Queries of one id are one query, that of the least vector; rows of its id are no candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import materialise_counting

K = 20
#: Standard errors that a bound allows for.
BOUND = 2.5
SAMPLE_VALUES = 1 << 20
#: Bytes of vectors in one block of candidates, and in one of queries.
BLOCK_BYTES = 1 << 20
QUERY_BYTES = 1 << 16
#: Bytes of queries that meet a block at once, and that one task holds.
TOGETHER_BYTES = 1 << 18
GROUP_BYTES = 1 << 24
#: Blocks that one task lets stream past a group of queries.
SHARD_BLOCKS = 32


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    gauss = np.random.Generator(np.random.PCG64(seed)).normal(size=(dim, dim))
    q, r = np.linalg.qr(gauss)
    return q * np.sign(np.diag(r))


def _usable(vector: Column) -> Column:
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _least_copies(vectors: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the vectors that may be among ``k`` nearest.

    Of equal ones these are the rows of the k + 1 least ids, since those of the query's own id do
    not count, and k rows of each id at most.
    """
    _, kind = np.unique(vectors, axis=0, return_inverse=True)
    order = np.lexsort((ids, kind))
    kind, own = kind[order], ids[order]
    new = np.ones(len(kind), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (own[1:] != own[:-1])
    group = np.cumsum(new) - 1
    distinct = group - group[np.searchsorted(kind, kind)]
    copy = np.arange(len(kind)) - np.flatnonzero(new)[group]
    return np.sort(order[(distinct <= k) & (copy < k)])


def _encode(dim: int, centre: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim)
        size = max(1, BLOCK_BYTES // (8 * dim))
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                vectors, ids = _matrix(part.column("v"), dim), part.column("id").to_numpy()
                kept = _least_copies(vectors, ids, k)
                vectors, ids = vectors[kept], ids[kept]
                away = (vectors - centre) @ turn.T
                length = np.sqrt((away**2).sum(axis=1))
                unit = away / np.where(length > 0, length, 1)[:, None]
                agreement = np.abs(unit).sum(axis=1) / np.sqrt(dim)
                values = {
                    "ids": ids.astype("<i8"),
                    "vectors": vectors.astype("<f8"),
                    "codes": np.packbits(unit > 0, axis=1),
                    "lengths": length.astype("<f8"),
                    "agreements": np.where(length > 0, agreement, 1).astype("<f8"),
                }
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.tobytes()], pa.binary()) for x in values.values()], list(values)
                )

    return run


def _gather(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, QUERY_BYTES // (8 * dim))
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                blobs = (
                    part.column("id").to_numpy().astype("<i8").tobytes(),
                    _matrix(part.column("v"), dim).astype("<f8").tobytes(),
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b], pa.binary()) for b in blobs], ["ids", "vectors"]
                )

    return run


class Search:
    """The best vectors so far of a group of queries."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, centre: np.ndarray, k: int):
        self.queries, self.ids, self.centre, self.k = queries, ids, centre, k
        self.turned = queries @ rotation(queries.shape[1]).T
        self.norms = np.sqrt((queries**2).sum(axis=1))
        self.limit = np.full(len(queries), -np.inf)
        self.best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        #: Pairs that the bounds let through.
        self.ranked = 0

    def _kth(self, scores: np.ndarray) -> np.ndarray:
        """The k-th largest of each row, if there are so many, or the limit if that is more."""
        if scores.shape[1] < self.k:
            return self.limit
        return np.maximum(self.limit, -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1])

    def meet(
        self,
        vectors: np.ndarray,
        ids: np.ndarray,
        codes: np.ndarray,
        lengths: np.ndarray,
        agreements: np.ndarray,
    ) -> None:
        """Let one block of codes compete."""
        dim = vectors.shape[1]
        signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float64) * 2 - 1
        estimate = (self.turned @ signs.T) / np.sqrt(dim) * (lengths / agreements)
        estimate += (self.queries @ self.centre)[:, None]
        spread = lengths * np.sqrt(np.maximum(1 - agreements**2, 0)) / agreements
        rounding = 1e-9 * self.norms[:, None] * (lengths + np.sqrt(self.centre @ self.centre))
        error = self.norms[:, None] * (spread * BOUND / np.sqrt(max(dim - 1, 1))) + rounding
        own = self.ids[:, None] == ids
        estimate[own] = -np.inf
        chosen = (estimate + error >= self._kth(estimate - error)[:, None]) & ~own
        self.ranked += int(chosen.sum())
        some = np.flatnonzero(chosen.any(axis=0))
        if not len(some):
            return
        scores = np.where(chosen[:, some], self.queries @ vectors[some].T, -np.inf)
        q, c = np.nonzero(scores >= self._kth(scores)[:, None] - rounding[:, some])
        finite = np.isfinite(scores[q, c])
        q, c = q[finite], some[c[finite]]
        exact = np.zeros(len(q))
        for d in range(dim):
            exact += self.queries[q, d] * vectors[c, d]
        merged = [np.concatenate(x) for x in zip(self.best, (q, ids[c], exact), strict=True)]
        order = np.lexsort((merged[1], -merged[2], merged[0]))
        merged = [x[order] for x in merged]
        rank = np.arange(len(order)) - np.searchsorted(merged[0], merged[0])
        self.best = tuple(x[rank < self.k] for x in merged)
        last = merged[2][rank == self.k - 1]
        self.limit[merged[0][rank == self.k - 1]] = last

    def results(self) -> pa.RecordBatch:
        q, vectors, scores = self.best
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[q]), pa.array(vectors), pa.array(scores)], ["query_id", "vec_id", "score"]
        )


_BLOCK_KINDS = {"vectors": "<f8", "ids": "<i8", "codes": "u1", "lengths": "<f8", "agreements": "<f8"}


def _search(dim: int, centre: np.ndarray, k: int):
    """Rows come by group and shard: first the queries, then the blocks of codes."""
    together = max(1, TOGETHER_BYTES // (8 * dim))
    width = {"vectors": dim, "codes": -(-dim // 8)}

    def read(row: dict, name: str, kind: str) -> np.ndarray:
        found = np.frombuffer(row[name], kind)
        return found.reshape(-1, width[name]) if name in width else found

    def searches(asked: list[tuple[np.ndarray, np.ndarray]]) -> list[Search]:
        queries, ids = (np.concatenate(x) for x in zip(*asked, strict=True))
        starts = range(0, len(ids), together)
        return [Search(queries[i : i + together], ids[i : i + together], centre, k) for i in starts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, asked, held = None, [], []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                if group != (row["group"], row["shard"]):
                    yield from (search.results() for search in held)
                    group, asked, held = (row["group"], row["shard"]), [], []
                if row["place"] == 0:
                    asked.append((read(row, "vectors", "<f8"), read(row, "ids", "<i8")))
                    continue
                if asked:
                    held, asked = searches(asked), []
                block = {name: read(row, name, kind) for name, kind in _BLOCK_KINDS.items()}
                for search in held:
                    search.meet(**block)
        yield from (search.results() for search in held)

    return run


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = K,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products of each query."""
    own = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(vector_col).cast("array<double>").alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    ).filter(F.col("id").isNotNull() & _usable(F.col("v")))
    empty = "query_id long, rank int, vec_id long, score double"
    lengths = own.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], empty)
    dim = lengths["dim"]
    own = own.filter(F.size("v") == dim)
    picked = own.select("v", F.xxhash64("id", "v").alias("h")).orderBy("h")
    sample = picked.limit(max(1, SAMPLE_VALUES // dim))
    mean = sample.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
    centre = np.array([r["m"] for r in mean.orderBy("i").collect()])

    schema = "ids binary, vectors binary, codes binary, lengths binary, agreements binary"
    blocks, seen = materialise_counting(
        own.select("id", "v").mapInArrow(_encode(dim, centre, k), schema), "codes", n=F.count("*")
    )
    asked = own.filter("asks").groupBy("id").agg(F.min("v").alias("v"))
    asked = asked.mapInArrow(_gather(dim), "ids binary, vectors binary")
    asked, counted = materialise_counting(asked, "queries", n=F.sum(F.length("vectors")))
    groups = -(-max(1, counted["n"] or 0) // GROUP_BYTES)
    tasks = vectors.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-seen["n"] // SHARD_BLOCKS), min(seen["n"], -(-tasks // groups)))

    def dealt(n: int) -> Column:
        return F.pmod(F.xxhash64("ids", "vectors"), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    first = asked.select("*", F.lit(0).alias("place"), dealt(groups).alias("group"), every(shards).alias("shard"))
    later = blocks.select("*", F.lit(1).alias("place"), every(groups).alias("group"), dealt(shards).alias("shard"))
    met = first.unionByName(later, allowMissingColumns=True)
    met = met.repartitionById(groups * shards, F.col("group") * shards + F.col("shard"))
    met = met.sortWithinPartitions("group", "shard", "place")
    found = met.select("group", "shard", "place", *_BLOCK_KINDS).mapInArrow(
        _search(dim, centre, k), "query_id long, vec_id long, score double"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
