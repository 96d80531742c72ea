"""Operator 2: exact top-k search by inner product with multi-resolution segment statistics.

Vectors become whole numbers, floor(scale * x). A vector is cut into 1, 4, 16, ... segments; for each, sqrt(n) times the
mean and the norm of the deviations from it are kept. The sum over segments of (difference of means)^2 + (difference of
deviations)^2 bounds the squared distance of two vectors from below. As the squares of a vector's statistics add up to its
squared norm, the inner product is then at most the inner product of the statistics.

Candidates go through the levels coarse to fine: each level looks only at what the levels before left, and drops what can't
reach the query's bar, the k-th best exact score that the task has seen. What is left after the finest level is scored
exactly. The first block sets the bar with the exact scores of its most promising candidates; each further one raises it.

Every query meets every candidate on a grid of tasks: candidate blocks are dealt to columns in turn, groups of query blocks
to rows, and a cell's task holds its queries (a bounded number) while candidate blocks pass by. That product is over blocks,
it is the stated comparison of a query set with all rows, and each cell sends on only k rows a query. Nothing is broadcast.

Cases: vectors that are null or hold null or non-finite components take no part; vectors are compared with those of their
own dimension, empty ones with each other at score 0; ties go to the smaller id; a repeated row is a candidate as often as
it is there; each row of a repeated query id is a query with k results of its own, and rows of a query's id are no
candidates for it; rows with a null id are no queries and no candidates; other columns are left out; an empty table gives an
empty one. A score beyond 64 bits raises OverflowError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from daybook.llm.common import discard, small_batches, written

#: Below this size products and sums of whole numbers are exact in doubles.
EXACT = float(1 << 53)
#: A level looks at single pairs where fewer than this share of a block's pairs are left, else at the whole block.
SPARSE = 0.05
#: Query blocks that a task holds, and bytes that a block's components have at most (but for a single longer row).
HELD, BLOCK_BYTES = 64, 1 << 21


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(x.astype(np.float64) * scale)


def segment_stats(x: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(n) * mean of each segment, then the norm of its deviations: their inner products bound those of the rows."""
    edges = np.linspace(0, x.shape[1], segments + 1).astype(int)
    means, devs = [], []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part = x[:, a:b]
        mean = part.mean(axis=1)
        means.append(mean * np.sqrt(b - a))
        devs.append(np.sqrt(((part - mean[:, None]) ** 2).sum(axis=1)))
    return np.stack(means + devs, 1)


def levels(dimension: int) -> list[int]:
    out, n = [], 1
    while n < dimension:
        out.append(n)
        n *= 4
    return out or [1]


class Block:
    """Rows of one dimension with their statistics by level, each made when it is first asked for."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows, self.known = ids, rows, {}
        self.most = float(np.abs(rows).max(initial=0))
        self.norms = np.sqrt((rows**2).sum(axis=1))

    def stats(self, segments: int) -> np.ndarray:
        if segments not in self.known:
            self.known[segments] = segment_stats(self.rows, segments)
        return self.known[segments]


def _dots(x: np.ndarray, y: np.ndarray, rows: np.ndarray, cols: np.ndarray, step: int = 100_000) -> np.ndarray:
    parts = [np.einsum("ij,ij->i", x[rows[i : i + step]], y[cols[i : i + step]]) for i in range(0, len(rows), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _first_bar(q: Block, c: Block, k: int) -> np.ndarray:
    """Each query's k-th best exact score among the k + 1 candidates of the highest bounds, its own rows left out."""
    if len(c.ids) <= k:
        return np.full(len(q.ids), -np.inf)
    finest = levels(q.rows.shape[1])[-1]
    most = np.argpartition(-(q.stats(finest) @ c.stats(finest).T), k, axis=1)[:, : k + 1]
    scores = _dots(q.rows, c.rows, np.repeat(np.arange(len(q.ids)), k + 1), most.reshape(-1)).reshape(most.shape)
    scores[q.ids[:, None] == c.ids[most]] = -np.inf
    return np.partition(scores, 1, axis=1)[:, 1]


def block_top(q: Block, c: Block, k: int, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's row, candidate's row, score) of each query's k best candidates in the block that reach its bar."""
    if q.most * c.most * q.rows.shape[1] >= EXACT:
        x, y = (np.array([[int(v) for v in row] for row in b.rows], object) for b in (q, c))
        rows, cols = np.nonzero(q.ids[:, None] != c.ids[None, :])
        scores = np.array([(x[i] * y[j]).sum() for i, j in zip(rows.tolist(), cols.tolist(), strict=True)], object)
        if any(not -(1 << 63) <= s < 1 << 63 for s in scores):
            raise OverflowError("an inner product exceeds 64 bits")
        order = np.lexsort((c.ids[cols], [-s for s in scores], rows)) if len(rows) else np.zeros(0, np.int64)
        rows, cols, scores = rows[order], cols[order], scores[order]
    else:
        slack = 1e-9 * q.norms[:, None] * max(float(c.norms.max(initial=0)), 1.0)  # rounding never loses a candidate
        rows = cols = None  # all pairs, until a level leaves few
        for n in levels(q.rows.shape[1]):
            if rows is None:
                hit = q.stats(n) @ c.stats(n).T >= bar[:, None] - slack
                if np.count_nonzero(hit) < SPARSE * hit.size:
                    rows, cols = np.nonzero(hit)
            else:
                left = _dots(q.stats(n), c.stats(n), rows, cols) >= bar[rows] - slack[rows, 0]
                rows, cols = rows[left], cols[left]
        if rows is None:
            exact = q.rows @ c.rows.T
            rows, cols = np.nonzero(exact >= bar[:, None])
            scores = exact[rows, cols]
        else:
            scores = _dots(q.rows, c.rows, rows, cols)
        left = (scores >= bar[rows]) & (q.ids[rows] != c.ids[cols])
        rows, cols, scores = rows[left], cols[left], scores[left]
        order = np.lexsort((c.ids[cols], -scores, rows))
        rows, cols, scores = rows[order], cols[order], scores[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[kept], cols[kept], scores[kept].astype(np.int64)


class Best:
    """The k best candidates of each query of a block so far."""

    def __init__(self, q: Block, k: int):
        self.q, self.k, self.bar = q, k, None
        self.found = tuple(np.zeros(0, np.int64) for _ in range(3))  # query's row, candidate's id, score

    def meet(self, c: Block) -> None:
        exact = self.q.most * c.most * self.q.rows.shape[1] < EXACT
        if self.bar is None:
            self.bar = np.full(len(self.q.ids), -np.inf)
        if exact and np.isneginf(self.bar).any():
            self.bar = np.maximum(self.bar, _first_bar(self.q, c, self.k))
        rows, cols, scores = block_top(self.q, c, self.k, self.bar)
        rows, ids, scores = (np.concatenate(x) for x in zip(self.found, (rows, c.ids[cols], scores), strict=True))
        order = np.lexsort((ids, -scores.astype(np.float64) if not len(scores) or np.abs(scores).max() < EXACT else [-int(s) for s in scores], rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        last = place == self.k - 1
        self.bar[rows[last]] = np.maximum(self.bar[rows[last]], np.nextafter(scores[last].astype(np.float64), -np.inf) if not exact else scores[last])
        self.found = tuple(x[place < self.k] for x in (rows, ids, scores))


def _blocks(vectors: DataFrame, size: int, scale: int) -> DataFrame:
    """Rows packed by dimension: dim, ids and components as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def out(dim: int) -> pa.RecordBatch:
            ids, rows = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([rows.tobytes()], pa.binary())], ["dim", "ids", "rows"])

        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            lists = batch.column("vector")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            heads = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                most = max(1, min(size, BLOCK_BYTES // (8 * max(dim, 1))))
                for i in range(0, len(own), most):
                    part = own[i : i + most]
                    held.setdefault(dim, []).append((ids[part].astype(np.int64), whole(flat[heads[part][:, None] + np.arange(dim)], scale)))
                    if sum(len(x) for x, _ in held[dim]) >= most:
                        yield out(dim)
        for dim in list(held):
            yield out(dim)

    return vectors.mapInArrow(run, "dim int, ids binary, rows binary")


def _numbered(blocks: DataFrame) -> tuple[DataFrame, int]:
    """blocks with consecutive numbers `no`, and how many there are. Only the counts of tasks reach the driver, and go back as
    a table with a row for each task."""
    rows = blocks.withColumn("part", F.shiftright("at", 33)).withColumn("own", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    heads, total = [], 0
    for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        heads.append((r.part, total))
        total += r.n
    offsets = blocks.sparkSession.createDataFrame(heads, "part long, head long")
    return rows.join(F.broadcast(offsets), "part").withColumn("no", F.col("head") + F.col("own")).drop("part", "own", "head", "at"), total


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, vec_id: str = "vec_id", vector: str = "embedding", query_block: int = 256, block: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k rows of highest inner product, itself left out."""
    spark = vectors.sparkSession
    small_batches(spark)
    v = F.col(f"`{vector}`").cast(T.ArrayType(T.DoubleType()))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), v.alias("vector"), is_query.alias("is_query"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & finite)
    place = F.monotonically_increasing_id().alias("at")
    stored_queries = written(_blocks(rows.where("is_query").select("id", "vector"), query_block, scale).select("*", place), "query-blocks")
    stored = written(_blocks(rows.select("id", "vector"), block, scale).select("*", place), "candidate-blocks")
    queries, n_queries = _numbered(stored_queries)
    candidates, n_blocks = _numbered(stored)

    down = max(1, -(-n_queries // HELD))
    tasks = 2 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    across = max(1, min(n_blocks, -(-tasks // down)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = candidates.withColumn("i", (F.col("no") % across).cast("int")).withColumn("j", every(down)).withColumn("is_query", F.lit(False))
    queries = queries.withColumn("j", (F.col("no") % down).cast("int")).withColumn("i", every(across)).withColumn("is_query", F.lit(True))
    cell = (F.col("j") * across + F.col("i")).cast("int")
    dealt = queries.unionByName(candidates).repartitionById(down * across, cell).sortWithinPartitions(F.desc("is_query"), "no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, Best]]] = {}  # by dimension
        for batch in batches:
            for r in range(batch.num_rows):
                query, no, dim, ids, x = (batch.column(c)[r].as_py() for c in ("is_query", "no", "dim", "ids", "rows"))
                ids = np.frombuffer(ids, np.int64)
                own = Block(ids, np.frombuffer(x).reshape(len(ids), dim) if dim else np.zeros((len(ids), 1)))
                if query:
                    held.setdefault(dim, []).append((no, Best(own, k)))
                else:
                    for _, best in held.get(dim, ()):
                        best.meet(own)
        for found in held.values():
            for no, best in found:
                a, ids, scores = best.found
                yield pa.RecordBatch.from_arrays([pa.array(best.q.ids[a]), pa.array((no << 32) + a), pa.array(ids), pa.array(scores)], ["query_id", "copy", "vec_id", "score"])

    scored = dealt.select("is_query", "no", "dim", "ids", "rows").mapInArrow(run, "query_id long, copy long, vec_id long, score long")
    best = Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id")
    ranked = written(scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "top-k")
    discard(stored_queries, stored)
    return ranked
