"""Exact top-k search by integer inner product: columnar branch-and-bound.

Candidates are packed into blocks of bounded size in vertical layout (one row
of the matrix for each dimension), queries into blocks too, and every query
block meets every candidate block once.  Inside a pair of blocks the dimensions
go in order of their energy, and partial products are accumulated a few
dimensions at a time.  What the remaining dimensions can add is at most the
product of the two vectors' remaining norms (Cauchy-Schwarz), their remaining
mass; a candidate whose bound falls below the k-th best score that the query has
is dropped and the survivors are compacted.  A task carries the k best of a query
from block to block, so later blocks begin with its bound, and a block's first
candidates are scored in full to have one from the start.

Sums are 64-bit floats, which are exact for integers below 2^53; pairs of
vectors so long that theirs may not be are told apart with a margin for rounding,
and scores of the few that are left are added up again as whole numbers.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors a block; with the dimension they bound a task's memory.  Dimensions a step; candidates scored in full first.
CANDIDATE_BLOCK, QUERY_BLOCK, DIMS, FIRST = 8192, 1024, 8, 256
#: Query blocks whose best scores a task carries along; those of the block met longest ago are sent on when there are more.
CARRIED = 256
#: Products of norms up to which sums are exact.
EXACT = 2.0**52
LEAST, MOST = -(1 << 63), (1 << 63) - 1

#: (-score, id) of the best candidates of a query, in order.
Best = list[tuple[int, int]]


def _within(sums: np.ndarray) -> np.ndarray:
    """Bounds of scores, which stay within 64 bits."""
    return np.clip(sums, -(2.0**63), 2.0**63)


def _score(x: np.ndarray, q: np.ndarray) -> int:
    """Whole-number inner product, kept within 64 bits."""
    return max(LEAST, min(MOST, sum(int(a) * int(b) for a, b in zip(x, q, strict=True))))


class _Chunk:
    """Candidates of a block, dimensions in order of energy."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int, best: list[Best]):
        self.ids, self.x, self.q_ids, self.q, self.k, self.best = ids, x, q_ids, q, k, best
        self.norm_x, self.norm_q = np.sqrt((x**2).sum(0)), np.sqrt((q**2).sum(0))
        self.work = 0

    def margin(self, j: int, at) -> np.ndarray:
        """What rounding may make of a sum."""
        long = self.norm_q[j] * self.norm_x[at]
        return np.where(long < EXACT, 0.0, long * (len(self.x) + 2) * 2.0**-52)

    def floor(self, j: int, sums: np.ndarray, slack: np.ndarray) -> float:
        """The k-th best score that query j has for certain."""
        known = float(-self.best[j][-1][0]) if len(self.best[j]) == self.k else -np.inf
        if len(sums) > 4 * self.k:
            known = max(known, np.partition(_within(sums - slack), len(sums) - self.k)[len(sums) - self.k])
        return known

    def keep(self, j: int, at: np.ndarray, sums: np.ndarray) -> None:
        """Take the best of the finished candidates ``at`` to query j's."""
        own = self.ids[at] != self.q_ids[j]
        at, sums = at[own], sums[own]
        margin = self.margin(j, at)
        near = _within(sums + margin) >= self.floor(j, sums, margin)
        at, sums, margin = at[near], sums[near], margin[near]
        if len(at) > self.k and not margin.any():
            top = np.lexsort((self.ids[at], -sums))[: self.k]
            at, sums, margin = at[top], sums[top], margin[top]
        found = [(-(int(s) if e == 0 else _score(self.x[:, i], self.q[:, j])), int(self.ids[i])) for i, s, e in zip(at.tolist(), sums.tolist(), margin.tolist(), strict=True)]
        self.best[j] = sorted(self.best[j] + found)[: self.k]

    def search(self) -> None:
        dims, n = self.x.shape
        x, q = self.x, self.q
        starts = list(range(0, dims, DIMS)) or [0]
        rest = lambda m: np.sqrt(np.cumsum((m**2)[::-1], axis=0)[::-1])
        rest_x, rest_q = rest(x), rest(q)
        sums = q[: starts[0] + DIMS].T @ x[: starts[0] + DIMS]  # all queries at once
        self.work += sums.size * min(DIMS, dims)
        every, few = np.arange(n), {}
        many = list(range(q.shape[1]))
        for step, start in enumerate(starts):
            if step:
                rows = slice(start, start + DIMS)
                width = min(DIMS, dims - start)
                if many:
                    sums[many] += q[rows, many].T @ x[rows]
                    self.work += len(many) * n * width
                for j, (at, part) in few.items():
                    few[j] = at, part + q[rows, j] @ x[rows, at]
                    self.work += len(at) * width
            if step + 1 == len(starts):
                break
            left_x, left_q = rest_x[start + DIMS], rest_q[start + DIMS]
            for j in [*many, *few]:
                at, part = few.get(j, (every, sums[j]))
                if len(at) <= 4 * self.k:
                    continue
                slack = left_q[j] * left_x[at] * (1 + 1e-9) + 1e-6 + self.margin(j, at)
                # the query's own row may be among the certain ones, so that one more is asked for
                hope = np.flatnonzero(_within(part + slack) >= self._floor_but_own(j, at, part, slack))
                if len(hope) < 0.5 * len(at):
                    few[j] = at[hope], part[hope]
            many = [j for j in many if j not in few]
        for j in many:
            self.keep(j, every, sums[j])
        for j, (at, part) in few.items():
            self.keep(j, at, part)

    def _floor_but_own(self, j: int, at: np.ndarray, part: np.ndarray, slack: np.ndarray) -> float:
        own = self.ids[at] == self.q_ids[j]
        return self.floor(j, part[~own], slack[~own]) if own.any() else self.floor(j, part, slack)


def block_search(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int, best: list[Best]) -> float:
    """Improve ``best``, for each query its k best so far, by a block; returns the share of the products that were taken.

    ``x`` and ``q`` have a row for each dimension.  A candidate with the
    query's own id is passed over; ties go to the smaller id.
    """
    order = np.argsort(-(x**2).sum(1) * (q**2).sum(1), kind="stable")
    x, q = x[order], q[order]
    cut = min(FIRST, x.shape[1]) if any(len(b) < k for b in best) else 0
    work = 0
    for part in (slice(0, cut), slice(cut, None)):
        if len(ids[part]):
            chunk = _Chunk(ids[part], x[:, part], q_ids, q, k, best)
            chunk.search()
            work += chunk.work
    return work / max(x.size * q.shape[1], 1)


def _packed(vectors: DataFrame, size: int, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """dim, n, ids (binary), matrix (binary, vertical): blocks of at most ``size`` usable vectors of one dimension."""
    schema = pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("matrix", pa.binary())])

    def block(dim: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, rows = (np.concatenate(p) for p in zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(rows.T).tobytes()], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        count: dict[int, int] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            vectors = batch.column(1)
            lengths = np.array([-1 if v is None else v for v in vectors.value_lengths().to_pylist()])
            flat = vectors.flatten()
            ends = np.cumsum(np.maximum(lengths, 0))
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
            for dim in np.unique(lengths[lengths >= 0]).tolist():
                at = np.flatnonzero(lengths == dim)
                rows = values[(ends[at] - dim)[:, None] + np.arange(dim)] if dim else np.zeros((len(at), 0))
                with np.errstate(over="ignore", invalid="ignore"):
                    rows = np.floor(rows * scale)
                    good = (np.abs(rows) < 2.0**63).all(1)  # neither NaN nor infinite
                at, rows = at[good], rows[good]
                for lo in range(0, len(at), size):
                    part = ids[at[lo : lo + size]].astype(np.int64), rows[lo : lo + size]
                    if count.get(dim, 0) + len(part[0]) > size:
                        yield block(dim, held.pop(dim))
                        count[dim] = 0
                    held.setdefault(dim, []).append(part)
                    count[dim] = count.get(dim, 0) + len(part[0])
        for dim, parts in held.items():
            yield block(dim, parts)

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter("id is not null and v is not null").mapInArrow(run, "dim int, n int, ids binary, matrix binary")


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id (long), rank (int, from 1), vec_id, score (long): the k highest inner products of floor(scale * x).

    Vectors that are null or hold a null or non-finite component take no part,
    nor do those with a component whose floor(scale * x) is no 64-bit integer
    and rows without an id; vectors meet those of their own dimension only.
    Scores beyond 64 bits are given as the nearest number that fits.
    A query doesn't meet rows with its own id.  Ties go to the smaller id, and
    rows repeated under one id each count.  Fewer than k rows: all.  Other
    columns are not read.

    Query blocks are dealt to groups of candidate blocks by an equi-join, so
    the traffic is that of blocks, and each task sends on at most k rows a query
    and CARRIED query blocks.
    """
    spark = candidates.sparkSession
    # no more groups than blocks, so that no copy of the queries meets nothing
    groups = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-candidates.count() // CANDIDATE_BLOCK)))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: OrderedDict[int, tuple[np.ndarray, list[Best]]] = OrderedDict()

        def out(q_ids: np.ndarray, best: list[Best]) -> pa.RecordBatch:
            rows = [(own, i, -s) for own, b in zip(q_ids.tolist(), best, strict=True) for s, i in b]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema=schema)

        for batch in batches:
            for row in range(batch.num_rows):
                dim, n, ids, matrix, number, m, q_ids, q_matrix = (batch.column(c)[row] for c in range(8))
                dim, n, m, number = dim.as_py(), n.as_py(), m.as_py(), number.as_py()
                own, best = carried.pop(number, None) or (np.frombuffer(q_ids.as_py(), np.int64), [[] for _ in range(m)])
                block_search(
                    np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(matrix.as_buffer(), np.float64).reshape(dim, n),
                    own, np.frombuffer(q_matrix.as_buffer(), np.float64).reshape(dim, m), k, best,
                )
                carried[number] = own, best
                if len(carried) > CARRIED:
                    yield out(*carried.popitem(last=False)[1])
        for held in carried.values():
            yield out(*held)

    blocks = _packed(candidates, CANDIDATE_BLOCK, id_col, vec_col, scale).withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))
    asked = _packed(queries, QUERY_BLOCK, id_col, vec_col, scale).select("dim", F.monotonically_increasing_id().alias("number"), F.col("n").alias("m"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    pairs = blocks.join(asked, ["g", "dim"]).select("dim", "n", "ids", "matrix", "number", "m", "q_ids", "q_matrix")
    found = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
