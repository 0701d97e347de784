"""Exact top-k inner products with block-at-a-time pruning.

Rows are cut into blocks of consecutive ids; a block keeps its vectors (the
forward index) and the largest and smallest value of each dimension (term
maxima).  For a query the maxima sum to a bound on any score in the block.
Blocks are taken in order of falling bounds and scored until a bound is below
the k-th score held.

Inputs and cases: vectors that are null, or hold null or non-finite components,
take no part; vectors of different lengths are compared as if the shorter ended
in zeros; rows that repeat an id count once, with the smallest vector; a null id
takes no part; an empty vector scores 0; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BLOCK = 128
#: Rows of one index part and queries of one query part: what a scoring task holds.
PART_ROWS = 16_384
PART_QUERIES = 1024
#: Exact in float64: sums of products stay below 2^53.
EXACT = 2.0**53


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) per component, x as double; null if any component is null or not finite."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(doubles, lambda x: F.floor(x * scale).cast("double")))


def _pack(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows (id, v) in id order, cut into parts of at most ``size`` rows: (part, ids, values as binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        vectors: list[list[float]] = []

        def part() -> pa.RecordBatch:
            width = max(map(len, vectors))
            m = np.zeros((len(vectors), width))
            for i, v in enumerate(vectors):
                m[i, : len(v)] = v
            return pa.RecordBatch.from_arrays(
                [pa.array([np.asarray(ids, "<i8").tobytes()]), pa.array([m.astype("<f8").tobytes()]), pa.array([width], pa.int32())],
                ["ids", "m", "width"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                vectors.append(v)
                if len(ids) == size:
                    yield part()
                    ids, vectors = [], []
        if ids:
            yield part()

    return rows.mapInArrow(run, "ids binary, m binary, width int").select(*[F.col(c).alias(f"{name}_{c}") for c in ("ids", "m", "width")])


def _matrix(ids: bytes, m: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    return i, np.frombuffer(m, "<f8").reshape(len(i), width)


def _product(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``q`` with all of ``d`` as whole numbers."""
    if not q.size or not d.size:
        return np.zeros((len(q), len(d)), dtype=np.int64)
    if np.abs(q).max() * np.abs(d).max() * q.shape[1] < EXACT:
        return (q @ d.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in d]
    return np.array([[sum(int(a) * b for a, b in zip(row, other)) for other in whole] for row in q], dtype=object)


def search_part(q_ids: np.ndarray, q: np.ndarray, d_ids: np.ndarray, d: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, row, score) of the k best rows of one index part for each query of one query part."""
    width = max(q.shape[1], d.shape[1])
    q = np.pad(q, ((0, 0), (0, width - q.shape[1])))
    d = np.pad(d, ((0, 0), (0, width - d.shape[1])))
    starts = range(0, len(d), BLOCK)
    high = np.array([d[s : s + BLOCK].max(axis=0) for s in starts])
    low = np.array([d[s : s + BLOCK].min(axis=0) for s in starts])
    # relative slack: bounds are only compared, scores are exact
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    bounds += np.abs(bounds) * 1e-12
    order = np.argsort(-bounds, axis=1, kind="stable")
    best: list[list[tuple[int, int]]] = [[] for _ in q_ids]
    kth = np.full(len(q_ids), -np.inf)
    active = np.arange(len(q_ids))
    for turn in range(len(high)):
        active = active[bounds[active, order[active, turn]] >= kth[active]]
        if not len(active):
            break
        blocks = order[active, turn]
        by_block = np.argsort(blocks, kind="stable")
        cuts = np.flatnonzero(np.diff(blocks[by_block])) + 1
        for group in np.split(by_block, cuts):
            queries, start = active[group], int(blocks[group[0]]) * BLOCK
            ids = d_ids[start : start + BLOCK]
            scores = _product(q[queries], d[start : start + BLOCK])
            for row, at in enumerate(queries):
                s = scores[row]
                near = np.flatnonzero((s >= kth[at]) & (ids != q_ids[at]))
                if not len(near):
                    continue
                held = sorted(best[at] + [(-int(s[j]), int(ids[j])) for j in near])[:k]
                best[at] = held
                if len(held) == k:
                    kth[at] = -held[-1][0]
    return [(int(q_ids[i]), row, -negative) for i, held in enumerate(best) for negative, row in held]


def top_k(vectors: DataFrame, vec_id: str, embedding: str, is_query: Column, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query row's k best other rows.

    Index parts and query parts are matched on a grid: query part x index part is
    one bounded unit of work, so neither side has to fit a task.  Every unit
    yields k rows a query; the final k are picked after a pre-aggregation.
    """
    clean = (
        vectors.select(F.col(vec_id).cast("long").alias("id"), quantised(F.col(embedding)).alias("v"), is_query.alias("asks"))
        .where("id is not null and v is not null")
        .groupBy("id").agg(F.min("v").alias("v"), F.max("asks").alias("asks"))
    )
    clean = stored(clean, "vectors")
    ordered = clean.repartitionByRange("id").sortWithinPartitions("id").select("id", "v")
    asked = clean.where("asks").repartitionByRange("id").sortWithinPartitions("id").select("id", "v")
    index, queries = _pack(ordered, PART_ROWS, "d"), _pack(asked, PART_QUERIES, "q")
    index = stored(index, "index-parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = search_part(*_matrix(r["q_ids"], r["q_m"], r["q_width"]), *_matrix(r["d_ids"], r["d_m"], r["d_width"]), k)
                columns = list(zip(*rows)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    units = queries.crossJoin(index)
    found = units.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
