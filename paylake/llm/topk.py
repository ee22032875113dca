"""Exact top-k by inner product with the three-phase uniform threshold.

The components of the vectors are cut into ``LISTS`` runs; a run gives every
vector a partial score, and the score is their sum.  For a block of queries:

1. Each task finds, per query and list, its ``k`` best partial scores, resolves
   those vectors' scores, and reports its ``k`` best; the ``k``-th best of all
   reports is a safe cutoff ``T`` (never above the true ``k``-th score).
2. The cutoffs (one integer per query of the block) are broadcast.  A vector
   whose partial scores all lie below ``T / LISTS`` can't reach ``T``; all other
   entries are collected.
3. Scores of the collected entries are resolved exactly in integers, and the
   best ``k`` are merged, ties to the smaller id.

Queries go in blocks of bounded size (``QUERY_BLOCK``), each against all rows;
rows meet the queries in vectorised blocks and only ``k`` rows per query and
task are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Fixed values of the task.
SCALE, K, QUERY_STEP = 1024, 10, 100
LISTS = 2
#: Queries of one broadcast block: its size is at most this times a vector's.
QUERY_BLOCK = 4096
#: Rows that meet a query block in one vectorised step.
ROW_BLOCK = 2048
_LONG = 2**63 - 1
_EXACT = 2.0**52


def vectors(table: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of rows that take part: an id, a vector of at
    least one component, none of them null or not finite."""
    v = F.col("embedding").cast("array<double>")
    return (table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
            .filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(F.size("v") > 0)
            .filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)))))


def query_blocks(rows: DataFrame, step: int, block: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(ids, vectors) of the queries, at most ``block`` at a time: rows whose id is
    divisible by ``step``, one per id (the smallest vector, where an id repeats)."""
    chosen = common.staged(rows.filter(F.pmod("vec_id", F.lit(step)) == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    last: int | None = None
    while True:
        part = chosen if last is None else chosen.filter(F.col("vec_id") > last)
        got = part.orderBy("vec_id").limit(block).collect()            # bounded by the block
        if not got:
            return
        yield np.array([r.vec_id for r in got], np.int64), [np.array(r.v) for r in got]
        if len(got) < block:
            return
        last = got[-1].vec_id


def row_blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of up to ``most`` neighbouring rows of one length."""
    held: dict[int, list] = {}
    for batch in batches:
        ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
        lists = batch.column("v")
        off = lists.offsets.to_numpy(zero_copy_only=False)
        flat = lists.values.to_numpy(zero_copy_only=False)
        sizes = np.diff(off)
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            got = held.setdefault(int(dim), [])
            got.append((ids[at], flat[off[at][:, None] + np.arange(dim)]))
            if sum(len(x) for x, _ in got) >= most:
                yield np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got])
                held[int(dim)] = []
    for got in held.values():
        if got:
            yield np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got])


def integers(x: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * x)


class Queries:
    """A block of queries, grouped by vector length; integers held as doubles."""

    def __init__(self, ids: np.ndarray, vecs: list[np.ndarray]):
        self.groups: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        dims = np.array([len(v) for v in vecs])
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            self.groups[int(dim)] = ids[at], integers(np.array([vecs[i] for i in at]))


def partials(q: np.ndarray, rows: np.ndarray, lists: int) -> list[np.ndarray]:
    """Partial scores (queries x rows) of each list, as doubles."""
    edges = np.linspace(0, q.shape[1], lists + 1).astype(int)
    return [q[:, a:b] @ rows[:, a:b].T for a, b in zip(edges[:-1], edges[1:])]


def slack(q: np.ndarray, rows: np.ndarray) -> float:
    """How far a partial score in doubles can be from the exact one."""
    most = float(np.abs(q).max(initial=0) * np.abs(rows).max(initial=0)) * q.shape[1]
    return 0.0 if most < _EXACT else most * 2.0**-40


def exact(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products of pairs (one row of ``q`` with one of ``rows``),
    held at the ends of the long range if they don't fit."""
    if slack(q, rows) == 0.0:
        return np.einsum("ij,ij->i", q, rows).astype(np.int64)
    return np.array([max(-_LONG - 1, min(_LONG, sum(int(a) * int(b) for a, b in zip(x, y)))) for x, y in zip(q, rows)], np.int64)


def best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k best entries of each query (score down, id up)."""
    order = np.lexsort((vec, -score.astype(np.float64), query))
    if len(order) and np.abs(score).max() > 2**52:                 # doubles don't tell such scores apart
        order = np.array(sorted(range(len(query)), key=lambda i: (query[i], -int(score[i]), vec[i])), np.int64)
    group = query[order]
    first = np.searchsorted(group, group, side="left")
    return order[np.arange(len(order)) - first < k]


def _search(queries: Queries, cutoff: dict[int, int] | None, k: int, lists: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for ids, raw in row_blocks(batches, ROW_BLOCK):
            if raw.shape[1] not in queries.groups:
                continue
            all_ids, all_q = queries.groups[raw.shape[1]]
            rows = integers(raw)
            for a in range(0, len(all_ids), 1024):
                qid, q = all_ids[a:a + 1024], all_q[a:a + 1024]
                off = slack(q, rows)
                want = np.zeros((len(qid), len(ids)), bool)
                for part in partials(q, rows, lists):
                    if cutoff is None:                             # phase 1: each list's best entries
                        m = min(k + 1, len(ids))
                        top = np.argpartition(-part, m - 1, axis=1)[:, :m]
                        np.put_along_axis(want, top, True, axis=1)
                    else:                                          # phase 2: entries at or above the uniform share
                        share = np.array([cutoff.get(int(i), -_LONG - 1) / lists for i in qid])
                        want |= part >= (share - off - np.abs(share) * 2.0**-50)[:, None]
                want &= qid[:, None] != ids[None, :]
                i, j = np.nonzero(want)
                for s in range(0, len(i), 500_000):                # phase 3: exact scores
                    x, y = i[s:s + 500_000], j[s:s + 500_000]
                    held = [np.concatenate(p) for p in zip(held, (qid[x], ids[y], exact(q[x], rows[y])))]
                    keep = best(*held, k)
                    held = [p[keep] for p in held]
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(p) for p in held], names=["query_id", "vec_id", "score"])

    return run


def top_k(rows: DataFrame, queries: Queries, k: int = K, lists: int = LISTS) -> DataFrame:
    """query_id, rank, vec_id, score of one block of queries against all ``rows``
    (vec_id, v); a query's own id is left out.  Vectors of another length than
    the query's have no inner product with it and take no part."""
    schema = "query_id long, vec_id long, score long"
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = rows.mapInArrow(_search(queries, None, k, lists), schema)
    # the k-th best report of a query; fewer reports than k: no cutoff
    cut = (first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k)
           .select("query_id", "score").collect())                 # one row per query of the block
    cutoff = {r.query_id: r.score for r in cut}
    found = rows.mapInArrow(_search(queries, cutoff, k, lists), schema)
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def search(table: DataFrame, step: int = QUERY_STEP, k: int = K) -> DataFrame:
    """Top k of every query row (id divisible by ``step``) over all rows of
    (vec_id, embedding).

    Rows without id and vectors that are null, empty or hold a null or
    non-finite component take no part.  A query id on several rows is asked
    once (its smallest vector); as candidates such rows all count.
    """
    spark = table.sparkSession
    common.prepare(spark)
    rows = vectors(table)
    out = None
    for ids, vecs in query_blocks(rows, step, QUERY_BLOCK):
        part = common.staged(top_k(rows, Queries(ids, vecs), k), "topk")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return out


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest integer inner products of every 100th vector: query_id, rank, vec_id, score."""
    return search(common.table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM q JOIN v AS c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
