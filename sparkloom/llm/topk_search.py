"""Exact top-k by inner product: a three-phase uniform threshold search.

A score is the sum of the partial scores of a few blocks of components.  Phase one
gathers, for each query and block, the vectors with the best partial scores and adds up the
whole scores of these alone; the k-th best of those is a safe cutoff, since k vectors reach it.  A
vector whose blocks all stay below cutoff / blocks cannot reach the cutoff, so phase two
collects only those with a block at or above it and a bound (the lengths of what is left of both vectors)
that can still reach it, block by block, and phase three adds up the
whole scores of what remains exactly and keeps the best k.

Queries are packed and handled PASS bytes at a time, in one pass over all vectors for each phase, so what is
broadcast (query vectors and cutoffs) does not grow with the table; a worker compares BLOCK of them at once.

Defined results: rows with a null id, a null vector, or a null or non-finite component take no part;
vectors of different lengths are compared over their common leading components; every query row asks, and every row
but itself is a candidate, those that share its id included (rows that share the id of several query rows give them
the same answers under that id); equal scores rank by the
smaller id; repeated rows count each; a score outside the range of a long is held at the nearest long; empty tables
give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Queries compared at once, rows scored at once, bytes of query vectors in one pass over the table.
BLOCK, ROWS, PASS = 1024, 2048, 32 << 20
SCHEMA = "query long, query_id long, vec_id long, score long"
LOW = -(2**63)


def whole(vectors: pa.Array, ids: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and integer components of the rows that take part; shorter vectors are filled with zeros."""
    size = np.asarray(vectors.value_lengths().fill_null(0)).astype(np.int64)
    good = np.asarray(vectors.is_valid()) & np.asarray(ids.is_valid())
    inner = vectors.flatten()
    x = np.asarray(inner.fill_null(float("nan")).cast(pa.float64()), dtype=np.float64)
    size[~np.asarray(vectors.is_valid())] = 0
    row = np.repeat(np.arange(len(vectors)), size)
    good[row[~np.isfinite(x)]] = False
    out = np.zeros((len(vectors), int(size.max(initial=0))))
    out[row, np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)] = np.where(np.isfinite(x), np.floor(scale * np.where(np.isfinite(x), x, 0)), 0)
    return np.asarray(ids.fill_null(0)).astype(np.int64)[good], out[good]


def product(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact inner products as int64."""
    n = min(rows.shape[1], queries.shape[1])
    rows, queries = rows[:, :n], queries[:, :n]
    if not n or not rows.size or not queries.size:
        return np.zeros((len(rows), len(queries)), np.int64)
    if np.abs(rows).max() * np.abs(queries).max() * n < 2**53:
        return (rows @ queries.T).astype(np.int64)
    exact = np.array([[int(v) for v in r] for r in rows], dtype=object) @ np.array([[int(v) for v in q] for q in queries], dtype=object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def blocks_of(rows: np.ndarray, queries: np.ndarray, blocks: int) -> list[slice]:
    """Components dealt in blocks; one block where they are few, or so large that sums of floats would not be exact."""
    n = min(rows.shape[1], queries.shape[1])
    large = np.abs(rows[:, :n]).max(initial=0) * np.abs(queries[:, :n]).max(initial=0) * max(n, 1) >= 2**53
    cuts = np.linspace(0, n, blocks + 1).astype(int) if n >= blocks and not large else np.array([0, n])
    return [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def gathered(rows: np.ndarray, queries: np.ndarray, blocks: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, query and whole score of those that are among the best of a query in one block at least."""
    parts = [product(rows[:, b], queries[:, b]) for b in blocks_of(rows, queries, blocks)]
    chosen = np.zeros(parts[0].shape, bool)
    for part in parts:
        if len(part) <= most:
            chosen[:] = True
        else:
            np.put_along_axis(chosen, np.argpartition(part, -most, axis=0)[-most:], True, axis=0)
    r, c = np.nonzero(chosen)
    return r, c, sum(part[r, c] for part in parts)


def survivors(rows: np.ndarray, queries: np.ndarray, blocks: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, query and whole score of all that can reach their query's cutoff: some block has its share, and the blocks so far and a bound on the rest still reach it."""
    cuts = blocks_of(rows, queries, blocks)
    if len(cuts) == 1:
        total = product(rows, queries)
        r, c = np.nonzero(total >= least[None, :])
        return r, c, total[r, c]
    n = cuts[-1].stop
    share = np.floor(np.maximum(least, -(2**62)) / len(cuts))
    # lengths of what comes after each block, rounded up
    left = lambda x, b: np.sqrt((x[:, b.stop : n] ** 2).sum(axis=1)) * (1 + 1e-9)
    first = product(rows[:, cuts[0]], queries[:, cuts[0]])
    r, c = np.nonzero(first + np.outer(left(rows, cuts[0]), left(queries, cuts[0])) >= least[None, :])
    score = first[r, c]
    reached = score >= share[c]
    for b in cuts[1:]:
        part = pairwise(rows[:, b], queries[:, b], r, c)
        score, reached = score + part, reached | (part >= share[c])
        able = score + left(rows, b)[r] * left(queries, b)[c] >= least[c]
        r, c, score, reached = r[able], c[able], score[able], reached[able]
    return r[reached], c[reached], score[reached]


def pairwise(rows: np.ndarray, queries: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Partial scores of the pairs r, c alone, or of all at once where most are asked for."""
    if 4 * len(r) > len(rows) * len(queries):
        return product(rows, queries)[r, c]
    out = np.empty(len(r), np.int64)
    for at in range(0, len(r), 1 << 18):
        i, j = r[at : at + (1 << 18)], c[at : at + (1 << 18)]
        out[at : at + (1 << 18)] = np.einsum("ij,ij->i", rows[i], queries[j]).astype(np.int64)
    return out


def best_of(kept: list[np.ndarray], more: tuple[np.ndarray, ...], k: int) -> list[np.ndarray]:
    """Of (query, score, id) arrays the k best of each query."""
    query, score, ids = (np.concatenate(x) for x in zip(kept, more, strict=True))
    order = np.lexsort((ids, -np.maximum(score, LOW + 1), query))
    of = query[order]
    first = np.arange(len(of)) - np.searchsorted(of, of) < k
    return [x[order][first] for x in (query, score, ids)]


def parts_of(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            piece = batch.slice(at, ROWS)
            ids, rows = whole(piece.column(1), piece.column(0), scale)
            if len(ids):
                yield ids, rows


def packed_queries(queries: DataFrame, scale: int) -> DataFrame:
    """The queries that take part, a few rows of ids and whole components each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in parts_of(batches, scale):
            yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()]), pa.array([rows.tobytes()]), pa.array([rows.nbytes], pa.int64())], names=["ids", "rows", "bytes"])

    return queries.mapInArrow(work, "ids binary, rows binary, bytes long")


def passes(packed: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and components of PASS bytes of queries, or a row of them, at a time."""
    ids: list = []
    rows: list = []
    size = 0

    def joined() -> tuple[np.ndarray, np.ndarray]:
        wide = max(x.shape[1] for x in rows)
        return np.concatenate(ids), np.concatenate([np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in rows])

    for r in packed.toLocalIterator():
        if size and size + r.bytes > PASS:
            yield joined()
            ids, rows, size = [], [], 0
        ids.append(np.frombuffer(r.ids, np.int64))
        rows.append(np.frombuffer(r.rows, np.float64).reshape(len(ids[-1]), -1))
        size += r.bytes
    if ids:
        yield joined()


def search(vectors: DataFrame, query_ids: np.ndarray, queries: np.ndarray, first: int, k: int, scale: int, blocks: int) -> DataFrame:
    """At least the k + 1 best rows, the query's own among them, for each of these queries, numbered from first on."""
    spark = vectors.sparkSession
    given = spark.sparkContext.broadcast((query_ids, queries))
    ranges = [slice(at, at + BLOCK) for at in range(0, len(query_ids), BLOCK)]
    most = k + 1  # the query's own row is one of them

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = given.value[1]
        kept = [[np.zeros(0, np.int64)] * 3 for _ in ranges]
        for ids, rows in parts_of(batches, scale):
            for i, part in enumerate(ranges):
                r, c, score = gathered(rows, q[part], blocks, most)
                kept[i] = best_of(kept[i], (c, score, ids[r]), most)
        for part, (c, score, _) in zip(ranges, kept, strict=True):
            cut = np.searchsorted(c, np.arange(len(q[part]) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(score))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.start, part.start + len(lists))), lists], names=["query", "scores"])

    lists = vectors.mapInArrow(gather, "query long, scores array<long>")
    merged = lists.groupBy("query").agg(F.slice(F.sort_array(F.flatten(F.collect_list("scores")), asc=False), 1, most).alias("scores"))
    least = np.full(len(query_ids), LOW)
    for r in merged.where(F.size("scores") == most).select("query", F.element_at("scores", -1).alias("least")).collect():  # one row a query of this pass
        least[r.query] = r.least
    safe = spark.sparkContext.broadcast(least)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = given.value
        kept = [[np.zeros(0, np.int64)] * 3 for _ in ranges]
        for ids, rows in parts_of(batches, scale):
            for i, part in enumerate(ranges):
                r, c, score = survivors(rows, q[part], blocks, safe.value[part])
                kept[i] = best_of(kept[i], (c, score, ids[r]), most)
        for part, (c, score, ids) in zip(ranges, kept, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(c + part.start + first), pa.array(q_ids[part][c]), pa.array(ids), pa.array(score)], names=["query", "query_id", "vec_id", "score"])

    return vectors.mapInArrow(collect, SCHEMA)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, blocks: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row of queries, which are rows of vectors, the k other rows with the highest inner product: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    vectors, queries = (df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")) for df in (vectors, queries))
    entries = spark.createDataFrame([], SCHEMA + ", own long")
    asked, waiting = 0, None
    for ids, rows in passes(packed_queries(queries, scale)):
        if waiting is not None:
            entries = entries.unionByName(common.stored(waiting))
        own = np.array([product(x[None], x[None])[0, 0] for x in rows], np.int64)
        known = spark.createDataFrame(pa.table({"query": np.arange(asked, asked + len(ids)), "own": own}))
        waiting = search(vectors, ids, rows, asked, k, scale, blocks).join(F.broadcast(known), "query")  # PASS bytes of queries at most
        asked += len(ids)
    if waiting is not None:
        entries = entries.unionByName(waiting) if asked > len(ids) else waiting
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("vec_id"))
    # the query's own row is one of those with its id and its score, which are all alike
    itself = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own"))
    best = entries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    places = Window.partitionBy("query")
    best = best.withColumn("itself", F.min(F.when(itself, F.col("rank"))).over(places)).where(F.col("itself").isNull() | (F.col("rank") != F.col("itself")))
    best = best.withColumn("rank", (F.col("rank") - (F.col("rank") > F.coalesce("itself", F.lit(k + 1))).cast("int")).cast("int"))
    return best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_exact_topk(spark, sf_dir):
    vectors = common.table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(coalesce(list_sum([p[1] * p[2] FOR p IN list_zip(q.e, c.e)]), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.n <> c.n),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
