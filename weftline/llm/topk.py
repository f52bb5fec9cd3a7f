"""Exact top-k search by distributed histogram selection.

Every candidate is scored against a block of queries; rounds of global score histograms narrow the place of each
query's kth value by eight bits a round, then one pass keeps what lies above it and the smallest ids of what equals it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.store import shared_dir, written

BITS = 8
BLOCK_ROWS = 2048
_SIGN = np.uint64(1 << 63)


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of each component as long; null ids and null or non-finite vectors are left out."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
    v = F.transform(vector_col, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    return kept.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def _matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    """Rows padded with zeros to dim."""
    n, offsets = len(lists), lists.offsets.to_numpy()
    flat = lists.values.to_numpy()[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    if n and (sizes == dim).all():
        return flat.reshape(n, dim)
    out = np.zeros((n, dim), np.int64)
    out[np.repeat(np.arange(n), sizes), np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat
    return out


def _blocks(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray) -> Iterator[tuple]:
    """Candidate ids, the score matrix and the mask of a query's own row, for a few thousand rows at a time."""
    dim, q_most = q.shape[1], int(np.abs(q).max(initial=0))
    q_float = q.astype(np.float64)
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            c_ids, c = part.column(0).to_numpy(), _matrix(part.column(1), dim)
            if q_most * int(np.abs(c).max(initial=0)) * max(dim, 1) < 1 << 53:
                s = (q_float @ c.astype(np.float64).T).astype(np.int64)
            else:
                s = q @ c.T  # wraps at 64 bits, as long arithmetic does
            yield c_ids, s, ids[:, None] == c_ids[None, :]


def _histogram(ids, q, base, prefix, level):
    """A mapInArrow function: counts by query and by the bits of this level, of scores that match the prefix so far."""

    def run(batches):
        total = np.zeros((len(ids), 1 << BITS), np.int64)
        for _, s, own in _blocks(batches, ids, q):
            u = _unsigned(s, base)
            live = ~own
            if level is not None and prefix is not None:
                live &= (u >> np.uint64(BITS * (level + 1))) == prefix[:, None]
            row, col = np.nonzero(live)
            digit = ((u[row, col] >> np.uint64(BITS * level)) & np.uint64((1 << BITS) - 1)).astype(np.int64)
            total += np.bincount(row * (1 << BITS) + digit, minlength=total.size).reshape(total.shape)
        row, digit = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(digit, pa.int32()), pa.array(total[row, digit], pa.int64())], ["q", "digit", "n"])

    return run


def _unsigned(s: np.ndarray, base: int | None) -> np.ndarray:
    """Scores as unsigned numbers in the same order."""
    return s.view(np.uint64) ^ _SIGN if base is None else (s + np.int64(base)).view(np.uint64)


def _taken(ids, q, base, kth, ties, open_end):
    """A mapInArrow function: all above the kth value, and of its equals the smallest ids that could still be taken."""

    def run(batches):
        equal: dict[int, np.ndarray] = {}
        for c_ids, s, own in _blocks(batches, ids, q):
            u = _unsigned(s, base)
            row, col = np.nonzero(~own & (open_end[:, None] | (u > kth[:, None])))
            yield _found(ids[row], c_ids[col], s[row, col])
            same = ~own & ~open_end[:, None] & (u == kth[:, None])
            for k in np.flatnonzero(same.any(axis=1)):
                near = np.concatenate([equal.get(k, np.empty(0, np.int64)), c_ids[same[k]]])
                equal[k] = np.sort(near)[: ties[k]]
        for k, near in equal.items():
            score = np.uint64(kth[k]) ^ _SIGN if base is None else np.uint64(kth[k]) - np.uint64(base)
            yield _found(np.full(len(near), ids[k]), near, np.full(len(near), np.array(score, np.uint64).view(np.int64)))

    return run


def _found(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["query_id", "vec_id", "score"])


def top_k(df: DataFrame, is_query: Column, *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, chunk: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best inner products of each query row with every other row.

    Queries go through in chunks of about `chunk` rows; what the driver and a broadcast hold is bounded by a chunk
    (its vectors, and 256 counts a query), whatever the table's size. Null ids, null vectors and vectors that hold
    null, NaN or infinite components take no part. Shorter vectors count as padded with zeros (an empty one scores 0).
    Ties go to the smaller id. Rows that repeat an id are candidates each, but not of a query with that id; a repeated
    query counts once, with the smallest of its vectors. An empty table gives an empty result.
    """
    spark = df.sparkSession
    rows = written(quantised(df, id_col, vector_col, scale), "topk-rows")
    queries = quantised(df.where(is_query), id_col, vector_col, scale).groupBy("id").agg(F.min("v").alias("v"))
    n_queries, dim, most = rows.join(queries.select("id").distinct(), "id", "left_semi").select("id").distinct().count(), *rows.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    out = f"{shared_dir(spark)}/weftline-topk-{uuid.uuid4().hex}"
    schema = "query_id long, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(out)
    n_chunks = -(-n_queries // chunk)
    queries = written(queries.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(max(1, n_chunks))).cast("int")), "topk-queries") if n_chunks else None
    for at in range(n_chunks):
        own = queries.where(F.col("chunk") == at).select("id", "v").toArrow()
        if not own.num_rows:
            continue
        ids, q = own["id"].to_numpy(), _matrix(own["v"].combine_chunks(), dim)
        bound = int(np.abs(q).max(initial=0)) * (most or 0) * max(dim, 1)
        base, bits = (bound, (2 * bound).bit_length()) if bound < 1 << 61 else (None, 64)
        prefix, need, open_end = None, np.full(len(ids), k), np.zeros(len(ids), bool)
        for level in reversed(range(max(1, -(-bits // BITS)))):
            counted = rows.mapInArrow(_histogram(ids, q, base, prefix, level), "q int, digit int, n long")
            found = counted.groupBy("q", "digit").agg(F.sum("n").alias("n")).toArrow()
            hist = np.zeros((len(ids), 1 << BITS), np.int64)
            hist[found["q"].to_numpy(), found["digit"].to_numpy()] = found["n"].to_numpy()
            above = hist[:, ::-1].cumsum(axis=1)
            open_end |= above[:, -1] < need
            step = np.argmax(above >= need[:, None], axis=1)
            need = np.where(open_end, need, need - np.where(step > 0, above[np.arange(len(ids)), step - 1], 0))
            digit = ((1 << BITS) - 1 - step).astype(np.uint64)
            prefix = digit if prefix is None else (prefix << np.uint64(BITS)) | digit
        rows.mapInArrow(_taken(ids, q, base, prefix, need, open_end), schema).write.mode("append").parquet(out)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = spark.read.schema(schema).parquet(out).withColumn("rank", F.row_number().over(best))
    return found.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_exact_topk(spark, sf_dir: str) -> DataFrame:
    """Ten best of every row whose vec_id is divisible by 100, against all other rows."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
