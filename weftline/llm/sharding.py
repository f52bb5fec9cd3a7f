"""Sharding by sampled splitters: size-weighted key samples give quantile boundaries, records are range-partitioned by
them, and ranges that came out overfull are sampled again and subdivided."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.store import written

OVERHEAD = 16


def _place(keys: np.ndarray, ids: np.ndarray, bound_keys: np.ndarray, bound_ids: np.ndarray) -> np.ndarray:
    """How many of the sorted bounds (key, id) are at or below each (key, id)."""
    lo, hi = np.searchsorted(bound_keys, keys, "left"), np.searchsorted(bound_keys, keys, "right")
    out = lo.copy()
    inside = np.flatnonzero(hi > lo)
    for key in np.unique(keys[inside]):
        rows = inside[keys[inside] == key]
        out[rows] = lo[rows[0]] + np.searchsorted(bound_ids[lo[rows[0]] : hi[rows[0]]], ids[rows], "right")
    return out.astype(np.int32)


def _ranged(meta: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    bound_keys, bound_ids = (np.array([b[i] for b in bounds], np.int64) for i in (0, 1))

    @F.pandas_udf("int")
    def place(key: pd.Series, row_key: pd.Series) -> pd.Series:
        return pd.Series(_place(key.to_numpy(), row_key.to_numpy(), bound_keys, bound_ids))

    return meta.withColumn("range", place("key", "row_key"))


def _splitters(sample: list, pieces: int) -> list[tuple[int, int]]:
    """Boundaries between `pieces` quantiles of a weighted sample of (key, row_key, weight)."""
    sample = sorted(sample)
    total, run, out = sum(w for *_, w in sample), 0.0, []
    for key, row_key, w in sample:
        if run >= total * (len(out) + 1) / pieces:
            out.append((key, row_key))
        run += w
    return out


def assign_shards(docs: DataFrame, *, shards: int = 40, ranges_per_shard: int = 16, rows_per_range: int = 250_000, sample_per_range: int = 24, rounds: int = 6) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): every row of docs, shards of near-equal bytes.

    The order is (hash of the text, doc_id), so equal texts lie together and one that outweighs a range is split by
    doc_id. Sizes are the text's UTF-8 bytes plus 16; a shard's bytes differ from the mean by less than the largest
    row. Null text is empty. Rows without doc_id and rows that repeat a doc_id are placed like any other. The driver
    holds the sample: about sample_per_range rows for each range, one range for rows_per_range rows or less.
    An empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    meta = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"))
    meta = written(meta.withColumn("row_key", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))), "shard-meta")
    total, n = meta.agg(F.sum("size"), F.count("*")).first()
    out = "doc_id long, size long, text_crc32 long, shard int, slot long"
    if not n:
        return docs.sparkSession.createDataFrame([], out)
    ranges = max(shards * ranges_per_shard, -(-n // rows_per_range))
    most = 2 * total / ranges

    def draw(rows: DataFrame, per_byte: float, round_no: int) -> list:
        """Rows with a chance in proportion to size, weighted by what they stand for."""
        chance = F.least(F.lit(1.0), F.col("size") * per_byte)
        uniform = F.xxhash64("key", "row_key", F.lit(round_no)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
        return [tuple(r) for r in rows.where(uniform < chance).select("key", "row_key", F.col("size") / chance).collect()]

    bounds = _splitters(draw(meta, ranges * sample_per_range / total, 0), ranges)
    for at in range(1, rounds):
        ranged = _ranged(meta, bounds)
        full = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count_distinct("key", "row_key").alias("n") if at > 2 else F.count("*").alias("n")).where((F.col("bytes") > most) & (F.col("n") > 1)).collect()
        if not full:
            break
        inside = F.broadcast(docs.sparkSession.createDataFrame([(r["range"],) for r in full], "range int"))
        drawn = _ranged_sample(draw(ranged.join(inside, "range", "left_semi"), ranges * sample_per_range / total, at), bounds)
        more = {b for r in full for b in _splitters(drawn.get(r["range"], []), -(-2 * r["bytes"] // int(most + 1)))}
        if more <= set(bounds):
            break
        bounds = sorted({*bounds, *more})
    ranged = _ranged(meta, bounds)
    sums = sorted(tuple(r) for r in ranged.groupBy("range").agg(F.sum("size"), F.count("*")).collect())
    starts, run_bytes, run_rows = [], 0, 0
    for at, b, c in sums:
        starts.append((at, run_bytes, run_rows))
        run_bytes, run_rows = run_bytes + b, run_rows + c
    starts = F.broadcast(docs.sparkSession.createDataFrame(starts, "range int, first_byte long, first_row long"))
    order = Window.partitionBy("range").orderBy("key", "row_key", "size", "text_crc32")
    placed = ranged.withColumns({"before": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"), "nth": F.row_number().over(order) - 1}).join(starts, "range")
    middle = (F.col("first_byte") + F.col("before") + F.col("size") / 2) * shards / F.lit(total)
    placed = written(placed.select("doc_id", "size", "text_crc32", F.least(F.floor(middle), F.lit(shards - 1)).cast("int").alias("shard"), (F.col("first_row") + F.col("nth")).cast("long").alias("nth")), "shard-placed")
    first = F.broadcast(placed.groupBy("shard").agg(F.min("nth").alias("first")))
    return placed.join(first, "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("nth") - F.col("first")).alias("slot"))


def _ranged_sample(sample: list, bounds: list) -> dict[int, list]:
    if not sample:
        return {}
    keys, ids = (np.array([s[i] for s in sample], np.int64) for i in (0, 1))
    places = _place(keys, ids, *(np.array([b[i] for b in bounds], np.int64) for i in (0, 1)))
    out: dict[int, list] = {}
    for at, row in zip(places.tolist(), sample, strict=True):
        out.setdefault(at, []).append(row)
    return out


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write docs as Parquet, a folder for each shard, rows in slot order; docs needs one row a doc_id."""
    placed = assign_shards(docs, **options).select("doc_id", "shard", "slot")
    docs.join(placed, "doc_id").repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    placed = assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
