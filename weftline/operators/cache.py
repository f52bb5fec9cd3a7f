"""The page cache: least recently used eviction and time to live over a log of requests, and reuse of parsed pages."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def cache_key(url, selectors):
    """Selectors stay apart: ['a,b'] and ['a', 'b'] are different keys."""
    return F.struct(url.alias("url"), F.array_sort(selectors).alias("selectors"))


def ttl_hits(log: DataFrame, key: str, at: str, ttl_ms: int) -> DataFrame:
    """log with hit: whether a read-through cache without bound holds the key at that time.

    A miss fetches and sets it; it lives ttl_ms from the set, not from later reads, and is gone at that very moment.
    Requests at the moment of the set come before what is fetched: all of them miss, whatever their order.
    Which requests set a key depends on the set before, so each key's own requests are walked in order; keys are
    independent.
    """
    schema = T.StructType([*log.schema.fields, T.StructField("hit", T.BooleanType())])
    ordered = log.repartition(F.col(key)).sortWithinPartitions(key, at)

    def by_partition(batches):
        now, since = None, None
        for batch in batches:
            hits = []
            for k, t in zip(batch[key], batch[at], strict=True):
                if k != now:
                    now, since = k, None
                hits.append(since is not None and since < t < since + ttl_ms)
                if not hits[-1]:
                    since = t
            yield batch.assign(hit=hits)

    return ordered.mapInPandas(by_partition, schema)


def lru_hits(log: DataFrame, shard: str, key: str, at: str, capacity: int, block: Column | None = None) -> DataFrame:
    """log with hit, for one cache of `capacity` keys a shard: a key is held if fewer than capacity other keys were asked
    for since it was asked for last.

    block cuts a shard's time: an expression of `at` that never falls as `at` grows. Each block is walked by a task of
    its own, which starts from the keys held at the block's start; those follow from the last `capacity` keys of each
    block before, so only capacity rows a block meet in one task. Without block a shard is one block.
    """
    names = log.columns
    rows = log.withColumns({"_block": F.lit(0) if block is None else block, "_turn": F.lit(0).cast("long")})
    if block is not None:
        rows = rows.unionByName(_held_at_start(rows, shard, key, at, capacity), allowMissingColumns=True)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, OrderedDict()
        for batch in batches:
            hits = []
            turns = batch["_turn"].to_pylist()
            for k, turn, *of in zip(batch[key].to_pylist(), turns, batch[shard].to_pylist(), batch["_block"].to_pylist(), strict=True):
                if of != now:
                    now, held = of, OrderedDict()
                hits.append(k in held)
                held[k] = True
                held.move_to_end(k)
                if len(held) > capacity:
                    held.popitem(last=False)
            out = pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(hits, pa.bool_())], [*names, "hit"])
            yield out.filter(pa.array([turn == 0 for turn in turns], pa.bool_()))

    ordered = rows.repartition(F.col(shard), F.col("_block")).sortWithinPartitions(shard, "_block", "_turn", at)
    return ordered.mapInArrow(walk, T.StructType([*log.schema.fields, T.StructField("hit", T.BooleanType())]))


def _held_at_start(rows: DataFrame, shard: str, key: str, at: str, capacity: int) -> DataFrame:
    """(shard, _block, key, _turn): the keys held when a block starts, the one asked for last with the highest _turn, -1."""
    newest = Window.partitionBy(shard, "_block").orderBy(F.desc("_last"))
    ends = rows.groupBy(shard, "_block", key).agg(F.max(at).alias("_last")).withColumn("_turn", -F.row_number().over(newest).cast("long")).where(F.col("_turn") >= -capacity)
    names = [shard, "_block", key, "_turn"]

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = (None, None), OrderedDict()
        for batch in batches:
            out = []
            for s, b, k in zip(*(batch[c].to_pylist() for c in names[:3]), strict=True):
                if (s, b) != now:
                    if s != now[0]:
                        held = OrderedDict()
                    now = (s, b)
                    out += [(s, b, h, i - len(held)) for i, h in enumerate(held)]
                held[k] = True
                held.move_to_end(k)
                if len(held) > capacity:
                    held.popitem(last=False)
            columns = zip(*out, strict=True) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), batch.schema.field(n).type) for c, n in zip(columns, names, strict=True)], names)

    ordered = ends.select(*names).repartition(F.col(shard)).sortWithinPartitions(shard, "_block", "_turn")
    return ordered.mapInArrow(carry, ordered.schema)


def cache_stats(log: DataFrame, by: str, hit: str = "hit") -> DataFrame:
    """(by, requests, hits, misses, hit_rate)."""
    out = log.groupBy(by).agg(F.count("*").alias("requests"), F.count_if(F.col(hit)).alias("hits"))
    return out.withColumns({"misses": F.col("requests") - F.col("hits"), "hit_rate": F.col("hits") / F.col("requests")})


class TtlLru:
    """The cache itself: at most capacity entries, each for ttl_ms from its set."""

    def __init__(self, capacity: int = 100, ttl_ms: int = 30 * 60 * 1000):
        self.capacity, self.ttl_ms, self.held = capacity, ttl_ms, OrderedDict()

    def get(self, key, now_ms: int):
        if key not in self.held:
            return None
        value, until = self.held.pop(key)
        if now_ms >= until:
            return None
        self.held[key] = value, until
        return value

    def set(self, key, value, now_ms: int) -> None:
        if key not in self.held and len(self.held) >= self.capacity:
            self.held.popitem(last=False)
        self.held.pop(key, None)
        self.held[key] = value, now_ms + self.ttl_ms

    def invalidate(self, key) -> None:
        self.held.pop(key, None)

    def clear(self) -> None:
        self.held.clear()

    def __len__(self) -> int:
        return len(self.held)


def replay(script: pd.DataFrame, capacity: int, ttl_ms: int) -> list:
    """Results of a script of (op, key, value, at_ms): the value of each get, None for a miss or another op."""
    cache, out = TtlLru(capacity, ttl_ms), []
    for op, key, value, at in script[["op", "key", "value", "at_ms"]].itertuples(index=False):
        out.append(cache.get(key, at) if op == "get" else None)
        if op == "set":
            cache.set(key, value, at)
    return out


def parse_through(requests: DataFrame, parsed: DataFrame, parse: Callable[[DataFrame], DataFrame], key: str = "url", force: bool = False) -> DataFrame:
    """Parsed rows for requests: from the parsed table where it has the key (from_cache true), parsed now where not.

    force parses all. Only misses reach the parse.
    """
    known = parsed.withColumn("from_cache", F.lit(True))
    if force:
        return parse(requests).withColumn("from_cache", F.lit(False)).select(*known.columns)
    hit = known.join(requests.select(key), key, "left_semi")
    missed = requests.join(parsed.select(key), key, "left_anti")
    return hit.unionByName(parse(missed).withColumn("from_cache", F.lit(False)).select(*known.columns))


def breaker_open(calls: DataFrame, provider: str, at: str, failed: str, failures: int = 3) -> DataFrame:
    """calls with open: whether the provider's last `failures` calls before this one all failed."""
    past = Window.partitionBy(provider).orderBy(at).rowsBetween(-failures, -1)
    return calls.withColumn("open", F.coalesce((F.count("*").over(past) == failures) & (F.sum(F.col(failed).cast("int")).over(past) == failures), F.lit(False)))
