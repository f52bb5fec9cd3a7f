"""The same operators on streams: pages parsed as they come, an index that ignores known URLs, a cache with expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.operators import fileindex, html


def page_stream(spark: SparkSession, path: str, schema: str = "page_id long, url string, html string", files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def parsed_stream(stream: DataFrame, **options) -> DataFrame:
    return html.parse_pages(stream, **options)


def indexed_stream(links: DataFrame, at: str, delay: str = "1 hour") -> DataFrame:
    """Classified links (file_url, at), the first of each URL within the watermark's delay."""
    return fileindex.classified(links).withWatermark(at, delay).dropDuplicatesWithinWatermark(["file_url"])


def insert_batch(path: str):
    """A foreachBatch function: insert-or-ignore into the Parquet index at path. A batch that is run again adds nothing."""

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        spark.createDataFrame([], batch.schema).write.mode("append").parquet(path)
        fileindex.insert_or_ignore(spark.read.schema(batch.schema).parquet(path), batch).write.mode("append").parquet(path)

    return run


def cached_requests(requests: DataFrame, key: str, at: str, ttl_ms: int, delay: str = "1 minute") -> DataFrame:
    """(key, at_ms, hit) of a stream of requests (at: timestamp), with each key's expiry as state.

    A miss sets the key for ttl_ms. Requests of a micro-batch are taken in order of time. State goes when the watermark,
    which trails the latest request by delay, passes the expiry; requests behind the watermark are dropped.
    """

    def walk(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = sorted(t for part in parts for t in part["at_ms"])
        until, hits = state.getOption[0] if state.exists else None, []
        for t in times:
            hits.append(until is not None and t < until)
            if not hits[-1]:
                until = t + ttl_ms
        state.update((until,))
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [keys[0]] * len(times), "at_ms": times, "hit": hits})

    kind = requests.schema[key].dataType.simpleString()
    rows = requests.withWatermark(at, delay).select(key, at, F.unix_millis(at).alias("at_ms"))
    return rows.groupBy(key).applyInPandasWithState(walk, f"{key} {kind}, at_ms long, hit boolean", "until long", "append", GroupStateTimeout.EventTimeTimeout)
