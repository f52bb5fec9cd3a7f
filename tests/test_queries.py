"""Queries against their SQL on small tables with what is rare in the test tables."""

from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql.functions import spark_partition_id

import __spark_entry__ as entry


def rows(frame, columns):
    return sorted(tuple(r[c] for c in columns) for r in frame)


def agrees(spark, folder, name):
    """Whether the query and its SQL give the same rows over the tables in the folder, and how many."""
    got = entry.queries()[name](spark, str(folder))
    sql = duckdb.connect()
    for table in folder.iterdir():
        sql.sql(f"CREATE VIEW {table.stem} AS SELECT * FROM read_parquet('{table}/*.parquet')")
    want = sql.sql(entry.oracle_sql()[name])
    found = rows((r.asDict() for r in got.collect()), got.columns)
    assert found == rows((dict(zip(want.columns, r, strict=True)) for r in want.fetchall()), got.columns)
    return len(found)


@pytest.mark.parametrize("name", ["page_overview", "strip_boilerplate_off", "page_markdown", "page_query_all", "page_selectors"])
def test_a_reference_cut_off_in_a_title(spark, tmp_path, name):
    page = '<html><head><title>{0}</title></head><body><nav><ul><li><a href="/a">a</a></li></ul></nav><article><h1>{0}</h1><p>{0}&amp; more</p></article><footer>f</footer></body></html>'
    titles = ["one &amp; two", "one&amp", "one&&amp", "one &copy; &quot;x&quot; &quo", "&copy"]
    spark.createDataFrame([(i, "https://e.com/x", page.format(t)) for i, t in enumerate(titles)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert agrees(spark, tmp_path, name) == 5


def test_requests_at_one_moment(spark, tmp_path):
    minutes = [0, 0, 0, 60, 60, 120, 120, 121, 240]
    events = [(i, user, datetime(2024, 1, 1) + timedelta(minutes=m)) for i, (user, m) in enumerate((u, m) for u in (1, 2) for m in minutes)]
    spark.createDataFrame(events, "event_id long, user_id long, ts timestamp_ntz").selectExpr("*", "'view' AS event_type").write.parquet(str(tmp_path / "events.parquet"))
    assert agrees(spark, tmp_path, "cache_ttl_hits") == 18


@pytest.mark.parametrize("name", ["article_fields", "readable_body"])
def test_pages_of_a_small_file_are_dealt_to_all_cores(spark, tmp_path, name):
    parts = spark.range(100).selectExpr("id AS p_partkey", "'almond ' || id AS p_name", "'Brand#1' AS p_brand", "'SMALL TIN' AS p_type", "CAST(id % 50 AS INT) AS p_size", "id + 0.5D AS p_retailprice")
    parts.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    tasks = entry.queries()[name](spark, str(tmp_path)).groupBy(spark_partition_id()).count().collect()
    assert len(tasks) >= spark.sparkContext.defaultParallelism
    assert agrees(spark, tmp_path, name) == 100
