import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.operators import cache, extract, fileindex, schema
from weftline.sources import http
from weftline.streaming import pages


def test_cache_script():
    script = pd.DataFrame([("set", "k1", "a", 0), ("set", "k2", "b", 1), ("get", "k1", None, 2), ("set", "k3", "c", 3), ("get", "k2", None, 4), ("get", "k1", None, 5), ("get", "k3", None, 6), ("get", "k1", None, 70)], columns=["op", "key", "value", "at_ms"])
    assert cache.replay(script, 2, 50) == [None, None, "a", None, None, "a", "c", None]


def test_index(spark):
    links = spark.createDataFrame([(i, u) for i, u in enumerate(["http://h/Été été.pdf", "http://h/a.b-c.zip", "http://h/song 100%.mp3", "http://h/a.b-c.zip"])], "id long, file_url string")
    index = fileindex.insert_or_ignore(None, fileindex.classified(links), ["id"])
    assert index.count() == 3
    assert fileindex.insert_or_ignore(index, fileindex.classified(links), ["id"]).count() == 0
    names = lambda df: [r["file_name"] for r in df.collect()]
    assert names(fileindex.search(index, "ete")) == ["Été été.pdf"]
    assert names(fileindex.search(index, "b-c", mode="fts")) == ["a.b-c.zip"]
    assert names(fileindex.search(index, "c-b", mode="fts")) == []
    assert names(fileindex.search(index, "100%", mode="like")) == ["song 100%.mp3"]
    assert names(fileindex.search(index, "NG 1", mode="auto")) == ["song 100%.mp3"]
    assert names(fileindex.search(index, "a", file_type="compressed")) == ["a.b-c.zip"]
    for bad in (("", None, 5), ("x", "pictures", 5), ("x", None, 0), ("x" * 201, None, 5)):
        with pytest.raises(ValueError):
            fileindex.search(index, *bad)


def test_crawl(spark):
    site = {"http://h/p/": '<base href="/p/"><a href="../">up</a><a href="d/">d</a><a href="a.pdf">a</a><a href="http://o/b.pdf">o</a>', "http://h/p/d/": '<a href="c.zip">c</a><a href="/p/">loop</a><a href="e/">e</a>'}
    known = spark.createDataFrame(list(site.items()), "url string, html string")
    fetch = lambda d: d.join(known, "url", "left")
    files, seen = fileindex.crawl(spark.createDataFrame([("http://h/p",), ("ftp://x",)], "url string"), fetch, keep=lambda d: d.cache())
    assert sorted(r["file_url"] for r in files.collect()) == ["http://h/p/a.pdf", "http://h/p/d/c.zip"]
    assert sorted((r["url"], r["depth"]) for r in seen.collect()) == [("http://h/p/", 0), ("http://h/p/d/", 1), ("http://h/p/d/e/", 2)]
    files, seen = fileindex.crawl(spark.createDataFrame([("http://h/p",)], "url string"), fetch, max_depth=0, max_files=1, keep=lambda d: d.cache())
    assert files.count() == 1 and seen.count() == 1


class Flaky(extract.AiProvider):
    def __init__(self, name, replies, cloud=False):
        self.name, self.replies, self.cloud = name, list(replies), cloud

    def complete(self, system, user, json_mode=True):
        reply = self.replies.pop(0)
        if isinstance(reply, int):
            raise extract.ExtractionError("x", reply)
        return reply


def test_chain():
    chain = extract.ProviderChain([Flaky("a", [500, 500]), Flaky("b", ["ok"])])
    assert chain.complete("", "") == "ok" and chain.attempts == [("a", "failed 500"), ("a", "failed 500"), ("b", "ok")]
    chain = extract.ProviderChain([Flaky("cloud", ["no"], cloud=True), Flaky("l", ["yes"])], allow_cloud=False)
    assert chain.complete("", "") == "yes" and chain.attempts[0] == ("cloud", "skipped")
    valid = lambda r: [] if r == "good" else ["bad"]
    assert extract.ProviderChain([Flaky("a", ["bad", "good"])], valid=valid).complete("", "") == "good"
    assert extract.ProviderChain([Flaky("a", ["bad", "bad"])], valid=valid).complete("", "") == "bad"
    with pytest.raises(extract.ExtractionError):
        extract.ProviderChain([Flaky("a", [401])]).complete("", "")


def test_requests():
    url, headers, body = extract.OpenAiProvider("k").request("s", "u", True)
    assert headers == {"Authorization": "Bearer k"} and body["temperature"] == 0.1 and body["response_format"] == {"type": "json_object"}
    assert extract.AnthropicProvider("k").request("s", "u", True)[2]["max_tokens"] == 4096
    assert extract.AnthropicProvider("k").reply({"content": [{"text": "t"}]}) == "t"
    assert extract.GeminiProvider("k").reply({"candidates": [{"content": {"parts": [{"text": "t"}]}}]}) == "t"
    assert "k=" not in repr(extract.GeminiProvider("secret")) and "secret" not in repr(extract.GeminiProvider("secret"))


def test_extraction(spark):
    def answer(system, user):
        if "fail" in user:
            raise extract.ExtractionError("down")
        return "```json\n" + json.dumps({"n": len(user)}) + "\n```"

    got = extract.extract_json(spark.createDataFrame([("x",), ("fail",), (None,)], "context string"), extract.CustomProvider(answer), "count").collect()
    assert [r["ai_error"] for r in got] == [None, "down", None] and got[1]["ai_json"] is None


def test_schema(spark):
    fields = [schema.Field("price", "number", required=True), schema.Field("mail", "email"), schema.Field("kind", "enum", values=("a", "b"))]
    got = schema.validated(spark.createDataFrame([("12.99", "a@b.c", "a"), (None, "x", "z")], "price string, mail string, kind string"), fields).collect()
    assert got[0]["errors"] == [] and got[0]["price"] == 12.99
    assert got[1]["errors"] == ["price: missing", "mail: not a email", "kind: not a enum"]
    assert schema.to_json_schema(fields)["required"] == ["price"]
    graph = spark.createDataFrame([(['{"@graph":[{"headline":"H"}]}'],)], "j array<string>")
    assert graph.select(schema.from_json_ld(F.col("j"), "title")).first()[0] == "H"


def test_robots_join(spark):
    rules = spark.createDataFrame([("h", "/a", False), ("h", "/a/b", True)], "host string, path string, allow boolean")
    links = spark.createDataFrame([("http://h/a/x",), ("http://h/a/b/c",), ("http://h/z",), ("http://o/",)], "url string")
    got = {r["url"]: r["allowed"] for r in http.allowed(links, rules).collect()}
    assert got == {"http://h/a/x": False, "http://h/a/b/c": True, "http://h/z": True, "http://o/": True}
    assert not http.allowed(links, rules, "strict").where("url = 'http://o/'").first()["allowed"]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "http://h/", "<title>a</title>"), (2, "http://h/2", None)], "page_id long, url string, html string")
    rows.write.parquet(str(tmp_path / "in"))
    out = pages.parsed_stream(pages.page_stream(spark, str(tmp_path / "in"))).select("page_id", "title")
    q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    assert {(r["page_id"], r["title"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, "a"), (2, "")}
    index = spark.createDataFrame([("http://h/a.pdf", "a.pdf", "docs", 1), ("http://h/a.pdf", "a.pdf", "docs", 2)], "file_url string, file_name string, file_type string, discovered_at int")
    insert = pages.insert_batch(str(tmp_path / "index"))
    insert(index, 0)
    insert(index, 1)
    assert [(r["file_type"], r["discovered_at"]) for r in spark.read.parquet(str(tmp_path / "index")).collect()] == [("Document", 1)]


def test_cached_requests_stream(spark, tmp_path):
    spark.createDataFrame([("a", 0), ("a", 10), ("a", 60), ("b", 5)], "k string, ms long").select("k", F.timestamp_millis(F.col("ms") + 10**12).alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in"))
    got = []
    q = pages.cached_requests(stream, "k", "ts", 50).writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["k"], r["at_ms"] - 10**12, r["hit"]) for r in got) == [("a", 0, False), ("a", 10, True), ("a", 60, False), ("b", 5, False)]


def test_lru_by_blocks_equals_one_walk(spark):
    import random

    from weftline.operators import cache

    draw = random.Random(3)
    rows = [(n, draw.choice(["a", "a", "a", None]), draw.choice([None, *range(12)]), 2**60 + n) for n in range(600)]
    log = spark.createDataFrame(rows, "at int, shard string, k int, big long")
    whole = {r["big"]: r["hit"] for r in cache.lru_hits(log, "shard", "k", "at", 4).collect()}
    for width in (7, 100, 1000):
        cut = cache.lru_hits(log, "shard", "k", "at", 4, F.floor(F.col("at") / width)).collect()
        assert {r["big"]: r["hit"] for r in cut} == whole and len(cut) == 600
    held, expected = {}, {}
    for at, shard, k, big in rows:
        own = held.setdefault(shard, [])
        expected[big] = k in own
        held[shard] = ([x for x in own if x != k] + [k])[-4:]
    assert whole == expected
    assert cache.lru_hits(log.limit(0), "shard", "k", "at", 4, F.col("at")).collect() == []
    stats = cache.cache_stats(cache.lru_hits(log, "shard", "k", "at", 4), "shard").collect()
    assert sum(r["requests"] for r in stats) == 600 and sum(r["hits"] for r in stats) == sum(expected.values())


def test_savings_count_models_without_price_as_free(spark):
    from weftline.operators import extract

    calls = spark.createDataFrame([("s", "m", "abcd" * 1000, "", True), ("s", "m", "abcd", "", False), ("s", "x", "abcd", None, False)], "session string, model string, prompt string, reply string, from_cache boolean")
    prices = spark.createDataFrame([("m", 1000.0, 1.0)], "model string, price_in double, price_out double")
    assert [tuple(r) for r in extract.savings(calls, prices).collect()] == [("s", 3, 1, 0.001, 1.0)]


def test_recipes_by_host_and_schema(spark):
    import datetime

    from weftline.operators import schema

    key, old = schema.schema_hash([schema.Field("a")]), datetime.date(2000, 1, 1)
    recipes = spark.createDataFrame([("X.example", key, 1, old, "r1"), ("x.example", key, 2, old, "r2"), ("x.example", "other", 3, old, "r3")], "host string, schema_hash string, version int, created date, recipe string")
    pages = spark.createDataFrame([("x.Example",), ("y.example",), (None,)], "host string")
    got = lambda **how: {r["host"]: r["recipe"] for r in schema.recipes_for(pages, recipes, [schema.Field("a")], **how).collect()}
    assert got() == {"x.Example": "r2", "y.example": None, None: None}
    assert set(got(max_age_days=30).values()) == {None}


def test_redirect_limit_and_pace(spark):
    import threading
    import time
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Site(BaseHTTPRequestHandler):
        def do_GET(self):  # /n redirects n times
            left = int(self.path[1:].partition("?")[0])
            self.send_response(302 if left else 200)
            self.send_header("Location", f"/{left - 1}")
            self.end_headers()
            self.wfile.write(b"" if left else b"page")

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        root = f"http://127.0.0.1:{server.server_port}"
        config = http.FetchConfig(max_retries=0)
        assert http.fetch_one(f"{root}/5", config)["html"] == "page"
        far = http.fetch_one(f"{root}/6", config)
        assert far["html"] is None and far["error_kind"] == "network"
        links = spark.createDataFrame([(f"{root}/0?{n}", 0.3) for n in range(3)], "url string, pace double")
        for how in ({"crawl_delay": "pace"}, {"config": http.FetchConfig(delay_s=0.3)}):
            began = time.time()
            assert [r["html"] for r in http.fetch(links, partitions=1, **how).collect()] == ["page"] * 3
            assert time.time() - began >= 0.6
    finally:
        server.shutdown()
