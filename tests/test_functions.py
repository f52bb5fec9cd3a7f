import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import normalize, text, urls
from weftline.sources import codecs, http


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(build(F.col("v")).alias("r")).first()["r"]


def chunks_by_hand(value, most):
    value = value.strip()
    if not value:
        return []
    if len(value) <= most:
        return [value]
    out, held = [], ""
    import re

    for p in (p.strip() for p in re.split(r"\n\s*\n", value)):
        if not p:
            continue
        if len(held) + len(p) + 2 <= most:
            held = f"{held}\n\n{p}" if held else p
            continue
        out += [held] if held else []
        held = "" if len(p) > most else p
        out += [p[i : i + most] for i in range(0, len(p), most)] if len(p) > most else []
    return out + ([held] if held else [])


def test_chunks(spark):
    values = ["", "   ", "x" * 40, "x" * 41, "a\n\nb\n \nc" + "y" * 100, "\n\n".join("p" * n for n in range(1, 60, 7)), None]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", text.chunked(F.col("v"), 10).alias("r")).collect()
    for r in rows:
        assert r["r"] == chunks_by_hand(r["v"] or "", 40)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=120), min_size=1, max_size=5))
def test_chunks_lose_nothing(spark, values):
    for r in spark.createDataFrame([(v,) for v in values], "v string").select("v", text.chunked(F.col("v"), 5).alias("r")).collect():
        assert all(len(c) <= 20 for c in r["r"])
        assert "".join("".join(r["r"]).split()) == "".join(r["v"].split())


def test_unicode_space(spark):
    assert one(spark, "\t x  y﻿", text.trimmed) == "x  y"
    assert one(spark, "\t x  y﻿", text.collapsed) == "x y"


@pytest.mark.parametrize(
    ("raw", "want"),
    [('{"a":1}', '{"a":1}'), ("[1]", '{"data":[1]}'), ("7", '{"data":7}'), ('```json\n{"a":1}\n```', '{"a":1}'), ('```\n{"a":1}\n```', '{"a":1}'), ('so: {"a":{"b":2}} ok', '{"a":{"b":2}}'), ("none", None), ("{bad", None), (None, None)],
)
def test_replies(spark, raw, want):
    assert one(spark, raw, text.reply_json) == want


def test_ranking(spark):
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate(["shipping", "price price", "éa price", "pricing"])] + [(2, 0, "x"), (2, 1, "price")], "k int, chunk_idx int, chunk string")
    got = text.ranked_chunks(rows, "k", F.lit("The PRICE, of"), 2).orderBy("k", "rank").collect()
    assert [(r["k"], r["chunk_idx"]) for r in got] == [(1, 1), (1, 2), (2, 0), (2, 1)]
    got = text.ranked_chunks(rows, "k", F.lit("of it"), 2).where("k = 1").orderBy("rank").collect()
    assert [r["chunk_idx"] for r in got] == [0, 1]


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "a c"), (3, "")], "d int, t string")
    terms = spark.createDataFrame([(1, "b")], "query_id int, term string")
    avg, n = 5 / 3 if False else (3 + 2 + 0) / 3, 3
    want = math.log(1 + (n - 1 + 0.5) / 1.5) * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / avg))
    assert [(r["d"], round(r["score"], 9)) for r in text.bm25(docs, "d", "t", terms).collect()] == [(1, round(want, 9))]


@pytest.mark.parametrize(
    ("href", "want"),
    [(" a/../b ", "http://h/d/b"), ("x/", "http://h/d/x/"), ("#f", None), ("mailto:x", None), ("JAVASCRIPT:x", None), ("HTTP://H2/P?q=1#f", "http://h2/P?q=1"), ("", None), ("//o", "http://o/")],
)
def test_normal_urls(href, want):
    assert urls.normalised("http://h/d/", href) == want
    assert want is None or urls.normalised("http://x/", want) == want


@pytest.mark.parametrize(
    ("name", "ext", "kind"),
    [("a.tar.gz", ".tar.gz", "Archive"), (".bashrc", "", "Other"), ("x.", "", "Other"), ("A.MP4", ".mp4", "Video"), ("page.html", ".html", "Other"), ("noext", "", "Other"), ("a.b.pdf", ".pdf", "Document")],
)
def test_file_types(spark, name, ext, kind):
    assert one(spark, name, urls.extension) == ext
    assert one(spark, name, urls.file_type) == kind


def test_file_names(spark):
    for url, want in [("http://h/a/my%20file.pdf", "my file.pdf"), ("http://h/a+b.zip?x=1", "a+b.zip"), ("http://h/d/", "d"), ("http://h", "")]:
        assert one(spark, url, urls.file_name) == want
    for url, want in [("http://h/a.pdf", True), ("http://h/d/", False), ("http://h/thumbs.db", False), ("http://h/x.css", False), ("http://h", False)]:
        assert one(spark, url, urls.is_indexable) is want
    assert one(spark, "http://h/a", urls.canonical_directory) == "http://h/a/"
    assert one(spark, "http://h?x#y", urls.canonical_directory) == "http://h/"
    assert one(spark, "http://h/ab/c", lambda c: urls.is_within(F.lit("http://h/a"), c)) is False
    assert one(spark, "http://h/?utm_a=1&b=2&fbclid=3#z", urls.without_tracking) == "http://h/?b=2#z"


def test_normalizers(spark):
    assert one(spark, "1,234.5k", normalize.number) == 1234500.0
    assert one(spark, "abc", normalize.number) is None
    assert tuple(one(spark, "£1,200.50", normalize.money)) == (__import__("decimal").Decimal("1200.50"), "GBP")
    assert one(spark, "free", normalize.money) is None
    assert one(spark, "+44 (20) 7946-0958", normalize.phone) == "+442079460958"
    assert one(spark, "12", normalize.phone) is None
    assert one(spark, "2024-02-03T01:02:03Z", normalize.date) == "2024-02-03"
    assert one(spark, "later", normalize.date) is None


def test_fetch_retries():
    def run(*statuses):
        left, waits = list(statuses), []

        def once(url, config, headers):
            s = left.pop(0)
            return s, "page" if s == 200 else None, None, None if s == 200 else "timeout" if s == 0 else "rate_limit" if s == 429 else "network"

        out = http.fetch_one("http://h/", http.FetchConfig(), sleep=waits.append, once=once)
        return out["status"], out["attempts"], [round(w, 3) for w in waits], out["error_kind"]

    assert run(200) == (200, 1, [], None)
    assert run(503, 200) == (200, 2, [0.8], None)
    assert run(503, 503, 503) == (503, 3, [0.8, 1.6], "network")
    assert run(429) == (429, 1, [], "rate_limit")
    assert run(404) == (404, 1, [], "network")
    assert run(0, 0, 0) == (None, 3, [0.8, 1.6], "timeout")
    assert http.fetch_one("ftp://h", http.FetchConfig())["error_kind"] == "url"


def test_fetch_from_a_local_server(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Page(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(404 if self.path == "/no" else 200)
            self.send_header("Content-Type", "text/html")
            self.end_headers()
            if self.path != "/no":
                self.wfile.write(b"<title>\xff" + self.path.encode() + b"</title>")

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Page)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    got = {r["url"]: r for r in http.fetch(spark.createDataFrame([(f"{base}/a",), (f"{base}/no",), ("x",)], "url string")).collect()}
    server.shutdown()
    assert got[f"{base}/a"]["html"] == "<title>�/a</title>"
    assert got[f"{base}/no"]["status"] == 404 and got[f"{base}/no"]["html"] is None
    assert got["x"]["error_kind"] == "url"


def test_robots():
    text_ = "User-agent: a\nUser-agent: b\nDisallow: /x\nAllow: /x/y\n\nUser-agent: *\nDisallow: /\n"
    assert http.robots_rules(text_, "b") == [("/x", False), ("/x/y", True)]
    assert http.robots_rules(text_, "z") == [("/", False)]


def test_codecs(spark):
    df = spark.createDataFrame([(1, "a,b", None)], "i int, s string, n string").withColumn("t", F.struct(F.lit(1).alias("x"), F.array(F.lit("q")).alias("y")))
    assert codecs.flattened(df).columns == ["i", "s", "n", "t.x", "t.y"]
    assert df.select(codecs.result_json(df)).first()[0] == '{"i":1,"s":"a,b","t":{"x":1,"y":["q"]}}'


def test_crawl_delay_of_the_agents_group():
    text_ = "User-agent: *\nCrawl-delay: soon\nCrawl-delay: 2.5 # slow\nDisallow: /a\n\nUser-agent: b\nDisallow: /x"
    assert http.robots_delay(text_) == 2.5 and http.robots_delay(text_, "b") is None
    assert http.robots_rules(text_) == [("/a", False)]


def test_structural_chunks(spark):
    from pyspark.sql import functions as F

    from weftline.functions import text as tx

    def plain(markdown, most, overlap):
        done, tail, held = [], "", ""
        for x in [x for x in re.split(r"\n\s*\n", markdown.strip()) if x.strip()]:
            heading, whole = re.match(r"#{1,6}\s", x), re.match(r"\s*(\||[-*+]\s|[0-9]+[.)]\s)", x)
            if not heading and held and len(held) + len(x) + 2 <= most:
                held += "\n\n" + x
                continue
            if held:
                done.append(tail + held)
            last = held[-overlap:] if overlap else ""
            tail = last + "\n\n" if last and not heading else ""
            if not whole and len(x) > most:
                done += [x[i : i + most] for i in range(0, len(x), most)]
                held = tail = ""
            else:
                held = x
        return done + ([tail + held] if held else [])

    pages = ["# A\n\none two\n\n| a |\n|---|\n" + "| b |\n" * 30 + "\n## B\n\n" + "word " * 40 + "\n\n- x\n- y\n\nend", "", "  \n\n ", "p" * 95, "1. a\n2. b\n\nabc\n\n" + "q" * 29 + "\n\nz"]
    rows = spark.createDataFrame([(n, x) for n, x in enumerate([*pages, None])], "n int, x string")
    for most, overlap in ((30, 0), (30, 7), (12, 20), (1000, 5)):
        got = {r["n"]: r["c"] for r in rows.select("n", tx.structural_chunks(F.col("x"), most, overlap).alias("c")).collect()}
        assert got == {n: plain(x or "", most, overlap) for n, x in enumerate([*pages, None])}


def test_planned_fields(spark):
    from pyspark.sql import functions as F

    from weftline.operators import schema

    rows = spark.createDataFrame([("Get prices, PRICE and every email", None), ("nothing asked", "no json"), (None, '{"fields": []}'), ("title", '{"fields": [{"name": "x", "kind": "date"}]}')], "q string, r string")
    got = [(r["p"]["many"], [tuple(f) for f in r["p"]["fields"]]) for r in rows.select(schema.planned(F.col("q"), F.col("r")).alias("p")).collect()]
    assert got == [(True, [("price", "money"), ("email", "email")]), (False, []), (False, []), (False, [("x", "date")])]
