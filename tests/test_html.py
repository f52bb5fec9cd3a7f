import random

import pytest

from weftline.operators import html

PAGE = """<html><head><title> Lamp </title><meta property="og:title" content="OG lamp"><meta property="og:title" content="OG last"><meta name="Author" content="Ann">
<script type="application/ld+json">{"@type":"Product","name":"Lamp"}</script><script type="application/ld+json">[1,{"name":"Second"}]</script><script type="application/ld+json">{bad</script></head>
<body><nav><a href="/nav">nav</a></nav><article><header>gone</header><h1>Lamp</h1><p>One <b>bold<p>Two<br>three<ul><li>a<li>b</ul><span class="price big" id="x">  12 eur </span><div class="ad">ad stays</div><div class="ads">goes</div></article>
<a href="">e</a><a href="javascript:x">j</a><a href="JavaScript:x">J</a><a href="mailto:a@b.c">m</a><a href="../up">u</a><a href="#f">f</a><a href="../up">again</a><script>var p="</p>";</script>"""


def test_page():
    got = html.extract(PAGE, "https://example.com/shop/item", (".price", "article > h1", "#x", "nav a"))
    assert got["title"] == "Lamp"
    assert got["links"] == ["https://example.com/nav", "JavaScript:x", "mailto:a@b.c", "https://example.com/up", "https://example.com/shop/item#f"]
    assert got["selector_matches"] == {".price": ["12 eur"], "article > h1": ["Lamp"], "#x": ["12 eur"], "nav a": ["nav"]}
    assert got["open_graph"] == {"title": "OG last"} and got["meta"] == {"author": "Ann"}
    assert len(got["json_ld"]) == 2
    assert "gone" not in got["clean_text"] and "goes" not in got["clean_text"] and "ad stays" in got["clean_text"]
    assert got["markdown"].startswith("# Lamp\n\nOne bold\n\nTwo\nthree\n\n- a\n- b")


@pytest.mark.parametrize(
    ("page", "title"),
    [("<title></title><meta property='og:title' content='og'>", ""), ("<meta property='og:title' content=' og '>", "og"), ("", ""), (None, "")],
)
def test_title(page, title):
    assert html.extract(page, None)["title"] == title


def test_strip_off_and_main():
    page = "<body><article>no</article><main><footer>f</footer>yes</main>"
    assert html.extract(page, None)["clean_text"] == "yes"
    assert html.extract(page, None, strip=False)["clean_text"] == "fyes"


def test_text_has_no_separator_between_blocks():
    assert html.extract("<body><p>a</p><p>b</p>", None)["clean_text"] == "ab"
    assert html.extract("<body><b>a</b> <i>b</i>", None)["markdown"] == "ab"
    assert html.extract("<body><h5>x</h5><h6>y</h6>", None)["markdown"] == "xy"


def test_unsupported_selector():
    with pytest.raises(ValueError):
        html.selector("li:nth-child(2)")


def test_gfm():
    root = html.parse("<h5>T</h5><p><a href='/x'>l</a> <strong>s</strong></p><ol><li>a<ul><li>b</ul><li>c</ol><table><tr><th>h|<tr><td>1</table><pre>x\ny</pre>")
    text = html.gfm(root)
    assert "##### T" in text and "[l](/x) **s**" in text and "1. a\n  - b\n2. c" in text and "| h\\| |\n| --- |\n| 1 |" in text and "```\nx\ny\n```" in text


def test_nodes_are_nested_intervals():
    nodes = html.number_nodes(html.parse("<div><p>a<p>b</div>"))
    assert [n["tag"] for n in nodes] == ["html", "body", "div", "p", "p"]
    div = nodes[2]
    assert [n["tag"] for n in nodes if n["node_id"] > div["node_id"] and n["post"] < div["post"]] == ["p", "p"]


def test_skeleton():
    assert "li count=3" in html.skeleton("<ul><li>a<li>b<li>c</ul>")


@pytest.mark.parametrize("tag", ["div", "b", "p", "section"])
def test_deep_pages_crash_nothing(tag):
    page = f"<{tag}>" * 5000 + "deep"
    got = html.extract(page, None)
    assert got["clean_text"] == "deep" and got["markdown"] == "deep" or tag == "p"
    assert html.extract(page, None, dialect="gfm")["markdown"].endswith("deep")
    assert html.skeleton(page).count("\n") > 2 or tag == "p"
    assert html.extract('<script type="application/ld+json">' + "[" * 100_000 + "</script>x", None)["json_ld"] == []


def test_many_siblings_take_linear_time():
    page = "<div>" + "<p>a<nav>n</nav>" * 20_000 + "</div>"
    assert html.extract(page, None)["clean_text"] == "a" * 20_000


def test_skeleton_fits_its_budget():
    page = "<main>" + "".join(f"<div class=c{i}><p><b>x</b></p></div>" for i in range(400)) + "</main>"
    assert "b\n" in html.skeleton(page) and len(html.skeleton(page, 1500)) <= 6000 and "main" in html.skeleton(page, 1500)


def test_query_all_and_regex(spark):
    root = html.parse('<p class="a b">one<p id=x>two<div class=b>three</div>')
    assert html.query_all(root, "p") == ["one", "two"] and html.query_all(root, class_name="b") == ["one", "three"]
    assert html.query_all(root, "P", own_id="x") == ["two"] and len(html.query_all(root, "section")) == 0
    with pytest.raises(ValueError):
        html.query_with_regex(html.F.lit(""), "(a)", 2)


def test_items():
    page = """<div itemscope itemtype="https://schema.org/Product"><h1 itemprop="name"> Lamp </h1><a itemprop=url href="/l">x</a>
    <span itemprop="offers" itemscope itemtype="https://schema.org/Offer"><meta itemprop="price" content="12"></span></div>
    <div vocab="https://schema.org/" typeof="Person"><span property="name">Ann</span></div>"""
    got = html.linked_items(html.parse(page), "https://e.com/a/")
    assert [(i["syntax"], i["type"]) for i in got] == [("microdata", "https://schema.org/Product"), ("microdata", "https://schema.org/Offer"), ("rdfa", "https://schema.org/Person")]
    assert [(p["name"], p["value"], p["child"]) for p in got[0]["properties"]] == [("name", "Lamp", -1), ("url", "https://e.com/l", -1), ("offers", None, 1)]
    assert [(p["name"], p["value"]) for p in got[1]["properties"]] == [("price", "12")] and got[2]["properties"][0]["value"] == "Ann"


def test_an_article_is_parsed_once(monkeypatch):
    parsed, parse = [], html.parse
    monkeypatch.setattr(html, "parse", lambda *x: parsed.append(x) or parse(*x))
    got = html.article("<title>T <noscript>n</noscript></title><meta property=og:title content=' '><body><p>x", None)
    assert len(parsed) == 1 and got["title"] == "T"


def test_article():
    page = """<title>T</title><meta name=author content=Ann><meta property="article:published_time" content="2024-01-02"><meta name="twitter:card" content="summary">
    <div class="sidebar"><p>Some text of a sidebar, with commas, and more, and more than that.</p></div>
    <div class="post"><p>The main content of the page, which is long enough to count.</p><p>And more of it, as it goes on, and on.</p><img src="i.png"></div>"""
    got = html.article(page, "https://e.com/a/b")
    assert got["body"].startswith("The main content") and "sidebar" not in got["body"]
    assert (got["title"], got["byline"], got["published"], got["twitter_card"], got["images"]) == ("T", "Ann", "2024-01-02", "summary", ["https://e.com/a/i.png"])
    assert got["n_words"] == 21 and got["reading_seconds"] == 7
    assert html.article(None, None)["body"] == ""


def test_references_without_semicolon():
    page = """<title>a&amp</title><meta name=author content="x&copy"><body><a href='/q?a=1&amp;b&lt'>l</a><h1>R&D&amp &amp; &#65; &#65 &ampx; &</h1><script type="application/ld+json">{"a": "&amp &"}</script>"""
    got, standard = html.extract(page, "https://e.com/", ("h1",), closed_only=True), html.extract(page, "https://e.com/", ("h1",))
    assert (got["title"], got["meta"]["author"], got["links"]) == ("a&amp", "x&copy", ["https://e.com/q?a=1&b&lt"])
    assert got["selector_matches"]["h1"] == ["R&D&amp & A &#65 &ampx; &"] and got["json_ld"] == ['{"a": "&amp &"}']
    assert (standard["title"], standard["meta"]["author"], standard["selector_matches"]["h1"]) == ("a&", "x©", ["R&D& & A A &x; &"])


def _shape(node):
    return [node.tag, node.attrs, [c if isinstance(c, str) else _shape(c) for c in node.children]]


def test_plain_pages_are_read_without_the_standard_parser(monkeypatch):
    parts = ["<p>", "</p>", '<div class="post">', "</div>", "<LI x>", "<br/>", '<a href="/x" HREF="/y">', "</a>", '<meta name="author" content="a > b">', "<td>", "</tr>", "<title>no</title>", "<!DOCTYPE html>", "a&amp;b &copy", " ", "\n", "a story, long enough to be a paragraph of its own"]
    odd = ['<a href="/?b&amp;c">', "<!-- c -->", "<p x=y>", "< p", "<script>a<b</script>", "<title><b>", "</ p>", "<textarea>"]
    draw = random.Random(1)
    pages = ["".join(draw.choices(parts, k=12)) + "x" for _ in range(300)]
    for page in pages + [p + o + "x</p>" for p, o in zip(pages, odd * 40, strict=False)]:
        tree = html._Builder()
        tree.feed(page)
        tree.close()
        tree._into_body()
        assert _shape(html.parse(page)) == _shape(tree.root), page
        assert html.body_text(page) == html.article(page, None)["body"]
    monkeypatch.setattr(html._Builder, "feed", None)
    for page in pages:
        html.parse(page)
