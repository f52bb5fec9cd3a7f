"""HTML to columns: a tree built on the standard library's tokenizer, selectors over it, and one Arrow UDF a page.

Recovered are missing end tags of html, body, p, li, dt, dd, option and table parts, void elements, unclosed inline
elements and stray end tags. Formatting elements are not opened again in the next paragraph, as a browser would.
"""

from __future__ import annotations

import functools
import json
import re
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.urls import resolved

# Element names of the HTML standard, and what counts as boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th")}
SCOPES = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "option": ("select",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
HEAD = frozenset("base link meta noscript script style template title".split())
BOILERPLATE = "script, style, noscript, iframe, svg, canvas, nav, footer, header, aside, .ads, .advertisement, .cookie-banner, #cookie-banner"
CODE_ONLY = "script, style, noscript"
PREFIX = {"h1": "# ", "h2": "## ", "h3": "### ", "h4": "### ", "p": "", "div": "", "section": "", "article": ""}
_SPACE = re.compile(r"[\s﻿]+")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self):
        """This element and those below it, in document order."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        if len(self.children) == 1 and isinstance(self.children[0], str):
            return self.children[0]
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                todo += reversed(node.children)
        return "".join(out)


class _Tree:
    """Puts tags and text in their places."""

    def __init__(self):
        self.root = Node("html", {}, None)
        self.open, self.body, self.open_p = [self.root], None, 0

    def _into_body(self):
        if self.body is None:
            self.body = Node("body", {}, self.root)
            self.root.children.append(self.body)
            self.open = [self.root, self.body]

    def handle_starttag(self, tag, attrs):
        found = {}
        for k, v in attrs:
            found.setdefault(k, v or "")
        if tag in ("html", "body"):
            if tag == "body":
                self._into_body()
            own = self.root if tag == "html" else self.body
            own.attrs = {**found, **own.attrs}
            return
        if tag == "head" or self.body is None and tag in HEAD:
            if tag == "head":
                return
        else:
            self._into_body()
        if tag in CLOSES_P and self.open_p:
            self._pop("p")
        elif tag in ENDS:
            for at in range(len(self.open) - 1, 0, -1):
                if self.open[at].tag in SCOPES[tag]:
                    break
                if self.open[at].tag in ENDS[tag]:
                    self._cut(at)
                    if tag != "tr":
                        break
        node = Node(tag, found, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.open_p += tag == "p"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def _cut(self, at):
        self.open_p -= sum(n.tag == "p" for n in self.open[at:])
        del self.open[at:]

    def _pop(self, tag):
        if len(self.open) > 1 and self.open[-1].tag == tag:
            self.open.pop()
            self.open_p -= tag == "p"
            return
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                self._cut(at)
                return

    def handle_endtag(self, tag):
        if tag == "br":
            self.handle_starttag("br", [])
        elif tag not in ("html", "body", "head"):
            self._pop(tag)

    def handle_data(self, data):
        if self.body is None and self.open[-1] is self.root:
            if not data.strip():
                return
            self._into_body()
        self.open[-1].children.append(data)


class _Builder(_Tree, HTMLParser):
    def __init__(self):
        HTMLParser.__init__(self, convert_charrefs=True)
        _Tree.__init__(self)

    def updatepos(self, i, j):  # lines aren't asked for
        return j


# Markup that every version of HTMLParser reads alike: tags with double-quoted values or none and no character references in
# them, text, a doctype; no comments, and of the elements that hold raw text only a title without markup.
_PLAIN_TAG = r"[a-zA-Z][a-zA-Z0-9]*+"
_PLAIN_ATTRS = r"(?:[ \t\n]++[a-zA-Z][a-zA-Z0-9_:-]*+(?:=\"[^\"&]*+\")?+)*+"
_RAW = r"(?i:script|style|textarea|title|iframe|noembed|noframes|xmp|plaintext)"
_PLAIN = re.compile(rf"(?:[^<]++|</{_PLAIN_TAG}>|<(?!{_RAW}){_PLAIN_TAG}{_PLAIN_ATTRS}[ \t\n]*+/?+>|<title>(?=[^<]*+</title>)|<!(?i:doctype)[^>]*+>)*+")
_TOKEN = re.compile(rf"([^<]++)|<(?:(/)?+({_PLAIN_TAG})({_PLAIN_ATTRS})[ \t\n]*+/?+|![^>]*+)>")
_ATTR = re.compile(r"([a-zA-Z][a-zA-Z0-9_:-]*+)(?:=\"([^\"]*+)\")?+")


def _plain_tree(html: str) -> Node:
    """The tree of a page that _PLAIN matches, as _Builder makes it, at a third of its time."""
    tree = _Tree()
    for data, end, tag, attrs in _TOKEN.findall(html):
        if data:
            tree.handle_data(unescape(data))
        elif end:
            tree.handle_endtag(tag.lower())
        elif tag:
            tree.handle_starttag(tag.lower(), [(k.lower(), v) for k, v in _ATTR.findall(attrs)] if attrs else ())
    tree._into_body()
    return tree.root


_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")
_MARK = "\ufdd0"  # a noncharacter


def _marked(m: re.Match) -> str:
    return m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else f"&{_MARK}{m[1] or ''}"


class _ClosedBuilder(_Builder):
    """Leaves an ampersand alone if no reference with a semicolon starts there; feed it text with _MARK behind those."""

    def handle_starttag(self, tag, attrs):
        plain = lambda x: x and x.replace("&" + _MARK, "&")
        super().handle_starttag(plain(tag), [(plain(k), plain(v)) for k, v in attrs])

    def handle_endtag(self, tag):
        super().handle_endtag(tag.replace("&" + _MARK, "&"))

    def handle_data(self, data):
        super().handle_data(data.replace("&" + _MARK, "&"))


def parse(html: str | None, closed_only: bool = False) -> Node:
    """The tree's root. closed_only: character references without their semicolon, which HTML reads too (`&amp`), stay text."""
    if html and not closed_only and _PLAIN.fullmatch(html):
        return _plain_tree(html)
    builder = _ClosedBuilder() if closed_only else _Builder()
    builder.feed(_REFERENCE.sub(_marked, html or "") if closed_only else html or "")
    builder.close()
    builder._into_body()
    return builder.root


_COMPOUND = re.compile(r"([a-zA-Z][\w-]*|\*)|#([\w-]+)|\.([\w-]+)|\[\s*([\w:-]+)\s*(?:([~^$*|]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]+))\s*)?\]")


@functools.lru_cache(maxsize=512)
def selector(text: str) -> tuple:
    """A comma list of compounds joined by descendant and child; other selectors raise ValueError."""
    out = []
    for one in re.split(r",(?![^\[]*\])", text):
        steps, relation = [], " "
        for part in re.findall(r">|(?:\[[^\]]*\]|[^\s>\[])+", one):
            if part == ">":
                relation = ">"
                continue
            tests, at = [], 0
            while at < len(part):
                m = _COMPOUND.match(part, at)
                if not m:
                    raise ValueError(f"selector not supported: {text}")
                tag, own_id, cls, attr, op, *value = m.groups()
                tests.append(("tag", tag.lower()) if tag else ("=", "id", own_id) if own_id else ("~=", "class", cls) if cls else (op or "has", attr.lower(), next((v for v in value if v is not None), "")))
                at = m.end()
            steps.append((relation, tuple(tests)))
            relation = " "
        if not steps:
            raise ValueError(f"selector not supported: {text}")
        out.append(tuple(steps))
    return tuple(out)


_TESTS = {
    "has": lambda have, want: True,
    "=": lambda have, want: have == want,
    "~=": lambda have, want: want in have.split(),
    "^=": lambda have, want: want != "" and have.startswith(want),
    "$=": lambda have, want: want != "" and have.endswith(want),
    "*=": lambda have, want: want != "" and want in have,
    "|=": lambda have, want: have == want or have.startswith(want + "-"),
}


def _fits(node: Node, tests: tuple) -> bool:
    return all(t[1] in ("*", node.tag) if t[0] == "tag" else t[1] in node.attrs and _TESTS[t[0]](node.attrs[t[1]], t[2]) for t in tests)


def _matches(node: Node, steps: tuple) -> bool:
    relation, tests = steps[-1]
    if not _fits(node, tests):
        return False
    if len(steps) == 1:
        return True
    up = node.parent
    while up is not None:
        if _matches(up, steps[:-1]):
            return True
        if relation == ">":
            return False
        up = up.parent
    return False


@functools.lru_cache(maxsize=512)
def _choices(text: str) -> tuple[frozenset, tuple]:
    """A selector's choices that are a tag alone, and the others."""
    tags = frozenset(c[0][1][0][1] for c in selector(text) if len(c) == 1 and len(c[0][1]) == 1 and c[0][1][0][0] == "tag" and c[0][1][0][1] != "*")
    return tags, tuple(c for c in selector(text) if len(c) > 1 or len(c[0][1]) > 1 or c[0][1][0][0] != "tag" or c[0][1][0][1] == "*")


def query(root: Node, text: str) -> list[Node]:
    tags, others = _choices(text)
    if not others:
        return [n for n in root.walk() if n.tag in tags]
    return [n for n in root.walk() if n.tag in tags or any(_matches(n, c) for c in others)]


def remove(root: Node, text: str) -> None:
    """Take out the elements that a selector finds, and what lies below them."""
    gone = {id(n) for n in query(root, text)}
    for n in list(root.walk()) if gone else ():
        if any(id(c) in gone for c in n.children):
            n.children = [c for c in n.children if id(c) not in gone]


def flat(text: str) -> str:
    return " ".join(text.replace("\ufeff", " ").split())


def stripped(text: str) -> str:
    return text.strip().strip("﻿").strip()


def markdown(root: Node) -> str:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if isinstance(node, tuple):  # the end of a block
            out.append(node[0])
        elif isinstance(node, str):
            if stripped(node):
                out.append(re.sub(r"[ \t]+", " ", node))
        else:
            if node.tag in PREFIX:
                out.append("\n\n" + PREFIX[node.tag])
                todo.append(("\n\n",))
            elif node.tag in ("li", "br"):
                out.append("\n- " if node.tag == "li" else "\n")
            todo += reversed(node.children)
    return stripped(re.sub(r"\n{3,}", "\n\n", "".join(out)))


def gfm(root: Node) -> str:
    """Markdown with six heading levels, links, images, emphasis, code, quotes, rules, nested lists and tables.

    A page nested deeper than Python's stack allows is written as plain Markdown.
    """

    def inner(node, depth=0):
        return "".join(walk(c, depth) for c in node.children)

    def walk(node, depth):
        if isinstance(node, str):
            return _SPACE.sub(" ", node)
        t = node.tag
        if re.fullmatch("h[1-6]", t):
            return f"\n\n{'#' * int(t[1])} {inner(node).strip()}\n\n"
        if t in ("strong", "b", "em", "i", "code"):
            mark = {"strong": "**", "b": "**", "code": "`"}.get(t, "*")
            text = inner(node, depth).strip()
            return f"{mark}{text}{mark}" if text else ""
        if t == "a":
            return f"[{inner(node, depth).strip()}]({node.attrs.get('href', '')})"
        if t == "img":
            return f"![{node.attrs.get('alt', '')}]({node.attrs.get('src', '')})"
        if t == "pre":
            return f"\n\n```\n{node.text().strip()}\n```\n\n"
        if t == "blockquote":
            return "\n\n" + "\n".join("> " + line for line in inner(node).strip().splitlines()) + "\n\n"
        if t in ("hr", "br"):
            return "\n\n---\n\n" if t == "hr" else "\n"
        if t in ("ul", "ol"):
            items = [c for c in node.children if isinstance(c, Node) and c.tag == "li"]
            return ("\n" if depth else "\n\n") + "\n".join("  " * depth + (f"{i}. " if t == "ol" else "- ") + inner(c, depth + 1).strip() for i, c in enumerate(items, 1)) + ("" if depth else "\n\n")
        if t == "table":
            rows = [[flat(c.text()).replace("|", "\\|") for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")] for r in node.walk() if r.tag == "tr"]
            return "\n\n" + "\n".join("| " + " | ".join(r) + " |" + ("\n" + "|" + " --- |" * len(r) if i == 0 else "") for i, r in enumerate(rows)) + "\n\n"
        return f"\n\n{inner(node, depth)}\n\n" if t in CLOSES_P else inner(node, depth)

    try:
        return re.sub(r"\n{3,}", "\n\n", walk(root, 0)).strip()
    except RecursionError:
        return markdown(root)


PARSED = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("title", "clean_text", "markdown", "canonical")]
    + [T.StructField("links", T.ArrayType(T.StringType())), T.StructField("selector_matches", T.MapType(T.StringType(), T.ArrayType(T.StringType())))]
    + [T.StructField(n, T.MapType(T.StringType(), T.StringType())) for n in ("open_graph", "meta")]
    + [T.StructField("json_ld", T.ArrayType(T.StringType()))]
)


def _head(nodes: list[Node], base: str | None) -> tuple[Node | None, str | None, dict, dict]:
    """Title element, canonical address, OpenGraph and named metadata of a page's elements."""
    graph, meta = {}, {}
    for n in nodes:
        content = stripped(n.attrs.get("content", "")) if n.tag == "meta" else ""
        if content and n.attrs.get("property", "").startswith("og:"):
            graph[n.attrs["property"][3:]] = content
        if content and "name" in n.attrs:
            meta[stripped(n.attrs["name"]).lower()] = content
    named = next((n for n in nodes if n.tag == "title"), None)
    canonical = next((resolved(base, stripped(n.attrs["href"])) for n in nodes if n.tag == "link" and n.attrs.get("rel", "").lower() == "canonical" and n.attrs.get("href")), None)
    return named, canonical, graph, meta


def extract(html: str | None, base: str | None, selectors: tuple = (), strip: bool = True, dialect: str = "plain", closed_only: bool = False) -> dict:
    """All fields of a page; metadata, selectors and links are read before boilerplate is taken out."""
    root = parse(html, closed_only)
    nodes = list(root.walk())
    named, canonical, graph, meta = _head(nodes, base)
    linked = []
    for n in nodes:
        if n.tag == "script" and n.attrs.get("type") == "application/ld+json":
            try:
                value = json.loads(n.text())
            except (ValueError, RecursionError):
                continue
            linked += [json.dumps(v, ensure_ascii=False) for v in (value if isinstance(value, list) else [value]) if isinstance(v, dict)]
    hrefs = [stripped(n.attrs["href"]) for n in nodes if n.tag == "a" and "href" in n.attrs]
    links = list(dict.fromkeys(resolved(base, h) for h in hrefs if h and not h.startswith("javascript:")))
    chosen = {s: [t for t in (flat(n.text()) for n in query(root, s)) if t] for s in selectors}
    remove(root, BOILERPLATE if strip else CODE_ONLY)
    left = {}
    for n in root.walk():
        left.setdefault(n.tag, n)
    top = left.get("main") or left.get("article") or left.get("body") or root
    title = graph.get("title", "") if named is None else stripped(named.text())
    return {"title": title, "clean_text": flat(top.text()), "markdown": (gfm if dialect == "gfm" else markdown)(top), "canonical": canonical, "links": links, "selector_matches": chosen, "open_graph": graph, "meta": meta, "json_ld": linked}


def page_fields(html: Column, base: Column, selectors: tuple = (), strip: bool = True, dialect: str = "plain", closed_only: bool = False) -> Column:
    """The fields as a struct. Each page is parsed once: filter on other columns first, then take fields of the struct."""
    for s in selectors:
        selector(s)

    @F.pandas_udf(PARSED)
    def run(pages: pd.Series, bases: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract(h, b, tuple(selectors), strip, dialect, closed_only) for h, b in zip(pages, bases, strict=True)], columns=PARSED.names)

    return run.asNondeterministic()(html, base)


def parse_pages(df: DataFrame, html: str = "html", base: str = "url", **options) -> DataFrame:
    """df without the HTML, with one column for each field; columns of those names are replaced. A null page is an empty one."""
    fields = page_fields(F.col(html), F.col(base), **options)
    kept = [c for c in df.columns if c != html and c not in PARSED.names]
    return df.select(*kept, fields.alias("_p")).select(*kept, "_p.*")


NODES = T.ArrayType(
    T.StructType(
        [T.StructField(n, T.IntegerType()) for n in ("node_id", "post", "parent_id", "depth")]
        + [T.StructField("tag", T.StringType()), T.StructField("attrs", T.MapType(T.StringType(), T.StringType())), T.StructField("own_text", T.StringType())]
    )
)


@F.pandas_udf(NODES)
def _nodes(pages: pd.Series) -> pd.Series:
    return pd.Series([number_nodes(parse(h)) for h in pages])


def number_nodes(root: Node) -> list[dict]:
    """Elements with their place on entering (node_id) and leaving (post): d is below a if a enters before and leaves after."""
    out, post, todo = [], 0, [(root, -1, 0, None)]
    while todo:
        node, parent, depth, row = todo.pop()
        if row is not None:
            row["post"], post = post, post + 1
            continue
        row = {"node_id": len(out), "post": 0, "parent_id": parent, "depth": depth, "tag": node.tag, "attrs": node.attrs, "own_text": "".join(c for c in node.children if isinstance(c, str))}
        out.append(row)
        todo.append((node, parent, depth, row))
        todo += [(c, row["node_id"], depth + 1, None) for c in reversed(node.children) if isinstance(c, Node)]
    return out


def dom_nodes(df: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, node_id, post, parent_id, depth, tag, attrs, own_text) rows: selectors become joins on key and intervals."""
    return df.select(key, F.explode(_nodes(F.col(html))).alias("n")).select(key, "n.*")


def descendants(nodes: DataFrame, key: str, above: Column, below: Column) -> DataFrame:
    """Nodes that fit `below` and lie under one that fits `above`."""
    a = nodes.where(above).select(key, F.col("node_id").alias("_a"), F.col("post").alias("_z"))
    return nodes.where(below).join(a, key).where((F.col("node_id") > F.col("_a")) & (F.col("post") < F.col("_z"))).drop("_a", "_z").dropDuplicates([key, "node_id"])


def skeleton(html: str | None, most_tokens: int | None = None) -> str:
    """The page's element outline without text; equal neighbours are written once with their count.

    With most_tokens (four characters each), whole lines of the deepest levels go first until the outline fits.
    """
    done: dict[int, tuple] = {}
    root = parse(html)
    for node in reversed(list(root.walk())):  # those below come before
        merged: list[list] = []
        for c in node.children:
            if isinstance(c, Node) and c.tag not in ("script", "style"):
                own = done.pop(id(c))
                if merged and merged[-1][0] == own:
                    merged[-1][1] += 1
                else:
                    merged.append([own, 1])
        name = node.tag + "".join(f".{c}" for c in node.attrs.get("class", "").split())
        lines = [(0, name)]
        for own, n in merged:
            lines += [(depth + 1, text + (f" count={n}" if n > 1 and at == 0 else "")) for at, (depth, text) in enumerate(own)]
        done[id(node)] = tuple(lines)
    lines = done[id(root)]
    written = lambda level: "".join("  " * d + t + "\n" for d, t in lines if d <= level)
    level = max(d for d, _ in lines)
    while most_tokens is not None and level and len(written(level)) > 4 * most_tokens:
        level -= 1
    return written(level)


def outline(html: Column, most_tokens: int | None = None) -> Column:
    """skeleton as an expression."""

    @F.pandas_udf(T.StringType())
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([skeleton(h, most_tokens) for h in pages], dtype=object)

    return run(html)


def query_all(root: Node, tag: str | None = None, class_name: str | None = None, own_id: str | None = None) -> list[str]:
    """Texts of the elements that have the tag, class and id asked for, in document order; empty ones are left out."""
    fits = lambda n: (tag is None or n.tag == tag.lower()) and (class_name is None or class_name in n.attrs.get("class", "").split()) and (own_id is None or n.attrs.get("id") == own_id)
    return [t for t in (flat(n.text()) for n in root.walk() if fits(n)) if t]


def query_with_regex(html: Column, pattern: str, group: int = 1) -> Column:
    """array<string> of a group of every match in the raw page; the whole match where the pattern has no group.

    ValueError for a group that the pattern doesn't have.
    """
    groups = re.compile(pattern).groups
    if group < 0 or groups and group > groups:
        raise ValueError(f"the pattern has {groups} groups, not {group}")
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(pattern), F.lit(group if groups else 0))


ELEMENTS = T.ArrayType(T.StringType())


def elements(html: Column, tag: str | None = None, class_name: str | None = None, own_id: str | None = None, closed_only: bool = False) -> Column:
    """query_all as an expression."""

    @F.pandas_udf(ELEMENTS)
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([query_all(parse(h, closed_only), tag, class_name, own_id) for h in pages], dtype=object)

    return run(html)


# Attributes that hold the value of an item's property, by element.
VALUE_IN = {"meta": "content", "a": "href", "area": "href", "link": "href", "img": "src", "audio": "src", "video": "src", "source": "src", "iframe": "src", "embed": "src", "object": "data", "data": "value", "meter": "value", "time": "datetime"}


def linked_items(root: Node, base: str | None = None) -> list[dict]:
    """Microdata and RDFa Lite: a dict for each item with syntax, its place, type, and properties (name, value, item).

    A property belongs to the nearest item above it. item is the number of the item that is the value, else -1.
    """
    items, of = [], {}
    owner: dict[tuple, int] = {}
    for n in root.walk():
        for syntax, scope, kind, prop in (("microdata", "itemscope", "itemtype", "itemprop"), ("rdfa", "typeof", "typeof", "property")):
            above = owner.get((syntax, id(n.parent)), -1)
            own = above
            vocabulary = n.attrs.get("vocab") if syntax == "rdfa" else None
            of[syntax, id(n)] = vocabulary if vocabulary is not None else of.get((syntax, id(n.parent)), "")
            if scope in n.attrs:
                own = len(items)
                name = n.attrs.get(kind, "").split()[:1]
                prefix = of[syntax, id(n)] if syntax == "rdfa" and name and ":" not in name[0] else ""
                items.append({"syntax": syntax, "item": own, "type": prefix + name[0] if name else "", "properties": []})
            owner[syntax, id(n)] = own
            if above >= 0 and prop in n.attrs:
                at = VALUE_IN.get(n.tag)
                value = n.attrs["content"] if "content" in n.attrs else n.attrs[at] if at in n.attrs else flat(n.text())
                value = resolved(base, stripped(value)) if at in ("href", "src", "data") and at in n.attrs and "content" not in n.attrs else flat(value)
                for name in n.attrs[prop].split():
                    items[above]["properties"].append({"name": name, "value": None if own != above else value, "child": own if own != above else -1})
    return items


PROPERTY = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType()), T.StructField("child", T.IntegerType())])
ITEMS = T.ArrayType(T.StructType([T.StructField("syntax", T.StringType()), T.StructField("item", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("properties", T.ArrayType(PROPERTY))]))


@F.pandas_udf(ITEMS)
def _items(pages: pd.Series, bases: pd.Series) -> pd.Series:
    return pd.Series([linked_items(parse(h), b) for h, b in zip(pages, bases, strict=True)], dtype=object)


def item_properties(df: DataFrame, key: str, html: str = "html", base: str = "url") -> DataFrame:
    """(key, syntax, item, type, place, name, value, child) rows of the Microdata and RDFa Lite items of pages."""
    rows = df.select(key, F.explode(_items(F.col(html), F.col(base))).alias("i")).select(key, "i.syntax", "i.item", "i.type", F.posexplode("i.properties").alias("place", "p"))
    return rows.select(key, "syntax", "item", "type", "place", "p.*")


# This repository's weights for finding a page's main content.
GOOD = re.compile(r"article|body|content|entry|main|page|post|story|text", re.I)
BAD = re.compile(r"ad-|ads|banner|combx|comment|footer|menu|meta|nav|promo|related|share|sidebar|social|sponsor|widget", re.I)
PARAGRAPHS = frozenset("p pre td blockquote li".split())


def readable(root: Node) -> tuple[Node, float]:
    """The element that holds the page's main content, and its score.

    Each paragraph of 25 characters or more gives 1, a point a comma and up to 3 for its length (a point a 100
    characters) to its parent, and half of it to its grandparent. Candidates add 25 for good class and id words, take 25
    off for bad ones, and are scaled by the share of their text outside links. The earliest of the best wins; body
    where there is no candidate.
    """
    scores: dict[int, float] = {}
    found: dict[int, Node] = {}
    nodes = list(root.walk())
    for n in nodes:
        if n.tag not in PARAGRAPHS or n.parent is None:
            continue
        text = flat(n.text())
        if len(text) < 25:
            continue
        points = 1 + text.count(",") + min(len(text) // 100, 3)
        for node, share in ((n.parent, 1.0), (n.parent.parent, 0.5)):
            if node is not None:
                if id(node) not in found:
                    named = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}" if node.attrs else ""
                    found[id(node)], scores[id(node)] = node, 25.0 * bool(GOOD.search(named)) - 25.0 * bool(BAD.search(named)) if named else 0.0
                scores[id(node)] += points * share
    best, top = None, 0.0
    inside = {id(n): len(flat(n.text())) for n in nodes if n.tag == "a"}  # characters of links in each element
    for n in reversed(nodes) if inside else ():  # those below come before
        if (own := inside.get(id(n))) and n.parent is not None:
            inside[id(n.parent)] = inside.get(id(n.parent), 0) + own
    for node in nodes:
        if id(node) in found:
            linked = inside.get(id(node), 0)
            whole = len(flat(node.text())) if linked else 0
            score = scores[id(node)] * (1 - linked / whole if whole else 1)
            if best is None or score > top:
                best, top = node, score
    return (best, top) if best is not None else (next((n for n in nodes if n.tag == "body"), root), 0.0)


def _untie(root: Node) -> None:
    """Leave a tree that has been read without cycles, so that it goes at once and not by the garbage collector."""
    for n in root.walk():
        n.parent = None


def body_text(html: str | None) -> str:
    """The body of article(), without its other fields."""
    root = parse(html)
    remove(root, CODE_ONLY)
    body = flat(readable(root)[0].text())
    _untie(root)
    return body


@F.pandas_udf(T.StringType())
def main_text(pages: pd.Series) -> pd.Series:
    """body_text as an expression."""
    return pd.Series([body_text(h) for h in pages], dtype=object)


ARTICLE = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "byline", "published", "body", "twitter_card", "canonical")] + [T.StructField("images", T.ArrayType(T.StringType())), T.StructField("n_words", T.IntegerType()), T.StructField("reading_seconds", T.IntegerType()), T.StructField("score", T.DoubleType())])


def article(html: str | None, base: str | None) -> dict:
    """An article's fields: the main content by readable(), metadata, absolute image addresses, and reading time at 200
    words a minute."""
    root = parse(html)
    nodes = list(root.walk())
    named, canonical, graph, meta = _head(nodes, base)
    cards = {n.attrs["name"].lower(): stripped(n.attrs.get("content", "")) for n in nodes if n.tag == "meta" and n.attrs.get("name", "").lower().startswith("twitter:")}
    remove(root, CODE_ONLY)
    top, score = readable(root)
    nodes = list(root.walk())
    by = next((flat(n.text()) for n in nodes if n.attrs and (n.attrs.get("rel") == "author" or n.attrs.get("itemprop") == "author" or "byline" in n.attrs.get("class", "").split())), None)
    when = next((n.attrs["datetime"] for n in nodes if n.tag == "time" and n.attrs.get("datetime")), None)
    properties = {n.attrs["property"].lower(): stripped(n.attrs.get("content", "")) for n in nodes if n.tag == "meta" and "property" in n.attrs}
    body = flat(top.text())
    words = len(body.split())
    images = list(dict.fromkeys(resolved(base, stripped(n.attrs["src"])) for n in top.walk() if n.tag == "img" and n.attrs.get("src")))
    if named is not None:
        remove(named, BOILERPLATE)  # as extract
    title = graph.get("title", "") if named is None else stripped(named.text())
    _untie(root)
    return {"title": graph.get("title") or title, "byline": meta.get("author") or by, "published": properties.get("article:published_time") or when, "body": body, "twitter_card": cards.get("twitter:card"), "canonical": canonical, "images": images, "n_words": words, "reading_seconds": -(-words * 60 // 200), "score": round(score, 6)}


def parse_articles(df: DataFrame, html: str = "html", base: str = "url") -> DataFrame:
    """df without the HTML, with the fields of ARTICLE; columns of those names are replaced."""

    @F.pandas_udf(ARTICLE)
    def run(pages: pd.Series, bases: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([article(h, b) for h, b in zip(pages, bases, strict=True)], columns=ARTICLE.names)

    kept = [c for c in df.columns if c != html and c not in ARTICLE.names]
    return df.select(*kept, run.asNondeterministic()(F.col(html), F.col(base)).alias("_a")).select(*kept, "_a.*")
