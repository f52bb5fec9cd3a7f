"""The index of files found in open directories: build, search, statistics, backfill and crawl."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weftline.functions import urls
from weftline.operators import html as pages

NAME_TOKEN = r"[^\p{L}\p{N}]+"


def classified(links: DataFrame, url: str = "file_url") -> DataFrame:
    """Indexable links with file_name and file_type; those of type Other go, as a crawl drops them."""
    own = links.where(urls.is_indexable(F.col(url))).withColumn("file_name", urls.file_name(F.col(url)))
    return own.withColumn("file_type", urls.file_type(F.col("file_name"))).where(F.col("file_type") != "Other")


def insert_or_ignore(index: DataFrame | None, new: DataFrame, order: list | None = None) -> DataFrame:
    """Rows of new whose file_url the index doesn't hold; of rows that repeat one, the first in the given order.

    A file_type is written as its normal name where it is an alias.
    """
    first = Window.partitionBy("file_url").orderBy(*(order or ["discovered_at", "file_name"]))
    kept = new.where("file_url is not null").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    kept = kept.withColumn("file_type", F.coalesce(urls.normal_type(F.col("file_type")), F.col("file_type")))
    return kept if index is None else kept.join(index.select("file_url"), "file_url", "left_anti").select(*kept.columns)


def folded(text: Column) -> Column:
    """Lower case without diacritics (combining marks of Latin letters)."""
    plain, marked = "aaaaaaceeeeiiiinooooouuuuyy", "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
    return F.translate(F.lower(text), marked, plain)


def inverted(index: DataFrame) -> DataFrame:
    """(token, id, place, n_tokens) of file names."""
    tokens = F.filter(F.split(folded(F.col("file_name")), NAME_TOKEN), lambda t: t != "")
    return index.select("id", tokens.alias("_t")).select("id", F.size("_t").alias("n_tokens"), F.posexplode("_t").alias("place", "token"))


def match_terms(query: str) -> list[list[str]]:
    """A query as words to find; each word is a phrase of tokens, the last one a prefix."""
    import re
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFD", query.lower()) if not unicodedata.combining(c))
    return [found for word in re.findall(r"[\w.\-]+", plain) if (found := re.findall(r"[^\W_]+", word))]


def search_fts(index: DataFrame, query: str, file_type: str | None = None, limit: int = 50) -> DataFrame:
    """Files whose name holds every word of the query (as a prefix; joined words as a phrase), best BM25 first."""
    phrases = match_terms(query)
    if not phrases:
        return index.limit(0)
    posted = inverted(index)
    totals = posted.groupBy("id").agg(F.max("n_tokens").alias("n")).agg(F.count("*").alias("_N"), F.avg("n").alias("_avg"))
    hits = None
    for n, phrase in enumerate(phrases):
        found = posted.where(F.startswith("token", F.lit(phrase[-1])) if len(phrase) == 1 else F.col("token") == phrase[0]).select("id", "place", "n_tokens")
        for at, word in enumerate(phrase[1:], 1):
            last = at == len(phrase) - 1
            nxt = posted.where(F.startswith("token", F.lit(word)) if last else F.col("token") == word).select("id", (F.col("place") - at).alias("place"))
            found = found.join(nxt, ["id", "place"], "left_semi")
        per = found.groupBy("id").agg(F.count("*").alias("tf"), F.max("n_tokens").alias("n_tokens")).withColumn("term", F.lit(n))
        hits = per if hits is None else hits.unionByName(per)
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    scored = hits.join(F.broadcast(df), "term").join(F.broadcast(totals))  # a row a word of the query, and one row
    idf = F.log(1 + (F.col("_N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("n_tokens") / F.col("_avg")))
    best = scored.groupBy("id").agg(F.count("*").alias("_hit"), F.sum(weight).alias("score")).where(F.col("_hit") == len(phrases)).drop("_hit")
    out = index.join(best, "id")
    return _of_type(out, file_type).orderBy(F.desc("score"), "file_name", "file_url").limit(limit)


def search_like(index: DataFrame, query: str, file_type: str | None = None, limit: int = 50) -> DataFrame:
    """Files whose name holds the query as it stands, whatever its case, by name."""
    out = index.where(F.contains(F.lower("file_name"), F.lower(F.lit(query))))
    return _of_type(out, file_type).orderBy("file_name", "file_url").limit(limit)


def _of_type(df: DataFrame, file_type: str | None) -> DataFrame:
    return df if file_type is None else df.where(F.col("file_type") == file_type)


def search(index: DataFrame, query: str, file_type: str | None = None, limit: int = 50, mode: str = "auto") -> DataFrame:
    """mode fts, like, or auto: full text, and names that hold the query where full text finds nothing.

    Raises ValueError for a query of no or over 200 characters, a limit out of 1 to 200, an unknown mode or type.
    """
    query = query.strip()
    if not 1 <= len(query) <= 200 or not 1 <= limit <= 200 or mode not in ("auto", "fts", "like"):
        raise ValueError("query of 1 to 200 characters, limit of 1 to 200 and mode auto, fts or like are wanted")
    if file_type is not None:
        words = " ".join(file_type.lower().replace("_", " ").replace("-", " ").replace("/", " ").split())
        found = next((kind for kind, names in urls.ALIASES.items() if words in names.split(",")), None)
        if found is None:
            raise ValueError(f"no such file type: {file_type}")
        file_type = found
    fts = search_fts(index, query, file_type, limit).select(*index.columns) if mode != "like" else None
    if mode == "fts" or fts is not None and not fts.isEmpty():
        return fts
    return search_like(index, query, file_type, limit)


def stats(index: DataFrame) -> DataFrame:
    """(file_type, total), most first."""
    return index.groupBy("file_type").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "file_type")


def backfill(index: DataFrame, posted: DataFrame) -> DataFrame:
    """Posting rows of the files that have none yet."""
    return inverted(index.join(posted.select("id").distinct(), "id", "left_anti"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def page_anchors(html: pd.Series, url: pd.Series) -> pd.Series:
    """Normal URLs of all anchors of a listing, its base element honoured, repeats kept."""

    def found(page, address):
        root = pages.parse(page)
        base = next((urls.normalised(address, n.attrs["href"]) for n in root.walk() if n.tag == "base" and n.attrs.get("href")), None) or address
        return [u for n in root.walk() if n.tag == "a" and "href" in n.attrs and (u := urls.normalised(base, n.attrs["href"]))]

    return pd.Series([found(h, u) for h, u in zip(html, url, strict=True)], dtype=object)


def crawl(seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], *, max_depth: int = 10, max_directories: int | None = None, max_files: int | None = None, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Files (file_url, depth, root) and directories (url, depth, root) below the seeds, a round for each depth.

    fetch adds the column html to (url, depth, root); null html is an error of that directory. keep writes a DataFrame
    and reads it again (it cuts the lineage between rounds). Directories of a round are taken in order of URL up to
    max_directories in all, and files in order of depth and URL up to max_files. A directory is followed below its
    root only, and once.
    """
    todo = seeds.select(urls.canonical_directory(F.col("url")).alias("url")).where(urls.is_http_url(F.col("url"))).distinct()
    todo = keep(todo.select("url", F.lit(0).alias("depth"), F.col("url").alias("root")))
    visited, files = None, None
    for depth in range(max_depth + 1):
        if max_directories is not None:
            left = max_directories - (visited.count() if visited is not None else 0)
            todo = keep(todo.orderBy("url").limit(max(0, left)))
        if todo.isEmpty():
            break
        visited = todo if visited is None else keep(visited.unionByName(todo))
        found = keep(fetch(todo).withColumn("link", F.explode(page_anchors("html", "url"))).select("root", "link"))
        below = found.where(urls.is_within(F.col("root"), F.col("link")))
        own = classified(below.select(F.col("link").alias("file_url"), F.lit(depth).alias("depth"), "root"))
        files = own if files is None else files.unionByName(own)
        todo = below.where(urls.is_directory_url(F.col("link"))).groupBy(urls.canonical_directory(F.col("link")).alias("url")).agg(F.min("root").alias("root"))
        todo = keep(todo.join(visited, "url", "left_anti").select("url", F.lit(depth + 1).alias("depth"), "root"))
    if files is None:
        files = classified(todo.select(F.col("url").alias("file_url"), "depth", "root")).limit(0)
    files = files.groupBy("file_url", "file_name", "file_type").agg(F.min("depth").alias("depth"), F.min("root").alias("root"))
    return (files if max_files is None else files.orderBy("depth", "file_url").limit(max_files)), (visited if visited is not None else todo)


def crawl_stats(fetched: DataFrame, files: DataFrame) -> DataFrame:
    """One row of counters: directories fetched, errors, links of files met, files indexed, and links met again.

    fetched: (url, html), a row a directory; files: (file_url), a row a link met.
    """
    seen = fetched.agg(F.count("*").alias("directories"), F.count_if(F.col("html").isNull()).alias("errors"))
    found = files.agg(F.count("*").alias("files_seen"), F.count_distinct("file_url").alias("files"))
    return seen.join(found).withColumn("repeats", F.col("files_seen") - F.col("files"))  # one row each
