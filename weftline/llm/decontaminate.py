"""Benchmark decontamination in DataFrame operations only: size-partitioned MinHash containment search.

Benchmark items are put into classes by their number of distinct word shingles. An item's sketch is its smallest shingle
hashes, as many as a document that holds the wanted share of the item can't all miss: of n shingles with at least `need`
found, the n - need + 1 smallest hold a found one. So no item inside a document is lost, however long the document is.
Each class has a bound, the largest hash of its sketches; a document's shingles are looked up only below the largest
bound, and only in the classes whose bound they don't exceed and whose size the document can hold. Candidates are
verified by exact containment of the shingles' words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.store import unused, written

WORDS = 5
BROADCAST_ROWS = 200_000


def normal(text: Column) -> Column:
    """Lower-cased letters and digits, one space for all between, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def _words(text: Column) -> Column:
    return F.filter(F.split(normal(text), " "), lambda w: w != "")


def _places(words: Column, width: int) -> Column:
    """Starts of shingles of so many words in an array of words; none if there are fewer words."""
    return F.when(F.size(words) >= width, F.sequence(F.lit(0), F.size(words) - width)).otherwise(F.array().cast("array<int>"))


def _hashes(words: Column, width: int) -> Column:
    return F.transform(_places(words, width), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(width))))


def _shingles(words: Column, width: int) -> Column:
    return F.array_distinct(F.transform(_places(words, width), lambda i: F.array_join(F.slice(words, i + 1, width), " ")))


def _by_width(words: Column, of) -> Column:
    """of(words, width) with the width of an item: WORDS, or all its words where it has fewer."""
    out = of(words, WORDS)
    for width in range(1, WORDS):
        out = F.when(F.size(words) == width, of(words, width)).otherwise(out)
    return out


def sketches(benchmark: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Items (item_id, width, shingles, n) and sketch rows (item_id, width, size_class, hash, least): a document needs
    `least` shingles at all."""
    item = benchmark.where(F.col("item_id").isNotNull()).select("item_id", _words(F.col("text")).alias("w")).where(F.size("w") > 0)
    item = item.select("item_id", F.least(F.size("w"), F.lit(WORDS)).alias("width"), _by_width(F.col("w"), _shingles).alias("shingles"), F.array_sort(F.array_distinct(_by_width(F.col("w"), _hashes))).alias("hashes"))
    item = written(item.withColumn("n", F.size("shingles")).dropDuplicates(["item_id", "shingles"]), "items")
    top = F.floor(F.log2(F.col("n").cast("double"))).cast("int")  # the class holds n from 2^top up to 2^(top+1) - 1
    upper = F.least(F.pow(F.lit(2.0), top + 1).cast("int") - 1, F.col("n") + 8)
    size = upper - F.ceil(upper * percent / F.lit(100)).cast("int") + 1
    rows = item.select("item_id", "width", top.alias("size_class"), F.ceil(F.col("n") * percent / F.lit(100)).cast("int").alias("least"), F.explode(F.slice("hashes", 1, F.least(size, F.size("hashes")))).alias("hash"))
    return item, written(rows, "sketch")


def contained_items(docs: DataFrame, benchmark: DataFrame, *, percent: int = 80) -> DataFrame:
    """(doc_id, text_hash, item_id, n_shingles, n_shared, containment): items of which a document holds at least
    `percent` per cent of the distinct five-word shingles.

    Words are runs of letters and digits, lower-cased. An item of fewer than five words is one shingle, all its words.
    Null or empty texts, items without words and items without item_id match nothing. Rows of documents are told apart
    by doc_id (null counts as a value) and text; equal rows give one result, as do equal items. Other columns are ignored.
    """
    item, sketch = sketches(benchmark.select("item_id", "text"), percent)
    bounds = {(r["width"], r["size_class"]): (r["bound"], r["least"], r["rows"]) for r in sketch.groupBy("width", "size_class").agg(F.max("hash").alias("bound"), F.min("least").alias("least"), F.count("*").alias("rows")).collect()}  # a row a class: 5 widths, some 30 sizes
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    worded = docs.select("doc_id", "text_hash", _words(F.col("text")).alias("w"))
    side = F.broadcast(sketch) if sum(n for _, _, n in bounds.values()) <= BROADCAST_ROWS else sketch  # larger benchmarks: a shuffled join, which splits hot keys
    pairs, widths = None, sorted({width for width, _ in bounds})
    for width in widths:
        own = {c: (bound, least) for (w, c), (bound, least, _) in bounds.items() if w == width}
        n_doc = F.size("w") - width + 1
        reach = F.greatest(*(F.when(n_doc >= least, F.lit(bound)) for bound, least in own.values()), F.lit(None).cast("long"))
        hashed = worded.where(F.size("w") >= width).select("doc_id", "text_hash", n_doc.alias("n_doc"), F.explode(F.filter(_hashes(F.col("w"), width), lambda h: h <= reach)).alias("hash"))
        met = hashed.join(side.where(F.col("width") == width), "hash").where(F.col("n_doc") >= F.col("least")).select("doc_id", "text_hash", "item_id")
        pairs = met if pairs is None else pairs.unionByName(met)
    if pairs is None:
        pairs = docs.select("doc_id", "text_hash").join(item.select("item_id"), F.lit(False))
    pairs = written(pairs.distinct(), "candidates")
    # Verified by the words: rows of a document and a shingle on both sides, however many items a document holds.
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash"))
    held = worded.alias("d").join(pairs.select("doc_id", "text_hash").distinct().alias("p"), same("d", "p"), "left_semi")
    held = held.select("doc_id", "text_hash", F.explode(F.array_distinct(F.concat(F.array().cast("array<string>"), *(_shingles(F.col("w"), width) for width in widths)))).alias("shingle")).distinct()
    wanted = pairs.join(item.select("item_id", "n", F.explode("shingles").alias("shingle")), "item_id")
    both = wanted.alias("w").join(held.alias("h"), same("w", "h") & (F.col("w.shingle") == F.col("h.shingle")))
    found = both.groupBy("w.doc_id", "w.text_hash", "w.item_id", "w.n").agg(F.count("*").alias("n_shared")).where(F.col("n_shared") * 100 >= F.col("n") * percent)
    out = found.select("doc_id", "text_hash", "item_id", F.col("n").cast("long").alias("n_shingles"), "n_shared")
    return out.distinct().withColumn("containment", F.round(F.col("n_shared") / F.col("n_shingles"), 6))


def without_benchmark(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the rows that hold a benchmark item; columns stay as they are, whatever their names."""
    doc, digest = unused(docs, "doc"), unused(docs, "digest")
    found = contained_items(docs, benchmark, **options).select(F.col("doc_id").alias(doc), F.col("text_hash").alias(digest)).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(digest)), "left_anti")


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contained_items(docs, benchmark).select("doc_id", "item_id", "n_shingles", "n_shared", "containment")


SQL = r"""
WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS whole FROM documents),
b AS (SELECT item_id, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM benchmark),
s AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) BETWEEN 1 AND 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM b),
m AS (
  SELECT doc_id, item_id, count(*) AS n_shingles, count(*) FILTER (contains(whole, ' ' || shingle || ' ')) AS n_shared
  FROM d, s GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_shared, round(CAST(n_shared AS DOUBLE) / n_shingles, 6) AS containment
FROM m WHERE n_shared * 100 >= n_shingles * 80
"""
