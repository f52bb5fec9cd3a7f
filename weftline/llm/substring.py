"""Substring dedup by De Bruijn compaction.

Edges of the graph are token k-mers that more than one document may hold. To find them without shuffling every k-mer,
each k-mer is stood for by its minimizer (the least hash of the half-length token runs inside it): equal k-mers have
equal minimizers, so only those whose minimizer two documents share become edges. Joins with the edges' degrees tell
where a path doesn't branch; runs of nonbranching edges compact into one path, whose occurrences all have the same
source documents. Digests of the words at the source coordinates verify each occurrence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.store import maybe_in, written
from weftline.llm.words import mixed, run_hashes, sliced, word_hashes


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters other than ASCII white space, as UTF-8."""
    return text.encode("utf-8", "replace").split() if text else []


def minima(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each n neighbouring values."""
    size = 1
    while size * 2 <= n:
        values, size = np.minimum(values[:-size], values[size:]), size * 2
    return np.minimum(values[: len(values) - (n - size)], values[n - size :]) if n > size else values


def minimizers(codes: np.ndarray, k: int) -> np.ndarray:
    """For each k-mer, the least hash of the runs of k // 2 tokens inside it."""
    return minima(run_hashes(codes, k // 2), k - k // 2 + 1)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = pa.array(np.cumsum([0, *map(len, parts)]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts).view(np.int64)))


def _scan(k: int):
    """A mapInArrow function: number of words, digest of the words and distinct minimizers of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            codes, bounds = word_hashes(batch.column(2))
            least = minimizers(codes, k) if len(codes) >= k else codes[:0]
            count, digest, own = np.diff(bounds), [], []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                digest.append(hashlib.md5(codes[a:b].tobytes()).digest())
                part = least[a : max(a, b - k + 1)]
                own.append(np.unique(part[np.append(True, part[1:] != part[:-1])]) if len(part) else part)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(count, pa.int64()), pa.array(digest, pa.binary()), _lists(own)], ["doc_id", "tag", "n_words", "digest", "least"])

    return run


def _edges(k: int):
    """A mapInArrow function: the k-mers whose minimizer is shared, with check hashes of themselves and neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["edge", "more", "doc_id", "tag", "at", "next", "prev"]
        for batch in sliced(batches, 2):
            words, bounds = word_hashes(batch.column(2))
            lists = batch.column(3)
            for row, (doc, tag) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                codes = words[bounds[row] : bounds[row + 1]]
                if len(codes) < k:
                    continue
                at = np.flatnonzero(np.isin(minimizers(codes, k), lists[row].values.to_numpy().view(np.uint64)))
                if not len(at):
                    continue
                edge = run_hashes(codes, k)
                more = (run_hashes(mixed(codes ^ np.uint64(0x5851F42D4C957F2D)), k, 0xD1342543DE82EF95) >> np.uint64(33)).astype(np.int32)
                side = np.zeros(len(edge) + 2, np.int32)  # 0 where no edge follows or comes before
                side[at + 1] = (edge[at] >> np.uint64(34)).astype(np.int32) + 1
                columns = [edge[at].view(np.int64), more[at], np.full(len(at), doc), np.full(len(at), tag, np.int32), at.astype(np.int32), side[at + 2], side[at]]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return run


def _digests(k: int):
    """A mapInArrow function: a digest of the words of each path's occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            out = []
            for doc, tag, text, paths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                out += [(doc, tag, p["first"], p["last"] + k, hashlib.md5(b" ".join(words[p["first"] : p["last"] + k])).digest()) for p in paths]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "tag", "start", "end", "digest"])

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 1):
        count, gone, kept = [], [], []
        for text, spans, whole in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            words = words_of(text)
            keep = np.full(len(words), not whole)
            for s in spans or ():
                keep[s["start"] : s["end"]] = False
            left = words if keep.all() else [words[i] for i in np.flatnonzero(keep)]
            count.append(len(words))
            gone.append(len(words) - len(left))
            kept.append(b" ".join(left))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(count, pa.int64()), pa.array(gone, pa.int64())], ["doc_id", "text", "n_words", "n_removed"])


def _once(docs: DataFrame) -> DataFrame:
    """Each different row once, dealt as the joins by (doc_id, tag) need it: a repeated row would double its places."""
    return docs.repartition("doc_id", "tag").dropDuplicates(["doc_id", "tag", "text"])


def repeated_spans(docs: DataFrame, *, k: int = 50) -> tuple[DataFrame, DataFrame]:
    """Spans (doc_id, tag, spans) of words to remove, and copies (doc_id, tag) that go as a whole.

    tag is hash(text); rows without doc_id take no part.
    """
    docs = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("tag"), "text")
    scan = written(docs.select("doc_id", "tag", "text").mapInArrow(_scan(k), "doc_id long, tag int, n_words long, digest binary, least array<long>").where(F.col("n_words") >= k), "substring-scan")
    # Copies with the same words go as a whole; only the one with the smallest doc_id takes part in the graph.
    first = scan.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    copies = written(scan.select("doc_id", "tag", "digest").join(first, ["digest", "doc_id"], "left_anti").select("doc_id", "tag").distinct(), "substring-copies")
    part = scan.join(first, ["digest", "doc_id"], "left_semi").groupBy("doc_id", "digest").agg(F.min("tag").alias("tag"), F.first("least").alias("least"))
    least = part.select("doc_id", "tag", F.explode("least").alias("m"))
    shared = least.groupBy("m").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("m")
    lists = written(least.join(shared, "m", "left_semi").groupBy("doc_id", "tag").agg(F.collect_list("m").alias("shared")), "substring-shared")
    likely, _ = maybe_in(docs, lists, ["doc_id", "tag"])
    edges = written(_once(likely).join(lists, ["doc_id", "tag"]).select("doc_id", "tag", "text", "shared").mapInArrow(_edges(k), "edge long, more int, doc_id long, tag int, at int, next int, prev int"), "substring-edges")

    degrees = edges.groupBy("edge", "more").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), ((F.min("next") == F.max("next")) & (F.min("next") != 0)).alias("one_next"), ((F.min("prev") == F.max("prev")) & (F.min("prev") != 0)).alias("one_prev")).where("lo <> hi")
    known = edges.select("edge", "more", "doc_id", "tag", "at").join(degrees.select("edge", "more", "one_next", "one_prev"), ["edge", "more"])
    order = Window.partitionBy("doc_id", "tag").orderBy("at")
    goes_on = (F.lag("at").over(order) == F.col("at") - 1) & F.lag("one_next").over(order) & F.col("one_prev")
    paths = known.withColumn("starts", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("path", F.sum("starts").over(order))
    paths = paths.groupBy("doc_id", "tag", "path").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    paths = written(paths.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("first", "last")).alias("paths")), "substring-paths")
    likely, _ = maybe_in(docs, paths, ["doc_id", "tag"])
    places = written(_once(likely).join(paths, ["doc_id", "tag"]).select("doc_id", "tag", "text", "paths").mapInArrow(_digests(k), "doc_id long, tag int, start int, end int, digest binary"), "substring-places")
    source = places.groupBy("digest").agg(F.min("doc_id").alias("source"))
    gone = places.join(source, "digest").where(F.col("doc_id") > F.col("source"))
    return gone.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("start", "end")).alias("spans")), copies


def drop_repeats(docs: DataFrame, *, k: int = 50) -> DataFrame:
    """(doc_id, text, n_words, n_removed), a row for each row of docs; text is the kept words joined by one space.

    A word goes if a window of k consecutive words that covers it also starts in a document with a smaller doc_id.
    Words are runs of characters other than ASCII white space, unchanged; null or empty text has none. Repeats inside
    one document stay. Rows without doc_id are neither sources nor cut. Rows that repeat a doc_id are no smaller than
    each other, so they don't cut each other.
    """
    spans, copies = repeated_spans(docs, k=k)
    cut = written(spans.withColumn("whole", F.lit(False)).unionByName(copies.select("doc_id", "tag", F.lit(None).cast("array<struct<start:int,end:int>>").alias("spans"), F.lit(True).alias("whole"))), "substring-cut")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("tag"), "text")
    likely, clean = maybe_in(docs, cut, ["doc_id", "tag"])
    both = likely.join(cut, ["doc_id", "tag"], "left").select("doc_id", "text", "spans", F.coalesce("whole", F.lit(False)).alias("whole"))
    rest = clean.select("doc_id", "text", F.lit(None).cast("array<struct<start:int,end:int>>").alias("spans"), F.lit(False).alias("whole"))
    return both.unionByName(rest).mapInArrow(_kept, "doc_id long, text string, n_words long, n_removed long")


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    kept = drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, hash(array_to_string(w[i:i + 49], ' ')) AS h FROM (
    SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
src AS (SELECT h, min(doc_id) AS lo FROM win GROUP BY h),
hit AS (SELECT win.doc_id, i FROM win JOIN src USING (h) WHERE win.doc_id > lo),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM hit),
pos AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM w),
kept AS (
  SELECT pos.doc_id, string_agg(word, ' ' ORDER BY pos.i) AS t, count(*) AS n FROM pos
  ANTI JOIN gone ON pos.doc_id = gone.doc_id AND pos.i = gone.i GROUP BY pos.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
