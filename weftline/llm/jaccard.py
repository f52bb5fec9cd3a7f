"""N-gram Jaccard self-join with set-relation skipping.

Documents are sets of word shingles; equal sets are one set. A first table ranks shingles by frequency, and each set puts
its rarest ones (as many as a partner can't all miss) into index lists, with its size and the shingle's position.

Index lists are skipped in blocks, by size band and by position. The first shingle that two linked sets share is at the
front of the smaller set (its first n - 2tn/(1+t) + 1 shingles), so entries behind the front are met by larger sets'
entries never, and two such entries never meet: those blocks are left out before the join, not filtered after it.

And answers are derived from those of highly similar sets. Members of a long list are compared with central members
first; a set highly similar to one has its answers (all that it links with is in one component), so only pairs that the
answers so far don't decide are compared further, with more centres each round, and all that is left in the last. Sets
whose prefixes differ too much by their marks (a bit for each shingle) are no pair. No link between different components
is lost: every pair that is skipped is either below the threshold or already joined.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.components import components
from weftline.llm.store import maybe_in, removed, swept, written
from weftline.llm.words import run_hashes, sliced, word_hashes

BYTES_A_COUNTER = 128
LEAST_BITS, MOST_BITS = 14, 26
BLOCK = 1 << 13
LONG_LIST = 32
CENTRES = (1, 4, 16)
MARK_BITS = 256


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """For each text, sorted distinct hashes of its n-word shingles, A-Z lower-cased; of all words if they are fewer."""
    words, bounds = word_hashes(texts, lower=True)
    runs, out = run_hashes(words, n), []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        out.append(np.unique(runs[a : b - n + 1]) if b - a >= n else run_hashes(words[a:b], b - a) if b > a else words[:0])
    return out


def counter_bits(text_bytes: int) -> int:
    """The table of counters grows with the texts, to 2^26 counters: one byte each is broadcast."""
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(text_bytes, 1) / BYTES_A_COUNTER))))


def _scan(n: int, bits: int):
    """A mapInArrow function: a row for each text with its set's size and digest, and the task's shingle counters."""
    names = ["doc_id", "tag", "size", "digest", "block", "counts"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int32)
        for batch in sliced(batches, 2):
            sets = shingle_sets(batch.column(2), n)
            np.add.at(counts, (np.concatenate(sets) & np.uint64(len(counts) - 1)).astype(np.int64), 1)
            none = [None] * batch.num_rows
            columns = [batch.column(0), batch.column(1), [len(x) for x in sets], [hashlib.md5(x.tobytes()).digest() for x in sets], none, none]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
        size = min(BLOCK, len(counts))
        for at in range(0, len(counts), size):
            if counts[at : at + size].any():
                part = np.minimum(counts[at : at + size], 255).astype(np.uint8).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((None, None, None, None, at // size, part), kinds, strict=True)], names)

    return run


def _classes(scan: DataFrame, bits: int) -> np.ndarray:
    """A frequency class of each counter: 0 up to twice the mean and a little, then one more for each doubling.

    Counts are summed and classed in tasks, a block each; the driver gets a byte a counter.
    """
    mean = (scan.agg(F.sum("size")).first()[0] or 0) / (1 << bits)
    steps = ((2 * mean + 8) * 2.0 ** np.arange(32)).astype(np.int64)

    def classed(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(pdf["counts"].iloc[0]), np.int64)
        for c in pdf["counts"]:
            total += np.frombuffer(c, np.uint8)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "classes": [np.searchsorted(steps, total).astype(np.uint8).tobytes()]})

    out = np.zeros(1 << bits, np.uint8)
    for r in scan.where("block is not null").select("block", "counts").groupBy("block").applyInPandas(classed, "block int, classes binary").toLocalIterator():
        own = np.frombuffer(r["classes"], np.uint8)
        out[r["block"] * len(own) : (r["block"] + 1) * len(own)] = own
    return out


def prefix_size(n: np.ndarray | int, percent: int):
    """How many of a set's first shingles must hold one of any partner's."""
    return n - (n * percent + 99) // 100 + 1


def _prefixes(held, n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = held.value
        for batch in sliced(batches, 1):
            ids, hashes, sizes, places, marks = [], [], [], [], []
            for doc, found in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), n), strict=True):
                if not len(found):
                    continue
                p = prefix_size(len(found), percent)
                first = found[np.argsort(classes[(found & np.uint64(len(classes) - 1)).astype(np.int64)], kind="stable")[:p]]
                mark = np.zeros(MARK_BITS, bool)
                mark[(first >> np.uint64(24)).astype(np.int64) % MARK_BITS] = True
                hashes += [np.zeros(1, np.uint64), first]  # place 0: the row of the set itself
                ids.append(np.full(p + 1, doc))
                sizes.append(np.full(p + 1, len(found)))
                places.append(np.arange(p + 1))
                marks += [np.packbits(mark).view("<i8").tolist(), *[None] * p]
            if ids:
                columns = [np.concatenate(hashes).view(np.int64), np.concatenate(ids), np.concatenate(sizes), np.concatenate(places), marks]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["h", "id", "size", "place", "mark"])

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            found = shingle_sets(batch.column(1), n)
            ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "shingles"])

    return run


def _overlap_needed(a: str, b: str, percent: int) -> Column:
    return F.ceil((F.col(a) + F.col(b)) * percent / F.lit(100 + percent))


def _front(size: Column, percent: int) -> Column:
    return size - F.floor((2 * size * percent + 99 + percent) / F.lit(100 + percent)) + 1


def _may_link(a: str, b: str, percent: int) -> Column:
    """Whether two sets' sizes and marks leave room for a link.

    A set's mark has a bit for each shingle of its prefix, so a bit of one that the other lacks stands for a shingle that
    the prefixes don't share. The overlap is at most the shared part of the prefixes and what lies beyond the prefix of
    the set whose prefix ends first.
    """
    sizes = [F.col(f"size_{k}") for k in (a, b)]
    own = [F.ceil(s * percent / F.lit(100)) - 1 for s in sizes]
    lacking = [sum((F.bit_count(F.get(f"mark_{x}", F.lit(i)).bitwiseAND(F.bitwise_not(F.get(f"mark_{y}", F.lit(i))))) for i in range(MARK_BITS // 64)), F.lit(0)) for x, y in ((a, b), (b, a))]
    shared = F.least(*(s - o - gone for s, o, gone in zip(sizes, own, lacking, strict=True)))
    close = (sizes[0] * 100 >= sizes[1] * percent) & (sizes[1] * 100 >= sizes[0] * percent)
    return close & (shared + F.greatest(*own) >= _overlap_needed(f"size_{a}", f"size_{b}", percent))


class _Join:
    """One self-join: distinct sets (doc_id of the smallest holder, text), and the pairs of them that link."""

    def __init__(self, texts: DataFrame, n: int, percent: int):
        self.texts, self.n, self.percent = texts, n, percent

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) of which any two sets link; all sets of both are read again for an exact count."""
        pairs = written(pairs.select("a", "b").distinct(), "jaccard-pairs")
        ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "jaccard-ids")
        likely, _ = maybe_in(self.texts, ids, ["doc_id"])
        likely = likely.join(ids.hint("merge"), "doc_id", "left_semi").distinct()
        sets = written(likely.select("doc_id", "text").mapInArrow(_sets(self.n), "id long, shingles array<long>"), "jaccard-sets")
        del likely
        swept(sets.sparkSession)
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")).hint("merge"), "a")
        both = both.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")).hint("merge"), "b")
        shared, union = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
        links = written(both.where(shared * (100 + self.percent) >= union * self.percent).select("a", "b"), "jaccard-links")
        del both
        for table in (pairs, ids, sets):
            removed(table)
        swept(links.sparkSession)
        return links

    def short_pairs(self, index: DataFrame) -> DataFrame:
        """Pairs of the short lists whose shared shingles still allow the overlap.

        A set's whole prefix looks into the fronts of sets no larger. What the two share is among what they met with, in
        long lists, or beyond the prefix of the one or the front of the other, whichever ends first. Of the prefixes they
        share no more than either's shingles that lie in any other prefix (`kept`), which the marks of long sets don't tell.
        """
        short, p = index.where(F.col("n") <= LONG_LIST), self.percent
        own = lambda k: [F.col("id").alias(k), *(F.col(c).alias(f"{d}_{k}") for c, d in (("size", "size"), ("mark", "mark"), ("long_lists", "long"), ("kept", "kept")))]
        a, b = short.select("h", *own("a")), short.where("front").select("h", *own("b"))
        smaller = (F.col("size_b") < F.col("size_a")) | ((F.col("size_b") == F.col("size_a")) & (F.col("b") < F.col("a")))
        needed, unseen = _overlap_needed("size_a", "size_b", p), [F.ceil(F.col(f"size_{k}") * p / F.lit(100)) - 1 for k in ("a", "b")]
        enough = F.least("kept_a", "kept_b") + F.greatest(*unseen) >= needed
        beyond = F.greatest(unseen[0], F.col("size_b") - _front(F.col("size_b"), p))
        met = a.join(b.hint("merge"), "h").where(smaller & enough & _may_link("a", "b", p)).select("a", "b", (needed - beyond - F.least("long_a", "long_b")).alias("least"))
        return met.groupBy("a", "b", "least").agg(F.count("*").alias("met")).where("met >= least").select("a", "b")

    def _meets(self, centres: DataFrame, entries: DataFrame) -> DataFrame:
        """Pairs of a centre and an entry of the same list in different components, whose positions leave room.

        Blocks of a list are size bands, each in front and behind. A centre at the front looks into all blocks of its band
        and the next ones; one behind the front only into the fronts of its own band and the one below.
        """
        base = float(np.log(100 / self.percent))
        band = F.floor(F.log(F.col("size").cast("double")) / base).cast("int")
        own = lambda k: [F.col("id").alias(k), *(F.col(c).alias(f"{d}_{k}") for c, d in (("size", "size"), ("place", "place"), ("mark", "mark"), ("component", "comp"), ("front", "front")))]
        blocks = [(d, f) for d in (-1, 0, 1) for f in (True, False)]
        within = lambda wanted: F.array(*(F.struct((band + d).alias("band"), F.lit(f).alias("at_front")) for d, f in wanted))
        reach = F.when(F.col("front"), within(blocks)).otherwise(within([(-1, True), (0, True)]))
        x = centres.select("h", *own("x"), F.explode(reach).alias("block")).select("*", "block.*").drop("block")
        y = entries.select("h", *own("y"), band.alias("band"), F.col("front").alias("at_front"))
        small_front = F.when(F.col("size_x") < F.col("size_y"), F.col("front_x")).when(F.col("size_x") > F.col("size_y"), F.col("front_y")).otherwise(F.col("front_x") | F.col("front_y"))
        room = 1 + F.least(F.col("size_x") - F.col("place_x"), F.col("size_y") - F.col("place_y"))
        met = y.join(x, ["h", "band", "at_front"]).where((F.col("comp_x") != F.col("comp_y")) & small_front & _may_link("x", "y", self.percent) & (room >= _overlap_needed("size_x", "size_y", self.percent)))
        return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    def _centres(self, entries: DataFrame, most: int) -> DataFrame:
        """For each list, the entry of most shared shingles of each of its `most` largest components."""
        best = F.struct("kept", -F.col("id"))
        columns = ("id", "size", "place", "mark", "front")
        per = entries.groupBy("h", "component").agg(F.count("*").alias("_c"), *(F.max_by(c, best).alias(c) for c in columns))
        rank = F.row_number().over(Window.partitionBy("h").orderBy(F.desc("_c"), "component"))
        return per.withColumn("_r", rank).where(F.col("_r") <= most).select("h", "component", *columns)

    def found(self, index: DataFrame) -> DataFrame:
        """(id, component) of the sets that link with any."""
        long = index.where(F.col("n") > LONG_LIST).select("h", "id", "size", "place", "mark", "kept", "front")
        alone = long.withColumn("component", F.col("id"))
        best = F.struct("kept", -F.col("id"))
        first = long.groupBy("h").agg(*(F.max_by(c, best).alias(c) for c in ("id", "size", "place", "mark", "front"))).withColumn("component", F.col("id"))
        links = self.linked(self.short_pairs(index).unionByName(self._meets(first, alone)))
        done = written(components(links), "jaccard-components")
        for most in (*CENTRES[1:], None):
            entries = written(long.join(done, "id", "left").withColumn("component", F.coalesce("component", "id")), "jaccard-entries")
            counted = entries.groupBy("h", "component").agg(F.count("*").alias("c"))
            largest = counted.groupBy("h").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
            # what a list's largest component has answered is not asked again
            left = written(entries.join(largest.select("h", "main").hint("merge"), "h").where("component <> main"), "jaccard-open").drop("main")
            if left.isEmpty():
                removed(left)
                removed(entries)
                break
            whole, entries = entries, entries.join(largest.select("h").hint("merge"), "h", "left_semi")
            more = self.linked(self._meets(left if most is None else self._centres(left, most), entries))
            if not more.isEmpty():
                done = self._joined(done, more)
            removed(left)
            removed(whole)
        return done

    def _joined(self, done: DataFrame, links: DataFrame) -> DataFrame:
        """Components after further links between members of different ones: only the components linked now are walked."""
        name = lambda k: done.select(F.col("id").alias(k), F.col("component").alias(f"of_{k}")).hint("merge")
        both = links.join(name("a"), "a", "left").join(name("b"), "b", "left")
        over = components(both.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))).withColumnRenamed("component", "now")
        kept = done.select(F.col("component").alias("id"), F.col("id").alias("member")).join(over.hint("merge"), "id", "full")
        return written(kept.select(F.coalesce("member", "id").alias("id"), F.coalesce("now", "id").alias("component")).distinct(), "jaccard-components")


def near_duplicates(docs: DataFrame, *, words: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs.

    Documents link when 100 * shared shingles >= percent * all shingles of both. Shingles are `words` consecutive words
    (runs of other than ASCII white space, A-Z lower-cased), or the whole sequence of a shorter text. component_id is
    the smallest doc_id that links reach. Null, empty or blank texts have no shingles and are alone, as are rows without
    doc_id (component null). Rows that repeat a doc_id are each judged by their own text, under that id. Other columns
    are ignored, whatever their names.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("tag"), "text")
    bits = counter_bits(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    scan = written(docs.mapInArrow(_scan(words, bits), "doc_id long, tag int, size long, digest binary, block int, counts binary"), "jaccard-scan")
    rows = scan.where("block is null").select("doc_id", "tag", "size", "digest")
    real = rows.where("size > 0 and doc_id is not null")
    first = written(real.groupBy("digest").agg(F.min("doc_id").alias("id")), "jaccard-first")
    copies = written(real.join(first.withColumnRenamed("id", "doc_id").hint("merge"), ["digest", "doc_id"], "left_anti").select("doc_id", "tag").distinct(), "jaccard-copies")
    classes = docs.sparkSession.sparkContext.broadcast(_classes(scan, bits))
    own = docs.where("doc_id is not null and text is not null")
    likely, single = maybe_in(own, copies, ["doc_id", "tag"])
    # texts are read in every round: the few that the bitmap leaves open are looked up once
    kept = written(likely.join(copies.hint("merge"), ["doc_id", "tag"], "left_anti").select("doc_id", "text"), "jaccard-kept")
    texts = single.select("doc_id", "text").unionByName(kept)
    prefixes = written(texts.mapInArrow(_prefixes(classes, words, percent), "h long, id long, size int, place int, mark array<long>"), "jaccard-prefix")
    swept(docs.sparkSession)
    marks, listed = prefixes.where("place = 0").select("id", "size", "mark"), prefixes.where("place > 0").drop("mark")
    shared = written(listed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "jaccard-shared")
    swept(docs.sparkSession)
    # most shingles are in one prefix alone: their rows are left where they are
    index = maybe_in(listed, shared, ["h"])[0].join(shared.hint("merge"), "h").withColumn("front", F.col("place") <= _front(F.col("size"), percent)).join(marks.distinct().hint("merge"), ["id", "size"])
    per_set = Window.partitionBy("id")
    index = written(index.withColumns({"kept": F.count("*").over(per_set), "long_lists": F.count_if(F.col("n") > LONG_LIST).over(per_set)}), "jaccard-index")
    removed(shared)
    del shared, marks, listed
    removed(prefixes)
    swept(docs.sparkSession)
    found = _Join(texts, words, percent).found(index)
    removed(index)
    removed(kept)
    named = first.join(found.hint("merge"), "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    alone = rows.where("size = 0 or doc_id is null").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return real.join(named.hint("merge"), "digest").select("doc_id", F.col("size").alias("n_shingles"), "component_id").unionByName(alone)


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs without those whose component holds a smaller doc_id; rows without doc_id stay.

    Rows that repeat a doc_id are one document: all of them stay, or all go where any of their texts is a near duplicate
    of a document with a smaller doc_id. Null, empty and blank texts stay.
    """
    gone = near_duplicates(docs, **options).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS o FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * o >= 85 * (na + nb - o)),
r AS (SELECT doc_id AS a, doc_id AS c FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.c = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id FROM s JOIN (SELECT a, min(c) AS component_id FROM r GROUP BY a) m ON s.doc_id = m.a
"""
