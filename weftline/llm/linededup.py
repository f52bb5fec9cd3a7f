"""Line dedup over levelled sorted runs of line hashes, in DataFrame operations only.

Documents come in batches, those of the largest doc_ids first. A run holds line keys in buckets sorted by key, so that
joins between a batch's keys and the runs move no run. Each batch's keys are merge-joined with the runs: those that no
run has (the anti-join) are new, and their largest doc_id in the batch is the one that keeps the line; the others only
add to the number of documents. The batch's rows become a run of level 0. When a level holds `fanout` runs, they are
merged into one run of the next level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.store import bucketed, removed, unused, written

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else; the quick function does where all is ASCII."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


class LineRuns:
    """Runs of (key, n_docs, keeper), a row a key in each. The run that saw a key first has its keeper, later ones null."""

    def __init__(self, spark, fanout: int = 2):
        self.fanout, self.levels = fanout, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, keys: DataFrame) -> None:
        """keys: (key, n_docs, keeper) of a batch whose documents no earlier batch held, and all of whose doc_ids are smaller."""
        for n, run in enumerate(self.runs()):
            keys = keys.join(run.select("key", F.lit(True).alias(f"known{n}")).hint("merge"), "key", "left")
        known = [F.col(c).isNotNull() for c in keys.columns if c.startswith("known")]
        new = ~F.greatest(F.lit(False), F.lit(False), *known)
        self._put(self._run(keys.select("key", "n_docs", F.when(new, F.col("keeper")).alias("keeper"))), 0)

    def _run(self, df: DataFrame) -> DataFrame:
        return bucketed(df, "run", "key", self.buckets)

    def _put(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._put(self._run(self._merged(old)), level + 1)
            for x in old:
                removed(x)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """One run of several by merge joins; a key's counts add up, and one run at most has its keeper."""
        out = runs[0]
        for run in runs[1:]:
            other = run.select("key", F.col("n_docs").alias("n"), F.col("keeper").alias("k")).hint("merge")
            out = out.join(other, "key", "full").select("key", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n_docs"), F.coalesce("keeper", "k").alias("keeper"))
        return out

    def totals(self) -> DataFrame:
        """(key, n_docs, keeper) over all that was added, one row a key."""
        return self._merged(self.runs())


def dropped_lines(docs: DataFrame, *, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 2) -> DataFrame:
    """(doc_id, text_hash, dropped): places of the lines to drop, for documents that lose any."""
    docs = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or [] if batches > 1 else []
    batch = sum((F.when(F.col("doc_id") <= F.lit(c), 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    lines = docs.select("doc_id", batch.alias("batch"), F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    keyed = lines.select("doc_id", "batch", "text_hash", "line_no", line_key(F.col("line")).alias("line_key")).where(F.length("line_key") >= min_chars)
    held = written(keyed.select("doc_id", "text_hash", "line_no", F.unhex(F.md5("line_key")).alias("key"), "batch"), "lines", "batch")
    runs = LineRuns(docs.sparkSession, fanout)
    for at in range(len(set(cuts)) + 1):
        own = held.where(F.col("batch") == at).select("key", "doc_id").distinct()
        runs.add(own.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")))
    common = runs.totals().where(F.col("n_docs") >= min_docs).select("key", "keeper")
    gone = held.join(common, "key").where(F.col("doc_id") < F.col("keeper"))
    return gone.groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("dropped"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """All columns of docs with text rebuilt from its kept lines, and n_lines, n_dropped beside them.

    A key (line stripped of ASCII white space, A-Z lower-cased) of at least min_chars code points that at least
    min_docs documents hold loses its lines in all of them but the one with the largest doc_id. Null or empty text is
    one empty line and becomes empty text. A row without doc_id keeps all lines and counts for no key. Rows that
    repeat a doc_id are one document to the counts; each row keeps its own lines. Columns named n_lines or n_dropped
    are replaced, all others stay whatever their names.
    """
    docs = docs.drop("n_lines", "n_dropped")
    gone = dropped_lines(docs.select("doc_id", "text"), **options)
    doc, digest, dropped, lines = (unused(docs, n) for n in ("doc", "digest", "dropped", "lines"))
    gone = gone.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(digest), F.col("dropped").alias(dropped))
    joined = docs.join(gone, (F.col("doc_id") == F.col(doc)) & (F.xxhash64("text") == F.col(digest)), "left")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped), lambda i: F.get(lines, i))
    text = F.when(F.col(dropped).isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n"))
    out = joined.withColumn(lines, F.split(F.coalesce("text", F.lit("")), "\n", -1))
    out = out.withColumns({"text": text, "n_lines": F.size(lines).cast("long"), "n_dropped": F.greatest(F.coalesce(F.size(dropped), F.lit(0)), F.lit(0)).cast("long")})
    return out.select(*docs.columns, "n_lines", "n_dropped")


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
c AS (SELECT key, max(doc_id) AS max_doc FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, c.max_doc IS NOT NULL AND k.doc_id < c.max_doc AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
