"""Byte-level BPE encoding and decoding by overlapping chunks.

A long text is cut into overlapping chunks that are pre-tokenised in parallel. Neighbours are stitched at the first
boundary that both have in their overlap: what the pattern matches from a boundary on depends only on the text after
it, so there they resynchronise. The pieces between stitches are encoded, each match separately, and ids of a text are
put together in order. Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK = 32_768
OVERLAP = 512
LOOKAHEAD = 3
CACHED = 50_000
_codecs: dict[int, "Codec"] = {}


class Codec:
    """Pieces to ids and back; ids of frequent pieces are kept as little-endian bytes."""

    def __init__(self, ranks: bytes, pattern: str):
        table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.tokens = {rank: token for token, rank in table.items()}
        codec = self

        class Known(dict):
            def __missing__(self, piece):
                ids = np.array(codec.encoding.encode_ordinary(piece), "<u4").tobytes()
                if len(self) < CACHED:
                    self[piece] = ids
                return ids

        self.known = Known()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def boundaries(self, text: str) -> list[int]:
        """Ends of matches after which the text can be cut: the match's last character isn't white space."""
        return [m.end() for m in self.pattern.finditer(text) if not text[m.end() - 1].isspace()]


def _codec(held) -> Codec:
    ranks, pattern = held.value
    key = hash((ranks, pattern))
    if key not in _codecs:
        _codecs[key] = Codec(ranks, pattern)
    return _codecs[key]


def _mapped(held, column: str, out: str, work):
    """A mapInArrow function that replaces one column, a few hundred rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                k = part.schema.get_field_index(column)
                done = pa.array([work(codec, x) for x in part.column(k).to_pylist()], pa.binary())
                columns = [done if i == k else part.column(i) for i in range(part.num_columns)]
                yield pa.RecordBatch.from_arrays(columns, [out if i == k else n for i, n in enumerate(part.schema.names)])

    return run


def _edges(held, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held)
        for batch in batches:
            heads, tails = [], []
            for start, text, last in zip(*(batch.column(n).to_pylist() for n in ("start", "chunk", "last")), strict=True):
                found = codec.boundaries(text)
                heads.append([start + b for b in found if b < overlap] if start else [])
                tails.append([] if last else [start + b for b in found if chunk <= b <= len(text) - LOOKAHEAD])
            keep = [batch.column(n) for n in ("doc_id", "key", "k")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], ["doc_id", "key", "k", "heads", "tails"])

    return run


def _held(docs: DataFrame, ranks_path: str, pattern: str):
    with open(ranks_path, "rb") as f:  # on the driver; the file's bytes are what is broadcast
        return docs.sparkSession.sparkContext.broadcast((f.read(), pattern))


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids): the token ids of each whole text as little-endian unsigned 32-bit integers, one row a row of docs.

    No special tokens. Null or empty text has no ids. Null and repeated doc_ids are kept as they are. A text of which
    some neighbours never resynchronise in their overlap (a run of more than `overlap` characters without a boundary)
    is encoded in one piece.
    """
    held = _held(docs, ranks_path, pattern)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    to_ids = _mapped(held, "text", "ids", Codec.encode)
    short = docs.where(F.length("text") <= chunk + overlap).mapInArrow(to_ids, f"doc_id {kind}, ids binary")

    long = docs.where(F.length("text") > chunk + overlap).groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    long = long.select("doc_id", F.md5("text").alias("key"), "text", "copies", F.length("text").alias("n"))
    last = F.floor((F.col("n") - overlap - 1) / chunk).cast("int")
    chunks = long.select("doc_id", "key", "text", F.explode(F.sequence(F.lit(0), last)).alias("k"), last.alias("end"))
    chunks = chunks.select("doc_id", "key", "k", (F.col("k") * chunk).alias("start"), F.col("text").substr(F.col("k") * chunk + 1, F.lit(chunk + overlap)).alias("chunk"), (F.col("k") == F.col("end")).alias("last"))
    edges = chunks.repartition("key", "k").mapInArrow(_edges(held, chunk, overlap), f"doc_id {kind}, key string, k int, heads array<int>, tails array<int>")
    order = Window.partitionBy("doc_id", "key").orderBy("k")
    cuts = edges.withColumn("next", F.lead("heads").over(order)).where(F.col("next").isNotNull())
    cuts = cuts.select("doc_id", "key", F.array_min(F.array_intersect("tails", "next")).alias("cut"))
    cuts = cuts.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list("cut")).alias("cuts"), F.bool_and(F.col("cut").isNotNull()).alias("synced"))
    same = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.key") == F.col("c.key"))
    cut = long.alias("d").join(cuts.alias("c"), same, "left").select("d.*", F.when(F.col("c.synced"), F.col("c.cuts")).otherwise(F.array().cast("array<int>")).alias("cuts"))
    ends = F.concat(F.array(F.lit(0)), "cuts", F.array("n"))
    parts = cut.withColumn("ends", ends).select("doc_id", "key", "copies", "text", "ends", F.posexplode(F.slice("ends", 2, F.size("ends") - 1)).alias("k", "to"))
    parts = parts.select("doc_id", "key", "copies", "k", F.col("text").substr(F.get("ends", "k") + 1, F.col("to") - F.get("ends", "k")).alias("text"))
    coded = parts.repartition("key", "k").mapInArrow(to_ids, f"doc_id {kind}, key string, copies long, k int, ids binary")
    whole = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.hex("ids").alias("ids")))), lambda x: x["ids"]), ""))
    joined = coded.groupBy("doc_id", "key").agg(whole.alias("ids"), F.max("copies").alias("copies"))
    return short.unionByName(joined.select("doc_id", "ids", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy"))


def decode(coded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) to (doc_id, ids, decoded): the raw bytes that the ids stand for."""
    held = _held(coded, ranks_path, pattern)
    kind = coded.schema["doc_id"].dataType.simpleString()
    both = coded.select("doc_id", "ids", F.col("ids").alias("decoded"))
    return both.mapInArrow(_mapped(held, "decoded", "decoded", Codec.decode), f"doc_id {kind}, ids binary, decoded binary")


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    how = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    done = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), *how), *how)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
