"""Text expressions: Unicode white space, chunks within a token budget, term ranking, prompts and model replies."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPACE = r"(?U)[\s\x{FEFF}]"
CHARS_PER_TOKEN = 4


def trimmed(c: Column) -> Column:
    """Without Unicode white space and byte-order marks at both ends."""
    return F.regexp_replace(c, rf"(?U)^[\s\x{{FEFF}}]+|[\s\x{{FEFF}}]+$", "")


def collapsed(c: Column) -> Column:
    """Every run of Unicode white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(c, SPACE + "+", " "))


def token_estimate(c: Column) -> Column:
    return F.ceil(F.length(c) / CHARS_PER_TOKEN).cast("long")


def _sliced(text: Column, most: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(most))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(most)))


def chunked(text: Column, max_tokens: int = 3000) -> Column:
    """array<string>: paragraphs (split at blank lines) packed into chunks of at most 4 * max_tokens characters.

    A text that fits is one chunk; a paragraph that doesn't is cut hard. Null, empty and blank texts have no chunks.
    """
    most = max_tokens * CHARS_PER_TOKEN
    whole = trimmed(text)
    paragraphs = F.filter(F.transform(F.split(whole, r"\n(?U)\s*\n"), trimmed), lambda p: p != "")
    empty = F.array().cast("array<string>")

    def step(acc: Column, p: Column) -> Column:
        fits = F.length(acc["open"]) + F.length(p) + 2 <= most
        closed = F.when(acc["open"] != "", F.array_append(acc["done"], acc["open"])).otherwise(acc["done"])
        huge = F.length(p) > most
        done = F.when(fits, acc["done"]).when(huge, F.concat(closed, _sliced(p, most))).otherwise(closed)
        joined = F.when(acc["open"] == "", p).otherwise(F.concat(acc["open"], F.lit("\n\n"), p))
        return F.struct(done.alias("done"), F.when(fits, joined).when(huge, F.lit("")).otherwise(p).alias("open"))

    start = F.struct(empty.alias("done"), F.lit("").alias("open"))
    end = lambda acc: F.when(acc["open"] != "", F.array_append(acc["done"], acc["open"])).otherwise(acc["done"])
    packed = F.aggregate(paragraphs, start, step, end)
    return F.when(F.coalesce(whole, F.lit("")) == "", empty).when(F.length(whole) <= most, F.array(whole)).otherwise(packed)


def query_terms(query: Column) -> Column:
    """Distinct lower-cased ASCII words of more than two characters."""
    return F.array_distinct(F.filter(F.split(F.lower(query), r"\W+"), lambda t: F.length(t) > 2))


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a non-empty term."""
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("long")


def term_score(text: Column, terms: Column) -> Column:
    """Sum over terms of occurrences * (1 + length / 10)."""
    low = F.lower(text)
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + occurrences(low, t) * (F.lit(1.0) + F.length(t) * F.lit(0.1)))


def chunk_rows(df: DataFrame, key: str, text: str, max_tokens: int = 3000) -> DataFrame:
    """(key, chunk_idx, chunk) rows."""
    return df.select(key, F.posexplode(chunked(F.col(text), max_tokens)).alias("chunk_idx", "chunk"))


def ranked_chunks(chunks: DataFrame, key: str, query: Column, top_k: int = 3) -> DataFrame:
    """The top_k chunks of each key with their rank and score.

    No more than top_k chunks stay in their order, unranked; a query without terms takes the first top_k. Ties go to
    the earlier chunk.
    """
    per_key = Window.partitionBy(key)
    scored = chunks.withColumns({"_terms": query_terms(query), "_n": F.count("*").over(per_key)})
    plain = (F.col("_n") <= top_k) | (F.size("_terms") == 0)
    scored = scored.withColumn("score", F.when(plain, F.lit(0.0)).otherwise(term_score(F.col("chunk"), F.col("_terms"))))
    best = per_key.orderBy(F.desc("score"), "chunk_idx")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k).drop("_terms", "_n")


def within_budget(chunks: DataFrame, key: str, order: list, budget: int, headroom: int = 0) -> DataFrame:
    """Chunks in the given order as long as their running token estimate stays within budget - headroom."""
    run = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("tokens_so_far", F.sum(token_estimate(F.col("chunk"))).over(run)).where(F.col("tokens_so_far") <= budget - headroom)


def bm25(chunks: DataFrame, doc: str, text: str, terms: DataFrame, *, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc, score): BM25 of documents for terms (query_id, term), over words in lower case.

    idf is ln(1 + (N - df + 0.5) / (df + 0.5)). Only words that are terms are counted and shuffled.
    """
    words = chunks.select(doc, F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != "").alias("_w")).withColumn("_len", F.size("_w"))
    total = words.agg(F.count("*").alias("_N"), F.avg("_len").alias("_avg"))
    wanted = terms.select("term").distinct()
    tf = words.select(doc, "_len", F.explode("_w").alias("term")).join(wanted, "term", "left_semi").groupBy(doc, "term").agg(F.count("*").alias("_tf"), F.first("_len").alias("_len"))
    df = tf.groupBy("term").agg(F.count("*").alias("_df"))
    one = tf.join(df, "term").join(F.broadcast(total))  # one row
    weight = F.log(1 + (F.col("_N") - F.col("_df") + 0.5) / (F.col("_df") + 0.5)) * F.col("_tf") * (k1 + 1) / (F.col("_tf") + k1 * (1 - b + b * F.col("_len") / F.col("_avg")))
    return one.withColumn("_s", weight).join(terms, "term").groupBy("query_id", doc).agg(F.sum("_s").alias("score"))


def field_terms(fields: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(query_id, term) rows for bm25: the words of each field's name and of its synonyms, each once a field."""
    words = {f: dict.fromkeys(w for name in (f, *others) for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w) for f, others in fields.items()}
    return [(f, w) for f, own in words.items() for w in own]


def structural_chunks(markdown: Column, max_chars: int = 12_000, overlap: int = 0) -> Column:
    """array<string>: the blocks of Markdown (split at blank lines) packed into chunks of at most max_chars characters.

    A heading always opens a chunk. Other chunks open with the last `overlap` characters of the one before, beyond
    max_chars. Tables and lists are never split, however long; other blocks too long for a chunk are cut hard, without
    overlap. Null and blank texts have no chunks.
    """
    blocks = F.filter(F.split(trimmed(markdown), r"\n(?U)\s*\n"), lambda x: trimmed(x) != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("tail"), F.lit("").alias("open"))

    def closed(acc: Column) -> Column:
        return F.when(acc["open"] != "", F.array_append(acc["done"], F.concat(acc["tail"], acc["open"]))).otherwise(acc["done"])

    def step(acc: Column, x: Column) -> Column:
        heading, whole = F.rlike(x, F.lit(r"^#{1,6}\s")), F.rlike(x, F.lit(r"^\s*(\||[-*+]\s|[0-9]+[.)]\s)"))
        fits = ~heading & (acc["open"] != "") & (F.length(acc["open"]) + F.length(x) + 2 <= max_chars)
        cut = ~whole & (F.length(x) > max_chars)
        last = F.right(acc["open"], F.lit(overlap)) if overlap else F.lit("")
        tail = F.when(heading | (last == ""), F.lit("")).otherwise(F.concat(last, F.lit("\n\n")))
        done = F.when(fits, acc["done"]).when(cut, F.concat(closed(acc), _sliced(x, max_chars))).otherwise(closed(acc))
        opened = F.when(fits, F.concat(acc["open"], F.lit("\n\n"), x)).when(cut, F.lit("")).otherwise(x)
        return F.struct(done.alias("done"), F.when(fits, acc["tail"]).when(cut, F.lit("")).otherwise(tail).alias("tail"), opened.alias("open"))

    return F.coalesce(F.aggregate(blocks, start, step, closed), F.array().cast("array<string>"))


def context(chunks: Column) -> Column:
    return F.array_join(chunks, "\n\n---\n\n")


def system_prompt(fields: dict[str, str] | None = None) -> str:
    text = "You extract structured data from web pages. Reply with one valid JSON object and nothing else."
    return text + ("\n\nRequired JSON keys and types:\n" + "\n".join(f"- {k}: {v}" for k, v in fields.items()) if fields else "")


def user_prompt(instruction: Column, content: Column) -> Column:
    return F.concat(F.lit("Instruction: "), instruction, F.lit("\n\nWebpage Content:\n"), content)


def reply_json(raw: Column) -> Column:
    """A model's reply as JSON text of one object, null if there is none.

    A code fence around it goes. An object stays; any other JSON value becomes {"data": value}; text that is no JSON
    gives what lies from its first { to its last }, if that is an object.
    """
    text = trimmed(raw)
    bare = F.when(F.startswith(text, F.lit("```")), trimmed(F.regexp_replace(F.regexp_replace(text, r"^```(?:json)?\s*", ""), r"\s*```$", ""))).otherwise(text)
    whole = F.try_parse_json(bare)
    inner = F.try_parse_json(F.regexp_extract(bare, r"(?s)\{.*\}", 0))
    is_object = lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    wrapped = F.concat(F.lit('{"data":'), F.to_json(whole), F.lit("}"))
    return F.when(whole.isNotNull(), F.when(is_object(whole), F.to_json(whole)).otherwise(wrapped)).when(inner.isNotNull() & is_object(inner), F.to_json(inner))


def redacted(c: Column) -> Column:
    """API keys and bearer tokens masked."""
    return F.regexp_replace(F.regexp_replace(c, r"(?i)(bearer\s+)[A-Za-z0-9._~+/=-]+", "$1***"), r"(?i)((?:api[_-]?key|x-api-key|key)[=:]\s*)[A-Za-z0-9._-]+", "$1***")
