"""Model extraction: providers, fallback chains, prompts for pages, usage and cost."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as tx


class ExtractionError(Exception):
    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


class AiProvider(ABC):
    """A model that completes a system and a user prompt; cloud tells whether text leaves the cluster."""

    name = "provider"
    cloud = True

    @abstractmethod
    def complete(self, system: str, user: str, json_mode: bool = True) -> str: ...


def _post(url: str, headers: dict, body: dict, timeout: float = 60) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return json.load(reply)
    except urllib.error.HTTPError as e:
        raise ExtractionError(f"status {e.code}", e.code) from None
    except (OSError, ValueError) as e:
        raise ExtractionError(type(e).__name__) from None


class HttpProvider(AiProvider):
    """Request and reply formats are plain functions, so they are tested without a network. Keys are never logged."""

    endpoint, default_model = "", ""

    def __init__(self, api_key: str, model: str | None = None, endpoint: str | None = None):
        self.api_key, self.model, self.endpoint = api_key, model or self.default_model, endpoint or self.endpoint

    def __repr__(self) -> str:
        return f"{type(self).__name__}({self.model!r}, api_key=***)"

    def request(self, system: str, user: str, json_mode: bool) -> tuple[str, dict, dict]:
        raise NotImplementedError

    def reply(self, body: dict) -> str:
        raise NotImplementedError

    def complete(self, system, user, json_mode=True):
        body = _post(*self.request(system, user, json_mode))
        try:
            return self.reply(body)
        except (KeyError, IndexError, TypeError):
            raise ExtractionError("empty reply") from None


class OpenAiProvider(HttpProvider):
    name, endpoint, default_model = "openai", "https://api.openai.com/v1/chat/completions", "gpt-4o-mini"

    def request(self, system, user, json_mode):
        body = {"model": self.model, "temperature": 0.1, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        return self.endpoint, {"Authorization": f"Bearer {self.api_key}"}, body | ({"response_format": {"type": "json_object"}} if json_mode else {})

    def reply(self, body):
        return body["choices"][0]["message"]["content"]


class AnthropicProvider(HttpProvider):
    name, endpoint, default_model = "anthropic", "https://api.anthropic.com/v1/messages", "claude-3-5-sonnet-latest"

    def request(self, system, user, json_mode):
        return self.endpoint, {"x-api-key": self.api_key, "anthropic-version": "2023-06-01"}, {"model": self.model, "max_tokens": 4096, "system": system, "messages": [{"role": "user", "content": user}]}

    def reply(self, body):
        return body["content"][0]["text"]


class GeminiProvider(HttpProvider):
    name, endpoint, default_model = "gemini", "https://generativelanguage.googleapis.com/v1beta/models", "gemini-1.5-flash"

    def request(self, system, user, json_mode):
        settings = {"temperature": 0.1} | ({"responseMimeType": "application/json"} if json_mode else {})
        body = {"systemInstruction": {"parts": [{"text": system}]}, "contents": [{"role": "user", "parts": [{"text": user}]}], "generationConfig": settings}
        return f"{self.endpoint}/{self.model}:generateContent?key={self.api_key}", {}, body

    def reply(self, body):
        return body["candidates"][0]["content"]["parts"][0]["text"]


@dataclass
class CustomProvider(AiProvider):
    """Any function of (system, user)."""

    call: Callable[[str, str], str]
    name: str = "custom"
    cloud: bool = False

    def complete(self, system, user, json_mode=True):
        return self.call(system, user)


class ProviderChain(AiProvider):
    """The first provider whose reply satisfies `valid`; cloud ones are passed over unless cloud egress is allowed.

    A 429 or a status of 500 and up is tried again, up to `retries` times; other failures go on to the next provider.
    A reply that isn't valid is asked for once more with its errors. A provider that failed `failures` times in a row
    is left out. Where all fail, the last reply there was is given, else ExtractionError.
    """

    name = "chain"

    def __init__(self, providers: list[AiProvider], *, valid: Callable[[str], list[str]] = lambda _: [], allow_cloud: bool = True, prefer_local: bool = False, retries: int = 1, failures: int = 3):
        self.providers = sorted(providers, key=lambda p: p.cloud) if prefer_local else list(providers)
        self.valid, self.allow_cloud, self.retries, self.failures = valid, allow_cloud, retries, failures
        self.failed: dict[str, int] = {}
        self.attempts: list[tuple[str, str]] = []  # the last ones

    def _try(self, p, system, user, json_mode):
        for again in range(self.retries + 1):
            try:
                reply = p.complete(system, user, json_mode)
                self.failed[p.name] = 0
                return reply
            except ExtractionError as e:
                self.attempts.append((p.name, f"failed {e.status or ''}".strip()))
                if again == self.retries or not (e.status == 429 or (e.status or 0) >= 500):
                    self.failed[p.name] = self.failed.get(p.name, 0) + 1
                    return None

    def complete(self, system, user, json_mode=True):
        partial = None
        del self.attempts[:-1000]
        for p in self.providers:
            if p.cloud and not self.allow_cloud or self.failed.get(p.name, 0) >= self.failures:
                self.attempts.append((p.name, "skipped"))
                continue
            reply = self._try(p, system, user, json_mode)
            if reply is not None and (errors := self.valid(reply)):
                partial = reply
                reply = self._try(p, system, f"{user}\n\nThe last reply was not valid: {'; '.join(errors)}", json_mode)
                if reply is not None and self.valid(reply):
                    self.attempts.append((p.name, "invalid"))
                    reply = None
            if reply is not None:
                self.attempts.append((p.name, "ok"))
                return reply
        if partial is None:
            raise ExtractionError("all providers failed")
        return partial


def contexts(pages: DataFrame, key: str, instruction: str, *, max_tokens: int = 3000, top_k: int = 3) -> DataFrame:
    """(key, context): the chunks of a page's Markdown (its text if that is empty) that answer the instruction best."""
    source = pages.select(key, F.when(F.coalesce("markdown", F.lit("")) != "", F.col("markdown")).otherwise(F.col("clean_text")).alias("_source"))
    best = tx.ranked_chunks(tx.chunk_rows(source, key, "_source", max_tokens), key, F.lit(instruction), top_k)
    listed = best.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "chunk"))).alias("_c"))
    return listed.select(key, tx.context(F.transform("_c", lambda c: c["chunk"])).alias("context"))


def extract_json(df: DataFrame, provider: AiProvider, instruction: str, fields: dict[str, str] | None = None, context: str = "context") -> DataFrame:
    """df with reply, ai_json (text of one object or null) and ai_error; a failed row never fails the job."""
    system = tx.system_prompt(fields)

    @F.pandas_udf("struct<reply:string,error:string>")
    def ask(users: pd.Series) -> pd.DataFrame:
        def one(user):
            try:
                return {"reply": provider.complete(system, user, True), "error": None}
            except ExtractionError as e:
                return {"reply": None, "error": str(e)}

        return pd.DataFrame([one(u) for u in users], columns=["reply", "error"])

    asked = df.withColumn("_a", ask.asNondeterministic()(tx.user_prompt(F.lit(instruction), F.coalesce(context, F.lit("")))))
    out = asked.withColumns({"reply": F.col("_a.reply"), "ai_error": F.col("_a.error")}).drop("_a").withColumn("ai_json", tx.reply_json(F.col("reply")))
    return out.withColumn("ai_error", F.coalesce("ai_error", F.when(F.col("ai_json").isNull(), F.lit("no JSON object in the reply"))))


def usage(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """(session, model, calls, tokens_in, tokens_out, cost) of calls (session, model, prompt, reply); prices are for a
    million tokens (model, price_in, price_out). Models without price cost null."""
    counted = calls.withColumns({"tin": tx.token_estimate(F.col("prompt")), "tout": tx.token_estimate(F.coalesce("reply", F.lit("")))})
    total = counted.groupBy("session", "model").agg(F.count("*").alias("calls"), F.sum("tin").alias("tokens_in"), F.sum("tout").alias("tokens_out"))
    return total.join(prices, "model", "left").withColumn("cost", (F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1e6).drop("price_in", "price_out")


def savings(calls: DataFrame, prices: DataFrame, from_cache: str = "from_cache") -> DataFrame:
    """(session, calls, saved_calls, cost, saved): what calls (session, model, prompt, reply, from_cache) cost, and what
    those answered from a cache would have cost. Models without price count as free."""
    paid = usage(calls.withColumn("session", F.struct("session", F.col(from_cache).alias("cached"))), prices)
    own = paid.select("session.session", "session.cached", "calls", F.coalesce("cost", F.lit(0.0)).alias("cost"))
    part = lambda c, cached: F.sum(F.when(F.col("cached") == cached, F.col(c)).otherwise(0))
    return own.groupBy("session").agg(F.sum("calls").alias("calls"), part("calls", True).alias("saved_calls"), part("cost", False).alias("cost"), part("cost", True).alias("saved"))


def merged_lists(parts: DataFrame, doc: str, items: str, key: str) -> DataFrame:
    """Map-reduce of list answers: items of all chunks of a document, the first of each key, in order of chunk and place."""
    from pyspark.sql.window import Window

    rows = parts.select(doc, "chunk_idx", F.posexplode(items).alias("place", "item"))
    first = Window.partitionBy(doc, F.col(f"item.{key}")).orderBy("chunk_idx", "place")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
