"""Calls to remote models as a table that grows: each request is named by its content and answered once.

A request's key is the hash of its body, so equal requests of any rows, runs or documents are one. A run writes down those
without a reply, once and by waves, and sends them wave by wave; a wave is a bounded number of requests, dealt to a fixed
number of tasks, and its attempts are appended as one commit. A run that is killed loses at most the wave it was in, and the next run sends only what
has no reply. Every attempt is logged, with what came back verbatim.

Defined cases: a null body is no request; of several replies to one key, as after two runs at once, the first by time and
number stays; a request that failed in all its attempts is tried again by the next run; keys that no table asks for any
more stay in the log and cost nothing; what another run answers after a run has begun is sent by both.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.replies import EXTRACTION_PRICE, delay, price, response_field, response_format
from ..functions.text import strip
from ..operators.relations import discard, shared_path

#: Requests of one commit, and tasks that send them at the same time.
WAVE, SENDERS = 20_000, 16
#: Attempts, and characters of replies, that a task hands on together.
ROWS, CHARS = 1000, 1 << 20
#: Attempts at a request.
ATTEMPTS = 5
#: What the log holds of each attempt.
LOG = (
    "key string, attempt int, at string, status string, latency_seconds double, body string, finish_reason string, input_tokens int, output_tokens int,"
    " reasoning_tokens int, error_type string, error_message string"
)


class Connector(Protocol):
    def send(self, body: str) -> str: ...


class HttpConnector:
    """Posts a body as JSON; any answer but a success is an error with the start of its text."""

    def __init__(self, url: str, headers: Callable[[], dict[str, str]] = dict, timeout: float = 180.0):
        self.url, self.headers, self.timeout = url, headers, timeout

    def send(self, body: str) -> str:
        request = urllib.request.Request(self.url, body.encode(), {"Content-Type": "application/json", **self.headers()}, method="POST")
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                return reply.read().decode()
        except urllib.error.HTTPError as e:
            kind = "rate limited" if e.code == 429 else "server error" if e.code >= 500 else "refused"
            raise RuntimeError(f"{kind} {e.code}: {e.read(500).decode(errors='replace')}") from e


def request_body(model: str, system: Column, user: Column, field: str | None = None, max_tokens: int = 180, reasoning: dict | None = None, fallbacks: bool | None = None) -> Column:
    """A chat request as JSON: two messages, no randomness, the strict schema of ``field``'s reply, a provider that must heed it all; null without a user's text."""
    provider = {"require_parameters": True} | ({} if fallbacks is None else {"allow_fallbacks": fallbacks})
    rest = {"temperature": 0, "max_tokens": max_tokens} | ({} if reasoning is None else {"reasoning": reasoning})
    rest |= ({} if field is None else {"response_format": response_format(field)}) | {"provider": provider}
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    head = F.to_json(F.struct(F.lit(model).alias("model"), F.array(message("system", system), message("user", user)).alias("messages")))
    # The rest is the same for all rows.
    return F.when(
        user.isNotNull(), F.concat(F.substring(head, F.lit(1), F.char_length(head) - 1), F.lit("," + json.dumps(rest, ensure_ascii=False)[1:]))
    )


def key_of(body: Column) -> Column:
    return F.sha2(body, 256)


def content_of(reply: str) -> tuple[str, str, dict]:
    """(text, finish reason, usage) of a chat reply; a ValueError where it holds no text. Text may come in parts."""
    found = json.loads(reply)
    choices = found.get("choices") or []
    if not choices:
        raise ValueError("no choices")
    content = (choices[0].get("message") or {}).get("content")
    if isinstance(content, list):
        content = "".join(x.get("text", "") for x in content if isinstance(x, dict) and x.get("type") == "text")
    if not isinstance(content, str) or not content.strip():
        raise ValueError("empty content")
    return content, choices[0].get("finish_reason") or "", found.get("usage") or {}


def _number(usage: dict, *names: str) -> int:
    for name in names:
        value = usage.get(name)
        if value:
            return int(value)
    return 0


def attempts(key: str, body: str, connector: Connector, most: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep) -> Iterator[tuple]:
    """The log's rows of one request: up to ``most`` attempts, the last one good or none."""
    for n in range(1, most + 1):
        at, began = datetime.now(UTC).isoformat(), time.perf_counter()
        reply = None
        try:
            reply = connector.send(body)
            content, finish, usage = content_of(reply)
            details = usage.get("completion_tokens_details") or {}
            tokens = (_number(usage, "prompt_tokens", "input_tokens"), _number(usage, "completion_tokens", "output_tokens"), _number(details, "reasoning_tokens") or _number(usage, "reasoning_tokens"))
            yield key, n, at, "success", round(time.perf_counter() - began, 4), reply, finish, *tokens, "", ""
            return
        except Exception as e:  # a connection's or model's failure of any kind
            yield key, n, at, "error", round(time.perf_counter() - began, 4), reply, "", 0, 0, 0, type(e).__name__, str(e)
            if n < most:
                wait(delay(n, random.random()))


def log(spark: SparkSession, store: str) -> DataFrame:
    """All attempts so far; none where nothing was sent yet."""
    try:
        return spark.read.schema(LOG).parquet(store)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LOG)


def replies(spark: SparkSession, store: str) -> DataFrame:
    """(key, body, ...) of each key's first good attempt."""
    good = log(spark, store).filter("status = 'success'")
    return good.groupBy("key").agg(F.min(F.struct("at", "attempt", *[c for c in good.columns if c not in ("key", "at", "attempt")])).alias("r")).select("key", "r.*")


def run(
    requests: DataFrame,
    store: str,
    connector: Callable[[], Connector],
    body: str = "body",
    most: int = ATTEMPTS,
    wave: int = WAVE,
    senders: int = SENDERS,
    wait: Callable[[float], None] = time.sleep,
) -> int:
    """Sends every request of ``requests`` that has no reply in ``store``; returns the waves it took.

    ``connector`` makes one connector a task. Waves are cut by the keys' hash, so a wave's size is ``wave`` in the mean.
    """
    spark = requests.sparkSession
    asked = requests.filter(F.col(body).isNotNull()).select(key_of(F.col(body)).alias("key"), F.col(body).alias("body")).dropDuplicates(["key"])

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = connector()
        columns = [c.split()[0] for c in LOG.split(", ")]
        rows, chars = [], 0
        for b in batches:
            for key, text in zip(b["key"], b["body"], strict=True):
                new = list(attempts(key, text, own, most, wait))
                rows.extend(new)
                chars += sum(len(r[columns.index("body")] or "") for r in new)
                if len(rows) >= ROWS or chars >= CHARS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, chars = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    done = log(spark, store).filter("status = 'success'").select("key").distinct()
    number = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    waves = -(-asked.select("key").distinct().join(done, "key", "left_anti").count() // wave)
    if not waves:
        return 0
    # Written once, as every wave would read all requests and the whole log otherwise.
    path = shared_path(spark)
    dealt = asked.join(done, "key", "left_anti").withColumn("wave", F.pmod(number, F.lit(waves)).cast("int"))
    try:
        dealt.repartition("wave", F.pmod(F.crc32("key"), F.lit(senders))).write.partitionBy("wave").option("compression", "zstd").parquet(path)
        written = spark.read.schema("key string, body string, wave int").parquet(path)
        for w in range(waves):
            mine = written.filter(F.col("wave") == w).select("key", "body").repartition(senders, "key")
            mine.mapInPandas(send, LOG).write.mode("append").parquet(store)
    finally:
        discard(spark, path)
    return waves


def answered(requests: DataFrame, store: str, body: str = "body", prices: tuple[float, float] = EXTRACTION_PRICE) -> DataFrame:
    """``requests`` with ``reply`` (the message's text), ``error``, tokens, dollars and ``attempts``; a request without a reply has its last error."""
    spark = requests.sparkSession
    every = log(spark, store)
    good = replies(spark, store).select("key", F.col("body").alias("_reply"), "finish_reason", "input_tokens", "output_tokens", "reasoning_tokens")
    tried = every.groupBy("key").agg(
        F.count(F.lit(1)).cast("int").alias("attempts"), F.max(F.struct("at", "attempt", F.concat_ws(": ", "error_type", "error_message").alias("e"))).alias("_last")
    )
    text = response_field(F.col("_reply"), "choices[0].message.content")
    parts = F.from_json(text, "array<struct<type:string,text:string>>")
    whole = F.when(text.startswith("[") & parts.isNotNull() & F.exists(parts, lambda p: p["type"] == "text"), F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "")).otherwise(text)
    rows = requests.withColumn("_key", key_of(F.col(body))).join(good.withColumnRenamed("key", "_key"), "_key", "left").join(tried.withColumnRenamed("key", "_key"), "_key", "left")
    error = F.when(F.col("_reply").isNotNull(), "").when(F.col("_last").isNull(), "not sent").otherwise(F.col("_last.e"))
    rows = rows.withColumns({"reply": whole, "error": error, "attempts": F.coalesce("attempts", F.lit(0)), "cost_usd": price(F.col("input_tokens"), F.col("output_tokens"), prices)})
    return rows.drop("_key", "_reply", "_last")


def blank_replies(answered: DataFrame) -> DataFrame:
    """Requests whose reply is missing or says nothing: the dead letters of a run."""
    return answered.filter(F.col("reply").isNull() | (strip(F.col("reply")) == ""))
