"""Provider batches as event tables: expected and returned items, expiry, retries, dangling attempts."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What each provider calls the states of a batch.
BATCH_STATES = {
    "anthropic": {"in_progress": "running", "canceling": "running", "ended": "completed"},
    "openai": {
        "validating": "pending", "in_progress": "running", "finalizing": "running", "cancelling": "running", "completed": "completed",
        "failed": "failed", "cancelled": "failed", "expired": "expired",
    },
    "gemini": {
        "JOB_STATE_PENDING": "pending", "JOB_STATE_QUEUED": "pending", "JOB_STATE_RUNNING": "running", "JOB_STATE_SUCCEEDED": "completed",
        "JOB_STATE_FAILED": "failed", "JOB_STATE_CANCELLED": "failed", "JOB_STATE_EXPIRED": "expired",
    },
}
#: Characters of a token, where a body states its most output tokens, their default, and a batch's discount.
CHARS_PER_TOKEN = 4
MAX_TOKEN_KEYS = ("max_tokens", "max_output_tokens", "maxOutputTokens")
DEFAULT_MAX_TOKENS = 1024
BATCH_DISCOUNT = 0.5


def with_expired(expected: DataFrame, returned: DataFrame, key: str) -> DataFrame:
    """returned, and a row with status expired for each expected key that did not come back."""
    lost = expected.select(key).distinct().join(returned.select(key).distinct(), key, "left_anti").withColumn("status", F.lit("expired"))
    return returned.select(key, "status").unionByName(lost)


def resubmits(results: DataFrame, retried: DataFrame, key: str) -> DataFrame:
    """Expired keys that were not retried yet."""
    return results.where("status = 'expired'").select(key).distinct().join(retried.select(key).distinct(), key, "left_anti")


def dangling(events: DataFrame, file: str) -> DataFrame:
    """Files with an intent that was never submitted."""
    flags = events.groupBy(file).agg(F.max(F.col("event") == "intent").alias("intent"), F.max(F.col("event") == "submitted").alias("submitted"), F.count("*").alias("events"))
    return flags.where("intent and not submitted")


def batch_status(provider_status, mapping: dict[str, str]):
    """The common status of a provider's; an unknown one raises."""
    out = F.raise_error(F.concat(F.lit("unknown batch status "), provider_status)).cast("string")
    for theirs, ours in mapping.items():
        out = F.when(provider_status == theirs, F.lit(ours)).otherwise(out)
    return out


def provider_items(lines: DataFrame, provider: str, text: str) -> DataFrame:
    """(custom_id, body, status) of a provider's result lines; the body stays JSON text, null unless completed.

    openai: lines of an output or an error file. gemini: a line is a whole answer with many items.
    """
    get = lambda c, path: F.get_json_object(c, path)
    t = F.col(text)
    if provider == "anthropic":
        kind = get(t, "$.result.type")
        odd = F.raise_error(F.concat(F.lit("unknown result type "), F.coalesce(kind, F.lit("null")))).cast("string")
        status = F.when(kind == "succeeded", "completed").when(kind == "expired", "expired").when(kind.isin("errored", "canceled"), "failed").otherwise(odd)
        return lines.select(get(t, "$.custom_id").alias("custom_id"), F.when(kind == "succeeded", get(t, "$.result.message")).alias("body"), status.alias("status"))
    if provider == "openai":
        good, code = get(t, "$.response.status_code") == "200", get(t, "$.error.code")
        status = F.when(F.coalesce(good, F.lit(False)), "completed").when(F.coalesce(code == "batch_expired", F.lit(False)), "expired").otherwise("failed")
        return lines.select(get(t, "$.custom_id").alias("custom_id"), F.when(status == "completed", get(t, "$.response.body")).alias("body"), status.alias("status"))
    if provider == "gemini":
        items = F.from_json(get(t, "$.response.inlinedResponses.inlinedResponses"), "array<string>")
        x = lines.select(F.explode(items).alias("x"))
        body = get(F.col("x"), "$.response")
        return x.select(get(F.col("x"), "$.metadata.key").alias("custom_id"), body.alias("body"), F.when(body.isNotNull(), "completed").otherwise("failed").alias("status"))
    raise ValueError(f"provider must be one of {sorted(BATCH_STATES)}")


def _texts(value) -> int:
    if isinstance(value, str):
        return len(value)
    if isinstance(value, dict):
        return sum(map(_texts, value.values()))
    return sum(map(_texts, value)) if isinstance(value, list) else 0


@F.pandas_udf(T.LongType())
def text_chars(bodies: pd.Series) -> pd.Series:
    """Code points of all text values of a JSON body, at any depth; names of fields do not count."""
    return bodies.map(lambda b: 0 if b is None else _texts(json.loads(b)))


def request_tokens(body: Column) -> tuple[Column, Column]:
    """Estimated input tokens, and the most output tokens that the body allows."""
    most = F.coalesce(*[F.get_json_object(body, f"$.{k}").try_cast("long") for k in MAX_TOKEN_KEYS], F.lit(DEFAULT_MAX_TOKENS).cast("long"))
    return F.floor(text_chars(body) / CHARS_PER_TOKEN), most


def admitted_batch(requests: DataFrame, custom_id: str, usd: str, max_usd: float) -> DataFrame:
    """One row: requests, usd and refusal, the first reason why a batch may not be sent, else null."""
    if not (max_usd > 0 and max_usd < float("inf")):
        raise ValueError(f"max_usd must be finite and above 0, got {max_usd}")
    by_id = requests.groupBy(custom_id).agg(F.count("*").alias("n"), F.sum(usd).alias("usd"))
    out = by_id.agg(F.sum("n").alias("requests"), F.sum("usd").alias("usd"), F.count_if(F.col("n") > 1).alias("repeated"))
    first = by_id.where("n > 1").orderBy(custom_id).limit(20).agg(F.array_sort(F.collect_list(custom_id)).alias("ids"))
    out = out.crossJoin(F.broadcast(first))  # one row each
    refusal = F.when(F.col("repeated") > 0, F.concat(F.lit("duplicate ids: "), F.array_join("ids", ", "))).when(F.col("usd") > max_usd, "over max_usd")
    return out.select("requests", "usd", refusal.alias("refusal"))


def request_lines(requests: DataFrame, custom_id: str, body: str, endpoint: str = "/v1/chat/completions") -> DataFrame:
    """(value): a provider's input lines; the body is JSON text and goes in as it is."""
    head = F.to_json(F.struct(F.col(custom_id).alias("custom_id"), F.lit("POST").alias("method"), F.lit(endpoint).alias("url")))
    return requests.select(F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"body":'), F.col(body), F.lit("}")).alias("value"))
