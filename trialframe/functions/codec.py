"""Tagged and binary values: canonical JSON, provider results, PCM samples, interval texts."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_json(**fields: Column) -> Column:
    """A JSON object of the fields in the order of their names, nulls included."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def provider_result(body: Column) -> Column:
    """(custom_id, status, content, error) of a provider's result line: succeeded, errored, canceled or expired."""
    schema = "custom_id string, result struct<type:string,message:struct<content:array<struct<type:string,text:string>>>,error:struct<message:string>>"
    r = F.from_json(body, schema)
    kind = r["result"]["type"]
    text = F.array_join(F.transform(F.filter(r["result"]["message"]["content"], lambda c: c["type"] == "text"), lambda c: c["text"]), "")
    status = F.when(kind == "succeeded", "completed").when(kind == "errored", "failed").when(kind == "canceled", "canceled").when(kind == "expired", "expired")
    return F.struct(r["custom_id"].alias("custom_id"), status.alias("status"), F.when(kind == "succeeded", text).alias("content"), r["result"]["error"]["message"].alias("error"))


@F.arrow_udf(T.ArrayType(T.FloatType()))
def f32_from_s16(raw: pa.Array) -> pa.Array:
    """Little-endian 16-bit samples as numbers from -1 to 1; an odd last byte is left out. One view per batch."""
    held = raw.cast(pa.large_binary())
    offs = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
    size = np.diff(offs)
    data = np.frombuffer(held.buffers()[2], np.uint8)[offs[0] : offs[-1]] if held.buffers()[2] is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    keep = np.ones(len(data), bool)
    keep[(offs[1:] - offs[0] - 1)[size % 2 == 1]] = False
    samples = data[keep].view("<i2").astype(np.float32) / np.float32(32768)
    ends = np.r_[0, np.cumsum(size // 2)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(samples), mask=held.is_null())


@F.arrow_udf(T.ArrayType(T.StringType()))
def json_objects(texts: pa.Array) -> pa.Array:
    """Every top-level JSON object inside each text, in order, keys sorted; braces that do not open one are passed over."""
    decoder, out = json.JSONDecoder(), []
    for text in texts.to_pylist():
        found, at = [], 0
        while text and (at := text.find("{", at)) >= 0:
            try:
                value, at = decoder.raw_decode(text, at)
            except (ValueError, RecursionError):
                at += 1
                continue
            found.append(json.dumps(value, sort_keys=True, separators=(",", ":")))
        out.append(found)
    return pa.array(out, pa.list_(pa.string()))


def seconds(ms: Column) -> Column:
    return ms / F.lit(1000.0)


def clip_duration(segments: Column, words: Column | None = None) -> Column:
    """The end of the last segment, without segments that of the last word, 0 without any."""
    last = lambda xs: F.array_max(F.transform(xs, lambda s: s["end"]))
    return F.coalesce(last(segments), *([] if words is None else [last(words)]), F.lit(0.0))
