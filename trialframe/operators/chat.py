"""Chat examples with a tokenizer: templates as column expressions, token ids and prompt boundaries in one pass."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What stands around each message's role and content, and what asks for the next answer."""

    before: str = "<|im_start|>"
    between: str = "\n"
    after: str = "<|im_end|>\n"
    answer: str = "<|im_start|>assistant\n"


def rendered(messages: Column, template: Template = Template(), ask: bool = False) -> Column:
    """The text of an array of (role, content); ask adds the head of an answer."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    one = lambda m: F.concat(F.lit(template.before), empty(m["role"]), F.lit(template.between), empty(m["content"]), F.lit(template.after))
    return F.concat(F.array_join(F.transform(messages, one), ""), F.lit(template.answer if ask else ""))


def boundary(full: np.ndarray, prompt: np.ndarray) -> int:
    """Tokens that both begin with."""
    n = min(len(full), len(prompt))
    other = np.flatnonzero(full[:n] != prompt[:n])
    return int(other[0]) if len(other) else n


def masked_examples(df: DataFrame, key: str, prompt: str, completion: str, tokenizer: str, template: Template = Template(), weight: float = 1.0) -> DataFrame:
    """(key, inputs, targets, weights, cut) of prompts and completions, both arrays of (role, content).

    tokenizer is the file of a tokenizer that all tasks can read; its special tokens in a text are ordinary text. The
    whole chat and its prompt with the head of the answer are encoded; tokens that both begin with weigh nothing, even
    where the tokenizer joins the end of the prompt with what follows. Targets are one step ahead. A null prompt or
    completion has no messages; an example of fewer than two tokens has no targets.
    """
    none = F.expr("cast(array() as array<struct<role:string,content:string>>)")
    p, c = F.coalesce(F.col(prompt), none), F.coalesce(F.col(completion), none)
    rows = df.select(F.col(key), rendered(F.concat(p, c), template).alias("full"), rendered(p, template, ask=True).alias("prompt"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        held = Tokenizer.from_file(tokenizer)
        held.encode_special_tokens = True
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                full, head = ([np.array(e.ids, np.int32) for e in held.encode_batch(part.column(k).to_pylist(), add_special_tokens=False)] for k in (1, 2))
                cut = np.array([boundary(f, h) for f, h in zip(full, head, strict=True)], np.int32)
                n = np.array([max(len(f) - 1, 0) for f in full], np.int32)
                offsets = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
                flat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int32)
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
                weights = np.where(place < np.repeat(cut, n), 0.0, weight).astype(np.float32)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (flat([f[:-1] for f in full]), flat([f[1:] for f in full]), weights)]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists, pa.array(cut)], names=[key, "inputs", "targets", "weights", "cut"])

    kind = df.schema[key].dataType.simpleString()
    return rows.mapInArrow(encode, f"`{key}` {kind}, inputs array<int>, targets array<int>, weights array<float>, cut int")
