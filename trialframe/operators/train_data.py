"""Training examples from chat turns: prompts and completions, preference pairs, token masks, budgeted batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialframe.functions.expr import prefix_masked
from trialframe.operators.ranges import numbered, numeric_bucket
from trialframe.operators.split import batch_steps


def conversations(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, messages): the turns of each conversation in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content"))))
    return turns.groupBy(conv).agg(F.transform(rows, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def sft_examples(chats: DataFrame, messages: str = "messages") -> DataFrame:
    """chats with prompt, all messages but the last, and completion, the last; chats with one message have no prompt."""
    m = F.col(messages)
    return chats.withColumns({"prompt": F.slice(m, 1, F.size(m) - 1), "completion": F.element_at(m, -1)})


def preference_pairs(chats: DataFrame, conv: str, answer: str) -> DataFrame:
    """chats with rejected: the answer of the next chat in order.

    The next chat is looked up by its dense position, so no global ordered window is needed.
    """
    nxt = chats.select((F.col("position") - 1).alias("position"), F.col(answer).alias("rejected"))
    return chats.join(nxt, "position")


def dense_position(df: DataFrame, key: str) -> DataFrame:
    """df with position from 0 by a numeric key."""
    return numbered(df, [], numeric_bucket(df, key), [F.col(key)], "position").withColumn("position", F.col("position") - 1)


def completion_mask(prompt_tokens: Column, all_tokens: Column, weight: float = 1.0) -> dict[str, Column]:
    """Inputs, targets and weights of one example, targets one step ahead; prompt tokens weigh nothing."""
    n, cut = F.size(all_tokens), F.size(prompt_tokens)
    return {"inputs": F.slice(all_tokens, 1, n - 1), "targets": F.slice(all_tokens, 2, n - 1), "weights": F.slice(prefix_masked(n, cut, weight), 2, n - 1)}


def char_codes(text: Column) -> Column:
    """A stand-in tokenizer: the code of every character."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))


def packed_batches(df: DataFrame, by: list[str], order: str, chars: str, most_texts: int, most_chars: int) -> DataFrame:
    """(by, order, batch): greedy batches of consecutive rows within two budgets; a row over budget is alone.

    The running sum starts anew where a row does not fit, so it is an ordered fold: rows are dealt by group, sorted
    within the task, and streamed past the open batch's two counts. No task holds a group.
    """
    rows = df.select(*by, order, F.col(chars).cast("long").alias(chars))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != chars)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, size, batch = None, 0, 0, 0
        for b in batches:
            out = []
            for *own, c in zip(*(b.column(k).to_pylist() for k in (*range(len(by)), len(by) + 1)), strict=True):
                if own != key:
                    key, n, size, batch = own, 0, 0, 0
                c = c or 0
                if n and (n + 1 > most_texts or size + c > most_chars):
                    n, size, batch = 0, 0, batch + 1
                n, size = n + 1, size + c
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.int64())], names=[*by, order, "batch"])

    return rows.repartition(*by).sortWithinPartitions(*by, order).mapInArrow(fold, f"{kinds}, batch long")


def text_deltas(df: DataFrame, entity: str, order: str, text: str) -> DataFrame:
    """What each cumulative text adds to the one before; rows that add nothing are left out after the comparison."""
    before = F.coalesce(F.lag(text).over(Window.partitionBy(entity).orderBy(order)), F.lit(""))
    return df.withColumn("delta", F.trim(F.substring(F.col(text), F.length(before) + 1, F.length(F.col(text))))).where(F.col("delta") != "")


def fits(tokens: Column, most: int) -> Column:
    """True for examples of at most so many tokens."""
    return F.size(tokens) <= most


def interleaved(chosen: Column, rejected: Column) -> Column:
    """chosen and rejected of each pair in turn."""
    return F.flatten(F.zip_with(chosen, rejected, lambda a, b: F.array(a, b)))


def prepared(examples: DataFrame, key: str, tokens: list[str], most: int, size: int, steps: int, base_step: int = 0) -> tuple[DataFrame, int]:
    """The batches of a run from base_step on, of examples whose token arrays all fit, and how many did not.

    Fewer than one batch of examples that fit are refused. For pairs name both sides.
    """
    ok = F.lit(True)
    for t in tokens:
        ok = ok & fits(F.col(t), most)
    counts = examples.agg(F.count("*").alias("all"), F.count_if(ok).alias("left")).first()
    plan = batch_steps(examples.where(ok), F.col(key), size, steps)
    return plan.where(F.col("step") >= base_step), counts["all"] - counts["left"]


def step_metrics(df: DataFrame, step: str, loss: Column, margin: Column | None = None) -> DataFrame:
    """(step, loss[, margin, accuracy]): means by step; with margins those of preference training too."""
    more = [] if margin is None else [F.avg(margin).alias("margin"), F.avg((margin > 0).cast("double")).alias("accuracy")]
    return df.groupBy(step).agg(F.avg(loss).alias("loss"), *more)


#: Fixed value: rows of a data set that are rendered before it is trained on.
PREVIEW_ROWS = 16


def preview(examples: DataFrame, key: str, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows by key, to be looked at before a run; an empty data set is refused."""
    if examples.isEmpty():
        raise ValueError("the data set is empty")
    return examples.orderBy(key).limit(rows)


def preference_example(prompt: Column, chosen: Column, rejected: Column) -> Column:
    """Both sides of a preference as masked examples over tokens: the prompt weighs nothing, the answer all."""
    side = lambda answer: F.struct(*[c.alias(k) for k, c in completion_mask(prompt, F.concat(prompt, answer)).items()])
    return F.struct(side(chosen).alias("chosen"), side(rejected).alias("rejected"))
