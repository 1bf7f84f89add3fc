"""Recognised tokens on pages: reconciliation of two readings, lines of a layout, agreement."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.functions import text as T
from trialframe.sources.shared import small_batches, stored

NEAR_X, NEAR_Y = 15.0, 10.0
#: Sides of the cells in which a batch of pages is searched: a little over the reach, so that near ones are neighbours after rounding.
CELL_X, CELL_Y = 16.0, 11.0
#: Pages with several rows that are broadcast.
BROADCAST_PAGES = 1_000_000
#: Side of a grid cell, in reaches.
CELL = 8


def centre(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column]:
    return x + w / 2, y + h / 2


def descaled(v: Column, scale: Column, offset: Column) -> Column:
    """A corner of an upscaled crop on its page, rounded half to even."""
    return F.bround(v / scale + offset, 0).cast("int")


def _cells(df: DataFrame, spread: bool) -> DataFrame:
    """The grid cell of each token's centre, or all cells that its reach touches (1.6 on average)."""
    cx, cy = centre(*(F.col(c) for c in ("x", "y", "w", "h")))
    held = df.withColumns({"cx": cx, "cy": cy})
    w, h = CELL * NEAR_X, CELL * NEAR_Y
    if not spread:
        return held.withColumns({"gx": F.floor(F.col("cx") / w), "gy": F.floor(F.col("cy") / h)})
    reach = lambda c, near, size: F.sequence(F.floor((c - near) / size), F.floor((c + near) / size))
    return held.withColumn("gx", F.explode(reach(F.col("cx"), NEAR_X, w))).withColumn("gy", F.explode(reach(F.col("cy"), NEAR_Y, h)))


def near_pairs(tokens: DataFrame, supplement: DataFrame, page: str, key: str) -> DataFrame:
    """Pairs of tokens whose centres lie near each other: an equi-join on grid cells, then the exact distance."""
    a = _cells(tokens, False).alias("a")
    b = _cells(supplement, True).alias("b")
    on = (F.col(f"a.{page}") == F.col(f"b.{page}")) & (F.col("a.gx") == F.col("b.gx")) & (F.col("a.gy") == F.col("b.gy"))
    near = (F.abs(F.col("a.cx") - F.col("b.cx")) < NEAR_X) & (F.abs(F.col("a.cy") - F.col("b.cy")) < NEAR_Y)
    cols = [F.col(f"a.{page}").alias(page), F.col(f"a.{key}").alias("token"), F.col(f"b.{key}").alias("other")]
    return a.join(b, on).where(near).select(*cols, F.col("a.text").alias("text"), F.col("b.text").alias("other_text"), F.col("a.confidence").alias("confidence"), F.col("b.confidence").alias("other_confidence"))


def reconciled(tokens: DataFrame, supplement: DataFrame, page: str, key: str) -> DataFrame:
    """Tokens, with half the least confidence among it and its near readings where any of these contradicts it, and what
    only the supplement has (tokens near none of the base).

    Base tokens meet the supplement, spread over the cells that its reach touches, in one join by grid cell; as a base
    token has one cell, its readings are folded without another shuffle. What the supplement adds is an anti-join the
    other way round, for which only the base's places are spread.
    """
    cell = [page, "gx", "gy"]
    a = _cells(tokens.withColumn("folded", T.normalized(F.col("text"))), False)
    b = _cells(supplement.select(page, "x", "y", "w", "h", F.col("confidence").alias("__c"), T.normalized(F.col("text")).alias("__f")), True)
    b = b.select(*cell, F.col("cx").alias("__x"), F.col("cy").alias("__y"), "__c", "__f")
    near = (F.abs(F.col("cx") - F.col("__x")) < NEAR_X) & (F.abs(F.col("cy") - F.col("__y")) < NEAR_Y)
    on = lambda left, right: [left[c] == right[c] for c in cell]
    met = a.join(b, [*on(a, b), near], "left").select(*[a[c] for c in (*cell, key, "text", "x", "y", "confidence", "folded")], "__c", "__f")
    met = met.groupBy(*cell, key, "text", "x", "y", "confidence").agg(F.min("__c").alias("least"), F.max(F.col("__f") != F.col("folded")).alias("differs"))
    clash = F.coalesce("differs", F.lit(False))
    cols = [page, key, "text", "x", "y"]
    kept = met.select(*cols, F.when(clash, F.least("confidence", "least") * 0.5).otherwise(F.col("confidence")).alias("confidence"), F.when(clash, "contradicted").otherwise("kept").alias("origin"))
    c = _cells(supplement, False)
    d = _cells(tokens.select(page, "x", "y", "w", "h"), True).select(*cell, F.col("cx").alias("__x"), F.col("cy").alias("__y"))
    added = c.join(d, [*on(c, d), near], "left_anti").select(*cols, "confidence", F.lit("added").alias("origin"))
    return kept.unionByName(added)


def _near(page_a: np.ndarray, a: np.ndarray, page_b: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in a and b (rows of x and y) that are of one page and near: cells of b in order, of which each of a looks at three runs of three."""
    cell = lambda v, size: np.clip(np.floor(v / size), -(2.0**52), 2.0**52)
    own = np.flatnonzero(np.isfinite(b).all(axis=0))
    bx, by = cell(b[0, own], CELL_X), cell(b[1, own], CELL_Y)
    xs, ys = np.unique(bx), np.unique(by)
    key = (page_b[own] * len(ys) + np.searchsorted(ys, by)) * len(xs) + np.searchsorted(xs, bx)
    order = np.argsort(key, kind="stable")
    key, own = key[order], own[order]
    mine = np.flatnonzero(np.isfinite(a).all(axis=0))
    ax, ay = cell(a[0, mine], CELL_X), cell(a[1, mine], CELL_Y)
    left, right = np.searchsorted(xs, ax - 1, "left"), np.searchsorted(xs, ax + 1, "right")
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for d in (-1, 0, 1) if len(own) else ():
        row = np.minimum(np.searchsorted(ys, ay + d), len(ys) - 1)
        first = (page_a[mine] * len(ys) + row) * len(xs)
        lo = np.searchsorted(key, first + left)
        n = np.where(ys[row] == ay + d, np.searchsorted(key, first + right) - lo, 0)
        i = np.repeat(mine, n)
        j = own[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        near = (np.abs(a[0, i] - b[0, j]) < NEAR_X) & (np.abs(a[1, i] - b[1, j]) < NEAR_Y)
        found.append((i[near], j[near]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def one_row_a_page(pages: DataFrame, page: str, *readings: str) -> DataFrame:
    """pages with the readings of a page in one row. Only pages that have several are shuffled."""
    again = stored(pages.groupBy(page).count().where(f"count > 1 and `{page}` is not null").select(page))
    n = again.count()
    if not n:
        return pages.select(page, *readings)
    few = F.broadcast(again) if n <= BROADCAST_PAGES else again
    whole = [F.flatten(F.collect_list(F.coalesce(r, F.array().cast(pages.schema[r].dataType)))).alias(r) for r in readings]
    return pages.join(few, page, "left_anti").select(page, *readings).unionByName(pages.join(few, page, "left_semi").groupBy(page).agg(*whole))


def reconciled_pages(pages: DataFrame, page: str, key: str, tokens: str = "tokens", supplement: str = "supplement", columns: tuple[str, ...] = ("text", "x", "y")) -> DataFrame:
    """`reconciled`, (page, columns, confidence, origin), of pages that have both readings in one row, as arrays of tokens.

    Nothing is shuffled: a page's tokens meet in its row, a batch of pages at a time, by cells sorted once. Tokens of
    one page and key are one. A page is what one task holds.
    """
    small_batches(pages.sparkSession)

    def side(name: str) -> Column:
        def held(t: Column) -> Column:
            cx, cy = centre(*(t[c].cast("double") for c in ("x", "y", "w", "h")))
            own = [t[c].alias(f"_{c}") for c in columns]
            return F.struct(t[key].alias("key"), T.normalized(t["text"]).alias("folded"), cx.alias("cx"), cy.alias("cy"), t["confidence"].cast("double").alias("confidence"), *own)

        return F.transform(name, held).alias(name)

    def numbered(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        code = pc.fill_null(pa.concat_arrays([a, b]).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        return code[: len(a)], code[len(a) :]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.columns[1:]
            at = [np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False)) for x in lists]
            a, b = (x.flatten() for x in lists)
            number = lambda t, c: t.field(c).to_numpy(zero_copy_only=False).astype(float)
            i, j = _near(at[0], np.stack([number(a, "cx"), number(a, "cy")]), at[1], np.stack([number(b, "cx"), number(b, "cy")]))
            folded, keys = (numbered(a.field(c), b.field(c)) for c in ("folded", "key"))
            most = max((int(k.max(initial=0)) for k in keys), default=0) + 2
            (_, ia), (_, ib) = (np.unique(p * most + k + 1, return_inverse=True) for p, k in zip(at, keys, strict=True))
            met, least = np.zeros(len(b), bool), np.full(len(a), np.inf)
            met[ib[j]] = True
            own, other = number(a, "confidence"), number(b, "confidence")
            np.minimum.at(least, ia[i], np.where(np.isnan(other), np.inf, other)[j])
            apart = (folded[0][i] != folded[1][j]) & (folded[0][i] >= 0) & (folded[1][j] >= 0)
            clash = np.bincount(ia[i][apart], minlength=len(a))[ia] > 0
            half = np.fmin(own, least[ia]) * 0.5
            added = np.flatnonzero(~met[ib])
            new = b.take(pa.array(added))
            both = lambda x, y: pa.concat_arrays([x, y])
            origin = pa.array(["kept", "contradicted", "added"]).take(pa.array(np.r_[clash.astype(np.int64), np.full(len(added), 2)]))
            weight = pc.if_else(pa.array(clash), pa.array(half, mask=~np.isfinite(half)), a.field("confidence"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.r_[at[0], at[1][added]])), *(both(a.field(f"_{c}"), new.field(f"_{c}")) for c in columns), both(weight, new.field("confidence")), origin],
                names=[page, *columns, "confidence", "origin"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema[tokens].dataType.elementType.fields}
    schema = ", ".join([f"`{page}` {pages.schema[page].dataType.simpleString()}", *(f"`{c}` {kinds[c]}" for c in columns), "confidence double, origin string"])
    return one_row_a_page(pages, page, tokens, supplement).select(page, side(tokens), side(supplement)).mapInArrow(match, schema)


def layout_lines(tokens: DataFrame, page: str, gap: float = 8.0) -> DataFrame:
    """(page, line, text): tokens by upper edge and left edge; a line goes on while centres lie within gap of its first.

    The open line's first token decides, not the neighbour, so this is an ordered fold over a page's tokens, inside the
    JVM: it keeps where lines begin; the texts are slices by left edge. A page is what one task holds.
    """
    token = F.struct(F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), (F.col("y") + F.col("h") / 2).cast("double").alias("middle"), F.coalesce("text", F.lit("")).alias("text"))
    pages = tokens.groupBy(page).agg(F.array_sort(F.collect_list(token)).alias("t"))
    start = F.struct(F.lit(None).cast("double").alias("first"), F.expr("cast(array() as array<int>)").alias("starts"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        new = s["first"].isNull() | (F.abs(x["middle"] - s["first"]) > gap)
        return F.struct(F.when(new, x["middle"]).otherwise(s["first"]).alias("first"), F.when(new, F.concat(s["starts"], F.array(s["n"]))).otherwise(s["starts"]).alias("starts"), (s["n"] + 1).alias("n"))

    held = pages.withColumn("starts", F.aggregate("t", start, step, lambda s: s["starts"]))

    def line(k: Column, i: Column) -> Column:
        own = F.slice("t", k + 1, F.coalesce(F.get("starts", i + 1), F.size("t")) - k)
        across = F.array_sort(F.transform(own, lambda x, j: F.struct(x["x"].alias("x"), j.alias("j"), x["text"].alias("text"))))
        return F.array_join(F.transform(across, lambda x: x["text"]), " ")

    return held.select(page, F.posexplode(F.transform("starts", line)).alias("line", "text"))


def ensemble(tokens: DataFrame, supplement: DataFrame, page: str, key: str, targeted: Column) -> DataFrame:
    """Tokens of whole-page readings reconciled with the supplement; targeted ones (of regions or enlarged) as they are."""
    whole, part = tokens.where(~targeted), tokens.where(targeted)
    pages = whole.select(page).distinct()
    both = reconciled(whole, supplement.join(pages, page, "left_semi"), page, key)
    return both.unionByName(part.withColumn("origin", F.lit("kept")).select(*both.columns))


def ensemble_pages(pages: DataFrame, page: str, key: str, targeted: Callable[[Column], Column], tokens: str = "tokens", supplement: str = "supplement", columns: tuple[str, ...] = ("text", "x", "y")) -> DataFrame:
    """`ensemble`, of pages that have both readings in one row, as arrays of tokens."""
    held = one_row_a_page(pages, page, tokens, supplement)
    whole = held.withColumn(tokens, F.filter(tokens, lambda t: ~targeted(t)))
    both = reconciled_pages(whole.withColumn(supplement, F.when(F.size(tokens) > 0, F.col(supplement))), page, key, tokens, supplement, columns)
    part = held.select(page, F.explode(F.filter(tokens, targeted)).alias("t"))
    return both.unionByName(part.select(page, *[F.col("t")[c].alias(c) for c in columns], F.col("t")["confidence"].cast("double").alias("confidence"), F.lit("kept").alias("origin")))
