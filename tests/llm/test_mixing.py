import hashlib
import re
from fractions import Fraction

from pyspark.sql import functions as F

from trialframe.llm import mixing as M

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, source string"


def plain(rows, weights=M.WEIGHTS, most=M.MOST, fills=M.FILLS):
    """(target by source, taken by row) by sorting and adding up."""
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    of = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in sources}
    w = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    target, free, left = {}, set(sources), Fraction(sum(size))
    while free:
        unit = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * unit > most * of[s]}
        if not over:
            target |= {s: w[s] * unit for s in free}
            break
        target |= {s: Fraction(most * of[s]) for s in over}
        left -= sum(target[s] for s in over)
        free -= over
    key = [hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest()[:15] for i, t, _ in rows]
    taken = [0] * len(rows)
    for s in sources:
        if not of[s]:
            continue
        whole, rest = divmod(int(target[s]), of[s])
        mine = sorted((k, i) for i, k in enumerate(key) if rows[i][2] == s and size[i])
        more, low = set(), ""
        for _ in range(fills + 1):
            fits = [(k, i) for k, i in mine if k > low and size[i] <= rest]
            done = True
            for k in sorted({k for k, _ in fits}):
                peers = [i for q, i in fits if q == k]
                if sum(size[i] for i in peers) > sum_left(rest, fits, k, size):
                    low, done = k, False
                    break
            took = {i for k, i in fits if done or k < low}
            more |= took
            rest -= sum(size[i] for i in took)
            if done or rest == 0:
                break
        left = {}
        for k, i in mine:
            if i not in more and size[i] < 2 * rest:
                left[k] = left.get(k, 0) + size[i]
        near = min(((n, k) for k, n in left.items() if n < 2 * rest), default=None)
        more |= {i for k, i in mine if near and k == near[1] and i not in more}
        for _, i in mine:
            taken[i] = size[i] * (whole + (i in more))
    return target, size, of, taken


def sum_left(rest, fits, k, size):
    return rest - sum(size[i] for q, i in fits if q < k)


def mix(spark, rows):
    sized = M.sizes(spark.createDataFrame(rows, SCHEMA))
    plan = M.planned(sized).withColumnRenamed("source", "of")
    out = sized.join(plan, F.col("source").eqNullSafe(F.col("of"))).select("id", "source", "size", "target", (F.col("size") * M.copies(F.col("key"), F.col("size"), {c: F.col(c) for c in M.PLAN})).alias("taken"))
    return sorted(map(tuple, out.collect()), key=repr)


def held(rows):
    target, size, _, taken = plain(rows)
    return sorted(((r[0], r[2], n, float(target[r[2]]), t) for r, n, t in zip(rows, size, taken, strict=True)), key=repr)


def test_equals_sorting_and_adding_up(spark):
    # A hot source, one with a third of its words in one document, small ones, null and empty ones, repeats and ties.
    rows = [(i, "w " * (1 + i * 7919 % 60), f"s{0 if i % 3 else i % 5}") for i in range(400)]
    rows += [(1000, "x " * 4000, "s2"), (1001, None, "s1"), (1002, "", None), (1003, "a\x0bb\x1cc d", None), (None, "e f", ""), (7, "again", "s4"), (7, "again", "s4")]
    rows += [(2000 + i, "one two three", "u") for i in range(9)] + [(3000, None, "v")]
    assert mix(spark, rows) == held(rows)


def test_taken_words_come_near_the_targets(spark):
    rows = [(i, "w " * (1 + i * 7919 % 300), f"s{i % 4}") for i in range(1200)]
    got = mix(spark, rows)
    for s in {r[1] for r in got}:
        target = next(r[3] for r in got if r[1] == s)
        assert abs(target - sum(r[4] for r in got if r[1] == s)) <= 0.005 * target
    assert all(t <= M.MOST * n and t % n == 0 for _, _, n, _, t in got)
    assert sum({r[1]: r[3] for r in got}.values()) == sum(r[2] for r in got)


def test_equal_rows_stay_together_and_do_not_block(spark):
    rows = [(5, "tie " * 40, "a")] * 30 + [(i, "w " * 5, "a") for i in range(100, 160)] + [(i, "w " * 900, "b") for i in range(5)]
    got = mix(spark, rows)
    assert got == held(rows)
    assert len({t for i, *_, t in got if i == 5}) == 1


def test_no_rows_no_words(spark):
    assert mix(spark, []) == []
    assert mix(spark, [(1, None, None), (2, " \t", "a")]) == [(1, None, 0, 0.0, 0), (2, "a", 0, 0.0, 0)]


def test_other_columns_pass_and_clash(spark):
    rows = [(i, "w " * (i % 9), f"s{i % 3}", i, i, i, i) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA + ", of int, key int, size int, `a.b` int")
    out = M.mixed(df)
    assert out.columns == [*df.columns, "copies"]
    got = {r.doc_id: r.copies * (r.doc_id % 9) for r in out.collect()}
    _, _, _, taken = plain([r[:3] for r in rows])
    assert got == {r[0]: t for r, t in zip(rows, taken, strict=True)}
    assert [r.of for r in out.orderBy("doc_id").collect()] == list(range(60))


def test_no_python_on_the_way(spark):
    sized = M.sizes(spark.createDataFrame([(1, "a b", "x"), (2, "c", None)], SCHEMA))
    plan = M.planned(sized).withColumnRenamed("source", "of")
    out = sized.join(plan, F.col("source").eqNullSafe(F.col("of"))).select(M.copies(F.col("key"), F.col("size"), {c: F.col(c) for c in M.PLAN}))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
