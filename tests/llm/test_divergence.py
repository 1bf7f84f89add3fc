import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from trialframe.llm import divergence as D

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "lang string, source string, text string"
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, top=D.TOP_TERMS):
    docs, counts, groups = {}, {}, set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = Counter(TERM.findall((text or "").translate(LOWER)))
        docs.setdefault(lang, Counter()).update(terms.keys())
        counts.setdefault((lang, source), Counter()).update(terms)
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= D.LEAST_DOCS]
        mine = sorted(s for g, s in groups if g == lang)

        def share(c):
            total = sum(c[t] for t in kept)  # noqa: B023
            return {t: 1 + D.PARTS * (c[t] + 1) // (total + len(kept)) for t in kept}  # noqa: B023

        p = {s: share(counts[lang, s]) for s in mine}
        q = share(sum((counts[lang, s] for s in mine), Counter()))
        for s in mine:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in mine if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def found(spark, rows, schema=SCHEMA, **kw):
    return sorted(map(tuple, D.divergence(spark.createDataFrame(rows, schema), **kw).collect()))


def some(seed, n, sources, vocabulary):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(vocabulary)]
    return [(rng.choice(["en", "de"]), f"s{min(rng.randrange(sources), rng.randrange(sources))}", " ".join(words[int(len(words) * rng.random() ** 3)] for _ in range(rng.randrange(40)))) for _ in range(n)]


def test_equals_the_plain_sums(spark):
    rows = some(1, 400, 9, 300)
    assert found(spark, rows) == plain(rows)


def test_nulls_empty_groups_long_texts_ties_and_repeats(spark):
    rows = some(2, 60, 4, 30) + [(None, None, None), (None, "a", "x x x"), ("", "a", "X x"), ("", "b", "x É é"), ("", "b", "É é"), ("", "c", "é É")]
    rows += [("en", "empty", None), ("en", "s1", "long " * 50_000 + "Ünï-cöde 世界_界"), ("en", "s2", "long 世界"), ("en", "s2", "long 世界")] + [("fr", "one", "tie a b c")] * 3 + [("fr", "two", "tie c b a")] * 3
    rows += [("xx", "p", "only once"), ("xx", "q", "another")]
    got = found(spark, rows)
    assert got == plain(rows)
    assert {r for r in got if r[0] == "xx"} == {("xx", "p", "pair", "q", 0, 1), ("xx", "q", "pair", "p", 0, 1)}
    assert any(r[1] == "empty" and r[2] == "pair" for r in got)


def test_ranks_of_terms_are_cut_and_a_hot_group_is_whole(spark):
    rows = [("en", "hot", " ".join(f"{chr(97 + i % 26)}{chr(97 + j)}{chr(97 + k)}" for j in range(26) for k in range(1 + i % 20))) for i in range(90)] + some(3, 40, 5, 60)
    for top in (7, 200):
        assert found(spark, rows, top=top) == plain(rows, top)


def test_empty_table_and_other_columns(spark):
    assert found(spark, []) == []
    rows = [(*r, 1, 2, 3) for r in some(4, 50, 3, 20)]
    assert found(spark, rows, SCHEMA + ", n int, i int, term int") == plain([r[:3] for r in rows])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(1, 6), st.integers(1, 3)), min_size=1, max_size=6, unique_by=lambda x: x[0]), max_size=25))
def test_a_tree_corrects_each_pair_once(rows):
    share = lambda i, n: 7 + 13 * n + 5 * i
    rows = [sorted(r) for r in rows]
    times = Counter(map(tuple, rows))
    paths = sorted(times)
    want = Counter()
    for path in paths:
        for x, (i, n) in enumerate(path):
            for j, m in path[:x] + path[x + 1 :]:
                a, b, a0, b0 = share(i, n), share(j, m), share(i, 0), share(j, 0)
                want[i << 32 | j] += times[path] * ((a - b) ** 2 // b - (a - b0) ** 2 // b0 - (a0 - b) ** 2 // b + (a0 - b0) ** 2 // b0)
    flat = [x for p in paths for x in p]
    i, n = np.array([x for x, _ in flat], np.int64), np.array([x for _, x in flat], np.int64)
    key, value = D.tree_pairs(np.r_[0, np.cumsum([len(p) for p in paths])].astype(np.int64), i, n, share(i, n), share(i, 0), np.array([times[p] for p in paths], np.int64), np.zeros(len(paths), np.int64))
    assert {k: v for k, v in zip(key.tolist(), value.tolist(), strict=True) if v} == {k: v for k, v in want.items() if v}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="aBZ é世_{1 \n\x7f", max_size=20), max_size=6))
def test_terms_are_those_of_the_pattern(texts):
    got = [[] for _ in texts]
    for doc, code, terms in D.terms_of(pa.array(texts, pa.string())):
        held = terms.to_pylist()
        for k, c in zip(doc.tolist(), code.tolist(), strict=True):
            got[k].append(held[c])
    assert got == [TERM.findall((t or "").translate(LOWER)) for t in texts]
