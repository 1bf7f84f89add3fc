import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from trialframe.llm import decontaminate as D


def words(rng, n):
    return [rng.choice("abcdefgh") + rng.choice("aeiou") + str(rng.randrange(60)) for _ in range(n)]


def plain(items, docs):
    """(doc, item) -> largest similarity, over all windows, by the definition."""
    from collections import Counter
    from math import log

    sh = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    tok = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    own = {i: tok(t) for i, t in items if len(tok(t)) >= D.LEAST_WORDS}
    seen = Counter(s for w in own.values() for s in sh(w))
    n = max(1, len(own))
    weigh = lambda s, a: log(1 + n / seen[s]) if s in a else log(1 + n)
    out = {}
    for d, t in docs:
        w = tok(t)
        for i, x in own.items():
            a = sh(x)
            for k in range(max(1, len(w) - len(x) + 1)):
                b = sh(w[k : k + len(x)])
                if not a.keys() & b.keys():
                    continue
                both = sum(weigh(s, a) * min(a[s], b[s]) for s in a.keys() | b.keys())
                out[d, i] = max(out.get((d, i), 0), both / sum(weigh(s, a) * max(a[s], b[s]) for s in a.keys() | b.keys()))
    return {k: v for k, v in out.items() if v >= D.SIMILARITY}


def test_equals_brute_force(spark):
    rng = random.Random(8)
    items = [(i, " ".join(words(rng, rng.choice([9, 15, 22, 40, 70, 130, 200])))) for i in range(30)]
    items += [(90, None), (91, "too short"), (None, items[0][1]), (92, items[1][1])]
    docs = [(0, None), (1, ""), (2, "few words"), (3, items[2][1]), (4, items[3][1].upper().replace(" ", ", "))]
    for d in range(5, 60):
        w, body = items[rng.randrange(30)][1].split(), words(rng, rng.randrange(0, 300))
        if d % 2:
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = "edited"
            body[len(body) // 2 : len(body) // 2] = w
        docs.append((d, " ".join(body)))
    docs.append((60, " ".join(words(rng, 20_000)) + " " + items[5][1]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    hits = D.with_matches(df, bench).select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*").collect()
    got, want = {(r.doc_id, r.item_id): r.similarity for r in hits}, plain([x for x in items if x[0] is not None], docs)
    assert got.keys() <= want.keys() and len(hits) == len(got)
    assert all(abs(got[k] - want[k]) < 1e-9 or got[k] >= D.SIMILARITY for k in got)
    exact = {k for k, v in want.items() if v > 0.999}
    assert exact <= got.keys() and len(want.keys() - got.keys()) <= 0.02 * len(want)


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 2**64, 40, dtype=np.uint64)
    near = []
    for p in prints:
        for n in range(0, 15):
            bits = rng.choice(64, n, replace=False)
            near.append(np.bitwise_xor.reduce(np.r_[p, np.uint64(1) << bits.astype(np.uint64)]))
    near = np.array(near, np.uint64)
    win, who = D.SizeIndex(prints, np.arange(40), np.zeros(40)).search(near)
    want = {(i, j) for i, x in enumerate(near) for j, p in enumerate(prints) if np.bitwise_count(x ^ p) <= D.RADIUS}
    assert set(zip(win.tolist(), who.tolist(), strict=True)) == want


def test_edited_items_are_alike_in_any_number_of_blocks(spark):
    rng = random.Random(3)
    common = words(rng, 12)  # shared by all items: its weight depends on the whole benchmark
    items = [(i, " ".join(words(rng, 30) + common + words(rng, rng.randrange(20)))) for i in range(40)] + [(3, None), (41, "short")]
    docs = []
    for i, t in items[:40]:
        w = t.split()
        w[rng.choice([0, 1, 2, 28, 40])] = "edited"
        docs.append((i, " ".join(words(rng, 9) + w + words(rng, 5)), i % 3))
    docs += [(50, None, 1), (50, docs[0][1], 1), (None, docs[1][1], 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")

    def hits(block):
        out = D.with_matches(df, bench, block_windows=block)
        assert out.columns == ["doc_id", "text", "item_id", "matches"]
        return sorted(((r.doc_id or -1, r.item_id, [(m.item_id, round(m.similarity, 9), m.start_word) for m in r.matches]) for r in out.collect()))

    one = hits(D.BLOCK_WINDOWS)
    assert hits(25) == one
    assert sum(len(r[2]) for r in one) >= 30
    want = plain([x for x in items if x[1]], [(k, d[1]) for k, d in enumerate(docs)])
    assert len(want) == sum(len(r[2]) for r in one)


def test_recall_of_edited_copies():
    """Copies with edits at a similarity of 0.8 or more, for every length of an item."""
    rng = random.Random(11)
    found, all_, rare = 0, 0, 1.0
    for n in list(range(8, 60)) * 4 + list(range(60, 200, 7)) * 4:
        item = words(rng, n)
        copy = list(item)
        for _ in range(rng.randrange(1, max(2, n // 25))):
            at = rng.randrange(n) if n > 45 else rng.choice([0, 1, n - 2, n - 1])
            copy[at : at + rng.randrange(2)] = ["edited"]
        h = lambda w: D.words_of(np.frombuffer(" ".join(w).encode(), np.uint8), np.array([0, len(" ".join(w))]))[0]
        index = D.Benchmark([1], [h(item)], [{s: 1.0 for s in D.shingles(h(item))}], rare)
        text = words(rng, 30) + copy + words(rng, 30)
        starts = range(25, 35)
        if max(index.similarity(0, h(text[k : k + n])) for k in starts) < D.SIMILARITY:
            continue
        all_ += 1
        found += bool(index.scan(pa.array([" ".join(text)]))[0])
    assert all_ > 100 and found >= 0.98 * all_, (found, all_)


def test_empty_tables(spark):
    df = spark.createDataFrame([(i, "some words that are long enough to be an item", 5) for i in range(3)], "doc_id long, text string, item_id int")
    bench = df.select(F.col("doc_id").alias("item_id"), "text")
    assert D.with_matches(df, bench.limit(0)).where(F.size("matches") > 0).count() == 0
    assert D.with_matches(df.limit(0), bench).count() == 0
    assert [len(r.matches) for r in D.with_matches(df, bench).collect()] == [3, 3, 3]


def test_fingerprints_are_majorities_of_pair_bits_also_beyond_a_byte_and_a_step():
    """Running sums carry between the eight counts of a number: 9,000 equal pairs overflow every byte."""
    rng = np.random.default_rng(8)
    words = np.r_[np.full(9_000, 77, np.uint64), rng.integers(0, 2**63, 3_000).astype(np.uint64)]
    running = D.pair_bits(words)
    assert running.nbytes == 64 * len(words)  # eight counts a number
    pair = D.mix(words[:-1] * D._SLOT[0] + words[1:] * D._SLOT[1])
    plain = np.vstack([np.zeros((1, 64), np.int64), np.cumsum(np.unpackbits(pair.view(np.uint8)).reshape(-1, 64).astype(np.int64), axis=0)])
    for size in D.SIZES:
        want = np.packbits(plain[size - 1 :] - plain[: 1 - size] > (size - 1) // 2, axis=1).view(np.uint64).ravel()
        assert np.array_equal(D.fingerprints(running, size), want)
    assert len(D.fingerprints(D.pair_bits(words[:9]), 10)) == 0


def test_windows_without_a_near_value_are_left_early():
    index = D.SizeIndex(np.array([5], np.uint64), np.array([0]), np.array([0]))
    assert [int(x.sum()) for x in index.some] == [137] * 4
    assert [x.tolist() for x in index.search(np.array([5, 2**64 - 1, 7], np.uint64))] == [[0, 2], [0, 0]]
