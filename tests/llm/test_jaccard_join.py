import random
import re

import numpy as np
import pytest

from trialframe.llm import jaccard_join as J
from trialframe.llm.components import components


def plain_set(t, k):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(docs, k, percent):
    sets = [(i, plain_set(t, k)) for i, t in docs]
    up = {i: i for i, _ in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            n = len(x & y)
            if x and y and 100 * n >= percent * (len(x) + len(y) - n):
                lo, hi = sorted((root(i), root(j)))
                up[hi] = lo
    return {i: (len(s), root(i)) for i, s in sets}


def corpus(seed, n, most=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        kind = rng.random()
        if out and kind < 0.6:
            w = rng.choice(out).split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                if w:
                    p = rng.randrange(len(w))
                    w[p : p + rng.randrange(2)] = [rng.choice(vocab)] * rng.randrange(1, 3)
            out.append(" ".join(w))
        else:
            out.append(" ".join(rng.choice(vocab) for _ in range(rng.randrange(0, most))))
    passage = " ".join(rng.choice(vocab) for _ in range(30))
    return [t + " " + passage if i % 4 == 0 else t for i, t in enumerate(out)]


@pytest.mark.parametrize(("k", "percent", "tokens"), [(4, 85, J.GROUP_TOKENS), (5, 80, 300)])
def test_equals_brute_force(spark, monkeypatch, k, percent, tokens):
    monkeypatch.setattr(J, "GROUP_TOKENS", tokens)  # small groups make components of many groups
    texts = corpus(percent, 260)
    docs = [(int(i), t) for i, t in zip(np.random.default_rng(0).permutation(5000), texts, strict=False)]
    docs += [(6000, None), (6001, ""), (6002, " \n"), (6003, "One"), (6004, "oNE"), (6005, "a b c d"), (6006, "A B C D"), (6007, "É b c d"), (6008, "é b c d")]
    docs += [(7000, " ".join(f"x{i}" for i in range(20_000))), (7001, " ".join(f"x{i}" for i in range(19_000)))]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, digest int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(df, k=k, percent=percent).collect()}
    want = brute(docs, k, percent)
    assert got == want
    assert len({c for _, c in want.values()}) < len(docs) - 60


def test_signatures_meet_the_guarantee():
    rng = np.random.default_rng(3)
    for percent in (80, 85, 95):
        sizes, met = J.Sizes(percent), 0
        for _ in range(1500):
            n = int(np.exp(rng.uniform(0, 7))) + 1
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            drop, add = rng.integers(0, n // 8 + 2), rng.integers(0, n // 8 + 2)
            b = np.unique(np.r_[rng.permutation(a)[drop:], rng.integers(0, 2**63, add).astype(np.uint64)])
            i = len(np.intersect1d(a, b))
            if i == len(a) == len(b) or 100 * i < percent * (len(a) + len(b) - i):
                continue
            met += 1
            x, y = (J.signatures(s, np.array([0, len(s)]), sizes)[0] for s in (a, b))
            assert len(np.intersect1d(x, y)), (percent, len(a), len(b), i)
        assert met > 40


def test_union_bound_never_hides_a_link():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(np.r_[rng.permutation(base)[: rng.integers(20, 60)], rng.integers(0, 2**63, rng.integers(0, 9)).astype(np.uint64)]) for _ in range(80)]
    g = J.Group(np.arange(80), sets)
    for q in sets:
        want = [j for j, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 70 * len(np.union1d(q, s))]
        assert g.links(q, 70).tolist() == want


def test_sketches_never_hide_a_link():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 90).astype(np.uint64)
    sets = [np.unique(np.r_[rng.permutation(base)[: rng.integers(40, 90)], rng.integers(0, 2**63, rng.integers(0, 60)).astype(np.uint64)]) for _ in range(60)]
    sets += [np.unique(np.r_[rng.permutation(s)[1:], rng.integers(0, 2**63, 2).astype(np.uint64)]) for s in sets]
    bits = J.sketches(np.concatenate(sets), np.r_[0, np.cumsum([len(s) for s in sets])])
    drawn = [J.Drawn(np.array([k]), np.array([len(s)]), [b]) for k, (s, b) in enumerate(zip(sets, bits, strict=True))]
    excluded = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            n = len(np.intersect1d(a, b))
            near = J.near_sketches(drawn[i], drawn[j], 85, False)
            assert near or 100 * n < 85 * (len(a) + len(b) - n)
            excluded += not near
    assert excluded > 5000  # of 7140 pairs
    half = [J.Drawn(np.arange(60) + k, np.array([len(s) for s in sets[k : k + 60]]), bits[k : k + 60]) for k in (0, 60)]
    assert {(b - 60) % 60 for _, b in J.near_sketches(*half, 85, False)} == set(range(60))


def test_short_texts_with_a_shared_passage_make_no_pairs_of_groups(spark, monkeypatch):
    """1,500 sets in one component of signatures, of which 40 pairs are linked: token groups meet no others."""
    monkeypatch.setattr(J, "GROUP_TOKENS", 4000)
    monkeypatch.setattr(J, "SKETCH_WORDS", 1000)
    rng = np.random.default_rng(6)
    passage = rng.integers(0, 2**63, 30).astype(np.uint64)
    sets = [np.unique(np.r_[passage, rng.integers(0, 2**63, rng.integers(20, 60)).astype(np.uint64)]) for _ in range(1460)]
    sets += [np.unique(np.r_[s, rng.integers(0, 2**63, 2).astype(np.uint64)]) for s in sets[:40]]
    live = spark.createDataFrame([(7, k, len(s), s.tobytes()) for k, s in enumerate(sets)], "root long, digest long, n long, tokens binary").repartition(3)
    met = []
    blocks = J._blocks
    monkeypatch.setattr(J, "_blocks", lambda *a: met.append(blocks(*a)) or met[-1])
    got = {tuple(sorted(r)) for r in J._links(live, 85).collect()}
    assert got == {(k, 1460 + k) for k in range(40)}
    assert met[-1].where("not same").count() == 0 and met[-1].where("same").count() == 40


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b c d e")] * 3 + [(None, "a b c d e"), (None, "solo words that none has"), (0, "other words are here now")], "doc_id long, text string")
    rows = sorted(J.jaccard_components(df).collect(), key=str)
    assert [r.component_id for r in rows if r.doc_id == 1] == [1, 1, 1]
    assert sorted(str(r.component_id) for r in rows if r.doc_id is None) == ["1", "None"]
    assert J.jaccard_components(df.limit(0)).count() == 0
    kept = J.keep_one(spark.createDataFrame([(i, "same text in all of these rows here", i) for i in range(5)] + [(9, None, 9), (8, "", 8)], "doc_id long, text string, __x int"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 8, 9] and kept.columns == ["doc_id", "text", "__x"]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 75), (7, 7), (100, 50), (300, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 50: 50, 75: 50, 100: 50, 200: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_shingle_of_very_many_short_texts_is_sent_once_a_portion(spark, monkeypatch):
    """10,000 short texts that share shingles: no signature's run in the shuffle grows with the texts."""
    rng = random.Random(7)
    texts = ["the same four words " + " ".join(f"v{rng.randrange(10**6)}" for _ in range(6)) for _ in range(9_000)]
    texts += [t + " more" for t in rng.sample(texts, 500)] + rng.sample(texts, 500)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    monkeypatch.setattr(J, "PORTION", 20_000)
    signed = J._signature_rows(docs.select("doc_id", "text"), J.SHINGLE, J.Sizes(80)).where("n is null").groupBy("key").count()
    assert signed.agg({"count": "max"}).first()[0] <= 40
    got = {r.doc_id: r.component_id for r in J.jaccard_components(docs, percent=80).collect()}
    first = {}
    for i, t in enumerate(texts):
        # a text with one word more has one shingle more: 7 of 8 are shared
        assert got[i] == first.setdefault(t.removesuffix(" more"), i), t


def test_packed_signatures_are_small_and_complete(spark):
    """What is shuffled has at most 12 bytes a signature, and gives each signature's range all of its sets."""
    rng = random.Random(3)
    texts = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(300)) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    plain = {(r.key % 2**64 >> 16, r.digest) for r in J._signature_rows(docs, 5, J.Sizes(80)).where("n is null").collect()}
    rows = J._signature_rows(docs, 5, J.Sizes(80), 16).where("keys is not null").collect()
    got = set()
    for r in rows:
        key = np.cumsum(J.unpack_numbers(r["keys"], np.uint64)) + J._bounds(16)[r.range]
        assert (key < J._bounds(16)[r.range + 1]).all()
        digest = np.frombuffer(r.names, np.int64)[J.unpack_numbers(r.owners, np.uint32)]
        got |= set(zip(key.tolist(), digest.tolist(), strict=True))
    assert got == plain
    assert sum(len(r["keys"]) + len(r.owners) + len(r.names) for r in rows) <= 12 * len(plain)


def test_star_edges_connect_what_shares_a_signature():
    sig, dig = np.array([5, 5, 7, 5, 7, 9], np.uint64), np.array([3, -4, 8, 3, 2, 6])
    key, own, left, right = J._star(sig, dig)
    assert key.tolist() == [5, 7, 9] and own.tolist() == [-4, 2, 6]
    assert sorted(zip(left.tolist(), right.tolist(), strict=True)) == [(3, -4), (8, 2)]


def test_columns_of_any_name_are_carried_along(spark):
    names = ["__gone", "component_id", "digest", "root", "n", "a.b"]
    df = spark.createDataFrame([(k, "the very same words in every one of them", *range(6)) for k in range(3)], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    assert [tuple(r) for r in J.keep_one(df).collect()] == [(0, "the very same words in every one of them", *range(6))]
    assert J.jaccard_components(df).columns == ["doc_id", "n_shingles", "component_id"]
