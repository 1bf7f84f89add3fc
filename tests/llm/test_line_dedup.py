import random
import re

from trialframe.llm import line_dedup as L


def folds(text):
    """(line, words) of each folded line, by the definition."""
    out = []
    for n, line in enumerate((text or "").split("\n")):
        w = re.findall(r"[^\x20\x09-\x0D]+", line)
        v = [(sum(x.encode()) * 7919 + len(x.encode()) * 104729) % 10007 for x in w]
        own = []
        for k, x in enumerate(w):
            own.append(x)
            least = len(w) > L.SHORT_LINE and all(v[k] < y for y in v[max(0, k - L.REACH) : k]) and all(v[k] <= y for y in v[k + 1 : k + 1 + L.REACH])
            if least or len(own) == L.LONG_FOLD or k == len(w) - 1:
                out.append((n, own))
                own = []
    return out


def units(words):
    return sum(max(1, len(x.encode()) // L.WORD_BYTES) for x in words)


def brute(docs):
    """doc id -> (text, lines, removed), for distinct non-null ids."""
    parts = {i: folds(t) for i, t in docs.items()}
    first, covered = {}, {i: set() for i in docs}
    for i in sorted(docs):
        p = [x for _, x in parts[i]]
        for k in range(len(p)):
            end = k + L.WINDOW
            while end <= len(p) and sum(map(units, p[k:end])) < L.LEAST_WORDS:
                end += 1
            if end > len(p):
                continue
            w = tuple(map(tuple, p[k:end]))
            if first.setdefault(w, (i, k)) != (i, k):
                covered[i] |= set(range(k, end))
    out = {}
    for i, t in docs.items():
        lines = []
        for n, raw in enumerate((t or "").split("\n")):
            own = [k for k, (m, _) in enumerate(parts[i]) if m == n]
            left = [k for k in own if k not in covered[i]]
            if len(left) == len(own):
                lines.append(raw)
            elif left:
                lines.append(" ".join(x for k in left for x in parts[i][k][1]))
        out[i] = (None if t is None else "\n".join(lines), len(parts[i]), len(covered[i]))
    return out


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zetalongword"]) + str(rng.randrange(50)) + rng.choice(["", "", "", "", ",", "."]) for _ in range(n))


def test_equals_brute_force(spark):
    rng = random.Random(5)
    shared = [words(rng, 60) for _ in range(3)]
    docs = {}
    for i in range(60):
        body = [words(rng, rng.randrange(1, 40)) for _ in range(rng.randrange(0, 5))]
        if i % 3 == 0:
            body.insert(rng.randrange(len(body) + 1), shared[i % 2])
        if i % 5 == 0:
            body = [x + " " + shared[2] + " " + x for x in body[:2]]
        docs[i * 7] = "\n".join(body)
    docs |= {1000: None, 1001: "", 1002: "  \n\n x", 1003: docs[0], 1004: (shared[0] + "\n") * 3, 1005: " ".join(["w"] * 5000), 1006: "a\nbé\nc\n" * 9, 1007: "漢字" * 30 + "\n" + "かな。" * 30, 1008: "x\x0b\r y"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    want = brute(docs)
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in L.dedup_lines(df).collect()}
    assert got == want
    assert sum(r[2] for r in want.values()) > 100


def test_passages_of_over_50_words_are_removed_at_every_phase(spark):
    """In running text, with and without punctuation and line feeds: most of each later copy goes, nothing else does."""
    rng = random.Random(1)
    docs, passages = [], []
    for n in range(60):
        tokens = [f"{rng.choice('abcdefghij')}{rng.randrange(900)}{rng.choice('stuv') * rng.randrange(5)}" for _ in range(51 + n % 10)]
        if n % 3 == 1:
            tokens = [t + rng.choice([",", ".", "", ""]) for t in tokens]
        passage = "".join(t + ("\n" if n % 3 == 2 and k % 17 == 16 else " ") for k, t in enumerate(tokens)).strip()
        passages.append(tokens)
        for copy in range(2):
            head, tail = ([f"{rng.choice('klmnop')}{rng.randrange(10**6)}" for _ in range(m)] for m in (rng.randrange(40) + copy, rng.randrange(30)))
            docs.append((2 * n + copy, " ".join(head + [passage] + tail), head, tail))
    got = {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")).collect()}
    left = []
    for i, text, head, tail in docs:
        if i % 2 == 0:
            assert got[i] == text
        else:
            have = set(got[i].split())
            left.append(sum(t in have for t in passages[i // 2]) / len(passages[i // 2]))
            assert len([t for t in head + tail if t not in have]) <= 14
    assert max(left) < 0.6 and sum(left) / len(left) < 0.3, (max(left), sum(left) / len(left))


def test_passages_of_short_lines_are_removed(spark):
    for width in (1, 2, 3):
        passage = "\n".join(" ".join(f"w{k}" for k in range(n, n + width)) for n in range(0, 60, width))
        rows = [(i, f"head {i} of its own\n{passage}\nend {i}") for i in range(3)]
        got = {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {0: rows[0][1], 1: "head 1 of its own\nend 1", 2: "head 2 of its own\nend 2"}


def test_edges(spark):
    t = words(random.Random(2), 40)
    rows = [(None, t), (1, t), (1, t), (None, t), (2, t)]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, lang string, n_lines int")
    got = sorted(((r.doc_id is None, r.doc_id), r.text) for r in L.dedup_lines(df).collect())
    assert [x[1] for x in got] == [t, t, "", t, t]
    assert L.dedup_lines(df.limit(0)).count() == 0
    untouched = " odd   spacing\t kept \r\n\n\nas it is  "
    odd = spark.createDataFrame([(1, untouched)], "doc_id long, text string")
    assert L.dedup_lines(odd).first().text == untouched



def test_columns_of_any_name_are_carried_along(spark):
    t = words(random.Random(3), 40)
    names = ["__i", "__later", "__again", "__cut", "i", "later", "again", "w", "first", "a.b"]
    df = spark.createDataFrame([(k, t, *range(10)) for k in range(3)], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    out = L.dedup_lines(df)
    assert out.columns == [*df.columns, "n_lines", "n_removed"]
    assert sorted(tuple(r)[:-2] for r in out.collect()) == [(0, t, *range(10)), (1, "", *range(10)), (2, "", *range(10))]
