import hashlib
import math
import random
import re
import zlib

import pyarrow as pa
import pytest

from trialframe.llm import prefix_trie as P

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "conv_id long, turn int, role string, text string"


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def plain(rows, group=None):
    """Nodes by their paths, members and subtrees one by one."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(v, key=lambda t: (t[0], t[1] or 0, t[2]))] for c, v in convs.items()}
    built = own
    if group:
        h = {c: zlib.crc32(str(c).encode()) % P.HEADS for c in own}
        built = {c: own.get(c - int(math.fmod(c, group)), [])[: h[c]] + t[h[c] :] for c, t in own.items()}
    members = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []
    for p, m in members.items():
        below, todo = [], [p]
        while todo:
            x = todo.pop()
            below.append(x)
            todo += kids.get(x, [])
        saved = sum((len(members[x]) - 1) * (len(WORD.findall(x[-1][1])) if x else 0) for x in below)
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), sum(x not in kids for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def built(spark, rows, group=None, schema=SCHEMA):
    return sorted(map(tuple, P.prefix_trie(spark.createDataFrame(rows, schema), group=group).collect()), key=repr)


def some(seed, n=120, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(400), n):
        rows += [(c, t, rng.choice(["user", "bot"]), "w " * rng.randrange(3)) for t in range(rng.randrange(1, longest))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "group"), [(1, None), (2, P.GROUP)])
def test_nodes_equal_plain_ones(spark, seed, group):
    assert built(spark, some(seed), group) == plain(some(seed), group)


def test_shards_hold_bounded_rows_and_all_of_them(monkeypatch):
    monkeypatch.setattr(P, "SHARD_TURNS", 10)
    monkeypatch.setattr(P, "SHARD", 4)
    sizes = [0, 3, 12, 1, 1, 1, 1, 1, 4, 4, 4, 0, 9]
    parts = [pa.RecordBatch.from_arrays([pa.array([b"x" * 24 * n for n in part], pa.binary())], ["turns"]) for part in (sizes[:5], sizes[5:])]
    got = [[len(x) // 24 for x in t.column("turns").to_pylist()] for t in P.shards(iter(parts), ["turns"])]
    assert sum(got, []) == sizes
    assert all(len(x) <= 4 and (sum(n + 1 for n in x) <= 10 or len(x) == 1) for x in got)


def test_a_hot_conversation_and_large_groups_of_copies(spark):
    rows = [(i, t, "user", f"same {t}") for i in range(2500) for t in range(3)]
    rows += [(9001, t, "user", f"long {t % 7}") for t in range(3000)] + [(9002, t, "user", f"long {t % 7}") for t in range(2990)]
    got = built(spark, rows)
    by = {(r[0], r[1]): r for r in got}
    assert len(got) == 1 + 3 + 3000
    every = ",".join(map(str, range(2500)))
    assert by[0, 3][3:] == (2500, 0, 1, 2499 * 2, hashlib.sha256(every.encode()).hexdigest())
    assert by[0, 0][3:7] == (2502, 2, 2, 2499 * 6 + 2 * 2990)
    assert by[9001, 2990] == (9001, 2990, 9001, 2, 1, 1, 2, hashlib.sha256(b"9002").hexdigest())
    assert by[9001, 3000][3:] == (1, 0, 1, 0, hashlib.sha256(b"9001").hexdigest())


def test_nulls_ties_repeats_and_turnless(spark):
    rows = [
        (None, 1, "user", "nobody's"), (41, None, "user", "first of all"), (41, 1, None, None), (41, 1, "", ""), (41, 1, "bot", "tie b"), (41, 1, "bot", "tie a"),
        (-3, 5, "user", "a b"), (-3, 5, "user", "a b"), (0, 0, "user", "x" * 100_000), (61, 2, "r", "only one"), (43, 1, "r", "q"), (44, 1, "r", "q"), (62, 9, "r", ""),
    ]
    for group in (None, P.GROUP):
        assert built(spark, rows, group) == plain(rows, group)
    turnless = [r for r in plain(rows, P.GROUP) if r[1] == 0]
    assert turnless[0][7] != hashlib.sha256(b"").hexdigest()


def test_empty_table_and_other_columns(spark):
    assert built(spark, []) == []
    rows = [(1, 1, "u", "a", 1, 2, 3), (2, 1, "u", "a", 4, 5, 6)]
    df = spark.createDataFrame(rows, SCHEMA + ", depth int, k1 int, words int")
    assert sorted(map(tuple, P.prefix_trie(df).collect()), key=repr) == plain([r[:4] for r in rows])
