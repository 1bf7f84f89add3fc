import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trialframe.llm import packing as P
from trialframe.llm.common import flat


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(P.tokenizer_path())


def test_word_table_equals_the_tokenizer(tokenizer):
    rng = random.Random(3)
    bits = "a bc XYZ é ß İ Σ ς 가 한글 0 12 ' 's 't . , !! ?! ; : - _ # <|endoftext|> ́   \x1c \x85 ﬁ 中 👍🏽 it's l'e. á. ×. ÷, d'un, 'll".split(" ")
    texts = [None, ""] + ["".join(rng.choice(bits) + rng.choice(["", "", " ", "\n", "\t"]) for _ in range(rng.randrange(60))) for _ in range(1500)]
    enc = P.Encoder(P.tokenizer_path(), 2, limit=900)
    for lo in range(0, len(texts), 50):
        part = texts[lo : lo + 50]
        ids, offs = enc.encode(*flat(pa.array(part, pa.string())))
        for j, t in enumerate(part):
            assert ids[offs[j] : offs[j + 1]].tolist() == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], t


def check(spark, df, tokenizer, **options):
    """Every id in one piece, windows without gaps; gives padding."""
    window = options.get("window", P.WINDOW)
    pieces = P.pack(df, **options).collect()
    by_window = {}
    for p in pieces:
        assert p.length == len(p.tokens) // 4 > 0
        by_window.setdefault(p.sequence_id, []).append(p)
    padding = 0
    for ps in by_window.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    want = sorted((r.doc_id, tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in df.collect())
    got = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        got.setdefault(p.doc_id, []).append(p)
    for i, ids in want:
        assert [x for p in got[i] for x in np.frombuffer(p.tokens, "<u4").tolist()] == ids
        assert {p.doc_tokens for p in got[i]} == {len(ids)}
        assert np.cumsum([0] + [p.length for p in got[i]])[:-1].tolist() == [p.start for p in got[i]]
    return padding, sum(len(x) for _, x in want), len(by_window)


def test_all_tokens_in_full_windows(spark, tokenizer):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "river", "of", "xyzzy.", "é"]) for _ in range(rng.choice([0, 1, 5, 80, 300, 900])))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "word " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    padding, total, _ = check(spark, df, tokenizer)
    assert padding <= 0.01 * total
    padding, total, _ = check(spark, df, tokenizer, window=256, open_windows=4, least=4)
    assert padding <= 0.03 * total


def test_bounded_space_and_best_fit():
    packer, done = P.Packer(10, 2, 2), []
    for doc, n in enumerate([6, 7, 3, 4, 5, 1, 25]):
        done += list(packer.add(doc, np.arange(n, dtype=np.uint32)))
        assert len(packer.open) <= 2
    assert [[(p[0], len(p[2])) for p in w] for w in done][:2] == [[(1, 7), (2, 3)], [(0, 6), (3, 4)]]
    left = list(P.merged([w for _, w in packer.open], 10, 2))
    sizes = [sum(len(p[2]) for p in w) for w in left]
    assert all(s == 10 or s & (s - 1) == 0 for s in sizes)
    assert sum(sizes) + sum(len(p[2]) for w in done for p in w) == 51


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b")] * 2 + [(None, "c")], "doc_id long, text string").withColumn("start", F.lit(1))
    assert P.pack(df).where("doc_id = 1").count() == 2 and P.pack(df).where("doc_id is null").count() >= 1
    assert P.pack(df.limit(0)).count() == 0
