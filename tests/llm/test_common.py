import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from trialframe.llm import common as C

TEXT = st.text(alphabet="ab é\n\t\x0b\x1c世", max_size=30)


def plain_words(t):
    out, held = [], ""
    for c in t or "":
        if c in C.WORD_SPACE:
            if held:
                out.append(held)
            held = ""
        else:
            held += c
    return out + [held] * bool(held)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=8))
def test_spans_are_the_words(texts):
    buf, offs = C.flat(pa.array(texts, pa.string()))
    s, e, d = C.word_spans(buf, offs)
    got = [[] for _ in texts]
    for a, b, k in zip(s, e, d, strict=True):
        got[k].append(buf[a:b].tobytes().decode())
    assert got == [plain_words(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, max_size=6), st.integers(1, 5))
def test_shingles_are_equal_where_words_are(texts, k):
    buf, offs = C.flat(pa.array(texts, pa.string()))
    s, e, d = C.word_spans(buf, offs)
    h, at = C.distinct_per_text(*C.shingle_hashes(C.span_hashes(buf, s, e), d, k))
    names = {}
    for j, t in enumerate(texts):
        w = plain_words(t)
        want = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        mine = h[at == j].tolist()
        assert len(mine) == len(set(mine)) == len(want)
        for x in mine:
            names.setdefault(x, []).append(want)
    for where in names.values():
        assert set.intersection(*where)


def test_slices_cover_all_texts_whole():
    texts = pa.array(["x" * 50, None, "", "y" * 500, "z"] * 3)
    seen = [(lo, hi, buf.tobytes(), len(offs)) for lo, hi, buf, offs in C.slices(texts, 120)]
    assert [lo for lo, *_ in seen][0] == 0 and seen[-1][1] == len(texts)
    assert b"".join(b for _, _, b, _ in seen) == b"".join((t or "").encode() for t in texts.to_pylist())
    assert all(n == hi - lo + 1 for lo, hi, _, n in seen)


def test_sliced_arrays_keep_their_rows():
    a = pa.array(["aa bb", "cc", "dd ee ff"]).slice(1)
    buf, offs = C.flat(a)
    assert buf.tobytes() == b"ccdd ee ff" and offs.tolist() == [0, 2, 10]
    assert len(np.unique(C.span_hashes(buf, *C.word_spans(buf, offs)[:2]))) == 4
