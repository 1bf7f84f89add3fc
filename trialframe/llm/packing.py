"""Packing: texts into token windows of a fixed size, online and in bounded space.

Every partition keeps at most `open_windows` windows. A text's tokens first fill whole windows of their own; what is
left goes to the open window that it fits best. Where none fits, the fullest is emitted, topped up by a cut of the text
if its gap and the rest are both worth a piece. What is open at the end of the partitions is written once and merged by
a second, much smaller pass: windows are put together best fit first, the emptiest fill the gaps of the fullest, and
the last one is cut into powers of two.

Tokenising is done once; its result is written to the shared folder, as both the finished windows and the leftovers
are read from it. Words are encoded once for each worker as long as its bounded table holds them: the tokenizer never
joins what white space separates.

Defined results: a null or empty text is the end token alone. Repeated rows are separate texts. Very long texts are cut
into whole windows. Of windows that a text fits equally well it goes to the one that was not used for longest. Extra columns do not take
part. An empty table gives no piece. A null id stays null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.llm.common import durable, slices, small_batches, span_hashes, table, word_spans

WINDOW = 4096
END_TOKEN = 2
OPEN_WINDOWS = 32
#: A text is not cut for fewer tokens than these.
LEAST_PIECE = 16
#: Words that a worker's table holds before it starts anew.
CACHE_WORDS = 1_000_000
#: Leftover windows that one merging task takes on average.
MERGED_WINDOWS = 2048
PIECES = "doc_id long, start long, length long, tokens binary, doc_tokens long, sequence_id long, offset long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Token ids of texts through a table of words."""

    def __init__(self, path: str, end: int, limit: int = CACHE_WORDS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.end, self.limit = Tokenizer.from_file(path), end, limit
        self.word_end = np.zeros(self.tok.get_vocab_size(), bool)
        for token, i in self.tok.get_vocab().items():
            self.word_end[i] = token.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        self.index: dict[int, int] = {}  # hash of a word: its entry
        self.ids = np.full(1 << 16, self.end, np.uint32)
        self.used = 1
        self.start, self.size = np.zeros(1 << 15, np.int64), np.ones(1 << 15, np.int64)
        self.count = 1  # entry 0 is the end token

    def _put(self, keys: list[int], ids: np.ndarray, sizes: np.ndarray) -> None:
        for name, need in (("ids", self.used + len(ids)), ("start", self.count + len(keys)), ("size", self.count + len(keys))):
            held = getattr(self, name)
            if need > len(held):
                setattr(self, name, np.concatenate([held, np.zeros(max(need, len(held)), held.dtype)]))
        self.ids[self.used : self.used + len(ids)] = ids
        at = slice(self.count, self.count + len(keys))
        self.size[at] = sizes
        self.start[at] = self.used + np.cumsum(sizes) - sizes
        self.index.update(zip(keys, range(self.count, self.count + len(keys)), strict=True))
        self.used += len(ids)
        self.count += len(keys)

    def _learn(self, keys: list[int], words: list[str]) -> None:
        # Words of letters only are encoded many at a time: each ends with the only word-end token that it has.
        letters = [w.lower().isalpha() for w in words]
        plain = [(k, w) for k, w, x in zip(keys, words, letters, strict=True) if x]
        rest = [(k, w) for k, w, x in zip(keys, words, letters, strict=True) if not x]
        for lo in range(0, len(plain), 1000):
            part = plain[lo : lo + 1000]
            ids = np.array(self.tok.encode(" ".join([w for _, w in part]), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.word_end[ids])
            if len(ends) == len(part) and ends[-1] == len(ids) - 1:
                self._put([k for k, _ in part], ids, np.diff(np.r_[-1, ends]))
            else:
                rest += part
        if rest:
            got = [e.ids for e in self.tok.encode_batch([w for _, w in rest], add_special_tokens=False)]
            self._put([k for k, _ in rest], np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got]))

    def _gather(self, entry: np.ndarray) -> np.ndarray:
        """The ids of the entries end to end."""
        sizes = self.size[entry]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.start[entry] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts (bytes end to end) end to end, each with the end token, and the n + 1 offsets."""
        starts, ends, doc = closed_spans(buf, *word_spans(buf, offs))
        keys, first, entry = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        if len(keys) + self.count > self.limit:
            self.clear()
        get, names = self.index.get, keys.tolist()
        known = [get(k, 0) for k in names]
        new = [j for j, e in enumerate(known) if not e]
        if new:
            raw = buf.tobytes()
            at = first[new]
            words = [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            self._learn([names[j] for j in new], words)
            for j in new:
                known[j] = self.index[names[j]]
        entry = np.array(known, np.int64)[entry]
        last = np.searchsorted(doc, np.arange(len(offs) - 1), "right")
        entry = np.insert(entry, last, 0)
        bounds = np.r_[0, np.cumsum(self.size[entry])]
        return self._gather(entry), bounds[np.r_[0, last + np.arange(1, len(last) + 1)]]


_CLOSES = np.zeros(256, bool)
_CLOSES[[ord(c) for c in ".,;:!?"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def closed_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Closing punctuation after a Latin letter as a word of its own: the tokenizer always parts them."""
    if not len(starts):
        return starts, ends, doc
    low = (buf >= 0x80) & (buf <= 0xBF) & (buf != 0x97) & (buf != 0xB7)  # the letters from U+00C0 to U+00FF
    letter = _LETTER[buf]
    letter[1:] |= low[1:] & (buf[:-1] == 0xC3)
    last = np.maximum.accumulate(np.where(_CLOSES[buf], -1, np.arange(len(buf))))[ends - 1]
    cut = (last >= starts) & (last < ends - 1)
    cut &= letter[np.maximum(last, 0)]
    slot = np.arange(len(starts)) + np.r_[0, np.cumsum(cut)[:-1]]
    n = len(starts) + int(cut.sum())
    s, e, d = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    s[slot], e[slot], d[slot] = starts, np.where(cut, last + 1, ends), doc
    more = slot[cut] + 1
    s[more], e[more], d[more] = last[cut] + 1, ends[cut], doc[cut]
    return s, e, d


@lru_cache(maxsize=2)
def encoder(path: str, end: int) -> Encoder:
    return Encoder(path, end)


class Packer:
    """Open windows of one partition; a piece is (doc, start, tokens, doc_tokens)."""

    def __init__(self, window: int, most: int, least: int):
        self.window, self.most, self.least = window, most, least
        self.open: list[tuple[int, list]] = []

    def add(self, doc, tokens: np.ndarray) -> Iterator[list]:
        """Yields finished windows."""
        n, at = len(tokens), 0
        while n - at >= self.window:
            yield [(doc, at, tokens[at : at + self.window], n)]
            at += self.window
        while at < n:
            size = n - at
            fits = [(self.window - fill, k) for k, (fill, _) in enumerate(self.open) if self.window - fill >= size]
            if fits:
                _, k = min(fits)
                fill, held = self.open.pop(k)
                held.append((doc, at, tokens[at:], n))
                if fill + size == self.window:
                    yield held
                else:
                    self.open.append((fill + size, held))
                return
            if len(self.open) < self.most:
                self.open.append((size, [(doc, at, tokens[at:], n)]))
                return
            k = max(range(len(self.open)), key=lambda i: self.open[i][0])
            fill, held = self.open.pop(k)
            gap = self.window - fill
            if gap >= self.least and size - gap >= self.least:
                held.append((doc, at, tokens[at : at + gap], n))
                at += gap
            yield held


def merged(windows: list[list], window: int, least: int) -> Iterator[list]:
    """Finished windows from partly filled ones: best fit decreasing, then the emptiest fill the gaps."""
    size = lambda w: sum(len(p[2]) for p in w)
    bins: list[list] = []
    for w in sorted(windows, key=size, reverse=True):
        n = size(w)
        fits = [b for b in bins if b[0] + n <= window]
        if fits:
            best = max(fits, key=lambda b: b[0])
            best[0] += n
            best[1] += w
        else:
            bins.append([n, list(w)])
    bins.sort(key=lambda b: -b[0])
    while len(bins) > 1:
        fill, held = bins[0]
        gap = window - fill
        while gap >= least and len(bins) > 1:
            doc, at, tokens, n = bins[-1][1].pop()
            take = min(gap, len(tokens))
            held.append((doc, at, tokens[:take], n))
            gap -= take
            bins[-1][0] -= take
            if take < len(tokens):
                bins[-1][1].append((doc, at + take, tokens[take:], n))
            if not bins[-1][1]:
                bins.pop()
        yield held
        bins.pop(0)
    for fill, held in bins:
        while fill:
            room = min(window, 1 << (fill.bit_length() - 1))
            fill -= room
            out = []
            while room:
                doc, at, tokens, n = held.pop(0)
                take = min(room, len(tokens))
                out.append((doc, at, tokens[:take], n))
                room -= take
                if take < len(tokens):
                    held.insert(0, (doc, at + take, tokens[take:], n))
            yield out


_OUT = ("doc_id", "start", "length", "tokens", "doc_tokens", "sequence_id", "offset", "leftover")


def _rows(windows: Iterator[tuple[int, list, bool]]) -> Iterator[pa.RecordBatch]:
    cols: list[list] = [[] for _ in _OUT]
    held = 0
    for sequence, pieces, leftover in windows:
        offset = 0
        for doc, at, tokens, n in pieces:
            for c, v in zip(cols, (doc, int(at), len(tokens), tokens.astype("<u4").tobytes(), n, sequence, offset, leftover), strict=True):
                c.append(v)
            offset += len(tokens)
        held += offset
        if held > 1_000_000:
            yield _batch(cols)
            cols, held = [[] for _ in _OUT], 0
    if cols[0]:
        yield _batch(cols)


def _batch(cols: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=list(_OUT))


def pack(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, window: int = WINDOW, end: int = END_TOKEN,
    open_windows: int = OPEN_WINDOWS, least: int = LEAST_PIECE,
) -> DataFrame:
    """One row per piece: its text's id, place and tokens (little-endian unsigned 32-bit), its window and place there."""
    path = path or tokenizer_path()

    def first(batches):
        base = TaskContext.get().partitionId() << 32

        def windows():
            packer, k = Packer(window, open_windows, least), 0
            for b in batches:
                ids = b.column(0).to_pylist()
                for lo, hi, buf, at in slices(b.column(1)):
                    tokens, offs = encoder(path, end).encode(buf, at)
                    for j, doc in enumerate(ids[lo:hi]):
                        for w in packer.add(doc, tokens[offs[j] : offs[j + 1]]):
                            yield base + k, w, False
                            k += 1
            for _, held in packer.open:
                yield base + k, held, True
                k += 1

        yield from _rows(windows())

    def second(batches):
        base = (1 << 60) + (TaskContext.get().partitionId() << 32)
        held: dict[int, list] = {}
        for b in batches:
            for doc, at, raw, n, seq, offset in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.setdefault(seq, []).append((offset, doc, at, np.frombuffer(raw, "<u4"), n))
        wins = [[p[1:] for p in sorted(held[s], key=lambda p: p[0])] for s in sorted(held)]
        yield from _rows((base + k, w, False) for k, w in enumerate(merged(wins, window, least)))

    small_batches(docs.sparkSession)
    schema = PIECES + ", leftover boolean"
    placed = durable(docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text}`")).mapInArrow(first, schema))
    left = placed.where("leftover").select("doc_id", "start", "tokens", "doc_tokens", "sequence_id", "offset")
    tasks = left.select(F.count_distinct("sequence_id")).first()[0] // MERGED_WINDOWS + 1
    again = left.repartition(tasks, "sequence_id").mapInArrow(second, schema)
    return placed.where("not leftover").unionByName(again).drop("leftover")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
