"""N-gram Jaccard join with a token-group matrix: all links of sets whose similarity reaches a threshold, exactly.

A text's set is its distinct k-word shingles, hashed to 64 bits. Equal sets are one class, named by a digest.

1. Signatures. Two sets of n and b shingles at the threshold differ in at most D = (1-s)/(1+s) (n+b) shingles. Sets of a
   size class are split, by a hash of each shingle, into the same number of parts, more than D of them filled; then at
   least one filled part must be equal in both. A set emits one signature per part, for its own size class and, where
   the threshold lets it reach a set of the next class, for that one too. Single shingles make poor signatures, as a
   passage that many texts share makes them frequent; so parts of fewer than two or three shingles are left out where enough
   others remain for the guarantee (tier A), and are added where not (tier B); a set for which even the filled parts do
   not suffice gets its class's common signature (tier C).
2. Candidates. Tasks send each signature once per portion, with edges from its sets to one of them. What is sent goes to
   ranges of the signatures' first 48 bits, a portion's sorted and packed for each range (about 9 bytes a signature);
   signatures taken for equal by that only enlarge components. A range has a bounded number of signatures, and equal
   ones give edges to their first set, never pairs. Linked sets share a signature, so they are in one connected
   component of these edges.
3. Narrowing. Passages that many short texts share join sets into large components with few links. The sets of a component
   that needs more than one group are drawn as sketches: the parity of the shingles that fall on each of two to four bits
   per shingle. The bits in which two sketches differ are at most the shingles in which the sets do, so pairs that differ
   in more bits than linked sets can are none. What the others connect are the components from here on. Sketches have
   a sixteenth of the shingles' bytes at most, and only they are compared all with all.
4. Groups. The sets of a component are partitioned into groups of similar size and bounded total length, and each
   group's token union is stored with it: the rows of the token-group matrix. A component with one group needs no more.
5. Opening. For each two groups of a component whose sizes can reach the threshold, every set of one is a query on the
   other: the overlap with the union bounds the overlap with each member. Only where that bound reaches what the
   smallest member needs is the group opened and the exact overlaps are counted. A block of two groups returns a
   spanning forest of its links, not the links.
6. Components of these links, over classes, give the result.

Nothing depends on sampling and no candidate is dropped. What grows with the square is the number of pairs of sketch
groups within a component of signatures, and of token groups within a narrowed one (its sets that are near each other,
not its copies), each a task of bounded size.

Defined results: null and empty texts, and texts without words, have an empty set, n_shingles 0, and are linked with
nothing, not even with each other. A text with fewer than k words has one shingle, its whole sequence. Repeated rows
are copies. Ties do not arise. Rows with a null id take part only as copies of rows that have one, else their component
is null. Extra columns do not take part. An empty table gives an empty result. Very long texts are handled whole.
"""

from __future__ import annotations

import math
import uuid
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.llm.common import LOWER, distinct_per_text, durable, flat, mix, pack_numbers, shingle_hashes, sized_broadcast, slices, small_batches, span_hashes, table, unpack_numbers, word_spans
from trialframe.llm.components import components

SHINGLE = 4
PERCENT = 85
#: Shingles that a group holds on average at most.
GROUP_TOKENS = 1 << 16
#: 64-bit words that a group of sketches holds on average at most, and what a short sketch counts for at least.
SKETCH_WORDS, SKETCH_LEAST = 1 << 15, 4
#: Signatures that a task holds before it sends them, and bits of them that are sent.
PORTION, KEY_BITS = 1_000_000, 48
#: Bytes of text whose signatures one range holds on average, and the least number of ranges.
RANGE_BYTES, RANGES = 32 << 20, 256
#: Live sets whose ids may be broadcast when their texts are read again.
BROADCAST_SETS = 2_000_000
#: Rows of the group plan that may be broadcast.
BROADCAST_PLANS = 500_000

_PART, _SUM, _BIT = np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xE7037ED1A0B428DB)


class Sizes:
    """Size classes and the number of parts of each, for a threshold in percent."""

    def __init__(self, percent: int):
        self.percent = percent
        self.slack = Fraction(100 - percent, 100 + percent)
        #: Parts of fewer shingles are poor signatures; at low thresholds parts are small.
        self.least = 3 if percent >= 85 else 2 if percent >= 75 else 1
        bounds = [1]
        while bounds[-1] < 1 << 40:
            bounds.append(max(bounds[-1] + 1, bounds[-1] * 2))
        self.bounds = np.array(bounds, np.int64)
        widest = [float(self.slack) * 2 * b for b in bounds[1:]]
        self.parts = np.array([math.ceil(1.12 * w) + 4 for w in widest], np.int64)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, n, "right") - 1

    def most_different(self, n: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The most shingles in which a set of n can differ from a linked one of size class k or n's own."""
        partner = np.minimum(self.bounds[k + 1] - 1, n * 100 // self.percent)
        return (n + partner) * self.slack.numerator // self.slack.denominator

    def reaches_next(self, n: np.ndarray) -> np.ndarray:
        return n * 100 // self.percent >= self.bounds[self.of(n) + 1]


def sets_of(texts, k: int):
    """(first row, shingle hashes, row offsets) of runs of texts: sorted distinct hashes of each."""
    for lo, hi, buf, offs in slices(texts):
        buf = LOWER[buf]
        starts, ends, doc = word_spans(buf, offs)
        h, d = distinct_per_text(*shingle_hashes(span_hashes(buf, starts, ends), doc, k))
        yield lo, h, np.searchsorted(d, np.arange(hi - lo + 1))


def digests(h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One 64-bit digest per set, as a signed number; of an empty set it means nothing."""
    total = np.r_[np.uint64(0), np.cumsum(mix(h * _SUM))]
    n = np.diff(offs).astype(np.uint64)
    return mix(total[offs[1:]] - total[offs[:-1]] + n * _PART).view(np.int64)


def signatures(h: np.ndarray, offs: np.ndarray, sizes: Sizes) -> tuple[np.ndarray, np.ndarray]:
    """Signature and set index, for sets of the given offsets."""
    n = np.diff(offs)
    own = sizes.of(np.maximum(n, 1))
    sig, at = [], []
    for step in (0, 1):
        use = n > 0
        if step:
            use &= sizes.reaches_next(n)
        k = own + step
        # A set that can be linked with its equals only needs no signature.
        apart = np.where(use, sizes.most_different(n, np.minimum(k, len(sizes.parts) - 1)), 0)
        use &= apart > 0
        if not use.any():
            continue
        m = sizes.parts[k]
        doc = np.repeat(np.arange(len(n)), np.where(use, n, 0))
        tok = h[np.repeat(use, n)]
        part = (mix(tok * _PART + k[doc].astype(np.uint64)) % m[doc].astype(np.uint64)).astype(np.int64)
        slot = doc * (int(m.max()) + 1) + part
        order = np.argsort(slot, kind="stable")
        slot, value = slot[order], mix(tok[order] * _SUM + np.uint64(7))
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        count = np.diff(np.r_[first, len(slot)])
        total = np.add.reduceat(value, first)
        d, p = doc[order][first], part[order][first]
        key = mix(total + mix(p.astype(np.uint64) * _PART + k[d].astype(np.uint64) * _SUM))
        large = count >= sizes.least
        safe_a = np.bincount(d[large], minlength=len(n)) > apart
        safe_b = np.bincount(d, minlength=len(n)) > apart
        sig.append(key[large])
        at.append(d[large])
        more = ~safe_a[d]
        sig.append(mix(key[more] + np.uint64(1)))
        at.append(d[more])
        poor = np.flatnonzero(use & ~safe_b)
        sig.append(mix(k[poor].astype(np.uint64) + np.uint64(99)))
        at.append(poor)
    if not sig:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(sig), np.concatenate(at)


# ---------------------------------------------------------------- candidates


def _star(sig: np.ndarray, dig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each signature once with its smallest digest, and edges from its other digests to that."""
    order = np.lexsort((dig, sig))
    sig, dig = sig[order], dig[order]
    start = np.r_[True, sig[1:] != sig[:-1]] if len(sig) else np.zeros(0, bool)
    first = dig[start][np.cumsum(start) - 1] if len(sig) else dig
    apart = dig != first
    edges = np.unique(np.stack([dig[apart], first[apart]], 1), axis=0) if apart.any() else np.zeros((0, 2), np.int64)
    return sig[start], dig[start], edges[:, 0], edges[:, 1]


def _bounds(ranges: int) -> np.ndarray:
    """The first key of each range and the end of the last."""
    return np.array([(j << KEY_BITS) // ranges for j in range(ranges + 1)], np.uint64)


def _packed(batches, ranges: int):
    """Signature rows by range: texts and edges, dealt to any, as they are; of a portion's signatures a row per range.

    It has the distances of the sorted keys, the place of each one's set among the range's digests, and these."""
    names = ["range", "digest", "doc_id", "n", "keys", "owners", "names"]
    bounds = _bounds(ranges)
    for b in batches:
        key, own = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
        if b.column(3).null_count < b.num_rows:
            at, none = (key % np.uint64(ranges)).astype(np.int32), pa.nulls(b.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(at), *b.columns[1:], none, none, none], names=names)
            continue
        key = key >> np.uint64(64 - KEY_BITS)
        cut = np.searchsorted(key, bounds)
        some = np.flatnonzero(cut[1:] > cut[:-1])
        held: list[list[bytes]] = [[], [], []]
        for j, lo, hi in zip(some.tolist(), cut[some].tolist(), cut[some + 1].tolist(), strict=True):
            digest, place = np.unique(own[lo:hi], return_inverse=True)
            for column, x in zip(held, (pack_numbers(np.diff(key[lo:hi], prepend=bounds[j])), pack_numbers(place.astype(np.uint32)), digest.tobytes()), strict=True):
                column.append(x)
        none = pa.nulls(len(some), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), none, none, none, *[pa.array(x, pa.binary()) for x in held]], names=names)


def _signature_rows(docs: DataFrame, k: int, sizes: Sizes, ranges: int = 0) -> DataFrame:
    """(key, digest, doc_id, n): a row per text, and per signature (n is null) once in a portion of a task; edges (n = -1).

    What a portion's sets share becomes star edges at once, so a signature of a large part of all texts reaches the
    shuffle once per portion of `PORTION` signatures, not once per text. With a number of ranges, as `_packed` gives them.
    """
    names = ["key", "digest", "doc_id", "n"]

    def sent(sig: list[np.ndarray], dig: list[np.ndarray]):
        key, own, left, right = _star(np.concatenate(sig), np.concatenate(dig))
        empty = pa.nulls(len(key), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(own), empty, empty], names=names)
        if len(left):
            yield pa.RecordBatch.from_arrays([pa.array(mix(left.view(np.uint64)).view(np.int64)), pa.array(left), pa.array(right), pa.array(np.full(len(left), -1))], names=names)

    def rows(batches):
        seen: set[int] = set()  # a digest's signatures are sent once by a task, as far as this bounded set tells
        sigs: list[np.ndarray] = []
        digs: list[np.ndarray] = []
        held = 0
        for b in batches:
            ids = b.column(0)
            for lo, h, offs in sets_of(b.column(1), k):
                dig, n = digests(h, offs), np.diff(offs)
                size = len(n)
                own = mix(np.arange(lo, lo + size).astype(np.uint64) + dig.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(dig), ids.slice(lo, size), pa.array(n.astype(np.int64))], names=names)
                sig, at = signatures(h, offs, sizes)
                new = np.zeros(size, bool)
                for j, x in enumerate(dig.tolist()):
                    if x not in seen:
                        new[j] = True
                        seen.add(x)
                if len(seen) > 500_000:
                    seen.clear()
                use = new[at]
                sigs.append(sig[use])
                digs.append(dig[at[use]])
                held += len(sigs[-1])
                if held > PORTION:
                    yield from sent(sigs, digs)
                    sigs, digs, held = [], [], 0
        if held:
            yield from sent(sigs, digs)

    if ranges:
        return docs.mapInArrow(lambda batches: _packed(rows(batches), ranges), "range int, digest long, doc_id long, n long, keys binary, owners binary, names binary")
    return docs.mapInArrow(rows, "key long, digest long, doc_id long, n long")


def _candidate_rows(signed: DataFrame, ranges: int) -> DataFrame:
    """The texts' rows as they are, and star edges (digest, first digest with the signature) with n = -1."""
    bounds = _bounds(ranges)

    def met(keys: list[np.ndarray], digs: list[np.ndarray], sent: set[tuple[int, int]]):
        key, dig = np.concatenate(keys), np.concatenate(digs)
        order = np.argsort(key, kind="stable")
        key = key[order]
        equal = key[1:] == key[:-1]
        shared = np.r_[equal, False] | np.r_[False, equal]
        _, _, left, right = _star(key[shared], dig[order][shared])
        fresh = [p for p in zip(left.tolist(), right.tolist(), strict=True) if p not in sent]
        sent.update(fresh)
        if len(sent) > 300_000:
            sent.clear()
        if fresh:
            a, f = zip(*fresh, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(f, pa.int64()), pa.array([-1] * len(a), pa.int64())], names=["digest", "doc_id", "n"])

    def stream(batches):
        sent: set[tuple[int, int]] = set()
        keys: list[np.ndarray] = []
        digs: list[np.ndarray] = []
        last = None
        for b in batches:
            packed = b.column(4).is_valid()
            plain = b.filter(pc.invert(packed))
            if plain.num_rows:
                yield plain.select(["digest", "doc_id", "n"])
            for row in b.filter(packed).select(["range", "keys", "owners", "names"]).to_pylist():
                if row["range"] != last:
                    if keys:
                        yield from met(keys, digs, sent)
                    keys, digs, last = [], [], row["range"]
                keys.append(np.cumsum(unpack_numbers(row["keys"], np.uint64)) + bounds[last])
                digs.append(np.frombuffer(row["names"], np.int64)[unpack_numbers(row["owners"], np.uint32)])
        if keys:
            yield from met(keys, digs, sent)

    dealt = signed.repartition("range").sortWithinPartitions("range")
    return dealt.mapInArrow(stream, "digest long, doc_id long, n long")


# ---------------------------------------------------------------- groups


def forest(n: int, pairs) -> list[tuple[int, int]]:
    """The pairs that join what was apart."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for a, b in pairs:
        ra, rb = root(a), root(b)
        if ra != rb:
            up[ra] = rb
            out.append((a, b))
    return out


class Group:
    """Some sets end to end, their token union and the smallest size: a row of the token-group matrix."""

    def __init__(self, digest: np.ndarray, sets: list[np.ndarray]):
        self.digest, once = np.unique(digest, return_index=True)
        self.sets = [sets[i] for i in once]
        self.size = np.array([len(s) for s in self.sets])
        tok = np.concatenate(self.sets)
        by = np.argsort(tok, kind="stable")
        self.token, self.member = tok[by], np.repeat(np.arange(len(self.sets)), self.size)[by]
        self.union = self.token[np.r_[True, self.token[1:] != self.token[:-1]]]
        self.start = np.searchsorted(self.token, self.union)
        self.end = np.r_[self.start[1:], len(self.token)]

    def links(self, query: np.ndarray, percent: int) -> np.ndarray:
        """The members linked with a query set."""
        n = len(query)
        at = np.minimum(np.searchsorted(self.union, query), len(self.union) - 1)
        at = at[self.union[at] == query]
        # 100 i >= p (n + b - i) for the smallest member that can reach the threshold
        least = max(int(self.size.min()), -(-n * percent // 100))
        if len(at) * (100 + percent) < percent * (n + least):
            return np.zeros(0, np.int64)  # the union bounds every member's overlap
        lengths = self.end[at] - self.start[at]
        pos = np.repeat(self.start[at] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        both = np.bincount(self.member[pos], minlength=len(self.sets))
        return np.flatnonzero((both > 0) & (both * (100 + percent) >= percent * (n + self.size)))


def open_groups(left: Group, right: Group, percent: int, same: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links between two groups, or within one, as digests."""
    n = len(left.sets)

    def pairs():
        for i, q in enumerate(left.sets):
            for j in right.links(q, percent).tolist():
                if not same:
                    yield i, n + j
                elif j > i:
                    yield i, j

    name = left.digest if same else np.r_[left.digest, right.digest]
    return [(int(name[a]), int(name[b])) for a, b in forest(len(name), pairs())]


def _blocks(live: DataFrame, weight: Column, most: int, fields: list[str], percent: int) -> DataFrame:
    """live: (root, digest, n, ...); (same, sets, others): each group of sets, and each two of a component that can have links.

    A group has sets whose weights sum to about `most`, each with the given fields."""
    s = percent / 100
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / s) * 2)
    # Sizes of similar value together; a random share of them where they are too many for one group.
    rows = live.withColumn("band", band)
    held = rows.groupBy("root", "band").agg(F.sum(weight).alias("held"))
    whole = held.groupBy("root").agg(F.sum("held").alias("all"))
    plan = held.join(whole, "root").select("root", "band", F.when(F.col("all") <= most, 0).otherwise(F.ceil(F.col("held") / most)).cast("int").alias("groups"))
    plan = durable(plan)
    part = F.when(F.col("groups") == 0, F.lit(-1)).otherwise(F.pmod(F.xxhash64("digest"), F.greatest(F.col("groups"), F.lit(1))).cast("int"))
    placed = (
        rows.join(sized_broadcast(plan, plan.count(), BROADCAST_PLANS), ["root", "band"]).withColumn("part", part)
        .withColumn("band", F.when(F.col("groups") == 0, F.lit(-1)).otherwise(F.col("band")))
        .groupBy("root", "band", "part")
        .agg(F.collect_list(F.struct(*fields)).alias("sets"), F.min("n").alias("low"), F.max("n").alias("high"))
    )
    groups = durable(placed.select("root", F.struct("band", "part").alias("g"), "sets", "low", "high"))
    names = groups.where("g.band >= 0").select("root", "g", "low", "high")
    a, b = names.alias("a"), names.alias("b")
    met = (
        a.join(b, F.col("a.root") == F.col("b.root"))
        .where("a.g < b.g")
        .where((F.col("a.high") * 100 >= F.col("b.low") * percent) & (F.col("b.high") * 100 >= F.col("a.low") * percent))
        .select(F.col("a.root").alias("root"), F.col("a.g").alias("g"), F.col("b.g").alias("other"))
    )
    side = groups.select("root", F.col("g").alias("other"), F.col("sets").alias("others"))
    across = met.join(groups.select("root", "g", "sets"), ["root", "g"]).join(side, ["root", "other"]).select(F.lit(False).alias("same"), "sets", "others")
    return groups.select(F.lit(True).alias("same"), "sets", F.expr("slice(sets, 1, 0)").alias("others")).unionByName(across)


def sketches(h: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """Of sets of the given offsets, the parity of the shingles on each of their bits, a power of two."""
    n = np.diff(offs)
    width = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))
    first = np.r_[0, np.cumsum(width)]
    bit = (mix(h * _BIT) & (np.repeat(width, n) - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(bit + np.repeat(first[:-1], n), minlength=first[-1]) & 1).astype(np.uint8)
    data = np.packbits(odd, bitorder="little").tobytes()
    return [data[a // 8 : b // 8] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


class Drawn:
    """Sketches of some sets, folded to the least width among them."""

    def __init__(self, digest: np.ndarray, size: np.ndarray, bits: list[bytes]):
        self.digest, self.size = digest, size
        least = min(len(b) for b in bits) // 8
        self.bits = np.stack([np.bitwise_xor.reduce(np.frombuffer(b, np.uint64).reshape(-1, least), axis=0) for b in bits])

    def folded(self, words: int) -> np.ndarray:
        return np.bitwise_xor.reduce(self.bits.reshape(len(self.bits), -1, words), axis=1)


def near_sketches(left: Drawn, right: Drawn, percent: int, same: bool) -> list[tuple[int, int]]:
    """Digests that connect the sets of two groups, or of one, whose sketches do not exclude a link."""
    words = min(left.bits.shape[1], right.bits.shape[1])
    a, b = left.folded(words), right.folded(words)
    shift = 0 if same else len(a)
    name = left.digest if same else np.r_[left.digest, right.digest]
    top = np.arange(len(name))
    out: list[tuple[int, int]] = []
    step = max(1, 2_000_000 // len(b))
    for lo in range(0, len(a), step):
        part, n = a[lo : lo + step], left.size[lo : lo + step, None]
        differ = np.zeros((len(part), len(b)), np.int32)
        for w in range(words):
            differ += np.bitwise_count(part[:, w, None] ^ b[None, :, w])
        # 100 i >= p (n + b - i) with i = (n + b - d) / 2
        near = differ * (100 + percent) <= (n + right.size) * (100 - percent)
        for i in np.flatnonzero(near.any(1)).tolist():
            own = top[lo + i]
            met = np.unique(top[shift + np.flatnonzero(near[i])])
            met = met[met != own]
            if len(met):
                out.extend((int(name[own]), int(name[m])) for m in met)
                top[np.isin(top, met)] = own
    return out


def _narrowed(live: DataFrame, percent: int) -> DataFrame:
    """live, its components of more than one group divided into what sketches leave connected; sets near no other go."""
    large = durable(live.groupBy("root").agg(F.sum("n").alias("all")).where(F.col("all") > GROUP_TOKENS).select("root"))
    many = large.count()
    if not many:
        return live
    large = sized_broadcast(large, many, BROADCAST_PLANS)

    def drawn(batches):
        for b in batches:
            if not b.num_rows:
                continue
            h, offs = flat(b.column(3))
            bits = pa.array(sketches(np.frombuffer(h.tobytes(), np.uint64), offs // 8), pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], bits], names=["root", "digest", "n", "bits"])

    drawings = durable(live.join(large, "root").select("root", "digest", "n", "tokens").mapInArrow(drawn, "root long, digest long, n long, bits binary"))
    blocks = _blocks(drawings, F.greatest(F.length("bits") / 8, F.lit(SKETCH_LEAST)), SKETCH_WORDS, ["digest", "n", "bits"], percent)

    def group(sets: pa.Array) -> Drawn:
        digest, size, bits = sets.flatten()
        return Drawn(digest.to_numpy(), size.to_numpy(), bits.to_pylist())

    def compared(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                same, one, two = batch.column(0)[k].as_py(), batch.column(1)[k].values, batch.column(2)[k].values
                left = group(one)
                found = near_sketches(left, left if same else group(two), percent, same)
                if found:
                    a, b = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    near = durable(components(blocks.mapInArrow(compared, "a long, b long")).select(F.col("node").alias("digest"), F.col("root").alias("near")))
    inside = live.join(large, "root").join(sized_broadcast(near, near.count(), BROADCAST_SETS), "digest").select(F.col("near").alias("root"), "digest", "n", "tokens")
    return live.join(large, "root", "left_anti").unionByName(inside)


def _links(live: DataFrame, percent: int) -> DataFrame:
    """live: (root, digest, n, tokens binary); the edges (a, b) of each component's links."""
    blocks = _blocks(_narrowed(live, percent), F.col("n"), GROUP_TOKENS, ["digest", "tokens"], percent)

    def group(sets: list[dict]) -> Group:
        return Group(np.array([x["digest"] for x in sets], np.int64), [np.frombuffer(x["tokens"], np.uint64) for x in sets])

    def opened(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                same, one, two = (c[k].as_py() for c in batch.columns)
                left = group(one)
                found = open_groups(left, left if same else group(two), percent, same)
                if found:
                    a, b = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return blocks.mapInArrow(opened, "a long, b long")


def _token_rows(docs: DataFrame, k: int) -> DataFrame:
    """(root, digest, n, tokens) of (root, digest, text), for rows whose text has that digest; once for each in a task."""

    def rows(batches):
        seen: set[int] = set()
        for b in batches:
            for lo, h, offs in sets_of(b.column(2), k):
                got: list[tuple] = []
                named = zip(b.column(0).slice(lo).to_pylist(), b.column(1).slice(lo).to_pylist(), digests(h, offs).tolist(), strict=False)
                for i, (root, digest, own) in enumerate(named):
                    if digest == own and own not in seen:
                        seen.add(own)
                        got.append((root, digest, int(offs[i + 1] - offs[i]), h[offs[i] : offs[i + 1]].tobytes()))
                if len(seen) > 500_000:
                    seen.clear()
                if got:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), kinds, strict=True)], names=["root", "digest", "n", "tokens"])

    return docs.mapInArrow(rows, "root long, digest long, n long, tokens binary")


# ---------------------------------------------------------------- the operator


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    sizes = Sizes(percent)
    held = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    ranges = max(RANGES, -(-(held.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES))
    found = durable(_candidate_rows(_signature_rows(held, k, sizes, ranges), ranges))
    texts = found.where("n >= 0")
    roots = durable(components(found.where("n = -1").select(F.col("digest").alias("a"), F.col("doc_id").alias("b"))).select(F.col("node").alias("digest"), "root"))
    live = roots.count()
    # One text of each live class is read again for its shingles.
    chosen = texts.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(roots, "digest").where("doc_id is not null")
    chosen = durable(chosen.select("doc_id", "digest", "root"))
    again = held.join(sized_broadcast(chosen, live, BROADCAST_SETS), "doc_id").select("root", "digest", "text")
    sets = durable(_token_rows(again, k))
    linked = components(_links(sets, percent)).select(F.col("node").alias("digest"), F.col("root").alias("link"))
    # The smallest id of each class, then of each component of classes; only what is shared needs the table.
    classes = texts.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"))
    classes = durable(classes.join(linked, "digest", "left").where("copies > 1 or link is not null"))
    lows = durable(classes.groupBy(F.coalesce("link", "digest").alias("name")).agg(F.min("low").alias("component")))
    named = durable(classes.withColumn("name", F.coalesce("link", "digest")).join(lows, "name").select("digest", "component"))
    empty = texts.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    full = texts.where("n > 0").join(named, "digest", "left")
    return full.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")).unionByName(empty)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component, the one with the smallest id; rows with a null id stay."""
    found = jaccard_components(docs, id_col, text, k, percent)
    own = "g" + uuid.uuid4().hex  # no column of docs has such a name
    gone = durable(found.where("component_id <> doc_id").select(F.col("doc_id").alias(own)).distinct())
    lost = sized_broadcast(gone, gone.count(), BROADCAST_SETS)
    return docs.join(lost, F.col(f"`{id_col}`") == F.col(own), "left_anti")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s
  FROM d),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS n, b.n AS m, count(*) AS i FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p WHERE 100 * i >= 85 * (n + m - i)),
u AS (SELECT x AS a, y AS b FROM e UNION SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS node FROM s UNION SELECT r.doc_id, u.b FROM r JOIN u ON r.node = u.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.component_id
FROM s JOIN (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id) m ON s.doc_id = m.doc_id
"""
