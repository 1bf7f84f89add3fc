"""Prefix trie of conversations by vertical bitmaps: what equal beginnings would save, node by node.

A node is a distinct sequence of first turns (role and text). Conversations are cut into segments, segments that begin
alike come into one shard, and a shard indexes (position, turn) to the bitset of its segments. Going down, the bitset of
a node is intersected with the postings of its members' next turns: that gives the children, their numbers of members by
popcount, and the lists of conversations that end there. Paths of a single member need no bitset and are laid out as they
are. Shards are merged by the nodes' keys, 120-bit hashes that add up along the path.

Sums over subtrees need no walk along ancestors. Every node belongs to its smallest member; a conversation c owns its
nodes from a depth t(c) on. So each member of a node that doesn't own it shares with a smaller one exactly the words
between this node and its own first one, and a childless node is counted by its owner. A second pass over the shards adds
that up.

Defined results: rows without a conversation are left out. Turns are ordered by turn, null first; equal turns by the
MD5 of role and text, and repeated rows are turns of their own. Null role and text are empty. A conversation without
turns ends at the root. Long texts go only through their digest and word count, in the scan; 24 bytes a turn are shuffled.
A conversation's digests pass through one task in order, `SEGMENT` at a time, and its segments are separate rows, so
none is held whole. `%` is Spark's, so negative numbers go towards 0. An empty table has no node. Only the named columns are read, so others don't matter.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.llm.common import WORD_RE, durable, flat, mix, small_batches, table

#: Turns of one segment at most.
SEGMENT = 1024
#: Segments and turns of one shard at most: bitsets of 256 bytes.
SHARD, SHARD_TURNS = 2048, 200_000
#: Conversations c of the query begin with up to HEADS - 1 turns of conversation c - c % GROUP.
GROUP, HEADS = 20, 4

MASK = np.uint64((1 << 60) - 1)
STEP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
NEVER = 2**62


def turn_rows(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, digest, words) of every turn."""
    r, t = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    digest = F.unhex(F.md5(F.concat(F.length(r).cast("string"), F.lit(":"), r, t)))
    return df.where(F.col(f"`{conv_id}`").isNotNull()).select(
        F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), digest.alias("digest"), F.regexp_count(t, F.lit(WORD_RE)).cast("long").alias("words")
    )


def lanes(rec: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """What each turn at its depth adds to the key of its path: two numbers of 60 bits."""
    d = depth.astype(np.uint64)
    return np.stack([mix(rec[:, k].view(np.uint64) + d * STEP[k]) & MASK for k in (0, 1)], axis=1)


def added_up(start: np.ndarray, steps: np.ndarray) -> np.ndarray:
    return (start + np.cumsum(steps, axis=0, dtype=np.uint64)) & MASK


SEGMENTS = pa.schema([
    *[(c, pa.int64()) for c in ("conv_id", "depth", "k1", "k2", "words")], ("last", pa.bool_()), ("turns", pa.binary()),
    *[(c, pa.int64()) for c in ("f1", "f2", "f3", "full")], ("total", pa.int64()),
])
SEGMENTS_DDL = "conv_id long, depth long, k1 long, k2 long, words long, last boolean, turns binary, f1 long, f2 long, f3 long, full long, total long"


def segments(turns: DataFrame, group: int | None = None, heads: int = HEADS) -> DataFrame:
    """The conversations in segments: key and words of the path before, and 24 bytes a turn.

    With a group, conversation c begins with the first h turns of conversation c - c % group, then has its own from the
    h-th on, where h is the CRC-32 of its decimal number modulo heads. The conversation that lends them comes first.
    """
    base = F.col("conv_id") - F.col("conv_id") % F.lit(group) if group else F.col("conv_id")
    held = turns.withColumn("base", base).withColumn("own", F.col("base") != F.col("conv_id")).repartition("base")
    held = held.sortWithinPartitions("base", "own", "conv_id", F.asc_nulls_first("turn"), "digest").select("base", "conv_id", "digest", "words")

    def rebuild(batches):
        out: list[list] = []
        none = np.zeros((0, 3), np.int64)
        now, lender, head, seen, buffer, depth, key, words, skip = None, None, none, 0, [], 0, np.zeros(2, np.uint64), 0, 0

        def emit(last: bool):
            nonlocal buffer, depth, key, words
            rec = np.concatenate(buffer) if buffer else none
            path = added_up(key, lanes(rec, depth + 1 + np.arange(len(rec)))) if len(rec) else np.zeros((0, 2), np.uint64)
            first = [int(path[j, 0]) if j < len(path) else -1 for j in range(3)]
            end = path[-1] if len(path) else key
            total = words + int(rec[:, 2].sum())
            out.append([now, depth, int(key[0]), int(key[1]), words, last, rec.tobytes(), *first, int(end[0]), total])
            buffer, depth, key, words = [], depth + len(rec), end, total

        def put(rec: np.ndarray):
            nonlocal buffer
            while len(rec):
                room = SEGMENT - sum(map(len, buffer))
                if not room:
                    emit(False)
                    continue
                buffer.append(rec[:room])
                rec = rec[room:]

        for batch in batches:
            ids = batch.column(1).to_numpy(zero_copy_only=False)
            bases = batch.column(0).to_numpy(zero_copy_only=False)
            rec = np.empty((len(ids), 3), np.int64)
            rec[:, :2] = flat(batch.column(2))[0].view(np.int64).reshape(-1, 2)
            rec[:, 2] = batch.column(3).to_numpy(zero_copy_only=False)
            for lo, hi in zip(at := np.r_[0, np.flatnonzero(ids[1:] != ids[:-1]) + 1], [*at[1:], len(ids)], strict=True):
                c, b = int(ids[lo]), int(bases[lo])
                if c != now:
                    if now is not None:
                        emit(True)
                    now, seen, buffer, depth, key, words, skip = c, 0, [], 0, np.zeros(2, np.uint64), 0, 0
                    if b != lender:
                        lender, head = b, none
                    if group and c != b:
                        skip = zlib.crc32(str(c).encode()) % heads
                        put(head[:skip])
                mine = rec[lo:hi]
                if group and c == b and len(head) < heads - 1:
                    head = np.concatenate([head, mine[: heads - 1 - len(head)]])
                put(mine[max(0, skip - seen) :])
                seen += hi - lo
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), SEGMENTS, strict=True)], schema=SEGMENTS)
                out = []
        if now is not None:
            emit(True)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), SEGMENTS, strict=True)], schema=SEGMENTS)

    return held.mapInArrow(rebuild, SEGMENTS_DDL)


class Shard:
    """Segments of one shard with their vertical index."""

    def __init__(self, batch: pa.Table):
        batch = batch.sort_by("conv_id")  # so the lowest bit of a bitset is its smallest conversation
        col = lambda c: batch.column(c).to_numpy()
        self.ids, self.depth, self.words, self.last = col("conv_id"), col("depth"), col("words"), col("last")
        self.start = np.stack([col("k1"), col("k2")], axis=1).astype(np.uint64)
        buf, offs = flat(batch.column("turns"))
        rec = np.frombuffer(buf.tobytes(), np.int64).reshape(-1, 3)
        self.offs = offs // 24
        self.n = len(self.ids)
        lens = np.diff(self.offs)
        self.end = self.depth + lens
        unit = np.repeat(np.arange(self.n), lens)
        self.at = self.depth[unit] + 1 + np.arange(len(rec)) - self.offs[unit]  # the depth of every turn
        steps = lanes(rec, self.at)
        sums = np.vstack([np.zeros((1, 2), np.uint64), np.cumsum(steps, axis=0, dtype=np.uint64)])
        self.path = (self.start[unit] + sums[1:] - sums[self.offs[unit]]) & MASK
        before = np.r_[0, np.cumsum(rec[:, 2])]
        self.before = self.words[unit] + before[:-1] - before[self.offs[unit]]  # words of the path above every turn
        # Postings: only those of several segments need a bitset.
        named = np.stack([rec[:, 0], rec[:, 1], self.at], axis=1)
        self.posting, counts = (np.unique(named, axis=0, return_inverse=True, return_counts=True)[1:]) if len(rec) else (np.zeros(0, int), np.zeros(0, int))
        self.posting = self.posting.ravel()
        self.shared = counts > 1
        self.bits: dict[int, int] = defaultdict(int)
        for t in np.flatnonzero(self.shared[self.posting]).tolist():
            self.bits[int(self.posting[t])] |= 1 << int(unit[t])

    def walk(self):
        """((segment, depth, bitset) of nodes with several members or none above them, (segment, depth) of paths of one)."""
        stops: dict[int, int] = defaultdict(int)
        roots: dict[tuple, int] = defaultdict(int)
        for u in range(self.n):
            stops[int(self.end[u])] |= 1 << u
            roots[int(self.depth[u]), int(self.start[u, 0]), int(self.start[u, 1])] |= 1 << u
        low = lambda b: (b & -b).bit_length() - 1
        nodes, single, stack = [], [], []
        for (d, *_), b in roots.items():
            if d == 0:
                nodes.append((low(b), 0, b))
            stack.append((d, b))
        while stack:
            d, b = stack.pop()
            rest = b & ~stops.get(d, 0)
            while rest:
                u = low(rest)
                p = int(self.posting[self.offs[u] + d - self.depth[u]])
                child = b & self.bits[p] if self.shared[p] else 1 << u
                rest &= ~child
                if child.bit_count() == 1:
                    single.append((u, d + 1))
                else:
                    nodes.append((u, d + 1, child))
                    stack.append((d + 1, child))
        return nodes, np.array(single, np.int64).reshape(-1, 2)

    def members(self, bits: int) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes((self.n + 7) // 8, "little"), np.uint8), bitorder="little"))

    def keys(self, u: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key, parent's key and words above for the nodes of segments at depths above their start, or at the root."""
        root = d == 0
        t = np.where(root, 0, self.offs[u] + d - self.depth[u] - 1)
        if not len(self.path):
            return np.zeros((len(u), 2), np.int64), np.zeros((len(u), 2), np.int64), np.zeros(len(u), np.int64)
        key = np.where(root[:, None], np.uint64(0), self.path[t])
        first = root | (d == self.depth[u] + 1)
        above = np.where(root[:, None], np.uint64(0), np.where(first[:, None], self.start[u], self.path[np.maximum(t - 1, 0)]))
        return key.astype(np.int64), above.astype(np.int64), np.where(root, 0, self.before[t])


def shards(batches, columns: list[str]):
    """Tables of at most SHARD segments and about SHARD_TURNS turns, in the order of the rows."""
    held, rows, turns = [], 0, 0
    for batch in batches:
        sizes = np.diff(flat(batch.column(columns.index("turns")))[1]) // 24 + 1
        lo = 0
        while lo < len(sizes):
            room = int(np.searchsorted(np.cumsum(sizes[lo:]), SHARD_TURNS - turns, "right"))
            take = min(len(sizes) - lo, SHARD - rows, max(room, 0 if rows else 1))
            if take:
                part = batch.slice(lo, take)
                held.append(part)
                rows, turns, lo = rows + take, turns + int(sizes[lo : lo + take].sum()), lo + take
            if lo < len(sizes):
                yield pa.Table.from_batches(held)
                held, rows, turns = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _dealt(units: DataFrame) -> DataFrame:
    """Segments that begin alike side by side; those of one hot beginning are dealt by their further turns and numbers."""
    by = ["depth", "k1", "f1", "f2", "f3", "full", "conv_id"]
    return units.repartitionByRange(*by).sortWithinPartitions(*by)


NODES_DDL = "k1 long, k2 long, p1 long, p2 long, depth long, n_convs long, conv_id long, before long, first_end long, ends string"


def shard_nodes(units: DataFrame) -> DataFrame:
    """A row for every node of every shard: its members there, and the ends among them as a list in one string."""
    columns = units.columns
    schema = pa.schema([(c, pa.string() if c == "ends" else pa.int64()) for c in [x.split()[0] for x in NODES_DDL.split(", ")]])

    def run(batches):
        for t in shards(batches, columns):
            s = Shard(t)
            nodes, single = s.walk()
            lasts: dict[int, int] = defaultdict(int)
            for u in np.flatnonzero(s.last).tolist():
                lasts[int(s.end[u])] |= 1 << u
            if nodes:
                u, d = np.array([x[0] for x in nodes]), np.array([x[1] for x in nodes])
                ends = [s.ids[s.members(e)] if (e := b & lasts.get(x, 0)) else None for _, x, b in nodes]
                yield batch(s, u, d, [b.bit_count() for *_, b in nodes], [None if e is None else int(e[0]) for e in ends], [None if e is None else ",".join(map(str, e.tolist())) for e in ends])
            if len(single):
                n = s.end[single[:, 0]] - single[:, 1] + 1
                u = np.repeat(single[:, 0], n)
                d = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(single[:, 1], n)
                for lo in range(0, len(u), 50_000):
                    v, w = u[lo : lo + 50_000], d[lo : lo + 50_000]
                    over = s.last[v] & (s.end[v] == w)
                    own = [int(i) if o else None for i, o in zip(s.ids[v], over, strict=True)]
                    yield batch(s, v, w, np.ones(len(v), np.int64), own, [None if i is None else str(i) for i in own])

    def batch(s, u, d, n, first, ends):
        key, above, before = s.keys(u, d)
        cols = [key[:, 0], key[:, 1], above[:, 0], above[:, 1], d, n, s.ids[u], before, first, ends]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return _dealt(units).mapInArrow(run, NODES_DDL)


SUMS_DDL = "k1 long, k2 long, saved_tokens long, n_leaves long"


def shard_sums(units: DataFrame) -> DataFrame:
    """(key, saved words, childless nodes) by shard, of nodes that several conversations share.

    units have of their conversation: own (the depth of the first node it owns), shared (its words above), leaf (whether
    its end is childless and its own) and deepest (the depth of its last node with several members).
    """
    columns = units.columns
    schema = pa.schema([(x.split()[0], pa.int64()) for x in SUMS_DDL.split(", ")])

    def run(batches):
        for t in shards(batches, columns):
            s = Shard(t)
            t = t.sort_by("conv_id")
            own, shared, leaf, deepest = (t.column(c).to_numpy() for c in ("own", "shared", "leaf", "deepest"))
            nodes, single = s.walk()
            if nodes:
                u, d = np.array([x[0] for x in nodes]), np.array([x[1] for x in nodes])
                key, _, before = s.keys(u, d)
                saved, leaves = np.zeros(len(u), np.int64), np.zeros(len(u), np.int64)
                for j, (_, x, b) in enumerate(nodes):
                    m = s.members(b)
                    other = m[own[m] > x]
                    saved[j], leaves[j] = shared[other].sum() - len(other) * before[j], leaf[m].sum()
                yield batch(key, saved, leaves)
            if len(single):
                n = np.maximum(np.minimum(s.end[single[:, 0]], deepest[single[:, 0]]) - single[:, 1] + 1, 0)
                u = np.repeat(single[:, 0], n)
                d = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(single[:, 1], n)
                if len(u):
                    key, _, before = s.keys(u, d)
                    yield batch(key, np.where(own[u] > d, shared[u] - before, 0), leaf[u])

    def batch(key, saved, leaves):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (key[:, 0], key[:, 1], saved, leaves)], schema=schema)

    return _dealt(units).mapInArrow(run, SUMS_DDL)


def ends_digests(nodes: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256): the lists of the shards follow each other in the order of their first number.

    Conversations that end at one node are equal, so the shards, dealt by path and number, have disjoint ranges of them.
    A digest is fed list by list; no task holds more than one.
    """
    lists = nodes.where("ends is not null").select("k1", "k2", "first_end", "ends").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first_end")
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])

    def digest(batches):
        held, sha = None, None
        for b in batches:
            out = []
            for k1, k2, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                if (k1, k2) == held:
                    sha.update(b"," + text.encode())
                    continue
                if held:
                    out.append((*held, sha.hexdigest()))
                held, sha = (k1, k2), hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], f.type) for j, f in enumerate(schema)], schema=schema)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*held, sha.hexdigest()), schema, strict=True)], schema=schema)

    return lists.mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")


def trie(units: DataFrame) -> DataFrame:
    """A row per node of the conversations in segments."""
    units = durable(units)
    found = durable(shard_nodes(units))
    merged = found.groupBy("k1", "k2").agg(F.min("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("before").alias("before"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    merged = durable(merged)
    below = merged.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = durable(merged.join(below, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    owned = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("own"), F.min("before").alias("shared"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"),
        F.coalesce(F.max(F.when(F.col("n_convs") > 1, F.col("depth"))), F.min("depth") - 1).alias("deepest"),
    )
    # A conversation without nodes of its own shares all its words.
    each = units.where("last").select("conv_id", "total").join(owned, "conv_id", "left").select(
        "conv_id", F.coalesce("own", F.lit(NEVER)).alias("own"), F.coalesce("shared", "total").alias("shared"),
        F.coalesce("leaf", F.lit(0).cast("long")).alias("leaf"), F.coalesce("deepest", F.lit(NEVER)).alias("deepest"),
    )
    sums = shard_sums(durable(units.drop("total").join(each, "conv_id"))).groupBy("k1", "k2").agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    nothing = hashlib.sha256(b"").hexdigest()
    out = nodes.join(sums, ["k1", "k2"], "left").join(ends_digests(found), ["k1", "k2"], "left")
    root, one = F.col("depth") == 0, F.lit(1).cast("long")
    return out.join(parents, ["p1", "p2"], "left").select(
        "conv_id", "depth", F.when(~root, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children",
        # A node of one conversation has one end below it and saves nothing.
        F.when(F.col("n_convs") > 1, F.col("n_leaves")).otherwise(one).alias("n_leaves"),
        F.when(F.col("n_convs") > 1, F.col("saved_tokens")).otherwise(F.lit(0).cast("long")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )


def prefix_trie(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", group: int | None = None) -> DataFrame:
    """The trie of the conversations as they are, or with the heads that segments() describes."""
    small_batches(df.sparkSession)
    return trie(segments(turn_rows(df, conv_id, turn, role, text), group))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of rebuilt conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"), group=GROUP)


#: Fixed value: the reversed polynomial of CRC-32.
_CRC = 0xEDB88320
ORACLE = rf"""
WITH t AS (
  SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS h,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS w
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, h, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, h) AS pos FROM t),
i AS (SELECT DISTINCT conv_id, conv_id - conv_id % {GROUP} AS b, conv_id::VARCHAR AS name FROM t),
c AS (
  SELECT conv_id, b, xor(4294967295, list_reduce(range(8 * length(name)), lambda a, x:
           xor(xor(a, CASE WHEN x % 8 = 0 THEN ascii(name[x // 8 + 1]) ELSE 0 END) // 2,
               {_CRC} * (xor(a, CASE WHEN x % 8 = 0 THEN ascii(name[x // 8 + 1]) ELSE 0 END) % 2)), 4294967295::BIGINT)) % {HEADS} AS k
  FROM i),
p AS (SELECT c.conv_id, o.pos AS d, h, w FROM c JOIN o ON o.conv_id = c.b AND o.pos <= c.k),
l AS (SELECT c.conv_id, any_value(k) AS k, count(d) AS m FROM c LEFT JOIN p USING (conv_id) GROUP BY c.conv_id),
q AS (SELECT * FROM p UNION ALL SELECT conv_id, m + pos - k AS d, h, w FROM o JOIN l USING (conv_id) WHERE pos > k),
e AS (
  SELECT conv_id, d, w, string_agg(h, '') OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS path FROM q
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
z AS (SELECT conv_id, max(d) AS deepest FROM e GROUP BY conv_id),
n AS (
  SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE deepest = d), '')) AS ends_sha256
  FROM e JOIN z USING (conv_id) GROUP BY path, d),
k AS (SELECT left(path, length(path) - 32) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
s AS (
  SELECT e.path, sum((n_convs - 1) * v.w) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM v JOIN e ON e.conv_id = v.conv_id AND e.d <= v.depth GROUP BY e.path)
SELECT v.conv_id, v.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, v.n_convs::BIGINT AS n_convs, v.n_children::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM v JOIN s USING (path) LEFT JOIN n u ON v.depth > 0 AND u.path = left(v.path, length(v.path) - 32)
"""
