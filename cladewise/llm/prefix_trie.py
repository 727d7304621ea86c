"""Conversation prefix trie: double-array tries of prefix shards, merged where they meet.

1. Turns become narrow rows (conversation, turn, digest of role and text, code
   points); texts do not move. Each conversation is rebuilt as one path: the
   digests of its turns in order, 20 bytes each.
2. Conversations of one path are one entry: its members' ids are sorted and
   hashed in a stream, whatever their number.
3. Distinct paths are range-partitioned, so every shard holds a contiguous run of
   them in byte order. A node can be in two shards only if it lies on the paths at
   their border, down to the common prefix of these.
4. In its shard a path is spelled in dense turn ids; BASE and CHECK arrays are
   packed over them, and walking every path through the arrays gives the nodes
   (slots), whose CHECK is their parent.
5. Nodes of one shard are complete. Of a node that several shards share each
   gives its part, and the parts add up: a node (as a child, and its turn's
   length) belongs to the first shard that holds it.

Defined results: null role and text become empty. Turns are ordered by turn (null
first), equal turns by the digest of role and text, so repeated rows are turns of
their own. Rows with a null conv_id belong to no conversation and make no member.
No conversation at all gives the root alone, with null conv_id, no members and,
as it has no children, one leaf. Extra columns are ignored. The narrow rows of one
conversation (28 bytes a turn) meet in one task; very long texts are only hashed.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cladewise.session import written

#: Bytes of a turn's digest in a path.
WIDTH = 20
#: Turns of distinct paths that a shard holds, about.
SHARD_TURNS = 20_000
#: Ids in one row while members of equal paths are gathered.
RUN = 1 << 13

#: crc32 of the decimal conv_id, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: [CAST(ascii(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)), 4294967295)"
ORACLE = f"""WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'d': sha256(concat(strlen(role), ':', role, text)), 'n': length(text)}} ORDER BY turn NULLS FIRST, sha256(concat(strlen(role), ':', role, text))) AS l FROM t GROUP BY conv_id),
hh AS (SELECT conv_id, l, {_CRC} % 6 AS h FROM o),
c AS (SELECT a.conv_id, CASE WHEN a.h > 0 THEN coalesce(b.l, [])[1:a.h] ELSE [] END || a.l[a.h + 1:] AS l FROM hh a LEFT JOIN o b ON b.conv_id = a.conv_id - a.conv_id % 100),
s AS (SELECT conv_id, l, 0 AS d, '' AS k, CAST(NULL AS VARCHAR) AS up, 0 AS n FROM c UNION ALL SELECT conv_id, l, d + 1, sha256(k || l[d + 1].d), k, l[d + 1].n FROM s WHERE d < len(l)),
v AS (SELECT k, up, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n, string_agg(CASE WHEN d = len(l) THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends FROM s GROUP BY k, up, d
  UNION ALL SELECT '', NULL, 0, NULL, 0, 0, NULL WHERE NOT EXISTS (SELECT 1 FROM c)),
kids AS (SELECT up AS k, count(*) AS n_children FROM v WHERE up IS NOT NULL GROUP BY up),
x AS (SELECT v.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * n AS saves FROM v LEFT JOIN kids USING (k)),
anc AS (SELECT k AS top, up AS next, n_children, saves FROM (SELECT k, k AS up, n_children, saves FROM x)
  UNION ALL SELECT x.up, x.up, a.n_children, a.saves FROM anc a JOIN x ON x.k = a.next WHERE x.up IS NOT NULL),
sums AS (SELECT top AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum(saves) AS saved FROM anc GROUP BY top)
SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, CASE WHEN x.n_convs = 0 THEN 0 ELSE saved END AS saved_tokens, sha256(coalesce(x.ends, '')) AS ends_sha256
FROM x JOIN sums USING (k) LEFT JOIN v p ON p.k = x.up"""

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(conversations: DataFrame, block: int = 100, spread: int = 6) -> DataFrame:
    """conv_id, path (hex digests in one binary), lens (code points of each turn).

    The first h turns come from the conversation conv_id - conv_id % block, with
    h = crc32(conv_id in decimal) % spread.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)
    turns = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(F.col("turn").alias("turn"), digest.alias("digest"), F.char_length(text).cast("bigint").alias("len")).alias("t"))
    whole = written(turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")), "conversations")
    heads = whole.filter(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, spread - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % spread).cast("int")
    j = whole.withColumn("base", F.col("conv_id") - F.col("conv_id") % block).join(heads, "base", "left").withColumn("h", h)
    none = F.slice("turns", 1, 0)
    both = F.concat(F.when(F.col("h") > 0, F.slice(F.coalesce("head", none), 1, F.greatest("h", F.lit(1)))).otherwise(none), F.slice("turns", F.col("h") + 1, F.size("turns")))
    j = j.select("conv_id", both.alias("turns"))
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    return j.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["len"]).alias("lens"))


def members(convs: DataFrame) -> DataFrame:
    """Per distinct path (key: its hash): n, first (least conv_id), ends_sha256 of its members' ids.

    Ids of one path are brought in order by a range shuffle, packed into rows of
    up to RUN ids, and hashed one row after the other; no group is held whole.
    """
    ids = convs.select(F.sha2("path", 256).alias("key"), "conv_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column("key").to_pylist(), np.asarray(batch.column("conv_id"))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            cuts = [a for lo, hi in zip(cuts, cuts[1:]) for a in range(lo, hi, RUN)] + [len(keys)]
            out = [(keys[a], int(ids[a]), b - a, ids[a:b].tobytes()) for a, b in zip(cuts, cuts[1:]) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.binary()))], names=["key", "first", "n", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            done = []
            for key, first, n, ids in zip(*(batch.column(c).to_pylist() for c in ("key", "first", "n", "ids"))):
                text = ",".join(map(str, np.frombuffer(ids, np.int64).tolist()))
                if state and state[0] == key:
                    state[2] += n
                    state[3].update(f",{text}".encode())
                else:
                    if state:
                        done.append((*state[:3], state[3].hexdigest()))
                    state = [key, first, n, hashlib.sha256(text.encode())]
            if done:
                yield _rows(done)
        if state:
            yield _rows([(*state[:3], state[3].hexdigest())])

    def _rows(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["key", "first", "n", "ends_sha256"])

    runs = ids.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(pack, "key string, first bigint, n bigint, ids binary")
    return runs.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digest, "key string, first bigint, n bigint, ends_sha256 string")


class DoubleArray:
    """A trie over dense symbols 1..m: from slot s, symbol c leads to t = base[s] + c if check[t] == s. The root is slot 0."""

    def __init__(self, flat: np.ndarray, offs: np.ndarray):
        """flat, offs: sorted paths as symbols, one after the other."""
        self.base, self.check = np.zeros(64, np.int64), np.full(64, -1, np.int64)
        self.check[0] = 0
        self.free = 1
        self.end = 1
        todo = deque([(0, 0, len(offs) - 1, 0)])
        lens = np.diff(offs)
        while todo:
            s, lo, hi, depth = todo.popleft()
            while lo < hi and lens[lo] <= depth:
                lo += 1  # the one path that ends here
            if lo == hi:
                continue
            if hi - lo == 1:
                cuts, symbols = [lo, hi], flat[offs[lo] + depth : offs[lo] + depth + 1]
            else:
                at = flat[offs[lo:hi] + depth]
                heads = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                cuts, symbols = [*(heads + lo).tolist(), hi], at[heads]
            slots = self._place(s, symbols)
            todo += [(t, a, b, depth + 1) for t, a, b in zip(slots, cuts, cuts[1:])]

    def _place(self, s: int, symbols: np.ndarray) -> list[int]:
        """Find the first base for which all children's slots are free, and take them."""
        low = int(symbols.min())
        gaps = symbols - low
        if len(gaps) == 1 and self.free < len(self.check):
            t = self.free
            self.base[s], self.check[t] = t - low, s
            self.end = max(self.end, t + 1)
            self._to_next()
            return [t]
        reach, at = int(gaps.max()) + 1, self.free
        while True:
            while len(self.check) < at + 64 + reach:
                self.base = np.r_[self.base, np.zeros(len(self.base), np.int64)]
                self.check = np.r_[self.check, np.full(len(self.check), -1, np.int64)]
            near = np.flatnonzero(self.check[at : at + 64] < 0) + at
            if len(gaps) > 1:
                near = near[(self.check[near[:, None] + gaps] < 0).all(axis=1)]
            if len(near):
                break
            at += 64
        first = int(near[0])
        slots = first + gaps
        self.base[s] = first - low
        self.check[slots] = s
        self.end = max(self.end, int(slots.max()) + 1)
        self._to_next()
        return slots.tolist()

    def _to_next(self) -> None:
        while self.free < len(self.check) and self.check[self.free] >= 0:
            self.free += 1

    def step(self, s: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The children of slots s by symbols c; -1 where there is none."""
        t = self.base[s] + c
        ok = (t > 0) & (t < len(self.check))
        ok[ok] = self.check[t[ok]] == s[ok]
        return np.where(ok, t, -1)


def shard_nodes(paths: list[bytes], lens: list[np.ndarray], n: np.ndarray, first: np.ndarray, ends: list[str], before: int, after: int) -> dict[str, list]:
    """Nodes of one shard of distinct paths, by a double-array trie.

    before, after: how many turns the shard's first and last path share with the
    shard before and after. Of shared nodes (``key``: the hash of their path) the
    figures are this shard's part; ``up`` is the shared parent's place, as its
    depth, negative for the side of the last path.
    """
    order = sorted(range(len(paths)), key=paths.__getitem__)
    paths, lens, ends = [paths[i] for i in order], [lens[i] for i in order], [ends[i] for i in order]
    n, first = n[order], first[order]
    counts = np.array([len(p) // WIDTH for p in paths], np.int64)
    offs = np.zeros(len(paths) + 1, np.int64)
    np.cumsum(counts, out=offs[1:])
    digests = np.frombuffer(b"".join(paths), np.dtype((np.void, WIDTH)))
    # Dense ids by first place, level after level, so that ids of siblings are near.
    depth_of = np.arange(offs[-1]) - np.repeat(offs[:-1], counts)
    _, firsts, flat = np.unique(digests, return_index=True, return_inverse=True)
    rank = np.empty(len(firsts), np.int64)
    rank[np.lexsort((firsts, depth_of[firsts]))] = np.arange(1, len(firsts) + 1)
    flat = rank[flat.ravel()] if len(firsts) else np.zeros(0, np.int64)
    # Sorted by bytes; the arrays only ask that equal prefixes are neighbours.
    trie = DoubleArray(flat, offs)
    size = trie.end
    length = np.concatenate(lens).astype(np.int64) if len(lens) else np.zeros(0, np.int64)

    big = np.iinfo(np.int64).max
    n_convs, least, depth, turn_len = np.zeros(size, np.int64), np.full(size, big), np.full(size, -1, np.int64), np.zeros(size, np.int64)
    path_end: dict[int, str] = {}
    live, s, d = np.arange(len(paths)), np.zeros(len(paths), np.int64), 0
    sample = np.zeros(size, np.int64)
    while len(live):
        np.add.at(n_convs, s, n[live])
        np.minimum.at(least, s, first[live])
        depth[s], sample[s] = d, live
        stop = counts[live] == d
        for i, t in zip(live[stop].tolist(), s[stop].tolist()):
            path_end[t] = ends[i]
        live, s = live[~stop], s[~stop]
        at = offs[live] + d
        s = trie.step(s, flat[at])
        turn_len[s] = length[at]
        d += 1
    used = np.flatnonzero(depth >= 0)
    parent = trie.check[:size].copy()

    # Shared nodes: along the first and the last path, as far as the neighbours go with them.
    shared, own = np.zeros(size, bool), np.ones(size, bool)
    side = np.zeros(size, np.int64)
    for i, upto, sign in ((0, before, 1), (len(paths) - 1, after, -1)):
        t = np.zeros(1, np.int64)
        for k in range(upto + 1 if upto >= 0 else 0):
            if k:
                t = trie.step(t, flat[offs[i] + k - 1 : offs[i] + k])
            shared[t] = True
            side[t] = sign * (k + 1) if side[t] == 0 else side[t]
            own[t] = own[t] & (sign < 0)
    children, leaves, saved = np.zeros(size, np.int64), np.zeros(size, np.int64), n_convs * turn_len - turn_len * own
    by_depth = used[np.argsort(-depth[used], kind="stable")]
    bounds = np.flatnonzero(np.r_[True, np.diff(depth[by_depth]) != 0, True])
    has = np.zeros(size, bool)
    for a, b in zip(bounds, bounds[1:]):
        level = by_depth[a:b]
        leaves[level] += ~has[level] & ~shared[level]  # several paths meet in a shared node, so one goes on
        if depth[level[0]]:
            up = parent[level]
            has[up] = True
            np.add.at(children, up, own[level])
            np.add.at(leaves, up, leaves[level])
            np.add.at(saved, up, saved[level])
    none = hashlib.sha256(b"").hexdigest()
    keys = [hashlib.sha256(paths[int(sample[t])][: int(depth[t]) * WIDTH]).digest() if shared[t] else None for t in used]
    up = parent[used]
    top = depth[used] == 0
    return {
        "key": keys,
        "side": [int(side[t]) if shared[t] else None for t in used],
        "up": [None if r else int(side[p]) if shared[p] else None for p, r in zip(up, top)],
        "conv_id": least[used].tolist(),
        "depth": depth[used].tolist(),
        "parent_conv_id": [None if r else int(least[p]) for p, r in zip(up, top)],
        "n_convs": n_convs[used].tolist(),
        "n_children": children[used].tolist(),
        "n_leaves": leaves[used].tolist(),
        "saved_tokens": saved[used].tolist(),
        "ends_sha256": [path_end.get(t, None if shared[t] else none) for t in used.tolist()],
    }


_NODE = pa.schema(
    [("part", pa.int32()), ("key", pa.binary()), ("side", pa.int64()), ("up", pa.int64()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64())]
    + [(c, pa.int64()) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends_sha256", pa.string())]
)


def _common(a: str, b: str) -> F.Column:
    """Turns at the start of both paths; -1 where one is missing."""

    def piece(c: str, i: F.Column) -> F.Column:
        return F.col(c).substr(i * WIDTH + 1, F.lit(WIDTH))

    most = F.least(F.octet_length(a), F.octet_length(b)) / WIDTH
    both = F.aggregate(F.sequence(F.lit(0), most.cast("int")), F.lit(0), lambda k, i: k + F.when((k == i) & (i < most) & (piece(a, i) == piece(b, i)), 1).otherwise(0))
    return F.when(F.col(a).isNull() | F.col(b).isNull(), -1).otherwise(both)


def prefix_nodes(conversations: DataFrame, block: int = 100, spread: int = 6, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations, with COLUMNS."""
    spark = conversations.sparkSession
    convs = written(rebuilt(conversations, block, spread), "rebuilt")
    groups = members(convs)
    # One conversation of each path, the one with the least id, carries the path on.
    distinct = convs.join(groups.withColumnRenamed("first", "conv_id"), "conv_id").drop("key")
    total = convs.agg(F.sum(F.size("lens")).alias("turns"), F.count("*").alias("n")).first()
    if not total.n:
        none = [(None, 0, None, 0, 0, 1, 0, hashlib.sha256(b"").hexdigest())]
        return spark.createDataFrame(none, "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string")
    shards = max(1, -(-(total.turns or 0) // shard_turns))
    paths = written(distinct.repartitionByRange(shards, "path").withColumn("part", F.spark_partition_id()), "paths")
    # One row per shard: its first and last path, and how far they go with the neighbours'.
    edges = paths.groupBy("part").agg(F.min("path").alias("lo"), F.max("path").alias("hi"))
    w = W.orderBy("part")
    edges = edges.select("part", "lo", "hi", F.lag("hi").over(w).alias("last"), F.lead("lo").over(w).alias("next"))
    edges = edges.select("part", _common("lo", "last").alias("before"), _common("hi", "next").alias("after"))

    def nodes(table: pa.Table) -> pa.Table:
        c = {k: table.column(k).combine_chunks() for k in table.column_names}
        got = shard_nodes(c["path"].to_pylist(), [np.asarray(x, np.int64) for x in c["lens"].to_pylist()], np.asarray(c["n"]), np.asarray(c["conv_id"]), c["ends_sha256"].to_pylist(), c["before"][0].as_py(), c["after"][0].as_py())
        return pa.table({"part": [c["part"][0].as_py()] * len(got["depth"]), **got}, schema=_NODE)

    kinds = {pa.int32(): "int", pa.int64(): "bigint", pa.binary(): "binary", pa.string(): "string"}
    found = paths.join(edges, "part").groupBy("part").applyInArrow(nodes, ", ".join(f"{f.name} {kinds[f.type]}" for f in _NODE))
    found = written(found, "trie-nodes")
    parts = found.filter("key IS NOT NULL")
    add = [F.sum(c).cast("bigint").alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    upper = written(parts.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), *add, F.coalesce(F.max("ends_sha256"), F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")), "upper-nodes")
    # Where a shard's shared nodes are, with their conv_id of all shards: the parents of what hangs from them.
    above = parts.join(upper.select("key", F.col("conv_id").alias("least")), "key").select("part", F.col("side").alias("up"), "least")
    placed = found.join(above, ["part", "up"], "left").withColumn("parent_conv_id", F.coalesce("least", "parent_conv_id"))
    own = placed.filter("key IS NULL").select(*COLUMNS)
    # All shards that hold a shared node have the same parent for it.
    parents = placed.filter("key IS NOT NULL").groupBy("key").agg(F.min("parent_conv_id").alias("parent_conv_id"))
    return own.unionByName(upper.join(parents, "key").select(*COLUMNS))
