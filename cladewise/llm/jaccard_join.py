"""N-gram Jaccard join: a grouped prefix join on word shingles.

A document's set holds its distinct 5-word shingles (A-Z lower-cased; with
fewer words, the whole sequence). Sets with 100 * intersection >= 75 * union
are linked; the result is each document's connected component.

The global order of shingles is: by a weight, which is 0 but for very frequent
ones (a count of all shingles in a table of fixed size), then by hash. The
prefix of a set of n shingles is its first n - ceil(0.75 n) + l(n), with
l(n) = 1 + n // 32. Of two linked sets, all common shingles up to the end of the
prefix that ends first are in both prefixes, and at most ceil(0.75 n) - l(n)
common ones are behind it; so they share l(n) prefix shingles, n being the
smaller set's or at least 0.75 times the other's.

1. Equal sets count once; sets with the same prefix and size form one group.
2. Prefix shingles of the groups are brought together. A group lives on if at
   least l(0.75 n) of its prefix shingles stand in another group's prefix (very
   frequent ones count as if they did), or if it has several members. Documents
   that only share a passage go here, before any pair is made.
3. In the list of each shingle the groups are paired with the list's first, and
   a group keeps the pair it meets in most lists; members are paired with their
   group's first. These pairs, at most one for each set, are verified. Lists of
   frequent shingles are dealt into parts, each with a copy of the list's first.
   This settles groups of many near copies in a number of pairs that is linear in
   their rows.
4. What is left are pairs in *different* components that share a prefix shingle.
   Groups are expanded to their members here; each list with several components
   gives all its pairs that pass the size and position filters, long lists in
   blocks, one task row for each pair of blocks. They are verified, and
   components are closed again.

Before texts are compared, a pair passes a bitmap filter. The bitmap of a set
holds the parity of its shingles by hash, in two bits a shingle and at most
1 KB; the bits in which two differ are at most the shingles that only one of
them has, which bounds what they share from above.

So no link between two components is lost, and pairs inside a component are not
spelled out. Rows of prefix shingles carry numbers only. Texts are read again
for the living documents (a Bloom filter of at most 8 MB, Spark's own, keeps most
others out of the shuffle), and move once for each pair that is verified; an
owner with many partners is dealt over several tasks. The one broadcast (1 MB of
weights) does not depend on the input. A family of N documents that share most
of their shingles without linking still needs N * N / 2 comparisons.

Shingles are told apart by a 64-bit hash, equal sets by 128 bits made with two
independent functions of the words.

Defined results: null text and text without words: empty set, linked with
nothing. Rows that share a doc_id are one node, linked where any of its rows
is; each row has its own set size. A null doc_id is linked with nothing. doc_id
must be a whole number: another type is a TypeError. Extra columns are ignored.
Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewise.llm import textnp as tn
from cladewise.llm.components import components
from cladewise.llm.sketch import frequent
from cladewise.session import bounded_batches, filtered_joins, written

SHINGLE = 5
#: Common prefix shingles that are asked for: one, and one for so many of the set.
EXTRA = 32
#: Partners of an owner that one task verifies.
PARTNERS = 64
#: Rows of numbers in an Arrow batch.
NARROW = 16_384
#: Rows of a list that are compared with each other in one task row; parts of a frequent shingle's list.
BLOCK_ROWS, PARTS = 512, 16
#: Bits of a bitmap, at most.
WIDEST = 8192
_U = np.uint64


def shingle_hashes(buf: np.ndarray, offs: np.ndarray, k: int = SHINGLE, both: bool = False):
    """Hashes of all shingles of all texts, and where each text's begin; with
    ``both`` also the hashes made with the second function."""
    low = tn.LOWER[buf]
    starts, ends, firsts = tn.words(low, offs)
    n = np.diff(firsts)
    short = np.flatnonzero((n > 0) & (n < k))
    made = []
    for which in (0, 1)[: 1 + both]:
        hashes = tn.word_hashes(low, starts, ends, which)
        _, wins, heads = tn.windows(hashes, firsts, k, which)
        if len(short):
            wins = np.insert(wins, heads[short], tn.short_sequences(hashes, firsts[short], n[short], which))
        made.append(wins)
    return (*made, heads + np.searchsorted(short, np.arange(len(heads))))


def _by_text(doc: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Order by text, then by the last key to the first; a slice seldom has 65,536 texts, and short numbers sort fast."""
    order = np.argsort(keys[0])
    for x in keys[1:]:
        order = order[np.argsort(x[order], kind="stable")]
    if len(doc) and doc[-1] < 1 << 16:
        doc = doc.astype(np.uint16)
    return order[np.argsort(doc[order], kind="stable")]


def _sets(h: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each text, where each text's begin, and of which occurrences they are."""
    if not len(h):
        return h, np.zeros(len(heads), np.int64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(heads) - 1), np.diff(heads))
    order = _by_text(doc, h)
    h = h[order]  # doc is sorted already and stays as it is
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.r_[0, np.cumsum(np.bincount(doc[new], minlength=len(heads) - 1))], order[new]


def sets_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each text, and where each text's begin."""
    return _sets(*shingle_hashes(buf, offs))[:2]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _hashes_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for _, buf, offs in tn.slices(batch):
        yield shingle_hashes(buf, offs)[0]


def _sums(x: np.ndarray, heads: np.ndarray) -> np.ndarray:
    s = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=s[1:])
    return s[heads[1:]] - s[heads[:-1]]


def parity_bitmaps(h: np.ndarray, n: np.ndarray, heads: np.ndarray) -> list[bytes]:
    """Per set the parity of its hashes modulo a power of two: at least twice its size, at most ``WIDEST``."""
    width = np.minimum(WIDEST, 1 << np.maximum(6, np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64)))
    starts = np.r_[0, np.cumsum(width)]
    at = np.repeat(starts[:-1], n) + (h & np.repeat(width - 1, n).astype(np.uint64)).astype(np.int64)
    raw = np.packbits(np.bincount(at, minlength=int(starts[-1])) & 1 == 1).tobytes()
    return [raw[a // 8 : b // 8] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]


def at_most_shared(bits: list[bytes], n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Upper bound of the intersection of the sets a[i] and b[i].

    The wider bitmap of a pair is folded to the narrower one's width.
    """
    size = np.fromiter(map(len, bits), np.int64, len(bits))
    out = np.empty(len(a), np.int64)
    narrow = np.minimum(size[a], size[b])
    for w in np.unique(narrow):
        mine = np.flatnonzero(narrow == w)
        rows = np.unique(np.concatenate([a[mine], b[mine]]))
        place = np.zeros(len(bits), np.int64)
        place[rows] = np.arange(len(rows))
        flat = np.empty((len(rows), w), np.uint8)
        for i, r in enumerate(rows.tolist()):
            flat[i] = np.bitwise_xor.reduce(np.frombuffer(bits[r], np.uint8).reshape(-1, w), axis=0)
        words = flat.view(np.uint64)
        step = max(1, (1 << 20) // words.shape[1])
        for i in range(0, len(mine), step):
            m = mine[i : i + step]
            differ = np.bitwise_count(words[place[a[m]]] ^ words[place[b[m]]]).sum(axis=1, dtype=np.int64)
            out[m] = (n[a[m]] + n[b[m]] - differ) // 2
    return out


def three_quarters(n):
    return (3 * n + 3) // 4


def prefix_length(n):
    return np.where(n > 0, np.minimum(n, n - three_quarters(n) + 1 + n // EXTRA), 0)


def _describe(often):
    """Per document: set size, set signature, group key, prefix (frequent shingles last), how many are not frequent, bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, offs in tn.slices(batch):
                every, second, heads = shingle_hashes(buf, offs, both=True)
                h, heads, source = _sets(every, heads)
                second = second[source]
                n = np.diff(heads)
                doc = np.repeat(np.arange(len(n)), n)
                ordered, weight = h, often.value.weight(h)
                if weight.any():
                    order = _by_text(doc, h, weight)
                    ordered, weight = h[order], weight[order]
                inside = np.arange(len(h)) - heads[doc] < prefix_length(n)[doc]
                toks, tdoc = ordered[inside], doc[inside]
                theads = np.r_[0, np.cumsum(prefix_length(n))].astype(np.int64)
                light = np.bincount(tdoc[weight[inside] == 0], minlength=len(n))
                raw, some = toks.tobytes(), (n > 0).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"), pa.array(n), _signed(_sums(tn.mix64(h), heads)), _signed(_sums(second, heads)),
                        _signed(tn.mix64(_sums(tn.mix64(toks + _U(1)), theads) + n.astype(np.uint64))), pa.array(light), pa.array(np.diff(theads)),
                        pa.array([raw[8 * a : 8 * b] if s else None for a, b, s in zip(theads[:-1].tolist(), theads[1:].tolist(), some)], pa.binary()),
                        pa.array([m if s else None for m, s in zip(parity_bitmaps(h, n, heads), some)], pa.binary()),
                    ],
                    names=["doc_id", "n", "sig0", "sig1", "gkey", "light", "k", "tokens", "bits"],
                )

    return run


def _exploded(keep: tuple[str, ...], only: str = ""):
    """One row per prefix shingle (only "light" or "frequent" ones): token, pos, whether it is frequent, and the kept columns (bigint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                # Some rows at a time, so that long texts do not make one large batch.
                b, size = batch.slice(at, 500), 0
                lists = []
                for x in b.column("tokens"):
                    lists.append(np.frombuffer(x.as_buffer(), np.uint64))
                    size += len(lists[-1])
                    if size > 200_000:
                        break
                b = b.slice(0, len(lists))
                at += len(lists)
                light = b.column("light").to_numpy()
                if only:
                    lists = [x[:k] if only == "light" else x[k:] for x, k in zip(lists, light.tolist())]
                k = np.fromiter(map(len, lists), np.int64, len(lists))
                which = np.repeat(np.arange(len(k)), k)
                pos = np.arange(len(which)) - np.repeat(np.cumsum(k) - k, k)
                if only == "frequent":
                    pos = pos + light[which]
                cols = [_signed(np.concatenate(lists)), pa.array(pos), pa.array(pos >= light[which]), *(pa.array(b.column(c).to_numpy()[which]) for c in keep)]
                yield pa.RecordBatch.from_arrays(cols, names=["token", "pos", "frequent", *keep])

    return run, "token bigint, pos bigint, frequent boolean" + "".join(f", {c} bigint" for c in keep)


def _in_several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, gkey) sorted: for each group, in how many lists with other groups it stands."""
    last, counted = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        t, g = batch.column("token").to_numpy(), batch.column("gkey").to_numpy()
        if last is not None:
            t, g = np.r_[last[0], t], np.r_[last[1], g]
        new = np.r_[True, (t[1:] != t[:-1]) | (g[1:] != g[:-1])]
        t, g = t[new], g[new]
        same = t[1:] == t[:-1]
        shared = np.r_[False, same] | np.r_[same, False]
        # The last row waits for the next batch, and is counted once.
        waits = bool(shared[-1]) or (counted and len(t) == 1)
        if last is not None and counted:
            shared[0] = False
        counted, last = waits, (t[-1], g[-1])
        ids, counts = np.unique(g[shared], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], names=["gkey", "shared"])


def least_shared(na, nb):
    """Shingles that two sets of these sizes share at least if they link."""
    return (3 * (na + nb) + 6) // 7


def may_link(na, pa_, nb, pb):
    """Size and position filters of a pair whose first common shingle is at these places."""
    need = least_shared(na, nb)
    return (4 * np.minimum(na, nb) >= 3 * np.maximum(na, nb)) & (np.minimum(na - pa_, nb - pb) >= need)


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs and how often each is there."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
    return a[new], b[new], np.diff(np.r_[new, len(a)])


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    a, b, _ = _distinct(a, b)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["owner", "member"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (token, part, size, pri): pairs of each row with the first of its list, and in how many lists."""
    head = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy() for c in ("token", "part", "size")])
        i, n, p = (batch.column(c).to_numpy() for c in ("id", "n", "pos"))
        new = np.ones(len(i), bool)
        new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
        first = np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))
        hi, hn, hp = i[first], n[first], p[first]
        if head is not None and head[0] == tuple(key[:, 0].tolist()):
            same = first == 0
            hi, hn, hp = (np.where(same, v, x) for v, x in zip(head[1:], (hi, hn, hp)))
        head = (tuple(key[:, -1].tolist()), hi[-1], hn[-1], hp[-1])
        ok = (hi != i) & may_link(hn, hp, n, p)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _distinct(hi[ok], i[ok])], names=["owner", "member", "lists"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (token, one, two, n): all pairs of different components that pass size and position.

    Rows are compared with the window of later rows of the same key whose size
    is within reach; the window is all that is kept of earlier batches. Between
    two blocks only rows of different blocks meet.
    """
    kept: np.ndarray | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(c).to_numpy() for c in ("token", "one", "two", "block", "n", "pos", "comp", "id")])
        old = 0
        if kept is not None:
            old = kept.shape[1]
            rows = np.concatenate([kept, rows], axis=1)
        t, one, two, block, n, p, c, i = rows
        new = np.flatnonzero(np.r_[True, (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)])
        number = np.zeros(len(t), np.int64)
        number[new[1:]] = 1
        number = np.cumsum(number)
        # Earlier rows of the same key that are large enough: keys and sizes ascend together.
        tall = int(n.max()) + 1
        bound = np.searchsorted(number * tall + n, number * tall + three_quarters(n))
        outs = []
        for at in range(old, len(t), 512):
            to = min(at + 512, len(t))
            lo = int(bound[at:to].min())
            x, y = np.arange(at, to)[:, None], np.arange(lo, to)[None, :]
            ok = (y < x) & (y >= bound[x]) & (c[y] != c[x])
            r, s = np.nonzero(ok)
            r, s = r + at, s + lo
            ok = may_link(n[s], p[s], n[r], p[r]) & ((one[r] == two[r]) | (block[r] != block[s]))
            outs.append(np.stack([i[s[ok]], i[r[ok]]]))
        both = np.concatenate(outs, axis=1)
        yield _pairs(np.minimum(*both), np.maximum(*both))
        reach = max(int(new[-1]), int(np.searchsorted(number * tall + n, number[-1] * tall + three_quarters(n[-1]))))
        kept = rows[:, reach:]


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (owner, salt), the owner's own first: the pairs that pass the bitmap filter."""
    owner, own = None, []
    for batch in batches:
        bits, n = [x.as_py() for x in batch.column("bits")], batch.column("n").to_pylist()
        at = len(bits)
        bits, n = bits + [x[0] for x in own], n + [x[1] for x in own]
        mine = list(range(at, len(bits)))
        a, b, where = [], [], []
        for r, (*o, own_row) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("owner", "salt", "mine")))):
            if o != owner:
                owner, mine = o, []
            if own_row:
                mine.append(r)
                continue
            a += mine
            b += [r] * len(mine)
        own = [(bits[r], n[r]) for r in mine]
        a, b, n = np.array(a, np.int64), np.array(b, np.int64), np.array(n, np.int64)
        ok = at_most_shared(bits, n, a, b) >= least_shared(n[a], n[b])
        where = np.unique(b[ok])
        yield _pairs(batch.column("owner").to_numpy()[where], batch.column("id").to_numpy()[where])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (owner, salt), the owner's own first: the pairs that link."""
    owner, own = None, []
    for batch in batches:
        for rows, buf, offs in tn.slices(batch):
            h, heads = sets_of(buf, offs)
            a, b = [], []
            for r, (*o, i, mine) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("owner", "salt", "id", "mine")))):
                s = h[heads[r] : heads[r + 1]]
                if o != owner:
                    owner, own = o, []
                if mine:
                    own.append(s.copy())
                    continue
                for x in own:
                    both = len(np.intersect1d(x, s, assume_unique=True))
                    if both and 100 * both >= 75 * (len(x) + len(s) - both):
                        a.append(o[0])
                        b.append(i)
                        break
            yield _pairs(np.array(a, np.int64), np.array(b, np.int64))


def _met(pairs: DataFrame, values: DataFrame, run, name: str) -> DataFrame:
    """The pairs (owner, member) that ``run`` lets pass, from the values (id and more) of both."""
    with filtered_joins(pairs.sparkSession):
        pairs = written(pairs, f"{name}-pairs")
    deals = written(pairs.groupBy("owner").count().select("owner", F.ceil(F.col("count") / PARTNERS).cast("int").alias("deals")), f"{name}-owners")
    member = pairs.join(deals, "owner").select("owner", F.pmod(F.xxhash64("member"), F.col("deals")).cast("int").alias("salt"), F.col("member").alias("id"), F.lit(False).alias("mine"))
    mine = deals.select("owner", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("salt"), F.col("owner").alias("id"), F.lit(True).alias("mine"))
    # Written, so that Spark knows how few they are before it moves any text.
    rows = written(member.unionByName(mine), f"{name}-deals").filter("salt >= 0")
    rows = rows.join(values, "id").repartition("owner", "salt").sortWithinPartitions("owner", "salt", F.col("mine").desc())
    return written(rows.mapInArrow(run, "owner bigint, member bigint").distinct(), name)


def _linked(pairs: DataFrame, live: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that link: by their bitmaps, then by their texts."""
    spark = pairs.sparkSession
    bounded_batches(spark, NARROW)
    alike = _met(pairs, live.select("id", "n", "bits"), _alike, "alike")
    bounded_batches(spark)
    return _met(alike, texts, _verify, "links")


def _star_pairs(reps: DataFrame) -> DataFrame:
    """Of each representative (id, n, light, tokens, pri) the pair with the first that it meets in most lists.

    The lists of frequent shingles are dealt into parts, each of which gets the list's first.
    """
    rows = reps.select("id", "n", "light", "pri", "tokens")
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3))).cast("bigint")

    def lists(only: str) -> DataFrame:
        run, schema = _exploded(("id", "n", "pri"), only)
        return rows.mapInArrow(run, schema).withColumn("size", size)

    part = F.when(F.col("frequent"), F.pmod(F.xxhash64("id"), F.lit(PARTS))).otherwise(F.lit(0)).cast("bigint")
    first = lists("frequent").groupBy("token", "size").agg(F.min(F.struct("pri", "id", "n", "pos")).alias("f"))
    parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PARTS - 1).cast("bigint")))
    heads = first.select("token", parts.alias("part"), "size", F.lit(-1).cast("bigint").alias("pri"), "f.id", "f.n", "f.pos")
    everything = lists("").select("token", part.alias("part"), "size", "pri", "id", "n", "pos").unionByName(heads)
    met = everything.repartition("token", "part").sortWithinPartitions("token", "part", "size", "pri", "id").mapInArrow(_stars, "owner bigint, member bigint, lists bigint")
    counted = met.groupBy("owner", "member").agg(F.sum("lists").alias("lists"))
    return counted.groupBy("member").agg(F.max_by("owner", F.struct("lists", -F.col("owner"))).alias("owner")).select("owner", "member")


def _cross_pairs(known: DataFrame) -> DataFrame:
    """All pairs of different components in one list that pass the size and position filters."""
    run, schema = _exploded(("id", "n", "comp"))
    rows = written(known.select("id", "n", "light", "comp", "tokens").mapInArrow(run, schema).drop("frequent"), "lists")
    mixed = rows.groupBy("token").agg(F.count("*").alias("rows"), F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a < b")
    mixed = written(mixed.select("token", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("blocks")), "mixed").filter("blocks > 0")
    dealt = rows.join(mixed, "token").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("bigint"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = dealt.select("token", "n", "pos", "comp", "id", "block", other).select(
        "token", F.least("block", "other").cast("bigint").alias("one"), F.greatest("block", "other").cast("bigint").alias("two"), "block", "n", "pos", "comp", "id"
    )
    return met.repartition("token", "one", "two").sortWithinPartitions("token", "one", "two", "n", "id").mapInArrow(_across, "owner bigint, member bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} must be a whole number")
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    often = spark.sparkContext.broadcast(frequent(docs.select("text"), _hashes_of))
    schema = "doc_id bigint, n bigint, sig0 bigint, sig1 bigint, gkey bigint, light bigint, k bigint, tokens binary, bits binary"
    made = written(docs.mapInArrow(_describe(often), schema), "sets")
    often.destroy()
    tn.tidy()
    sides = [f(c) for c in ("sig0", "sig1") for f in (F.min, F.max)]
    several = made.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.struct(*sides[::2]).alias("a"), F.struct(*sides[1::2]).alias("b")).filter("a <> b")
    if not several.isEmpty():
        return _by_row(docs)

    # Equal sets, and groups of sets with one prefix and size: numbers only.
    cand = made.filter("n > 0 AND doc_id IS NOT NULL")
    narrow = [F.min(c).alias(c) for c in ("gkey", "light", "k")]
    sets = written(cand.groupBy("sig0", "sig1", "n").agg(F.min("doc_id").alias("id"), *narrow), "equal-sets")
    groups = sets.groupBy("gkey", "n").agg(F.min("id").alias("first"), F.count("*").alias("members"), F.min("light").alias("light"), F.min("k").alias("k"))

    # Groups whose prefix can be shared with another's.
    bounded_batches(spark, NARROW)
    run, schema = _exploded(("gkey",), only="light")
    light = cand.select("gkey", "light", "tokens").mapInArrow(run, schema).select("token", "gkey")
    shared = light.repartition("token").sortWithinPartitions("token", "gkey").mapInArrow(_in_several, "gkey bigint, shared bigint").groupBy("gkey").agg(F.sum("shared").alias("shared"))
    counted = groups.join(shared, "gkey", "left").withColumn("common", F.coalesce("shared", F.lit(0)) + F.col("k") - F.col("light"))
    needed = F.lit(1) + F.floor(F.floor((3 * F.col("n") + 3) / 4) / EXTRA)
    # The group that shares most comes first in its lists.
    pri = (F.floor(16 * (1 - F.least(F.col("common") / F.col("k"), F.lit(1.0)))) * F.lit(1 << 58) + F.shiftrightunsigned(F.xxhash64("first"), 6)).cast("bigint")
    living = counted.filter((F.col("common") >= needed) | (F.col("members") > 1)).select("gkey", "n", "first", pri.alias("pri"))
    living = written(living, "living-groups")
    alive = written(sets.select("gkey", "n", "sig0", "sig1", "id").join(living, ["gkey", "n"]).drop("gkey"), "living-sets").filter("n > 0")
    found = cand.select(F.col("doc_id").alias("id"), "n", "sig0", "sig1", "light", "tokens", "bits")
    with filtered_joins(spark):
        live = written(found.join(alive, ["id", "n", "sig0", "sig1"]).drop("sig0", "sig1"), "living-items")
        texts = written(docs.select(F.col("doc_id").alias("id"), "text").join(alive.select("id"), "id", "left_semi"), "texts")

    # Stars of the groups, and of each group's members.
    reps = live.filter("id = first")
    inside = live.filter("id <> first").select(F.col("first").alias("owner"), F.col("id").alias("member"))
    comps = written(components(_linked(_star_pairs(reps).unionByName(inside), live, texts), "owner", "member"), "components")

    # All pairs of different components that are left.
    known = live.join(comps, F.col("id") == F.col("node"), "left").select("id", "n", "light", "tokens", F.coalesce("component", "id").alias("comp"))
    bounded_batches(spark, NARROW)
    edges = _linked(_cross_pairs(known), live, texts).unionByName(comps.select(F.col("component").alias("owner"), F.col("node").alias("member")).filter("owner <> member"))
    closed = written(components(edges, "owner", "member"), "components")

    ids = sets.join(closed, F.col("id") == F.col("node"), "left").select("sig0", "sig1", "n", F.coalesce("component", "id").alias("component_id"))
    ids = written(ids, "set-components")
    single = made.filter("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    linked = cand.select("doc_id", "n", "sig0", "sig1").join(ids, ["sig0", "sig1", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return single.unionByName(linked)


def _by_row(docs: DataFrame) -> DataFrame:
    """The same where a doc_id has several texts: rows are joined under numbers of
    their own, then components of rows that share a doc_id are closed."""
    rows = written(docs.filter("doc_id IS NOT NULL").withColumn("row", F.monotonically_increasing_id()), "numbered")
    got = near_duplicates(rows.select(F.col("row").alias("doc_id"), "text")).withColumnRenamed("doc_id", "row")
    got = written(rows.select("row", "doc_id").join(got, "row"), "row-components")
    least = got.groupBy("component_id").agg(F.min("doc_id").alias("least"))
    closed = components(got.join(least, "component_id").select("least", "doc_id"), "least", "doc_id")
    linked = got.join(closed, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return linked.unionByName(near_duplicates(docs.filter("doc_id IS NULL")))


#: DuckDB SQL for the rows, where each doc_id has one row: every pair with a common shingle is counted.
ORACLE = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sha256(array_to_string(w[i:i + 4], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n m ON m.doc_id = a JOIN n o ON o.doc_id = b WHERE 100 * shared >= 75 * (m.n + o.n - shared)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS doc_id, b AS other FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, min(other)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY d.doc_id"""
