"""Ranked lexical search by bags: equal term vectors are scored once.

1. Each document is restricted to the items' vocabulary: the pairs (term, tf) it
   holds, packed in order of term, and n, the number of all its terms.
2. N, L and df are counted over all documents; they give each term's weight and
   each document's m.
3. Documents of equal vector and equal m are one class. They meet by a hash, and
   the vectors themselves are compared. Each class keeps its documents of least
   doc_id, as many as a ranking may ask for.
4. Every class is scored once against all items, by an index of the vocabulary;
   a task passes on the best classes of each item only. A document in an item's
   top k is in one of its k first classes by (score, least doc_id).
5. The classes left are expanded to their members in ascending doc_id.

Items are taken in blocks whose vocabulary is at most ``BLOCK_TERMS`` terms (or
one item), so what is broadcast is bounded; documents are read once a block.

Defined results: null text has no term and is not counted in N. Rows of items that
share an item_id make one item, whose terms are those of all of them. Items
without terms have no rows. Documents that share a doc_id are ranked each, and
a null doc_id comes before others. Extra columns are ignored; an empty table on
either side gives no rows. Long texts are worked on whole, in linear time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cladewise.llm import textnp as tn
from cladewise.session import bounded_batches, written

#: Terms of a block of items, at most.
BLOCK_TERMS = 1 << 16
#: Pairs of a class's term and an item that are scored at once.
_AT_ONCE = 1 << 20

#: Bytes that belong to terms: digits, letters and all of non-ASCII characters.
_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def terms(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all terms, and per text the index of its first term (one entry more than texts)."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    inside = _TERM[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offs[:-1] < offs[1:]
    heads, tails = offs[:-1][full], offs[1:][full] - 1
    first[heads] = inside[heads]
    last[tails] = inside[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, term (bytes), k: how often the item holds the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, offs in tn.slices(batch):
                low = tn.LOWER[buf]
                s, e, firsts = terms(low, offs)
                whole = low.tobytes()
                words = pa.array([whole[a:b] for a, b in zip(s.tolist(), e.tolist())], pa.binary())
                at = np.repeat(np.arange(len(rows)), np.diff(firsts))
                yield pa.RecordBatch.from_arrays([rows.column("item_id").take(pa.array(at)), words], names=["item_id", "term"])

    items = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    kind = items.schema["item_id"].dataType.simpleString()
    return items.mapInArrow(run, f"item_id {kind}, term binary").groupBy("item_id", "term").agg(F.count("*").alias("k"))


def item_blocks(items: DataFrame, most: int = BLOCK_TERMS) -> Iterator[tuple[list, list[bytes], list[list[tuple[int, int]]]]]:
    """Blocks of items: their ids, their vocabulary, and per term the pairs (item's place, k). One block is on the driver at a time."""
    held: dict[bytes, list[tuple[int, int]]] = {}
    ids: list = []
    for r in items.groupBy("item_id").agg(F.collect_list(F.struct("term", "k")).alias("terms")).orderBy("item_id").toLocalIterator():
        if ids and len(held) + len(r.terms) > most:
            yield ids, list(held), list(held.values())
            held, ids = {}, []
        for t in r.terms:
            held.setdefault(bytes(t.term), []).append((len(ids), t.k))
        ids.append(r.item_id)
    if ids:
        yield ids, list(held), list(held.values())


class Vocabulary:
    """Looks terms up by hash, and then compares their bytes."""

    def __init__(self, words: list[bytes]):
        self.size = len(words)
        self.buf = np.frombuffer(b"".join(words), np.uint8)
        self.ends = np.cumsum([len(w) for w in words])
        self.starts = self.ends - [len(w) for w in words]
        hashes = tn.word_hashes(self.buf, self.starts, self.ends)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        self.split = bool(len(hashes)) and len(np.unique(hashes)) < len(hashes)
        self.place = {w: i for i, w in enumerate(words)} if self.split else {}

    def find(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the terms are in the vocabulary, and their places in it."""
        if not len(starts) or not self.size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = tn.word_hashes(buf, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, h), self.size - 1)
        some = np.flatnonzero(self.hashes[at] == h)
        place = self.order[at[some]]
        if self.split:
            whole = buf.tobytes()
            found = np.array([self.place.get(whole[a:b], -1) for a, b in zip(starts[some].tolist(), ends[some].tolist())], np.int64)
            return some[found >= 0], found[found >= 0]
        n = ends[some] - starts[some]
        same = n == self.ends[place] - self.starts[place]
        some, place, n = some[same], place[same], n[same]
        both = np.concatenate([buf, self.buf])
        same = tn.same_bytes(both, starts[some], self.starts[place] + len(buf), n)
        return some[same], place[same]


def bags(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """Per document with a term: doc_id, n (all its terms), bag (pairs term and tf as 32-bit numbers, by term); written."""
    spark = docs.sparkSession
    bounded_batches(spark)
    given = spark.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(given.value)
        for batch in tn.gathered(batches):
            for rows, buf, offs in tn.slices(batch):
                low = tn.LOWER[buf]
                s, e, firsts = terms(low, offs)
                n = np.diff(firsts)
                some, place = vocabulary.find(low, s, e)
                doc = np.searchsorted(firsts, some, "right") - 1
                keys, tf = np.unique(doc * (vocabulary.size + 1) + place, return_counts=True)
                pairs = np.stack([keys % (vocabulary.size + 1), tf], 1).astype("<u4")
                heads = np.searchsorted(keys // (vocabulary.size + 1), np.arange(len(n) + 1)).astype(np.int32) * 8
                bag = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(heads.tobytes()), pa.py_buffer(pairs.tobytes())])
                got = pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n.astype(np.int64)), bag], names=["doc_id", "n", "bag"])
                yield got.filter(pa.array(n > 0))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return written(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n bigint, bag binary"), "bags")


def document_counts(rows: DataFrame) -> DataFrame:
    """term (its place), df: the documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            found = np.bincount(tn.binary_bytes(batch.column("bag")).view("<u4")[::2])
            if len(found) > len(total):
                total, found = found, total
            total[: len(found)] += found
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    return rows.select("bag").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def score_classes(bags: list[bytes], m: np.ndarray, w: np.ndarray, heads: np.ndarray, items: np.ndarray, ks: np.ndarray, n_items: int) -> Iterator[tuple[int, np.ndarray]]:
    """Runs of classes with their scores against all items: (first class, classes x items).

    heads, items, ks: per term the items that hold it, and how often. Sums are
    made of two halves of each number, so that doubles hold them exactly.
    """
    sizes = np.array([len(b) // 8 for b in bags], np.int64)
    pairs = np.frombuffer(b"".join(bags), "<u4").reshape(-1, 2).astype(np.int64)
    term, tf = pairs[:, 0], pairs[:, 1]
    owner = np.repeat(np.arange(len(bags)), sizes)
    value = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[owner]))
    spread = heads[term + 1] - heads[term]
    upto = np.concatenate([[0], np.cumsum(spread)])
    first = np.concatenate([[0], np.cumsum(sizes)])
    a = 0
    while a < len(bags):
        b = max(a + 1, int(np.searchsorted(upto[first], upto[first[a]] + _AT_ONCE, "right")) - 1)
        b = min(b, len(bags), a + max(1, _AT_ONCE // max(n_items, 1)))
        lo, hi = first[a], first[b]
        n = spread[lo:hi]
        at = np.arange(int(n.sum())) + np.repeat(heads[term[lo:hi]] - (upto[lo:hi] - upto[lo]), n)
        cell = np.repeat(owner[lo:hi] - a, n) * n_items + items[at]
        x = np.repeat(value[lo:hi], n) * ks[at]
        low = np.bincount(cell, (x & 0xFFFFFF).astype(np.float64), (b - a) * n_items).astype(np.int64)
        high = np.bincount(cell, (x >> 24).astype(np.float64), (b - a) * n_items).astype(np.int64)
        yield a, ((high << 24) + low).reshape(b - a, n_items)
        a = b


def best_classes(classes: DataFrame, top: int, n_items: int, given) -> DataFrame:
    """Per task and item the first classes by score and least doc_id: item (its place), score, class, least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, heads, items, ks = given.value
        best: list[list[tuple]] = [[] for _ in range(n_items)]
        least_type = pa.null()
        for batch in batches:
            least_type = batch.schema.field("doc_id").type
            keys, m = batch.column("class").to_pylist(), np.asarray(batch.column("m"))
            least = batch.column("doc_id").to_pylist()
            # Of equal scores the class of least doc_id comes first; null is least.
            order = sorted(range(len(least)), key=lambda i: (least[i] is not None, least[i]))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            for a, scores in score_classes(batch.column("bag").to_pylist(), m, w, heads, items, ks, n_items):
                for i in range(n_items):
                    col = scores[:, i]
                    if len(best[i]) == top:
                        some = np.flatnonzero(col >= max(best[i][-1][0], 1))
                    else:
                        some = np.flatnonzero(col > 0)
                    if not len(some):
                        continue
                    if len(some) > top:
                        some = some[np.lexsort((rank[a + some], -col[some]))[:top]]
                    more = [(int(col[j]), keys[a + j], least[a + j]) for j in some.tolist()]
                    best[i] = sorted(best[i] + more, key=lambda x: (-x[0], x[2] is not None, x[2]))[:top]
        out = [(i, *x) for i, found in enumerate(best) for x in found]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), least_type))], names=["item", "score", "class", "least"])

    kind = classes.schema["doc_id"].dataType.simpleString()
    return classes.select("class", "m", "bag", "doc_id").mapInArrow(run, f"item bigint, score bigint, class binary, least {kind}")


def ranked(docs: DataFrame, items: DataFrame, top: int = 20, most_terms: int = BLOCK_TERMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents of each item."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = (items.schema["item_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString())
    out = spark.createDataFrame([], f"item_id {kinds[0]}, rank int, doc_id {kinds[1]}, score bigint")
    for ids, words, held in item_blocks(written(item_terms(items), "item-terms"), most_terms):
        out = out.unionByName(_ranked_block(docs, ids, words, held, top, kinds[0]))
    return out


def _ranked_block(docs: DataFrame, ids: list, words: list[bytes], held: list[list[tuple[int, int]]], top: int, kind: str) -> DataFrame:
    spark = docs.sparkSession
    rows = bags(docs, words)
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    # One row per term of the block.
    df = {r.term: r.df for r in document_counts(rows).collect()}
    w = np.array([weight(total.n, df.get(i, 0)) for i in range(len(words))], np.int64)
    heads = np.concatenate([[0], np.cumsum([len(x) for x in held])])
    flat = np.array([p for x in held for p in x], np.int64).reshape(-1, 2)
    given = spark.sparkContext.broadcast((w, heads, flat[:, 0], flat[:, 1]))

    m = F.expr(f"75 + (25 * n * {total.n}L) div {max(total.l, 1)}L")
    some = rows.filter(F.octet_length("bag") > 0).select("doc_id", m.alias("m"), "bag")
    some = some.withColumn("class", F.unhex(F.sha2(F.concat(F.col("bag"), F.col("m").cast("string").cast("binary")), 256)))
    # The hash brings a class together; equal rows of the order below have equal vectors and m as well.
    of = W.partitionBy("class", "m", "bag").orderBy("doc_id")
    members = written(some.withColumn("nth", F.row_number().over(of)).filter(F.col("nth") <= top), "class-members")
    best = best_classes(members.filter("nth = 1"), top, len(ids), given)
    first = W.partitionBy("item").orderBy(F.desc("score"), "least", "class")
    best = written(best.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= top).drop("at", "least"), "best-classes")
    j = best.join(members.select("class", "doc_id"), "class")
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), "doc_id", "class"))
    got = j.withColumn("rank", rank).filter(F.col("rank") <= top)
    names = spark.createDataFrame(list(enumerate(ids)), f"item bigint, item_id {kind}")
    return got.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOUND = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_FOUND} AS t FROM documents), x AS (SELECT r, doc_id, len(t) AS n, t FROM d WHERE len(t) > 0),
tot AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM x), i AS (SELECT item_id, term, count(*) AS k FROM (SELECT item_id, unnest({_FOUND}) AS term FROM benchmark) GROUP BY ALL),
f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(t) AS term FROM x) SEMI JOIN i USING (term) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, tot GROUP BY term),
s AS (SELECT item_id, r, doc_id, CAST(sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // l)))) AS BIGINT) AS score FROM f JOIN w USING (term) JOIN i USING (term), tot GROUP BY ALL)
SELECT item_id, CAST(rn AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rn FROM s WHERE score > 0) WHERE rn <= 20"""
