"""SentencePiece by chunks, prefix tries and ranked search against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from helpers import same

from cladewise.llm import pieces, prefix_trie, queries, ranked_search

SCHEMA = "doc_id bigint, text string, ids string, decoded string, chunk string, n int, m int, bag string, rank int, score int, part int, depth int, path string"
EXTRA = ("x", "x", "x", 1, 1, "x", 1, 1, 1, 1, "x")


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


def random_texts(seed, n, parts, longest=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(longest))) for _ in range(n)]


PIECES = ["a", "b", " ", "  ", "▁", "the", " the", "1", ".", "\n", "é", "日", "\U0001f600", "́", "<s>", " ", "\u0085", " ", "'s", "Σ", "\x00", "‍"]


@pytest.mark.parametrize("most", [pieces.TABLE, 20, 0])
def test_sentencepiece(spark, most):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    texts = [None, "", " ", "a ", "  a  b▁c ▁ d", "▁", "<s> </s> <unk> <0x41>", "x" * 20000, " " * 40 + "b", "a" + " " * 17 + "b", "w " * 20000, *random_texts(1, 800, PIECES)]
    rows = [(i // 2, t) for i, t in enumerate(texts)] + [(None, "no id"), (0, None)]

    def want(t):
        ids = model.encode(t or "")
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()

    df = frame(spark, rows)
    key = lambda r: (r[0] is None, *map(str, r))
    got = pieces.encode_decode(df, queries.piece_model(), most=most)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((i, *want(t)) for i, t in rows), key=key)
    kept = pieces.encode_decode(df.limit(30), queries.piece_model(), keep=("ids", "decoded"), most=most).collect()
    assert all(model.decode(list(r.ids)) == r.decoded and len(r.ids) == r.n_tokens for r in kept)
    assert pieces.encode_decode(df.limit(0), queries.piece_model()).count() == 0
    named = df.selectExpr("cast(doc_id as string) AS doc_id", "text")
    assert pieces.encode_decode(named, queries.piece_model(), most=most).count() == len(rows)


def test_sentencepiece_query(spark, data):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op13_sentencepiece(spark, data).collect()}
    assert set(got) == set(docs)
    for i, t in docs.items():
        ids = model.encode(t)
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest())


def test_chunk_table_is_bounded(spark):
    rows = [(i, f"common rare{i} " * 3 + "often " * (i % 7)) for i in range(300)]
    table = pieces.chunk_table(frame(spark, rows), queries.piece_model(), most=10).collect()
    assert {b"common", b"often"} <= {bytes(r.chunk) for r in table} and len(table) <= 10


def test_chunks():
    text = "a  b▁▁c ".encode()
    buf, offs = np.frombuffer(text, np.uint8), np.array([0, 0, len(text)])
    s, e, firsts = pieces.chunks(buf, offs)
    assert [text[a:b].decode() for a, b in zip(s, e)] == ["a", " b", "▁c", ""] and firsts.tolist() == [0, 0, 4]


TURN = "conv_id bigint, turn bigint, role string, text string, path string, n int, part int, key string, h int"


def plain_trie(rows):
    """All nodes of the trie of rebuilt conversations, one prefix after the other."""
    none = hashlib.sha256(b"").hexdigest()
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    digest = lambda r, x: hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).hexdigest()
    own = {c: [(r, x) for *_, r, x in sorted(v, key=lambda t: (*t[:2], digest(*t[2:])))] for c, v in own.items()}
    made = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        made[c] = tuple(own.get(base, [])[:h] + v[h:])
    nodes = {(): []}
    for c, v in made.items():
        for d in range(len(v) + 1):
            nodes.setdefault(v[:d], []).append(c)
    kids = {}
    for v in nodes:
        if v:
            kids.setdefault(v[:-1], []).append(v)
    leaves, saved = {}, {}
    for v in sorted(nodes, key=len, reverse=True):
        leaves[v] = sum(leaves[k] for k in kids.get(v, [])) or 1
        saved[v] = sum(saved[k] for k in kids.get(v, [])) + ((len(nodes[v]) - 1) * len(v[-1][1]) if v else 0)
    ends = lambda v: [c for c in sorted(nodes[v]) if len(made[c]) == len(v)]
    low = lambda v: min(nodes[v], default=None)
    return sorted((str((low(v), len(v), low(v[:-1]) if v else None, len(nodes[v]), len(kids.get(v, [])), leaves[v], saved[v], hashlib.sha256(",".join(map(str, ends(v))).encode()).hexdigest() if ends(v) else none)) for v in nodes))


def trie(df, **k):
    got = prefix_trie.prefix_nodes(df, **k)
    assert got.columns == prefix_trie.COLUMNS
    return sorted(str(tuple(r)) for r in got.collect())


@pytest.mark.parametrize("turns", [20_000, 7])
def test_prefix_trie(spark, turns):
    rng = random.Random(turns)
    said = ["", "hi", "hello \U0001f600", "a", "b", None, "x" * 3000]
    rows = []
    for c in [*range(-250, 450, 7), 100, 200, 0, 7 * 10**12, None]:
        for t in range(rng.choice([1, 1, 2, 3, 6, 12])):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "user", None]), rng.choice(said[:3] if t < 3 else said)))
    rows += rows[:20]
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1060) for t in range(9)]
    df = spark.createDataFrame([(*r, "x", 1, 1, "x", 1) for r in rows], TURN)
    assert trie(df, shard_turns=turns) == plain_trie(rows)


def test_prefix_trie_edges(spark, data, duck):
    empty = spark.createDataFrame([], TURN)
    assert trie(empty) == plain_trie([]) and trie(spark.createDataFrame([(None, 1, "a", "b", "x", 1, 1, "x", 1)], TURN)) == plain_trie([])
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{data}/conversations.parquet").collect()]
    assert sorted(str(tuple(r)) for r in queries.op12_prefix_trie(spark, data).select(*prefix_trie.COLUMNS).collect()) == plain_trie(rows)
    same(queries.op12_prefix_trie(spark, data), duck, prefix_trie.ORACLE)


def test_double_array():
    rng = random.Random(5)
    words = sorted({tuple(rng.randrange(1, 40) for _ in range(rng.randrange(8))) for _ in range(900)})
    flat = np.array([c for w in words for c in w], np.int64)
    offs = np.cumsum([0, *map(len, words)])
    t = prefix_trie.DoubleArray(flat, offs)
    prefixes = {w[:k] for w in words for k in range(len(w) + 1)}
    slots = {}
    for w in prefixes:
        s = np.zeros(1, np.int64)
        for c in w:
            s = t.step(s, np.array([c]))
            assert s[0] >= 0
        slots[w] = int(s[0])
    assert len(set(slots.values())) == len(prefixes)
    for w in list(prefixes)[:300]:
        for c in range(1, 40):
            assert (t.step(np.array([slots[w]]), np.array([c]))[0] >= 0) == ((*w, c) in prefixes)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_search(docs, items, top):
    held = [(i, collections.Counter(TERM.findall((t or "").translate(LOW)))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, length = len(held), sum(n for *_, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    want = collections.defaultdict(list)
    for i, t in items:
        want[i] += TERM.findall((t or "").translate(LOW))
    out = []
    for item, words in want.items():
        scored = []
        for i, c, n in held:
            m = 75 + 25 * n * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1000000000 * c[w] // (1000 * c[w] + 12 * m)) for w in words)
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, k, x[3], -x[0]) for k, x in enumerate(sorted(scored)[:top], 1)]
    return sorted(map(str, out))


def test_ranked_search(spark, data, duck):
    same(queries.op11_ranked_search(spark, data), duck, ranked_search.ORACLE)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    got = queries.op11_ranked_search(spark, data)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_search(docs, items, 20)


@pytest.mark.parametrize("most", [ranked_search.BLOCK_TERMS, 6])
def test_ranked_search_on_odd_rows(spark, most):
    rng = random.Random(most)
    parts = ["alpha", "Alpha", "be", "é", "日本", "x1", " ", " ", ", ", "_", "{|}", "\U0001f600", "ÀB", "zz", "\x00"]
    texts = [None, "", " ,;", "only words that no item holds", "alpha " * 5000, *random_texts(most, 150, parts, 12), *["alpha be x1"] * 60, *["x1 alpha be"] * 30]
    docs = [(i - 3 if i % 9 else None, t) for i, t in enumerate(texts)] + [(7, "zz é"), (7, "zz é")]
    items = [(1, "alpha beta alpha"), (2, None), (3, ""), (None, "be é"), (4, "日本 zz"), (4, "x1"), (5, "no document has these"), (6, "Alpha, BE; x1 x1")]
    d = frame(spark, docs)
    b = spark.createDataFrame([(*i, "x", 1) for i in items], "item_id bigint, text string, term string, k int")
    for top in (3, 20):
        assert sorted(str(tuple(r)) for r in ranked_search.ranked(d, b, top, most).collect()) == plain_search(docs, items, top)
    assert ranked_search.ranked(d.limit(0), b).count() == 0 and ranked_search.ranked(d, b.limit(0)).count() == 0
    named = d.selectExpr("cast(doc_id as string) AS doc_id", "text")
    assert ranked_search.ranked(named, b, 3, most).count() == len(plain_search(docs, items, 3))


def test_colliding_terms(monkeypatch):
    monkeypatch.setattr(ranked_search.tn, "word_hashes", lambda b, s, e, which=0: np.zeros(len(s), np.uint64))
    words = [b"one", b"two", b"three"]
    buf = np.frombuffer(b"two six one", np.uint8)
    some, place = ranked_search.Vocabulary(words).find(buf, np.array([0, 4, 8]), np.array([3, 7, 11]))
    assert some.tolist() == [0, 2] and place.tolist() == [1, 0]


def test_jaccard_join_of_repeated_ids(spark):
    from cladewise.llm import jaccard_join

    rng = random.Random(9)
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    near = lambda t: t.replace("x29", "y29")
    rows = [(1, text(1)), (2, text(1)), (2, text(2)), (3, near(text(2))), (3, None), (4, text(4)), (4, text(5)), (5, text(6)), (5, text(7)), (6, near(text(7))), (7, text(4)), (None, text(1)), (None, text(2)), (8, ""), (9, "a b"), (9, "a b")]
    rows += [(rng.randrange(20, 40), near(text(k)) if rng.random() < 0.5 else text(k)) for k in range(100, 110) for _ in range(3)]
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got.collect()) == linked_rows(rows)


def linked_rows(rows):
    """Components of doc_ids whose rows link, the definition pair by pair."""
    from test_corpus_operators import shingles

    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = top(a), top(b)
                if x != y:
                    up[max(x, y)] = min(x, y)
    return sorted((str(i), len(s), str(top(i))) for i, s in sets)
