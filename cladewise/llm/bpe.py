"""BPE encoding and decoding by per-prefix dynamic programming.

For a word of symbols c1..cn (the last one carries the end-of-word mark), the
encoding of every prefix ends in one token. It is the one token t that is a
suffix of the prefix and may follow the last token u of the prefix before it;
u may precede t when merging the symbols of u and t together gives u and t
again. So one pass over the word, taking the tokens that end at each place from
an Aho-Corasick automaton (the suffix matches), stores the last token of every
prefix, and the back-pointers from the end give the exact ids.

The pair test follows the two pieces that touch at the border while the merges
run: the right spine of u's merge tree and the left spine of t's. The border is
crossed when a merge of two touching pieces comes before the merges that use
them up. This holds where every merge comes after those that made its parts,
which is checked when the vocabulary is loaded.

Different pieces of a slice (pre-tokens of ASCII words, any other word
``[^\\x20\\x09-\\x0D]+``) are encoded once and looked up after that,
their bytes compared, so that no hash decides which piece it is; a bounded memo
keeps the ids of pieces across slices. Work on a text is linear in its length,
and no text is cut.

Defined results: null text counts as empty: no ids, empty decoded text. The
strings of special tokens in a text give their ids, as in the library. Rows
that repeat are encoded each. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cladewise.llm import textnp as tn
from cladewise.session import bounded_batches

#: Pieces, and pairs of tokens, that a worker remembers; at most this many of each, then it starts again.
MEMO = 300_000
#: Borders of tokens that a worker remembers.
SPINES = 20_000
_END = "\0"
_NEVER = 1 << 60


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class WordBpe:
    """Encoder and decoder of one vocabulary file (word ends marked by a suffix)."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.names = {i: t for t, i in {**vocab, **self.special}.items()}
        self.rank: dict[tuple[int, int], int] = {}
        # For each token: the merge that makes it, and its two parts.
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            key = (vocab[a], vocab[b])
            self.rank.setdefault(key, r)
            self.made.setdefault(vocab[a + b], (r, *key))
        self.ordered = all(r > max(self.made.get(a, (-1,))[0], self.made.get(b, (-1,))[0]) for r, a, b in self.made.values())
        self.spines: tuple[dict, dict] = ({}, {})
        self.pairs: dict[int, bool] = {}
        self.symbols: dict[int, tuple[int, ...]] = {}
        self.match = ahocorasick.Automaton()
        for text, i in vocab.items():
            if i not in self.made or self._merged(self._symbols(i)) == (i,):
                ends = text.endswith(suffix)
                body = text[: -len(suffix)] if ends else text
                self.match.add_word(body + _END * ends, (i, len(body) + ends))
        self.match.make_automaton()
        # White space of the vocabulary's pattern: fixed values.
        space = r"\t-\r\x20\x85\xa0  -     　"
        self.pieces_of = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{space}\p{{L}}\p{{N}}]+").findall
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.to_chars = dict(enumerate(_byte_chars()))
        self.memo: dict[bytes, array] = {}
        self.decimal = [str(i) for i in range(max(self.names) + 1)]

    # -- the pair test ------------------------------------------------------------

    def _symbols(self, token: int) -> tuple[int, ...]:
        got = self.symbols.get(token)
        if got is None:
            made = self.made.get(token)
            got = self.symbols[token] = (token,) if made is None else self._symbols(made[1]) + self._symbols(made[2])
        return got

    def _merged(self, symbols: tuple[int, ...]) -> tuple[int, ...]:
        """The merges applied one by one: the definition, used to check the vocabulary."""
        parts = list(symbols)
        while len(parts) > 1:
            r, i = min((self.rank.get(p, _NEVER), i) for i, p in enumerate(zip(parts, parts[1:])))
            if r == _NEVER:
                break
            parts[i : i + 2] = [self._join(parts[i], parts[i + 1])]
        return tuple(parts)

    def _join(self, a: int, b: int) -> int:
        found = self.__dict__.setdefault("joined", {})
        if not found:
            found.update({(x, y): t for t, (_, x, y) in self.made.items()})
        return found[a, b]

    def _spine(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """Pieces at one border of a token: (piece, when made, when used up)."""
        got = self.spines[side].get(token)
        if got is None:
            if len(self.spines[side]) > SPINES:
                self.spines[side].clear()
            got, piece, used = [], token, _NEVER
            while True:
                made = self.made.get(piece)
                got.append((piece, -1 if made is None else made[0], used))
                if made is None:
                    break
                piece, used = made[1 if side else 2], made[0]
            self.spines[side][token] = got
        return got

    def _may_follow(self, u: int, t: int) -> bool:
        if not self.ordered:
            return self._merged(self._symbols(u) + self._symbols(t)) == (u, t)
        rank = self.rank
        for a, a_made, a_used in self._spine(u, 0):
            for b, b_made, b_used in self._spine(t, 1):
                if a_made < b_used and b_made < a_used:
                    r = rank.get((a, b), _NEVER)
                    # Of equal merges the left one comes first.
                    if r < a_used and r <= b_used and r != _NEVER:
                        return False
        return True

    # -- words ----------------------------------------------------------------------

    def piece_ids(self, piece: str) -> list[int]:
        """Ids of one pre-token, by the last token of every prefix."""
        word = (piece if piece.isascii() and piece.isalnum() else piece.encode().decode("latin-1").translate(self.to_chars)) + _END
        n = len(word)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        pairs = self.pairs
        for end, (token, length) in self.match.iter(word):
            i = end + 1
            if last[i] >= 0:
                continue
            s = i - length
            if s:
                u = last[s]
                if u < 0:
                    continue
                key = u << 20 | token
                ok = pairs.get(key)
                if ok is None:
                    if len(pairs) > MEMO:
                        pairs.clear()
                    ok = pairs[key] = self._may_follow(u, token)
                if not ok:
                    continue
            last[i], back[i] = token, s
        ids, i = [], n
        while i:
            ids.append(last[i])
            i = back[i]
        return ids[::-1]

    def _odd(self, word: str) -> list[int]:
        """Ids of a word that is not all ASCII letters."""
        out: list[int] = []
        for k, part in enumerate(self.split_special(word) if self.split_special else [word]):
            if k % 2:
                out.append(self.special[part])
            elif part:
                low = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                for piece in self.pieces_of(low):
                    out += self.ids_of(piece.encode(), True)
        return out

    def ids_of(self, word: bytes, plain: bool) -> array:
        """Ids of a word, from the memo if they are there; plain: one pre-token already."""
        got = self.memo.get(word)
        if got is None:
            text = word.decode("utf-8", "replace")
            got = array("I", self.piece_ids(text) if plain else self._odd(text))
            if len(self.memo) >= MEMO:
                self.memo.clear()
            if plain:
                self.memo[word] = got
        return got


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """The vocabulary, read once by each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


# Classes of bytes: 0 white, 1 ASCII letter, 2 digit, 3 other ASCII that makes a pre-token with its like, 4 the rest.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[tn.SPACE] = 0
_CLASS[0x21:0x7F] = 3
_CLASS[[ord("'"), ord("<")]] = 4
_CLASS[ord("0") : ord("9") + 1] = 2
for _first in "aA":
    _CLASS[ord(_first) : ord(_first) + 26] = 1
# Letters U+00C0 to U+00FF are this byte and one of 0x80 to 0xBF; two places are no letters; capitals come before 0x9F.
_LATIN, _NO_LETTERS, _LAST_CAPITAL = 0xC3, (0x97, 0xB7), 0x9E
_CLASS[_LATIN] = 1


def distinct_pieces(buf: np.ndarray, offs: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Different pieces of a slice, which of them are plain, which one each piece is, and each text's first piece.

    A word of ASCII without ' and <, and of letters up to U+00FF, is cut into the
    pre-tokens of the vocabulary's pattern: runs of letters (in lower case), single
    digits, runs of other characters. These pieces are plain. Any other word is one
    piece as it stands.
    Pieces of one hash are one piece only where their bytes are the same.
    """
    starts, ends, firsts = tn.words(buf, offs)
    if not len(starts):
        return [], np.zeros(0, bool), np.zeros(0, np.int64), firsts
    kind, lower = _CLASS[buf], tn.LOWER[buf]
    at = np.flatnonzero(buf[:-1] == _LATIN) + 1
    second = buf[at]
    kind[at] = np.where(np.isin(second, _NO_LETTERS), 4, 1)
    lower[at] = second + 32 * (second <= _LAST_CAPITAL).astype(np.uint8)
    rest = np.zeros(len(buf) + 1, np.int32)
    np.cumsum(kind == 4, out=rest[1:])
    odd = rest[ends] > rest[starts]
    step = np.zeros(len(buf) + 1, np.int8)
    step[starts[odd]] += 1
    step[ends[odd]] -= 1
    whole_word = np.cumsum(step[:-1], dtype=np.int8).view(bool)
    low = np.where(whole_word, buf, lower)
    begins = np.zeros(len(buf), bool)
    begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    begins &= (kind > 0) & ~whole_word
    begins[starts] = True
    s = np.flatnonzero(begins)
    n = len(s)
    at_start = np.zeros(len(buf), bool)
    at_start[starts] = True
    heads = np.flatnonzero(at_start[s])
    word = np.zeros(n, np.int64)
    word[heads[1:]] = 1
    np.cumsum(word, out=word)
    e, plain = ends[word], ~odd[word]
    e[:-1] = np.minimum(e[:-1], s[1:])
    firsts = np.r_[heads, n][firsts]

    import pandas as pd

    which, _ = pd.factorize(tn.word_hashes(low, s, e))
    one = np.empty(int(which.max()) + 1, np.int64)
    one[which[::-1]] = np.arange(n - 1, -1, -1)
    size, first = e - s, one[which]
    heading = tn.first_eight(low, s, size)
    same = (size == size[first]) & (heading == heading[first])
    long = np.flatnonzero(same & (size > 8))
    same[long] = tn.same_bytes(low, s[long], s[first[long]], size[long])
    whole = low.tobytes()
    found, plain_found = [whole[a:b] for a, b in zip(s[one].tolist(), e[one].tolist())], plain[one]
    if not same.all():
        numbers: dict[bytes, int] = {}
        for i in np.flatnonzero(~same).tolist():
            piece = whole[s[i] : e[i]]
            if piece not in numbers:
                numbers[piece] = len(found)
                found.append(piece)
                plain_found = np.append(plain_found, plain[i])
            which[i] = numbers[piece]
    return found, plain_found, which, firsts


class Encoded:
    """Ids and texts of a slice, put together from its pieces."""

    def __init__(self, bpe: WordBpe, buf: np.ndarray, offs: np.ndarray):
        found, plain, self.which, self.firsts = distinct_pieces(buf, offs)
        made = [bpe.ids_of(w, p) for w, p in zip(found, plain.tolist())]
        self.counts = np.fromiter(map(len, made), np.int64, len(made))
        # Decimal and text form are made once for a slice; the memo holds the ids alone.
        decimal, names = bpe.decimal, bpe.names
        self.ids, self.texts = [" ".join(map(decimal.__getitem__, x)) for x in made], [" ".join(map(names.__getitem__, x)) for x in made]
        self.flat = np.frombuffer(b"".join(made), np.uint32)
        upto = np.zeros(len(self.which) + 1, np.int64)
        if len(self.which):
            np.cumsum(self.counts[self.which], out=upto[1:])
        self.upto, self.totals = upto, np.diff(upto[self.firsts])

    def strings(self) -> Iterator[tuple[str, str]]:
        """Per text: ids joined by spaces, decoded text."""
        some = self.counts[self.which] > 0 if len(self.which) else np.zeros(0, bool)
        gaps = not some.all()
        for a, b in zip(self.firsts[:-1].tolist(), self.firsts[1:].tolist()):
            at = self.which[a:b]
            if gaps:
                at = at[some[a:b]]
            at = at.tolist()
            yield " ".join([self.ids[k] for k in at]), " ".join([self.texts[k] for k in at])

    def lists(self) -> pa.ListArray:
        """Per text: its ids."""
        n = self.counts[self.which] if len(self.which) else np.zeros(0, np.int64)
        heads = np.cumsum(self.counts) - self.counts
        at = np.arange(int(self.upto[-1])) + (np.repeat(heads[self.which] - self.upto[:-1], n) if len(n) else 0)
        return pa.ListArray.from_arrays(pa.array(self.upto[self.firsts].astype(np.int32)), pa.array(self.flat[at].astype(np.int32)))


def encode_slice(bpe: WordBpe, buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[str, str, int]]:
    """Per text: ids joined by spaces, decoded text, number of ids."""
    made = Encoded(bpe, buf, offs)
    for (ids, text), n in zip(made.strings(), made.totals.tolist()):
        yield ids, text, n


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and
    what ``keep`` names of ids (array of numbers) and decoded (text)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in tn.gathered(batches):
            for rows, buf, offs in tn.slices(batch, most=2 * tn.SLICE_BYTES):
                made = Encoded(bpe, buf, offs)
                shas, texts = [], []
                for ids, text in made.strings():
                    shas.append((hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
                    if "decoded" in keep:
                        texts.append(text)
                cols = [rows.column("doc_id"), pa.array(made.totals), pa.array([x[0] for x in shas], pa.string()), pa.array([x[1] for x in shas], pa.string())]
                more = {"ids": made.lists, "decoded": lambda: pa.array(texts, pa.string())}  # noqa: B023
                yield pa.RecordBatch.from_arrays(cols + [more[k]() for k in keep], names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *keep]
    docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kinds = {"ids": "array<int>", "decoded": "string"}
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + "".join(f", {k} {kinds[k]}" for k in keep)
    return docs.mapInArrow(run, schema)
