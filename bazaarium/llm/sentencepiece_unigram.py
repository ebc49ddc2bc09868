"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The pieces and their scores come from a model file; scores count as log-probabilities.  Of all ways to cut a text into
pieces, the one with the greatest sum is taken; a character that no piece covers goes to its UTF-8 bytes.  Spaces are
written U+2581, with one before the text; no other normalisation is done.  Since no piece of the file has a marker after
another character, the text falls into words that are cut independently, so each distinct word is cut once; many
words are cut at a time in numpy, walking the trie for all of them together.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bazaarium.llm.tables import id_and_text, slices, tidy

MARK = "▁"
#: An uncovered character costs this much more than the worst piece.
UNCOVERED = 10.0
#: Words longer than this are cut one at a time.
WIDE = 40
#: Remembered words: two generations of so many.
REMEMBERED = 100_000
_words = re.compile(r" *[^ ]+| +$").findall


class DoubleArray:
    """A trie in two arrays: from state s, character code c leads to base[s] + c if check there is s."""

    def __init__(self, keys: list[str]):
        # The commonest characters get the smallest codes, which keeps the arrays dense.
        letters = [c for c, _ in Counter(c for k in keys for c in k).most_common()]
        #: Code of each character, 0 for those in no key.
        self.codes = {c: i + 1 for i, c in enumerate(letters)}
        tree: dict = {}
        for n, key in enumerate(keys):
            node = tree
            for c in key:
                node = node.setdefault(self.codes[c], {})
            node[0] = n
        size = sum(map(len, keys)) + 2 * len(letters) + 1024
        self.base, self.check, self.value = (np.full(size, fill, np.int32) for fill in (0, -1, -1))
        taken = bytearray(size)
        taken[0] = 1
        queue, top = [(0, tree)], 0
        # Single children fill the holes from the left; the search for wider nodes never goes back.
        free = wide = 1
        for state, node in queue:
            if 0 in node:
                self.value[state] = node[0]
            codes = sorted(c for c in node if c)
            if not codes:
                continue
            at = taken.find(0, max(free if len(codes) == 1 else wide, codes[0] + 1))
            while any(taken[at - codes[0] + c] for c in codes):
                at = taken.find(0, at + 1)
            if len(codes) > 1:
                wide = at + 1
            elif at == taken.find(0, free):
                free = at
            base = at - codes[0]
            self.base[state] = base
            for c in codes:
                taken[base + c] = 1
                self.check[base + c] = state
                queue.append((base + c, node[c]))
                top = max(top, base + c)
        # Room for any code after any base.
        self.base, self.check, self.value = (np.concatenate([a[: top + 1], np.full(len(letters) + 2, fill, np.int32)]) for a, fill in ((self.base, 0), (self.check, -1), (self.value, -1)))
        self.longest = max(map(len, keys), default=0)

    def code_table(self) -> np.ndarray:
        """Codes by code point."""
        table = np.zeros(0x110000, np.int32)
        table[[ord(c) for c in self.codes]] = list(self.codes.values())
        return table


class Unigram:
    """Encoder and decoder of one model file."""

    def __init__(self, blob: bytes):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=blob)
        ids = range(model.get_piece_size())
        self.pieces = [model.id_to_piece(i) for i in ids]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in ids if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.usable = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.trie = DoubleArray([self.pieces[i] for i in self.usable])
        self.scores = np.array([model.get_score(i) for i in self.usable])
        self.uncovered = float(self.scores.min()) - UNCOVERED
        #: Whether words are independent.
        self.by_words = not any(MARK in self.pieces[i].lstrip(MARK) for i in self.usable)
        self.kind = np.dtype("<u2" if len(self.pieces) <= 1 << 16 else "<u4")
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        plain = {i: self.pieces[i].replace(MARK, " ").encode() for i in self.usable}
        self.spelled = [plain.get(i, b"") for i in ids]
        for b, i in self.byte_ids.items():
            self.spelled[i] = bytes([b])
        self.spelled[self.unknown] = " ⁇ ".encode()

    @cached_property
    def code_of(self) -> np.ndarray:
        return self.trie.code_table()

    def _fallback(self, char: str) -> list[int]:
        found = [self.byte_ids.get(b, self.unknown) for b in char.encode()]
        return [self.unknown] if self.unknown in found else found

    def _trace(self, text: str, piece: np.ndarray, size: np.ndarray) -> bytes:
        """Ids along the best path, from the last piece and its size at each place."""
        out: list[int] = []
        at = len(text)
        while at:
            n, p = int(size[at]), int(piece[at])
            out += self._fallback(text[at - 1])[::-1] if p < 0 else [self.usable[p]]
            at -= n
        return np.array(out[::-1], self.kind).tobytes()

    def cut_one(self, text: str) -> bytes:
        """Viterbi over one string with markers."""
        trie, codes = self.trie, [self.trie.codes.get(c, 0) for c in text]
        base, check, value, scores = trie.base, trie.check, trie.value, self.scores
        n = len(text)
        best, piece, size = np.full(n + 1, -np.inf), np.full(n + 1, -1), np.ones(n + 1, int)
        best[0] = 0.0
        for s in range(n):
            state, single, here = 0, False, best[s]
            for e in range(s + 1, min(n, s + trie.longest) + 1):
                code = codes[e - 1]
                to = base[state] + code
                if not code or check[to] != state:
                    break
                state = to
                p = value[state]
                if p >= 0:
                    single |= e == s + 1
                    if here + scores[p] > best[e]:
                        best[e], piece[e], size[e] = here + scores[p], p, e - s
            if not single and here + self.uncovered > best[s + 1]:
                best[s + 1], piece[s + 1], size[s + 1] = here + self.uncovered, -1, 1
        return self._trace(text, piece, size)

    def cut_many(self, texts: list[str]) -> list[bytes]:
        """Viterbi over many short strings at once."""
        trie, m = self.trie, len(texts)
        lengths = np.array([len(t) for t in texts])
        wide = int(lengths.max(initial=0))
        codes = np.zeros((m, wide), np.int32)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.arange(wide)[None, :] < lengths[:, None]
        codes[inside] = self.code_of[points]
        best = np.full((m, wide + 1), -np.inf)
        best[:, 0] = 0.0
        piece, size = np.full((m, wide + 1), -1, np.int32), np.ones((m, wide + 1), np.int32)
        for s in range(wide):
            rows = np.flatnonzero(lengths > s)
            alone = np.ones(m, bool)
            at, state = rows, np.zeros(len(rows), np.int32)
            for e in range(s + 1, min(wide, s + trie.longest) + 1):
                code = codes[at, e - 1]
                to = trie.base[state] + code
                ok = (code > 0) & (trie.check[to] == state)
                at, state = at[ok], to[ok]
                if not len(at):
                    break
                p = trie.value[state]
                hit = p >= 0
                r, p = at[hit], p[hit]
                if e == s + 1:
                    alone[r] = False
                total = best[r, s] + self.scores[p]
                up = total > best[r, e]
                r = r[up]
                best[r, e], piece[r, e], size[r, e] = total[up], p[up], e - s
            r = rows[alone[rows]]
            total = best[r, s] + self.uncovered
            up = total > best[r, s + 1]
            r = r[up]
            best[r, s + 1], piece[r, s + 1], size[r, s + 1] = total[up], -1, 1
        return self._traced(texts, lengths, piece, size)

    def _traced(self, texts: list[str], lengths: np.ndarray, piece: np.ndarray, size: np.ndarray) -> list[bytes]:
        """Walk all best paths back together."""
        m, wide = len(texts), piece.shape[1] - 1
        ids = np.zeros((m, wide), self.kind)
        count, at, odd = np.zeros(m, np.int64), lengths.copy(), np.zeros(m, bool)
        usable = np.array(self.usable, self.kind)
        rows = np.flatnonzero(at > 0)
        while len(rows):
            p = piece[rows, at[rows]]
            odd[rows[p < 0]] = True
            ids[rows, wide - 1 - count[rows]] = usable[p]
            at[rows] -= size[rows, at[rows]]
            count[rows] += 1
            rows = rows[at[rows] > 0]
        return [self._trace(t, piece[i], size[i]) if odd[i] else ids[i, wide - count[i] :].tobytes() for i, t in enumerate(texts)]

    def _learn(self, words: set[str]) -> None:
        """Cut the words not remembered."""
        if len(self.recent) > REMEMBERED:
            self.older, self.recent = self.recent, {}
        new = []
        for w in words:
            if w not in self.recent:
                old = self.older.get(w)
                if old is None:
                    new.append(w)
                else:
                    self.recent[w] = old
        new.sort(key=len)
        short = [w for w in new if len(w) < WIDE]
        for i in range(0, len(short), 8192):
            part = short[i : i + 8192]
            self.recent.update(zip(part, self.cut_many([MARK + w for w in part]), strict=True))
        for w in new[len(short) :]:
            self.recent[w] = self.cut_one(MARK + w)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; an empty text has none."""
        if not self.by_words:
            return [self.cut_one((MARK + t).replace(" ", MARK)) if t else b"" for t in texts]
        cut, words = [], set()
        for t in texts:
            if not t:
                parts = []
            elif "  " in t or t[0] == " " or t[-1] == " ":
                # A run of spaces belongs to the word after it; its first marker is the one every word has.
                parts = [w[1:].replace(" ", MARK) for w in _words(" " + t)]
            else:
                parts = t.split(" ")
            cut.append(parts)
            words.update(parts)
        self._learn(words)
        found = self.recent.__getitem__
        return [b"".join(map(found, parts)) for parts in cut]

    def decode(self, ids: np.ndarray) -> str:
        """Text of some ids: bytes join to characters, markers turn to spaces, the first one goes."""
        raw = b"".join(map(self.spelled.__getitem__, ids.tolist()))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


_open: dict[int, Unigram] = {}


def opened(blob: bytes) -> Unigram:
    """The encoder of this file, kept for the life of the Python worker."""
    key = zlib.crc32(blob) << 32 | len(blob)
    if key not in _open:
        _open[key] = Unigram(blob)
    return _open[key]


def encoded(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, ids) for every row of ``docs``; ids is an array of int, empty for a null or empty text.

    Rows that repeat keep a row each; only doc_id and text are read.
    """
    file = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram = opened(file.value)
        for batch in batches:
            for part in slices(batch):
                packed = unigram.encode(part.column("text").to_pylist())
                counts = np.array([len(p) for p in packed]) // unigram.kind.itemsize
                values = np.frombuffer(b"".join(packed), unigram.kind).astype(np.int32)
                ids = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(values))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(tidy(run), "doc_id long, ids array<int>")


def decoded(ids: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, text) from (doc_id, ids); null ids count as none, and give an empty text.

    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit integers.
    """
    file = ids.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram = opened(file.value)
        for batch in batches:
            texts, sizes, crcs = [], [], []
            for row in batch.column("ids"):
                own = row.values.to_numpy() if row.is_valid else np.zeros(0, np.int32)
                texts.append(unigram.decode(own))
                sizes.append(len(own))
                crcs.append(zlib.crc32(own.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_pieces", "ids_crc32", "text"])

    return ids.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, n_pieces long, ids_crc32 long, text string")
