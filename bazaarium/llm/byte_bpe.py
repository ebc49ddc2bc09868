"""Byte-level BPE inside tasks: pre-tokens, their ids from the tokenizers library, and a bounded memory of both."""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from functools import cached_property

import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# The pre-token pattern of this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_pretokens = regex.compile(PATTERN).findall
#: The same for ASCII texts, by the faster library.
_ascii_pretokens = re.compile(PATTERN.replace(r"^\s\p{L}\p{N}", r"^\sA-Za-z0-9").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]"), re.ASCII).findall
#: A space before a non-space starts a pre-token in any context, so texts may be cut there.
_cut = re.compile(r" (?=\S)").split
_odd_space = re.compile(r" \s").search
#: ASCII marks that end no letters and begin no contraction: at the end of a word they are one pre-token.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where printable, else the next letter from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_LETTERS = str.maketrans(_byte_letters())
_SPACE = _byte_letters()[32]


class Remembering(dict):
    """``make(key)``, remembered for the last ``2 * limit`` keys or so: when full, the older half is let go."""

    def __init__(self, make, limit: int = 250_000, longest: int = 64):
        self.make, self.limit, self.longest, self.older = make, limit, longest, {}

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        self[key] = value
        return value

    def trim(self) -> None:
        """Call between slices of text."""
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()


def words(text: str) -> list[str]:
    """Cut a text where pre-tokens surely begin; every word but the first lacks the space before it."""
    return text.split(" ") if _odd_space(text) is None else _cut(text)


def spaced_pretokens(word: str) -> list[str]:
    """Pre-tokens of a word that follows a space; letters with marks behind them need no pattern."""
    stem = word.rstrip(_MARKS)
    if not stem.isalpha():
        return (_ascii_pretokens if word.isascii() else _pretokens)(" " + word)
    return [" " + stem, word[len(stem) :]] if len(stem) < len(word) else [" " + word]


class ByteBpe:
    """A tokenizer file whose texts are pre-tokenised by PATTERN and whose pieces are found once per pre-token."""

    def __init__(self, blob: bytes):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(blob.decode())
        self.whole.no_truncation()
        self.whole.no_padding()
        self._pieces = self.whole.model.tokenize
        said = json.loads(blob)
        before = said.get("pre_tokenizer") or {}
        model = said.get("model") or {}
        #: Other kinds of file go through the library text by text.
        self.by_words = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not said.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout")
        self.special = [x["content"] for x in said.get("added_tokens", [])]
        self.vocabulary = self.whole.get_vocab_size()
        self.code = "H" if self.vocabulary < 1 << 16 else "I"

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def piece_ids(self, pretoken: str) -> list[int]:
        """Ids of one pre-token."""
        if pretoken[:1] == " " and pretoken.isascii() and pretoken[1:].isalpha():
            letters = _SPACE + pretoken[1:]
        else:
            letters = pretoken.encode().decode("latin-1").translate(_LETTERS)
        return [t.id for t in self._pieces(letters)]

    def text_ids(self, text: str) -> list[int]:
        """Ids of a whole text from the library itself."""
        return self.whole.encode(text, add_special_tokens=False).ids

    def _packed_pretoken(self, pretoken: str) -> bytes:
        return array(self.code, self.piece_ids(pretoken)).tobytes()

    def _packed_word(self, word: str) -> bytes:
        return b"".join(map(self.packed_parts.__getitem__, _pretokens(word)))

    def _packed_after_space(self, word: str) -> bytes:
        return b"".join(map(self.packed_parts.__getitem__, spaced_pretokens(word)))

    @cached_property
    def packed_parts(self) -> Remembering:
        """Packed ids of a pre-token: words that differ in the marks behind them share it."""
        return Remembering(self._packed_pretoken, 100_000)

    @cached_property
    def packed(self) -> Remembering:
        """Packed ids of a word that follows a space."""
        return Remembering(self._packed_after_space)

    def trim(self) -> None:
        """Call between slices of text."""
        self.packed.trim()
        self.packed_parts.trim()

    def encode(self, text: str) -> bytes:
        """Ids of a text, packed little-endian as ``code`` says; equal to the library's for the whole text."""
        if not self.by_words or self.has_special(text):
            return array(self.code, self.text_ids(text)).tobytes()
        first, *rest = words(text)
        return self._packed_word(first) + b"".join(map(self.packed.__getitem__, rest))

    @cached_property
    def pretokens(self) -> Remembering:
        """Pre-tokens of a word that follows a space."""
        return Remembering(lambda word: tuple(spaced_pretokens(word)))

    def pretokens_of(self, text: str) -> list[str]:
        """Pre-tokens of a short text without special strings."""
        return _pretokens(text)


_open: dict[str, ByteBpe] = {}


def opened(blob: bytes) -> ByteBpe:
    """The tokenizer of this file, kept for the life of the Python worker."""
    key = hashlib.sha256(blob).hexdigest()
    if key not in _open:
        _open[key] = ByteBpe(blob)
    return _open[key]
