"""Ids of texts from a tokenizer file that drops white space, found once per word between ASCII white space."""

from __future__ import annotations

import hashlib
import json
import os
from array import array

import regex

from bazaarium.llm.byte_bpe import _LETTERS, Remembering

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# The normaliser and the pre-token pattern of this family of vocabularies.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Marks that alone are a pre-token after a word of letters.
MARKS = ".,;:!?"

_pretokens = regex.compile(PATTERN).findall
#: Printable letters that no normaliser composes; the cases of each are alike in all libraries.
_plain = regex.compile("[!-~¡-ɏ]+").fullmatch


class WordBpe:
    """A tokenizer file, and a bounded memory of the ids of words.

    White space never is part of a pre-token of such a file nor composes with other letters, so a text's ids are those
    of its words in order.  Texts that hold a special string, and files of other kinds, go through the library whole.
    """

    def __init__(self, blob: bytes):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(blob.decode())
        self.whole.no_truncation()
        self.whole.no_padding()
        said = json.loads(blob)
        before = (said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        model = said.get("model") or {}
        self.by_words = (
            (said.get("normalizer") or {}).get("normalizers") == NORMALIZER and before[0].get("pattern") == {"Regex": PATTERN} and before[0].get("invert") is True and before[0].get("behavior") == "Removed"
            and before[1:] == [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}] and model.get("type") == "BPE" and not model.get("dropout")
        )
        self.special = [x["content"].encode() for x in said.get("added_tokens", [])]
        self.code = "H" if self.whole.get_vocab_size() < 1 << 16 else "I"
        self.packed = Remembering(self._packed)

    def _library(self, text: str) -> bytes:
        return array(self.code, self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _pieces(self, pretoken: str) -> list[int]:
        letters = pretoken if pretoken.isascii() else pretoken.encode().decode("latin-1").translate(_LETTERS)
        return [t.id for t in self.whole.model.tokenize(letters)]

    def _packed(self, word: bytes) -> bytes:
        text = word.decode()
        if not _plain(text):
            return self._library(text)
        if text[-1] in MARKS and text[:-1].isalpha():
            return self.packed[word[:-1]] + self.packed[word[-1:]]
        text = text.lower()
        return array(self.code, self._pieces(text) if text.isalpha() else [i for p in _pretokens(text) for i in self._pieces(p)]).tobytes()

    def encode(self, raw: bytes) -> bytes:
        """Ids of a text in UTF-8, packed little-endian as ``code`` says; equal to the library's.

        A to Z are lower-cased for the whole text at once: they compose with marks as their small letters do.
        """
        if not self.by_words or any(s in raw for s in self.special):
            return self._library(raw.decode())
        return b"".join(map(self.packed.__getitem__, raw.lower().split()))


_open: dict[str, WordBpe] = {}


def opened(blob: bytes) -> WordBpe:
    """The tokenizer of this file, kept for the life of the Python worker."""
    key = hashlib.sha256(blob).hexdigest()
    if key not in _open:
        _open[key] = WordBpe(blob)
    return _open[key]
