"""Word-exact encoding with a byte-pair tokenizer of the ``tokenizers`` library.

The vocabulary used here drops white space and ends every pre-token inside a
word, so the ids of a text are the ids of its words one after another.  Words and
their letter, digit and symbol runs are encoded by the library's model once and
kept in bounded caches; whatever the short way does not cover (characters beyond
Latin, control characters, the strings of special tokens) goes through the
library's full encode.  A definition with other rules (see ``word_wise``) gets no
short way: its texts go whole through the library.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from tidemark.llm.shared import split_words

ID_DTYPE = "<u4"
#: The pre-tokenizer's own pattern (a fixed value of the vocabulary file).
PIECE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The rules that the short way has built in (fixed values of the vocabulary file).
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": PIECE_PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_PLAIN = re.compile("[\x21-\x7e\xa1-ɏ]+")
_SPECIAL = "<|"
#: Single marks that are a pre-token of their own after letters.
_MARKS = frozenset([b".", b",", b";", b":", b"!", b"?"])


def _byte_symbols() -> dict[int, str]:
    """Byte -> printable symbol: printable Latin-1 stands for itself, the others
    take the code points from 256 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    symbols, spare = {}, 256
    for b in range(256):
        if b in own:
            symbols[b] = chr(b)
        else:
            symbols[b], spare = chr(spare), spare + 1
    return symbols


def load_tokenizer(definition: str) -> Tokenizer:
    tok = Tokenizer.from_str(definition)
    tok.no_truncation()
    tok.no_padding()
    return tok


def word_wise(definition: str) -> bool:
    """Whether the rules of a definition are those of the short way: the same normalizer
    and pre-tokenizer, byte-pair merges without chance, and special tokens that all hold
    the mark which the short way leaves to the library."""
    d = json.loads(definition)
    model = d["model"]
    return (
        (d["normalizer"], d["pre_tokenizer"], d["post_processor"], d["decoder"]) == (NORMALIZER, PRE_TOKENIZER, None, None)
        and model["type"] == "BPE"
        and not model.get("dropout")
        and all(_SPECIAL in t["content"] and not (t["lstrip"] or t["rstrip"]) for t in d["added_tokens"])
    )


class _Pieces(dict):
    """pre-token -> its ids as little-endian 32-bit integers."""

    def __init__(self, model, limit: int, vocab_size: int) -> None:
        self.model, self.limit, self.symbols = model, limit, _byte_symbols()
        self.packed = [i.to_bytes(4, "little") for i in range(vocab_size)]

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        if not (piece.isascii() and piece.isalpha()):
            shown = piece.encode().decode("latin-1").translate(self.symbols)
        else:
            shown = piece
        packed = self.packed
        ids = self[piece] = b"".join([packed[t.id] for t in self.model.tokenize(shown)])
        return ids


class WordEncoder(dict):
    """word (UTF-8, no ASCII white space) -> its ids as little-endian 32-bit integers."""

    def __init__(self, definition: str, max_words: int = 400_000, max_pieces: int = 100_000) -> None:
        self.tok, self.word_wise = load_tokenizer(definition), word_wise(definition)
        self.pieces = _Pieces(self.tok.model, max_pieces, self.tok.get_vocab_size())
        self.tokenize = self.tok.model.tokenize
        self.limit = max_words
        self.find = regex.compile(PIECE_PATTERN).findall

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        body, last = word[:-1], word[-1:]
        if word.isalpha():  # ASCII letters: one pre-token
            ids = self._letters(word.lower().decode())
        elif last in _MARKS and body.isalpha():
            ids = self[body] + self[last]
        else:
            text = word.decode("utf-8", "replace")
            if _SPECIAL not in text and _PLAIN.fullmatch(text):
                lower = text.lower()
                if lower.isalpha():
                    ids = self._letters("".join(map(self.pieces.symbols.__getitem__, lower.encode())))
                else:
                    ids = b"".join(map(self.pieces.__getitem__, self.find(lower)))
            else:
                ids = self.by_library(text)
        self[word] = ids
        return ids

    def _letters(self, shown: str) -> bytes:
        packed = self.pieces.packed
        return b"".join([packed[t.id] for t in self.tokenize(shown)])

    def forget(self) -> None:
        """Empties the caches."""
        self.clear()
        self.pieces.clear()

    def by_library(self, text: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.tok.encode(text, add_special_tokens=False).ids)

    def encode(self, text: bytes) -> bytes:
        if not self.word_wise:
            return self.by_library(text.decode("utf-8", "replace"))
        return b"".join(map(self.__getitem__, text.split()))

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin (one
        more entry at the end).  Distinct words of the texts are looked up once."""
        if not self.word_wise:
            parts = [self.by_library(t or "") for t in texts.to_pylist()]
            ends = np.cumsum([0, *map(len, parts)]) // 4
            return np.frombuffer(b"".join(parts), dtype=ID_DTYPE), ends
        number, words, begins = split_words(texts)
        packed = list(map(self.__getitem__, words))
        ids = np.frombuffer(b"".join(packed), dtype=ID_DTYPE)
        size = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // 4
        first, reach = np.cumsum(size) - size, size[number]
        ends = np.concatenate([[0], np.cumsum(reach)])
        at = np.repeat(first[number] - ends[:-1], reach) + np.arange(ends[-1])
        return ids[at], ends[begins]


_encoders: dict[int, WordEncoder] = {}


def shared_encoder(definition: str) -> WordEncoder:
    """One encoder per Python worker and vocabulary."""
    key = hash(definition)
    if key not in _encoders:
        _encoders[key] = WordEncoder(definition)
    return _encoders[key]
