"""BPE encoding with content-defined chunk reuse, and decoding.

A rolling hash over the bytes cuts each text where its content says so, hence
copies and shared passages fall into the same chunks in any document.  A chunk is
encoded once and kept; what lies between its first and last white space does not
depend on its neighbours.  At each join the broken words are encoded again in a
window that reaches into both chunks, widened until the window's ids agree exactly
with what both chunks already hold there; if they never do, the document is encoded
whole.

Chunks are kept per Python worker in a cache of bounded size, so no text or id is
ever shuffled; a chunk may be encoded once in each worker.  Chunks rest on words that
are encoded by themselves: texts of a vocabulary with other rules (see
``tokens.word_wise``) are encoded whole.

Defined results for odd input
    null or empty text   no ids, decoded to the empty text
    white space only     no ids
    repeated rows        one result row each
    empty table          an empty result with the full schema
    extra columns        ignored
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import bounded_batches
from tidemark.llm.tokens import ID_DTYPE, WordEncoder

#: log2 of the mean chunk length in bytes.
CHUNK_BITS = 10
WINDOW_DOUBLINGS = 4  # the rolling hash sees 16 bytes
_FACTOR = 0x9E3779B1


def _byte_hashes() -> np.ndarray:
    """A 32-bit value per byte from a multiply-xor rule."""
    x = (np.arange(256, dtype=np.uint64) + 1) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


_HASHES = _byte_hashes()


def cut_points(data: bytes, bits: int = CHUNK_BITS) -> list[int]:
    """Ends of the chunks of ``data``; a cut depends on the 16 bytes before it only."""
    n = len(data)
    if n <= 16:
        return [n]
    h = _HASHES[np.frombuffer(data, dtype=np.uint8)]
    factor, step = _FACTOR, 1
    for _ in range(WINDOW_DOUBLINGS):
        rolled = h.copy()
        rolled[step:] += h[:-step] * np.uint32(factor)
        h, step, factor = rolled, step * 2, factor * factor & 0xFFFFFFFF
    cuts = np.flatnonzero((h[16:] >> np.uint32(32 - bits)) == 0) + 16
    ends = cuts.tolist()
    if not ends or ends[-1] != n:
        ends.append(n)
    return ends


class _Chunk:
    """head and tail: bytes outside the first and last white space (head alone if
    there is none); words: those between, ids: theirs."""

    __slots__ = ("head", "ids", "tail", "whole", "words")

    def __init__(self, data: bytes, words: WordEncoder) -> None:
        parts = data.split(None)
        self.whole = len(parts) <= 1 and not (data[:1].isspace() or data[-1:].isspace())
        self.head = self.tail = b""
        if self.whole:
            self.head, self.words, self.ids = data, [], b""
            return
        if parts and not data[:1].isspace():
            self.head = parts.pop(0)
        if parts and not data[-1:].isspace():
            self.tail = parts.pop()
        self.words = parts
        self.ids = b"".join(map(words.__getitem__, parts))


class ChunkEncoder:
    def __init__(self, words: WordEncoder, bits: int = CHUNK_BITS, max_bytes: int = 32 << 20) -> None:
        self.words, self.bits, self.max_bytes = words, bits, max_bytes
        self.chunks: dict[bytes, _Chunk] = {}
        self.older: dict[bytes, _Chunk] = {}
        self.joins: dict[tuple, bytes] = {}
        self.held = self.encoded = self.reused = self.widened = self.whole = 0
        self.tokens = [words.tok.id_to_token(i) for i in range(words.tok.get_vocab_size())]

    def _chunk(self, data: bytes) -> _Chunk:
        got = self.chunks.get(data)
        if got is None and (got := self.older.pop(data, None)) is not None:
            self._hold(data, got)
        if got is not None:
            self.reused += 1
            return got
        got = _Chunk(data, self.words)
        self._hold(data, got)
        self.encoded += 1
        return got

    def _hold(self, data: bytes, chunk: _Chunk) -> None:
        """Keeps a chunk; when half the room is full, what was not met since the last
        time goes, so shared chunks stay."""
        if self.held > self.max_bytes // 2:
            self.older, self.chunks, self.joins, self.held = self.chunks, {}, {}, 0
        self.chunks[data] = chunk
        self.held += len(data) * 2 + len(chunk.ids) + 60 * len(chunk.words)

    def _repair(self, left: list[bytes], broken: bytes, right: list[bytes]) -> bytes | None:
        """Ids of ``broken``, which lies between words ``left`` and ``right`` whose
        ids are known; None if no window agrees with both sides."""
        if not broken:
            return b""
        k = 1
        while True:
            a, b = left[-k:], right[:k]
            key = (*a, None, broken, None, *b) if k == 1 else None
            if key in self.joins:
                return self.joins[key]
            window = b" ".join([*a, broken, *b]).decode("utf-8", "replace")
            ids = self.words.by_library(window)
            before = b"".join(map(self.words.__getitem__, a))
            after = b"".join(map(self.words.__getitem__, b))
            if len(ids) >= len(before) + len(after) and ids.startswith(before) and ids.endswith(after):
                got = ids[len(before) : len(ids) - len(after)]
                if key is not None:
                    self.joins[key] = got
                    self.held += len(window) + 200
                return got
            if k >= max(len(left), len(right)):
                return None
            self.widened += 1
            k *= 4

    def encode(self, text: bytes) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if not self.words.word_wise:
            return self._whole(text)
        ends = cut_points(text, self.bits)
        if len(ends) == 1 and len(text) < 64:
            return self.words.encode(text)
        out, begin, pending, left = [], 0, b"", []
        for end in ends:
            chunk, begin = self._chunk(text[begin:end]), end
            pending += chunk.head
            if chunk.whole:
                continue
            got = self._repair(left, pending, chunk.words)
            if got is None:
                return self._whole(text)
            out += (got, chunk.ids)
            pending, left = chunk.tail, chunk.words
        got = self._repair(left, pending, [])
        if got is None:
            return self._whole(text)
        out.append(got)
        return b"".join(out)

    def _whole(self, text: bytes) -> bytes:
        self.whole += 1
        return self.words.by_library(text.decode("utf-8", "replace"))

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode; without a decoder that is tokens joined by spaces."""
        if not self.words.word_wise:
            return self.words.tok.decode(ids.tolist(), skip_special_tokens=False)
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


_chunkers: dict[int, ChunkEncoder] = {}


def shared_chunker(definition: str) -> ChunkEncoder:
    key = hash(definition)
    if key not in _chunkers:
        _chunkers[key] = ChunkEncoder(WordEncoder(definition, 200_000, 200_000))
    return _chunkers[key]


def read_definition(path: str) -> str:
    """The vocabulary file (a few MB), read by the driver and broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _bytes_column(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))


def encoded(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every whole text."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_definition(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shared_chunker(shared.value)
        for batch in batches:
            ids = [np.frombuffer(enc.encode(t.as_py()), dtype=ID_DTYPE).astype(np.int32) for t in batch.column(1)]
            col = pa.array(ids, type=pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), col], names=["doc_id", "ids"])

    return _bytes_column(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(encoded_docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and text that the ids decode to."""
    shared = encoded_docs.sparkSession.sparkContext.broadcast(read_definition(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shared_chunker(shared.value)
        for batch in batches:
            texts = [enc.decode(np.array(x.as_py() or [], dtype=np.int64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded_docs.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document n_tokens and the SHA-256 of its ids and of their decoded text,
    in one pass (ids and decoded texts never leave the worker)."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_definition(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shared_chunker(shared.value)
        for batch in batches:
            n, a, b = [], [], []
            for t in batch.column(1):
                raw = enc.encode(t.as_py())
                n.append(len(raw) // 4)
                a.append(hashlib.sha256(raw).hexdigest())
                b.append(hashlib.sha256(enc.decode(np.frombuffer(raw, dtype=ID_DTYPE)).encode()).hexdigest())
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _bytes_column(docs, id_col, text_col).mapInArrow(run, schema)
