"""BPE encoding and decoding by content-defined chunk reuse.

A text is cut where a rolling hash of its last eight bytes is small, so equal passages are cut alike wherever they
stand. Each distinct chunk is encoded once in a task and reused across that task's documents. A chunk is kept as
(head, middle, tail): head ends at the chunk's first sure token border, tail starts at its last. The middle's ids hold
in any surroundings. At each join, tail and next head are re-encoded as one piece, reaching further chunks while no sure
border has come, so that the ids agree exactly with an encoding of the whole text.

A sure border lies between a character that is not white space and an ASCII space: the byte-level splitting pattern
never matches across it, and its only look-ahead concerns white space before it.

Reuse is kept within a task (the README has figures of what a shuffle of chunks would move); the caches have a bounded
number of bytes and forget their older generation when full, which changes time only, never ids. Pieces with a long run
of white space, and pieces of more than LARGE characters, go to the library itself, whose time and stack stay bounded.

Defined cases: null text is encoded as empty text (no ids); null doc_id stays null; repeated rows give repeated rows, and
there are no ties to break; very long texts, without any border too, are encoded whole; an empty table gives an empty
result; columns beside id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstream.llm.common import mapped, slices, utf8

_BORDER = re.compile(r"\S(?= )")
_SPACES = re.compile(r"\s{256}")
_HASH_BYTES = 8
LEAST_CHUNK = 32
LARGE = 1 << 15


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


#: Fixed value: the splitting pattern of byte-level BPE.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def piece_codec(path: str):
    """An encoding with the vocabulary and special tokens of a byte-level BPE file; faster than the library on pieces."""
    import tiktoken

    spec = json.loads(Path(path).read_text())
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in plain)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("pieces", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens=special)


class Generations:
    """A dictionary that holds about most_bytes: when the young half is full it becomes the old half."""

    def __init__(self, most_bytes: int):
        self.most, self.held = most_bytes // 2, 0
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found, 200)
        return found

    def put(self, key, value, cost: int) -> None:
        if self.held > self.most:
            self.old, self.young, self.held = self.young, {}, 0
        self.young[key] = value
        self.held += cost


def cut_points(data: np.ndarray, mean_bits: int) -> np.ndarray:
    """Positions after whose preceding eight bytes the rolling hash has mean_bits zero bits, at borders of characters."""
    n = len(data)
    if n <= _HASH_BYTES:
        return np.empty(0, np.int64)
    wide = data.astype(np.uint32)
    h = np.zeros(n - _HASH_BYTES, np.uint32)
    for k in range(_HASH_BYTES):  # the polynomial hash of data[i : i + 8], for each cut position i + 8
        h *= np.uint32(0x01000193)
        h += wide[k : k + n - _HASH_BYTES]
    h *= np.uint32(0x9E3779B1)
    small = np.flatnonzero(h >> np.uint32(32 - mean_bits) == 0) + _HASH_BYTES
    return small[(data[small] & 0xC0) != 0x80]


def sure_borders(text: str) -> tuple[int, int]:
    """The first and the last position where an ASCII space follows a character that is not white space; (-1, -1) if none."""
    first = _BORDER.search(text)
    if not first:
        return -1, -1
    at = text.rfind(" ")
    while text[at - 1].isspace():  # ends at the first border at the latest
        at = text.rfind(" ", 0, at)
    return first.end(), at


class ChunkEncoder:
    """Encodes whole texts with reuse of chunks; ids are kept as little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer_path: str, mean_bits: int = 9, cache_bytes: int = 24 << 20):
        self.path, self.library = tokenizer_path, None
        self.codec = piece_codec(tokenizer_path)
        self.special = sorted(self.codec.special_tokens_set)
        self.mean_bits = mean_bits
        self.chunks = Generations(cache_bytes)  # chunk -> (head, ids, decoded, tail), or () without a sure border
        self.stats = {"chunks": 0, "reused": 0, "joins": 0}

    def piece(self, text: str) -> tuple[bytes, bytes]:
        """The ids of a text that starts and ends at sure borders, and the bytes decoded from them."""
        if not text:
            return b"", b""
        if len(text) > LARGE or _SPACES.search(text):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
                self.library.no_truncation()
                self.library.no_padding()
            ids = self.library.encode(text, add_special_tokens=False).ids
            return np.array(ids, "<u4").tobytes(), self.library.decode(ids, skip_special_tokens=False).encode()
        ids = self.codec.encode(text, allowed_special="all") if any(x in text for x in self.special) else self.codec.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes(), self.codec.decode_bytes(ids)

    def chunk(self, text: str) -> tuple:
        self.stats["chunks"] += 1
        if (found := self.chunks.get(text)) is not None:
            self.stats["reused"] += 1
            return found
        first, last = sure_borders(text)
        entry = () if first < 0 else (text[:first], *self.piece(text[first:last]), text[last:])
        self.chunks.put(text, entry, 400 + 6 * len(text))
        return entry

    def encode(self, cuts: np.ndarray, raw: bytes) -> tuple[bytes, bytes]:
        """The ids and the decoded text; cuts: byte positions within raw, the text's UTF-8."""
        ids: list[bytes] = []
        back: list[bytes] = []
        carry, at = [], 0
        for end in [*cuts.tolist(), len(raw)]:
            if end - at < LEAST_CHUNK and end < len(raw):
                continue
            part = raw[at:end].decode()
            at = end
            entry = self.chunk(part)
            if not entry:
                carry.append(part)
                continue
            head, mid, mid_text, tail = entry
            self.stats["joins"] += 1
            i, d = self.piece("".join([*carry, head]))
            ids += [i, mid]
            back += [d, mid_text]
            carry = [tail]
        i, d = self.piece("".join(carry))
        return b"".join([*ids, i]), b"".join([*back, d])

    def encode_batch(self, raws: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        data = np.frombuffer(b"".join(raws), np.uint8)
        ends = np.cumsum([len(r) for r in raws])
        cuts = cut_points(data, self.mean_bits)
        for k, raw in enumerate(raws):
            start = int(ends[k]) - len(raw)
            own = cuts[np.searchsorted(cuts, start + _HASH_BYTES) : np.searchsorted(cuts, ends[k])] - start
            yield self.encode(own, raw)


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def _encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def _digest_rows(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for batch in slices(batches, most_bytes=1 << 20):
            n, a, b = [], [], []
            for ids, back in enc.encode_batch(utf8(batch.column("text"))):
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(back).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _token_rows(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for batch in slices(batches, most_bytes=1 << 20):
            got = list(enc.encode_batch(utf8(batch.column("text"))))
            ids = [np.frombuffer(i, "<u4").astype(np.int32) for i, _ in got]
            offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.empty(0, np.int32)])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array([d.decode("utf-8", "replace") for _, d in got], pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids and the text decoded from them: (doc_id, ids array<int>, decoded string)."""
    src = _source(docs, id_col, text_col)
    kind = src.schema["doc_id"].dataType.simpleString()
    return mapped(src, _token_rows(tokenizer_path), f"doc_id {kind}, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_documents, with counts and SHA-256 digests instead of the ids and texts themselves."""
    src = _source(docs, id_col, text_col)
    kind = src.schema["doc_id"].dataType.simpleString()
    return mapped(src, _digest_rows(tokenizer_path), f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
