"""Language-model scoring by prediction by partial matching over bytes, with all counts of the whole training corpus.

A text is read as its lower-cased words, each followed by a space, then one end mark. The model counts every (context of
ORDER bytes, next byte), most recent byte first, so that the counts of all shorter contexts are sums over ranges of them:
the byte-context trie. Nothing is pruned: the trie grows with the corpus and never stands in one place. A context's escape
mass is DISCOUNT of a count for each of its bytes, taken from their counts. After an escape, bytes that the longer context
has are excluded from the shorter one's counts; a byte that no order has gets an equal part of what the empty context's
escape leaves among the other byte values. The probabilities of all 256 bytes add up to one in every context.

The trie is dealt out by its contexts' last two bytes, in GROUPS groups: all longer contexts of a group lie in it, and the
shorter ones (at most 2^16 counts) are broadcast. Texts are packed in chunks of some megabytes. Each chunk sends every
group its distinct (context, byte) keys with their training counts, once; the groups add them up, and answer with the
keys' log probabilities; a chunk's texts meet the answers and add up code lengths over whole texts. Whole words take the
same way for the base score. No row stands for a single byte or word, keys are sent once for a chunk however often they
stand in it, and a group that many chunks ask is answered in SHARE chunks at a time by copies of its counts.

Defined cases: null text is empty text (one end token); a null doc_id counts as empty text in the split; repeated rows
are scored each, and there are no ties to break; very long texts are scored whole, as a chunk of their own; without
training texts every byte has probability 1/256 and the base is that of its formula; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from veilstream.llm.common import mapped, materialize, slices, utf8

ORDER = 6
#: What escape estimation takes from each byte's count for bytes not seen in a context.
DISCOUNT = 0.4
END = 0x0A
GROUPS, WORD_GROUPS = 1024, 256
CHUNK_BYTES = 16 << 20
#: Chunks that a copy of a group's counts answers.
SHARE = 64
_DOCS = 1 << 30  # in place of a group's number: the texts of a chunk
_SLICE = 1 << 20
_MERGE = 4_000_000


def word_key(word: bytes) -> int:
    """Signed 64-bit hash; the end token is the empty word."""
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def stream_of(words: list[bytes]) -> bytes:
    return b" ".join([*words, bytes([END])]) if words else bytes([END])


def gram_keys(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the streams its key, context above and the byte itself lowest; and where each stream starts."""
    pad = bytes([END]) * ORDER
    data = np.frombuffer(pad + pad.join(streams) if streams else b"", np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, streams), np.int64, len(streams))
    first = np.cumsum(sizes + ORDER) - sizes
    starts = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum())) + np.repeat(first - starts, sizes)
    key = data.copy()
    for back in range(1, ORDER + 1):  # the most recent byte is the highest
        key[back:] |= data[: len(data) - back] << 8 * (ORDER + 1 - back)
    return key[at], starts


def group_of(keys: np.ndarray) -> np.ndarray:
    """The group of a (context, byte) key, by its context's last two bytes."""
    return ((keys >> 8 * (ORDER - 1)) * 40503 >> 4) & (GROUPS - 1)


def word_group_of(keys: np.ndarray) -> np.ndarray:
    return GROUPS + ((keys >> 20) & (WORD_GROUPS - 1))


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as byte planes, compressed: high planes of small numbers are all zero."""
    planes = np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<i8").astype(np.int64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys, by their differences (which may wrap around)."""
    return pack(np.diff(keys, prepend=np.int64(0)))


def unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.int64)


class Sums:
    """Counts by key, merged now and then; held in sorted arrays."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.held.append((keys, counts))
        self.waiting += len(keys)
        if self.waiting > _MERGE:
            self.held = [self.merged()]
            self.waiting = 0

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        keys, counts = np.concatenate([k for k, _ in self.held]), np.concatenate([c for _, c in self.held])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        return keys[at], np.add.reduceat(counts, at) if len(at) else counts


class _Chunk:
    """Texts on their way into a chunk, and the keys that they need."""

    def __init__(self, number: int):
        self.number, self.size = number, 0
        self.grams, self.words, self.asked = Sums(), Counter(), set()
        self.raw: dict[bool, list[np.ndarray]] = {True: [], False: []}
        self.rows: list[tuple] = []

    def flush(self) -> None:
        for learnt, held in self.raw.items():
            if held:
                keys, counts = np.unique(np.concatenate(held), return_counts=True)
                held.clear()
                self.grams.add(keys, counts if learnt else np.zeros(len(keys), np.int64))

    def add(self, ids: pa.Array, held_out: list[bool], raws: list[bytes]) -> None:
        texts = [raw.lower().split() for raw in raws]
        streams = [stream_of(t) for t in texts]
        for learnt in (True, False):
            some = [k for k, h in enumerate(held_out) if h != learnt]
            if some:
                self.raw[learnt].append(gram_keys([streams[k] for k in some])[0])
            for k in some:
                if learnt:
                    self.words.update(texts[k])
                else:
                    self.asked.update(texts[k])
            if learnt:
                self.words[b""] += len(some)
        joined = b"".join(streams)
        self.rows.append((ids, held_out, [len(s) for s in streams], zstandard.ZstdCompressor(level=1).compress(joined)))
        self.size += len(joined)
        if sum(map(len, self.raw[True])) + sum(map(len, self.raw[False])) > _MERGE:
            self.flush()

    def batches(self, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        def row(grp: int, ids=None, held=None, sizes=None, blob=None, counts=None) -> pa.RecordBatch:
            listed = pa.array([None], pa.list_(id_type)) if ids is None else pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([pa.array([self.number], pa.int64()), pa.array([grp], pa.int32()), listed, pa.array([held], pa.list_(pa.bool_())), pa.array([sizes], pa.list_(pa.int32())), pa.array([blob], pa.binary()), pa.array([counts], pa.binary())], names=_COLUMNS)

        self.flush()
        for ids, held, sizes, blob in self.rows:
            yield row(_DOCS, ids, held, sizes, blob)
        words = {word_key(w): n for w, n in self.words.items()} | {k: 0 for k in map(word_key, self.asked - self.words.keys())}
        keys = np.fromiter(words.keys(), np.int64, len(words))
        order = np.argsort(keys)
        counts = np.fromiter(words.values(), np.int64, len(words))[order]
        for keys, counts, group in ((*self.grams.merged(), group_of), (keys[order], counts, word_group_of)):
            grp = group(keys)
            order = np.argsort(grp, kind="stable")
            ends = np.flatnonzero(np.diff(grp[order], append=-1)) + 1
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True) if len(ends) else ():
                part = order[a:b]
                yield row(int(grp[part[0]]), blob=pack_keys(keys[part]), counts=pack(counts[part]))


_COLUMNS = ["chunk", "grp", "ids", "held", "sizes", "blob", "counts"]


def _chunked(id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        chunk = _Chunk(number)
        for batch in slices(batches, most_bytes=_SLICE):
            chunk.add(batch.column("doc_id"), batch.column("held_out").to_pylist(), utf8(batch.column("text")))
            if chunk.size >= CHUNK_BYTES:
                yield from chunk.batches(id_type)
                number += 1
                chunk = _Chunk(number)
        if chunk.rows:
            yield from chunk.batches(id_type)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (grp, blob, counts) sorted by grp, to one for each grp with its seen keys, their sum and number, and counts by short context."""
    grp, sums = None, Sums()

    def row() -> pa.RecordBatch:
        keys, counts = sums.merged()
        keys, counts = keys[counts > 0], counts[counts > 0]
        low = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if grp < GROUPS:
            short, back = np.unique((keys >> 8 * ORDER << 8) | (keys & 255), return_inverse=True)
            low = short, np.bincount(back, counts, len(short)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([grp], pa.int32()), pa.array([pack_keys(keys)], pa.binary()), pa.array([pack(counts)], pa.binary()), pa.array([int(counts.sum())], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([low[0]], pa.list_(pa.int64())), pa.array([low[1]], pa.list_(pa.int64()))], names=["grp", "blob", "counts", "total", "kinds", "short", "n"])

    for batch in batches:
        for g, blob, counts in zip(batch.column("grp").to_pylist(), batch.column("blob"), batch.column("counts"), strict=True):
            if g != grp:
                if grp is not None:
                    yield row()
                grp, sums = g, Sums()
            sums.add(unpack_keys(blob.as_py()), unpack(counts.as_py()))
    if grp is not None:
        yield row()


@dataclass
class Model:
    """A part of the trie: for each order the contexts and the (context, byte) keys, sorted, with their tables."""

    contexts: list[np.ndarray] = field(default_factory=list)
    grams: list[np.ndarray] = field(default_factory=list)
    counts: list[np.ndarray] = field(default_factory=list)
    own: list[np.ndarray] = field(default_factory=list)  # log of the denominator at this context when nothing is excluded
    escape: list[np.ndarray] = field(default_factory=list)  # log escape there
    below: list[np.ndarray] = field(default_factory=list)  # log of the parent's denominator with this context's bytes excluded
    passed: list[np.ndarray] = field(default_factory=list)  # summed log escapes of all ancestors, each after its child's exclusion
    uniform: float = 0.0


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def build_model(low: tuple[np.ndarray, np.ndarray], keys: np.ndarray, counts: np.ndarray) -> Model:
    """low: all counts by (last byte, byte); keys, counts: the part's counts by (context of ORDER bytes, byte), sorted."""
    m = Model()
    if not len(low[0]):
        return Model(uniform=-np.log10(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in range(ORDER + 1):
            if k < 2:
                key, n = _summed(low[0] & 255, low[1]) if k == 0 else low
            else:
                key, n = _summed((keys >> 8 * (ORDER + 1 - k) << 8) | (keys & 255), counts) if k < ORDER else (keys, counts)
            ctx, total = _summed(key >> 8, n)
            where = np.searchsorted(ctx, key >> 8)
            kinds = np.bincount(where, minlength=len(ctx)).astype(float)
            total, n = total.astype(float), n.astype(float)
            m.contexts.append(ctx)
            m.grams.append(key)
            m.counts.append(np.log10(n - DISCOUNT))
            m.own.append(np.log10(total))
            m.escape.append(np.log10(DISCOUNT * kinds) - np.log10(total))
            if k == 0:
                m.below.append(np.full(len(ctx), np.nan))
                m.passed.append(np.zeros(len(ctx)))
            else:
                up_ctx, up_total, up_kinds = last
                parent = np.searchsorted(up_ctx, ctx >> 8)
                there = np.searchsorted(up_key, (key >> 16 << 8) | (key & 255))  # the same byte in the parent
                t, q = up_total[parent] - np.bincount(where, up_n[there], len(ctx)), up_kinds[parent] - kinds
                m.below.append(np.log10(t))
                m.passed.append(m.passed[k - 1][parent] + np.where(t > 0, np.log10(DISCOUNT * q) - np.log10(t), 0.0))
            last, up_key, up_n = (ctx, total, kinds), key, n
    m.uniform = -np.log10(max(1, 256 - len(m.grams[0])))
    return m


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), max(0, len(table) - 1))
    return at, (table[at] == keys) if len(table) else np.zeros(len(keys), bool)


def log_probabilities(model: Model, keys: np.ndarray) -> np.ndarray:
    """log10 of the model's probability of each key's byte after its context; keys: distinct and sorted is fastest."""
    out = np.full(len(keys), model.uniform)
    if not model.contexts:
        return out
    ctx, sym = keys >> 8, keys & 255
    deepest = np.zeros(len(keys), np.int64)  # the longest context there
    top_passed = np.zeros(len(keys))
    top_escape = np.full(len(keys), model.escape[0][0])
    met = np.full(len(keys), -1, np.int64)  # the longest context that has the byte
    met_log, met_own = np.zeros(len(keys)), np.zeros(len(keys))
    after_below, after_passed = np.zeros(len(keys)), np.zeros(len(keys))  # of the context one longer than met
    alive = np.arange(len(keys))
    for k in range(len(model.contexts)):
        c = ctx[alive] >> 8 * (ORDER - k)
        at, yes = _find(model.contexts[k], c)
        alive, at, c = alive[yes], at[yes], c[yes]
        if not len(alive):
            break
        deepest[alive], top_passed[alive], top_escape[alive] = k, model.passed[k][at], model.escape[k][at]
        if k:
            short = met[alive] == k - 1
            after_below[alive[short]], after_passed[alive[short]] = model.below[k][at[short]], model.passed[k][at[short]]
        g, has = _find(model.grams[k], (c << 8) | sym[alive])
        who = alive[has]
        met[who], met_log[who], met_own[who] = k, model.counts[k][g[has]], model.own[k][at[has]]
    direct = met == deepest
    out[direct] = met_log[direct] - met_own[direct]
    fell = (met >= 0) & ~direct
    out[fell] = top_escape[fell] + top_passed[fell] - after_passed[fell] + met_log[fell] - after_below[fell]
    none = met < 0
    out[none] = top_escape[none] + top_passed[none] + model.uniform
    return out


class Part:
    """A group's answers: log probabilities of (context, byte) keys, or counts of words."""

    def __init__(self, grp: int, low: tuple[np.ndarray, np.ndarray], keys: np.ndarray, counts: np.ndarray):
        self.grp, self.keys, self.counts = grp, keys, counts
        if grp < GROUPS:
            self.model = build_model(low, keys, counts)
            if self.model.contexts:  # a key that was seen has all it needs in its own context
                at = np.searchsorted(self.model.contexts[ORDER], keys >> 8)
                self.logs = self.model.counts[ORDER] - self.model.own[ORDER][at]

    def answer(self, keys: np.ndarray) -> np.ndarray:
        at, seen = _find(self.keys, keys)
        if self.grp >= GROUPS:
            return np.where(seen, self.counts[at] if len(self.counts) else 0, 0)
        out = np.empty(len(keys))
        if seen.any():
            out[seen] = self.logs[at[seen]]
        out[~seen] = log_probabilities(self.model, keys[~seen])
        return out


def _answers(low):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (grp, chunk, blob, counts) sorted by grp and copy, the group's own counts (chunk null) first."""
        part = None
        for batch in batches:
            for grp, chunk, blob, counts in zip(batch.column("grp").to_pylist(), batch.column("chunk").to_pylist(), batch.column("blob"), batch.column("counts"), strict=True):
                if chunk is None:
                    part = Part(grp, low.value, unpack_keys(blob.as_py()), unpack(counts.as_py()))
                    continue
                if part is None or part.grp != grp:
                    part = Part(grp, low.value, np.empty(0, np.int64), np.empty(0, np.int64))
                values = part.answer(unpack_keys(blob.as_py()))
                packed = pack(values.astype(np.float32).view(np.int32)) if grp < GROUPS else pack(values)
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([grp], pa.int32()), pa.array([blob.as_py()], pa.binary()), pa.array([packed], pa.binary())], names=["chunk", "grp", "blob", "counts"])

    return run


class Lookup:
    """Values by key: two hash tables, and a sorted one for keys that found no place in them."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.tables = []
        for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            bits = max(4, int(2 * len(keys)).bit_length())
            shift, factor = np.uint64(64 - bits), np.uint64(factor)
            slot = (keys.view(np.uint64) * factor) >> shift
            at, value = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.float32)
            at[slot] = keys
            lost = at[slot] != keys
            value[slot[~lost]] = values[~lost]
            self.tables.append((factor, shift, at, value))
            keys, values = keys[lost], values[lost]
        order = np.argsort(keys)
        self.rest, self.rest_values = keys[order], values[order]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out, left = None, None
        for factor, shift, at, value in self.tables:
            slot = (keys.view(np.uint64) * factor) >> shift
            got, miss = value[slot], np.flatnonzero(at[slot] != keys)
            if out is None:
                out, left = got.astype(np.float64), miss
            else:
                out[left] = got
                left = left[miss]
            keys = keys[miss]
            if not len(keys):
                return out
        out[left] = self.rest_values[np.searchsorted(self.rest, keys)]
        return out


class _Counts(dict):
    """Training counts by word, looked up by its hash when it is first met."""

    def __init__(self, known: dict[int, int]):
        self.known = known

    def __missing__(self, word: bytes) -> int:
        n = self[word] = self.known.get(word_key(word), 0)
        return n


def _scored(floor: float, tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by chunk and grp: a chunk's answers, then its texts."""
        chunk, keys, values, known, lookup, counts = None, [], [], {}, None, None
        for batch in batches:
            for at, (number, grp) in enumerate(zip(batch.column("chunk").to_pylist(), batch.column("grp").to_pylist(), strict=True)):
                if number != chunk:
                    chunk, keys, values, known, lookup = number, [], [], {}, None
                blob = batch.column("blob")[at].as_py()
                if grp < GROUPS:
                    keys.append(unpack_keys(blob))
                    values.append(unpack(batch.column("counts")[at].as_py()).astype(np.int32).view(np.float32))
                    continue
                if grp < _DOCS:
                    known.update(zip(unpack_keys(blob).tolist(), unpack(batch.column("counts")[at].as_py()).tolist(), strict=True))
                    continue
                if lookup is None:
                    lookup, counts = Lookup(np.concatenate(keys), np.concatenate(values)), _Counts(known)
                    keys, values = [], []
                joined, streams, start = zstandard.ZstdDecompressor().decompress(blob), [], 0
                for size in batch.column("sizes")[at].as_py():
                    streams.append(joined[start : start + size])
                    start += size
                ids = batch.column("ids")[at].values
                score = np.empty(len(streams))
                base, n_tokens, n_known = np.empty(len(streams)), np.empty(len(streams), np.int64), np.empty(len(streams), np.int64)
                for a, b in _runs(streams):
                    grams, starts = gram_keys(streams[a:b])
                    score[a:b] = np.add.reduceat(lookup(grams), starts)
                for k, s in enumerate(streams):
                    c = np.fromiter(map(counts.__getitem__, [*s[:-1].split(), b""]), float)
                    base[k], n_tokens[k], n_known[k] = np.log10(c + 1.0).sum() - len(c) * floor, len(c), (c > 0).sum()
                yield pa.RecordBatch.from_arrays([ids, batch.column("held")[at].values, pa.array(n_tokens), pa.array(n_known), pa.array(np.full(len(streams), tokens)), pa.array(base), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def _runs(streams: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of streams of about _SLICE bytes."""
    a = size = 0
    for k, s in enumerate(streams):
        size += len(s)
        if size >= _SLICE or k + 1 == len(streams):
            yield a, k + 1
            a, size = k + 1, 0


def score_documents(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the rows where held_out is false, score every row: both scores are log10 probabilities of whole texts."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out.alias("held_out"))
    kind = src.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    schema = f"chunk bigint, grp int, ids array<{kind.simpleString()}>, held array<boolean>, sizes array<int>, blob binary, counts binary"
    packed = materialize(mapped(src, _chunked(id_type), schema), "chunks")
    asked = packed.where(F.col("grp") < _DOCS).select("chunk", "grp", "blob", "counts")
    copies = max(1, -(-packed.where(F.col("grp") == _DOCS).select("chunk").distinct().count() // SHARE))
    model_schema = "grp int, blob binary, counts binary, total bigint, kinds bigint, short array<bigint>, n array<bigint>"
    copy = F.pmod(F.xxhash64("chunk"), F.lit(copies)).cast("int").alias("copy")
    parts = asked.select("grp", "blob", "counts", copy)
    if copies > 1:  # first within the chunks of a copy
        parts = mapped(parts.repartition("grp", "copy").sortWithinPartitions("grp", "copy"), _merge, model_schema)
    parts = mapped(parts.select("grp", "blob", "counts").repartition("grp").sortWithinPartitions("grp"), _merge, model_schema)
    parts = materialize(parts, "counts")
    tokens, kinds = (x or 0 for x in parts.where(F.col("grp") >= GROUPS).agg(F.sum("total"), F.sum("kinds")).first())
    short = parts.select(F.explode(F.arrays_zip("short", "n")).alias("z")).groupBy("z.short").agg(F.sum("z.n").alias("n")).toArrow().sort_by("short")  # 2^16 rows at most
    low = spark.sparkContext.broadcast(tuple(short.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("short", "n")))
    own = parts.select("grp", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), F.lit(None).cast("bigint").alias("chunk"), "blob", "counts")
    both = own.union(asked.select("grp", copy, "chunk", "blob", F.lit(None).cast("binary").alias("counts")))
    answers = mapped(both.repartition("grp", "copy").sortWithinPartitions("grp", "copy", F.col("chunk").asc_nulls_first()), _answers(low), "chunk bigint, grp int, blob binary, counts binary")
    texts = packed.where(F.col("grp") == _DOCS)
    nothing = [F.lit(None).cast(texts.schema[c].dataType).alias(c) for c in ("ids", "held", "sizes")]
    rows = texts.union(answers.select("chunk", "grp", *nothing, "blob", "counts")).repartition("chunk").sortWithinPartitions("chunk", "grp")
    floor = float(np.log10(tokens + kinds + 1.0))
    return mapped(rows, _scored(floor, int(tokens)), f"doc_id {kind.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
