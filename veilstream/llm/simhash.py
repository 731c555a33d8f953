"""SimHash near-duplicates by deletion-variant signatures.

A document's fingerprint has a bit set where more than half of its shingles' 64-bit hashes have it. Two fingerprints
link at four or fewer differing bits. The 64 bits are cut into three segments (21, 21 and 22 bits): of four differing
bits, one segment has at most one. So each distinct fingerprint is filed, for each of the 64 bits, under its segment
with that bit wiped out: fingerprints with a segment that differs in one bit at most meet in an equal key. In a key,
only pairs that differ at the wiped bit are compared (and, under each segment's first bit, those that agree in the
whole segment), which keeps each pair from being met again and again; whole fingerprints then decide.

Exact copies collapse to one fingerprint before anything is filed. The keys meet by one shuffle; each task walks its
keys in order, holding one at a time. A key with more than BLOCK members, found by counting first, is dealt out to pairs
of blocks instead, so no task holds more than two blocks of it. A key's links are reduced to a spanning forest where
they are found, so that a group of thousands gives no more links than it has members, and connects the same documents.

Defined cases: null and empty texts have no words and fingerprint zero, which links like any other; fewer words than a
shingle make one shingle; a null doc_id is never the smallest; repeated rows are copies; as many bits set as not is no
tie, the bit is zero; very long texts are read whole; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from veilstream.llm.common import discard, mapped, materialize, slices, utf8
from veilstream.llm.graph import connected

BITS = 4
#: First bit and mask of each segment.
SEGMENTS = [(0, (1 << 21) - 1), (21, (1 << 21) - 1), (42, (1 << 22) - 1)]
BLOCK = 4096
#: Of keep_first: fingerprints of each set of shingles, their bits, and the bits of half of one of their three segments.
FINGERPRINTS, WIDE, HALF = 18, 54, 9
#: Bits by which near sets may differ in two of the fingerprints (met in a segment), and in all of them.
NEAR, NEAR_ALL = 28, FINGERPRINTS * WIDE // 4
#: Members of a half that a task holds; pairs compared at once; near pairs of a key that are listed one by one.
HALF_BLOCK, PAIRS, CROWD = 1 << 17, 1 << 19, 256
#: Near pairs that a batch lists of sets that they connect in rings; pairs a member that are listed of sets that all batches' pairs connect.
LISTED, SPARSE = 32, 4
#: Shingles that a task holds of a side of a key; pairs of sets that a task connects at once.
CELL, EDGES = 1 << 20, 1 << 20


def shingle_hashes(raw: bytes, width: int, seed: int) -> list[int]:
    words = raw.lower().split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(line, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], seed) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]


def fingerprints_of(raws: list[bytes], width: int = 4, seed: int = 42) -> np.ndarray:
    out = np.zeros(len(raws), np.uint64)
    for k, raw in enumerate(raws):
        h = np.array(shingle_hashes(raw, width, seed), "<u8")
        votes = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 16):
            votes += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * votes > len(h), bitorder="little").view("<u8")[0]
    return out


def fingerprint_documents(docs: DataFrame, keep: list[str], text_col: str = "text", width: int = 4, seed: int = 42, name: str = "fp") -> DataFrame:
    """docs' columns named in keep, and the fingerprint as a signed long."""
    src = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.select(*keep).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            fp = fingerprints_of(utf8(batch.column("__text")), width, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fp)], names=[*keep, name])

    return mapped(src, run, f"{schema}, `{name}` bigint")


def _filed(fps: DataFrame) -> DataFrame:
    """(key, fp): each fingerprint under its 64 one-wildcard segments. key: the wiped bit's number and the segment."""
    p = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p")
    start = F.expr("CASE WHEN p < 21 THEN 0 WHEN p < 42 THEN 21 ELSE 42 END")
    mask = F.expr(f"CASE WHEN p < 42 THEN {SEGMENTS[0][1]}L ELSE {SEGMENTS[2][1]}L END")
    wiped = F.expr("fp & ~shiftleft(1L, p)")
    segment = F.call_function("shiftrightunsigned", wiped, start).bitwiseAND(mask)
    return fps.select("fp", p).select((F.expr("shiftleft(p, 22)") + segment.cast("int")).alias("key"), "fp")


def _linked(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """Which pairs are to be linked here: few differing bits, and met at this key rather than at another."""
    x = a[:, None] ^ b[None, :]
    near = np.bitwise_count(x) <= BITS
    if p in (0, 21, 42):
        return near
    return near & ((x >> np.uint64(p)) & np.uint64(1)).astype(bool)


def forest(fps: np.ndarray, p: int, fresh: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what the key's pairs connect, one fewer than the members at most.

    fresh: a second block, if only pairs across the two blocks are to be met.
    """
    all_, side = (fps, None) if fresh is None else (np.concatenate([fps, fresh]), np.concatenate([np.zeros(len(fps), bool), np.ones(len(fresh), bool)]))
    out, left = [], np.arange(len(all_))
    while len(left) > 1:
        seed, left = left[0], left[1:]
        todo = [int(seed)]
        while todo and len(left):
            part, todo = todo[:256], todo[256:]
            hit = _linked(all_[part], all_[left], p)
            if side is not None:
                hit &= side[part][:, None] != side[left][None, :]
            met = hit.any(axis=0)
            found = left[met]
            out += [(int(seed), int(j)) for j in found]
            todo += found.tolist()
            left = left[~met]
    return [(int(all_[i]), int(all_[j])) for i, j in out]


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(sorted(set(found)), np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], names=["a", "b"])


def key_links(keys: np.ndarray, starts: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> list[tuple[int, int]]:
    """Links of many keys at once: of the k-th key the members are values[starts[k] : starts[k] + sizes[k]]."""
    out: list[tuple[int, int]] = []
    bit = keys >> 22
    plain = np.isin(bit, (0, 21, 42))
    for m in np.unique(sizes[sizes > 1]).tolist():
        rows = np.flatnonzero(sizes == m)
        if m > 32:
            for r in rows.tolist():
                out += forest(values[starts[r] : starts[r] + m], int(bit[r]))
            continue
        i, j = np.triu_indices(m, 1)
        step = max(1, 200_000 // len(i))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            group = values[starts[part][:, None] + np.arange(m)]
            x = group[:, i] ^ group[:, j]
            hit = (np.bitwise_count(x) <= BITS) & (plain[part][:, None] | ((x >> bit[part].astype(np.uint64)[:, None]) & np.uint64(1)).astype(bool))
            many = hit.sum(axis=1) >= m
            for r in part[many].tolist():
                out += forest(values[starts[r] : starts[r] + m], int(bit[r]))
            g, q = np.nonzero(hit & ~many[:, None])
            out += zip(group[g, i[q]].tolist(), group[g, j[q]].tolist(), strict=True)
    return out


def _run_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; the last key of a batch waits for the next batch."""
    key, fp = np.empty(0, np.int32), np.empty(0, np.uint64)
    for batch in batches:
        key = np.concatenate([key, batch.column("key").to_numpy()])
        fp = np.concatenate([fp, batch.column("fp").to_numpy().view(np.uint64)])
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        if len(starts) > 1:
            yield _pairs(key_links(key[starts[:-1]], starts[:-1], np.diff(starts), fp))
            key, fp = key[starts[-1] :], fp[starts[-1] :]
    if len(key):
        yield _pairs(key_links(key[:1], np.zeros(1, np.int64), np.array([len(key)]), fp))


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, one, two in zip(*(batch.column(c).to_pylist() for c in ("key", "one", "two")), strict=True):
            a, b = (np.array(x, np.int64).view(np.uint64) for x in (one, two))
            yield _pairs(forest(a, key >> 22, b if len(b) else None))


def link_fingerprints(fps: DataFrame) -> DataFrame:
    """Links (a, b) among distinct fingerprints fp: a spanning forest of each key's links, whole in what they connect."""
    filed = _filed(fps)
    crowded = materialize(filed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK), "crowded")
    if crowded.isEmpty():
        usual, links = filed, None
    else:
        usual = filed.join(crowded, "key", "left_anti")
        blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
        own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
        dealt = filed.join(crowded, "key").select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        dealt = dealt.select("key", "fp", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
        grouped = dealt.groupBy("key", "lo", "hi").agg(
            F.collect_list(F.when(F.col("own") == F.col("lo"), F.col("fp"))).alias("one"),
            F.collect_list(F.when((F.col("own") == F.col("hi")) & (F.col("lo") < F.col("hi")), F.col("fp"))).alias("two"),
        )
        links = mapped(grouped.select("key", "one", "two"), _block_links, "a bigint, b bigint")
    found = mapped(usual.repartition("key").sortWithinPartitions("key"), _run_links, "a bigint, b bigint")
    return (found if links is None else found.union(links)).distinct()


def component_ids(prints: DataFrame, order: Column) -> DataFrame:
    """(fp, first): the smallest value of order among the rows whose fingerprints are connected with fp."""
    firsts = materialize(prints.groupBy("fp").agg(F.min(order).alias("own")), "firsts")
    labels = connected(link_fingerprints(firsts.select("fp")))
    if labels is None:
        return firsts.select("fp", F.col("own").alias("first"))
    named = materialize(firsts.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left").select("fp", "own", F.coalesce("label", F.xxhash64("fp")).alias("label")), "named")
    discard(labels)
    discard(firsts)
    return named.join(named.groupBy("label").agg(F.min("own").alias("first")), "label").select("fp", "first")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each document: its class of near copies by the smallest doc_id in it."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints = materialize(fingerprint_documents(src, ["doc_id"], "text", width, seed), "prints")
    ids = component_ids(prints, F.col("doc_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(ids, "fp").select("doc_id", hexed, F.col("first").alias("component_id"))


def wide_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """FINGERPRINTS fingerprints of WIDE bits for each set of shingle hashes: a bit is set if more than half of the set's mixed hashes have it."""
    draw = np.random.default_rng(42)
    add, factor = (draw.integers(0, 1 << 64, FINGERPRINTS, dtype=np.uint64) for _ in range(2))
    out = np.zeros((len(sets), FINGERPRINTS), np.uint64)
    for k, hashes in enumerate(sets):
        votes = np.zeros(64 * FINGERPRINTS, np.int64)
        for at in range(0, len(hashes), 255):
            x = (hashes[at : at + 255, None] ^ add) * (factor | np.uint64(1))
            x ^= x >> np.uint64(32)
            x *= np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
            votes += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
        out[k] = np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")
    return out & np.uint64((1 << WIDE) - 1)


def _sets(raws: list[bytes], width: int, seed: int) -> list[np.ndarray]:
    return [np.unique(np.array(shingle_hashes(raw, width, seed), np.uint64)) for raw in raws]


def _printed(docs: DataFrame, text_col: str, width: int, seed: int) -> DataFrame:
    """(row, doc, digest, size, fps): docs' rows as they are, numbered, and of each text's set of shingles a digest, its size and its fingerprints."""
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc"))
    at, kind = docs.columns.index(text_col), src.schema["doc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "doc", most_bytes=1 << 20):
            sets = _sets(utf8(batch.column("doc").flatten()[at].cast(pa.string())), width, seed)
            sizes = np.array([len(s) for s in sets], np.int64)
            offsets = np.concatenate([[0], np.cumsum((sizes > 0) * FINGERPRINTS)]).astype(np.int32)
            fps = pa.ListArray.from_arrays(pa.array(offsets), pa.array(wide_fingerprints(sets)[sizes > 0].ravel().view(np.int64)))
            digest = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc"), digest, pa.array(sizes), fps], names=["row", "doc", "digest", "size", "fps"])

    return mapped(src, run, StructType([StructField("row", LongType()), kind, StructField("digest", BinaryType()), StructField("size", LongType()), StructField("fps", ArrayType(LongType()))]))


def _halved(sets: DataFrame) -> DataFrame:
    """(key, cell, node, fp, more): each set under each half of its fingerprints' segments, with that fingerprint and the next.

    key: the half's number and its bits. Keys of more than HALF_BLOCK members are dealt to cells, one for each pair of blocks.
    """
    filed = sets.where("size > 0").select("node", "fps", F.explode(F.sequence(F.lit(0), F.lit(6 * FINGERPRINTS - 1))).alias("p"))
    filed = filed.select("node", "p", F.expr("fps[p div 6]").alias("fp"), F.expr(f"fps[(p div 6 + 1) % {FINGERPRINTS}]").alias("more"))
    filed = filed.select(F.expr(f"shiftleft(p, {HALF}) + cast(shiftright(fp, {HALF} * (p % 6)) & {(1 << HALF) - 1} AS int)").alias("key"), "node", "fp", "more")
    crowded = materialize(filed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HALF_BLOCK), "crowded")
    usual = filed.select("key", F.lit(0).alias("cell"), "node", "fp", "more")
    if crowded.isEmpty():
        return usual
    blocks = F.ceil(F.col("n") / F.lit(HALF_BLOCK)).cast("int")
    dealt = filed.join(F.broadcast(crowded), "key").withColumns({"n": blocks, "own": F.pmod(F.xxhash64("node"), blocks).cast("int")})
    cells = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda b: F.least("own", b) * F.col("n") + F.greatest("own", b) + 1)
    dealt = dealt.select("key", F.explode(cells).alias("cell"), "node", "fp", "more")
    return usual.join(F.broadcast(crowded.select("key")), "key", "left_anti").union(dealt)


def _groups(fp: np.ndarray, more: np.ndarray) -> list[np.ndarray]:
    """Members that pairs of near fingerprints connect, in groups of two or more."""
    out, left = [], np.arange(len(fp))
    while len(left) > 1:
        todo, left, group = [int(left[0])], left[1:], [int(left[0])]
        while todo and len(left):
            part, todo = todo[:64], todo[64:]
            near = np.bitwise_count(fp[part][:, None] ^ fp[left]) + np.bitwise_count(more[part][:, None] ^ more[left]) <= NEAR
            met = near.any(axis=0)
            todo += left[met].tolist()
            group += left[met].tolist()
            left = left[~met]
        if len(group) > 1:
            out.append(np.array(group))
    return out


def smallest_connected(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, first): the nodes of the pairs, in order, and the place in nodes of the smallest one that each is connected with."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = place[: len(a)], place[len(a) :]
    first = np.arange(len(nodes))
    while True:
        low = np.minimum(first[one], first[two])
        if (first[one] == first[two]).all():
            return nodes, first
        for side in (one, two):
            np.minimum.at(first, first[side], low)
        first = first[first]


def _ringed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs are left when pairs of a node without another one are taken away again and again (of longer branches an end stays)."""
    left = np.arange(len(a))
    for _ in range(64):
        _, place, count = np.unique(np.concatenate([a[left], b[left]]), return_inverse=True, return_counts=True)
        stay = (count[place] > 1).reshape(2, -1).all(axis=0)
        if stay.all():
            break
        left = left[stay]
    return left


def grouped(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, a, b), where sets that more than LISTED pairs connect in rings come as a group: of m of them m rows, not up to m * m / 2."""
    plain = np.flatnonzero(group == 0)
    ringed = plain[_ringed(a[plain], b[plain])]
    nodes, first = smallest_connected(a[ringed], b[ringed])
    of = first[np.searchsorted(nodes, a[ringed])]
    many = np.bincount(of, minlength=len(nodes)) > LISTED
    stay = np.ones(len(a), bool)
    stay[ringed[many[of]]] = False
    member = many[first]
    least = nodes[first[member]]
    rows = [np.concatenate([x[stay], y]) for x, y in ((group, least + 1), (a, least), (b, nodes[member]))]
    rows = np.unique(np.stack(rows, axis=1), axis=0)
    return rows[:, 0], rows[:, 1], rows[:, 2]


def meetings(key: np.ndarray, cell: np.ndarray, node: np.ndarray, fp: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, a, b): pairs a < b whose fingerprints are near and meet in a segment with one bit wiped, group 0.

    Rows of a key and cell agree in one half of a segment; their other halves are met here with each bit wiped in turn, or
    whole, if the first half is the one that agrees. Where more than CROWD pairs are near, or more than LISTED connect
    members in rings, groups of near members come instead: a is the smallest member, b each member, and the group a + 1.
    """
    half = key >> HALF
    other = (fp.view(np.int64) >> (HALF * ((half % 6) ^ 1))) & ((1 << HALF) - 1)
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])])
    place = (np.cumsum(new) << HALF) | other
    order = np.argsort(place, kind="stable")
    node, fp, more = node[order], fp[order], more[order]
    value, start, count = np.unique(place[order], return_index=True, return_counts=True)
    whole = np.flatnonzero((half[order][start] % 2 == 0) & (count > 1))
    left, right = [whole], [whole]
    for bit in range(HALF):
        unset = np.flatnonzero((value >> bit) & 1 == 0)
        at = np.minimum(np.searchsorted(value, value[unset] | (1 << bit)), len(value) - 1)
        same = value[at] == value[unset] | (1 << bit)
        left.append(unset[same])
        right.append(at[same])
    left, right = np.concatenate(left), np.concatenate(right)
    n, m = count[left], count[right]
    total = n * m
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    crowds = np.flatnonzero(total > PAIRS).tolist()
    usual = np.flatnonzero(total <= PAIRS)
    ends = np.cumsum(total[usual])
    at = 0
    while at < len(usual):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        part, at = usual[at:to], to
        of = np.repeat(np.arange(len(part)), total[part])
        off = np.arange(len(of)) - np.repeat(np.cumsum(total[part]) - total[part], total[part])
        i, j = start[left[part]][of] + off // m[part][of], start[right[part]][of] + off % m[part][of]
        near = (np.bitwise_count(fp[i] ^ fp[j]) + np.bitwise_count(more[i] ^ more[j]) <= NEAR) & (i != j)
        many = np.bincount(of[near], minlength=len(part)) > CROWD
        crowds += part[many].tolist()
        near &= ~many[of]
        a, b = node[i[near]], node[j[near]]
        found.append((np.zeros(len(a), np.int64), np.minimum(a, b), np.maximum(a, b)))
    for k in crowds:
        own = [np.arange(start[s], start[s] + count[s]) for s in {int(left[k]), int(right[k])}]
        rows = np.concatenate(own)
        for group in _groups(fp[rows], more[rows]):
            b = np.sort(node[rows[group]])
            found.append((np.full(len(b), b[0] + 1), np.full(len(b), b[0]), b))
    columns = [np.concatenate([f[c] for f in found] or [np.empty(0, np.int64)]) for c in range(3)]
    rows = np.unique(np.stack(columns, axis=1), axis=0)
    return grouped(rows[:, 0], rows[:, 1], rows[:, 2])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key and cell; those of the last one wait until it is whole and there is enough to do."""
    waiting: list[pa.RecordBatch] = []
    held, last = 0, None

    def met(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        key, cell, node, fp, more = (np.concatenate([r.column(c).to_numpy() for r in rows]) for c in ("key", "cell", "node", "fp", "more"))
        out = meetings(key.astype(np.int64), cell, node, fp.view(np.uint64), more.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in out], names=["key", "a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, cell = batch.column("key").to_numpy(), batch.column("cell").to_numpy()
        breaks = np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1
        at = 0 if last is not None and last != (key[0], cell[0]) else int(breaks[0]) if len(breaks) and held >= 1 << 16 else None
        if at is not None and held >= 1 << 16:
            yield met([*waiting, batch.slice(0, at)])
            waiting, held, batch = [], 0, batch.slice(at)
        waiting.append(batch)
        held += batch.num_rows
        last = (key[-1], cell[-1])
    if waiting:
        yield met(waiting)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b) that connect what the pairs of EDGES rows or a few more connect, fewer than their nodes."""
    held: list[pa.RecordBatch] = []

    def stars() -> pa.RecordBatch:
        nodes, first = smallest_connected(*(np.concatenate([h.column(c).to_numpy() for h in held]) for c in ("a", "b")))
        rest = first != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[first[rest]]), pa.array(nodes[rest])], names=["a", "b"])

    for batch in batches:
        held.append(batch)
        if sum(h.num_rows for h in held) >= EDGES:
            yield stars()
            held = []
    if held:
        yield stars()


def gathered(met: DataFrame, sets: DataFrame) -> DataFrame:
    """met's rows (key, a, b), where sets that many pairs connect, met in whatever places, come as one group.

    A group of m sets that are near but no copies meets in many places, with few pairs in each, and up to m * m / 2 in all.
    Of connected sets, pairs stay if they are at most SPARSE times the members (times the blocks that the members'
    shingles fill); otherwise the members are one key, of which everything is compared in cells.
    """
    labels = connected(mapped(met.select("a", "b"), _stars, "a bigint, b bigint"))
    if labels is None:
        return met
    rows = met.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n"))
    members = materialize(labels.join(sets.select("node", "size"), "node").join(rows, "node", "left"), "members")
    discard(labels)
    plan = members.groupBy("label").agg(F.min("node").alias("first"), F.count("*").alias("m"), F.sum("n").alias("n"), F.ceil(F.sum("size") / F.lit(CELL)).alias("blocks"))
    dense = members.select("node", "label").join(plan.where(F.col("n") > SPARSE * F.col("m") * F.col("blocks")).select("label", "first"), "label")
    dense = materialize(dense.select((F.col("first") + 1).alias("key"), F.col("first").alias("a"), F.col("node").alias("b")), "dense")
    discard(members)
    rest = met.join(dense.select(F.col("b").alias("a")), "a", "left_anti").select("key", "a", "b")
    out = materialize(rest.union(dense), "met")
    discard(dense)
    discard(met)
    return out


def _verified(width: int, seed: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (a, b, one, two) with the texts of a pair; those of the same a mostly follow each other."""
        last, held = None, np.empty(0, np.uint64)
        for whole in batches:
            for batch in slices(slices([whole], "one"), "two"):
                yes = []
                for a, one, two in zip(batch.column("a").to_pylist(), batch.column("one"), utf8(batch.column("two")), strict=True):
                    if a != last:
                        last, held = a, _sets([(one.as_py() or "").encode()], width, seed)[0]
                    other = _sets([two], width, seed)[0]
                    both = len(np.intersect1d(held, other, assume_unique=True))
                    yes.append(both >= least * (len(held) + len(other) - both))
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(yes, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    return run


def cell_links(nodes: list[int], labels: list[int], sides: list[int], sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links between members of different labels (and of different sides, where there are two) that connect all that are similar.

    Members that a link or a label already connects are not compared, so a group of copies costs its size, not the square.
    """
    _, label = np.unique(np.array(labels), return_inverse=True)
    sizes = np.array([len(s) for s in sets], np.int64)
    _, words = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    side, two = np.array(sides), len(set(sides)) > 1
    mark = np.zeros(int(words.max(initial=0)) + 1, bool)
    out, held = [], None
    for i in range(len(nodes)):
        at = (label[i], side[i] if two else 0)
        behind = label[i + 1 :] != label[i]
        if 2 * behind.sum() > len(behind) and sizes.all():  # all behind it, as they lie: those before it have been compared with it
            others, flat, starts = np.arange(i + 1, len(nodes)), words[ends[i] :], ends[i:-1] - ends[i]
        else:
            if held is None or held[0] != at:  # whom members of this label and side are to be compared with
                others = np.flatnonzero((label != label[i]) & (~two | (side != side[i])) & (sizes > 0))
                flat = np.concatenate([words[ends[j] - sizes[j] : ends[j]] for j in others.tolist()]) if len(others) else words[:0]
                held = (at, others, flat, np.cumsum(sizes[others]) - sizes[others])
            _, others, flat, starts = held
        if not len(others) or not sizes[i]:
            continue
        own = words[ends[i] - sizes[i] : ends[i]]
        mark[own] = True
        both = np.add.reduceat(mark[flat].astype(np.int64), starts)
        mark[own] = False
        near = others[both >= least * (sizes[i] + sizes[others] - both)]
        for j in near.tolist():
            if label[j] != label[i]:
                out.append((nodes[i], nodes[j]))
                label[label == label[j]] = label[i]
                held = None
    return out


def _cells(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, lo, hi, block, node, label, hashes) sorted by key, lo and hi; one cell is held at a time."""
        cell, rows = None, []

        def links() -> pa.RecordBatch:
            found = cell_links([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [np.frombuffer(r[3], np.uint64) for r in rows], least)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "lo", "hi", "node", "label", "block")]
            for key, lo, hi, node, label, block, hashes in zip(*columns, batch.column("hashes"), strict=True):
                if (key, lo, hi) != cell:
                    if len(rows) > 1:
                        yield links()
                    cell, rows = (key, lo, hi), []
                rows.append((node, label, block, hashes.as_py()))
        if len(rows) > 1:
            yield links()

    return run


def _hashed(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=1 << 20):
            sets = _sets(utf8(batch.column("text")), width, seed)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "hashes"])

    return run


def _dealt(tagged: DataFrame) -> DataFrame:
    """(key, lo, hi, block, node, label): the members of keys with more than one label, dealt to cells of bounded size.

    A key of at most CELL shingles is one cell. Of a larger one, the members of the label with most of them are dealt to
    blocks that need not meet each other, the rest to blocks that meet all blocks.
    """
    by_label = tagged.groupBy("key", "label").agg(F.sum("size").alias("weight"))
    plan = by_label.groupBy("key").agg(F.max(F.struct("weight", "label")).alias("top"), F.sum("weight").alias("total"), F.count("*").alias("kinds")).where("kinds > 1")
    blocks = lambda weight: F.ceil(weight / F.lit(CELL)).cast("int")
    rows = tagged.join(plan, "key").withColumns({"major": F.col("label") == F.col("top.label"), "n": blocks(F.col("top.weight")), "m": blocks(F.col("total") - F.col("top.weight"))})
    draw = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    rows = rows.withColumn("block", F.when(F.col("total") <= CELL, 0).when(F.col("major"), draw(F.col("n"))).otherwise(F.col("n") + draw(F.col("m"))))
    cell = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    own = F.col("block")
    behind = F.sequence(F.col("n"), F.col("n") + F.col("m") - 1)
    with_major = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda b: cell(b, own))
    with_minor = F.transform(behind, lambda b: cell(F.least(b, own), F.greatest(b, own)))
    cells = F.when(F.col("total") <= CELL, F.array(cell(F.lit(0), F.lit(0)))).when(F.col("major"), with_minor).otherwise(F.concat(with_major, with_minor))
    return rows.select("key", "block", "node", "label", F.explode(cells).alias("cell")).select("key", "cell.lo", "cell.hi", "block", "node", "label")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, seed: int = 42, least: float = 0.8) -> DataFrame:
    """The rows of docs without those that have a near copy before them (by id, then by place): one row of each class.

    Near copies are texts whose sets of shingles have a Jaccard similarity of least or more, and what these connect. Texts
    with equal sets collapse first. The method is the one above, made wide enough for that similarity, at which a bit of a
    fingerprint differs with a chance of 0.151: each set has FINGERPRINTS fingerprints of three segments of 18 bits, and two
    sets meet where a segment agrees but for one wiped bit at most. A pair at 0.8 meets in none of them with a chance of 2
    in a million, and a closer one more surely. As the wiped bit is in one half of the segment, the other half is equal:
    sets are dealt by halves, and the variants are made where they arrive. Of those that meet, whole fingerprints decide
    who is compared, and the exact similarity of the texts who is linked. Crowds of near members, in a place or by many
    places together, are first held against their first one; where they are then still in several classes, members of
    different classes are compared and linked in cells of bounded size, so that no link is lost and no group of near texts,
    copies or not, is expanded into its pairs.

    Defined cases: null and empty texts are copies of each other; a null id comes last; repeated rows are copies; of equal
    ids the row read first stays; an empty table gives an empty result; all columns are kept, whatever their names.
    """
    placed = materialize(_printed(docs, text_col, width, seed), "placed")
    order = F.struct(F.col("doc").getField(id_col).isNull().alias("none"), F.col("doc").getField(id_col).alias("id"), "row")
    sets = placed.groupBy("digest").agg(F.min(order).alias("own"), F.first("size").alias("size"), F.first("fps").alias("fps"))
    sets = materialize(sets.select("own", F.col("own.row").alias("node"), "size", "fps"), "sets")
    halved = _halved(sets).repartition("key", "cell").sortWithinPartitions("key", "cell")
    met = gathered(materialize(mapped(halved, _met, "key bigint, a bigint, b bigint").distinct(), "met"), sets)
    pairs = met.where("a < b").select("a", "b").distinct()
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("size").alias(f"size_{side}"), F.col("fps").alias(f"fps_{side}")), side)
    apart = F.expr("aggregate(zip_with(fps_a, fps_b, (x, y) -> bit_count(x ^ y)), 0, (n, d) -> n + d)")
    fits = (F.least("size_a", "size_b") >= F.lit(least) * F.greatest("size_a", "size_b")) & (apart <= NEAR_ALL)
    pairs = materialize(pairs.where(fits).select("a", "b"), "pairs")
    crowds = met.where("key <> 0").select("key", F.col("b").alias("node"))
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(crowds.select("node")).distinct()
    texts = placed.select(F.col("row").alias("node"), F.col("doc").getField(text_col).cast("string").alias("text"))
    texts = materialize(texts.join(nodes, "node", "left_semi"), "near")
    told = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("two")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("one")), "a")
    links = materialize(mapped(told.select("a", "b", "one", "two"), _verified(width, seed, least), "a bigint, b bigint"), "links")
    labels = connected(links)
    label = F.xxhash64("node").alias("label")
    crowds = crowds.join(sets.select("node", "size"), "node")
    tagged = crowds.select("key", "node", "size", label) if labels is None else crowds.join(labels, "node", "left").select("key", "node", "size", F.coalesce("label", F.xxhash64("node")).alias("label"))
    tagged = materialize(tagged, "tagged")
    cells = materialize(_dealt(tagged), "cells")
    if not cells.isEmpty():
        hashes = mapped(texts.join(cells.select("node").distinct(), "node", "left_semi"), _hashed(width, seed), "node bigint, hashes binary")
        more = cells.join(hashes, "node").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
        more = materialize(mapped(more, _cells(least), "a bigint, b bigint"), "links")
        if not more.isEmpty():
            discard(labels)
            labels = connected(links.union(more))
        discard(more)
    for done in (met, pairs, texts, links, tagged, cells):
        discard(done)
    firsts = sets.select("own", "node")
    if labels is not None:
        firsts = firsts.join(labels, "node", "left").groupBy(F.coalesce("label", F.xxhash64("node")).alias("label")).agg(F.min("own").alias("own"))
    return placed.join(firsts.select(F.col("own.row").alias("row")), "row", "left_semi").select("doc.*")
