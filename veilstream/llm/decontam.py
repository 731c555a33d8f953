"""Benchmark decontamination with one Aho-Corasick automaton over normalised test questions and answers.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. A window is eight consecutive words of an
item; an item of fewer words is one window. Any window of eight holds one of the item's anchors: the runs of four words
that start at every fifth word. The automaton holds the anchors (shorter items whole) between spaces, a tenth of what
all windows would take. A text is scanned once in its normalised form; where an anchor ends, the item is compared with
the text to both sides, and if eight or more words agree, all of them are hit. Offsets map back to the original text.

The item table is read in blocks of bounded size, each with its own automaton, so that what is broadcast never exceeds
the bound. One block is the usual case: hits and results are made in the same pass. With several, each block's pass over
the texts writes the hits only, by a hash of the text, and one join brings all hits to their rows. Items longer than a
block's share are cut into parts that overlap by seven words, which loses no window.

Defined cases: null text and null items have no words; rows of items with a null id mark words as hit but count as no
item; repeated item ids count once; repeated documents give repeated rows; an item that ties with others on the same
words counts like each of them; very long texts and items are scanned whole; an empty item table leaves all clean, an
empty document table gives an empty result; other columns of the documents and items are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstream.llm.common import mapped, materialize, slices, utf8

WINDOW, ANCHOR = 8, 4
STEP = WINDOW - ANCHOR + 1
PART_WORDS = 4096

_WORD = re.compile(rb"[^ ]+")
_TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()  # A-Z to a-z, other ASCII to space


def normalise(raw: bytes) -> str:
    """Words between single spaces, with one at both ends; one character for each byte."""
    return _joined(raw.translate(_TABLE).split())


def _joined(words: list[bytes]) -> str:
    return (b" " + b" ".join(words) + b" ").decode("latin-1") if words else " "


def item_parts(item_id, raw: bytes) -> Iterator[tuple[object, str]]:
    words = raw.translate(_TABLE).split()
    for at in range(0, max(1, len(words) - WINDOW + 1), PART_WORDS):
        if words:
            yield item_id, _joined(words[at : at + PART_WORDS + WINDOW - 1])


def build(parts: list[tuple[object, str]]) -> ahocorasick.Automaton:
    """Anchors of all parts; each with the places (part number, offset) where it stands."""
    found: dict[str, list[tuple[int, int]]] = {}
    for k, (_, text) in enumerate(parts):
        starts = [i for i, c in enumerate(text) if c == " "]  # word w stands between starts[w] and starts[w + 1]
        n = len(starts) - 1
        if n < WINDOW:
            found.setdefault(text, []).append((k, 0))
            continue
        for w in range(0, n - ANCHOR + 1, STEP):
            found.setdefault(text[starts[w] : starts[w + ANCHOR] + 1], []).append((k, starts[w]))
    a = ahocorasick.Automaton()
    for anchor, places in found.items():
        a.add_word(anchor, (len(anchor), places))
    if found:
        a.make_automaton()
    return a


def _reach(a: str, i: int, b: str, j: int, step: int) -> int:
    """How many characters agree from a[i] and b[j] on, rightwards or leftwards."""
    n, most, size = 0, min(len(a) - i, len(b) - j) if step > 0 else min(i, j) + 1, 32
    while size and n < most:
        take = min(size, most - n)
        if step > 0:
            same = a.startswith(b[j + n : j + n + take], i + n)
        else:
            same = a.startswith(b[j - n - take + 1 : j - n + 1], i - n - take + 1)
        if same:
            n, size = n + take, 2 * size
        else:
            size = take // 2
    return n


def find(text: str, automaton: ahocorasick.Automaton, parts: list[tuple[object, str]]) -> list[tuple[int, int, object]]:
    """(start, end, item id) of the runs of text that hold an item's window; both ends at a space of the normalised text."""
    runs: list[tuple[int, int, object]] = []
    if not len(automaton):
        return runs
    seen: dict[tuple[int, int], int] = {}
    for last, (size, places) in automaton.iter(text):
        start = last - size + 1
        for k, offset in places:
            item_id, item = parts[k]
            if size == len(item):
                runs.append((start, last, item_id))
                continue
            if seen.get((k, start - offset), -1) >= last:
                continue
            right = last + _reach(text, last, item, offset + size - 1, 1) - 1
            left = start - _reach(text, start, item, offset, -1) + 1
            right, left = text.rfind(" ", 0, right + 1), text.find(" ", left)
            seen[(k, start - offset)] = right
            if text.count(" ", left, right) >= WINDOW:
                runs.append((left, right, item_id))
    return runs


def merged(runs: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[object, str]]]:
    """The items' parts in blocks of about block_bytes; the driver holds one block at a time."""
    block, held = [], 0
    for item_id, text in items.select(F.col(id_col), F.col(text_col).cast("string")).toLocalIterator():
        for part in item_parts(item_id, (text or "").encode()):
            block.append(part)
            held += len(part[1])
            if held >= block_bytes:
                yield block
                block, held = [], 0
    if block:
        yield block


#: The task's last parts and their automaton; the parts are held, so that another list is never taken for them.
_BUILT: list = [None, None]

#: A hit: (start, end, item as text); byte offsets in the normalised text.
Hit = tuple[int, int, str | None]
_HITS = "array<struct<start:bigint,end:bigint,item:string>>"


def _hits(shared) -> Callable[[list[bytes]], list[list[Hit]]]:
    def run(raws: list[bytes]) -> list[list[Hit]]:
        parts = shared.value
        if _BUILT[0] is not parts:
            _BUILT[:] = [parts, build(parts)]
        return [[(a, b, None if i is None else str(i)) for a, b, i in find(normalise(raw), _BUILT[1], parts)] for raw in raws]

    return run


def with_hits(docs: DataFrame, items: DataFrame, item_id: str, item_text: str, finish: Callable[[pa.RecordBatch, list[bytes], list[list[Hit]]], pa.RecordBatch], schema, block_bytes: int = 2 << 20, field: str | None = None) -> DataFrame:
    """finish(batch, texts, hits) of every batch of docs (doc, text), or of docs (doc) whose field of that name is the text."""
    spark = docs.sparkSession
    blocks = (spark.sparkContext.broadcast(parts) for parts in item_blocks(items, item_id, item_text, block_bytes))
    first = list(itertools.islice(blocks, 2))
    if len(first) < 2:
        search = _hits(first[0]) if first else lambda raws: [[] for _ in raws]
        at = None if field is None else docs.schema["doc"].dataType.names.index(field)

        def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text" if at is None else "doc"):
                raws = utf8(batch.column("text") if at is None else batch.column("doc").flatten()[at].cast(pa.string()))
                yield finish(batch, raws, search(raws))

        return mapped(docs, at_once, schema)
    if field is not None:
        docs = docs.withColumn("text", F.col("doc").getField(field).cast("string"))
    keyed = docs.withColumn("key", F.struct(F.xxhash64("text").alias("a"), F.hash("text").alias("b"), F.octet_length("text").alias("n")))
    kind = keyed.schema["key"].dataType.simpleString()
    found = []
    for shared in itertools.chain(first, blocks):

        def one(batches: Iterator[pa.RecordBatch], search=_hits(shared)) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                hits = search(utf8(batch.column("text")))
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(_records(hits), _SPANS)], names=["key", "hits"]).filter(pa.array([bool(h) for h in hits], pa.bool_()))

        found.append(materialize(mapped(keyed.select("key", "text"), one, f"key {kind}, hits {_HITS}").distinct(), "hits"))
    hits = reduce(DataFrame.union, found).groupBy("key").agg(F.flatten(F.collect_list("hits")).alias("hits"))

    def after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            known = [[(h["start"], h["end"], h["item"]) for h in row or ()] for row in batch.column("hits").to_pylist()]
            yield finish(batch, utf8(batch.column("text")), known)

    return mapped(keyed.join(hits, "key", "left").select("doc", "text", "hits"), after, schema)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("item", pa.string())]))


def _records(hits: list[list[Hit]]) -> list[list[dict]]:
    return [[{"start": a, "end": b, "item": i} for a, b, i in row] for row in hits]


def original_offsets(raw: bytes, spans: list[list[int]]) -> list[tuple[int, int]]:
    """Character offsets [start, end) in the original text for ascending spans between spaces of its normalised form."""
    words = [m.span() for m in _WORD.finditer(raw.translate(_TABLE))]
    text, out = normalise(raw), []
    seen = at = chars = word = 0  # up to where the normalised form, and the raw text, are counted
    for a, b in spans:
        first = word + text.count(" ", seen, a)
        word, seen = first + text.count(" ", a, b), b
        start, end = words[first][0], words[word - 1][1]
        begin = chars + len(raw[at:start].decode())
        chars, at = begin + len(raw[start:end].decode()), end
        out.append((begin, chars))
    return out


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least_items: int = 2, block_bytes: int = 2 << 20) -> DataFrame:
    """One row for each document: counts, digest of the items found, verdict, and the hit spans of the original text."""
    src = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc"].dataType.simpleString()
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]

    def finish(batch: pa.RecordBatch, raws: list[bytes], hits: list[list[Hit]]) -> pa.RecordBatch:
        rows = []
        for raw, row in zip(raws, hits, strict=True):
            spans = merged([(a, b) for a, b, _ in row])
            found = sorted({i for _, _, i in row if i is not None})
            text = normalise(raw)
            n_hit = sum(text.count(" ", a, b) for a, b in spans)
            rows.append((text.count(" ") - 1, n_hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), len(found) >= least_items, [{"start": a, "end": b} for a, b in original_offsets(raw, spans)] if spans else []))
        return pa.RecordBatch.from_arrays([batch.column("doc"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names=["doc_id", *names])

    schema = f"doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans array<struct<start:bigint,end:bigint>>"
    return with_hits(src, items, item_id, item_text, finish, schema, block_bytes)


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least_items: int = 2, block_bytes: int = 2 << 20) -> DataFrame:
    """docs without its contaminated rows; from other rows the words that an item's window hits are cut out.

    The columns of docs stay as they are but for the text of a cut row, and n_chars, if docs has it, which counts it anew.
    """
    packed = docs.select(F.struct("*").alias("doc"))
    names = docs.columns

    def finish(batch: pa.RecordBatch, raws: list[bytes], hits: list[list[Hit]]) -> pa.RecordBatch:
        keep = [len({i for _, _, i in row if i is not None}) < least_items for row in hits]
        columns = dict(zip(names, batch.column("doc").flatten(), strict=True))
        touched = {k for k, row in enumerate(hits) if row and keep[k]}
        if touched:
            texts = columns[text_col].cast(pa.string()).to_pylist()
            for k in touched:
                at, parts = 0, []
                for a, b in original_offsets(raws[k], merged([(a, b) for a, b, _ in hits[k]])):
                    parts.append(texts[k][at:a])
                    at = b
                texts[k] = "".join([*parts, texts[k][at:]])
            columns[text_col] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                counts = columns["n_chars"].to_pylist()
                columns["n_chars"] = pa.array([len(t) if k in touched else n for k, (t, n) in enumerate(zip(texts, counts, strict=True))], columns["n_chars"].type)
        return pa.RecordBatch.from_arrays([columns[c] for c in names], names=names).filter(pa.array(keep, pa.bool_()))

    return with_hits(packed, items, item_id, item_text, finish, docs.schema, block_bytes, text_col)
