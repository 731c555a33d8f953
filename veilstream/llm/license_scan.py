"""License scans by conditional compression.

A text is read as its words, so line ends and comment marks within a notice do not matter. A template that is there with
at most one word in MAX_DIFFERENCE lost keeps one of its anchors, of which it has one more than it may lose; around each
anchor's occurrence a window of the template's size is compressed alone and with the template as a raw zstandard
dictionary. It is a candidate if the dictionary saves LEAST_SAVING of the template's own size, and wins if the exact
wording differences are few and none is in a version number or a distinguishing name. All notices of a text are
reported, of overlapping ones that with the most equal words. Lines with a cue word of licensing outside of all notices
are reported as blocks without a license, with the template that saves most.

Defined cases: null and empty texts have no blocks and no licenses; ties in the ranking go to the template's id;
repeated rows give repeated rows; very long texts and lines are read whole; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import difflib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstream.llm.common import mapped, slices, utf8

#: Identifiers and the customary wording of public license notices.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
]

#: Identifiers of the public SPDX list, by the license they stand for.
SPDX = {
    "Apache-2.0": ["Apache-2.0"], "MIT": ["MIT"], "BSD-2-Clause": ["BSD-2-Clause"], "BSD-3-Clause": ["BSD-3-Clause"], "ISC": ["ISC"],
    "GPL-2.0": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"], "GPL-3.0": ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"],
    "LGPL-3.0": ["LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"], "AGPL-3.0": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"],
    "MPL-2.0": ["MPL-2.0"], "CC-BY-4.0": ["CC-BY-4.0"], "CC-BY-SA-4.0": ["CC-BY-SA-4.0"], "CC-BY-NC-4.0": ["CC-BY-NC-4.0"], "CC-BY-ND-4.0": ["CC-BY-ND-4.0"],
    "CC-BY-NC-SA-4.0": ["CC-BY-NC-SA-4.0"], "CC0-1.0": ["CC0-1.0"], "Unlicense": ["Unlicense"],
}
TEMPLATES += [(name, f"SPDX-License-Identifier: {i}") for name, ids in SPDX.items() for i in ids]

#: Words by which licenses are told apart; a difference in one of them rules a template out.
TELLING = set("apache mit bsd isc gnu gpl lgpl agpl general lesser affero library mozilla mpl cc by nc sa nd cc0 commons".split())
#: What makes a line a candidate, as lower-case UTF-8.
CUES = [c.encode() for c in ("licen", "copyright", "©", "rights reserved", "permission is hereby", "permission to use", "redistribut", "public domain", "free software", "warrant", "spdx", "cc by", "cc-by", "cc0", "source code form", "endorse")]
_WORD = re.compile(r"[^\W_]+")
MAX_DIFFERENCE = 8
LEAST_SAVING = 0.15


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


@lru_cache(maxsize=1)
def _compressors() -> tuple[zstandard.ZstdCompressor, list[tuple[int, str, list[str], zstandard.ZstdCompressor]]]:
    def plain(**more) -> zstandard.ZstdCompressor:
        return zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False, write_dict_id=False, **more)

    own = []
    for k, (name, text) in enumerate(TEMPLATES):
        raw = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.append((k, name, words_of(text), plain(dict_data=raw)))
    return plain(), own


def align(template: list[str], block: list[str]) -> tuple[list[str], int, int]:
    """The differing words of the template and its best-aligned stretch of the block, and where the equal words begin and end."""
    match = difflib.SequenceMatcher(None, template, block, autojunk=False)
    same = [m for m in match.get_matching_blocks() if m.size]
    if not same:
        return template, 0, 0
    lo, hi = max(0, same[0].b - same[0].a), min(len(block), same[-1].b + len(template) - same[-1].a)
    out = []
    for op, a, b, c, d in difflib.SequenceMatcher(None, template, block[lo:hi], autojunk=False).get_opcodes():
        if op != "equal":
            out += [*template[a:b], *block[lo + c : lo + d]]
    return out, same[0].b, same[-1].b + same[-1].size


def differences(template: list[str], block: list[str]) -> list[str]:
    """The template's words that its best-aligned stretch of the block lacks, and the words that stand there instead."""
    return align(template, block)[0]


@lru_cache(maxsize=1)
def _anchors() -> dict[str, list[tuple[int, int]]]:
    """Of each template its longest words, one more than it may lose: {word: [(template, the word's place in it)]}."""
    out: dict[str, list[tuple[int, int]]] = {}
    for k, _, words, _ in _compressors()[1]:
        places = sorted(range(len(words)), key=lambda t: (-len(words[t]), t))
        for t in places[: len(words) // MAX_DIFFERENCE + 1]:
            out.setdefault(words[t], []).append((k, t))
    return out


@lru_cache(maxsize=20_000)
def _wins(k: int, window: str) -> tuple[float, int, int, int] | None:
    """(share saved, differing words, first word, end) of template k in a window of words; None if it is not there."""
    plain, own = _compressors()
    _, _, words, compressor = own[k]
    have = window.split(" ")
    if sum((Counter(words) & Counter(have)).values()) < len(words) - len(words) // MAX_DIFFERENCE:
        return None
    saved = len(plain.compress(window.encode())) - len(compressor.compress(window.encode()))
    share = saved / len(plain.compress(" ".join(words).encode()))
    if share < LEAST_SAVING:
        return None
    diff, first, end = align(words, have)
    if len(diff) * MAX_DIFFERENCE > len(words) or any(w in TELLING or w.isdigit() for w in diff):
        return None
    return share, len(diff), first, end


def notices(text: str) -> list[tuple[int, int, str, float, int]]:
    """(start, end, license, share saved, differing words) of the notices in text, on one line or more, none overlapping."""
    spans = list(_WORD.finditer(text))
    words = [m[0].lower() for m in spans]
    anchors, own = _anchors(), _compressors()[1]
    seen, found = set(), set()
    for i, w in enumerate(words):
        for k, t in anchors.get(w, ()):
            size = len(own[k][2])
            slack = size // MAX_DIFFERENCE
            lo, hi = max(0, i - t - slack), min(len(words), i - t + size + slack)
            if (k, lo, hi) not in seen:
                seen.add((k, lo, hi))
                if got := _wins(k, " ".join(words[lo:hi])):
                    found.add((got[1] - size, own[k][1], lo + got[2], lo + got[3], got[0], got[1]))
    taken, out = set(), []
    for _, name, lo, hi, share, diff in sorted(found):  # the most equal words first
        if taken.isdisjoint(range(lo, hi)):
            taken.update(range(lo, hi))
            out.append((spans[lo].start(), spans[hi - 1].end(), name, share, diff))
    return sorted(out)


@lru_cache(maxsize=20_000)
def judge(block: str) -> tuple[str | None, float, int]:
    """(license or None, share saved, differing words) of a candidate block."""
    plain, own = _compressors()
    raw = block.lower().encode()
    alone = len(plain.compress(raw))
    ranked = sorted((len(c.compress(raw)) - alone, name, k, words) for k, name, words, c in own)
    have = words_of(block)
    if got := notices(block):
        return got[0][2:]
    return None, max(0, -ranked[0][0]) / alone, len(differences(ranked[0][3], have))


def candidate_blocks(raw: bytes) -> list[tuple[int, int]]:
    """Byte ranges of the lines with a cue."""
    low, found = raw.lower(), set()
    for cue in CUES:
        at = low.find(cue)
        while at >= 0:
            end = low.find(b"\n", at)
            end = len(low) if end < 0 else end
            found.add((low.rfind(b"\n", 0, at) + 1, end))
            at = low.find(cue, end)
    return sorted(found)


def scan_text(raw: bytes) -> list[dict]:
    """The notices of a text, and its lines with a cue that lie outside all of them."""
    text = raw.decode()
    sure = notices(text)
    out = [{"offset": a, "length": b - a, "license": name, "saved": saved, "differences": diff} for a, b, name, saved, diff in sure]
    chars, at, starts = 0, 0, [x[0] for x in sure]
    for a, b in candidate_blocks(raw):
        chars, at = chars + len(raw[at:a].decode()), a
        block = raw[a:b].decode()
        before = bisect.bisect_left(starts, chars + len(block))  # notices do not overlap: the last of these ends last
        if not before or sure[before - 1][1] <= chars:
            name, saved, diff = judge(block)
            out.append({"offset": chars, "length": len(block), "license": name, "saved": saved, "differences": diff})
    return sorted(out, key=lambda x: x["offset"])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_blocks, licenses array, n_confirmed, blocks array<struct>) for each document."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("license", pa.string()), ("saved", pa.float64()), ("differences", pa.int64())])
        for batch in slices(batches):
            found = [scan_text(t) for t in utf8(batch.column("text"))]
            names = [sorted({b["license"] for b in f if b["license"]}) for f in found]
            sure = [sum(b["license"] is not None for b in f) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(f) for f in found], pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(sure, pa.int64()), pa.array(found, pa.list_(block))], names=["doc_id", "n_blocks", "licenses", "n_confirmed", "blocks"])

    return mapped(src, run, f"doc_id {kind}, n_blocks bigint, licenses array<string>, n_confirmed bigint, blocks array<struct<offset:bigint,length:bigint,license:string,saved:double,differences:bigint>>")
