"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the one- to three-character n-grams of a text's letters (lower-cased, everything else one space), hashed to
2^18 columns, weighted by TF-IDF and scaled to length one. Document frequencies come from all training rows. The weights
are fitted with follow-the-regularised-leader, whose elastic-net penalties keep most of them at zero, on a bounded
sample: FIT_ROWS training rows, shared evenly among the languages and drawn by a hash of the id. A fifth of the sample
is left out of the fit and sets the temperature by which scores are calibrated. Every text is read whole.

Defined cases: null texts and texts without a letter are `und` with score 0; rows with a null language teach nothing;
without training rows all texts are `und`; ties go to the alphabetically first language; repeated rows repeat; very long
texts are read whole; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstream.llm.common import mapped, slices

GRAMS = 3
COLUMN_BITS = 18
FIT_ROWS = 2400
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
UNKNOWN = "und"
_SLICE = 1 << 19


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column numbers of all n-grams of the texts, each text's own together; the texts' starts; which have a letter."""
    gap = " " * GRAMS
    joined = gap + gap.join([t.lower() for t in texts]) + gap
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[code]
    code = np.where(letter, code, 32).astype(np.uint32)
    sizes = np.fromiter((len(t.lower()) for t in texts), np.int64, len(texts))
    start = np.cumsum(sizes + GRAMS) - sizes
    keep = letter.copy()  # an n-gram counts if its last or the one before is a letter: runs of spaces say nothing
    keep[1:] |= letter[:-1]
    out = []
    h = np.zeros(len(code), np.uint32)
    for n in range(GRAMS):
        h = h.copy()
        h[n:] = (h[n:] ^ code[: len(code) - n]) * np.uint32(0x01000193) + np.uint32(n + 1)
        mixed = h * np.uint32(0x9E3779B1)
        out.append((mixed ^ mixed >> np.uint32(15)) * np.uint32(0x85EBCA77) >> np.uint32(32 - COLUMN_BITS))
    grid = np.stack(out, axis=1)  # a row for each character
    seen = np.concatenate([[0], np.cumsum(keep)])
    bounds = np.concatenate([start, start[-1:] + sizes[-1:] + 1]) if len(texts) else np.zeros(1, np.int64)
    cols = grid[keep].ravel().astype(np.int64)
    starts = seen[bounds] * GRAMS
    ends = seen[np.minimum(start + sizes + 1, len(code))] * GRAMS
    has = np.array([bool(letter[a : a + s].any()) for a, s in zip(start.tolist(), sizes.tolist(), strict=True)], bool)
    return cols, np.stack([starts[: len(texts)], ends], axis=1) if len(texts) else np.zeros((0, 2), np.int64), has


class _Distinct:
    """The distinct columns of a text with their counts, without sorting."""

    def __init__(self):
        self.place = np.zeros(1 << COLUMN_BITS, np.int64)

    def __call__(self, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.arange(len(cols))
        self.place[cols] = order
        at = self.place[cols]
        first = np.flatnonzero(at == order)
        return cols[first], np.bincount(at, minlength=len(cols))[first]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    distinct, df, docs = _Distinct(), np.zeros(1 << COLUMN_BITS, np.int64), 0
    for batch in slices(batches, most_bytes=_SLICE):
        cols, spans, has = hashed(batch.column("text").to_pylist())
        for (a, b), yes in zip(spans.tolist(), has.tolist(), strict=True):
            if yes:
                df[distinct(cols[a:b])[0]] += 1
                docs += 1
    used = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(df[used], docs))], names=["col", "n"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    distinct = _Distinct()
    for batch in slices(batches, most_bytes=_SLICE):
        cols, spans, has = hashed(batch.column("text").to_pylist())
        got = [distinct(cols[a:b]) for a, b in spans.tolist()]
        keep = pa.array(has)
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("draw"), pa.array([g[0].astype(np.int32) for g in got], pa.list_(pa.int32())), pa.array([g[1].astype(np.int32) for g in got], pa.list_(pa.int32()))], names=["lang", "draw", "cols", "counts"]).filter(keep)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # columns by languages, most rows zero
    bias: np.ndarray
    temperature: float = 1.0


def _vector(cols: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = counts * idf[cols]
    return x / max(1e-12, float(np.sqrt(x @ x)))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray) -> Model:
    """rows: (language, columns, counts) in a random order; every fifth row calibrates."""
    languages = sorted({r[0] for r in rows})
    number = {name: k for k, name in enumerate(languages)}
    k = len(languages)
    z, n = np.zeros((len(idf) + 1, k), np.float64), np.zeros((len(idf) + 1, k), np.float64)

    def weights(at: np.ndarray) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(z[at]) <= L1, 0.0, w)

    vectors = [(np.append(c, len(idf)), np.append(_vector(c, m, idf), 1.0), number[name]) for name, c, m in rows]
    held = vectors[::5] if len(vectors) >= 5 else vectors
    learn = [v for i, v in enumerate(vectors) if i % 5] if len(vectors) >= 5 else vectors
    for _ in range(EPOCHS):
        for at, x, y in learn:
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    full = weights(np.arange(len(idf) + 1))
    logits = np.array([x @ full[at] for at, x, _ in held])
    truth = np.array([y for _, _, y in held])
    loss = {t: -np.log(np.maximum(1e-12, softmax(logits / t)[np.arange(len(truth)), truth])).mean() for t in np.geomspace(0.1, 10, 81)}
    return Model(languages, idf, full[:-1].astype(np.float32), full[-1], float(min(loss, key=loss.get)))


def train(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Model | None:
    """docs: (doc_id, text, lang) of the training rows."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    df = np.zeros(1 << COLUMN_BITS)
    total = 0
    for r in mapped(labelled.select("text"), _frequencies, "col bigint, n bigint").groupBy("col").agg(F.sum("n").alias("n")).toArrow().to_pylist():
        if r["col"] < 0:
            total = r["n"]
        else:
            df[r["col"]] = r["n"]
    idf = np.where(df > 0, np.log((1 + total) / (1 + df)) + 1, 0.0)
    each = max(2, fit_rows // len(sizes))
    draw = F.xxhash64(F.col("doc_id").cast("string"), F.lit("fit"))
    share = F.coalesce(*[F.when(F.col("lang") == name, F.lit(min(1.0, 1.5 * each / n))) for name, n in sorted(sizes.items())])
    chosen = labelled.select("text", "lang", draw.alias("draw")).where((F.pmod(F.col("draw"), F.lit(1_000_003)) / 1_000_003.0) < share)
    got = mapped(chosen, _sampled, "lang string, draw bigint, cols array<int>, counts array<int>").toArrow().sort_by([("draw", "ascending")])
    taken: dict[str, int] = {}
    rows = []
    for name, cols, counts in zip(got.column("lang").to_pylist(), got.column("cols"), got.column("counts"), strict=True):
        taken[name] = taken.get(name, 0) + 1
        if taken[name] <= each:
            rows.append((name, cols.values.to_numpy(zero_copy_only=False), counts.values.to_numpy(zero_copy_only=False)))
    return fit(rows, idf) if rows else None


class Predictor:
    """Predictions of a model for whole texts, with what a task prepares once."""

    def __init__(self, model: Model):
        self.model, self.distinct = model, _Distinct()
        self.idf2 = model.idf**2
        self.table = (model.idf[:, None] * model.weights).astype(np.float32)

    def __call__(self, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
        """Of each text the language, its score, and the share of its n-grams that the training rows have."""
        m = self.model
        cols, spans, has = hashed(texts)
        names, scores, known = [], [], []
        for (a, b), yes in zip(spans.tolist(), has.tolist(), strict=True):
            if not yes:
                names.append(UNKNOWN)
                scores.append(0.0)
                known.append(0.0)
                continue
            c, k = self.distinct(cols[a:b])
            known.append(float(k @ (self.idf2[c] > 0)) / (b - a))
            norm = np.sqrt((k.astype(float) ** 2) @ self.idf2[c])
            p = softmax(((k @ self.table[c]) / max(1e-12, norm) + m.bias) / m.temperature)
            best = int(p.argmax())
            names.append(m.languages[best])
            scores.append(float(p[best]))
        return names, scores, known


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs without its column text, with lang_pred and score."""
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)}).drop("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carried = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carried).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(shared.value)
        for batch in slices(batches, most_bytes=_SLICE):
            names, scores, _ = predictor([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*carried, "lang_pred", "score"])

    return mapped(docs, run, f"{schema}, lang_pred string, score double")


def accept(docs: DataFrame, model: Model | None, least_share: float, least_known: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose text has a learned language.

    Its score is at least least_share times an even share among the learned languages, and at least least_known of the
    text's n-grams are among those of the training rows.
    """
    if model is None:
        return docs.where(F.lit(False))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    least_score = min(1.0, least_share / len(model.languages)) if len(model.languages) > 1 else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(shared.value)
        for batch in slices(batches, text_col, _SLICE):
            got = predictor([t or "" for t in batch.column(text_col).to_pylist()])
            yield batch.filter(pa.array([n != UNKNOWN and s >= least_score and k >= least_known for n, s, k in zip(*got, strict=True)], pa.bool_()))

    return mapped(docs, run, docs.schema)


def identify(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows where held_out is false, predict every row: (doc_id, held_out, lang_pred, score)."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), held_out.alias("held_out"))
    model = train(src.where(~F.col("held_out")).select("doc_id", "text", "lang"))
    return predict(src.select("doc_id", "held_out", "text"), model)
