"""Operator 9: a quality classifier by factorisation machine over hashed words, structure and metadata.

A document is a sparse vector: hashed words (normalised counts), one-hot bins of structure statistics (shares of
capitals, symbols, repeats, line lengths ...) and of metadata columns. The score is the logistic of
w0 + <w, x> + sum over pairs <v_i, v_j> x_i x_j, the pairs summed in linear time as half of (sum of v x) squared minus the sum of
squares. It is trained in numpy on a bounded sample of labelled rows (SAMPLE per class at most, the lowest
by a hash of the id, one row an id) and applied in one narrow pass over whole texts. The driver gets the sample's sparse vectors, no texts.

Defined cases: null or empty texts have no words, only structure and metadata bins, and get a score like any other;
null metadata has a bin of its own, and so has a metadata column that the table lacks; labels that are null are not used;
without any label of one class the model stays untrained and every score is 0.5. Repeated rows score alike; of rows that share a
labelled id, the least by text and metadata is learnt from.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, frugal, quoted, unused

#: Labelled rows of each class that the model is fitted on, at most.
SAMPLE = 2500
#: Hashed words, bins of each statistic, rank of the interactions.
WORDS, BINS, RANK = 1 << 15, 16, 8
THRESHOLD = 0.3
#: Structure statistics, each in 0..1, in the order of `structure`.
STATISTICS = ("capitals", "symbols", "exclamations", "digits", "ends", "distinct", "repeats", "word_length", "line_length", "bars", "top_word", "beyond_ascii")
#: Words kept with their hashes by a worker; beyond this the table is dropped and begun anew.
CACHE = 200_000

# classes of bytes: 0 small letter, 1 capital, 2 digit, 3 white space, 4 end of line, 5 end of clause, 6 exclamation, 7 other symbol, 8 bar, 9 beyond ASCII
_BYTE = np.full(256, 7, np.uint8)
_BYTE[97:123], _BYTE[65:91], _BYTE[48:58], _BYTE[[9, 11, 12, 13, 32]], _BYTE[10] = 0, 1, 2, 3, 4
_BYTE[[ord(c) for c in ".,;:?'\"-()"]], _BYTE[ord("!")], _BYTE[ord("|")], _BYTE[128:] = 5, 6, 8, 9


class _Hashes(dict):
    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = (zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORDS).to_bytes(4, "little")
        return h


_hashes = _Hashes()


def structure(text: str, words: np.ndarray, distinct: int, top: int) -> np.ndarray:
    """The STATISTICS of a text, given its hashed words."""
    c = np.bincount(_BYTE[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)], minlength=10)
    chars, letters, n = max(1, len(text)), max(1, c[0] + c[1]), max(1, len(words))
    repeats = float(np.mean(words[1:] == words[:-1])) if len(words) > 1 else 0.0
    return np.array(
        [c[1] / letters, 4 * c[7] / chars, 8 * c[6] / chars, c[2] / chars, 4 * c[5] / n, distinct / n, repeats, chars / n / 24, chars / (1 + c[4]) / 2000, 2 * c[8] / n, top / n, c[9] / chars]
    ).clip(0, 1)


def featurize(text: str | None, metadata: Sequence[float | None]) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of a document; words take 0..WORDS-1, bins follow."""
    text = text or ""
    words = np.frombuffer(b"".join(map(_hashes.__getitem__, text.lower().split())), np.uint32)
    index, counts = np.unique(words, return_counts=True)
    stats = structure(text, words, len(index), int(counts.max()) if len(counts) else 0)
    bins = np.minimum((np.sqrt(stats) * BINS).astype(np.int64), BINS - 1)
    meta = np.array([0 if m is None or not np.isfinite(m) else 1 + min(BINS - 2, int(np.log2(1 + max(0.0, m)))) for m in metadata], np.int64)
    dense = np.concatenate([bins, meta])
    dense += WORDS + BINS * np.arange(len(dense))
    values = counts / np.sqrt(float(np.dot(counts, counts)) or 1.0)
    return np.concatenate([index.astype(np.int64), dense]), np.concatenate([values, np.full(len(dense), len(dense) ** -0.5)]).astype(np.float32)


@dataclass
class FactorisationMachine:
    bias: float
    w: np.ndarray
    v: np.ndarray

    @classmethod
    def empty(cls, size: int, seed: int = 7) -> FactorisationMachine:
        return cls(0.0, np.zeros(size, np.float32), np.random.default_rng(seed).normal(0, 0.02, (size, RANK)).astype(np.float32))

    def raw(self, index: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The score before the logistic, by the sum-of-squares identity, and what its gradient needs."""
        vx = self.v[index] * x[:, None]
        s = vx.sum(0)
        return float(self.bias + self.w[index] @ x + 0.5 * (s @ s - np.einsum("ij,ij->", vx, vx))), vx, s

    def score(self, index: np.ndarray, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(index, x)[0], -30, 30))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 6, rate: float = 0.15, decay: float = 2e-5, seed: int = 11) -> None:
        """Adagrad on the logistic loss, both classes with equal weight."""
        gw, gv, rng = np.full_like(self.w, 1e-2), np.full_like(self.v, 1e-2), np.random.default_rng(seed)
        weight = {y: len(labels) / 2 / max(1, int((labels == y).sum())) for y in (0, 1)}
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                index, x = rows[i]
                z, vx, s = self.raw(index, x)
                g = weight[int(labels[i])] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i])
                self.bias -= 0.02 * g
                dw = g * x + decay * self.w[index]
                dv = g * (x[:, None] * s - vx * x[:, None]) + decay * self.v[index]
                gw[index] += dw * dw
                gv[index] += dv * dv
                self.w[index] -= rate * dw / np.sqrt(gw[index])
                self.v[index] -= 0.3 * rate * dv / np.sqrt(gv[index])


def held_out(id_col: str | Column) -> Column:
    """Rows whose labels are never learnt from."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _metadata(docs: DataFrame, names: Sequence[str]) -> list[Column]:
    """The metadata columns as numbers; one that docs lacks is null."""
    have = {c.lower() for c in docs.columns}
    return [(F.col(quoted(m)) if m.lower() in have else F.lit(None)).cast("double") for m in names]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", metadata: Sequence[str] = ("n_chars",), sample: int = SAMPLE) -> FactorisationMachine:
    """Fits the model on at most `sample` labelled rows of each class that are not held out."""
    bounded_batches(docs.sparkSession)
    known = labels.where(~held_out(quoted(id_col))).select(F.col(quoted(id_col)).alias("id"), F.col(quoted(label_col)).cast("int").alias("y")).where("id is not null")
    first = lambda y: known.where(F.col("y") == y).distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    chosen = F.broadcast(first(0).unionByName(first(1)))  # at most 2 * sample rows
    data = F.struct(F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("t"), F.array(*_metadata(docs, metadata)).cast("array<double>").alias("m"))
    # rows that share an id fold where they are read, so at most 2 * sample rows and as many texts a task go on
    rows = docs.select(F.col(quoted(id_col)).alias("id"), data.alias("x")).join(chosen, "id").groupBy("id", "y").agg(F.min("x").alias("x")).select("id", "y", "x.*")
    kind = rows.schema["id"].dataType.simpleString()

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [featurize(t.as_py(), m) for t, m in zip(b.column(2), b.column(3).to_pylist())]
            columns = [pa.array([i for i, _ in made], pa.list_(pa.int64())), pa.array([x for _, x in made], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["id", "y", "i", "v"])

    got = rows.mapInArrow(frugal(vectors), f"id {kind}, y int, i array<bigint>, v array<float>").toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    model = FactorisationMachine.empty(WORDS + BINS * (len(STATISTICS) + len(metadata)))
    y = got["y"].to_numpy()
    if len(set(y.tolist())) == 2:
        model.fit([(i.values.to_numpy(), v.values.to_numpy()) for i, v in zip(got["i"], got["v"])], y)
    else:
        model.v[:] = 0
    return model


def score(docs: DataFrame, model: FactorisationMachine, text_col: str = "text", metadata: Sequence[str] = ("n_chars",), score_col: str = "score") -> DataFrame:
    """docs with score_col (0..1, higher is better) after its own columns; narrow, one pass."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.w, model.v))  # a fixed number of parameters
    schema = docs.select("*", F.lit(0.0).alias(score_col)).schema
    at, width = docs.columns.index(text_col), len(docs.columns)
    extra = unused(docs.columns, *(f"m{i}" for i in range(len(metadata))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = FactorisationMachine(*shared.value)
        for b in batches:
            columns = [c.to_pylist() for c in b.columns[width:]]
            texts = (s.as_py() for s in b.column(at))
            scores = [m.score(*featurize(t, x)) for t, x in zip(texts, zip(*columns) if columns else iter(lambda: (), None))]
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(scores, pa.float64())], names=[*b.schema.names[:width], score_col])
        _hashes.clear()  # a worker lives on after its task

    bounded_batches(docs.sparkSession)
    return docs.select("*", *[c.alias(n) for c, n in zip(_metadata(docs, metadata), extra)]).mapInArrow(frugal(run), schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", threshold: float = THRESHOLD, **options) -> DataFrame:
    """(id_col, held_out, score, predicted) of every row."""
    model = train(docs, labels, id_col, **options)
    text, meta = options.get("text_col", "text"), options.get("metadata", ("n_chars",))
    have = {c.lower() for c in docs.columns}
    scored = score(docs.select(*map(quoted, dict.fromkeys([id_col, text, *(m for m in meta if m.lower() in have)]))), model, text, meta)
    return scored.select(quoted(id_col), held_out(quoted(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
