"""Operator 3: best-fit packing of token sequences by hierarchical residual packing.

Every partition tokenises its documents, cuts those over the limit and packs the pieces best-fit decreasing
into bins, a window of WINDOW tokens at a time, so a task's memory follows the window and the longest text, not the partition.
Nearly full bins are final. Underfull bins are merged in a tree: each round deals them anew, as single items of their fill, into groups
of a bounded number of bins and packs each group best-fit again, until one group is left. Where even a fresh deal merges
less than one bin in a hundred the tree ends early: best fit leaves no two bins of a group that fit into one, so what further rounds could
still save is a part of that hundredth. Only (bin, fill) pairs travel between rounds; pieces learn their sequence by one join at the end.

Token ids come from the tokenizer file, word by word: the tokenizer encodes each word on its own, so the ids of a
text are those of its words in order, and a worker keeps the words it has met (CACHE at most).

Defined cases: null text is empty and packs its end-of-text id alone; repeated rows are packed once each; null ids are carried
along; a very long text is cut into pieces like any other; an empty table gives an empty result; columns other than id and text are
not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, frugal, materialize, quoted

CAPACITY = 4096
#: The id that ends each document.
END = 1
#: A bin with at most so many free places is final.
SLACK = 32
#: Underfull bins that one group of a round packs, at most (in expectation).
GROUP = 20_000
#: Tokens that a task packs at a time.
WINDOW = 4_000_000
#: Words kept with their ids by a worker; beyond this the table is dropped and begun anew.
CACHE = 300_000
TOKENIZER = "word_bpe_49k.json"

#: Letters whose normal form and lower case are one Latin letter each.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
#: How the tokenizer parts a text in lower case, for texts of ASCII and Latin letters.
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^\s{_LATIN}0-9]+")
#: What sends a text to the tokenizer whole: other characters, separators that are white space to Python only, control strings.
_OTHER = re.compile(rf"[^\x00-\x7f{_LATIN}]|[\x1c-\x1f]|<\|")
_ENCODERS: dict[str, WordEncoder] = {}


class WordEncoder(dict):
    """Little-endian 32-bit ids by word. Words that a batch of texts needs and that are not known yet are encoded in one go; the
    last token of each is marked in the vocabulary as the end of a word. Texts beyond ASCII and Latin letters are encoded whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True

    def encode(self, s: str) -> bytes:
        return np.array(self.tokenizer.encode(s, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        """Makes sure of the ids of all these words. A full table is dropped before, never between, look-ups."""
        if len(self) >= CACHE:
            self.clear()
        new = list(words.difference(self))
        for at in range(0, len(new), 5000):
            some = new[at : at + 5000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts, data = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist(), ids.tobytes()
            if len(cuts) == len(some):
                self.update(zip(some, (data[i:j] for i, j in zip([0, *cuts], cuts))))
            else:
                self.update((w, self.encode(w)) for w in some)

    def texts(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text."""
        split = [None if _OTHER.search(t) else _WORD.findall(t.encode().lower().decode()) for t in texts]
        self.learn(set().union(*(w for w in split if w)))
        for t, words in zip(texts, split):
            yield self.encode(t) if words is None else b"".join(map(self.__getitem__, words))

    def text(self, text: str) -> bytes:
        return next(self.texts([text]))


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def best_fit(lengths: Iterable[int], capacity: int = CAPACITY) -> list[tuple[int, int, int]]:
    """(bin, offset, fill of the bin) of each item: longest first, each into the fullest bin that takes it."""
    lengths = list(lengths)
    where: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free places
    some, fills = 0, []  # bit r: there is a bin with r free places
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fit = some >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                some ^= 1 << r
        else:
            b, r = len(fills), capacity
            fills.append(0)
        where[i] = (b, fills[b])
        fills[b] += n
        free[r - n].append(b)
        some |= 1 << (r - n)
    return [(b, at, fills[b]) for b, at in where]


def _local(path: str, capacity: int, end: int, with_ids: bool, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tail = encoder(path), end.to_bytes(4, "little")
        out: list[list] = [[], [], [], [], [], []]
        kind, base, held = None, TaskContext.get().partitionId() << 32, 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal base
            placed = best_fit(out[3], capacity)
            columns = [pa.array(out[0], kind), pa.array(out[1], pa.int32()), *[pa.array(c, pa.int64()) for c in out[2:5]], *([pa.array(out[5], pa.binary())] if with_ids else [])]
            columns += [pa.array([base + b for b, _, _ in placed], pa.int64()), pa.array([at for _, at, _ in placed], pa.int64()), pa.array([f for _, _, f in placed], pa.int32())]
            base += 1 + max(b for b, _, _ in placed)
            for c in out:
                c.clear()
            whole = pa.RecordBatch.from_arrays(columns, names=[str(i) for i in range(len(columns))])
            for k in range(0, len(whole), 20_000):
                yield whole.slice(k, 20_000)

        for batch in batches:
            kind = batch.schema.field(0).type
            for key, ids in zip(batch.column(0).to_pylist(), words.texts([t or "" for t in batch.column(1).to_pylist()])):
                ids += tail
                view = memoryview(ids)
                for k in range(0, len(ids), 4 * capacity):
                    piece = view[k : k + 4 * capacity]
                    for column, value in zip(out, (key, k // (4 * capacity), k // 4, len(piece) // 4, zlib.crc32(piece), bytes(piece) if with_ids else None)):
                        column.append(value)
                held += len(ids) // 4
                if held >= window:
                    yield from packed()
                    held = 0
        if out[0]:
            yield from packed()
        words.clear()  # a worker lives on after its task

    return run


def _merge(group: pd.DataFrame, capacity: int) -> pd.DataFrame:
    group = group.sort_values("cur", ignore_index=True)
    placed = best_fit(group["fill"].tolist(), capacity)
    first: dict[int, int] = {}
    for cur, (b, _, _) in zip(group["cur"].tolist(), placed):
        first[b] = min(cur, first.get(b, cur))
    return pd.DataFrame({"cur": group["cur"], "new": [first[b] for b, _, _ in placed], "add": [at for _, at, _ in placed], "new_fill": [f for _, _, f in placed]})


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end: int = END, slack: int = SLACK, group: int = GROUP, with_ids: bool = False, window: int = WINDOW) -> DataFrame:
    """One row per piece: (id_col, piece, start, length, ids_crc32, [ids,] sequence_id, offset)."""
    bounded_batches(docs.sparkSession)
    keys = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("t"))
    schema = f"id {keys.schema['id'].dataType.simpleString()}" + ", piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids + ", bin bigint, at bigint, bin_fill int"
    pieces = materialize(keys.mapInArrow(frugal(_local(path or tokenizer_path(), capacity, end, with_ids, window)), schema), "pack-pieces")
    # where each underfull bin of a partition ends up: (bin, cur, base, fill)
    state = pieces.where(F.col("bin_fill") < capacity - slack).select("bin", F.col("bin").alias("cur"), F.lit(0).cast("long").alias("base"), F.col("bin_fill").alias("fill")).distinct()
    state = materialize(state, "pack-bins")
    before, rounds = None, 0
    while True:
        items = state.where(F.col("fill") < capacity - slack).select("cur", "fill").distinct()
        n = items.count()
        groups = max(1, -(-n // group))
        if n < 2 or before is not None and n > 0.99 * before:
            break
        rounds += 1
        dealt = items.withColumn("g", F.pmod(F.xxhash64("cur", F.lit(rounds)), F.lit(groups)))
        merged = dealt.groupBy("g").applyInPandas(lambda g: _merge(g, capacity), "cur bigint, new bigint, add bigint, new_fill int")
        merged = merged.withColumnRenamed("cur", "m_cur")
        state = state.join(merged, F.col("cur") == F.col("m_cur"), "left").select(
            "bin", F.coalesce("new", "cur").alias("cur"), (F.col("base") + F.coalesce("add", F.lit(0))).alias("base"), F.coalesce("new_fill", "fill").alias("fill")
        )
        state = materialize(state, "pack-bins")
        before = n
        if groups == 1:
            break
    moved = state.select(F.col("bin").alias("s_bin"), "cur", "base")
    return pieces.join(moved, F.col("bin") == F.col("s_bin"), "left").select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, F.coalesce("cur", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("base", F.lit(0))).alias("offset")
    )
