"""Operator 1: masked pseudo-likelihood scores from a bidirectional window network trained in numpy.

Words are counted over the whole corpus. All that occur LEAST times (and the OWN most frequent in any case) get token ids of their
own, so the vocabulary grows with the corpus; all others share hashed ids. A token is predicted from the WINDOW tokens on either
side: h = tanh(b + sum of one embedding per position), and its id, written in three or more digits of base 16, digit by digit, each
by a softmax given h and the digits before, so a step costs 16 outputs a digit and not the vocabulary. The probability of a word
with a shared id is that of the id times the word's share of the id's occurrences, by a join with the full counts; words with an id
of their own are left out of it, so no key of it has more than LEAST rows. A document's score is the sum of log p(word | both sides) over all its words.

Training is distributed: each partition goes through all its documents, from common starting weights; weights are then averaged by
tokens (only they are shuffled), for ROUNDS rounds. A hash of token, place and document deals the positions to the rounds, so every
position is a target in one of them.
Texts become ids once; training and scoring read these. Weights depend on how rows lie in partitions, as any averaged training does, and are
the same for the same table. Everything covers all data; what is gathered (word counts and weights of every partition, rare words of every row) grows with it.

Defined cases: null or empty texts have no tokens, a score of 0.0 and a mean of null; a text of one word is predicted from
padding alone; repeated rows score alike; an empty table gives an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, quoted

#: Ids of the least vocabulary: OWN for frequent words, the rest hashed; one more stands for what lies beyond the text.
IDS, OWN, BASE = 4096, 2048, 16
SHARED = IDS - OWN
#: Words of so many occurrences have ids of their own, however many words these are.
LEAST = 1000
WINDOW, WIDTH = 2, 16
ROUNDS = 2
BATCH, RATE = 16_384, 0.1
#: Words that a task counts before it hands its counts on; bytes of text that are hashed at a time.
COUNTED, SEGMENT = 2_000_000, 1 << 20
_OFFSETS = [o for o in range(-WINDOW, WINDOW + 1) if o]
#: The tables of nodes: for each digit but the first, an embedding of the digits before.
_NODES = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh")


def id_count(own: int) -> int:
    """Ids of a vocabulary of so many words of their own."""
    return max(own, OWN) + SHARED


def shapes(ids: int = IDS) -> dict[str, tuple[int, ...]]:
    digits = next(d for d in range(3, len(_NODES) + 2) if BASE**d >= ids)
    out = {"embed": (len(_OFFSETS), ids + 1, WIDTH), "bias": (WIDTH,)}
    out |= {k: (-(-ids // BASE ** (digits - 1 - i)), WIDTH) for i, k in enumerate(_NODES[: digits - 1])}
    return out | {f"w{i}": (WIDTH, BASE) for i in range(digits)} | {f"b{i}": (BASE,) for i in range(digits)}


def weights(ids: int = IDS) -> int:
    return sum(int(np.prod(s)) for s in shapes(ids).values())


#: Weights travel in blocks of so many numbers.
BLOCK = 4096


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n + 1, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


_BASE = 0x100000001B3  # odd, so it has an inverse modulo 2**64
_UP, _DOWN = _powers(_BASE, SEGMENT), _powers(pow(_BASE, -1, 1 << 64), SEGMENT)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, where it begins) by prefix sums of a polynomial."""
    b = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], ~_WHITE[b], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    up, down = (_UP, _DOWN) if len(b) <= SEGMENT else (_powers(_BASE, len(b)), _powers(pow(_BASE, -1, 1 << 64), len(b)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)])])
    return _mix((sums[end] - sums[start]) * down[start]), start


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the lower-case words of all texts in order, number of words of each text). Texts go through in
    segments of about SEGMENT bytes, cut at white space."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    held: list[bytes] = []
    first = size = 0

    def flush(upto: int) -> None:
        nonlocal held, first, size
        if held:
            h, start = _hashed(b"\n".join(held))
            begins = np.cumsum([0, *[len(x) + 1 for x in held[:-1]]])
            counts[first:upto] += np.bincount(np.searchsorted(begins, start, "right") - 1, minlength=len(held))[: upto - first]
            hashes.append(h)
        held, first, size = [], upto, 0

    for i, t in enumerate(texts):
        data = (t or "").lower().encode("utf-8", "surrogatepass")
        if size + len(data) > SEGMENT:
            flush(i)
        while len(data) > SEGMENT:
            cut = max(data.rfind(b" ", 0, SEGMENT), data.rfind(b"\n", 0, SEGMENT))
            if cut <= 0:
                break
            h, _ = _hashed(data[:cut])
            hashes.append(h)
            counts[i] += len(h)
            data = data[cut:]
        held.append(data)
        size += len(data)
    flush(len(texts))
    return np.concatenate(hashes) if hashes else np.empty(0, np.uint64), counts


class Vocabulary:
    """Token ids by word hash: the frequent ones have ids of their own."""

    def __init__(self, frequent: np.ndarray):
        self.order = np.argsort(frequent)
        self.sorted = frequent[self.order]
        self.own, self.size = id_count(len(frequent)) - SHARED, id_count(len(frequent))

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of tokens of each)."""
        ids, counts, _ = self.split(texts)
        return ids, counts

    def split(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same, and the hashes of all words."""
        h, counts = word_hashes(texts)
        ids = (self.own + (h >> np.uint64(32)) % np.uint64(SHARED)).astype(np.int32)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
            own = self.sorted[at] == h
            ids[own] = self.order[at[own]]
        return ids, counts, h


def _slices(batch: pa.RecordBatch, column: int, size: int = 500) -> Iterator[tuple[int, list[str | None]]]:
    for at in range(0, len(batch), size):
        yield at, batch.column(column).slice(at, size).to_pylist()


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all rows, words by their hash; tasks add up what they have read before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def hand_on() -> pa.RecordBatch:
            w, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], names=["word", "n"])

        for b in batches:
            held.extend(word_hashes(texts)[0] for _, texts in _slices(b, 0))
            if sum(map(len, held)) > COUNTED:
                yield hand_on()
        if held:
            yield hand_on()

    return docs.select(quoted(text_col)).mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, own: int = OWN, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the words with ids of their own: all that occur `least` times, and `own` words in any case."""
    n = max(own, counts.where(F.col("n") >= least).count())
    got = counts.orderBy(F.col("n").desc(), "word").limit(n).toArrow()
    return got["word"].to_numpy().view(np.uint64), got["n"].to_numpy()


def frequent_words(docs: DataFrame, text_col: str = "text", own: int = OWN, least: int = LEAST) -> np.ndarray:
    """The words with ids of their own: hashes, by count, then hash."""
    return most_frequent(word_counts(docs, text_col), own, least)[0]


def shared_counts(counts: DataFrame, frequent: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Occurrences of each shared id: SHARED sums, less those of the words with ids of their own."""
    sums = np.zeros(SHARED, np.int64)
    for r in counts.groupBy((F.shiftrightunsigned("word", 32) % SHARED).alias("i")).agg(F.sum("n").alias("n")).collect():
        sums[r["i"]] = r["n"]
    np.subtract.at(sums, ((frequent >> np.uint64(32)) % np.uint64(SHARED)).astype(np.int64), n)
    return sums


def unpacked(flat: np.ndarray, ids: int = IDS) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in shapes(ids).items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s)
        at += n
    return out


def initial(seed: int = 5, ids: int = IDS) -> np.ndarray:
    return np.random.default_rng(seed).normal(0, 0.1, weights(ids)).astype(np.float32)


def contexts(ids: np.ndarray, counts: np.ndarray, beyond: int = IDS) -> np.ndarray:
    """(len(ids), 2 * WINDOW) ids around each position, padding beyond the ends of its text."""
    at = np.arange(len(ids)) + WINDOW * (1 + np.repeat(np.arange(len(counts)), counts))
    padded = np.full(len(ids) + WINDOW * (len(counts) + 1), beyond, np.int32)
    padded[at] = ids
    return np.stack([padded[at + o] for o in _OFFSETS], 1)


def _softmax(z: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log p of the targets, p). Logits are held below what the exponential can take."""
    z = np.minimum(z, 60)
    e = np.exp(z)
    s = e @ np.ones(z.shape[1], z.dtype)
    return z[np.arange(len(z)), target] - np.log(s), e / s[:, None]


def forward(w: dict[str, np.ndarray], context: np.ndarray, target: np.ndarray):
    """(log p of each target, what the gradient needs)."""
    h = np.tanh(w["bias"] + sum(w["embed"][i][context[:, i]] for i in range(context.shape[1])))
    digits = sum(f"w{i}" in w for i in range(len(_NODES) + 1))
    nodes = [target // BASE ** (digits - 1 - i) for i in range(digits)]  # the digits up to each
    inputs = [h, *(h + w[k][n] for k, n in zip(_NODES, nodes[:-1]))]
    logp, ps = np.zeros(len(target), np.float32), []
    for i, node in enumerate(nodes):
        lp, p = _softmax(inputs[i] @ w[f"w{i}"] + w[f"b{i}"], node % BASE)
        logp += lp
        ps.append((p, node % BASE))
    return logp, (h, inputs, ps, nodes[:-1])


def _scatter(index: np.ndarray, g: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(index, weights=g[:, j], minlength=n) for j in range(g.shape[1])], 1).astype(np.float32)


def gradient(w: dict[str, np.ndarray], context: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
    """Of the summed negative log-probability."""
    _, (h, inputs, ps, nodes) = forward(w, context, target)
    out, back = {}, []
    for i, (p, digit) in enumerate(ps):
        d = p.copy()
        d[np.arange(len(d)), digit] -= 1
        out[f"w{i}"], out[f"b{i}"] = inputs[i].T @ d, d.sum(0)
        back.append(d @ w[f"w{i}"].T)
    for k, node, g in zip(_NODES, nodes, back[1:]):
        out[k] = _scatter(node, g, len(w[k]))
    dz = sum(back) * (1 - h * h)
    out["bias"] = dz.sum(0)
    out["embed"] = np.stack([_scatter(context[:, i], dz, w["embed"].shape[1]) for i in range(context.shape[1])])
    return out


def dealt(ids: np.ndarray, counts: np.ndarray, rounds: int) -> np.ndarray:
    """The round of each position, by a hash of its token, its place and its text."""
    ends = np.cumsum(counts)
    place = np.arange(len(ids)) - np.repeat(ends - counts, counts)
    own = _mix(ids.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(32)) + np.uint64(1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own, dtype=np.uint64)])
    text = _mix(sums[ends] - sums[ends - counts])
    return (_mix(own ^ np.repeat(text, counts)) % np.uint64(rounds)).astype(np.int64)


class Trainer:
    """Adagrad over batches of positions."""

    def __init__(self, flat: np.ndarray, ids: int = IDS):
        self.flat, self.ids = flat.copy(), ids
        self.w, self.seen = unpacked(self.flat, ids), unpacked(np.full(len(flat), 1e-3, np.float32), ids)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = self.tokens = 0

    def add(self, ids: np.ndarray, counts: np.ndarray, round_: int, rounds: int) -> None:
        """Takes in texts; targets are the positions dealt to the round."""
        at = np.flatnonzero(dealt(ids, counts, rounds) == round_)
        if len(at):
            self.held.append((contexts(ids, counts, self.ids)[at], ids[at]))
            self.waiting += len(at)
            if self.waiting >= BATCH:
                self.step()

    def step(self) -> None:
        if not self.held:
            return
        context, target = np.concatenate([c for c, _ in self.held]), np.concatenate([t for _, t in self.held])
        for i in range(0, len(target), BATCH):
            n = len(target[i : i + BATCH])
            for k, g in gradient(self.w, context[i : i + BATCH], target[i : i + BATCH]).items():
                g /= n**0.5
                self.seen[k] += g * g
                self.w[k] -= RATE * g / np.sqrt(self.seen[k])
        self.tokens += len(target)
        self.held, self.waiting = [], 0


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of weights, averaged by tokens."""
    sums: dict[int, list] = {}
    for batch in batches:
        for block, tokens, x in zip(*(batch.column(i) for i in range(3))):
            s = sums.setdefault(block.as_py(), [0, 0.0])
            s[0] += tokens.as_py()
            s[1] = s[1] + x.values.to_numpy().astype(np.float64) * tokens.as_py()
    for block, (tokens, s) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([(s / tokens).astype(np.float32)], pa.list_(pa.float32()))], names=["block", "weights"])


def encoded(docs: DataFrame, frequent: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, id, ids, rare) of every row: the token ids (little-endian, 32-bit), and the hashes of the words with shared ids, in order."""
    words = docs.sparkSession.sparkContext.broadcast(frequent)  # 8 bytes a word with an id of its own
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(words.value)
        for b in batches:
            for at, texts in _slices(b, 2):
                ids, n, h = vocabulary.split(texts)
                ends, rare = np.concatenate([[0], np.cumsum(n)]), ids >= vocabulary.own
                data = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(ids.astype("<i4"))])
                upto = np.concatenate([[0], np.cumsum(rare)])[ends]
                hashes = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(h[rare].view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), b.column(1).slice(at, len(texts)), data, hashes], names=["rid", "id", "ids", "rare"])

    return rows.mapInArrow(run, f"rid bigint, id {rows.schema['id'].dataType.simpleString()}, ids binary, rare array<bigint>")


def _ids_of(column: pa.Array, size: int = 500) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids of all rows, number of each) of a column of ids, some rows at a time."""
    for at in range(0, len(column), size):
        each = [np.frombuffer(x.as_buffer(), "<i4") for x in column.slice(at, size)]
        yield at, np.concatenate(each) if each else np.empty(0, np.int32), np.array([len(x) for x in each], np.int64)


def train_ids(rows: DataFrame, ids: int, rounds: int = ROUNDS) -> np.ndarray:
    """The averaged weights, from rows with a column ids. What reaches the driver is one set of weights a round."""
    sc, flat = rows.sparkSession.sparkContext, initial(ids=ids)
    for round_ in range(rounds):
        start = sc.broadcast(flat)

        def run(batches: Iterator[pa.RecordBatch], round_=round_, start=start) -> Iterator[pa.RecordBatch]:
            t = Trainer(start.value, ids)
            for b in batches:
                for _, got, n in _ids_of(b.column(0)):
                    t.add(got, n, round_, rounds)
            t.step()
            if t.tokens:
                for at in range(0, len(t.flat), BLOCK):
                    yield pa.RecordBatch.from_arrays([pa.array([at // BLOCK], pa.int32()), pa.array([t.tokens], pa.int64()), pa.array([t.flat[at : at + BLOCK]], pa.list_(pa.float32()))], names=["block", "tokens", "weights"])

        local = rows.select("ids").mapInArrow(run, "block int, tokens bigint, weights array<float>")
        got = local.repartition("block").mapInArrow(_mean, "block int, weights array<float>").toArrow()
        flat = flat.copy()
        for block, x in zip(got["block"].to_pylist(), got["weights"]):
            flat[block * BLOCK : (block + 1) * BLOCK] = x.values.to_numpy()
        start.unpersist()
    return flat


def train(docs: DataFrame, frequent: np.ndarray, text_col: str = "text", rounds: int = ROUNDS) -> np.ndarray:
    """The averaged weights of a network trained on docs."""
    return train_ids(encoded(docs, frequent, text_col, text_col), id_count(len(frequent)), rounds)


def text_scores(w: dict[str, np.ndarray], ids: np.ndarray, counts: np.ndarray, given: np.ndarray | None = None) -> np.ndarray:
    """Summed conditional log-probabilities of all tokens of each text; given: what is added to that of each token."""
    context = contexts(ids, counts, w["embed"].shape[1] - 1)
    logp = [forward(w, context[i : i + BATCH], ids[i : i + BATCH])[0] for i in range(0, len(ids), BATCH)]
    each = np.concatenate(logp or [np.empty(0)]).astype(np.float64)
    sums = np.concatenate([[0.0], np.cumsum(each if given is None else each + given)])
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]


def score_ids(rows: DataFrame, flat: np.ndarray, own: int, shared_n: np.ndarray | None = None) -> DataFrame:
    """(rid, id, n_tokens, pll) of rows with ids; own is the number of ids that stand for one word. A shared id counts as one word, or,
    with the occurrences of the shared ids (shared_n), pll is less their logarithm for each such word."""
    shared = rows.sparkSession.sparkContext.broadcast((flat, shared_n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, n_of = unpacked(shared.value[0], own + SHARED), shared.value[1]
        for b in batches:
            for at, ids, n in _ids_of(b.column(2)):
                given = None
                if n_of is not None:
                    rare = ids >= own
                    given = np.zeros(len(ids))
                    given[rare] = -np.log(n_of[ids[rare] - own])
                sums = text_scores(w, ids, n, given)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(n)), b.column(1).slice(at, len(n)), pa.array(n), pa.array(sums)], names=["rid", "id", "n_tokens", "pll"])

    return rows.select("rid", "id", "ids").mapInArrow(run, f"rid bigint, id {rows.schema['id'].dataType.simpleString()}, n_tokens bigint, pll double")


def _told(scored: DataFrame, id_col: str, *more: str) -> DataFrame:
    return scored.select(F.col("id").alias(id_col), "n_tokens", "pll", F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens")).alias("mean_pll"), *more)


def score(docs: DataFrame, flat: np.ndarray, frequent: np.ndarray, id_col: str = "doc_id", text_col: str = "text", shared_n: np.ndarray | None = None) -> DataFrame:
    """(id_col, n_tokens, pll, mean_pll) of every row; one narrow pass. Words with shared ids have the probability of the id."""
    return _told(score_ids(encoded(docs, frequent, id_col, text_col), flat, id_count(len(frequent)) - SHARED, shared_n), id_col)


def with_word_counts(scored: DataFrame, rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds to pll the logarithm of its count for each word with a shared id, by a join. Words of one occurrence add nothing."""
    each = rows.select(F.col("rid").alias("r"), F.explode("rare").alias("word")).join(counts.where("n > 1"), "word")
    more = each.groupBy("r").agg(F.sum(F.ln("n")).alias("more"))
    out = scored.join(more, F.col("rid") == F.col("r"), "left")
    return out.withColumn("pll", F.col("pll") + F.coalesce("more", F.lit(0.0))).drop("r", "more")


def word_scores(docs: DataFrame, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, **vocabulary: int) -> DataFrame:
    """(id_col, n_tokens, pll, mean_pll) of every row of docs, by a network trained on docs whose words have these counts."""
    frequent, n = most_frequent(counts, **vocabulary)
    rows = materialize(encoded(docs, frequent, id_col, text_col), "pll-ids")
    flat = train_ids(rows, id_count(len(frequent)), rounds)
    scored = score_ids(rows, flat, id_count(len(frequent)) - SHARED, shared_counts(counts, frequent, n))
    return _told(with_word_counts(scored, rows, counts), id_col)


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Counts, trains and scores on docs."""
    bounded_batches(docs.sparkSession)
    return word_scores(docs, materialize(word_counts(docs, text_col), "pll-counts"), id_col, text_col, rounds)
