"""Operator 7: near-duplicate detection by BagMinHash over multisets of word shingles.

A document is the multiset of its runs of SHINGLE words (lower case, runs of word characters). Its signature has one
register per hash function. The weight axis of a shingle is discretised into dyadic blocks [0,1), [1,2), [2,4),
[4,8), ...; each block has one Poisson process of points in time at the block's length as rate; blocks are not split further (the hierarchical
step of BagMinHash), points beyond the weight are rejected instead: a point has a position
within its block and belongs to the document if the position lies below the shingle's weight. Every point picks a
register, which keeps its earliest point. Two signatures agree in a register with probability equal to the
weighted Jaccard similarity. Generating points in order of time and stopping once all registers are filled makes the work per document
about its number of distinct shingles plus registers * log(registers).

Signatures are cut into BANDS of ROWS registers; documents of similarity s share a band with probability
1 - (1 - s**ROWS)**BANDS, above 0.999998 at 0.8. Candidates are verified by their true multiset overlap, from whole texts:

1. documents with equal multisets are one node; nodes that share a band key form a bucket. Buckets of up to SMALL nodes, which is most
   of them and all that chance makes, fall apart into groups whose signatures agree in FLOOR of the registers (see 3), so that a
   chance band ties no two texts; larger ones stay whole. Buckets that share nodes are a component, found by labels that go from nodes to
   buckets and back, at a cost of one row per membership;
2. components hold all pairs that share a band and may be links. Texts of nodes in a component are fetched once, past a fixed-size
   Bloom filter of their ids, and a component is cut into blocks of BLOCK nodes (or BLOCK_WEIGHT shingles);
3. a task compares the nodes of two blocks: pairs that are not yet in one class and whose signatures agree in FLOOR of the
   registers (a true pair agrees in less with probability 2e-6) are verified, and only links that join two classes leave the task.

Classes are the connected components of the links, by label propagation on tables in the shared folder.

Defined cases: a text of fewer than SHINGLE words (but some) is one shingle of all its words; texts without words (null
and empty ones among them) are alike only if equal, null as empty. Repeated rows and repeated ids are rows like others.
Null ids are carried along; a class named by its least id is null only if all its ids are. Columns other than id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, frugal, materialize, quoted, text_hash, text_of, without

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 4
REGISTERS = BANDS * ROWS
FLOOR, BLOCK, BLOCK_WEIGHT = 0.6, 2048, 2_000_000
#: Nodes of a bucket whose signatures are compared before it ties them.
SMALL = 64
#: Bits of the filter that keeps texts which no pair needs from being shuffled; fixed, whatever the input.
FILTER_BITS = 1 << 24
CACHE = 200_000
#: Shingles whose points are drawn together.
TOGETHER = 100_000

_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)
_WORD = re.compile(r"\w+")


class _WordHashes(dict):
    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")).to_bytes(8, "little")
        return h


_words = _WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def bag(text: str | None, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order, and how often each occurs."""
    w = np.frombuffer(b"".join(map(_words.__getitem__, _WORD.findall((text or "").lower()))), _U)
    if len(w) == 0:
        return w, np.empty(0, np.int64)
    n = min(size, len(w))
    h = np.full(len(w) - n + 1, n, _U)
    for i in range(n):
        h = mix(h + w[i : len(w) - n + 1 + i] * _U(2 * i + 1) + _GOLDEN)
    return np.unique(h, return_counts=True)


def node_of(text: str | None, shingles: np.ndarray, counts: np.ndarray) -> int:
    """Names the multiset; texts without words are named by themselves."""
    data = shingles.tobytes() + counts.tobytes() if len(shingles) else b"\0" + (text or "").encode("utf-8", "surrogatepass")
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - both
    return both / total if total else 0.0


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """(len(bags), registers) float64: the earliest point of each register. Bags must not be empty."""
    docs = len(bags)
    doc = np.repeat(np.arange(docs), [len(b[0]) for b in bags])
    shingle, weight = np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags])
    # blocks of the weight axis: 0 is [0, 1), j is [2**(j-1), 2**j)
    parts, j, left = [], 0, np.arange(len(doc))
    while len(left):
        low = 0 if j == 0 else 1 << (j - 1)
        parts.append((left, np.full(len(left), low), np.full(len(left), max(1, low)), np.full(len(left), j, _U)))
        j += 1
        left = left[weight[left] > 1 << (j - 1)]
    at, low, rate, level = (np.concatenate(c) for c in zip(*parts))
    seed, doc, weight = mix(shingle[at] + (level + _U(1)) * _GOLDEN), doc[at], weight[at]
    total = np.bincount(doc, weights=np.minimum(weight - low, rate), minlength=docs)
    horizon = registers * (np.log(registers) + 4) / total
    best = np.full(docs * registers, np.inf)

    def draw(s: np.ndarray, k: int) -> np.ndarray:
        return (mix(s + _U(k) * _GOLDEN) >> _U(11)).astype(np.float64) * 2.0**-53

    x, k = -np.log1p(-draw(seed, 1)) / rate, 1
    late: list[tuple[np.ndarray, ...]] = []  # points beyond the horizon, in case registers stay empty
    live = (seed, doc, weight, low, rate, x, np.full(len(x), k, np.int64))
    while True:
        while len(live[0]):
            due = live[5] <= horizon[live[1]]
            if not due.all():
                late.append(tuple(c[~due] for c in live))
                live = tuple(c[due] for c in live)
            seed, doc, weight, low, rate, x, step = live
            if not len(seed):
                break
            r = mix(seed ^ mix(step.astype(_U) * _U(0xD6E8FEB86659FD93)))
            position = low + rate * ((r >> _U(32)).astype(np.float64) * 2.0**-32)
            ok = position < weight
            np.minimum.at(best, doc[ok] * registers + (r[ok] & _U(0xFFFFFFFF)).astype(np.int64) % registers, x[ok])
            gap = -np.log1p(-((mix(seed + (step + 1).astype(_U) * _GOLDEN) >> _U(11)).astype(np.float64) * 2.0**-53)) / rate
            live = (seed, doc, weight, low, rate, x + gap, step + 1)
        empty = np.isinf(best.reshape(docs, registers)).any(1)
        if not empty.any():
            return best.reshape(docs, registers)
        horizon[empty] *= 2
        again = [tuple(c[empty[p[1]]] for c in p) for p in late]
        live, late = tuple(np.concatenate(c) for c in zip(*again)), []


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(docs, BANDS) int64 keys."""
    s = mix(signature.view(_U)).reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=_U), s.shape[:2]).copy()
    for i in range(ROWS):
        key = mix(key * _GOLDEN + s[:, :, i])
    return key.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held: list[tuple] = []
        weight = 0
        for key, text, raw in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            text = text.as_py()
            b = bag(text)
            held.append((key, node_of(text, *b), b, raw))
            weight += len(b[0])
            if weight > TOGETHER:
                yield _sketched(held, batch.schema.field(0).type)
                held, weight = [], 0
        if held:
            yield _sketched(held, batch.schema.field(0).type)
    _words.clear()  # a worker lives on after its task


def _sketched(held: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    full = [i for i, x in enumerate(held) if len(x[2][0])]
    bands, bits = [[] for _ in held], [b""] * len(held)
    if full:
        s = signatures([held[i][2] for i in full])
        for i, keys, low in zip(full, band_keys(s), (mix(s.view(_U)) & _U(255)).astype(np.uint8)):
            bands[i], bits[i] = keys, low.tobytes()
    arrays = [
        pa.array([x[0] for x in held], kind), pa.array([x[1] for x in held], pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.binary()),
        pa.array([len(x[2][0]) for x in held], pa.int64()), pa.array([x[3] for x in held], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=["id", "node", "bands", "bits", "weight", "raw"])


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows with equal values in the first `keys` columns, one table a run; batches come sorted by them."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for b in batches:
        if not len(b):
            continue
        columns = [b.column(i).to_numpy() for i in range(keys)]
        new = np.zeros(len(b), bool)
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cuts = [*np.flatnonzero(new), len(b)]
        for i, j in zip(cuts, cuts[1:]):
            this = tuple(c[i] for c in columns)
            if this != now and held:
                yield pa.Table.from_batches(held)
                held = []
            now = this
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _agree(bits: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether signatures, by 8 bits a register, agree in FLOOR of the registers, but for chance."""
    return ((bits == others).mean(-1) - 1 / 256) / (1 - 1 / 256) >= FLOOR


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, node, bits) of small buckets, sorted by bucket; (bucket, node, least) of the groups in them that agree, each under a
    key of its own."""
    held: pa.RecordBatch | None = None

    def groups(b: pa.RecordBatch) -> pa.RecordBatch:
        bucket, node = b.column(0).to_numpy(), b.column(1).to_numpy()
        bits = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(len(b), REGISTERS)
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        sizes = np.diff(starts, append=len(b))
        pairs = starts[sizes == 2]
        pairs = pairs[_agree(bits[pairs], bits[pairs + 1])]
        rows, keys, least = [pairs, pairs + 1], [bucket[pairs], bucket[pairs]], [np.minimum(node[pairs], node[pairs + 1])] * 2
        for at, n in zip(starts[sizes > 2], sizes[sizes > 2]):
            own, classes = bits[at : at + n], _Classes(n)
            near = _agree(own[:, None], own[None])
            for x, y in zip(*np.nonzero(np.triu(near, 1))):
                classes.join(x, y)
            for label in np.unique(classes.of):
                members = at + np.flatnonzero(classes.of == label)
                if len(members) > 1:
                    rows.append(members)
                    keys.append(np.full(len(members), mix(bucket[at : at + 1].view(_U) + _U(label) * _GOLDEN).view(np.int64)[0] if label else bucket[at]))
                    least.append(np.full(len(members), node[members].min()))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys), pa.int64()), pa.array(node[np.concatenate(rows)], pa.int64()), pa.array(np.concatenate(least), pa.int64())], names=["bucket", "node", "least"])

    for b in batches:
        if not len(b):
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        bucket = b.column(0).to_numpy()
        last = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on in the next batch
        held = b.slice(last)
        if last:
            yield groups(b.slice(0, last))
    if held is not None:
        yield groups(held)


class _Classes:
    """Union-find over the rows of a task."""

    def __init__(self, n: int):
        self.of = np.arange(n)  # a label per row, kept flat: reads are many, unions few

    def join(self, a: int, b: int) -> None:
        x, y = self.of[a], self.of[b]
        self.of[self.of == max(x, y)] = min(x, y)


def links_between(bags: list[tuple[np.ndarray, np.ndarray]], bits: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links between rows of left and right (the same rows, or disjoint ones) that join two classes; with those it leaves
    out, they have the same components as all links."""
    out, classes = [], _Classes(len(bags))
    same = left is right
    sizes = np.array([b[1].sum() for b in bags])
    at = np.concatenate([[0], np.cumsum([len(b[0]) for b in bags])])
    ids, flat = np.unique(np.concatenate([b[0] for b in bags]), return_inverse=True)
    counts = np.concatenate([b[1] for b in bags])
    mine = np.zeros(len(ids), np.int64)
    for n, x in enumerate(left):
        others = right[n + 1 :] if same else right
        others = others[_agree(bits[others], bits[x]) & (classes.of[others] != classes.of[x])]
        if not len(others):
            continue
        own = slice(at[x], at[x + 1])
        mine[flat[own]] = counts[own]
        if len(others) > 64 and same:
            both = np.add.reduceat(np.minimum(mine[flat], counts), at[:-1])[others]
        else:
            both = np.array([np.minimum(mine[flat[at[y] : at[y + 1]]], counts[at[y] : at[y + 1]]).sum() for y in others])
        mine[flat[own]] = 0
        for y in others[both >= similarity * (sizes[others] + sizes[x] - both)]:
            if classes.of[x] != classes.of[y]:
                classes.join(x, y)
                out.append((int(x), int(y)))
    return out


def _linked(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (component, i, j, own block, node, bits, text) of two blocks; the links that join classes."""
        for t in _runs(batches, 3):
            found = {}
            for block, node, bits, text in zip(*(t.column(k).to_pylist() for k in (3, 4, 5)), t.column(6)):
                if (block, node) not in found:
                    b = bag(text.as_py())
                    if node_of(text.as_py(), *b) == node:  # else another text under a repeated id
                        found[block, node] = (b, bits)
            if len(found) < 2:
                continue
            nodes, blocks = [n for _, n in found], np.array([b for b, _ in found])
            bits = np.frombuffer(b"".join(x[1] for x in found.values()), np.uint8).reshape(len(found), REGISTERS)
            i, j = t.column(1)[0].as_py(), t.column(2)[0].as_py()
            left = np.flatnonzero(blocks == i)
            pairs = links_between([x[0] for x in found.values()], bits, left, left if i == j else np.flatnonzero(blocks == j), similarity)
            yield pa.RecordBatch.from_arrays([pa.array([nodes[x] for x, _ in pairs], pa.int64()), pa.array([nodes[y] for _, y in pairs], pa.int64())], names=["a", "b"])

    return run


def _places(id_col: str) -> list:
    h, g = F.xxhash64(id_col), F.xxhash64(id_col, F.lit(1))
    return [F.pmod(x, F.lit(FILTER_BITS)).cast("int") for x in (h, F.shiftright(h, 32), g)]


def texts_of(need: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """need, which has a column id, with the texts of its ids as column text. Documents whose id is surely not needed are left where they are; a full filter lets
    all pass, which costs a shuffle and nothing else."""
    words = need.select(F.explode(F.array(*_places("id"))).alias("p")).groupBy(F.expr("p div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, p % 64)")).alias("bits")).toPandas()
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(table.view(np.uint8))  # FILTER_BITS

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_ = shared.value
        for b in batches:
            ok = np.ones(len(b), bool)
            for k in (2, 3, 4):
                p = b.column(k).to_numpy()
                ok &= (bytes_[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["d_id", "text"]).filter(pa.array(ok))

    rows = docs.select(F.col(id_col).alias("d_id"), text_of(text_col).alias("text"), *[p.alias(f"p{k}") for k, p in enumerate(_places(id_col))])
    kind = rows.schema["d_id"].dataType.simpleString()
    passed = rows.mapInArrow(frugal(passing), f"d_id {kind}, text string")
    n = need.withColumnRenamed("id", "n_id")
    return passed.join(n, F.col("d_id").eqNullSafe(F.col("n_id"))).drop("d_id", "n_id")


def _spread(labels: DataFrame, near, steps: int = 2) -> DataFrame:
    """(node, label) of every node from first labels: near(labels) gives (node, near), the least label around each node; labels also
    jump to their own labels. A table is written every few steps, and the end is reached when a table's last step changed nothing;
    rounds grow with the logarithm of a component's diameter in practice."""
    while True:
        for _ in range(steps):
            step = labels.join(near(labels), "node").select("node", "label", F.least("label", "near").alias("new"))
            jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
            step = step.join(jump, "new", "left").select("node", F.least("new", F.coalesce("far", "new")).alias("new"), "label")
            labels = step.select("node", F.col("new").alias("label"))
        step = materialize(step, "near-labels")
        labels = step.select("node", F.col("new").alias("label"))
        if step.where("new <> label").isEmpty():
            return labels


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node in a link: its component's least node."""
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(links.select(F.col(b).alias("x"), F.col(a).alias("y")))
    both = materialize(both.distinct(), "near-edges")
    first = both.groupBy(F.col("x").alias("node")).agg(F.least(F.col("node"), F.min("y")).alias("label"))
    return _spread(first, lambda of: both.join(of.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near")))


def bucket_components(crowded: DataFrame) -> DataFrame:
    """(node, label) of every node in a bucket, from rows (bucket, node, least): nodes are in one component if buckets tie them.
    Labels go from nodes to buckets and back, so a round's rows are the memberships, and none of the pairs in a bucket."""
    pairs = crowded.select("bucket", "node")

    def near(labels: DataFrame) -> DataFrame:
        of = pairs.join(labels, "node").groupBy("bucket").agg(F.min("label").alias("l"))
        return pairs.join(of, "bucket").groupBy("node").agg(F.min("l").alias("near"))

    return _spread(crowded.groupBy("node").agg(F.min("least").alias("label")), near)


def classes(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(rows, named): (id, node, raw) of every row of docs, raw being the text_hash, and (node, label, class_id, class_size,
    class_node) of every node; class_node is the node of the class's least id."""
    bounded_batches(docs.sparkSession)
    id_col, text_col = quoted(id_col), quoted(text_col)
    keyed = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"), text_hash(text_col).alias("raw"))
    kind = keyed.schema["id"].dataType.simpleString()
    sketched = materialize(keyed.mapInArrow(frugal(_sketch), f"id {kind}, node bigint, bands array<bigint>, bits binary, weight bigint, raw bigint"), "near-sketch")
    nodes = materialize(sketched.groupBy("node", "bands", "bits", "weight").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "near-nodes")
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    counted = banded.groupBy("bucket").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = materialize(banded.join(counted, "bucket"), "near-shared-bands")
    some = shared.where(F.col("members") <= SMALL).select("bucket", F.col("node").alias("s_node"))
    some = some.join(nodes.select("node", "bits"), F.col("s_node") == F.col("node")).select("bucket", "node", "bits")
    small = some.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(frugal(_agreeing), "bucket bigint, node bigint, least bigint")
    crowded = materialize(shared.where(F.col("members") > SMALL).select("bucket", "node", "least").unionByName(small), "near-crowded")
    group = bucket_components(crowded).withColumnsRenamed({"label": "component", "node": "c_node"})
    members = materialize(nodes.join(group, F.col("node") == F.col("c_node")).select("component", "node", "id", "bits", "weight"), "near-members")
    sizes = members.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("weight") / BLOCK_WEIGHT)).alias("blocks"))
    rows = texts_of(members.join(sizes, "component").drop("weight"), docs, id_col, text_col)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "bits", "text")
    rows = rows.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    first = components(materialize(rows.mapInArrow(frugal(_linked(similarity)), "a bigint, b bigint"), "near-links"))
    label = nodes.join(first, "node", "left").select("node", "id", "copies", F.coalesce("label", "node").alias("label"))
    named = label.groupBy("label").agg(
        F.min("id").alias("class_id"), F.sum("copies").alias("class_size"), F.coalesce(F.min_by("node", "id"), F.min("node")).alias("class_node")
    )
    named = materialize(label.join(named, "label").select("node", "label", "class_id", "class_size", "class_node"), "near-classes")
    return sketched.select("id", "node", "raw"), named


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: (id_col, class_id, class_size, node). class_id is the least id of the class; node names the
    multiset and tells apart rows with a repeated id."""
    rows, named = classes(docs, id_col, text_col, similarity)
    named = named.select(F.col("node").alias("n_node"), "class_id", "class_size")
    return rows.join(named, F.col("node") == F.col("n_node")).select(F.col("id").alias(id_col), "class_id", "class_size", "node")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class, with all its columns: the row with the class's least id (of rows that share it, the one
    with the least text_hash, and of equal rows any). Rows that go are named by id and hash, so texts are not parsed again."""
    rows, named = classes(docs, id_col, text_col, similarity)
    of = named.where("class_size > 1").select(F.col("node").alias("n_node"), "label", "class_id", "class_node")
    shared = materialize(rows.join(of, F.col("node") == F.col("n_node")).select("id", "raw", "label", F.col("id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("class_node"))).toDF("id", "raw", "label", "least"), "near-shared")
    # rows of a class fold to their (id, hash) where they are read, then the few that have the least id to one
    keep = shared.where("least").groupBy("label", "id", "raw").agg(F.count(F.lit(1)).alias("n"))
    keep = materialize(keep.groupBy("label").agg(F.min(F.struct("raw", "id", "n")).alias("k")).select("label", "k.*"), "near-kept")
    keys = keep.select(F.col("id").alias("k_id"), F.col("raw").alias("k_raw"))
    dropped = shared.select("id", "raw").distinct().join(keys, F.col("id").eqNullSafe(F.col("k_id")) & (F.col("raw") == F.col("k_raw")), "left_anti")
    return without(docs, materialize(dropped, "near-dropped"), materialize(keep.where("n > 1").select("id", "raw"), "near-once"), id_col, text_col)
