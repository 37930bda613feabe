"""The pipeline against plain versions of its stages."""

import collections

import corpus_pipeline as P
from siftlake.llm import mixing, near_dedup, packing, quality
from siftlake.llm import queries as Q

from ..test_entry import compare
from .test_operators import ODD, SCHEMA, _check_packing, _classes, low


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(P.STAGES)
    assert list(stage) == ["quality classifier", "exact dedup", "near dedup", "mixing", "packing"] and P.ORACLE_SQL is None
    good = stage["quality classifier"](spark, docs, sf).cache()
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    want = {r["doc_id"] for r in docs.collect() if model.score(*quality.featurize(r["text"], [r["n_chars"]])) >= quality.THRESHOLD}
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()} == want
    best = {}
    for r in good.collect():
        best[low(r["text"])] = max(r["doc_id"], best.get(low(r["text"]), -1))
    single = stage["exact dedup"](spark, good, sf).cache()
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(best.values())
    rows = single.collect()
    least = {}
    for r, c in zip(rows, _classes([r["text"] for r in rows])):
        least[c] = min(r["doc_id"], least.get(c, r["doc_id"]))
    apart = stage["near dedup"](spark, single, sf).cache()
    assert sorted(r["doc_id"] for r in apart.collect()) == sorted(least.values())
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_report(apart).collect()}
    mixed = stage["mixing"](spark, apart, sf).cache()
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == collections.Counter({k: v for k, v in copies.items() if v})
    packed = stage["packing"](spark, mixed, sf).collect()
    used, fewest = _check_packing(mixed, packed)
    assert used <= fewest + 2


def test_odd_rows_and_empty_tables(spark, sf):
    odd = spark.createDataFrame([(i, t, l, s, None if t is None else len(t), 1, "b", "i", "t", "z", "sc", "bu", "co") for i, t, l, s in ODD], SCHEMA)
    for docs in (odd, odd.limit(0)):
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns and out.count() >= 0
        assert P.STAGES[-1][1](spark, docs, sf).count() >= docs.count()


def test_run(spark, sf):
    assert P.run(spark, sf).count() > 0


def test_sql(spark, sf):
    for name, sql in Q.ORACLE_SQL.items():
        compare(spark, sf, name, Q.QUERIES[name], sql)
