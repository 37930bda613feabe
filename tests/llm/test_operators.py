"""Every operator against a plain version, on the small tables and on a table of odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlake.llm import chat, exact_dedup, fingerprint, mixing, near_dedup, packing, pseudo_likelihood, quality, secrets, warc
from siftlake.llm import queries as Q

LONG = "wort " * 30_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, bands string, id string, t string, size string, score string, bucket string, component string"
ODD = [
    (1, "a b c d e f g h", "en", "s1"), (1, "a b c d e f g h", "en", "s1"), (2, None, None, None), (3, "", "en", "s1"), (None, "x y z", "en", None), (None, "x y z", "en", None), (None, None, None, "s2"),
    (4, LONG, "de", "s2"), (5, "A B C D E F G H", "en", "s1"), (6, "!!! ???", "en", "s1"), (7, "ein", "de", "s2"), (8, "Ünïcödé 😀 text\nzwei", "fr", "s3"), (9, "same id", "en", "s1"), (9, "other text", "en", "s1"),
]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, l, s, None if t is None else len(t), 1, "b", "i", "t", "z", "sc", "bu", "co") for i, t, l, s in ODD], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def low(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


# 10
def _exact(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[low(t)] if x is not None]
        out.append((i, max(ids) if ids else None, len(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()))
    return sorted(out, key=str)


def _one_keeper(got):
    """Each group of equal texts has one row that stays, and it has the largest id."""
    kept = [r for r in got if r["kept"]]
    assert all(r["doc_id"] == r["keep_id"] for r in kept) and len(kept) == len({r["text_sha256"] for r in got}) == len({r["text_sha256"] for r in kept})


def test_exact_dedup(docs, odd, empty):
    for df in (docs, odd):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = exact_dedup.exact_dedup(df).collect()
        assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == _exact(rows)
        _one_keeper(got)
        kept = exact_dedup.deduplicated(df)
        assert kept.columns == df.columns and sorted(kept.select("doc_id", F.sha2(exact_dedup.normalised("text"), 256)).collect(), key=str) == sorted(((r["doc_id"], r["text_sha256"]) for r in got if r["kept"]), key=str)
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.deduplicated(empty).count() == 0


def test_ties_have_one_keeper(spark):
    rows = [(7, "Same text"), (7, "same TEXT"), (7, "same TEXT"), (5, "same text"), (None, "x"), (None, "X")]
    for n in (1, 4):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        _one_keeper(exact_dedup.exact_dedup(df).collect())
        assert sorted(map(str, (r["doc_id"] for r in exact_dedup.deduplicated(df).collect()))) == ["7", "None"]


def test_clashing_hashes_do_not_merge_texts(spark, monkeypatch):
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    df = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "ALPHA"), (4, "gamma" * 2000), (5, "gamma" * 2000), (6, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(df).collect()}
    assert got == {1: (3, 2), 3: (3, 2), 2: (2, 1), 4: (5, 2), 5: (5, 2), 6: (6, 1)}


def test_columns_of_any_name(spark, empty):
    df = spark.createDataFrame([(1, "a b c", "s", 3), (2, "A B C", "s", 3), (2, "A B C", "s", 3)], "`doc-id` long, `the text` string, `so``urce` string, `row` int")
    assert exact_dedup.deduplicated(df, "doc-id", "the text").columns == df.columns and near_dedup.near_dedup(df, "doc-id", "the text").count() == 1
    assert mixing.mix(df, "doc-id", "the text", "so`urce").columns == df.columns and packing.pack(df, "doc-id", "the text").count() == 3
    assert chat.digests(chat.format_turns(df, None, "doc-id", "row", "so`urce", "the text"), None, "doc-id", "row").count() == 2
    assert secrets.secret_report(df, "doc-id", "the text").count() == 3 and fingerprint.edit_report(df, "doc-id", "the text").count() == 3


def test_chunks_cover_and_follow_content(docs):
    rows = docs.select(exact_dedup.normalised("text").alias("t")).select("t", exact_dedup.chunks(F.col("t")).alias("c")).collect()
    assert all("".join(r["c"]) == r["t"] for r in rows)
    text = "".join(random.Random(1).choices("abcdefghij klmnop.", k=20_000))
    cut = lambda s: set(docs.sparkSession.createDataFrame([(s,)], "s string").select(exact_dedup.chunks(F.col("s"))).first()[0])
    assert len(cut(text) & cut("an insertion " + text)) > 0.7 * len(cut(text))


def test_ambiguous_chunks_get_ordinals(spark, monkeypatch):
    df = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "alpha"), (4, "beta")], "doc_id long, text string")
    clash = spark.createDataFrame([(0, "alpha", 1), (0, "beta", 1)], "h long, chunk string, uses long")
    assert [tuple(r) for r in exact_dedup.ambiguous_chunks(clash).orderBy("ordinal").collect()] == [(0, "alpha", 1), (0, "beta", 2)]
    assert {r["keep_id"] for r in exact_dedup.exact_dedup(df).collect()} == {3, 4}


# 5
def _edits(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 4
        out.append((i, len(t), hashlib.sha256((t[: len(t) - m] + following[:m]).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("per_bucket", [2048, 3])
def test_fingerprints(docs, odd, empty, per_bucket, monkeypatch):
    monkeypatch.setattr(fingerprint.with_next, "__defaults__", ("id", "t", per_bucket, 10_000))
    for df in (docs, odd):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = fingerprint.edit_report(df).collect()
        assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == _edits(rows)
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
        assert all((r["fingerprint"] == r["edited_fingerprint"]) == (r["first_paragraph"] is None) for r in got)
        assert all(r["near_edited"] == 1.0 for r in got if r["fingerprint"] == r["edited_fingerprint"])
    roots = {r["fingerprint"]: 0 for r in fingerprint.fingerprints(docs).collect()}
    assert len(roots) == docs.select("text").distinct().count()
    assert fingerprint.edit_report(empty).count() == 0


# 6
BASE = {
    "assign": re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def _base(text):
    out = []
    for n, (kind, rx) in enumerate(BASE.items()):
        for m in rx.finditer(text or ""):
            if len(m[2]) >= 8 if kind == "assign" else len(m[0]) >= (16 if kind == "access" else 32):
                out.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}"))
    return sorted(out)


SECRET_TEXTS = [
    "token=abc password: hunter2hunter2", "token=api_key: abcdefgh1", "AKIAAKIAABCDEFGH12 AKIA", "a" * 31 + " " + "0123456789abcdef" * 2, "😀 PASSWD = 'correct.horse' x", "secret=secret=abcdefghijk", None, "",
    "host: db.example.com\nuser: bob\npwd: hunter2hunter\n", "pwd: hunter2hunter alone", "user: bob\n\npwd: hunter2hunter", "user: bob " + "x " * 200 + "pwd: hunter2hunter",
]


#: The weak patterns again, for Python; in order of kind.
WEAK = {
    3: re.compile(r"""(?i:(?<![a-z0-9])(?:client|access_?key|key|account|user|tenant|login)(?:_?(?:id|name))?["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{3,}))"""),
    4: re.compile(r"""(?i:(?<![a-z0-9])(?:pass(?:phrase|code)?|pwd|credentials?|auth|signature|sig|sas|(?:private|shared|access|account)_?key|key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,})|(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"""),
    5: re.compile(r"""(?i:(?<![a-z0-9])(?:https?|ftp|jdbc:[a-z]{2,16}|amqps?|redis|postgres(?:ql)?|mongodb)://[^\s"'<>]{3,}|(?<![a-z0-9])(?:host|server|endpoint|url|bucket)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:/-]{4,})"""),
}


def _links(text):
    """(start, kind, end, credential or None) of every span that is reported, by comparing all pairs."""
    text = text or ""
    found = [(a, k, int(s.split(":")[2])) for a, k, s in _base(text)]
    for better in (4, 3, 5):
        clash = [x for x in found if x[1] < 3 or (better == 3 and x[1] == 4) or better == 5]
        found += [(m.start(), better, m.end()) for m in WEAK[better].finditer(text) if not any(a < m.end() and m.start() < e for a, _, e in clash)]
    breaks = [m.start() for m in re.finditer(r"\n[ \t\r]*\n", text)]
    scope = lambda x: sum(b < x[0] or b == x[0] for b in breaks)
    gap = lambda x, y: max(x[0], y[0]) - min(x[2], y[2])
    secret = lambda x: x[1] in (0, 2, 4)
    linked = sorted(x for x in found if any(secret(y) != secret(x) and scope(y) == scope(x) and gap(x, y) <= 240 for y in found))
    out, number, last = {}, 0, {}
    for x in linked:
        if scope(x) not in last or x[0] - last[scope(x)] > 240:
            number += 1
        last[scope(x)] = max(x[2], last.get(scope(x), 0))
        out[x] = number
    return sorted((*x, out.get(x)) for x in found if x[1] < 3 or x in out)


def _check_links(df, texts):
    want = sorted(str(_links(t)) for t in texts)
    got = collections.defaultdict(list)
    for r in secrets.spans(df).collect():
        got[r["rid"]] += [(r["start"], r["kind"], r["end"], r["credential"])] if r["kind"] is not None else []
    assert sorted(str(sorted(x, key=lambda s: s[:3])) for x in got.values()) == want


def test_links_are_those_of_all_pairs(spark):
    rng = random.Random(4)
    parts = ["user: bob", "key=abcdefgh1", "access_key: hunter2hunter", "pwd: hunter2hunter", "password=geheim123", "AKIAABCDEFGH1234XY", "0123456789abcdef" * 2, "host: db.example.com", "https://h.example/x?key=abcdefgh12", "\n\n", "\n \n", "w " * 130, "ä€ ", "url=abcd"]
    texts = [rng.choice([" ", "\n"]).join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(400)] + [None, "", "key=abcdefgh1", "access_key: hunter2hunter alone"]
    ids = [rng.choice([1, 1, 2, None]) for _ in texts]  # null and repeated ids
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    _check_links(df, texts)
    report = secrets.secret_report(df).collect()
    assert len(report) == len(texts) and all((r["n_linked"] == 0) or "+" in r["credentials"] for r in report)


def test_secrets(spark, docs, odd, empty):
    texts = spark.createDataFrame(list(enumerate(SECRET_TEXTS)), "doc_id long, text string")
    for df in (docs, texts, odd.where("doc_id <> 9 and doc_id <> 1 and doc_id is not null")):
        want = {r["doc_id"]: _base(r["text"]) for r in df.collect()}
        for r in secrets.secret_report(df).collect():
            base = want[r["doc_id"]]
            assert r["base_sha256"] == hashlib.sha256(",".join(s for *_, s in base).encode()).hexdigest()
            assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(n == k for _, n, _ in base) for k in range(3))
            assert {s for *_, s in base} <= set(filter(None, r["spans"].split(",")))
    _check_links(texts, [t for t in SECRET_TEXTS])
    linked = {r["doc_id"]: r["spans"] for r in secrets.secret_report(texts).collect()}
    assert linked[8] == "linked_endpoint:0:20,linked_id:21:30,linked_secret:31:49" and linked[9] == linked[10] == linked[11] == ""
    assert secrets.secret_report(empty).count() == 0 and secrets.secret_report(odd).count() == len(ODD)


# 4
def _targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in capped else level * weight[s] for s in names}
        capped |= over


def test_mixing(docs, odd, empty):
    for df in (docs, odd):
        rows = df.collect()
        sizes = collections.Counter()
        for r in rows:
            sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        got = mixing.mix_report(df).collect()
        assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix_report(df.repartition(5)).collect()))
        taken = collections.Counter()
        for r in got:
            assert r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
            taken[r["source"]] += r["taken"]
        want = _targets(dict(sizes))
        for r in got:
            assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        for r in got:  # what is not taken would not fit in what is left of its target
            room = want[r["source"]] - taken[r["source"]]
            assert room > -1e-6 * max(1, want[r["source"]])
            if r["size"] and r["copies"] <= r["target"] / r["source_size"] - 1e-9 and r["copies"] < 2:
                assert r["size"] > room - 1e-6
        mixed = mixing.mix(df)
        assert mixed.columns == df.columns and mixed.count() == sum(r["copies"] for r in got)
    assert mixing.mix_report(empty).count() == 0 and mixing.mix(empty).count() == 0


# 3
def _check_packing(df, got, capacity=4096):
    tok = packing.encoder(packing.tokenizer_path()).tokenizer
    want = collections.Counter()
    for r in df.collect():
        ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), capacity):
            want[r["doc_id"], k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(ids[k : k + capacity].tobytes())] += 1
    assert want == collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= capacity
    return len(bins), math.ceil(sum(r["length"] for r in got) / capacity)


def test_packing(docs, odd, empty):
    used, least = _check_packing(docs, packing.pack(docs).collect())
    assert used <= least + 1
    used, least = _check_packing(docs, packing.pack(docs.repartition(6), group=3).collect())
    assert used <= 1.1 * least + 1
    used, least = _check_packing(docs, packing.pack(docs.repartition(3), group=4, window=20_000).collect())
    assert used <= 1.1 * least + 1
    _check_packing(odd, packing.pack(odd, with_ids=True).collect())
    assert packing.pack(empty).count() == 0


def test_word_encoder_is_the_tokenizer():
    words = packing.encoder(packing.tokenizer_path())
    rng = random.Random(3)
    pool = ["Hello", "don't", "'s", "it's!", "étude", "É", "İstanbul", "ΣΑΣ", "12ab²", "ﬁ½Ⅷ", "日本語", "a̸", "é", "<|endoftext|>", "x\x1cy", "foo_bar!!", "\t", "\n", " ", "!'s", " ", "ßẞ", "ŉ"]
    for _ in range(300):
        text = "".join(rng.choice(pool) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 9)))
        assert list(np.frombuffer(words.text(text), "<u4")) == words.tokenizer.encode(text, add_special_tokens=False).ids, text


# 7
def _classes(texts, similarity=0.8):
    bags = [near_dedup.bag(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            same = near_dedup.overlap(bags[i], bags[j]) >= similarity if len(bags[i][0]) and len(bags[j][0]) else not len(bags[i][0]) and not len(bags[j][0]) and (texts[i] or "") == (texts[j] or "")
            if same:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(texts))]


def _family(rng, n):
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    base = [word() for _ in range(150)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = word()
        out.append(" ".join(copy))
    return out


def test_near_duplicates(spark, docs, odd, empty):
    rng = random.Random(5)
    made = spark.createDataFrame(list(enumerate(_family(rng, 60) + _family(rng, 40) + _family(rng, 1))), "doc_id long, text string")
    for df in (docs, made):
        rows = df.select("doc_id", "text").collect()
        roots = _classes([r["text"] for r in rows])
        least = {}
        for r, c in zip(rows, roots):
            least[c] = min(r["doc_id"], least.get(c, r["doc_id"]))
        sizes = collections.Counter(roots)
        want = sorted((r["doc_id"], least[c], sizes[c]) for r, c in zip(rows, roots))
        assert sorted((r["doc_id"], r["class_id"], r["class_size"]) for r in near_dedup.near_duplicates(df).collect()) == want
        assert sorted(r["doc_id"] for r in near_dedup.near_dedup(df).collect()) == sorted(least.values())
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and sorted((r["class_id"], r["class_size"]) for r in got if r["doc_id"] in (1, 5)) == [(1, 3)] * 3
    kept = near_dedup.near_dedup(odd)
    assert kept.columns == odd.columns and kept.count() == len({r["node"] for r in got}) == 9
    assert near_dedup.near_duplicates(empty).count() == 0 and near_dedup.near_dedup(empty).count() == 0


def test_signatures_are_unbiased():
    rng, errors = np.random.default_rng(0), []
    for _ in range(40):
        ids = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
        a = rng.integers(1, 9, len(ids))
        b = np.where(rng.random(len(ids)) < 0.8, a, rng.integers(1, 40, len(ids)))
        x, y = near_dedup.signatures([(ids, a), (ids, b)])
        errors.append((x == y).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


def test_blocks_find_what_all_pairs_find(monkeypatch, spark):
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    rng = random.Random(9)
    made = spark.createDataFrame(list(enumerate(_family(rng, 50))), "doc_id long, text string")
    roots = _classes([r["text"] for r in made.orderBy("doc_id").collect()])
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(made).collect()}
    assert len({(got[i], roots[i]) for i in got}) == len(set(got.values())) == len(set(roots))


def test_chance_bands_tie_nothing(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    base = [word() for _ in range(200)]
    texts = []
    for i in range(120):  # similarities about 0.4 to the base, and so often a band in common
        copy = list(base)
        for k in rng.sample(range(200), 22):
            copy[k] = word()
        texts.append(" ".join(copy))
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    seen = []
    monkeypatch.setattr(near_dedup, "bucket_components", lambda crowded, f=near_dedup.bucket_components: (seen.append(crowded.count()), f(crowded))[1])
    pairs = {}
    for small in (64, 0):
        monkeypatch.setattr(near_dedup, "SMALL", small)
        got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(made).collect()}
        pairs[small] = sorted(got.items())
    roots = _classes(texts)
    assert pairs[64] == pairs[0] and len({c for _, c in pairs[64]}) == len(set(roots)) and seen[0] < 0.5 * seen[1]


# 9
def test_quality(spark, sf, docs, odd, empty):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    more = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality.classify(more, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert quality.classify(odd, labels).count() == len(ODD) and quality.classify(empty, labels).count() == 0
    assert {r["score"] for r in quality.classify(odd, labels.limit(0)).collect()} == {0.5}


def test_quality_sample_is_bounded(spark, monkeypatch):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, quality int")
    docs = spark.createDataFrame([(i % 3 + 1, f"text {i}", 5) for i in range(500)], "doc_id long, text string, n_chars long")
    seen = []
    monkeypatch.setattr(quality.FactorisationMachine, "fit", lambda self, rows, y: seen.append(len(rows)))
    quality.train(docs, labels, sample=2)
    assert seen == [] or max(seen) <= 4
    bare = spark.createDataFrame([(i, f"w{i}") for i in range(1, 40)], "doc_id long, text string")
    monkeypatch.undo()
    assert quality.classify(bare, labels).count() == 39  # no n_chars


def test_quality_scores_are_the_plain_model(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    rows = sorted((r["doc_id"], r["text"], r["n_chars"]) for r in docs.collect() if known.get(r["doc_id"]) is not None)
    model = quality.FactorisationMachine.empty(quality.WORDS + quality.BINS * (len(quality.STATISTICS) + 1))
    model.fit([quality.featurize(t, [n]) for _, t, n in rows], np.array([known[i] for i, *_ in rows]))
    want = {r["doc_id"]: model.score(*quality.featurize(r["text"], [r["n_chars"]])) for r in docs.collect()}
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(want) and all(abs(r["score"] - want[r["doc_id"]]) < 1e-6 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_interactions_are_the_pairwise_sum():
    m, rng = quality.FactorisationMachine.empty(50), np.random.default_rng(1)
    m.w, m.v = rng.normal(size=50).astype(np.float32), rng.normal(size=(50, quality.RANK)).astype(np.float32)
    i, x = np.arange(0, 50, 3), rng.normal(size=17).astype(np.float32)
    pairs = sum(float(m.v[i[a]] @ m.v[i[b]]) * x[a] * x[b] for a in range(17) for b in range(a))
    assert abs(m.raw(i, x)[0] - (m.bias + float(m.w[i] @ x) + pairs)) < 1e-3


# 6
def test_long_identifiers_are_taken_whole(spark):
    text = f"user: {'u' * 200} pwd: hunter2hunter"
    got = secrets.spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).where("kind = 3").collect()
    assert [text[r["start"] : r["end"]] for r in got] == [f"user: {'u' * 200}"]


# 1
def test_pseudo_likelihood(docs, odd, empty):
    frequent = pseudo_likelihood.frequent_words(docs)
    flat = pseudo_likelihood.train(docs, frequent, rounds=1)
    w, vocabulary = pseudo_likelihood.unpacked(flat.astype(np.float64)), pseudo_likelihood.Vocabulary(frequent)
    got = {r["doc_id"]: r for r in pseudo_likelihood.score(docs, flat, frequent).collect()}
    for r in docs.limit(5).collect():
        ids, n = vocabulary.ids([r["text"]])
        total = 0.0
        for k in range(len(ids)):
            around = [ids[k + o] if 0 <= k + o < len(ids) else pseudo_likelihood.IDS for o in (-2, -1, 1, 2)]
            h = np.tanh(w["bias"] + sum(w["embed"][j][c] for j, c in enumerate(around)))
            a, b, c = ids[k] // 256, ids[k] // 16, ids[k] % 16
            for i, (z, digit) in enumerate(((h, a), (h + w["first"][a], b % 16), (h + w["second"][b], c))):
                logits = z @ w[f"w{i}"] + w[f"b{i}"]
                total += logits[digit] - np.log(np.exp(logits).sum())
        assert got[r["doc_id"]]["n_tokens"] == n[0] == len(r["text"].split()) and abs(got[r["doc_id"]]["pll"] - total) < 1e-3 * abs(total) + 1e-3
    trained, raw = sum(r["pll"] for r in got.values()), sum(r["pll"] for r in pseudo_likelihood.score(docs, pseudo_likelihood.initial(), frequent).collect())
    assert trained > raw
    scored = {r["doc_id"]: r for r in pseudo_likelihood.pseudo_likelihood(odd, rounds=1).collect()}
    assert scored[3]["pll"] == 0.0 and scored[3]["mean_pll"] is None and pseudo_likelihood.pseudo_likelihood(empty, rounds=1).count() == 0


def test_pseudo_likelihood_of_words(spark, docs):
    counts = pseudo_likelihood.word_counts(docs).cache()
    all_n = {np.int64(r["word"]).view(np.uint64).item(): r["n"] for r in counts.collect()}
    frequent, n = pseudo_likelihood.most_frequent(counts, own=100, least=8)  # every word above the threshold, though own is less
    assert set(frequent.tolist()) == {w for w, k in all_n.items() if k >= 8} and len(frequent) > 100
    flat, vocabulary = pseudo_likelihood.train(docs, frequent, rounds=1), pseudo_likelihood.Vocabulary(frequent)
    w, buckets = pseudo_likelihood.unpacked(flat, vocabulary.size), collections.Counter()
    for x, k in all_n.items():
        if x not in set(frequent.tolist()):
            buckets[(x >> 32) % pseudo_likelihood.SHARED] += k
    got = {r["doc_id"]: r for r in pseudo_likelihood.word_scores(docs, counts, rounds=1, own=100, least=8).collect()}
    assert len(got) == docs.count()
    for r in docs.limit(5).collect():
        ids, k, h = vocabulary.split([r["text"]])
        total = float(pseudo_likelihood.text_scores(w, ids, k)[0]) + sum(math.log(all_n[x] / buckets[(x >> 32) % pseudo_likelihood.SHARED]) for x in h.tolist() if all_n[x] < 8)
        assert abs(got[r["doc_id"]]["pll"] - total) < 1e-3 * abs(total) + 1e-3 and abs(got[r["doc_id"]]["mean_pll"] * k[0] - total) < 1e-3 * abs(total) + 1e-3
    junk, known = "zzqx wqpv xxkj qqzv", " ".join(["the of"] * 2)
    extra = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, junk), (-2, known)], "doc_id long, text string"))
    scored = {r["doc_id"]: r["mean_pll"] for r in pseudo_likelihood.pseudo_likelihood(extra, rounds=1).where("doc_id < 0").collect()}
    assert scored[-1] < scored[-2] - 2


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_every_position_is_a_target_once(rounds):
    texts = [["kopf", "zeile", *f"{i} a b c d e f g".split()] for i in range(400)]
    vocabulary = pseudo_likelihood.Vocabulary(np.empty(0, np.uint64))
    ids, n = vocabulary.ids([" ".join(t) for t in texts] + [""])
    trained = []
    for round_ in range(rounds):
        t = pseudo_likelihood.Trainer(pseudo_likelihood.initial())
        t.add(ids, n, round_, rounds)
        trained.append(np.concatenate([x for _, x in t.held]))
    assert sorted(np.concatenate(trained).tolist()) == sorted(ids.tolist())
    of = pseudo_likelihood.dealt(ids, n, rounds)
    assert all(abs((of[k::10] == r).mean() - 1 / rounds) < 0.12 for k in range(10) for r in range(rounds))  # a header is in all rounds


def test_vocabulary_beyond_three_digits():
    rng, ids = np.random.default_rng(0), pseudo_likelihood.id_count(5000)
    w = pseudo_likelihood.unpacked(pseudo_likelihood.initial(ids=ids), ids)
    assert ids > 4096 and "w3" in w and w["third"].shape[0] * 16 >= ids
    context, target = rng.integers(0, ids + 1, (40, 4)), rng.integers(4096, ids, 40)
    logp = pseudo_likelihood.forward(w, context, target)[0]
    g = pseudo_likelihood.gradient(w, context, target)
    assert {k: v.shape for k, v in g.items()} == {k: v.shape for k, v in w.items()}
    for k in w:
        w[k] -= 0.01 * g[k]
    assert pseudo_likelihood.forward(w, context, target)[0].sum() > logp.sum()


def test_gradient():
    rng = np.random.default_rng(0)
    w = pseudo_likelihood.unpacked(pseudo_likelihood.initial().astype(np.float64))
    context, target = rng.integers(0, pseudo_likelihood.IDS + 1, (40, 4)), rng.integers(0, pseudo_likelihood.IDS, 40)
    g = pseudo_likelihood.gradient(w, context, target)
    for k, v in w.items():
        flat, i, e = v.reshape(-1), int(np.argmax(np.abs(g[k]))), 1e-4
        loss = lambda d: (flat.__setitem__(i, flat[i] + d), -float(pseudo_likelihood.forward(w, context, target)[0].astype(np.float64).sum()))[1]
        up, down = loss(e), loss(-2 * e)
        flat[i] += e
        assert abs((up - down) / (2 * e) - g[k].reshape(-1)[i]) < 0.05 * abs(g[k].reshape(-1)[i]) + 0.05


def test_word_hashes_in_segments(monkeypatch):
    texts = ["The cat the\nCAT", None, "", "  cat ", "ab cd " * 400_000, "y z"]
    h, n = pseudo_likelihood.word_hashes(texts)
    assert n.tolist() == [len((t or "").split()) for t in texts] and h[0] == h[2] and h[1] == h[3] == h[4] and len(set(h[5:-2].tolist())) == 2


# 2
def test_chat(spark, sf):
    turns = [(1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (1, 1, "assistant", "<\\|im_end|> <| \\"), (1, 1, "assistant", "<\\|im_end|> <| \\"), (None, None, None, None), (2, 0, "assistant", ""), (3, 0, "a\nb\\", LONG), (3, 1, "assistant", "<|endoftext|> é😀")]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, ids string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_turns(df)).collect()}
    for c in {t[0] for t in turns}:
        mine = [((r or ""), (x or "")) for i, _, r, x in turns if i == c]
        learnt = "".join(x for r, x in mine if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for r, x in mine)
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(mine), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    rows = chat.with_offsets(chat.format_turns(df)).where("conv_id = 1").orderBy("token_start").collect()
    assert rows[0]["token_start"] == 0 and rows[1]["token_start"] == rows[0]["n_tokens"]
    assert all(r["formatted"].count("<|im_start|>") == 1 == r["formatted"].count("<|im_end|>") for r in rows)
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0


def test_turns_that_tie_go_by_their_text(spark):
    texts = ["a b", "a", "<a", "<|", "<\\|x", "", "a\n", "ä", "<|im_end|>", "a!"]
    df = spark.createDataFrame([(1, 0, "assistant", t) for t in texts], "conv_id long, turn long, role string, text string").repartition(3)
    formatted = chat.format_turns(df)
    got = chat.digests(formatted).first()
    assert got["loss_sha256"] == hashlib.sha256("".join(sorted(texts)).encode()).hexdigest()
    order = [r["formatted"] for r in chat.with_offsets(formatted).orderBy("token_start", "n_tokens").collect()]
    assert order == [f"<|im_start|>assistant\n{chat.escape(t)}<|im_end|>\n" for t in sorted(texts)]


# 8
def test_warc(spark, tmp_path):
    big = "<p>ä</p>" * 9000
    pages = spark.createDataFrame(
        [(1, "http://a/\r\nX: y", "same", "e"), (5, None, "same", "e"), (3, "u", "same", "e"), (2, "u", big, "e"), (9, "u", big, "e"), (4, "u", None, "e"), (6, "u", "", "e"), (7, "u", "WARC/1.1\r\n\r\n0\r\n\r\n", "e"), (8, "u", big + "x", "e"), (8, "u", big + "x", "e")],
        "page_id long, url string, html string, digest string",
    )
    got = sorted(tuple(r) for r in warc.round_trip(spark, pages).select("page_id", "payload_bytes", "record_type", "intact").collect())
    n = len(big.encode())
    assert got == [(1, 4, "revisit", True), (2, n, "revisit", True), (3, 4, "revisit", True), (4, 0, "revisit", True), (5, 4, "response", True), (6, 0, "response", True), (7, 17, "response", True), (8, n + 1, "response", True), (8, n + 1, "response", True), (9, n, "response", True)]
    refers = {r["page_id"]: r["refers_to"] for r in warc.round_trip(spark, pages).collect()}
    assert (refers[1], refers[3], refers[2], refers[4], refers[9]) == (5, 5, 9, 6, None)
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_damaged_archives(spark, tmp_path):
    records = list(warc.page_records(1, None, b"x" * 50_000, "A" * 32, None, False))
    assert len(records) == 4 and warc.dechunked(warc.chunked(b"abc" * 5000)) == b"abc" * 5000 and warc.dechunked(b"zz") is None
    (tmp_path / "a.gz").write_bytes(__import__("gzip").compress(b"\r\n\r\n".join([records[0], records[1], records[3], b""])))
    row = warc.read_archives(spark, f"file://{tmp_path}").first()
    assert row["page_id"] == 1 and row["intact"] is False and row["payload_bytes"] is None


def test_archives_in_parts(monkeypatch):
    import gzip
    import time

    monkeypatch.setattr(warc, "INFLATED", 50)
    records = [*warc.page_records(1, "u", b"x" * 40_000, "A" * 32, None, False), *warc.page_records(2, "u", b"WARC/1.1\r\n\r\n" * 3, "B" * 32, None, False)]
    plain = b"\r\n\r\n".join([*records, b""])
    one_each = b"".join(gzip.compress(r + b"\r\n\r\n") for r in records)
    want = list(warc.parse(plain))
    assert len(want) == len(records) and list(warc.parse(gzip.compress(plain))) == want == list(warc.parse(one_each))
    assert list(warc.parse(b"")) == [] and len(list(warc.parse(gzip.compress(plain)[:-200]))) <= len(want)
    monkeypatch.undo()
    took = []
    for mb in (2, 16):
        began = time.perf_counter()
        body = b"z" * (mb << 20)
        blocks = [b for _, b in warc.parse(gzip.compress(b"\r\n\r\n".join([*warc.page_records(1, "u", body, "A" * 32, None, False), b""]), 1))]
        assert warc._payload(b"".join(blocks)) == body
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * took[0] + 1  # in proportion, not with the square


def test_registered():
    assert [n for n in range(1, 11) if any(q.startswith(f"op{n}_") for q in Q.QUERIES)] == list(range(1, 11))
    assert set(Q.ORACLE_SQL) <= set(Q.QUERIES)
