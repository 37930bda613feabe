"""The engine against a plain version: every rule on every line and token, without a sieve, a cache or batches."""

import random
import re
import time

import pyarrow.parquet as pq
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from siftlake import rules
from siftlake.catalog import Catalog, Rule, from_tuples, infer_scope, parse, provenance, shipped, unfit
from siftlake.functions import patterns as P
from siftlake.functions.text import WRAPPERS, norm_text
from siftlake.operators import engine as E
from siftlake.operators.detect import spec_of
from siftlake.operators.tokenize import json_tokens, line_tokens, pair_of
from siftlake.plans.queries import GOLD

from .test_detect import POSITIVE

SHIPPED = shipped()


def plain(line, catalog=SHIPPED):
    """(stage, pos, family, ord, value, start) of all hits."""
    out = []
    stop = catalog.stopwords.get("regexp", ())
    never = set(catalog.stopwords.get("search", ())) | set(rules.TECHNICAL_TERMS)
    if not line:
        return out
    for o, r in catalog.of("regexp", "line"):
        for n, m in enumerate(re.finditer(r.regex, line)):
            value = m[0].strip()
            if len(value) >= 5 and norm_text(value) not in stop:
                out.append((0, n, 0, o, value, m.start() + len(m[0]) - len(m[0].lstrip())))
    low = [(norm_text(c), i) for i, c in enumerate(line)]
    text, at = "".join(n for n, _ in low), [i for n, i in low for _ in n]
    for o, _, _, p in catalog.phrases():
        if p in catalog.stopwords.get("search", ()):
            continue
        for m in re.finditer(f"(?={re.escape(p)})", text):
            before, behind = text[: m.start()][-1:], text[m.start() + len(p) :][:1]
            if not before.isalnum() and not behind.isalnum():
                out.append((1, 0, 2, o, p, at[m.start()]))
                break
    looks = line[0] in "[{" or "{" in line and '"' in line
    tokens = json_tokens(line) if looks else line_tokens(line)
    for i, t in enumerate(tokens):
        for o, r in catalog.of("regexp", "token"):
            if len(t) >= 5 and (m := re.search(r.regex, t)) and m[0] and not {norm_text(m[0]), norm_text(t)} & set(stop):
                out.append((2, i, 0, o, m[0], line.find(m[0])))
        for o, r in catalog.of("field"):
            if len(t) >= 3 and re.search(r.regex, t):
                pair = pair_of(t) if r.offset == 1 else None
                if pair and re.search(r.regex, pair[0]):
                    value = pair[1]
                else:
                    ahead = [w.strip(WRAPPERS) for w in tokens[i + r.offset : i + r.offset + 4] if w not in rules.FIELD_SEPARATORS]
                    value = next((w for w in ahead if w), "")
                if value:
                    out.append((2, i, 1, o, value, line.find(value)))
        for o, r in catalog.of("string"):
            n = norm_text(t)
            if " " not in n and n in r.values and n not in never:
                out.append((2, i, 2, o, t, line.find(t)))
    return sorted(out)


def scanned(lines, catalog=SHIPPED):
    got = [[] for _ in lines]
    for row, stage, pos, family, o, value, _, _, start, *_ in E.Engine(spec_of(catalog)).scan(lines):
        got[row].append((stage, pos, family, o, value, start))
    return [sorted(x) for x in got]


def test_shipped_rules_on_odd_lines():
    words = [*POSITIVE.values(), *(t for t, _ in GOLD), "plz ٥٠٦٦٧ ok", "ſtrasse", "HAUPTſTRASSE", "BİND_PW=geheim", "Kennwort: x", "toKen", "pwd: geheim1", "Authorization: Basic abcdef", "identified by tiger1", "Múltiple Sklerose",
             '{"password":"a b","n":[1,"a@b.de"]}', "https://u:p%40w@h.de/x?mail=a%40b.de&x=1", "user=bob", "a\tb", "==", "->", "Straße: Müller", "keystore", "AKIA", "x" * 300, "\x00", "😀", "Diabetes", "DIABETES,", "x?a=1&b=50667", "[1, 2]", "key:\"v\""]
    rng = random.Random(1)
    lines = [rng.choice([" ", " ", ",", "=", ""]).join(rng.choices(words, k=rng.randint(0, 7))).strip() for _ in range(3000)] + [None, ""]
    got = scanned(lines)
    for line, g in zip(lines, got):
        assert g == plain(line), line
    assert [x for x in scanned(["plz ٥٠٦٦٧ ok"])[0] if x[4] == "٥٠٦٦٧"]


def test_shipped_rules_on_documents(sf):
    texts = pq.read_table(f"{sf}/documents.parquet", columns=["text"])["text"].to_pylist()
    lines = [x.strip() for t in texts if t for x in t.split("\n")][:1500]
    assert scanned(lines) == [plain(x) for x in lines]
    catalog = from_tuples([], [], [("w", 3, ["that", "une", "der die"])], 2)
    assert scanned(lines, catalog) == [plain(x, catalog) for x in lines]


@pytest.mark.parametrize("kind,scope", [("regexp", "line"), ("regexp", "token"), ("field", "")])
def test_rules_find_what_they_match(kind, scope):
    """Generated matches of each rule, with all of Unicode that it takes, are found despite the sieve."""
    for o, r in SHIPPED.of(kind, scope):
        seen = []

        @settings(max_examples=40, deadline=None, derandomize=True, database=None, suppress_health_check=list(HealthCheck))
        @given(st.from_regex(r.regex))
        def collect(text):
            seen.append(text.replace("\n", " ").strip())

        collect()
        assert scanned(seen) == [plain(x) for x in seen], r.name


@settings(max_examples=400, deadline=None)
@given(st.sampled_from([r.regex for r in SHIPPED.rules if r.regex] + ["(?i)stra(ss|ß)e", "(?:ab|cd)+x?[0-9]{3}", "a{2,}b|c", "[^x]y(?=z)", "(?i:k)ELVIN", ".{3}q"]), st.data())
def test_needs_are_needed(regex, data):
    text = data.draw(st.from_regex(regex))
    m, n = re.search(regex, text), P.needs(regex)
    assert m and len(m[0]) >= n.width and sum(c.isdecimal() for c in m[0]) >= n.digits
    assert not n.strings or any(s in (P.fold(m[0]) if n.folded else m[0]) for s in n.strings)
    if n.plain is not None:
        import pyarrow as pa
        import pyarrow.compute as pc

        assert pc.match_substring_regex(pa.array([text]), n.plain)[0].as_py()


def test_results_do_not_depend_on_batches(monkeypatch):
    lines = [f"user=a{i} mail m{i % 7}@x.de plz 5066{i % 10}" for i in range(300)]
    whole = scanned(lines)
    monkeypatch.setattr(E, "TOGETHER", 7)
    monkeypatch.setattr(E, "KNOWN", 5)
    assert scanned(lines) == whole


def test_hostile_patterns_end():
    catalog = from_tuples([("bad", 1, "", "(a|aa)+$", "line"), ("worse", 1, "", "(a|a)*c$", "token"), ("good", 1, "", "b{5}", "line")])
    spec = spec_of(catalog)
    assert P.needs("(a+)+$").risky and P.needs("(a|aa)+$").risky and not any(P.needs(r.regex).risky for r in SHIPPED.rules if r.regex)
    engine, lines = E.Engine(E.Spec(spec.lines, spec.tokens, timeout_ms=50, strikes=3)), ["a" * (45 + i) + "!" + "b" * 5 for i in range(12)]
    began = time.perf_counter()
    got = engine.scan(lines)
    assert time.perf_counter() - began < 10
    assert sum(g[1] == E.TIMED_OUT and g[4] == 0 for g in got) == 3 and sum(g[4] == 2 for g in got) == 12
    engine.begin()
    assert not any(r.off for r in engine.lines.all)


def test_vetting():
    assert unfit("a(") and unfit("(a+)+b") and unfit(r"\d{5}") is None
    c = parse("a::9::d::(x\nb::7::d::y+\nc::1::d::z::nowhere\n", "", "", stopwords={})
    assert [(r.name, r.krit, r.scope) for r in c.rules] == [("b", 5, "line"), ("c", 1, "line")] and len(c.warnings) == 2
    assert c.sources == (("regexp", provenance("a::9::d::(x\nb::7::d::y+\nc::1::d::z::nowhere\n")),) and len(provenance("x")) == 12
    assert infer_scope(r"a\sb") == "line" and infer_scope("ab") == "token"
    assert [r.scope for r in from_tuples([("t", 1, "", "ab"), ("l", 1, "", "a b")]).rules] == ["token", "line"]
    assert Catalog((Rule("x", "string", 1, values=frozenset(["ab cd", "ef"])),)).phrases() == [(0, "x", 1, "ab cd")]
