"""The scan of a task: batches of lines in, hits out. Plain Python behind Arrow, because a line is tried against dozens of rules and a
compiled expression in a loop is several times cheaper than as many nested higher-order functions.

What a token means to the rules depends on the token alone, so tokens are looked up: a worker keeps what it knows of short tokens (KNOWN
at most), and only those that it meets for the first time are tried. Rules say what they need (functions.patterns): strings are searched
in all new tokens (or lines) of a batch at once, digits counted at once, and the expression itself runs where both are there.

Guard: patterns that may backtrack without bound, and all patterns on very long texts, run with a time limit. A rule that exceeds it on
several texts is given up for the rest of the task; each such text is reported as a hit of stage TIMED_OUT.
"""

from __future__ import annotations

import gc
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .. import rules
from ..functions.patterns import fold, needs
from ..functions.text import FOLD_FROM, FOLD_TO, WRAPPERS
from .tokenize import json_tokens, line_tokens, pair_of

#: Tokens that a worker remembers, at most, and the longest of them.
KNOWN, SHORT = 300_000, 100
#: From so many texts on, a rule's own automaton sifts them before the expression.
MANY = 16
#: Lines that are looked at together.
TOGETHER = 2000
#: Texts of more characters are matched under the time limit whatever the rule.
LONG = 20_000
LINE, PHRASE, TOKEN, TIMED_OUT = 0, 1, 2, 9
#: What a hit consists of, beside the columns of its line.
HIT = "stage int, pos int, family int, ord int, value string, orig string, token string, start int, end int, confidence string"


@dataclass(frozen=True)
class Spec:
    """What a scan looks for; plain data that travels to the workers."""

    lines: tuple[tuple[int, str], ...] = ()  # (place in the catalog, expression) of line rules
    tokens: tuple[tuple[int, str], ...] = ()
    fields: tuple[tuple[int, str, int], ...] = ()  # (place, expression, offset)
    words: tuple[tuple[str, tuple[int, ...]], ...] = ()  # (normal form, places)
    phrases: tuple[tuple[int, str], ...] = ()
    stop_values: frozenset[str] = frozenset()
    parse_json: str = "auto"
    timeout_ms: int = 100
    strikes: int = 5
    others: tuple[int, int] | None = None  # characters before and behind a hit in which the values of other hits are listed


_MARKS: dict[int, str | None] = {}
_BEYOND = re.compile("[^\0-\x7f]+")


def _folded(m: re.Match) -> str:
    """What `normal` does to characters beyond ASCII."""
    if not _MARKS:
        _MARKS.update({c: None for c in range(0x300, 0x1F000) if unicodedata.category(chr(c)) == "Mn"} | {c: None for c in range(0xE0100, 0xE01F0)})
        _MARKS.update(str.maketrans(FOLD_FROM, FOLD_TO) | {0xDF: "ss"})
    return m[0].translate(_MARKS)


def normal(text: str) -> str:
    """Lower case, sharp s as ss, no accents."""
    low = text.lower()
    return low if low.isascii() else _BEYOND.sub(_folded, low)


@dataclass
class Rule:
    """An expression with what it needs."""

    ord: int
    regex: str
    offset: int = 0
    strikes: int = 0
    off: bool = False
    rx: re.Pattern = field(init=False)
    guarded: object = field(init=False, default=None)

    def __post_init__(self) -> None:
        self.rx, self.needs = re.compile(self.regex), needs(self.regex)
        self.strings = tuple(s for s in self.needs.strings if len(s) > 1) if all(len(s) > 1 for s in self.needs.strings) else ()
        self.chars = "" if self.strings else self.needs.strings


class _Sieve:
    """Which of many texts have the strings, digits and length that rules need."""

    def __init__(self, found: list[Rule]):
        self.all = found
        self.by_string: dict[tuple[bool, str], list[Rule]] = {}
        for r in found:
            for s in r.strings:
                self.by_string.setdefault((r.needs.folded, s), []).append(r)
        self.by_digits = [r for r in found if not r.strings and r.needs.digits]
        self.rest = [r for r in found if not r.strings and not r.needs.digits]

    def places(self, texts: list[str]) -> Iterator[tuple[Rule, list[int]]]:
        """(rule, places of texts that have what it needs); a rule comes once, places rise."""
        if not texts or not self.all:
            return
        blob = "\n".join(texts)
        if blob.count("\n") >= len(texts):
            blob = "\n".join(t.replace("\n", "\0") for t in texts)
        yield from self._by_strings(blob)
        if not self.by_digits and not self.rest:
            return
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        digits = self._digit_counts(blob) if self.by_digits else sizes
        for r in (*self.by_digits, *self.rest):
            fit = sizes >= r.needs.width
            if r.needs.digits:
                fit &= digits >= r.needs.digits
            places = np.flatnonzero(fit).tolist()
            yield r, places if len(places) > MANY else self._with_chars(r, texts, places)

    @staticmethod
    def _with_chars(r: Rule, texts: list[str], some: list[int]) -> list[int]:
        if not r.chars or r.needs.folded:
            return some
        return [i for i in some if any(c in texts[i] for c in r.chars)]

    def _by_strings(self, blob: str) -> Iterator[tuple[Rule, list[int]]]:
        found: dict[int, set[int]] = {}
        starts: dict[bool, np.ndarray] = {}
        hay = {False: blob, True: fold(blob)}
        for (folded, s), wanted in self.by_string.items():
            h, at, places = hay[folded], 0, []
            while (at := h.find(s, at)) >= 0:
                places.append(at)
                at += len(s)
            if not places:
                continue
            if folded not in starts:
                starts[folded] = np.cumsum([0, *[len(x) + 1 for x in h.split("\n")]])
            rows = np.unique(np.searchsorted(starts[folded], places, "right") - 1).tolist()
            for r in wanted:
                found.setdefault(id(r), set()).update(rows)
        for r in self.all:
            if id(r) in found:
                yield r, sorted(found[id(r)])

    @staticmethod
    def _digit_counts(blob: str) -> np.ndarray:
        """Digits of each text; texts beyond ASCII count as full of them."""
        data = np.frombuffer(blob.encode("utf-8", "surrogatepass"), np.uint8)
        ends = np.append(np.flatnonzero(data == 10), len(data))
        weight = ((data >= 48) & (data <= 57)).astype(np.int64)
        if not blob.isascii():
            weight += (data >= 128) * 1_000_000
        upto = np.concatenate([[0], np.cumsum(weight)])
        return np.diff(upto[ends], prepend=0)


def _matching(column: pa.Array, plain: str) -> list[int]:
    return np.flatnonzero(pc.match_substring_regex(column, plain).to_numpy(zero_copy_only=False)).tolist()


class Rules:
    """Expressions that are tried on many texts."""

    def __init__(self, found: list[Rule], timeout_ms: int, strikes: int):
        self.all, self.timeout, self.most = found, timeout_ms / 1000, strikes
        plain = [r for r in found if r.needs.plain is not None]
        #: One automaton for all rules that have a plain form; the others are tried on texts that it turns down too.
        self.any = "|".join(f"(?:{r.needs.plain})" for r in plain) if plain else None
        self.sieved, self.others = _Sieve(plain), _Sieve([r for r in found if r.needs.plain is None])
        self.timed_out: list[tuple[Rule, str]] = []

    def worth_trying(self, texts: list[str]) -> Iterator[tuple[Rule, str, int]]:
        """(rule, text, its place) of texts that have what a rule needs; a rule's texts come together."""
        if self.any and texts:
            column = pa.array(texts, pa.string())
            some = _matching(column, self.any)
            kept, column = [texts[i] for i in some], column.take(pa.array(some, pa.int32()))
            for r, places in self.sieved.places(kept):
                if len(places) > MANY:
                    places = [places[i] for i in _matching(column.take(pa.array(places, pa.int32())), r.needs.plain)]
                for i in places:
                    yield r, kept[i], some[i]
        for r, places in self.others.places(texts):
            for i in places:
                yield r, texts[i], i

    def matches(self, rule: Rule, text: str, once: bool = False) -> list[re.Match]:
        """All matches in a text (once: the first at least); none of a rule that was given up."""
        if len(text) < 24 or not rule.needs.risky and len(text) < LONG:
            m = rule.rx.search(text)
            return [m] if m and once else list(rule.rx.finditer(text)) if m else []
        if rule.off:
            return []
        import regex

        rule.guarded = rule.guarded or regex.compile(rule.regex)
        try:
            return list(rule.guarded.finditer(text, timeout=self.timeout))
        except TimeoutError:
            rule.strikes += 1
            rule.off = rule.strikes >= self.most
            self.timed_out.append((rule, text))
            return []


class Engine:
    def __init__(self, spec: Spec):
        self.spec = spec
        make = lambda found: Rules([Rule(*r) for r in found], spec.timeout_ms, spec.strikes)
        self.lines, self.tokens, self.fields = map(make, (spec.lines, spec.tokens, spec.fields))
        self.words, self.phrases = dict(spec.words), spec.phrases
        self.longest_stop = max(map(len, spec.stop_values), default=0)
        self.seen: set[str] = set()  # tokens that were tried
        self.known: dict[str, tuple] = {}  # what the rules say of those that mean something

    def begin(self) -> None:
        """A task begins: what the last one gave up is tried again."""
        for group in (self.lines, self.tokens, self.fields):
            for r in group.all:
                r.strikes, r.off = 0, False

    def _stopped(self, text: str) -> bool:
        return not (len(text) > self.longest_stop and text.isascii()) and normal(text) in self.spec.stop_values

    def _tell(self, new: list[str]) -> dict[str, tuple]:
        """What the rules say of tokens: (hits of token rules, keys of field rules, lexicons); tokens that mean nothing are left out."""
        hits: dict[str, list] = {}
        keys: dict[str, list] = {}
        words: dict[str, tuple] = {}
        for r, t, _ in self.tokens.worth_trying([t for t in new if len(t) >= rules.MIN_REGEXP]):
            m = next(iter(self.tokens.matches(r, t, True)), None)
            if m and m[0] and not self._stopped(m[0]) and not self._stopped(t):
                hits.setdefault(t, []).append((r.ord, m[0]))
        for r, t, _ in self.fields.worth_trying([t for t in new if len(t) >= rules.MIN_FIELD]):
            if self.fields.matches(r, t, True):
                pair = pair_of(t) if r.offset == 1 else None
                keys.setdefault(t, []).append((r.ord, r.offset, pair[1] if pair and r.rx.search(pair[0]) else None))
        if self.words:
            low = normal("\n".join(new)).split("\n")
            low = low if len(low) == len(new) else [normal(t) for t in new]  # a token from JSON may hold line ends
            if not self.words.keys().isdisjoint(low):
                words = {t: w for t, n in zip(new, low) if (w := self.words.get(n))}
        return {t: (hits.get(t, ()), keys.get(t, ()), words.get(t, ())) for t in {*hits, *keys, *words}}

    def _tokens_of(self, line: str) -> list[str]:
        mode = self.spec.parse_json
        if mode != "false" and (mode == "true" or line[0] in "[{" or "{" in line and '"' in line):
            return json_tokens(line)
        return line_tokens(line)

    def scan(self, lines: list[str | None]) -> list[tuple]:
        """(row, stage, pos, family, ord, value, orig, token, start, end, confidence) of every hit in lines, and the values near it if they
        are asked for; rows rise with the lines of a part, not within."""
        out: list[tuple] = []
        for at in range(0, len(lines), TOGETHER):
            self._scan([(i, s) for i, s in enumerate(lines[at : at + TOGETHER], at) if s], out)
        return [(*h, o) for h, o in zip(out, self._others(out))] if self.spec.others else out

    def _others(self, hits: list[tuple]) -> list[list[str]]:
        """The originals of the hits that lie near each hit in its line, long ones first; all of the line's where its place is unknown."""
        before, behind = self.spec.others
        of_row: dict[int, list[tuple[int, int, str]]] = {}
        for h in hits:
            if h[8] >= 0:
                of_row.setdefault(h[0], []).append((h[8], h[9], h[6]))
        widest = {row: max(e - s for s, e, _ in sorted_) for row, sorted_ in of_row.items() if not sorted_.sort()}
        out = []
        for h in hits:
            places = of_row.get(h[0], [])
            if h[8] >= 0:
                low = bisect_left(places, (h[8] - before - widest[h[0]],))
                places = places[low : bisect_left(places, (h[9] + behind,))]
            out.append(sorted({v for _, _, v in places if v}, key=lambda v: (-len(v), v)))
        return out

    def _scan(self, rows: list[tuple[int, str]], out: list[tuple]) -> None:
        if not rows:
            return
        for r, text, i in self.lines.worth_trying([s for _, s in rows]):
            for n, m in enumerate(self.lines.matches(r, text)):
                value = m[0].strip()
                if len(value) >= rules.MIN_REGEXP and not self._stopped(value):
                    start = m.start() + len(m[0]) - len(m[0].lstrip())
                    out.append((rows[i][0], LINE, n, 0, r.ord, value, value, None, start, start + len(value), "high"))
        if self.phrases:
            self._phrases(rows, out)
        if self.tokens.all or self.fields.all or self.words:
            self._tokens(rows, out)
        for family, group in ((0, self.lines), (0, self.tokens), (1, self.fields)):
            for r, text in group.timed_out:
                row = next((i for i, s in rows if text in s), rows[0][0])
                out.append((row, TIMED_OUT, 0, family, r.ord, "", "", None, -1, -1, "low"))
            group.timed_out.clear()

    def _phrases(self, rows: list[tuple[int, str]], out: list[tuple]) -> None:
        low = normal("\n".join(s.replace("\n", "\0") for _, s in rows))
        wanted = [(o, p) for o, p in self.phrases if p in low]
        if not wanted:
            return
        for (row, line), n in zip(rows, low.split("\n")):
            for o, p in wanted:
                at = n.find(p)
                while at >= 0 and (at > 0 and n[at - 1].isalnum() or n[at + len(p) : at + len(p) + 1].isalnum()):
                    at = n.find(p, at + 1)
                if at >= 0:
                    start, end = (at, at + len(p)) if len(n) == len(line) else _origin(line, at, at + len(p))
                    out.append((row, PHRASE, 0, 2, o, p, line[start:end], None, start, end, _confidence(line)))

    def _tokens(self, rows: list[tuple[int, str]], out: list[tuple]) -> None:
        lists = [self._tokens_of(s) for _, s in rows]
        every = set().union(*lists)
        new = every - self.seen
        hot = {t: self.known[t] for t in self.known.keys() & every}
        if new:
            told = self._tell(list(new))
            hot.update(told)
            if len(self.seen) > KNOWN:
                self.seen.clear()
                self.known.clear()
            self.seen |= new if max(map(len, new)) <= SHORT else {t for t in new if len(t) <= SHORT}
            self.known.update((t, c) for t, c in told.items() if len(t) <= SHORT)
        if not hot:
            return
        separators = rules.FIELD_SEPARATORS
        for (row, line), tokens in zip(rows, lists):
            if hot.keys().isdisjoint(tokens):
                continue
            confidence = None
            for i, t in enumerate(tokens):
                c = hot.get(t)
                if not c:
                    continue
                hits, keys, words = c
                for o, value in hits:
                    at = line.find(value)
                    out.append((row, TOKEN, i, 0, o, value, value, None, at, at + len(value) if at >= 0 else -1, "high"))
                for o, offset, value in keys:
                    if value is None:
                        for w in tokens[i + offset : i + offset + rules.LOOKAHEAD]:
                            if w not in separators and (value := w.strip(WRAPPERS)):
                                break
                    if value:
                        at = line.find(value)
                        out.append((row, TOKEN, i, 1, o, value, value, t, at, at + len(value) if at >= 0 else -1, "high"))
                if words:
                    confidence = confidence or _confidence(line)
                    at = line.find(t)
                    for o in words:
                        out.append((row, TOKEN, i, 2, o, t, t, None, at, at + len(t) if at >= 0 else -1, confidence))


def _confidence(line: str) -> str:
    low = line.lower()
    return "medium" if any(m in low for m in rules.CONTEXT_MARKERS) else "low"


def _origin(line: str, start: int, end: int) -> tuple[int, int]:
    """The span of a line that gave a span of its normal form."""
    upto = np.cumsum([len(normal(c)) for c in line])
    return int(np.searchsorted(upto, start, "right")), int(np.searchsorted(upto, end - 1, "right")) + 1


_ENGINES: dict[Spec, Engine] = {}


def engine_for(spec: Spec) -> Engine:
    if spec not in _ENGINES:
        if len(_ENGINES) > 7:
            _ENGINES.clear()
        _ENGINES[spec] = Engine(spec)
    _ENGINES[spec].begin()
    return _ENGINES[spec]


_KINDS = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
def hit_columns(spec: Spec) -> str:
    return HIT + ", others array<string>" * bool(spec.others)


#: Hits that one batch of results holds, about.
BATCH = 20_000


def scanner(spec: Spec, column: int):
    """A function of Arrow batches: each row's columns once for each hit in its line, and the hit."""
    names, kinds = [x.split()[0] for x in hit_columns(spec).split(", ")], [*_KINDS, *[pa.list_(pa.string())] * bool(spec.others)]

    def results(b: pa.RecordBatch, hits: list[tuple]) -> pa.RecordBatch:
        row, *columns = zip(*hits)
        taken = b.take(pa.array(row, pa.int32()))
        return pa.RecordBatch.from_arrays([*taken.columns, *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[*b.schema.names, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = engine_for(spec)
        for b in batches:
            gc.disable()  # hits hold no cycles, and there are many of them
            try:
                hits = engine.scan(b.column(column).to_pylist())
            finally:
                gc.enable()
            for at in range(0, len(hits), BATCH):
                yield results(b, hits[at : at + BATCH])

    return run
