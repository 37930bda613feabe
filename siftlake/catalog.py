"""Rule catalogs: built from the shipped data or from rule files, checked once on the driver.

A catalog is small and lives on the driver; its patterns become literals of the plan, its lexicons literals or a table,
by their size.
"""

from __future__ import annotations

import csv
import hashlib
import io
import os
import stat
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import rules
from .functions.patterns import fault
from .functions.text import norm_text

DELIMITER = "::"


class DuplicateRule(ValueError):
    """A rule name that is declared twice, in whatever families."""


@dataclass(frozen=True)
class Rule:
    name: str
    kind: str  # regexp, field or string
    krit: int
    description: str = ""
    regex: str = ""
    scope: str = ""  # of regexp rules: token or line
    offset: int = 1  # of field rules: where the value is looked for
    values: frozenset[str] = frozenset()  # of string rules: normal forms


@dataclass(frozen=True)
class Catalog:
    rules: tuple[Rule, ...]
    stopwords: dict[str, frozenset[str]] = field(default_factory=dict)
    warnings: tuple[str, ...] = ()
    #: (name, short digest) of the rule files that it comes from.
    sources: tuple[tuple[str, str], ...] = ()

    def __post_init__(self) -> None:
        seen: dict[str, str] = {}
        for r in self.rules:
            if r.name in seen:
                raise DuplicateRule(f"rule {r.name} is declared as {seen[r.name]} and as {r.kind}")
            seen[r.name] = r.kind

    def of(self, kind: str, scope: str = "") -> list[tuple[int, Rule]]:
        """(place in the catalog, rule)."""
        return [(i, r) for i, r in enumerate(self.rules) if r.kind == kind and (not scope or r.scope == scope)]

    def only(self, *kinds: str) -> Catalog:
        return Catalog(tuple(r for r in self.rules if r.kind in kinds), self.stopwords, self.warnings, self.sources)

    def words(self) -> list[tuple[int, str, int, str]]:
        """(place, name, severity, value) of lexicon entries without a space."""
        return [(i, r.name, r.krit, v) for i, r in self.of("string") for v in sorted(r.values) if " " not in v]

    def phrases(self) -> list[tuple[int, str, int, str]]:
        return [(i, r.name, r.krit, v) for i, r in self.of("string") for v in sorted(r.values) if " " in v]

    def frame(self, spark: SparkSession) -> DataFrame:
        """The rules as a table."""
        rows = [(r.name, r.kind, r.krit, r.description, r.regex or None, r.scope or None, r.offset if r.kind == "field" else None, i) for i, r in enumerate(self.rules)]
        return spark.createDataFrame(rows, "name string, kind string, krit int, description string, regex string, scope string, value_offset int, ord int")


def clamp(krit: int) -> int:
    return max(1, min(5, krit))


def infer_scope(regex: str) -> str:
    """Of a rule that is given without a scope: a pattern with white space cannot match within a token."""
    return "line" if any(w in regex for w in ("\\s", " ", "\\t", "\t")) else "token"


def from_tuples(regexps: Iterable[tuple], fields: Iterable[tuple] = (), lexicons: Iterable[tuple[str, int, Iterable[str]]] = (), minlen: int = 4) -> Catalog:
    """A catalog from (name, severity, description, pattern[, scope]), the same with an offset for fields, and (name, severity, words)."""
    found = [Rule(r[0], "regexp", clamp(r[1]), r[2], r[3], r[4] if len(r) > 4 else infer_scope(r[3])) for r in regexps]
    found += [Rule(r[0], "field", clamp(r[1]), r[2], r[3], offset=r[4] if len(r) > 4 else 1) for r in fields]
    return Catalog(tuple(found + [Rule(n, "string", clamp(k), values=lexicon_values(w, minlen)) for n, k, w in lexicons]))


def lexicon_values(entries: Iterable[str], minlen: int) -> frozenset[str]:
    return frozenset(norm_text(e.strip()) for e in entries if len(e.strip()) >= minlen)


@cache
def shipped(minlen: int = 4) -> Catalog:
    """The catalog that comes with the package."""
    return replace(from_tuples(rules.REGEXP_RULES, rules.FIELD_RULES, rules.LEXICONS, minlen), stopwords={k: frozenset(map(norm_text, v)) for k, v in rules.STOPWORDS.items()})


#: Seconds that a pattern may take on the probe, and the probe.
PROBE_SECONDS, PROBE = 2.0, "a" * 1000


def unfit(regex: str) -> str | None:
    """What is wrong with a pattern: it doesn't compile, or takes too long on a plain text."""
    if said := fault(regex):
        return said
    import regex as engine

    try:
        engine.search(regex, PROBE, timeout=PROBE_SECONDS)
    except TimeoutError:
        return f"{regex}: too slow"
    except engine.error as e:
        return f"{regex}: {e}"
    return None


def provenance(text: str) -> str:
    """A short digest that names a rule file's state."""
    return hashlib.sha256(text.encode()).hexdigest()[:12]


def open_rule_file(path: str | Path) -> str:
    """The text of a regular file; symbolic links and pipes are refused."""
    fd = os.open(path, os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0) | getattr(os, "O_NONBLOCK", 0))
    with os.fdopen(fd, "rb") as f:
        if not stat.S_ISREG(os.fstat(f.fileno()).st_mode):
            raise OSError(f"not a regular file: {path}")
        return f.read().decode("utf-8-sig")


def within(base: str | Path, name: str) -> Path | None:
    """The file of that name inside base; None if it lies outside."""
    root = Path(base).resolve()
    target = (root / name).resolve()
    return target if target.is_relative_to(root) else None


def _parts(text: str) -> Iterable[tuple[str, list[str]]]:
    for line in text.splitlines():
        if line.strip():
            yield line, [p.strip() if i != 3 else p for i, p in enumerate(line.strip().split(DELIMITER))]


def parse(
    regexp: str = "",
    fields: str = "",
    lexicons: str = "",
    lexicon_dir: str | Path | None = None,
    stopwords: dict[str, str] | None = None,
    minlen: int = 4,
    check: Callable[[str], str | None] = unfit,
) -> Catalog:
    """A catalog from the text of rule files: name::severity::description::pattern[::scope], the same with [::offset] for fields,
    name::severity::file for lexicons. Faulty lines are left out with a warning, severities out of range are clamped with one; a name declared
    twice is an error."""
    found: list[Rule] = []
    warned: list[str] = []
    sources: list[tuple[str, str]] = [(n, provenance(t)) for n, t in (("regexp", regexp), ("field", fields), ("lexicons", lexicons)) if t]

    def severity(line: str, text: str) -> int:
        if clamp(int(text)) != int(text):
            warned.append(f"{line}: severity taken as {clamp(int(text))}")
        return clamp(int(text))

    for kind, text in (("regexp", regexp), ("field", fields)):
        for line, p in _parts(text):
            try:
                if len(p) < 4:
                    raise ValueError("too few parts")
                if wrong := check(p[3]):
                    raise ValueError(wrong)
                if kind == "regexp":
                    scope = p[4] if len(p) > 4 and p[4] in ("token", "line") else "line"
                    found.append(Rule(p[0], kind, severity(line, p[1]), p[2], p[3], scope))
                else:
                    offset = int(p[4]) if len(p) > 4 and p[4] else 1
                    if offset < 0:
                        raise ValueError("a negative offset")
                    found.append(Rule(p[0], kind, severity(line, p[1]), p[2], p[3], offset=offset))
            except ValueError as e:
                warned.append(f"{line}: {e}")
    for line, p in _parts(lexicons):
        path = within(lexicon_dir or ".", p[2]) if len(p) > 2 else None
        values: frozenset[str] = frozenset()
        if path is not None and path.is_file():
            content = open_rule_file(path)
            sources.append((p[2], provenance(content)))
            rows = list(csv.reader(io.StringIO(content)))[1:]
            values = lexicon_values((r[0] for r in rows if r), minlen)
        else:
            warned.append(f"{line}: no such lexicon")
        try:  # the name counts as declared even without entries
            found.append(Rule(p[0], "string", severity(line, p[1]), values=values))
        except (ValueError, IndexError) as e:
            warned.append(f"{line}: {e}")
    words = {k: frozenset(norm_text(w.strip()) for w in v.splitlines() if w.strip()) for k, v in (stopwords or {}).items()}
    return Catalog(tuple(found), words, tuple(warned), tuple(sources))


def from_files(names: dict[str, str], base: str | Path, minlen: int = 4) -> Catalog:
    """A catalog from the files that an INI's [files] names, inside base; a file that lies outside or is missing is a warning. Families
    without a file keep the shipped rules, and so do stop lists."""
    warned: list[str] = []

    def text(key: str) -> str | None:
        if key not in names:
            return None
        path = within(base, names[key])
        if path is None or not path.is_file():
            warned.append(f"{key}: no such file: {names[key]}")
            return ""
        return open_rule_file(path)

    texts = {k: text(k) for k in ("regexp", "field", "suchmuster")}
    stop = {kind: t for kind, key in (("regexp", "stopword_regexp"), ("field", "stopword_field"), ("search", "stopword_suchmuster")) if (t := text(key)) is not None}
    folder = within(base, names.get("suchmuster_verzeichnis", "."))
    own, kept = parse(texts["regexp"] or "", texts["field"] or "", texts["suchmuster"] or "", folder or base, stop, minlen), shipped(minlen)
    kinds = {"regexp": "regexp", "field": "field", "suchmuster": "string"}
    found = [r for key, kind in kinds.items() for r in (own if texts[key] is not None else kept).rules if r.kind == kind]
    return Catalog(tuple(found), kept.stopwords | own.stopwords, (*own.warnings, *warned), own.sources)
