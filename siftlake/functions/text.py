"""Text functions as Columns: normal form, stripping, predicates, windows."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules

#: Wrappers that are taken off a value.
WRAPPERS = "\"'{}[](),.:;!?"


def _folds() -> tuple[str, str]:
    """Small letters that decompose to one base character and combining marks, and those bases; from the Unicode tables."""
    source, target = [], []
    for start, end in ((0xC0, 0x250), (0x370, 0x530), (0x1E00, 0x2000)):
        for c in map(chr, range(start, end)):
            base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
            if len(base) == 1 and base != c and c == c.lower():
                source.append(c)
                target.append(base)
    return "".join(source), "".join(target)


FOLD_FROM, FOLD_TO = _folds()


def norm(c: Column) -> Column:
    """Lower case, sharp s as ss, no accents. ASCII takes the short way."""
    low = F.lower(c)
    folded = F.regexp_replace(F.translate(F.replace(low, F.lit("ß"), F.lit("ss")), FOLD_FROM, FOLD_TO), r"\p{Mn}", "")
    return F.when(F.octet_length(c) == F.char_length(c), low).otherwise(folded)


def norm_text(text: str) -> str:
    """`norm` on the driver, for rules."""
    low = text.lower().replace("ß", "ss").translate(str.maketrans(FOLD_FROM, FOLD_TO))
    return "".join(c for c in low if unicodedata.category(c) != "Mn")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def unwrap(c: Column) -> Column:
    """Without quotes, brackets and punctuation at either end."""
    return F.btrim(c, F.lit(WRAPPERS))


def looks_like_path(c: Column) -> Column:
    """Certain file paths: /a/b, ~/x, \\\\server and X:\\ or X:/."""
    return c.rlike(r"^(?:/[^\n]*/|~/|\\\\|[A-Za-z]:[\\/])")


#: Fixed value: what stands for a value that is masked already.
MASK = r"^(?:\*{2,}|x{3,}|[<\[]\s*(?:redacted|masked|hidden|removed|sanitized|filtered|secret|xxxx+)\s*[>\]]|(?:redacted|masked|hidden|removed|sanitized|filtered))$"


def is_masked(c: Column) -> Column:
    return strip(c).rlike(f"(?i){MASK}")


def lexicon_confidence(line: Column) -> Column:
    return F.when(F.lower(line).rlike("|".join(map(re.escape, rules.CONTEXT_MARKERS))), "medium").otherwise("low")


def severity_text(krit: int) -> str:
    """`severity_label` on the driver."""
    return rules.SEVERITY_LABELS[krit]


def severity_label(c: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in rules.SEVERITY_LABELS.items() for x in (F.lit(k), F.lit(v))]), c)


def context_window(line: Column, start: Column, end: Column, before: int, after: int, limit: int = 0) -> Column:
    """struct<text, start, end, cut>: the line around a hit, with marks where it was cut, and the hit's new place.
    An unknown place (-1) gives the whole line; text over limit is cut and loses the place."""
    known = (start >= 0) & (start < end) & (end <= F.char_length(line))
    low, high = F.greatest(F.lit(0), start - before), F.least(F.char_length(line), end + after)
    head = F.when(low > 0, F.lit(rules.CUT_MARK + " ")).otherwise("")
    tail = F.when(high < F.char_length(line), F.lit(" " + rules.CUT_MARK)).otherwise("")
    text = F.when(known, F.concat(head, F.substring(line, low + 1, high - low), tail)).otherwise(line)
    at = F.when(known, start - low + F.char_length(head)).otherwise(start)
    to = F.when(known, start - low + F.char_length(head) + end - start).otherwise(end)
    cut = F.when(known, (low > 0) | (high < F.char_length(line))).otherwise(F.lit(False))
    if not limit:
        return F.struct(text.alias("text"), at.alias("start"), to.alias("end"), cut.alias("cut"))
    long = F.char_length(text) > limit
    short = F.when(long, F.concat(F.left(text, F.lit(limit)), F.lit(" " + rules.CUT_MARK))).otherwise(text)
    lost = to > F.char_length(short)
    return F.struct(short.alias("text"), F.when(lost, -1).otherwise(at).alias("start"), F.when(lost, -1).otherwise(to).alias("end"), (cut | long).alias("cut"))


def sanitize_cell(c: Column) -> Column:
    """Safe in a spreadsheet: no control characters, no more than a cell holds, no formula."""
    clean = F.left(F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""), F.lit(32767))
    return F.when(clean.rlike("^[ \\t\\r\\n\\x0b\\f\\u00a0\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]*[=+\\-@]"), F.concat(F.lit("'"), clean)).otherwise(clean)
