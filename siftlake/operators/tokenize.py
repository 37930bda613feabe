"""Lines to tokens: as Columns, where lines with JSON go through an Arrow function (others reach it as nulls), and as Python functions for
the engine."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What parts tokens, query values and URLs, and how deep and how far JSON is walked.
SEPARATORS = r"\s?&=,;|"
QUERY = r"[?&]([\w.\-\[\]]+)=([^&\n#]+)"
URL = r"[A-Za-z][A-Za-z0-9+.\-]*://[^\s]+"
URL_TAIL = ".,;)]}\"'>"
DEEPEST, MOST_VALUES = 20, 1000
#: Fixed value: key:value or key=value within one token.
INLINE = r"""^[\s"'{\[(]*([\w.\-]{1,60})[\s"'}\])]*([:=])(.+)$"""

_TOKEN, _QUERY, _URL, _INLINE = re.compile(f"[^{SEPARATORS}]+"), re.compile(QUERY), re.compile(URL), re.compile(INLINE)


def split_tokens(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(f"(?U)[^{SEPARATORS}]+"), F.lit(0))


def percent_decoded(value: Column) -> Column:
    """Decoded once; what is no escape stays as it is, and so does a plus."""
    safe = F.replace(F.regexp_replace(value, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.when(F.contains(value, F.lit("%")), F.coalesce(F.try_url_decode(safe), value)).otherwise(value)


def url_values(line: Column) -> Column:
    """User names, passwords and query values of the URLs in a line, decoded and, where that differs, raw."""
    urls = F.transform(F.regexp_extract_all(line, F.lit("(?U)" + URL), F.lit(0)), lambda u: F.rtrim(u, F.lit(URL_TAIL)))
    login = lambda u: F.regexp_extract(u, r"(?s)^[^:]+://([^/?#]*)@", 1)
    logins = F.flatten(F.transform(urls, lambda u: F.array(F.split_part(login(u), F.lit(":"), F.lit(1)), F.regexp_extract(login(u), r"(?s)^[^:]*:(.*)$", 1))))
    asked = F.transform(F.regexp_extract_all(line, F.lit("(?U)" + QUERY), F.lit(2)), lambda v: F.regexp_replace(v, r"(?U)^\s+|\s+$", ""))
    none = F.array().cast("array<string>")
    raw = F.filter(F.concat(F.when(F.contains(line, F.lit("://")), logins).otherwise(none), F.when(line.rlike("[?&]"), asked).otherwise(none)), lambda v: v != "")
    both = F.flatten(F.transform(raw, lambda v: F.array(percent_decoded(v), v)))
    return F.array_distinct(F.filter(both, lambda v: v != ""))


def plain_tokens(line: Column) -> Column:
    """Tokens in order, then values of URLs that are not among them."""
    tokens = split_tokens(line)
    return F.when(line.rlike("[?&]|://"), F.concat(tokens, F.array_except(url_values(line), tokens))).otherwise(tokens)


def wants_json(line: Column, mode: str) -> Column:
    if mode != "auto":
        return F.lit(mode == "true")
    return line.rlike(r"(?U)^\s*[{\[]") | (F.contains(line, F.lit("{")) & F.contains(line, F.lit('"')))


def json_outcome(line: Column) -> Column:
    """parsed or failed for a line that begins like JSON, else null."""
    return F.when(line.rlike(r"(?U)^\s*[{\[]"), F.when(F.try_parse_json(line).isNotNull(), "parsed").otherwise("failed"))


class _Walk:
    """Strings and key→value pairs of a parsed JSON value, bounded in depth and number."""

    def __init__(self, value: object):
        self.strings: list[str] = []
        self.pairs: list[tuple[str, str]] = []
        todo: list[tuple[int, str | None, object]] = [(0, None, value)]
        while todo:
            depth, key, x = todo.pop()
            if isinstance(x, (dict, list)):
                if depth <= DEEPEST:
                    inside = x.items() if isinstance(x, dict) else ((None, y) for y in x)
                    todo.extend(reversed([(depth + 1, None if k is None else str(k), y) for k, y in inside]))
            elif isinstance(x, str):
                if depth <= DEEPEST and len(self.strings) < MOST_VALUES:
                    self.strings.append(x)
                if x:
                    self._pair(key, x)
            elif isinstance(x, (int, float)) and not isinstance(x, bool):
                self._pair(key, str(x))

    def _pair(self, key: str | None, value: str) -> None:
        if key is not None and len(self.pairs) < MOST_VALUES:
            self.pairs.append((key, value))


def _parsed(text: str) -> _Walk | None:
    try:
        return _Walk(json.loads(text))
    except (ValueError, RecursionError):
        return None


_STEP = re.compile(r'"(?:[^"\\]|\\.)*(?:"|$)|[{}]', re.S)


def _balanced(text: str, start: int) -> int:
    """Behind the bracket that closes the one at start, strings aside; start if there is none."""
    depth = 0
    for m in _STEP.finditer(text, start):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if depth == 0 and m[0] == "}":
            return m.end()
    return start


_DECODER = json.JSONDecoder()


def fragments(text: str) -> list[tuple[int, int]]:
    """Spans of JSON objects in a text: valid ones, or else balanced brackets."""
    out, at = [], text.find("{")
    while at >= 0:
        try:
            end = _DECODER.raw_decode(text, at)[1]
        except (ValueError, RecursionError):
            end = _balanced(text, at)
        if end > at:
            out.append((at, end))
        at = text.find("{", max(end, at + 1))
    return out


def _urls(text: str) -> list[str]:
    raw: list[str | None] = []
    for m in _URL.finditer(text) if "://" in text else ():
        try:
            parts = urlsplit(m[0].rstrip(URL_TAIL))
        except ValueError:
            continue
        raw += [parts.username, parts.password]
    raw += [m[2].strip() for m in _QUERY.finditer(text)] if "?" in text or "&" in text else []
    return [v for r in raw if r for v in dict.fromkeys((unquote(r), r)) if v]


def line_tokens(line: str, before: Sequence[str] = ()) -> list[str]:
    """`plain_tokens` of a line without JSON; values of URLs that are among the tokens before are left out too."""
    out = _TOKEN.findall(line)
    if "?" in line or "&" in line or "://" in line:
        known = {*out, *before}
        out += [v for v in dict.fromkeys(_urls(line)) if v not in known]
    return out


def pair_of(token: str) -> tuple[str, str] | None:
    """`inline_pair` of a token."""
    if "://" in token or ":" not in token and "=" not in token or not (m := _INLINE.match(token)):
        return None
    key, value = m[1].strip("\"'{}[](),.;!? "), m[3].strip("\"'{}[](),.:;!?")
    time = m[2] == ":" and key.isascii() and key.isdigit() and ":" in value
    return (key, value) if key and value and not time else None


def json_tokens(line: str) -> list[str]:
    """Tokens of a line that may hold JSON. A line that is an object counts as its string values; an object within a line is one token,
    followed by the tokens of its values; key:value tokens keep the context of keys."""
    whole = _parsed(line) if line.startswith("{") else None
    texts, pairs = (whole.strings, list(whole.pairs)) if whole else ([line], [])
    out: list[str] = []
    for text in texts:
        if "{" not in text:
            out += line_tokens(text, out)
            continue
        at = 0
        for start, end in fragments(text):
            part = _parsed(text[start:end])
            out += _TOKEN.findall(text[at:start])
            out.append(text[start:end])
            for value in part.strings if part else [text[start:end]]:
                out += _TOKEN.findall(value)
            pairs += part.pairs if part else []
            at = end
        out += _TOKEN.findall(text[at:])
        known = set(out)
        out += [v for v in dict.fromkeys(_urls(text)) if v not in known]
    known = set(out)
    return out + [t for t in dict.fromkeys(f"{k}:{v}" for k, v in pairs) if t not in known]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _json_tokens(lines: pd.Series) -> pd.Series:
    return lines.map(lambda s: None if s is None else json_tokens(s))


def tokens(line: Column, mode: str = "auto") -> Column:
    """The tokens of a line. The text of lines that may hold JSON goes to Python; of others a null."""
    if mode == "false":
        return plain_tokens(line)
    ask = wants_json(line, mode)
    return F.when(ask, _json_tokens(F.when(ask, line))).otherwise(plain_tokens(line))


def inline_pair(token: Column) -> Column:
    """struct<key, value> of a key:value or key=value token; null for URLs, times, addresses and everything else."""
    rx = "(?U)" + INLINE
    key = F.btrim(F.regexp_extract(token, rx, 1), F.lit("\"'{}[](),.;!? "))
    value = F.btrim(F.regexp_extract(token, rx, 3), F.lit("\"'{}[](),.:;!?"))
    time = (F.regexp_extract(token, rx, 2) == ":") & key.rlike("^[0-9]+$") & F.contains(value, F.lit(":"))
    good = F.contains(token, F.lit(":")) | F.contains(token, F.lit("="))
    return F.when(good & ~F.contains(token, F.lit("://")) & (key != "") & (value != "") & ~time, F.struct(key.alias("key"), value.alias("value")))
