"""What a regular expression needs of a text, read from its parsed form: strings, digits, a length, and a plainer expression that an
automaton without backtracking tests for. Whatever lacks these cannot match, so a rule is tried on few texts and none is lost. Also says which
patterns may backtrack without bound."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache
from re import _constants as C
from re import _parser

#: A repeat of so many rounds or more whose body may match in several ways can take exponential time.
MANY = 20
_REPEATS = (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT)
_ZERO_WIDTH = (C.AT, C.ASSERT, C.ASSERT_NOT)


@dataclass(frozen=True)
class Needs:
    strings: tuple[str, ...]  # one of these is in every match; folded, if folded says so; none: not known
    folded: bool
    digits: int  # least number of decimal digits in a match
    width: int  # least number of characters of a match
    risky: bool
    plain: str | None = None  # matches wherever the expression does, and is regular; None: not known


def fold(text: str) -> str:
    """Equal for all texts that differ in case only, in the sense of the expressions' engine."""
    if text.isascii():
        return text.lower()
    return text.casefold().replace("̇", "").replace("ı", "i")


def _better(a: tuple[str, ...] | None, b: tuple[str, ...] | None) -> tuple[str, ...] | None:
    if not a or not b:
        return a or b
    rank = lambda x: (min(map(len, x)), -len(x))
    return max(a, b, key=rank)


def _strings(seq) -> tuple[str, ...] | None:
    best, run = None, ""
    for op, av in [*seq, (None, None)]:
        if op is C.LITERAL:
            run += chr(av)
            continue
        if op in _ZERO_WIDTH:
            continue
        if run:
            best, run = _better(best, (run,)), ""
        if op is C.SUBPATTERN:
            best = _better(best, _strings(av[3]))
        elif op is C.ATOMIC_GROUP:
            best = _better(best, _strings(av))
        elif op in _REPEATS and av[0] >= 1:
            best = _better(best, _strings(av[2]))
        elif op is C.BRANCH:
            ways = [_strings(x) for x in av[1]]
            if all(ways):
                best = _better(best, tuple(sorted({s for w in ways for s in w})))
    return best


def _is_digit(items) -> bool:
    zero, nine = ord("0"), ord("9")
    for op, av in items:
        inside = (op is C.CATEGORY and av is C.CATEGORY_DIGIT) or (op is C.RANGE and zero <= av[0] and av[1] <= nine) or (op is C.LITERAL and zero <= av <= nine)
        if not inside:
            return False
    return True


def _digits(seq) -> int:
    n = 0
    for op, av in seq:
        if op is C.LITERAL:
            n += chr(av).isdecimal()
        elif op is C.IN:
            n += _is_digit(av)
        elif op is C.SUBPATTERN:
            n += _digits(av[3])
        elif op is C.ATOMIC_GROUP:
            n += _digits(av)
        elif op in _REPEATS:
            n += min(av[0], 1000) * _digits(av[2])
        elif op is C.BRANCH:
            n += min(_digits(x) for x in av[1])
    return n


def _varies(seq) -> bool:
    """Whether it may match in several ways."""
    for op, av in seq:
        if op is C.BRANCH or op in _REPEATS and (av[0] != av[1] or _varies(av[2])):
            return True
        if op is C.SUBPATTERN and _varies(av[3]) or op is C.ATOMIC_GROUP and _varies(av):
            return True
    return False


def _risky(seq) -> bool:
    for op, av in seq:
        if op in _REPEATS and (av[1] >= MANY and _varies(av[2]) or _risky(av[2])) or op in (C.GROUPREF, C.GROUPREF_EXISTS):
            return True
        inner = av[1] if op is C.BRANCH else [av[3]] if op is C.SUBPATTERN else [av[1]] if op in (C.ASSERT, C.ASSERT_NOT) else [av] if op is C.ATOMIC_GROUP else []
        if any(map(_risky, inner)):
            return True
    return False


def _ignores_case(seq) -> bool:
    for op, av in seq:
        if op is C.SUBPATTERN and (av[1] & re.I or _ignores_case(av[3])) or op in _REPEATS and _ignores_case(av[2]):
            return True
        if op is C.BRANCH and any(map(_ignores_case, av[1])) or op is C.ATOMIC_GROUP and _ignores_case(av):
            return True
    return False


#: Repeats beyond this are unbounded in the plain form, which keeps its automaton small.
_FEW = 6
_BEYOND_ASCII = r"\x{80}-\x{10ffff}"
_CLASSES = {C.CATEGORY_DIGIT: "0-9" + _BEYOND_ASCII, C.CATEGORY_SPACE: r"\x09-\x0d\x1c-\x20" + _BEYOND_ASCII, C.CATEGORY_WORD: "0-9A-Za-z_" + _BEYOND_ASCII}


class _NotPlain(Exception):
    pass


def _char(code: int, folded: bool) -> str:
    """The members of a class that stand for a character."""
    if folded and code < 128 and chr(code).isalpha():
        return chr(code).lower() + chr(code).upper() + _BEYOND_ASCII  # some letters beyond ASCII equal one of ASCII but for case
    return rf"\x{{{code:x}}}" if code < 128 or not folded else _BEYOND_ASCII


def _members(items, folded: bool) -> str:
    out, letters = "", range(65, 123)
    for op, av in items:
        if op is C.LITERAL:
            out += _char(av, folded)
        elif op is C.RANGE:
            out += rf"\x{{{av[0]:x}}}-\x{{{av[1]:x}}}"
            if folded and av[0] < 123 and av[1] >= 65:
                out += "A-Za-z" + _BEYOND_ASCII
            elif folded and av[1] not in letters and av[1] >= 128:
                out += _BEYOND_ASCII
        elif op is C.CATEGORY and av in _CLASSES:
            out += _CLASSES[av]
        else:
            raise _NotPlain
    return out


def _plain(seq, folded: bool) -> str:
    """A regular expression without look-around, boundaries or case, of a superset of the texts."""
    out = ""
    for op, av in seq:
        if op in _ZERO_WIDTH:
            continue
        if op is C.LITERAL:
            out += f"[{_char(av, folded)}]"
        elif op is C.IN and av[0][0] is C.NEGATE or op in (C.NOT_LITERAL, C.ANY):
            out += "(?s:.)"
        elif op is C.IN:
            out += f"[{_members(av, folded)}]"
        elif op is C.SUBPATTERN:
            out += f"(?:{_plain(av[3], folded)})"
        elif op is C.ATOMIC_GROUP:
            out += f"(?:{_plain(av, folded)})"
        elif op is C.BRANCH:
            out += "(?:" + "|".join(_plain(x, folded) for x in av[1]) + ")"
        elif op in _REPEATS:
            low, high = min(av[0], _FEW), av[1]
            bounds = f"{{{low},{high}}}" if high <= _FEW and low == av[0] else f"{{{low},}}"
            out += f"(?:{_plain(av[2], folded)}){bounds}"
        else:
            raise _NotPlain
    return out


@cache
def needs(regex: str) -> Needs:
    tree = _parser.parse(regex)
    folded = bool(tree.state.flags & re.I) or _ignores_case(tree)
    if tree.state.flags & re.X:
        return Needs((), False, 0, 0, True)
    found = _strings(tree) or ()
    found = tuple(sorted({fold(s) for s in found})) if folded else found
    if any("\n" in s or not s for s in found):
        found = ()
    try:
        plain = _plain(tree, folded)
    except _NotPlain:
        plain = None
    return Needs(found, folded, _digits(tree), tree.getwidth()[0], _risky(tree), plain)


def fault(regex: str, name: str = "") -> str | None:
    """What is wrong with a pattern; None if it can be used."""
    try:
        re.compile(regex)
    except (re.error, OverflowError, RecursionError) as e:
        return f"{name or regex}: {e}"
    return None
