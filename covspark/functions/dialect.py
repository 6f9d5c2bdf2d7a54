"""Patterns of a linear-time regex dialect, on Java's backtracking engine.

What that dialect rejects and Java would take - look-around, back-references,
atomic groups, possessive quantifiers - has to be rejected here, and `$` has to
mean the very end. Anything doubtful is unsupported: a rule that uses it gets no
verdict rather than a wrong one.
"""

from __future__ import annotations

import re
import warnings

BUDGET = 1 << 15  # states that bounded repeats may unroll to, about what a program of 1 MiB holds

_FOREIGN = re.compile(r"\(\?(?:=|!|<=|<!|>|P=|P>|\(|#|&|R|[0-9])|\\[1-9]|\\k[<{']|\\[GKRXZ]|\\Q|\\E|&&|--|~~")
_CLASS = re.compile(r"\\[pP](?:\{\^?\w+(?:=\w+)?\}|[A-Z])|\\x\{[0-9A-Fa-f]+\}|\[:\^?\w+:\]")


def _size(tree) -> int:
    total = 0
    for op, arg in tree:
        name = str(op)
        if name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = arg
            count = int(high) if int(high) < 1 << 31 else max(int(low), 1)
            total += max(1, count) * _size(inner)
        elif name == "POSSESSIVE_REPEAT":
            return BUDGET + 1
        elif name == "SUBPATTERN":
            total += _size(arg[3])
        elif name == "BRANCH":
            total += sum(map(_size, arg[1]))
        else:
            total += 1
    return total


def _walk(pattern: str):
    """(character, inside a class, escaped) of each place."""
    inside, i = 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            yield i, pattern[i : i + 2], inside, True
            i += 2
            continue
        if c == "[":
            inside += 1
        elif c == "]" and inside:
            inside -= 1
        yield i, c, inside, False
        i += 1


def translate(pattern: str, multi_line: bool = False, dot_all: bool = False) -> str | None:
    """The Java pattern that searches as this one does, whatever the case, or None if it is unsupported."""
    plain = "".join("" if inside and len(c) == 1 else c for _, c, inside, _ in _walk(pattern))
    plain = _CLASS.sub("a", plain)
    if _FOREIGN.search(plain) or re.search(r"(?<!\\)[*+?}]\+", plain):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = re._parser.parse(_CLASS.sub("a", pattern).replace(r"\z", r"\Z"))
    except (re.error, OverflowError, RecursionError):
        return None
    if _size(tree) > BUDGET:
        return None
    out = []
    for _, c, inside, escaped in _walk(pattern):
        out.append(r"\z" if c == "$" and not inside and not escaped and not multi_line else c)
    body = re.sub(r"\(\?P<", "(?<", "".join(out))
    return f"(?iudU{'m' * multi_line}{'s' * dot_all}){body}"
