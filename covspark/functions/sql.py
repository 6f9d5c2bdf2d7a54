"""Spark SQL text: literals and the string leaves that rules are made of.

Compilers emit text because a projection of hundreds of rules parses faster as
text than it is built as Column objects.
"""

from __future__ import annotations

import re
from collections.abc import Iterable


#: White space of any script.
SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def lit(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\0", "\\0") + "'"


def strings(values: Iterable[str]) -> str:
    """An array of string literals."""
    values = list(values)
    return f"array({', '.join(map(lit, values))})" if values else "cast(array() as array<string>)"


def quoted(value: str) -> str:
    """A Java regex that matches value itself."""
    return re.sub(r"([\\.^$|?*+()\[\]{}\-&~#])", r"\\\1", value)


def _join(parts: Iterable[str], word: str, empty: str) -> str:
    parts = list(parts)
    return empty if not parts else parts[0] if len(parts) == 1 else "(" + f" {word} ".join(parts) + ")"


def every(parts: Iterable[str]) -> str:
    """Three-valued AND; true of nothing."""
    return _join(parts, "AND", "true")


def some(parts: Iterable[str]) -> str:
    """Three-valued OR; false of nothing."""
    return _join(parts, "OR", "false")


def negate(part: str) -> str:
    return f"(NOT {part})"


def contains(low: str, needle: str) -> str:
    """low is a lower-cased expression; as in the other leaves, case doesn't count."""
    return f"contains({low}, {lit(needle.lower())})"


def prefix(low: str, needle: str) -> str:
    return f"startswith({low}, {lit(needle.lower())})"


def suffix(low: str, needle: str) -> str:
    return f"endswith({low}, {lit(needle.lower())})"


def equal(low: str, needle: str) -> str:
    return f"{low} = {lit(needle.lower())}"


def word(low: str, needle: str) -> str:
    """needle where neither neighbour is one of [A-Za-z0-9_]; an empty needle is nowhere."""
    if not needle:
        return "false"
    return f"({contains(low, needle)} AND {low} RLIKE {lit('(?<![A-Za-z0-9_])' + quoted(needle.lower()) + '(?![A-Za-z0-9_])')})"


def path_under(low: str, base: str) -> str:
    """A path that is base or lies below it; a base of slashes holds nothing."""
    base = base.lower().rstrip("/")
    if not base:
        return "false"
    return f"(rtrim('/', {low}) = {lit(base)} OR startswith(rtrim('/', {low}), {lit(base + '/')}))"


def trim(text: str) -> str:
    """Without white space, of any script, at either end."""
    return f"trim(BOTH {lit(SPACE)} FROM {text})"


def glob(value: str, pattern: str, whole: bool = True) -> str:
    """* is any run and ? any character; there is no escape. whole: the pattern spans the value."""
    body = "".join({"*": ".*", "?": "."}.get(c) or quoted(c) for c in pattern)
    if "*" not in pattern and "?" not in pattern:
        return f"{value} = {lit(pattern)}" if whole else f"contains({value}, {lit(pattern)})"
    return f"{value} RLIKE {lit(f'(?s)\\A{body}\\z' if whole else f'(?s){body}')}"


def last_segment(path: str) -> str:
    """What follows the last slash of either kind."""
    return f"regexp_extract({path}, {lit(r'[^/\\]*\z')}, 0)"
