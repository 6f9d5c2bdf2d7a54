"""Command lines: tokens, commands, logical lines.

A line becomes tokens by one regex alternation, tokens become segments between
separators, and a segment's program is found by a regex over one letter per
token. The same patterns serve Spark SQL text and, for here-documents and for
single commands on the driver, Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import EXTENSIONS, INTERPRETERS, SEPARATORS, WRAPPERS
from .sql import lit, strings, trim

COMMAND = "struct<program:string,args:array<string>,raw:string>"
COMMANDS = f"array<{COMMAND}>"

# a comment from a # at the start of a word; a separator; a word of quoted and bare parts
TOKEN = r"""(?<![^\s;|&])#(?s:.*)|\|\||&&|[;|&]|(?:'[^']*+(?:'|\z)|"[^"]*+(?:"|\z)|[^\s;|&'"]++)++"""
QUOTED = r"""'([^']*)(?:'|\z)|"([^"]*)(?:"|\z)"""
ASSIGNMENT = r"^[A-Za-z_][A-Za-z0-9_]*="
HEAD = r"^(?:A|WF*)*"  # assignments, and wrappers with their flags
EXTENSION = rf"(?i)\.(?:{'|'.join(EXTENSIONS)})$"


def basename_sql(path: str) -> str:
    name = f"regexp_extract({path}, {lit(r'[^/\\]*\z')}, 0)"
    return f"regexp_replace({name}, {lit(EXTENSION.replace('$', r'\z'))}, '')"


def tokens_sql(line: str) -> str:
    """Bare tokens of a line: quotes gone, a comment cut."""
    raw = f"filter(regexp_extract_all({line}, {lit('(?U)' + TOKEN)}, 0), t -> NOT startswith(t, '#'))"
    bare = f"if(contains(t, '\"') OR contains(t, '\\''), regexp_replace(t, {lit(QUOTED)}, '$1$2'), t)"
    return f"filter(transform({raw}, t -> {bare}), t -> t <> '')"


def commands_sql(line: str) -> str:
    """The commands of a line, an array of COMMAND; raw is the whole line without white space around it."""
    kind = f"CASE WHEN t RLIKE {lit(ASSIGNMENT)} THEN 'A' WHEN array_contains({strings(WRAPPERS)}, lower(t)) THEN 'W' WHEN startswith(t, '-') THEN 'F' ELSE 'O' END"
    cut = f"concat(array(0), filter(transform(ts, (t, i) -> if(array_contains({strings(SEPARATORS)}, t), i + 1, null)), i -> i IS NOT NULL), array(size(ts) + 1))"
    parts = "transform(slice(cut, 1, size(cut) - 1), (a, i) -> slice(ts, a + 1, cut[i + 1] - a - 1))"
    plain = f"(size(p) = 0 OR NOT (contains(p[0], '=') OR array_contains({strings(WRAPPERS)}, lower(p[0]))))"  # most: the program comes first
    head = f"if({plain}, 0, length(regexp_extract(array_join(transform(p, t -> {kind}), ''), {lit(HEAD)}, 0)))"
    command = f"named_struct('program', {basename_sql('p[h]')}, 'args', slice(p, h + 2, size(p)), 'raw', raw)"
    made = f"transform(filter(transform(parts, p -> named_struct('p', p, 'h', {head})), x -> x.h < size(x.p)), x -> {command.replace('p[h]', 'x.p[x.h]').replace('slice(p, h + 2, size(p))', 'slice(x.p, x.h + 2, size(x.p))')})"
    # names for intermediate arrays, by one-element transforms: SQL text has no let
    return _let(_let(_let(_let(made, "parts", parts), "cut", cut), "ts", tokens_sql(line)), "raw", trim(line))


def _let(body: str, name: str, value: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def commands(line: str) -> list[dict]:
    """What commands_sql gives, for one line on the driver."""
    return [{"program": c.program, "args": list(c.args), "raw": c.raw} for c in parse(line)]


@dataclass(frozen=True)
class Command:
    program: str
    args: tuple[str, ...]
    raw: str


_TOKEN, _QUOTED = (re.compile(p.replace(r"\z", r"\Z")) for p in (TOKEN, QUOTED))


def basename(path: str) -> str:
    return re.sub(EXTENSION.replace("$", r"\Z"), "", re.split(r"[/\\]", path)[-1])


def parse(line: str) -> list[Command]:
    found = [_QUOTED.sub(lambda m: (m[1] or "") + (m[2] or ""), t) for t in _TOKEN.findall(line) if t[0] != "#"]
    segments: list[list[str]] = [[]]
    for t in filter(None, found):
        if t in SEPARATORS:
            segments.append([])
        else:
            segments[-1].append(t)
    out = []
    for s in segments:
        kinds = "".join("A" if re.match(ASSIGNMENT, t) else "W" if t.lower() in WRAPPERS else "F" if t[0] == "-" else "O" for t in s)
        head = re.match(HEAD, kinds).end()
        if head < len(s):
            out.append(Command(basename(s[head]), tuple(s[head + 1 :]), line.strip()))
    return out


_HEREDOC = re.compile(r"""-?\s*['"]*([A-Za-z0-9_]+)""")


def heredoc(text: str) -> str | None:
    """The word that ends the here-document which a line opens, if it opens one."""
    at = text.find("<<")
    if at < 0 or text[at + 2 : at + 3] == "<":
        return None
    m = _HEREDOC.match(text, at + 2)
    return m[1] if m else None


def logical_lines(text: str) -> Iterator[tuple[int, str]]:
    """(first physical line, text) of each logical line.

    A line goes on after an odd number of backslashes, |, || or && at its end. A
    here-document is data, unless the line that opens it runs an interpreter:
    its lines then stand for themselves.
    """
    lines = re.split(r"\r?\n", text)
    lines = lines[:-1] if lines[-1] == "" else lines
    at = 0
    while at < len(lines):
        first, parts = at, []
        while True:
            line = lines[at]
            at += 1
            slashes = len(line) - len(line.rstrip("\\"))
            if slashes % 2 and at < len(lines):
                parts.append(line[:-1])
                continue
            parts.append(line)
            if not (line.rstrip().endswith(("|", "&&")) and at < len(lines)):
                break
        whole = " ".join(parts)
        yield first + 1, whole
        if end := heredoc(whole):
            code = any(c.program in INTERPRETERS for c in parse(whole))
            while at < len(lines) and lines[at].strip() != end:
                if code:
                    yield at + 1, lines[at]
                at += 1
            at += 1


def substitutions(text: str) -> list[str]:
    """What stands inside each $(...), the inner ones after the outer, and each pair of backticks."""
    out, at = [], 0
    while at < len(text):
        if text.startswith("$(", at):
            depth, end = 1, at + 2
            while end < len(text) and depth:
                depth += (text[end] == "(") - (text[end] == ")")
                end += 1
            if not depth:
                inner = text[at + 2 : end - 1]
                out += [inner, *substitutions(inner)]
                at = end
                continue
        elif text[at] == "`" and (end := text.find("`", at + 1)) > 0:
            out.append(text[at + 1 : end])
            at = end
        at += 1
    return out


def lines_column(text: Column) -> Column:
    """array<struct<line:int,text:string>>: sequential state within a document, so Python, by Arrow batches."""

    @F.pandas_udf("array<struct<line:int,text:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"line": n, "text": x} for n, x in logical_lines(t or "")])

    return run(text)


def substitutions_column(text: Column) -> Column:
    """array<string>; brackets nest, which no regex matches."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: substitutions(t) if t and ("$(" in t or "`" in t) else [])

    return run(text)
