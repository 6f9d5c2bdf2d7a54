"""Chat formatting with a template compiler.

A small template language is parsed into a syntax tree, constants are folded,
and the tree becomes Python closures. It is sandboxed: a template reaches the
values given to it, literals and the filters named here, and nothing else; it
has no calls, no attribute access beyond the keys of dicts, and no loops but
those over given lists.

    {{ expr }}   {% for x in expr %} {% endfor %}   {% set x = expr %}   {# note #}
    {% if expr %} {% elif expr %} {% else %} {% endif %}
    {% generation %} {% endgeneration %}     text that is learned: its span is returned

Expressions: names, strings, integers, true, false, none, x.key, x[expr], filters
x | name, + and ~ to join, == != < <= > >= in, not, and, or, brackets. A loop sets
loop.index, loop.index0, loop.first and loop.last. A minus sign inside a tag
({%- -%}) strips white space beside it.
"""

from __future__ import annotations

import hashlib
import operator
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scan import tidy
from .store import table

Env = dict[str, Any]


class TemplateError(ValueError):
    """The template is not in the language."""


# --- the control strings, and a reversible escape of them inside texts

#: Strings that chat models read as marks.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|user|>", "<|assistant|>", "<|system|>", "<|eot_id|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_MARKS = re.compile("%|" + "|".join(map(re.escape, CONTROL)))
_CODED = re.compile("%([0-9A-F]{2})")


def escape(text: str) -> str:
    """Percent-code each % and the first character of each control string, so none is left whole."""
    return _MARKS.sub(lambda m: f"%{ord(m[0][0]):02X}{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _CODED.sub(lambda m: chr(int(m[1], 16)), text)


def escape_role(role: str) -> str:
    """As escape, and line ends too: a role is one line."""
    return escape(role).replace("\n", "%0A")


FILTERS: dict[str, Callable[[Any], Any]] = {"escape": escape, "escape_role": escape_role, "trim": lambda x: x.strip(), "upper": lambda x: x.upper(), "lower": lambda x: x.lower(), "length": len}

# --- syntax tree


@dataclass
class Const:
    value: Any


@dataclass
class Name:
    name: str


@dataclass
class Item:
    of: Any
    key: Any


@dataclass
class Filter:
    of: Any
    name: str


@dataclass
class Unary:
    of: Any


@dataclass
class Binary:
    op: str
    left: Any
    right: Any


@dataclass
class Print:
    of: Any


@dataclass
class For:
    name: str
    of: Any
    body: list


@dataclass
class If:
    arms: list[tuple[Any, list]]


@dataclass
class Set:
    name: str
    of: Any


@dataclass
class Generation:
    body: list


_TAG = re.compile(r"\{\{-?|\{%-?|\{#")
_TOKEN = re.compile(r"""\s*(?:(?P<int>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>|.\[\]()=]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None}
_JOIN = {"+": operator.add, "~": lambda a, b: f"{a}{b}"}
_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "in": lambda a, b: a in b}


class _Expressions:
    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unreadable: {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str | None, str | None]:
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, None)

    def take(self, *values: str) -> str | None:
        kind, value = self.peek()
        if kind in ("op", "name") and value in values:
            self.at += 1
            return value
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected, not {self.peek()[1]!r}")

    def name(self) -> str:
        kind, value = self.peek()
        if kind != "name":
            raise TemplateError(f"a name expected, not {value!r}")
        self.at += 1
        return value

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"too much: {self.peek()[1]!r}")

    def parse(self) -> Any:
        left = self._and()
        while self.take("or"):
            left = Binary("or", left, self._and())
        return left

    def _and(self) -> Any:
        left = self._not()
        while self.take("and"):
            left = Binary("and", left, self._not())
        return left

    def _not(self) -> Any:
        return Unary(self._not()) if self.take("not") else self._compare()

    def _compare(self) -> Any:
        left = self._join()
        while op := self.take(*_COMPARE):
            left = Binary(op, left, self._join())
        return left

    def _join(self) -> Any:
        left = self._postfix()
        while op := self.take(*_JOIN):
            left = Binary(op, left, self._postfix())
        return left

    def _postfix(self) -> Any:
        left = self._atom()
        while op := self.take(".", "[", "|"):
            if op == ".":
                left = Item(left, Const(self.name()))
            elif op == "[":
                left = Item(left, self.parse())
                self.need("]")
            else:
                name = self.name()
                if name not in FILTERS:
                    raise TemplateError(f"no such filter: {name}")
                left = Filter(left, name)
        return left

    def _atom(self) -> Any:
        kind, value = self.peek()
        self.at += 1
        if kind == "int":
            return Const(int(value))
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "name":
            return Const(_WORDS[value]) if value in _WORDS else Name(value)
        if value == "(":
            inner = self.parse()
            self.need(")")
            return inner
        raise TemplateError(f"an expression expected, not {value!r}")


def parse(source: str) -> list:
    """The syntax tree of a template: a list of Const, Print, For, If, Set and Generation."""
    pieces: list[tuple[str, str]] = []
    at, strip = 0, False
    while m := _TAG.search(source, at):
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        pieces.append(("text", text.rstrip() if m[0].endswith("-") else text))
        close = {"{{": "}}", "{%": "%}", "{#": "#}"}[m[0][:2]]
        end = source.find(close, m.end())
        if end < 0:
            raise TemplateError(f"{close} is missing")
        inner = source[m.end() : end]
        strip = inner.endswith("-") and close != "#}"
        pieces.append((m[0][:2], inner[:-1] if strip else inner))
        at = end + 2
    pieces.append(("text", source[at:].lstrip() if strip else source[at:]))
    body, left, stop = _block(pieces, 0, ())
    if stop:
        raise TemplateError(f"{stop} closes nothing")
    assert left == len(pieces)
    return body


def _block(pieces: list[tuple[str, str]], at: int, until: tuple[str, ...]) -> tuple[list, int, str]:
    body: list = []
    while at < len(pieces):
        kind, inner = pieces[at]
        at += 1
        if kind == "text":
            if inner:
                body.append(Const(inner))
        elif kind == "{{":
            e = _Expressions(inner)
            body.append(Print(e.parse()))
            e.end()
        elif kind == "{%":
            word = (re.match(r"\s*(\w*)", inner) or [""])[1]
            if word in until or word.startswith("end") or word in ("elif", "else"):
                return body, at, inner.strip()
            e = _Expressions(inner)
            e.name()
            if word == "for":
                name = e.name()
                e.need("in")
                of = e.parse()
                inside, at, stop = _block(pieces, at, ("endfor",))
                _closed(stop, "endfor")
                body.append(For(name, of, inside))
            elif word == "if":
                arms, test, other = [], e.parse(), False
                while True:
                    inside, at, stop = _block(pieces, at, ("elif", "else", "endif"))
                    arms.append((test, inside))
                    if stop == "endif":
                        break
                    if other or not stop:
                        raise TemplateError("endif is missing")
                    if stop == "else":
                        test, other = Const(True), True
                    else:
                        e = _Expressions(stop)
                        if e.name() != "elif":
                            raise TemplateError(f"endif expected, not {stop}")
                        test = e.parse()
                body.append(If(arms))
            elif word == "set":
                name = e.name()
                e.need("=")
                body.append(Set(name, e.parse()))
            elif word == "generation":
                inside, at, stop = _block(pieces, at, ("endgeneration",))
                _closed(stop, "endgeneration")
                body.append(Generation(inside))
            else:
                raise TemplateError(f"no such tag: {word}")
            e.end()
    return body, at, ""


def _closed(stop: str, word: str) -> None:
    if stop != word:
        raise TemplateError(f"{word} expected, not {stop or 'the end'}")


# --- folding


def fold(node: Any) -> Any:
    """The same tree with constant expressions computed, dead arms gone and texts joined."""
    if isinstance(node, list):
        out: list = []
        for x in map(fold, node):
            for y in x if isinstance(x, list) else [x]:
                if isinstance(y, Const) and out and isinstance(out[-1], Const):
                    out[-1] = Const(out[-1].value + y.value)
                else:
                    out.append(y)
        return out
    if isinstance(node, Print):
        of = fold(node.of)
        return Const(_text(of.value)) if isinstance(of, Const) else Print(of)
    if isinstance(node, If):
        arms = []
        for test, body in node.arms:
            test = fold(test)
            if isinstance(test, Const) and not test.value:
                continue
            arms.append((test, fold(body)))
            if isinstance(test, Const):
                break
        if arms and isinstance(arms[0][0], Const):
            return arms[0][1]
        return If(arms) if arms else []
    if isinstance(node, For):
        return For(node.name, fold(node.of), fold(node.body))
    if isinstance(node, Set):
        return Set(node.name, fold(node.of))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, (Item, Filter, Unary)):
        parts = {k: fold(v) if k != "name" else v for k, v in vars(node).items()}
        node = type(node)(**parts)
        if all(isinstance(v, Const) for k, v in parts.items() if k != "name"):
            return _constant(node)
        return node
    if isinstance(node, Binary):
        node = Binary(node.op, fold(node.left), fold(node.right))
        if isinstance(node.left, Const) and (isinstance(node.right, Const) or node.op in ("and", "or") and bool(node.left.value) == (node.op == "or")):
            return _constant(node)
    return node


def _constant(node: Any) -> Const:
    try:
        return Const(expression(node)({}))
    except TypeError as e:
        raise TemplateError(str(e)) from e


# --- closures


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def expression(node: Any) -> Callable[[Env], Any]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, n=node.name: env.get(n)
    if isinstance(node, Item):
        of, key = expression(node.of), expression(node.key)

        def item(env: Env) -> Any:
            x, k = of(env), key(env)
            if isinstance(x, dict):
                return x.get(k)
            return x[k] if isinstance(x, (list, str)) and isinstance(k, int) and -len(x) <= k < len(x) else None

        return item
    if isinstance(node, Filter):
        of, apply = expression(node.of), FILTERS[node.name]
        return lambda env: apply(of(env) if node.name == "length" else _text(of(env)))
    if isinstance(node, Unary):
        of = expression(node.of)
        return lambda env: not of(env)
    left, right = expression(node.left), expression(node.right)
    if node.op == "and":
        return lambda env: left(env) and right(env)
    if node.op == "or":
        return lambda env: left(env) or right(env)
    apply = (_JOIN | _COMPARE)[node.op]
    return lambda env: apply(left(env), right(env))


@dataclass
class Output:
    parts: list[str] = field(default_factory=list)
    size: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def put(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def statement(node: Any) -> Callable[[Env, Output], None]:
    if isinstance(node, list):
        steps = [statement(x) for x in node]

        def block(env: Env, out: Output) -> None:
            for step in steps:
                step(env, out)

        return block
    if isinstance(node, Const):
        return lambda env, out, v=node.value: out.put(v)
    if isinstance(node, Print):
        of = expression(node.of)
        return lambda env, out: out.put(_text(of(env)))
    if isinstance(node, Set):
        of = expression(node.of)
        return lambda env, out, n=node.name: env.__setitem__(n, of(env))
    if isinstance(node, If):
        arms = [(expression(test), statement(body)) for test, body in node.arms]

        def choose(env: Env, out: Output) -> None:
            for test, body in arms:
                if test(env):
                    return body(env, out)

        return choose
    if isinstance(node, For):
        of, body = expression(node.of), statement(node.body)

        def loop(env: Env, out: Output) -> None:
            rows = list(of(env) or [])
            for i, row in enumerate(rows):
                body(env | {node.name: row, "loop": {"index": i + 1, "index0": i, "first": i == 0, "last": i + 1 == len(rows)}}, out)

        return loop
    body = statement(node.body)

    def learned(env: Env, out: Output) -> None:
        begin = out.size
        body(env, out)
        out.spans.append((begin, out.size))

    return learned


def compile_template(source: str) -> Callable[[list[dict[str, str]]], tuple[str, list[tuple[int, int]]]]:
    """A function from messages to the formatted text and the spans of it that are learned."""
    run = statement(fold(parse(source)))

    def render(messages: list[dict[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        run({"messages": messages}, out)
        return "".join(out.parts), out.spans

    return render


#: Marks each turn; the learned text is an assistant's, without its marks.
TEMPLATE = """\
{%- for m in messages -%}
{{ '<|im_start|>' ~ (m.role | escape_role) ~ '\\n' }}
{%- if m.role == 'assistant' -%}
{%- generation -%}{{ m.text | escape }}{%- endgeneration -%}
{%- else -%}{{ m.text | escape }}{%- endif -%}
{{ '<|im_end|>' ~ '\\n' }}
{%- endfor -%}
"""
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns in a text that TEMPLATE formatted."""
    turns, at = [], 0
    while m := _TURN.match(formatted, at):
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not made by this template")
    return turns


def format_chats(rows: DataFrame, template: str = TEMPLATE, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, n_turns, formatted, spans (array of begin, end code points) of each conversation.

    Turns are sorted within partitions by turn, role and text, null first; a
    worker holds one conversation's turns, as its formatted text is one value
    anyway. Null roles and texts are empty; rows with no conversation id are one
    conversation; repeated rows are turns of their own; an empty table gives no rows.
    """
    compile_template(template)  # a bad template fails here, on the driver
    dealt = rows.select(F.col(conv).alias("c"), F.col(turn).alias("n"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    dealt = dealt.repartition("c").sortWithinPartitions("c", "n", "r", "t")
    kind = dealt.schema["c"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        ready: list[tuple[Any, int, str, list]] = []
        now: Any = None
        turns: list[dict[str, str]] = []
        held = 0

        def close() -> None:
            nonlocal held
            if turns:
                ready.append((now, len(turns), *render(turns)))
                held += len(ready[-1][2])

        def flush() -> pa.RecordBatch:
            nonlocal held
            held = 0
            columns = list(zip(*ready, strict=True))
            spans = pa.array([[{"begin": a, "end": b} for a, b in x] for x in columns[3]], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], key), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), spans], ["c", "n_turns", "formatted", "spans"])

        for batch in batches:
            key = batch.schema.field(0).type
            for c, r, t in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if turns and c != now:
                    close()
                    turns = []
                now = c
                turns.append({"role": r, "text": t})
                if held > 1 << 22:
                    yield flush()
                    ready.clear()
        close()
        if ready:
            yield flush()

    return dealt.mapInArrow(tidy(run), f"c {kind}, n_turns long, formatted string, spans array<struct<begin:long,end:long>>").withColumnRenamed("c", conv)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    made = format_chats(rows.unionByName(probe))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for c, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                turns = read_back(text)
                learned = "".join(unescape(text[x["begin"] : x["end"]]) for x in spans)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((c, len(turns), _sha(whole), len(learned), _sha(learned), len(text)))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = made.schema["conv_id"].dataType.simpleString()
    return made.select("conv_id", "formatted", "spans").mapInArrow(tidy(digest), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
