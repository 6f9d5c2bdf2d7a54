"""Knowledge-base matchers compiled to Spark SQL text.

Expressions read these columns: commands (array of COMMAND), pairs (structs of
each command c and its lower-cased copy l), raw and lraw for lines; class and lfields (a map with lower-cased
keys and its values as recorded) for events. They are two-valued: a missing
field is false at its leaf, so `not` of it is true.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from ..fixed import CLASS_CATEGORY
from ..functions import sql
from ..functions.dialect import translate


class MatcherError(ValueError):
    """The matcher is not in the schema."""


_TEXT: dict[str, Callable[[str, str], str]] = {"eq": sql.equal, "contains": sql.contains, "prefix": sql.prefix, "suffix": sql.suffix, "word": sql.word, "path_under": sql.path_under}
ARG_LEAVES = {"flag", "eq", "contains", "prefix", "suffix", "word", "path_under"}
LINE_LEAVES = {"contains", "word", "prefix", "suffix"}
STRING_LEAVES = {"eq", "contains", "prefix", "suffix", "word"}
EVENT_LEAVES = {"eq", "contains", "prefix", "suffix", "word", "path_under"}
GROUPS = {"all": sql.every, "any": sql.some}


def _one(pred: Any, where: str) -> tuple[str, Any]:
    if not isinstance(pred, dict) or len(pred) != 1:
        raise MatcherError(f"{where}: one key expected in {pred!r}")
    return next(iter(pred.items()))


def _regex(text: str, pattern: str) -> str:
    java = translate(pattern)
    if java is None:
        raise MatcherError(f"unsupported pattern {pattern!r}")
    return f"{text} RLIKE {sql.lit(java)}"


def leaf(pred: dict, low: str, text: str) -> str:
    """A leaf on one string: low is the lower-cased expression, text the original."""
    kind, value = _one(pred, "leaf")
    if kind == "regex":
        return _regex(text, value)
    if kind not in STRING_LEAVES:
        raise MatcherError(f"no such leaf: {kind}")
    return _TEXT[kind](low, value)


def arguments(pred: dict, low: str = "p.l.args", args: str = "p.c.args") -> str:
    kind, value = _one(pred, "args")
    if kind in GROUPS:
        return GROUPS[kind](arguments(p, low, args) for p in value)
    if kind == "not":
        return sql.negate(arguments(value, low, args))
    if kind == "at":
        if set(value) != {"index", "value"}:
            raise MatcherError(f"at: {value!r}")
        return f"coalesce({leaf(value['value'], f'get({low}, {int(value["index"])})', f'get({args}, {int(value["index"])})')}, false)"
    if kind == "joined":
        return leaf(value, f"array_join({low}, ' ')", f"array_join({args}, ' ')")
    if kind == "regex":
        return f"exists({args}, a -> {_regex('a', value)})"
    if kind not in ARG_LEAVES:
        raise MatcherError(f"no such leaf: {kind}")
    return f"exists({low}, a -> {_TEXT['eq' if kind == 'flag' else kind]('a', value)})"


def line(pred: dict, low: str = "lraw", raw: str = "raw") -> str:
    kind, value = _one(pred, "line")
    if kind in GROUPS:
        return GROUPS[kind](line(p, low, raw) for p in value)
    if kind == "not":
        return sql.negate(line(value, low, raw))
    if kind == "regex":
        return _regex(raw, value)
    if kind not in LINE_LEAVES:
        raise MatcherError(f"no such leaf: {kind}")
    return _TEXT[kind](low, value)


def event_field(pred: dict) -> tuple[str, str, str]:
    """(field, kind, value) of an event leaf; raises unless it tests exactly one thing."""
    keys = set(pred) - {"field", "class"}
    if "field" not in pred or not pred["field"]:
        raise MatcherError(f"event predicate without a field: {pred!r}")
    if len(keys) != 1 or not keys <= EVENT_LEAVES | {"regex"}:
        raise MatcherError(f"event field {pred['field']!r} must set one predicate, has {sorted(keys)}")
    kind = keys.pop()
    if not pred[kind]:
        raise MatcherError(f"event field {pred['field']!r} has an empty predicate")
    return pred["field"], kind, pred[kind]


def event(pred: dict) -> str:
    groups = [k for k in ("all", "any", "not") if k in pred]
    if groups:
        if len(groups) > 1 or set(pred) - {"class", *groups}:
            raise MatcherError(f"event group: {pred!r}")
        kind = groups[0]
        if kind == "not":
            return sql.negate(event(pred["not"]))
        if not pred[kind]:
            raise MatcherError("an event group is empty")
        return GROUPS[kind](map(event, pred[kind]))
    name, kind, value = event_field(pred)
    at = f"lfields[{sql.lit(name.lower())}]"
    test = _regex(at, value) if kind == "regex" else _TEXT[kind](f"lower({at})", value)
    return f"coalesce({test}, false)"


def event_match(pred: dict) -> str:
    if pred.get("class", "").lower() not in CLASS_CATEGORY:
        raise MatcherError(f"no such event class: {pred.get('class')!r}")
    return f"(lower(class) = {sql.lit(pred['class'].lower())} AND {event(pred)})"


def _programs(match: dict) -> list[str]:
    program = match.get("program")
    return [] if program is None else [program] if isinstance(program, str) else list(program["any"])


def line_match(match: dict) -> str | None:
    """The command that satisfies the matcher in a struct, or NULL; None if it can match no line.

    With a program, the first command for which program, args and line hold.
    Without, line alone decides and args are ignored; the first command is attached.
    """
    on_line = line(match["line"]) if "line" in match else None
    if "program" in match:
        tests = [f"p.l.program IN ({', '.join(sql.lit(p.lower()) for p in _programs(match))})"]
        if "args" in match:
            tests.append(arguments(match["args"]))
        body = f"get(filter(pairs, p -> {sql.every(tests)}), 0).c"
        found = f"if({body} IS NULL, NULL, named_struct('command', {body}))"
        return found if on_line is None else f"if({on_line}, {found}, NULL)"
    if on_line is None:
        return None
    return f"if({on_line}, named_struct('command', get(commands, 0)), NULL)"


def raw_test(match: dict) -> str | None:
    """What must hold of a line's text for line_match to match, and all that must if there is no program.

    A program is named in the text of its line, if no quote splits its name.
    """
    on_line = line(match["line"]) if "line" in match else None
    if "program" not in match:
        return on_line
    named = [f"contains(lraw, {sql.lit(p.lower())})" for p in _programs(match)]
    return sql.every([sql.some([*named, "contains(raw, '\"')", "contains(raw, '\\'')"]), *([on_line] if on_line else [])])


@dataclass
class Entry:
    """A knowledge-base entry, checked."""

    id: str
    match: dict
    description: str
    techniques: list[dict]
    telemetry: list[str]
    detections: list[dict]
    noise: int
    example: str | None = None
    warnings: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        unknown = set(self.match) - {"program", "args", "line", "event"}
        if unknown:
            raise MatcherError(f"{self.id}: unknown keys {sorted(unknown)}")
        if not 0 <= self.noise <= 100:
            raise MatcherError(f"{self.id}: noise {self.noise}")
        if has_regex(self.match) and not self.example:
            raise MatcherError(f"{self.id}: a regex needs an example")
        if "args" in self.match and "program" not in self.match:
            self.warnings.append(f"{self.id}: args without a program are ignored")
        self.on_line = line_match(self.match)
        self.raw_test = raw_test(self.match)
        self.raw_only = "program" not in self.match
        self.on_event = event_match(self.match["event"]) if "event" in self.match else None
        if self.on_event and not representative_event(self.match):
            raise MatcherError(f"{self.id}: its event has nothing positive to stand for it")


def has_regex(match: dict) -> bool:
    def inside(x: Any) -> bool:
        if isinstance(x, dict):
            return "regex" in x or any(map(inside, x.values()))
        return isinstance(x, list) and any(map(inside, x))

    return any(inside(match.get(k)) for k in ("args", "line"))


# --- what an entry stands for: a line and a record made of its literals


def _literal(pred: dict) -> str | None:
    kind, value = _one(pred, "leaf")
    return None if kind == "regex" else value


def _argument_terms(pred: dict) -> tuple[dict[int, str], list[str]]:
    kind, value = _one(pred, "args")
    placed: dict[int, str] = {}
    loose: list[str] = []
    if kind in GROUPS:
        for p in value if kind == "all" else value[:1]:
            a, b = _argument_terms(p)
            placed |= a
            loose += b
    elif kind == "at":
        if (x := _literal(value["value"])) is not None:
            placed[value["index"]] = x
    elif kind == "joined":
        loose += [x] if (x := _literal(value)) is not None else []
    elif kind in ARG_LEAVES:
        loose.append(value)
    return placed, loose


def _line_terms(pred: dict) -> list[str]:
    kind, value = _one(pred, "line")
    if kind in GROUPS:
        return [t for p in (value if kind == "all" else value[:1]) for t in _line_terms(p)]
    return [value] if kind in LINE_LEAVES else []


def representative_line(entry: Entry) -> str | None:
    """The example, or a line of the matcher's literals; gaps before a fixed position hold `_`."""
    if entry.example:
        return entry.example
    parts = _programs(entry.match)[:1]
    if "args" in entry.match:
        placed, loose = _argument_terms(entry.match["args"])
        rest = iter(loose)
        parts += [placed[i] if i in placed else next(rest, "_") for i in range(max(placed, default=-1) + 1)]
        parts += rest
    if "line" in entry.match:
        parts += _line_terms(entry.match["line"])
    return " ".join(parts).strip() or None


def representative_event(match: dict) -> tuple[str, dict[str, str]] | None:
    """(class, fields) made of the event axis's literals, one value for each field."""
    if "event" not in match:
        return None
    found: dict[str, tuple[str, dict]] = {}

    def gather(pred: dict) -> None:
        for kind in ("all", "any"):
            if kind in pred:
                for p in pred[kind] if kind == "all" else pred[kind][:1]:
                    gather(p)
                return
        if "not" in pred:
            return
        name, kind, value = event_field(pred)
        parts = found.setdefault(name.lower(), (name, {"middle": []}))[1]
        if kind in ("eq", "prefix", "suffix"):
            parts[kind] = value
        elif kind in ("contains", "word"):
            parts["middle"].append(value)
        elif kind == "path_under":
            parts["middle"].append(value.rstrip("/") + "/_")

    gather(match["event"])
    fields = {name: text for name, parts in found.values() if (text := _compose(parts))}
    return (match["event"]["class"].lower(), fields) if fields else None


def _compose(parts: dict) -> str:
    """One value that satisfies all parts; a slash keeps two words from fusing."""
    if "eq" in parts:
        return parts["eq"]
    out = ""
    for piece in filter(None, [parts.get("prefix"), *parts["middle"], parts.get("suffix")]):
        fuse = out and (out[-1].isascii() and (out[-1].isalnum() or out[-1] == "_")) and (piece[0].isascii() and (piece[0].isalnum() or piece[0] == "_"))
        out += ("/" if fuse else "") + piece
    return out
