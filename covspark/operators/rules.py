"""Detection rules in YAML: documents, searches and conditions, read into small trees."""

from __future__ import annotations

import base64
import dataclasses
import ipaddress
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import yaml

from ..fixed import AUDIT_FIELDS, DASHES
from ..functions.dialect import translate

COMPARISONS = {"contains", "startswith", "endswith", "re", "cidr"}


@dataclass
class FieldTest:
    """`field|modifier...: values`, with its values expanded.

    groups holds for each value the alternatives that a transform made of it.
    unsupported names modifiers that leave the test unanswered.
    """

    key: str
    values: list[str]
    field: str = ""
    op: str = "glob"
    all: bool = False
    case: bool = False
    groups: list[list[str]] = dataclasses.field(default_factory=list)
    unsupported: list[str] = dataclasses.field(default_factory=list)

    def __post_init__(self) -> None:
        self.field, *tokens = self.key.split("|")
        flags, chosen, steps = set(), None, []
        at = 0
        while at < len(tokens):
            token = tokens[at]
            at += 1
            if token in COMPARISONS:
                own = set()
                while token == "re" and at < len(tokens) and tokens[at] in ("i", "m", "s"):
                    own.add(tokens[at])
                    at += 1
                if chosen is None:
                    chosen, flags = token, own
                else:
                    self.unsupported.append(token)
            elif token == "all":
                self.all = True
            elif token in TRANSFORMS:
                steps.append(token)
            else:
                self.unsupported.append(token)
        self.op = chosen or "glob"
        self.case = "base64offset" in steps
        if self.op in ("re", "cidr"):
            made = [translate(v, "m" in flags, "s" in flags) if self.op == "re" else network(v) for v in self.values]
            if steps or None in made:
                self.unsupported.append(self.op)
            else:
                self.groups = [[v] for v in made]
        else:
            for value in self.values:
                group: list[str] | None = [value]
                for step in steps:
                    made = [TRANSFORMS[step](v) for v in group]
                    if None in made:
                        self.unsupported.append(step)
                        group = None
                        break
                    group = list(dict.fromkeys(x for m in made for x in m))
                if group is None:
                    break
                self.groups.append(group)

    @property
    def answered(self) -> bool:
        return not self.unsupported and bool(self.values)


def network(value: str) -> str | None:
    """The leading bits, of 128, that an address in the network has; None if it isn't one.

    IPv4 counts as mapped into IPv6, so 0.0.0.0/0 holds IPv4 only and ::/0 everything.
    """
    address, _, prefix = (x.strip() for x in value.strip().partition("/"))
    try:
        ip = ipaddress.ip_address(address)
        if "%" in address or ("/" in value and not re.fullmatch(r"\+?[0-9]+", prefix)):
            return None
        size = int(prefix) if "/" in value else ip.max_prefixlen
    except ValueError:
        return None
    return address_bits(ip)[: size + 128 - ip.max_prefixlen] if size <= ip.max_prefixlen else None


def address_bits(ip: ipaddress.IPv4Address | ipaddress.IPv6Address) -> str:
    number = int(ip) + (0xFFFF << 32) * (ip.version == 4)
    return f"{number:0128b}"


def windash(value: str) -> list[str]:
    """value with each dash or slash that follows no word character as every dash form."""
    site = re.compile(r"(?<![^\W])[-/]")
    return list(dict.fromkeys(site.sub(d, value) for d in DASHES)) if site.search(value) else [value]


def base64offset(value: str) -> list[str] | None:
    """What base64 makes of value at each of three alignments, without the characters neighbours share."""
    raw = value.encode()
    if len(raw) < 3:
        return None
    out = []
    for shift in range(3):
        text = base64.b64encode(b" " * shift + raw).decode()
        first = -(-8 * shift // 6)
        out.append(text[first : 8 * (shift + len(raw)) // 6])
    return out


TRANSFORMS = {"windash": windash, "base64offset": base64offset}


@dataclass
class Keywords:
    values: list[str]
    all: bool = False


Search = list[list[FieldTest]] | Keywords  # alternatives of conjunctions


@dataclass
class Rule:
    id: str
    title: str
    searches: dict[str, Search]
    condition: tuple

    def tests(self) -> Iterator[FieldTest]:
        for s in self.searches.values():
            if not isinstance(s, Keywords):
                for group in s:
                    yield from group

    @property
    def fields(self) -> list[str]:
        """Names that the rule asks for anywhere, not only where its verdict turned."""
        own = {t.field for t in self.tests()}
        if any(isinstance(s, Keywords) for s in self.searches.values()):
            own.add("CommandLine")
        return sorted(own)

    @property
    def blocking(self) -> list[str]:
        """Modifiers that can leave a test unanswered; cidr can, on a value that is no address."""
        return sorted({m for t in self.tests() for m in [*t.unsupported, *(["cidr"] if t.op == "cidr" and t.answered else [])]})

    @property
    def null_value(self) -> bool:
        return any(not t.values for t in self.tests())

    @property
    def audit_shaped(self) -> bool:
        return any(f in AUDIT_FIELDS or re.fullmatch(r"a[0-9]+", f) for f in self.fields)


def _scalar(value: Any) -> str | None:
    if isinstance(value, bool):
        return str(value).lower()
    return str(value) if isinstance(value, str | int | float) else None


def _scalars(value: Any) -> list[str]:
    return [s for v in (value if isinstance(value, list) else [value]) if (s := _scalar(v)) is not None]


def _search(value: Any) -> Search | None:
    tests = lambda m: [FieldTest(k, _scalars(v)) for k, v in m.items() if isinstance(k, str)]
    if isinstance(value, dict):
        if len(value) == 1:
            key, own = next(iter(value.items()))
            if isinstance(key, str) and re.fullmatch(r"(\|all)*", key) and isinstance(own, list):
                return Keywords(_scalars(own), key != "")
        return [tests(value)]
    if isinstance(value, list):
        return [tests(m) for m in value] if value and all(isinstance(m, dict) for m in value) else Keywords(_scalars(value))
    return None


class _Condition:
    """or < and < not < brackets, names, `N of x`, `all of x`; trees are tuples."""

    def __init__(self, text: str):
        self.words = re.findall(r"[()]|[^\s()]+", text)

    def tree(self) -> tuple:
        out = self.chain("or", lambda: self.chain("and", self.inverse))
        if self.words:
            raise ValueError(self.words[0])
        return out

    def chain(self, word: str, part) -> tuple:
        parts = [part()]
        while self.words[:1] == [word]:
            self.words.pop(0)
            parts.append(part())
        return parts[0] if len(parts) == 1 else (word, *parts)

    def inverse(self) -> tuple:
        if self.words[:1] == ["not"]:
            self.words.pop(0)
            return ("not", self.inverse())
        return self.primary()

    def primary(self) -> tuple:
        word = self.words.pop(0)
        if word == "(":
            inner = self.chain("or", lambda: self.chain("and", self.inverse))
            if self.words.pop(0) != ")":
                raise ValueError(word)
            return inner
        if word == "all" or word.isascii() and word.isdigit():
            if self.words.pop(0) != "of":
                raise ValueError(word)
            return ("of", None if word == "all" else int(word), self.words.pop(0))
        return ("id", word)


def condition(text: str) -> tuple | None:
    try:
        return _Condition(text).tree()
    except (ValueError, IndexError):
        return None


def rule_of(document: Any) -> Rule | None:
    """The logic of a rule document, or None if any of it can't be read."""
    detection = document.get("detection") if isinstance(document, dict) else None
    if not isinstance(detection, dict) or not all(isinstance(k, str) for k in detection) or not isinstance(detection.get("condition"), str):
        return None
    tree = condition(detection["condition"])
    searches = {k: s for k, v in detection.items() if k != "condition" and (s := _search(v)) is not None}
    name = lambda k: v if isinstance(v := document.get(k), str) else ""
    return Rule(name("id"), name("title"), searches, tree) if tree else None


class _Loader(yaml.SafeLoader):
    """Plain scalars but numbers, booleans and null stay text: rules have dates, and no use for them."""


_Loader.yaml_implicit_resolvers = {k: [x for x in v if x[0] != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}


def documents(text: str) -> Iterator[dict]:
    """The documents of a YAML stream; one that can't be read is passed over."""
    for part in re.split(r"(?m)^---[ \t]*(?:#.*)?$", text):
        try:
            value = yaml.load(part, _Loader)
        except yaml.YAMLError:
            continue
        if isinstance(value, dict):
            yield value


def parse_rule(text: str) -> Rule | None:
    return next((rule_of(d) for d in documents(text)), None)


def technique(tag: str) -> str | None:
    """T1059.001 of attack.t1059.001."""
    m = re.fullmatch(r"attack\.[tT]([0-9.]+)", tag)
    return "T" + m[1] if m else None


def header(document: dict, product: str) -> dict | None:
    """What the index keeps of a document, or None: of another product, or without id or title."""
    source = document.get("logsource") if isinstance(document.get("logsource"), dict) else {}
    text = lambda v, other="": v if isinstance(v, str) else other
    declared = source.get("product")
    if isinstance(declared, str) and declared.lower() != product.lower():
        return None
    if not isinstance(document.get("id"), str) or not isinstance(document.get("title"), str):
        return None
    tags = [t for t in document.get("tags") or [] if isinstance(t, str)] if isinstance(document.get("tags"), list) else []
    return {"rule_id": document["id"], "title": document["title"], "level": text(document.get("level"), "medium"), "category": text(source.get("category")), "techniques": [x for t in tags if (x := technique(t))]}
