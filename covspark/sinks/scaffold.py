"""Starter rules in YAML that mirror how an entry of the knowledge base matches."""

from __future__ import annotations

import datetime
import hashlib
import itertools
import textwrap
import uuid
from dataclasses import dataclass, field

from ..fixed import CLASS_CATEGORY
from ..operators.kb import KnowledgeBase
from ..operators.matcher import ARG_LEAVES, LINE_LEAVES, Entry, _literal, _programs, event_field
from ..operators.verdict import PRODUCT

MODIFIER = {"eq": "", "contains": "|contains", "prefix": "|startswith", "suffix": "|endswith", "regex": "|re", "word": "|contains", "path_under": "|startswith"}


@dataclass
class Selection:
    """What of a matcher's command axes one selection can say; simplified where it can't say all."""

    programs: list[str] = field(default_factory=list)
    every: list[str] = field(default_factory=list)
    some: list[str] = field(default_factory=list)
    patterns: list[str] = field(default_factory=list)
    simplified: bool = False

    def lower(self, pred: dict, leaves: set[str]) -> None:
        kind, value = next(iter(pred.items()))
        if kind == "all":
            for p in value:
                self.lower(p, leaves)
        elif kind == "any":
            literals = [next(iter(p.values())) if next(iter(p)) in leaves else None for p in value]
            if None in literals:
                self.simplified = True
                self.lower(value[0], leaves)
            elif self.some:
                self.simplified = True
            else:
                self.some = literals
        elif kind == "not":
            self.simplified = True
        elif kind in ("at", "joined"):
            inner = value["value"] if kind == "at" else value
            if (x := _literal(inner)) is None:
                self.patterns.append(inner["regex"])
            else:
                self.every.append(x)
        elif kind == "regex":
            self.patterns.append(value)
        else:
            self.every.append(value)


def selection(entry: Entry) -> Selection:
    out = Selection(_programs(entry.match))
    if "args" in entry.match:
        out.lower(entry.match["args"], ARG_LEAVES)
    if "line" in entry.match:
        out.lower(entry.match["line"], LINE_LEAVES)
    out.simplified |= bool(out.every and out.some)
    return out


Block = dict[tuple[str, str], list[str]]  # (field, modifier): values


def event_blocks(pred: dict, notes: list[str]) -> list[Block]:
    """The event axis as alternatives of fields that all hold; notes say where they are wider than it."""
    for kind in ("all", "any"):
        if kind in pred:
            parts = [event_blocks(p, notes) for p in pred[kind]]
            if kind == "any":
                return [b for alternatives in parts for b in alternatives]
            out = []
            for combination in itertools.product(*filter(None, parts)):
                whole: Block = {}
                for key, values in (x for b in combination for x in b.items()):
                    same = next((k for k in whole if (k[0].lower(), k[1]) == (key[0].lower(), key[1])), key)
                    whole[same] = list(dict.fromkeys([*whole.get(same, []), *values]))
                out.append(whole)
            return out
    if "not" in pred:
        notes.append("A `not` was dropped: a selection is a positive test, so this rule matches more than the entry does.")
        return []
    name, kind, value = event_field(pred)
    if kind == "word":
        notes.append(f"`{name}` tests `word: {value}`; there is no word-boundary modifier, so `|contains` stands in and also matches inside longer words.")
    if kind == "path_under":
        notes.append(f"`{name}` tests `path_under: {value}`; there is no segment-aware modifier, so `|startswith` stands in and also matches paths that merely share the prefix.")
    return [{(name, MODIFIER[kind]): [value]}]


def _folded(block: Block) -> dict[tuple[str, str], tuple[str, str]]:
    """A block's keys by field in lower case and modifier."""
    return {(field.lower(), modifier): (field, modifier) for field, modifier in block}


def merged(blocks: list[Block]) -> list[tuple[Block, set[tuple[str, str]]]]:
    """Blocks that differ in the alternatives of one key become one, until none do; with each, the keys whose values must all hold."""
    out = [({k: list(v) for k, v in b.items()}, {k for k, v in b.items() if len(v) > 1}) for b in blocks]
    while True:
        for (i, (have, must)), (j, (more, also)) in itertools.combinations(enumerate(out), 2):
            own, other = _folded(have), _folded(more)
            if own.keys() != other.keys() or {k for k in own if own[k] in must} != {k for k in other if other[k] in also}:
                continue
            differing = [k for k in own if set(have[own[k]]) != set(more[other[k]])]
            if len(differing) <= 1 and not any(own[k] in must for k in differing):
                for k in differing:
                    have[own[k]] = list(dict.fromkeys([*have[own[k]], *more[other[k]]]))
                del out[j]
                break
        else:
            return out


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(key: str, values: list[str], all_of: bool, plain_numbers: bool = False) -> list[str]:
    show = lambda v: v if plain_numbers and v.isascii() and v.isdigit() and len(v) <= 19 and (v == "0" or v[0] != "0") else _quote(v)
    if not values:
        return []
    if len(values) == 1:
        return [f"        {key}: {show(values[0])}"]
    return [f"        {key}{'|all' if all_of else ''}:", *(f"            - {show(v)}" for v in values)]


def _note(text: str, indent: int) -> list[str]:
    pad = " " * indent
    return textwrap.wrap("NOTE: " + text, 78, initial_indent=f"{pad}# ", subsequent_indent=f"{pad}# ", break_long_words=False, break_on_hyphens=False)


def placeholder_id(seed: str) -> str:
    """A version 4 UUID that the same entry always has."""
    return str(uuid.UUID(bytes=hashlib.sha256(f"{seed}::scaffold".encode()).digest()[:16], version=4))


def title(description: str) -> str:
    base = description.split("—")[0].strip()
    return base[:1].upper() + base[1:] or "Scaffold"


def level(noise: int) -> str:
    return ("low", "medium", "high", "critical")[min(noise // 25, 3)]


def _document(entry: Entry, product: str, date: str, category: str, suffix: str, seed: str, detection: list[str], condition: str) -> str:
    lines = [
        "# A starter rule that mirrors how this action is matched. Refine the TODO fields",
        "# and tighten the detection before it is used.",
        f"title: {_quote(title(entry.description) + suffix)}",
        f"id: {placeholder_id(seed)}   # generated placeholder; regenerate",
        "status: experimental",
        "description: |",
        f"    {entry.description}",
        "references:",
        *(f"    - https://attack.mitre.org/techniques/{t['id'].replace('.', '/')}/" for t in entry.techniques),
        "author: 'TODO: your name'",
        f"date: {date}",
        "tags:",
        *(f"    - attack.{t['id'].lower()}" for t in entry.techniques),
        "    # TODO: add the tactic's tag",
        "logsource:",
        f"    category: {category}",
        f"    product: {product}",
        "detection:",
        *detection,
        f"    condition: {condition}",
        "falsepositives:",
        "    - Unknown",
        f"level: {level(entry.noise)}",
    ]
    return "\n".join(lines) + "\n"


def documents(entry: Entry, platform: str, date: str | None = None) -> list[str]:
    """A rule for the command axes and one for the event axis, which is another log source."""
    date = date or datetime.date.today().isoformat()
    product, out = PRODUCT[platform], []
    own = selection(entry)
    image = [f"\\{p}.exe" if platform == "windows-sysmon" else f"/{p}" for p in own.programs]
    words, all_of = (own.some, False) if own.some and not own.every else (own.every, True)
    body = [*_values("Image|endswith", image, False), *_values("CommandLine|contains", words, all_of), *_values("CommandLine|re", own.patterns, False)]
    blocks, notes = [], []
    if "event" in entry.match:
        blocks = merged([b for b in event_blocks(entry.match["event"], notes) if b])
    if body or not blocks:
        if own.simplified:
            body = _note("this matcher alternates or nests in ways that one selection can't mirror; some alternatives may be missing.", 8) + body
        out.append(_document(entry, product, date, "process_creation", "", entry.id, ["    selection:", *(body or ["        # TODO: nothing on this entry can be matched; define the selection"])], "selection"))
    if blocks:
        kind = entry.match["event"]["class"].lower()
        lines, names = [x for n in notes for x in _note(n, 4)], []
        for i, (block, must) in enumerate(blocks):
            names.append("selection" if not i else f"selection_{i}")
            lines.append(f"    {names[-1]}:")
            for key, values in block.items():
                lines += _values("".join(key), values, key in must, plain_numbers=key[1] == "")
        out.append(_document(entry, product, date, CLASS_CATEGORY[kind], f" ({kind} event)", f"{entry.id}#{kind}", lines, " or ".join(names)))
    return out


def entries_by_ids(kb: KnowledgeBase, ids: list[str]) -> list[Entry]:
    """Entries named, once each, in the order they are named; unknown ids are passed over."""
    by_id = {e.id: e for e in kb.entries}
    return [by_id[i] for i in dict.fromkeys(ids) if i in by_id]


