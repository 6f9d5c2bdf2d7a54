"""Reports for people. Rows come to the driver: a page is read, not a cluster's output."""

from __future__ import annotations

from pyspark.sql import Row

COLOURS = {"low": 32, "medium": 33, "high": 35, "critical": 31, "covered": 32, "gap": 31, "indeterminate": 33, "no-rules": 90}


def paint(word: str, colour: bool) -> str:
    return f"\x1b[{COLOURS.get(word, 0)}m{word.upper()}\x1b[0m" if colour else word.upper()


def plural(n: int, word: str) -> str:
    return f"{n} {word}{'' if n == 1 else 's'}"


def report(r: Row, colour: bool = False) -> str:
    """One report: findings loudest first, with what each would leave and what would see it."""
    out = [f"{r.src} — {r.platform}", r.note, f"{plural(len(r.findings), 'finding')} on {plural(r.lines_analyzed, 'line')}, loudest {r.max_noise}", ""]
    for f in r.findings:
        out.append(f"{paint(f.severity, colour)} {f.noise:3d}  L{f.line}  {f.rule_id}: {f.description}")
        out += [f"      ATT&CK {t.id} {t.name}" for t in f.techniques]
        out += [f"      leaves: {t}" for t in f.telemetry]
        out += [f"      seen: {s['class']}: {s.detail}" for s in f.observed_side_effects]
        out += [f"      {d.source}: {d.rule} ({d.confidence}){' — ' + d.verdict if d.verdict else ''}" for d in f.detections]
        for e in (f.edr or []) if "edr" in f else []:
            out.append(f"      {e.vendor}: {', '.join(e.events)}")
    out.append("A line without a finding is not shown to be unseen.")
    return "\n".join(out) + "\n"


def coverage(rows: list[Row], colour: bool = False) -> str:
    out = [f"{paint(r.coverage, colour):14s} L{r.line}  {r.rule_id}: {r.description}{'  [' + '; '.join(r.firing) + ']' if r.firing else ''}" for r in rows]
    tally = {s: sum(r.coverage == s for r in rows) for s in ("covered", "gap", "indeterminate", "no-rules")}
    return "\n".join([*out, ", ".join(f"{n} {s}" for s, n in tally.items())]) + "\n"


def verified(rows: list[Row], colour: bool = False) -> str:
    out = [f"{paint(r.status, colour):16s} {r.id}: {r.description}" for r in rows]
    return "\n".join(out) + "\n"


def delta(rows: list[Row]) -> str:
    """Added, removed and changed rules, or the like, one a line."""
    name = lambda r: r["rule_id"] if "rule_id" in r else r["id"]
    return "\n".join(f"{r['change']:12s} {name(r)}" for r in rows) + ("\n" if rows else "no change\n")


def short_ref(ref: str) -> str:
    """The first 12 digits of a commit's 40; anything else whole."""
    return ref[:12] if len(ref) == 40 and all(c in "0123456789abcdefABCDEF" for c in ref) else ref
