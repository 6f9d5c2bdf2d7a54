"""Fields of telemetry records, as Spark SQL text; only free-form JSON needs Python."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import EVENT_FIELDS
from .sql import lit

FIELDS = "map<string,string>"


# --- JSON


def json_records(text: str) -> list[str]:
    """The records of an array, one object, or one JSON value a line; anything else raises."""
    head = text.lstrip()
    if head.startswith("["):
        return [json.dumps(x) for x in json.loads(text)]
    if head.startswith("{"):
        try:
            return [json.dumps(json.loads(text))]
        except ValueError:
            pass
    out = []
    for n, line in enumerate(text.split("\n"), 1):
        if line.strip():
            try:
                json.loads(line)
            except ValueError as e:
                raise ValueError(f"invalid JSON on line {n}: {e}") from e
            out.append(line.strip())
    if not out:
        raise ValueError("no telemetry records found")
    return out


def json_records_column(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(json_records)

    return run(text)


_CANONICAL = {f.lower(): f for f in EVENT_FIELDS} | {"event_id": "EventID"}
DEPTH = 4


def _plain(value: object) -> str | None:
    if isinstance(value, bool):
        return str(value).lower()
    return value if isinstance(value, str) else str(value) if isinstance(value, int | float) else None


def _levels(value: dict) -> Iterator[tuple[str, object]]:
    """(name, scalar) of an event, a level before the levels inside it; of equal names the first counts."""

    def inside(v: object, depth: int) -> Iterator[tuple[str, object]]:
        if not isinstance(v, dict) or depth > DEPTH:
            return
        yield from v.items()
        for x in v.values():
            for y in x if isinstance(x, list) else [x]:
                if isinstance(x, list) and isinstance(y, dict):
                    name = next((y[k] for k in ("@Name", "Name") if k in y), None)
                    content = next((y[k] for k in ("#text", "text") if k in y), None)
                    if isinstance(name, str) and content is not None:
                        yield name, content
                        continue
                yield from inside(y, depth + 1)

    return inside(value, 0)


def flatten(record: str) -> dict[str, str]:
    """All scalars of an event as text, under their canonical names."""
    out: dict[str, str] = {}
    for name, value in _levels(json.loads(record)):
        if (text := _plain(value)) is not None:
            out.setdefault(_CANONICAL.get(name.lower(), name), text)
    return out


def flatten_column(record: Column) -> Column:
    """The depth of an event is anything, so a walk in Python, by Arrow batches."""

    @F.pandas_udf(FIELDS)
    def run(records: pd.Series) -> pd.Series:
        return records.map(flatten)

    return run(record)


# --- key=value records


def pairs(line: str) -> str:
    """map of key=value pairs; values may be quoted; the last of equal keys wins (under LAST_WIN)."""
    found = f"regexp_extract_all({line}, {lit('[^ =]*=(?:\"[^\"]*\"?|[^ ]*)|[^ ]+')}, 0)"
    return f"map_from_entries(transform(filter({found}, p -> contains(p, '=')), p -> named_struct('k', substring_index(p, '=', 1), 'v', substring(p, locate('=', p) + 1))))"


def decoded(value: str) -> str:
    """A value without its quotes, or the text of an even number of hex digits, or as it is."""
    v = f"trim({value})"
    text = f"cast(unhex(regexp_replace({v}, '(00)+$', '')) as string)"
    return f"""CASE WHEN {v} RLIKE '^(?s)".*"$' AND length({v}) >= 2 THEN substring({v}, 2, length({v}) - 2)
        WHEN {v} RLIKE '^([0-9A-Fa-f][0-9A-Fa-f])+$' AND is_valid_utf8({text}) THEN {text} ELSE {v} END"""


def event_id(msg: str) -> str:
    return f"nullif(regexp_extract({msg}, {lit(r'audit\(([^)]*)\)')}, 1), '')"


def quoted_argument(text: str) -> str:
    """An argument as a shell would take it: bare if it can be, else in the quotes that it lacks."""
    return f"""CASE WHEN {text} RLIKE '^[-A-Za-z0-9_./:=@,+%]+$' THEN {text} WHEN NOT contains({text}, '"') THEN concat('"', {text}, '"') ELSE concat('\\'', {text}, '\\'') END"""


def _byte(hexed: str, i: str) -> str:
    return f"cast(conv(substring({hexed}, 2 * ({i}) + 1, 2), 16, 10) as int)"


def socket_address(hexed: str) -> str:
    """struct<ip,port> of a socket address in hex, NULL unless it is IPv4 or IPv6; port NULL for 0."""
    size = f"(length({hexed}) div 2)"
    good = f"({hexed} RLIKE '^[0-9A-Fa-f]+$' AND {size} >= 4)"
    family = f"({_byte(hexed, '0')} + 256 * {_byte(hexed, '1')})"
    port = f"nullif({_byte(hexed, '2')} * 256 + {_byte(hexed, '3')}, 0)"
    v4 = f"concat_ws('.', {', '.join(_byte(hexed, str(i)) for i in range(4, 8))})"
    v6 = f"array_join(transform(sequence(0, 7), g -> lower(coalesce(nullif(ltrim('0', substring({hexed}, 17 + 4 * g, 4)), ''), '0'))), ':')"
    made = lambda ip: f"named_struct('ip', {ip}, 'port', cast({port} as string))"
    return f"CASE WHEN NOT {good} THEN NULL WHEN {family} = 2 AND {size} >= 8 THEN {made(v4)} WHEN {family} = 10 AND {size} >= 24 THEN {made(v6)} END"
