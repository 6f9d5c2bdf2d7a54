"""Rules compiled to three-valued Spark SQL: NULL is the unknown.

An event e is struct<fields:map<string,string>,partial:array<string>>. A missing
field is NULL by itself, and AND, OR and NOT carry it as the logic of rules asks.
`partial` names fields of which only the end is known; only those that a made-up
event can have are compiled with it.
"""

from __future__ import annotations

import ipaddress
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import PRODUCT
from ..functions import sql
from ..functions.shell import COMMAND, commands
from ..shared import written
from ..ship import ship
from .rules import FieldTest, Keywords, Rule, Search, address_bits

EVENT = "struct<fields:map<string,string>,partial:array<string>>"
VERDICT = "struct<outcome:string,missing_fields:array<string>,partial_fields:array<string>,blocking_modifiers:array<string>,null_value_match:boolean>"
PARTIAL = {"Image", "a0", "name"}
UNKNOWN = "cast(NULL as boolean)"
BATCH = 100  # rules in one projection


def parse_address(value: str | None) -> str | None:
    """128 bits of an address written bare, as [v6]:port, v4:port or v6%scope; None if it is none."""
    text = (value or "").strip()
    forms = [text]
    if m := re.match(r"\[([^\]]*)\]", text):
        forms = [m[1]]
    elif text.count(":") == 1:
        forms = [text.split(":")[0]]
    elif "%" in text:
        forms = [text.split("%")[0]]
    for form in forms:
        try:
            return address_bits(ipaddress.ip_address(form))
        except ValueError:
            continue
    return None


def prepare(spark: SparkSession) -> None:
    """The package on executors, and the map policy that parsed records need: the last of equal keys wins."""
    ship(spark)
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")


def field_test(test: FieldTest, e: str) -> str:
    if not test.answered:
        return UNKNOWN
    value = f"{e}.fields[{sql.lit(test.field)}]"
    partial = f"array_contains({e}.partial, {sql.lit(test.field)})" if test.field in PARTIAL else None
    group = sql.every if test.all else sql.some
    if test.op == "cidr":
        return group(f"startswith({e}.ips[{sql.lit(test.field)}], '{bits}')" for (bits,) in test.groups)
    if test.op == "re":
        found = group(f"{value} RLIKE {sql.lit(p)}" for (p,) in test.groups)
        return f"if({partial}, NULL, {found})" if partial else found
    text = value if test.case else f"lower({value})"
    return group(sql.some(_needle(test.op, text, n if test.case else n.lower(), partial) for n in g) for g in test.groups)


def _hit(op: str, text: str, needle: str) -> str:
    if op == "glob":
        return sql.glob(text, needle)
    return f"{op}({text}, {sql.lit(needle)})"


def _needle(op: str, text: str, needle: str, partial: str | None) -> str:
    """Of a partial path only the last segment can be compared: where that agrees, nothing is known.

    A path that ends with a needle which names a directory has the needle's whole last segment.
    """
    hit = _hit(op, text, needle)
    end = max(needle.rfind("/"), needle.rfind("\\")) + 1
    if not partial or not end:
        return hit
    last = sql.last_segment(text)
    agrees = f"{last} = {sql.lit(needle[end:])}" if op == "endswith" else _hit(op, last, needle[end:])
    return f"(CASE WHEN {hit} THEN true WHEN {text} IS NULL THEN NULL WHEN NOT {partial} THEN false WHEN {agrees} THEN NULL ELSE false END)"


def search(own: Search, e: str) -> str:
    if isinstance(own, Keywords):
        text = f"lower({e}.fields['CommandLine'])"
        tests = [sql.glob(text, k.lower(), whole=False) for k in own.values]
        made = (sql.every if own.all else sql.some)(tests)
        return f"if({text} IS NULL, NULL, {made})"
    return sql.some(sql.every(field_test(t, e) for t in group) for group in own)


def condition(tree: tuple, searches: dict[str, Search], e: str) -> str:
    kind, *rest = tree
    if kind == "id":
        return search(searches[rest[0]], e) if rest[0] in searches else UNKNOWN
    if kind == "not":
        return sql.negate(condition(rest[0], searches, e))
    if kind in ("and", "or"):
        return (sql.every if kind == "and" else sql.some)(condition(t, searches, e) for t in rest)
    count, pattern = rest
    chosen = [s for name, s in searches.items() if pattern == "them" or name == pattern or pattern.endswith("*") and name.startswith(pattern[:-1])]
    parts = [search(s, e) for s in chosen]
    if count is None:
        return sql.every(parts)
    yes = " + ".join([f"int(coalesce({p}, false))" for p in parts] or ["0"])
    maybe = " + ".join([f"int(coalesce({p}, true))" for p in parts] or ["0"])
    return f"(CASE WHEN {yes} >= {count} THEN true WHEN {maybe} >= {count} THEN NULL ELSE false END)"


def verdict(rule: Rule, e: str) -> str:
    """A VERDICT: the outcome, and for an unknown one its possible causes."""
    truth = condition(rule.condition, rule.searches, e)
    outcome = f"(CASE WHEN ({truth}) THEN 'fires' WHEN NOT ({truth}) THEN 'no-fire' ELSE 'indeterminate' END)"
    names = [f for f in rule.fields if f]
    missing = f"filter({sql.strings(names)}, f -> NOT map_contains_key({e}.fields, f))"
    partial = f"filter({sql.strings([f for f in names if f in PARTIAL])}, f -> array_contains({e}.partial, f))"
    none = sql.strings([])
    whole = f"named_struct('outcome', o, 'missing_fields', {missing}, 'partial_fields', {partial}, 'blocking_modifiers', {sql.strings(rule.blocking)}, 'null_value_match', {str(rule.null_value).lower()})"
    bare = f"named_struct('outcome', o, 'missing_fields', {none}, 'partial_fields', {none}, 'blocking_modifiers', {none}, 'null_value_match', false)"
    return f"transform(array({outcome}), o -> if(o = 'indeterminate', {whole}, {bare}))[0]"


def fold(rule: Rule, records: str) -> str:
    """One VERDICT of several records of an action.

    Any that fires, fires. A record that lacks only fields which others have was not
    the one asked; of the rest, all must say no for a no. Otherwise causes are united.
    """
    none = sql.strings([])
    each = f"transform({records}, e -> {verdict(rule, 'e')})"
    names = f"array_distinct(flatten(transform({records}, e -> map_keys(e.fields))))"
    elsewhere = "(v.outcome = 'indeterminate' AND size(v.blocking_modifiers) = 0 AND size(v.partial_fields) = 0 AND NOT v.null_value_match AND size(v.missing_fields) > 0 AND size(array_except(v.missing_fields, names)) = 0)"
    union = lambda f: f"array_sort(array_distinct(flatten(transform(why, v -> v.{f}))))"
    bare = lambda o: f"named_struct('outcome', '{o}', 'missing_fields', {none}, 'partial_fields', {none}, 'blocking_modifiers', {none}, 'null_value_match', false)"
    united = f"named_struct('outcome', 'indeterminate', 'missing_fields', {union('missing_fields')}, 'partial_fields', {union('partial_fields')}, 'blocking_modifiers', {union('blocking_modifiers')}, 'null_value_match', exists(why, v -> v.null_value_match))"
    causes = f"transform(array(if(size(kept) > 0, kept, vs)), why -> {united})[0]"
    judged = f"CASE WHEN exists(vs, v -> v.outcome = 'fires') THEN {bare('fires')} WHEN size(kept) > 0 AND forall(kept, v -> v.outcome = 'no-fire') THEN {bare('no-fire')} ELSE {causes} END"
    kept = f"transform(array(filter(vs, v -> NOT {elsewhere})), kept -> {judged})[0]"
    return f"transform(array({names}), names -> transform(array({each}), vs -> {kept})[0])[0]"


# --- events of a command that nobody recorded


def process_event(platform: str, command: str = "matched_command") -> str:
    """CommandLine, Image of which only the last part is known, and OriginalFileName."""
    image = f"concat('\\\\', {command}.program, '.exe')" if platform == "windows-sysmon" else f"concat('/', {command}.program)"
    return f"named_struct('fields', map('CommandLine', {command}.raw, 'Image', {image}, 'OriginalFileName', {command}.program), 'partial', array('Image'))"


def operands(command: str = "matched_command") -> str:
    """Arguments that name a path, once each, in order: no flags, no URLs, after redirections and `x=`."""
    bare = f"if(a RLIKE '[<>]', regexp_replace(a, {sql.lit('^[<>&0-9]+')}, ''), a)"
    value = f"regexp_replace({bare}, '^[^=]*=', '')"
    return f"array_distinct(filter(transform(filter({command}.args, a -> NOT startswith(a, '-') AND NOT contains(a, '://')), a -> {value}), a -> contains(a, '/')))"


def audit_records(command: str = "matched_command", files: str | None = None) -> str:
    """An EXECVE, a SYSCALL and, for each operand or file touched, a PATH record."""
    argument = "transform(sequence(0, size(x.args)), i -> named_struct('k', concat('a', i), 'v', if(i = 0, x.program, x.args[i - 1])))"
    execve = f"map_from_entries(concat(array(named_struct('k', 'type', 'v', 'EXECVE')), {argument.replace('x.', command + '.')}, array(named_struct('k', 'CommandLine', 'v', {command}.raw))))"
    syscall = f"map('type', 'SYSCALL', 'comm', substring({command}.program, 1, 15))"
    paths = operands(command) if files is None else f"array_union({operands(command)}, {files})"
    none = sql.strings([])
    path = f"transform({paths}, o -> named_struct('fields', map('type', 'PATH', 'name', o), 'partial', if(startswith(o, '/'), {none}, array('name'))))"
    return f"concat(array(named_struct('fields', {execve}, 'partial', array('a0')), named_struct('fields', {syscall}, 'partial', {none})), {path})"


def observe(event: str, fields: str, typed: bool = False) -> str:
    """An event with recorded fields over made-up ones: empty values say nothing; with typed, type stays its own."""
    seen = f"map_filter({fields}, (k, v) -> v <> ''{' AND k <> ' + sql.lit('type') if typed else ''})"
    return f"transform(array({seen}), s -> named_struct('fields', map_concat({event}.fields, s), 'partial', array_except({event}.partial, map_keys(s))))[0]"


def evidence(rows: DataFrame, platform: str, observed: str | None = None, files: str | None = None) -> DataFrame:
    """rows (matched_command) with process and audit, the events by which rules judge the command.

    observed names a column of recorded fields, NULL where there are none. On
    Linux, rules about audit records see records; others, and those of other platforms, one process event.
    """
    whole = process_event(platform)
    seen = f"if({observed} IS NULL, e, {observe('e', observed)})" if observed else "e"
    rows = rows.withColumn("process", F.expr(f"transform(array({whole}), e -> {seen})"))
    if PRODUCT[platform] != "linux":
        return rows.withColumn("audit", F.col("process"))
    over = f"if({observed} IS NULL, e, {observe('e', observed, typed=True)})" if observed else "e"
    return rows.withColumn("audit", F.expr(f"transform({audit_records(files=files)}, e -> {over})"))


def with_addresses(rows: DataFrame, column: str, rules: list[Rule]) -> DataFrame:
    """Events with ips, the bits of the fields that any cidr test reads: parsed once, in Arrow batches."""
    names = sorted({t.field for r in rules for t in r.tests() if t.op == "cidr"})
    if not names:
        return rows.withColumn(column, F.expr(f"transform({column}, e -> named_struct('fields', e.fields, 'partial', e.partial, 'ips', cast(map() as map<string,string>)))"))

    @F.pandas_udf("array<map<string,string>>")
    def bits(events: pd.Series) -> pd.Series:
        return events.map(lambda es: [{n: b for n in names if (b := parse_address(dict(m).get(n)))} for m in es])

    fields = F.transform(column, lambda e: e["fields"])
    return rows.withColumn("bits__", bits(fields)).withColumn(column, F.expr(f"transform({column}, (e, i) -> named_struct('fields', e.fields, 'partial', e.partial, 'ips', bits__[i]))")).drop("bits__")


def judge(rows: DataFrame, rules: dict[str, Rule], candidates: str, process: str = "process", audit: str = "audit") -> DataFrame:
    """rows with a row for each of its candidates (an array of rule ids) among rules, and its verdict.

    A rule is evaluated on the rows that ask for it alone. Rules beyond a batch take
    projections of their own, which all read the rows as written once.
    """
    own = list(rules.values())
    for column in dict.fromkeys((process, audit)):
        rows = with_addresses(rows, column, own)
    if len(rules) > BATCH:
        rows = written(rows)
    keep = [c for c in rows.columns if c not in (process, audit)]
    made = [f"if(array_contains({candidates}, {sql.lit(i)}), named_struct('judged', {sql.lit(i)}, 'verdict', {fold(r, audit if r.audit_shaped else process)}), NULL)" for i, r in rules.items()]
    none = f"cast(array() as array<struct<judged:string,verdict:{VERDICT}>>)"
    parts = [rows.selectExpr(*keep, f"inline(array_compact(array({', '.join(made[i : i + BATCH])})))") for i in range(0, len(made), BATCH)] or [rows.selectExpr(*keep, f"inline({none})")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def label(verdict: str = "verdict") -> str:
    """The verdict in words: what is missing comes first, then what is known in part."""
    return f"""CASE WHEN {verdict}.outcome <> 'indeterminate' THEN {verdict}.outcome
        WHEN size({verdict}.missing_fields) > 0 THEN concat('indeterminate (needs ', array_join({verdict}.missing_fields, ', '), ')')
        WHEN size({verdict}.partial_fields) > 0 THEN concat('indeterminate (needs ', array_join(transform({verdict}.partial_fields, f -> concat('a full path for ', f)), ', '), ')')
        ELSE 'indeterminate' END"""


def evaluate(spark: SparkSession, rule: Rule, line: str, platform: str, observed: dict[str, str] | None = None, files: list[str] | None = None) -> DataFrame:
    """command and verdict of each command on a line, for one rule."""
    prepare(spark)
    rows = spark.createDataFrame([(c, observed) for c in commands(line)], f"matched_command {COMMAND}, observed map<string,string>")
    rows = evidence(rows, platform, "observed", sql.strings(files) if files else None).withColumn("asked", F.array(F.lit(rule.id)))
    return judge(rows, {rule.id: rule}, "asked").select(F.col("matched_command").alias("command"), "verdict")


def evaluate_record(spark: SparkSession, rule: Rule, fields: dict[str, str]) -> DataFrame:
    """The verdict on one record as it is: nothing made up."""
    prepare(spark)
    rows = spark.createDataFrame([([(fields, [])], [rule.id])], f"process array<{EVENT}>, asked array<string>")
    return judge(rows, {rule.id: rule}, "asked", audit="process").select("verdict")
