"""Recorded telemetry as two tables.

observations: src, record, commands, raw, fields, side_effects - executions.
events: src, record, class, detail, fields - other records with no execution before them.

A record of a process belongs to the latest execution before it with the same
pid, in the same file; that is a window over (src, pid), with no state held.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import records as R
from ..functions.shell import basename_sql, commands_sql
from ..functions.sql import lit, trim
from ..operators.verdict import prepare
from ..shared import written

FORMATS = ("sysmon", "auditd", "esf")


@dataclass
class Ingest:
    observations: DataFrame
    events: DataFrame
    skipped: DataFrame  # src, skipped: records that are no executions, kept as side effects or not


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """src, text: a row a file; files are what records are correlated within."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("src"), F.col("value").alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """src, n, line: a row a line, n in the order of the file. Large files are read in splits.

    n is where the line's split begins, in bytes, plus its place among the split's
    rows: a task reads fewer rows than bytes, so a later split's lines have larger n.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("src"), (F.col("_metadata.file_block_start") + row).alias("n"), F.col("value").alias("line"))


def passwd(files: DataFrame) -> DataFrame:
    """uid, name of passwd lines; the last line of a uid counts."""
    lines = files.select("src", F.posexplode(F.split("text", "\r?\n")).alias("n", "line")).select("src", "n", F.split("line", ":").alias("f"))
    good = lines.where("size(f) >= 3 AND f[0] <> '' AND f[2] <> ''")
    return good.groupBy(F.expr("f[2]").alias("uid")).agg(F.max_by(F.expr("f[0]"), F.struct("src", "n")).alias("name"))


def blank(field: str) -> str:
    return f"nullif(coalesce({field}, ''), '')"


def executions(rows: DataFrame) -> DataFrame:
    """rows (fields) with raw and commands: the command line, or the image where it is blank.

    The first command's program is the image's, where there is one; raw is NULL where neither is.
    """
    line, image = "coalesce(fields['CommandLine'], '')", "coalesce(fields['Image'], '')"
    rows = rows.withColumn("raw", F.expr(f"nullif(if({trim(line)} = '', {image}, {line}), '')")).withColumn("raw", F.expr(f"if({trim('raw')} = '', NULL, raw)"))
    rows = rows.withColumn("commands", F.expr(commands_sql("coalesce(raw, '')")))
    first = f"named_struct('program', {basename_sql(image)}, 'args', if(size(commands) > 0, commands[0].args, cast(array() as array<string>)), 'raw', if(size(commands) > 0, commands[0].raw, raw))"
    return rows.withColumn("commands", F.expr(f"if({trim(image)} = '', commands, concat(array({first}), slice(commands, 2, greatest(size(commands), 1))))"))


def correlate(rows: DataFrame) -> Ingest:
    """rows: src, record, pid, is_exec, raw, commands, fields, class, detail (class NULL: nothing seen)."""
    rows = rows.withColumn("done", F.col("is_exec") & F.col("raw").isNotNull())
    before = W.partitionBy("src", "pid").orderBy("record").rowsBetween(W.unboundedPreceding, -1)
    owner = F.when(F.col("pid").isNotNull(), F.last(F.when(F.col("done"), F.col("record")), ignorenulls=True).over(before))
    owned = rows.withColumn("owner", owner)
    extra = owned.where(~F.col("is_exec") & F.col("class").isNotNull())
    # an execution and what it owns meet in one grouping: its record is the key of all of them
    part = owned.where(F.col("done") | (~F.col("is_exec") & F.col("class").isNotNull() & F.col("owner").isNotNull()))
    own = F.any_value(F.when(F.col("done"), F.struct("commands", "raw", "fields")), ignoreNulls=True).alias("own")
    effects = F.sort_array(F.collect_list(F.when(~F.col("done"), F.struct("record", "class", "detail")))).alias("effects")
    done = part.groupBy("src", F.when(F.col("done"), F.col("record")).otherwise(F.col("owner")).alias("at")).agg(own, effects)
    done = done.selectExpr("src", "at AS record", "own.*", "transform(effects, e -> named_struct('class', e.class, 'detail', e.detail)) AS side_effects")
    alone = extra.where(F.col("owner").isNull()).select("src", "record", "class", "detail", "fields")
    skipped = rows.groupBy("src").agg(F.count_if(~F.col("done")).alias("skipped"))
    return Ingest(done, alone, skipped)


def sysmon(files: DataFrame) -> Ingest:
    """JSON events: an array, one object or one a line; flat or nested."""
    prepare(files.sparkSession)
    rows = files.select("src", F.posexplode(R.json_records_column(F.col("text"))).alias("n", "json")).select("src", (F.col("n") + 1).alias("record"), R.flatten_column(F.col("json")).alias("fields"))
    kind = "fields['EventID']"
    host = f"coalesce({blank("fields['DestinationIp']")}, {blank("fields['DestinationHostname']")})"
    port = f"coalesce(concat(':', {blank("fields['DestinationPort']")}), '')"
    rows = executions(rows).withColumns(
        {
            "pid": F.expr("fields['ProcessId']"),
            "is_exec": F.expr(f"raw IS NOT NULL AND CASE WHEN {kind} IS NOT NULL THEN {trim(kind)} = '1' ELSE {trim("coalesce(fields['CommandLine'], '')")} <> '' END"),
            "detail": F.expr(f"CASE {kind} WHEN '3' THEN concat('network connection to ', {host}, {port}) WHEN '11' THEN concat('file created ', {blank("fields['TargetFilename']")}) WHEN '13' THEN concat('registry set ', {blank("fields['TargetObject']")}) END"),
        }
    )
    return correlate(rows.withColumn("class", F.expr(f"if(detail IS NULL, NULL, CASE {kind} WHEN '3' THEN 'network' WHEN '11' THEN 'file' WHEN '13' THEN 'registry' END)")))


def audit_lines(files: DataFrame) -> DataFrame:
    """src, n, kind, event, fields as written, text decoded: one row a line that has a type and an event id.

    files: src and text, a row a file; or src, n and line, a row a line. Further columns of lines stay.
    """
    prepare(files.sparkSession)
    lines = files if "line" in files.columns else files.select("src", F.posexplode(F.split("text", "\r?\n")).alias("n", "line"))
    own = [c for c in lines.columns if c != "line"]
    parsed = lines.select(*own, F.expr(R.pairs("line")).alias("fields")).selectExpr(*own, "fields", f"transform_values(fields, (k, v) -> {R.decoded('v')}) AS text")
    return parsed.selectExpr(*own, "text['type'] AS kind", f"{R.event_id("fields['msg']")} AS event", "fields", "text").where("kind IS NOT NULL AND event IS NOT NULL")


def gathered(lines: DataFrame, *keys: str) -> DataFrame:
    """src, event, keys, first, recs: the records of an event, in order, wherever in the file they stand."""
    row = F.struct("n", "kind", F.map_entries("fields").alias("fields"), F.map_entries("text").alias("text"))
    grouped = lines.groupBy("src", "event", *keys).agg(F.min("n").alias("first"), F.sort_array(F.collect_list(row)).alias("recs"))
    maps = "transform(recs, r -> named_struct('kind', r.kind, 'fields', map_from_entries(r.fields), 'text', map_from_entries(r.text)))"
    return grouped.select("src", "event", *keys, "first", F.expr(maps).alias("recs"))


STRETCH = 1 << 16  # of a file's line numbers, whose events a task counts


def audit_groups(lines: DataFrame) -> DataFrame:
    """src, record, recs: events numbered by their first line within the file, a stretch of it in a task."""
    groups = written(gathered(lines).withColumn("stretch", F.expr(f"first div {STRETCH}")))
    sums = groups.groupBy("src", "stretch").agg(F.count("*").alias("c"))
    before = W.partitionBy("src").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select("src", "stretch", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    nth = F.row_number().over(W.partitionBy("src", "stretch").orderBy("first"))
    return groups.withColumn("nth", nth).join(base, ["src", "stretch"]).select("src", (F.col("base") + F.col("nth")).alias("record"), "recs")


def auditd(files: DataFrame, users: DataFrame | None = None) -> Ingest:
    """key=value records, several to an event. Socket addresses are decoded as they stand, in hex."""
    return correlate(audit_events(audit_groups(audit_lines(files)), users))


def audit_events(rows: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """What each event says, of src, record, recs; further columns stay."""
    own = [c for c in rows.columns if c not in ("src", "record", "recs")]
    first = lambda test: f"get(filter(recs, r -> {test}), 0)"
    chosen = {
        "call": "r.kind = 'SYSCALL'",
        "run": "r.kind = 'EXECVE'",
        "cwd": "r.kind = 'CWD'",
        "named": "r.kind = 'PATH' AND r.text['name'] IS NOT NULL",
        "path": "r.kind = 'PATH' AND coalesce(r.text['nametype'], '') <> 'PARENT'",
        "peer": "r.kind = 'SOCKADDR' AND r.fields['saddr'] IS NOT NULL",
    }
    rows = rows.selectExpr("src", "record", *own, *(f"{first(t)} AS {n}" for n, t in chosen.items()))
    rows = rows.withColumns({"exec": F.col("run.text"), "uid": F.expr("call.fields['uid']"), "pid": F.expr("call.fields['pid']"), "worked": F.expr("run IS NULL AND coalesce(call.text['success'], 'yes') = 'yes'")})
    if users is None:
        rows = rows.withColumn("user", F.lit(None).cast("string"))
    else:
        rows = rows.join(users.withColumnRenamed("name", "user"), "uid", "left")
    count = "coalesce(nullif(array_position(transform(sequence(0, size(exec)), i -> map_contains_key(exec, concat('a', i))), false), 0) - 1, 0)"
    rows = rows.withColumn("argv", F.expr(f"if(exec IS NULL, NULL, slice(transform(sequence(0, size(exec)), i -> exec[concat('a', i)]), 1, int({count})))"))
    fixed = {
        "CommandLine": f"array_join(transform(argv, d -> {R.quoted_argument('d')}), ' ')", "User": "user", "Image": "call.text['exe']", "exe": "call.text['exe']", "comm": "call.text['comm']",
        "tty": "nullif(call.text['tty'], '(none)')", "key": "nullif(call.text['key'], '(none)')", "name": "named.text['name']", "CurrentDirectory": "cwd.text['cwd']", "ProcessId": "pid",
    }
    whole = f"map_concat(map_filter(exec, (k, v) -> k RLIKE '^a[0-9]+$'), map({', '.join(f'{lit(k)}, {v}' for k, v in fixed.items())}))"
    rows = rows.withColumns({"made": F.expr(f"map_filter({whole}, (k, v) -> v <> '')"), "address": F.expr(f"if(worked, {R.socket_address("peer.fields['saddr']")}, NULL)"), "file": F.expr("if(worked, nullif(path.text['name'], ''), NULL)")})
    rows = rows.withColumn("class", F.expr("CASE WHEN address IS NOT NULL THEN 'network' WHEN file IS NOT NULL THEN 'file' END"))
    detail = "CASE class WHEN 'network' THEN concat('network connection to ', address.ip, coalesce(concat(':', address.port), '')) WHEN 'file' THEN concat(if(path.text['nametype'] = 'CREATE', 'file created ', 'file opened '), file) END"
    seen = "map_filter(CASE class WHEN 'network' THEN map('DestinationIp', address.ip, 'DestinationPort', address.port, 'ProcessId', pid) WHEN 'file' THEN map('TargetFilename', file, 'ProcessId', pid) END, (k, v) -> v IS NOT NULL)"
    rows = rows.selectExpr("src", "record", *own, "run IS NOT NULL AS is_exec", "pid", "class", f"{detail} AS detail", f"if(run IS NOT NULL, made, {seen}) AS fields")
    return executions(rows)


ESF = """process STRUCT<executable: STRUCT<path: STRING>, audit_token: STRUCT<pid: STRING>, pid: STRING>,
event STRUCT<
    exec: STRUCT<target: STRUCT<executable: STRUCT<path: STRING>, audit_token: STRUCT<pid: STRING>, pid: STRING, is_platform_binary: BOOLEAN, signing_id: STRING, team_id: STRING>, args: ARRAY<STRING>, cwd: STRUCT<path: STRING>>,
    open: STRUCT<file: STRUCT<path: STRING>>,
    create: STRUCT<destination: STRUCT<existing_file: STRUCT<path: STRING>, new_path: STRUCT<filename: STRING>>, file: STRUCT<path: STRING>>,
    write: STRUCT<target: STRUCT<path: STRING>>,
    connect: STRUCT<address: STRING, port: STRING>>"""


def esf(files: DataFrame) -> Ingest:
    """Endpoint Security JSON: executions, and files and connections."""
    prepare(files.sparkSession)
    rows = files.select("src", F.posexplode(R.json_records_column(F.col("text"))).alias("n", "json")).select("src", (F.col("n") + 1).alias("record"), F.from_json("json", ESF).alias("e")).select("src", "record", "e.*")
    pid = lambda p: f"nullif(coalesce({p}.audit_token.pid, {p}.pid), '')"
    line = f"array_join(transform(filter(event.exec.args, a -> a IS NOT NULL), a -> {R.quoted_argument('a')}), ' ')"
    own = {
        "Image": "event.exec.target.executable.path", "CommandLine": line, "CurrentDirectory": "event.exec.cwd.path", "ParentImage": "process.executable.path", "ProcessId": pid("event.exec.target"),
        "signing_id": "event.exec.target.signing_id", "team_id": "event.exec.target.team_id", "is_platform_binary": "cast(event.exec.target.is_platform_binary as string)",
    }
    created = "coalesce(event.create.destination.existing_file.path, event.create.destination.new_path.filename, event.create.file.path)"
    file = f"coalesce(event.open.file.path, {created}, if(event.create IS NULL, event.write.target.path, NULL))"
    verb = "CASE WHEN event.open.file.path IS NOT NULL THEN 'file opened ' WHEN event.create IS NOT NULL THEN 'file created ' ELSE 'file written ' END"
    seen = {"TargetFilename": "file", "DestinationIp": "host", "DestinationPort": "if(host IS NULL, NULL, event.connect.port)", "ProcessId": pid("process"), "Image": "process.executable.path"}
    made = lambda m: f"map_filter(map({', '.join(f'{lit(k)}, {v}' for k, v in m.items())}), (k, v) -> coalesce(v, '') <> '')"
    rows = rows.selectExpr("*", "event.exec IS NOT NULL AS is_exec", f"{file} AS file").selectExpr("*", "if(file IS NULL AND event.create IS NULL, event.connect.address, NULL) AS host")
    rows = rows.selectExpr(
        "src", "record", "is_exec",
        f"if(is_exec, {pid('event.exec.target')}, {pid('process')}) AS pid",
        "CASE WHEN file IS NOT NULL THEN 'file' WHEN host IS NOT NULL THEN 'network' END AS class",
        f"CASE WHEN file IS NOT NULL THEN concat({verb}, file) WHEN host IS NOT NULL THEN concat('network connection to ', host, coalesce(concat(':', event.connect.port), '')) END AS detail",
        f"if(is_exec, {made(own)}, {made(seen)}) AS fields",
    )
    return correlate(executions(rows))


def ingest(files: DataFrame, form: str, users: DataFrame | None = None) -> Ingest:
    if form not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    return auditd(files, users) if form == "auditd" else {"sysmon": sysmon, "esf": esf}[form](files)
