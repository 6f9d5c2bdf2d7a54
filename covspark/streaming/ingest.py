"""Lines, audit events and correlated records of streams.

Matching needs no state. The records of an audit event are gathered by a grouping
that ends with the watermark. What a record belongs to is decided when the watermark
has passed it, so that executions that arrive after it, but stand before it, count.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.kb import KnowledgeBase, match_events, match_units
from ..plans.analyze import predictive, script_units
from ..sources.telemetry import audit_events, audit_lines, gathered

OWNED = "host string, pid string, record long, ts timestamp, class string, detail string, owner long"
IDLE_MS = 30 * 60 * 1000  # of event time, after which a pid's state goes
LATE = "10 minutes"


def stream_findings(lines: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """Findings of a stream of scripts or single command lines (src, text): those of the batch, as each row is whole by itself."""
    return predictive(script_units(lines), kb)


def window_counts(findings: DataFrame, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Findings with a ts by rule and window; a window closes once the watermark has passed it."""
    return findings.withWatermark("ts", late).groupBy(F.window("ts", length), "rule_id").agg(F.count("*").alias("n"), F.max("noise").alias("max_noise"))


def stream_audit(lines: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Audit events of a stream of lines (src, n, line), each once, when the watermark has passed the time in its id.

    src, record (the event's first line), ts, is_exec, pid, raw, commands, class, detail,
    fields, as the batch reads them. A line that comes more than LATE behind goes unread.
    """
    ts = F.expr("timestamp_millis(cast(try_cast(substring_index(event, ':', 1) AS double) * 1000 AS bigint))")
    timed = audit_lines(lines).withColumn("ts", ts).withWatermark("ts", LATE)
    return audit_events(gathered(timed, "ts").withColumnRenamed("first", "record").drop("event"), users)


def audit_findings(events: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """src, record, rule_id, noise, severity of events: executions by their commands, others by their fields.

    For each micro-batch of stream_audit, by foreachBatch: it reads its events twice.
    """
    shown = ["src", "record", "rule_id", "noise", "severity"]
    runs = match_units(events.where("is_exec AND raw IS NOT NULL").withColumn("raw", F.trim("raw")), kb, from_raw=False)
    return runs.select(*shown).unionByName(match_events(events.where("NOT is_exec AND class IS NOT NULL"), kb).select(*shown))


def _own(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    runs, held = json.loads(state.get[0]) if state.exists else ([], [])
    for batch in batches:
        for executes, record, ts, kind, detail in zip(*(batch[c] for c in ("is_exec", "record", "ts", "class", "detail")), strict=True):
            at = int(ts.timestamp() * 1000)
            if executes:
                runs.append([int(record), at])
            else:
                held.append([int(record), at, kind, detail])
    mark = state.getCurrentWatermarkMs()
    runs.sort()
    records = [r for r, _ in runs]
    ready = sorted(x for x in held if x[1] <= mark)
    held = [x for x in held if x[1] > mark]
    owners = [records[i - 1] if (i := bisect.bisect_left(records, x[0])) else None for x in ready]
    old = max((r for r, at in runs if at <= mark), default=None)  # of executions behind the watermark the latest can still own
    runs = [x for x in runs if x[1] > mark or x[0] == old]
    latest = max([at for _, at in runs] + [x[1] for x in held], default=0)
    if held or latest + IDLE_MS > mark:
        state.update((json.dumps([runs, held]),))
        state.setTimeoutTimestamp(max(mark + 1, min((x[1] for x in held), default=latest + IDLE_MS)))
    else:
        state.remove()
    out = pd.DataFrame(ready, columns=["record", "at", "class", "detail"])
    yield out.assign(host=key[0], pid=key[1], ts=pd.to_datetime(out.pop("at"), unit="ms"), owner=pd.array(owners, "Int64"))[["host", "pid", "record", "ts", "class", "detail", "owner"]]


def correlate(records: DataFrame) -> DataFrame:
    """OWNED for each record that is no execution: owner is the latest execution before it of its host and pid.

    records: host, pid, record, ts, is_exec, class, detail. A record comes out when the
    watermark has passed it, by which time all executions before it have come, in whatever
    order: the owners are those of the batch. Rows without a pid have no owner and come at
    once. A pid's state is its records ahead of the watermark and its latest execution
    behind it, dropped when the watermark has passed its last record by half an hour.
    """
    known = records.where("pid IS NOT NULL").withWatermark("ts", LATE)
    owned = known.groupBy("host", "pid").applyInPandasWithState(_own, OWNED, "kept string", "append", GroupStateTimeout.EventTimeTimeout)
    lone = records.where("pid IS NULL AND NOT is_exec").select("host", "pid", "record", "ts", "class", "detail", F.lit(None).cast("long").alias("owner"))
    return owned.unionByName(lone)
