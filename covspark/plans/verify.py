"""Claims: does a rule fire on what each entry of the knowledge base stands for?"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import MOST_CAUSES
from ..functions.shell import COMMAND, commands
from ..operators.candidates import candidates, for_class, for_process, level_rank
from ..operators.kb import KnowledgeBase
from ..operators.matcher import representative_event, representative_line
from ..operators.verdict import EVENT, evidence, judge, prepare
from ..sources.ruleset import Index
from .deltas import STATUS_RANK, _ranked

LISTS = ("modifiers", "missing_fields", "partial_fields")


def representatives(spark: SparkSession, kb: KnowledgeBase) -> DataFrame:
    """rule_id, techniques, claimed, matched_command, class, fields, files of entries that claim a Sigma rule."""
    rows = []
    for e in kb.entries:
        claims = [d["rule"] for d in e.detections if d["source"].lower() == "sigma"]
        if not claims:
            continue
        line, event = representative_line(e), representative_event(e.match)
        command = next(iter(commands(line)), None) if line else None
        kind, fields = event or (None, None)
        files = [fields["TargetFilename"]] if kind == "file" and "TargetFilename" in fields else []
        rows.append((e.id, e.description, [(t["id"], t["name"]) for t in e.techniques], [c for c in claims if c], command, kind, fields, files))
    return spark.createDataFrame(rows, f"rule_id string, description string, techniques array<struct<id:string,name:string>>, claimed array<string>, matched_command {COMMAND}, class string, fields map<string,string>, files array<string>")


def verify(spark: SparkSession, kb: KnowledgeBase, index: Index) -> DataFrame:
    """id, description, techniques, claimed, status, firing, not_firing, because: worst status first.

    Rules for processes are asked about the entry's representative command, which
    touches the file of its event; rules of its event's class about the record as it
    is. verified: one fires. indeterminate: none does and one can't be told. unverified:
    all say no. not-applicable: no candidate is of either kind. no-rule: no candidate.
    """
    prepare(spark)
    claims = representatives(spark, kb)
    asked = candidates(claims, index, ["rule_id"]).join(F.broadcast(claims.select("rule_id", "class", "matched_command")), "rule_id")  # entries of the knowledge base
    way = F.when(for_process(), "process").when(F.coalesce(for_class(F.col("class")), F.lit(False)), "event").otherwise("none")
    asked = asked.withColumn("way", way)
    lists = asked.groupBy("rule_id").agg(*(F.collect_set(F.when(F.col("way") == w, F.col("candidate"))).alias(w + "_ids") for w in ("process", "event")))
    logic = {i: r for i, r in index.logic.items() if r}
    ready = claims.join(lists, "rule_id")
    by_command = evidence(ready.where("matched_command IS NOT NULL"), kb.platform, files="files").select("rule_id", "process_ids", "process", "audit")
    by_record = ready.where("fields IS NOT NULL").select("rule_id", "event_ids", F.expr(f"cast(array(struct(fields, cast(array() as array<string>))) as array<{EVENT}>)").alias("process"))
    said = judge(by_command, logic, "process_ids").select("rule_id", F.col("judged").alias("candidate"), "verdict").unionByName(judge(by_record, logic, "event_ids", audit="process").select("rule_id", F.col("judged").alias("candidate"), "verdict"))
    unread = [i for i, r in index.logic.items() if r is None]
    told = asked.join(said, ["rule_id", "candidate"], "left").withColumns({"unread": F.col("candidate").isin(unread), "mute": (F.col("way") == "process") & F.col("matched_command").isNull()})
    used = F.col("way") != "none"
    outcome = F.when(used, F.when(F.col("mute") | F.col("unread"), "indeterminate").otherwise(F.col("verdict.outcome")))
    order = F.struct((-level_rank("level")).alias("l"), "title", "candidate")
    union = lambda f: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(outcome == "indeterminate", F.col(f"verdict.{f}"))))))
    tally = told.groupBy("rule_id").agg(
        F.count_if(used).alias("used"), F.count_if(~used).alias("inapplicable_rules"), F.count_if(outcome == "indeterminate").alias("open"),
        F.transform(F.sort_array(F.collect_list(F.when(outcome == "fires", order))), lambda x: x["title"]).alias("firing"),
        F.sort_array(F.collect_list(F.when(outcome == "no-fire", F.col("title")))).alias("not_firing"),
        union("blocking_modifiers").alias("modifiers"), union("missing_fields").alias("missing_fields"), union("partial_fields").alias("partial_fields"),
        F.count_if(used & F.col("unread") & ~F.col("mute")).alias("unparsed_rules"),
        F.coalesce(F.max(F.when(outcome == "indeterminate", F.col("verdict.null_value_match"))), F.lit(False)).alias("null_value_match"),
        F.coalesce(F.max("mute"), F.lit(False)).alias("no_representative"),
    )
    none = F.array().cast("array<string>")
    status = F.when(F.col("used").isNull(), "no-rule").when(F.col("used") == 0, "not-applicable").when(F.size("firing") > 0, "verified").when(F.col("open") > 0, "indeterminate").otherwise("unverified")
    out = claims.join(tally, "rule_id", "left").withColumn("status", status)
    open_ = F.col("status") == "indeterminate"
    because = F.struct(
        *(F.when(open_, F.col(c)).otherwise(none).alias(c) for c in LISTS),
        F.when(open_, F.col("unparsed_rules")).otherwise(0).alias("unparsed_rules"),
        F.when(open_ | (F.col("status") == "not-applicable"), F.col("inapplicable_rules")).otherwise(0).alias("inapplicable_rules"),
        *(F.when(open_, F.col(c)).otherwise(False).alias(c) for c in ("null_value_match", "no_representative")),
    )
    firing = F.when(F.col("status") == "verified", F.col("firing")).otherwise(none)
    refused = F.when(F.col("status") == "unverified", F.col("not_firing")).otherwise(none)
    shown = out.select(F.col("rule_id").alias("id"), "description", F.transform("techniques", lambda t: t["id"]).alias("techniques"), "claimed", "status", firing.alias("firing"), refused.alias("not_firing"), because.alias("because"))
    return shown.orderBy(_ranked("status", STATUS_RANK), "id")


def causes(results: DataFrame) -> DataFrame:
    """cause, entries, detail: why claims are indeterminate, the commonest cause first."""
    open_ = results.where("status = 'indeterminate'")
    words = {"modifiers": "modifiers", "missing_fields": "missing fields", "partial_fields": "path-only fields"}
    named = []
    for i, (column, word) in enumerate(words.items()):
        each = open_.select(F.explode(f"because.{column}").alias("x")).groupBy("x").agg(F.count("*").alias("c"))
        top = each.agg(F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("k"), "x"))).alias("t"), F.count("*").alias("m"))  # distinct fields and modifiers of rules
        text = F.concat(F.array_join(F.transform(F.slice("t", 1, MOST_CAUSES), lambda e: F.concat(e["x"], F.lit(" "), -e["k"])), ", "), F.when(F.col("m") > MOST_CAUSES, F.concat(F.lit(", +"), F.col("m") - MOST_CAUSES, F.lit(" more"))).otherwise(""))
        named.append(open_.agg(F.count_if(F.size(f"because.{column}") > 0).alias("entries")).crossJoin(top.select(text.alias("detail"))).select(F.lit(i).alias("at"), F.lit(word).alias("cause"), "entries", "detail"))
    flags = [("because.unparsed_rules > 0", "unparsed rules", ""), ("because.inapplicable_rules > 0", "other logsource", "candidate rules set aside, not counted above"), ("because.null_value_match", "field-absent", "rule asserts a field is null"), ("because.no_representative", "no representative", "entry has no line to evaluate")]
    for i, (test, word, text) in enumerate(flags, 3):
        named.append(open_.agg(F.count_if(F.expr(test)).alias("entries")).select(F.lit(i).alias("at"), F.lit(word).alias("cause"), "entries", F.lit(text).alias("detail")))
    out = named[0]
    for n in named[1:]:
        out = out.unionByName(n)
    return out.where("entries > 0").orderBy(F.desc("entries"), "at").drop("at")
