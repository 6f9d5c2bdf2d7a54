"""The command line. Exit codes: 0 passed, 1 a gate failed, 2 wrong use or a file that can't be read."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import serve
from .fixed import PRODUCT
from .operators.candidates import KEY, enrich
from .operators.edr import annotate
from .operators.kb import load
from .plans import analyze, coverage, deltas, verify
from .sinks import exports, gates, scaffold, text
from .sources import ruleset, runs, telemetry


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser("covspark", description="What a defender would see of commands or recorded telemetry.")
    p.add_argument("path", nargs="?", help="a script, or a folder of them; - for standard input")
    p.add_argument("-c", "--command", help="a command line instead of a path")
    p.add_argument("--telemetry", help="recorded telemetry instead of a script")
    p.add_argument("--format", choices=telemetry.FORMATS, default="sysmon")
    p.add_argument("--users", help="a passwd file that names audit uids")
    p.add_argument("--platform", choices=list(PRODUCT), default="linux-auditd")
    p.add_argument("--min", type=int, default=0, help="hide quieter findings; gates still see them")
    p.add_argument("--threshold", type=int, default=gates.THRESHOLD)
    p.add_argument("--ci", action="store_true", help="exit 1 if a gate fails")
    shape = p.add_mutually_exclusive_group()
    for name in ("json", "sarif", "navigator"):
        shape.add_argument(f"--{name}", action="store_true")
    p.add_argument("--no-color", action="store_true")
    p.add_argument("--edr", nargs="?", const="all", action="append", help="vendors' events: a name, or all")
    p.add_argument("--sigma", help="a folder of rules")
    p.add_argument("--sigma-cache", help="a folder for parsed rules")
    p.add_argument("--no-sigma-cache", action="store_true")
    p.add_argument("--sigma-ref", help="the commit of the rules, kept with verified claims")
    mode = p.add_mutually_exclusive_group()
    mode.add_argument("--check-rule", help="a rule file, judged on each command")
    mode.add_argument("--coverage-gaps", action="store_true")
    mode.add_argument("--scaffold", nargs="*", metavar="ID", help="starter rules of entries, or of findings")
    mode.add_argument("--verify-detections", action="store_true")
    p.add_argument("--diff", help="a saved run of the same kind")
    args = p.parse_args(argv)
    if sum(x is not None for x in (args.path, args.command, args.telemetry)) > 1:
        p.error("one of a path, --command and --telemetry")
    if (args.coverage_gaps or args.verify_detections) and not args.sigma:
        p.error("this mode needs --sigma")
    if not (args.verify_detections or args.scaffold) and not (args.path or args.command or args.telemetry):
        p.error("nothing to analyze")
    return args


def main(argv: list[str] | None = None) -> int:
    args = arguments(argv)
    spark = SparkSession.builder.appName("covspark").getOrCreate()
    try:
        return run(spark, args)
    except (OSError, ValueError) as e:
        print(f"covspark: {e}", file=sys.stderr)
        return 2


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    kb = load(args.platform)
    colour = sys.stdout.isatty() and not args.no_color
    cache = None if args.no_sigma_cache else args.sigma_cache
    index = ruleset.load(spark, args.sigma, kb.product, cache) if args.sigma else None
    if args.verify_detections:
        return _verify(spark, args, kb, index, colour)
    if args.scaffold:
        entries = scaffold.entries_by_ids(kb, args.scaffold)
        print("---\n".join(d for e in entries for d in scaffold.documents(e, args.platform)), end="")
        return 0 if entries else 2
    if args.telemetry:
        users = telemetry.passwd(telemetry.read_files(spark, args.users)) if args.users else None
        read = telemetry.read_lines if args.format == "auditd" else telemetry.read_files  # JSON may be one value a file
        found = telemetry.ingest(read(spark, args.telemetry), args.format, users)
        units = found.observations.select("src").unionByName(found.events.select("src"))
        findings = analyze.observed(found, kb)
    else:
        body = sys.stdin.read() if args.path == "-" else args.command
        scripts = spark.createDataFrame([("command", body)], "src string, text string") if body is not None else telemetry.read_files(spark, args.path)
        if args.check_rule:
            with open(args.check_rule) as f:
                rule = f.read()
            rows = [r for s in scripts.collect() for r in serve.check_rule(spark, rule, s.text, args.platform).orderBy("line").collect()]
            for r in rows:
                print(f"L{r.line} {r.command.program}: {r.verdict.outcome}")
            return int(args.ci and not any(r.verdict.outcome == "fires" for r in rows))
        units = analyze.script_units(scripts)
        findings = analyze.predictive(units, kb)
    if args.coverage_gaps:
        return _coverage(spark, args, kb, index, findings, colour)
    if index:
        findings = enrich(findings, index, args.platform)
    reports = analyze.report(findings, units, kb, args.min).cache()
    if args.scaffold is not None:
        ids = [r.rule_id for r in findings.select("rule_id").distinct().orderBy("rule_id").collect()]
        print("---\n".join(d for e in scaffold.entries_by_ids(kb, ids) for d in scaffold.documents(e, args.platform)), end="")
        return 0
    if args.diff:
        old = runs.rows(runs.read(spark, args.diff, "report"), "report")
        new = reports.select("platform", F.posexplode("findings").alias("pos", "r")).select("platform", "pos", "r.*")
        print(text.delta(deltas.findings_delta(old, new).collect()), end="")
    elif args.sarif or args.navigator or args.json:
        made = exports.sarif(reports) if args.sarif else exports.navigator(reports) if args.navigator else exports.report_json(reports)
        for r in made.orderBy("src").toLocalIterator():
            print(r.json)
    else:
        shown = reports
        if args.edr:
            each = reports.select("src", F.posexplode("findings").alias("pos", "f")).select("src", "pos", "f.*")
            with_edr = annotate(each, args.edr, ["src", "pos"])
            listed = with_edr.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("pos", F.struct(*(c for c in with_edr.columns if c not in ("src", "pos"))).alias("f")))).alias("rows"))
            shown = reports.drop("findings").join(listed, "src").withColumn("findings", F.transform("rows", lambda x: x["f"]))
        for r in shown.orderBy("src").toLocalIterator():
            print(text.report(r, colour))
    return gates.exit_code(gates.loud(reports, args.threshold)) if args.ci else 0


def _coverage(spark, args, kb, index, findings, colour) -> int:
    results = coverage.coverage(findings, index, args.platform).cache()
    if args.diff:
        old = runs.rows(runs.read(spark, args.diff, "coverage"), "coverage")
        new = results.withColumn("pos", F.monotonically_increasing_id())
        print(text.delta(deltas.coverage_delta(old, new).collect()), end="")
        return int(args.ci and deltas.coverage_gate(old, new).first().regressed)
    if args.scaffold is not None:
        ids = [r.rule_id for r in results.where("coverage = 'gap'").select("rule_id").distinct().orderBy("rule_id").collect()]
        print("---\n".join(d for e in scaffold.entries_by_ids(kb, ids) for d in scaffold.documents(e, args.platform)), end="")
    elif args.json:
        print(exports.rows_json(results, {"platform": F.lit(kb.product), "rules_indexed": F.lit(index.rules_indexed)}, ["line", "rule_id"]).first().json)
    else:
        print(text.coverage(results.orderBy(*KEY).collect(), colour), end="")
    return gates.exit_code(gates.gaps(results)) if args.ci else 0


def _verify(spark, args, kb, index, colour) -> int:
    results = verify.verify(spark, kb, index).cache()
    if args.diff:
        whole = runs.read(spark, args.diff, "verify")
        if whole.first().platform != kb.product:
            raise ValueError("the saved run is of another platform")
        old = runs.rows(whole, "verify")
        print(text.delta(deltas.verify_delta(old, results).collect()), end="")
        gate = deltas.verify_gate(old, results).first()
        print(gate.reason)
        return int(args.ci and gate.fails)
    if args.json:
        print(exports.rows_json(results, {"platform": F.lit(kb.product), "sigma_ref": F.lit(args.sigma_ref), "rules_indexed": F.lit(index.rules_indexed)}, ["id"]).first().json)
    else:
        print(text.verified(results.collect(), colour), end="")
        for r in verify.causes(results).collect():
            print(f"  {r.cause}: {r.entries} {r.detail}")
    return gates.exit_code(gates.unverified(results)) if args.ci else 0


if __name__ == "__main__":
    sys.exit(main())
