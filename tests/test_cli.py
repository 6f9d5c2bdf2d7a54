"""The command line end to end."""

import json

import pytest
import yaml

from covspark.__main__ import arguments, main

RULE = yaml.safe_dump({"title": "Curl", "id": "c", "level": "high", "tags": ["attack.t1105"], "logsource": {"product": "linux", "category": "process_creation"}, "detection": {"s": {"Image|endswith": "/curl"}, "condition": "s"}})


@pytest.fixture
def files(tmp_path):
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules/a.yml").write_text(RULE)
    (tmp_path / "s.sh").write_text("curl x\nwget y\nls\n")
    return tmp_path


def test_usage_errors(spark):
    for bad in ([], ["a", "-c", "b"], ["-c", "x", "--coverage-gaps"], ["-c", "x", "--json", "--sarif"], ["-c", "x", "--platform", "beos"]):
        with pytest.raises(SystemExit) as e:
            arguments(bad)
        assert e.value.code == 2
    assert main(["-c", "x", "--check-rule", "/no/such/file"]) == 2


def test_reports_and_gates(spark, files, capsys):
    script = f"file://{files}/s.sh"
    assert main([script, "--json", "--ci", "--threshold", "90"]) == 0
    saved = json.loads(capsys.readouterr().out)
    assert [f["rule_id"] for f in saved["findings"]] == ["curl", "wget"]
    assert main([script, "--ci", "--edr", "s1"]) == 1
    assert "IP Connect" in capsys.readouterr().out
    (files / "old.json").write_text(json.dumps(saved))
    assert main(["-c", "curl x; id", "--diff", f"{files}/old.json"]) == 0
    assert capsys.readouterr().out.split() == ["added", "id", "removed", "wget"]
    assert main([script, "--sarif", "--sigma", f"{files}/rules"]) == 0
    assert "Detection: Sigma: Curl (c) (high confidence)" in json.loads(capsys.readouterr().out)["runs"][0]["results"][0]["message"]["text"]


def test_audit_modes(spark, files, capsys):
    sigma = ["--sigma", f"{files}/rules", "--sigma-cache", f"file://{files}/cache"]
    assert main([f"file://{files}/s.sh", "--coverage-gaps", "--ci", *sigma]) == 1
    assert "1 covered, 1 gap" in capsys.readouterr().out
    assert main([f"file://{files}/s.sh", "--coverage-gaps", "--json", *sigma]) == 0
    saved = capsys.readouterr().out
    (files / "cov.json").write_text(saved)
    assert main([f"file://{files}/s.sh", "--coverage-gaps", "--diff", f"{files}/cov.json", "--ci", *sigma]) == 0
    capsys.readouterr()
    assert main(["--verify-detections", "--json", "--sigma-ref", "abc", *sigma]) == 0
    claims = capsys.readouterr().out
    assert {r["id"]: r["status"] for r in json.loads(claims)["results"]}["curl"] == "verified"
    (files / "v.json").write_text(claims)
    assert main(["--verify-detections", "--diff", f"{files}/v.json", "--ci", *sigma]) == 0
    capsys.readouterr()
    assert main(["--scaffold", "curl", "--ci"]) == 0
    assert yaml.safe_load(capsys.readouterr().out)["detection"]["selection"] == {"Image|endswith": "/curl"}
    assert main(["-c", "curl x", "--check-rule", f"{files}/rules/a.yml"]) == 0
    assert capsys.readouterr().out == "L1 curl: fires\n"
