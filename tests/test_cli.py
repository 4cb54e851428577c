import json
import os

from test_trace import ALIGNMENT

from tracequarry.__main__ import main


def test_flags(spark, tmp_path, capsys):
    path = str(tmp_path / "t.log")
    (tmp_path / "t.log").write_text("\n".join(ALIGNMENT))

    def shown(*flags):
        assert main([path, *flags], spark) == 0
        return capsys.readouterr().out

    assert "event_count: 3" in shown("--summary") and json.loads(shown("--info"))["cpu_count"] == 1
    assert json.loads(shown("--classify"))["idle"]["time_percent"] == 50.0
    assert json.loads(shown("--stats", "3711"))["run_time"] == 0.001 and json.loads(shown("--analyze-gaps", "5")) == []
    assert shown("--query-pid", "3711", "--format", "csv").count("sched_switch:") == 2
    assert len(json.loads(shown("--query-event", "sched_switch", "--time-range", "7541.835", "7542", "--format", "json"))) == 2
    assert shown("--scenario", "1").splitlines()[0].split() == ["cpu", "cpu_time_seconds", "cpu_usage_percent"]
    assert shown("--sql", "SELECT count(*) AS n FROM sched", "--format", "csv") == "n\n3\n\n"
    (tmp_path / "q.sql").write_text("-- two\nINCLUDE PERFETTO MODULE x;\nSELECT count(*) AS n\nFROM sched;\nSELECT 'a' AS b;\n")
    assert shown("--sql-file", str(tmp_path / "q.sql"), "--format", "csv") == "n\n3\n\nb\na\n\n"
    assert json.loads(shown("--stats", "kube-apiserver"))["run_time"] == 0.001
    assert shown("--query-pid", "3711", "--export-csv", str(tmp_path / "out")) == "" and (tmp_path / "out" / "_SUCCESS").exists()
    report = tmp_path / "r.md"
    shown("--report", str(report), "--index", str(tmp_path / "stored"))
    first = report.read_text()
    assert "## 30. Timeline gaps" in first and "- Failed: 0" in first
    report.write_text("kept")
    os.utime(report, (2_000_000_000, 2_000_000_000))
    shown("--report", str(report))
    assert report.read_text() == "kept"
    shown("--report", str(report), "--force")
    dated = lambda text: [line for line in text.splitlines() if not line.startswith("- Date: ")]
    assert dated(report.read_text()) == dated(first)
