"""Counts while a job runs."""

from tracequarry.__main__ import main
from tracequarry.functions.progress import Progress
from tracequarry.sources.ftrace import parse_events, read_lines


def test_intermediate_counts(spark, tmp_path):
    path = tmp_path / "trace.txt"
    line = " p-7 [001] d... {}.000000: sched_switch: prev_comm=p prev_pid=7 prev_prio=120 prev_state=S ==> next_comm=q next_pid=9 next_prio=120"
    path.write_text("\n".join(line.format(k) for k in range(60_000)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    seen = []
    try:
        with Progress(spark, lambda read, written, seconds: seen.append((read, written)), 1000, 0.02):
            parse_events(read_lines(spark, str(path))).write.parquet(str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert seen[-1] == (60_000, 60_000) and seen == sorted(seen)
    assert any(0 < read < 60_000 for read, _ in seen[:-1])
    # jobs outside are not counted
    again = len(seen)
    spark.range(10).count()
    assert len(seen) == again


def test_command_tells_progress(spark, tmp_path, capsys):
    path = tmp_path / "trace.txt"
    path.write_text(" p-7 [001] d... 1.000000: x: y\n")
    assert main([str(path), "--kernel-log", str(tmp_path / "k.log")], spark) == 0
    out, err = capsys.readouterr()
    assert "1 rows in" in out and "read" in err
