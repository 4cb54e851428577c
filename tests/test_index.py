"""An index that follows its files, prunes by pid, and answers without reading events; the kernel log in order."""

import os

import pytest

from tracequarry.__main__ import main
from tracequarry.sources.ftrace import kernel_log_header, read_lines, write_kernel_log
from tracequarry.sources.index import Index
from tracequarry.trace import TraceFile


def _line(k, pid=None, at=None):
    return f" p{k % 7}-{pid or k % 7} [00{k % 4}] d... {at if at is not None else k}.000000: sched_switch: prev_comm=p{k % 7} prev_pid={pid or k % 7} prev_prio=120 prev_state=S ==> next_comm=q next_pid={100 + k % 3} next_prio=120"


@pytest.fixture
def folder(tmp_path):
    path = tmp_path / "trace"
    path.mkdir()
    for n in range(3):
        (path / f"{n}.txt").write_text("\n".join(_line(n * 200 + k) for k in range(200)) + "\n")
    return path


def test_index_follows_files(spark, folder, tmp_path):
    trace = TraceFile(spark, str(folder), str(tmp_path / "index"))
    assert not trace.has_index() and trace.build_index() == 3 and trace.has_index()
    assert trace.build_index() == 0 and trace.get_event_count() == 600
    # a new file is indexed alone
    (folder / "3.txt").write_text(_line(700) + "\n")
    assert not trace.has_index() and TraceFile(spark, str(folder), trace.index).get_event_count() == 601
    assert trace.build_index() == 1 and trace.has_index() and trace.get_event_count() == 601
    assert trace.info()["event_count"] == 601 and len(Index(spark, trace.index).batches()) == 2
    # lines appended to a file of the folder
    with open(folder / "1.txt", "a") as f:
        f.write("\n".join(_line(800 + k) for k in range(10)) + "\n")
    assert not trace.has_index() and TraceFile(spark, str(folder), trace.index).get_event_count() == 611
    assert trace.build_index() == 4 and trace.get_event_count() == 611 and len(Index(spark, trace.index).batches()) == 1
    # a file that went
    os.remove(folder / "3.txt")
    assert trace.build_index() == 3 and trace.get_event_count() == 610


def test_a_build_that_broke_off_leaves_nothing(spark, folder, tmp_path, monkeypatch):
    trace = TraceFile(spark, str(folder), str(tmp_path / "index"))
    trace.build_index()
    (folder / "3.txt").write_text(_line(700) + "\n")
    with monkeypatch.context() as m:
        m.setattr("tracequarry.sources.index.uuid.uuid4", lambda: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            trace.build_index()
    spark.read.parquet(f"{trace.index}/batch={Index(spark, trace.index).batches()[0]}").write.parquet(f"{trace.index}/batch=half")
    assert trace.build_index() == 1 and trace.get_event_count() == 601


def test_pid_reads_its_partitions(spark, tmp_path):
    path = tmp_path / "trace.txt"
    # pid 9999 runs in one minute of forty
    path.write_text("\n".join(_line(k, 9999 if 1500 <= k < 1510 else None) for k in range(2400)) + "\n")
    trace = TraceFile(spark, str(path), str(tmp_path / "index"))
    plain = TraceFile(spark, str(path))
    trace.build_index()
    found = trace.query().pid(9999)
    want = plain.query().pid(9999).count()
    assert found.count() == want == 10
    text = found.frame._jdf.queryExecution().toString()
    assert "ts_part" in text.split("PartitionFilters:")[1].split("]")[0] and "25" in text
    assert trace.query().pid(3, 101).count() == plain.query().pid(3, 101).count() > 0
    assert trace.query().pid(123456).count() == 0
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    scan = trace.query().cpu(1).comm("p1").frame._jdf.queryExecution().executedPlan().toString()
    assert "In(" in scan.split("PushedFilters:")[1] or "EqualTo(task,p1)" in scan.split("PushedFilters:")[1]
    pushed = trace.query().pid(9999).frame._jdf.queryExecution().executedPlan().toString().split("PushedFilters:")[1]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(prev_pid,9999)" in pushed and "EqualTo(pid,9999)" in pushed


def test_folders_of_a_long_trace_are_few(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr("tracequarry.sources.index.FOLDERS", 8)
    (folder / "3.txt").write_text("\n".join(_line(k, at=k * 30) for k in range(100)) + "\n")  # 50 minutes
    trace, plain = TraceFile(spark, str(folder), str(tmp_path / "index")), TraceFile(spark, str(folder))
    assert trace.build_index() == 4

    def parts(batch):
        return sorted(int(x.split("=")[1]) for x in os.listdir(f"{trace.index}/batch={batch}") if x.startswith("ts_part="))

    (first,) = Index(spark, trace.index).batches()
    assert parts(first) == list(range(0, 50, 8)) and not [x for x in os.listdir(trace.index) if x.startswith("_parsed")]
    # a short file later has folders of a minute beside those of eight
    (folder / "4.txt").write_text("\n".join(_line(k, 7777 if k == 5 else None, at=1000 + k) for k in range(90)) + "\n")
    assert trace.build_index() == 1 and trace.info() == plain.info() | {"indexed": True}
    (second,) = set(Index(spark, trace.index).batches()) - {first}
    assert parts(second) == [16, 17, 18]
    for start, end in ((0, 3000), (1019, 1021), (1085, 1088), (479, 481), (480, 480), (2000, 2100)):
        found = trace.query().time_range(start, end)
        assert found.count() == plain.query().time_range(start, end).count() > 0
        assert "ts_part" in found.frame._jdf.queryExecution().executedPlan().toString().split("PartitionFilters:")[1].split("]")[0]
    assert trace.query().pid(7777).count() == plain.query().pid(7777).count() == 1
    assert trace.query().pid(3).count() == plain.query().pid(3).count() > 0


def test_info_of_an_index_reads_no_events(spark, folder, tmp_path):
    trace = TraceFile(spark, str(folder), str(tmp_path / "index"))
    want = TraceFile(spark, str(folder)).info()
    trace.build_index()
    for root, _, names in os.walk(trace.index):
        if "batch=" in root:
            for name in names:
                os.remove(os.path.join(root, name))  # nothing that info() says may come from there
    assert trace.info() == want | {"indexed": True}


def test_glance(spark, folder, tmp_path):
    small = TraceFile(spark, str(folder))
    want, got = small.info(), small.glance()
    assert got == want | {"line_count": 600}
    long = tmp_path / "long.txt"
    long.write_text("\n".join(_line(k) for k in range(20_000)) + "\n")
    seen = TraceFile(spark, str(long)).glance()
    assert seen["time_range"] == {"start": 0.0, "end": 19999.0, "duration": 19999.0} and abs(seen["event_count"] - 20_000) < 400
    empty = tmp_path / "empty.txt"
    empty.write_text("")
    assert TraceFile(spark, str(empty)).glance()["event_count"] == 0


def test_empty_trace(spark, tmp_path):
    path = tmp_path / "empty.txt"
    path.write_text("# nothing\n")
    trace = TraceFile(spark, str(path), str(tmp_path / "index"))
    trace.build_index()
    assert trace.has_index() and trace.info()["event_count"] == 0 and trace.get_event_count() == 0


def test_groups(spark, folder):
    result = TraceFile(spark, str(folder)).query().execute()
    groups = result.by_cpu()
    assert list(groups) == [0, 1, 2, 3] and len(groups[2]) == 150 and groups[2][0].ts == 2 * 10**9
    assert {r.cpu: r["count"] for r in groups.table().collect()} == dict.fromkeys(range(4), 150)
    with pytest.raises(KeyError):
        groups[9]


def test_groups_written(spark, folder, tmp_path):
    TraceFile(spark, str(folder)).query().execute().by_state().write(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("prev_state").count().collect()[0]["count"] == 600


def test_kernel_log_in_order(spark, tmp_path):
    path = tmp_path / "trace.txt"
    path.write_text("# tracer\n" + "\n".join(_line(k, at=(k * 7919) % 1000) for k in range(3000)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lines = read_lines(spark, str(path))
        done = write_kernel_log(lines, str(tmp_path / "log"))
        write_kernel_log(lines, str(tmp_path / "one.log"), single=True)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted(f for f in os.listdir(tmp_path / "log") if f.startswith("part-"))
    text = "".join((tmp_path / "log" / f).read_text() for f in parts)
    assert done["rows"] == 3000 and len(parts) > 1 and (tmp_path / "one.log").read_text() == text
    rows = text.splitlines()
    assert rows[0] == kernel_log_header() and len(rows) == 3001
    messages = [line.split(": ", 1)[1] for line in path.read_text().splitlines()[1:]]
    assert [r.split(": ", 2)[2] for r in rows[1:]] == messages
    assert main([str(path), "--kernel-log", str(tmp_path / "cli.log"), "--base-time", "2026-01-09T10:38:15Z"], spark) == 0
    assert (tmp_path / "cli.log").read_text() == text
