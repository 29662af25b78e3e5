import pytest
from pyspark.sql import functions as F

from flowlake.sources.csv_flows import discover, inspect, load_flows
from flowlake.sources import versions
from flowlake.sources.sinks import embeddings_wide, write_csv
from flowlake import fixtures
from conftest import SF


def write(folder, name, text, encoding="utf-8"):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(text.encode(encoding))


@pytest.fixture
def folder(tmp_path):
    base = tmp_path / "in"
    write(base, "day1.csv", "Source IP,Destination Port,Protocol,Flow Duration,Label\n"
                            "10.0.0.1,443,6,5000000,BENIGN\n10.0.0.2,80.0,17,7000000,DDoS\n10.0.0.3,,6,9000000,\n")
    write(base / "sub", "day2.csv", "﻿srcip,dport,proto,dur,label\n10.0.0.4,22,tcp,1.5,0\n10.0.0.5,53,udp,2.5\n")
    write(base / "sub", "day3.csv", "srcip,dport,proto,dur,label\n10.0.0.6,22,tcp,1.5,café€\n", "cp1252")
    write(base, "ports.csv", "srcip,dport\n10.0.0.7,0x01bb\n10.0.0.8,443\n")
    write(base, "ragged.csv", "srcip,dport\n10.0.0.9,443\n10.0.0.9,443,7\n")
    write(base, "my_events.csv", "a,b\n1,2\n")
    write(base, "UNSW_features.csv", "a,b\n1,2\n")
    write(base, "notes.txt", "a,b\n1,2\n")
    return str(base)


def test_discover_skips_documentation(spark, folder):
    names = [p.rsplit("/", 1)[-1] for p in discover(spark, [folder])]
    assert sorted(names) == ["day1.csv", "day2.csv", "day3.csv", "ports.csv", "ragged.csv"]
    with pytest.raises(ValueError):
        discover(spark, [folder + "/notes.txt"])
    with pytest.raises(Exception):
        discover(spark, [folder + "/absent"])


def test_inspect_finds_encodings_and_layouts(spark, folder):
    groups = {g.paths[0].rsplit("/", 1)[-1]: g for g in inspect(spark, discover(spark, [folder]))}
    assert groups["day3.csv"].encoding == "windows-1252" and groups["day1.csv"].encoding == "UTF-8"
    assert groups["day2.csv"].columns == ("srcip", "dport", "proto", "dur", "label")


def test_load_and_quarantine(spark, folder):
    flows, report = load_flows(spark, [folder], order_by=[F.col("src_ip")])
    verdict = {r.path.rsplit("/", 1)[-1]: r for r in report.collect()}
    assert not verdict["ports.csv"].accepted and verdict["ports.csv"].bad_rows == 1
    assert not verdict["ragged.csv"].accepted and verdict["ragged.csv"].too_long_rows == 1
    rows = {r.src_ip: r for r in flows.collect()}
    assert set(rows) == {f"10.0.0.{i}" for i in range(1, 7)}
    assert rows["10.0.0.1"].duration_sec == 5.0 and rows["10.0.0.4"].duration_sec == 1.5
    assert (rows["10.0.0.2"].dst_port, rows["10.0.0.3"].dst_port) == (80, 443)
    assert (rows["10.0.0.2"].protocol, rows["10.0.0.3"].label, rows["10.0.0.5"].label) == ("UDP", "nan", "nan")
    assert rows["10.0.0.6"].label == "café€"


def test_nothing_readable(spark, tmp_path):
    write(tmp_path / "bad", "x.csv", "srcip,dport\n1,http\n")
    with pytest.raises(FileNotFoundError):
        load_flows(spark, [str(tmp_path / "bad")])


def test_round_trip(spark, flows, tmp_path):
    write_csv(flows, str(tmp_path / "out"))
    back, report = load_flows(spark, [str(tmp_path / "out")])
    assert report.filter("NOT accepted").count() == 0
    same = ["flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "direction", "bytes", "label"]
    typed = back.withColumn("flow_id", F.col("flow_id").cast("long")).select(*same)
    assert typed.exceptAll(flows.select(*same)).count() == 0 and back.count() == flows.count()


def test_wide_embeddings(spark, flows):
    table = fixtures.embeddings(spark, SF).withColumn("src_ip", F.lit("1"))
    assert embeddings_wide(table).columns == ["src_ip", "label"] + [f"emb_{i}" for i in range(64)]


def test_dotted_folders_and_times_that_start_anew(spark, tmp_path):
    base = tmp_path / "flows.v1"
    base.mkdir()
    for name, n in (("a.csv", 3), ("b.csv", 400)):
        (base / name).write_text("src_ip,dst_port\n" + "".join(f"10.1.{k // 200}.{k % 200},443\n" for k in range(n)))
    flows, _ = load_flows(spark, [str(base)])
    times = sorted(str(r.timestamp) for r in flows.collect())
    assert times[:5] == ["2026-04-20 00:00:00"] * 2 + ["2026-04-20 00:00:05"] * 2 + ["2026-04-20 00:00:10"]
    for r in flows.collect():
        a, b = map(int, r.src_ip.split(".")[2:])
        assert (r.timestamp.hour * 3600 + r.timestamp.minute * 60 + r.timestamp.second) == 5 * (a * 200 + b)
    with pytest.raises(ValueError):
        (tmp_path / "x.json").write_text("{}")
        load_flows(spark, [str(tmp_path / "x.json")])


def test_units_and_dates_of_each_file(spark, tmp_path):
    """Files of one header: seconds and microseconds, day-first and month-first."""
    base = tmp_path / "captures"
    write(base, "a.csv", "srcip,dport,dur,timestamp\n10.0.0.1,443,5.5,13/02/2024 10:00\n10.0.0.2,443,7,01/02/2024 10:00\n")
    write(base, "b.csv", "srcip,dport,dur,timestamp\n10.0.1.1,443,5500000,02/13/2024 10:00\n10.0.1.2,443,7000000,02/01/2024 10:00\n")
    flows, _ = load_flows(spark, [str(base)])
    rows = {r.src_ip: (r.duration_sec, str(r.timestamp)[:10]) for r in flows.collect()}
    assert rows["10.0.0.1"] == rows["10.0.1.1"] == (5.5, "2024-02-13") and rows["10.0.0.2"] == rows["10.0.1.2"] == (7.0, "2024-02-01")
    assert not [c for c in flows.columns if c.startswith("_")]


def test_cells_over_several_lines(spark, tmp_path):
    base = tmp_path / "lines"
    write(base, "a.csv", 'srcip,dport,label\n10.0.0.1,443,"port\nscan, ""slow"""\n10.0.0.2,443,benign\n')
    write(base, "b.csv", 'srcip,dport,label\n10.0.1.1,443,benign\n')
    write(base, "c.csv", 'srcip,dport,label\n10.0.2.1,443,"caf\u00e9\n\u20ac"\n', "cp1252")
    groups = {g.paths[0][-5:]: g for g in inspect(spark, discover(spark, [str(base)]))}
    assert [groups[k].multi_line for k in ("a.csv", "b.csv", "c.csv")] == [True, False, True]
    flows, report = load_flows(spark, [str(base)])
    assert report.filter("accepted").count() == 3 and {r.n_rows for r in report.collect()} == {1, 2}
    assert {r.src_ip: r.label for r in flows.collect()} == {
        "10.0.0.1": 'port\nscan, "slow"', "10.0.0.2": "normal", "10.0.1.1": "normal", "10.0.2.1": "caf\u00e9\n\u20ac"}


def test_versions_are_published_whole(spark, tmp_path):
    root = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        versions.read_table(spark, root)
    assert versions.publish_table(spark.range(3), root) == 1

    def killed(folder):
        spark.range(5).write.parquet(folder)
        raise RuntimeError("killed between writes")

    with pytest.raises(RuntimeError):
        versions.publish(spark, root, killed)
    assert versions.versions(spark, root) == [1] and versions.read_table(spark, root).count() == 3
    assert versions.publish_table(spark.range(7), root) == 2
    assert versions.read_table(spark, root).count() == 7 and versions.read_table(spark, root, 1).count() == 3
    with pytest.raises(FileNotFoundError):
        versions.folder_of(spark, root, 9)


def test_a_number_is_taken_once(spark, tmp_path, monkeypatch):
    """A writer that looked before another one published goes on to the next number."""
    root = str(tmp_path / "table")
    versions.publish_table(spark.range(1), root)
    known, seen = versions.versions, []

    def stale(*args):
        seen.append(args)
        return [] if len(seen) == 1 else known(*args)

    monkeypatch.setattr(versions, "versions", stale)
    assert versions.publish_table(spark.range(2), root) == 2
    monkeypatch.undo()
    assert versions.read_table(spark, root, 1).count() == 1 and versions.read_table(spark, root).count() == 2
