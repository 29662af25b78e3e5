import pytest
from pyspark.sql import functions as F

from flowlake.functions.numeric import fixed_text, parse_number
from flowlake.functions.ports import port_band, port_of_service
from flowlake.functions.text import (canonical_protocol, failed_state, infer_direction, is_known_attack,
                                     normal_label, parse_timestamp)
from flowlake.operators.prepare import (coerce_numbers, column_key, detect_units, parse_timestamps,
                                        prepare_flows, standardize_columns)


def one(spark, values, expression, kind="string"):
    table = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in table.orderBy("i").select(expression(F.col("v"))).collect()]


def test_protocol(spark):
    cases = {"6": "TCP", " 6 ": "TCP", "17": "UDP", "1": "ICMP", "47": "OTHER", "6.0": "OTHER", "icmpv6": "ICMP",
             "ipv6-icmp": "OTHER", "tcp-x": "TCP", "udplite": "UDP", "": "OTHER", None: "OTHER", "sctp": "OTHER"}
    assert one(spark, list(cases), canonical_protocol) == list(cases.values())


def test_label(spark):
    cases = {"BENIGN": "normal", "0": "normal", "1": "anomalous", "DDoS": "ddos", "": "unknown", None: "nan",
             "0.0": "0.0", " True ": "anomalous"}
    assert one(spark, list(cases), normal_label) == list(cases.values())
    assert one(spark, ["nan", "0.0", "unknown", "normal"], is_known_attack) == [True, True, False, False]
    assert one(spark, [None], lambda c: normal_label(c, "unknown")) == ["unknown"]


def test_direction(spark):
    rows = [("10.0.0.1", "8.8.8.8"), ("8.8.8.8", "192.168.1.5"), ("10.0.0.1", "172.16.9.9"), ("x", "10.0.0.1"),
            ("2001:4860::8888", "fd00::1"), ("8.8.8.8", "300.1.1.1")]
    table = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in table.select(infer_direction(F.col("a"), F.col("b"))).collect()]
    assert got == ["outbound", "inbound", "outbound", "outbound", "inbound", "outbound"]


def test_numbers(spark):
    values = ["1", " 2.5 ", "1e3", "12d", "NaN", "", "-.5", "0x10", None, "-inf"]
    assert one(spark, values, parse_number) == [1.0, 2.5, 1000.0, None, None, None, -0.5, None, None, float("-inf")]
    assert one(spark, [0.125, 2.675, 1234.565, 0.0], fixed_text, "double") == ["0.12", "2.67", "1234.57", "0.00"]


def test_lookups(spark):
    assert one(spark, ["HTTP", "ftp-data", "-", None], port_of_service) == [80, 20, 0, 0]
    assert one(spark, ["rej", "S0", "SF", None], failed_state) == [1.0, 1.0, 0.0, 0.0]
    assert one(spark, [443, 81, 0, 9999, 10000], port_band, "int") == [
        "https", "system-other", "system-other", "registered", "dynamic"]


def test_timestamps(spark):
    values = ["2024-01-02 03:04:05", "7/13/2017 8:59", "13/7/2017 8:59", "junk", None, "1500000000000000000"]
    got = [str(v) if v else None for v in one(spark, values, lambda c: parse_timestamp(c).cast("string"))]
    assert got == ["2024-01-02 03:04:05", "2017-07-13 08:59:00", None, None, None, "2017-07-14 02:40:00"]
    got = [str(v) if v else None for v in one(spark, values, lambda c: parse_timestamp(c, day_first=True).cast("string"))]
    assert got[1:3] == [None, "2017-07-13 08:59:00"]


def test_day_and_month_are_told_apart_per_file(spark):
    rows = [("a", "12/07/2017 08:59"), ("a", "13/07/2017 08:59"), ("b", "12/07/2017 08:59"), ("b", "12/13/2017 08:59"), ("c", "2017-01-02 00:00:00"),
            ("c", None)]
    table = spark.createDataFrame(rows, "file string, timestamp string")
    got = [(r.file, str(r.timestamp)[:10]) for r in parse_timestamps(table, source="file").orderBy("file", "timestamp").collect()]
    assert got == [("a", "2017-07-12"), ("a", "2017-07-13"), ("b", "2017-12-07"), ("b", "2017-12-13"), ("c", "None"), ("c", "2017-01-02")]
    one_file = parse_timestamps(table.filter("file = 'a'")).orderBy("timestamp").collect()
    assert [str(r.timestamp)[:10] for r in one_file] == ["2017-07-12", "2017-07-13"]


def test_aliases(spark):
    assert column_key(" Total_Length of-Bwd ") == "totallengthofbwd"
    table = spark.createDataFrame([(1, 2, 3, 4)], "`Dst Port` int, dpkts int, spkts int, dur int")
    named = standardize_columns(table)
    assert named.columns == ["dst_port", "dpkts", "packets", "duration_sec"]
    kept = standardize_columns(spark.createDataFrame([(1, 2)], "packets int, `Total Fwd Packets` int"))
    assert kept.columns == ["packets", "Total Fwd Packets"]


@pytest.mark.parametrize("values,factor", [([1000, 1000, 1000], None), ([1001, 1001, 1001], 1e-6),
                                           ([10, 1990], None), ([10, 1992], 1e-6), ([5, -4000, 4000], 1e-6)])
def test_duration_units(spark, values, factor):
    table = spark.createDataFrame([(float(v),) for v in values], "duration_sec double")
    assert detect_units(table).factors.get("duration_sec") == factor


@pytest.mark.parametrize("values,factor", [([9.9, 0, 0], 1000.0), ([10, 0], 1.0), ([0, 0], 0.0), ([5, 15], 1.0),
                                           ([5, 14.9], 1000.0)])
def test_jitter_units(spark, values, factor):
    table = spark.createDataFrame([(float(v),) for v in values], "sjit double")
    assert detect_units(table).factors["sjit"] == factor


def test_clamps(spark):
    table = spark.createDataFrame([(-1.0, 0.0, 70000.0)], "packets double, duration_sec double, inter_arrival_mean_ms double")
    row = coerce_numbers(table).first()
    assert (row.packets, row.duration_sec, row.inter_arrival_mean_ms, row.bytes) == (0.0, 1e-6, 60000.0, 0.0)


def test_defaults_and_options(spark):
    table = spark.createDataFrame([(1, None, "8.8.8.8", "10.1.1.1", "Exploits", 3, 4)],
                                  "flow_id int, sport string, srcip string, dstip string, attack_cat string, "
                                  "spkts int, dpkts int")
    row = prepare_flows(table, order_by=[F.col("flow_id")]).first()
    assert (row.src_port, row.dst_port, row.protocol, row.direction, row.packets) == (40000, 443, "TCP", "outbound", 3.0)
    assert row.label == "exploits" and str(row.timestamp) == "2026-04-20 00:00:00"
    row = prepare_flows(table, order_by=[F.col("flow_id")], volume="sum", infer_flow_direction=True).first()
    assert (row.packets, row.direction) == (7.0, "inbound")


def test_label_fallback(spark):
    table = spark.createDataFrame([(1, None, "Worms", "443.0"), (2, "0", "x", "abc")],
                                  "flow_id int, label string, attack_cat string, dst_port string")
    rows = prepare_flows(table, order_by=[F.col("flow_id")], label_fallback="attack_cat").orderBy("flow_id").collect()
    assert [r.label for r in rows] == ["worms", "normal"]
    assert [r.dst_port for r in rows] == [443, None]
