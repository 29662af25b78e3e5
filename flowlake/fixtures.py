"""Flow fixture: a deterministic projection of the ``events`` table.

The expressions use only arithmetic that Spark SQL and ANSI SQL engines share,
so the same text builds the input on both sides of a comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .session import spread

# One flow per event, as an access log of a shop would show it: the kind of event decides the service, the
# user the host, the value the length of the session. Errors are short-lived attempts on other ports.
_PACKETS = "(2 + floor(value / 3) + user_id % 7)"
_PORT = ("(CASE event_type WHEN 'click' THEN 443 WHEN 'view' THEN (CASE user_id % 3 WHEN 0 THEN 443 WHEN 1 THEN 80 ELSE 8080 END) "
         "WHEN 'purchase' THEN (CASE user_id % 4 WHEN 0 THEN 5432 WHEN 1 THEN 443 ELSE 8080 END) "
         "WHEN 'signup' THEN (CASE user_id % 3 WHEN 0 THEN 25 WHEN 1 THEN 53 ELSE 123 END) "
         "ELSE (CASE event_id % 6 WHEN 0 THEN 3389 WHEN 1 THEN 445 WHEN 2 THEN 22 WHEN 3 THEN 6667 WHEN 4 THEN 443 ELSE 50000 END) END)")
_PROTOCOL = (f"(CASE WHEN event_id % 90 = 7 THEN 'OTHER' WHEN event_id % 45 = 11 THEN 'ICMP' WHEN {_PORT} IN (53, 123) THEN 'UDP' "
             "ELSE 'TCP' END)")
_DURATION = "(0.02 + value * value / 300)"


def _tcp(ratio: str) -> str:
    return f"CAST(CASE WHEN {_PROTOCOL} = 'TCP' THEN {ratio} ELSE 0.0 END AS DOUBLE)"


FLOW_EXPRESSIONS: dict[str, str] = {
    "flow_id": "event_id",
    "timestamp": "CAST(ts AS TIMESTAMP)",
    "dataset_source": "CASE WHEN user_id % 10 < 5 THEN 'shop' WHEN user_id % 10 < 8 THEN 'office' ELSE 'branch' END",
    "src_ip": "concat('192.168.', CAST(user_id % 16 AS STRING), '.', CAST(user_id % 200 + 1 AS STRING))",
    "dst_ip": ("CASE WHEN event_type IN ('signup', 'error') AND user_id % 2 = 1 THEN concat('10.9.', CAST(event_id % 4 AS STRING), '.', "
               "CAST(user_id % 90 + 5 AS STRING)) ELSE concat('93.', CAST(user_id % 190 AS STRING), '.', CAST(event_id % 13 AS STRING), "
               "'.7') END"),
    "src_port": "CAST(32768 + (event_id * 31 + user_id) % 28000 AS INT)",
    "dst_port": f"CAST({_PORT} AS INT)",
    "protocol": _PROTOCOL,
    "direction": "CASE WHEN event_type = 'signup' OR user_id % 9 = 0 THEN 'inbound' ELSE 'outbound' END",
    "duration_sec": f"CAST({_DURATION} AS DOUBLE)",
    "packets": f"CAST({_PACKETS} AS DOUBLE)",
    "bytes": f"CAST({_PACKETS} * (90 + (user_id * user_id) % 1301) AS DOUBLE)",
    "tcp_syn_ratio": _tcp(f"least((1 + event_id % 4) / {_PACKETS}, 1.0)"),
    "tcp_ack_ratio": _tcp(f"1 - 2 / {_PACKETS}"),
    "tcp_fin_ratio": _tcp(f"CASE WHEN event_type = 'error' THEN 0 ELSE 1 / {_PACKETS} END"),
    "inter_arrival_mean_ms": f"CAST({_DURATION} * 1000 / {_PACKETS} AS DOUBLE)",
    "inter_arrival_std_ms": f"CAST({_DURATION} * 1000 / {_PACKETS} * (user_id % 12) / 10 AS DOUBLE)",
    "failed_connections": "CAST(CASE WHEN event_type = 'error' THEN 1 + user_id % 4 ELSE 0 END AS DOUBLE)",
    "label": ("CASE WHEN event_id % 97 = 3 THEN 'unknown' WHEN event_type = 'error' AND value > 45 THEN 'anomalous' "
              "WHEN value > 210 THEN 'anomalous' ELSE 'normal' END"),
}


def _fixed_point(expression: str, digits: int) -> str:
    """Text of a non-negative number cut after ``digits`` decimals."""
    scaled = f"CAST(floor({expression} * {10 ** digits}) AS BIGINT)"
    return (f"concat(CAST(({scaled} - {scaled} % {10 ** digits}) / {10 ** digits} AS BIGINT), '.', "
            f"lpad(CAST({scaled} % {10 ** digits} AS STRING), {digits}, '0'))")


# Raw layouts as they come out of CSV files: every column is text, units and
# names differ from the canonical ones, and some cells are dirty on purpose.
RAW_LAYOUTS: dict[str, dict[str, str]] = {
    # forward/backward totals, microseconds, protocol numbers
    "fwd_bwd": {
        "flow_id": "flow_id",
        "Timestamp": ("CASE WHEN flow_id % 29 = 0 THEN 'not a date' "
                      "WHEN flow_id % 31 = 0 THEN NULL "
                      "ELSE CAST(date_trunc('second', timestamp) AS STRING) END"),
        "Source IP": "src_ip",
        "Destination IP": "dst_ip",
        "Source Port": "CASE WHEN flow_id % 23 = 0 THEN NULL ELSE CAST(src_port AS STRING) END",
        "Destination Port": "CAST(dst_port AS STRING)",
        "Protocol": ("CASE WHEN flow_id % 19 = 0 THEN '47' WHEN protocol = 'TCP' THEN '6' "
                     "WHEN protocol = 'UDP' THEN ' 17 ' ELSE '1' END"),
        "Flow Duration": ("CASE WHEN flow_id % 37 = 0 THEN 'n/k' WHEN flow_id % 41 = 0 THEN '-5' "
                          "ELSE CAST(CAST(floor(duration_sec * 1000000) AS BIGINT) AS STRING) END"),
        "Total Fwd Packets": "CAST(CAST(packets AS BIGINT) AS STRING)",
        "Total Backward Packets": ("CASE WHEN flow_id % 13 = 0 THEN NULL "
                                   "ELSE CAST(flow_id % 11 AS STRING) END"),
        "Total Length of Fwd Packets": ("CASE WHEN flow_id % 43 = 0 THEN '12d' "
                                        "ELSE CAST(CAST(bytes AS BIGINT) AS STRING) END"),
        "Total Length of Bwd Packets": "CAST(flow_id % 700 AS STRING)",
        "Flow IAT Mean": "CAST(CAST(floor(inter_arrival_mean_ms * 1000) AS BIGINT) AS STRING)",
        "Flow IAT Std": ("CASE WHEN flow_id % 47 = 0 THEN 'NaN' ELSE "
                         "CAST(CAST(floor(inter_arrival_std_ms * 1000) AS BIGINT) AS STRING) END"),
        "SYN Flag Count": "CAST(CAST(floor(tcp_syn_ratio * packets) AS BIGINT) AS STRING)",
        "ACK Flag Count": "CAST(CAST(floor(tcp_ack_ratio * packets) AS BIGINT) AS STRING)",
        "FIN Flag Count": "CAST(CAST(floor(tcp_fin_ratio * packets) AS BIGINT) AS STRING)",
        "Label": ("CASE WHEN label = 'normal' THEN 'BENIGN' WHEN flow_id % 5 = 0 THEN 'PortScan' "
                  "WHEN flow_id % 5 = 1 THEN ' Malicious ' WHEN flow_id % 5 = 2 THEN '' "
                  "ELSE 'DDoS' END"),
    },
    # s/d prefixed counters, seconds, service instead of destination port
    "src_dst_short": {
        "flow_id": "flow_id",
        "srcip": "src_ip",
        "dstip": "dst_ip",
        "sport": "CAST(src_port AS STRING)",
        "proto": ("CASE WHEN flow_id % 19 = 0 THEN 'ospf' WHEN flow_id % 97 = 0 THEN NULL "
                  "WHEN flow_id % 53 = 0 THEN 'tcp-x' WHEN flow_id % 59 = 0 THEN 'ipv6-icmp' "
                  "ELSE lower(protocol) END"),
        "state": ("CASE WHEN failed_connections >= 3 THEN 'rej' WHEN failed_connections >= 1 "
                  "THEN 'INT' WHEN flow_id % 61 = 0 THEN NULL ELSE 'FIN' END"),
        "service": ("CASE dst_port WHEN 80 THEN 'HTTP' WHEN 443 THEN 'ssl' WHEN 22 THEN 'ssh' "
                    "WHEN 25 THEN 'smtp' WHEN 53 THEN 'dns' WHEN 4444 THEN 'ftp-data' ELSE '-' END"),
        "dur": _fixed_point("duration_sec", 3),
        "spkts": "CAST(CAST(packets AS BIGINT) AS STRING)",
        "dpkts": "CAST(flow_id % 9 AS STRING)",
        "sbytes": "CAST(CAST(bytes AS BIGINT) AS STRING)",
        "dbytes": "CASE WHEN flow_id % 13 = 0 THEN 'bad' ELSE CAST(flow_id % 900 AS STRING) END",
        "sinpkt": _fixed_point("inter_arrival_mean_ms", 2),
        "dinpkt": _fixed_point("inter_arrival_mean_ms / 1000", 4),
        "sjit": _fixed_point("inter_arrival_std_ms", 2),
        "djit": "'0'",
        "attack_cat": ("CASE WHEN label = 'normal' THEN 'Normal' WHEN flow_id % 2 = 0 "
                       "THEN 'Exploits' ELSE 'Fuzzers' END"),
        "Label": "CASE WHEN label = 'normal' THEN '0' WHEN flow_id % 7 = 0 THEN NULL ELSE '1' END",
    },
    # src/dst prefixed counters, connection state, no unit problems
    "src_dst_long": {
        "flow_id": "flow_id",
        "src_ip": "src_ip",
        "src_port": "CAST(src_port AS STRING)",
        "dst_ip": "dst_ip",
        "dst_port": "CAST(dst_port AS STRING)",
        "proto": "lower(protocol)",
        "service": "'-'",
        "duration": _fixed_point("duration_sec", 4),
        "src_bytes": "CAST(CAST(bytes AS BIGINT) AS STRING)",
        "dst_bytes": "CAST(flow_id % 500 AS STRING)",
        "conn_state": ("CASE WHEN failed_connections >= 3 THEN 'S0' WHEN failed_connections >= 1 "
                       "THEN 'OTH' ELSE 'SF' END"),
        "src_pkts": "CAST(CAST(packets AS BIGINT) - 5 AS STRING)",
        "dst_pkts": "CAST(flow_id % 6 AS STRING)",
        "label": "CASE WHEN label = 'normal' THEN '0' ELSE '1' END",
        "type": "CASE WHEN label = 'normal' THEN 'normal' ELSE 'scanning' END",
    },
}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture flows of one scale factor, already in canonical form."""
    return spread(events(spark, sf_dir)).selectExpr(
        *[f"{expression} AS `{name}`" for name, expression in FLOW_EXPRESSIONS.items()])


def raw_flows(spark: SparkSession, sf_dir: str, layout: str) -> DataFrame:
    """The fixture flows in one of the raw CSV-like layouts."""
    return flows(spark, sf_dir).selectExpr(
        *[f"{expression} AS `{name}`" for name, expression in RAW_LAYOUTS[layout].items()])


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def duckdb_flows_cte() -> str:
    """``flows`` as a common table expression for the comparison engine."""
    columns = ",\n    ".join(f'{expression} AS "{name}"' for name, expression in FLOW_EXPRESSIONS.items())
    return f"flows AS (SELECT {columns} FROM events)".replace("AS STRING", "AS VARCHAR")


def duckdb_raw_cte(layout: str) -> str:
    columns = ",\n    ".join(
        f'{expression} AS "{name}"' for name, expression in RAW_LAYOUTS[layout].items())
    return f"raw AS (SELECT {columns} FROM flows)".replace("AS STRING", "AS VARCHAR")
