"""Comparison SQL for the query catalogue, written for DuckDB.

Each statement states the result on its own terms (``median``,
``quantile_cont``, self joins); nothing is shared with the Spark side but the
fixture that derives the input tables.
"""

from __future__ import annotations

from ..fixtures import FLOW_EXPRESSIONS, duckdb_flows_cte, duckdb_raw_cte
from ..schema import (COLUMN_ALIASES, ENCODER_COLUMNS, FAILED_STATES, FEATURE_COLUMNS, FEATURE_WORDING,
                      PRIVATE_IPV4_BLOCKS, PROTOCOL_NAMES, SERVICE_NAME_PORTS, SERVICE_PORTS)

FLOWS = duckdb_flows_cte()


def _map(values: dict) -> str:
    def lit(x):
        return f"'{x}'" if isinstance(x, str) else str(x)
    return "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in values.items()) + "}"


def with_flows(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([FLOWS, *ctes]) + "\n" + select


def with_raw(layout: str, *ctes: str, select: str) -> str:
    return with_flows(duckdb_raw_cte(layout), *ctes, select=select)


# -- scalar rules ------------------------------------------------------------

def number(text: str) -> str:
    return (f"CASE WHEN regexp_full_match({text}, '\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)"
            f"([eE][+-]?[0-9]+)?\\s*') THEN CAST(trim({text}) AS DOUBLE) ELSE 0.0 END")


def protocol(text: str) -> str:
    t = f"upper(trim({text}))"
    return (f"CASE WHEN {text} IS NULL THEN 'OTHER' WHEN {t} IN ('6') THEN 'TCP' WHEN {t} = '17' THEN 'UDP' "
            f"WHEN {t} = '1' THEN 'ICMP' WHEN map_contains({_map(PROTOCOL_NAMES)}, {t}) "
            f"THEN {_map(PROTOCOL_NAMES)}[{t}] WHEN starts_with({t}, 'TCP') THEN 'TCP' "
            f"WHEN starts_with({t}, 'UDP') THEN 'UDP' WHEN starts_with({t}, 'ICMP') THEN 'ICMP' "
            "ELSE 'OTHER' END")


def label(text: str, null_label: str = "nan") -> str:
    t = f"lower(trim({text}))"
    return (f"CASE WHEN {text} IS NULL THEN '{null_label}' "
            f"WHEN {t} IN ('0', 'normal', 'benign', 'false', 'legitimate') THEN 'normal' "
            f"WHEN {t} IN ('1', 'attack', 'anomaly', 'anomalous', 'malicious', 'true') THEN 'anomalous' "
            f"WHEN {t} = '' THEN 'unknown' ELSE {t} END")


SERVICE = f"coalesce({_map(SERVICE_PORTS)}[dst_port], 'other')"
PORT_BAND = (f"coalesce({_map(SERVICE_PORTS)}[dst_port], CASE WHEN dst_port < 1024 THEN 'system-other' "
             "WHEN dst_port < 10000 THEN 'registered' ELSE 'dynamic' END)")
CONTEXT = f"protocol || '|' || direction || '|' || {PORT_BAND}"
_SERVICES = ", ".join(str(p) for p in SERVICE_PORTS)
FEATURES = {
    "log_duration": "ln(1 + greatest(duration_sec, 0.001))",
    "log_packets": "ln(1 + greatest(packets, 1))",
    "log_bytes": "ln(1 + greatest(bytes, 1))",
    "bytes_per_packet": "greatest(bytes, 1) / greatest(packets, 1)",
    "bytes_per_sec": "ln(1 + greatest(bytes, 1) / greatest(duration_sec, 0.001))",
    "packets_per_sec": "ln(1 + greatest(packets, 1) / greatest(duration_sec, 0.001))",
    "tcp_syn_ratio": "least(greatest(tcp_syn_ratio, 0), 1)",
    "tcp_ack_ratio": "least(greatest(tcp_ack_ratio, 0), 1)",
    "tcp_fin_ratio": "least(greatest(tcp_fin_ratio, 0), 1)",
    "log_inter_arrival_mean_ms": "ln(1 + greatest(inter_arrival_mean_ms, 0))",
    "log_inter_arrival_std_ms": "ln(1 + greatest(inter_arrival_std_ms, 0))",
    "failed_connections": "greatest(failed_connections, 0)",
    "is_inbound": "direction = 'inbound'",
    "is_tcp": "protocol = 'TCP'",
    "is_udp": "protocol = 'UDP'",
    "is_icmp": "protocol = 'ICMP'",
    "is_other_proto": "protocol NOT IN ('TCP', 'UDP', 'ICMP')",
    "is_web_service": "dst_port IN (80, 443, 8080)",
    "is_admin_service": "dst_port IN (22, 23, 445, 3389)",
    "is_uncommon_port": f"dst_port NOT IN ({_SERVICES})",
}


def _each(template: str, names: list[str] = FEATURE_COLUMNS, sep: str = ", ") -> str:
    return sep.join(template.replace("{n}", n) for n in names)


def plane_ctes(p: str, centred: str, rank: int = 4, steps: int = 30) -> list[str]:
    """``p``plane (g, m): the projector on the leading directions of the rows ``centred`` (g, c_*), as a matrix.

    The scatter matrix, squared ``steps`` times over, becomes the projector on its first direction; without that
    direction the next one follows in the same way.
    """
    rows = ", ".join("[" + ", ".join(f"sum(c_{a} * c_{b})" for b in FEATURE_COLUMNS) + "]" for a in FEATURE_COLUMNS)
    scaled = "[[x / t FOR x IN row] FOR row IN m]"
    trace = "list_sum([m[i][i] FOR i IN range(1, 21)])"
    ctes = [f"{p}rest0 AS MATERIALIZED (SELECT g, [{rows}] AS m FROM ({centred}) GROUP BY g)"]
    for k in range(rank):
        ctes += [
            (f"{p}power{k} AS (SELECT g, 0 AS step, {scaled} AS m FROM (SELECT g, m, {trace} AS t FROM {p}rest{k}) UNION ALL "
             f"SELECT g, step + 1, {scaled} FROM (SELECT g, step, m, {trace} AS t FROM (SELECT g, step, "
             f"[[list_dot_product(a, b) FOR b IN m] FOR a IN m] AS m FROM {p}power{k} WHERE step < {steps})))"),
            f"{p}found{k} AS MATERIALIZED (SELECT g, m FROM {p}power{k} WHERE step = {steps})",
            (f"{p}rest{k + 1} AS MATERIALIZED (SELECT g, [[a.m[i][j] - v * b.m[i][j] FOR j IN range(1, 21)] FOR i IN range(1, 21)] AS m "
             f"FROM (SELECT g, list_sum([list_dot_product(a.m[i], b.m[i]) FOR i IN range(1, 21)]) AS v FROM {p}rest{k} a JOIN {p}found{k} b USING (g)) "
             f"JOIN {p}rest{k} a USING (g) JOIN {p}found{k} b USING (g))")]
    total = " + ".join(f"f{k}.m[i][j]" for k in range(rank))
    joined = f"{p}found0 f0 " + " ".join(f"JOIN {p}found{k} f{k} USING (g)" for k in range(1, rank))
    return [*ctes, f"{p}plane AS MATERIALIZED (SELECT g, [[{total} FOR j IN range(1, 21)] FOR i IN range(1, 21)] AS m FROM {joined})"]


#: What is left of a row's centred features ``x`` beside the plane ``m``.
_LEFT = "sqrt(greatest(list_dot_product(x, x) - list_dot_product(x, [list_dot_product(p, x) FOR p IN m]), 0) / 20)"


def model_ctes(group: str = "0", source: str = "flows", rank: int = 0) -> list[str]:
    """Feature, parameter and score tables; ``group`` is the model key."""
    feats = ", ".join(f"CAST({FEATURES[n]} AS DOUBLE) AS f_{n}" for n in FEATURE_COLUMNS)
    squares = " + ".join(
        f"power(least(greatest(z_{n} - m_{n}, -12), 12), 2)" for n in FEATURE_COLUMNS)
    return [
        f"feat AS (SELECT *, {group} AS g, {CONTEXT} AS context_key, {feats} FROM {source})",
        f"med AS (SELECT g, {_each('median(f_{n}) AS med_{n}')} FROM feat GROUP BY g)",
        ("mad AS (SELECT g, " + _each(
            "CASE WHEN median(abs(f_{n} - med_{n})) = 0 THEN 1e-6 ELSE median(abs(f_{n} - med_{n})) END AS mad_{n}")
         + " FROM feat JOIN med USING (g) GROUP BY g)"),
        ("scaled AS (SELECT feat.*, " + _each("(f_{n} - med_{n}) / mad_{n} AS z_{n}")
         + " FROM feat JOIN med USING (g) JOIN mad USING (g))"),
        f"mean AS (SELECT g, {_each('avg(z_{n}) AS m_{n}')} FROM scaled GROUP BY g)",
        ("freq AS (SELECT g, context_key, count(*) * 1.0 / (sum(count(*)) OVER (PARTITION BY g)) AS frequency "
         "FROM feat GROUP BY g, context_key)"),
        *(plane_ctes("", "SELECT g, " + _each("z_{n} - m_{n} AS c_{n}") + " FROM scaled JOIN mean USING (g)") if rank else []),
        (f"parts AS (SELECT scaled.*, sqrt(({squares}) / 20) AS distance, -ln(coalesce(frequency, 0.0001)) AS rarity, "
         f"[{', '.join(f'least(greatest(z_{n} - m_{n}, -12), 12)' for n in FEATURE_COLUMNS)}] AS x "
         "FROM scaled JOIN mean USING (g) LEFT JOIN freq USING (g, context_key))"),
        # Without a subspace nothing is reconstructed, so that error is the distance.
        (f"errors AS (SELECT *, {_LEFT} AS reconstruction FROM parts JOIN plane USING (g))" if rank else
         "errors AS (SELECT *, distance AS reconstruction FROM parts)"),
        "scores AS (SELECT *, 1.6 * distance + 1.2 * reconstruction + 0.85 * rarity AS anomaly_score FROM errors)",
        ("centre AS (SELECT g, median(anomaly_score) FILTER (label = 'normal') AS mid FROM scores GROUP BY g)"),
        ("limits AS (SELECT g, quantile_cont(anomaly_score, 0.92) AS q_all, "
         "quantile_cont(anomaly_score, 0.995) FILTER (label = 'normal') AS q_normal, "
         "any_value(mid) + greatest(3.5 * (median(abs(anomaly_score - mid)) FILTER (label = 'normal')), 1.0) AS robust "
         "FROM scores JOIN centre USING (g) GROUP BY g)"),
        "thr AS (SELECT g, greatest(q_all, q_normal, robust) AS threshold FROM limits)",
        "flagged AS (SELECT *, anomaly_score >= threshold AS is_anomaly FROM scores JOIN thr USING (g))",
    ]


RISK = ("CASE WHEN anomaly_score >= 18 THEN 'critical' WHEN anomaly_score >= 12 THEN 'high' "
        "WHEN anomaly_score >= 7 THEN 'medium' ELSE 'low' END")


def class_ctes(flagged: str, group: str = "g", p: str = "") -> list[str]:
    """Signature classes of a table with features and ``is_anomaly``; ``p`` goes before the tables' names."""
    return [
        (f"{p}cuts AS (SELECT {group} AS cg, quantile_cont(f_packets_per_sec, 0.6) AS pps, "
         "quantile_cont(f_bytes_per_sec, 0.6) AS bps, quantile_cont(f_bytes_per_packet, 0.4) AS bpp "
         f"FROM {flagged} WHERE is_anomaly GROUP BY 1)"),
        (f"{p}classed AS (SELECT t.*, CASE WHEN NOT is_anomaly THEN 'BENIGN' "
         "WHEN (CASE WHEN f_log_inter_arrival_mean_ms > 0.1 THEN f_log_inter_arrival_std_ms / "
         "(f_log_inter_arrival_mean_ms + 1e-6) ELSE 1 END) < 0.35 AND f_packets_per_sec < pps THEN 'Botnet' "
         "WHEN f_bytes_per_sec >= bps AND f_is_uncommon_port = 1 THEN 'Infiltration' "
         "WHEN f_is_web_service = 1 THEN 'Web Attack' "
         "WHEN f_is_admin_service = 1 AND failed_connections >= 1 THEN 'Brute Force' "
         "WHEN f_tcp_syn_ratio >= 0.55 AND f_bytes_per_packet <= bpp AND failed_connections >= 1 THEN 'Port Scan' "
         "WHEN f_packets_per_sec >= pps AND f_tcp_syn_ratio >= 0.35 AND f_is_tcp = 1 THEN 'DoS/DDoS' "
         "WHEN f_bytes_per_sec >= bps AND f_packets_per_sec >= pps THEN 'DoS/DDoS' "
         f"ELSE 'Unknown Anomaly' END AS traffic_class FROM {flagged} t LEFT JOIN {p}cuts ON t.{group} = {p}cuts.cg)"),
    ]


def fit_ctes(p: str, source: str, rank: int = 0) -> list[str]:
    """The model ``p`` fitted on the rows of ``source``, down to its own threshold."""
    feats = ", ".join(f"CAST({FEATURES[n]} AS DOUBLE) AS f_{n}" for n in FEATURE_COLUMNS)
    return [
        f"{p}feat AS (SELECT *, 0 AS g, {CONTEXT} AS context_key, {feats} FROM {source})",
        f"{p}med AS (SELECT {_each('median(f_{n}) AS med_{n}')} FROM {p}feat)",
        f"{p}mad AS (SELECT " + _each("CASE WHEN median(abs(f_{n} - med_{n})) = 0 THEN 1e-6 ELSE median(abs(f_{n} - med_{n})) END AS mad_{n}")
        + f" FROM {p}feat, {p}med)",
        f"{p}mean AS (SELECT " + _each("avg((f_{n} - med_{n}) / mad_{n}) AS m_{n}") + f" FROM {p}feat, {p}med, {p}mad)",
        f"{p}freq AS (SELECT context_key, count(*) * 1.0 / (SELECT count(*) FROM {p}feat) AS frequency FROM {p}feat GROUP BY 1)",
        *(plane_ctes(p, "SELECT 0 AS g, " + _each("(f_{n} - med_{n}) / mad_{n} - m_{n} AS c_{n}") + f" FROM {p}feat, {p}med, {p}mad, {p}mean")
          if rank else []),
        *apply_ctes(f"{p}own", p, source, rank=rank)]


def apply_ctes(q: str, p: str, source: str, floor: str = "NULL", rank: int = 0) -> list[str]:
    """Rows of ``source`` scored and flagged by model ``p`` as ``q``flagged; ``floor`` is the least threshold."""
    feats = ", ".join(f"CAST({FEATURES[n]} AS DOUBLE) AS f_{n}" for n in FEATURE_COLUMNS)
    return [
        f"{q}rows AS (SELECT *, 0 AS g, {CONTEXT} AS context_key, {feats} FROM {source})",
        (f"{q}parts AS (SELECT r.*, -ln(coalesce(frequency, 0.0001)) AS rarity, "
         f"[{', '.join(f'least(greatest((f_{n} - med_{n}) / mad_{n} - m_{n}, -12), 12)' for n in FEATURE_COLUMNS)}] AS x "
         f"FROM {q}rows r CROSS JOIN {p}med CROSS JOIN {p}mad CROSS JOIN {p}mean LEFT JOIN {p}freq USING (context_key))"),
        (f"{q}scores AS (SELECT * EXCLUDE (x, rarity, m), 1.6 * sqrt(list_dot_product(x, x) / 20) + 1.2 * {_LEFT} + 0.85 * rarity AS anomaly_score "
         f"FROM {q}parts JOIN {p}plane USING (g))" if rank else
         f"{q}scores AS (SELECT * EXCLUDE (x, rarity), 2.8 * sqrt(list_dot_product(x, x) / 20) + 0.85 * rarity AS anomaly_score FROM {q}parts)"),
        f"{q}centre AS (SELECT median(anomaly_score) FILTER (label = 'normal') AS mid FROM {q}scores)",
        (f"{q}thr AS (SELECT greatest(quantile_cont(anomaly_score, 0.92), quantile_cont(anomaly_score, 0.995) FILTER (label = 'normal'), "
         f"any_value(mid) + greatest(3.5 * (median(abs(anomaly_score - mid)) FILTER (label = 'normal')), 1.0), {floor}) AS threshold "
         f"FROM {q}scores, {q}centre)"),
        f"{q}flagged AS (SELECT s.*, threshold, anomaly_score >= threshold AS is_anomaly FROM {q}scores s, {q}thr)"]


def _fitted(p: str) -> str:
    return f"(SELECT threshold FROM {p}ownthr)"


def _candidates(k: int) -> str:
    """The rows of batch ``k`` to learn from: the normal ones, topped up to 250 with the lowest scores of unknown label."""
    return (f"candidates{k} AS (SELECT * FROM part{k} WHERE flow_id IN (SELECT flow_id FROM (SELECT flow_id, label, "
            "row_number() OVER (ORDER BY anomaly_score, flow_id) AS rank, count(*) FILTER (label = 'normal') OVER () AS normals "
            f"FROM b{k}scores WHERE label IN ('normal', 'unknown')) WHERE label = 'normal' OR rank <= 250 - normals))")


def adaptive_ctes(batches: int = 3, memory: str | None = None, label: str = "label", skipped: tuple[int, ...] = (),
                  rank: int = 0) -> list[str]:
    """The first batch is the warm-up; the model is fitted anew on the memory after each batch but the ``skipped`` ones.

    The memory holds the latest ``memory`` normal flows of the batches learned from, all of them by default.
    """
    size = f"((SELECT count(*) + {batches - 1} FROM flows) // {batches})"
    steps = ["""placed AS (SELECT *, row_number() OVER (ORDER BY "timestamp" NULLS LAST, flow_id) - 1 AS position FROM flows)""",
             f"cut AS (SELECT *, position // {size} AS slice_id FROM placed)",
             f"sliced AS (SELECT * REPLACE ({label} AS label) FROM cut)",
             *(f"part{k} AS (SELECT * FROM sliced WHERE slice_id = {k})" for k in range(batches))]
    latest = f" ORDER BY position DESC LIMIT {memory}" if memory else ""
    columns = "flow_id, slice_id, protocol, label, anomaly_score, is_anomaly, threshold, traffic_class"
    rows, version = [], 1
    for k in range(batches):
        if k == 0:  # the model is fitted before the memory is cut; all rows if few are known to be normal
            steps += ["candidates0 AS (SELECT * FROM part0 WHERE label = 'normal' OR "
                      "(SELECT count(*) FROM part0 WHERE label = 'normal') < 250)", *fit_ctes("m1", "candidates0", rank)]
        steps += apply_ctes(f"b{k}", f"m{version}", f"part{k}", _fitted(f"m{version}"), rank) + class_ctes(f"b{k}flagged", p=f"b{k}")
        if k:
            steps.append(_candidates(k))
        if k not in skipped:
            held = f"SELECT * FROM memory{version} UNION ALL " if k else ""
            version = k + 1
            steps.append(f"memory{version} AS (SELECT * FROM ({held}SELECT * FROM candidates{k}){latest})")
            if k and k + 1 < batches:
                steps += fit_ctes(f"m{version}", f"memory{version}", rank)
        status = "skipped" if k in skipped else "updated" if k else "warmup"
        rows.append(f"SELECT {columns}, {k + 1} AS batch_id, '{'adapt' if k else 'warmup'}' AS phase, '{status}' AS relearn_status, "
                    f"(SELECT count(*) FROM candidates{k}) AS candidates, (SELECT count(*) FROM memory{version}) AS memory_rows "
                    f"FROM b{k}classed")
    return [*steps, "result AS (" + " UNION ALL ".join(rows) + ")"]


def scored_ctes(group: str = "0", source: str = "flows", rank: int = 0) -> list[str]:
    return (model_ctes(group, source, rank) + class_ctes("flagged")
            + [f"result AS (SELECT *, {RISK} AS risk_level FROM classed)"])


def _summary(with_recall: bool = True) -> str:
    attack, normal = "label NOT IN ('normal', 'benign', '0', 'unknown')", "label IN ('normal', 'benign', '0')"
    text = (
        "count(*) AS total_flows, count_if(is_anomaly) AS flagged_flows, "
        "round(count_if(is_anomaly) * 100.0 / count(*), 2) AS flag_rate, "
        "round(avg(anomaly_score), 4) AS mean_score, round(max(anomaly_score), 4) AS max_score, ")
    quality = (
        f"count_if({attack}) AS known_attack_flows, count_if({normal}) AS known_normal_flows, "
        f"CASE WHEN count_if({attack}) > 0 THEN count_if({attack} AND is_anomaly) END AS detected_known_attacks, "
        f"CASE WHEN count_if({normal}) > 0 THEN count_if({normal} AND is_anomaly) END AS benign_false_positives, "
        f"round(count_if({normal} AND is_anomaly) * 100.0 / nullif(count_if({normal}), 0), 2) "
        "AS benign_false_positive_rate")
    recall = (f", round(count_if({attack} AND is_anomaly) * 100.0 / nullif(count_if({attack}), 0), 2) "
              "AS known_attack_recall")
    return text + quality + (recall if with_recall else "")


def _hash(key: str, seed: int = 42) -> str:
    return f"CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{seed}'), 1, 13) AS BIGINT)"


def _private(address: str) -> str:
    def whole(text):
        parts = [f"CAST(split_part({text}, '.', {i}) AS BIGINT)" for i in range(1, 5)]
        return f"(({parts[0]} * 256 + {parts[1]}) * 256 + {parts[2]}) * 256 + {parts[3]}"
    tests = []
    for block in PRIVATE_IPV4_BLOCKS:
        base, bits = block.split("/")
        size = 2 ** (32 - int(bits))
        tests.append(f"({whole(address)}) // {size} = ({whole(chr(39) + base + chr(39))}) // {size}")
    return "(" + " OR ".join(tests) + ")"


# -- preparation ---------------------------------------------------------------

_FWD_TIME = f"""t AS (SELECT *, {number('"Flow Duration"')} AS dur, {number('"Flow IAT Mean"')} AS iat,
  {number('"Flow IAT Std"')} AS iat_std FROM raw)"""
_SHORT = f"""t AS (SELECT *, {number('sinpkt')} AS a, {number('dinpkt')} AS b, {number('sjit')} AS c,
  {number('djit')} AS d FROM raw)"""


def _jitter(column: str) -> str:
    mid = f"(SELECT median({column}) FROM t WHERE {column} > 0)"
    return f"CASE WHEN {mid} IS NULL THEN 0.0 WHEN {mid} < 10 THEN {column} * 1000 ELSE {column} END"


_PREPARED_FWD = f"""
  try_cast("Timestamp" AS TIMESTAMP) AS "timestamp", "Source IP" AS src_ip, "Destination IP" AS dst_ip,
  coalesce(CAST("Source Port" AS INT), 40000) AS src_port, CAST("Destination Port" AS INT) AS dst_port,
  {protocol('"Protocol"')} AS protocol, 'outbound' AS direction,
  greatest(CASE WHEN (SELECT median(abs(dur)) FROM t) > 1000 THEN dur / 1000000 ELSE dur END, 1e-6) AS duration_sec,
  greatest({number('"Total Fwd Packets"')}, 0) AS packets,
  greatest({number('"Total Length of Fwd Packets"')}, 0) AS bytes,
  {number('"SYN Flag Count"')} / greatest({number('"Total Fwd Packets"')}, 1) AS tcp_syn_ratio,
  {number('"ACK Flag Count"')} / greatest({number('"Total Fwd Packets"')}, 1) AS tcp_ack_ratio,
  {number('"FIN Flag Count"')} / greatest({number('"Total Fwd Packets"')}, 1) AS tcp_fin_ratio,
  least(greatest(CASE WHEN (SELECT median(abs(iat)) FROM t) > 1000 THEN iat / 1000 ELSE iat END, 0), 60000)
    AS inter_arrival_mean_ms,
  least(greatest(CASE WHEN (SELECT median(abs(iat_std)) FROM t) > 1000 THEN iat_std / 1000 ELSE iat_std END, 0), 60000)
    AS inter_arrival_std_ms,
  0.0 AS failed_connections, {label('"Label"')} AS label"""

_STATES = ", ".join(f"'{s}'" for s in FAILED_STATES)


def _top_three() -> str:
    entries = ", ".join(
        f"{{'r': -abs(z_{n}), 'i': {i}, 't': '{FEATURE_WORDING.get(n, n)}=' || printf('%.2f', f_{n})}}"
        for i, n in enumerate(FEATURE_COLUMNS))
    return f"list_transform(list_sort([{entries}])[1:3], lambda entry: entry.t)"


def _std_columns() -> str:
    wanted = []
    for canonical, spellings in COLUMN_ALIASES.items():
        keys = []
        for s in spellings:
            key = "".join(ch for ch in s.lower() if ch.isalnum())
            if key not in keys:
                keys.append(key)
        wanted += [(canonical, i, k) for i, k in enumerate(keys)]
    values = ", ".join(f"('{c}', {i}, '{k}')" for c, i, k in wanted)
    return f"""aliases(canonical, pos, key) AS (VALUES {values}),
      cols AS (SELECT column_name AS name, lower(regexp_replace(column_name, '[^A-Za-z0-9]', '', 'g')) AS key
               FROM (SELECT unnest(['flow_id', 'Timestamp', 'Source IP', 'Destination IP', 'Source Port',
                 'Destination Port', 'Protocol', 'Flow Duration', 'Total Fwd Packets', 'Total Backward Packets',
                 'Total Length of Fwd Packets', 'Total Length of Bwd Packets', 'Flow IAT Mean', 'Flow IAT Std',
                 'SYN Flag Count', 'ACK Flag Count', 'FIN Flag Count', 'Label']) AS column_name)),
      picked AS (SELECT canonical, arg_min(name, pos) AS name FROM aliases JOIN cols USING (key) GROUP BY canonical)"""


_UNITS = """units AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, CAST(embedding AS DOUBLE[]) AS v,
  sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS len FROM embeddings)"""
_SPLIT = f"""ranked AS (SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY {_hash('vec_id')})
  AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
  split AS (SELECT *, r <= ceil(0.2 * n) AS is_test FROM ranked)"""
_KNN = f"""{_SPLIT}, unit AS (SELECT vec_id, label, is_test, CAST(embedding AS DOUBLE[]) AS v,
    sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS len FROM split),
  pairs AS (SELECT a.vec_id AS id, a.label AS truth, b.vec_id AS other, CAST(b.label AS VARCHAR) AS label,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY
      1 - list_dot_product(a.v, b.v) / (a.len * b.len), b.vec_id) AS pos
    FROM unit a JOIN unit b ON a.is_test AND NOT b.is_test),
  votes AS (SELECT id, label, count(*) AS n FROM pairs WHERE pos <= 7 GROUP BY id, label),
  best AS (SELECT id, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY id
    ORDER BY n DESC, label) AS rn FROM votes) WHERE rn = 1),
  judged AS (SELECT id, CAST(truth AS VARCHAR) AS truth, predicted FROM best
    JOIN (SELECT DISTINCT id, truth FROM pairs) USING (id))"""
_CLASS_PAIRS = f"""{_UNITS}, pairs AS (SELECT a.label AS la, b.label AS lb,
    list_dot_product(a.v, b.v) / (a.len * b.len) AS cosine FROM units a JOIN units b ON a.vec_id < b.vec_id),
  intra AS (SELECT la AS label, avg(cosine) AS intra_cosine FROM pairs WHERE la = lb GROUP BY la),
  inter AS (SELECT least(la, lb) AS class_a, greatest(la, lb) AS class_b, avg(cosine) AS inter_cosine
    FROM pairs WHERE la <> lb GROUP BY 1, 2)"""


def _positions(size: int) -> str:
    return (f"""placed AS (SELECT *, row_number() OVER (ORDER BY "timestamp" NULLS LAST, flow_id) - 1 AS position
      FROM flows), sliced AS (SELECT *, position // {size} AS slice_id FROM placed)""")


_BATCHED = ("(SELECT *, row_number() OVER (ORDER BY \"timestamp\" NULLS LAST, flow_id) - 1 AS position FROM flows)")


def oracle_sql() -> dict[str, str]:
    feature_list = ", ".join(f"round(f_{n}, 6) AS {n}" for n in FEATURE_COLUMNS)
    z = ", ".join(f"round(z_{n}, 6) AS {n}" for n in FEATURE_COLUMNS)
    q: dict[str, str] = {}

    # sources
    tagged = "concat('set_', CAST(slot AS VARCHAR)) AS dataset_source"
    q["src_union_tagged"] = with_flows(
        "cut AS (SELECT *, flow_id % 3 AS slot FROM flows)",
        select=f"SELECT flow_id, src_ip, dst_port, CASE WHEN slot = 1 THEN NULL ELSE label END AS label, {tagged} FROM cut")
    q["src_csv_flows"] = with_raw("src_dst_long", select=f"""SELECT flow_id, src_ip, dst_ip, CAST(src_port AS INT) AS src_port,
      CAST(dst_port AS INT) AS dst_port, {protocol('proto')} AS protocol, round({number('duration')}, 6) AS duration_sec,
      greatest({number('src_pkts')}, 0) AS packets, {label('label')} AS label FROM raw""")
    q["src_units_per_file"] = with_raw("src_dst_long", select=f"""SELECT flow_id, round(greatest(CASE WHEN flow_id % 2 = 1
      THEN floor({number('duration')} * 1000000) / 1000000 ELSE {number('duration')} END, 1e-6), 6) AS duration_sec,
      CASE WHEN flow_id % 2 = 1 AND flow_id % 50 < 4 THEN 'port, scan' || chr(10) || '"slow"' ELSE {label('label')} END AS label FROM raw""")
    q["src_skip_patterns"] = with_flows(select="SELECT flow_id, dst_port FROM flows WHERE flow_id % 4 IN (0, 2)")
    q["src_quarantine"] = with_flows(select="""SELECT concat('part_', CAST(flow_id % 4 AS VARCHAR)) AS file,
      count(*) AS n_rows, count_if(flow_id % 4 = 1 AND flow_id % 50 < 4) AS bad_rows,
      NOT bool_or(flow_id % 4 = 1 AND flow_id % 50 < 4) AS accepted FROM flows GROUP BY 1""")
    q["limit_sample"] = with_flows(select=f"SELECT flow_id, src_ip FROM flows ORDER BY {_hash('flow_id')} LIMIT 4000")
    q["embeddings_wide"] = ("SELECT vec_id, label, " + ", ".join(
        f"embedding[{i + 1}] AS emb_{i}" for i in range(64)) + " FROM embeddings")

    # preparation
    q["std_columns"] = with_raw("fwd_bwd", _std_columns(), select="""SELECT coalesce(canonical, cols.name) AS column_name,
      (SELECT count(*) FROM raw) AS n_rows FROM cols LEFT JOIN picked USING (name)""")
    q["prep_timestamp"] = with_raw("fwd_bwd", select='SELECT flow_id, try_cast("Timestamp" AS TIMESTAMP) AS "timestamp" FROM raw')
    q["prep_synth_ts"] = with_flows(select="""SELECT flow_id, TIMESTAMP '2026-04-20' + to_seconds(5 *
      (row_number() OVER (ORDER BY flow_id) - 1)) AS "timestamp" FROM flows""")
    q["prep_numeric"] = with_raw("fwd_bwd", select=f"""SELECT flow_id, {number('"Flow Duration"')} AS duration,
      {number('"Total Length of Fwd Packets"')} AS fwd_bytes, {number('"Flow IAT Std"')} AS iat_std FROM raw""")
    q["prep_bidir_volume"] = with_raw("src_dst_short", select=f"""SELECT flow_id,
      {number('spkts')} + {number('dpkts')} AS packets, {number('sbytes')} + {number('dbytes')} AS bytes FROM raw""")
    q["prep_duration_scale"] = with_raw("fwd_bwd", _FWD_TIME, select="""SELECT flow_id, round(CASE WHEN
      (SELECT median(abs(dur)) FROM t) > 1000 THEN dur / 1000000 ELSE dur END, 6) AS duration_sec FROM t""")
    q["prep_iat_scale"] = with_raw("fwd_bwd", _FWD_TIME, select="""SELECT flow_id,
      round(CASE WHEN (SELECT median(abs(iat)) FROM t) > 1000 THEN iat / 1000 ELSE iat END, 6) AS inter_arrival_mean_ms,
      round(CASE WHEN (SELECT median(abs(iat_std)) FROM t) > 1000 THEN iat_std / 1000 ELSE iat_std END, 6)
        AS inter_arrival_std_ms FROM t""")
    q["prep_jitter_scale"] = with_raw("src_dst_short", _SHORT, select=f"""SELECT flow_id,
      round(({_jitter('a')} + {_jitter('b')}) / 2, 6) AS inter_arrival_mean_ms,
      round(({_jitter('c')} + {_jitter('d')}) / 2, 6) AS inter_arrival_std_ms FROM t""")
    q["prep_service_port"] = with_raw("src_dst_short", select=f"""SELECT flow_id,
      coalesce({_map(SERVICE_NAME_PORTS)}[lower(trim(service))], 0) AS dst_port FROM raw""")
    q["prep_state_failed"] = with_raw("src_dst_short", select=f"""SELECT flow_id,
      CASE WHEN upper(state) IN ({_STATES}) THEN 1.0 ELSE 0.0 END AS failed_connections FROM raw""")
    q["prep_label"] = with_raw("src_dst_short", select=f"""SELECT flow_id, {label('"Label"')} AS label,
      {label('coalesce("Label", attack_cat)')} AS label_or_category,
      {label('"Label"', 'unknown')} AS label_null_unknown FROM raw""")
    q["prep_flag_ratio"] = with_raw("fwd_bwd", select="SELECT flow_id, " + ", ".join(
        f"""round({number(f'"{k} Flag Count"')} / greatest({number('"Total Fwd Packets"')}, 1), 6) AS tcp_{k.lower()}_ratio"""
        for k in ("SYN", "ACK", "FIN")) + " FROM raw")
    q["prep_defaults"] = with_raw("fwd_bwd", select="""SELECT flow_id, 'outbound' AS direction, "Source IP" AS src_ip,
      coalesce(CAST("Source Port" AS INT), 40000) AS src_port FROM raw""")
    q["prep_direction"] = with_flows(select=f"""SELECT flow_id, CASE WHEN NOT {_private('src_ip')} AND
      {_private('dst_ip')} THEN 'inbound' ELSE 'outbound' END AS direction,
      CASE WHEN NOT {_private('dst_ip')} THEN 'inbound' ELSE 'outbound' END AS direction_swapped FROM flows""")
    q["prep_clamp"] = with_flows(select="""SELECT flow_id, greatest(packets - 20, 0) AS packets,
      greatest(bytes - 9000, 0) AS bytes, round(greatest(duration_sec - 1, 1e-6), 6) AS duration_sec,
      round(least(greatest(inter_arrival_mean_ms * 3000 - 1000, 0), 60000), 6) AS inter_arrival_mean_ms,
      round(least(greatest(inter_arrival_std_ms * 9000, 0), 60000), 6) AS inter_arrival_std_ms FROM flows""")
    q["prep_protocol"] = with_raw("src_dst_short", select=f"""SELECT flow_id, {protocol('proto')} AS protocol,
      {protocol("CASE flow_id % 5 WHEN 0 THEN '17' WHEN 1 THEN ' 6 ' WHEN 2 THEN '6.0' WHEN 3 THEN 'icmpv6' ELSE '' END")}
        AS protocol_number FROM raw""")
    q["prep_types"] = with_raw("fwd_bwd", select="""SELECT flow_id, 'outbound' AS direction, "Source IP" AS src_ip,
      "Destination IP" AS dst_ip, coalesce(CAST("Source Port" AS INT), 40000) AS src_port,
      CAST("Destination Port" AS INT) AS dst_port FROM raw""")
    q["prep_sorted"] = with_raw("fwd_bwd", select="""SELECT flow_id, row_number() OVER (ORDER BY
      try_cast("Timestamp" AS TIMESTAMP) NULLS LAST, flow_id) - 1 AS position FROM raw""")
    q["prepare_flows"] = with_raw("fwd_bwd", _FWD_TIME, f"p AS (SELECT flow_id, {_PREPARED_FWD} FROM t)", select="""
      SELECT * REPLACE (round(duration_sec, 6) AS duration_sec, round(inter_arrival_mean_ms, 6) AS inter_arrival_mean_ms,
      round(inter_arrival_std_ms, 6) AS inter_arrival_std_ms, round(tcp_syn_ratio, 6) AS tcp_syn_ratio,
      round(tcp_ack_ratio, 6) AS tcp_ack_ratio, round(tcp_fin_ratio, 6) AS tcp_fin_ratio) FROM p""")

    # features
    m = model_ctes()
    q["flow_features"] = with_flows(*m[:1], select=f"SELECT flow_id, {feature_list} FROM feat")
    q["context_keys"] = with_flows(*m[:1], select=f"SELECT flow_id, {PORT_BAND} AS port_band, context_key FROM feat")
    q["service_name"] = with_flows(select=f"SELECT flow_id, dst_port, {SERVICE} AS service FROM flows")
    inputs = {**{c: f"CAST({c} AS DOUBLE)" for c in ENCODER_COLUMNS[:10]},
              "protocol_num": "CASE protocol WHEN 'TCP' THEN 0.0 WHEN 'UDP' THEN 1.0 WHEN 'ICMP' THEN 2.0 ELSE 3.0 END",
              "direction_num": "CASE direction WHEN 'inbound' THEN 1.0 ELSE 0.0 END"}
    enc = "enc AS (SELECT flow_id, " + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in inputs.items()) + " FROM flows)"
    q["encoder_features"] = with_flows(enc, select="SELECT flow_id, " + ", ".join(
        f"round({n}, 6) AS {n}" for n in inputs) + " FROM enc")
    names = list(inputs)
    q["encoder_features_scaled"] = with_flows(
        enc, f"em AS (SELECT {_each('median({n}) AS med_{n}', names)} FROM enc)",
        "es AS (SELECT " + _each("CASE WHEN median(abs({n} - med_{n})) < 1e-6 THEN 1.0 ELSE median(abs({n} - med_{n})) END AS mad_{n}", names) + " FROM enc, em)",
        select="SELECT flow_id, " + _each("round(least(greatest(({n} - med_{n}) / mad_{n}, -10), 10), 6) AS {n}", names) + " FROM enc, em, es")

    # model
    per_feature = " UNION ALL ".join(
        f"SELECT g, '{n}' AS feature, round(med_{n}, 6) AS median, round(mad_{n}, 6) AS mad FROM med JOIN mad USING (g)"
        for n in FEATURE_COLUMNS)
    q["robust_params"] = with_flows(*m[:3], select=f"SELECT feature, median, mad FROM ({per_feature})")
    by_source = model_ctes("dataset_source")
    q["per_source_robust_params"] = with_flows(
        *by_source[:3], select=f"SELECT g AS dataset_source, feature, median, mad FROM ({per_feature})")
    q["robust_scaled"] = with_flows(*m[:4], select=f"SELECT flow_id, {z} FROM scaled")
    q["scaled_mean"] = with_flows(*m[:5], select="SELECT feature, mean FROM (" + " UNION ALL ".join(
        f"SELECT '{n}' AS feature, round(m_{n}, 5) AS mean FROM mean" for n in FEATURE_COLUMNS) + ")")
    q["context_frequency"] = with_flows(*m[:6], select="SELECT context_key, round(frequency, 8) AS frequency FROM freq")
    q["decision_threshold"] = with_flows(*m[:12], select="SELECT round(threshold, 6) AS threshold FROM thr")
    q["score_distance"] = with_flows(*m[:7], select="SELECT flow_id, round(distance, 6) AS distance FROM parts")
    q["score_rarity"] = with_flows(*m[:7], select="SELECT flow_id, round(rarity, 6) AS rarity FROM parts")
    q["risk_band"] = with_flows(*m[:9], select=f"""SELECT flow_id, {RISK} AS risk_level,
      {RISK.replace('anomaly_score', '(anomaly_score / 2)')} AS risk_of_half FROM scores""")
    q["flags_without_subspace"] = with_flows(*m, select="SELECT flow_id, round(anomaly_score, 6) AS anomaly_score, is_anomaly FROM flagged")
    four = model_ctes(rank=4)
    q["score_reconstruction"] = with_flows(*four[:-4], select="SELECT flow_id, round(reconstruction, 6) AS reconstruction FROM scores")
    q["anomaly_score"] = with_flows(*four[:-4], select="SELECT flow_id, round(anomaly_score, 6) AS anomaly_score FROM scores")
    q["anomaly_flag"] = with_flows(*four, select="SELECT flow_id, round(anomaly_score, 6) AS anomaly_score, is_anomaly FROM flagged")
    q["explain_top3"] = with_flows(*m[:4], select=f"""SELECT flow_id, array_to_string({_top_three()}, ', ') ||
      ', context=' || protocol || '/' || direction || '/port-' || dst_port AS explanation FROM scaled""")
    known = [*m[:1], "marked AS (SELECT *, label = 'anomalous' AS is_anomaly FROM feat)", *class_ctes("marked")]
    q["classify_traffic"] = with_flows(*known, select="SELECT flow_id, traffic_class FROM classed")

    # summaries, on the model without a subspace
    s = scored_ctes()
    q["summary_kpis"] = with_flows(*s, select=f"""SELECT {_summary()}, (SELECT protocol FROM result GROUP BY protocol
      ORDER BY count(*) DESC, protocol LIMIT 1) AS top_protocol FROM result""")
    q["top_protocol"] = with_flows(select="SELECT protocol, count(*) AS count FROM flows GROUP BY protocol ORDER BY 2 DESC, 1 LIMIT 1")
    q["class_breakdown"] = with_flows(*s, select="SELECT traffic_class, count(*) AS count FROM result GROUP BY 1")
    q["label_masks"] = with_raw("fwd_bwd", f"l AS (SELECT flow_id, {label(chr(34) + 'Label' + chr(34))} AS label FROM raw)", select="""
      SELECT flow_id, label, label NOT IN ('normal', 'benign', '0', 'unknown') AS known_attack,
      label IN ('normal', 'benign', '0') AS known_normal FROM l""")
    q["detection_quality"] = with_flows(
        f"r AS (SELECT {_summary()} FROM (SELECT *, event_score > 40 AS is_anomaly, 1.0 AS anomaly_score FROM "
        "(SELECT *, packets AS event_score FROM flows)))",
        select="SELECT known_attack_flows, known_normal_flows, detected_known_attacks, benign_false_positives, "
               "benign_false_positive_rate, known_attack_recall FROM r")
    q["batch_summary"] = with_flows(
        *scored_ctes(source=_BATCHED), select=f"""SELECT position // 1000 + 1 AS batch_id,
        CASE WHEN position < 1000 THEN 'warmup' ELSE 'adapt' END AS phase,
        {_summary(False).replace('AS total_flows', 'AS batch_size')} FROM result GROUP BY 1, 2""")
    q["per_source_thresholds"] = with_flows(
        *by_source[:12], select="SELECT g AS dataset_source, round(threshold, 6) AS threshold FROM thr")
    q["per_source_summary"] = with_flows(*scored_ctes("dataset_source"), select=f"""
      SELECT g AS dataset_source, {_summary()}, mode_protocol AS top_protocol, round(any_value(threshold), 4) AS threshold
      FROM result JOIN (SELECT g, arg_min(protocol, (-n, protocol)) AS mode_protocol FROM (SELECT g, protocol, count(*) AS n
        FROM result GROUP BY g, protocol) GROUP BY g) USING (g) GROUP BY g, mode_protocol""")

    # models per source, for other rows, and over batches, all without a subspace
    q["per_source_flags"] = with_flows(*scored_ctes("dataset_source"), select="""SELECT flow_id, dataset_source,
      round(anomaly_score, 6) AS anomaly_score, is_anomaly, traffic_class FROM result""")
    q["per_source_overview"] = with_flows(*scored_ctes("dataset_source"), select=f"""SELECT {_summary()},
      (SELECT protocol FROM result GROUP BY protocol ORDER BY count(*) DESC, protocol LIMIT 1) AS top_protocol,
      (SELECT count(*) FROM thr) AS source_models,
      (SELECT string_agg(g || '=' || CAST(round(threshold, 4) AS VARCHAR), ', ' ORDER BY g) FROM thr) AS per_source_thresholds,
      round(quantile_cont(anomaly_score, 0.92), 6) AS overall_score_quantile FROM result""")
    q["per_source_scores"] = with_flows(*scored_ctes("dataset_source", rank=4), select="""SELECT flow_id, dataset_source,
      round(anomaly_score, 6) AS anomaly_score, is_anomaly, traffic_class FROM result""")
    q["per_source_combined"] = q["per_source_overview"].replace(with_flows(*scored_ctes("dataset_source"), select=""), with_flows(
        *scored_ctes("dataset_source", rank=4), select=""))
    q["summary_versions"] = q["batch_summary"]
    unseen = ["known AS (SELECT * FROM flows WHERE label = 'normal')", *fit_ctes("m", "known"),
              *apply_ctes("a", "m", "flows", _fitted("m")), *class_ctes("aflagged")]
    q["score_unseen_flows"] = with_flows(*unseen, select=f"""SELECT flow_id, round(anomaly_score, 6) AS anomaly_score, is_anomaly,
      {RISK} AS risk_level, traffic_class FROM classed""")
    q["model_versions"] = q["score_unseen_flows"]
    unseen = ["known AS (SELECT * FROM flows WHERE label = 'normal')", *fit_ctes("m", "known", 4),
              *apply_ctes("a", "m", "flows", _fitted("m"), 4), *class_ctes("aflagged"),
              "told AS (SELECT *, " + _each("(f_{n} - med_{n}) / mad_{n} AS z_{n}") + " FROM classed, mmed, mmad)"]
    q["score_flows"] = with_flows(*unseen, select=f"""SELECT flow_id, {SERVICE} AS service, round(anomaly_score, 6) AS anomaly_score, is_anomaly,
      {RISK} AS risk_level, traffic_class, array_to_string({_top_three()}, ', ') || ', context=' || protocol || '/' || direction
      || '/port-' || dst_port AS explanation FROM told""")
    gram = ", ".join(f"sum(c_{a} * c_{b})" for a in FEATURE_COLUMNS for b in FEATURE_COLUMNS)
    q["subspace_moments"] = with_flows(
        *model_ctes()[:5], "centred AS (SELECT " + _each("z_{n} - m_{n} AS c_{n}") + " FROM scaled JOIN mean USING (g))",
        f"gram AS (SELECT unnest([{gram}]) AS v, unnest(range(400)) // 20 AS i, unnest(range(400)) % 20 AS j FROM centred)",
        "square AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM gram a JOIN gram b ON a.j = b.i GROUP BY a.i, b.j)",
        select="""SELECT round(log10((SELECT sum(v) FROM gram WHERE i = j)), 6) AS power_2, round(log10((SELECT sum(v * v) FROM gram)), 6) AS power_4,
      round(log10((SELECT sum(s.v * g.v) FROM square s JOIN gram g USING (i, j))), 6) AS power_6""")
    for name, ctes in (("adaptive_flags", adaptive_ctes()), ("adaptive_scored", adaptive_ctes(rank=4))):
        q[name] = with_flows(*ctes, select="""SELECT flow_id, batch_id, slice_id, phase AS learning_phase,
      round(anomaly_score, 6) AS anomaly_score, is_anomaly, traffic_class FROM result""")
    decided = """SELECT flow_id, batch_id, phase AS learning_phase, round(anomaly_score, 6) AS anomaly_score, is_anomaly,
      relearn_status, candidates, memory_rows FROM result"""
    q["adaptive_evicting"] = with_flows(*adaptive_ctes(5, "((SELECT count(*) + 4 FROM flows) // 5) // 2"), select=decided)
    q["adaptive_skipping"] = with_flows(*adaptive_ctes(
        label="CASE WHEN slice_id = 1 AND flow_id % 20 <> 0 THEN 'ddos' ELSE label END", skipped=(1,)), select=decided)
    for name, rank in (("stream_flags", 0), ("stream_adaptive", 4)):  # the stream keeps the default memory of 5000 flows
        q[name] = with_flows(*adaptive_ctes(memory="5000", rank=rank), select="""SELECT flow_id, batch_id, phase AS learning_phase,
      round(anomaly_score, 6) AS anomaly_score, is_anomaly FROM result""")
    for name, rank in (("relearn_overview", 0), ("relearn_decisions", 4)):
        q[name] = with_flows(*adaptive_ctes(rank=rank), select=f"""SELECT batch_id, phase,
      {_summary(False).replace('AS total_flows', 'AS batch_size')}, round(any_value(threshold), 4) AS threshold,
      CASE batch_id WHEN 1 THEN 'warmup' ELSE 'updated' END AS relearn_status FROM result GROUP BY batch_id, phase""")
    for name, rank in (("adaptive_overview", 0), ("adaptive_summary", 4)):
        q[name] = with_flows(*adaptive_ctes(rank=rank), select=f"""SELECT {_summary()},
      (SELECT protocol FROM result GROUP BY protocol ORDER BY count(*) DESC, protocol LIMIT 1) AS top_protocol,
      1 AS warmup_batches, 5 * ((SELECT count(*) + 2 FROM flows) // 3) AS memory_size, 3 AS adaptive_batches,
      0 AS skipped_relearn_batches, round((SELECT threshold FROM b2thr), 6) AS final_threshold FROM result""")

    # ranking
    q["top_hits"] = with_flows(*s, select="""SELECT flow_id, src_ip, dst_ip, dst_port, protocol,
      round(anomaly_score, 6) AS anomaly_score FROM (SELECT *, row_number() OVER (PARTITION BY src_ip, dst_ip, dst_port,
      protocol ORDER BY anomaly_score DESC, flow_id) AS rn FROM result) WHERE rn = 1
      ORDER BY anomaly_score DESC, flow_id LIMIT 5""")
    columns = ", ".join(f'round({c}, 6) AS {c}' if "AS DOUBLE" in e else f'"{c}"' for c, e in FLOW_EXPRESSIONS.items())
    q["fit_score_top_hits"] = with_flows(*scored_ctes(rank=4), select=f"""SELECT {columns}, {SERVICE} AS service,
      round(anomaly_score, 6) AS anomaly_score, is_anomaly, risk_level, traffic_class, array_to_string({_top_three()}, ', ') || ', context='
      || protocol || '/' || direction || '/port-' || dst_port AS explanation FROM (SELECT *, row_number() OVER (PARTITION BY src_ip, dst_ip,
      dst_port, protocol ORDER BY anomaly_score DESC, flow_id) AS rn, anomaly_score AS score FROM result) WHERE rn = 1
      ORDER BY score DESC, flow_id LIMIT 5""")
    q["best_per_signature"] = with_flows(*s, select="""SELECT flow_id, src_ip, dst_port, round(anomaly_score, 6) AS anomaly_score
      FROM (SELECT *, row_number() OVER (PARTITION BY src_ip, dst_port, protocol ORDER BY anomaly_score DESC, flow_id) AS rn
      FROM result) WHERE rn = 1""")
    q["scored_sorted"] = with_flows(*s, select="SELECT flow_id, round(anomaly_score, 6) AS anomaly_score FROM result")
    sparse = ("sparse AS (SELECT flow_id, packets AS anomaly_score, CASE WHEN flow_id % 100 = 0 THEN 'normal' "
              "WHEN flow_id % 7 = 0 THEN 'unknown' ELSE 'ddos' END AS label FROM flows)")
    q["benign_reference"] = with_flows(select="SELECT flow_id, label FROM flows WHERE label = 'normal'")
    q["benign_reference_sparse"] = with_flows(
        sparse, "c AS (SELECT count(*) AS n FROM sparse WHERE label = 'normal')",
        select="""SELECT flow_id, label, anomaly_score FROM sparse WHERE label = 'normal' UNION
        SELECT flow_id, label, anomaly_score FROM (SELECT *, row_number() OVER (ORDER BY anomaly_score, flow_id) AS rn
        FROM sparse WHERE label IN ('normal', 'unknown')), c WHERE rn <= 250 - n""")
    q["memory_window"] = with_flows(select="SELECT flow_id, src_ip FROM flows ORDER BY \"timestamp\" DESC, flow_id DESC LIMIT 5000")
    q["value_counts"] = with_flows(select="SELECT dst_port, count(*) AS count FROM flows GROUP BY dst_port")
    q["distinct_rows"] = with_flows(select="SELECT DISTINCT src_ip, dst_port, protocol, direction FROM flows")
    q["min_class_filter"] = with_flows(select="""SELECT flow_id, dst_ip FROM flows WHERE dst_ip IN
      (SELECT dst_ip FROM flows GROUP BY dst_ip HAVING count(*) >= 2)""")
    q["batch_assign"] = with_flows(_positions(700), select="SELECT flow_id, position, slice_id FROM sliced")

    # embeddings
    q["training_labels"] = with_flows(*s, select="SELECT flow_id, traffic_class AS training_label FROM result")
    q["label_index"] = with_flows(select="SELECT flow_id, dense_rank() OVER (ORDER BY src_ip) - 1 AS label_index FROM flows")
    q["stratified_split"] = f"WITH {_SPLIT} SELECT vec_id, label, is_test FROM split"
    q["balanced_resample"] = with_flows(
        "placed AS (SELECT flow_id, label, dense_rank() OVER (ORDER BY label) - 1 AS r, row_number() OVER (PARTITION BY label "
        "ORDER BY flow_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM flows)",
        "sizes AS (SELECT DISTINCT r, n FROM placed)",
        f"""draws AS (SELECT CAST(floor({_hash('d')} / 4503599627370496.0 * (SELECT count(*) FROM sizes)) AS BIGINT) AS r,
      {_hash('d', 43)} / 4503599627370496.0 AS u FROM range((SELECT count(*) FROM flows)) AS t(d))""",
        select="""SELECT flow_id, label, row_number() OVER (PARTITION BY flow_id) AS draw
      FROM draws JOIN sizes USING (r) JOIN placed p ON p.r = draws.r AND p.i = CAST(floor(u * sizes.n) AS BIGINT)""")
    q["triplet_loss"] = f"""WITH e AS (SELECT vec_id, label, vec_id // 128 AS batch, CAST(embedding AS DOUBLE[]) AS v
      FROM embeddings), pairs AS (SELECT a.batch, a.vec_id, a.label = b.label AS same,
      1 - least(greatest(list_dot_product(a.v, b.v), -1), 1) AS d FROM e a JOIN e b ON a.batch = b.batch
      AND a.vec_id <> b.vec_id), hard AS (SELECT batch, vec_id, max(d) FILTER (same) AS pos, min(d) FILTER (NOT same) AS neg
      FROM pairs GROUP BY 1, 2), anchors AS (SELECT batch, greatest(pos - neg + 0.3, 0) AS loss FROM hard
      WHERE pos IS NOT NULL AND neg IS NOT NULL)
      SELECT b.batch, count(loss) AS anchors, round(coalesce(avg(loss), 0), 6) AS loss
      FROM (SELECT DISTINCT batch FROM e) b LEFT JOIN anchors USING (batch) GROUP BY b.batch"""
    q["knn_predict"] = f"WITH {_KNN} SELECT id, predicted FROM best"
    q["knn_pivots"] = q["knn_predict"]
    q["knn_proba"] = f"""WITH {_KNN}, classes AS (SELECT DISTINCT CAST(label AS VARCHAR) AS class FROM split WHERE NOT is_test)
      SELECT id, class, round(coalesce(n, 0) / 7.0, 6) AS probability FROM best CROSS JOIN classes
      LEFT JOIN votes USING (id) WHERE votes.label = class UNION ALL
      SELECT id, class, 0.0 FROM best CROSS JOIN classes WHERE NOT EXISTS
      (SELECT 1 FROM votes WHERE votes.id = best.id AND votes.label = class)"""
    q["confusion_matrix"] = f"WITH {_KNN} SELECT truth, predicted, count(*) AS n FROM judged GROUP BY 1, 2"
    q["classification_report"] = f"""WITH {_KNN}, names AS (SELECT truth AS class FROM judged UNION SELECT predicted FROM judged),
      c AS (SELECT class, (SELECT count(*) FROM judged WHERE truth = class AND predicted = class) AS hits,
        (SELECT count(*) FROM judged WHERE truth = class) AS support,
        (SELECT count(*) FROM judged WHERE predicted = class) AS claimed FROM names),
      p AS (SELECT *, CASE WHEN claimed = 0 THEN 0 ELSE hits / claimed END AS precision,
        CASE WHEN support = 0 THEN 0 ELSE hits / support END AS recall FROM c),
      f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM p),
      r AS (SELECT class, precision, recall, f1, support FROM f
        UNION ALL SELECT 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support), sum(hits) / sum(support), sum(support) FROM f
        UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
        UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
          sum(f1 * support) / sum(support), sum(support) FROM f)
      SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
        CAST(support AS BIGINT) AS support FROM r"""
    q["cosine_pairs"] = f"""WITH {_UNITS}, probes AS (SELECT min(vec_id) AS vec_id FROM embeddings GROUP BY label)
      SELECT a.vec_id, b.vec_id AS probe, round(list_dot_product(a.v, b.v) / (a.len * b.len), 6) AS cosine
      FROM units a, units b WHERE b.vec_id IN (SELECT vec_id FROM probes)"""
    q["cosine_join"] = f"""WITH {_UNITS} SELECT a.vec_id AS id, b.vec_id AS other, round(list_dot_product(a.v, b.v) / (a.len * b.len), 6) AS cosine
      FROM units a JOIN units b ON a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) / (a.len * b.len) >= 0.35"""
    q["cosine_intra"] = f"WITH {_CLASS_PAIRS} SELECT label, round(intra_cosine, 6) AS intra_cosine FROM intra"
    q["cosine_inter"] = f"WITH {_CLASS_PAIRS} SELECT class_a, class_b, round(inter_cosine, 6) AS inter_cosine FROM inter"
    q["embedding_kpis"] = f"""WITH {_CLASS_PAIRS}, k AS (SELECT (SELECT avg(intra_cosine) FROM intra) AS mean_intra,
      (SELECT avg(inter_cosine) FROM inter) AS mean_inter) SELECT round(mean_intra, 6) AS mean_intra,
      round(mean_inter, 6) AS mean_inter, mean_intra >= 0.70 AS intra_ok, mean_inter <= 0.30 AS inter_ok FROM k"""

    # reports
    q["report_protocols"] = with_flows(select="SELECT protocol, count(*) AS count FROM flows GROUP BY 1")
    q["report_risk"] = with_flows(*s, select="SELECT risk_level, count(*) AS count FROM result WHERE is_anomaly GROUP BY 1")
    q["report_classes"] = with_flows(*s, select="""SELECT traffic_class, count(*) AS count,
      round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS percent FROM result GROUP BY 1""")
    q["report_cards"] = with_flows(select="""SELECT unnest(['Total Flows', 'Top Protocol', 'Source Models']) AS card,
      unnest([CAST((SELECT count(*) FROM flows) AS VARCHAR), (SELECT protocol FROM flows GROUP BY 1
      ORDER BY count(*) DESC, 1 LIMIT 1), CAST((SELECT count(DISTINCT dataset_source) FROM flows) AS VARCHAR)]) AS value""")
    q["report_top_hits"] = with_flows(*s, select=f"""SELECT strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS second, dataset_source,
      src_ip, dst_ip, protocol || '/' || dst_port AS service, printf('%.3f', anomaly_score) AS score, risk_level,
      traffic_class, array_to_string({_top_three()}, ', ') || ', context=' || protocol || '/' || direction || '/port-'
      || dst_port AS explanation FROM (SELECT *, row_number() OVER (PARTITION BY src_ip, dst_ip, dst_port, protocol
      ORDER BY anomaly_score DESC, flow_id) AS rn FROM result) WHERE rn = 1 ORDER BY anomaly_score DESC, flow_id LIMIT 5""")
    return q
