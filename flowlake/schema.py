"""Names and lookup tables shared by the whole package.

Everything in this module is data, not logic: the values have to equal the
ones the original tool uses, otherwise scores and classes would differ.
"""

# --- fixed values: numeric and categorical flow columns --------------------
NUMERIC_COLUMNS = [
    "duration_sec", "packets", "bytes",
    "tcp_syn_ratio", "tcp_ack_ratio", "tcp_fin_ratio",
    "inter_arrival_mean_ms", "inter_arrival_std_ms", "failed_connections",
]

# --- fixed values: defaults for absent or null categorical columns ---------
CATEGORICAL_DEFAULTS = {
    "protocol": "TCP",
    "direction": "outbound",
    "src_ip": "10.0.0.10",
    "dst_ip": "8.8.8.8",
    "src_port": 40000,
    "dst_port": 443,
}

# --- fixed values: accepted spellings of each canonical column -------------
# Compared after lower-casing and dropping everything but letters and digits,
# so one spelling stands for all its punctuation variants.
COLUMN_ALIASES = {
    "timestamp": ["timestamp", "time", "datetime", "date", "ts"],
    "src_ip": ["src_ip", "source_ip", "srcip", "source", "src host"],
    "dst_ip": ["dst_ip", "destination_ip", "dstip", "destination", "dst host"],
    "src_port": ["src_port", "source_port", "sport", "src_port_num"],
    "dst_port": ["dst_port", "destination_port", "dport", "dest_port"],
    "protocol": ["protocol", "proto", "protocol_type"],
    "direction": ["direction", "flow_direction"],
    "state": ["state", "conn_state"],
    "duration_sec": ["duration_sec", "duration", "flow_duration", "dur", "duration_seconds"],
    "packets": [
        "packets", "packet_count", "total_packets", "pkts", "tot_pkts", "flow_packets",
        "total_fwd_packets", "total_backward_packets",
        "subflow_fwd_packets", "subflow_bwd_packets",
        "spkts", "dpkts", "src_pkts", "dst_pkts",
    ],
    "bytes": [
        "bytes", "byte_count", "total_bytes", "flow_bytes", "tot_bytes", "payload_bytes",
        "total_length_of_fwd_packets", "total_length_of_bwd_packets",
        "subflow_fwd_bytes", "subflow_bwd_bytes",
        "sbytes", "dbytes", "src_bytes", "dst_bytes", "src_ip_bytes", "dst_ip_bytes",
    ],
    "tcp_syn_ratio": ["tcp_syn_ratio", "syn_ratio", "syn_rate"],
    "tcp_ack_ratio": ["tcp_ack_ratio", "ack_ratio", "ack_rate"],
    "tcp_fin_ratio": ["tcp_fin_ratio", "fin_ratio", "fin_rate"],
    "syn_flag_count": ["syn_flag_count", "syn_flag"],
    "ack_flag_count": ["ack_flag_count", "ack_flag"],
    "fin_flag_count": ["fin_flag_count", "fin_flag"],
    "inter_arrival_mean_ms": [
        "inter_arrival_mean_ms", "iat_mean", "flow_iat_mean", "mean_iat", "interarrival_mean",
    ],
    "inter_arrival_std_ms": [
        "inter_arrival_std_ms", "iat_std", "flow_iat_std", "std_iat", "interarrival_std",
    ],
    "failed_connections": [
        "failed_connections", "failed_conn", "failed_attempts", "connection_errors",
    ],
    "label": [
        "label", "attack", "attack_type", "class", "target", "is_attack", "attack_cat", "type",
    ],
}

# --- fixed values: forward/backward counter pairs that add up to a volume ---
VOLUME_PAIRS = {
    "packets": [
        ("total_fwd_packets", "total_backward_packets"),
        ("src_pkts", "dst_pkts"),
        ("spkts", "dpkts"),
    ],
    "bytes": [
        ("total_length_of_fwd_packets", "total_length_of_bwd_packets"),
        ("src_bytes", "dst_bytes"),
        ("sbytes", "dbytes"),
    ],
}

# --- fixed values: protocol numbers and names -------------------------------
PROTOCOL_NUMBERS = {"1": "ICMP", "6": "TCP", "17": "UDP"}
PROTOCOL_NAMES = {
    "TCP": "TCP", "UDP": "UDP", "ICMP": "ICMP", "ICMPV6": "ICMP",
    "IGMP": "OTHER", "SCTP": "OTHER", "GRE": "OTHER", "ESP": "OTHER", "AH": "OTHER",
    "OSPF": "OTHER", "IP": "OTHER", "IPIP": "OTHER", "PIM": "OTHER", "GGP": "OTHER",
    "EGP": "OTHER",
}

# --- fixed values: label spellings ------------------------------------------
NORMAL_LABEL_SPELLINGS = ["0", "normal", "benign", "false", "legitimate"]
ATTACK_LABEL_SPELLINGS = ["1", "attack", "anomaly", "anomalous", "malicious", "true"]
KNOWN_NORMAL_LABELS = ["normal", "benign", "0"]
NOT_ATTACK_LABELS = ["normal", "benign", "0", "unknown"]

# --- fixed values: connection states that count as a failed connection ------
FAILED_STATES = ["REJ", "RST", "RSTO", "RSTR", "S0", "SH", "OTH", "INT"]

# --- fixed values: service name -> port, used when only a service is given --
SERVICE_NAME_PORTS = {
    "http": 80, "https": 443, "dns": 53, "ssh": 22, "ftp": 21, "ftp-data": 20, "smtp": 25,
    "pop3": 110, "imap": 143, "dhcp": 67, "ntp": 123, "irc": 194, "ssl": 443, "mqtt": 1883,
    "telnet": 23,
}

# --- fixed values: port -> service ------------------------------------------
SERVICE_PORTS = {
    20: "ftp-data", 21: "ftp", 22: "ssh", 23: "telnet", 25: "smtp", 53: "dns", 80: "http",
    123: "ntp", 443: "https", 445: "smb", 3389: "rdp", 8080: "http-alt",
}
WEB_PORTS = [80, 443, 8080]
ADMIN_PORTS = [22, 23, 445, 3389]

# --- fixed values: the 20 model features, in vector order -------------------
FEATURE_COLUMNS = [
    "log_duration", "log_packets", "log_bytes",
    "bytes_per_packet", "bytes_per_sec", "packets_per_sec",
    "tcp_syn_ratio", "tcp_ack_ratio", "tcp_fin_ratio",
    "log_inter_arrival_mean_ms", "log_inter_arrival_std_ms", "failed_connections",
    "is_inbound", "is_tcp", "is_udp", "is_icmp", "is_other_proto",
    "is_web_service", "is_admin_service", "is_uncommon_port",
]

# --- fixed values: wording of the explanations ------------------------------
# The two log inter-arrival features have no wording and keep their name.
FEATURE_WORDING = {
    "log_duration": "session duration",
    "log_packets": "packet volume",
    "log_bytes": "byte volume",
    "bytes_per_packet": "bytes per packet",
    "bytes_per_sec": "throughput",
    "packets_per_sec": "packet rate",
    "tcp_syn_ratio": "SYN ratio",
    "tcp_ack_ratio": "ACK ratio",
    "tcp_fin_ratio": "FIN ratio",
    "failed_connections": "failed connections",
    "is_inbound": "inbound direction",
    "is_tcp": "TCP usage",
    "is_udp": "UDP usage",
    "is_icmp": "ICMP usage",
    "is_other_proto": "other-protocol usage",
    "is_web_service": "web-service traffic",
    "is_admin_service": "admin-service traffic",
    "is_uncommon_port": "uncommon destination port",
}

# --- fixed values: traffic classes and risk bands ---------------------------
TRAFFIC_CLASSES = [
    "BENIGN", "DoS/DDoS", "Port Scan", "Brute Force", "Web Attack", "Botnet",
    "Infiltration", "Unknown Anomaly",
]
RISK_BANDS = [(18.0, "critical"), (12.0, "high"), (7.0, "medium")]

# --- fixed values: scoring constants ----------------------------------------
CLIP = 12.0
SUBSPACE_RANK = 4
WEIGHT_DISTANCE = 1.6
WEIGHT_RECONSTRUCTION = 1.2
WEIGHT_RARITY = 0.85
UNSEEN_FREQUENCY = 0.0001
ZERO_MAD = 1e-6
MIN_BENIGN_ROWS = 250

# --- fixed values: the 12 encoder inputs ------------------------------------
ENCODER_NUMERIC_COLUMNS = [
    "duration_sec", "packets", "bytes",
    "tcp_syn_ratio", "tcp_ack_ratio", "tcp_fin_ratio",
    "inter_arrival_mean_ms", "inter_arrival_std_ms",
    "failed_connections", "dst_port",
]
PROTOCOL_ORDINALS = {"TCP": 0, "UDP": 1, "ICMP": 2, "OTHER": 3}
DIRECTION_ORDINALS = {"outbound": 0, "inbound": 1}
ENCODER_COLUMNS = ENCODER_NUMERIC_COLUMNS + ["protocol_num", "direction_num"]

# --- fixed values: file names that are documentation rather than flows ------
SKIP_FILE_WORDS = [
    "feature", "list_event", "event", "readme", "description", "metadata", "schema",
]

# --- fixed values: embedding quality targets --------------------------------
TARGET_ACCURACY = 0.90
TARGET_INTRA = 0.70
TARGET_INTER = 0.30

# --- fixed values: key of one flow signature, identity columns of exports ---
SIGNATURE_COLUMNS = ["src_ip", "dst_ip", "dst_port", "protocol"]
EXPORT_ID_COLUMNS = ["src_ip", "dst_ip", "dst_port", "protocol", "traffic_class", "label"]

# --- fixed values: IANA special-purpose IPv4 blocks counted as private ------
PRIVATE_IPV4_BLOCKS = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/29", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32",
]
