"""Column names and types of flow tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The 39 numeric features in model order.
FEATURES = (
    "PROTOCOL", "L7_PROTO", "IN_BYTES", "IN_PKTS", "OUT_BYTES", "OUT_PKTS", "TCP_FLAGS", "CLIENT_TCP_FLAGS",
    "SERVER_TCP_FLAGS", "FLOW_DURATION_MILLISECONDS", "DURATION_IN", "DURATION_OUT", "MIN_TTL", "MAX_TTL",
    "LONGEST_FLOW_PKT", "SHORTEST_FLOW_PKT", "MIN_IP_PKT_LEN", "MAX_IP_PKT_LEN", "SRC_TO_DST_SECOND_BYTES",
    "DST_TO_SRC_SECOND_BYTES", "RETRANSMITTED_IN_BYTES", "RETRANSMITTED_IN_PKTS", "RETRANSMITTED_OUT_BYTES",
    "RETRANSMITTED_OUT_PKTS", "SRC_TO_DST_AVG_THROUGHPUT", "DST_TO_SRC_AVG_THROUGHPUT", "NUM_PKTS_UP_TO_128_BYTES",
    "NUM_PKTS_128_TO_256_BYTES", "NUM_PKTS_256_TO_512_BYTES", "NUM_PKTS_512_TO_1024_BYTES",
    "NUM_PKTS_1024_TO_1514_BYTES", "TCP_WIN_MAX_IN", "TCP_WIN_MAX_OUT", "ICMP_TYPE", "ICMP_IPV4_TYPE",
    "DNS_QUERY_ID", "DNS_QUERY_TYPE", "DNS_TTL_ANSWER", "FTP_COMMAND_RET_CODE",
)

# Endpoints, targets, and the columns whose type is not bigint.
SRC_IP, SRC_PORT, DST_IP, DST_PORT = "IPV4_SRC_ADDR", "L4_SRC_PORT", "IPV4_DST_ADDR", "L4_DST_PORT"
ENDPOINTS = (SRC_IP, SRC_PORT, DST_IP, DST_PORT)
TARGETS = ("Label", "Attack")
STRING_COLUMNS = (SRC_IP, DST_IP, "Attack", "Dataset")
DOUBLE_COLUMNS = ("L7_PROTO", "SRC_TO_DST_SECOND_BYTES", "DST_TO_SRC_SECOND_BYTES", "FTP_COMMAND_RET_CODE")
DATASETS = ("NF-UNSW-NB15-v2", "NF-BoT-IoT-v2", "NF-ToN-IoT-v2", "NF-CSE-CIC-IDS2018-v2")
SPLITS = ("train", "val", "test")

# The 46 columns of a raw file: endpoints, features, targets, provenance.
RAW_COLUMNS = (*ENDPOINTS, *FEATURES, "Label", "Attack", "Dataset")
NUMERIC_COLUMNS = tuple(c for c in RAW_COLUMNS if c not in STRING_COLUMNS)
TRACE_COLUMNS = ("source_row_id", "flow_group_id")


def raw_schema() -> T.StructType:
    """Types of the 46 raw columns; integers stay 64-bit, so 2**53 + 1 survives."""
    kind = {c: T.StringType() for c in STRING_COLUMNS} | {c: T.DoubleType() for c in DOUBLE_COLUMNS}
    return T.StructType([T.StructField(c, kind.get(c, T.LongType())) for c in RAW_COLUMNS])


def require_columns(df: DataFrame, needed) -> DataFrame:
    """df itself, or a ValueError that names the missing columns in order."""
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
