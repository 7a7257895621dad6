"""Fixed values and argument defaults.

The values under "fixed values" must equal the behaviour being reproduced for results to match;
they are stated plainly and in their natural order.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------------------------
# fixed values
# ---------------------------------------------------------------------------------------------

# Slice configurations: training_config -> resource-block groups of slice 0, 1, 2 (eMBB, URLLC,
# mMTC).  Every entry sums to 17.
SLICE_CONFIGS = {
    "tr0": [2, 13, 2], "tr1": [4, 11, 2], "tr2": [6, 9, 2], "tr3": [8, 7, 2], "tr4": [10, 5, 2],
    "tr5": [12, 3, 2], "tr6": [14, 1, 2], "tr7": [2, 11, 4], "tr8": [4, 9, 4], "tr9": [6, 7, 4],
    "tr10": [8, 5, 4], "tr11": [10, 3, 4], "tr12": [12, 1, 4], "tr13": [2, 9, 6], "tr14": [4, 7, 6],
    "tr15": [6, 5, 6], "tr16": [8, 3, 6], "tr17": [10, 1, 6], "tr18": [2, 7, 8], "tr19": [4, 5, 8],
    "tr20": [6, 3, 8], "tr21": [8, 1, 8], "tr22": [2, 5, 10], "tr23": [4, 3, 10], "tr24": [6, 1, 10],
    "tr25": [2, 3, 12], "tr26": [4, 1, 12], "tr27": [2, 1, 14],
}

# Scheduling policy names and their codes; any other name has no code (null).
SCHED_POLICY_CODES = {"sched0": 0, "sched1": 1, "sched2": 2}

# Imputation constants of the quality and load features.
DEFAULT_DL_ERRORS_PCT = 2.5
DEFAULT_UL_ERRORS_PCT = 2.5
DEFAULT_DL_CQI = 10.0
DEFAULT_NUM_UES = 5.0
MAX_CQI = 15.0
MAX_UES = 42.0

# The twelve model features (in model order) and the target.
FEATURE_COLUMNS = [
    "slice_id", "sched_policy_num", "allocated_rbgs",
    "sum_requested_prbs", "sum_granted_prbs",
    "prb_utilization", "throughput_efficiency", "qos_score",
    "network_load", "hour", "minute", "day_of_week",
]
TARGET_COLUMN = "allocation_efficiency"

# Raw KPI column names as they appear in the CSV files, and the names used in this library.
RAW_COLUMN_NAMES = {
    "Timestamp": "ts_ms",
    "tx_brate downlink [Mbps]": "tx_brate_dl_mbps",
    "tx_errors downlink (%)": "tx_errors_dl_pct",
    "rx_errors uplink (%)": "rx_errors_ul_pct",
}

# Text screening: case-insensitive substrings that mark a value as dangerous.
DANGEROUS_PATTERNS = ["<script", "javascript:", "data:", "vbscript:", "onload=", "onerror="]

# Characters removed at both ends by the screening trim: Unicode white space as Python's
# str.strip() defines it (Java and RE2 "\s" classes are narrower).
STRIP_CHARS_CLASS = (r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                     r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")

# ---------------------------------------------------------------------------------------------
# argument defaults (configuration defaults of the reproduced system)
# ---------------------------------------------------------------------------------------------

TOTAL_RBGS = 17
NUM_SLICES = 3
CURRENT_ALLOCATION = [5, 7, 5]
GENETIC_POPULATION = 80
GENETIC_GENERATIONS = 15
VALIDATION_SPLIT = 0.2
RANDOM_SEED = 42
QUALITY_THRESHOLD = 70.0
SAMPLE_SIZE = 5_000_000
RF_TREES = 300
RF_MAX_DEPTH = 16
CV_TREES = 100
CV_FOLDS = 5
IQR_THRESHOLD = 1.5
RATE_LIMIT = 100
RATE_WINDOW_SECONDS = 3600
BRUTEFORCE_WINDOW_SECONDS = 3600
BRUTEFORCE_THRESHOLD = 10
MAX_INPUT_LENGTH = 1000
RECENT_EVENTS = 50
RECENT_EVENTS_KEPT = 1000
DP_EPSILON = 1.0
DP_DELTA = 0.0
