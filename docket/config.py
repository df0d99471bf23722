"""Fixed values that results depend on.

Everything in the FIXED VALUES block below must stay equal to the behaviour
being reproduced (split boundaries, rule thresholds, issue codes, regex
patterns).  Operators take these as defaults; every operator also accepts its
own override argument so nothing here is a global switch.
"""

from __future__ import annotations

import datetime as _dt

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reproduced behaviour; do not reorder)
# ---------------------------------------------------------------------------

FEATURE_SCHEMA_VERSION = "opening-v1"
CANONICAL_MAPPING_VERSION = "1.0.0"
SNAPSHOT_TYPE = "opening"

# Source column -> domain column (validator column map).
COLUMN_MAP = {
    "case_enquiry_id": "external_id",
    "open_dt": "created_at",
    "closed_dt": "completed_at",
    "sla_target_dt": "deadline",
    "case_status": "current_status",
    "closure_reason": "closure_reason",
}
REQUIRED_COLUMNS = ["case_enquiry_id", "open_dt"]
CATEGORICAL_COLUMNS = ["source", "subject", "reason", "type", "neighborhood", "department"]
CATEGORICAL_FEATURES = ["source", "subject", "reason", "type", "neighborhood"]
NUMERIC_FEATURES = ["open_month", "open_weekday", "open_hour", "is_weekend", "sla_duration_hours"]
ALL_FEATURES = CATEGORICAL_FEATURES + NUMERIC_FEATURES
SNAPSHOT_REQUIRED_KEYS = ["created_at", "deadline", "source", "subject", "reason", "type", "neighborhood"]

MISSING_CODE = "missing"
UNKNOWN_CODE = "unknown"
NULL_TOKEN = "<<null>>"
EMPTY_TOKEN = "<<empty>>"

# Feature display labels (label catalog v1.0.0).
FEATURE_LABELS = {
    "source": "Bildirim Kaynagi",
    "subject": "Konu",
    "reason": "Neden",
    "type": "Surec Tipi",
    "neighborhood": "Mahalle",
    "open_month": "Acilis Ayi",
    "open_weekday": "Acilis Gunu (Haftanin)",
    "open_hour": "Acilis Saati",
    "is_weekend": "Haftasonu Acilis",
    "sla_duration_hours": "SLA Suresi (saat)",
}

# Reference split boundaries: half-open [start, end).
REFERENCE_SPLITS = [
    ("train", _dt.datetime(2024, 1, 1), _dt.datetime(2024, 9, 1)),
    ("validation", _dt.datetime(2024, 9, 1), _dt.datetime(2024, 10, 1)),
    ("test", _dt.datetime(2024, 10, 1), _dt.datetime(2024, 12, 1)),
    ("audit", _dt.datetime(2024, 12, 1), _dt.datetime(2025, 1, 1)),
]
REFERENCE_CUTOFF = _dt.datetime(2025, 1, 13)
ALLOWED_EVAL_SPLITS = ["train", "validation"]
SEALED_SPLITS = ["test", "audit"]

# Issue codes and severities.
ISSUE_CODES = [
    "DUPLICATE_FILE", "UNKNOWN_CANONICAL_MAPPING", "REQUIRED_FIELD_MISSING", "INVALID_DATE",
    "INVALID_FILE_SCHEMA", "OPENING_DATA_CONFLICT", "CANONICAL_MAPPING_MISMATCH",
    "UNSUPPORTED_FILE_FORMAT", "MISSING_REQUIRED_COLUMN",
]
SEVERITIES = ["warning", "error"]
IMPORT_STATUSES = ["pending", "running", "completed", "completed_with_issues", "failed", "duplicate_file"]
SUCCESS_IMPORT_STATUSES = ["completed", "completed_with_issues"]
PREDICTION_TYPES = ["normal", "simulation"]
PREDICTION_STATUSES = ["success", "failed"]
RISK_LEVELS = ["low", "medium", "high"]
FEEDBACK_TYPES = ["accuracy", "usefulness"]
SUPPORTED_EXTENSIONS = [".csv", ".xlsx"]

# Risk bands: score <= 39 low, <= 69 medium, else high.
RISK_LOW_MAX = 39
RISK_MEDIUM_MAX = 69
DEFAULT_THRESHOLD = 0.35
THRESHOLD_CUTS = 17            # 0.10, 0.15, ..., 0.90
THRESHOLD_START = 0.10
THRESHOLD_STEP = 0.05
IDLE_THRESHOLD = 0.5           # when no cut reaches a positive F1
LOGIT_EPS = 1e-15
IQR_MULTIPLIER = 1.5
CLEANING_MIN_YEAR = 2020
CLEANING_MAX_YEAR = 2026
FEEDBACK_COMMENT_MAX = 5000
PROCESS_TYPE_NULL_LABEL = "Tanımlanmamış"
DASHBOARD_DAYS = 30
TOP_PROCESS_TYPES = 10
RECENT_RUNS = 10
HISTORY_LIMIT = 50
SIMILAR_K = 5
PERMUTATION_REPEATS = 5

# Hyper-parameter grids.
SEARCH_SPACES = {
    "logreg": {"C": [0.1, 0.5, 1.0, 5.0, 10.0]},
    "gbt": {"learning_rate": [0.01, 0.05, 0.1, 0.2], "max_iter": [100, 200, 300], "max_leaf_nodes": [15, 31, 63, None], "max_depth": [3, 5, 7, None],
            "min_samples_leaf": [10, 20, 50], "l2_regularization": [0.0, 0.1, 1.0]},
    "rf": {"n_estimators": [100, 200, 300], "max_depth": [5, 10, 20, None], "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 5, 10],
           "max_features": ["sqrt", "log2", 0.5], "class_weight": ["balanced", "balanced_subsample", None]},
    "rf_regressor": {"n_estimators": [100, 200, 300], "max_depth": [5, 10, 20, None], "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 5, 10],
                     "max_features": ["sqrt", "log2", 0.5]},
    "enet": {"alpha": [0.01, 0.1, 0.5, 1.0, 5.0], "l1_ratio": [0.0, 0.25, 0.5, 0.75, 1.0]},
}

# What-if override ranges (inclusive).
OVERRIDE_RANGES = {
    "open_month": (1, 12),
    "open_weekday": (0, 6),
    "open_hour": (0, 23),
    "is_weekend": (0, 1),
    "sla_duration_hours": (0.0, 87600.0),
}

# Sensitive-content patterns (Java regex; case-insensitive flag inline).
SENSITIVE_PATTERNS = [
    ("api_key", r"""(?i)api[_-]?key\s*[=:]\s*["'][^"']+["']"""),
    ("password", r"""(?i)password\s*[=:]\s*["'][^"']+["']"""),
    ("token", r"""(?i)token\s*[=:]\s*["'][^"']{20,}["']"""),
    ("secret", r"""(?i)secret\s*[=:]\s*["'][^"']+["']"""),
    ("base64_like", r"""(?<![a-zA-Z0-9])[a-zA-Z0-9+/]{40,}(?![a-zA-Z0-9])"""),
]
# External asset reference: non-local http(s) URL ending in a static extension.
EXTERNAL_ASSET_PATTERN = r"""(?i)https?://(?!127\.0\.0\.1|localhost)[^\s"']+\.(js|css|png|svg|woff)"""

# ---------------------------------------------------------------------------
# Test-table stand-ins (our own choice, see README "test mapping")
# ---------------------------------------------------------------------------

# Priority -> SLA days; '4-NOT SPECIFIED' has no SLA.
PRIORITY_SLA_DAYS = {"1-URGENT": 7, "2-HIGH": 30, "3-MEDIUM": 90, "5-LOW": 365}
TEST_SPLITS = [
    ("train", _dt.datetime(1900, 1, 1), _dt.datetime(1999, 1, 1)),
    ("validation", _dt.datetime(1999, 1, 1), _dt.datetime(2000, 1, 1)),
    ("test", _dt.datetime(2000, 1, 1), _dt.datetime(2001, 1, 1)),
    ("audit", _dt.datetime(2001, 1, 1), _dt.datetime(2001, 7, 1)),
]
TEST_CUTOFF = _dt.datetime(2001, 1, 1)
# Dashboard "now" for the events-derived prediction table.
TEST_AS_OF = _dt.datetime(2024, 2, 10)
