"""Naming conventions, word lists and thresholds the operators work with."""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# The results depend on these exact patterns, lists and numbers.
# ---------------------------------------------------------------------------

KEY_SHAPE = r"(^ID$|_ID$|^PK_|_PK$|_KEY$|_SEQ$|_SURROGATE)"
STRONG_KEY_SHAPE = r"(^ID$|^PK_|_PK$|_KEY$|_SEQ$|_SURROGATE)"
NULLABLE_KEY_SHAPE = r"(^ID$|_ID$|^PK_|_PK$|_KEY$)"
FOREIGN_KEY_SHAPE = r"(_ID|_KEY|_REF)$"
DATE_SHAPE = r"(_DATE|_DT|_DAY|_AT|_ON|_TS|_TIME|_TIMESTAMP)$"
FLAG_SHAPE = r"(_FL$|_FLAG$|_IND$|_INDICATOR$|^IS_|_IS$|_YN$|_BIT$)"

NUMERIC_TYPES = (
    "NUMBER", "INTEGER", "INT", "BIGINT", "SMALLINT", "TINYINT", "BYTEINT", "DECIMAL",
    "NUMERIC", "FLOAT", "FLOAT4", "FLOAT8", "DOUBLE", "DOUBLE PRECISION", "FIXED",
)
DATE_TYPES = ("DATE",)
TIMESTAMP_TYPES = ("TIMESTAMP_NTZ", "TIMESTAMP_LTZ", "TIMESTAMP_TZ", "TIMESTAMP", "DATETIME")
TEMPORAL_TYPES = DATE_TYPES + TIMESTAMP_TYPES
BOOLEAN_TYPES = ("BOOLEAN", "BOOL", "BIT")
TEXT_TYPES = (
    "VARCHAR", "TEXT", "STRING", "CHAR", "CHARACTER", "NCHAR", "NVARCHAR", "NVARCHAR2",
    "CHAR VARYING", "CHARACTER VARYING",
)

#: (name pattern, allowed types, rule code); the first pattern that hits decides.
NAME_TYPE_RULES = (
    (r"(_ID|_KEY|_FK|_PK|_SEQ|_NUM|_NO)$", NUMERIC_TYPES, "COLUMN_ID_WRONG_TYPE"),
    (r"(_DATE|_DT|_DAY|_MONTH|_YEAR|_PERIOD)$", TEMPORAL_TYPES, "COLUMN_DATE_WRONG_TYPE"),
    (r"(_TS|_TIMESTAMP|_TIME|_AT|_ON)$", TEMPORAL_TYPES, "COLUMN_TIMESTAMP_WRONG_TYPE"),
    (
        r"(_FL|_FLAG|_IND|_INDICATOR|^IS_|_IS$|_YN$|_BIT$)$",
        BOOLEAN_TYPES + NUMERIC_TYPES,
        "COLUMN_FLAG_WRONG_TYPE",
    ),
    (
        r"(_AMT|_AMOUNT|_PRICE|_COST|_RATE|_VALUE|_TOTAL|_SUM|_QTY|_QUANTITY)$",
        NUMERIC_TYPES,
        "COLUMN_AMOUNT_WRONG_TYPE",
    ),
)

PII_NAMES = (
    "SSN", "SOCIAL_SECURITY", "SOCIAL_SEC",
    "PASSPORT", "PASSPORT_NUM", "PASSPORT_NO",
    "EMAIL", "EMAIL_ADDR", "EMAIL_ADDRESS",
    "PHONE", "PHONE_NUM", "PHONE_NUMBER", "MOBILE", "MOBILE_NUM",
    "PASSWORD", "PASSWD", "PWD", "HASHED_PASSWORD",
    "CREDIT_CARD", "CARD_NUMBER", "CARD_NUM", "CVV", "CVC",
    "DOB", "BIRTH_DATE", "DATE_OF_BIRTH", "BIRTHDATE",
    "SALARY", "COMPENSATION", "INCOME", "WAGE",
    "ROUTING_NUMBER", "BANK_ACCOUNT", "ACCOUNT_NUMBER", "IBAN",
    "IP_ADDRESS", "IP_ADDR",
    "BIOMETRIC", "FINGERPRINT", "FACE_ID",
    "NATIONAL_ID", "TAX_ID", "NIN", "SIN",
    "MEDICAL_RECORD", "PATIENT_ID", "HEALTH_ID",
)
PII_PATTERNS = (
    r"EMAIL",
    r"PHONE|MOBILE",
    r"SSN|SOCIAL.SEC",
    r"PASSPORT",
    r"PASSWORD|PASSWD|PWD",
    r"CREDIT.?CARD|CARD.?NUM|CVV|CVC",
    r"\bDOB\b|BIRTH.?DATE|DATE.?OF.?BIRTH",
    r"\bSALARY\b|COMPENSATION|INCOME",
    r"BANK.?ACCT|ACCOUNT.?NUM|ROUTING|IBAN",
    r"\bIP.?ADDR",
    r"NATIONAL.?ID|TAX.?ID|NIN\b|SIN\b",
)
GENERIC_NAMES = (
    "COL", "COL1", "COL2", "COL3", "COL4", "COL5",
    "COLUMN", "COLUMN1", "COLUMN2", "COLUMN3",
    "FIELD", "FIELD1", "FIELD2", "FIELD3",
    "DATA", "DATA1", "DATA2",
    "VALUE", "VAL", "VAL1",
    "INFO", "MISC", "OTHER", "EXTRA", "ATTR",
    "TEMP", "TMP", "TEST", "DUMMY",
    "A", "B", "C", "D", "E", "F", "X", "Y", "Z",
    "FLAG", "TYPE", "STATUS",
)
CREATED_AT_NAMES = (
    "CREATED_AT", "CREATE_DATE", "CREATED_DATE", "CREATED_DT",
    "CREATED_ON", "CREATE_DT", "INS_DATE", "INSERT_DATE",
    "INSERT_TS", "CREATED_TS", "CREATED_TIME",
)
UPDATED_AT_NAMES = (
    "UPDATED_AT", "UPDATE_DATE", "MODIFIED_DATE", "MODIFIED_DT",
    "LAST_MODIFIED", "MODIFIED_ON", "UPD_DATE", "LAST_UPDATED",
    "UPDATED_TS", "MODIFIED_TS", "LAST_MODIFIED_TS",
)
MAX_COLUMNS = 50

#: Type family used to decide whether two key columns can be joined.
TYPE_FAMILIES = {
    "numeric": (
        "NUMBER", "DECIMAL", "NUMERIC", "INT", "INTEGER", "BIGINT", "SMALLINT", "TINYINT",
        "BYTEINT", "FLOAT", "FLOAT4", "FLOAT8", "DOUBLE", "DOUBLE PRECISION", "REAL",
    ),
    "text": ("TEXT", "VARCHAR", "CHAR", "CHARACTER", "STRING"),
    "temporal": (
        "DATE", "TIME", "DATETIME", "TIMESTAMP", "TIMESTAMP_NTZ", "TIMESTAMP_LTZ", "TIMESTAMP_TZ",
    ),
    "boolean": ("BOOLEAN",),
    "binary": ("BINARY", "VARBINARY"),
}
UNIVERSAL_KEY_NAMES = ("SURROGATE_KEY", "ROW_ID", "RECORD_ID", "ID")
BARE_KEY_NAMES = ("ID", "PK", "KEY", "SEQ")

# Column categories of the profile.
NUMERIC_PREFIXES = (
    "NUMBER", "DECIMAL", "INT", "FLOAT", "DOUBLE", "SMALLINT", "INTEGER", "BIGINT", "NUMERIC",
    "REAL", "SERIAL", "MONEY",
)
DATE_PREFIXES = ("DATE", "TIME", "TIMESTAMP")
TEXT_PREFIXES = ("VARCHAR", "CHAR", "STRING", "TEXT", "CHARACTER")
AMOUNT_HINTS = (
    "AMOUNT", "AMT", "PRICE", "COST", "REVENUE", "SALARY", "BALANCE", "TOTAL", "FEE", "SPREAD",
    "PREMIUM", "VALUE", "USD",
)
ID_HINTS = ("_ID", "_KEY", "_PK", "_FK", "_SEQ", "GUID", "UUID")
STATUS_HINTS = ("STATUS", "STATE", "_FL", "_FLAG", "_IND", "IS_", "TYPE", "KIND", "CATEGORY")
CATEGORY_ORDER = (
    "id", "date", "amount", "measure", "status", "categorical", "email", "phone", "text",
)
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
PHONE_PATTERN = r"^\+?[0-9][0-9\-\s().]{6,}$"

#: Short spellings of threshold keys and the name they stand for.
THRESHOLD_ALIASES = {
    "min": "min_value",
    "max": "max_value",
    "minimum": "min_value",
    "maximum": "max_value",
    "pattern_regex": "pattern",
    "regex": "pattern",
    "values": "accepted_values",
    "allowed_values": "accepted_values",
}

#: Words that carry no meaning when two rule texts are compared.
STOP_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have",
    "has", "had", "do", "does", "did", "will", "would", "could", "should", "may",
    "might", "must", "shall", "can", "need", "dare", "ought", "used", "to", "of",
    "in", "for", "on", "with", "at", "by", "from", "as", "into", "through", "this",
    "that", "these", "those", "it", "its", "and", "or", "but", "if", "than", "when",
    "where", "which", "who", "how", "all", "each", "every", "both", "rule", "check",
    "column", "table", "snowflake", "data", "quality", "not", "no", "any",
)
SIMILARITY_THRESHOLD = 0.55
SYNTHESIS_SIMILARITY_THRESHOLD = 0.5
REPROPOSE_BELOW = 0.3

SEVERITY_WEIGHT = {"critical": 5, "high": 3, "medium": 2, "low": 1, "info": 1}
DEFAULT_SEVERITY_WEIGHT = 2
SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}
HISTORY_LIMIT = 20
FAIL_HISTORY_MAX = 50
REOPEN_WINDOW_DAYS = 7

RESCAN_NOTE = "Auto-resolved by rescan"
VERIFICATION_NOTE = "Auto-resolved by verification scan — rule no longer fires on current schema."
STALE_PROPOSAL_REASON = "Superseded by a new scan before the prior review was completed."

BASELINE_WINDOW_DAYS = 30
BASELINE_MIN_SAMPLES = 14
#: metric -> (check shape, severity, rank); lower rank is proposed first.
METRIC_PROPOSALS = {
    "row_count": ("metric_anomaly", "high", -3),
    "freshness_lag_hours": ("metric_anomaly", "high", -2),
    "null_pct": ("metric_anomaly", "medium", 0),
    "distinct_count": ("metric_anomaly", "low", 0),
    "observed_categories": ("category_disappeared", "medium", -1),
}
TABLE_DEFAULT_METRICS = ("row_count", "freshness_lag_hours")

DRIFT_SEVERITY = {
    "column_added": "low",
    "column_removed": "high",
    "column_type_changed": "high",
    "column_nullability_changed": "medium",
    "table_removed": "critical",
}

ORPHAN_REJECT_RATE = 0.90
MIN_OWNER_RATIO = 0.5

RETIRE_QUIET_DAYS = 90
RETIRE_MIN_RUNS = 3
FLAPPING_REOPENS = 4
RELEVANCE_TOKEN = r"[A-Za-z][A-Za-z0-9_]+"
SYNTHESIS_LESSON_LIMIT = 40
#: maintenance action -> new status of the rule instance.
MAINTENANCE_STATUS = {
    "retire_candidate": "paused",
    "flapping": "paused",
    "superseded": "retired",
    "obsolete_target": "retired",
}
STICKY_ENROLLMENTS = ("user", "auto_table")

OBJECT_KINDS = {
    "TABLE": "table",
    "VIEW": "view",
    "MATERIALIZED VIEW": "materialized_view",
    "DYNAMIC TABLE": "dynamic_table",
    "EXTERNAL TABLE": "external_table",
    "ICEBERG TABLE": "iceberg_table",
    "STAGE": "stage",
    "EXTERNAL LOCATION": "external_location",
    "SEMANTIC VIEW": "semantic_view",
}
# ------------------------------ end of fixed values ------------------------


@dataclass(frozen=True)
class ProfilePolicy:
    """Tunable thresholds of the profile."""

    top_k: int = 5
    top_values_max_distinct: int = 50
    tail_values_max_distinct: int = 200
    closed_set_max_distinct: int = 50
    categorical_max_distinct: int = 15
    outlier_stddevs: float = 4.0
    high_null_pct: float = 30.0
    stale_days: float = 7.0
    pattern_min_pct: float = 95.0


@dataclass(frozen=True)
class NamingPolicy:
    """How key columns are recognised from their names.

    ``strip_prefix`` is removed from a column name before the patterns are
    tried, so that ``o_custkey`` can be read as ``custkey``.
    """

    key_shape: str = KEY_SHAPE
    foreign_key_shape: str = FOREIGN_KEY_SHAPE
    strip_prefix: str = ""


#: Star schemas name columns ``<table letter>_<entity>key``.
STAR_NAMING = NamingPolicy(
    key_shape=r"(KEY$|_ID$|^ID$)", foreign_key_shape=r"KEY$", strip_prefix=r"^[A-Z]{1,2}_"
)
