"""Fixed values shared by every job: names, input contract, weights, texts."""

from __future__ import annotations

# --- fixed values: vocabularies -------------------------------------------
SOURCE_TYPES = ["cdr", "ipdr", "bank_upi", "email", "android_log"]

PHONE = "phone"
ACCOUNT = "account"
IMEI = "device_imei"
IP = "ip_address"
MAC = "mac_address"
EMAIL = "email_address"
ENTITY_TYPES = [PHONE, ACCOUNT, IMEI, IP, MAC, EMAIL]

CASE_STATUSES = ["active", "closed", "archived"]

# --- fixed values: identifier patterns ------------------------------------
# Word boundaries are spelled out as ASCII look-arounds so that results do not
# depend on how a given JDK reads \b.
_NOT_AFTER_WORD = r"(?<![0-9A-Za-z_])"
_NOT_BEFORE_WORD = r"(?![0-9A-Za-z_])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
EMAIL_RE = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+"
IPV4_RE = rf"{_NOT_AFTER_WORD}{_OCTET}(?:\.{_OCTET}){{3}}{_NOT_BEFORE_WORD}"
MAC_RE = rf"{_NOT_AFTER_WORD}(?:[0-9A-Fa-f]{{2}}[:-]){{5}}[0-9A-Fa-f]{{2}}{_NOT_BEFORE_WORD}"
IMEI_RE = rf"{_NOT_AFTER_WORD}[0-9]{{14,16}}{_NOT_BEFORE_WORD}"
LOG_PHONE_RE = r"(?i)(?:phone|msisdn|tel)[:=]\s*(\+?[0-9]{10,15})"
PACKAGE_RE = r"^[a-zA-Z_][a-zA-Z0-9_]*+(?:\.[a-zA-Z_][a-zA-Z0-9_]*+)++"

# Cells a CSV reader treats as missing (pandas defaults).
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- fixed values: header aliases per role (input contract) ----------------
# Dict order is the order in which roles are tried for a header.
CALL_ALIASES = {
    "caller": ["caller", "calling_number", "source_number", "caller_msisdn", "caller_phone",
               "ani", "from_number", "originating_number", "a_party", "calling_no"],
    "callee": ["callee", "called_number", "destination_number", "dialed_number", "dnis",
               "to_number", "terminating_number", "b_party", "called_no"],
    "imei": ["imei", "device_imei", "caller_imei", "source_imei", "imei_number", "first_imei"],
    "timestamp": ["timestamp", "call_date", "call_time", "start_time", "datetime", "date_time",
                  "time", "event_time"],
    "ip": ["ip", "ip_address", "source_ip", "client_ip", "dest_ip", "ipdr_ip"],
}
CALL_REQUIRED = ["caller", "callee", "imei", "ip"]

LEDGER_ALIASES = {
    "sender": ["sender_account", "sender_acc", "remitter_account", "from_account", "sender",
               "debit_account", "source_account", "remitter"],
    "receiver": ["receiver_account", "receiver_acc", "beneficiary_account", "to_account",
                 "receiver", "credit_account", "destination_account", "beneficiary"],
    "upi": ["upi_handle", "upi_id", "vpa", "virtual_address", "upi", "payee_vpa", "payer_vpa",
            "beneficiary_upi"],
    "amount": ["amount", "txn_amount", "transaction_amount", "value", "amt", "inr"],
    "timestamp": ["timestamp", "txn_date", "transaction_date", "date", "datetime", "time",
                  "txn_time"],
}
LEDGER_REQUIRED = ["sender", "receiver", "upi"]

# --- fixed values: link rules, root role -> (target role, link type, confidence)
CALL_RULES = {
    "caller": [("imei", "shared_imei", 0.95), ("callee", "direct_communication", 0.90),
               ("ip", "shared_ip_subnet", 0.85)],
    "callee": [("caller", "direct_communication", 0.90)],
    "imei": [("caller", "shared_imei", 0.95)],
    "ip": [("caller", "shared_ip_subnet", 0.85)],
}
CALL_ROLE_TYPES = {"caller": PHONE, "callee": PHONE, "imei": IMEI, "ip": IP}

LEDGER_RULES = {
    "sender": [("receiver", "transaction", 0.95), ("upi", "shared_upi_handle", 0.90),
               ("phone", "shared_upi_handle", 0.88)],
    "receiver": [("sender", "transaction", 0.95), ("upi", "shared_upi_handle", 0.95),
                 ("phone", "shared_upi_handle", 0.92)],
    "upi": [("receiver", "shared_upi_handle", 0.95), ("sender", "shared_upi_handle", 0.90),
            ("phone", "shared_upi_handle", 0.98)],
    "phone": [("upi", "shared_upi_handle", 0.98), ("receiver", "shared_upi_handle", 0.92)],
}
LEDGER_ROLE_TYPES = {"sender": ACCOUNT, "receiver": ACCOUNT, "upi": ACCOUNT, "phone": PHONE}

MAIL_RECIPIENT = ("direct_communication", 0.95)
MAIL_HOP = ("shared_ip_subnet", 0.85)

# Device dumps: root type -> (target type, link type, confidence).
DEVICE_RULES = {
    IMEI: [(MAC, "shared_mac", 0.98), (IP, "shared_ip_subnet", 0.90), (PHONE, "shared_imei", 0.95)],
    MAC: [(IMEI, "shared_imei", 0.98), (IP, "shared_ip_subnet", 0.90)],
    IP: [(IMEI, "shared_imei", 0.90), (MAC, "shared_mac", 0.90)],
    PHONE: [(IMEI, "shared_imei", 0.95)],
}
DEVICE_TYPE_ORDER = [IMEI, MAC, IP, PHONE]

# --- fixed values: link weights and bands ----------------------------------
LINK_WEIGHTS = {
    "shared_imei": 0.85,
    "shared_upi_handle": 0.80,
    "transaction": 0.75,
    "direct_communication": 0.70,
    "shared_mac": 0.60,
    "co_occurrence": 0.40,
    "shared_ip_subnet": 0.30,
}
DEFAULT_LINK_WEIGHT = 0.50
WEAK_BELOW = 0.50
MIN_CONFIDENCE = 1e-4
CONFIDENCE_BANDS = [(0.8, "Strong"), (0.5, "Medium")]
LOWEST_CONFIDENCE_BAND = "Weak"
SCORE_TIERS = [(80, "CRITICAL"), (60, "HIGH"), (40, "MEDIUM")]
LOWEST_SCORE_TIER = "LOW"
SEVERITY_BANDS = [(70, "critical"), (40, "elevated")]
LOWEST_SEVERITY_BAND = "baseline"

# --- fixed values: scoring --------------------------------------------------
VELOCITY = "HIGH_VELOCITY_ROUTING"
SIM_SWITCH = "SIM_SWITCHING_PATTERN"
FLAGGED_PEER = "SHARED_DEVICE_FLAGGED_PEER"
OVERSIZED = "OVERSIZED_CLUSTER"
HUB = "MULTI_ACCOUNT_TRANSACTION_HUB"
REASON_WEIGHTS = {VELOCITY: 45, SIM_SWITCH: 40, FLAGGED_PEER: 35, OVERSIZED: 20, HUB: 30}
VELOCITY_MIN_HOPS = 3
VELOCITY_WINDOW_MINUTES = 10
SIM_MIN_PHONES = 3
SIM_WINDOW_HOURS = 24
FLAGGED_MIN_SCORE = 40
OVERSIZED_MIN_RATIO = 1.5
HUB_MIN_PARTIES = 3
MAX_SCORE = 100
HIGH_RISK_MIN_SCORE = 40

REASON_TEXTS = {
    VELOCITY: "High-velocity multi-hop routing detected: %d linked entity hops observed within "
              "%d minutes, indicating rapid fund layering.",
    SIM_SWITCH: "SIM-switching / burner-rotation pattern: same device (IMEI %s) linked to %d "
                "distinct phone numbers within %dh, consistent with deliberate CDR identity "
                "obfuscation.",
    FLAGGED_PEER: "Shared device with already-flagged entity: this entity shares a device or MAC "
                  "with entity %d (risk score %d), indicating confederate device usage.",
    OVERSIZED: "Embedded in oversized syndicate cluster: cluster contains %d entities vs. case "
               "median of %.1f, indicating broad network membership (%.1fx above median).",
    HUB: "Multi-account transaction hub: this entity receives transactions from %d distinct "
         "sender accounts, consistent with mule aggregation or cash-pooling prior to layering.",
}
REVIEW_ADVICE = ("Recommended for investigator review — do not act without independent "
                 "corroboration of the evidence.")
LOW_RISK_ADVICE = ("No significant fraud indicators detected at this time. Continue routine "
                   "monitoring.")

PLAIN_REASONS = {
    "HIGH_VELOCITY_ROUTING":
        "Rapid fund layering connecting to 3+ distinct entities within a 10-minute window",
    "SIM_SWITCHING_PATTERN":
        "Physical handset cycling through 3+ distinct phone numbers within 24 hours",
    "SHARED_DEVICE_FLAGGED_PEER":
        "Shared hardware (IMEI/MAC) with an already flagged suspect entity (score ≥ 40)",
    "MULE_ACCOUNT_STRUCTURE":
        "Transaction pattern consistent with mule layering — small inbound bursts, rapid "
        "outbound transfers",
    "FLAGGED_IP_NEXUS": "IP address overlaps with a cluster of high-risk entities",
    "CROSS_CASE_ENTITY":
        "Entity appears across multiple cases — indicates organised network activity",
    "SUSPICIOUS_UPI_CHURN":
        "UPI handle linked to abnormal churn: high volume of small-value transactions over "
        "short span",
}

# --- fixed values: custody and brief texts ----------------------------------
GENESIS = "GENESIS"
INGEST_NOTE = "Forensic ingestion and cryptographic verification for %s (source: %s)"
BREAK_GENESIS = "Genesis entry contains unexpected previous_hash"
BREAK_LINK = ("missing entry or broken link: previous_hash does not match preceding "
              "chained_hash")
BREAK_HASH = "hash mismatch: recomputed chained_hash does not match stored value"
BREAK_UNLOGGED = ("missing entry: one or more evidence files lack corresponding custody log "
                  "entries")
BREAK_NO_LOG = "missing entry: Evidence files exist for case but custody log is empty"
EMPTY_CHAIN = "No custody log entries found for case (empty chain)"
STATEMENT_VALID = (
    "Tamper-evident chain of custody mathematically verified intact from genesis to head across "
    "%d evidentiary artifact(s). Complies with Section 65B of the Indian Evidence Act, 1872 and "
    "Section 63 of the Bharatiya Sakshya Adhiniyam, 2023."
)
STATEMENT_BROKEN = ("WARNING: Cryptographic custody chain verification FAILED. Discrepancy "
                    "detected: %s.")
CLASSIFICATION = "LAW ENFORCEMENT SENSITIVE // OFFICIAL INVESTIGATIVE BRIEF"
TOP_ENTITIES = 10
DIGEST_ENTITIES = 5
DIGEST_CLUSTERS = 3
HIDDEN_HASH_CHARS = 32

# --- fixed values: rejection classes ----------------------------------------
EMPTY_FILE = "EmptyFileError"
CORRUPTED = "CorruptedFileError"
MISSING_COLUMN = "MissingColumnError"
UNSUPPORTED = "UnsupportedFormatError"
