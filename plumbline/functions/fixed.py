"""Patterns, word lists and vocabularies that define the results.

They must stay as they are for results to agree with other implementations of
the same checks.  Rules and thresholds live in ``params``.
"""

# Personal-data patterns of the risk check (search semantics).
RISK_PII_PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "phone": r"\b(\+\d{1,2}\s?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}\b",
    "credit_card": r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b",
    "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "passport": r"\b[A-Z]{1,2}\d{6,9}\b",
}

# A literal that every match of the pattern must contain.
PII_REQUIRED_LITERAL = {"email": "@", "ssn": "-", "ip_address": "."}

# The length of a run of digits that every match must contain.
PII_REQUIRED_DIGITS = {"phone": 3, "credit_card": 4, "passport": 6}

# Personal-data patterns of the governance check.
GOVERNANCE_PII_PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
}

# Parts of a column name that mark it as sensitive; first hit wins.
SENSITIVE_NAME_TERMS = [
    "ssn", "social_security", "tax_id", "passport", "license", "credit_card",
    "password", "secret", "token", "api_key", "salary", "income", "wage",
    "dob", "birth_date", "birthdate", "medical", "health", "diagnosis",
    "religion", "ethnicity", "race", "political", "sexual_orientation",
]

# Parts of a column name that show that consent is tracked.
CONSENT_NAME_TERMS = ["consent", "opt_in", "opt_out"]

# Required governance columns and their allowed values.
LINEAGE_FIELDS = ["source_system", "created_date", "modified_date"]
CONSENT_FIELDS = ["consent_status", "consent_date", "data_subject_id"]
CLASSIFICATION_FIELDS = ["data_classification", "sensitivity_level", "retention_period"]
CONSENT_STATUSES = ["granted", "denied", "withdrawn", "pending"]
DATA_CLASSIFICATIONS = ["public", "internal", "confidential", "restricted"]
SENSITIVITY_LEVELS = ["low", "medium", "high", "critical"]
SOURCE_SYSTEM_PATTERN = "^[A-Z_]+$"

# Default rule tables of the rule checks.
UNIQUE_COLUMNS = ["id", "email", "username", "employee_id"]
RANGE_RULES = {
    "age": (0, 120),
    "salary": (0, 1000000),
    "score": (0, 100),
    "rating": (1, 5),
    "quantity": (0, None),
    "price": (0, None),
    "percentage": (0, 100),
}
FORMAT_RULES = {
    "email": r"^[\w\.-]+@[\w\.-]+\.[a-zA-Z]{2,}$",
    "phone": r"^\+?[1-9]\d{1,14}$|^\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}$",
    "ssn": r"^\d{3}-\d{2}-\d{4}$",
    "zip_code": r"^\d{5}(-\d{4})?$",
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "credit_card": r"^\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}$",
    "url": r"^https?:\/\/[\w\.-]+\.[a-zA-Z]{2,}(\/.*)?$",
    "ip_address": r"^(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$",
    "product_code": r"^[A-Z]{2,3}-\d{4,6}$",
    "currency": r"^\$?\d{1,3}(,\d{3})*(\.\d{2})?$",
}

# An IPv4 address whose octets are at most 255 (strict option).
STRICT_IP_PATTERN = (
    r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}"
    r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"
)

# Cell texts that a CSV reader treats as missing.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]

# Text that reads as a floating point number.
NUMERIC_TEXT = (
    r"^\s*[+-]?((\d(_?\d)*(\.(\d(_?\d)*)?)?|\.\d(_?\d)*)([eE][+-]?\d(_?\d)*)?"
    r"|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$"
)

# Text that starts like a date.
DATE_TEXT = r"^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4})"

# Which type changes keep old readers working (old -> new types).
COMPATIBLE_UPGRADES = {
    "bigint": ["double", "string"],
    "int": ["bigint", "double", "string"],
    "float": ["double", "string"],
    "boolean": ["string"],
    "timestamp": ["string"],
}
