"""Thresholds and word lists of profiling, relationship discovery and validation."""

from __future__ import annotations

from dataclasses import dataclass

# The lists and patterns below define results.
PLACEHOLDERS = ("n/a", "na", "null", "none", "unknown", "tbd", "pending", "n.a.", "not available", "--", "???", "?", "missing")
TRUE_SPELLINGS = ("true", "t", "yes", "y", "1", "1.0")
FALSE_SPELLINGS = ("false", "f", "no", "n", "0", "0.0")
EMAIL = r"^[^@\s]+@[^@\s]+$"
KNOWN_PATTERNS = {
    # inside of the class, the two backslashes admit a backslash and an s, not white space: kept, as it defines results
    "phone_intl": r"^\+\d{1,3}[-.\\s]?\d{1,14}$",
    "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$",
    "date_iso": r"^\d{4}-\d{2}-\d{2}$",
    "currency": r"^\$\d{1,3}(,\d{3})*(\.\d{2})?$",
    "url": r"^https?://[^\s]+$",
    "uuid": r"^[{]?[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}[}]?$",
}
SINGAPORE_PATTERNS = {"phone_sg": r"^[689]\d{7}$", "nric_sg": r"^[STFGM]\d{7}[A-Z]$", "postal_code_sg": r"^\d{6}$"}
SUSPICIOUS = (r"^0{3,}$", r"^1{3,}$", r"^9{3,}$", r"^x{3,}", r"^dummy")
DESCRIPTIVE_PREFIXES = ("billing", "shipping", "mailing", "home", "work", "customer", "supplier", "vendor", "contact", "delivery", "invoice")
DESCRIPTIVE_TERMS = (
    "name", "firstname", "lastname", "fullname", "address", "street", "city", "state", "province", "region", "country", "postalcode", "postcode", "zipcode", "zip",
    "phone", "mobile", "fax", "email", "title", "description", "comment", "notes",
)
HIERARCHY_TERMS = ("reportsto", "manager", "managerid", "parent", "parentid", "supervisor", "supervisorid", "boss", "lead", "owner", "ownerid")
ASSIGNMENT_PARENTS = ("employee", "staff", "person", "people", "user", "agent", "representative", "rep", "accountmanager")
ASSIGNMENT_KEYS = ("rep", "representative", "agent", "staff", "employee", "salesperson", "owner", "manager", "assignee")
ID_TOKENS = ("id", "key", "identifier", "uuid", "ssn")
#: Names of identifiers that hold a separator, and so are no token.
ID_PHRASES = ("soc_sec",)
OWNER_NAMES = ("reportsto", "manager", "managerid", "parent", "parentid", "supervisor", "supervisorid", "owner", "ownerid")
NA_TOKENS = ("", "#N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


@dataclass(frozen=True)
class Config:
    max_sample_values: int = 5
    max_permissible_values: int = 50
    categorical_threshold: int = 20
    near_dupe_threshold: float = 0.88
    near_dupe_max_values: int = 2000
    pk_uniqueness: float = 0.95
    fk_coverage: float = 0.95
    one_to_one_coverage: float = 0.95
    join_coverage: float = 0.90
    name_score: float = 0.65
    duplicate_threshold: float = 0.9
    near_identical_threshold: float = 0.7
    outlier_z: float = 3.0
    outlier_multiplier: float = 2.0
    range_fence_multiplier: float = 3.0
    uniqueness_rule_min_ratio: float = 0.9
    country_patterns: bool = False
    date_formats: tuple[str, ...] = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "MMMM d, yyyy", "dd/MM/yyyy", "yyyyMMdd")


DEFAULT = Config()
