"""Redaction of secrets, paths and personal data as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of secrets and what takes their place, applied in this order.
SECRETS = (
    (r"""(?i)(api[_-]?key|apikey|api_secret)['":\s=]+['"]?([a-zA-Z0-9_-]{20,})['"]?""", "$1[REDACTED]"),
    (r"""(?i)bearer\s+([a-zA-Z0-9._-]{20,})""", "[REDACTED]"),
    (r"""(?i)(aws_?access_?key_?id|aws_?secret_?access_?key)['":\s=]+['"]?([A-Z0-9/+=]{16,})['"]?""", "$1[REDACTED]"),
    (r"""(gh[pousr]_[a-zA-Z0-9]{36,})""", "[REDACTED]"),
    (r"""-----BEGIN[A-Z ]*PRIVATE KEY-----""", "[REDACTED]"),
    (r"""(?i)(password|passwd|pwd)['":\s=]+['"]?([^\s'"]{8,})['"]?""", "$1[REDACTED]"),
    (r"""(?i)(postgres|mysql|mongodb|redis)://[^\s]+""", "[REDACTED]"),
    (r"""eyJ[a-zA-Z0-9_-]+\.eyJ[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+""", "[REDACTED]"),
    (r"""(?i)(secret|token|credential)['":\s=]+['"]?([a-zA-Z0-9_-]{16,})['"]?""", "$1[REDACTED]"),
)
#: Home directories, which vanish, and other absolute paths, of which the last part stays.
PATHS = (
    (r"/home/[^/\s]+/", ""), (r"/Users/[^/\s]+/", ""), (r"~/?", ""), (r"C:\\Users\\[^\\]+\\", ""), (r"%USERPROFILE%", ""), (r"/workspaces/[^/\s]+/", ""), (r"/workspace/", ""),
    (r"(?:/[a-zA-Z0-9_.-]+)+/([a-zA-Z0-9_.-]+)", "$1"),
)
#: Personal data and its placeholders.
PERSONAL = (
    (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[email]"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "[ip]"),
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "[uuid]"),
)


def apply(text: Column, rules) -> Column:
    return reduce(lambda t, rule: F.regexp_replace(t, rule[0], rule[1]), rules, text)


def redact(text: Column) -> Column:
    return apply(text, SECRETS)


def strip_paths(text: Column) -> Column:
    return apply(text, PATHS)


def generalize(text: Column) -> Column:
    return apply(text, PERSONAL)


def sanitize(text: Column) -> Column:
    return generalize(strip_paths(redact(text)))


def is_sensitive(text: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.rlike(text, F.lit(p)) for p, _ in SECRETS))


def as_sql(text: str, rules) -> str:
    """The same replacements as nested SQL calls."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return reduce(lambda t, rule: f"regexp_replace({t}, {quote(rule[0])}, {quote(rule[1].replace('$1', chr(92) + '1'))}, 'g')", rules, text)
