"""Redaction of session facts: nine replacements on strings, and sensitive keys of JSON objects."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "[redacted]"
_DASHES = "-----"

# The patterns whose matches are replaced, in order, in the syntax shared by Java and Python.
PEM = rf"{_DASHES}BEGIN [A-Z ]*PRIVATE KEY{_DASHES}[\s\S]*?{_DASHES}END [A-Z ]*PRIVATE KEY{_DASHES}"
BEARER = r"Bearer\s+[A-Za-z0-9._~+/=-]+"
PLAIN = (r"AIza[0-9A-Za-z_-]{20,}", r"sk-[A-Za-z0-9_-]{20,}", r"gh[pousr]_[A-Za-z0-9_]{20,}", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b")
URL = r"(?i)\b([a-z][a-z0-9+.-]*://[^:\s/@]+:)[^@\s\"'`]+(@[^\s\"'`]+)"
ASSIGNMENT = r"(?i)\b([A-Z0-9_]*(?:PASSWORD|PASSWD|SECRET|TOKEN|API_KEY|ACCESS_KEY|PRIVATE_KEY|DATABASE_URL)[A-Z0-9_]*\s*=(?!=)\s*)([^\s\"'`]+)"
SENSITIVE_KEY = r"(?i)(authorization|password|passwd|secret|api[_-]?key|access[_-]?token|refresh[_-]?token|bearer|cookie|credential|private[_-]?key|encrypted[_-]?content|cipher[_-]?text)"


def _steps() -> list[tuple[str, str]]:
    """Pattern and replacement, groups written as $1."""
    pem = f"{_DASHES}BEGIN PRIVATE KEY{_DASHES}{REDACTED}{_DASHES}END PRIVATE KEY{_DASHES}"
    return [(PEM, pem), (BEARER, f"Bearer {REDACTED}"), *((p, REDACTED) for p in PLAIN), (URL, f"$1{REDACTED}$2"), (ASSIGNMENT, f"$1{REDACTED}")]


def redact(text: Column) -> Column:
    """A string column with every match replaced; the whole chain stays inside the JVM."""
    for pattern, replacement in _steps():
        text = F.regexp_replace(text, pattern, replacement)
    return text


_COMPILED = [(re.compile(p), re.sub(r"\$(\d)", r"\\g<\1>", r)) for p, r in _steps()]
_KEY = re.compile(SENSITIVE_KEY)


def redact_value(value: object) -> object:
    """A JSON value with strings redacted and the values of sensitive keys replaced, at every depth."""
    if isinstance(value, str):
        for pattern, replacement in _COMPILED:
            value = pattern.sub(replacement, value)
        return value
    if isinstance(value, list):
        return [redact_value(v) for v in value]
    if isinstance(value, dict):
        return {k: REDACTED if _KEY.search(k) else redact_value(v) for k, v in value.items()}
    return value


def redact_json(text: Column) -> Column:
    """A column of JSON texts, redacted by key and string; one that is not JSON is redacted as a string."""

    @F.pandas_udf("string")
    def done(values: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None:
                return None
            try:
                return json.dumps(redact_value(json.loads(t)), separators=(",", ":"), ensure_ascii=False)
            except ValueError:
                return str(redact_value(t))

        return values.map(one)

    return done(text)
