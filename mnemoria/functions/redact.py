"""Credential redaction as three ordered replacements; applying it twice changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MARKER = "[REDACTED]"

# Names whose value is a credential; longer names come before their parts.
CREDENTIAL_KEYS = [
    "authorization", "auth[-_]?token", "access[-_]?token", "refresh[-_]?token", "client[-_]?secret",
    "private[-_]?key", "x[-_]?api[-_]?key", "api[-_]?key", "apikey", "set[-_]?cookie", "cookie",
    "signature", "password", "passwd", "pwd", "secret", "bearer", "token",
]
HEADER_KEYS = ["authorization", "set[-_]?cookie", "cookie"]

# A block of key text, a header line, and an assignment. The value group of the last ends at the quote it
# began with, or at the first character that no bare credential holds; values already replaced are left alone.
KEY_BLOCK = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z0-9 ]*PRIVATE KEY-----"
# The value starts after all blanks; where only blanks follow, the last one is the value.
HEADER = (
    rf"(?i)((?:{'|'.join(HEADER_KEYS)})[ \t]*:(?:[ \t]*+(?=[^\r\n])|[ \t]*(?=[ \t](?:[\r\n]|\z))))"
    r"(?!\[REDACTED)[^\r\n]+"
)
ASSIGNMENT = (
    rf"(?i)([\"']?(?:{'|'.join(CREDENTIAL_KEYS)})[\"']?[ \t]*+[:=][ \t]*+)"
    r"(?:([\"'])(?!\[REDACTED)(?:(?!\2)[^\r\n])+\2|(?!\[REDACTED)[^\s\"',;)}\]]+)"
)


def _steps(text: Column) -> tuple[Column, Column, Column]:
    no_blocks = F.regexp_replace(text, KEY_BLOCK, MARKER)
    no_headers = F.regexp_replace(no_blocks, HEADER, "$1" + MARKER)
    return no_blocks, no_headers, F.regexp_replace(no_headers, ASSIGNMENT, "$1$2" + MARKER + "$2")


def redacted(text: Column) -> Column:
    return _steps(text)[2]


def redaction_counts(text: Column) -> dict[str, Column]:
    no_blocks, no_headers, _ = _steps(text)
    return {
        "key_block": F.regexp_count(text, F.lit(KEY_BLOCK)),
        "header": F.regexp_count(no_blocks, F.lit(HEADER)),
        "assignment": F.regexp_count(no_headers, F.lit(ASSIGNMENT)),
    }
