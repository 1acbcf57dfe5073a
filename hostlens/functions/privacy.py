"""Pseudonyms and redaction with built-in string functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECRET, CREDENTIAL, SECRET_PATH = "[REDACTED]", "[REDACTED_CREDENTIAL]", "[REDACTED_PATH]"
# Patterns of credentials in text (the second group is the secret), of sensitive paths, and words in keys.
CREDENTIALS = (
    r"(?i)(?:password|passwd|pwd|secret|token|bearer|api[_-]?key|auth|credential)[=:\s]+(['\"]?)([^'\"\s&]+)\1",
    r"(?i)(?:--password|--token|--api-key|--secret)[=:\s]+(['\"]?)([^'\"\s]+)\1",
)
PATHS = (
    r"(?i)^[^\n]*[/\\]\.ssh[/\\][^\n]+\n?$", r"(?i)^[^\n]*[/\\]\.gnupg[/\\][^\n]+\n?$", r"(?i)^[^\n]*[/\\]\.aws[/\\]credentials[^\n]*\n?$",
    r"(?i)^[^\n]*[/\\]\.docker[/\\]config\.json[^\n]*\n?$", r"(?i)^[^\n]*[/\\]\.config[/\\]gcloud[^\n]*\n?$",
)
KEY_WORDS = ("password", "passwd", "secret", "private_key", "token", "auth", "api_key", "apikey", "credential")
TOKEN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key", "key=")


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def program_id(executable: str | Column, comm: str | Column) -> Column:
    """Identity of a program: 12 hex digits of its path, else its name, else ``?``."""
    name = F.coalesce(F.nullif(_c(executable), F.lit("")), F.nullif(_c(comm), F.lit("")), F.lit("?"))
    return F.substring(F.sha1(name.cast("binary")), 1, 12)


def path_pseudonym(path: str | Column, salt: str) -> Column:
    """16 hex digits of the salted path, with an extension of at most 8 characters kept."""
    p = _c(path)
    ext = F.regexp_extract(F.substring_index(p, "/", -1), r"[^.](\.[A-Za-z0-9]{1,7})$", 1)
    return F.concat(F.substring(F.sha2(F.concat(F.lit(salt), p), 256), 1, 16), ext)


def hashed(value: str | Column, digits: int = 64) -> Column:
    return F.concat(F.lit("h_"), F.substring(F.sha2(_c(value), 256), 1, digits))


def redact_command(tokens: str | Column) -> Column:
    """Hide tokens that look like secrets, join, keep 512 characters."""

    def one(t: Column) -> Column:
        low = F.lower(t)
        secret = (t.contains("=") & (F.length(t) > 20))
        for w in TOKEN_WORDS:
            secret = secret | low.contains(w)
        return F.when(secret, F.lit(SECRET)).otherwise(t)

    return F.substring(F.array_join(F.transform(_c(tokens), one), " "), 1, 512)


def redact_text(text: str | Column) -> Column:
    """Hide credentials, then the whole text if it is a sensitive path. Null stays null."""
    t = _c(text)
    for p in CREDENTIALS:
        t = F.regexp_replace(t, p, f"$1{SECRET.replace('[', r'\[').replace(']', r'\]')}$1")
    is_path = F.lit(False)
    for p in PATHS:
        is_path = is_path | t.rlike(p)
    return F.when(is_path, F.lit(SECRET_PATH)).otherwise(t)


def redact_nested(value: str | Column, kind: T.DataType) -> Column:
    """Redact a value of any type: text in structs, maps and lists at every depth; a text under a telling key is hidden
    as a whole, another value under it becomes null. Numbers and the like stay."""
    x = _c(value)
    if isinstance(kind, T.StringType):
        return redact_text(x)
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda v: redact_nested(v, kind.elementType))
    if isinstance(kind, T.MapType):
        text = isinstance(kind.valueType, T.StringType)
        hidden = F.lit(CREDENTIAL) if text else F.lit(None).cast(kind.valueType)
        return F.transform_values(x, lambda k, v: F.when(_telling(k), hidden).otherwise(redact_nested(v, kind.valueType)))
    if isinstance(kind, T.StructType):
        told = lambda f: any(w in f.name.lower() for w in KEY_WORDS)
        hidden = lambda f: F.lit(CREDENTIAL) if isinstance(f.dataType, T.StringType) else F.lit(None).cast(f.dataType)
        fields = [(hidden(f) if told(f) else redact_nested(x[f.name], f.dataType)).alias(f.name) for f in kind.fields]
        return F.when(x.isNotNull(), F.struct(*fields))
    return x


def _telling(key: Column) -> Column:
    telling = F.lit(False)
    for w in KEY_WORDS:
        telling = telling | F.lower(key).contains(w)
    return telling


def redact_map(entries: str | Column) -> Column:
    """Hide values under telling keys, and credentials in the others."""

    def one(key: Column, value: Column) -> Column:
        return F.when(_telling(key), F.lit(CREDENTIAL)).otherwise(redact_text(value))

    return F.transform_values(_c(entries), one)
