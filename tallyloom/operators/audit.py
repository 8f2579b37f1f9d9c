"""Scrubbing of audit details, and opaque tokens."""

from __future__ import annotations

import base64
import json
import posixpath
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keys whose text is hidden, and what hides it.
HIDDEN_KEYS = {"notes", "remarks", "expected_confirmation"}
REDACTED = "[redacted]"


def _base(text: str) -> str:
    name = posixpath.basename(posixpath.normpath(text.strip().replace("\\", "/"))) if text.strip() else ""
    return "" if name in (".", "/") else name


def scrub(value: Any, key: str = "") -> Any:
    """value with hidden texts redacted, paths cut to their last part and strings trimmed, at any depth."""
    if isinstance(value, dict):
        return {k: scrub(v, k) for k, v in value.items()}
    if isinstance(value, list):
        return [scrub(v, key) for v in value]
    name = key.strip().lower()
    if name in HIDDEN_KEYS:
        return REDACTED if value not in (None, "") else value
    if isinstance(value, str):
        return _base(value) if "path" in name or "file" in name or name == "source_reference" else value.strip()
    return value


@F.pandas_udf(T.StringType())
def scrubbed_json(details: pd.Series) -> pd.Series:
    """JSON text scrubbed; text that is no JSON becomes null, null stays null."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(scrub(json.loads(text)), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except ValueError:
            return None

    return details.map(one)


def details(**fields: Column | str) -> Column:
    """A details text of named columns."""
    return F.to_json(F.struct(*((c if isinstance(c, Column) else F.col(c)).alias(k) for k, c in fields.items())))


def client_filter(page: DataFrame, value: str, columns: tuple[str, ...] = ("operator_name", "status", "import_id")) -> DataFrame:
    """Rows of an already fetched page of which a column contains the value in any case."""
    needle = value.strip().lower()
    hit = F.lit(not needle)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.trim(c)), F.lit(needle)), F.lit(False))
    return page.where(hit)


def encode_token(fields: dict) -> str:
    return base64.urlsafe_b64encode(json.dumps(fields, sort_keys=True).encode()).decode().rstrip("=")


def decode_token(token: str) -> dict:
    try:
        out = json.loads(base64.urlsafe_b64decode(token.strip() + "=" * (-len(token.strip()) % 4)))
    except ValueError as e:
        raise ValueError("the token can't be read") from e
    if not isinstance(out, dict):
        raise ValueError("the token can't be read")
    return out
