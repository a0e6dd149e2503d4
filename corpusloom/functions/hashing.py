"""Content addresses: canonical JSON, digests, unit and node ids."""

from __future__ import annotations

import base64
import hashlib
import json
import math
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def canonical(value: object) -> str:
    """JSON with keys in code-point order, composed strings and finite numbers only."""
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    if isinstance(value, str):
        return json.dumps(unicodedata.normalize("NFC", value), ensure_ascii=False)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("JSON has no such number")
        return str(int(value)) if value == int(value) and abs(value) < 1e21 else repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, dict):
        if not all(isinstance(k, str) for k in value):
            raise TypeError("keys must be strings")
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in sorted(value)) + "}"
    raise TypeError(f"{type(value).__name__} has no JSON form")


def canonical_struct(**fields: Column) -> Column:
    """Canonical JSON of string fields, in the engine."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def base32_lower(raw: bytes, length: int = 20) -> str:
    return base64.b32encode(raw).decode().lower().rstrip("=")[:length]


def short_id(prefix: str, value: object) -> str:
    return f"{prefix}_{base32_lower(hashlib.sha256(canonical(value).encode()).digest())}"


@F.pandas_udf(StringType())
def unit_id(digest: pd.Series) -> pd.Series:
    """Identifier of a unit from the hexadecimal digest of its content."""
    return digest.map(lambda x: None if x is None else "u_" + base32_lower(bytes.fromhex(x)))


def unit_digest(category: Column, text: Column) -> Column:
    return sha256_hex(canonical_struct(category=category, text=text))
